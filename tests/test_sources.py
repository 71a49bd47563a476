"""Property files, archives and exports."""

from pyspark.sql import functions as F

from runledger.sources import export, files, properties


def test_property_files(spark, tmp_path):
    path = tmp_path / "p"
    path.write_text("# comment\n  ! comment\n\nhost1 = c1\nhost2:c2\nhost\\:8021=c 3  \nbare\nbig.computecost=10\nbig.machinememory = 24576\n"
                    "odd.type.computecost=x\nodd.type.machinememory=5\n")
    rows = {r.key: r.value for r in properties.read_properties(spark, str(path)).collect()}
    assert rows["host1"] == "c1" and rows["host2"] == "c2" and rows["host:8021"] == "c 3" and rows["bare"] == "" and len(rows) == 8
    rates = {r.machine_type: (r.compute_cost, r.machine_memory) for r in properties.read_rates(spark, str(path)).collect()}
    assert rates == {"big": (10.0, 24576), "odd.type": (0.0, 5)}
    assert {r.host: r.cluster for r in properties.read_clusters(spark, str(path)).collect()}["host1"] == "c1"


def test_archive_takes_every_file_once(spark, tmp_path):
    root = str(tmp_path / "done")
    rows = spark.createDataFrame([("in/a", 0, b"1"), ("in/b", 86_400_000, b"2"), ("in/b", 86_400_000, b"2"), ("in/c", 86_400_001, b"3")],
                                 "path string, mod_time bigint, content binary")
    assert files.archived(spark, root) is None
    files.archive(rows.where("path = 'in/a'"), root)
    files.archive(rows, root)
    files.archive(rows, root)
    got = spark.read.parquet(root).collect()
    assert sorted((r.path, bytes(r.content), r.year, r.month, r.day) for r in got) == [("in/a", b"1", 1970, 1, 1), ("in/b", b"2", 1970, 1, 2), ("in/c", b"3", 1970, 1, 2)]
    assert {r.target_path for r in files.archived(spark, root).collect()} == {f"{root}/1970/01/01/a", f"{root}/1970/01/02/b", f"{root}/1970/01/02/c"}


def test_an_archive_of_many_days_has_few_folders(spark, tmp_path):
    root = tmp_path / "done"
    day = F.col("id") * 86_400_000
    rows = spark.range(800).select(F.concat(F.lit("in/f"), F.col("id")).alias("path"), day.alias("mod_time"), F.col("id").alias("length"))
    for part in (rows.where("id % 3 = 0"), rows, rows):
        files.archive(part, str(root))
    assert {p.name for p in root.iterdir() if p.is_dir()} == {"year=1970", "year=1971", "year=1972"}
    assert len(list(root.rglob("*.parquet"))) < 60
    got = spark.read.parquet(str(root))
    assert [f.dataType.typeName() for f in got.select("year", "month", "day").schema] == ["integer"] * 3
    date = F.make_date("year", "month", "day")
    assert got.count() == 800 and got.where(F.date_diff(date, F.lit("1970-01-01").cast("date")) == F.col("length")).count() == 800


def test_exported_jobs_read_back_as_they_were(spark, tmp_path):
    path = str(tmp_path / "json")
    rows = spark.createDataFrame([("c", "u", "a", 1, "job_1_0001", "O", 3, None, {"k": "v", "e": ""}, {"g": {"x": 5}}, {}, None)], export.EXPORTED_JOB)
    export.write_json(rows, path)
    assert export.read_json(spark, path, export.EXPORTED_JOB).collect() == rows.collect()
    export.write_text(rows.select(export.tab_separated({"job": F.col("job_id"), "total_maps": F.col("total_reduces")}, null_number="none")), str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["job_1_0001\tnone"]
