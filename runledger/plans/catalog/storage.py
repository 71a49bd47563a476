"""Storage usage queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ...functions import paths as P
from ...operators import storage as O
from ...session import new_work_path
from ..views import Views
from .registry import merged_sql, query

HOUR = 1704153600  # 2024-01-02 00:00, epoch seconds
WEEK_AGO, NOW = 1704067200, 1704672000


@query("storage_newest_cells", "W15", "SELECT * FROM usage", "usage")
def storage_newest_cells(v: Views):
    return v.hdfs_usage()


@query("storage_three_versions", "W15", """
SELECT * FROM usage_writes QUALIFY row_number() OVER
  (PARTITION BY cluster, path ORDER BY write_ts DESC) <= 3""", "usage_writes")
def storage_three_versions(v: Views):
    return O.newest_cells(v.usage_writes(), ["cluster", "path"], ["write_ts"], keep=3)


@query("storage_merged", "A10 F34", "SELECT * FROM merged_usage", "merged_usage")
def storage_merged(v: Views):
    return O.merge_namespaces(v.hdfs_usage())


@query("storage_snapshot", "P25 F25", merged_sql("usage", f"run_id = {HOUR} AND path LIKE '/view%'"), "usage")
def storage_snapshot(v: Views):
    return O.snapshot(v.hdfs_usage(), None, HOUR + 1234, "/view")


@query("storage_snapshot_limited", "P25 N6", merged_sql("usage", f"run_id = {HOUR}") + """
ORDER BY cluster, path, run_id DESC LIMIT 5""", "usage")
def storage_snapshot_limited(v: Views):
    return O.snapshot(v.hdfs_usage(), None, HOUR, limit=5)


@query("storage_as_of", "J8", """
SELECT m.* FROM merged_usage m JOIN (SELECT cluster, max(run_id) AS run_id FROM usage WHERE run_id <= 1704240000 GROUP BY cluster)
USING (cluster, run_id)""", "usage merged_usage")
def storage_as_of(v: Views):
    return O.snapshot_as_of(v.hdfs_usage(), None, 1704240000 + 59)


@query("storage_as_of_path", "J8", """
SELECT m.* FROM merged_usage m JOIN (
  SELECT cluster, max(run_id) AS run_id FROM usage WHERE path LIKE '/error/1%' AND run_id <= 1704240000 GROUP BY cluster)
USING (cluster, run_id) WHERE path LIKE '/error/1%'""", "usage merged_usage")
def storage_as_of_path(v: Views):
    return O.snapshot_as_of(v.hdfs_usage(), None, 1704240000, "/error/1")


@query("storage_series", "P26", merged_sql("usage", f"lower(path) = '/view/7' AND run_id BETWEEN {WEEK_AGO} AND {NOW}"), "usage")
def storage_series(v: Views):
    return O.series(v.hdfs_usage(), None, "/VIEW/7", NOW, WEEK_AGO)


@query("storage_order", "W10", """
SELECT cluster, path, run_id, CAST(row_number() OVER (PARTITION BY cluster, path ORDER BY run_id DESC) AS BIGINT) AS age
FROM merged_usage""", "merged_usage")
def storage_order(v: Views):
    merged = O.merge_namespaces(v.hdfs_usage())
    newest = Window.partitionBy("cluster", "path").orderBy(F.col("run_id").desc())
    # hours of one path: bounded by time, not by the number of rows
    return O.order(merged.select("cluster", "path", "run_id").withColumn("age", F.row_number().over(newest).cast("bigint")))


@query("qualified_path_match", "F37", """
SELECT a.cluster, a.path, a.run_id, a.namespace, (nullif(a.namespace, 'ns2') IS NULL OR a.namespace = 'ns1') AS matches
FROM usage a""", "usage")
def qualified_path_match(v: Views):
    usage = v.hdfs_usage()
    ns = F.nullif("namespace", F.lit("ns2"))
    return usage.select(
        "cluster", "path", "run_id", "namespace",
        P.same_qualified_path(F.col("cluster"), F.col("path"), ns, F.col("cluster"), F.col("path"), F.lit("ns1")).alias("matches"),
    )


@query("qualified_paths_of_two_listings", "F37", """
SELECT a.cluster, a.path, a.namespace, b.cluster AS other_cluster, b.namespace AS other_namespace, count(*) AS pairs,
  count(*) FILTER (a.cluster = b.cluster AND (nullif(a.namespace, 'ns2') IS NULL OR a.namespace = b.namespace)) AS matches
FROM usage a JOIN usage b ON a.path = b.path AND b.run_id = a.run_id GROUP BY ALL""", "usage")
def qualified_paths_of_two_listings(v: Views):
    """Rows of one hour and path against each other, over clusters and namespaces."""
    a, b = v.hdfs_usage(), v.hdfs_usage().select("path", "run_id", F.col("cluster").alias("other_cluster"), F.col("namespace").alias("other_namespace"))
    both = a.join(b, ["path", "run_id"])
    same = P.same_qualified_path(F.col("cluster"), F.col("path"), F.nullif("namespace", F.lit("ns2")), F.col("other_cluster"), F.col("path"), F.col("other_namespace"))
    return both.groupBy("cluster", "path", "namespace", "other_cluster", "other_namespace").agg(F.count("*").alias("pairs"), F.count_if(same).alias("matches"))


@query("storage_stored_by_day", "P25 P26 J8 A10", f"""
SELECT 'as of' AS reading, * FROM ({merged_sql("usage", "run_id = (SELECT max(u.run_id) FROM usage u WHERE u.cluster = usage.cluster AND u.run_id <= 1704240000)")})
UNION ALL SELECT 'series', * FROM ({merged_sql("usage", f"lower(path) = '/view/7' AND run_id BETWEEN {WEEK_AGO} AND {NOW}")})""", "usage")
def storage_stored_by_day(v: Views):
    """As-of look-up and series on the usage written by day."""
    path = new_work_path(v.spark, "usage")
    O.write_usage(v.hdfs_usage(), path)
    stored = v.spark.read.parquet(path)
    as_of, series = O.snapshot_as_of(stored, None, 1704240000 + 59), O.series(stored, None, "/VIEW/7", NOW, WEEK_AGO)
    return as_of.select(F.lit("as of").alias("reading"), "*").unionByName(series.select(F.lit("series").alias("reading"), "*"))
