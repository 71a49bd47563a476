"""JSON and tab-separated exports, and reading the JSON back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import counters as K


def to_json_lines(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON text per row, keys in the given column order, nulls left out."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("json"))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Exported rows back; ``schema`` has conf as map<string,string> and counters nested."""
    return spark.read.schema(schema).json(path)


def parse_json_lines(lines: DataFrame, schema: str, column: str = "json") -> DataFrame:
    return lines.select(F.from_json(column, schema).alias("row")).select("row.*")


EXPORTED_JOB = (
    "cluster string, user_name string, app_id string, run_id bigint, job_id string, job_status string, "
    "total_maps bigint, total_reduces bigint, conf map<string,string>, "
    f"counters {K.NESTED}, map_counters {K.NESTED}, reduce_counters {K.NESTED}"
)


def tab_separated(columns: dict[str, Column], null_string: str = "", null_number: str = "0") -> Column:
    """One tab-separated line. Counter and total columns use the number placeholder."""

    def is_number(name: str) -> bool:
        return name.startswith(("g!", "gm!", "gr!", "total"))

    cells = [
        F.coalesce(c.cast("string"), F.lit(null_number if is_number(name) else null_string))
        for name, c in columns.items()
    ]
    return F.concat_ws("\t", *cells)


def write_text(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.write.mode(mode).text(path)
