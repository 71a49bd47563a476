"""Global positions and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir

_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the 1-based position of every row in a total order, without one task seeing all rows.

    Rows are range-partitioned and numbered inside their slice; the slice sizes, one row per
    slice, give the offsets. The order has to be total, so that ties spread over slices. The
    numbered rows are checkpointed: both uses must see the same slices.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = (
        df.repartitionByRange(slices, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .select(
            *df.columns,
            F.shiftright("_id", 33).alias("_slice"),
            F.col("_id").bitwiseAND(F.lit(_ROW_BITS)).alias("_at"),
        )
        .checkpoint()
    )
    sizes = numbered.groupBy("_slice").agg(F.count("*").alias("_rows"))
    # at most one row per slice reaches this window
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return numbered.join(offsets, "_slice").select(
        *df.columns, (F.col("_offset") + F.col("_at") + 1).alias(name)
    )


def page(df: DataFrame, order: list[Column], limit: int, start: Column | None = None) -> DataFrame:
    """One page in a total order: ``limit`` rows plus the first row of the next page; 0: all rows.

    ``start`` is the condition "at or behind the start key". The extra row is marked
    ``is_next``; its key is the start key of the following page.
    """
    rows = df if start is None else df.filter(start)
    if limit == 0:
        return with_position(rows, order, "page_row").withColumn("is_next", F.lit(False))
    cut = rows.orderBy(*order).limit(limit + 1)
    # the window sees limit + 1 rows
    numbered = cut.withColumn("page_row", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return numbered.withColumn("is_next", F.col("page_row") > limit)
