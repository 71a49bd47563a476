"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned


def _toward_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every node u hands its smallest neighbour m (or itself) to its neighbours.

    ``larger_only``: to the neighbours above u, seeing all of them (large-star);
    otherwise to those below u and to u itself, seeing only those (small-star).
    """
    if larger_only:
        seen = edges.union(edges.select("b", "a")).toDF("u", "v")
    else:
        seen = edges.toDF("u", "v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    told = seen.join(least, "u")
    if larger_only:
        told = told.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        told = told.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a <> b")
    return told.distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: two columns of long node ids. Gives (node, component), component being the
    smallest id reachable; nodes without a link to another node do not appear."""
    a, b = links.columns
    edges = pinned(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    before = None
    while True:
        edges = pinned(_toward_minimum(_toward_minimum(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.toDF("node", "component")
    return stars.union(stars.select("component", "component")).distinct()
