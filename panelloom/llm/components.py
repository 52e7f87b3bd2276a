"""Connected components by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import sized, written

#: Vertices with more neighbours get theirs by a table sent to all tasks, so their neighbours need not meet in one.
HOT = 100


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id of ``edges`` with the smallest id that it reaches.

    Each step joins every vertex with the least vertex of its neighbourhood, so depth shrinks
    geometrically; minima are taken with partial aggregates, and the neighbours of a vertex that has very many
    stay where they are.  Null ends and loops are ignored; no edges give no rows.
    """
    e = written(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m"), (F.col(a) != F.col(b)).alias("_use"))
                .where("_use").select("v", "m").distinct(), "edges")
    while not _stars(e):
        both = e.select(F.col("v").alias("u"), F.col("m").alias("w")).union(e.select(F.col("m"), F.col("v")))
        least = both.groupBy("u").agg(F.min("w").alias("_m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "_m").alias("least"), "n")
        large = _with_least(both, least, "u").where("w > u").select(F.col("w").alias("v"), F.col("least").alias("m"))
        low = large.groupBy("v").agg(F.min("m").alias("least"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, low, "v").where("m != least").select(F.col("m").alias("v"), F.col("least").alias("m"))
        e = written(low.select("v", F.col("least").alias("m")).union(small).distinct(), "edges")
    roots = e.select(F.col("m").alias("id")).distinct()
    return e.select(F.col("v").alias("id"), F.col("m").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def _with_least(rows: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """The rows with the ``least`` of their key (key, least, n); keys of more than HOT rows do not shuffle theirs."""
    hot = written(least.where(F.col("n") > HOT).drop("n"), "hot")
    if hot.isEmpty():
        return rows.join(least.drop("n"), key)
    return rows.join(least.where(F.col("n") <= HOT).drop("n"), key).unionByName(rows.join(sized(hot), key))


def _stars(e: DataFrame) -> bool:
    """Whether every vertex has one least neighbour, and no vertex that has one is one."""
    ends = e.select(F.col("v").alias("x"), F.lit(1).alias("has"), F.lit(0).alias("is")).union(e.select("m", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("has").alias("has"), F.max("is").alias("is")).where("has > 1 or (has = 1 and is = 1)").isEmpty()
