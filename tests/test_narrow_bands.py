"""Ranks, row numbers and quantiles where most values lie in a narrow band and one value is on a third of the rows."""
import numpy as np
from pyspark.sql import functions as F

from panelloom.functions import ordered as O


def band(spark, n=6000):
    wide = spark.range(n).select(F.when(F.col("id") % 3 == 0, 2.901).otherwise(2.9 + (F.xxhash64("id") % 1_000_000).cast("double") / 1e9).alias("v"),
                                 (F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2 ** 48)).alias("t"))
    return wide.union(spark.createDataFrame([(None, 0, 5), (-1.0, 1, 6), (0.0, 0, 7), (1e300, 1, 8)], "v double, g long, t long"))


def test_chunks_stay_small_and_ordered(spark, monkeypatch):
    monkeypatch.setattr(O, "CROWD", 200)
    folded = band(spark).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    one = folded.withColumn("c", O.value_chunk(F.col("v"))).groupBy("g", "c").count().agg(F.max("count")).first()[0]
    rows = O.with_chunks(folded, ["g"], "v").where("v is not null").collect()
    size = {}
    for r in rows:
        size[r["g"], r["_chunk"]] = size.get((r["g"], r["_chunk"]), 0) + 1
    assert one > 1500 and max(size.values()) < 400
    for g in (0, 1):
        line = sorted((r["v"], r["_chunk"]) for r in rows if r["g"] == g)
        assert [c for _, c in line] == sorted(c for _, c in line)


def test_same_results_cut_or_not(spark, monkeypatch):
    df = band(spark)
    out = []
    for crowd in (10 ** 9, 50):
        monkeypatch.setattr(O, "CROWD", crowd)
        ranks = sorted(((r["g"], r["v"], r["rank"]) for r in O.ranks(df.where("v is not null"), ["g"], "v").collect()), key=str)
        numbers = sorted(((r["g"], r["t"], r["rn"]) for r in O.row_numbers(df, ["g"], "v", "t").collect()), key=str)
        q = sorted(map(tuple, O.quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()))
        out.append((ranks, numbers, q))
    assert out[0] == out[1]
    values = {g: np.array([r["v"] for r in df.where(f"g = {g} and v is not null").collect()]) for g in (0, 1)}
    for g, a, b, c in out[1][2]:
        assert np.allclose([a, b, c], np.quantile(values[g], [0.1, 0.5, 0.99]), rtol=1e-12)
