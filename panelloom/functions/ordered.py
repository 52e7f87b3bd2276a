"""Ordered operators that stay parallel inside one key.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task.  Here every
key is cut into chunks by a column that never decreases along the sort order (for a
time series: ``floor(t / width)``).  Rows are windowed per (key, chunk); only one
summary row per chunk crosses chunk borders, so a key that holds a third of the data
is spread over as many tasks as it has chunks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


#: Types whose extremes by another column are kept in fixed-width aggregation buffers.
FIXED_WIDTH = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz"}
#: Stands for a null chunk.
NO_CHUNK = -(1 << 62)


def attach(df: DataFrame, small: DataFrame, keys) -> DataFrame:
    """Left join by ``keys`` in which null equals null, so a group with a null key keeps its row."""
    keys = list(keys)
    right = small.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_a{i}"))
    return df.join(right, on, "left").drop(*[f"_a{i}" for i in range(len(keys))])


def _cols(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def carry(df: DataFrame, keys, chunk: str, order, *, prev=None, nxt=None, sums=None,
          sums_before=None, sums_after=None, totals=None, folds=None) -> DataFrame:
    """Add lag / lead / running-sum columns computed chunk by chunk.

    prev, nxt:    {output: column} value of the previous / next row of the key
    sums:         {output: expression} running sum including the row
    sums_before:  {output: expression} running sum excluding the row
    sums_after:   {output: expression} sum of the row and all later ones (order: names of columns)
    totals:       {output: expression} sum over the key
    folds:        {output: (F.max or F.min, expression)} running extreme including the row
    """
    prev, nxt = prev or {}, nxt or {}
    sums, before, folds = sums or {}, sums_before or {}, folds or {}
    after, totals = sums_after or {}, totals or {}
    keys, order = list(keys), list(order)
    part = keys + [chunk]
    # one long stands for the keys, nulls included, so that join and window share one exchange by plain
    # equality; two keys meet only if all 64 bits and the chunk agree
    df = df.withColumns({"_kh": F.xxhash64(*keys) if keys else F.lit(0).cast("long"), "_kc": F.coalesce(F.col(chunk).cast("long"), F.lit(NO_CHUNK))})
    single = len(order) == 1
    pos = _c(order[0]) if single else F.struct(*_cols(order))
    kind = dict(df.select(*[_c(c).alias(o) for o, c in {**prev, **nxt}.items()]).dtypes)
    # fixed-width values under one order column stay in a hash aggregate
    plain = lambda o: single and kind[o] in FIXED_WIDTH
    boxed = lambda o, c: _c(c) if plain(o) else F.struct(_c(c).alias("v"))
    ends = df.groupBy("_kh", *keys, "_kc").agg(
        *[F.max_by(boxed(o, c), pos).alias(f"_l_{o}") for o, c in prev.items()],
        *[F.min_by(boxed(o, c), pos).alias(f"_f_{o}") for o, c in nxt.items()],
        *[F.sum(_c(c)).alias(f"_s_{o}") for o, c in {**sums, **before, **after, **totals}.items()],
        *[fn(_c(c)).alias(f"_x_{o}") for o, (fn, c) in folds.items()])
    across = W.partitionBy("_kh", *keys).orderBy("_kc")
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("_kh", *keys).orderBy(F.desc("_kc")).rowsBetween(W.unboundedPreceding, -1)
    value = lambda side, o: F.col(f"{side}{o}") if plain(o) else F.col(f"{side}{o}")["v"]
    summary = ends.select(
        F.col("_kh"), F.col("_kc"),
        *[F.lag(value("_l_", o)).over(across).alias(f"_l_{o}") for o in prev],
        *[F.lead(value("_f_", o)).over(across).alias(f"_f_{o}") for o in nxt],
        *[F.sum(f"_s_{o}").over(earlier).alias(f"_s_{o}") for o in {**sums, **before}],
        *[F.sum(f"_s_{o}").over(later).alias(f"_s_{o}") for o in after],
        *[F.sum(f"_s_{o}").over(W.partitionBy("_kh", *keys)).alias(f"_s_{o}") for o in totals],
        *[fn(f"_x_{o}").over(earlier).alias(f"_x_{o}") for o, (fn, _) in folds.items()])
    out = df.join(summary, ["_kh", "_kc"])
    local = W.partitionBy("_kh", "_kc", *part).orderBy(*_cols(order))
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    strictly = local.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    adds = {}
    for o, c in prev.items():
        adds[o] = F.when(F.lag(F.lit(1)).over(local).isNotNull(), F.lag(_c(c)).over(local)).otherwise(F.col(f"_l_{o}"))
    for o, c in nxt.items():
        adds[o] = F.when(F.lead(F.lit(1)).over(local).isNotNull(), F.lead(_c(c)).over(local)).otherwise(F.col(f"_f_{o}"))
    for o, c in sums.items():
        adds[o] = F.coalesce(F.sum(_c(c)).over(upto), zero) + F.coalesce(F.col(f"_s_{o}"), zero)
    for o, c in before.items():
        adds[o] = F.coalesce(F.sum(_c(c)).over(strictly), zero) + F.coalesce(F.col(f"_s_{o}"), zero)
    if after:
        back = W.partitionBy("_kh", "_kc", *part).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
        for o, c in after.items():
            adds[o] = F.coalesce(F.sum(_c(c)).over(back), zero) + F.coalesce(F.col(f"_s_{o}"), zero)
    for o in totals:
        adds[o] = F.coalesce(F.col(f"_s_{o}"), zero)
    for o, (fn, c) in folds.items():
        pick = F.greatest if fn is F.max else F.least
        adds[o] = pick(fn(_c(c)).over(upto), F.col(f"_x_{o}"))
    return out.withColumns(adds).drop(*summary.columns)


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def halo(df: DataFrame, keys, index: str, before: int, after: int, block: int = 1024) -> tuple[DataFrame, list]:
    """Rows plus copies of their neighbours, so that a bounded frame fits in one chunk.

    ``index`` is a dense zero-based position inside ``keys``.  Returns the frame with
    ``_chunk`` and ``_own``, and the window partition to use; keep rows with ``_own`` after
    the window columns are added.
    """
    own = F.floor(F.col(index) / block)
    homes = F.array_distinct(F.array(own, F.floor((F.col(index) + before) / block),
                                     F.floor((F.col(index) - after) / block)))
    d = df.withColumn("_chunk", F.explode(homes)).withColumn("_own", F.col("_chunk") == own)
    return d, list(keys) + ["_chunk"]


def value_chunk(v: Column, per_octave: int = 256) -> Column:
    """A monotone integer of a double that needs no look at the data.

    ``log2`` of the magnitude is cut into ``per_octave`` steps, mirrored for negative
    values, so equal cuts are computed in every branch and retry of a plan.
    """
    a = F.abs(v)
    step = F.floor((F.log2(F.greatest(a, F.lit(1e-12))) + 40.0) * per_octave) + 1
    return F.when(a < 1e-12, F.lit(0)).otherwise(F.signum(v).cast("long") * step).cast("long")   # null stays null


#: Distinct values of a key in one chunk from which the chunk is cut further.
CROWD = 65_536
_FINE = 1 << 20


def with_chunks(folded: DataFrame, keys, value: str) -> DataFrame:
    """Distinct values per key with ``_chunk``: ``value_chunk``, cut evenly between least and greatest where many values lie in a narrow band.

    Counts, least and greatest are exact, so every branch and retry cuts alike.  Only crowded chunks are listed, at most one
    for each CROWD distinct values, and that list is sent to all tasks, so the values are not shuffled once more."""
    keys = list(keys)
    d = folded.withColumn("_coarse", value_chunk(F.col(value)))
    crowded = d.groupBy(*keys, "_coarse").agg(F.count(F.lit(1)).alias("_cn"), F.min(value).alias("_clo"), F.max(value).alias("_chi")).where(F.col("_cn") > CROWD)
    d = attach(d, F.broadcast(crowded), [*keys, "_coarse"])
    parts = F.least(F.lit(_FINE), F.ceil(2.0 * F.col("_cn") / CROWD))
    fine = F.least(parts - 1, F.floor((F.col(value) - F.col("_clo")) / (F.col("_chi") - F.col("_clo")) * parts))
    fine = F.when(F.col("_chi") > F.col("_clo"), F.greatest(F.lit(0), fine)).otherwise(0)
    return d.withColumn("_chunk", (F.col("_coarse") * (2 * _FINE) + F.coalesce(fine, F.lit(0))).cast("long")).drop("_coarse", "_cn", "_clo", "_chi")


def ranks(df: DataFrame, keys, value: str, out: str = "rank", *, n_out: str | None = None,
          weight: Column | None = None) -> DataFrame:
    """Tie-averaged ranks of ``value`` inside ``keys`` (ascending, from 1).

    Equal values are folded to one row first, so a value shared by a third of the rows is
    one row in the window; the window runs over (keys, value chunk).
    """
    keys = list(keys)
    w = F.lit(1) if weight is None else weight
    folded = with_chunks(df.groupBy(*keys, value).agg(F.sum(w).alias("_n")), keys, value)
    folded = carry(folded, keys, "_chunk", [value], sums_before={"_below": "_n"})
    folded = folded.withColumn(out, F.col("_below") + (F.col("_n") + 1) / 2.0)
    keep = [out] + ([n_out] if n_out else [])
    if n_out:
        folded = folded.withColumnRenamed("_n", n_out)
    return attach(df, folded.select(*keys, value, *keep), keys + [value])


def row_numbers(df: DataFrame, keys, value: str, tiebreak: str, out: str = "rn", *,
                descending: bool = False, tie_bits: int = 38) -> DataFrame:
    """Row number by (value, tiebreak) with ``tiebreak`` a unique 48-bit hash, from 1.

    Rows below a value come from the folded distribution of values; rows inside a tie are
    numbered per (value, block of hashes): the bits above ``tie_bits`` name one of 1,024 blocks.
    Null values come first.
    """
    keys = list(keys)
    v = F.col(value) if not descending else -F.col(value)
    d = df.withColumn("_v", v.cast("double"))
    folded = with_chunks(d.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), keys, "_v")
    folded = carry(folded, keys, "_chunk", ["_v"], sums_before={"_below": "_n"})
    d = attach(d, folded.select(*keys, "_v", "_below"), keys + ["_v"])
    d = d.withColumn("_tb", F.shiftright(F.col(tiebreak).cast("long"), tie_bits))
    d = carry(d, keys + ["_v"], "_tb", [tiebreak], sums={"_in": F.lit(1)})
    return d.withColumn(out, (F.col("_below") + F.col("_in")).cast("long")).drop("_v", "_below", "_in", "_tb")


def count_below(df: DataFrame, keys, value: str, weight_out: dict) -> DataFrame:
    """Per distinct (keys, value): running totals of weights strictly below the value.

    weight_out: {name: expression}; returns one row per value with ``name`` (at the value)
    and ``name_below``.
    """
    keys = list(keys)
    folded = with_chunks(df.groupBy(*keys, value).agg(*[F.sum(e).alias(n) for n, e in weight_out.items()]), keys, value)
    folded = carry(folded, keys, "_chunk", [value],
                   sums_before={f"{n}_below": n for n in weight_out})
    return folded.drop("_chunk")


def quantiles(df: DataFrame, keys, value: str, qs: dict[str, float], n_out: str | None = None) -> DataFrame:
    """Exact interpolated quantiles per key, without gathering a key in one task.

    The distinct values are counted and cumulated by chunk; the two order statistics around
    ``q (n - 1)`` are then picked by a hash aggregate.
    """
    keys = list(keys)
    d = df.filter(F.col(value).isNotNull())
    if not keys:
        d, keys = d.withColumn("_all", F.lit(0)), ["_all"]
    f = count_below(d, keys, value, {"_w": F.lit(1)})
    j = attach(f, f.groupBy(*keys).agg(F.sum("_w").alias("_n")), keys)
    aggs = [F.first("_n").alias("_n")]
    for i, q in enumerate(qs.values()):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        for side, at in (("a", F.floor(pos)), ("b", F.ceil(pos))):
            hit = (F.col("_w_below") <= at) & (at < F.col("_w_below") + F.col("_w"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}{i}"))
    g = j.groupBy(*keys).agg(*aggs)
    out = []
    for i, (name, q) in enumerate(qs.items()):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        out.append((F.col(f"_a{i}") + (pos - F.floor(pos)) * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(name))
    extra = [F.col("_n").alias(n_out)] if n_out else []
    return g.select(*[k for k in keys if k != "_all"], *out, *extra)


def order_statistics(df: DataFrame, keys, value: str, index: Column, out: str) -> DataFrame:
    """The value at zero-based position ``index`` (an expression over ``_n``, the group size)."""
    keys = list(keys)
    f = count_below(df.filter(F.col(value).isNotNull()), keys, value, {"_w": F.lit(1)})
    totals = f.groupBy(*keys).agg(F.sum("_w").alias("_n")).withColumn("_i", index)
    cond = (F.col("_i") >= F.col("_w_below")) & (F.col("_i") < F.col("_w_below") + F.col("_w"))
    if not keys:
        j = f.crossJoin(totals)   # one row on the right: the global count
    else:
        j = attach(f, totals, keys)
    return j.filter(cond).select(*keys, F.col(value).alias(out), F.col("_n").alias(f"{out}_n"))
