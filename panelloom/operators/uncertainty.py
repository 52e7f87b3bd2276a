"""Replicate spread, conformal intervals, cluster bootstraps, correlations, frontiers, gates."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.lineage import cut
from ..functions.ordered import attach, order_statistics, quantiles, row_numbers, value_chunk
from .splits import hash_int, hash_positions

# ---- fixed values ----
ALPHA = 0.1
MIN_CONDITIONS = 5
GATE_THRESHOLDS = [0.0, 0.01, 0.02, 0.05, 0.10]
SPREAD_KEY = ["parameter_set", "checkup_k_next", "target"]


def long_targets(intervals: DataFrame) -> DataFrame:
    arms = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in ("capacity_Ah_k1", "delta_capacity_Ah")])
    return intervals.select("parameter_set", "cell_id", "checkup_k_next", F.explode(arms).alias("a")).select("parameter_set", "cell_id", "checkup_k_next", "a.*")


def replicate_spread(intervals: DataFrame) -> DataFrame:
    d = long_targets(intervals)
    g = d.groupBy(*SPREAD_KEY).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("std"),
                                   (F.max("y") - F.min("y")).alias("spread"), F.min("y").alias("lower"), F.max("y").alias("upper"))
    return attach(g, quantiles(d, SPREAD_KEY, "y", {"median": .5}), SPREAD_KEY)


def tolerance_band(spread: DataFrame) -> DataFrame:
    return spread.select(*SPREAD_KEY, "lower", "upper", (F.col("spread") / 2).alias("half_width"))


def error_vs_spread(pred: DataFrame, spread: DataFrame, keys) -> DataFrame:
    d = pred.withColumn("_e", F.abs(F.col("y_pred") - F.col("y_true"))).join(spread.select(*SPREAD_KEY, "spread"), SPREAD_KEY)
    k = [*keys, "parameter_set"]
    g = d.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("mae"), F.avg("spread").alias("mean_spread"))
    g = attach(g, quantiles(d, k, "_e", {"median_abs_error": .5}), k)
    return g.withColumn("exceeds_spread", F.col("mae") > F.col("mean_spread") + 1e-12)


def uncertainty_summary(errors: DataFrame, keys) -> DataFrame:
    return errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("conditions"), F.avg(F.col("exceeds_spread").cast("double")).alias("fraction_exceeding"),
                                     F.avg("mae").alias("mean_mae"))


def conformal_index(coverage: float) -> Column:
    n = F.col("_n")
    return F.least(n - 1, F.greatest(F.lit(0), F.ceil((n + 1) * F.lit(coverage)) - 1))


def conformal_radius(residuals: DataFrame, keys, value: str, coverage: float) -> DataFrame:
    """Order statistic ceil((n + 1) c) - 1 of the residuals of a key."""
    return order_statistics(residuals, keys, value, conformal_index(coverage), "radius")


def conformal(pred: DataFrame, spread: DataFrame, coverage: float = 0.9, least: int = MIN_CONDITIONS) -> DataFrame:
    """Row intervals of the split (Q1), cross-split (Q2) and replicate-hybrid (Q3) methods.

    pred holds one arm.  The calibration pool of a (target, split, fold) is every row of the
    target whose condition is not tested there; Q1 keeps the same split and other folds.

    A pool is a total less what is tested: the place of an order statistic is found in the running counts of
    stretches of values (total minus tested), and only the values of that one stretch are looked at.
    """
    key = ["target", "split_name", "heldout_fold"]
    base = pred.withColumn("_e", F.abs(F.col("y_true") - F.col("y_pred")))
    tested = cut(base.select(*key, "parameter_set").distinct())
    known = base.join(spread.select(*SPREAD_KEY, "spread"), SPREAD_KEY, "left")
    near = {"radius": conformal_index(coverage)}
    middle = {"_a": F.floor((F.col("_n") - 1) / 2), "_b": F.ceil((F.col("_n") - 1) / 2)}
    errors = counted_values(known, "_e")
    one, two = pool_statistics(errors, tested, True, near), pool_statistics(errors, tested, False, near)
    rep = pool_statistics(counted_values(known, "spread"), tested, False, middle).select(*key, ((F.col("_a") + F.col("_b")) / 2).alias("_rep"))
    three = attach(two, rep, key).withColumn("radius", F.greatest("radius", F.coalesce("_rep", F.lit(0.0)))).drop("_rep")
    names = ("Q1_split_conformal_abs_residual", "Q2_stressor_family_conformal", "Q3_replicate_tolerance_hybrid")
    rad = union_all([d.withColumn("method", F.lit(m)) for d, m in zip((one, two, three), names)]).withColumnRenamed("_n", "n_calibration_rows")
    rad = rad.join(_pool_conditions(base, tested, key), [*key, "method"]).where(F.col("n_calibration_conditions") >= least)
    d = base.join(rad, key).join(spread.select(*SPREAD_KEY, "spread"), SPREAD_KEY, "left")
    return interval_scores(d, F.col("y_pred") - F.col("radius"), F.col("y_pred") + F.col("radius"))


def counted_values(pred: DataFrame, value: str) -> DataFrame:
    """(target, _s, _f, parameter_set, v, n, chunk): values of each split, fold and condition with their counts."""
    by = ["target", F.col("split_name").alias("_s"), F.col("heldout_fold").alias("_f"), "parameter_set", F.col(value).alias("v")]
    return cut(pred.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("chunk", value_chunk(F.col("v"))))


def pool_statistics(counts: DataFrame, tested: DataFrame, same_split: bool, positions: dict[str, Column]) -> DataFrame:
    """Order statistics of the pool of each run (target, split_name, heldout_fold): all values of its target (of its split, if
    ``same_split``) except those of the conditions ``tested`` in it.  ``positions`` are expressions over the pool's size ``_n``."""
    key = ["target", "split_name", "heldout_fold"]
    scope = ["target", "split_name"] if same_split else ["target"]
    mine = counts.withColumnRenamed("_s", "split_name") if same_split else counts.drop("_s")
    runs = tested.select(*key).distinct()
    total = mine.groupBy(*scope, "chunk").agg(F.sum("n").alias("all"))
    gone = mine.join(tested, [*scope, "parameter_set"]).groupBy(*key, "chunk").agg(F.sum("n").alias("gone"))
    # stretches of values are a fixed grid, so these tables do not grow with the predictions
    left = runs.join(total, scope).join(gone, [*key, "chunk"], "left").select(*key, "chunk", (F.col("all") - F.coalesce("gone", F.lit(0))).alias("n")).where("n > 0")
    w = W.partitionBy(*key)
    before = w.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    line = left.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "_n": F.sum("n").over(w)})
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in positions.items()]))
    line = line.withColumn("p", each).where((F.col("p.at") >= F.col("before")) & (F.col("p.at") < F.col("before") + F.col("n")))
    picked = cut(line.select(*key, "chunk", "before", "_n", "p.name", "p.at"))
    inside = picked.join(mine, [*scope, "chunk"]).join(tested, [*key, "parameter_set"], "left_anti")
    inside = inside.groupBy(*key, "name", "at", "_n", "before", "v").agg(F.sum("n").alias("n"))
    upto = W.partitionBy(*key, "name").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("low", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
    hit = inside.where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("low") + F.col("n")))
    return cut(hit.groupBy(*key, "_n").pivot("name", list(positions)).agg(F.max("v")))


def _pool_conditions(base: DataFrame, tested: DataFrame, key) -> DataFrame:
    """Distinct conditions left in each pool; one row a condition and split, not a prediction."""
    where = base.select("target", F.col("split_name").alias("_s"), F.col("heldout_fold").alias("_f"), "parameter_set").distinct()
    runs = tested.select(*key).distinct()
    d = runs.join(where, "target").join(tested, [*key, "parameter_set"], "left_anti")
    same = (F.col("_s") == F.col("split_name")) & (F.col("_f") != F.col("heldout_fold"))
    g = d.groupBy(*key).agg(F.countDistinct(F.when(same, F.col("parameter_set"))).alias("a"), F.countDistinct("parameter_set").alias("b"))
    names = [("Q1_split_conformal_abs_residual", "a"), ("Q2_stressor_family_conformal", "b"), ("Q3_replicate_tolerance_hybrid", "b")]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("n_calibration_conditions")) for m, c in names]))
    return g.select(*key, each.alias("m")).select(*key, "m.*")


def raw_quantile(pred: DataFrame, spread: DataFrame) -> DataFrame:
    """Method Q0: the intervals between the 0.1 and 0.9 quantiles that an arm predicts itself, not calibrated."""
    d = pred.where("y_pred_q10 IS NOT NULL AND y_pred_q90 IS NOT NULL").join(spread.select(*SPREAD_KEY, "spread"), SPREAD_KEY, "left")
    d = d.withColumns({"method": F.lit("Q0_raw_quantile"), "radius": F.lit(None).cast("double")})
    return interval_scores(d, F.col("y_pred_q10"), F.col("y_pred_q90"))


def interval_scores(rows: DataFrame, lower: Column, upper: Column, alpha: float = ALPHA) -> DataFrame:
    """Coverage flag, width and interval score; the alpha of the score is fixed."""
    lo, hi, y = F.least(lower, upper), F.greatest(lower, upper), F.col("y_true")
    miss = F.greatest(F.lit(0.0), lo - y) + F.greatest(F.lit(0.0), y - hi)
    return rows.withColumns({"covered": miss <= 1e-12, "width": hi - lo, "interval_score": hi - lo + (2.0 / alpha) * miss})


def coverage_rollup(intervals: DataFrame, keys) -> DataFrame:
    """Coverage, width and score, then the mean and least per-condition coverage."""
    cov = F.col("covered").cast("double")
    g = intervals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test_rows"), F.countDistinct("parameter_set").alias("n_test_conditions"), F.avg(cov).alias("empirical_coverage"),
        F.avg("width").alias("mean_interval_width"), F.avg("interval_score").alias("interval_score"), F.avg("spread").alias("mean_test_replicate_spread"),
        F.avg(F.when(F.col("spread").isNotNull(), (F.col("width") < F.col("spread") - 1e-12).cast("double"))).alias("narrower_than_spread_fraction"))
    c = intervals.groupBy(*keys, "parameter_set").agg(F.avg(cov).alias("c")).groupBy(*keys).agg(
        F.avg("c").alias("condition_level_coverage"), F.min("c").alias("worst_condition_coverage"))
    return attach(attach(g, c, keys), quantiles(intervals, keys, "width", {"median_interval_width": .5}), keys)


# ---- bootstraps over clusters ----
def cluster_weights(clusters: DataFrame, keys, cluster: str, resamples: int, seed: int) -> DataFrame:
    """How often each cluster is drawn in each resample, by hashed picks.

    Clusters are conditions or contrasts; only their draw counts are made, and they are
    joined to per-cluster sums, so no data row is copied per resample.
    """
    keys = list(keys)
    ids = hash_positions(clusters.select(*keys, cluster).distinct(), keys, cluster, seed, "_pos")
    n = ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    draws = n.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("_slot", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    pick = F.pmod(hash_int(F.lit(str(seed)), F.col("b").cast("string"), F.col("_slot").cast("string")), F.col("_n"))
    w = draws.withColumn("_pos", pick).groupBy(*keys, "b", "_pos").agg(F.count(F.lit(1)).alias("w"))
    return w.join(ids, [*keys, "_pos"]).select(*keys, "b", cluster, "w")


def bootstrap_mean(rows: DataFrame, keys, cluster: str, value: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """Mean and win rate per resample; p05, p50 and p95 over the resamples."""
    keys = list(keys)
    per = rows.groupBy(*keys, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.sum((F.col(value) > 0).cast("long")).alias("wins"))
    w = cluster_weights(per, keys, cluster, resamples, seed)
    e = w.join(per, [*keys, cluster]).groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"),
                                                              (F.sum(F.col("w") * F.col("wins")) / F.sum(F.col("w") * F.col("n"))).alias("r"))
    return quantiles(e, keys, "m", {"mean_p05": .05, "mean_p50": .5, "mean_p95": .95}).join(quantiles(e, keys, "r", {"win_p05": .05, "win_p50": .5, "win_p95": .95}), keys)


def bootstrap_p05(rows: DataFrame, keys, cluster: str, value: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """The order statistic int(.05 (n - 1)) of the resampled means, not interpolated."""
    keys = list(keys)
    per = rows.groupBy(*keys, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    e = cluster_weights(per, keys, cluster, resamples, seed).join(per, [*keys, cluster]).groupBy(*keys, "b").agg(
        (F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    return order_statistics(e, keys, "m", F.floor(F.lit(0.05) * (F.col("_n") - 1)), "p05").drop("p05_n")


def bootstrap_correlation(rows: DataFrame, keys, cluster: str, x: str, y: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """Pearson correlation per resample from summed moments of the drawn clusters."""
    keys = list(keys)
    X, Y = F.col(x), F.col(y)
    mo = {"n": F.lit(1.0), "sx": X, "sy": Y, "sxx": X * X, "syy": Y * Y, "sxy": X * Y}
    per = rows.filter(X.isNotNull() & Y.isNotNull()).groupBy(*keys, cluster).agg(*[F.sum(e).alias(n) for n, e in mo.items()])
    e = cluster_weights(per, keys, cluster, resamples, seed).join(per, [*keys, cluster]).groupBy(*keys, "b").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in mo])
    c = F.col
    den = (c("sxx") - c("sx") * c("sx") / c("n")) * (c("syy") - c("sy") * c("sy") / c("n"))
    e = e.withColumn("r", F.when(den > 1e-24, (c("sxy") - c("sx") * c("sy") / c("n")) / F.sqrt(den)))
    return quantiles(e, keys, "r", {"p05": .05, "p50": .5, "p95": .95})


# ---- correlations ----
def with_scopes(df: DataFrame) -> DataFrame:
    """Rows in scope all, and in the rate and cold scopes where they qualify."""
    tags = F.array_compact(F.array(F.lit("all"), F.when(F.col("c_rate_holdout_fold") != 0, "c_rate"), F.when(F.col("nominal_temperature_C") <= 10, "cold")))
    return df.withColumn("scope", F.explode(tags))


def correlations(df: DataFrame, keys, x: str, y: str, tiebreak: str) -> DataFrame:
    """Pearson and the ordinal-rank Spearman (ties broken by row order) per key.

    Numbering reads its input several times, so the narrow rows are cut before each of the two; else the second would repeat
    the whole first one at every read."""
    d = cut(row_numbers(cut(df.select(*keys, x, y, tiebreak)), keys, x, tiebreak, "_rx"))
    d = row_numbers(d, keys, y, tiebreak, "_ry")
    ok = (F.count(F.lit(1)) >= 2) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(ok, F.corr(x, y)).alias("pearson"), F.corr("_rx", "_ry").alias("spearman_ordinal"))


def deciles(df: DataFrame, keys, value: str, tiebreak: str) -> DataFrame:
    """min(9, int(10 i / n)) + 1 in order of the value."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = row_numbers(df, keys, value, tiebreak, "_i").join(n, list(keys))
    return d.withColumn("decile", F.least(F.lit(9), F.floor(F.lit(10) * (F.col("_i") - 1) / F.col("_n"))).cast("int") + 1).drop("_i", "_n")


# ---- frontiers, gates, guarded choices ----
def pareto_frontier(df: DataFrame, gain: str = "gain", cost: str = "degradation", id_col: str = "model_setting_id") -> DataFrame:
    """Mark the points no other point beats: more gain is better, less cost is better.

    A point is dominated when a cheaper or equal point gains at least as much.  That is a
    running maximum of gain along cost, so points are not compared in pairs.
    """
    from ..functions.ordered import carry
    g = F.coalesce(F.col(gain), F.lit(float("-inf")))
    c = F.coalesce(F.col(cost), F.lit(float("inf")))
    d = df.withColumns({"_g": F.round(g, 12), "_c": F.round(c, 12), "_all": F.lit(0)})
    per = d.groupBy("_all", "_c").agg(F.max("_g").alias("_best")).withColumn("_chunk", F.when(F.col("_c") == float("inf"), F.lit(2**40)).otherwise(value_chunk(F.col("_c"))))
    run = carry(per, ["_all"], "_chunk", ["_c"], folds={"_run": (F.max, "_best")}, prev={"_pc": "_c"})
    run = carry(run, ["_all"], "_chunk", ["_c"], prev={"_cheaper": "_run"})
    j = d.join(run.select("_c", "_best", "_cheaper"), "_c")
    dominated = (F.col("_g") < F.col("_best")) | F.coalesce(F.col("_cheaper") >= F.col("_g"), F.lit(False))
    return j.withColumn("is_nondominated", ~dominated).drop("_g", "_c", "_all", "_best", "_cheaper")


def gate(frontier: DataFrame, gain: str, p05: str, cost: str, thresholds=GATE_THRESHOLDS) -> DataFrame:
    """Which arms have gain > 0, p05 > 0 and degradation at most each threshold."""
    d = frontier.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    ok = (F.col(gain) > 0) & (F.col(p05) > 0) & (F.col(cost) <= F.col("threshold"))
    return d.withColumn("passes_threshold", F.coalesce(ok, F.lit(False)))


def guarded_choice(df: DataFrame, keys, gain: str, cost: str, limit: float, id_col: str) -> DataFrame:
    """Best gain among arms within the guardrail, else the arm of least degradation."""
    inside = F.col(cost) <= limit
    score = F.struct(F.when(inside, 0).otherwise(1).alias("o"), F.when(inside, -F.round(gain, 12)).otherwise(F.round(cost, 12)).alias("v"), F.col(id_col).alias("i"))
    g = df.groupBy(*keys).agg(F.min_by(F.struct(id_col, gain, cost), score).alias("b"), F.sum(inside.cast("long")).alias("arms_inside"))
    return g.select(*keys, "arms_inside", *[F.col(f"b.{c}").alias(c) for c in (id_col, gain, cost)])


def settings_grid(spark, models, strengths, bags) -> DataFrame:
    """Model x strength x bags; the strength applies to weighted models, bags to bagged ones."""
    m = spark.createDataFrame([(x,) for x in models], "model_level string")
    s = spark.createDataFrame([(float(x),) for x in strengths], "weight_strength double")
    b = spark.createDataFrame([(int(x),) for x in bags], "bag_count int")
    d = m.crossJoin(s).crossJoin(b)   # three short literal lists
    return d.withColumn("model_setting_id", F.format_string("%s|w%.2f|b%d", "model_level", "weight_strength", "bag_count"))


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
