"""Support of held-out conditions in the train side, and selective performance."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..functions.ordered import attach as attach_keys, carry, quantiles
from .splits import SPLITS, stack_splits

# ---- fixed values: fields of the distance and retention fractions ----
NUMERIC = ["nominal_temperature_C", "nominal_charge_C_rate", "nominal_discharge_C_rate"]
CATEGORICAL = ["voltage_window_family", "profile_label", "aging_mode"]
RETENTIONS = [1.0, 0.9, 0.75, 0.5, 0.25]


def conditions(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("parameter_set").agg(*[F.min_by(c, F.struct("cell_id", "checkup_k")).alias(c) for c in [*NUMERIC, *CATEGORICAL, *SPLITS]])


def _same_family(a: str, b: str) -> Column:
    eq = lambda c: F.col(a + c) == F.col(b + c)
    s = F.col("split_name")
    return (F.when(s == "temperature_holdout_fold", eq(NUMERIC[0])).when(s == "c_rate_holdout_fold", eq(NUMERIC[1]) & eq(NUMERIC[2]))
            .when(s == "profile_holdout_fold", eq("profile_label")).when(s == "voltage_window_holdout_fold", eq("voltage_window_family"))
            .otherwise(eq("aging_mode")))


def condition_support(intervals: DataFrame) -> DataFrame:
    """Nearest train condition, exact matches and family matches per held-out condition.

    Conditions with equal attributes and fold are folded to one profile first.  Profiles are
    points of the experiment's design grid, so the profile-by-profile join inside a split is
    bounded by the grid, not by the number of cells, intervals or conditions.
    """
    c = stack_splits(conditions(intervals))
    attrs = [*NUMERIC, *CATEGORICAL]
    prof = c.groupBy("split_name", "fold", *attrs).agg(F.count(F.lit(1)).alias("n"), F.min("parameter_set").alias("first_id"))
    per_fold = prof.groupBy("split_name", "fold").agg(F.sum("n").alias("n"), *[f(x).alias(f"{p}{x}") for x in NUMERIC for f, p in ((F.min, "lo_"), (F.max, "hi_"))])
    folds = per_fold.select("split_name", F.col("fold").alias("heldout_fold"))
    rng = per_fold.join(folds, "split_name").filter(F.col("fold") != F.col("heldout_fold")).groupBy("split_name", "heldout_fold").agg(
        F.sum("n").alias("train_conditions"), *[(F.max(f"hi_{x}") - F.min(f"lo_{x}")).alias(f"r_{x}") for x in NUMERIC])
    a = prof.select("split_name", F.col("fold").alias("heldout_fold"), *[F.col(x).alias(f"a_{x}") for x in attrs])
    b = prof.select("split_name", "fold", "n", "first_id", *[F.col(x).alias(f"b_{x}") for x in attrs])
    j = a.join(rng, ["split_name", "heldout_fold"]).join(b, "split_name").filter(F.col("fold") != F.col("heldout_fold"))
    width = lambda x: F.when(F.col(f"r_{x}") > 0, F.col(f"r_{x}")).otherwise(1.0)
    gap = lambda x: (F.col(f"a_{x}") - F.col(f"b_{x}")) / width(x)
    misses = sum(((F.col(f"a_{x}") != F.col(f"b_{x}")).cast("double") for x in CATEGORICAL), F.lit(0.0))
    d2 = sum((gap(x) * gap(x) for x in NUMERIC), F.lit(0.0)) + misses
    exact = S.all_of([F.abs(F.col(f"a_{x}") - F.col(f"b_{x}")) <= 1e-12 for x in NUMERIC] + [F.col(f"a_{x}") == F.col(f"b_{x}") for x in CATEGORICAL])
    j = j.withColumn("_d", F.round(F.sqrt(d2), 12))
    g = j.groupBy("split_name", "heldout_fold", *[f"a_{x}" for x in attrs]).agg(
        F.max("train_conditions").alias("train_conditions"), F.min("_d").alias("nearest_distance"), F.min_by("first_id", F.struct("_d", "first_id")).alias("nearest_parameter_set"),
        F.sum(F.when(exact, F.col("n")).otherwise(0)).alias("exact_nominal_match_count"),
        F.sum(F.when(_same_family("a_", "b_"), F.col("n")).otherwise(0)).alias("same_stressor_support_count"))
    g = g.withColumnsRenamed({f"a_{x}": x for x in attrs})
    out = c.select("split_name", F.col("fold").alias("heldout_fold"), "parameter_set", *attrs).join(g, ["split_name", "heldout_fold", *attrs])
    return out.withColumn("support_score", 1.0 / (1.0 + F.col("nearest_distance")))


SUPPORT = ["support_score", "nearest_distance", "exact_nominal_match_count", "same_stressor_support_count"]


def attach(rows: DataFrame, support: DataFrame) -> DataFrame:
    """Support of the row's condition under its split."""
    return rows.join(support.select("split_name", "parameter_set", *SUPPORT), ["split_name", "parameter_set"], "left")


def attach_two(rows: DataFrame, support: DataFrame) -> DataFrame:
    """Weaker support of two arms: least score, greatest distance."""
    out = rows
    for p in "ab":
        out = out.join(support.select("split_name", F.col("parameter_set").alias(f"arm_{p}_parameter_set"), *[F.col(c).alias(f"_{p}_{c}") for c in SUPPORT]),
                       ["split_name", f"arm_{p}_parameter_set"], "left")
    pick = {c: (F.greatest if c == "nearest_distance" else F.least)(f"_a_{c}", f"_b_{c}") for c in SUPPORT}
    return out.withColumns(pick).drop(*[f"_{p}_{c}" for p in "ab" for c in SUPPORT])


def retained(rows: DataFrame, keys, group: str, order, chunk: Column, retentions=RETENTIONS) -> DataFrame:
    """Each row once per retention that keeps it: the best ceil(n r) rows of a key.

    Rows of one ``group`` share score and distance, so groups are ranked by their counts and
    rows are numbered only inside a group, chunk by chunk.
    """
    keys = list(keys)
    by_group = rows.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"), F.first("support_score").alias("_s"), F.first("nearest_distance").alias("_d"))
    by_group = by_group.withColumns({"_o": F.struct((-F.col("_s")).alias("s"), F.col("_d").alias("d"), F.col(group).alias("g")),
                                     "_chunk": F.floor(-F.round(F.col("_s"), 9) * 256)})
    by_group = carry(by_group, keys, "_chunk", ["_o"], sums_before={"_before": "_n"})
    total = by_group.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    d = rows.join(by_group.join(total, keys).select(*keys, group, "_before", "_total"), [*keys, group]).withColumn("_chunk", chunk)
    d = carry(d, [*keys, group], "_chunk", order, sums={"_pos": F.lit(1)})
    d = d.withColumn("retention_fraction", F.explode(F.array(*[F.lit(r) for r in retentions])))
    take = F.greatest(F.lit(1), F.ceil(F.col("_total") * F.col("retention_fraction")))
    return d.filter(F.col("_before") + F.col("_pos") <= take).drop("_before", "_pos", "_total", "_chunk")


def replicate_of(cell: Column) -> Column:
    return F.split_part(cell, F.lit("_"), F.lit(2)).cast("int")


def selective_regression(pred: DataFrame, support: DataFrame, keys) -> DataFrame:
    rows = attach(pred, support).withColumn("_r", replicate_of(F.col("cell_id")))
    d = retained(rows, keys, "parameter_set", ["_r", "checkup_k"], F.col("_r"))
    err = F.col("y_pred") - F.col("y_true")
    k = [*keys, "retention_fraction"]
    g = d.groupBy(*k).agg(F.count(F.lit(1)).alias("rows_retained"), F.countDistinct("parameter_set").alias("conditions_retained"), F.avg(F.abs(err)).alias("mae"),
                          F.sqrt(F.avg(err * err)).alias("rmse"), F.avg("support_score").alias("mean_support_score"))
    return g.join(quantiles(d, k, "nearest_distance", {"median_nearest_distance": .5}), k)


def selective_probability(pred: DataFrame, support: DataFrame, keys) -> DataFrame:
    from .metrics import ece
    rows = attach(pred, support).withColumn("_r", replicate_of(F.col("cell_id")))
    d = retained(rows, keys, "parameter_set", ["_r", "checkup_k"], F.col("_r")).withColumn("p", S.clip_probability(F.col("p")))
    k = [*keys, "retention_fraction"]
    g = d.groupBy(*k).agg(F.count(F.lit(1)).alias("rows_retained"), F.sum("y").alias("positive_count"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"),
                          F.avg("support_score").alias("mean_support_score"))
    return g.join(ece(d, k), k)


def selective_ordering(pairwise: DataFrame, support: DataFrame, keys) -> DataFrame:
    from .contrasts import with_all
    rows = with_all(attach_two(pairwise, support))
    k = [*keys, "contrast_family"]
    # arms of one condition pair share their support
    rows = rows.withColumn("_pair", F.format_string("%05d_%s", "arm_a_parameter_set", "contrast_id"))
    d = retained(rows, k, "_pair", ["checkup_k"], F.floor(F.col("checkup_k") / 64))
    kk = [*k, "retention_fraction"]
    n = lambda c: F.sum(F.col(c).cast("long"))
    return d.groupBy(*kk).agg(F.count(F.lit(1)).alias("rows_retained"), F.countDistinct("contrast_id").alias("contrasts_retained"), n("sign_evaluable").alias("sign_evaluable_rows"),
                              n("sign_correct").alias("sign_correct_rows"), F.avg("effect_abs_error").alias("mean_effect_abs_error"), F.avg("support_score").alias("mean_support_score"))


def support_summary(support: DataFrame, keys) -> DataFrame:
    """Conditions, low-support share, mean and median score per key."""
    low = S.low_support(F.col("support_score"))
    g = support.groupBy(*keys).agg(F.count(F.lit(1)).alias("conditions"), F.sum(low.cast("long")).alias("low_support"), F.avg(low.cast("double")).alias("low_fraction"),
                                   F.avg("support_score").alias("mean_score"), F.avg("nearest_distance").alias("mean_distance"))
    return attach_keys(g, quantiles(support, keys, "support_score", {"median_score": .5}), keys)


def stratum_gains(gains: DataFrame, support: DataFrame, keys) -> DataFrame:
    """Paired gains split by low and high support."""
    d = attach(gains, support).withColumn("stratum", F.when(S.low_support(F.col("support_score")), "low_support").otherwise("high_support"))
    k = [*keys, "stratum"]
    g = d.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.avg("gain").alias("mean_gain"))
    return g.join(quantiles(d, k, "gain", {"median_gain": .5}), k)
