"""Rule-based arms: persistence, slopes, train means, warning rules, pooling, weights, encoders."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalar as S
from ..functions.ordered import count_below, quantiles
from .splits import fold_totals, hash_positions, stack_splits, test_rows

FOLD = ["split_name", "heldout_fold"]
ROW = ["cell_id", "parameter_set", "checkup_k", "checkup_k_next"]
ARM = ["run_scope", *FOLD, "model_level", "feature_group", "target"]

# ---- fixed values: names of the arms and targets ----
LEVEL, DELTA = "capacity_Ah_k1", "delta_capacity_Ah"
GROUPS = ["persistence", "F1_nominal", "F2_state", "F4_state_log_age_scalar"]
SCOPES = ["primary", "sensitivity_excluding_monotonicity"]


def persistence(target: Column, state: Column) -> Column:
    """The level stays, changes and rates are zero."""
    return F.when(target == LEVEL, state).otherwise(0.0)


def prior_slope(state: Column, prior: Column, horizon: Column) -> Column:
    return state + F.coalesce(prior, F.lit(0.0)) * horizon


def train_means(rows: DataFrame, values: dict[str, Column], by=()) -> DataFrame:
    """Mean of each value over the train side of every held-out fold.

    One row per split, held-out fold and group of the design: callers send it to all tasks, so that
    no test row is dealt by these few keys.
    """
    n = {f"n_{k}": F.when(v.isNotNull(), 1).otherwise(0) for k, v in values.items()}
    t = fold_totals(rows, {**values, **n}, by)
    return t.select(*FOLD, *by, *[F.when(F.col(f"n_{k}") > 0, F.col(k) / F.col(f"n_{k}")).alias(k) for k in values])


def capacity_predictions(intervals: DataFrame) -> DataFrame:
    """Long prediction table of the rule arms for both targets, splits and scopes.

    Train means are small (split x fold x rate group); they join the test rows on
    (split, fold) as a broadcast, so no prediction row moves.
    """
    d = F.col("delta_capacity_Ah")
    m = train_means(intervals, {"mean_level": F.col("capacity_Ah_k1"), "mean_delta": d})
    g = train_means(intervals, {"group_delta": d}, ["nominal_charge_C_rate"])
    means = g.join(m, FOLD).withColumn("group_delta", F.coalesce("group_delta", "mean_delta"))
    t = test_rows(intervals).join(F.broadcast(means), FOLD + ["nominal_charge_C_rate"])
    cap, M, D, G = (F.col(c) for c in ("capacity_Ah_k", "mean_level", "mean_delta", "group_delta"))
    arms = []

    def arm(model, group, level, delta, quant=False):
        for target, pred, truth in ((LEVEL, level, F.col("capacity_Ah_k1")), (DELTA, delta, d)):
            off = (lambda x: pred + x) if quant else (lambda x: F.lit(None).cast("double"))  # noqa: B023
            arms.append(F.struct(F.lit(model).alias("model_level"), F.lit(group).alias("feature_group"), F.lit(target).alias("target"),
                                 truth.alias("y_true"), pred.alias("y_pred"), off(-0.1).alias("y_pred_q10"), off(0.0).alias("y_pred_q50"),
                                 off(0.05).alias("y_pred_q90")))
    arm("L0_persistence", GROUPS[0], cap, F.lit(0.0))
    arm("L1_mean", GROUPS[1], M, D)
    arm("L2_rule", GROUPS[2], cap + D, G)
    arm("L2_rule", GROUPS[3], cap + G, (D + G) / 2)
    arm("L3_quantile", GROUPS[3], cap + G, G, True)
    scopes = F.when(F.col("LOG_AGE_monotonicity_clean"), F.array(*[F.lit(s) for s in SCOPES])).otherwise(F.array(F.lit(SCOPES[0])))
    t = t.withColumn("_a", F.explode(F.array(*arms))).withColumn("run_scope", F.explode(scopes))
    return t.select("run_scope", *FOLD, *ROW, "replicate_id", "aging_mode", "nominal_temperature_C", "voltage_window_family", "nominal_charge_C_rate",
                    "nominal_discharge_C_rate", "profile_label", "capacity_Ah_k", "_a.*")


def horizon_predictions(horizon: DataFrame) -> DataFrame:
    """Persistence, prior-slope and train-mean arms on the horizon table.

    The exposure diagnostic sees the hours of the horizon, never its target: the train mean of the
    change per hour times those hours.
    """
    d, hours = F.col("delta_capacity_Ah_h"), F.col("horizon_duration_h")
    m = train_means(horizon, {"mean_delta": d, "mean_rate": F.when(hours > 0, d / hours)}, ["horizon_checkups"])
    t = test_rows(horizon).join(F.broadcast(m), FOLD + ["horizon_checkups"])
    cap, h = F.col("capacity_Ah_k"), F.col("horizon_checkups")
    slope = prior_slope(cap, F.col("prior_delta_capacity_Ah"), h)
    arms = F.array(*[F.struct(F.lit(a).alias("model_level"), F.lit(g).alias("feature_group"), p.alias("y_pred")) for a, g, p in (
        ("MH0_persistence", "persistence", cap), ("MH1_prior_slope", "prior_slope", slope), ("MH2_mean", "K2_state_exposure", cap + F.col("mean_delta")),
        ("MH2_mean", "K3_oracle_exposure_diagnostic", cap + F.coalesce(F.col("mean_rate") * hours, F.col("mean_delta"))), ("MH2_mean", "K4_trajectory_shape", cap + F.col("mean_delta") / 2 + F.coalesce(
            F.col("prior_delta_capacity_Ah"), F.lit(0.0)) * h / 2))])
    t = t.withColumn("_a", F.explode(arms))
    return t.select(F.lit("primary").alias("run_scope"), *FOLD, "cell_id", "parameter_set", "checkup_k", F.col("target_checkup_k").alias("checkup_k_next"),
                    "horizon_checkups", "nominal_temperature_C", "nominal_charge_C_rate", "soh_k", "prior_delta_capacity_Ah",
                    F.lit("capacity_Ah_kh").alias("target"), F.col("capacity_Ah_kh").alias("y_true"), "_a.*")


# ---- warning rules ----
def warning_long(warning: DataFrame, targets: dict[str, int]) -> DataFrame:
    arms = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("y"), F.lit(h).alias("horizon")) for t, h in targets.items()])
    d = warning.withColumn("_a", F.explode(arms)).select("*", "_a.target", "_a.y", "_a.horizon").drop("_a")
    m = S.capacity_margins(F.col("capacity_Ah_k"), F.col("soh_k"), F.col("checkup_k"))
    d = d.withColumns(m)
    return d.withColumn("label_status", S.label_status(F.col("y") == 1, F.col("time_to_event_checkups"), F.col("horizon"), F.col("event_observed")))


def with_policy(long: DataFrame, policy: str) -> DataFrame:
    """Label policy: ``verified_only`` drops censored rows, the other two keep all rows."""
    return long.filter(F.col("label_status") != "right_censored_unknown") if policy == "verified_only" else long


def warning_predictions(long: DataFrame) -> DataFrame:
    """Prior, distance and extrapolation arms per target, split and held-out fold."""
    by = ["target"]
    rate = train_means(long, {"prior": F.col("y").cast("double")}, by)
    limit = distance_limit(long)
    t = test_rows(long).join(F.broadcast(rate), FOLD + by).join(F.broadcast(limit), FOLD + by, "left")
    near = F.col("margin_soh") <= F.coalesce("limit", F.lit(0.0))
    floor = lambda share: F.greatest(F.lit(0.01), share * F.col("prior"))
    dist = F.when(near, 0.75).otherwise(floor(0.25))
    slope = F.col("prior_slope_Ah")
    steps = F.when(slope < 0, F.col("margin_soh") / F.abs(slope))
    extra = F.when(slope >= 0, floor(0.2)).when(steps <= F.col("horizon"), 0.8).otherwise(floor(0.3))
    arms = F.array(*[F.struct(F.lit(a).alias("model_level"), p.cast("double").alias("p")) for a, p in (
        ("B0_prior", F.col("prior")), ("B1_distance_rule", dist), ("B2_extrapolation", extra))])
    t = t.withColumn("_a", F.explode(arms))
    return t.select(*FOLD, "cell_id", "parameter_set", "checkup_k", "target", "y", "label_status", "soh_k", "margin_soh", "time_to_event_checkups",
                    F.expr("_a.model_level"), F.expr("_a.p"))


def distance_limit(long: DataFrame) -> DataFrame:
    """Order statistic int(.9 (n-1)) of the positives' margins on each train side.

    Margins are folded per (split, fold, target, value); the train side is all folds but
    the held-out one, reached by joining folds on inequality over the folded values only.
    """
    pos = test_free(long.filter("y = 1"))
    folds = test_rows(long).select(*FOLD).distinct()
    train = pos.join(folds, "split_name").filter(F.col("fold") != F.col("heldout_fold"))
    f = count_below(train, FOLD + ["target"], "margin_soh", {"w": F.col("n")})
    n = f.groupBy(*FOLD, "target").agg(F.sum("w").alias("n")).withColumn("i", F.floor(F.lit(0.9) * (F.col("n") - 1)))
    j = f.join(n, FOLD + ["target"]).filter((F.col("i") >= F.col("w_below")) & (F.col("i") < F.col("w_below") + F.col("w")))
    return j.select(*FOLD, "target", F.col("margin_soh").alias("limit"))


def test_free(long: DataFrame) -> DataFrame:
    return stack_splits(long).groupBy("split_name", "fold", "target", "margin_soh").agg(F.count(F.lit(1)).alias("n"))


def calibration_partition(long: DataFrame, fraction: float = 0.3, seed: int = 42, min_class: int = 1) -> DataFrame:
    """Hash-ordered conditions set aside for calibration, per (split, held-out fold, target).

    ceil(fraction) of the train conditions, grown until both classes are seen, never all.
    """
    per = stack_splits(long).groupBy("split_name", "fold", "target", "parameter_set").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    folds = test_rows(long).select(*FOLD).distinct()
    train = per.join(folds, "split_name").filter(F.col("fold") != F.col("heldout_fold"))
    keys = FOLD + ["target"]
    cond = train.groupBy(*keys, "parameter_set").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    d = hash_positions(cond, keys, "parameter_set", seed, "pos_rank")
    # one row per condition: the window is as long as the experiment has conditions
    w = W.partitionBy(*keys).orderBy("pos_rank").rowsBetween(W.unboundedPreceding, -1)
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumns({"pb": F.coalesce(F.sum("pos").over(w), F.lit(0)), "nb": F.coalesce(F.sum("neg").over(w), F.lit(0))}).join(n, keys)
    want = F.ceil(F.lit(fraction) * F.col("n"))
    need = (F.col("pos_rank") < want) | (F.col("pb") < min_class) | (F.col("nb") < min_class)
    return d.select(*keys, "parameter_set", (need & (F.col("pos_rank") < F.col("n") - 1)).alias("calibration"))


# ---- pooling, bias correction, weights ----
def pool_keys() -> list[tuple[str, Column]]:
    c = {"temperature": F.col("nominal_temperature_C").cast("string"), "rate": S.c_rate_bucket(F.col("nominal_charge_C_rate")),
         "window": F.col("voltage_window_family"), "profile": F.col("profile_label"), "mode": F.col("aging_mode")}
    return list(c.items())


def residual_pool(residuals: DataFrame, keys, strength: float = 5.0, min_count: int = 3) -> DataFrame:
    """Shrunk residual mean of each stressor key: mean x n / (n + strength)."""
    arms = F.array(*[F.struct(F.lit(n).alias("pool"), c.alias("pool_value")) for n, c in pool_keys()])
    d = residuals.withColumn("_p", F.explode(arms)).select(*keys, "_p.pool", "_p.pool_value", "residual")
    g = d.groupBy(*keys, "pool", "pool_value").agg(F.avg("residual").alias("mean"), F.count("residual").alias("n")).filter(F.col("n") >= min_count)
    return g.withColumn("shrunk_offset", F.col("mean") * F.col("n") / (F.col("n") + strength))


def pooled_offset(rows: DataFrame, pool: DataFrame, glob: DataFrame, keys, row_keys) -> DataFrame:
    """Mean of the offsets a row hits, else the global residual mean."""
    arms = F.array(*[F.struct(F.lit(n).alias("pool"), c.alias("pool_value")) for n, c in pool_keys()])
    d = rows.withColumn("_p", F.explode(arms)).select(*keys, *row_keys, "_p.pool", "_p.pool_value")
    hit = d.join(pool, [*keys, "pool", "pool_value"], "left").groupBy(*keys, *row_keys).agg(F.avg("shrunk_offset").alias("o"), F.count("shrunk_offset").alias("hits"))
    return hit.join(glob, keys, "left").withColumn("pooled_offset", F.coalesce("o", "global_offset")).drop("o", "global_offset")


def replicate_radius(residuals: DataFrame, spread: DataFrame, keys) -> DataFrame:
    """max(p90 of abs residual, p90 of replicate spread / 2) per key."""
    a = quantiles(residuals.withColumn("_a", F.abs("residual")), keys, "_a", {"r90": 0.9})
    b = quantiles(spread, keys, "spread", {"s90": 0.9})
    return a.join(b, keys, "left").withColumn("radius", F.greatest("r90", F.coalesce(F.col("s90") / 2, F.lit(0.0))))


def bias_correction(train_residuals: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """Mean train residual by (temperature, window, rate bucket), and globally."""
    d = train_residuals.withColumn("rate_bucket", S.c_rate_bucket(F.col("nominal_charge_C_rate")))
    by = [*keys, "nominal_temperature_C", "voltage_window_family", "rate_bucket"]
    return (d.groupBy(*by).agg(F.avg("residual").alias("group_bias")), d.groupBy(*keys).agg(F.avg("residual").alias("global_bias")))


def balanced_weights(rows: DataFrame, keys, group: Column, strength: float = 1.0) -> DataFrame:
    """Inverse group counts, mean one, blended as 1 + strength (w - 1)."""
    d = rows.withColumn("_g", group)
    n = d.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    tot = n.groupBy(*keys).agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_groups"))
    w = F.col("_rows") / (F.col("_n") * F.col("_groups"))
    return d.join(n.join(tot, keys).withColumn("weight", 1.0 + strength * (w - 1.0)).select(*keys, "_g", "weight"), [*keys, "_g"]).drop("_g")


# ---- encoders ----
def fit_encoder(rows: DataFrame, numeric, categorical, forbidden=()) -> tuple[DataFrame, DataFrame]:
    """Train statistics: (mean, population std with 0 -> 1) and the category list, both long."""
    bad = sorted(set(numeric + categorical) & set(forbidden))
    if bad:
        raise ValueError(f"leaking fields: {bad}")
    arms = F.array(*[F.struct(F.lit(c).alias("field"), S.finite(F.col(c)).alias("x")) for c in numeric])
    num = rows.select(F.explode(arms).alias("a")).groupBy("a.field").agg(F.avg("a.x").alias("mean"), F.stddev_pop("a.x").alias("std"))
    num = num.withColumn("std", F.when(F.coalesce("std", F.lit(0.0)) == 0, 1.0).otherwise(F.col("std"))).fillna(0.0, ["mean"])
    cats = F.array(*[F.struct(F.lit(c).alias("field"), S.group_label(F.col(c)).alias("value")) for c in categorical])
    cat = rows.select(F.explode(cats).alias("a")).select("a.field", "a.value").distinct()
    return num, cat


def transform(rows: DataFrame, num: DataFrame, cat: DataFrame, numeric, categorical) -> DataFrame:
    """Standardised numbers (NULL -> mean) and one-hot columns; unseen categories give zeros.

    The statistics are one row per field, so they are attached as one single-row frame.
    """
    stats = num.groupBy().pivot("field", list(numeric)).agg(F.first("mean").alias("m"), F.first("std").alias("s"))
    out = rows.crossJoin(stats)   # one-row frame on the right
    z = [((F.coalesce(S.finite(F.col(c)), F.col(f"{c}_m")) - F.col(f"{c}_m")) / F.col(f"{c}_s")).alias(f"{c}_z") for c in numeric]
    known = {c: cat.filter(F.col("field") == c).agg(F.array_sort(F.collect_set("value")).alias(f"{c}_levels")) for c in categorical}
    for c, k in known.items():
        out = out.crossJoin(k)   # one-row frame on the right: the category list of the train side

    def one_hot(c: str) -> Column:
        return F.transform(F.col(f"{c}_levels"), lambda x: (x == S.group_label(F.col(c))).cast("double")).alias(f"{c}_hot")
    hot = [one_hot(c) for c in categorical]
    return out.select(*rows.columns, *z, *hot)


def leakage_audit(spark, groups: dict[str, list[str]], forbidden) -> DataFrame:
    """Feature names of every group that are on the forbidden list."""
    feats = spark.createDataFrame([(g, f) for g, fs in groups.items() for f in fs], "feature_group string, feature string")
    ban = spark.createDataFrame([(f,) for f in forbidden], "feature string")
    bad = feats.join(ban, "feature", "left_semi").groupBy("feature_group").agg(F.count(F.lit(1)).alias("leaking"))
    return feats.groupBy("feature_group").agg(F.count(F.lit(1)).alias("features")).join(bad, "feature_group", "left").fillna(0)


def token_scan(spark, names, tokens) -> DataFrame:
    """Column names that contain a leakage token."""
    d = spark.createDataFrame([(n,) for n in names], "name string")
    hit = reduce(lambda a, b: a | b, [F.lower("name").contains(t) for t in tokens])
    return d.filter(hit)
