"""Capacity trajectories, horizon targets and prior-shape features."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scalar as S
from ..functions.ordered import carry, halo, quantiles

META = ["aging_mode", "nominal_temperature_C", "voltage_window_family", "nominal_charge_C_rate",
        "nominal_discharge_C_rate", "profile_label"]
FOLDS = ["condition_fold", "temperature_holdout_fold", "c_rate_holdout_fold", "profile_holdout_fold",
         "voltage_window_holdout_fold"]
HORIZONS = (1, 2, 3, 5)
FEW_CHECKUPS = 6
INCREASE_AH = 0.02
LOG_FLAGS = ["LOG_AGE_inserted_diagnostics_masked", "LOG_AGE_missing_interval", "LOG_AGE_monotonicity_violation"]


def capacity_points(intervals: DataFrame, block: int = 64) -> DataFrame:
    """One row per (cell, check-up) with everything known at that check-up.

    ``idx`` is the dense position, the ``cum_*`` columns are running sums, and the
    ``prior_*`` columns belong to the interval that ends here (NULL at the first point).
    """
    ids = ["cell_id", "parameter_set", "replicate_id", *META, *FOLDS]
    pos = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0)))
    ends = intervals.select(
        *ids, F.col("checkup_k_next").alias("k"), F.col("t_result_k1_s").alias("t_s"), F.col("capacity_Ah_k1").alias("capacity_Ah"),
        F.col("delta_capacity_Ah").alias("prior_delta"), F.col("calendar_days").alias("prior_days"), "duration_h",
        pos("log_age_efc_delta").alias("efc"), pos("log_age_delta_q_Ah").alias("q"),
        F.col("log_age_efc_delta").alias("efc_raw"), F.col("log_age_delta_q_Ah").alias("q_raw"),
        F.col("log_age_row_count").alias("log_rows"), *[F.array_contains(F.split("quality_flags", ";"), f).cast("int").alias(f"_f{i}")
                                                        for i, f in enumerate(LOG_FLAGS)])
    first = intervals.groupBy("cell_id").agg(F.min_by(F.struct(
        *[c for c in ids if c != "cell_id"], F.col("checkup_k").alias("k"), F.col("t_result_k_s").alias("t_s"),
        F.col("capacity_Ah_k").alias("capacity_Ah")), "checkup_k").alias("s")).select("cell_id", "s.*")
    pts = ends.unionByName(first, allowMissingColumns=True)
    zero = first.select("cell_id", F.col("t_s").alias("t_first"), F.col("capacity_Ah").alias("capacity_first"))
    pts = pts.join(zero, "cell_id").withColumn("_chunk", F.floor(F.col("k") / block))
    n = lambda c: F.col(c).isNotNull().cast("long")
    d0 = F.col("prior_delta")
    slope = S.safe_ratio(d0, F.col("prior_days"))
    zeros = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    pts = pts.withColumn("prior_slope", slope)
    out = carry(pts, ["cell_id"], "_chunk", ["k"],
                prev={"_pcap": "capacity_Ah"},
                sums={"cum_efc": zeros("efc"), "cum_q": zeros("q"), "cum_h": zeros("duration_h"), "cum_days": zeros("prior_days"),
                      "cum_efc_raw": zeros("efc_raw"), "cum_q_raw": zeros("q_raw"), "n_efc": n("efc_raw"), "n_q": n("q_raw"),
                      "cum_rows": F.coalesce(F.col("log_rows"), F.lit(0)), "history": n("prior_delta"),
                      "sum_delta": zeros("prior_delta"), "sum_delta2": zeros("prior_delta") * zeros("prior_delta"),
                      "increases": F.coalesce(d0 > 0, F.lit(False)).cast("long"),
                      **{f"cf{i}": F.coalesce(F.col(f"_f{i}"), F.lit(0)) for i in range(len(LOG_FLAGS))}},
                sums_before={"idx": F.lit(1)},
                folds={"cap_max": (F.max, "capacity_Ah"), "cap_min": (F.min, "capacity_Ah"), "abs_max": (F.max, F.abs(d0))})
    return out.withColumns({
        "soh": S.safe_ratio(F.col("capacity_Ah"), F.col("capacity_first")), "idx": F.col("idx").cast("int"),
        "calendar_days_since": (F.col("t_s") - F.col("t_first")) / 86400.0,
        "capacity_rise": F.coalesce(F.col("capacity_Ah") - F.col("_pcap"), F.lit(0.0))}).drop("_chunk", "_pcap", "_f0", "_f1", "_f2")


def trajectory_flags(points: DataFrame) -> DataFrame:
    """Per cell: number of points, flags of the trajectory and its metadata."""
    g = points.groupBy("cell_id").agg(
        F.min_by(F.struct("parameter_set", "replicate_id", *META), "k").alias("m"), F.count(F.lit(1)).alias("n_points"),
        (F.count(F.lit(1)) - F.countDistinct("k")).alias("dup"), F.max("capacity_rise").alias("rise"))
    return g.select("cell_id", "m.*", "n_points", F.concat_ws(
        ";", F.when(F.col("n_points") < FEW_CHECKUPS, "few_checkups"), F.when(F.col("dup") > 0, "duplicate_checkups"),
        F.when(F.col("rise") > INCREASE_AH, "capacity_increase_gt_0p02Ah")).alias("trajectory_flags"))


def horizon_table(points: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Targets h check-ups ahead; every interval of the span must exist.

    Span sums are differences of running sums, so a row needs the point h places on: read in the
    bounded frame of a block of points, so points are shuffled once and not once per horizon.
    """
    keep = ["capacity_Ah", "soh", "t_s", "idx", "cum_h", "cum_days", "cum_efc_raw", "cum_q_raw", "n_efc", "n_q", "cum_rows",
            *[f"cf{i}" for i in range(len(LOG_FLAGS))]]
    own = ["cell_id", "parameter_set", "replicate_id", "k", "calendar_days_since", "cum_efc", "cum_q", "prior_delta", "prior_slope", *META, *FOLDS]
    d, part = halo(points.filter("cell_id IS NOT NULL").select(*dict.fromkeys([*own, *keep])), ["cell_id"], "idx", 0, max(horizons))
    on = W.partitionBy(*part).orderBy("idx")
    ahead = F.struct(F.col("k").alias("_k"), *[F.col(c).alias(f"b_{c}") for c in keep])
    d = d.withColumns({f"_at{h}": F.lead(ahead, h).over(on) for h in horizons}).filter("_own")
    j = d.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_at{h}").alias("at")) for h in horizons])))
    j = j.drop(*[f"_at{h}" for h in horizons]).select("*", "_b.h", "_b.at.*").filter(
        (F.col("k") + F.col("h") == F.col("_k")) & (F.col("b_idx") - F.col("idx") == F.col("h")))
    diff = lambda c: F.col(f"b_{c}") - F.col(c)
    flags = F.array_sort(F.array_compact(F.array(
        *[F.when(diff(f"cf{i}") > 0, f) for i, f in enumerate(LOG_FLAGS)],
        F.when(F.col("prior_delta").isNull(), "no_prior_delta"))))
    return j.select(
        "cell_id", "parameter_set", "replicate_id", F.col("k").alias("checkup_k"), F.col("_k").alias("target_checkup_k"),
        F.col("h").alias("horizon_checkups"), F.col("capacity_Ah").alias("capacity_Ah_k"), F.col("b_capacity_Ah").alias("capacity_Ah_kh"),
        diff("capacity_Ah").alias("delta_capacity_Ah_h"), F.col("soh").alias("soh_k"), F.col("b_soh").alias("soh_kh"),
        F.col("calendar_days_since").alias("calendar_day_k"), (diff("t_s") / 86400.0).alias("horizon_days"),
        F.col("cum_efc").alias("cumulative_efc_k"), F.col("cum_q").alias("cumulative_q_Ah_k"),
        F.col("prior_delta").alias("prior_delta_capacity_Ah"), F.col("prior_delta").alias("prior_capacity_slope_per_checkup"),
        F.col("prior_slope").alias("prior_capacity_slope_per_day"), *META, *FOLDS, F.col("h").alias("horizon_interval_count"),
        diff("cum_h").alias("horizon_duration_h"), diff("cum_days").alias("horizon_calendar_days"),
        F.when(diff("n_efc") > 0, diff("cum_efc_raw")).alias("horizon_log_age_efc_delta"),
        F.when(diff("n_q") > 0, diff("cum_q_raw")).alias("horizon_log_age_delta_q_Ah"),
        diff("cum_rows").alias("horizon_log_age_row_count"), F.lit(True).alias("event_observed"),
        F.when(F.size(flags) > 0, F.concat_ws(";", flags)).otherwise("none").alias("quality_flags"))


def horizon_coverage(horizon: DataFrame, points: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Rows against possible starts (target check-up exists, contiguity not asked)."""
    last = points.groupBy("cell_id").agg(F.max("k").alias("kmax"))
    starts = points.join(last, "cell_id").filter("k < kmax").select("cell_id", "k")
    s = starts.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    possible = (s.join(points.select("cell_id", F.col("k").alias("_k")), (F.col("k") + F.col("h") == F.col("_k")) &
                       (s.cell_id == points.cell_id)).groupBy("h").agg(F.count(F.lit(1)).alias("possible_start_rows")))
    g = horizon.groupBy(F.col("horizon_checkups").alias("h")).agg(F.count(F.lit(1)).alias("row_count"), *holdout_counts())
    return (possible.join(g, "h", "left").fillna(0).withColumn(
        "missing_or_censored_rows", F.greatest(F.col("possible_start_rows") - F.col("row_count"), F.lit(0)))
        .withColumnRenamed("h", "horizon_checkups"))


def holdout_counts() -> list:
    """Cells, conditions and held-out rows of the rate and profile splits."""
    out = [F.countDistinct("cell_id").alias("cells"), F.countDistinct("parameter_set").alias("parameter_sets")]
    for name in ("c_rate", "profile"):
        on = F.col(f"{name}_holdout_fold") != 0
        out += [F.sum(on.cast("long")).alias(f"{name}_holdout_rows"),
                F.countDistinct(F.when(on, F.col("parameter_set"))).alias(f"{name}_holdout_parameter_sets")]
    return out


def trajectory_features(horizon: DataFrame, points: DataFrame) -> DataFrame:
    """Shape of the history up to check-up k, joined to the horizon rows by (cell, k)."""
    d, part = halo(points, ["cell_id"], "idx", 4, 0)
    w = W.partitionBy(*part).orderBy("idx")
    d = d.withColumns({**{f"d{i}": F.lag("prior_delta", i - 1).over(w) for i in (1, 2, 3, 4)},
                       **{f"s{i}": F.lag("prior_slope", i - 1).over(w) for i in (1, 2, 3)}}).filter("_own")
    arr = lambda *cs: F.array_compact(F.array(*cs))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a))

    def std(a):
        m = mean(a)
        return F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m))))
    c = F.col
    recent, slopes = arr(c("d1"), c("d2"), c("d3")), arr(c("s1"), c("s2"), c("s3"))
    acc = arr(c("d1") - c("d2"), c("d2") - c("d3"), c("d3") - c("d4"))
    n = c("history")
    mu = c("sum_delta") / n
    feats = d.select(
        "cell_id", c("k").alias("checkup_k"), n.alias("prior_history_length"), c("d1").alias("prior_capacity_delta_lag1"),
        c("d2").alias("prior_capacity_delta_lag2"), c("d3").alias("prior_capacity_delta_lag3"), mean(recent).alias("prior_delta_mean_3"),
        std(recent).alias("prior_delta_std_3"), F.array_min(recent).alias("prior_delta_min_3"), F.array_max(recent).alias("prior_delta_max_3"),
        F.when(n > 0, mu).alias("prior_delta_mean_all"),
        F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), c("sum_delta2") / n - mu * mu))).alias("prior_delta_std_all"),
        mean(slopes).alias("prior_slope_per_day_mean_3"), std(slopes).alias("prior_slope_per_day_std_3"),
        (c("d1") - c("d2")).alias("prior_capacity_curvature_lag1"), mean(acc).alias("prior_capacity_acceleration_mean_3"),
        std(recent).alias("prior_capacity_volatility_3"), c("increases").alias("prior_capacity_increase_count"),
        F.when(n > 0, c("increases") / n).alias("prior_capacity_increase_fraction"),
        F.when(n > 0, c("cap_max") - c("cap_min")).alias("prior_capacity_range_Ah_all"), c("abs_max").alias("prior_delta_abs_max_all"),
        F.when(n == 0, "no_prior_history").when(n < 3, "short_prior_history").otherwise("none").alias("trajectory_quality_flags"))
    keys = ["cell_id", "parameter_set", "replicate_id", "checkup_k", "target_checkup_k", "horizon_checkups"]
    return horizon.select(*keys).join(feats, ["cell_id", "checkup_k"])


def trajectory_coverage(features: DataFrame, horizon: DataFrame) -> DataFrame:
    h = "horizon_checkups"
    g = features.groupBy(h).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum((F.col("prior_history_length") == 0).cast("long")).alias("zero_prior_history_rows"),
        F.min("prior_history_length").alias("min_prior_history_length"), F.max("prior_history_length").alias("max_prior_history_length"),
        F.countDistinct("cell_id").alias("cells"), F.countDistinct("parameter_set").alias("parameter_sets"))
    med = quantiles(features.withColumn("_l", F.col("prior_history_length").cast("double")), [h], "_l",
                    {"median_prior_history_length": 0.5})
    return (horizon.groupBy(h).agg(F.count(F.lit(1)).alias("expected_horizon_rows")).join(g, h, "left").join(med, h, "left"))


def diagnostic_horizon(points: DataFrame, states: dict[str, tuple[DataFrame, list]], horizons=HORIZONS) -> DataFrame:
    """Future diagnostic values; the future one must be finite, the current one may be missing.

    states: {family: (frame keyed by cell_id, checkup_k with quality_flags, target columns)}
    """
    long = None
    for family, (df, targets) in states.items():
        one = df.select("cell_id", "checkup_k", "quality_flags", F.explode(F.array(*[
            F.struct(F.lit(t).alias("target_name"), S.finite(F.col(t)).alias("value")) for t in targets])).alias("s"))
        one = one.select("cell_id", "checkup_k", F.lit(family).alias("diagnostic_family"), "s.target_name", "s.value", "quality_flags")
        long = one if long is None else long.unionByName(one)
    # keys and values meet first; a point's own columns join them once, at the end
    exists = points.select("cell_id", F.col("k").alias("target_checkup_k"))
    fut = long.filter("value IS NOT NULL").select("cell_id", F.col("checkup_k").alias("target_checkup_k"), "diagnostic_family",
                                                  "target_name", F.col("value").alias("diagnostic_value_kh"), F.col("quality_flags").alias("_ff"))
    cur = long.select("cell_id", F.col("checkup_k").alias("k"), "diagnostic_family", "target_name",
                      F.col("value").alias("diagnostic_value_k"), F.col("quality_flags").alias("_cf"))
    ends = (fut.join(exists, ["cell_id", "target_checkup_k"], "left_semi")
            .withColumn("horizon_checkups", F.explode(F.array(*[F.lit(h) for h in horizons])))
            .withColumn("k", F.col("target_checkup_k") - F.col("horizon_checkups")))
    own = points.select("cell_id", "k", "parameter_set", "replicate_id", "capacity_Ah", "soh", "calendar_days_since", "cum_efc", "cum_q", "prior_delta",
                        "prior_slope", *META, *FOLDS)
    j = ends.join(cur, ["cell_id", "k", "diagnostic_family", "target_name"], "left").join(own, ["cell_id", "k"])
    flags = merge_flags(F.col("_cf"), F.col("_ff"), F.when(F.col("diagnostic_value_k").isNull(), "missing_current_diagnostic"))
    return j.select(
        "cell_id", "parameter_set", "replicate_id", F.col("k").alias("checkup_k"), "target_checkup_k", "horizon_checkups",
        "diagnostic_family", "target_name", "diagnostic_value_k", "diagnostic_value_kh",
        (F.col("diagnostic_value_kh") - F.col("diagnostic_value_k")).alias("delta_diagnostic_value_h"),
        F.col("capacity_Ah").alias("capacity_Ah_k"), F.col("soh").alias("soh_k"), F.col("calendar_days_since").alias("calendar_day_k"),
        F.col("cum_efc").alias("cumulative_efc_k"), F.col("cum_q").alias("cumulative_q_Ah_k"),
        F.col("prior_delta").alias("prior_delta_capacity_Ah"), F.col("prior_slope").alias("prior_capacity_slope_per_day"),
        *META, *FOLDS, flags.alias("diagnostic_quality_flags"))


def merge_flags(*texts):
    """Sorted distinct non-empty flags of several ``;`` texts, or ``none``."""
    a = F.array_sort(F.array_distinct(F.filter(F.split(F.concat_ws(";", *texts), ";"),
                                               lambda x: (x != "") & (x != "none") & (x != "OK"))))
    return F.when(F.size(a) > 0, F.concat_ws(";", a)).otherwise("none")


def diagnostic_coverage(diag: DataFrame, points: DataFrame, horizons=HORIZONS) -> DataFrame:
    possible = horizon_coverage(diag.limit(0), points, horizons).select(
        "horizon_checkups", F.col("possible_start_rows").alias("possible_capacity_start_rows"))
    keys = ["diagnostic_family", "target_name", "horizon_checkups"]
    g = diag.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"),
                                F.count("diagnostic_value_k").alias("finite_current_diagnostic_rows"), *holdout_counts())
    return g.join(possible, "horizon_checkups", "left").withColumn(
        "missing_or_unobserved_target_rows", F.greatest(F.col("possible_capacity_start_rows") - F.col("row_count"), F.lit(0)))
