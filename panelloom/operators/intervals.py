"""Interval spine, log range join, exposure aggregates and monotonicity audit."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..functions.ordered import carry, quantiles

DAY = 86400.0
KEY = ["cell_id", "checkup_k"]
CONDITION_COLUMNS = ["aging_mode", "nominal_temperature_C", "voltage_window", "voltage_window_family",
                     "soc_window_approx", "nominal_charge_C_rate", "nominal_discharge_C_rate",
                     "profile_label"]
FOLD_COLUMNS = ["condition_fold", "temperature_holdout_fold", "voltage_window_holdout_fold",
                "soc_window_holdout_fold", "c_rate_holdout_fold", "profile_holdout_fold",
                "replicate_calibration_fold", "time_horizon_fold"]


def interval_spine(checkups: DataFrame, conditions: DataFrame | None = None,
                   splits: DataFrame | None = None, *, k_block: int = 64) -> DataFrame:
    """Pairs of adjacent check-ups of a cell; window bounds count from its first check-up."""
    d = checkups.withColumn("_chunk", F.floor(F.col("checkup_k") / k_block))
    d = carry(d, ["cell_id"], "_chunk", ["checkup_k", "timestamp"], nxt={
        "checkup_k_next": "checkup_k", "t_result_k1_s": "timestamp",
        "capacity_Ah_k1": "capacity_Ah", "_soh1": "capacity_soh"}).drop("_chunk")
    zero = checkups.groupBy("cell_id").agg(
        F.min_by("timestamp", F.struct("checkup_k", "timestamp")).alias("_zero"))
    d = d.filter(F.col("checkup_k_next") > F.col("checkup_k")).join(zero, "cell_id")
    dur = F.col("t_result_k1_s") - F.col("timestamp")
    out = d.select(
        "cell_id", "parameter_set", "replicate_id", "checkup_k", "checkup_k_next",
        F.col("timestamp").alias("t_result_k_s"), "t_result_k1_s",
        dur.alias("duration_s"), (dur / 3600.0).alias("duration_h"), (dur / DAY).alias("calendar_days"),
        F.col("capacity_Ah").alias("capacity_Ah_k"), "capacity_Ah_k1",
        (F.col("capacity_Ah_k1") - F.col("capacity_Ah")).alias("delta_capacity_Ah"),
        (F.col("_soh1") - F.col("capacity_soh")).alias("delta_capacity_soh"),
        (F.col("timestamp") - F.col("_zero")).alias("window_start_s"),
        (F.col("t_result_k1_s") - F.col("_zero")).alias("window_end_s"))
    if conditions is not None:
        out = out.join(conditions.select("cell_id", *CONDITION_COLUMNS), "cell_id")
    if splits is not None:
        out = out.join(splits.select("cell_id", *FOLD_COLUMNS), "cell_id")
    return out


def range_join(points: DataFrame, spine: DataFrame, time_col: str = "timestamp_s", *,
               cols=(), width: float = DAY, how: str = "inner", bucket: str | None = None) -> DataFrame:
    """Attach the interval with ``start < t <= end`` (left open, right closed).

    Both sides get a time bucket, and the interval is repeated once per bucket it covers, so
    the join is an equi-join on (cell, bucket) with a residual range test.  Each point meets
    only intervals of its own bucket; a hot cell is spread over its buckets, and neither side
    has to be broadcast.  Spark may still broadcast the interval side when its measured size
    is under ``autoBroadcastJoinThreshold``.  ``bucket`` names a column that keeps the point's time bucket; both sides
    are then shuffled in any case, so that what follows by (cell, bucket) finds its rows together.
    """
    first = F.floor(F.col("window_start_s") / width).cast("long")
    last = F.floor(F.col("window_end_s") / width).cast("long")
    iv = spine.select(F.col("cell_id").alias("_cell"), "checkup_k", "checkup_k_next",
                      "window_start_s", "window_end_s", *cols,
                      F.explode(F.sequence(first, last)).alias("_bucket"))
    p = points.withColumn("_pb", F.floor(F.col(time_col) / width).cast("long"))
    cond = ((F.col("cell_id") == F.col("_cell")) & (F.col("_pb") == F.col("_bucket"))
            & (F.col(time_col) > F.col("window_start_s")) & (F.col(time_col) <= F.col("window_end_s")))
    out = p.join(iv if bucket is None else iv.hint("merge"), cond, how).drop("_cell", "_bucket")
    return out.drop("_pb") if bucket is None else out.withColumnRenamed("_pb", bucket)


def interval_exposure(log_in_interval: DataFrame) -> DataFrame:
    """Exposure aggregates per interval (one partial + final hash aggregate)."""
    span = lambda c: F.max(c) - F.min(c)
    i_abs = F.abs("i_raw_A")
    return log_in_interval.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("log_age_row_count"),
        span("timestamp_s").alias("log_age_elapsed_s"), span("EFC").alias("log_age_efc_delta"),
        span("delta_q_Ah").alias("log_age_delta_q_Ah"),
        F.avg("v_raw_V").alias("log_age_mean_voltage_V"), F.min("v_raw_V").alias("log_age_min_voltage_V"),
        F.max("v_raw_V").alias("log_age_max_voltage_V"),
        F.avg("t_cell_degC").alias("log_age_mean_temperature_C"),
        F.min("t_cell_degC").alias("log_age_min_temperature_C"),
        F.max("t_cell_degC").alias("log_age_max_temperature_C"),
        F.avg("i_raw_A").alias("log_age_mean_current_A"), F.avg(i_abs).alias("log_age_mean_abs_current_A"),
        F.max(i_abs).alias("log_age_max_abs_current_A"),
        F.avg("soc_est").alias("log_age_mean_soc"), F.min("soc_est").alias("log_age_min_soc"),
        F.max("soc_est").alias("log_age_max_soc"),
        F.count("cap_aged_est_Ah").alias("log_age_capacity_diag_rows_masked"),
        F.count("R0_mOhm").alias("log_age_r0_diag_rows_masked"),
        F.count("R1_mOhm").alias("log_age_r1_diag_rows_masked"))


def monotonicity_violations(log: DataFrame, *, order: str = "seq", file_col: str = "source_file",
                            block: int = 65536, time_eps: float = 0.0, efc_eps: float = 1e-9) -> DataFrame:
    """Rows whose time or EFC is below the previous row of the cell in stored (file) order."""
    d = log.withColumn("_chunk", F.floor(F.col(order) / block))
    d = carry(d, ["cell_id"], "_chunk", [order],
              prev={"previous_timestamp_s": "timestamp_s", "previous_EFC": "EFC"})
    t_drop = F.greatest(F.lit(0.0), F.col("previous_timestamp_s") - F.col("timestamp_s"))
    e_drop = F.greatest(F.lit(0.0), F.col("previous_EFC") - F.col("EFC"))
    t_bad, e_bad = t_drop > time_eps, e_drop > efc_eps
    return (d.filter(F.col("previous_timestamp_s").isNotNull() & (t_bad | e_bad))
            .select("cell_id", file_col, order, "timestamp_s", "previous_timestamp_s", "EFC", "previous_EFC",
                    t_drop.alias("timestamp_drop_s"), e_drop.alias("efc_drop"),
                    S.violation_type(t_bad, e_bad).alias("violation_type"),
                    S.magnitude_bucket(t_drop, e_drop).alias("magnitude_bucket")))


def violations_per_interval(violations: DataFrame, spine: DataFrame) -> DataFrame:
    j = range_join(violations, spine)
    one = lambda c: F.sum(c.cast("long"))
    kind = F.col("violation_type")
    return j.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("log_age_monotonicity_violation_count"),
        one(kind.isin("timestamp_decrease", "both")).alias("log_age_timestamp_decrease_count"),
        one(kind.isin("efc_decrease", "both")).alias("log_age_efc_decrease_count"),
        F.max("timestamp_drop_s").alias("log_age_max_timestamp_drop_s"),
        F.max("efc_drop").alias("log_age_max_efc_drop"))


def violation_summary(violations: DataFrame) -> DataFrame:
    """Counts by cell, file and type in one grouping-sets pass."""
    out = violations.groupingSets([["cell_id"], ["source_file"], ["violation_type"]],
                                  "cell_id", "source_file", "violation_type")
    return out.agg(F.count(F.lit(1)).alias("n"), F.max("timestamp_drop_s").alias("max_timestamp_drop_s"),
                   F.max("efc_drop").alias("max_efc_drop"))


def top_violations(violations: DataFrame, n: int = 20) -> DataFrame:
    """The n worst rows by (largest drop, time drop, EFC drop)."""
    d = violations.withColumn("rank_drop", F.greatest("timestamp_drop_s", "efc_drop"))
    return d.orderBy(F.desc("rank_drop"), F.desc("timestamp_drop_s"), F.desc("efc_drop"), "cell_id",
                     "seq").limit(n)


def interval_table(spine: DataFrame, log: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """Spine left-joined with exposure and violation aggregates, plus quality flags."""
    out = spine.join(interval_exposure(range_join(log, spine)), KEY, "left")
    if violations is not None:
        out = out.join(violations_per_interval(violations, spine), KEY, "left")
    else:
        out = out.withColumns({c: F.lit(0) for c in (
            "log_age_monotonicity_violation_count", "log_age_timestamp_decrease_count",
            "log_age_efc_decrease_count", "log_age_max_timestamp_drop_s", "log_age_max_efc_drop")})
    masked = ["log_age_capacity_diag_rows_masked", "log_age_r0_diag_rows_masked", "log_age_r1_diag_rows_masked"]
    counts = ["log_age_row_count", *masked, "log_age_monotonicity_violation_count",
              "log_age_timestamp_decrease_count", "log_age_efc_decrease_count"]
    out = out.fillna(0, counts).fillna(0.0, ["log_age_max_timestamp_drop_s", "log_age_max_efc_drop"])
    any_masked = sum((F.col(c) for c in masked), F.lit(0)) > 0
    bad = F.col("log_age_monotonicity_violation_count") > 0
    return out.withColumns({
        "LOG_AGE_available": F.col("log_age_row_count") > 0,
        "LOG_AGE_monotonicity_clean": ~bad,
        "quality_flags": F.concat_ws(
            ";", F.when(F.col("log_age_row_count") == 0, "LOG_AGE_missing_interval"),
            F.when(any_masked, "LOG_AGE_inserted_diagnostics_masked"),
            F.when(bad, "LOG_AGE_monotonicity_violation"))})


def interval_id() -> Column:
    return F.concat_ws("_", "cell_id", F.concat(F.lit("k"), F.col("checkup_k")),
                       F.concat(F.lit("k"), F.col("checkup_k_next")))


def subset_registry(intervals: DataFrame, jitter: float = S.EFC_JITTER) -> DataFrame:
    flags = S.interval_policy(jitter)
    return intervals.select("cell_id", "parameter_set", "replicate_id", "checkup_k", "checkup_k_next",
                            interval_id().alias("interval_id"), *[c.alias(n) for n, c in flags.items()])


def subset_counts(registry: DataFrame) -> DataFrame:
    names = list(S.interval_policy())
    return registry.agg(F.count(F.lit(1)).alias("intervals"),
                        *[F.sum(F.col(n).cast("long")).alias(n) for n in names])


def interval_qa(intervals: DataFrame, checkups: DataFrame, tolerance_s: float = 1e-6) -> DataFrame:
    """One row: expected and observed counts and failed checks."""
    expect = checkups.agg((F.count(F.lit(1)) - F.countDistinct("cell_id")).alias("expected_intervals"))
    n = lambda c: F.sum(c.cast("long"))
    got = intervals.agg(
        F.count(F.lit(1)).alias("intervals"), F.countDistinct("cell_id").alias("cells"),
        n(F.col("duration_s") <= 0).alias("nonpositive_duration"),
        n(F.abs(F.col("duration_h") * 3600 - F.col("duration_s")) > tolerance_s).alias("duration_mismatch"),
        n(F.coalesce(F.col("log_age_elapsed_s") > F.col("duration_s") + tolerance_s, F.lit(False)))
        .alias("elapsed_over_duration"),
        n(F.coalesce(F.col("log_age_efc_delta") < 0, F.lit(False))).alias("negative_efc"),
        n(~F.col("LOG_AGE_available")).alias("missing_log"),
        n(~F.col("LOG_AGE_monotonicity_clean")).alias("with_violations"))
    return got.crossJoin(expect)   # two one-row frames


def flag_distribution(df: DataFrame, flag_col: str = "quality_flags") -> DataFrame:
    return (df.select(F.explode(F.split(flag_col, ";")).alias("flag")).filter("flag <> ''")
            .groupBy("flag").agg(F.count(F.lit(1)).alias("n")))


def current_sign_steps(log: DataFrame, *, width: float = DAY, rest: float = S.REST_CURRENT_A) -> DataFrame:
    """Voltage and SOC slopes over the step after a sample with non-zero current."""
    d = log.withColumn("_chunk", F.floor(F.col("timestamp_s") / width))
    d = carry(d, ["cell_id"], "_chunk", ["timestamp_s", "seq"],
              prev={"_t": "timestamp_s", "_v": "v_raw_V", "_q": "soc_est", "_i": "i_raw_A"})
    dt = F.col("timestamp_s") - F.col("_t")
    return (d.filter((dt > 0) & (F.abs("_i") > rest))
            .select(F.when(F.col("_i") > 0, "positive").otherwise("negative").alias("sign"),
                    ((F.col("v_raw_V") - F.col("_v")) / dt).alias("dv_dt"),
                    ((F.col("soc_est") - F.col("_q")) / dt).alias("dsoc_dt")))


def current_sign_audit(log: DataFrame, **kw) -> DataFrame:
    """One row per sign of the current: rows, means and medians of the following slopes."""
    s = current_sign_steps(log, **kw)
    means = s.groupBy("sign").agg(F.count(F.lit(1)).alias("n"), F.avg("dv_dt").alias("mean_dv_dt"),
                                  F.avg("dsoc_dt").alias("mean_dsoc_dt"))
    return (means.join(quantiles(s, ["sign"], "dv_dt", {"median_dv_dt": .5}), "sign")
            .join(quantiles(s, ["sign"], "dsoc_dt", {"median_dsoc_dt": .5}), "sign"))


def current_sign_vote(audit: DataFrame, enough: int = 1000, least: int = 3) -> DataFrame:
    """Read the sign convention from the two audit rows; each slope casts one vote."""
    pick = lambda c, sign: F.max(F.when(F.col("sign") == sign, F.col(c)))
    w = audit.agg(*[pick(c, sign).alias(f"{c}_{sign}") for c in ("n", "median_dv_dt", "median_dsoc_dt")
                    for sign in ("positive", "negative")])
    few = F.least("n_positive", "n_negative")
    known = (few >= F.when(few < enough, least).otherwise(enough)) & S.all_of(
        [F.col(f"median_{m}_{s}").isNotNull() for m in ("dv_dt", "dsoc_dt") for s in ("positive", "negative")])

    def votes(direction: int) -> Column:
        return sum(((F.signum(f"median_{m}_positive") == direction)
                    & (F.signum(f"median_{m}_negative") == -direction)).cast("int")
                   for m in ("dv_dt", "dsoc_dt"))
    up, down = votes(1), votes(-1)
    lead = F.greatest(up, down)
    clear = known & ((lead == 2) | ((lead == 1) & (F.least(up, down) == 0)))
    return w.select(
        F.when(~F.coalesce(known, F.lit(False)), "unknown").when(~clear, "ambiguous")
        .when(up > down, "positive_current_charge").otherwise("positive_current_discharge").alias("convention"),
        F.when(clear & (lead == 2), "high").when(clear, "medium").otherwise("low").alias("confidence"))
