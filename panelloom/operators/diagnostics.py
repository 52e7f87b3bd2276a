"""Pulse and impedance diagnostics: as-of alignment, summaries, features, two-state targets."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as S
from ..functions.ordered import attach, carry, quantiles

# ---- fixed values: selected frequencies and alignment limits ----
SELECTED = {"0p5Hz": 0.5, "1Hz": 1.0, "10Hz": 10.0, "1kHz": 1000.0, "5kHz": 5000.0}
ALIGNMENT_LIMITS_S = [6 * 3600.0, 12 * 3600.0, 24 * 3600.0, 36 * 3600.0]
SPECTRUM = ["cell_id", "checkup_k", "soc_percent", "temperature_context"]
PULSE_KEY = SPECTRUM + ["pulse_direction"]
EIS_VALUES = ["z_real_1kHz", "z_imag_1kHz", "z_abs_1kHz", "phase_1kHz", "nyquist_re_min", "nyquist_re_max",
              "nyquist_im_peak_abs", "nyquist_semicircle_width_proxy"]
EIS_DELTAS = ["z_real_1kHz", "z_abs_1kHz", "nyquist_semicircle_width_proxy"]


def nearest_checkup(points: DataFrame, checkups: DataFrame, *, time_col: str = "timestamp", id_col: str = "point_id",
                    width: float = 86400.0) -> DataFrame:
    """Nearest check-up of the cell by absolute time; the earlier one wins a tie.

    Points and check-ups are merged on one time line and the last check-up is carried
    forward, so no point is paired with every check-up of its cell.  Points travel whole on the
    line: ids only order points of one time, so null and repeated ids lose and multiply nothing.
    """
    c = checkups.select("cell_id", F.col("timestamp").alias("t"), F.col("checkup_k").alias("k"))
    c = carry(c.withColumn("_chunk", F.floor(F.col("t") / width)), ["cell_id"], "_chunk", ["t", "k"],
              nxt={"nt": "t", "nk": "k"})
    first = c.groupBy("cell_id").agg(F.min_by(F.struct(F.col("t").alias("ft"), F.col("k").alias("fk")), F.struct("t", "k")).alias("f"))
    marks = c.select("cell_id", "t", F.lit(0).alias("kind"), F.col("k").cast("long").alias("o"),
                     F.struct("t", "k", "nt", "nk").alias("mark"))
    payload = F.struct(*[F.col(p) for p in points.columns])
    pts = points.select("cell_id", F.col(time_col).alias("t"), F.lit(1).alias("kind"), F.col(id_col).cast("long").alias("o"), payload.alias("_row"))
    line = marks.unionByName(pts, allowMissingColumns=True).withColumn("_chunk", F.floor(F.col("t") / width))
    line = carry(line, ["cell_id"], "_chunk", ["t", "kind", "o"], folds={"last": (F.max, "mark")}).filter("kind = 1")
    line = line.join(first, "cell_id", "left")
    before, after = F.col("t") - F.col("last.t"), F.col("last.nt") - F.col("t")
    use_next = after < before
    k = (F.when(F.col("last").isNull(), F.col("f.fk")).when(use_next, F.col("last.nk")).otherwise(F.col("last.k")))
    dt = (F.when(F.col("last").isNull(), F.col("f.ft") - F.col("t")).when(use_next, after).otherwise(before))
    return line.select("_row.*", F.coalesce(k, F.lit(0)).alias("checkup_k"), F.coalesce(F.abs(dt), F.lit(0.0)).alias("alignment_delta_s"))


def pulse_summary(pulses: DataFrame, order: str = "point_id") -> DataFrame:
    """Mean temperature and first-row resistances per pulse key."""
    d = pulses.withColumn("soc_percent", F.round("soc_percent", 1))
    first = lambda c: F.min_by(c, order).alias(c)
    return d.groupBy(*PULSE_KEY).agg(
        F.avg("temperature_C").alias("temperature_C"), first("pulse_10ms_resistance"), first("pulse_1s_resistance"),
        first("alignment_delta_s"), F.count(F.lit(1)).alias("n"))


def canonical_state(summary: DataFrame, soc: float = 50.0, context: str = "RT", direction: str = "mean") -> DataFrame:
    d = summary.filter((F.abs(F.col("soc_percent") - soc) < 1e-6) & (F.upper("temperature_context") == context.upper()))
    if direction != "mean":
        d = d.filter(F.lower("pulse_direction") == direction)
    return d.groupBy("cell_id", "checkup_k").agg(*[F.avg(c).alias(c) for c in (
        "pulse_1s_resistance", "pulse_10ms_resistance", "alignment_delta_s")])


def two_state(intervals: DataFrame, state: DataFrame, values, deltas, flag: str, *, prefix: str = "", keep=()) -> DataFrame:
    """Left join a state at k and at k_next, with deltas and ``missing_*`` flags."""
    out = intervals.select("cell_id", "parameter_set", "replicate_id", "checkup_k", "checkup_k_next", *keep)
    name = lambda v, s: (f"{prefix}{v}_{s}" if v.startswith(("z_", "phase")) else f"{v}_{s}")
    for s, key in (("k", "checkup_k"), ("k1", "checkup_k_next")):
        st = state.select("cell_id", F.col("checkup_k").alias(key), F.lit(1).alias(f"_h{s}"),
                          *[F.col(v).alias(name(v, s)) for v in values])
        out = out.join(st, ["cell_id", key], "left")
    d = {f"delta_{prefix}{v}" if v.startswith(("z_", "phase")) else f"delta_{v}": F.col(name(v, "k1")) - F.col(name(v, "k"))
         for v in deltas}
    flags = F.concat_ws(";", F.when(F.col("_hk").isNull(), f"missing_{flag}_k"), F.when(F.col("_hk1").isNull(), f"missing_{flag}_k1"))
    return out.withColumns({**d, "quality_flags": F.when(flags == "", "OK").otherwise(flags)}).drop("_hk", "_hk1")


def pulse_targets(intervals: DataFrame, summary: DataFrame, keep=(), **canonical) -> DataFrame:
    return two_state(intervals, canonical_state(summary, **canonical), ["pulse_1s_resistance", "pulse_10ms_resistance", "alignment_delta_s"],
                     ["pulse_1s_resistance", "pulse_10ms_resistance"], "pulse", keep=keep)


# ---- spectra ----
def spectrum_quality(rows: DataFrame) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(*SPECTRUM).agg(
        F.avg("temperature_C").alias("temperature_C_mean"), F.count(F.lit(1)).alias("total_frequencies"),
        n(F.col("is_valid_raw")).alias("valid_raw_frequencies"), n(F.col("is_valid_modeling_frequency")).alias("valid_modeling_frequencies"),
        F.avg(F.col("is_valid_modeling_frequency").cast("double")).alias("valid_modeling_fraction"),
        F.min_by("alignment_delta_s", "row_id").alias("alignment_delta_s"))


def selected_frequencies(rows: DataFrame, tie: str = "row_id") -> DataFrame:
    """Nearest valid row to each selected frequency, within max(0.05 Hz, 8 %)."""
    d = rows.filter("is_valid_modeling_frequency")
    f, aggs = F.col("frequency_Hz"), []
    vals = ["z_real", "z_imag", "z_abs", "phase", "frequency_Hz"]
    for label, target in SELECTED.items():
        dist = F.abs(f - target)
        ok = F.when(dist <= max(0.05, target * 0.08), F.struct(dist, tie))
        aggs.append(F.min_by(F.struct(*vals), ok).alias(label))
    g = d.groupBy(*SPECTRUM).agg(*aggs)
    return g.select(*SPECTRUM, *[F.col(f"{lb}.{v}").alias(f"{v}_{lb}" if v != "frequency_Hz" else f"freq_selected_{lb}")
                                 for lb in SELECTED for v in vals])


def nyquist_shape(rows: DataFrame, tie: str = "row_id") -> DataFrame:
    """Extent of the arc and the slope between the two lowest-frequency points.

    The two lowest points come from ``min_by`` and from the smallest order key above it,
    both as aggregates: no spectrum is ranked in a window.
    """
    d = rows.filter("is_valid_modeling_frequency")
    pos = F.struct("frequency_Hz", tie)
    g = d.groupBy(*SPECTRUM).agg(
        F.min("z_real").alias("nyquist_re_min"), F.max("z_real").alias("nyquist_re_max"), F.min("z_imag").alias("nyquist_im_min"),
        F.max(F.abs("z_imag")).alias("nyquist_im_peak_abs"), (F.max("z_real") - F.min("z_real")).alias("nyquist_semicircle_width_proxy"),
        F.max_by("z_real", F.struct("frequency_Hz", -F.col(tie))).alias("nyquist_high_freq_re_intercept_proxy"),
        F.min_by(F.struct(pos.alias("pos"), "z_real", "z_imag"), pos).alias("a"))
    second = (d.join(g.select(*SPECTRUM, "a"), SPECTRUM).filter(pos > F.col("a.pos")).groupBy(*SPECTRUM)
              .agg(F.min_by(F.struct("z_real", "z_imag"), pos).alias("b")))
    slope = F.when(F.abs(F.col("b.z_real") - F.col("a.z_real")) > 1e-12,
                   (F.col("b.z_imag") - F.col("a.z_imag")) / (F.col("b.z_real") - F.col("a.z_real")))
    return g.join(second, SPECTRUM, "left").withColumn("nyquist_low_freq_tail_slope_proxy", slope).drop("a", "b")


def eis_features(rows: DataFrame, quality: DataFrame, intervals: DataFrame, soc: float = 50.0, context: str = "RT") -> DataFrame:
    can = lambda df: df.filter((F.abs(F.col("soc_percent") - soc) < 1e-6) & (F.upper("temperature_context") == context))
    base = can(quality)
    r = can(rows)
    out = base.join(selected_frequencies(r), SPECTRUM, "left").join(nyquist_shape(r), SPECTRUM, "left")
    meta = checkup_metadata(intervals).select("cell_id", "checkup_k", "parameter_set", "replicate_id")
    out = out.join(meta, ["cell_id", "checkup_k"], "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"freq_selected_{lb}").isNull(), lb) for lb in SELECTED]))
    flags = F.concat_ws(";", F.when(F.col("nyquist_re_min").isNull(), "no_valid_modeling_frequencies"),
                        F.when(F.size(missing) > 0, F.concat(F.lit("missing_selected_frequencies="), F.concat_ws(",", missing))))
    return out.withColumn("quality_flags", F.when(flags == "", "OK").otherwise(flags))


def eis_targets(intervals: DataFrame, features: DataFrame, keep=()) -> DataFrame:
    return two_state(intervals, features, EIS_VALUES + ["valid_modeling_fraction", "alignment_delta_s"], EIS_DELTAS, "eis", prefix="eis_", keep=keep)


def checkup_metadata(intervals: DataFrame) -> DataFrame:
    """Interval metadata per (cell, check-up), from the first interval that names it."""
    d = intervals.withColumn("_k", F.explode(F.array("checkup_k", "checkup_k_next")))
    cols = [c for c in intervals.columns if c not in ("cell_id", "checkup_k", "checkup_k_next")]
    return (d.groupBy("cell_id", "_k").agg(F.min_by(F.struct(*cols), "checkup_k").alias("m"))
            .select("cell_id", F.col("_k").alias("checkup_k"), "m.*"))


# ---- audits ----
def mask_audit(rows: DataFrame) -> DataFrame:
    policy = S.modeling_mask(F.col("frequency_Hz"), F.col("z_real"), F.col("z_imag"), F.col("is_valid_raw").cast("int"))
    stored = F.col("is_valid_modeling_frequency")
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(S.frequency_bucket(F.col("frequency_Hz")).alias("frequency_bucket")).agg(
        F.count(F.lit(1)).alias("row_count"), n(stored).alias("stored_modeling_rows"), n(policy).alias("policy_modeling_rows"),
        n(stored != policy).alias("mask_mismatch_rows"))


def grouped(df: DataFrame, columns) -> DataFrame:
    """One row per (row, grouping): ``grouping`` and ``group_value`` as text."""
    arms = F.array(*[F.struct(F.lit(c).alias("grouping"), S.group_label(F.col(c)).alias("group_value")) for c in columns])
    return df.withColumn("_g", F.explode(arms)).select("*", "_g.grouping", "_g.group_value").drop("_g")


def spectrum_coverage(quality: DataFrame, intervals: DataFrame, splits) -> DataFrame:
    """The same coverage aggregate over ten groupings."""
    d = quality.join(checkup_metadata(intervals).select("cell_id", "checkup_k", "parameter_set", *splits), ["cell_id", "checkup_k"], "left")
    d = d.withColumns({c: F.col(c).cast("int") for c in ("soc_percent",)})
    d = grouped(d, ["soc_percent", "temperature_context", "cell_id", "checkup_k", *splits]).filter(
        ~(F.col("grouping").isin(*splits) & (F.col("group_value") == "unknown")))
    keys = ["grouping", "group_value"]
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("spectrum_count"), F.countDistinct("cell_id").alias("unique_cells"),
                             F.countDistinct("parameter_set").alias("unique_parameter_sets"), F.countDistinct("checkup_k").alias("unique_checkups"))
    return attach(g, quantiles(d, keys, "valid_modeling_fraction", {"valid_modeling_fraction_median": .5}), keys)


def target_coverage(targets: DataFrame) -> DataFrame:
    d = grouped(targets, ["cell_id", "parameter_set", "condition_fold", "c_rate_holdout_fold", "profile_holdout_fold"])
    return d.groupBy("grouping", "group_value").agg(
        F.count(F.lit(1)).alias("interval_rows"), F.count("eis_z_abs_1kHz_k").alias("finite_prior_eis_rows"),
        F.count("eis_z_abs_1kHz_k1").alias("finite_k1_eis_rows"), F.count("delta_eis_z_abs_1kHz").alias("finite_delta_rows"))


def pulse_coverage(summary: DataFrame) -> DataFrame:
    return summary.groupBy(*PULSE_KEY).agg(F.count(F.lit(1)).alias("row_count"))


def numeric_summary(df: DataFrame, keys, value: str) -> DataFrame:
    """count, min, median, p95, max of the finite values."""
    d = df.withColumn("_x", S.finite(F.col(value)))
    return quantiles(d, keys, "_x", {"min": 0.0, "median": 0.5, "p95": 0.95, "max": 1.0}, n_out="count")


def alignment_sensitivity(targets: DataFrame, limits=ALIGNMENT_LIMITS_S) -> DataFrame:
    """Rows kept under each alignment limit (NULL limit: all); one pass over the targets."""
    usable = F.col("delta_pulse_1s_resistance").isNotNull() & F.col("alignment_delta_s_k").isNotNull() & F.col("alignment_delta_s_k1").isNotNull()
    worst = F.greatest("alignment_delta_s_k", "alignment_delta_s_k1")
    arms = F.array(*[F.struct(F.lit(t).cast("double").alias("threshold_s"), (usable & ((worst <= t) if t is not None else F.lit(True))).alias("kept"))
                     for t in [*limits, None]])
    d = targets.withColumn("_a", F.explode(arms)).select("*", "_a.threshold_s", F.coalesce("_a.kept", F.lit(False)).alias("kept"))
    on = lambda c: F.when(F.col("kept"), c)
    n = lambda c: F.coalesce(F.sum(on(c.cast("long"))), F.lit(0))
    return d.groupBy("threshold_s").agg(
        n(F.lit(True)).alias("retained_intervals"), F.sum((~F.col("kept")).cast("long")).alias("missing_intervals"),
        F.countDistinct(on(F.col("cell_id"))).alias("retained_cells"), F.countDistinct(on(F.col("parameter_set"))).alias("retained_parameter_sets"),
        n(F.col("c_rate_holdout_fold") == 1).alias("c_rate_holdout_rows"), n(F.col("profile_holdout_fold") == 1).alias("profile_holdout_rows"))


def spectrum_alignment(quality: DataFrame, limits=ALIGNMENT_LIMITS_S) -> DataFrame:
    arms = F.array(*[F.struct(F.lit(t).cast("double").alias("threshold_s"),
                              ((F.col("alignment_delta_s") <= t) if t is not None else F.lit(True)).alias("kept")) for t in [*limits, None]])
    d = quality.withColumn("_a", F.explode(arms)).select("*", "_a.threshold_s", "_a.kept")
    return d.groupBy("threshold_s").agg(F.sum(F.col("kept").cast("long")).alias("retained_spectra"),
                                        F.countDistinct(F.when(F.col("kept"), F.col("cell_id"))).alias("retained_cells"))


def missing_by_group(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(S.group_label(F.col(column)).alias("group_value")).agg(
        F.count(F.lit(1)).alias("missing_rows"), F.countDistinct("cell_id").alias("missing_cells"),
        F.countDistinct("parameter_set").alias("missing_parameter_sets"))


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def pulse_qa(summary: DataFrame, checkups: DataFrame) -> DataFrame:
    """One row: rows, keys, duplicates and check-ups without the canonical state."""
    can = canonical_state(summary).select("cell_id", "checkup_k")
    miss = checkups.select("cell_id", "checkup_k").join(can, ["cell_id", "checkup_k"], "left_anti").agg(F.count(F.lit(1)).alias("missing_checkups"))
    dup = duplicate_keys(summary, PULSE_KEY).agg(F.count(F.lit(1)).alias("duplicate_keys"))
    rows = summary.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("cell_id").alias("cells"))
    return rows.crossJoin(dup).crossJoin(miss)   # one-row frames


def eligible_intervals(targets: DataFrame, max_delta_s=None, min_fraction=None, complete: bool = False) -> DataFrame:
    """Keys of spectra targets that meet the alignment, completeness and fraction filters."""
    c = []
    if max_delta_s is not None:
        c += [F.col(f"alignment_delta_s_{s}") <= max_delta_s for s in ("k", "k1")]
    if min_fraction is not None:
        c += [F.col(f"valid_modeling_fraction_{s}") >= min_fraction for s in ("k", "k1")]
    if complete:
        c += [F.col("quality_flags") == "OK"]
    out = targets.filter(reduce(lambda a, b: a & b, c)) if c else targets
    return out.select("cell_id", "checkup_k", "checkup_k_next")
