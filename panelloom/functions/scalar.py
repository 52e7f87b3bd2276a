"""Row-level rules: bins, flags, classifiers and guarded arithmetic."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# ---- fixed values: limits, labels and bins that results depend on ----
MODALITY_WORDS = {"cfg": ["cfg", "config"], "eoc": ["eoc"], "eis": ["eis", "impedance"],
                  "pulse": ["pulse", "pls"], "log_age": ["log_age", "log-age", "logage"],
                  "log": ["log"]}
COHORT_PATTERN = r"P\d{3}_\d"
FREQ_BAND = (0.5, 5000.0)
FREQ_EXCLUDED = [(100.0, 0.01, "excluded_100Hz"), (208.3, 0.1, "excluded_208p3Hz"),
                 (14700.0, 10.0, "excluded_14p7kHz")]
WINDOW_FAMILIES = [(2.50, 4.20, "approx_0_100"), (3.249, 4.20, "approx_10_100"),
                   (3.249, 4.092, "approx_10_90")]
WINDOW_TOLERANCE = 0.011
REST_CURRENT_A = 0.05
EFC_JITTER = 0.00025
RATIO_EPS = 1e-12
MAGNITUDES = [(1e-9, "tiny"), (1.0, "small"), (60.0, "medium"), (3600.0, "large")]
PROBABILITY_EPS = 1e-6
EFFECT_EPS = 1e-12
STRESSOR_COLUMNS = {
    "temperature_holdout_fold": ["nominal_temperature_C"],
    "c_rate_holdout_fold": ["charge_bucket", "discharge_bucket"],
    "profile_holdout_fold": ["profile_label"],
    "voltage_window_holdout_fold": ["voltage_window_family"],
    "condition_fold": ["aging_mode", "nominal_temperature_C", "charge_bucket",
                       "voltage_window_family", "profile_label"],
}


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def safe_ratio(num: Column, den: Column) -> Column:
    n, d = finite(num), finite(den)
    return F.when(F.abs(d) > RATIO_EPS, n / d)


def cut(v: Column, steps, last: str, *, closed: bool = False, missing: str | None = None) -> Column:
    """Label by the first step whose limit is above the value (``closed``: at or above)."""
    out = None
    if missing is not None:
        out = F.when(v.isNull(), missing)
    for limit, label in steps:
        test = v <= limit if closed else v < limit
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(last)


def window_family(v_min: Column, v_max: Column, mode: Column, soc: Column) -> Column:
    num = soc.try_cast("double")
    soc_text = (F.when(num.isNull(), F.replace(F.trim(soc), F.lit("%"), F.lit("")))
                .when(num == F.floor(num), num.cast("long").cast("string"))
                .otherwise(F.replace(num.cast("string"), F.lit("."), F.lit("p"))))
    out = F.when(mode == "calendar", F.concat(F.lit("calendar_soc_"), soc_text))
    for lo, hi, name in WINDOW_FAMILIES:
        near = (F.abs(v_min - lo) <= WINDOW_TOLERANCE) & (F.abs(v_max - hi) <= WINDOW_TOLERANCE)
        out = out.when(near, name)
    custom = F.replace(F.format_string("custom_%.2f_%.2f", v_min, v_max), F.lit("."), F.lit("p"))
    return out.otherwise(custom)


def modeling_mask(freq: Column, z_re: Column, z_im: Column, valid: Column) -> Column:
    ok = (valid == 1) & finite(z_re).isNotNull() & finite(z_im).isNotNull() & freq.between(*FREQ_BAND)
    for f, tol, _ in FREQ_EXCLUDED:
        ok = ok & ~(F.abs(freq - f) < tol)
    return F.coalesce(ok, F.lit(False))


def frequency_bucket(freq: Column) -> Column:
    out = F.when(finite(freq).isNull(), "nonfinite")
    for f, tol, label in FREQ_EXCLUDED:
        out = out.when(F.abs(freq - f) < tol, label)
    return (out.when(freq.between(*FREQ_BAND), "modeling_band_other")
            .when(freq < FREQ_BAND[0], "below_0p5Hz").otherwise("above_5kHz"))


def current_state(i: Column, rest: float = REST_CURRENT_A) -> Column:
    v = finite(i)
    return (F.when(v.isNull(), "unknown").when(F.abs(v) <= rest, "rest")
            .when(v > rest, "charge").otherwise("discharge"))


def interval_policy(jitter: float = EFC_JITTER) -> dict[str, Column]:
    """Boolean columns over the interval table's monotonicity summary."""
    bad_time = F.col("duration_s") <= 0
    missing = ~F.col("LOG_AGE_available") | (F.col("log_age_row_count") <= 0)
    dropped = (F.col("log_age_timestamp_decrease_count") > 0) | (F.col("log_age_max_timestamp_drop_s") > 0)
    any_bad = F.col("log_age_monotonicity_violation_count") > 0
    efc = F.col("log_age_max_efc_drop")
    usable = ~(bad_time | missing)
    return {
        "baseline_clean_strict": usable & ~any_bad,
        "baseline_clean_tolerant": usable & ~dropped & ~(efc > jitter),
        "sensitivity_flagged_monotonicity": any_bad,
        "small_efc_jitter": any_bad & ~dropped & (efc > 0) & (efc <= jitter),
        "excluded_due_to_large_efc_drop": efc > jitter,
        "excluded_due_to_timestamp_drop": dropped,
        "excluded_due_to_missing_log_age": missing,
        "excluded_due_to_duration_error": bad_time,
    }


def c_rate_bucket(v: Column) -> Column:
    return cut(finite(v), [(1.0, "<1C"), (1.5, "1C-1.5C"), (5.0 / 3.0, "1.5C-5over3C")], ">=5over3C",
               missing="unknown")


def interval_count_bucket(v: Column) -> Column:
    return cut(v, [(5, "<=5"), (10, "6-10"), (20, "11-20")], ">20", closed=True, missing="unknown")


def midpoint_bucket(lo: Column, hi: Column, limits, labels) -> Column:
    a, b = finite(lo), finite(hi)
    mid = F.coalesce((a + b) / 2.0, a, b)
    return cut(mid, list(zip(limits, labels[:-1])), labels[-1], missing="unknown")


def growth_bin(v: Column) -> Column:
    f = finite(v)
    return cut(f, [(-0.001, "negative"), (0.001, "near_zero"), (0.003, "moderate")], "high")


def violation_type(time_bad: Column, efc_bad: Column) -> Column:
    return (F.when(time_bad & efc_bad, "both").when(time_bad, "timestamp_decrease")
            .otherwise("efc_decrease"))


def magnitude_bucket(time_drop: Column, efc_drop: Column) -> Column:
    return cut(F.greatest(time_drop, efc_drop), MAGNITUDES, "severe", closed=True)


def temperature_fold(t: Column) -> Column:
    return F.when(t == 0, 1).when(t == 40, 2).otherwise(0)


def c_rate_fold(chg: Column, dis: Column) -> Column:
    return F.when((chg >= 5.0 / 3.0) | (dis >= 5.0 / 3.0), 1).otherwise(0)


def profile_fold(mode: Column) -> Column:
    return F.when(mode == "profile", 1).otherwise(0)


def replicate_fold(rep: Column) -> Column:
    return F.when(rep == 3, 1).otherwise(0)


def voltage_fold(family: Column) -> Column:
    return (F.when(family == "approx_0_100", 1).when(family.isin("approx_10_100", "approx_10_90"), 2)
            .when(family.startswith("calendar_soc_"), 3).otherwise(0))


def label_status(positive: Column, remaining: Column, horizon, event_observed: Column) -> Column:
    return (F.when(positive, "positive_observed")
            .when((remaining > horizon) | event_observed, "negative_observed")
            .otherwise("right_censored_unknown"))


def lead_time_bin(margin: Column, time_to_event: Column) -> Column:
    later = cut(time_to_event, [(1, "event_next_checkup"), (2, "event_within_2_checkups_not_next"),
                                (3, "event_within_3_checkups_not_1_or_2")],
                "event_later_than_3_checkups", closed=True, missing="right_censored_unknown")
    return F.when(margin <= 0, "at_or_below_threshold_at_k").otherwise(later)


def proximity_bin(soh: Column, threshold: float = 0.8) -> Column:
    return cut(soh - threshold,
               [(0.0, "at_or_below_threshold"), (0.02, "within_2pct_soh"),
                (0.05, "within_5pct_soh"), (0.10, "within_10pct_soh")],
               "above_10pct_soh", closed=True)


def capacity_margins(cap: Column, soh: Column, k: Column, threshold: float = 0.8) -> dict[str, Column]:
    init = F.when(soh > 0, cap / soh)
    return {
        "margin_soh": soh - threshold,
        "margin_Ah": cap - threshold * init,
        "prior_slope_Ah": F.when((k > 0) & init.isNotNull(), (cap - init) / k).otherwise(0.0),
    }


def effect_sign(effect: Column) -> Column:
    return (F.when(effect > EFFECT_EPS, "arm_b_more_degraded")
            .when(effect < -EFFECT_EPS, "arm_a_more_degraded").otherwise("tie"))


def effect_bin(size: Column) -> Column:
    return cut(size, [(0.01, "tiny_lt_0.01Ah"), (0.02, "small_0.01_to_0.02Ah"), (0.05, "medium_0.02_to_0.05Ah")], "large_ge_0.05Ah")


def checkup_bin(k: Column) -> Column:
    return cut(k, [(3, "checkup_0_3"), (7, "checkup_4_7"), (12, "checkup_8_12")], "checkup_13_plus", closed=True, missing="unknown")


def soh_bin(soh: Column) -> Column:
    return (F.when(soh.isNull(), "unknown").when(soh >= 0.9, "soh_ge_0_90").when(soh >= 0.8, "soh_0_80_0_90")
            .when(soh >= 0.7, "soh_0_70_0_80").otherwise("soh_lt_0_70"))


def prior_delta_bin(d: Column) -> Column:
    return cut(F.abs(d), [(0.005, "prior_abs_lt_0_005"), (0.02, "prior_abs_0_005_0_02"),
                           (0.05, "prior_abs_0_02_0_05")], "prior_abs_ge_0_05",
               missing="unknown")


def clip_probability(p: Column, eps: float = PROBABILITY_EPS) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))


def logit(p: Column, eps: float = PROBABILITY_EPS) -> Column:
    c = clip_probability(p, eps)
    return F.log(c / (1.0 - c))


def stressor_key(split: Column) -> Column:
    """A text key of the stressor columns that the split varies."""
    parts = {"charge_bucket": c_rate_bucket(F.col("nominal_charge_C_rate")),
             "discharge_bucket": c_rate_bucket(F.col("nominal_discharge_C_rate"))}
    text = {name: F.concat_ws("|", *[group_label(parts.get(c, F.col(c))) for c in cols])
            for name, cols in STRESSOR_COLUMNS.items()}
    out = None
    for name, t in text.items():
        if name != "condition_fold":
            out = F.when(split == name, t) if out is None else out.when(split == name, t)
    return out.otherwise(text["condition_fold"])


def group_label(c: Column) -> Column:
    """Text of a grouping value; NULL becomes ``unknown``."""
    return F.coalesce(c.cast("string"), F.lit("unknown"))


def rate_to_level(pred: Column, target: Column, days: Column, efc: Column) -> Column:
    return (F.when(target == "delta_capacity_per_day", pred * days)
            .when(target == "delta_capacity_per_efc", pred * efc).otherwise(pred))


def cold_fast(temp: Column, rate: Column) -> Column:
    return (temp <= 10.0) & (rate >= 1.0)


def low_support(score: Column, limit: float = 0.5) -> Column:
    return score < limit


def spectrum_key(soc: Column, context: Column) -> dict[str, Column]:
    return {"soc_key": F.round(soc, 1), "context_key": F.upper(context)}


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)
