"""Dwell histograms and longest runs of stress states per interval."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalar as S
from ..functions.ordered import carry, quantiles

KEY = ["cell_id", "checkup_k"]

# ---- fixed values: bin limits, names and weights of the dwell table ----
NOMINAL_CAPACITY_AH = 3.0
MAX_GAP_S = 300.0
VOLTAGE_BINS = [("time_voltage_lt_3p3_h", None, 3.3), ("time_voltage_3p3_3p6_h", 3.3, 3.6),
                ("time_voltage_3p6_3p9_h", 3.6, 3.9), ("time_voltage_3p9_4p1_h", 3.9, 4.1),
                ("time_voltage_ge_4p1_h", 4.1, None)]
TEMPERATURE_BINS = [("time_temp_lt_5C_h", None, 5.0), ("time_temp_5_15C_h", 5.0, 15.0),
                    ("time_temp_15_30C_h", 15.0, 30.0), ("time_temp_30_40C_h", 30.0, 40.0),
                    ("time_temp_ge_40C_h", 40.0, None)]
SOC_BINS = [("time_soc_lt_20_h", None, 20.0), ("time_soc_20_50_h", 20.0, 50.0),
            ("time_soc_50_80_h", 50.0, 80.0), ("time_soc_ge_80_h", 80.0, None)]
C_RATES = [("1C", 1.0), ("1p5C", 1.5), ("5over3C", 5.0 / 3.0)]
VOLTAGE_WEIGHTS = {"time_voltage_3p3_3p6_h": 0.25, "time_voltage_3p6_3p9_h": 0.5,
                   "time_voltage_3p9_4p1_h": 1.0, "time_voltage_ge_4p1_h": 1.5}
RUNS = ["charge", "discharge", "rest", "abs_current_ge_1C", "abs_current_ge_1p5C", "abs_current_ge_5over3C",
        "cold_high_abs_current", "high_voltage_high_abs_current", "high_soc_high_abs_current"]


@dataclass(frozen=True)
class DwellLimits:
    """Arguments of the dwell table; defaults are the fixed values above."""
    max_gap_s: float = MAX_GAP_S
    gap_counts_s: tuple = (60.0, 300.0)
    rest_current_a: float = S.REST_CURRENT_A
    capacity_ah: float = NOMINAL_CAPACITY_AH
    chunk_s: float = 86400.0


def capped_gaps(log_in_interval: DataFrame, lim: DwellLimits = DwellLimits()) -> DataFrame:
    """Time since the previous sample of the interval (the first one counts from its start)."""
    d = log_in_interval.withColumn("_chunk", F.floor(F.col("timestamp_s") / lim.chunk_s))
    d = carry(d, KEY, "_chunk", ["timestamp_s", "seq"], prev={"_prev": "timestamp_s"})
    raw = F.col("timestamp_s") - F.coalesce(F.col("_prev"), F.col("window_start_s"))
    return (d.withColumn("raw_dt_s", raw).filter(F.col("raw_dt_s") > 0)
            .withColumn("dt_s", F.least(F.col("raw_dt_s"), F.lit(lim.max_gap_s)))
            .withColumn("dt_h", F.col("dt_s") / 3600.0).drop("_prev"))


def states(lim: DwellLimits = DwellLimits()) -> dict[str, Column]:
    """Boolean stress states of a sample."""
    v, t, i, q = (F.col(c) for c in ("v_raw_V", "t_cell_degC", "i_raw_A", "soc_est"))
    out = {}
    for col, bins in ((v, VOLTAGE_BINS), (t, TEMPERATURE_BINS), (q, SOC_BINS)):
        for name, lo, hi in bins:
            parts = ([col >= lo] if lo is not None else []) + ([col < hi] if hi is not None else [])
            out[name] = S.all_of(parts)
    out["charge_time_h"], out["discharge_time_h"] = i > lim.rest_current_a, i < -lim.rest_current_a
    out["rest_time_h"] = F.abs(i) <= lim.rest_current_a
    for name, rate in C_RATES:
        out[f"abs_current_ge_{name}_time_h"] = F.abs(i) >= rate * lim.capacity_ah
        out[f"charge_current_ge_{name}_time_h"] = i >= rate * lim.capacity_ah
    cold, hot, fast = t < 15.0, t >= 40.0, out["abs_current_ge_1p5C_time_h"]
    out["cold_high_charge_time_h"] = cold & out["charge_current_ge_1p5C_time_h"]
    out["cold_high_abs_current_time_h"] = cold & fast
    out["high_voltage_hot_time_h"] = (v >= 4.1) & hot
    out["high_soc_hot_time_h"] = (q >= 80.0) & hot
    out["high_voltage_high_abs_current_time_h"] = (v >= 4.1) & fast
    out["high_soc_high_abs_current_time_h"] = (q >= 80.0) & fast
    return out


def dwell_sums(gaps: DataFrame, lim: DwellLimits = DwellLimits()) -> DataFrame:
    """Hours per state and gap counters; one hash aggregate."""
    dt, st = F.col("dt_h"), states(lim)
    small, big = lim.gap_counts_s
    hours = [F.coalesce(F.sum(F.when(c, dt)), F.lit(0.0)).alias(n) for n, c in st.items()]
    weighted = lambda s, v: S.safe_ratio(F.sum(F.when(st[s], v * dt)), F.sum(F.when(st[s], dt)))
    return gaps.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("stress_log_age_row_count"), *hours,
        weighted("charge_time_h", F.col("i_raw_A")).alias("mean_charge_current_A"),
        weighted("discharge_time_h", F.abs("i_raw_A")).alias("mean_discharge_current_A"),
        F.sum(dt).alias("stress_observed_duration_h"), F.max("raw_dt_s").alias("max_log_age_gap_s"),
        F.sum((F.col("raw_dt_s") > small).cast("long")).alias("log_age_gap_count_gt_60s"),
        F.sum((F.col("raw_dt_s") > big).cast("long")).alias("log_age_gap_count_gt_300s"))


def stress_runs(gaps: DataFrame, lim: DwellLimits = DwellLimits()) -> DataFrame:
    """Number of run starts and longest run per state.

    Runs are measured inside (interval, chunk); chunk summaries (leading run, trailing run,
    total) are then merged along the interval, so a run may cross any number of chunks.
    """
    st = states(lim)
    act = {r: F.coalesce(st[f"{r}_time_h"], F.lit(False)) for r in RUNS}
    local = W.partitionBy(*KEY, "_chunk").orderBy("timestamp_s")
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    d = gaps.withColumns({f"_a_{r}": c for r, c in act.items()})
    d = d.withColumn("_cum", F.sum("dt_h").over(upto))
    d = d.withColumns({f"_b_{r}": F.max(F.when(~F.col(f"_a_{r}"), F.col("_cum"))).over(upto) for r in RUNS})
    d = d.withColumns({f"_p_{r}": F.coalesce(F.lag(f"_a_{r}").over(local), F.lit(False)) for r in RUNS})
    aggs = [F.sum("dt_h").alias("total")]
    for r in RUNS:
        a, b = F.col(f"_a_{r}"), F.col(f"_b_{r}")
        run = F.when(a, F.col("_cum") - F.coalesce(b, F.lit(0.0))).otherwise(0.0)
        aggs += [F.max(run).alias(f"m_{r}"),
                 F.coalesce(F.max(F.when(b.isNull(), F.col("_cum"))), F.lit(0.0)).alias(f"lead_{r}"),
                 F.max_by(run, "timestamp_s").alias(f"trail_{r}"), F.every(a).alias(f"all_{r}"),
                 F.min_by(a, "timestamp_s").alias(f"first_{r}"), F.max_by(a, "timestamp_s").alias(f"last_{r}"),
                 F.sum((a & ~F.col(f"_p_{r}")).cast("long")).alias(f"n_{r}")]
    c = d.groupBy(*KEY, "_chunk").agg(*aggs)
    across = W.partitionBy(*KEY).orderBy("_chunk")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("_before", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    c = c.withColumns({f"_open_{r}": F.when(~F.col(f"all_{r}"), F.col("_before") + F.col("total") - F.col(f"trail_{r}"))
                       for r in RUNS})
    c = c.withColumns({f"_from_{r}": F.coalesce(F.max(f"_open_{r}").over(before), F.lit(0.0)) for r in RUNS})
    c = c.withColumns({f"_join_{r}": (F.col(f"first_{r}") & F.coalesce(F.lag(f"last_{r}").over(across), F.lit(False)))
                       .cast("long") for r in RUNS})
    fin = []
    for r in RUNS:
        joined = F.when(F.col(f"first_{r}"), F.col("_before") + F.col(f"lead_{r}") - F.col(f"_from_{r}")).otherwise(0.0)
        fin.append(F.max(F.greatest(F.col(f"m_{r}"), joined)).alias(f"max_{r}_event_h"))
        if r in ("charge", "discharge", "rest"):
            fin.append((F.sum(f"n_{r}") - F.sum(f"_join_{r}")).alias(f"n_{r}_events"))
    return c.groupBy(*KEY).agg(*fin)


def stress_table(intervals: DataFrame, log_in_interval: DataFrame, lim: DwellLimits = DwellLimits(),
                 cut=lambda df: df) -> DataFrame:
    """One row per interval: dwell, rates, coverage and runs (zeros where nothing was logged)."""
    gaps = cut(capped_gaps(log_in_interval, lim))
    sums, runs = dwell_sums(gaps, lim), stress_runs(gaps, lim)
    med = quantiles(gaps, KEY, "dt_s", {"median_log_age_dt_s": 0.5})
    out = (intervals.join(sums, KEY, "left").join(runs, KEY, "left").join(med, KEY, "left"))
    nullable = {"mean_charge_current_A", "mean_discharge_current_A", "median_log_age_dt_s"}
    fill = [c for c in sums.columns + runs.columns if c not in nullable and c not in KEY]
    out = out.fillna(0, fill)
    obs, dur = F.col("stress_observed_duration_h"), F.col("duration_h")
    return out.withColumns({
        "stress_duration_h": dur,
        "stress_coverage_fraction": F.least(F.lit(1.0), F.coalesce(S.safe_ratio(obs, dur), F.lit(0.0))),
        "high_voltage_time_h": F.col("time_voltage_ge_4p1_h"),
        "voltage_dwell_weighted_h": sum((F.col(n) * w for n, w in VOLTAGE_WEIGHTS.items()), F.lit(0.0)),
        "cold_time_h": F.col("time_temp_lt_5C_h") + F.col("time_temp_5_15C_h"),
        "hot_time_h": F.col("time_temp_ge_40C_h"), "high_soc_time_h": F.col("time_soc_ge_80_h"),
        "delta_capacity_per_day": S.safe_ratio(F.col("delta_capacity_Ah"), F.col("calendar_days")),
        "delta_capacity_per_efc": S.safe_ratio(F.col("delta_capacity_Ah"), F.col("log_age_efc_delta")),
        "delta_capacity_per_Ah_throughput": S.safe_ratio(F.col("delta_capacity_Ah"), F.col("log_age_delta_q_Ah")),
        "log_age_efc_per_day": S.safe_ratio(F.col("log_age_efc_delta"), F.col("calendar_days"))})


def stress_qa(stress: DataFrame, intervals: DataFrame, tolerance_h: float = 1e-6) -> DataFrame:
    """One row: interval keys without a stress row, and range / sum checks."""
    keys = ["cell_id", "checkup_k", "checkup_k_next"]
    missing = intervals.select(*keys).join(stress.select(*keys), keys, "left_anti").agg(
        F.count(F.lit(1)).alias("missing_intervals"))
    n = lambda c: F.sum(c.cast("long"))
    obs = F.col("stress_observed_duration_h")

    def off(bins):
        return n(F.abs(sum((F.col(b[0]) for b in bins), F.lit(0.0)) - obs) > tolerance_h)
    got = stress.agg(
        F.count(F.lit(1)).alias("rows"), off(VOLTAGE_BINS).alias("voltage_sum_mismatch"),
        off(TEMPERATURE_BINS).alias("temperature_sum_mismatch"), off(SOC_BINS).alias("soc_sum_mismatch"),
        n(F.abs(F.col("charge_time_h") + F.col("discharge_time_h") + F.col("rest_time_h") - obs) > tolerance_h)
        .alias("current_sum_mismatch"),
        n(~F.col("stress_coverage_fraction").between(0, 1)).alias("coverage_out_of_range"),
        n(obs > F.col("stress_duration_h") + tolerance_h).alias("observed_over_duration"))
    return got.crossJoin(missing)   # two one-row frames
