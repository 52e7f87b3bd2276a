"""Run events (gaps and islands) and order features per interval."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalar as S
from ..functions.ordered import attach, carry, quantiles

KEY = ["cell_id", "checkup_k"]
IDS = ["cell_id", "parameter_set", "replicate_id", "checkup_k", "checkup_k_next"]
TYPES = ["rest", "charge", "discharge", "unknown"]
#: Events of an interval that one task numbers or merges.
BLOCK = 4096
TRANSITIONS = [("charge", "rest"), ("rest", "charge"), ("discharge", "rest"), ("rest", "discharge")]


@dataclass(frozen=True)
class EventLimits:
    """Arguments of the event table (defaults: fixed values of the event policy)."""
    max_gap_s: float = 300.0
    rest_current_a: float = S.REST_CURRENT_A
    high_current_a: float = 4.5
    high_voltage_v: float = 4.1
    cold_c: float = 10.0
    hot_c: float = 35.0
    chunk_s: float = 86400.0


def run_events(log_in_interval: DataFrame, lim: EventLimits = EventLimits(), *, chunk: str | None = None,
               counted: bool = False) -> DataFrame:
    """One row per maximal run of one state without a long gap.

    Runs are numbered inside (interval, chunk) and folded there.  One narrow row per chunk, its first and last
    sample and its number of runs, crosses chunk borders and gives the running number; the folded rows
    are shuffled once, to merge runs that cross a border.

    ``chunk`` names a column of ``range_join`` that holds floor(timestamp_s / lim.chunk_s): windows, folds and the
    chunk rows then share the join's exchange.  ``counted`` adds ``event_count``, the interval's events.
    """
    at = "_chunk"
    d = log_in_interval.withColumn(at, F.floor(F.col("timestamp_s") / lim.chunk_s) if chunk is None else F.col(chunk))
    d = d.withColumn("_state", S.current_state(F.col("i_raw_A"), lim.rest_current_a))
    w = W.partitionBy("cell_id", at, "checkup_k").orderBy("timestamp_s", "seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({"_rn": F.row_number().over(w), "_place": F.rank().over(w), "_pt": F.lag("timestamp_s").over(w), "_ps": F.lag("_state").over(w),
                       "_nt": F.lead("timestamp_s").over(w), "_last": F.lead(F.lit(1)).over(w).isNull(),
                       "_first_t": F.first("timestamp_s").over(upto), "_first_state": F.first("_state").over(upto)})
    d = d.withColumn("_gap", F.when(F.col("_rn") > 1, F.coalesce(F.col("timestamp_s") - F.col("_pt"), F.lit(0.0))))
    new = F.col("_pt").isNull() | (F.col("_ps") != F.col("_state")) | (F.col("_gap") > lim.max_gap_s)
    d = d.withColumn("_local", F.sum(F.when((F.col("_rn") > 1) & new, 1).otherwise(0)).over(upto))

    # the last sample of a chunk knows its first one and the number of runs that start after that
    across = W.partitionBy("cell_id", "checkup_k").orderBy(at)
    ends = d.where("_last").select("cell_id", "checkup_k", at, "_first_t", "_first_state", F.col("timestamp_s").alias("_last_t"),
                                   F.col("_state").alias("_last_state"), F.col("_local").alias("_more"))
    ends = ends.withColumns({"_bt": F.lag("_last_t").over(across), "_bs": F.lag("_last_state").over(across),
                             "_exit_gap": F.lead("_first_t").over(across) - F.col("_last_t")})
    ends = ends.withColumn("_first_gap", F.coalesce(F.col("_first_t") - F.col("_bt"), F.lit(0.0)))
    starts = F.when(F.col("_bt").isNull() | (F.col("_bs") != F.col("_first_state")) | (F.col("_first_gap") > lim.max_gap_s), 1).otherwise(0)
    ends = ends.withColumn("_starts", starts)
    total = F.sum(F.col("_starts") + F.col("_more"))
    ends = ends.select("cell_id", "checkup_k", at, "_first_gap", "_exit_gap", "_more", (total.over(across) - F.col("_more")).alias("_base"),
                       *[total.over(W.partitionBy("cell_id", "checkup_k")).alias("event_count")] * counted)

    sums = {}
    for src, name in (("v_raw_V", "v"), ("i_raw_A", "i"), ("t_cell_degC", "t"), ("soc_est", "q")):
        x = S.finite(F.col(src))
        sums |= {f"{name}_sum": F.sum(x), f"{name}_n": F.count(x), f"{name}_min": F.min(x), f"{name}_max": F.max(x)}
    ai = F.abs(S.finite(F.col("i_raw_A")))
    sums |= {"ai_sum": F.sum(ai), "ai_max": F.max(ai)}
    for src, name in (("delta_q_Ah", "dq"), ("EFC", "efc")):
        x = S.finite(F.col(src))
        # of samples with equal time and number the first one stands for both ends
        last = F.col("_place").cast("long") * 2**31 - F.col("_rn")
        sums |= {f"{name}_a": F.min_by(x, F.when(x.isNotNull(), F.col("_rn"))), f"{name}_b": F.max_by(x, F.when(x.isNotNull(), last))}
    # fixed-width buffers, and the state as a key, keep both folds in hash aggregates
    part = d.groupBy("cell_id", at, "checkup_k", *[c for c in IDS if c not in KEY], "_local", F.col("_state").alias("event_type")).agg(
        F.min("timestamp_s").alias("s"), F.max("timestamp_s").alias("e"), F.max("_gap").alias("gap"),
        F.max_by(F.col("_nt") - F.col("timestamp_s"), "_rn").alias("exit"), F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in sums.items()])
    if chunk is None:
        part = attach(part, ends, ["cell_id", at, "checkup_k"])
    else:                                    # keys of a range join are never null; equality on two of them keeps its partitions
        right = ends.withColumnsRenamed({"cell_id": "_cell", at: "_at", "checkup_k": "_k"})
        same = (F.col("checkup_k") >= F.col("_k")) & (F.col("checkup_k") <= F.col("_k"))
        part = part.join(right, (F.col("cell_id") == F.col("_cell")) & (F.col(at) == F.col("_at")) & same).drop("_cell", "_at", "_k")
    part = part.withColumns({
        "_id": F.col("_base") + F.col("_local"), "gap": F.greatest("gap", F.when(F.col("_local") == 0, F.col("_first_gap"))),
        "exit": F.when(F.col("_local") == F.col("_more"), F.col("_exit_gap")).otherwise(F.col("exit"))})
    # folded rows of an interval lie together, in blocks of a bounded number of events, so that later folds by interval find few keys a task
    part = part.withColumn("_block", F.floor(F.col("_id") / BLOCK)).repartition(*KEY, "_block")
    merged = part.groupBy(*IDS, "_block", "_id", "event_type").agg(
        F.min("s").alias("event_start_s"), F.max("e").alias("event_end_s"), F.max("gap").alias("max_gap_s"),
        F.max_by("exit", at).alias("_next_gap"), F.sum("rows").alias("source_rows"),
        *[F.sum(c).alias(c) for c in ("v_sum", "v_n", "i_sum", "i_n", "t_sum", "t_n", "q_sum", "q_n", "ai_sum")],
        *[F.min(f"{n}_min").alias(f"{n}_min") for n in "vtq"], *[F.max(f"{n}_max").alias(f"{n}_max") for n in "vtq"],
        F.max("ai_max").alias("ai_max"),
        *[F.min_by(f"{n}_a", F.when(F.col(f"{n}_a").isNotNull(), F.col(at))).alias(f"{n}_a") for n in ("dq", "efc")],
        *[F.max_by(f"{n}_b", F.when(F.col(f"{n}_b").isNotNull(), F.col(at))).alias(f"{n}_b") for n in ("dq", "efc")],
        *[F.max("event_count").alias("event_count")] * counted)
    return _finish_events(merged, lim, ["event_count"] * counted)


def _finish_events(m: DataFrame, lim: EventLimits, extra=()) -> DataFrame:
    dur = F.greatest(F.lit(0.0), F.col("event_end_s") - F.col("event_start_s"))
    mean = lambda n: F.when(F.col(f"{n}_n") > 0, F.col(f"{n}_sum") / F.col(f"{n}_n"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    hv, cold = yes(F.col("v_max") >= lim.high_voltage_v), yes(F.col("t_min") <= lim.cold_c)
    fast = yes(F.col("ai_max") >= lim.high_current_a)
    return m.select(
        *IDS, (F.col("_id") - 1).cast("int").alias("event_index"), "event_type", "event_start_s", "event_end_s",
        dur.alias("event_duration_s"), (dur / 3600.0).alias("event_duration_h"),
        mean("v").alias("mean_voltage_V"), F.col("v_min").alias("min_voltage_V"), F.col("v_max").alias("max_voltage_V"),
        mean("i").alias("mean_current_A"),
        F.when(F.col("i_n") > 0, F.col("ai_sum") / F.col("i_n")).alias("mean_abs_current_A"),
        F.col("ai_max").alias("max_abs_current_A"), mean("t").alias("mean_temperature_C"),
        F.col("t_max").alias("max_temperature_C"), mean("q").alias("mean_soc"),
        F.col("q_min").alias("min_soc"), F.col("q_max").alias("max_soc"),
        (F.col("dq_b") - F.col("dq_a")).alias("delta_q_Ah"), (F.col("efc_b") - F.col("efc_a")).alias("delta_EFC"),
        hv.alias("high_voltage_event"), cold.alias("cold_event"), yes(F.col("t_max") >= lim.hot_c).alias("hot_event"),
        fast.alias("high_abs_current_event"), (cold & fast).alias("cold_high_current_event"),
        (hv & fast).alias("high_voltage_high_current_event"), "source_rows", "max_gap_s",
        F.concat_ws(";", F.when(F.col("_next_gap") > lim.max_gap_s, "gap_gt_300s"),
                    F.when(dur <= 0, "zero_duration")).alias("quality_flags"), *extra)


def with_event_count(events: DataFrame) -> DataFrame:
    """``event_count``, the events of the interval; taken as it is if the table already has it."""
    if "event_count" in events.columns:
        return events
    return events.join(events.groupBy(*KEY).agg(F.count(F.lit(1)).alias("event_count")), KEY)


def order_features(events: DataFrame, index: str = "event_index", block: int = BLOCK,
                   cut=lambda df: df) -> DataFrame:
    """Transitions, thirds exposure and bursts of one event order per interval."""
    d = with_event_count(events).withColumnRenamed("event_count", "n").withColumn("_chunk", F.floor(F.col(index) / block))
    high, cold = F.col("high_abs_current_event"), F.col("cold_high_current_event")
    d = carry(d, KEY, "_chunk", [index], prev={"_pt": "event_type"},
              sums={"_gh": (~high).cast("long"), "_gc": (~cold).cast("long")})
    d = cut(d.select(*KEY, index, "n", "_pt", "_gh", "_gc", "event_type", "event_duration_h",
                     "high_abs_current_event", "cold_high_current_event"))
    pos = F.col(index) / F.greatest(F.lit(1), F.col("n") - 1)
    third = F.least(F.lit(2), F.floor(F.col(index) * 3 / F.col("n")))
    hours = F.col("event_duration_h")
    total = F.sum(F.when(high, hours))
    share = lambda i: F.when(total > 0, F.coalesce(F.sum(F.when(high & (third == i), hours)), F.lit(0.0))
                             / total).otherwise(0.0)
    base = d.groupBy(*KEY).agg(
        *[F.sum(((F.col("_pt") == a) & (F.col("event_type") == b)).cast("long")).alias(f"transition_{a}_{b}")
          for a, b in TRANSITIONS],
        F.sum((F.col("_pt") != F.col("event_type")).cast("long")).alias("alternation_count"),
        F.min(F.when(high, pos)).alias("first_high_current_position"),
        F.max(F.when(high, pos)).alias("last_high_current_position"),
        share(0).alias("early_high_current_fraction"), share(1).alias("mid_high_current_fraction"),
        share(2).alias("late_high_current_fraction"))
    for flag, grp, out in ((high, "_gh", "longest_high_current_burst_h"),
                           (cold, "_gc", "longest_cold_high_current_burst_h")):
        burst = (d.filter(flag).groupBy(*KEY, grp).agg(F.sum(hours).alias("h"))
                 .groupBy(*KEY).agg(F.max("h").alias(out)))
        base = base.join(burst, KEY, "left")
    counts = [c for c in base.columns if c.startswith(("transition", "alternation", "longest"))]
    return base.fillna(0, counts)


def sequence_features(events: DataFrame, intervals: DataFrame, seed: int = 42, block: int = BLOCK,
                      cut=lambda df: df) -> DataFrame:
    """Counts, durations, order features and shuffled-order controls per interval."""
    hours, typ = F.col("event_duration_h"), F.col("event_type")
    n = lambda c: F.sum(c.cast("long"))
    sums = events.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("sequence_event_count"), F.sum(hours).alias("sequence_total_event_duration_h"),
        *[n(typ == t).alias(f"sequence_{t}_event_count") for t in TYPES],
        *[F.sum(F.when(typ == t, hours)).alias(f"sequence_{t}_duration_h") for t in TYPES[:3]],
        *[F.max(F.when(typ == t, hours)).alias(f"sequence_max_{t}_duration_h") for t in TYPES[:3]],
        n(F.col("high_abs_current_event")).alias("sequence_high_current_event_count"),
        n(F.col("cold_high_current_event")).alias("sequence_cold_high_current_event_count"),
        n(F.col("high_voltage_high_current_event")).alias("sequence_high_voltage_high_current_event_count"))
    true = order_features(events, block=block, cut=cut)
    true = true.select(*KEY, *[F.col(c).alias(f"sequence_{c}") for c in true.columns if c not in KEY])
    sh = order_features(shuffled_index(events, seed), "shuffled_index", block, cut)
    keep = [c for c in sh.columns if c.startswith(("transition", "alternation", "early", "mid", "late"))]
    sh = sh.select(*KEY, *[F.col(c).alias(f"sequence_shuffled_{c}") for c in keep])
    out = intervals.select(*IDS).join(sums, KEY, "left").join(true, KEY, "left").join(sh, KEY, "left")
    nullable = {"sequence_first_high_current_position", "sequence_last_high_current_position"}
    fill = [c for c in out.columns if c.startswith("sequence_") and c not in nullable]
    return out.fillna(0, fill).withColumns({
        "sequence_shuffle_seed": F.lit(seed),
        "sequence_quality_flags": F.when(F.col("sequence_event_count") == 0, "missing_events").otherwise("")})


def shuffled_index(events: DataFrame, seed: int = 42) -> DataFrame:
    """``shuffled_index``: position of the event in a seeded hash order of its interval."""
    from .splits import hash_int
    h = hash_int(F.lit(str(seed)), F.col("cell_id"), F.col("checkup_k").cast("string"),
                 F.col("event_index").cast("string"))
    d = events.withColumn("_h", h).withColumn("_chunk", F.shiftright("_h", 38))
    d = carry(d, KEY, "_chunk", ["_h", "event_index"], sums_before={"shuffled_index": F.lit(1)})
    return d.withColumn("shuffled_index", F.col("shuffled_index").cast("int")).drop("_h", "_chunk")


def event_qa(events: DataFrame, intervals: DataFrame, warn_h: float = 24.0) -> DataFrame:
    """One row: coverage, long events and gap summary of the event table."""
    got = events.agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.array_contains(F.split("quality_flags", ";"), "zero_duration")
                                                .cast("long")).alias("zero_duration_events"),
        F.sum((F.col("event_duration_h") > warn_h).cast("long")).alias("long_events"),
        F.max("max_gap_s").alias("max_gap_s"), F.sum("source_rows").alias("source_rows"))
    cover = intervals.select(*KEY).distinct().join(events.select(*KEY).distinct(), KEY, "left_anti").agg(
        F.count(F.lit(1)).alias("intervals_without_events"))
    per = events.groupBy(*KEY).agg(F.count(F.lit(1)).cast("double").alias("c"))
    med = quantiles(per, [], "c", {"median_events_per_interval": 0.5, "max_events_per_interval": 1.0})
    return got.crossJoin(cover).crossJoin(med)   # one-row frames


def event_duration_gaps(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Interval duration minus the sum of event durations."""
    s = events.groupBy(*KEY).agg(F.sum("event_duration_h").alias("event_h"))
    j = intervals.join(s, KEY, "left").fillna(0.0, ["event_h"])
    return j.select(*KEY, "duration_h", "event_h", (F.col("duration_h") - F.col("event_h")).alias("uncovered_h"))


def sequence_qa(features: DataFrame) -> DataFrame:
    nums = [c for c, t in features.dtypes if c.startswith("sequence_") and t in ("int", "bigint", "double")]
    neg = sum((F.coalesce(F.col(c) < 0, F.lit(False)).cast("long") for c in nums), F.lit(0))
    return features.agg(F.count(F.lit(1)).alias("rows"),
                        F.sum((F.col("sequence_quality_flags") == "missing_events").cast("long")).alias("missing_events"),
                        F.sum(neg).alias("negative_values"))
