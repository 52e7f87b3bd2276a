"""Knee detectors, threshold events and warning labels on trajectories."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalar as S
from ..functions.ordered import attach, carry, halo, quantiles
from .splits import is_heldout, stack_splits
from .trajectories import FOLDS, META, trajectory_flags

# ---- fixed values: names of axes, detectors and thresholds ----
AXES = {"checkup_index": "k", "calendar_days": "calendar_days_since", "log_age_efc_cumulative": "cum_efc"}
SMOOTHING = ["none", "rolling_3"]
TWO_LINE = ["piecewise_linear_bic", "two_line_l_method"]
THRESHOLDS = [0.8, 0.7, 0.6]
PRIMARY = {"detector_name": "piecewise_linear_bic", "x_axis": "checkup_index", "smoothing_policy": "none"}
SEVERE = ["few_checkups", "duplicate_checkups", "capacity_increase_gt_0p02Ah"]
SERIES = ["cell_id", "x_axis", "smoothing_policy"]
WEAK_RATIO = 1.25
X_EPS = 1e-9   # summed axes carry rounding noise: closer points are one x value
TARGETS = {"event_within_1_checkup": 1, "event_within_2_checkups": 2, "event_within_3_checkups": 3}


def smoothed(points: DataFrame) -> DataFrame:
    """Capacity and SOH after a centred mean of three; the two end points stay."""
    d, part = halo(points, ["cell_id"], "idx", 1, 1)
    w = W.partitionBy(*part).orderBy("idx").rowsBetween(-1, 1)
    inner = F.count(F.lit(1)).over(w) == 3
    out = {f"{c}_smooth": F.when(inner, F.avg(c).over(w)).otherwise(F.col(c)) for c in ("capacity_Ah", "soh")}
    return d.withColumns(out).filter("_own").drop("_own", "_chunk")


def _beside(points: DataFrame) -> DataFrame:
    """One narrow row per point: x of every axis, y and s of every smoothing, x and y of the points before and after."""
    d, part = halo(points.select("cell_id", "idx", "k", *[F.col(c).cast("double").alias(f"x_{a}") for a, c in AXES.items()],
                                 F.col("capacity_Ah").alias("y_none"), F.col("soh").alias("s_none")), ["cell_id"], "idx", 2, 2)
    line = W.partitionBy(*part).orderBy("idx")
    near = line.rowsBetween(-1, 1)
    inner = F.count(F.lit(1)).over(near) == 3
    d = d.withColumns({f"{c}_rolling_3": F.when(inner, F.avg(f"{c}_none").over(near)).otherwise(F.col(f"{c}_none")) for c in "ys"})
    values = [*[f"x_{a}" for a in AXES], *[f"y_{m}" for m in SMOOTHING]]
    d = d.withColumns({**{f"p{v}": F.lag(v).over(line) for v in values}, **{f"n{v}": F.lead(v).over(line) for v in values}})
    return d.filter("_own").drop("_own", "_chunk")


def _sums(points: DataFrame, block: int) -> DataFrame:
    """Prefix and suffix sums of the regression moments and counts of distinct x, one row per point for all series.

    Prefix moments are taken about the first point and suffix moments about the last one, so
    short ends of a long axis lose no digits to a far-away centre.  Both run over one exchange, and
    moments that several series share are summed once.
    """
    values = [*[f"x_{a}" for a in AXES], *[f"y_{m}" for m in SMOOTHING]]
    d = _beside(points)
    ends = d.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), *[F.min_by(v, "idx").alias(f"{v}0") for v in values],
                                    *[F.max_by(v, "idx").alias(f"{v}1") for v in values])
    d = d.join(ends, "cell_id").withColumn("_chunk", F.floor(F.col("idx") / block))
    d = d.withColumns({f"new_{a}": (F.col(f"px_{a}").isNull() | (F.abs(F.col(f"px_{a}") - F.col(f"x_{a}")) > X_EPS)).cast("long") for a in AXES})

    def moments(p: str, at: str) -> dict[str, Column]:
        u = {a: F.col(f"x_{a}") - F.col(f"x_{a}{at}") for a in AXES}
        v = {m: F.col(f"y_{m}") - F.col(f"y_{m}{at}") for m in SMOOTHING}
        return {f"{p}c": F.lit(1.0), **{f"{p}su_{a}": u[a] for a in AXES}, **{f"{p}suu_{a}": u[a] * u[a] for a in AXES},
                **{f"{p}sv_{m}": v[m] for m in SMOOTHING}, **{f"{p}svv_{m}": v[m] * v[m] for m in SMOOTHING},
                **{f"{p}suv_{a}_{m}": u[a] * v[m] for a in AXES for m in SMOOTHING}}
    d = carry(d, ["cell_id"], "_chunk", ["idx"], sums={**moments("", "0"), **{f"dx_{a}": f"new_{a}" for a in AXES}},
              sums_after=moments("r", "1"), totals={f"distinct_{a}": f"new_{a}" for a in AXES})
    # distinct values from here on: the runs that start later, plus the one in progress
    return d.withColumns({f"{p}_{a}": F.when(F.col(f"new_{a}").isNotNull(), v) for a in AXES for p, v in (
        ("dr", F.col(f"distinct_{a}") - F.col(f"dx_{a}") + 1), ("dx", F.col(f"dx_{a}")))})


def _fit(c, su, sv, suu, suv, svv, distinct) -> tuple[Column, Column]:
    """Slope and squared error of a least-squares line from raw moments."""
    sxx, sxy, syy = suu - su * su / c, suv - su * sv / c, svv - sv * sv / c
    ok = (c >= 2) & (distinct >= 2) & (sxx > 0)
    return F.when(ok, sxy / sxx), F.when(ok, F.greatest(F.lit(0.0), syy - sxy * sxy / sxx)).otherwise(F.lit(float("inf")))


def line_fits(points: DataFrame, block: int = 64) -> DataFrame:
    """Per series and point: slope and error of the line up to it and of the line from it."""
    C = F.col
    combos = []
    for a in AXES:
        for m in SMOOTHING:
            side = lambda p, dist: _fit(*[C(f"{p}{c}") for c in ("c", f"su_{a}", f"sv_{m}", f"suu_{a}", f"suv_{a}_{m}", f"svv_{m}")], C(f"{dist}_{a}"))  # noqa: B023, E731
            pre, post = side("", "dx"), side("r", "dr")
            combos.append(F.struct(
                F.lit(a).alias("x_axis"), F.lit(m).alias("smoothing_policy"), C(f"distinct_{a}").alias("distinct_x"),
                *[C(f"{p}x_{a}").alias(f"{p}x") for p in ("", "p", "n")], *[C(f"{p}y_{m}").alias(f"{p}y") for p in ("", "p", "n")], C(f"s_{m}").alias("s"),
                *[C(f"x_{a}{i}").alias(f"x{i}") for i in (0, 1)], *[C(f"y_{m}{i}").alias(f"y{i}") for i in (0, 1)],
                pre[0].alias("pre_slope"), pre[1].alias("pre_sse"), post[0].alias("post_slope"), post[1].alias("post_sse")))
    return _sums(points, block).select("cell_id", "idx", "k", "n", F.explode(F.array(*combos)).alias("z")).select("cell_id", "idx", "k", "n", "z.*")


def knee_candidates(points: DataFrame, block: int = 64) -> DataFrame:
    """The detector grid: 3 axes x 2 smoothings x 7 detectors per cell."""
    fits = line_fits(points, block)
    C = F.col
    row = F.struct("k", "idx", "x", "y", "s", "pre_slope", "post_slope")
    tie = lambda v: F.round(v, 9)  # noqa: E731  equal scores go to the first point
    sse = C("pre_sse") + C("post_sse")
    inside = (C("idx") >= 2) & (C("idx") <= C("n") - 3)
    two = F.when(inside & (sse < float("inf")), F.struct(tie(sse), "idx"))
    span_x, span_y = C("x1") - C("x0"), C("y1") - C("y0")
    chord = F.abs(span_y * C("x") - span_x * C("y") + C("x1") * C("y0") - C("y1") * C("x0"))
    span = F.sqrt(span_x * span_x + span_y * span_y)
    far = F.when(span > 0, F.struct((-tie(F.try_divide(chord, span))).alias("d"), "idx"))
    s_in = F.when(F.abs(C("x") - C("px")) > 1e-12, (C("y") - C("py")) / (C("x") - C("px")))
    s_out = F.when(F.abs(C("nx") - C("x")) > 1e-12, (C("ny") - C("y")) / (C("nx") - C("x")))
    change = F.abs(s_out - s_in)
    bend = F.when(change.isNotNull(), F.struct((-tie(change)).alias("d"), "idx"))
    g = fits.groupBy(*SERIES).agg(
        F.first("n").alias("n"), F.first("distinct_x").alias("distinct_x"),
        F.min_by(row, two).alias("two"), F.min_by(row, far).alias("far"), F.min_by(row, bend).alias("bend"),
        F.count(s_in).alias("slopes"), F.max(F.greatest(F.abs(span_x), F.abs(span_y))).alias("span"),
        *[F.min_by(row, F.when(C("s") <= f, C("idx"))).alias(f"cross{int(round(f * 100))}") for f in THRESHOLDS])
    none = F.lit(None).cast("struct<k:int,idx:int,x:double,y:double,s:double,pre_slope:double,post_slope:double>")
    few = C("n") < 5
    edge = (C("far.idx") == 0) | (C("far.idx") == C("n") - 1)
    ratio = F.abs(C("bend.post_slope")) / F.greatest(F.abs(C("bend.pre_slope")), F.lit(1e-12))
    short2 = (C("n") < 6) | (C("distinct_x") < 5)
    arms = []

    def arm(name, hit, flag):
        hit = F.when(~few & flag[1], hit).otherwise(none)
        arms.append(F.struct(F.lit(name).alias("detector_name"), hit.alias("hit"),
                             F.when(few, "too_few_points").otherwise(flag[0]).alias("flag")))
    for name in TWO_LINE:
        arm(name, C("two"), (F.when(short2, "too_few_unique_points").when(C("two").isNull(), "no_valid_split").otherwise(""),
                             ~short2))
    arm("max_chord_distance", C("far"), (F.when(C("span") <= 0, "degenerate_chord").when(edge, "edge_knee").otherwise(""),
                                         (C("span") > 0) & ~edge))
    arm("slope_change_threshold", C("bend"), (F.when(C("slopes") < 4, "too_few_slopes").when(C("bend").isNull(), "no_slope_change")
                                              .when(ratio < WEAK_RATIO, "weak_slope_change").otherwise(""), C("slopes") >= 4))
    for f in THRESHOLDS:
        pct = int(round(f * 100))
        c = C(f"cross{pct}")
        arm(f"capacity_threshold_{pct}", c, (F.when(c.isNull(), "threshold_not_reached").otherwise("threshold_reference"), c.isNotNull()))
    g = g.select(*SERIES, F.explode(F.array(*arms)).alias("a"))
    meta = trajectory_flags(points)
    hit = lambda c: C(f"a.hit.{c}")
    return g.join(meta, "cell_id").select(
        *SERIES, "parameter_set", "replicate_id", *META, "a.detector_name", hit("k").alias("knee_checkup_k"), hit("x").alias("knee_x_value"),
        hit("y").alias("knee_capacity_Ah"), hit("s").alias("knee_soh"), hit("pre_slope").alias("pre_knee_slope"),
        hit("post_slope").alias("post_knee_slope"),
        (F.abs(hit("post_slope")) / F.greatest(F.abs(hit("pre_slope")), F.lit(1e-12))).alias("slope_change_ratio"),
        F.concat_ws(";", F.when(C("trajectory_flags") != "", C("trajectory_flags")), F.when(C("a.flag") != "", C("a.flag")))
        .alias("detector_quality_flags"))


def primary(candidates: DataFrame) -> DataFrame:
    return candidates.filter(S.all_of([F.col(c) == v for c, v in PRIMARY.items()]))


GRID = ["detector_name", "x_axis", "smoothing_policy"]


def detector_agreement(candidates: DataFrame) -> DataFrame:
    """Differences between detectors on one series (seven detectors, so 21 pairs at most)."""
    d = candidates.filter("knee_checkup_k IS NOT NULL")
    a = d.select(*SERIES, F.col("detector_name").alias("detector_a"), F.col("knee_checkup_k").alias("ka"))
    b = d.select(*SERIES, F.col("detector_name").alias("detector_b"), F.col("knee_checkup_k").alias("kb"))
    p = a.join(b, SERIES).filter("detector_a < detector_b").withColumn("diff", F.abs(F.col("ka") - F.col("kb")).cast("double"))
    keys = ["x_axis", "smoothing_policy", "detector_a", "detector_b"]
    within = lambda n: F.avg((F.col("diff") <= n).cast("double"))
    g = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), within(1).alias("agreement_within_1_checkup"),
                             within(2).alias("agreement_within_2_checkups"), F.avg("diff").alias("mean_abs_disagreement_checkups"))
    return attach(g, quantiles(p, keys, "diff", {"median_abs_disagreement_checkups": 0.5}), keys)


def label_stability(candidates: DataFrame) -> DataFrame:
    """Coverage of the grid and how far labels move with the axis and with smoothing."""
    has = F.col("knee_checkup_k").isNotNull()
    prim = S.all_of([F.col(c) == v for c, v in PRIMARY.items()])
    n = lambda c: F.sum(c.cast("long"))
    cover = candidates.agg(F.count(F.lit(1)).alias("candidate_rows"), n(has).alias("valid_candidate_rows"),
                           n(prim).alias("primary_rows"), n(prim & has).alias("primary_valid_rows"))
    for vary, name in (("x_axis", "axis"), ("smoothing_policy", "smoothing")):
        keys = [c for c in ("cell_id", *GRID) if c != vary]
        d = (candidates.filter(has).groupBy(*keys).agg(F.count(F.lit(1)).alias("m"),
             (F.max("knee_checkup_k") - F.min("knee_checkup_k")).cast("double").alias("d")).filter("m >= 2"))
        s = d.agg(F.count(F.lit(1)).alias(f"{name}_comparisons"), F.avg("d").alias(f"{name}_mean_disagreement"),
                  F.avg((F.col("d") <= 2).cast("double")).alias(f"{name}_within_2"))
        cover = cover.crossJoin(s)   # one-row frames
    return cover


def _spread(df: DataFrame, keys, extra=()) -> DataFrame:
    d = df.withColumn("_k", F.col("knee_checkup_k").cast("double"))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.count("_k").alias("n_valid_knees"),
                             (F.max("_k") - F.min("_k")).alias("spread"), *extra)
    return attach(g, quantiles(d, keys, "_k", {"median_knee_checkup_k": 0.5}), keys)


def knee_by_condition(candidates: DataFrame) -> DataFrame:
    meta = [c for c in META if c != "nominal_discharge_C_rate"]
    return _spread(candidates, ["parameter_set", *GRID], [F.min_by(c, "cell_id").alias(c) for c in meta]).withColumnRenamed(
        "spread", "knee_checkup_spread")


def replicate_consistency(candidates: DataFrame) -> DataFrame:
    g = candidates.groupBy("parameter_set", *GRID).agg(
        F.countDistinct("cell_id").alias("n_replicates"), F.count("knee_checkup_k").alias("n_valid_knees"),
        (F.max("knee_checkup_k") - F.min("knee_checkup_k")).cast("double").alias("knee_spread_checkups"))
    return g.withColumn("replicate_consistent_within_2_checkups", F.coalesce(F.col("knee_spread_checkups") <= 2, F.lit(False)))


def _flag_set() -> Column:
    """Distinct flags of a group: the flag vocabulary is fixed, so the set stays small."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split("detector_quality_flags", ";"), lambda x: x != "")))))


def stable_registry(candidates: DataFrame) -> DataFrame:
    g = _spread(primary(candidates), ["parameter_set"], [
        F.countDistinct("cell_id").alias("n_replicates"), _flag_set().alias("flags"), *[F.min_by(c, "cell_id").alias(c) for c in META]])
    severe = F.arrays_overlap("flags", F.array(*[F.lit(f) for f in SEVERE]))
    n = F.col("n_valid_knees")
    return g.withColumn("has_severe_qa_flags", severe).withColumns({
        "stability_status": F.when(n < 2, "insufficient_label").when((F.col("spread") <= 2) & ~F.col("has_severe_qa_flags"), "stable")
        .otherwise("unstable"),
        "quality_flags": F.when(F.size("flags") > 0, F.concat_ws(";", "flags")).otherwise("none")}).withColumnRenamed(
        "spread", "knee_spread_checkups").drop("flags")


def stable_coverage(registry: DataFrame) -> DataFrame:
    """Counts by five condition fields in one grouping-sets pass."""
    fields = ["aging_mode", "nominal_temperature_C", "nominal_charge_C_rate", "voltage_window_family", "profile_label"]
    d = registry.select("stability_status", *[F.col(f).cast("string").alias(f) for f in fields])
    n = lambda s: F.sum((F.col("stability_status") == s).cast("long"))
    g = d.groupingSets([[f] for f in fields], *fields).agg(
        F.count(F.lit(1)).alias("n_conditions"), n("stable").alias("stable_conditions"), n("unstable").alias("unstable_conditions"),
        n("insufficient_label").alias("insufficient_label_conditions"), *[F.grouping(f).alias(f"_g_{f}") for f in fields])
    name = F.coalesce(*[F.when(F.col(f"_g_{f}") == 0, f) for f in fields])
    return g.select(name.alias("group_field"), F.coalesce(*fields).alias("group_value"), "n_conditions", "stable_conditions",
                    "unstable_conditions", "insufficient_label_conditions",
                    (F.col("stable_conditions") / F.col("n_conditions")).alias("stable_fraction"))


def knee_inconsistent(candidates: DataFrame, points: DataFrame) -> DataFrame:
    """Conditions whose replicates disagree by more than two check-ups, with day and EFC spread."""
    p = primary(candidates).filter("knee_checkup_k IS NOT NULL")
    at = points.select("cell_id", F.col("k").alias("knee_checkup_k"), F.col("calendar_days_since").alias("day"), F.col("cum_efc").alias("efc"))
    j = p.join(at, ["cell_id", "knee_checkup_k"], "left")
    g = j.groupBy("parameter_set").agg(
        F.count(F.lit(1)).alias("n"), (F.max("knee_checkup_k") - F.min("knee_checkup_k")).alias("knee_spread_checkups"),
        (F.max("day") - F.min("day")).alias("knee_spread_days"), (F.max("efc") - F.min("efc")).alias("knee_spread_efc"),
        _flag_set().alias("flags"))
    pick = lambda inside: F.filter("flags", lambda x: x.isin(*SEVERE) if inside else ~x.isin(*SEVERE))
    text = lambda a: F.when(F.size(a) > 0, F.concat_ws(";", a)).otherwise("none")
    return g.filter("n >= 2 AND knee_spread_checkups > 2").select(
        "parameter_set", "n", "knee_spread_checkups", "knee_spread_days", "knee_spread_efc",
        text(pick(True)).alias("trajectory_qa_flags"), text(pick(False)).alias("detector_quality_flags"))


def knee_risk(candidates: DataFrame, intervals: DataFrame) -> DataFrame:
    p = primary(candidates).select("cell_id", "knee_checkup_k", "detector_quality_flags")
    left = F.col("knee_checkup_k") - F.col("checkup_k")
    within = lambda h: F.coalesce((left > 0) & (left <= h), F.lit(False))
    return intervals.join(p, "cell_id", "left").select(
        "cell_id", "parameter_set", "replicate_id", "checkup_k", "checkup_k_next", within(1).alias("knee_within_1_checkup"),
        within(2).alias("knee_within_2_checkups"), within(3).alias("knee_within_3_checkups"), left.alias("time_to_knee_checkups"),
        F.concat(F.lit("exploratory;"), F.coalesce("detector_quality_flags", F.lit("missing_primary_candidate"))).alias("knee_label_quality"))


# ---- thresholds ----
def threshold_events(points: DataFrame) -> DataFrame:
    """First check-up at or below each SOH threshold, long, NULL where not reached."""
    hit = F.struct("k", "calendar_days_since", "cum_efc")
    g = points.groupBy("cell_id", "parameter_set").agg(
        *[F.min_by(hit, F.when(F.col("soh") <= f, F.col("k"))).alias(f"h{i}") for i, f in enumerate(THRESHOLDS)])
    arms = []
    for i, f in enumerate(THRESHOLDS):
        pct = int(round(f * 100))
        for label in (f"soh_below_{pct}", f"capacity_below_{pct}pct_initial"):
            arms.append(F.struct(F.lit(label).alias("threshold_label"), F.lit(f).alias("threshold_fraction"),
                                 F.col(f"h{i}.k").alias("threshold_event_checkup_k"),
                                 F.col(f"h{i}.calendar_days_since").alias("threshold_event_days"),
                                 F.col(f"h{i}.cum_efc").alias("threshold_event_efc")))
    g = g.select("cell_id", "parameter_set", F.explode(F.array(*arms)).alias("a")).select("cell_id", "parameter_set", "a.*")
    flags = trajectory_flags(points).select("cell_id", F.when(F.col("trajectory_flags") == "", "none").otherwise(
        F.col("trajectory_flags")).alias("target_quality_flags"))
    return g.join(flags, "cell_id")


def threshold_labels(intervals: DataFrame, points: DataFrame) -> DataFrame:
    ev = threshold_events(points).drop("parameter_set")
    zero = points.filter("idx = 0").select("cell_id", F.col("t_s").alias("_z"))
    left = F.col("threshold_event_checkup_k") - F.col("checkup_k")
    within = lambda h: F.coalesce((left > 0) & (left <= h), F.lit(False))
    d = intervals.select("cell_id", "parameter_set", "replicate_id", "checkup_k", "checkup_k_next", "t_result_k_s").join(zero, "cell_id")
    return d.join(ev, "cell_id").withColumns({
        "time_to_event_checkups": left, **{t: within(h) for t, h in TARGETS.items()},
        "time_to_event_days": F.col("threshold_event_days") - (F.col("t_result_k_s") - F.col("_z")) / 86400.0}).drop("_z", "t_result_k_s")


def threshold_by_condition(points: DataFrame) -> DataFrame:
    e = threshold_events(points).withColumn("_k", F.col("threshold_event_checkup_k").cast("double"))
    keys = ["threshold_label", "threshold_fraction", "parameter_set"]
    g = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_replicates"), F.count("_k").alias("n_reaching_threshold"),
                             (F.max("_k") - F.min("_k")).alias("event_spread_checkups"))
    med = quantiles(e, keys, "_k", {"median_event_checkup_k": 0.5})
    within = lambda n: F.coalesce(F.col("event_spread_checkups") <= n, F.lit(False))
    return g.join(med, keys, "left").withColumns({
        "replicate_consistent_within_1_checkup": within(1), "replicate_consistent_within_2_checkups": within(2)})


def threshold_stability(intervals: DataFrame, points: DataFrame, conditions: int | None = None) -> DataFrame:
    """Coverage, consistency and class counts per threshold; coverage is of ``conditions``, by default those of the panel."""
    by = threshold_by_condition(points)
    whole = F.count(F.lit(1)).cast("double") if conditions is None else F.lit(float(conditions))
    key = "threshold_label"
    two = F.col("n_reaching_threshold") >= 2
    share = lambda n: F.avg(F.when(two, (F.col("event_spread_checkups") <= n).cast("double")))
    g = by.groupBy(key, "threshold_fraction").agg(
        F.sum("n_reaching_threshold").alias("cells_reaching_threshold"),
        (F.sum("n_reaching_threshold") / F.sum("n_replicates")).alias("cell_coverage_fraction"),
        F.sum(two.cast("long")).alias("conditions_with_at_least_2_events"),
        (F.sum(two.cast("long")) / whole).alias("condition_coverage_fraction"),
        share(1).alias("replicate_consistency_within_1_checkup"), share(2).alias("replicate_consistency_within_2_checkups"))
    s = quantiles(by.filter(two), [key], "event_spread_checkups", {"median_spread_checkups": 0.5})
    e = threshold_events(points).withColumn("_k", F.col("threshold_event_checkup_k").cast("double"))
    m = quantiles(e, [key], "_k", {"median_event_checkup_k": 0.5})
    rows = threshold_labels(intervals, points).groupBy(key).agg(
        *[F.sum(F.col(t).cast("long")).alias(f"{t}_rows") for t in TARGETS])
    return g.join(s, key, "left").join(m, key, "left").join(rows, key)


def warning_table(labels: DataFrame, intervals: DataFrame, points: DataFrame, threshold: str = "soh_below_80") -> DataFrame:
    """One threshold; features are the state known at check-up k only."""
    lab = labels.filter(F.col("threshold_label") == threshold).select(
        "cell_id", "checkup_k", F.col("threshold_event_checkup_k").alias("event_checkup_k"), "time_to_event_checkups", *TARGETS,
        F.concat(F.lit("exploratory;"), "target_quality_flags").alias("label_quality"))
    st = points.select("cell_id", F.col("k").alias("checkup_k"), F.col("soh").alias("soh_k"),
                       F.col("calendar_days_since").alias("calendar_day_k"), F.col("cum_efc").alias("cumulative_efc_k"))
    iv = intervals.select("cell_id", "parameter_set", "replicate_id", "checkup_k", "capacity_Ah_k", *META, *FOLDS)
    return (iv.join(lab, ["cell_id", "checkup_k"]).join(st, ["cell_id", "checkup_k"])
            .withColumns({"threshold_name": F.lit(threshold), "event_observed": F.col("event_checkup_k").isNotNull()}))


def _stack_targets(df: DataFrame) -> DataFrame:
    arms = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("y")) for t in TARGETS])
    return df.withColumn("_a", F.explode(arms)).select("*", "_a.target", "_a.y").drop("_a")


def class_balance(warning: DataFrame) -> DataFrame:
    return _balance(_stack_targets(warning).groupBy("target"), cells=True)


def _balance(g, cells: bool) -> DataFrame:
    y = F.col("y")
    extra = [F.countDistinct("cell_id").alias("cells")] if cells else []
    return g.agg(F.count(F.lit(1)).alias("row_count"), F.sum(y).alias("positive_count"), F.sum(1 - y).alias("negative_count"),
                 F.avg(y.cast("double")).alias("positive_rate"), F.countDistinct("parameter_set").alias("parameter_sets"), *extra)


def split_coverage(warning: DataFrame) -> DataFrame:
    d = stack_splits(_stack_targets(warning)).filter(is_heldout(F.col("split_name"), F.col("fold")))
    return _balance(d.groupBy("target", "split_name", F.col("fold").alias("heldout_fold")), cells=False)
