"""Matched contrasts between conditions and the ordering of their effects."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalar as S
from ..functions.ordered import attach, carry, quantiles, ranks, row_numbers, with_chunks

# ---- fixed values: contrast families, limits and thresholds ----
MODE, TEMP, WINDOW, CHG, DIS, PROFILE = ("aging_mode", "nominal_temperature_C", "voltage_window_family", "nominal_charge_C_rate",
                                         "nominal_discharge_C_rate", "profile_label")
FAMILIES = {"charge_c_rate": (CHG, [MODE, TEMP, WINDOW, DIS, PROFILE]), "temperature": (TEMP, [MODE, WINDOW, CHG, DIS, PROFILE]),
            "voltage_window": (WINDOW, [MODE, TEMP, CHG, DIS, PROFILE]), "profile": (PROFILE, [MODE, TEMP, WINDOW, CHG, DIS])}
STABLE = (0.75, 0.25)
EFFECT_THRESHOLDS = [0.0, 0.01, 0.02, 0.05]
TOP_K = [3, 5]
SCOPE = ["split_name", "target", "horizon_checkups", "model_level", "feature_group"]


def condition_summaries(intervals: DataFrame) -> DataFrame:
    """Per condition: cells, interval rows, set of check-ups and attributes.

    The set of check-up numbers of a condition is at most as long as its longest trajectory.
    """
    meta = [MODE, TEMP, WINDOW, CHG, DIS, PROFILE]
    g = intervals.groupBy("parameter_set").agg(
        F.countDistinct("cell_id").alias("cells"), F.count(F.lit(1)).alias("interval_rows"),
        F.min("checkup_k").alias("min_checkup_k"), F.max("checkup_k_next").alias("max_checkup_k"),
        *[F.min_by(c, F.struct("cell_id", "checkup_k")).alias(c) for c in meta])
    ks = (intervals.select("parameter_set", F.explode(F.array("checkup_k", "checkup_k_next")).alias("k")).distinct()
          .groupBy("parameter_set").agg(F.array_sort(F.collect_list("k")).alias("checkups")))
    return g.join(ks, "parameter_set")


def match_key(fields) -> Column:
    """JSON text of the fields in name order, values as text."""
    return F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in sorted(fields)]))


def contrast_registry(intervals: DataFrame) -> DataFrame:
    """All ordered pairs equal on the match fields and different on the varied one.

    The join runs on condition summaries, one row per design point, and only inside one
    match key: the pairs are bounded by the design, however many cells replicate it.
    """
    s = condition_summaries(intervals)
    types = dict(s.dtypes)
    arms = F.array(*[F.struct(
        F.lit(f).alias("contrast_family"), F.lit(v).alias("varied_field"), match_key(m).alias("match_key"), F.col(v).cast("string").alias("value"),
        (F.col(v).cast("double") if types[v] == "double" else F.lit(0.0)).alias("num")) for f, (v, m) in FAMILIES.items()])
    d = s.withColumn("_a", F.explode(arms)).select("parameter_set", "cells", "interval_rows", "min_checkup_k", "max_checkup_k", "checkups", "_a.*")
    keys = ["contrast_family", "varied_field", "match_key"]
    side = lambda p: d.select(*keys, F.struct("num", "value").alias(f"o_{p}"), *[F.col(c).alias(f"arm_{p}_{c}") for c in (
        "parameter_set", "value", "cells", "interval_rows", "min_checkup_k", "max_checkup_k", "checkups")])
    j = side("a").join(side("b"), keys).filter(F.col("o_a") < F.col("o_b"))
    common = F.size(F.array_intersect("arm_a_checkups", "arm_b_checkups"))
    low = F.least("arm_a_cells", "arm_b_cells")
    level = F.when(low >= 3, "matched_triplets").when(low >= 2, "partial_replicates").otherwise("insufficient_replicates")
    quality = F.concat_ws(";", level, F.when(common < 3, "insufficient_common_horizon"))
    return j.select(
        F.format_string("%s_%03d_%03d", "contrast_family", "arm_a_parameter_set", "arm_b_parameter_set").alias("contrast_id"), *keys,
        *[f"arm_{p}_{c}" for c in ("parameter_set", "value", "cells", "interval_rows", "min_checkup_k", "max_checkup_k") for p in "ab"],
        F.array_except(F.array_intersect("arm_a_checkups", "arm_b_checkups"), F.array(F.lit(0))).alias("common_checkups"),
        common.alias("common_checkup_count"), (quality == "matched_triplets").alias("has_triplet_support"), quality.alias("support_quality"))


def families(registry: DataFrame) -> DataFrame:
    return registry.groupBy("contrast_family").agg(F.count(F.lit(1)).alias("contrasts"), F.sum(F.col("has_triplet_support").cast("long")).alias("triplet_supported"),
                                                   F.countDistinct("match_key").alias("match_groups"))


def observed_stability(registry: DataFrame, points: DataFrame) -> DataFrame:
    """Effect per contrast and common check-up, and the share of replicate pairs with b > a.

    The share comes from counts of a-values below each b-value, so no pairs are formed.
    """
    first = points.filter("idx = 0").select("cell_id", F.col("capacity_Ah").alias("_c0"))
    loss = points.join(first, "cell_id").select("parameter_set", F.col("k").alias("checkup_k"), (F.col("_c0") - F.col("capacity_Ah")).alias("loss"))
    loss = loss.filter("checkup_k <> 0 AND loss IS NOT NULL AND parameter_set IS NOT NULL")
    ids = ["contrast_id", "contrast_family", "arm_a_parameter_set", "arm_b_parameter_set", "support_quality"]
    arms, key = ["arm_a_parameter_set", "arm_b_parameter_set"], ["_pair", "checkup_k"]
    g = loss.groupBy("parameter_set", "checkup_k").agg(F.count("loss").alias("replicates"), F.avg("loss").alias("mean"))
    side = lambda p: g.select(F.col("parameter_set").alias(f"arm_{p}_parameter_set"), "checkup_k", F.col("replicates").alias(f"arm_{p}_replicates"),
                              F.col("mean").alias(f"arm_{p}_mean"))
    g = registry.select(*ids).join(side("a"), "arm_a_parameter_set").join(side("b"), ["arm_b_parameter_set", "checkup_k"])
    # a pair of conditions is counted once however many families it is a contrast in; its losses are dealt by stretches of
    # values, counted there, and only the counts of a stretch meet
    pairs = registry.select(*arms).distinct().withColumn("_pair", F.col(arms[0]).cast("long") * (1 << 31) + F.col(arms[1]))
    folded = with_chunks(loss.groupBy("parameter_set", "checkup_k", "loss").agg(F.count(F.lit(1)).alias("n")), ["checkup_k"], "loss")
    reg = pairs.select("_pair", F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.col(c).alias("parameter_set")) for i, c in enumerate(arms)])).alias("s")).select("_pair", "s.*")
    d = reg.join(folded, "parameter_set").select(*key, "_chunk", "loss", "b", "n")
    local = W.partitionBy(*key, "_chunk").orderBy("loss").rangeBetween(W.unboundedPreceding, W.currentRow)
    na, nb = F.when(F.col("b") == 0, F.col("n")).otherwise(0), F.when(F.col("b") == 1, F.col("n")).otherwise(0)
    # of equal losses both sides stand in the running sum: those of arm a are taken off again
    tied = F.sum(na).over(W.partitionBy(*key, "_chunk", "loss"))
    d = d.withColumn("_below", F.sum(na).over(local) - tied)
    c = d.groupBy(*key, "_chunk").agg(F.sum(nb * F.col("_below")).alias("w"), F.sum(na).alias("na"), F.sum(nb).alias("nb"))
    before = F.coalesce(F.sum("na").over(W.partitionBy(*key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = c.withColumn("_w", F.col("w") + F.col("nb") * before).groupBy(*key).agg(F.sum("_w").alias("wins"))
    wins = wins.join(pairs, "_pair").drop("_pair")
    j = g.join(wins, [*arms, "checkup_k"])
    share = F.col("wins") / (F.col("arm_a_replicates") * F.col("arm_b_replicates"))
    effect = F.col("arm_b_mean") - F.col("arm_a_mean")
    stable = (F.col("arm_a_replicates") >= 2) & (F.col("arm_b_replicates") >= 2) & ((share >= STABLE[0]) | (share <= STABLE[1]))
    return j.withColumns({"effect_b_minus_a": effect, "pairwise_positive_fraction": share, "sign_label": S.effect_sign(effect), "sign_stable": stable})


def stability_by_family(stability: DataFrame) -> DataFrame:
    d = stability.withColumn("_e", F.abs("effect_b_minus_a"))
    g = d.groupBy("contrast_family").agg(F.count(F.lit(1)).alias("stability_rows"), F.sum(F.col("sign_stable").cast("long")).alias("sign_stable_rows"),
                                         F.avg(F.col("sign_stable").cast("double")).alias("sign_stable_fraction"), F.countDistinct("contrast_id").alias("unique_contrasts"))
    return attach(g, quantiles(d, ["contrast_family"], "_e", {"median_abs_effect_b_minus_a": .5}), ["contrast_family"])


def join_truth(pred: DataFrame, truth: DataFrame, keys, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Predictions with the observed value, and a one-row count of rows that disagree with it."""
    j = pred.join(truth.select(*keys, F.col("observed")), list(keys))
    bad = F.abs(F.col("y_true") - F.col("observed")) > tolerance
    return j, j.agg(F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("long")).alias("mismatches"))


def pairwise_ordering(registry: DataFrame, pred: DataFrame, min_rows: int = 2) -> DataFrame:
    """Observed against predicted mean severity of the two arms per contrast and base key."""
    base = [*SCOPE, "checkup_k"]
    g = pred.groupBy("parameter_set", *base).agg(F.count(F.lit(1)).alias("rows"), F.avg(-F.col("y_true")).alias("obs"), F.avg(-F.col("y_pred")).alias("prd"))
    side = lambda p: g.filter(F.col("rows") >= min_rows).select(F.col("parameter_set").alias(f"arm_{p}_parameter_set"), *base, *[
        F.col(c).alias(f"arm_{p}_{c}") for c in ("rows", "obs", "prd")])
    r = registry.filter("has_triplet_support").select("contrast_id", "contrast_family", "arm_a_parameter_set", "arm_b_parameter_set")
    j = r.join(side("a"), "arm_a_parameter_set").join(side("b"), ["arm_b_parameter_set", *base])
    obs, prd = F.col("arm_b_obs") - F.col("arm_a_obs"), F.col("arm_b_prd") - F.col("arm_a_prd")
    j = j.withColumns({"observed_effect_b_minus_a": obs, "predicted_effect_b_minus_a": prd, "effect_abs_error": F.abs(prd - obs),
                       "observed_sign_label": S.effect_sign(obs), "predicted_sign_label": S.effect_sign(prd)})
    ok = (F.col("observed_sign_label") != "tie") & (F.col("predicted_sign_label") != "tie")
    return j.withColumns({"sign_evaluable": ok, "sign_correct": ok & (F.col("observed_sign_label") == F.col("predicted_sign_label"))})


def with_all(df: DataFrame) -> DataFrame:
    """Every row in its family and in ``all``."""
    return df.withColumn("contrast_family", F.explode(F.array(F.col("contrast_family"), F.lit("all"))))


def ordering_summary(pairwise: DataFrame, extra=()) -> DataFrame:
    d = with_all(pairwise)
    keys = [*SCOPE, "contrast_family", *extra]
    n = lambda c: F.sum(c.cast("long"))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairwise_rows"), F.countDistinct("contrast_id").alias("unique_contrasts"), n(F.col("sign_evaluable")).alias("sign_evaluable_rows"),
        n(F.col("sign_correct")).alias("sign_correct_rows"), F.avg("effect_abs_error").alias("mean_effect_abs_error"),
        n(F.col("observed_sign_label") == "tie").alias("observed_tie_rows"), n(F.col("predicted_sign_label") == "tie").alias("predicted_tie_rows"))
    g = g.withColumn("sign_accuracy", S.safe_ratio(F.col("sign_correct_rows"), F.col("sign_evaluable_rows")))
    return attach(g, quantiles(d, keys, "effect_abs_error", {"median_effect_abs_error": .5}), keys)


def threshold_accuracy(pairwise: DataFrame, thresholds=EFFECT_THRESHOLDS) -> DataFrame:
    """The same summary over rows whose observed effect is at least each threshold."""
    d = pairwise.withColumn("effect_threshold_Ah", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return ordering_summary(d.filter(F.abs("observed_effect_b_minus_a") >= F.col("effect_threshold_Ah")), ["effect_threshold_Ah"])


def arm_bins(pairwise: DataFrame, candidate: Column, reference: Column) -> DataFrame:
    """Paired accuracy and error of two prediction arms by effect bin."""
    keys = ["split_name", "target", "horizon_checkups", "contrast_id", "contrast_family", "checkup_k"]
    side = lambda c, p: pairwise.filter(c).select(*keys, F.abs("observed_effect_b_minus_a").alias(f"{p}_size"), F.col("sign_correct").cast("double").alias(f"{p}_ok"),
                                                  F.col("effect_abs_error").alias(f"{p}_err"))
    j = side(candidate, "c").join(side(reference, "r"), keys)
    return j.groupBy("horizon_checkups", S.effect_bin(F.col("c_size")).alias("effect_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("c_ok").alias("candidate_accuracy"), F.avg("r_ok").alias("reference_accuracy"),
        F.avg("c_err").alias("candidate_error"), F.avg("r_err").alias("reference_error"))


def contrast_effects(pairwise: DataFrame) -> DataFrame:
    """Mean observed and predicted effect per contrast, in its family and in ``all``."""
    g = pairwise.groupBy(*SCOPE, "contrast_family", "contrast_id", (F.col("arm_a_parameter_set") * 100000 + F.col("arm_b_parameter_set")).alias("pair_id")).agg(
        F.avg("observed_effect_b_minus_a").alias("obs"), F.avg("predicted_effect_b_minus_a").alias("prd"))
    g = with_all(g)
    # one pair of conditions may be a contrast in two families
    return g.withColumn("pair_id", F.col("pair_id") * 8 + F.pmod(F.ascii(F.substring("contrast_id", 1, 1)), F.lit(8))).withColumns(
        {c: F.round(c, 10) for c in ("obs", "prd")})


def spearman(df: DataFrame, keys, x: str, y: str, out: str = "spearman_r") -> DataFrame:
    """Correlation of tie-averaged ranks."""
    d = ranks(ranks(df, keys, x, "_rx"), keys, y, "_ry")
    return d.groupBy(*keys).agg(F.when((F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0), F.corr("_rx", "_ry")).alias(out), F.count(F.lit(1)).alias("n"))


def kendall_tau_b(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Kendall tau-b without forming pairs.

    Two rows differ in y first at one bit of their y-ranks.  Per bit, rows are grouped by the
    higher bits and a running count along x of rows with the bit set gives the discordant
    pairs decided at that bit: n log n rows in place of n squared.
    """
    keys = list(keys)
    d = ranks(ranks(df, keys, x, "_rx", n_out="_tx"), keys, y, "_ry", n_out="_ty")
    d = d.withColumns({"_ix": (F.col("_rx") - (F.col("_tx") + 1) / 2.0).cast("long"), "_iy": (F.col("_ry") - (F.col("_ty") + 1) / 2.0).cast("long")})
    both = d.groupBy(*keys, "_ix", "_iy").agg(F.count(F.lit(1)).alias("_b"), F.max("_tx").alias("_tx"), F.max("_ty").alias("_ty"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    share = both.groupBy(*keys).agg(F.sum("_b").alias("n"), F.sum(F.col("_b") * (F.col("_tx") - 1) / 2.0).alias("n1"),
                                    F.sum(F.col("_b") * (F.col("_ty") - 1) / 2.0).alias("n2"), F.sum(pairs("_b")).alias("n3"), F.max("_iy").alias("_m"))
    bits = both.join(share.select(*keys, "_m"), keys).withColumn(
        "_bit", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("_m"), F.lit(1)))).cast("int"))))
    bits = bits.withColumns({"_hi": F.expr("shiftright(_iy, _bit + 1)"), "_on": F.expr("shiftright(_iy, _bit) & 1L")})
    cells = bits.groupBy(*keys, "_bit", "_hi", "_ix").agg(F.sum(F.col("_b") * F.col("_on")).alias("c1"), F.sum(F.col("_b") * (1 - F.col("_on"))).alias("c0"))
    cells = carry(cells.withColumn("_chunk", F.floor(F.col("_ix") / 4096)), [*keys, "_bit", "_hi"], "_chunk", ["_ix"], sums_before={"_b1": "c1"})
    disc = cells.groupBy(*keys).agg(F.sum(F.col("c0") * F.col("_b1")).alias("d"))
    j = share.join(disc, keys)
    n0 = F.col("n") * (F.col("n") - 1) / 2.0
    conc = n0 - F.col("n1") - F.col("n2") + F.col("n3") - F.col("d")
    den = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    return j.select(*keys, F.when(den > 0, (conc - F.col("d")) / den).alias("kendall_tau_b"))


def rank_correlation(pairwise: DataFrame, least: int = 5) -> DataFrame:
    e = contrast_effects(pairwise)
    keys = [*SCOPE, "contrast_family"]
    out = spearman(e, keys, "obs", "prd").join(kendall_tau_b(e, keys, "obs", "prd"), keys)
    ok = F.col("n") >= least
    return out.select(*keys, F.col("n").alias("contrast_rows"), F.when(ok, F.col("spearman_r")).alias("spearman_r"),
                      F.when(ok, F.col("kendall_tau_b")).alias("kendall_tau_b"), F.when(ok, "evaluated").otherwise("insufficient_contrasts").alias("status"))


def top_k_regret(pairwise: DataFrame, ks=TOP_K, least: int = 3) -> DataFrame:
    """Overlap of predicted and observed top k, and the observed effect lost by choosing on predictions."""
    e = contrast_effects(pairwise)
    keys = [*SCOPE, "contrast_family"]
    d = row_numbers(row_numbers(e, keys, "obs", "pair_id", "ro", descending=True), keys, "prd", "pair_id", "rp", descending=True)
    n = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("contrast_rows"))
    d = d.join(n.filter(F.col("contrast_rows") >= least), keys).withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks])))
    k = F.least("top_k", "contrast_rows")
    a, b = F.col("ro") <= k, F.col("rp") <= k
    g = d.groupBy(*keys, "top_k").agg(F.max("contrast_rows").alias("contrast_rows"), F.sum((a & b).cast("long")).alias("_hit"),
                                      F.avg(F.when(b, F.col("obs"))).alias("mean_observed_effect_selected"), F.avg(F.when(a, F.col("obs"))).alias("mean_observed_effect_best"))
    return g.withColumns({"effective_top_k": k, "topk_overlap_fraction": F.col("_hit") / k,
                          "regret_vs_observed_best": F.col("mean_observed_effect_best") - F.col("mean_observed_effect_selected")}).drop("_hit")
