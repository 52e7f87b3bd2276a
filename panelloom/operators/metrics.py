"""Grouped metrics, leaderboards, paired comparisons and probability scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..functions.ordered import attach, carry, count_below, quantiles, row_numbers
from .rules import ARM, FOLD, GROUPS

BOARD = ["run_scope", "model_level", "feature_group", "target", "split_name"]


def _err() -> Column:
    return F.col("y_pred") - F.col("y_true")


def condition_errors(pred: DataFrame, keys=ARM) -> DataFrame:
    """Mean absolute error per arm and condition; the base of every two-level metric."""
    return pred.groupBy(*keys, "parameter_set").agg(
        F.avg(F.abs(_err())).alias("condition_mae"), F.sum(F.abs(_err())).alias("abs_sum"), F.sum(_err() * _err()).alias("sq_sum"), F.sum(_err()).alias("err_sum"),
        F.count(F.lit(1)).alias("n"), F.count(_err()).alias("n_err"))


def regression_metrics(pred: DataFrame, keys=ARM, cut=lambda df: df) -> DataFrame:
    """Row metrics, then mean, median and worst of the per-condition errors."""
    return metrics_of(cut(condition_errors(pred, keys)), keys)


def metrics_of(c: DataFrame, keys=ARM) -> DataFrame:
    """``regression_metrics`` of ``condition_errors``."""
    g = c.groupBy(*keys).agg(
        F.sum("n").alias("test_rows"), F.count(F.lit(1)).alias("test_parameter_sets"), (F.sum("abs_sum") / F.sum("n")).alias("mae"),
        F.sqrt(F.sum("sq_sum") / F.sum("n")).alias("rmse"), (F.sum("err_sum") / F.sum("n")).alias("bias"),
        F.avg("condition_mae").alias("condition_mean_mae"), F.max("condition_mae").alias("worst_condition_mae"),
        F.max_by("parameter_set", F.struct("condition_mae", -F.col("parameter_set"))).alias("worst_parameter_set"))
    return attach(g, quantiles(c, keys, "condition_mae", {"condition_median_mae": 0.5}), keys)


def quantile_metrics(pred: DataFrame, keys=ARM) -> DataFrame:
    """Coverage, width and pinball losses; a missing quantile empties the whole group."""
    y, a, m, b = (F.col(c) for c in ("y_true", "y_pred_q10", "y_pred_q50", "y_pred_q90"))
    ok = F.every(a.isNotNull() & m.isNotNull() & b.isNotNull() & y.isNotNull())
    pin = lambda q, t: F.avg(F.greatest(t * (y - q), (t - 1) * (y - q)))
    vals = {"q10_q90_interval_coverage": F.avg(y.between(a, b).cast("double")), "q10_q90_interval_width_mean": F.avg(b - a),
            "pinball_loss_q10": pin(a, .1), "pinball_loss_q50": pin(m, .5), "pinball_loss_q90": pin(b, .9)}
    return pred.groupBy(*keys).agg(*[F.when(ok, e).alias(n) for n, e in vals.items()])


def leaderboard(metrics: DataFrame, keys=BOARD) -> DataFrame:
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fold_count"), F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"),
        F.avg("condition_mean_mae").alias("condition_mean_mae"), F.avg("condition_median_mae").alias("condition_median_mae"),
        F.max("worst_condition_mae").alias("worst_condition_mae"), F.sum("test_rows").alias("test_rows"),
        F.sum("test_parameter_sets").alias("test_parameter_sets"))


def adjacent_gains(board: DataFrame, groups=GROUPS) -> DataFrame:
    """Gain from one feature group to the next in the declared order, F1 onward."""
    order = F.create_map(*[x for i, g in enumerate(groups[1:]) for x in (F.lit(g), F.lit(i))])
    d = board.filter("model_level <> 'L0_persistence'").withColumn("_o", F.try_element_at(order, F.col("feature_group"))).filter("_o IS NOT NULL")
    keys = ["run_scope", "model_level", "target", "split_name"]
    a = d.select(*keys, (F.col("_o") + 1).alias("_o"), *[F.col(c).alias(f"from_{c}") for c in ("feature_group", "condition_mean_mae", "worst_condition_mae")])
    b = d.select(*keys, "_o", *[F.col(c).alias(f"to_{c}") for c in ("feature_group", "condition_mean_mae", "worst_condition_mae")])
    return a.join(b, [*keys, "_o"]).withColumns({
        "condition_mean_mae_gain": F.col("from_condition_mean_mae") - F.col("to_condition_mean_mae"),
        "worst_condition_mae_gain": F.col("from_worst_condition_mae") - F.col("to_worst_condition_mae")}).drop("_o")


def scope_deltas(metrics: DataFrame, first: str = "primary", second: str = "sensitivity_excluding_monotonicity") -> DataFrame:
    keys = ["model_level", "feature_group", "target", "split_name", "heldout_fold"]
    pick = lambda s, c: F.max(F.when(F.col("run_scope") == s, F.col(c)))
    g = metrics.groupBy(*keys).agg(*[pick(s, c).alias(f"{n}_{c}") for s, n in ((first, "primary"), (second, "sensitivity"))
                                     for c in ("mae", "condition_mean_mae")])
    g = g.filter("primary_mae IS NOT NULL AND sensitivity_mae IS NOT NULL")
    return g.withColumns({f"primary_minus_sensitivity_{c}": F.col(f"primary_{c}") - F.col(f"sensitivity_{c}") for c in ("mae", "condition_mean_mae")})


def arm_gains(table: DataFrame, keys, candidate: Column, reference: Column, value: str, label=("model_level", "feature_group")) -> DataFrame:
    """Pair candidate arms with reference arms of the same scope: gain = reference - candidate."""
    side = lambda c, p: table.filter(c).select(*keys, *[F.col(x).alias(f"{p}_{x}") for x in label], F.col(value).alias(f"{p}_value"))
    j = side(candidate, "candidate").join(side(reference, "reference"), list(keys))
    gain = F.col("reference_value") - F.col("candidate_value")
    return j.withColumns({"gain": gain, "relative_gain": S.safe_ratio(gain, F.col("reference_value")), "beats_reference": gain > 1e-12})


def best_arm(board: DataFrame, keys=("target", "split_name")) -> DataFrame:
    """Lexicographic argmin of (mean, worst) over the arms of a key."""
    best = F.min_by(F.struct("model_level", "feature_group", "condition_mean_mae", "worst_condition_mae"),
                    F.struct(F.round("condition_mean_mae", 12), F.round("worst_condition_mae", 12), "model_level", "feature_group"))
    return board.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(f"best_{c}") for c in (
        "model_level", "feature_group", "condition_mean_mae", "worst_condition_mae")])


def best_against_baseline(board: DataFrame, errors: DataFrame) -> DataFrame:
    """Best arm per target and split with its worst condition and the gain over persistence; ``errors`` of ``condition_errors``."""
    p = board.filter("run_scope = 'primary'")
    b = best_arm(p)
    l0 = p.filter("model_level = 'L0_persistence'").select("target", "split_name", F.col("condition_mean_mae").alias("l0_condition_mean_mae"))
    keys = ["target", "split_name", "model_level", "feature_group"]
    c = errors.filter("run_scope = 'primary'").groupBy(*keys, "parameter_set").agg(F.try_divide(F.sum("abs_sum"), F.sum("n_err")).alias("condition_mae"))
    c = c.groupBy(*keys).agg(
        F.max_by(F.struct("parameter_set", "condition_mae"), F.struct("condition_mae", -F.col("parameter_set"))).alias("w"))
    c = c.select("target", "split_name", F.col("model_level").alias("best_model_level"), F.col("feature_group").alias("best_feature_group"),
                 F.col("w.parameter_set").alias("worst_parameter_set"), F.col("w.condition_mae").alias("worst_parameter_set_mae"))
    j = b.join(l0, ["target", "split_name"], "left").join(c, ["target", "split_name", "best_model_level", "best_feature_group"], "left")
    return j.withColumn("condition_mean_mae_improvement_vs_l0", F.col("l0_condition_mean_mae") - F.col("best_condition_mean_mae"))


def error_summary(pred: DataFrame, keys) -> DataFrame:
    """n, MAE, RMSE, bias and median absolute error per key."""
    g = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(_err())).alias("mae"), F.sqrt(F.avg(_err() * _err())).alias("rmse"),
                                F.avg(_err()).alias("bias"), F.countDistinct("parameter_set").alias("parameter_sets"))
    med = quantiles(pred.withColumn("_e", F.abs(_err())), keys, "_e", {"median_abs_error": 0.5})
    return g.join(med, list(keys))


def grouped_errors(pred: DataFrame, keys, fields) -> DataFrame:
    """The same error summary by several fields, long."""
    from .diagnostics import grouped
    return error_summary(grouped(pred, fields), [*keys, "grouping", "group_value"])


def paired_condition_gains(pred: DataFrame, reference: str = "L0_persistence") -> DataFrame:
    """Candidate against every reference feature group on the same condition and fold."""
    c = condition_errors(pred)
    keys = ["run_scope", *FOLD, "target", "parameter_set"]
    return arm_gains(c, keys, F.col("model_level") != reference, F.col("model_level") == reference, "condition_mae")


def common_keys(pred: DataFrame, groups, keys=("target", "split_name", "cell_id", "checkup_k", "checkup_k_next")) -> DataFrame:
    """Row keys that every listed feature group predicts."""
    d = pred.filter(F.col("feature_group").isin(*groups)).groupBy(*keys).agg(F.countDistinct("feature_group").alias("g"))
    return d.filter(F.col("g") == len(groups)).drop("g")


def win_rate(gains: DataFrame, keys) -> DataFrame:
    return gains.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("gain").alias("mean_gain"), F.avg((F.col("gain") > 0).cast("double")).alias("win_rate"))


# ---- probability scores ----
def _p() -> Column:
    return F.col("p")


def _y() -> Column:
    return F.col("y")


def point_scores(df: DataFrame, keys) -> DataFrame:
    """Brier, log loss and the least-squares calibration line of y on logit(p)."""
    c = S.clip_probability(_p())
    ll = -(_y() * F.log(c) + (1 - _y()) * F.log(1 - c))
    z = S.logit(_p())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(_y()).alias("positives"), F.avg((_p() - _y()) * (_p() - _y())).alias("brier"),
                                 F.avg(ll).alias("log_loss"),
                                 F.when(F.var_pop(z) > 1e-12, F.covar_pop(z, _y().cast("double")) / F.var_pop(z)).alias("calibration_slope"),
                                 F.when(F.var_pop(z) > 1e-12, F.avg(_y()) - F.avg(z) * F.covar_pop(z, _y().cast("double")) / F.var_pop(z)).alias("calibration_intercept"))


def auroc(df: DataFrame, keys) -> DataFrame:
    """Mann-Whitney share with ties at one half, from counts per distinct score.

    Each score is one row however many predictions share it; NULL if a class is absent.
    """
    f = count_below(df, keys, "p", {"pos": _y(), "neg": 1 - _y()})
    return f.groupBy(*keys).agg(
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0),
               F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg"))).alias("auroc"))


def auprc(df: DataFrame, keys, tiebreak: str) -> DataFrame:
    """Step area under precision-recall in order of falling score, ties by ``tiebreak``."""
    d = row_numbers(df.withColumn("_neg", -_p()), keys, "_neg", tiebreak, "rn")
    d = carry(d.withColumn("_chunk", F.floor(F.col("rn") / 4096)), keys, "_chunk", ["rn"], sums={"tp": _y()})
    g = d.groupBy(*keys).agg(F.sum(_y()).alias("pos"), F.sum(F.when(_y() == 1, F.col("tp") / F.col("rn"))).alias("s"))
    return g.select(*keys, F.when(F.col("pos") > 0, F.coalesce("s", F.lit(0.0)) / F.col("pos")).alias("auprc"))


def reliability_bins(df: DataFrame, keys, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(_p() * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(_p()).alias("mean_p"), F.avg(_y().cast("double")).alias("observed_rate"))


def ece(df: DataFrame, keys, bins: int = 10) -> DataFrame:
    r = reliability_bins(df, keys, bins)
    return r.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("observed_rate"))) / F.sum("n")).alias("ece"))


def ece_equal_frequency(df: DataFrame, keys, bins: int = 10) -> DataFrame:
    """Bin i holds rows [i n / b, (i + 1) n / b) in order of (p, y).

    Rows with equal (p, y) are folded, so a bin is cut by counts: the part of a folded group
    inside a bin is an overlap of two integer ranges.
    """
    f = count_below(df, keys, "p", {"n1": _y(), "n0": 1 - _y()})
    n = f.groupBy(*keys).agg(F.sum(F.col("n0") + F.col("n1")).alias("n"))
    start = F.col("n0_below") + F.col("n1_below")
    parts = F.array(F.struct(start.alias("a"), (start + F.col("n0")).alias("b"), F.lit(0.0).alias("yy")),
                    F.struct((start + F.col("n0")).alias("a"), (start + F.col("n0") + F.col("n1")).alias("b"), F.lit(1.0).alias("yy")))
    d = f.join(n, keys).withColumn("_q", F.explode(parts)).filter(F.col("_q.b") > F.col("_q.a"))
    lo = F.floor((F.col("_q.a") * bins) / F.col("n")) - 1
    hi = F.floor((F.col("_q.b") * bins) / F.col("n")) + 1
    d = d.withColumn("bin", F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.lit(bins - 1)))))
    at = lambda i: F.floor(i * F.col("n") / bins)
    take = F.least(F.col("_q.b"), at(F.col("bin") + 1)) - F.greatest(F.col("_q.a"), at(F.col("bin")))
    d = d.withColumn("t", take).filter("t > 0")
    g = d.groupBy(*keys, "bin").agg(F.sum("t").alias("m"), F.sum(F.col("t") * F.col("p")).alias("sp"), F.sum(F.col("t") * F.col("_q.yy")).alias("sy"))
    return g.groupBy(*keys).agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("m")).alias("ece_equal_frequency"))


def warning_metrics(df: DataFrame, keys, tiebreak: str = "row_id") -> DataFrame:
    """All probability scores plus the mean and worst per-condition Brier score."""
    cond = df.groupBy(*keys, "parameter_set").agg(F.avg((_p() - _y()) * (_p() - _y())).alias("b")).groupBy(*keys).agg(
        F.avg("b").alias("condition_mean_brier"), F.max("b").alias("worst_condition_brier"))
    out = point_scores(df, keys).join(cond, keys)
    for part in (auroc(df, keys), auprc(df, keys, tiebreak), ece(df, keys), ece_equal_frequency(df, keys)):
        out = out.join(part, keys, "left")
    return out
