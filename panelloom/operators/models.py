"""MLlib arms of the evaluation grid: ridge, trees, logistic, calibration, bags, nested search.

Each fit is a distributed MLlib job.  The driver only loops over the declared arms and folds
(tens of them) and never sees a data row; arms are unioned into the long prediction table.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..functions.lineage import cut
from ..functions.ordered import quantiles
from . import ridge as rg
from .rules import balanced_weights
from .splits import SPLITS, inner_folds, is_heldout, stack_splits
from .uncertainty import cluster_weights

NUMERIC = ["capacity_Ah_k", "nominal_temperature_C", "nominal_charge_C_rate", "duration_h", "log_age_efc_delta"]
CATEGORICAL = ["voltage_window_family", "profile_label"]
KEEP = ["cell_id", "parameter_set", "checkup_k"]
#: Boosting steps of every tree arm unless named otherwise.
STEPS = 50


def fold_ids(df: DataFrame, split: str) -> list[int]:
    """Held-out folds of a split: a handful of integers read from an aggregate."""
    d = df.select(F.col(split).alias("f")).distinct().filter(is_heldout(F.lit(split), F.col("f")))
    return sorted(r["f"] for r in d.collect())


def sides(df: DataFrame, split: str, fold: int) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(split) != fold), df.filter(F.col(split) == fold)


def featurise(train: DataFrame, test: DataFrame, numeric, categorical, extra=()) -> tuple[DataFrame, DataFrame]:
    """Train-fitted imputation, scaling and one-hot; unseen categories give zeros."""
    imp = [f"{c}_i" for c in numeric]
    idx, hot = [f"{c}_x" for c in categorical], [f"{c}_h" for c in categorical]
    stages = [Imputer(inputCols=list(numeric), outputCols=imp, strategy="mean"), VectorAssembler(inputCols=imp, outputCol="_num"),
              StandardScaler(inputCol="_num", outputCol="_std", withMean=True, withStd=True)]
    if categorical:
        stages += [StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep"), OneHotEncoder(inputCols=idx, outputCols=hot)]
    stages.append(VectorAssembler(inputCols=["_std", *hot, *extra], outputCol="features"))
    as_double = lambda d: d.withColumns({c: F.col(c).cast("double") for c in numeric})
    m = Pipeline(stages=stages).fit(as_double(train))
    return m.transform(as_double(train)), m.transform(as_double(test))


def ridge(train: DataFrame, label: str, alpha: float = 1.0, weight: str | None = None):
    """Ridge with penalty alpha: MLlib averages the loss and scales the label, so the
    parameter is alpha * std(y) / n."""
    s = train.agg(F.stddev_pop(label).alias("s"), F.count(F.lit(1)).alias("n")).first()
    reg = alpha * (s["s"] or 1.0) / max(s["n"], 1)
    lr = LinearRegression(labelCol=label, featuresCol="features", regParam=float(reg), elasticNetParam=0.0, solver="normal", standardization=False)
    return (lr.setWeightCol(weight) if weight else lr).fit(train)


def trees(label: str, seed: int, steps: int, weight: str | None = None):
    g = GBTRegressor(labelCol=label, featuresCol="features", maxIter=steps, maxDepth=3, stepSize=0.1, seed=seed, cacheNodeIds=False)
    return g.setWeightCol(weight) if weight else g


def tag(pred: DataFrame, split: str, fold: int, model: str, group: str, target: str, value: Column, extra=()) -> DataFrame:
    return pred.select(F.lit("primary").alias("run_scope"), F.lit(split).alias("split_name"), F.lit(fold).alias("heldout_fold"),
                       F.lit(model).alias("model_level"), F.lit(group).alias("feature_group"), F.lit(target).alias("target"), *KEEP,
                       F.col(target).cast("double").alias("y_true"), value.alias("y_pred"), *extra)


def run_arms(df: DataFrame, split: str, target: str, arms, numeric=NUMERIC, categorical=CATEGORICAL, group: str = "F4_state_log_age_scalar",
             seed: int = 42, steps: int = STEPS) -> DataFrame:
    """Predictions of the named arms on every held-out fold.

    arms: any of L1_ridge, L2_trees, L3_quantile (mean trees plus train-residual quantiles)
    """
    out = []
    for fold in fold_ids(df, split):
        a, b = (x.filter(F.col(target).isNotNull()) for x in sides(df, split, fold))
        a, b = featurise(a, b, numeric, categorical)
        if "L1_ridge" in arms:
            out.append(tag(ridge(a, target).transform(b), split, fold, "L1_ridge", group, target, F.col("prediction")))
        if "L2_trees" in arms or "L3_quantile" in arms:
            m = trees(target, seed, steps).fit(a)
            p = m.transform(b)
            if "L2_trees" in arms:
                out.append(tag(p, split, fold, "L2_trees", group, target, F.col("prediction")))
            if "L3_quantile" in arms:
                r = m.transform(a).withColumn("_r", F.col(target) - F.col("prediction"))
                q = quantiles(r, [], "_r", {"q10": .1, "q50": .5, "q90": .9})
                p = p.crossJoin(q)   # one-row frame
                v = [F.col("prediction") + F.col(c) for c in ("q10", "q50", "q90")]
                out.append(tag(p, split, fold, "L3_quantile", group, target, v[1], [F.least(*v).alias("y_pred_q10"), v[1].alias("y_pred_q50"), F.greatest(*v).alias("y_pred_q90")]))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), out)


# ---- probabilities ----
def run_warning_arms(warning: DataFrame, split: str, target: str, arms=("B5_logistic", "B6_trees"), numeric=("soh_k", "calendar_day_k", "cumulative_efc_k", "nominal_temperature_C"),
                     categorical=CATEGORICAL, seed: int = 42, steps: int = STEPS, C: float = 1.0) -> DataFrame:
    """Event probabilities; a train side with one class falls back to its prior."""
    d = warning.withColumn("y", F.col(target).cast("double"))
    out = []
    for fold in fold_ids(d, split):
        a, b = sides(d, split, fold)
        s = a.agg(F.avg("y").alias("p"), F.count(F.lit(1)).alias("n")).first()
        if s["p"] in (None, 0.0, 1.0):
            out += [tag(b.withColumn("_p", F.lit(float(s["p"] or 0.0))), split, fold, m, "W2_nominal", "y", F.col("_p")) for m in arms]
            continue
        a, b = featurise(a, b, list(numeric), categorical)
        for m in arms:
            est = (LogisticRegression(labelCol="y", regParam=1.0 / (C * s["n"]), standardization=False) if m == "B5_logistic"
                   else GBTClassifier(labelCol="y", maxIter=steps, maxDepth=3, seed=seed))
            p = est.fit(a).transform(b).withColumn("_p", vector_to_array("probability")[1])
            out.append(tag(p, split, fold, m, "W2_nominal", "y", F.col("_p")))
    return reduce(DataFrame.unionByName, out).withColumn("target", F.lit(target))


def calibrate(base: DataFrame, test: DataFrame, method: str, min_class: int = 5) -> DataFrame:
    """Platt or isotonic map of ``p`` learned on ``base`` (p, y), applied to ``test``.

    Raw probabilities are kept where the base is empty, has one class or too few of one.
    """
    s = base.agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).first()
    if method == "raw" or min(s["pos"] or 0, s["neg"] or 0) < min_class:
        return test.withColumns({"p_calibrated": F.col("p"), "calibration": F.lit("raw")})
    lab = lambda d: d.withColumns({"label": F.col("y").cast("double"), "z": S.logit(F.col("p"))})
    if method == "platt":
        va = VectorAssembler(inputCols=["z"], outputCol="features")
        m = LogisticRegression(labelCol="label", regParam=0.0).fit(va.transform(lab(base)))
        t = m.transform(va.transform(lab(test))).withColumn("p_calibrated", vector_to_array("probability")[1])
    else:
        m = IsotonicRegression(labelCol="label", featuresCol="p").fit(lab(base))
        t = m.transform(lab(test)).withColumn("p_calibrated", F.col("prediction"))
    return t.select(*test.columns, "p_calibrated", F.lit(method).alias("calibration"))


# ---- weighted, bagged and selected trees ----
def weighted_arm(df: DataFrame, split: str, target: str, kind: str, strength: float = 1.0, bags: int = 3, seed: int = 42, steps: int = STEPS,
                 numeric=NUMERIC, categorical=CATEGORICAL, name: str | None = None) -> DataFrame:
    """R0 plain, R1 condition weights, R2 stressor weights, R3 bags of resampled conditions.

    A bag is a weight: how often the row's condition was drawn, so no row is copied.
    """
    out = []
    for fold in fold_ids(df, split):
        a, b = sides(df, split, fold)
        a = cut(_weights(a, split, kind, strength))
        fa, fb = featurise(a, b, numeric, categorical)
        if kind != "R3_bagged":
            p = trees(target, seed, steps, "weight").fit(fa).transform(fb)
            out.append(tag(p, split, fold, name or kind, "F4_state_log_age_scalar", target, F.col("prediction")))
            continue
        w = cut(cluster_weights(a.select("parameter_set").withColumn("_all", F.lit(0)), ["_all"], "parameter_set", bags, seed))
        parts = []
        for i in range(bags):
            one = fa.drop("weight").join(w.filter(F.col("b") == i).select("parameter_set", F.col("w").cast("double").alias("weight")), "parameter_set")
            parts.append(trees(target, seed + i, steps, "weight").fit(one).transform(fb).select(*KEEP, F.col(target).cast("double").alias(target), "prediction"))
        p = reduce(DataFrame.unionByName, parts).groupBy(*KEEP, target).agg(F.avg("prediction").alias("prediction"))
        out.append(tag(p, split, fold, name or kind, "F4_state_log_age_scalar", target, F.col("prediction")))
    return reduce(DataFrame.unionByName, out)


def _weights(a: DataFrame, split: str, kind: str, strength: float) -> DataFrame:
    if kind == "R1_condition_balanced":
        return balanced_weights(a.withColumn("_all", F.lit(0)), ["_all"], F.col("parameter_set"), strength).drop("_all")
    if kind == "R2_stressor_balanced":
        return balanced_weights(a.withColumn("_all", F.lit(0)), ["_all"], S.stressor_key(F.lit(split)), strength).drop("_all")
    return a.withColumn("weight", F.lit(1.0))


def nested_errors(df: DataFrame, split: str, fold: int, target: str, settings, inner: int = 2, seed: int = 42, steps: int = STEPS) -> DataFrame:
    """Inner-fold condition errors of each setting, on the train side of one outer fold.

    settings: list of (name, kind, strength)
    """
    a, _ = sides(df, split, fold)
    ids = inner_folds(a.withColumn("_all", F.lit(0)), ["_all"], "parameter_set", inner, seed).select("parameter_set", "inner_fold")
    a = cut(a.join(ids, "parameter_set"))
    out = []
    for name, kind, strength in settings:
        p = weighted_arm(a, "inner_fold", target, kind, strength, 2, seed, steps, name=name).filter("heldout_fold >= 0")
        e = p.groupBy("model_level", "heldout_fold", "parameter_set").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("condition_mae"))
        out.append(e.groupBy("model_level").agg(F.avg("condition_mae").alias("mean_condition_mae"), F.max("condition_mae").alias("worst_condition_mae")))
    res = reduce(DataFrame.unionByName, out)
    return res.select(F.lit(split).alias("split_name"), F.lit(fold).alias("heldout_fold"), F.lit(target).alias("target"), F.col("model_level").alias("setting"),
                      "mean_condition_mae", "worst_condition_mae")


def choose(errors: DataFrame, reference: str, policy: str = "worst", limit: float = 0.05) -> DataFrame:
    """Setting per (split, fold, target): least worst-condition error, or best mean error among
    settings whose worst error is within ``limit`` of the reference's."""
    keys = ["split_name", "heldout_fold", "target"]
    ref = errors.filter(F.col("setting") == reference).select(*keys, F.col("worst_condition_mae").alias("_ref"))
    d = errors.join(ref, keys, "left").withColumn("inside", F.coalesce(F.col("worst_condition_mae") <= F.col("_ref") * (1 + limit), F.lit(True)))
    score = (F.struct("worst_condition_mae", "mean_condition_mae", "setting") if policy == "worst"
             else F.struct(F.when(F.col("inside"), 0).otherwise(1), "mean_condition_mae", "setting"))
    return d.groupBy(*keys).agg(F.min_by("setting", score).alias("setting"))


# ---- stacking ----
def out_of_fold(df: DataFrame, split: str, fold: int, aux: str, numeric=NUMERIC, categorical=CATEGORICAL, inner: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Auxiliary value predicted out of fold on the train side and by the full train model on
    the test side; rows without the auxiliary target get the train mean."""
    a, b = sides(df, split, fold)
    ids = inner_folds(a.withColumn("_all", F.lit(0)), ["_all"], "parameter_set", inner, seed).select("parameter_set", "inner_fold")
    a = cut(a.join(ids, "parameter_set"))
    parts = []
    for i in range(inner):
        known = a.filter((F.col("inner_fold") != i) & F.col(aux).isNotNull())
        fa, fb = featurise(known, a.filter(F.col("inner_fold") == i), numeric, categorical)
        parts.append(ridge(fa, aux).transform(fb).select(*a.columns, F.col("prediction").alias("aux_prediction")))
    fa, fb = featurise(a.filter(F.col(aux).isNotNull()), b, numeric, categorical)
    test = ridge(fa, aux).transform(fb).select(*b.columns, F.col("prediction").alias("aux_prediction"))
    return cut(reduce(DataFrame.unionByName, parts)), cut(test)


def stacked(df: DataFrame, split: str, target: str, aux: str, **kw) -> DataFrame:
    """Stage B: the target model gets the out-of-fold auxiliary prediction as a feature."""
    out = []
    for fold in fold_ids(df, split):
        a, b = out_of_fold(df, split, fold, aux, **kw)
        fa, fb = featurise(a, b, [*NUMERIC, "aux_prediction"], CATEGORICAL)
        out.append(tag(ridge(fa, target).transform(fb), split, fold, "stacked_ridge", "D1_auxiliary_state", target, F.col("prediction")))
    return reduce(DataFrame.unionByName, out)


# ---- event sequences: ridges of all splits and folds from one pass of normal equations ----
def _stretched(column, n: int) -> np.ndarray:
    """Arrays of a batch as lines of equal length, zeros at the end."""
    size = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    row = np.repeat(np.arange(n), size)
    out = np.zeros((n, int(size.max()) if n else 0))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _plus(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Sum of two blocks; the one of shorter sequences has zeros in the other's further places."""
    if a is None:
        return b
    big, small = (a, b) if len(a) >= len(b) else (b, a)
    out = big.copy()
    out[:len(small), :len(small)] += small
    return out


def _sequence_fit(block: np.ndarray, places: rg.Layout, alpha: float) -> np.ndarray:
    """Ridge coefficients over (design vector, 0, sequence) from the sums of products of (design vector, target, sequence).

    Numbers and sequence places are standardised by sample deviation, missing numbers count as the mean, flags stay; constant places are left out."""
    p, w, n = len(places.numeric), places.width, block[0, 0]
    turn = []
    for here, at in [(1 + j, 1 + p + j) for j in range(p)] + [(0, j) for j in range(w + 1, len(block))]:
        known, total, square = block[0, here], block[0, at], block[at, at]
        spread = square - total * total / known if known else 0.0
        if n > 1 and spread > 1e-12 * square:
            column = np.zeros(len(block))
            column[at], column[here] = 1.0, -total / known
            turn.append(column / np.sqrt(spread / (n - 1)))
    for j in range(1 + 2 * p, w):
        turn.append(np.eye(1, len(block), j)[0])
    turn = np.array(turn).reshape(-1, len(block)).T
    mean, mean_y = turn.T @ block[0] / n, block[0, w] / n
    gram = turn.T @ block @ turn - n * np.outer(mean, mean)
    beta = np.linalg.solve(gram + alpha * np.eye(len(mean)), turn.T @ block[w] - n * mean * mean_y)
    out = turn @ beta
    out[0] += mean_y - mean @ beta
    return out


def sequence_ridges(panel: DataFrame, target: str, vectors: dict[str, str], numeric=NUMERIC, categorical=CATEGORICAL, alpha: float = 10.0, splits=SPLITS) -> DataFrame:
    """Ridges on scalar features plus a standardised event vector, for every split, held-out fold and vector (vectors = {column: model name}).

    A vector may end before its padding.  Rows are laid out by their folds, tasks add up the products of few fold combinations
    each; the sums of a fold are joined in tasks, a train side is the sum of the other folds, and only coefficients reach the driver."""
    names = list(vectors)
    shift = rg.layout(panel, numeric, [])
    categories = [(c, r["v"]) for c in categorical for r in panel.where(F.col(c).isNotNull()).select(S.group_label(F.col(c)).alias("v")).distinct().orderBy("v").collect()]
    places = rg.Layout(shift.numeric, shift.shift, tuple(categories))
    folds = [f"_{s}" for s in splits]
    z = panel.select(*KEEP, places.column().alias("_z"), S.finite(F.col(target)).alias("_y"), *[F.col(s).cast("int").alias(f) for s, f in zip(splits, folds)], *names).where("_y is not null")
    width, schema = places.width, "vector int, " + ", ".join(f"{f} int" for f in folds) + ", size int, block binary"

    def opened(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                n = batch.num_rows
                x = batch.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                yield batch, x, batch.column("_y").to_numpy(zero_copy_only=False), [_stretched(batch.column(c), n) for c in names]

    def sums(batches):
        held: dict = {}

        def out():
            for (v, key), block in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()), *[pa.array([k], pa.int32()) for k in key], pa.array([len(block)], pa.int32()), pa.array([block.tobytes()], pa.binary())],
                                                 ["vector", *folds, "size", "block"])
            held.clear()
        for batch, x, y, lines in opened(batches):
            keys = list(zip(*(batch.column(f).to_pylist() for f in folds)))
            for key in dict.fromkeys(keys):
                mine = np.array([k == key for k in keys])
                for v, line in enumerate(lines):
                    w = np.column_stack([x[mine], y[mine], line[mine]])
                    held[v, key] = _plus(held.get((v, key)), w.T @ w)
            if sum(b.nbytes for b in held.values()) > rg.HELD_BYTES:
                yield from out()
        yield from out()

    def total(key, frame):
        block = None
        for size, b in zip(frame["size"], frame["block"]):
            block = _plus(block, np.frombuffer(b, float).reshape(size, size))
        return pd.DataFrame([{"vector": int(key[0]), "split_name": key[1], "fold": int(key[2]), "size": len(block), "block": block.tobytes()}])

    def fit(key, frame):
        blocks = {int(f): np.frombuffer(b, float).reshape(n, n) for f, n, b in zip(frame["fold"], frame["size"], frame["block"])}
        found = []
        for fold in sorted(blocks):
            rest = reduce(_plus, (b for f, b in sorted(blocks.items()) if f != fold), None)
            if rest is not None and (key[1] == "condition_fold" or fold != 0):
                found.append((int(key[0]), key[1], fold, _sequence_fit(rest, places, alpha).tolist()))
        return pd.DataFrame(found, columns=["vector", "split_name", "heldout_fold", "coef"])

    parts = max(z.sparkSession.sparkContext.defaultParallelism, z.rdd.getNumPartitions())
    laid = z.select("_z", "_y", *folds, *names, *KEEP).repartitionByRange(parts, *folds, "cell_id", "checkup_k")
    table = cut(laid.select("_z", "_y", *folds, *names).mapInArrow(sums, schema))
    table = stack_splits(table.select("vector", "size", "block", *[F.col(f).alias(s) for s, f in zip(splits, folds)]), splits).where("fold is not null")
    per = table.groupBy("vector", "split_name", "fold").applyInPandas(total, "vector int, split_name string, fold int, size int, block binary")
    models = per.groupBy("vector", "split_name").applyInPandas(fit, "vector int, split_name string, heldout_fold int, coef array<double>").collect()
    shared = z.sparkSession.sparkContext.broadcast([(r["vector"], r["split_name"], r["heldout_fold"], np.array(r["coef"])) for r in sorted(models, key=lambda r: r[:3])])
    kinds = dict(z.dtypes)
    arm = ["split_name", "heldout_fold", "model_level", "feature_group", "target"]
    schema_out = "split_name string, heldout_fold int, model_level string, feature_group string, target string, " + ", ".join(f"{c} {kinds[c]}" for c in KEEP) + ", y_true double, y_pred double"

    def predicted(batches):
        for batch, x, y, lines in opened(batches):
            held = {s: np.array(batch.column(f).fill_null(-1).to_pylist()) for s, f in zip(splits, folds)}
            for v, split, fold, coef in shared.value:
                at = np.flatnonzero(held[split] == fold)
                if not len(at):
                    continue
                line, own = lines[v][at], coef[width + 1:]
                both = min(line.shape[1], len(own))
                p = x[at] @ coef[:width] + line[:, :both] @ own[:both]
                const = [pa.array([c] * len(at), k) for c, k in zip((split, fold, vectors[names[v]], names[v], target), (pa.string(), pa.int32(), *[pa.string()] * 3))]
                yield pa.RecordBatch.from_arrays([*const, *[batch.column(c).take(pa.array(at)) for c in KEEP], pa.array(y[at]), pa.array(p)], [*arm, *KEEP, "y_true", "y_pred"])

    return z.mapInArrow(predicted, schema_out).withColumn("run_scope", F.lit("primary"))


def residualised(df: DataFrame, values, numeric, categorical) -> DataFrame:
    """Least-squares residuals of each value on the controls, as ``<value>_residual``."""
    d, _ = featurise(df, df, numeric, categorical)
    for v in values:
        m = LinearRegression(labelCol=v, featuresCol="features", regParam=0.0, predictionCol=f"_{v}").fit(d)
        d = m.transform(d).withColumn(f"{v}_residual", F.col(v) - F.col(f"_{v}"))
    return d


