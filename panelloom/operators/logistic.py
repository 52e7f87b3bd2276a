"""Logistic arms and probability calibration of every split, fold and target, fitted together.

All models step at once: a pass over the rows adds up each model's gradient and curvature (a vector and a
matrix of fixed size), the driver solves the small systems, and the next pass sees the new coefficients.
The number of passes is that of Newton steps, however many splits, folds, targets and feature sets there
are.  Models are declared by the design, so what is sent to the driver does not grow with the rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalar as S
from ..functions.lineage import cut
from . import ridge as rg
from .splits import SPLITS

STEPS, STOP = 40, 1e-10
FAN = 64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def _summed(rows: DataFrame, schema: str) -> list:
    """One row (model, total) a model from partial rows (model, part, total)."""
    def add(key, frame):
        return pd.DataFrame([{"model": int(frame["model"].iloc[0]), "part": int(key[-1]), "total": np.sum([np.asarray(t, float) for t in frame["total"]], axis=0).tolist()}])

    few = rows.groupBy("model", F.floor(F.col("part") / FAN).cast("int").alias("to")).applyInPandas(add, schema)
    return few.groupBy("model", F.lit(0).alias("to")).applyInPandas(add, schema).collect()


def newton(rows: DataFrame, width: int, rows_of, models: list[dict]) -> list[np.ndarray]:
    """Coefficients of all models by joint Newton steps with step halving.

    ``rows_of(batch)`` gives the batch as (vectors, function of a model to (row numbers, labels)); a model names its
    ``penalty`` matrix and a ``turn`` from design vectors to its features (the first is the constant)."""
    schema = "model int, part int, total array<double>"
    coefs = [np.zeros(m["turn"].shape[1]) for m in models]
    best, open_ = [np.inf] * len(models), list(range(len(models)))
    step = [np.zeros_like(c) for c in coefs]
    for _ in range(STEPS):
        shared = rows.sparkSession.sparkContext.broadcast({i: (models[i], models[i]["turn"] @ coefs[i]) for i in open_})

        def run(batches):
            held, sums, part = shared.value, {}, TaskContext.get().partitionId()
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, pick = rows_of(batch)
                for i, (m, raw) in held.items():
                    at, y = pick(m)
                    if not len(at):
                        continue
                    a = x[at]
                    z = a @ raw
                    p = _sigmoid(z)
                    loss = np.logaddexp(0, z).sum() - y @ z
                    f = a @ m["turn"]
                    total = np.concatenate([[loss, len(at)], f.T @ (p - y), (f.T @ (f * (p * (1 - p))[:, None])).ravel()])
                    sums[i] = sums.get(i, 0) + total
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([part] * len(sums), pa.int32()),
                                                  pa.array([t.tolist() for t in sums.values()], pa.list_(pa.float64()))], ["model", "part", "total"])

        still = []
        for r in _summed(rows.mapInArrow(run, schema), schema):
            i, total = r["model"], np.array(r["total"])
            k, b, penalty = len(coefs[i]), coefs[i], models[i]["penalty"]
            value = total[0] + 0.5 * b @ penalty @ b
            if value > best[i] * (1 + 1e-14) + 1e-14:
                step[i] = step[i] / 2                          # too far: halve the last step
                coefs[i] = coefs[i] - step[i]
                if np.abs(step[i]).max() > STOP:
                    still.append(i)
                continue
            best[i] = value
            grad, curve = total[2:2 + k] + penalty @ b, total[2 + k:].reshape(k, k) + penalty
            step[i] = -np.linalg.lstsq(curve, grad, rcond=1e-12)[0]
            if np.abs(step[i]).max() > STOP:
                coefs[i] = b + step[i]
                still.append(i)
        open_ = still
        if not open_:
            break
    return coefs


def logistic_arms(df: DataFrame, targets, groups: dict[str, tuple], splits=SPLITS, C: float = 1.0, model: str = "B5_logistic", keep=rg.KEEP,
                  leave_out: DataFrame | None = None) -> DataFrame:
    """Probabilities of penalised logistic fits for each (split, held-out fold, target, feature set).

    Features are encoded as in the ridge arms (train side only); the loss is sum of log losses plus |b|^2 / (2 C), the
    constant free.  A train side with one class gives its share.  ``leave_out`` (split_name, heldout_fold, target,
    parameter_set) names conditions that a fit does not see; their rows are predicted too and marked ``calibration``."""
    numeric = list(dict.fromkeys(n for a, _ in groups.values() for n in a))
    categorical = list(dict.fromkeys(c for _, b in groups.values() for c in b))
    places = rg.layout(df, numeric, categorical)
    targets = list(targets)
    z = rg.designed(df, places, targets)
    blocks = rg.blocks(z, targets, splits)
    # a few names for each fit: conditions are set by the design
    aside: dict = {}
    for r in leave_out.select("split_name", "heldout_fold", "target", F.col("parameter_set").cast("string").alias("unit")).collect() if leave_out is not None else []:
        aside.setdefault((r["split_name"], r["heldout_fold"], r["target"]), set()).add(r["unit"])

    def turns(side: rg.Side):
        out = aside.get((side.split, side.fold, side.target), set())
        which = side.train & ~side.units["unit"].isin(out).to_numpy()
        total = side.total(which) if which.any() else None
        if total is None or not total[0, 0]:
            return
        for name, (a, b) in groups.items():
            turn = side.places.encoder(total, a, b)
            yield side.row(model, name, np.r_[total[0, -1] / total[0, 0], turn.ravel()], total[0, 0])

    found = rg.fits(blocks, places, turns, splits).collect()
    z = cut(z.select(*keep, "_z", "_y", F.col("parameter_set").cast("string").alias("_unit"), *[F.col(s).cast("int").alias(f"_{s}") for s in splits]))
    models, constant = [], []
    for r in found:
        share, turn = r["coef"][0], np.array(r["coef"][1:]).reshape(places.width, -1)
        one = np.zeros((places.width, 1))
        one[0] = 1
        m = {"split": r["split_name"], "fold": r["heldout_fold"], "target": targets.index(r["target"]), "group": r["feature_group"], "share": share,
             "turn": np.column_stack([one, turn]), "aside": aside.get((r["split_name"], r["heldout_fold"], r["target"]), set())}
        m["penalty"] = np.diag(np.r_[0.0, np.full(turn.shape[1], 1 / C)])
        (models if 0 < share < 1 else constant).append(m)

    def opened(batch):
        n = batch.num_rows
        x = batch.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        y = batch.column("_y").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)
        fold = {s: np.array([np.nan if v is None else v for v in batch.column(f"_{s}").to_pylist()], float) for s in splits}
        return x, y, fold, np.array(batch.column("_unit").to_pylist(), object)

    def rows_of(batch):
        x, y, fold, unit = opened(batch)

        def pick(m):
            f = fold[m["split"]]
            use = (f != m["fold"]) & ~np.isnan(f) & ~np.isnan(y[:, m["target"]])
            if m["aside"]:
                use &= ~np.isin(unit, list(m["aside"]))
            at = np.flatnonzero(use)
            return at, y[at, m["target"]]
        return x, pick

    coefs = newton(z, places.width, rows_of, models) if models else []
    shared = df.sparkSession.sparkContext.broadcast([(m, m["turn"] @ b) for m, b in zip(models, coefs)] + [(m, None) for m in constant])
    kinds = dict(z.dtypes)
    schema = ("split_name string, heldout_fold int, model_level string, feature_group string, target string, calibration boolean, "
              + ", ".join(f"{c} {kinds[c]}" for c in keep) + ", y_true double, y_pred double")

    def run(batches):
        held = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold, unit = opened(batch)
            for m, raw in held:
                test = fold[m["split"]] == m["fold"]
                left = ~test & np.isin(unit, list(m["aside"])) if m["aside"] else np.zeros(len(test), bool)
                at = np.flatnonzero((test | left) & ~np.isnan(y[:, m["target"]]))
                if not len(at):
                    continue
                p = _sigmoid(x[at] @ raw) if raw is not None else np.full(len(at), m["share"])
                n = len(at)
                const = [pa.array([v] * n, k) for v, k in ((m["split"], pa.string()), (m["fold"], pa.int32()), (model, pa.string()), (m["group"], pa.string()), (targets[m["target"]], pa.string()))]
                yield pa.RecordBatch.from_arrays([*const, pa.array(left[at]), *[batch.column(c).take(pa.array(at)) for c in keep], pa.array(y[at, m["target"]]), pa.array(p)],
                                                 ["split_name", "heldout_fold", "model_level", "feature_group", "target", "calibration", *keep, "y_true", "y_pred"])

    return z.mapInArrow(run, schema)


# ---- calibration of scored probabilities, all groups at once ------------------------------------------------

def platt(base: DataFrame, keys) -> DataFrame:
    """(keys, slope, intercept) of unpenalised logistic fits of y on the logit of p, one for each key of ``base`` (keys, p, y)."""
    keys = list(keys)
    groups = [tuple(r) for r in base.select(*keys).distinct().orderBy(*keys).collect()]
    models = [{"key": g, "turn": np.eye(2), "penalty": np.zeros((2, 2))} for g in groups]
    rows = cut(base.select(*keys, S.logit(F.col("p")).alias("_x"), F.col("y").cast("double").alias("_t")))

    def rows_of(batch):
        key = list(zip(*(batch.column(c).to_pylist() for c in keys)))
        places: dict = {}
        for i, k in enumerate(key):
            places.setdefault(k, []).append(i)
        x = np.column_stack([np.ones(batch.num_rows), batch.column("_x").to_numpy(zero_copy_only=False)])
        y = batch.column("_t").to_numpy(zero_copy_only=False)

        def pick(m):
            at = np.array(places.get(m["key"], []), int)
            return at, y[at]
        return x, pick

    coefs = newton(rows, 2, rows_of, models) if models else []
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*keys).schema) + ", intercept double, slope double"
    return base.sparkSession.createDataFrame([(*m["key"], float(b[0]), float(b[1])) for m, b in zip(models, coefs)], schema)


def _pool(x, mean, weight):
    """Adjacent blocks of falling mean are pooled until means rise; blocks are (largest x, mean, weight)."""
    out: list[list[float]] = []
    for a, m, w in zip(x, mean, weight):
        out.append([a, m, w])
        while len(out) > 1 and out[-2][1] >= out[-1][1]:
            (_, m1, w1), (a2, m2, w2) = out[-2:]
            out[-2:] = [[a2, (m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2]]
    return out


def isotonic(base: DataFrame, keys, chunk_rows: int = 100_000) -> DataFrame:
    """(keys, lo, hi, value): the isotonic fit of y on p of each key as steps; between steps it is interpolated.

    Equal p are folded to one weighted value.  The values of a key are pooled inside chunks along p first, and the
    blocks of consecutive chunks are pooled again, level by level, so no task sees all values of a hot key:
    pooling is associative over consecutive stretches."""
    keys = list(keys)
    folded = cut(base.groupBy(*keys, F.col("p").alias("x")).agg(F.avg(F.col("y").cast("double")).alias("mean"), F.count(F.lit(1)).cast("double").alias("weight")))
    folded = folded.withColumn("lo", F.col("x"))
    most = folded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    chunks = max(1, 1 << max(0, int(np.ceil(np.log2(max(1, most / chunk_rows))))))
    # probabilities lie in 0 to 1; a chunk is an equal stretch, halved levels join neighbours
    blocks = folded.withColumn("chunk", F.least(F.lit(chunks - 1), F.greatest(F.lit(0), F.floor(F.col("x") * chunks))).cast("int"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*keys).schema) + ", lo double, x double, mean double, weight double, chunk int"

    def pooled(key, frame):
        frame = frame.sort_values("x")
        steps = _pool(frame["x"], frame["mean"], frame["weight"])
        starts = dict(zip(frame["x"], frame["lo"]))
        los, at, rows = frame["lo"].to_numpy(), 0, []
        xs = frame["x"].to_numpy()
        for x, m, w in steps:
            rows.append((*[frame[k].iloc[0] for k in keys], float(los[at]), float(x), float(m), float(w), int(key[-1])))
            at = int(np.searchsorted(xs, x, side="right"))
        assert len(starts) == len(frame)
        return pd.DataFrame(rows, columns=[*keys, "lo", "x", "mean", "weight", "chunk"])

    blocks = cut(blocks.select(*keys, "lo", "x", "mean", "weight", "chunk").groupBy(*keys, F.col("chunk").alias("to")).applyInPandas(pooled, schema))
    while chunks > 1:
        chunks //= 2
        blocks = cut(blocks.groupBy(*keys, F.floor(F.col("chunk") / 2).cast("int").alias("to")).applyInPandas(pooled, schema))
    return blocks.select(*keys, "lo", F.col("x").alias("hi"), F.col("mean").alias("value"))


def apply_isotonic(rows: DataFrame, steps: DataFrame, keys) -> DataFrame:
    """``p_calibrated`` of each row: the value of its step, linear between the end of one step and the start of the next, constant outside.

    Rows and step ends are put in one line per key and stretch of p; the nearest ends are carried across stretches."""
    keys = list(keys)
    ends = steps.select(*keys, F.explode(F.array_distinct(F.array(F.struct(F.col("lo").alias("p"), F.col("value").alias("v")), F.struct(F.col("hi").alias("p"), F.col("value").alias("v"))))).alias("e"))
    ends = ends.select(*keys, "e.p", "e.v")
    packed = rows.select(*keys, F.col("p"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))
    line = ends.select(*keys, "p", F.lit(None).cast(packed.schema["_row"].dataType).alias("_row"), F.struct("p", "v").alias("_end")).unionByName(
        packed.withColumn("_end", F.lit(None).cast("struct<p:double,v:double>")))
    line = line.withColumn("_chunk", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("p") * 256))).cast("int"))
    own = line.groupBy(*keys, "_chunk").agg(F.max("_end").alias("_last"), F.min("_end").alias("_first"))
    back, ahead = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    own = own.select(*keys, "_chunk", F.max("_last").over(back).alias("_before"), F.min("_first").over(ahead).alias("_after"))
    # both run from a partition's start to the current row: a frame that ends at the partition's end is added up anew for each row
    up, down = (Window.partitionBy(*keys, "_chunk").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("p").asc(), F.col("p").desc()))
    line = line.join(own, [*keys, "_chunk"]).withColumns({"_l": F.coalesce(F.max("_end").over(up), "_before"), "_r": F.coalesce(F.min("_end").over(down), "_after")})
    l, r, p = F.col("_l"), F.col("_r"), F.col("p")
    value = (F.when(l.isNull(), r["v"]).when(r.isNull(), l["v"]).when(r["p"] <= l["p"], l["v"])
             .otherwise(l["v"] + (r["v"] - l["v"]) * (p - l["p"]) / (r["p"] - l["p"])))
    return line.where("_row is not null").withColumn("p_calibrated", value).select("_row.*", "p_calibrated")


def calibrated(rows: DataFrame, keys, min_class: int = 5) -> DataFrame:
    """Test rows (``calibration`` false) with raw, Platt and isotonic probabilities fitted on the calibration rows of their key.

    rows: keys, p, y, calibration.  A key with fewer than ``min_class`` calibration rows of a class keeps its raw
    probabilities under all three names; ``applied`` tells which map was used."""
    keys = list(keys)
    base, test = rows.where("calibration"), rows.where("not calibration")
    counts = base.groupBy(*keys).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    able = cut(counts.where((F.col("pos") >= min_class) & (F.col("neg") >= min_class)).select(*keys))
    fit = cut(base.join(able, keys, "left_semi"))
    good, bad = test.join(able, keys, "left_semi"), test.join(able, keys, "left_anti")
    line = good.join(platt(fit, keys), keys).withColumn("_z", F.col("intercept") + F.col("slope") * S.logit(F.col("p")))
    scaled = line.withColumn("p_calibrated", F.when(F.col("_z") >= 0, 1 / (1 + F.exp(-F.col("_z")))).otherwise(F.exp("_z") / (1 + F.exp("_z")))).drop("_z", "intercept", "slope")
    stepped = apply_isotonic(good, isotonic(fit, keys), keys)
    raw = lambda d, m, a: d.withColumns({"p_calibrated": F.col("p"), "method": F.lit(m), "applied": F.lit(a)})
    out = raw(good, "raw", "raw").unionByName(scaled.withColumns({"method": F.lit("platt"), "applied": F.lit("platt")}))
    out = out.unionByName(stepped.withColumns({"method": F.lit("isotonic"), "applied": F.lit("isotonic")}))
    for m in ("raw", "platt", "isotonic"):
        out = out.unionByName(raw(bad, m, "raw"))
    return out
