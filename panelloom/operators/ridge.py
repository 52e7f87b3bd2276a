"""Ridge arms of every split, fold, feature set and target from one pass of normal equations.

A row becomes a design vector: 1, a presence flag and a value for each numeric feature (0 where missing), a flag
for each category.  Its outer products with itself and the target, summed per condition, are all that any
ridge fit needs: the train side of a fold is the total of the conditions outside the fold, condition
weights scale the blocks, and mean imputation, scaling and centring are linear maps of a block.  So the
table is read once for all fits and once for their predictions, however many splits, folds, feature sets,
weight settings and inner folds there are.

Blocks are of fixed size and their number is that of the conditions, which the experiment's design sets.
The fits of one (split, held-out fold, target) run in one task on the blocks of all conditions.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..functions.lineage import cut
from .splits import SPLITS, is_heldout, stack_splits

#: Partial blocks that one task adds up.
FAN = 64
#: Bytes of blocks a task holds before it hands them on.
HELD_BYTES = 64 << 20
POOLS = ["nominal_temperature_C", "rate_bucket", "voltage_window_family", "profile_label", "aging_mode"]
MODELS = ("split_name string, heldout_fold int, target string, model_level string, feature_group string, setting string, seed int, "
          "inner_fold int, n double, coef array<double>, offsets map<string,double>")


@dataclass(frozen=True)
class Layout:
    """Places of a design vector: 1, presence of each number, value of each number, categories."""
    numeric: tuple[str, ...]
    shift: tuple[tuple[float, float], ...]
    categories: tuple[tuple[str, str], ...]

    @property
    def width(self) -> int:
        return 1 + 2 * len(self.numeric) + len(self.categories)

    def column(self) -> Column:
        value = [S.finite(F.col(c)) for c in self.numeric]
        return F.array(F.lit(1.0), *[F.when(v.isNotNull(), 1.0).otherwise(0.0) for v in value],
                       *[F.coalesce((v - F.lit(a)) / F.lit(b), F.lit(0.0)) for v, (a, b) in zip(value, self.shift)],
                       *[F.when(S.group_label(F.col(c)) == F.lit(name), 1.0).otherwise(0.0) for c, name in self.categories])

    def encoder(self, block: np.ndarray, numeric, categorical) -> np.ndarray:
        """Linear map of the design vector to the standardised features of a train block (population deviation, 0 counts as 1)."""
        p = len(self.numeric)
        columns = []
        for c in numeric:
            j = self.numeric.index(c)
            here, at = 1 + j, 1 + p + j
            n, s = block[0, here], block[0, at]
            mean = s / n if n else 0.0
            var = block[at, at] / n - mean * mean if n else 0.0
            out = np.zeros(self.width)
            out[at], out[here] = 1.0, -mean
            columns.append(out / (np.sqrt(var) if var > 1e-13 * max(1.0, mean * mean) else 1.0))
        for k, (c, _) in enumerate(self.categories):
            if c in categorical:
                out = np.zeros(self.width)
                out[1 + 2 * p + k] = 1.0
                columns.append(out)
        return np.array(columns).reshape(-1, self.width).T


def layout(df: DataFrame, numeric, categorical) -> Layout:
    """Places, shifts (any constants near mean and deviation do; they only keep sums small) and category lists."""
    stats = df.agg(*[f(S.finite(F.col(c))).alias(f"{n}{i}") for i, c in enumerate(numeric) for n, f in (("a", F.avg), ("s", F.stddev_pop))]).first() if numeric else {}
    shift = tuple((stats[f"a{i}"] or 0.0, stats[f"s{i}"] or 1.0) for i in range(len(numeric)))
    names = []
    for c in categorical:
        names += [(c, r["v"]) for r in df.select(S.group_label(F.col(c)).alias("v")).distinct().orderBy("v").collect()]
    return Layout(tuple(numeric), shift, tuple(names))


def designed(df: DataFrame, places: Layout, targets) -> DataFrame:
    """The rows with ``_z`` (design vector) and ``_y`` (targets, null where not finite)."""
    return df.withColumns({"_z": places.column(), "_y": F.array(*[S.finite(F.col(t)) for t in targets])})


def unit_columns(splits=SPLITS) -> list[Column]:
    """What a block is kept for: the condition, its folds and its stressor attributes."""
    out = [F.col("parameter_set").cast("string").alias("unit")]
    out += [F.col(s).cast("int").alias(s) for s in splits]
    out += [S.group_label(S.c_rate_bucket(F.col("nominal_charge_C_rate")) if c == "rate_bucket" else F.col(c)).alias(c) for c in POOLS]
    return out + [S.stressor_key(F.lit(s)).alias(f"stressor_{i}") for i, s in enumerate(splits)]


def _unit_names(splits=SPLITS) -> list[str]:
    return ["unit", *splits, *POOLS, *[f"stressor_{i}" for i in range(len(splits))]]


def blocks(z: DataFrame, targets, splits=SPLITS) -> DataFrame:
    """One row per unit and target: (unit columns, target, block) with the sums of products of (design, target)."""
    names, targets = _unit_names(splits), list(targets)
    kinds = ["string"] + ["int"] * len(splits) + ["string"] * (len(POOLS) + len(splits))
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", target string, part int, block array<double>"
    arrow = pa.schema([(n, pa.int32() if k == "int" else pa.string()) for n, k in zip(names, kinds)]
                      + [("target", pa.string()), ("part", pa.int32()), ("block", pa.list_(pa.float64()))])

    def run(batches):
        part, held = TaskContext.get().partitionId(), {}

        def out():
            rows = [{**dict(zip(names, key)), "target": t, "part": part, "block": b.ravel().tolist()} for (key, t), b in held.items()]
            held.clear()
            yield from pa.Table.from_pylist(rows, schema=arrow).to_batches(max_chunksize=64)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            y = batch.column("_y").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)
            keys = pd.MultiIndex.from_arrays([batch.column(c).to_pylist() for c in names])
            code, distinct = pd.factorize(keys)
            for u, key in enumerate(distinct):
                mine = code == u
                for t, name in enumerate(targets):
                    rows = mine & ~np.isnan(y[:, t])
                    if rows.any():
                        w = np.column_stack([x[rows], y[rows, t]])
                        key_t = (tuple(None if isinstance(k, float) and np.isnan(k) else k for k in key), name)
                        held[key_t] = held.get(key_t, 0) + w.T @ w
            if held and len(held) * next(iter(held.values())).nbytes > HELD_BYTES:
                yield from out()
        if held:
            yield from out()

    def add(key, frame):
        total = np.sum([np.asarray(b, float) for b in frame["block"]], axis=0)
        first = frame.iloc[0]
        return pd.DataFrame([{**{n: first[n] for n in names}, "target": first["target"], "part": int(key[-1]), "block": total.tolist()}])[[*names, "target", "part", "block"]]

    partial = cut(z.select(*unit_columns(splits), "_z", "_y").mapInArrow(run, schema))
    few = partial.groupBy(*names, "target", F.floor(F.col("part") / FAN).cast("int").alias("to")).applyInPandas(add, schema)
    return cut(few.groupBy(*names, "target", F.lit(0).alias("to")).applyInPandas(add, schema).drop("part"))


# --- fits on blocks (numpy, inside tasks) -----------------------------------------------------------------

def solve(places: Layout, plain: np.ndarray, numeric, categorical, alpha: float = 1.0, weighted: np.ndarray | None = None) -> np.ndarray:
    """Ridge coefficients over the design vector: penalty alpha on the standardised features, none on the constant.

    ``plain`` gives the encoder, ``weighted`` (by default the same) the sums of the fit."""
    block = plain if weighted is None else weighted
    turn = places.encoder(plain, numeric, categorical)
    gram, side, n = block[:-1, :-1], block[:-1, -1], block[0, 0]
    mean = turn.T @ gram[0] / n
    mean_y = side[0] / n
    f = turn.T @ gram @ turn - n * np.outer(mean, mean)
    r = turn.T @ side - n * mean * mean_y
    beta = np.linalg.solve(f + alpha * np.eye(len(f)), r) if len(f) else np.zeros(0)
    out = turn @ beta if len(f) else np.zeros(places.width)
    out[0] += mean_y - mean @ beta if len(f) else mean_y
    return out


def residual_sums(block: np.ndarray, coef: np.ndarray) -> tuple[float, float]:
    """(rows, sum of residuals) of a block under a linear fit."""
    return block[0, 0], block[0, -1] - block[0, :-1] @ coef


def pooled_offsets(units: pd.DataFrame, train: np.ndarray, coef: np.ndarray, strength: float = 5.0, least: int = 3) -> dict[str, float]:
    """Offset of each held-out unit: mean of the shrunk train residual means of the stressor values it shares, else the global mean."""
    sums = np.array([residual_sums(b, coef) for b in units["block"]])
    total = sums[train].sum(axis=0)
    overall = total[1] / total[0] if total[0] else 0.0
    out = {}
    for i in np.flatnonzero(~train):
        hits = []
        for c in POOLS:
            n, s = sums[train & (units[c] == units[c].iloc[i]).to_numpy()].sum(axis=0)
            if n >= least:
                hits.append(s / n * n / (n + strength))
        out[units["unit"].iloc[i]] = float(np.mean(hits)) if hits else float(overall)
    return out


def bias_offsets(units: pd.DataFrame, train: np.ndarray, coef: np.ndarray) -> dict[str, float]:
    """Mean train residual of the units of equal temperature, window and rate bucket, else of all."""
    by = ["nominal_temperature_C", "voltage_window_family", "rate_bucket"]
    sums = np.array([residual_sums(b, coef) for b in units["block"]])
    key = units[by].agg("|".join, axis=1)
    n, s = sums[train].sum(axis=0)
    out = {}
    for i in np.flatnonzero(~train):
        mine = train & (key == key.iloc[i]).to_numpy()
        a, b = sums[mine].sum(axis=0) if mine.any() else (n, s)
        out[units["unit"].iloc[i]] = float(b / a) if a else 0.0
    return out


def group_weights(counts: np.ndarray, group, strength: float) -> np.ndarray:
    """Row weight of each unit: inverse group counts with mean one over the rows, blended as 1 + strength (w - 1)."""
    group = np.asarray(group)
    code, distinct = pd.factorize(group)
    n = np.bincount(code, weights=counts, minlength=len(distinct))
    w = counts.sum() / (n[code] * max(1, len(distinct)))
    return 1 + strength * (w - 1)


def hash_rank(units, seed: int) -> np.ndarray:
    """Place of each unit in md5 order of (seed, unit)."""
    keys = [int(hashlib.md5(f"{seed}|{u}".encode()).hexdigest()[:12], 16) for u in units]
    order = sorted(range(len(keys)), key=lambda i: (keys[i], units[i]))
    rank = np.empty(len(keys), int)
    rank[order] = np.arange(len(keys))
    return rank


class Side:
    """Blocks of the units of one (split, held-out fold, target)."""

    def __init__(self, places: Layout, key, units: pd.DataFrame, split_index: int):
        self.places, self.units = places, units.sort_values("unit").reset_index(drop=True)
        self.split, self.fold, self.target = key
        self.blocks = np.array([np.asarray(b, float).reshape(places.width + 1, -1) for b in self.units["block"]])
        self.units = self.units.assign(block=list(self.blocks))
        self.train = (self.units["fold"] != self.fold).to_numpy()
        self.counts = self.blocks[:, 0, 0]
        self.stressor = self.units[f"stressor_{split_index}"].to_numpy()

    def total(self, which: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.tensordot(weights[which], self.blocks[which], 1) if weights is not None else self.blocks[which].sum(axis=0)

    def weights(self, kind: str, strength: float, which: np.ndarray) -> np.ndarray:
        """Row weights of all units, set on those in ``which``."""
        w = np.ones(len(self.units))
        if kind.startswith("R1"):
            w[which] = group_weights(self.counts[which], self.units["unit"].to_numpy()[which], strength)
        elif kind.startswith("R2"):
            w[which] = group_weights(self.counts[which], self.stressor[which], strength)
        return w

    def row(self, model: str, group: str, coef: np.ndarray, n: float, offsets: dict | None = None, setting: str = "", seed: int = 0, inner: int = -1) -> dict:
        return {"split_name": self.split, "heldout_fold": int(self.fold), "target": self.target, "model_level": model, "feature_group": group, "setting": setting,
                "seed": seed, "inner_fold": inner, "n": float(n), "coef": coef.tolist(), "offsets": offsets}


# --- arms: functions of a Side that give rows of MODELS ----------------------------------------------------

def plain_arms(groups: dict[str, tuple], model: str = "L1_ridge", alpha: float = 1.0):
    """One ridge for each feature set: groups = {name: (numeric, categorical)}."""
    def fit(side: Side):
        total = side.total(side.train)
        for name, (numeric, categorical) in groups.items():
            yield side.row(model, name, solve(side.places, total, numeric, categorical, alpha), total[0, 0])
    return fit


def corrected_arms(groups, model: str = "L1_ridge"):
    """Each ridge, and the same with its train residual means added (bias correction)."""
    def fit(side: Side):
        for r in plain_arms(groups, model)(side):
            yield r
            yield {**r, "model_level": f"{model}_bias_corrected", "offsets": bias_offsets(side.units, side.train, np.array(r["coef"]))}
    return fit


def hierarchical_arms(groups):
    """H0 train mean, H1 ridge, H2 ridge with pooled residual offsets."""
    def fit(side: Side):
        total = side.total(side.train)
        for name, (numeric, categorical) in groups.items():
            yield side.row("H0_global_train_mean", name, solve(side.places, total, [], []), total[0, 0])
            coef = solve(side.places, total, numeric, categorical)
            yield side.row("H1_state_time_ridge", name, coef, total[0, 0])
            yield side.row("H2_partial_pooling_ridge", name, coef, total[0, 0], pooled_offsets(side.units, side.train, coef))
    return fit


def weighted_arms(group: str, numeric, categorical, bags: int = 5, seed: int = 42, strength: float = 1.0):
    """R0 plain, R1 condition weights, R2 stressor weights, R3 mean of fits on conditions drawn with replacement.

    A bag weighs a condition by how often it was drawn; the mean of linear fits is a linear fit."""
    def fit(side: Side):
        total = side.total(side.train)
        for kind in ("R0_reference", "R1_condition_balanced", "R2_stressor_balanced"):
            w = side.weights(kind, strength, side.train)
            yield side.row(kind, group, solve(side.places, total, numeric, categorical, weighted=side.total(side.train, w)), total[0, 0])
        units = side.units["unit"].to_numpy()[side.train]
        coefs = []
        for b in range(bags):
            draws = [int(hashlib.md5(f"{seed}|{b}|{side.split}|{side.fold}|{i}".encode()).hexdigest()[:12], 16) % len(units) for i in range(len(units))]
            w = np.zeros(len(side.units))
            w[np.flatnonzero(side.train)] = np.bincount(draws, minlength=len(units))
            drawn = side.total(side.train, (w > 0).astype(float))
            coefs.append(solve(side.places, drawn, numeric, categorical, weighted=side.total(side.train, w)))
        yield side.row("R3_bagged", group, np.mean(coefs, axis=0), total[0, 0])
    return fit


#: (name, kind, strength) of the declared settings.
SETTINGS = [("R0_reference", "R0", 0.0), ("R1_condition_balanced", "R1", 1.0), ("R2_w0.25", "R2", 0.25), ("R2_w0.5", "R2", 0.5), ("R2_w1", "R2", 1.0)]


def nested_arms(group: str, numeric, categorical, settings=SETTINGS, inner: int = 3, seeds=(42,)):
    """Each setting fitted on all but one inner fold of the train conditions (hash order, round robin), for each seed."""
    def fit(side: Side):
        at = np.flatnonzero(side.train)
        units = side.units["unit"].to_numpy()[at]
        for seed in seeds:
            fold = hash_rank(list(units), seed) % inner
            for i in range(inner):
                which = np.zeros(len(side.units), bool)
                which[at[fold != i]] = True
                if not which.any() or not (fold == i).any():
                    continue
                total = side.total(which)
                checked = {u: 0.0 for u in units[fold == i]}
                for name, kind, strength in settings:
                    w = side.weights(kind, strength, which)
                    coef = solve(side.places, total, numeric, categorical, weighted=side.total(which, w))
                    # the validation units of this fit travel as its offsets
                    yield side.row(kind, group, coef, total[0, 0], checked, name, seed, i)
    return fit


def stacked_arms(aux: str, group: str, numeric, categorical, inner: int = 3, seed: int = 42):
    """Ridge with an auxiliary state as a feature: predicted out of fold on the train side, by the full train fit on the test side.

    The auxiliary prediction is linear in the design vector, so the sums of the second stage follow from the
    blocks of the first.  Sides of the auxiliary target come as ``side.aux``."""
    def fit(side: Side):
        known = side.aux
        fold = hash_rank(list(side.units["unit"]), seed) % inner
        of = dict(zip(side.units["unit"], fold))
        aux_fold = np.array([of.get(u, -1) for u in known.units["unit"]])
        full = known.total(known.train)
        if not full[0, 0] if np.ndim(full) else True:
            return
        width = side.places.width

        def extended(block, coef):
            lift = np.zeros((width + 1, width + 2))
            lift[:width, :width] = np.eye(width)
            lift[:width, width] = coef
            lift[width, width + 1] = 1
            return lift.T @ block @ lift

        total = np.zeros((width + 2, width + 2))
        for i in range(inner):
            rest = known.train & (aux_fold != i)
            stage = known.total(rest) if rest.any() and known.counts[rest].sum() else full
            coef = solve(side.places, stage, numeric, categorical)
            mine = side.train & (fold == i)
            if mine.any():
                total += extended(side.total(mine), coef)
        yield side.row("D0_without_state", group, solve(side.places, side.total(side.train), numeric, categorical), total[0, 0])
        # standardise the extra feature beside the others
        turn = np.zeros((width + 1, 0))
        base = side.places.encoder(total[:width + 1, :width + 1], numeric, categorical)
        n, s, q = total[0, 0], total[0, width], total[width, width]
        mean, var = s / n, q / n - (s / n) ** 2
        extra = np.zeros(width + 1)
        extra[width], extra[0] = 1.0, -mean
        turn = np.column_stack([np.vstack([base, np.zeros((1, base.shape[1]))]), extra / (np.sqrt(var) if var > 1e-13 * max(1.0, mean * mean) else 1.0)])
        gram, rhs = total[:-1, :-1], total[:-1, -1]
        centre, mean_y = turn.T @ gram[0] / n, rhs[0] / n
        f = turn.T @ gram @ turn - n * np.outer(centre, centre)
        beta = np.linalg.solve(f + np.eye(len(f)), turn.T @ rhs - n * centre * mean_y)
        out = turn @ beta
        out[0] += mean_y - centre @ beta
        whole = solve(side.places, full, numeric, categorical)
        yield side.row("D1_auxiliary_state", group, out[:width] + out[width] * whole, n)
    fit.aux = aux
    return fit


# --- the Spark side: fits, predictions, scores -------------------------------------------------------------

def fits(table: DataFrame, places: Layout, arms, splits=SPLITS) -> DataFrame:
    """Rows of MODELS for every split, held-out fold and target of the blocks ``table``; ``arms`` as above."""
    folds = stack_splits(table.select("unit", *splits), splits).select("split_name", F.col("fold").alias("heldout_fold")).distinct()
    folds = folds.where(is_heldout(F.col("split_name"), F.col("heldout_fold")) & F.col("heldout_fold").isNotNull())
    sides = stack_splits(table, splits).where("fold is not null").join(folds, "split_name")
    aux = getattr(arms, "aux", None)
    columns = MODELS.replace("map<string,double>", "map<string|double>").split(", ")
    names = [c.split()[0] for c in columns]

    def run(key, frame):
        split, fold = key[0], int(key[1])
        at = list(splits).index(split)
        found = []
        by = {t: Side(places, (split, fold, t), part, at) for t, part in frame.groupby("target")}
        for t, side in sorted(by.items()):
            if t == aux or side.train.all() or not side.train.any():
                continue
            if aux:
                if aux not in by:
                    continue
                side.aux = by[aux]
            found += list(arms(side))
        return pd.DataFrame(found, columns=names)

    return cut(sides.groupBy("split_name", "heldout_fold").applyInPandas(run, MODELS))


KEEP = ["cell_id", "parameter_set", "checkup_k"]


def predictions(z: DataFrame, models: DataFrame, targets, keep=KEEP, splits=SPLITS) -> DataFrame:
    """Long table of every model's predictions on the rows of its held-out fold.

    The models (a few numbers each, their count set by the design) are sent to the tasks."""
    rows = models.collect()
    shared = z.sparkSession.sparkContext.broadcast([r.asDict() for r in rows])
    targets = list(targets)
    fixed = "split_name string, heldout_fold int, model_level string, feature_group string, target string"
    kinds = dict(z.dtypes)
    schema = f"{fixed}, {', '.join(f'{c} {kinds[c]}' for c in keep)}, y_true double, y_pred double"

    def run(batches):
        held = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            y = batch.column("_y").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)
            unit = np.array(batch.column("unit").to_pylist(), object)
            fold = {s: np.array([-1 if v is None else v for v in batch.column(f"_{s}").to_pylist()]) for s in splits}
            for m in held:
                t = targets.index(m["target"])
                at = np.flatnonzero((fold[m["split_name"]] == m["heldout_fold"]) & ~np.isnan(y[:, t]))
                if not len(at):
                    continue
                p = x[at] @ np.array(m["coef"])
                if m["offsets"]:
                    p = p + np.array([m["offsets"].get(u, 0.0) for u in unit[at]])
                picked = [batch.column(c).take(pa.array(at)) for c in keep]
                const = [pa.array([m[c]] * len(at), k) for c, k in (("split_name", pa.string()), ("heldout_fold", pa.int32()), ("model_level", pa.string()),
                                                                    ("feature_group", pa.string()), ("target", pa.string()))]
                yield pa.RecordBatch.from_arrays([*const, *picked, pa.array(y[at, t]), pa.array(p)],
                                                 ["split_name", "heldout_fold", "model_level", "feature_group", "target", *keep, "y_true", "y_pred"])

    d = z.select(*keep, "_z", "_y", F.col("parameter_set").cast("string").alias("unit"), *[F.col(s).cast("int").alias(f"_{s}") for s in splits])
    return d.mapInArrow(run, schema).withColumn("run_scope", F.lit("primary"))


def nested_scores(z: DataFrame, models: DataFrame, targets) -> DataFrame:
    """Mean and worst condition error of each setting over the inner folds: one row per (split, fold, target, seed, setting)."""
    rows = models.collect()
    shared = z.sparkSession.sparkContext.broadcast([r.asDict() for r in rows])
    targets = list(targets)

    def run(batches):
        held = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            y = batch.column("_y").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)
            code, units = pd.factorize(np.array(batch.column("unit").to_pylist(), object))
            found = {"model": [], "unit": [], "total": [], "n": []}
            for i, m in enumerate(held):
                t = targets.index(m["target"])
                checked = np.array([u in m["offsets"] for u in units], bool)
                at = np.flatnonzero(checked[code] & ~np.isnan(y[:, t]))
                if not len(at):
                    continue
                e = np.abs(x[at] @ np.array(m["coef"]) - y[at, t])
                total, count = np.bincount(code[at], weights=e, minlength=len(units)), np.bincount(code[at], minlength=len(units))
                for u in np.flatnonzero(count):
                    for c, v in zip(found.values(), (i, units[u], total[u], count[u])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(found["model"], pa.int32()), pa.array(found["unit"], pa.string()), pa.array(found["total"], pa.float64()),
                                              pa.array(found["n"], pa.int64())], list(found))

    sums = z.select("_z", "_y", F.col("parameter_set").cast("string").alias("unit")).mapInArrow(run, "model int, unit string, total double, n long")
    sums = sums.groupBy("model", "unit").agg((F.sum("total") / F.sum("n")).alias("condition_mae"))
    names = z.sparkSession.createDataFrame([(i, r["split_name"], r["heldout_fold"], r["target"], r["seed"], r["setting"], r["inner_fold"]) for i, r in enumerate(rows)],
                                           "model int, split_name string, heldout_fold int, target string, seed int, setting string, inner_fold int")
    keys = ["split_name", "heldout_fold", "target", "seed", "setting"]
    per = sums.join(names, "model").groupBy(*keys, "inner_fold").agg(F.avg("condition_mae").alias("fold_mae"), F.max("condition_mae").alias("fold_worst"))
    return cut(per.groupBy(*keys).agg(F.avg("fold_mae").alias("mean_condition_mae"), F.max("fold_worst").alias("worst_condition_mae"),
                                      F.map_from_entries(F.collect_list(F.struct("inner_fold", "fold_mae"))).alias("by_fold")))


def adaptive_selection(scores: DataFrame, policy: str, limit: float = 0.02, reference: str = "R0_reference") -> DataFrame:
    """The setting that a policy picks per (split, fold, target, seed), with gain and worst degradation against the reference.

    max_gain_guarded: the largest mean gain among the settings whose error grows by at most ``limit`` in any inner
    fold and that gain on average; conservative_guarded: the weakest such setting.  Without one, the least degradation."""
    keys = ["split_name", "heldout_fold", "target", "seed"]
    ref = scores.where(F.col("setting") == reference).select(*keys, F.col("by_fold").alias("ref"))
    d = scores.where(F.col("setting") != reference).join(ref, keys)
    gains = F.transform(F.map_keys("ref"), lambda k: F.struct((F.element_at("ref", k) - F.element_at("by_fold", k)).alias("gain"),
                                                              F.when(F.element_at("ref", k) > 0, (F.element_at("by_fold", k) - F.element_at("ref", k)) / F.element_at("ref", k)).alias("loss")))
    d = d.withColumn("_g", gains).withColumns({"mean_gain": F.aggregate("_g", F.lit(0.0), lambda a, g: a + g["gain"]) / F.size("_g"),
                                               "max_degradation": F.array_max(F.transform("_g", lambda g: g["loss"]))})
    gain = F.round("mean_gain", 9)
    d = d.withColumn("guarded", F.coalesce((F.col("max_degradation") <= limit) & (gain > 0), F.lit(False)))
    late = F.coalesce(F.round("max_degradation", 9), F.lit(float("inf")))
    first = F.struct(F.when(F.col("guarded"), 0).otherwise(1), F.when(F.col("guarded"), -gain).otherwise(late), late, "setting") if policy == "max_gain_guarded" else \
        F.struct(F.when(F.col("guarded"), 0).otherwise(1), F.col("setting"), late)
    best = F.min_by(F.struct("setting", "mean_gain", "max_degradation", "guarded"), first)
    return d.groupBy(*keys).agg(best.alias("b")).select(*keys, F.lit(policy).alias("policy"), "b.*")


def chosen(scores: DataFrame, policy: str = "worst", limit: float = 0.05, reference: str = "R0_reference") -> DataFrame:
    """Setting per (split, fold, target, seed): least worst-condition error, or best mean error among those whose worst
    is within ``limit`` of the reference's."""
    keys = ["split_name", "heldout_fold", "target", "seed"]
    ref = scores.where(F.col("setting") == reference).select(*keys, F.col("worst_condition_mae").alias("_ref"))
    d = scores.join(ref, keys, "left").withColumn("inside", F.coalesce(F.col("worst_condition_mae") <= F.col("_ref") * (1 + limit), F.lit(True)))
    # settings that differ by rounding only are tied
    worst, mean = F.round("worst_condition_mae", 9), F.round("mean_condition_mae", 9)
    score = F.struct(worst, mean, "setting") if policy == "worst" else F.struct(F.when(F.col("inside"), 0).otherwise(1), mean, "setting")
    return d.groupBy(*keys).agg(F.min_by(F.struct("setting", "mean_condition_mae", "worst_condition_mae"), score).alias("b")).select(*keys, "b.*")


def run(df: DataFrame, targets, arms, numeric, categorical, splits=SPLITS, extra_targets=()) -> tuple[DataFrame, DataFrame]:
    """(predictions, models) of the arms on all splits and folds of ``df``; ``extra_targets`` only serve as auxiliary states."""
    everything = [*targets, *extra_targets]
    places = layout(df, numeric, categorical)
    z = designed(df, places, everything)
    models = fits(blocks(z, everything, splits), places, arms, splits)
    return predictions(z, models, everything, splits=splits), models


def run_nested(df: DataFrame, targets, arms, numeric, categorical, splits=SPLITS) -> DataFrame:
    places = layout(df, numeric, categorical)
    z = designed(df, places, targets)
    return nested_scores(z, fits(blocks(z, targets, splits), places, arms, splits), targets)
