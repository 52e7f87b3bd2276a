"""Boosted trees of every split, held-out fold, target and weight setting, grown together.

Features are cut into bins once (quantiles of the table; missing values have a bin of their own).  One pass over
the rows adds up, for all models at once, the gradient and weight of each (node, feature, bin) of the level
that is being grown; tasks add up the parts of a model and pick the best cut of each node, the driver takes note of the
cuts, and the next pass sees the grown trees.  Rows are scored on lines of bits, and features are counted in groups by joint
bins, so that a pass costs a model a few operations a tree and a group.  The number of passes is steps times depth, however many models there are, and
what is sent to the driver is a few numbers a node.
"""
from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as S
from ..functions.lineage import cut
from ..functions.ordered import quantiles
from . import ridge as rg
from .splits import SPLITS, is_heldout, stack_splits

STEPS, DEPTH, RATE, LEAST_ROWS = 50, 3, 0.1, 20
BINS = 32
#: Rows of a stored chunk, of the blocks it is worked on in, and of the pieces that are dealt to the partitions.
CHUNK, BLOCK, SMALL = 262144, 65536, 512
#: Trees whose leaves are looked up at once (an even number), the key of a cut that no bin exceeds, joint bins of a group of features.
TOGETHER, NO_CUT, JOINT_BINS = 4, 255, 2048


@dataclass
class Model:
    split: str
    fold: int
    target: int
    setting: str = ""
    #: Weight of the rows of a unit on the train side; all 1 if None.
    weights: dict | None = None
    base: float = 0.0
    trees: list = field(default_factory=list)


def binned(df: DataFrame, numeric, categorical, targets, keep=rg.KEEP, splits=SPLITS) -> tuple[DataFrame, int]:
    """Stored rows with ``_b`` (bins), ``_y``, ``_unit``, folds and ``keep``; and the number of features."""
    edges: dict[str, list[float]] = {}
    if numeric:
        share = [i / BINS for i in range(1, BINS)]
        row = df.agg(*[F.percentile_approx(S.finite(F.col(c)), share, 10_000).alias(f"q{i}") for i, c in enumerate(numeric)]).first()
        edges = {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(numeric)}
    columns = []
    for c in numeric:
        v, e = S.finite(F.col(c)), F.array(*[F.lit(float(x)) for x in edges[c]]).cast("array<double>")
        columns.append(F.when(v.isNull(), 0).otherwise(1 + F.size(F.filter(e, lambda x, v=v: x < v))))
    for c in categorical:
        names = [r["v"] for r in df.select(S.group_label(F.col(c)).alias("v")).distinct().orderBy("v").collect()]
        columns += [F.when(S.group_label(F.col(c)) == F.lit(n), 1).otherwise(0) for n in names]
    out = df.select(*keep, F.array(*[c.cast("int") for c in columns]).alias("_b"), F.array(*[S.finite(F.col(t)) for t in targets]).alias("_y"),
                    F.col("parameter_set").cast("string").alias("_unit"), *[F.col(s).cast("int").alias(f"_{s}") for s in splits])
    return cut(out), len(columns)


def _turns(over, levels: int) -> list[np.ndarray]:
    """For each level of a tree in heap order, which rows go right; ``over(n)`` tells which rows exceed the cut of node ``n``."""
    turns: list[np.ndarray] = []
    for level in range(levels):
        found = [over(2 ** level - 1 + k) for k in range(2 ** level)]
        for t in reversed(turns):
            found = [a ^ (t & (a ^ b)) for a, b in zip(found[::2], found[1::2])]
        turns.append(found[0])
    return turns


def _route(bins: np.ndarray, feature: np.ndarray, at: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row among the nodes after ``levels`` levels of one tree; a row goes right if its bin exceeds the cut.

    ``bins`` has a line for each feature, so that a cut is one comparison along a line."""
    node = np.zeros(bins.shape[1], np.uint8)
    for right in _turns(lambda n: bins[feature[n]] > at[n] if feature[n] >= 0 else np.zeros(bins.shape[1], bool), levels):
        node = 2 * node + right
    return node


class Forest:
    """Scores of grown trees: (models, trees, nodes) features (-1: no cut) and cuts, (models, trees, leaves) values, a base for each model.

    The rows that exceed a cut are a line of bits, made once for all trees with that cut, so that a tree's turns are a few
    operations on words of 64 rows.  The leaves of TOGETHER trees make one code, whose sum of values is looked up at once.
    A model's trees with the same cuts are one tree with the sums of their values."""

    def __init__(self, feature, at, value, base):
        self.base, self.value, trees = base, [], []
        for key, leaves in zip(np.where(feature < 0, NO_CUT, feature * 256 + at), value):
            distinct, same = np.unique(key, axis=0, return_inverse=True)
            spare = ((0, -len(distinct) % TOGETHER), (0, 0))
            sums = np.zeros((len(distinct), leaves.shape[1]))
            np.add.at(sums, same.ravel(), leaves)
            trees.append(np.pad(distinct, spare, constant_values=NO_CUT))
            self.value.append(np.pad(sums, spare))
        self.cuts = np.unique(np.concatenate(trees)) if trees else np.zeros(0, int)
        self.place = [np.searchsorted(self.cuts, t) for t in trees]

    def planes(self, bins: np.ndarray) -> np.ndarray:
        """A line of words for each cut."""
        n = bins.shape[1]
        out = np.zeros((len(self.cuts), -(-n // 64) * 8), np.uint8)
        of, at = np.divmod(self.cuts, 256)
        for f in np.unique(of):
            which = np.flatnonzero(of == f)
            out[which, :-(-n // 8)] = np.packbits(bins[f] > at[which, None].astype(np.uint8), axis=1)
        return out.view(np.uint64)

    def score(self, i: int, planes: np.ndarray, n: int) -> np.ndarray:
        out, half = np.full(planes.shape[1] * 64, float(self.base[i])), TOGETHER // 2 * DEPTH
        found = np.empty_like(out)
        turns = np.stack(_turns(lambda k: planes.take(self.place[i][:, k], axis=0), DEPTH), axis=1)
        for j in range(0, len(turns), TOGETHER):
            bits = np.unpackbits(turns[j:j + TOGETHER].reshape(2 * half, -1).view(np.uint8), axis=1).view(np.uint64).reshape(2, half, -1)
            code = bits[:, 0]
            for x in range(1, half):
                code <<= np.uint64(1)
                code |= bits[:, x]
            first, second = code.view(np.uint8)
            index = first.astype(np.uint16)
            index <<= half
            index |= second
            sums = self.value[i][j]
            for v in self.value[i][j + 1:j + TOGETHER]:
                sums = (sums[:, None] + v).ravel()
            out += sums.take(index, mode="clip", out=found)
        return out[:n]


def forest(models: list[Model]) -> Forest:
    """The trees of finished models."""
    trees, inner = max((len(m.trees) for m in models), default=0), 2 ** DEPTH - 1
    feature, at, value = (np.full((len(models), trees, k), v, t) for k, v, t in ((inner, -1, np.int64), (inner, 0, np.int64), (inner + 1, 0.0, float)))
    for i, m in enumerate(models):
        for t, tree in enumerate(m.trees):
            feature[i, t], at[i, t], value[i, t] = tree
    return Forest(feature, at, value, np.array([m.base for m in models]))


def _gradients(loss: str, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Gradient and curvature; None: 1 a row."""
    if loss == "square":
        return score - y, None
    p = 1 / (1 + np.exp(-score))
    return p - y, np.maximum(p * (1 - p), 1e-12)


def _opened(batch, splits):
    n = batch.num_rows
    bins = np.ascontiguousarray(batch.column("_b").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.uint8).T)
    y = batch.column("_y").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)
    fold = {s: batch.column(f"_{s}").cast(pa.float64()).to_numpy(zero_copy_only=False) for s in splits}
    return bins, y, fold, np.array(batch.column("_unit").to_pylist(), object)


@dataclass
class Chunk:
    """Rows of a pass: a line of bins for each feature, of ``y`` for each target, of folds for each split; ``code`` numbers ``units``."""
    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    code: np.ndarray
    units: list


def packed(rows: DataFrame, splits=SPLITS) -> DataFrame:
    """The rows as stored chunks of up to CHUNK rows, one partition a core or more: a pass reads bytes, nothing is decoded row by row."""
    schema = "bins binary, y binary, fold binary, code binary, units array<string>"

    def records(chunks):
        for c in chunks:
            yield pa.RecordBatch.from_arrays([*[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (c.bins, c.y, c.fold, c.code)], pa.array([c.units], pa.list_(pa.string()))],
                                             ["bins", "y", "fold", "code", "units"])

    def pack(batches):
        def small():
            for batch in batches:
                for at in range(0, batch.num_rows, SMALL):
                    bins, y, fold, unit = _opened(batch.slice(at, SMALL), splits)
                    code, units = pd.factorize(unit, use_na_sentinel=False)
                    yield Chunk(bins, y.T, np.array([fold[s] for s in splits]), code.astype(np.int32), list(units))
        yield from records(small())

    def merge(batches):
        def large():
            held, n = [], 0
            for c in _chunks(batches, len(splits)):
                if held and n + len(c.code) > CHUNK:
                    yield joined(held)
                    held, n = [], 0
                held.append(c)
                n += len(c.code)
            if held:
                yield joined(held)

        def joined(held):
            place = {u: k for k, u in enumerate(dict.fromkeys(u for c in held for u in c.units))}
            return Chunk(*[np.concatenate([getattr(c, k) for c in held], axis=1) for k in ("bins", "y", "fold")],
                         np.concatenate([np.array([place[u] for u in c.units], np.int32).take(c.code) for c in held]), list(place))
        yield from records(large())

    cores = rows.sparkSession.sparkContext.defaultParallelism
    small = rows.select("_b", "_y", "_unit", *[f"_{s}" for s in splits]).mapInArrow(pack, schema)
    return cut(small.repartition(cores).mapInArrow(merge, schema))


def _chunks(batches, splits: int):
    for batch in batches:
        for r in range(batch.num_rows):
            code = np.frombuffer(batch.column("code")[r].as_buffer(), np.int32)
            y, fold = (np.frombuffer(batch.column(k)[r].as_buffer(), float).reshape(-1, len(code)) for k in ("y", "fold"))
            yield Chunk(np.frombuffer(batch.column("bins")[r].as_buffer(), np.uint8).reshape(-1, len(code)), y, fold, code, batch.column("units")[r].as_py())


def _parts(chunk: Chunk, models: dict[int, Model], splits):
    """(rows, sides) for the targets known on the same rows: a side is the places of its train rows and the numbers of its models."""
    known: dict = {}
    for i, m in models.items():
        known.setdefault(m.target, []).append(i)
    parts: dict = {}
    for target, members in known.items():
        here = ~np.isnan(chunk.y[target])
        parts.setdefault(here.tobytes(), (here, []))[1].extend(members)
    for here, members in parts.values():
        rows = np.flatnonzero(here)
        sides: dict = {}
        for i in members:
            sides.setdefault((models[i].split, models[i].fold), []).append(i)
        for first in range(0, len(rows), BLOCK):
            at = rows[first:first + BLOCK]
            part = chunk if len(at) == len(here) else Chunk(*[getattr(chunk, k).take(at, axis=1, mode="clip") for k in ("bins", "y", "fold")], chunk.code.take(at), chunk.units)
            train = [(_outside(part.fold[list(splits).index(split)], fold), own) for (split, fold), own in sides.items()]
            yield part, [(at, own) for at, own in train if len(at)]


def _outside(folds: np.ndarray, fold: int) -> np.ndarray:
    return np.flatnonzero((folds != fold) & ~np.isnan(folds))


def _weighed(m: Model, part: Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The rows at ``at`` that have a weight in the model, and the weights; None if all are 1."""
    if m.weights is None:
        return at, None
    w = np.array([m.weights.get(u, 0.0) for u in part.units]).take(part.code.take(at, mode="clip"), mode="clip")
    if not (w > 0).all():
        at, w = at[w > 0], w[w > 0]
    return at, None if (w == 1).all() else w


def _totals(chunks: DataFrame, function, finish, splits=SPLITS) -> dict[int, np.ndarray]:
    """``finish`` of the total of ``function(chunk)`` = {model: array} over all chunks; totals are added up and finished in tasks."""
    def run(batches):
        held: dict = {}
        for chunk in _chunks(batches, len(splits)):
            for i, total in function(chunk):
                held[i] = held.get(i, 0) + total
        for i, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["model", "total"])

    def add(batches):
        held: dict = {}
        for batch in batches:
            for i, total in zip(batch.column("model").to_pylist(), batch.column("total")):
                held[i] = held.get(i, 0) + np.frombuffer(total.as_buffer(), float)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.asarray(finish(t), float).tolist() for t in held.values()], pa.list_(pa.float64()))], ["model", "found"])

    cores = chunks.sparkSession.sparkContext.defaultParallelism
    out = chunks.mapInArrow(run, "model int, total binary").repartition(cores, "model").mapInArrow(add, "model int, found array<double>")
    return {r["model"]: np.array(r["found"]) for r in out.collect()}


def _best(hist: np.ndarray, least: float):
    """(feature, cut, left sums, right sums) of one node's sums (gradient, curvature, rows) by feature and bin; None without a gain."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist.sum(axis=2)[:, :1, None]
    right = total - left
    value = lambda s: np.where(s[1] > 0, s[0] ** 2 / np.maximum(s[1], 1e-300), 0.0)
    gain = value(left) + value(right) - value(total)
    gain = np.where((left[2] >= least) & (right[2] >= least), gain, -1.0)
    # the first of equal gains, so that the order of partial sums does not decide
    f, b = np.unravel_index(int((gain >= gain.max() * (1 - 1e-9)).argmax()) if gain.max() > 0 else 0, gain.shape)
    return (int(f), int(b), left[:, f, b], right[:, f, b]) if gain[f, b] > 1e-12 else None


def _joint(bins: np.ndarray) -> tuple[list, np.ndarray]:
    """Features put together as long as their joint bins stay few: [(features, bins of each)] and a line of joint bins for each group."""
    size = bins.max(axis=1).astype(int) + 1
    groups: list[list[int]] = []
    for f in np.argsort(-size, kind="stable"):
        g = min(groups, key=lambda g: math.prod(size[g]), default=None)
        if g is not None and math.prod(size[g]) * size[f] <= JOINT_BINS:
            g.append(int(f))
        else:
            groups.append([int(f)])
    lines = np.zeros((len(groups), bins.shape[1]), np.intp)
    for g, line in zip(groups, lines):
        for f in g:
            line *= size[f]
            line += bins[f]
    return [(g, [int(size[f]) for f in g]) for g in groups], lines


def _spread(table: np.ndarray, sizes: list[int]):
    """Sums by the bins of each feature of a group from the sums by their joint bins (the last axis)."""
    if len(sizes) == 1:
        yield table
        return
    half = len(sizes) // 2
    both = table.reshape(len(table), math.prod(sizes[:half]), -1)
    yield from _spread(np.add.reduce(both, axis=2), sizes[:half])
    yield from _spread(np.add.reduce(both, axis=1), sizes[half:])


def _histograms(groups, lines: np.ndarray, node: np.ndarray | None, nodes: int, values, features: int) -> np.ndarray:
    """Sums of each of ``values`` (None: 1 a row) by (node, feature, bin); ``lines`` are joint bins."""
    out = np.zeros((len(values) * nodes, features, BINS + 1))
    place, first = np.empty(lines.shape[1], np.intp), {}
    for (members, sizes), line in zip(groups, lines):
        n = math.prod(sizes)
        if node is not None:
            if n not in first:
                first[n] = node * n
            line = np.add(line, first[n], out=place)
        table = np.array([np.bincount(line, weights=v, minlength=n * nodes) for v in values], float).reshape(len(out), n)
        for f, k, found in zip(members, sizes, _spread(table, sizes)):
            out[:, f, :k] = found
    return out.reshape(len(values), nodes, features, -1)


def grow(rows: DataFrame, features: int, models: list[Model], loss: str = "square", steps: int = STEPS, splits=SPLITS) -> list[Model]:
    """Grow ``steps`` trees of DEPTH levels for each model."""
    if not models:
        return models
    chunks, send = packed(rows, splits), rows.sparkSession.sparkContext.broadcast
    every = send(dict(enumerate(models)))

    def means(chunk):
        for part, sides in _parts(chunk, every.value, splits):
            for side, members in sides:
                for i in members:
                    at, w = _weighed(every.value[i], part, side)
                    y = part.y[every.value[i].target][at]
                    if len(y):
                        yield i, np.array([y.sum(), len(y)] if w is None else [w @ y, w.sum()], float)

    open_ = []
    for i, t in sorted(_totals(chunks, means, lambda t: t, splits).items()):
        mean = t[0] / t[1]
        models[i].base = mean if loss == "square" else (np.log(mean / (1 - mean)) if 0 < mean < 1 else (-40.0 if mean <= 0 else 40.0))
        if loss == "square" or 0 < mean < 1:
            open_.append(i)
    width, inner, least, place = BINS + 1, 2 ** DEPTH - 1, LEAST_ROWS, {i: k for k, i in enumerate(open_)}
    base = np.array([models[i].base for i in open_])
    feature, at_bin = np.full((len(open_), steps, inner), -1), np.zeros((len(open_), steps, inner), np.int64)
    value = np.zeros((len(open_), steps, inner + 1))
    for step in range(steps if open_ else 0):
        for level in range(DEPTH):
            shared = send((Forest(feature[:, :step], at_bin[:, :step], value[:, :step], base), feature[:, step], at_bin[:, step]))
            nodes, first = 2 ** level, 2 ** level - 1

            def histograms(chunk):
                (trees, new, new_at), held = shared.value, every.value
                for part, sides in _parts(chunk, {i: held[i] for i in open_}, splits):
                    planes, n = trees.planes(part.bins), len(part.code)
                    groups, lines = _joint(part.bins)
                    for side, members in sides:
                        mine = lines if len(side) == n else lines.take(side, axis=1, mode="clip")
                        for i in members:
                            at, w = _weighed(held[i], part, side)
                            if not len(at):
                                continue
                            own = mine if len(at) == len(side) else lines.take(at, axis=1, mode="clip")
                            k = place[i]
                            g, h = _gradients(loss, trees.score(k, planes, n).take(at, mode="clip"), part.y[held[i].target].take(at, mode="clip"))
                            node = _route(part.bins, new[k], new_at[k], level).take(at, mode="clip").astype(np.intp) if level else None
                            if w is not None:
                                g, h = w * g, w * h if h is not None else w
                            sums = _histograms(groups, own, node, nodes, (g, None) if h is None else (g, h, None), features)
                            yield i, sums if loss == "square" and held[i].weights is None else sums[[0, 1, len(sums) - 1]]

            def cuts(total):
                """For each node: feature (-1: no cut, -2: no rows), cut, sums of either side."""
                hist, out = total.reshape(-1, nodes, features, width), np.zeros((nodes, 8))
                hist = hist[[0, 1, -1]]     # plain rows have curvature 1
                for n in range(nodes):
                    if not hist[2, n].any():
                        out[n, 0] = -2
                        continue
                    found = _best(hist[:, n], least)
                    out[n] = [*found[:2], *found[2], *found[3]] if found else [-1, 0, *hist[:, n, 0].sum(axis=1), 0, 0, 0]
                return out.ravel()

            for i, found in _totals(chunks, histograms, cuts, splits).items():
                k = place[i]
                for n, (f, at, *sums) in enumerate(found.reshape(nodes, 8)):
                    if f >= 0:
                        feature[k, step, first + n], at_bin[k, step, first + n] = int(f), int(at)
                    if f > -2 and level == DEPTH - 1:
                        for leaf, s in enumerate((sums[:3], sums[3:])):
                            value[k, step, 2 * n + leaf] = -RATE * s[0] / s[1] if s[1] > 0 else 0.0
            shared.destroy()
    for i, k in place.items():
        models[i].trees = list(zip(feature[k], at_bin[k], value[k]))
    every.destroy()
    return models


def declared(rows: DataFrame, targets, splits=SPLITS) -> list[Model]:
    """One model for each split, held-out fold and target."""
    folds = stack_splits(rows.select(*[F.col(f"_{s}").alias(s) for s in splits]).distinct(), splits).select("split_name", "fold").distinct()
    folds = folds.where(is_heldout(F.col("split_name"), F.col("fold")) & F.col("fold").isNotNull()).orderBy("split_name", "fold").collect()
    return [Model(r["split_name"], r["fold"], t) for r in folds for t in range(len(targets))]


def weighted(table: DataFrame, places: rg.Layout, targets, bags: int = 3, seed: int = 42, strength: float = 1.0, splits=SPLITS) -> list[Model]:
    """The models of all sides in the settings R0 plain, R1 condition weights, R2 stressor weights and R3 bags (one model a bag)."""
    def weigh(side: rg.Side):
        units = side.units["unit"].to_numpy()
        for kind in ("R0_reference", "R1_condition_balanced", "R2_stressor_balanced"):
            w = side.weights(kind, strength, side.train)
            yield side.row(kind, "", np.zeros(1), 0, {u: float(x) for u, x in zip(units[side.train], w[side.train])})
        own = units[side.train]
        for b in range(bags):
            drawn: dict = {}
            for i in range(len(own)):
                u = own[int(hashlib.md5(f"{seed}|{b}|{side.split}|{side.fold}|{i}".encode()).hexdigest()[:12], 16) % len(own)]
                drawn[u] = drawn.get(u, 0.0) + 1.0
            yield side.row("R3_bagged", "", np.zeros(1), 0, drawn, seed=b)
    out = []
    for r in rg.fits(table, places, weigh, splits).collect():
        out.append(Model(r["split_name"], r["heldout_fold"], list(targets).index(r["target"]), f"{r['model_level']}|{r['seed']}", r["offsets"]))
    return sorted(out, key=lambda m: (m.split, m.fold, m.target, m.setting))


def predictions(rows: DataFrame, models: list[Model], targets, level, group: str, loss: str = "square", keep=rg.KEEP, splits=SPLITS, train: bool = False) -> DataFrame:
    """Long table of predictions on the held-out folds (or on the train sides of models without weights); ``level(model)`` names the arm.

    Models of one arm, split, fold and target give one prediction, their mean."""
    sides: dict = {}
    for m in models:
        sides.setdefault((m.split, m.fold, m.target), []).append(m)
    link = (lambda s: 1 / (1 + np.exp(-s))) if loss == "log" else lambda s: s
    sent = [(forest(own), own, [level(m) for m in own]) for own in sides.values()]
    shared = rows.sparkSession.sparkContext.broadcast(sent)
    kinds, targets = dict(rows.dtypes), list(targets)
    schema = ("split_name string, heldout_fold int, model_level string, feature_group string, target string, "
              + ", ".join(f"{c} {kinds[c]}" for c in keep) + ", y_true double, y_pred double")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y, fold, _ = _opened(batch, splits)
            for trees, own, names in shared.value:
                m, f = own[0], fold[own[0].split]
                at = np.flatnonzero(((f != m.fold) & ~np.isnan(f) if train else f == m.fold) & ~np.isnan(y[:, m.target]))
                if not len(at):
                    continue
                planes, kept = trees.planes(bins.take(at, axis=1, mode="clip")), None
                for name in dict.fromkeys(names):
                    arm = [k for k, other in enumerate(names) if other == name]
                    p = sum(link(trees.score(k, planes, len(at))) for k in arm) / len(arm)
                    kept = kept or [*[batch.column(c).take(pa.array(at)) for c in keep], pa.array(y[at, m.target])]
                    const = [pa.repeat(pa.scalar(v, k), len(at)) for v, k in ((m.split, pa.string()), (m.fold, pa.int32()), (name, pa.string()), (group, pa.string()), (targets[m.target], pa.string()))]
                    yield pa.RecordBatch.from_arrays([*const, *kept, pa.array(p)], ["split_name", "heldout_fold", "model_level", "feature_group", "target", *keep, "y_true", "y_pred"])

    return rows.mapInArrow(run, schema).withColumn("run_scope", F.lit("primary"))


def run_trees(df: DataFrame, targets, numeric, categorical, group: str, model: str = "L2_trees", quantile_model: str | None = None, loss: str = "square",
              steps: int = STEPS, keep=rg.KEEP, splits=SPLITS) -> DataFrame:
    """Predictions of boosted trees for every split, held-out fold and target.

    With ``quantile_model`` also an arm of quantiles: the trees plus the 0.1, 0.5 and 0.9 quantiles of the train residuals;
    these predictions are stored, others are not."""
    targets = list(targets)
    rows, features = binned(df, numeric, categorical, targets, keep, splits)
    models = grow(rows, features, declared(rows, targets, splits), loss, steps, splits)
    out = predictions(rows, models, targets, lambda m: model, group, loss, keep, splits)
    if not quantile_model:
        return out
    key = ["split_name", "heldout_fold", "target"]
    r = predictions(rows, models, targets, lambda m: model, group, loss, keep, splits, train=True).withColumn("_r", F.col("y_true") - F.col("y_pred"))
    q = cut(quantiles(cut(r.select(*key, "_r")), key, "_r", {"q10": .1, "q50": .5, "q90": .9}))
    v = [F.col("y_pred") + F.col(c) for c in ("q10", "q50", "q90")]
    three = out.join(q, key).withColumns({"model_level": F.lit(quantile_model), "y_pred_q10": F.least(*v), "y_pred_q50": v[1], "y_pred_q90": F.greatest(*v)})
    out = out.unionByName(three.withColumn("y_pred", F.col("y_pred_q50")).select(*out.columns, "y_pred_q10", "y_pred_q50", "y_pred_q90"), allowMissingColumns=True)
    return cut(out)


def run_weighted(df: DataFrame, targets, numeric, categorical, group: str, bags: int = 3, steps: int = STEPS, keep=rg.KEEP, splits=SPLITS) -> DataFrame:
    """Trees under the four weight settings; the bags of a fold are averaged, and rows with equal ``keep``.  Nothing is stored."""
    targets = list(targets)
    rows, features = binned(df, numeric, categorical, targets, keep, splits)
    places = rg.layout(df, [], [])
    table = rg.blocks(rg.designed(df, places, targets), targets, splits)
    models = grow(rows, features, weighted(table, places, targets, bags, splits=splits), "square", steps, splits)
    p = predictions(rows, models, targets, lambda m: m.setting.split("|")[0], group, "square", keep, splits)
    if rows.groupBy(*keep).count().where("count > 1").isEmpty():
        return p
    by = ["run_scope", "split_name", "heldout_fold", "model_level", "feature_group", "target", *keep]
    return p.groupBy(*by).agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))
