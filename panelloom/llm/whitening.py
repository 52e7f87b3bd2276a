"""Whitening of embeddings by incremental eigendecomposition.

Every task keeps the spectrum (eigenvalues and eigenvectors) of the scatter of the vectors it has read and
adds a vector by one centred rank-one update: with z the deviation from the mean so far in the basis of the
eigenvectors, the new eigenvalues solve the secular equation 1 + sum z_j^2 / (d_j - x) = 0, one between each two
old ones.  Components without a share in z and (after a rotation) those of equal eigenvalues are deflated,
that is kept as they are.  The spectra of the tasks are combined in a tree of bounded fan-in: the
eigenpairs of one are rank-one updates of the other, the last update is the difference of the means.  A
last distributed pass (Rayleigh-Ritz) takes the scatter in the combined basis about the exact mean and turns
the basis to its eigenvectors, which removes what rounding the updates have gathered.

Sums over vectors and deviations are whole numbers of any size.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import written

COMPONENTS = 4
#: Spectra that one task combines.
FAN = 16
EPS = np.finfo(float).eps
#: An eigenvalue below this share of the largest is no direction of spread.
RANK = 1e-12


# --- rank-one updates -------------------------------------------------------------------------------------

def secular_roots(d: np.ndarray, z2: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(origin, offset): root i of 1 + sum z2_j / (d_j - x) is d[origin_i] + offset_i, the origin being the nearer pole.

    ``d`` ascends strictly, ``z2`` is positive.  All roots are sought at once by fitting, on either side of
    a root, one pole and a constant to the sum (value and slope), inside a bracket that each step shrinks.
    """
    k = len(d)
    i = np.arange(k)
    upper = np.append(d[1:], d[-1] + z2.sum())
    half = (upper - d) / 2
    at_half = 1 + (z2 / (d - (d + half)[:, None])).sum(axis=1)
    left = at_half > 0
    origin = np.where(left | (i == k - 1), i, i + 1)
    delta = d - d[origin][:, None]
    last = np.zeros(k, bool)
    last[-1] = True
    lo = np.where(left, 0.0, np.where(last, half, -half))
    hi = np.where(left, half, np.where(last, 2 * half, 0.0))
    near = np.tri(k)
    p1, p2 = delta[i, i], np.append(delta[i[:-1], i[1:]], 0.0)
    x = (lo + hi) / 2
    todo = i
    for _ in range(steps):
        xs, side = x[todo], near[todo]
        gap = delta[todo] - xs[:, None]
        r = z2 / gap
        slope = r / gap
        below = np.einsum("ij,ij->i", r, side)
        above = r.sum(axis=1) - below
        f = 1 + below + above
        open_ = np.abs(f) > 8 * k * EPS * (1 - below + above)
        if not open_.any():
            break
        lo[todo], hi[todo] = np.where(f < 0, xs, lo[todo]), np.where(f < 0, hi[todo], xs)
        s1 = np.einsum("ij,ij->i", slope, side)
        s2 = slope.sum(axis=1) - s1
        d1, d2 = p1[todo], p2[todo]
        g1, g2 = d1 - xs, d2 - xs
        a1, a2 = s1 * g1 * g1, s2 * g2 * g2
        c = f - s1 * g1 - s2 * g2
        b = c * (d1 + d2) + a1 + a2
        e = c * d1 * d2 + a1 * d2 + a2 * d1
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.maximum(b * b - 4 * c * e, 0))
            y = np.where(b <= 0, (b - root) / (2 * c), 2 * e / (b + root))
            y = np.where(todo == k - 1, a1 / c, y)
        y = np.where((y >= lo[todo]) & (y <= hi[todo]), y, (lo[todo] + hi[todo]) / 2)
        x[todo[open_]] = y[open_]
        todo = todo[open_]
    return origin, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``vectors diag(values) vectors' + v v'``; values ascend, vectors are columns."""
    z = vectors.T @ v
    size = np.sqrt(z @ z)
    if not size > 0:
        return values, vectors
    tiny = 8 * EPS * max(abs(values[-1]), size * size)
    vectors = vectors.copy()
    z[np.abs(z) * size <= tiny] = 0
    active = np.flatnonzero(z)
    d, y = values[active], z[active]
    with np.errstate(divide="ignore", invalid="ignore"):
        close = np.diff(d) * np.abs(y[1:] * y[:-1]) <= tiny * (y[1:] ** 2 + y[:-1] ** 2)
    if close.any():
        kept = active[0]
        for j in active[1:]:
            r = np.hypot(z[kept], z[j])
            c, s = z[j] / r, z[kept] / r
            if (values[j] - values[kept]) * abs(c * s) <= tiny:
                one, two = vectors[:, kept].copy(), vectors[:, j].copy()
                vectors[:, kept], vectors[:, j] = c * one - s * two, s * one + c * two
                z[kept], z[j] = 0, r
            kept = j
        active = np.flatnonzero(z)
        d, y = values[active], z[active]
    k = len(active)
    values = values.copy()
    if k == 1:
        values[active] += y * y
    elif k:
        origin, offset = secular_roots(d, y * y)
        gap = d - d[origin][:, None] - offset[:, None]                # d_j - root i, without cancellation
        # the update whose exact roots these are: its eigenvectors are orthogonal
        i = np.arange(k)
        pole = np.where(i[None, :] > i[:, None], d[:, None], np.append(d[1:], 0.0)[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = gap / (d - pole)
        ratio[-1] = -gap[-1]
        y = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=0))), y)
        turn = y / gap
        turn /= np.sqrt((turn * turn).sum(axis=1))[:, None]
        vectors[:, active] = vectors[:, active] @ turn.T
        values[active] = d[origin] + offset
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, mean and spectrum of the scatter of some vectors, and their exact sums."""

    def __init__(self, d: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(d), np.zeros(d), np.eye(d)
        self.sums, self.largest, self.updates = [0] * d, 0, 0

    def _update(self, v: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, v)
        self.updates += 1
        if self.updates % 4096 == 0:
            self.vectors = np.linalg.qr(self.vectors)[0]

    def add(self, x: np.ndarray) -> None:
        """One vector after the other, each by a centred rank-one update."""
        if not len(x):
            return
        # halves of 32 bits, so that no sum of a batch overflows
        high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
        self.sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(self.sums, high, low)]
        self.largest = max([self.largest, abs(int(x.min())), abs(int(x.max()))] if x.size else [0])
        for v in x.astype(float):
            off = v - self.mean
            self._update(off * np.sqrt(self.n / (self.n + 1)))
            self.n += 1
            self.mean = self.mean + off / self.n

    def combine(self, other: "Spectrum") -> None:
        if not other.n:
            return
        for value, u in zip(other.values, other.vectors.T):
            if value > 0:
                self._update(np.sqrt(value) * u)
        n, off = self.n + other.n, other.mean - self.mean
        self._update(off * np.sqrt(self.n * other.n / n))
        self.mean, self.n = self.mean + off * (other.n / n), n
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self.largest = max(self.largest, other.largest)

    def row(self) -> dict:
        return {"n": self.n, "largest": str(self.largest), "sums": [str(s) for s in self.sums], "mean": self.mean.tolist(),
                "values": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def of(cls, r) -> "Spectrum":
        d = len(r["mean"])
        out = cls(d)
        out.n, out.largest, out.sums = int(r["n"]), int(r["largest"]), [int(s) for s in r["sums"]]
        out.mean, out.values = np.array(r["mean"], float), np.array(r["values"], float)
        out.vectors = np.array(r["vectors"], float).reshape(d, d)
        return out


# --- the Spark side ---------------------------------------------------------------------------------------

SPECTRA = "part int, n long, largest string, sums array<string>, mean array<double>, values array<double>, vectors array<double>"
MOMENTS = "part int, n long, mean array<double>, scatter array<double>"


def folded(parts: DataFrame, combine, schema: str, name: str) -> list:
    """The one row that ``combine`` makes of all, FAN at a time; a row's size depends on the dimension alone."""
    parts = written(parts, name)
    while True:
        last = parts.agg(F.max("part").alias("last")).first()["last"]
        if not last:
            return parts.collect()
        parts = written(parts.groupBy(F.floor(F.col("part") / FAN).cast("int").alias("to")).applyInPandas(combine, schema), name)


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def spectra(fit: DataFrame, d: int) -> DataFrame:
    """The spectrum of each partition of ``fit`` (x)."""
    def run(batches):
        held = Spectrum(d)
        for batch in batches:
            held.add(_matrix(batch.column("x"), d))
        if held.n:
            yield pd.DataFrame([{"part": TaskContext.get().partitionId(), **held.row()}])

    def arrow(batches):
        for frame in run(batches):
            yield from pa.Table.from_pylist(frame.to_dict("records"), schema=_SPECTRA).to_batches()

    return fit.select("x").mapInArrow(arrow, SPECTRA)


_SPECTRA = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("largest", pa.string()), ("sums", pa.list_(pa.string())),
                      ("mean", pa.list_(pa.float64())), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


def _combined(key, frame: pd.DataFrame) -> pd.DataFrame:
    rows = frame.sort_values("part").to_dict("records")
    held = Spectrum.of(rows[0])
    for r in rows[1:]:
        held.combine(Spectrum.of(r))
    return pd.DataFrame([{"part": int(key[0]), **held.row()}])


class Centre:
    """Exact deviations from the mean of ``n`` vectors with the given sums, times n."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.d = n, len(sums)
        bound = n * largest + max([abs(s) for s in sums] or [0])
        self.exact = bound * bound * max(1, self.d) >= 2 ** 62
        self.sums = np.array(sums, object if self.exact else np.int64)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        return x.astype(object if self.exact else np.int64) * self.n - self.sums

    def centred(self, off: np.ndarray) -> np.ndarray:
        return (off / self.n).astype(float)


def moments(fit: DataFrame, centre: Centre, basis: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, scatter about that mean) of the centred vectors of ``fit`` in ``basis``, summed over all partitions."""
    shared = fit.sparkSession.sparkContext.broadcast((vars(centre), basis))
    d, k = basis.shape

    def run(batches):
        held, turn = Centre.__new__(Centre), shared.value[1]
        vars(held).update(shared.value[0])
        total = None
        for batch in batches:
            if batch.num_rows:
                y = held.centred(held.deviations(_matrix(batch.column("x"), d))) @ turn
                mean = y.mean(axis=0)
                total = _pooled(total, (len(y), mean, (y - mean).T @ (y - mean)))
        if total:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "n": total[0], "mean": total[1].tolist(),
                                               "scatter": total[2].ravel().tolist()}], schema=_MOMENTS)

    def combine(key, frame):
        total = None
        for r in frame.sort_values("part").to_dict("records"):
            total = _pooled(total, (int(r["n"]), np.array(r["mean"], float), np.array(r["scatter"], float).reshape(k, k)))
        return pd.DataFrame([{"part": int(key[0]), "n": total[0], "mean": total[1].tolist(), "scatter": total[2].ravel().tolist()}])

    r = folded(fit.select("x").mapInArrow(run, MOMENTS), combine, MOMENTS, "moments")[0]
    return r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(k, k)


_MOMENTS = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64()))])


def _pooled(a, b):
    if a is None:
        return b
    n, off = a[0] + b[0], b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)


OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
       "eigenvalue double, deviation_exact string")


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding) with a finite vector, and component: the whitened value.

    Returns vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue, deviation_exact.  Entries c
    become x = floor(256 c); the fit list holds each different x once, so copies weigh nothing.  Rows whose
    vector is null or holds a null or non-finite entry are dropped.  A vector shorter than the longest
    one counts as zero in the missing dimensions.  Components without spread (fewer dimensions or different
    vectors than asked for) are left out: a table of one vector gives no rows, as does an empty one.
    ``deviation`` is null where it exceeds a long, and ``deviation_exact`` (its decimal digits) is then set, else
    null.  Null and repeated ids are kept as they are; extra columns are ignored.
    """
    spark = rows.sparkSession
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform("embedding", lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long"))
    rows = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, x).alias("x")).where("x is not null"), "vectors")
    sizes = rows.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    d = sizes["most"] or 0
    if sizes["least"] != d:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
    if not d:
        return _none(spark)
    fit = written(rows.select("x").distinct(), "fit")
    whole = Spectrum.of(folded(spectra(fit, d), _combined, SPECTRA, "spectra")[0].asDict())
    centre = Centre(whole.n, whole.sums, whole.largest)
    basis = np.linalg.qr(whole.vectors)[0]
    n, mean, scatter = moments(fit, centre, basis)
    values, turn = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, basis = values[::-1], (basis @ turn)[:, ::-1]
    k = int((values[:components] > RANK * max(values[0], 0)).sum()) if values[0] > 0 else 0
    if not k:
        return _none(spark)
    trace = float(values.sum())
    values = values[:k]
    basis = basis[:, :k] / np.sqrt(values)
    _, _, scatter = moments(fit, centre, basis)
    error = float(np.abs(scatter / n - np.eye(k)).max())
    shared = spark.sparkContext.broadcast((vars(centre), basis))

    def run(batches):
        held, scaled = Centre.__new__(Centre), shared.value[1]
        vars(held).update(shared.value[0])
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            off = held.deviations(_matrix(batch.column("x"), d))
            white = held.centred(off) @ scaled
            far = (off * off).sum(axis=1).tolist()
            fits = [v < 2 ** 63 for v in far]
            columns = [batch.column("vec_id").take(np.repeat(np.arange(m), k)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n),
                       pa.array([v if ok else None for v, ok in zip(far, fits) for _ in range(k)], pa.int64()), white.ravel(),
                       np.tile(values / trace, m), np.full(m * k, error), np.tile(values, m),
                       pa.array([None if ok else str(v) for v, ok in zip(far, fits) for _ in range(k)], pa.string())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in OUT.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(run, OUT)


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OUT)
