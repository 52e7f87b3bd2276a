"""A bidirectional gated recurrent network with attention pooling, in numpy.

Input of a step is a word: the vector of its hash, and the mean and the largest of its character n-gram
vectors.  All is learnt by back-propagation; word and n-gram vectors start from log odds of label 1 beside
random signs.  A window of steps gives one logit; a text takes the largest of its overlapping windows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import _IS_SPACE, _TABLE_FOLDED, CHUNK_BYTES, _power, mix

PIECE = 16                  # a longer word is read as several pieces
GRAMS = (3, 5)              # bytes of a character n-gram; white space marks the ends of a word
STEPS, STRIDE = 32, 16      # words of a window, and from one window to the next
WORD_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 18
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 4, 4, 8, 8
INPUT = WORD_DIM + GRAM_DIM + 1
#: A word or n-gram in fewer training texts than this tells nothing.
LEAST_TEXTS = 3
_EVEN = _TABLE_FOLDED.copy()
_EVEN[_IS_SPACE] = _TABLE_FOLDED[32]


def pieces_of(run: list[bytes]):
    """Words of the texts, A-Z folded, cut into pieces.

    Returns (index, bounds, buckets, grams, counts, hashes): piece i of the texts is distinct piece
    index[i]; text k has pieces bounds[k] to bounds[k + 1]; each distinct piece has a word bucket, a row
    of n-gram buckets, of which counts are real, and a 64-bit hash.
    """
    a = np.frombuffer(b" " + b" ".join(run) + b" ", np.uint8)
    space = _IS_SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    parts = np.maximum(1, -(-(ends - starts) // PIECE))
    if len(parts) and parts.max() > 1:
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + inside * PIECE
        ends = np.minimum(np.repeat(ends, parts), starts + PIECE)
    power, inverse = _power(len(a) + 1)
    prefix = np.empty(len(a) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_EVEN[a] * power[:-1], out=prefix[1:])
    h = mix((prefix[ends] - prefix[starts]) * inverse[starts])
    firsts = np.cumsum([1] + [len(b) + 1 for b in run])
    bounds = np.searchsorted(starts, firsts)
    distinct, at, index = np.unique(h, return_index=True, return_inverse=True)
    s, n = starts[at] - 1, ends[at] - starts[at] + 2
    grams, counts = [], np.zeros(len(distinct), np.int64)
    for size in GRAMS:
        offset = s[:, None] + np.arange(PIECE + 3 - size)[None, :]
        real = np.arange(PIECE + 3 - size)[None, :] <= (n - size)[:, None]
        lo = np.minimum(offset, len(a) - size)
        g = mix((prefix[lo + size] - prefix[lo]) * inverse[lo] + np.uint64(size))
        grams.append(np.where(real, 1 + (g % np.uint64(GRAM_BUCKETS - 1)).astype(np.int32), 0))
        counts += real.sum(axis=1)
    buckets = 1 + (distinct % np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    return index.astype(np.int32), bounds, buckets, np.concatenate(grams, axis=1), np.maximum(counts, 1), distinct


def gathered(texts: list[bytes]):
    """As ``pieces_of`` for many texts, in runs of bounded size."""
    runs, run, size = [], [], 0
    for t in [*texts, None]:
        if run and (t is None or size + len(t) > CHUNK_BYTES):
            runs.append(pieces_of(run))
            run, size = [], 0
        if t is not None:
            run.append(t)
            size += len(t)
    hashes = np.concatenate([r[5] for r in runs])
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    index, bounds, before, pieces = [], [np.zeros(1, np.int64)], 0, 0
    for r in runs:
        index.append(number[before + r[0]].astype(np.int32))
        bounds.append(r[1][1:] - r[1][0] + pieces)
        before += len(r[5])
        pieces += len(r[0])
    take = lambda k: np.concatenate([r[k] for r in runs])[first]
    return np.concatenate(index), np.concatenate(bounds), take(2), take(3), take(4), distinct


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n pieces; the last window ends with the text."""
    if n <= STEPS:
        return [0]
    return list(range(0, n - STEPS, STRIDE)) + [n - STEPS]


def windows_of(index: np.ndarray, bounds: np.ndarray):
    """Rows of distinct piece numbers plus one (0: nothing), and the text of each row."""
    rows, owner = [], []
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        w = window_starts(b - a)
        rows += [a + x for x in w]
        owner += [k] * len(w)
    rows, owner = np.array(rows, np.int64), np.array(owner, np.int64)
    at = rows[:, None] + np.arange(STEPS)[None, :]
    real = at < bounds[owner + 1][:, None]
    if not len(index):
        return np.zeros(at.shape, np.int32), owner
    return np.where(real, index[np.minimum(at, len(index) - 1)] + 1, 0).astype(np.int32), owner


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 5) -> "Network":
        r = np.random.default_rng(seed)
        small = lambda *s: (r.standard_normal(s) * 0.3 / np.sqrt(s[0])).astype(np.float32)
        d, h = INPUT, HIDDEN
        signs = lambda *s: (r.integers(0, 2, s) * 0.4 - 0.2).astype(np.float32)
        w = {"word": signs(WORD_BUCKETS, WORD_DIM), "gram": signs(GRAM_BUCKETS, GRAM_DIM)}
        for side in "fb":
            w |= {f"{side}W": small(d, 3 * h) * 3, f"{side}U": small(h, 3 * h), f"{side}b": np.zeros(3 * h, np.float32)}
        w |= {"A": small(2 * h, ATTENTION) * 3, "a": np.zeros(ATTENTION, np.float32), "v": small(ATTENTION),
              "o": small(2 * h) * 3, "c": np.full(1, -1.0, np.float32)}
        w["scale"] = np.array([1.0, 0.0], np.float32)
        w["word"][0] = w["gram"][0] = w["word"][:, 0] = w["gram"][:, 0] = 0
        return cls(w)

    def inputs(self, buckets, grams, counts) -> np.ndarray:
        """Input of each distinct piece; row 0 stands for nothing."""
        w = self.weights
        chars, most = np.zeros((len(buckets), GRAM_DIM), np.float32), np.zeros(len(buckets), np.float32)
        for column in grams.T:
            v = w["gram"][column]
            chars += v
            np.maximum(most, v[:, 0], out=most)
        chars /= counts[:, None].astype(np.float32)
        own = np.concatenate([w["word"][buckets], chars, most[:, None]], axis=1)
        return np.concatenate([np.zeros((1, INPUT), np.float32), own])

    def _run(self, x: np.ndarray, side: str, keep: list | None):
        """x: steps x batch x 3h projected inputs, in reading order; states in the same order."""
        w, h = self.weights[f"{side}U"], HIDDEN
        state = np.zeros((x.shape[1], h), np.float32)
        states = np.empty((x.shape[0], x.shape[1], h), np.float32)
        for t in range(x.shape[0]):
            u = state @ w
            gate = _sigmoid(x[t, :, :2 * h] + u[:, :2 * h])
            r, z = gate[:, :h], gate[:, h:]
            n = np.tanh(x[t, :, 2 * h:] + r * u[:, 2 * h:])
            if keep is not None:
                keep.append((state, u, r, z, n))
            state = n + z * (state - n)
            states[t] = state
        return states

    def logits(self, x: np.ndarray, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """x: inputs of distinct pieces; rows: windows of their numbers."""
        w = self.weights
        states = []
        for side in "fb":
            projected = x @ w[f"{side}W"] + w[f"{side}b"]
            order = rows.T if side == "f" else rows.T[::-1]
            steps = [] if keep is not None else None
            s = self._run(projected[order], side, steps)
            states.append(s if side == "f" else s[::-1])
            if keep is not None:
                keep[side] = steps
        s = np.concatenate(states, axis=2)
        m = np.tanh(s @ w["A"] + w["a"])
        e = m @ w["v"]
        e = np.exp(e - e.max(axis=0))
        p = e / e.sum(axis=0)
        pooled = (p[:, :, None] * s).sum(axis=0)
        if keep is not None:
            keep |= {"s": s, "m": m, "p": p, "pooled": pooled, "x": x, "rows": rows}
        return pooled @ w["o"] + w["c"][0]

    def gradients(self, keep: dict, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all learnt weights for d, the derivative of the loss by each logit."""
        w, h = self.weights, HIDDEN
        s, m, p = keep["s"], keep["m"], keep["p"]
        g = {"o": keep["pooled"].T @ d, "c": np.array([d.sum()], np.float32)}
        dpooled = d[:, None] * w["o"]
        ds = p[:, :, None] * dpooled
        dp = (s * dpooled).sum(axis=2)
        de = p * (dp - (p * dp).sum(axis=0))
        g["v"] = np.einsum("tb,tba->a", de, m)
        dm = de[:, :, None] * w["v"] * (1 - m * m)
        g["A"] = np.einsum("tbs,tba->sa", s, dm)
        g["a"] = dm.sum(axis=(0, 1))
        ds += dm @ w["A"].T
        dx = np.zeros_like(keep["x"])
        for side, part in (("f", ds[:, :, :h]), ("b", ds[::-1, :, h:])):
            order = keep["rows"].T if side == "f" else keep["rows"].T[::-1]
            U, dU = w[f"{side}U"], np.zeros_like(w[f"{side}U"])
            dproj = np.empty((part.shape[0], part.shape[1], 3 * h), np.float32)
            back = np.zeros((part.shape[1], h), np.float32)
            for t in range(part.shape[0] - 1, -1, -1):
                state, u, r, z, n = keep[side][t]
                total = part[t] + back
                dn = total * (1 - z) * (1 - n * n)
                dz = total * (state - n) * z * (1 - z)
                dr = dn * u[:, 2 * h:] * r * (1 - r)
                du = np.concatenate([dr, dz, dn * r], axis=1)
                dproj[t] = np.concatenate([dr, dz, dn], axis=1)
                dU += state.T @ du
                back = total * z + du @ U.T
            flat, where = dproj.reshape(-1, 3 * h), order.reshape(-1)
            np.add.at(dx, where, flat @ w[f"{side}W"].T)
            g[f"{side}U"], g[f"{side}b"] = dU, flat.sum(axis=0)
            g[f"{side}W"] = keep["x"][where].T @ flat
        keep["dx"] = dx
        return g

    def vector_gradients(self, dx: np.ndarray, buckets, grams, counts) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """(rows, gradients) of the word and n-gram vectors, from the derivatives by the inputs of distinct pieces."""
        words, at = np.unique(buckets, return_inverse=True)
        gw = np.zeros((len(words), WORD_DIM), np.float32)
        np.add.at(gw, at, dx[:, :WORD_DIM])
        rows, at = np.unique(grams, return_inverse=True)
        at = at.reshape(grams.shape)
        gg = np.zeros((len(rows), GRAM_DIM), np.float32)
        share = dx[:, WORD_DIM:WORD_DIM + GRAM_DIM] / counts[:, None]
        for column in at.T:
            np.add.at(gg, column, share)
        first = self.weights["gram"][grams][:, :, 0]
        top = first.argmax(axis=1)
        most = first[np.arange(len(top)), top] > 0                 # else the largest is the floor of 0
        np.add.at(gg[:, 0], at[np.arange(len(top)), top][most], dx[most, -1])
        return {"word": (words, gw), "gram": (rows, gg)}

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        scale = self.weights["scale"].astype(float)
        return _sigmoid(scale[0] * logits + scale[1])

    def text_logits(self, run: list[bytes], at_once: int = 2048) -> np.ndarray:
        """Largest window logit of each text; every window of every text is scored."""
        index, bounds, buckets, grams, counts, _ = pieces_of(run)
        rows, owner = windows_of(index, bounds)
        x = self.inputs(buckets, grams, counts)
        out = np.full(len(run), -np.inf)
        for lo in range(0, len(rows), at_once):
            np.maximum.at(out, owner[lo:lo + at_once], self.logits(x, rows[lo:lo + at_once]))
        return out


#: Weights that the optimiser of the whole matrices leaves alone: vectors are stepped by row, the scale is fitted after.
FIXED = ("word", "gram", "scale")
#: Step of the vectors, and how fast they are drawn back to where they started.
VECTOR_RATE, VECTOR_DECAY = 0.005, 0.05


class Adam:
    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.t = network, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in network.weights.items() if k not in FIXED}
        self.v = {k: np.zeros_like(v) for k, v in self.m.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        for k in self.m:
            v = self.network.weights[k]
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.001 * (g[k] * g[k] - self.v[k])
            v -= self.rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.999 ** self.t)) + 1e-8)


class ByRow:
    """Steps of the word and n-gram vectors that a batch holds, each scaled by its own past gradients (Adagrad)."""

    def __init__(self, network: Network, rate: float = VECTOR_RATE):
        self.network, self.rate = network, rate
        self.start = {k: network.weights[k].copy() for k in ("word", "gram")}
        self.past = {k: np.full(v.shape, 1e-4, np.float32) for k, v in self.start.items()}

    def step(self, found: dict) -> None:
        for k, (rows, g) in found.items():
            real = rows != 0                                        # row 0 stands for nothing
            rows, g = rows[real], g[real]
            w, past = self.network.weights[k], self.past[k]
            past[rows] += g * g
            w[rows] -= self.rate * g / np.sqrt(past[rows]) + VECTOR_DECAY * (w[rows] - self.start[k][rows])


def _odds(held: np.ndarray, document: np.ndarray, buckets: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """Log odds of label 1 given a bucket, from the documents that hold it.

    Piece held[i] lies in document[i] (ascending) and has the bucket or buckets buckets[held[i]].
    """
    one, none = np.zeros(size, np.int64), np.zeros(size, np.int64)
    cuts = np.searchsorted(document, np.arange(0, len(labels) + 64, 64))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own = buckets[held[lo:hi]].reshape(hi - lo, -1).astype(np.int64)
        pair = np.unique((document[lo:hi, None] * size + own).reshape(-1))
        is_one = labels[pair // size] == 1
        one += np.bincount(pair[is_one] % size, minlength=size)
        none += np.bincount(pair[~is_one] % size, minlength=size)
    odds = np.log((one + 0.5) / (labels.sum() + 1)) - np.log((none + 0.5) / ((1 - labels).sum() + 1))
    sure = np.abs(odds) - 2 * np.sqrt(1 / (one + 0.5) + 1 / (none + 0.5))      # two standard errors nearer to 0
    odds = np.where(one + none < LEAST_TEXTS, 0, np.sign(odds) * np.clip(sure, 0, 4)).astype(np.float32)
    odds[0] = 0
    return odds


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit on labelled texts of both labels.

    A quarter of the texts is kept apart.  A text stands for its windows: each epoch picks the window with
    the largest logit of every other text, and for label 0 a second one at random, and fits those.  Then
    scale and shift of the logits are fitted to the texts kept apart.
    """
    apart = np.arange(len(texts)) % 4 == 3
    if len(set(labels[~apart].tolist())) < 2 or len(set(labels[apart].tolist())) < 2:
        apart[:] = False
    fit = [t for t, a in zip(texts, apart) if not a]
    network = _fit(fit, labels[~apart], epochs, batch, rate, seed)
    kept = [t for t, a in zip(texts, apart) if a] or fit
    logits = np.concatenate([network.text_logits(kept[lo:lo + 64]) for lo in range(0, len(kept), 64)])
    network.weights["scale"] = _scale(logits, labels[apart] if apart.any() else labels)
    return network


def _scale(x: np.ndarray, labels: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression on one logit, with targets drawn in from 0 and 1 by the numbers of texts."""
    one, none = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (one + 1) / (one + 2), 1 / (none + 2))
    a, b, spread, middle = 1.0, 0.0, x.std() + 1e-6, x.mean()
    z = (x - middle) / spread
    for _ in range(steps):                      # Newton steps
        p = _sigmoid(a * z + b)
        v = p * (1 - p) + 1e-9
        g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
        H = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(H, g)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
    return np.array([a / spread, b - a * middle / spread], np.float32)


def _fit(texts, labels, epochs, batch, rate, seed) -> Network:
    network, r = Network.new(seed), np.random.default_rng(seed)
    index, bounds, buckets, grams, counts, _ = gathered(texts)
    rows, owner = windows_of(index, bounds)
    held = np.unique(np.repeat(np.arange(len(texts)), np.diff(bounds)) * len(buckets) + index)      # distinct pieces of each text
    document, held = held // len(buckets), held % len(buckets)
    network.weights["word"][:, 0] = _odds(held, document, buckets, labels, WORD_BUCKETS)
    network.weights["gram"][:, 0] = _odds(held, document, grams, labels, GRAM_BUCKETS)
    x = network.inputs(buckets, grams, counts)
    optimiser, vectors = Adam(network, rate), ByRow(network)
    first = np.searchsorted(owner, np.arange(len(texts)))
    size = np.diff(np.append(first, len(rows)))
    zeros = np.flatnonzero(labels == 0)
    weight_one = min(4.0, 0.5 / max(1e-3, labels.mean()))
    for _ in range(epochs):
        logit = np.concatenate([network.logits(x, rows[lo:lo + 4096]) for lo in range(0, len(rows), 4096)])
        best = np.lexsort((-logit, owner))[first]
        chosen = np.concatenate([best, first[zeros] + r.integers(0, size[zeros])])
        chosen = chosen[r.permutation(len(chosen))]
        for lo in range(0, len(chosen), batch):
            take = rows[chosen[lo:lo + batch]]
            target = labels[owner[chosen[lo:lo + batch]]].astype(np.float32)
            used, local = np.unique(take, return_inverse=True)
            held = used[used > 0] - 1
            own = (buckets[held], grams[held], counts[held])
            now = network.inputs(*own)                              # with the vectors as they are now
            now = now if used[0] == 0 else now[1:]
            keep: dict = {}
            y = network.logits(now, local.reshape(take.shape), keep)
            weight = np.where(target == 1, weight_one, 1.0)
            g = network.gradients(keep, ((_sigmoid(y) - target) * weight / len(take)).astype(np.float32))
            dx = keep["dx"] if used[0] else keep["dx"][1:]
            found = network.vector_gradients(dx, *own)
            optimiser.step(g)
            vectors.step(found)
        x = network.inputs(buckets, grams, counts)
    return network
