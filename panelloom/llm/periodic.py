"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q that is at least 2 q long and that no neighbouring word
extends.  At each scale t = 1, 2, 4, ... a hash of every window of t words selects positions: i is selected
if the least hash among the windows that start at i to i + t stands at i or at i + t.  Whether a position
is selected depends on its context, the words i to i + 2 t, alone; so a square with period p in
[3 t, 6 t) selects the same place in both halves, and two selected positions with equal contexts at
distance p propose it.

Windows that lie in runs of period at most t / 3 (found at smaller scales) take no part, or such regions
would select nearly all their positions.  What is omitted with them is supplied apart: a square whose
period p is itself such a region [a, b) ends it inside, where a second region of the same small period
starts, so each two regions that meet propose the periods that fit into both; and periods of 1 and 2 are
compared directly.

Contexts are compared by exact names (equal numbers for equal windows of 1, 2, 4, ... words of one
text), not by hashes.  The same names extend a proposal to both sides until words differ.
"""
from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NULL_ID, from_key, id_key, mix, slices, text_chunks

#: The shortest run that is reported.
LEAST = 12
_NONE = np.uint64(2 ** 64 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def names_of(letters: np.ndarray) -> list[np.ndarray]:
    """Level k: equal numbers for equal windows of 2^k letters; -1 where a window stands once (or does not fit)."""
    _, inverse, count = np.unique(letters, return_inverse=True, return_counts=True)
    name = np.full(len(letters) + 1, -1, np.int32)
    name[:-1] = np.where(count[inverse] > 1, inverse, -1)
    levels, width = [], 1
    while name.max() >= 0:
        levels.append(name)
        at = np.flatnonzero(name[:-width] >= 0)
        at = at[name[at + width] >= 0]
        _, inverse, count = np.unique(name[at].astype(np.int64) * len(name) + name[at + width], return_inverse=True, return_counts=True)
        name = np.full(len(name), -1, np.int32)
        name[at] = np.where(count[inverse] > 1, inverse, -1)
        width *= 2
    return levels


def extent(levels: list[np.ndarray], x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch [lo, hi) around each x in which letter i equals letter i + p; empty stretches have lo = hi."""
    hi, lo = x.copy(), x.copy()
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k]
        same = (name[hi] >= 0) & (name[hi] == name[np.minimum(hi + p, len(name) - 1)])
        hi[same] += 1 << k
        at = lo - (1 << k)
        same = (at >= 0) & (name[at] >= 0) & (name[at] == name[at + p])
        lo[same] -= 1 << k
    return lo, hi


def synchronising(hashes: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """Selected positions at scale t; ``hashes`` are of the windows of t letters, ``periodic`` marks those left out."""
    v = np.where(periodic[:len(hashes)], _NONE, hashes)
    n = len(v) - t
    if n < 1:
        return np.empty(0, np.int64)
    least, width = v, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])[:n]
    return np.flatnonzero(((least == v[:n]) | (least == v[t:t + n])) & (least != _NONE))


class Found:
    """Runs (start, end, period) so far."""

    def __init__(self):
        self.rows = np.empty((0, 3), np.int64)

    def add(self, levels, x: np.ndarray, p: np.ndarray) -> None:
        """Extend the proposals (position, period) and keep those of at least two periods."""
        if not len(x):
            return
        order = np.lexsort((x, p))
        x, p = x[order], p[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (p[1:] != p[:-1])]
        x, p = x[new], p[new]
        lo, hi = extent(levels, x, p)
        long = hi - lo >= p
        rows = np.stack([lo[long], hi[long] + p[long], p[long]], axis=1)
        # a stretch with several periods is the run of the least
        rows = np.concatenate([self.rows, rows])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        self.rows = rows[first]


def runs_of(letters: np.ndarray) -> np.ndarray:
    """All runs (start, end, period) of at least two periods, in order of start and end.

    Letters of different texts must differ, so that several texts can be searched at once.
    """
    found = Found()
    levels = names_of(letters)
    if not levels:
        return found.rows
    for p in (1, 2):
        same = levels[0][:-1 - p] == levels[0][p:-1]
        at = np.flatnonzero(same & (levels[0][:-1 - p] >= 0))
        if len(at):
            at = at[np.r_[True, np.diff(at) > 1]]                    # one place of each stretch
        found.add(levels, at, np.full(len(at), p))
    hashes = mix(letters.astype(np.uint64) * _STEP)
    for k in range(len(levels) - 1):
        t = 1 << k
        start, end, period = found.rows.T
        small = (3 * period <= t) & (end - start >= t)
        change = np.zeros(len(letters) + 1, np.int64)
        np.add.at(change, start[small], 1)
        np.add.at(change, end[small] - t + 1, -1)
        at = synchronising(hashes, t, np.cumsum(change) > 0)
        context = levels[k + 1]
        at = at[context[at] >= 0]
        xs, ps = [], []
        i, step = np.arange(len(at) - 1), 1
        while len(i):
            d = at[i + step] - at[i]
            near = d < 6 * t
            i, d = i[near], d[near]
            hit = (d >= 3 * t) & (context[at[i]] == context[at[i + step]])
            xs.append(at[i[hit]])
            ps.append(d[hit])
            step += 1
            i = i[i + step < len(at)]
        x, p = _meeting(found.rows[small], t)
        near = letters[x] == letters[x + p]
        found.add(levels, np.concatenate([*xs, x[near]]), np.concatenate([*ps, p[near]]))
        hashes = mix(hashes[:-t] * _STEP + hashes[t:])
    return found.rows


def _meeting(rows: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals of regions of one small period that meet: the square's halves lie in one region each."""
    rows = rows[rows[:, 1] - rows[:, 0] >= 3 * t]
    rows = rows[np.lexsort((rows[:, 0], rows[:, 2]))]
    a, b = rows[:-1], rows[1:]
    meet = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1]) & (b[:, 0] > a[:, 1] - a[:, 2])
    a, b = a[meet], b[meet]
    most = np.minimum(np.minimum(a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]), 6 * t - 1)
    n = most - 3 * t + 1
    p = 3 * t + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(a[:, 1], n) - p, p


# --- texts ------------------------------------------------------------------------------------------------

RUNS = ("id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
        "collapsed_sha256 string")


def repeated(doc_id: int, n: int) -> tuple[int, int] | None:
    """(a, p) if the words of this document from the a-th repeat with period p, by the checksum of its id."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n or doc_id == NULL_ID:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def described(ids: list[int], texts: list[bytes]) -> dict[str, list]:
    """The columns of RUNS for some texts, searched together."""
    words, bounds = [], [0]
    for text in texts:
        words += text.split()                        # bytes split at space and the controls 9 to 13
        bounds.append(len(words))
    number: defaultdict = defaultdict(itertools.count().__next__)
    index = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    source, moved = np.arange(len(words)), set()
    for d, doc_id in enumerate(ids):
        lo, hi = bounds[d], bounds[d + 1]
        how = repeated(doc_id, hi - lo)
        if how:
            a, p = how
            source[lo + a:hi] = lo + a + np.arange(hi - lo - a) % p
            moved.add(d)
    sizes = np.diff(bounds)
    letters = index[source] + np.repeat(np.arange(len(texts)), sizes) * max(1, len(number))
    rows = runs_of(letters) if len(words) else np.empty((0, 3), np.int64)
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(LEAST, 2 * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    at = np.searchsorted(rows[:, 0], bounds)
    out: dict[str, list] = {c.split()[0]: [] for c in RUNS.split(", ")}
    for d, doc_id in enumerate(ids):
        lo, hi = bounds[d], bounds[d + 1]
        own = [(int(s) - lo, int(e - s), int(p)) for s, e, p in rows[at[d]:at[d + 1]]]
        best = max(own, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        if own or d in moved:
            text = b" ".join([words[j] for j in source[lo:hi][kept[lo:hi]].tolist()])
        else:
            text = b" ".join(words[lo:hi])
        values = (doc_id, len(own), *best, 1000 * best[1] // best[2] if own else None,
                  hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
        for c, v in zip(out.values(), values):
            c.append(v)
    return out


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_runs, the longest run (start, length, period, exponent_milli) and the
    digests runs_sha256 and collapsed_sha256, after the repetition that the id's checksum asks for.

    Runs of at least 12 words count; the longest is first by length, then smallest start, then period.  Null
    or wordless text has no runs, four nulls and the digests of nothing.  A null doc_id stays null and its
    words stay as they are.  Repeated rows give equal rows; extra columns are ignored; empty input gives
    no rows.  Texts are searched whole, in batches of about 1 MB; a longer text is a batch of its own.
    """
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches):
        for batch in slices(batches):
            ids, at = batch.column("id").to_pylist(), 0
            for chunk in text_chunks(batch.column("text").to_pylist()):
                found = described(ids[at:at + len(chunk)], chunk)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found.values(), kinds)], list(found))
                at += len(chunk)

    found = docs.select(id_key().alias("id"), "text").mapInArrow(run, RUNS)
    return found.select(from_key("id").alias("doc_id"), *[c.split()[0] for c in RUNS.split(", ")[1:]])
