"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and grouping.

Every shingle of a text ranks the signature components by a pseudo-random permutation of its own; at
step j it offers the value j + r to the component in place j.  A component keeps the least offer.  The
steps of all shingles run level by level: once every component of a text holds a value below j, later
levels cannot change it, and the text stops early.  Long texts need one or two levels.

Texts with equal sets are folded to one class before any comparison.  Classes that agree in a band are
candidates; they are compared on their full sets and grouped by connected components.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import from_key, id_key, mix, sized, slices, text_chunks, union_all, word_hashes, written
from .components import components

WORDS = 4
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: Members of a bucket up to which its pairs are listed, and of a block above that.
SMALL, BLOCK = 64, 256
#: Odd multipliers that place the words of a shingle.
_PLACE = np.random.default_rng(7).integers(1, 2 ** 63, 64, dtype=np.uint64) | np.uint64(1)
_LEVEL = np.random.default_rng(11).integers(1, 2 ** 63, SIZE, dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def shingle_sets(run: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a shorter text is one shingle, no words none."""
    h, bounds = word_hashes(run)
    n = len(h) - words + 1
    whole = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(words):
            whole += h[k:k + n] * _PLACE[k]
        whole = mix(whole)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            s = np.sort(whole[a:b - words + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif b > a:
            short = np.uint64(b - a) + (h[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64)
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """One row of ``size`` values (level in the upper, rank in the lower half) for each set."""
    sig = np.full((len(sets), size), np.uint64(2 ** 64 - 1), np.uint64)
    flat = sig.reshape(-1)
    lengths = np.array([len(s) for s in sets], np.int64)
    active = np.flatnonzero(lengths)
    if not len(active):
        return sig
    elements = np.concatenate([sets[i] for i in active])
    owner = np.repeat(active, lengths[active])
    draws: list[np.ndarray] = []
    for j in range(size):
        z = mix(elements ^ _LEVEL[j])
        k = (j + (((z & _LOW) * np.uint64(size - j)) >> _HALF)).astype(np.int64)
        place = k
        for t in range(j - 1, -1, -1):
            place = np.where(place == draws[t], t, place)
        draws.append(k)
        np.minimum.at(flat, owner * size + place, (np.uint64(j) << _HALF) | (z >> _HALF))
        more = sig[active].max(axis=1) >= np.uint64(j + 1) << _HALF
        if not more.any():
            break
        if not more.all():
            active = active[more]
            stay = np.isin(owner, active, assume_unique=False, kind="table")
            elements, owner = elements[stay], owner[stay]
            draws = [d[stay] for d in draws]
    return sig


def bands(sig: np.ndarray, count: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // count
    key = np.zeros((len(sig), count), np.uint64)
    for r in range(rows):
        key = mix(key + sig[:, r * count:(r + 1) * count] * _PLACE[r])
    return key.view(np.int64)


# --- the Spark side ------------------------------------------------------------------------------------

MARKS = "id long, n_shingles long, fp1 long, fp2 long, bands array<long>"


def marks(docs: DataFrame, words: int) -> DataFrame:
    """Per row of ``docs``: id key, set size, fingerprint of the set and band keys; the text stays behind."""
    def run(batches):
        for batch in slices(batches):
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            for chunk in text_chunks(texts):
                sets = shingle_sets(chunk, words)
                keys = bands(signatures(sets))
                n = np.array([len(s) for s in sets], np.int64)
                fp = np.array([[mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(len(s))))] for s in sets],
                              np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at:at + len(chunk)], pa.int64()), pa.array(n), pa.array(fp[:, 0]), pa.array(fp[:, 1]),
                     pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.reshape(-1)))],
                    ["id", "n_shingles", "fp1", "fp2", "bands"])
                at += len(chunk)
    return docs.select(id_key().alias("id"), "text").mapInArrow(run, MARKS)


def checked(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = docs.select(id_key().alias("id"), "text").join(sized(ids), "id", "left_semi")
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"))

    def run(batches):
        for batch in slices(batches):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            keep = []
            for lo in range(0, len(a), 64):
                left = _sets_of(ta[lo:lo + 64], words)
                right = _sets_of(tb[lo:lo + 64], words)
                for i, (x, y) in enumerate(zip(left, right)):
                    if not len(x) or not len(y):
                        continue
                    small, large = (x, y) if len(x) <= len(y) else (y, x)
                    if 100 * len(small) < percent * len(large):
                        continue
                    at = np.searchsorted(large, small)
                    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        keep.append(lo + i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _sets_of(texts, words):
    return [s for chunk in text_chunks(texts) for s in shingle_sets(chunk, words)]


def links_within(frame: pd.DataFrame, words: int, percent: int) -> list[tuple[int, int]]:
    """Links between rows (rep, label, block, text) of different labels, at most one for each two labels.

    Rows of one block are compared with each other if all rows are of that block, else only across.
    All intersections come from one product of the incidence matrix of shingles that occur twice.
    """
    sets = _sets_of(frame["text"].tolist(), words)
    size = np.array([len(s) for s in sets], np.int64)
    own = np.repeat(np.arange(len(sets)), size)
    distinct, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((len(sets), len(sets)), np.float32)
    often = np.flatnonzero(count > 1)
    number = np.full(len(distinct), -1)
    for lo in range(0, len(often), 4096):
        part = often[lo:lo + 4096]
        number[:] = -1
        number[part] = np.arange(len(part))
        use = number[column] >= 0
        seen = np.zeros((len(sets), len(part)), np.float32)
        seen[own[use], number[column[use]]] = 1
        common += seen @ seen.T
    common = common.astype(np.int64)
    linked = (100 * common >= percent * (size[:, None] + size[None, :] - common)) & (size[:, None] > 0) & (size[None, :] > 0)
    label, block = frame["label"].to_numpy(), frame["block"].to_numpy()
    linked &= label[:, None] < label[None, :]
    if block.min() != block.max():
        linked &= block[:, None] != block[None, :]
    rep, found = frame["rep"].to_numpy(), {}
    for i, j in zip(*np.nonzero(linked)):
        found.setdefault((label[i], label[j]), (int(rep[i]), int(rep[j])))
    return list(found.values())


def block_links(left: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between different groups in large buckets (band, key, rep, label, size), compared block by block.

    A bucket is cut into blocks of about BLOCK members by hash; a task holds the texts of two blocks.
    """
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep", F.lit("block")), n).cast("int")
    ids = written(left.select(F.col("rep").alias("id")).distinct(), "ids")
    texts = docs.select(id_key().alias("id"), "text").join(sized(ids), "id", "left_semi").distinct()
    units = left.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    units = units.withColumns({"u": F.least("block", "other"), "v": F.greatest("block", "other")})
    units = units.select("band", "key", "u", "v", "rep", "label", "block").join(texts.withColumnRenamed("id", "rep"), "rep")

    def run(frame):
        return pd.DataFrame(links_within(frame, words, percent), columns=["a", "b"]).astype("int64")

    return units.groupBy("band", "key", "u", "v").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest linked doc_id), kept.

    Links hold between documents with 100 * intersection >= ``percent`` * union of their shingle sets
    (A-Z folded words).  A bucket of documents that agree in a band is never expanded into its pairs:

    1. every member is compared with one member of its bucket, and the links are grouped;
    2. buckets that still hold several groups are compared in full across groups: pair by pair in buckets
       of at most SMALL members, block by block in larger ones, where only links between groups leave the
       task.

    Null or wordless text: no shingles, linked with nothing.  Rows with one doc_id are one document: a
    link of any of its texts counts.  A null doc_id counts as one document with the smallest id.  Extra
    columns are ignored; empty input gives no rows.
    """
    docs = docs.select("doc_id", "text")
    seen = written(marks(docs, words), "marks")
    classes = seen.where("n_shingles > 0").groupBy("fp1", "fp2").agg(
        F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    rows = seen.select("id", "n_shingles", "fp1", "fp2").join(classes.select("fp1", "fp2", "rep"), ["fp1", "fp2"], "left")
    several = rows.where("rep is not null").groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi")
    edges = [written(rows.join(several, "id").where("rep != lo").select(F.col("rep").alias("a"), F.col("lo").alias("b")), "same")]

    member = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = member.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    member = written(member.join(shared, ["band", "key"]), "members")

    pivot = member.groupBy("band", "key").agg(F.min_by("rep", F.xxhash64("rep")).alias("p"))
    tried = member.join(pivot, ["band", "key"]).where("rep != p").select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"))
    tried = written(tried.distinct(), "pairs")
    edges.append(written(checked(tried, docs, words, percent), "links"))
    groups = written(components(union_all(edges)), "groups")

    left = member.join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    mixed = left.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi")
    left = written(left.join(mixed, ["band", "key"]).select("band", "key", "rep", "label", "size"), "left")
    x, y = left.where(F.col("size") <= SMALL).alias("x"), left.alias("y")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep"))
                   & (F.col("x.label") != F.col("y.label"))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    pairs = written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    more = checked(pairs, docs, words, percent)
    large = left.where(F.col("size") > SMALL)
    if not large.isEmpty():
        more = more.union(block_links(large, docs, words, percent))
    more = written(more, "links")
    if not more.isEmpty():
        # the groups so far are stars already
        groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    groups = groups.withColumnRenamed("id", "rep")

    out = rows.join(groups, "rep", "left").withColumn("_c", F.coalesce("component", "rep", "id"))
    return out.select(from_key("id").alias("doc_id"), "n_shingles", from_key("_c").alias("component_id"), (F.col("id") == F.col("_c")).alias("kept"))
