"""Language of texts by prediction by partial matching over bytes.

For each language the bytes of its sample texts give a tree of contexts of 0 to DEPTH bytes.  A context
seen n times with d different next bytes codes a next byte seen k times in k / (n + d), and the escape to
the context one byte shorter in d / (n + d); below the empty context every byte has 1 / 256.  A byte is
coded in the longest context that the tree has, after the escapes that lead to a context that knows it
(without exclusions, so that code lengths add up along the tree).  The statistics are frozen; the code
length of a text is the exact sum over all its bytes, and the language with the shortest code wins.

The trees of all languages are laid over each other: a node is a string of up to DEPTH + 1 bytes seen in
any of them, and holds for every language the bits of its last byte after the bytes before it, and the
bits of an escape from it as a context.  A batch of texts walks the common tree from all positions at
once, so a position costs one look-up a byte of depth, whatever the number of languages.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import from_key, id_key, slices, text_chunks
from .toxicity import held_out

DEPTH = 4
#: Trees are fitted on so many different texts of a language at most, by hash of the text ...
TEXTS = 300
#: ... among texts of at most so many bytes ...
LONGEST = 30_000
#: ... and have so many contexts together at most; beyond, contexts of two bytes and more that were seen least go.
CONTEXTS = 120_000
UNKNOWN = "und"
#: Texts are walked in batches of about so many bytes.
BATCH = 1 << 18


class Trees:
    """The common tree of several languages.

    ``follow[node, class of byte]`` is the node of the longer string, 0 where there is none; node 0 has no
    successors, node 1 is the empty string.  ``bits[node]`` and ``leave[node]`` have a column a language.
    """

    def __init__(self, languages: list[str], classes: np.ndarray, follow: np.ndarray, bits: np.ndarray, leave: np.ndarray):
        self.languages, self.classes, self.follow, self.bits, self.leave = languages, classes, follow, bits, leave

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        # class 0 stands between the texts and has no node, class 1 is a byte of no tree
        a = self.classes[np.frombuffer(b"\0" + b"\0".join(texts) + bytes(DEPTH + 1), np.uint8)]
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1)
        a[0], a[ends], a[ends[-1]:] = 0, 0, 0
        n = len(a)
        walk = [np.full(n, 1, np.int32)]                # walk[k][i]: the node of the k bytes from i on
        for k in range(DEPTH + 1):
            node = np.zeros(n, np.int32)
            node[:n - k] = self.follow.take(walk[-1][:n - k].astype(np.int64) * self.follow.shape[1] + a[k:])
            walk.append(node)
        cost = np.zeros((n, len(self.languages)), np.float32)
        left = np.flatnonzero(a)
        for k in range(DEPTH, -1, -1):
            ready = left >= k
            at = left if ready.all() else left[ready]
            node = walk[k + 1][at - k]
            known = node > 0
            cost[at[known]] += self.bits[node[known]]
            at = at[~known]
            cost[at] += self.leave[walk[k][at - k]]
            left = at if ready.all() else np.concatenate([left[~ready], at])
        cost[left] += 8
        starts = ends - sizes
        total = np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        total[sizes == 0] = 0
        return total


def fit(texts: list[bytes], labels: list[str], most: int = CONTEXTS) -> Trees | None:
    """Trees from (text, language) rows; None without rows."""
    languages = sorted(set(labels))
    if not languages:
        return None
    code = {name: i for i, name in enumerate(languages)}
    n_lang = len(languages)
    runs = {i: b"\0".join(t for t, name in zip(texts, labels) if code[name] == i) for i in range(n_lang)}
    starts = {i: np.cumsum([0] + [len(t) + 1 for t, name in zip(texts, labels) if code[name] == i])[1:-1] - 1 for i in range(n_lang)}
    arrays = {i: np.frombuffer(b, np.uint8) for i, b in runs.items()}
    # strings of k bytes as (distinct keys, counts a language); the bytes of a key are 8 bits each
    levels = []
    for k in range(1, DEPTH + 2):
        keys, counts, owner = [], [], []
        for i, a in arrays.items():
            n = len(a) - k + 1
            if n < 1:
                continue
            inside = np.ones(len(a), bool)
            inside[starts[i]] = False                    # strings that span two texts do not count
            ok, key = np.ones(n, bool), np.zeros(n, np.int64)
            for j in range(k):
                ok &= inside[j:j + n]
                key = key << 8 | a[j:j + n]
            key, count = np.unique(key[ok], return_counts=True)
            keys.append(key)
            counts.append(count)
            owner.append(np.full(len(key), i))
        key, at = np.unique(np.concatenate(keys or [np.empty(0, np.int64)]), return_inverse=True)
        table = np.zeros((len(key), n_lang))
        if keys:
            table[at, np.concatenate(owner)] = np.concatenate(counts)
        levels.append((key, table))
    levels = _pruned(levels, most)
    used = np.unique(levels[0][0])
    classes = np.ones(256, np.int64)
    classes[used] = np.arange(2, 2 + len(used))
    first = np.cumsum([2] + [len(key) for key, _ in levels])       # number of a level's first node
    total = int(first[-1])
    follow = np.zeros((int(first[DEPTH]), 2 + len(used)), np.int32)
    bits, leave = np.zeros((total, n_lang), np.float32), np.zeros((total, n_lang), np.float32)
    parent_keys, parent_first, lower = np.zeros(1, np.int64), 1, None
    for k, (key, table) in enumerate(levels, 1):
        parent = np.searchsorted(parent_keys, key >> 8)
        node = np.arange(first[k - 1], first[k])
        follow[parent + parent_first, classes[key & 255]] = node
        seen, kinds = np.zeros((len(parent_keys), n_lang)), np.zeros((len(parent_keys), n_lang))
        np.add.at(seen, parent, table)
        np.add.at(kinds, parent, table > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(seen > 0, np.log2((seen + kinds) / kinds), 0)
            own = np.log2((seen + kinds)[parent] / table)
        leave[parent_first:parent_first + len(parent_keys)] = out
        # unseen here: escape, then as after the shorter context
        if lower is None:
            shorter = np.full((len(key), n_lang), 8.0)
        else:
            shorter = lower[1][np.searchsorted(lower[0], key & ((1 << 8 * (k - 1)) - 1))]
        exact = np.where(table > 0, own, out[parent] + shorter)
        bits[first[k - 1]:first[k]] = exact
        parent_keys, parent_first, lower = key, int(first[k - 1]), (key, exact)
    return Trees(languages, classes, follow, bits, leave)


def _pruned(levels, most: int):
    """Drop the strings of three bytes and more seen least often in all, until at most ``most`` contexts are left.

    A string goes with all longer ones that start or end with it, which were seen no more often."""
    floor = 1
    while sum(len(key) for key, _ in levels[:DEPTH]) > most:
        floor += 1
        levels = levels[:2] + [(key[keep], table[keep]) for key, table in levels[2:] for keep in [table.sum(axis=1) >= floor]]
        if not any(len(key) for key, _ in levels[2:]):
            break
    return levels


# --- the Spark side --------------------------------------------------------------------------------------

_ascii_letter = re.compile("[A-Za-z]").search


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ascii_letter(text) is not None or any(map(str.isalpha, text)))


def sample(docs: DataFrame, texts: int = TEXTS) -> list[tuple[str, str]]:
    """The rows to fit on: (text, lang), different texts of each language by hash of the text.

    A first pass estimates the number of different texts of each language; the second keeps hashes
    below a threshold that gives about twice as many as asked for, so what is ranked is bounded."""
    able = docs.where("text is not null and lang is not null").where(F.octet_length("text") <= LONGEST)
    able = able.where(~held_out()).select("lang", "text", F.xxhash64("text").alias("h"))
    share = {r["lang"]: min(1.0, 2 * texts / r["n"]) for r in able.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not share:
        return []
    limit = F.create_map(*[F.lit(v) for name, s in sorted(share.items()) for v in (name, int(s * 2 ** 30))])
    near = able.where(F.pmod(F.xxhash64("h"), F.lit(2 ** 30)) < limit[F.col("lang")]).dropDuplicates(["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h"))
    rows = near.withColumn("at", rank).where(F.col("at") <= texts).orderBy("lang", "at").select("text", "lang").collect()
    return [(r["text"], r["lang"]) for r in rows]


def predicted(docs: DataFrame, texts: int = TEXTS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, bits_per_byte.

    Trees are fitted on rows that are not held out and have a text and a lang.  The score is the posterior of the predicted
    language under equal priors, from the code lengths; equal code lengths go to the smaller name.  A text
    that is null or has no letter is ``und`` with score 0, as is every text if nothing could be learnt.
    Whole texts are scored, of any length.  A null doc_id is not held out; repeated rows get equal results;
    extra columns are ignored; empty input gives no rows.
    """
    rows = sample(docs, texts)
    trees = fit([t.encode("utf-8", "surrogatepass") for t, _ in rows], [name for _, name in rows])
    shared = docs.sparkSession.sparkContext.broadcast(trees and vars(trees))          # of bounded size
    schema = "id long, lang_pred string, score double, bits_per_byte double"

    def run(batches):
        held = Trees(**shared.value) if shared.value else None
        for batch in slices(batches):
            ids, texts, at = batch.column("id"), batch.column("text").to_pylist(), 0
            for chunk in text_chunks(texts, BATCH):
                names, scores, rate = [], [], []
                bits = held.code_lengths(chunk) if held else None
                for i, text in enumerate(chunk):
                    if held is None or not has_letter(texts[at + i]):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        rate.append(None)
                        continue
                    best = int(bits[i].argmin())
                    names.append(held.languages[best])
                    scores.append(float(1 / np.exp2(np.maximum(bits[i][best] - bits[i], -1000)).sum()))
                    rate.append(float(bits[i][best] / len(text)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(chunk)), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                                  pa.array(rate, pa.float64())], ["id", "lang_pred", "score", "bits_per_byte"])
                at += len(chunk)

    found = docs.select(id_key().alias("id"), "text").mapInArrow(run, schema)
    found = found.select(from_key("id").alias("doc_id"), "lang_pred", "score", "bits_per_byte")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
