"""Packing by deficit round robin over source queues.

Every document is a run of token ids in the queue of its source.  Windows of fixed length are filled from
all queues in the target proportions: of the first ``s`` tokens served, the queues up to the k-th get
``floor(s * W_k / W)`` (W_k: sum of the first k weights).  What a queue is short of or ahead of its share,
its deficit, is below one token and carries over from window to window; because it is a function of
``s`` alone, any partition can cut any window without knowing the others.  When a queue runs dry the
rest go on in their proportions (a new phase).

A source with a share of at least LEAST tokens a window (so there are few) has its own queue.  All others
share the tail, where deficits are carried over many windows: a tail source is served in bursts of QUANTUM
tokens, each due when its share has come to it, and the bursts of all tail sources are put in the order of
their due times.  Sources with a given weight have their own queue and go first.
"""
from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_right
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from .common import from_key, id_key, sized, slices, written

WINDOW = 2048
END = 1
#: Words whose ids a worker keeps, the first it meets (the first half also with their signs and capitals); and the longest such word in bytes.
KEPT_WORDS, KEPT_LENGTH = 160_000, 40
#: A run of these around letters is one piece of the text for the tokenizer; an apostrophe may start a contraction.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A source with so many tokens a window has its own queue; the others are served in bursts of QUANTUM tokens.
LEAST, QUANTUM = 8, 128
#: Blocks of due times in which bursts are put in order.
BLOCKS = 1024
#: The queue of the tail.
TAIL = 0


# --- token ids ------------------------------------------------------------------------------------------

def _byte_letters() -> str:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    stand = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(stand[b] for b in range(256))


class WordIds(dict):
    """Ids of a text as little-endian 16-bit numbers, from ids of its words (the keys, as bytes).

    The tokenizer drops white space and no token spans it, so words can be encoded alone.  Letters with signs
    before or after them go to the vocabulary directly, piece by piece; any other word goes through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 65536:
            raise ValueError("ids do not fit 16 bits")
        self.tokenize = self.whole.model.tokenize
        self.letters = _byte_letters()
        self.two = [i.to_bytes(2, "little") for i in range(65536)]
        self.signs: dict[bytes, bytes] = {b"": b""}

    def _part(self, part: bytes) -> bytes:
        two = self.two
        return b"".join([two[t.id] for t in self.tokenize(charmap_decode(part, "strict", self.letters)[0])])

    def _signs(self, signs: bytes) -> bytes:
        ids = self.signs.get(signs)
        if ids is None:
            ids = self._part(signs)
            if len(self.signs) < 10_000 and len(signs) <= KEPT_LENGTH:
                self.signs[signs] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        base = word.strip(SIGNS)
        low = None
        if len(word) <= KEPT_LENGTH and b"<|" not in word:
            if base.isalpha():                            # of bytes: ASCII letters
                low = base.lower()
            else:
                text = base.decode("utf-8")
                # Latin letters have one lower case each; others are left to the tokenizer
                if text.isalpha() and max(text) < "Ā" and unicodedata.is_normalized("NFC", text):
                    low = text.lower().encode("utf-8")
        if low is None:
            two = self.two
            ids = b"".join([two[i] for i in self.whole.encode(word.decode("utf-8"), add_special_tokens=False).ids])
        else:
            ids = self.get(low)
            if ids is None:
                ids = self._part(low)
                if len(self) < KEPT_WORDS:
                    self[low] = ids
            if low == word:
                return ids
            if len(base) < len(word):
                at = word.index(base)
                ids = self._signs(word[:at]) + ids + self._signs(word[at + len(base):])
        if len(self) < KEPT_WORDS // 2 and len(word) <= KEPT_LENGTH:
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8").split()))      # bytes split at ASCII white space


_loaded: dict = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


# --- the schedule ---------------------------------------------------------------------------------------

class Phase:
    """Tokens t0 to t0 + length of the whole stream, dealt to ``queues`` by ``weights``; ``served`` is what
    each queue has given before."""

    def __init__(self, t0: int, length: int, queues: list[int], weights: list[int], served: dict[int, int]):
        self.t0, self.length, self.queues = t0, length, queues
        self.bounds = [0]
        for w in weights:
            self.bounds.append(self.bounds[-1] + w)
        self.total = self.bounds[-1]
        self.served = [served[q] for q in queues]
        self.place = {q: k for k, q in enumerate(queues)}

    def upto(self, k: int, s: int) -> int:
        """Tokens of the first k queues among the first s of the phase."""
        return s * self.bounds[k] // self.total


def raised(weights: list[int], window: int | None) -> list[int]:
    """Weights of at least one token a window, below which rounding could take a token back."""
    if window is None:
        return weights
    if len(weights) >= window:
        raise ValueError("more queues than tokens in a window")
    least = sum(weights) // (window - len(weights)) + 1
    return [max(w, least) for w in weights]


def schedule(sizes: dict[int, int], weights: dict[int, int] | None = None, window: int | None = None) -> list[Phase]:
    """Phases that serve all tokens; weights are positive integers, by default the sizes themselves (every
    window then mirrors the corpus, and there is one phase unless a queue has less than a token a window)."""
    left = {q: n for q, n in sorted(sizes.items()) if n > 0}
    given = {q: 0 for q in left}
    weights = {q: (weights or sizes).get(q, 0) for q in left}
    phases, t = [], 0
    while left:
        queues = [q for q in left if weights[q] > 0] or list(left)
        own = raised([max(1, weights[q]) for q in queues], window)
        nearly = [q for q in queues if left[q] <= 2]
        if nearly and len(queues) > len(nearly):
            queues, own = nearly[:1], [1]
        total = sum(own)
        length = min(left[q] * total // w for q, w in zip(queues, own))
        p = Phase(t, length, queues, own, given)
        takes = lambda s: [p.upto(k + 1, s) - p.upto(k, s) for k in range(len(queues))]
        while length > 1 and any(x > left[q] for x, q in zip(takes(length), queues)):
            length -= 1
        if length < 1 or any(x > left[q] for x, q in zip(takes(length), queues)):
            queues, own = [min(queues, key=left.get)], [1]
            length = left[queues[0]]
            p = Phase(t, length, queues, own, given)
        p.length = length
        for x, q in zip(takes(length), queues):
            given[q] += x
            left[q] -= x
            if not left[q]:
                del left[q]
        phases.append(p)
        t += length
    return phases


def pieces(phases: list[Phase], queue: int, a: int, b: int, window: int = WINDOW):
    """(start in the queue, length, window, offset) of the tokens a to b of a queue, in order."""
    mine = [p for p in phases if queue in p.place]
    i = max(0, bisect_right([p.served[p.place[queue]] for p in mine], a) - 1)
    while a < b:
        p = mine[i]
        k = p.place[queue]
        before = p.served[k]
        give = lambda s: before + p.upto(k + 1, s) - p.upto(k, s)
        if a >= give(p.length):
            i += 1
            continue
        # the window that serves token a: near its share of the phase
        w = (p.t0 + (a - before) * p.total // (p.bounds[k + 1] - p.bounds[k])) // window
        first, last = p.t0 // window, (p.t0 + p.length - 1) // window
        w = min(max(w, first), last)
        cut = lambda w: min(max(w * window - p.t0, 0), p.length)
        while give(cut(w)) > a:
            w -= 1
        while give(cut(w + 1)) <= a:
            w += 1
        while a < b and w <= last:
            s0, s1 = cut(w), cut(w + 1)
            start, stop = give(s0), give(s1)
            if a < stop:
                end = min(b, stop)
                offset = p.t0 + s0 - w * window + p.upto(k, s1) - p.upto(k, s0) + a - start
                yield a, end - a, w, offset
                a = end
            w += 1


TOKENS = "id long, queue string, part int, at long, n long, ids binary"
PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def tail_bursts(sizes: DataFrame, quantum: int) -> DataFrame:
    """(queue, burst, pos): where in the tail each burst of each source (queue, size) starts.

    Burst j of a source is due at (j + phase) * quantum / size, with a phase by hash; blocks of due times are
    summed first, so no task holds all."""
    phase = F.pmod(F.xxhash64("queue", F.lit("phase")), F.lit(4096)) / 4096.0
    bursts = sizes.withColumn("burst", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / quantum))))
    bursts = bursts.select("queue", "burst", F.least(F.lit(quantum).cast("long"), F.col("size") - F.col("burst") * quantum).alias("n"),
                           ((F.col("burst") + phase) * quantum / F.greatest("size", F.lit(quantum))).alias("due"))
    bursts = written(bursts.withColumn("block", F.least(F.lit(BLOCKS - 1), F.floor(F.col("due") * BLOCKS)).cast("int")), "bursts")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = bursts.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", before(Window.partitionBy(F.lit(0)).orderBy("block")).alias("low"))
    inside = before(Window.partitionBy("block").orderBy("due", "queue", "burst")).alias("within")
    return bursts.select("queue", "burst", "block", inside).join(F.broadcast(blocks), "block").select("queue", "burst", (F.col("low") + F.col("within")).alias("pos"))


def pack(docs: DataFrame, path: str | None = None, weights: dict[str, int] | None = None, window: int = WINDOW,
         quantum: int = QUANTUM) -> DataFrame:
    """Pieces of all documents (doc_id, text, source) in windows of ``window`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue (the source); every id
    of a document and its end id lie in one piece; only the last window is short.  ``weights`` maps sources
    to positive integers (a share below one token a window counts as one); sources without a weight are
    served when those are done, in the proportions of their tokens.  A weight for a source that has no documents is an
    error, as its share would silently go to the others.

    Null text is empty (one end id), null source the empty source, a null doc_id stays null.  Queues are
    in the order of the table; repeated rows are documents of their own.  Extra columns are ignored;
    empty input gives no rows.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def encode(batches):
        ids_of, part, at = word_ids(path), TaskContext.get().partitionId(), {}
        for batch in slices(batches):
            rows = {c: [] for c in ("id", "queue", "part", "at", "n", "ids")}
            for i, q, text in zip(*(batch.column(c).to_pylist() for c in ("id", "source", "text"))):
                ids = ids_of.text(text or "") + b"\x01\x00"
                n = len(ids) // 2
                for c, v in zip(rows, (i, q, part, at.get(q, 0), n, ids)):
                    rows[c].append(v)
                at[q] = at.get(q, 0) + n
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))

    source = F.coalesce("source", F.lit(""))
    tokens = written(docs.select(id_key().alias("id"), source.alias("source"), "text").mapInArrow(encode, TOKENS), "tokens")
    parts = written(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "parts")
    sizes = parts.groupBy("queue").agg(F.sum("n").alias("size"))
    total = parts.agg(F.sum("n").alias("n")).first()["n"] or 0
    weights = weights or {}
    if weights and min(weights.values()) < 1:
        raise ValueError("weights are positive integers")
    large = sizes.where((F.col("size") * window >= LEAST * total) | F.col("queue").isin(list(weights))).collect()
    sizes_of = {r["queue"]: r["size"] for r in large}
    if lost := sorted(set(weights) - set(sizes_of)):
        raise ValueError(f"weights for sources without documents: {', '.join(lost[:20])}")
    queue_of = {q: i for i, q in enumerate(sorted(sizes_of), 1)}
    phases = schedule({queue_of[q]: sizes_of[q] for q in weights}, {queue_of[q]: w for q, w in weights.items()}, window) if weights else []
    first = sum(p.length for p in phases)
    others = {queue_of[q]: n for q, n in sizes_of.items() if q not in weights} | {TAIL: total - sum(sizes_of.values())}
    for p in schedule(others, None, window):
        p.t0 += first
        phases.append(p)
    own = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(parts.select("queue", "part", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("base")), "queue-parts")
    placed = tokens.join(sized(base), ["queue", "part"]).select("id", "queue", (F.col("at") + F.col("base")).alias("a"), "n", "ids")
    # (a: where in the queue the ids start, lo: where in the document)
    rows = placed.withColumn("lo", F.lit(0).cast("long"))
    if others[TAIL]:
        is_own = F.col("queue").isin(list(queue_of)) if queue_of else F.lit(False)
        bursts = tail_bursts(sizes.where(~is_own), quantum)
        tail = rows.where(~is_own).withColumn("burst", F.explode(F.sequence(F.floor(F.col("a") / quantum), F.floor((F.col("a") + F.col("n") - 1) / quantum))))
        start = F.greatest("a", F.col("burst") * quantum)
        stop = F.least(F.col("a") + F.col("n"), (F.col("burst") + 1) * quantum)
        tail = tail.join(bursts, ["queue", "burst"]).withColumns({"start": start, "stop": stop}).withColumn("lo", F.col("start") - F.col("a"))
        cut_ids = F.substring("ids", (2 * F.col("lo") + 1).cast("int"), (2 * (F.col("stop") - F.col("start"))).cast("int"))
        tail = tail.select("id", "queue", (F.col("pos") + F.col("start") - F.col("burst") * quantum).alias("a"), "n", cut_ids.alias("ids"), "lo")
        rows = rows.where(is_own).unionByName(tail)

    def cut(batches):
        for batch in slices(batches):
            rows = {c.split()[0]: [] for c in PIECES.split(", ")}
            for i, q, a, n, ids, before in zip(*(batch.column(c).to_pylist() for c in ("id", "queue", "a", "n", "ids", "lo"))):
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                for start, length, w, offset in pieces(phases, queue_of.get(q, TAIL), a, a + len(ids) // 2, window):
                    lo = start - a
                    for c, v in zip(rows.values(), (i, before + lo, length, zlib.crc32(wide[4 * lo:4 * (lo + length)]), n, w, offset, q)):
                        c.append(v)
            kinds = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))

    found = rows.select("id", "queue", "a", "n", "ids", "lo").mapInArrow(cut, PIECES)
    return found.select(from_key("id").alias("doc_id"), *[c.split()[0] for c in PIECES.split(", ")[1:]])
