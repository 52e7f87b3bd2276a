"""What several operators share: reading tables, cutting lineage, null-safe keys, word hashes."""
from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of every word rule here: space and the six ASCII controls 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id in joins: a null doc_id counts as one document with the smallest id.
NULL_ID = -(2 ** 63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one of our own, in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="llm-")
    return _own[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read back: lineage ends, columns can be pruned."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_key(c: str = "doc_id") -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(NULL_ID))


def from_key(c: str) -> Column:
    return F.when(F.col(c) != NULL_ID, F.col(c))


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that helper columns beside it cannot clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def words_of(text: Column) -> Column:
    """Words between white space, A-Z folded."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SPACE, -1), "")


def sized(keys: DataFrame, at_most: int = 1_000_000) -> DataFrame:
    """A written table of a few short columns, sent to all executors only up to ``at_most`` rows."""
    return F.broadcast(keys) if keys.count() <= at_most else keys


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


# --- words of a batch of texts as 64-bit hashes (numpy, inside tasks) ---------------------------------

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TABLE_FOLDED = _TABLE[_FOLD]
CHUNK_BYTES = 1 << 20
_powers: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches, rows: int = 512):
    """Arrow batches cut into short ones, so that only a few texts at a time become Python objects; unused memory is
    handed back at the end, as a worker lives on for the next stage."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    pa.default_memory_pool().release_unused()


def text_chunks(texts, at_most: int = CHUNK_BYTES):
    """Runs of consecutive texts (as bytes) of about ``at_most`` bytes; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if run and size + len(b) > at_most:
            yield run
            run, size = [], 0
        run.append(b)
        size += len(b)
    if run:
        yield run


def word_hashes(run: list[bytes]):
    """Hashes of all words of the texts, A-Z folded.

    Returns (hashes, bounds): words of text i are hashes[bounds[i]:bounds[i+1]].
    """
    return _hashed(np.frombuffer(b" " + b" ".join(run) + b" ", np.uint8), run, _TABLE_FOLDED)[:2]


def exact_word_hashes(run: list[bytes]):
    """As ``word_hashes`` with capitals kept apart, and the code points in the words of each text."""
    a = np.frombuffer(b" " + b" ".join(run) + b" ", np.uint8)
    hashes, bounds, firsts = _hashed(a, run, _TABLE)
    points = np.concatenate([[0], np.cumsum(~_IS_SPACE[a] & ((a & 0xC0) != 0x80))])
    return hashes, bounds, np.diff(points[firsts])


def _hashed(a: np.ndarray, run: list[bytes], table: np.ndarray):
    space = _IS_SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power(len(a) + 1)
    prefix = np.empty(len(a) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(table[a] * power[:-1], out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * inverse[starts])
    firsts = np.cumsum([1] + [len(b) + 1 for b in run])
    return hashes, np.searchsorted(starts, firsts), firsts
