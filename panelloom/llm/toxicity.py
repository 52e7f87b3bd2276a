"""Toxicity of whole texts by the recurrent network of ``gru``, fitted on labelled rows and run on all rows."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import gru
from .common import from_key, id_key, slices, text_chunks

#: The classifier is fitted on so many labelled rows of each label at most, by hash of their id ...
ONES, ZEROS = 1000, 2000
#: ... among texts of at most so many bytes.
LONGEST = 30_000
THRESHOLD = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def sample(docs: DataFrame, labels: DataFrame, ones: int = ONES, zeros: int = ZEROS) -> list[tuple[str, int]]:
    """The rows to fit on: (text, label).  An id with both labels counts as 1; null ids and labels are left out."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.where("text is not null").where(F.octet_length("text") <= LONGEST).where(~held_out()).select("doc_id").distinct()
    known = usable.join(marked, "doc_id")
    chosen = {}
    for label, n in ((1, ones), (0, zeros)):
        rows = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
        chosen |= {r["doc_id"]: label for r in rows}
    if not chosen:
        return []
    texts = docs.where(F.col("doc_id").isin(list(chosen))).where(F.octet_length("text") <= LONGEST)
    # ids that repeat give one text
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [(r["text"], chosen[r["doc_id"]]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame) -> gru.Network | None:
    """The network, or None if the sample lacks a label."""
    rows = sample(docs, labels)
    y = np.array([label for _, label in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return gru.train([t.encode("utf-8") for t, _ in rows], y)


def score(docs: DataFrame, network: gru.Network | None) -> DataFrame:
    """(doc_id, toxicity) for each row of ``docs``; all overlapping windows of the whole text count."""
    if network is None:
        return docs.select("doc_id", F.lit(0.0).alias("toxicity"))
    shared = docs.sparkSession.sparkContext.broadcast(network.weights)       # of fixed size

    def run(batches):
        model = gru.Network(shared.value)
        for batch in slices(batches):
            found = [model.probabilities(model.text_logits(c)) for c in text_chunks(batch.column("text").to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(found), pa.float64())], ["id", "toxicity"])

    found = docs.select(id_key().alias("id"), "text").mapInArrow(run, "id long, toxicity double")
    return found.select(from_key("id").alias("doc_id"), "toxicity")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts are scored as a window of nothing.  Without both labels in the sample every score
    is 0.  Repeated rows get equal scores; a null doc_id is not held out and never learnt from.  Extra
    columns are ignored; empty input gives no rows.
    """
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    network = fit(docs, labels)
    if network is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(network.weights)
    at = docs.columns.index("text")

    def keep(batches):
        model = gru.Network(shared.value)
        for batch in slices(batches):
            found = [model.probabilities(model.text_logits(c)) for c in text_chunks(batch.column(at).to_pylist())]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) < threshold))

    return docs.mapInArrow(keep, docs.schema)
