"""Line dedup over overlapping windows of three lines."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import id_key, packed, written

#: What is cut off a line before it is compared; a line of nothing else is blank.
EDGES = " \t\r"
WINDOW = 3


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(id, th, at, w1, w2): every window of ``width`` consecutive lines that are not blank; ``at`` lists
    their line numbers in the text, ``w1`` and ``w2`` are 128 bits of hash, ``th`` is the hash of the text."""
    line = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(EDGES)).alias("x")))
    rows = docs.select("id", "th", F.filter(line, lambda s: s["x"] != "").alias("lines")).where(F.size("lines") >= width)
    rows = rows.select("id", "th", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - width)).alias("k"))
    own = [F.col("lines")[F.col("k") + j] for j in range(width)]
    # the length of a part before it keeps ("ab", "c") and ("a", "bc") apart
    parts = [c for s in own for c in (F.length(s["x"]), s["x"])]
    return rows.select("id", "th", F.array(*[s["i"] for s in own]).alias("at"), F.xxhash64(*parts).alias("w1"),
                       F.xxhash64(F.lit(1), *parts).alias("w2"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` (not blank) and ``n_removed``.

    A window of lines that occurs again, in any document, stays where it is first by (doc_id, text hash,
    position) and is removed elsewhere: the lines covered by removed windows are merged and taken out,
    blank lines stay.  A repeat that overlaps the first occurrence takes the shared lines out, so a line
    repeated on end is left once.  Fewer than ``width`` lines: unchanged.  Null text stays null with 0
    lines; a null doc_id comes first.  Rows with equal doc_id and text are one document and get one result.
    All other columns of ``docs`` are kept.
    """
    key = packed(docs).select("row", id_key("row.doc_id").alias("id"), F.xxhash64("row.text").alias("th"))
    found = windows(key.select("id", "th", F.col("row.text").alias("text")).where("text is not null"), width)
    place = F.struct("id", "th", F.col("at")[0].alias("at"))
    again = found.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
    later = found.join(again, ["w1", "w2"]).where(place != F.col("first"))
    covered = later.select("id", "th", F.explode("at").alias("at")).groupBy("id", "th").agg(F.collect_set("at").alias("gone"))
    covered = written(covered, "covered-lines")
    # texts meet their lines by one shuffle at every size
    out = key.join(covered.hint("merge"), ["id", "th"], "left")
    text = F.col("row.text")
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    clean = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    number = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(EDGES)) != ""))
    added = {"clean_text": clean, "n_lines": F.when(text.isNull(), 0).otherwise(number).cast("long"),
             "n_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")}
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *[c.alias(n) for n, c in added.items()])
