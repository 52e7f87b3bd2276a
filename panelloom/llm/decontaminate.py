"""Benchmark decontamination by spaced seeds.

A mask is a row of 1 and 0; a seed is the hash of the words under its 1s, so words under a 0 may differ.
Every position of a training text is hashed under every mask and looked up among the seeds of the
benchmark; a hit fixes how text and item lie against each other, and the windows of the item around the
hit are compared word by word.

The acceptance rule is local, so its meaning and cost do not depend on an item's length: of WINDOW
consecutive item words at least EQUAL stand in the same places of the text.  The masks are fixed; between
them they hit every way in which up to WINDOW - EQUAL words of a window can differ (a test goes through all of
them), so no overlap that the rule accepts is missed.  Items shorter than a window are compared whole.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import from_key, id_key, packed, sized, union_all, words_of, written

#: Items of fewer words are ignored.
LEAST_WORDS = 5
#: Words of a window, and how many of them must be equal; for shorter items the share of their words.
WINDOW, EQUAL, EQUAL_SHARE = 13, 10, 0.75
#: Masks for items of at least WINDOW words, and for shorter ones.
MASKS, SHORT_MASKS = ("111011", "1100001011", "110111"), ("111", "1101")
#: Seeds that are sent to all executors at once, about 40 bytes each; a larger benchmark goes in several blocks.
SEEDS_AT_ONCE = 500_000


def hashed_words(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def seed(mask: str, words: Column, at: Column) -> Column:
    """Hash of the words under the mask; the mask is part of it."""
    return F.xxhash64(F.lit(mask), *[F.get(words, at + i) for i, c in enumerate(mask) if c == "1"])


def window_of(n: Column) -> Column:
    return F.least(n, F.lit(WINDOW))


def needed(n: Column) -> Column:
    """Equal words that make an overlap with a window of an item of ``n`` words."""
    return F.when(n >= WINDOW, EQUAL).otherwise(F.ceil(n * EQUAL_SHARE)).cast("int")


def seeds_of(items: DataFrame) -> tuple[DataFrame, list[str]]:
    """(h, item, q, span): the seeds of items (item, iw) and the masks in use."""
    n = F.size("iw")
    kinds = items.select((n >= WINDOW).alias("long")).distinct().collect()
    masks = [m for long, own in ((True, MASKS), (False, SHORT_MASKS)) if any(r["long"] == long for r in kinds) for m in own]
    at = items.select("item", "iw", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("q"))
    own = [F.when(((F.col("n") >= WINDOW) == F.lit(m in MASKS)) & (F.col("q") + len(m) <= F.col("n")),
                  F.struct(seed(m, F.col("iw"), F.col("q")).alias("h"), F.lit(len(m)).alias("span"))) for m in masks]
    empty = F.lit(None).cast("struct<h:bigint,span:int>")
    return at.select(F.explode(F.array_compact(F.array(*own or [empty]))).alias("s"), "item", "q").select("s.h", "item", "q", "s.span"), masks


def windows_around(there: Column, iw: Column, q: Column, span: Column, start: Column, lo: Column, first: Column) -> Column:
    """(equal, at) of the windows that hold the hit and enough equal words.

    A window begins at an equal word, or as late as the item allows for words nearer to its end; ``at`` is that
    word's place in the text.  ``there`` holds the text's words from item place ``first`` on, ``lo`` is the first
    item place that a window around the hit can have."""
    n = F.size(iw)
    width = window_of(n)
    hi = F.least(n, q + width)
    same = F.transform(F.sequence(lo, hi - 1), lambda k: F.coalesce(F.get(there, k - first) == F.get(iw, k), F.lit(False)).cast("int"))

    def window(k: Column) -> Column:
        o = F.least(k, n - width)
        total = F.aggregate(F.slice(same, o - lo + 1, width), F.lit(0), lambda a, x: a + x)
        fits = (F.get(same, k - lo) == 1) & (o >= lo) & (o <= q) & (o + width >= q + span)
        return F.struct(F.when(fits, total).otherwise(0).alias("equal"), F.greatest(start + k, F.lit(0)).alias("at"))

    return F.filter(F.transform(F.sequence(lo, hi - 1), window), lambda w: w["equal"] >= needed(n))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, th, item_id, equal_words, item_words, first_word): verified overlaps of documents and items.

    Words are cut at white space, A-Z folded.  Text and item lie against each other as a seed hit tells;
    the pair is an overlap if a window of WINDOW item words (the whole item, if shorter) has EQUAL words
    (EQUAL_SHARE of the item, rounded up) equal in place.  ``equal_words`` is the most equal words of a window,
    ``first_word`` the smallest place in the text of an equal word that begins such a window.

    Null texts and items, and items of fewer than LEAST_WORDS words, overlap with nothing.  Repeated
    items are one item for each item_id; a null item_id counts as the smallest.  ``id`` and ``th`` are the
    null-safe id and the hash of the text.  Empty tables give no rows.
    """
    items = benchmark.where("text is not null").select(id_key("item_id").alias("item_id"), hashed_words(F.col("text")).alias("iw"))
    items = items.where(F.size("iw") >= LEAST_WORDS).distinct()
    items = written(items.withColumn("item", F.xxhash64("item_id", "iw")), "items")
    seeds, masks = seeds_of(items)
    seeds = written(seeds.distinct(), "seeds")
    blocks = 1 + seeds.count() // SEEDS_AT_ONCE
    texts = docs.where("text is not null").select(id_key().alias("id"), F.xxhash64("text").alias("th"), hashed_words(F.col("text")).alias("tw"))
    at = texts.where(F.size("tw") >= 1).select("id", "th", "tw", F.explode(F.sequence(F.lit(0), F.size("tw") - 1)).alias("p"))
    at = at.select("id", "th", "tw", "p", F.explode(F.array(*[seed(m, F.col("tw"), F.col("p")) for m in masks] or [F.lit(0).cast("long")])).alias("h"))
    start, lo = F.col("p") - F.col("q"), F.greatest(F.col("q") + F.col("span") - WINDOW, F.lit(0))
    first = F.greatest(lo, -start)
    found = []
    for b in range(blocks):
        mine = seeds.where(F.pmod("item", F.lit(blocks)) == b)
        # the words around the hit are cut out at once, so that no row carries a text from here on
        hit = at.join(F.broadcast(mine), "h").select("id", "th", "item", "q", "span", start.alias("start"), lo.alias("lo"), first.alias("first"),
                                                     F.slice("tw", start + first + 1, F.lit(2 * WINDOW)).alias("there"))
        found.append(hit)
    # many seeds of one stretch hit; the items are joined by Spark's own choice
    hit = union_all(found).join(items, "item")
    c = {x: F.col(x) for x in ("there", "iw", "q", "span", "start", "lo", "first")}
    hit = hit.select("id", "th", "item_id", F.size("iw").alias("n"), F.explode(windows_around(**c)).alias("w"))
    return hit.groupBy("id", "th", "item_id").agg(
        F.max("w.equal").cast("long").alias("equal_words"), F.max("n").cast("long").alias("item_words"), F.min("w.at").cast("long").alias("first_word"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, equal_words, item_words, first_word), one row for each overlapping pair of ids."""
    pairs = overlaps(docs, benchmark).groupBy("id", "item_id").agg(
        F.max("equal_words").alias("equal_words"), F.max("item_words").alias("item_words"), F.min("first_word").alias("first_word"))
    return pairs.select(from_key("id").alias("doc_id"), from_key("item_id").alias("item_id"), "equal_words", "item_words", "first_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text overlaps with no item; null texts stay."""
    bad = written(overlaps(docs, benchmark).select("id", "th").distinct(), "contaminated")
    rows = packed(docs).select("row", id_key("row.doc_id").alias("id"), F.xxhash64("row.text").alias("th"))
    return rows.join(sized(bad), ["id", "th"], "left_anti").select("row.*")
