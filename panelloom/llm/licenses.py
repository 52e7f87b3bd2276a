"""License scan: exact set-similarity join of text blocks with license templates.

A block is a window of words.  Templates of up to 2^c words are sought in windows of 2^(c+1) words every
2^c words over the whole text, across line ends, so any stretch of a template's length lies whole in one.
Tokens of templates are ordered by how many texts of the corpus hold them, rarest first.  If a block holds at
least ``need = ceil(threshold * |T|)`` of a template's tokens, the first ``|T| - need + 1`` tokens of the template and
the first ``|B| - need + 1`` of the block (both in that order) share one; blocks and templates meet on those
tokens only, after a length and a positional filter.  Tokens in no template are in no intersection, so a
text is cut to template tokens first, and blocks are formed around tokens that a match cannot do without.

A template can name words that a block must hold and words that it must not: they tell templates apart that
share nearly all their words.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import LOWER, UPPER, id_key, written

#: Word rule, base phrases, and templates of the method (label, text).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: (label, text, words a block must hold, words it must not hold).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit"], []),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission", "granted"], []),
    ("apache", "licensed under the apache license version 2 0", ["apache"], []),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general", "public"], ["lesser", "affero"]),
    ("lgpl", "this library is licensed under the gnu lesser general public license version 3", ["lesser"], []),
    ("agpl", "this work is licensed under the gnu affero general public license version 3", ["affero"], []),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc", "nc"], []),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc", "sa"], ["nc"]),
    ("cc-by", "licensed under cc by 4 0", ["cc", "by"], ["nc", "sa", "nd"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution", "binary"], []),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla"], []),
    ("reserved", "all rights reserved", ["reserved"], []),
]
THRESHOLD = 0.8


def base_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase among ``words``."""
    tokens = phrase.split()

    def here(i):
        ok = F.get(words, i) == tokens[0]
        for k, t in enumerate(tokens[1:], 1):
            ok = ok & (F.get(words, i + k) == t)
        return ok
    return F.filter(F.sequence(F.lit(0), F.size(words) - len(tokens)), here)


def base_matches(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and _base (labels) to rows with ``text``."""
    folded = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    d = docs.withColumn("_words", F.array_remove(F.split(folded, GAP, -1), ""))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    none = F.array().cast("array<int>")
    for i, (phrase, _) in enumerate(phrases):
        last = phrase.split()[-1]
        fits = F.array_contains("_words", last) & (F.size("_words") >= len(phrase.split()))
        d = d.withColumn(f"_p{i}", F.when(fits, base_places(F.col("_words"), phrase)).otherwise(none))
    places = F.concat(*[F.col(f"_p{i}") for i in range(len(phrases))])
    labels = F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)])
    d = d.withColumns({"n_base": F.size(places).cast("long"), "first_word": F.array_min(places).cast("long"), "last_word": F.array_max(places).cast("long"),
                       "_base": F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull())))})
    return d.drop("_words", *[f"_p{i}" for i in range(len(phrases))])


def window_class(text: str) -> int:
    """c of a template: it has at most 2^c words and is sought in windows of 2^(c+1) words every 2^c."""
    return max(1, math.ceil(math.log2(len(text.split()))))


def template_matches(docs: DataFrame, templates: Sequence[tuple] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, th, class, start, label, score): windows of rows (id, th, text) that hold at least ``threshold`` of the
    distinct words of a template, with the share they hold, all its ``must`` words and none it must not hold."""
    spark: SparkSession = docs.sparkSession
    sets = [(label, sorted(set(text.split())), window_class(text), list(must), list(without)) for label, text, must, without in templates if text.split()]
    vocabulary = sorted({t for _, s, _, must, without in sets for t in (*s, *must, *without)})
    least = min(max(1, math.ceil(threshold * len(s) - 1e-9)) for _, s, _, _, _ in sets)
    words = F.array_remove(F.split(F.translate("text", UPPER, LOWER), GAP, -1), "")
    known = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("i"), w.alias("w")))))
    rows = docs.where("text is not null").select("id", "th", known.alias("known")).where(F.size("known") >= least)
    rows = written(rows, "known")

    # one row for each template token at most
    held = rows.select(F.explode(F.array_distinct(F.col("known.w"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    count = {r["t"]: r["n"] for r in held.collect()}
    order = sorted(vocabulary, key=lambda t: (count.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    index, whole, anchors = [], [], {}
    for number, (label, s, c, must, without) in enumerate(sets):
        ordered = sorted(s, key=rank.get)
        need = max(1, math.ceil(threshold * len(s) - 1e-9))
        whole.append((number, label, ordered, need, must, without))
        prefix = ordered[:len(s) - need + 1]
        index += [(t, c, number, len(s), need, i) for i, t in enumerate(prefix)]
        # a match holds all must words, and one of the prefix
        anchors.setdefault(c, set()).update([min(must, key=rank.get)] if must else prefix)
    index = spark.createDataFrame(index, "token string, class int, template int, t_size int, need int, t_at int")
    whole = spark.createDataFrame(whole, "template int, label string, tokens array<string>, need int, must array<string>, without array<string>")

    def windows(c: int, tokens) -> Column:
        step = 1 << c
        hits = F.filter("known", lambda x: x["w"].isin(sorted(tokens)))
        starts = F.flatten(F.transform(hits, lambda x: F.array((x["i"] / step).cast("int") * step, (x["i"] / step).cast("int") * step - step)))
        return F.transform(F.array_distinct(F.filter(starts, lambda x: x >= 0)), lambda x: F.struct(F.lit(c).alias("class"), x.alias("start")))

    at = rows.select("id", "th", "known", F.explode(F.concat(*[windows(c, tokens) for c, tokens in sorted(anchors.items())])).alias("b"))
    stop = F.expr("b.start + shiftleft(2, b.class)")
    inside = F.transform(F.filter("known", lambda x: (x["i"] >= F.col("b.start")) & (x["i"] < stop)), lambda x: x["w"])
    blocks = at.select("id", "th", "b.class", "b.start", F.array_intersect(F.array(*map(F.lit, order)), inside).alias("known")).where(F.size("known") >= least)
    prefix = blocks.select("id", "th", "class", "start", "known", F.posexplode(F.slice("known", F.lit(1), F.size("known") - (least - 1))).alias("b_at", "token"))
    size = F.size("known")
    # a few rows for each template, whatever the corpus
    met = prefix.join(F.broadcast(index), ["token", "class"]).where((size >= F.col("need")) & (F.col("b_at") <= size - F.col("need"))
                                                                    & (F.least(size - F.col("b_at"), F.col("t_size") - F.col("t_at")) >= F.col("need")))
    met = met.select("id", "th", "class", "start", "known", "template").distinct()
    found = met.join(F.broadcast(whole), "template").withColumn("held", F.size(F.array_intersect("known", "tokens"))).where("held >= need")
    found = found.where((F.size(F.array_except("must", "known")) == 0) & ~F.arrays_overlap("without", "known"))
    return found.select("id", "th", "class", "start", "label", (F.col("held") / F.size("tokens")).alias("score"))


def scan(docs: DataFrame, templates: Sequence[tuple] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score,
    n_blocks (windows that meet a template).

    The score is 1 where a base phrase stands, else the best share of a template held by a window that
    meets it, else 0.  Labels are distinct, sorted, comma-joined, empty if there are none.
    Null and empty texts have no words.  Rows with equal doc_id and text get one result; a null doc_id is an
    id like others.  Extra columns are ignored; empty input gives no rows.
    """
    rows = docs.select("doc_id", "text", id_key().alias("id"), F.xxhash64("text").alias("th"))
    base = base_matches(rows).drop("text")
    found = template_matches(rows, templates, threshold)
    found = found.groupBy("id", "th").agg(F.collect_set("label").alias("_more"), F.max("score").alias("_score"), F.countDistinct("class", "start").alias("n_blocks"))
    out = base.join(found, ["id", "th"], "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
                      F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_more", none))), ",").alias("labels"),
                      F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
                      F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))
