"""Rows and plain re-computations that several tests use."""
from __future__ import annotations

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, th string, key string, label string, n long, "
          "rep string, kept string, size string, _id string, text_crc32 string, part string, queue string, line string, band string, at string")
WORD = re.compile("[^\x20\x09-\x0D]+")


def rows(texts, source=None):
    """Rows of documents with extra columns whose names clash with those the operators use inside."""
    out = []
    for i, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (i, t)
        out.append((i, t, "en", (source or (lambda k: f"s{(k or 0) % 3}"))(i), None if t is None else len(t), *["x"] * 4, 1, *["x"] * 10))
    return out


def frame(spark, texts, source=None):
    return spark.createDataFrame(rows(texts, source), SCHEMA)


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(t or "")


def shingles(t, n):
    w = words(fold(t))
    if not w:
        return set()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10 ** 6)}" if r.random() < share else w for w in text.split(" "))


EDGES = [None, "", "   \t\n ", "one", "one", "a b c", (None, "null id text of some words here"), (None, None), (3, "one"), (7, "Une École à l'été"),
         "x" * 100_000, "long " * 30_000, "tab\tand\x0bvt\x0cff\rcr\nnl", "<|endoftext|> MIT License, it's <b>", "İstanbul ΣΑΣ ǅ straße é"]
