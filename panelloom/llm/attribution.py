"""Token counts by section: whole texts are encoded once, and token spans are joined to section spans.

Byte-level tokens cover a text without gaps, so the ends of the tokens are the running sum of their
byte lengths.  Sections are spans of the same bytes in ascending order; both lists are sorted, and one
binary search for each end replaces a join of all tokens with all sections.
"""
from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from .common import from_key, id_key

RULES = ("first", "most", "share")
COLUMNS = "doc_id long, section long, kind string, start_byte long, end_byte long, n_tokens double, n_crossing long, doc_tokens long"
_loaded: dict = {}


def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of a file of ranks and the byte length of each token, read once a worker."""
    if path not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(t) for t in ranks]
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[path]


def sections(text: bytes) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Starts and ends of the lines with their line ends, and their kinds: blank, heading or body.

    A line of at most 8 words that does not end in punctuation, followed by another line, is a heading.
    """
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    ends = breaks if len(breaks) and breaks[-1] == len(text) else np.append(breaks, len(text))
    ends = ends.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    kinds = []
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        line = text[a:b].strip()
        short = line.count(b" ") < 8 and line[-1:] not in (b".", b"!", b"?", b":", b";", b",")
        kinds.append("blank" if not line else "heading" if short and i + 1 < len(ends) else "body")
    return starts, ends, kinds


def allocate(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and tokens of it that cross a boundary.

    Rules for a token that crosses: ``first`` gives it to the section of its first byte, ``most`` to the
    one that holds most of its bytes (the first of equals), ``share`` to each by its part of the bytes.
    The counts of all sections add up to the number of tokens.
    """
    token_starts = np.concatenate([[0], token_ends])[:-1].astype(np.int64)
    first = np.searchsorted(ends, token_starts, side="right")
    last = np.searchsorted(ends, token_ends - 1, side="right")
    crossing = np.flatnonzero(first != last)
    counts = np.bincount(first, minlength=len(ends)).astype(float)
    touched = np.zeros(len(ends), np.int64)
    for i in crossing.tolist():
        span = np.arange(first[i], last[i] + 1)
        touched[span] += 1
        if rule != "first":
            inside = np.minimum(ends[span], token_ends[i]) - np.maximum(starts[span], token_starts[i])
            counts[first[i]] -= 1
            if rule == "most":
                counts[span[np.argmax(inside)]] += 1
            else:
                counts[span] += inside / inside.sum()
    return counts, touched


def section_tokens(docs: DataFrame, path: str | None = None, rule: str = "first") -> DataFrame:
    """A row for each section of each text of ``docs`` (doc_id, text): its kind, byte span, tokens by
    ``rule``, tokens that cross one of its ends, and the tokens of the whole text.

    Sections are lines with their line end, numbered from 0; ``path`` names a file of byte-level ranks,
    and strings of special tokens are ordinary text.  A null or empty text is one blank section with no
    tokens.  Repeated rows and null doc_ids are rows like others; extra columns are ignored; empty input
    gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(frames):
        encoding, lengths = encoder(path)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                body = (text or "").encode("utf-8")
                starts, ends, kinds = sections(body)
                token_ends = np.cumsum(lengths[encoding.encode_to_numpy(text)]) if body else np.zeros(0, np.int64)
                counts, crossing = allocate(token_ends, starts, ends, rule)
                rows.append((doc_id, kinds, starts, ends, counts, crossing, len(token_ends)))
            n = [len(r[1]) for r in rows]
            if rows:
                yield pd.DataFrame({
                    "doc_id": np.repeat([r[0] for r in rows], n), "section": np.concatenate([np.arange(k) for k in n]),
                    "kind": [k for r in rows for k in r[1]], "start_byte": np.concatenate([r[2] for r in rows]),
                    "end_byte": np.concatenate([r[3] for r in rows]), "n_tokens": np.concatenate([r[4] for r in rows]),
                    "n_crossing": np.concatenate([r[5] for r in rows]), "doc_tokens": np.repeat([r[6] for r in rows], n)})

    found = docs.select(id_key().alias("doc_id"), "text").mapInPandas(run, COLUMNS)
    return found.withColumn("doc_id", from_key("doc_id"))
