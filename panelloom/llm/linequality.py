"""Line-first cleaning: judge every line by rules, drop the failing ones, then judge what is left."""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import exact_word_hashes, from_key, id_key, mix, text_chunks

#: Line endings that count as punctuation, and texts of navigation and boilerplate lines.
ENDINGS = tuple(".!?…:;,\"'”’»)]}。！？")
NAVIGATION = ("home", "menu", "search", "login", "log in", "sign in", "sign up", "next", "previous", "back to top", "skip to content",
              "share", "tweet", "read more", "older posts", "newer posts", "contact", "about", "sitemap", "follow us")
BOILERPLATE = re.compile(r"all rights reserved|cookie policy|cookies? to|privacy policy|terms of (use|service)|enable javascript|"
                         r"subscribe to our|newsletter|powered by|lorem ipsum|click here", re.IGNORECASE)
TRAIL = re.compile(r"[|»›>]")
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Rules:
    """Limits of the method."""

    unpunctuated_words: int = 4      # a line of so many words or more must end in punctuation
    navigation_words: int = 6        # a line of at most so many words may be a menu
    max_lost_words: float = 0.5      # a document that loses more of its words is rejected
    max_symbol_share: float = 0.1    # symbols a word, over the kept lines
    max_upper_share: float = 0.6     # capitals among the letters of the kept lines


def line_fault(line: str, words: int, rules: Rules) -> str | None:
    """The first rule that a line with a word fails, or None."""
    if BOILERPLATE.search(line):
        return "boilerplate"
    if words <= rules.navigation_words and (len(TRAIL.findall(line)) >= 2 or line.strip(BLANK + ".:!").lower() in NAVIGATION):
        return "navigation"
    if words >= rules.unpunctuated_words and not line.rstrip(BLANK).endswith(ENDINGS):
        return "punctuation"
    return None


def clean(text: str, rules: Rules) -> tuple[list[str], int, int, dict]:
    """Kept lines, repeated lines (equal to an earlier one, with a word), words lost, and faults by rule."""
    seen, kept, repeated, lost, faults = set(), [], 0, 0, {}
    for line in text.split("\n"):
        if line and line.strip(BLANK):
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
            words = len(line.split())
            fault = line_fault(line, words, rules)
            if fault:
                lost += words
                faults[fault] = faults.get(fault, 0) + 1
                continue
        kept.append(line)
    return kept, repeated, lost, faults


def repeated_words(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text: its words that lie in a 3-word window found twice or more in it."""
    n = len(h) - 2
    out = np.zeros(len(bounds) - 1, np.int64)
    if n <= 0:
        return out
    odd = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
    window = mix(h[:n] * odd[0] + h[1:n + 1] * odd[1] + h[2:] * odd[2])
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b - a < 4:
            continue
        w = window[a:b - 2]
        order = np.argsort(w)
        s = w[order]
        same = s[1:] == s[:-1]
        if not same.any():
            continue
        twice = np.zeros(len(w), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(w) + 2, bool)
        cover[:-2] |= twice
        cover[1:-1] |= twice
        cover[2:] |= twice
        out[i] = cover.sum()
    return out


COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept boolean, n_lines_dropped long, n_words_left long, fault string")


def line_quality(docs: DataFrame, rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): base counts, the verdict and what cleaning dropped; with
    ``with_text`` also ``clean_text``, the kept lines.

    Null text counts as empty: all counts 0, ``base_failed`` true.  Blank lines are kept and judged by
    no rule.  ``fault`` names why the method rejects (null if it does not): lost, symbols, capitals.
    Rows are independent, so repeated rows get equal results; extra columns are ignored.
    """
    def run(frames):
        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"].tolist()]
            columns = {k: [] for k in ("n_words", "word_chars", "n_repeat_words")}
            for chunk in text_chunks(texts):
                h, bounds, chars = exact_word_hashes(chunk)
                columns["n_words"].append(np.diff(bounds))
                columns["word_chars"].append(chars)
                columns["n_repeat_words"].append(repeated_words(h, bounds))
            out = pd.DataFrame({"doc_id": frame["doc_id"]} | {k: np.concatenate(v) if v else [] for k, v in columns.items()})
            symbols, again, dropped, left, faults, cleaned = [], [], [], [], [], []
            for text, n in zip(texts, out["n_words"].tolist()):
                kept, repeated, lost, by_rule = clean(text, rules)
                body = "\n".join(kept)
                remaining = n - lost
                letters = len(body) - body.count(" ")
                fault = None
                if lost > rules.max_lost_words * n:
                    fault = "lost"
                elif len(SYMBOLS.findall(body)) > rules.max_symbol_share * max(remaining, 1):
                    fault = "symbols"
                elif letters and sum(map(str.isupper, body)) > rules.max_upper_share * letters:
                    fault = "capitals"
                symbols.append(len(SYMBOLS.findall(text)))
                again.append(repeated)
                dropped.append(sum(by_rule.values()))
                left.append(remaining)
                faults.append(fault)
                cleaned.append(body)
            out["n_symbols"], out["n_dup_lines"], out["n_lines_dropped"], out["n_words_left"] = symbols, again, dropped, left
            out["fault"] = faults
            out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
            out["kept"] = ~out["base_failed"] & out["fault"].isna()
            if with_text:
                out["clean_text"] = cleaned
            yield out

    found = docs.select(id_key().alias("doc_id"), "text").mapInPandas(run, COLUMNS + (", clean_text string" if with_text else ""))
    return found.withColumn("doc_id", from_key("doc_id"))
