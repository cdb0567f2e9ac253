"""Quality rules: how much of a text is repetition.

Words (runs of characters other than space and \\t..\\r) are hashed in numpy; the hashes of all windows of n words are rolled on to
those of n + 1 words by one multiplication and sum, for n from 2 to 10. A text fails if too large a share of its words' characters lies inside 5- to 10-word
windows that occurred before, inside its most frequent 2-, 3- or 4-word window, or if too many lines (or
characters in lines) repeat an earlier line. Thresholds are those published for such rules in the
literature on web corpora, and hold at every length. Null and empty texts have no words and
fail the base rule; rows that repeat get equal results; an empty table gives an empty one; texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, powers, span_hashes, utf8, word_bounds

#: Largest share of word characters inside repeated windows of so many words.
DUPLICATE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share inside the most frequent window of so many words.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
LINES = 0.30
LINE_CHARS = 0.20
LEAST_WORDS = 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["dup_line_share", "dup_line_char_share", "top_gram_share", "dup_gram_share"]


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words are inside windows of n words that start at these."""
    step = np.zeros(words + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measured(text: str | None) -> dict:
    b = utf8(text)
    starts, ends = word_bounds(b)
    n = len(starts)
    heads = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))  # characters that begin before each byte
    chars = heads[ends] - heads[starts]
    out = dict(n_words=n, word_chars=int(chars.sum()), n_symbols=int(_SYMBOL[b].sum()), n_dup_lines=0, n_repeat_words=0, base_failed=True, kept=False)
    out |= dict.fromkeys(SHARES, 0.0)
    if not n:
        return out
    words = span_hashes(b, starts, ends)
    total = max(1, out["word_chars"])
    # lines that have a word
    cuts = np.flatnonzero(b == 10)
    lo, hi = np.concatenate(([0], cuts + 1)), np.append(cuts, len(b))
    first = np.searchsorted(starts, lo)
    has = np.searchsorted(starts, hi) > first
    lo, hi = lo[has], hi[has]
    _, at = np.unique(span_hashes(b, lo, hi), return_index=True)
    again = np.ones(len(lo), dtype=bool)
    again[at] = False
    out["n_dup_lines"] = int(again.sum())
    out["dup_line_share"] = again.sum() / len(lo)
    out["dup_line_char_share"] = float((heads[hi] - heads[lo])[again].sum() / max(1, (heads[hi] - heads[lo]).sum()))
    worst = worst_top = 0.0
    fine = out["dup_line_share"] <= LINES and out["dup_line_char_share"] <= LINE_CHARS
    rolled = words
    for k in range(2, min(n, max(DUPLICATE)) + 1):
        rolled = rolled[:-1] + words[k - 1 :] * powers(k)[k - 1]
        grams, at, where, times = np.unique(mixed(rolled), return_index=True, return_inverse=True, return_counts=True)
        if k == 3:
            out["n_repeat_words"] = int(_covered(np.flatnonzero(times[where] > 1), k, n).sum())
        if k in TOP and times.max() > 1:
            most = np.flatnonzero(times == times.max())
            most = most[np.argmin(at[most])]  # of equally frequent ones the first in the text
            share = float(chars[_covered(np.flatnonzero(where == most), k, n)].sum() / total)
            worst_top = max(worst_top, share)
            fine &= share <= TOP[k]
        if k in DUPLICATE:
            repeat = np.ones(len(where), dtype=bool)
            repeat[at] = False
            share = float(chars[_covered(np.flatnonzero(repeat), k, n)].sum() / total)
            worst = max(worst, share)
            fine &= share <= DUPLICATE[k]
    out["top_gram_share"], out["dup_gram_share"] = worst_top, worst
    out["base_failed"] = n < LEAST_WORDS or 100 * out["n_repeat_words"] > 50 * n
    out["kept"] = not out["base_failed"] and bool(fine)
    return out


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_line_char_share double, top_gram_share double, dup_gram_share double"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        frame = pd.DataFrame([measured(t) for t in batch["text"]], columns=[f.split()[0] for f in FIELDS.split(", ")][1:])
        frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def judged(df: DataFrame) -> DataFrame:
    """Counts, shares and the verdict for every row; texts are read once, where they lie."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInPandas(_judge, FIELDS)
