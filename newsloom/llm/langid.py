"""Language ID: rank-order profiles of the most frequent character n-grams, compared by out-of-place distance.

A text's letters are lower-cased and every run of other characters is one space; its n-grams of one to
three such characters (but for the space alone) are ranked by frequency, ties by the n-gram. A language's
profile has the ``PROFILE`` most frequent n-grams of its training texts. The distance is the sum, over the text's
own top n-grams, of how far their rank is from the profile's, or ``PROFILE`` where the profile lacks one.
The nearest language wins, ties by name. The score is 1 - distance / largest possible distance.

A null text, one without a letter, and every text where nothing could be learned are ``und``, score 0. Rows that repeat get equal
results; an empty table gives an empty one; texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

PROFILE = 300
#: Different texts wanted for each language; more are thinned by a hash of the text. This bounds what is fitted.
TRAINING_ROWS = 2_000
UNKNOWN = "und"
_BITS = np.uint64(21)
_HASHES = 1 << 40


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers, and their counts; none if there is no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype=np.uint32)
    c = _letters()[points]
    if not (c != 32).any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.concatenate(([32], c, [32])).astype(np.uint64)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    two = c[:-1] << _BITS | c[1:]
    three = c[:-2] << (_BITS + _BITS) | two[1:]
    return np.unique(np.concatenate((c[c != 32], two, three)), return_counts=True)


def top(values: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent values, most frequent first; ties by value, ascending."""
    if len(values) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        held = counts >= least
        values, counts = values[held], counts[held]
    return values[np.lexsort((values, -counts))][:n]


class Profiles:
    """Ranks by n-gram and language, held for the n-grams that a language has: so large as the profiles, however many languages."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.names = sorted(ranked)
        each = [np.array(ranked[x], dtype=np.uint64) for x in self.names]
        found = np.concatenate([np.empty(0, np.uint64), *each])
        order = np.argsort(found, kind="stable")
        self.langs = np.repeat(np.arange(len(each)), [len(x) for x in each])[order]
        self.ranks = np.concatenate([np.empty(0, np.int64), *(np.arange(len(x)) for x in each)])[order]
        self.known, begins = np.unique(found[order], return_index=True)
        self.bounds = np.append(begins, len(found))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = top(*grams(text), self.size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == own) if len(self.known) else np.empty(0, dtype=np.int64)
        begins, counts = self.bounds[at[hit]], self.bounds[at[hit] + 1] - self.bounds[at[hit]]
        rows = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        gained = self.size - np.minimum(np.abs(self.ranks[rows] - np.repeat(hit, counts)), self.size)
        away = self.size * len(own) - np.bincount(self.langs[rows], gained, len(self.names)).astype(np.int64)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.size * len(own)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from; a null doc_id is hashed as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            values, counts = [], []
            for text in texts:
                v, n = grams(text)
                values.append(v)
                counts.append(n)
            v, where = np.unique(np.concatenate(values), return_inverse=True)
            yield pd.DataFrame({"lang": lang, "gram": v.astype(np.int64), "n": np.bincount(where, np.concatenate(counts), len(v)).astype(np.int64)})


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAINING_ROWS) -> Profiles:
    """Profiles of the languages of these rows, from about ``rows`` different texts of each (a bounded sample).

    Only rows that have both a text and a lang count, and rows of one text as one. The sample keeps a text where its hash is
    small enough for its language's share, and of each language the text of the least hash in any case, so none is left out; n-grams are counted in the
    tasks and summed, then ranked, a language's n-grams together: as many as its sample has. The driver sees ``PROFILE`` n-grams of
    each language; there are under 8,000 language codes.
    """
    base = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("hash", F.xxhash64("text"))
    of = F.pmod(F.col("hash"), F.lit(_HASHES))
    sizes = base.select("lang", "hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(of).alias("least")).collect()
    if not sizes:
        return Profiles({})
    most = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(max(r["least"], int(min(1.0, rows / r["n"]) * _HASHES) - 1)))])
    sample = base.where(of <= F.try_element_at(most, F.col("lang"))).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    counted = sample.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in counted.select("lang", "gram", place.alias("place")).where(F.col("place") <= PROFILE).orderBy("lang", "place").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked)


def identify(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """df with ``lang_pred`` and ``score`` (under fresh names if it has such columns), from the whole text alone."""
    names = fresh(df, "lang_pred", "score")

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    (found,) = fresh(df, "found")
    out = df.withColumn(found, predict(F.col(text)))
    return out.withColumns({names[0]: F.col(f"{found}.lang_pred"), names[1]: F.col(f"{found}.score")}).drop(found)


def predicted(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out."""
    rows = df.select("doc_id", "text", "lang", held_out().alias("held_out"))
    profiles = learn(rows.where(~F.col("held_out")))
    return identify(rows.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")
