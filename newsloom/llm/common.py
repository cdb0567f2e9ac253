"""What the operators share: columns, lineage cuts, ordered dealing and vectorised word hashes.

Rows are told apart by ``row_key``: a 64-bit hash of (doc_id, text). Rows that repeat both are one
document as far as an operator's decision goes, and all of them get that decision.
"""

from __future__ import annotations

import tempfile
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than these six.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"
SHINGLE = 5
SIMILARITY = 0.8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir, so that nothing above is computed again.

    Only where that setting is absent (tests, a single machine) a temporary folder is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="newsloom-"))
    return df.checkpoint()


def narrow(df: DataFrame, rows: int, rows_a_part: int = 100_000) -> DataFrame:
    """df in as many partitions as so many rows need, and no more than it has: each task of a shuffle leaves files, however few its rows."""
    return df.coalesce(int(rows // rows_a_part) + 4)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have, whatever case its own are in."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def named(df: DataFrame) -> list[Column]:
    """df's columns, whatever characters are in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def n_words(text: Column) -> Column:
    """Words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_of(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the texts."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return n, int(size)


def deal_in_order(df: DataFrame, key: str, bucket: str, buckets: int) -> DataFrame:
    """Add ``bucket``: 0.. in ascending key, rows near equal in number; nulls go first, to bucket 0.

    The bounds are at most ``buckets`` - 1 numbers (quantiles of the key), whatever the input's size,
    and each row finds its bucket by binary search in them, so a retried task deals alike.
    """
    buckets = max(1, min(int(buckets), 65_536))
    bounds: list[int] = []
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        found = df.agg(F.percentile_approx(F.col(key), at, F.lit(max(10_000, 4 * buckets)))).first()[0]
        bounds = sorted(set(found or []))
    if not bounds:
        return df.withColumn(bucket, F.lit(0))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    edges = F.array(*[F.lit(int(x)).cast("long") for x in bounds]) if len(bounds) < 500 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    found = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(bounds)) & (F.get(edges, at + step - 1) <= F.col(key).cast("long")), at + step
        ).otherwise(at),
    )
    return df.withColumn(bucket, F.when(F.col(key).isNull(), F.lit(0)).otherwise(found))


# --- numpy over one text ---------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> np.ndarray:
    """BASE**0.. modulo 2**64, at least n of them."""
    return _powers(1 << max(10, (max(n, 1) - 1).bit_length()))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words begin and end."""
    edge = np.ones(len(b) + 2, dtype=np.int8)
    edge[1:-1] = _SPACE[b]
    step = np.diff(edge)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans ascend and do not overlap."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    rel = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = (b[np.repeat(starts, lengths) + rel].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[rel]
    return mixed(np.add.reduceat(value, first) ^ (lengths.astype(np.uint64) << np.uint64(48)))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every window of n words; of all words if there are fewer."""
    n = min(n, len(words))
    if not n:
        return np.empty(0, dtype=np.uint64)
    p = powers(n)
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        h += words[k : len(words) - n + 1 + k] * p[k]
    return mixed(h)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Distinct n-word shingles of a text as sorted 64-bit hashes; a shorter text has one, of all its words."""
    b = utf8(text)
    return np.unique(gram_hashes(span_hashes(b, *word_bounds(b)), n))
