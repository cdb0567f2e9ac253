"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a piece wherever it is -1 modulo the block size; each piece
gives one character of a signature. A fingerprint is ``block:signature:signature at twice the block``,
where the block size is the smallest of 3 * 2**k that leaves at most 64 pieces, so no text is lumped
into its last piece. Two fingerprints compare where their block sizes agree or differ by the factor two.

Null and empty texts have the fingerprint ``3::``. Equal texts have equal fingerprints, and likeness 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deal_in_order, mixed, powers, size_of, utf8

WINDOW = 7
LEAST_BLOCK = 3
LENGTH = 64
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)


def rolling(b: np.ndarray) -> np.ndarray:
    """For each byte, a hash of the seven bytes that end there."""
    h = np.zeros(len(b), dtype=np.uint32)
    x = b.astype(np.uint32) + np.uint32(1)
    for k in range(min(WINDOW, len(b))):
        h[k:] += x[: len(b) - k] * np.uint32(pow(0x01000193, k + 1, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def _signature(b: np.ndarray, ends: np.ndarray) -> str:
    """One character for each piece; ends: where pieces end, exclusively, the last with the text."""
    if not len(b):
        return ""
    starts = np.concatenate(([0], ends[:-1]))
    rel = np.arange(len(b)) - np.repeat(starts, ends - starts)
    value = np.add.reduceat((b.astype(np.uint64) + np.uint64(1)) * powers(int((ends - starts).max()))[rel], starts)
    return LETTERS[(mixed(value) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def _ends(h: np.ndarray, size: int) -> np.ndarray:
    """Where pieces end at this block size, the text's end with them."""
    e = np.flatnonzero(h % np.uint32(size) == np.uint32(size - 1)) + 1 if size < 1 << 32 else np.empty(0, dtype=np.int64)
    return e if len(e) and e[-1] == len(h) else np.append(e, len(h))


def fingerprint(text: str | None) -> str:
    b = utf8(text)
    h = rolling(b)
    block = LEAST_BLOCK
    while block * LENGTH < len(b):
        block *= 2
    # Pieces that end at twice a block also end at the block: their number never grows with it. A block beyond every
    # hash has one piece.
    now = _ends(h, block)
    while len(now) > LENGTH:
        block *= 2
        now = _ends(h, block)
    while block > LEAST_BLOCK and len(less := _ends(h, block // 2)) <= LENGTH:
        block //= 2
        now = less
    return f"{block}:{_signature(b, now)}:{_signature(b, _ends(h, 2 * block))}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _squeezed(s: str) -> str:
    """Without what a run of one character has beyond three: such runs say little."""
    if len(s) < 4:
        return s
    return s[:3] + "".join(c for i, c in enumerate(s[3:], 3) if not s[i - 3] == s[i - 2] == s[i - 1] == c)


def _close(a: str, b: str) -> float:
    """1 less edits (insert and delete 1, change 2) over both lengths; 0 with no run in common."""
    a, b = _squeezed(a), _squeezed(b)
    if not a or not b:
        return 0.0
    run = min(WINDOW, max(1, min(len(a), len(b)) // 2))
    grams = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in grams for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(left: str, right: str) -> float:
    """From 0 (nothing in common, or block sizes over a factor of two apart) to 1 (equal)."""
    if left == right:
        return 1.0
    x, y = left.split(":"), right.split(":")
    m, n = int(x[0]), int(y[0])
    if m == n:
        return max(_close(x[1], y[1]), _close(x[2], y[2]))
    if m == 2 * n:
        return _close(x[1], y[2])
    if n == 2 * m:
        return _close(x[2], y[1])
    return 0.0


def edited(text: str, following: str) -> str:
    """The last quarter's characters replaced by as many of the following text's first (or all)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its texts' fingerprints in one more column, ``fingerprint``."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint, na_action=None)

    return df.withColumn("fingerprint", of(F.coalesce(F.col(text), F.lit(""))))


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, bucket = None, None  # the text that waits for the one after it
    for batch in batches:
        out = []
        for at, own, doc_id, text in zip(batch["bucket"], batch["own"], batch["doc_id"], batch["text"]):
            now = (doc_id, text, fingerprint(text))
            if last is not None and bucket == at:
                new = edited(last[1], text)
                mark = last[2] if new == last[1] else fingerprint(new)
                out.append((last[0], len(last[1]), hashlib.sha256(new.encode()).hexdigest(), last[2], mark, likeness(last[2], mark), likeness(last[2], now[2])))
            last, bucket = (now if own else None), at
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in FIELDS.split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def compared_in_order(df: DataFrame, bytes_a_bucket: int = 8 << 20) -> DataFrame:
    """Fingerprint each whole text, its edited text, and compare with these and the next document.

    The next document is the next in ascending doc_id (nulls first; ties by text); after the last comes
    the first. Texts move once, to buckets of the doc_id's ranges that stream through the task in order;
    the first row of each bucket goes to the bucket before it too. One document alone follows itself.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n, size = size_of(rows)
    dealt = deal_in_order(rows, "doc_id", "bucket", max(size // bytes_a_bucket, min(n // 64, df.sparkSession.sparkContext.defaultParallelism)) + 1)
    rank = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), F.xxhash64("text"))
    # One row per bucket, 65,536 at most: whose first row is whose sentinel.
    firsts = sorted((r[0], tuple(r[1])) for r in dealt.groupBy("bucket").agg(F.min(rank)).collect())
    pairs = [(firsts[(i + 1) % len(firsts)][0], b, firsts[(i + 1) % len(firsts)][1]) for i, (b, _) in enumerate(firsts)]
    if not pairs:
        return df.sparkSession.createDataFrame([], FIELDS)
    to = df.sparkSession.createDataFrame([(b, before, *first) for b, before, first in pairs], "bucket int, before int, first_id long, first_hash long")
    sentinels = (
        dealt.join(F.broadcast(to), "bucket")
        .where((rank["col1"] == F.col("first_id")) & (rank["col2"] == F.col("first_hash")))
        .groupBy("before").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
        .select(F.col("before").alias("bucket"), "doc_id", "text", F.lit(False).alias("own"))
    )
    both = dealt.select("bucket", "doc_id", "text", F.lit(True).alias("own")).unionByName(sentinels)
    return (
        both.repartition(len(firsts), "bucket")
        .sortWithinPartitions("bucket", F.desc("own"), F.asc_nulls_first("doc_id"), F.xxhash64("text"))
        .mapInPandas(_rows, FIELDS)
    )
