"""Packing: fill windows of 2048 ids by non-negative least squares over length combinations.

A document over the window is cut into whole windows and a rest. The rests' histogram (at most 2047
lengths) is met as well as possible by repeat counts of combinations of one to three lengths that fill a
window exactly: counts >= 0 that minimise the squared difference, by coordinate descent, rounded down so
that no length is used more often than it occurs. What is left is packed greedily, longest first, each
window closed by the longest rest that still fits; identical windows are made many at a time, so the
plan's size depends on the number of lengths and not on the number of documents. The rests of windows that
stay short run on from one sequence to the next, cut where a sequence is full: the copies of a window are taken
in powers of two, and each power's rests fill that many sequences at a time by one pattern. What is left below a
whole sequence goes on to the next lower power, so that one sequence of all is padded.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import encoder, in_batches

WINDOW = 2048
END = 1


# --- the plan: driver side, over a histogram of at most WINDOW - 1 lengths ------------------------


def combinations(lengths: list[int], window: int, per_length: int = 8) -> list[tuple[int, ...]]:
    """Combinations of two or three of these lengths that fill a window, so many at most for each longest one."""
    have = set(lengths)
    out: dict[tuple[int, ...], None] = {}
    for a in lengths:
        rest = window - a
        if rest in have and rest <= a:
            out[a, rest] = None
        middle = [b for b in lengths if b <= min(a, rest - 1) and rest - b in have and rest - b <= b]
        step = max(1, len(middle) // per_length)
        for b in middle[::step]:
            out[a, b, rest - b] = None
    return list(out)


def solve(columns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = 30) -> np.ndarray:
    """Non-negative least squares by coordinate descent: counts x of the columns with A x near the histogram."""
    left = {k: float(v) for k, v in histogram.items()}
    uses = [[(k, c.count(k)) for k in set(c)] for c in columns]
    norm = [sum(m * m for _, m in u) for u in uses]
    x = np.zeros(len(columns))
    for _ in range(sweeps):
        moved = 0.0
        for j, u in enumerate(uses):
            step = max(-x[j], sum(m * left[k] for k, m in u) / norm[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, m in u:
                    left[k] -= m * step
        if moved < 0.25:
            break
    return x


def windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): which lengths share a window and how often; every rest of the histogram is in one."""
    left = {k: v for k, v in histogram.items() if v > 0}
    columns = combinations(sorted(left, reverse=True), window)
    out: list[tuple[tuple[int, ...], int]] = []
    x = solve(columns, left)
    for j in np.argsort(-x, kind="stable"):
        c = columns[j]
        times = min(int(x[j] + 1e-6), *(left[k] // c.count(k) for k in c))
        if times > 0:
            out.append((c, times))
            for k in c:
                left[k] -= times
    present = np.zeros(window + 1, dtype=np.int64)
    for k, v in left.items():
        present[k] = v
    at = window
    while True:
        while at > 0 and not present[at]:
            at -= 1
        if not at:
            break
        taken, free = [at], window - at
        present[at] -= 1
        while free:
            fits = np.flatnonzero(present[: free + 1])
            if not len(fits):
                break
            taken.append(int(fits[-1]))
            present[fits[-1]] -= 1
            free -= int(fits[-1])
        more = min(int(present[k]) // taken.count(k) for k in set(taken))
        for k in taken:
            present[k] -= more
        out.append((tuple(taken), 1 + more))
    return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple], int]:
    """Where rests go: rows (length, first rank, last rank, sequence of the first, offset, begin, piece), and sequences.

    The rests of one length are ranked from 0; those of a row go to consecutive sequences at the same
    offset. begin and piece say which part of the rest that is: all of it but for cut rests. Rows are bounded by the
    windows that differ and the bits of their counts.
    """
    filled = windows(histogram, window)
    rank: dict[int, int] = defaultdict(int)
    rows: list[tuple] = []
    sequence = 0
    short: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # by power of two: length, first rank, begin, piece
    for lengths, times in filled:
        at = 0
        for k in lengths:
            if sum(lengths) == window:
                rows.append((k, rank[k], rank[k] + times - 1, sequence, at, 0, k))
                at += k
            else:
                low = rank[k]
                for power in reversed(range(times.bit_length())):
                    if times >> power & 1:
                        short[power].append((k, low, 0, k))
                        low += 1 << power
            rank[k] += times
        if at:
            sequence += times
    left: list[tuple[int, int, int, int]] = []
    for power in reversed(range(max(short, default=-1) + 1)):
        n = 1 << power
        stream = [(k, low + half, begin, piece) for k, low, begin, piece in left for half in (0, n)] + short[power]
        total = sum(piece for *_, piece in stream)
        end = total // window * window if power else total
        left, at = [], 0
        for k, low, begin, piece in stream:
            while piece and at < end:
                some = min(piece, window - at % window)
                rows.append((k, low, low + n - 1, sequence + at // window * n, at % window, begin, some))
                begin, piece, at = begin + some, piece - some, at + some
            if piece:
                left.append((k, low, begin, piece))
        sequence += -(-end // window) * n
    return rows, sequence


# --- over documents -------------------------------------------------------------------------------


DOCS = "part int, row long, doc_id long, doc_tokens long, whole_before long, crcs array<long>, rest int, rank long, rest_crc long, rest_ids binary"


def _encode(tokenizer: str, window: int):
    """Ids of each text; part and row name it, rank counts the rests of its length in this task before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder("words", tokenizer)
        part = TaskContext.get().partitionId()
        end = np.array([END], dtype=np.uint16)
        seen: dict[int, int] = defaultdict(int)
        row = wholes = 0
        for batch in batches:
            done = 0
            for some in in_batches(batch["text"].tolist()):
                rows = []
                for doc_id, ids in zip(batch["doc_id"].iloc[done : done + len(some)], encode.ids(some), strict=True):
                    ids = np.append(ids, end).astype("<u4")
                    n = len(ids) // window
                    tail = ids[n * window :]
                    crcs = [zlib.crc32(ids[i * window : (i + 1) * window].data) for i in range(n)]
                    rows.append((part, row, doc_id, len(ids), wholes, crcs, len(tail), seen[len(tail)], zlib.crc32(tail.data), tail.astype("<u2").tobytes()))
                    row, wholes = row + 1, wholes + n
                    seen[len(tail)] += 1
                done += len(some)
                frame = pd.DataFrame(rows, columns=[f.split()[0] for f in DOCS.split(", ")])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return run


def _piece_crc(ids: bytes, begin: int, piece: int) -> int:
    return zlib.crc32(np.frombuffer(ids, "<u2")[begin : begin + piece].astype("<u4").data)


PLAN = "rest int, low long, high long, base_sequence long, offset long, begin long, length long"


def packed(df: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of df is a document of its own, also where rows repeat. Null texts are empty: the end id
    alone. Texts are encoded once, where they lie; ids are kept (two bytes each) for the rests that
    are cut. The driver sees the histogram (window - 1 numbers) and the plan made from it; ranks within a
    length are the task's count plus the tasks before it, so no length, however frequent, meets in one task.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = cut(rows.mapInPandas(_encode(tokenizer, window), DOCS))
    spark = df.sparkSession
    slim = docs.drop("rest_ids")
    tallies = docs.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["rest"]: r["n"] for r in tallies.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(0, None)
    planned, sequences = plan(histogram, window)
    # A few rows for each combination of lengths that was used, times the bits of its count: bounded by window, not by documents.
    where = spark.createDataFrame(planned, PLAN)
    before = lambda key: Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tallies = tallies.select("part", "rest", F.coalesce(F.sum("n").over(before(["rest"])), F.lit(0)).alias("base"))
    ranked = (
        docs.where(F.col("rest") > 0).join(tallies, ["part", "rest"])
        .select("doc_id", "doc_tokens", "rest", "rest_crc", "rest_ids", (F.col("rank") + F.col("base")).alias("rank"))
    )
    placed = ranked.join(F.broadcast(where), "rest").where(F.col("rank").between(F.col("low"), F.col("high"))).select(
        "doc_id", (F.col("doc_tokens") - F.col("rest") + F.col("begin")).alias("start"), "length", "rest_crc", "rest_ids", "doc_tokens",
        (F.col("base_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset", "begin", "rest",
    )
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    entire = placed.where(F.col("length") == F.col("rest")).withColumn("ids_crc32", F.col("rest_crc")).select(out)
    # No rows move for these but where Spark does not broadcast the tallies.
    cuts = placed.where(F.col("length") < F.col("rest"))
    halved = cuts.withColumn("ids_crc32", F.udf(_piece_crc, "long", useArrow=True)("rest_ids", F.col("begin"), F.col("length"))).select(out)
    counts = docs.where(F.size("crcs") > 0).groupBy("part").agg(F.sum(F.size("crcs")).alias("n"))
    counts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    whole = (
        slim.where(F.size("crcs") > 0).join(counts, "part")
        .select("doc_id", "doc_tokens", "whole_before", "base", F.posexplode("crcs").alias("at", "ids_crc32"))
        .select(
            "doc_id", (F.col("at") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
            (F.col("whole_before") + F.col("base") + F.col("at") + F.lit(sequences)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        )
    )
    return entire.unionByName(halved).unionByName(whole)
