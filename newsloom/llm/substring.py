"""Substring dedup: content-defined units of text are hashed, digests grouped over the corpus, repeats extended and removed.

Words are runs of characters other than white space, in lower case; a character of a script that is written without spaces
is a word. Anchors are the ``GRAM``-word windows with the least hash of ``REACH`` windows in a row, so what lies around a
passage moves none of its anchors but near its ends. A unit goes from one anchor's first word to the next anchor's last. A passage of
``LEAST_WORDS`` words or more holds two anchors, thus a unit, wherever it begins and ends. The earliest occurrence of a unit (by
doc_id, null first, then position) keeps its text. Runs of units that occurred before are extended word by word, as far as the
words around the earliest occurrence agree, and removed if they have at least ``LEAST_WORDS`` words: single common lines and
short phrases stay. With a smaller ``least_words`` every line of so many words is a unit of its own too (normalised as its words
are), down to 1: then each repeated line goes, whatever its length. The offsets of what was removed, in code points of the original text, are
kept. A null text stays null; a text without words has no unit; ties in doc_id go by a hash of the text; rows that repeat doc_id and text
are one document, with one result; an empty table gives an empty one; texts are read whole, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, gram_hashes, mixed, row_key, span_hashes

#: Words that a run of repeated units needs to be removed, unless a caller names another number.
LEAST_WORDS = 30
_LINE = np.uint64(0xD6E8FEB86659FD93)
#: Words of an anchor, and windows in a row of which one is an anchor: 2 * REACH + GRAM - 1 <= LEAST_WORDS.
GRAM = 5
REACH = 13
#: Words around a run that are compared with the earliest occurrence; a passage's ends are under REACH words from its anchors.
AROUND = 24
_WHITE = re.compile(r"\s")
#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
_SINGLE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code point offsets where words begin and end, and the text in lower case as code points."""
    flat = _WHITE.sub(" ", text)
    low = flat.lower()
    if len(low) != len(flat):  # a letter whose lower case is two
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in flat)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = np.zeros(len(points) + 2, dtype=bool)
    word[1:-1] = points != 32
    edge = word[1:] != word[:-1]
    if len(points) and points.max() >= 0x0E00:
        single = np.zeros(len(word), dtype=bool)
        for a, b in _SINGLE:
            single[1:-1] |= (points >= a) & (points <= b)
        inner = (single[1:] | single[:-1]) & word[1:] & word[:-1]
    else:
        inner = np.zeros(len(edge), dtype=bool)
    return np.flatnonzero((edge & word[1:]) | inner), np.flatnonzero((edge & word[:-1]) | inner), points


def units(text: str) -> list[tuple[int, int]]:
    """Where words begin and end; what is between them is white space."""
    starts, ends, _ = _words(text)
    return list(zip(starts.tolist(), ends.tolist()))


def hashed_words(text: str) -> np.ndarray:
    starts, ends, points = _words(text)
    return span_hashes(points, starts, ends)


def anchored(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and digest of each unit."""
    none = np.empty(0, dtype=np.int64)
    if len(words) < GRAM + REACH:
        return none, none, none
    grams = gram_hashes(words, GRAM)
    least = np.lib.stride_tricks.sliding_window_view(grams, REACH).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    first, size = at[:-1], np.diff(at) + GRAM
    # spans overlap by GRAM: hash the words up to the next anchor, and that anchor
    if not len(first):
        return none, none, none
    low, high = (grams[at] & np.uint64(0xFFFFFFFF)), grams[at[1:]]
    stepped = span_hashes(words, first, at[1:])
    return first, size, span_hashes(np.column_stack((stepped, high, low[:-1])).reshape(-1), np.arange(len(first)) * 3, np.arange(len(first)) * 3 + 3).view(np.int64)


def lines(text: str, starts: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and digest of each line of at least so many words, and too few to hold a unit for sure."""
    cuts = np.searchsorted(starts, [m.start() for m in re.finditer("\n", text)])
    first, last = np.concatenate(([0], cuts)).astype(np.int64), np.append(cuts, len(starts)).astype(np.int64)
    some = (last - first >= max(1, least)) & (last - first < LEAST_WORDS)
    first, last = first[some], last[some]
    return first, last - first, mixed(span_hashes(words, first, last) ^ _LINE).view(np.int64)


def _digests(least_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places, digests = [], []
            for text in batch["text"]:
                starts, ends, points = _words(text)
                words = span_hashes(points, starts, ends)
                found = [anchored(words)]
                if least_words < LEAST_WORDS:
                    found.append(lines(text, starts, words, least_words))
                first, size, digest = map(np.concatenate, zip(*found))
                places.append((first << 5 | size).astype(np.int64))
                digests.append(digest)
            yield pd.DataFrame({"doc_key": batch["doc_key"], "doc_id": batch["doc_id"].astype("Int64"), "places": places, "digests": digests})

    return run


RUNS = "doc_key long, begin long, end long, before_doc long, before_at long, after_doc long, after_at long"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of repeated units, in words, with where the earliest occurrences of their first and last unit begin and end.

    Rows: doc_key, unit, doc, other in order of doc_key and unit. One run is held from batch to batch.
    """
    held: tuple | None = None
    for batch in batches:
        doc, unit, place, other = (batch[c].to_numpy() for c in ("doc_key", "unit", "doc", "other"))
        begin, end, at = unit >> 5, (unit >> 5) + (unit & 31), other >> 5
        change = np.append(True, doc[1:] != doc[:-1])
        which = np.cumsum(change) << 32
        far = np.maximum.accumulate(which + end)
        heads = np.flatnonzero(change | (which + begin > np.append(-1, far[:-1])))
        rows = []
        for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(doc)]):
            last = i + int(np.argmax(end[i:j]))
            run = (doc[i], begin[i], end[last], place[i], at[i], place[last], at[last] + (unit[last] & 31))
            if held is None:
                held = run
            elif held[0] != run[0] or run[1] > held[2]:
                rows.append(held)
                held = run
            elif run[2] > held[2]:
                held = (*held[:2], run[2], *held[3:5], *run[5:])
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in RUNS.split(", ")], dtype=np.int64)
    if held is not None:
        yield pd.DataFrame([held], columns=[f.split()[0] for f in RUNS.split(", ")], dtype=np.int64)


def _low(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _around(key: str, wanted: str):
    """The words before or after a place of a text, the nearest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, places in zip(batch[key], batch["text"], batch[wanted]):
                words = _low(hashed_words(text))
                for w in places:
                    at = w["at"]
                    rows.append((doc, at, w["after"], words[at : at + AROUND] if w["after"] else words[max(0, at - AROUND) : at][::-1]))
            yield pd.DataFrame(rows, columns=["doc", "at", "after", "words"])

    return run


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many words agree from the first on."""
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    return int(unlike[0]) if len(unlike) else n


def extended(text: str, found: list, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Spans of the runs (begin, end, words before and after the earliest occurrence), extended, joined, of enough words."""
    starts, ends, points = _words(text)
    words = _low(span_hashes(points, starts, ends))
    joined: list[list[int]] = []
    for r in sorted(found, key=lambda r: r["begin"]):
        begin, end = r["begin"], r["end"]
        if r["before"] is not None:
            begin -= _same(words[max(0, begin - AROUND) : begin][::-1], np.asarray(r["before"], dtype=np.int64))
        if r["after"] is not None:
            end += _same(words[end : end + AROUND], np.asarray(r["after"], dtype=np.int64))
        if end - begin < LEAST_WORDS:  # a short line: it alone repeats, whatever word stands beside it
            begin, end = r["begin"], r["end"]
        if joined and begin <= joined[-1][1]:
            joined[-1] = [min(begin, joined[-1][0]), max(end, joined[-1][1])]
        else:
            joined.append([begin, end])
    return [(int(starts[a]), int(ends[b - 1])) for a, b in joined if b - a >= least_words]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less these spans and the white space before them; what stays joined is parted as it was."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a].rstrip(" \t\n") if text[b : b + 1] in ("", " ", "\t", "\n") else text[at:a])
        at = b
    rest = text[at:]
    out = "".join(parts)
    return (out + rest) if out else rest.lstrip(" \t\n")


def _removing(least_words: int):
    def run(text: str | None, found: list | None) -> dict | None:
        spans = extended(text, found, least_words) if text is not None and found is not None else []
        return {"kept": without(text, spans), "begins": [a for a, _ in spans], "ends": [b for _, b in spans]} if spans else None

    # nondeterministic: so that Spark does not write the call out in every place that reads a part of its result
    return F.udf(run, "struct<kept:string,begins:array<int>,ends:array<int>>", useArrow=True).asNondeterministic()


def removals(df: DataFrame, span: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """df with a column more: kept (text), begins, ends (removed spans) of each text that has a repeat, else null.

    Digests (twelve bytes for each unit) are cut to the shared folder. First they alone are counted, with sums made in the tasks; only
    those that occur again are joined with their places, of which the least is the earliest occurrence. A unit
    that is in very many documents is a join key that Spark can split; no task collects a digest's documents. Of the
    earliest occurrences only the words around the ends of runs are sent, each place once. Rows are dealt by their
    key once: both joins have the same left side, with the same columns, so that Spark uses one exchange for both.
    """
    key, wanted_, found_ = fresh(df, "doc_key", "wanted", "found")
    base = df.withColumn(key, row_key())
    rows = df.where(F.col("text").isNotNull()).select(row_key().alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = cut(rows.mapInPandas(_digests(least_words), "doc_key long, doc_id long, places array<int>, digests array<long>"))
    each = hashed.select("doc_key", "places", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rank"), F.posexplode("digests").alias("i", "digest"))
    each = each.select("doc_key", "rank", F.get("places", F.col("i")).alias("unit"), "digest")
    place = F.struct("rank", "doc_key", "unit")
    counts = hashed.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    repeated = cut(each.join(counts.where("n > 1").select("digest"), "digest"))
    first = repeated.groupBy("digest").agg(F.min(place).alias("first"))
    again = repeated.join(first, "digest").where(place != F.col("first")).select("doc_key", F.col("unit").cast("long").alias("unit"), F.col("first.doc_key").alias("doc"), F.col("first.unit").cast("long").alias("other"))
    runs = cut(again.repartition("doc_key").sortWithinPartitions("doc_key", "unit").mapInPandas(_runs, RUNS))
    ends = runs.select(F.col("before_doc").alias("doc"), F.col("before_at").alias("at"), F.lit(False).alias("after"))
    ends = ends.unionByName(runs.select(F.col("after_doc").alias("doc"), F.col("after_at").alias("at"), F.lit(True).alias("after"))).distinct()
    wanted = ends.groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("at", "after")).alias(wanted_))
    around = base.join(wanted, key).mapInPandas(_around(key, wanted_), "doc long, at long, after boolean, words array<long>").dropDuplicates(["doc", "at", "after"])
    before = around.where(~F.col("after")).select(F.col("doc").alias("before_doc"), F.col("at").alias("before_at"), F.col("words").alias("before"))
    after = around.where("after").select(F.col("doc").alias("after_doc"), F.col("at").alias("after_at"), F.col("words").alias("after"))
    known = runs.join(before, ["before_doc", "before_at"], "left").join(after, ["after_doc", "after_at"], "left")
    found = known.groupBy(F.col("doc_key").alias(key)).agg(F.collect_list(F.struct("begin", "end", "before", "after")).alias(found_))
    return base.join(found, key, "left").withColumn(span, _removing(least_words)("text", found_)).drop(key, found_)


def marked(df: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Each row's doc_id, n_chars (of the original), kept_chars, removed (spans), text (what is kept)."""
    out = removals(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "span", least_words)
    text = F.when(F.col("span").isNull(), F.col("text")).otherwise(F.col("span.kept"))
    return out.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("kept_chars"),
        F.coalesce(F.arrays_zip(F.col("span.begins").alias("begin"), F.col("span.ends").alias("end")), F.array().cast("array<struct<begin:int,end:int>>")).alias("removed"), text.alias("text"),
    )


def deduplicated(df: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """df with repeats removed from its texts and n_chars (if it has that) set anew; rows left without a word go.

    A row that came without words stays as it is.
    """
    names = df.columns
    df = df.toDF(*[f"column_{i}" if set(".`") & set(c) else c for i, c in enumerate(names)])
    (span,) = fresh(df, "span")
    kept = F.col(f"{span}.kept")
    out = removals(df, span, least_words).where(F.col(span).isNull() | (F.trim(F.regexp_replace(kept, r"[\s]+", "")) != ""))
    changes = {"text": F.coalesce(kept, F.col("text"))}
    if "n_chars" in df.columns:
        changes["n_chars"] = F.when(F.col(span).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast(df.schema["n_chars"].dataType))
    return out.withColumns(changes).select(df.columns).toDF(*names)
