"""N-gram Jaccard join: MinHash banding over word shingles, with every candidate verified on its full set.

Equal texts are one class (by a 64-bit hash; null counts as the empty text). Of each class one text is shingled (five words; a shorter
text has one shingle, of all its words; a text without words has none and joins nothing), hashed to
``BANDS`` * ``ROWS`` minima, and dealt by band. The chance that two texts of similarity s share a bucket is
1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8 with 20 bands of 5 rows.

Every two texts that share a bucket are compared once, on full sets: in the lowest band whose bucket they share. Buckets
with the same members as one of a lower band are left out before any set moves. A bucket is compared in blocks of bounded
size, each pair of blocks being a task's work of its own, so neither a hot bucket nor its sets meet in one task; and pairs
never become rows: a block pair returns for each text how many partners it has found, and one member that it is connected to.
So links are counted exactly, and what moves is in proportion to the texts (and a hot bucket's blocks), not to their pairs. The comparisons
themselves stay quadratic in the different texts of one bucket, less those whose sizes alone rule a link out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILARITY, cut, fresh, mixed, named, narrow, shingles
from .components import components

BANDS = 20
ROWS = 5
#: Texts, and shingles, that one block of a bucket has on average.
BLOCK_TEXTS = 512
BLOCK_GRAMS = 1 << 20
NULL_ID = -(1 << 63)
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def bands(sh: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band's minima; none for an empty set."""
    if not len(sh):
        return np.empty(0, dtype=np.int64)
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(sh), 4096):
        part = sh[i : i + 4096, None] * _SEEDS[None, :]
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0), out=least)
    folded = np.zeros(len(least) // rows, dtype=np.uint64)
    for k in range(rows):
        folded = mixed(folded * np.uint64(31) + least[k::rows][: len(folded)])
    return mixed(folded + np.arange(len(folded), dtype=np.uint64)).view(np.int64)


SIGNED = "k long, own long, grams long, bands array<long>"


def _banded(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, n) for t in batch["text"]]
            yield pd.DataFrame({"k": batch["k"], "own": batch["own"], "grams": [len(s) for s in sets], "bands": [bands(s) for s in sets]})

    return run


def _shingled(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "kept": batch["kept"], "set": [shingles(t, n).view(np.int64) for t in batch["text"]]})

    return run


def linked_within(sets: list[np.ndarray], kept: np.ndarray, band: int, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text its links in this block pair, and the first member of its component there.

    kept: a row for each text with the bucket of each band, 0 where none counts. side: 0 or 1 for the blocks of a pair, whose
    members are compared across only; all 0: one block, compared within. Pairs that share a lower band are left out.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, side, kept = size[order], side[order], kept[order, :band]
    sets = [sets[i] for i in order]
    across = bool(side.any())
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    begins = ends - size
    marked = np.zeros(len(names), dtype=bool)
    links = np.zeros(len(sets), dtype=np.int64)
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(sets) - 1):
        stop = int(np.searchsorted(size, size[i] / least, side="right"))
        if stop <= i + 1:
            continue
        open_ = ~((kept[i + 1 : stop] == kept[i]) & (kept[i] != 0)).any(axis=1)
        if across:
            open_ &= side[i + 1 : stop] != side[i]
        at = i + 1 + np.flatnonzero(open_)
        if not len(at):
            continue
        own = flat[begins[i] : ends[i]]
        marked[own] = True
        if 2 * len(at) > stop - i - 1:
            lo = begins[i + 1]
            both = np.add.reduceat(marked[flat[lo : ends[stop - 1]]], begins[i + 1 : stop] - lo, dtype=np.int64)[at - i - 1]
        else:
            both = np.array([np.count_nonzero(marked[flat[begins[j] : ends[j]]]) for j in at.tolist()])
        marked[own] = False
        found = at[both >= least * (size[i] + size[at] - both)]
        links[i] += len(found)
        links[found] += 1
        for j in found.tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    out, first = np.empty_like(links), np.empty_like(root)
    out[order], first[order] = links, order[[find(i) for i in range(len(sets))]]
    return out, first


BLOCKS = "bucket long, i int, j int"
FOUND = "k long, other long, links long"


def _compared(least: float):
    """Rows in order of BLOCKS -> for each text with links in a block pair: a member of its component, its number of links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def closed() -> pd.DataFrame:
            rows = pd.concat(held).drop_duplicates("k") if len(held) > 1 else held[0].drop_duplicates("k")
            k, i, j = rows["k"].to_numpy(), int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
            side = (rows["block"].to_numpy() == j).astype(np.int8) if i != j else np.zeros(len(k), dtype=np.int8)
            if len(k) < 2 or (i != j and side.min() == side.max()):
                return pd.DataFrame({"k": k[:0], "other": k[:0], "links": k[:0]})
            kept = np.vstack(rows["kept"].to_numpy())
            links, first = linked_within([np.asarray(s) for s in rows["set"]], kept, int(rows["band"].iloc[0]), side, least)
            some = links > 0
            return pd.DataFrame({"k": k[some], "other": k[first[some]], "links": links[some]})

        now = None
        for batch in batches:
            keys = batch[["bucket", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                if b > a:
                    key = tuple(keys[a])
                    if key != now and held:
                        yield closed()
                        held = []
                    now = key
                    held.append(batch.iloc[a:b])
        if held:
            yield closed()

    return run


def signed(rows: DataFrame, n: int = SHINGLE) -> DataFrame:
    """One row for each different text of rows (k, own, text): k, the least own, n_copies, the number of its shingles, its buckets."""
    told = rows.mapInPandas(_banded(n), SIGNED)
    return cut(told.groupBy("k").agg(F.min("own").alias("own"), F.count(F.lit(1)).alias("n_copies"), F.max("grams").alias("grams"), F.first("bands").alias("bands")))


def linked(rows: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """(k, other, links): texts with links, as the block pairs found them. rows: (k, own, text); texts: signed(rows).

    A text's links are the sum over its rows; other is in the same component as k. Of the texts in shared buckets, the row of the least ``own`` is
    shingled, and joining on (k, own) spreads the copies of one text over all tasks.
    """
    dealt = texts.select("k", "grams", F.posexplode("bands").alias("band", "bucket"))
    mark = lambda seed: F.bit_xor(F.xxhash64("k", F.lit(seed)))
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("grams").alias("weight"), mark(1).alias("x"), mark(2).alias("y"), F.min("band").alias("band"))
    # buckets of one set of members: the lowest band's will do
    alike = sizes.where("members > 1").groupBy("members", "weight", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_TEXTS, F.col("weight") / BLOCK_GRAMS)).cast("int")
    once = alike.select("b.bucket", blocks.alias("blocks"))
    members = cut(dealt.select("k", "band", "bucket").join(once, "bucket"))
    members = narrow(members, members.count())
    of_text = F.map_from_entries(F.collect_list(F.struct("band", "bucket")))
    wanted = members.groupBy("k").agg(of_text.alias("m")).join(texts.select("k", "own"), "k")
    wanted = wanted.select("k", "own", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0))).alias("kept"))
    found = rows.join(wanted, ["k", "own"]).groupBy("k").agg(F.first("text").alias("text"), F.first("kept").alias("kept"))
    sets = found.mapInPandas(_shingled(n), "k long, kept array<long>, set array<long>")
    block = F.pmod(F.xxhash64("k", "bucket"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = members.withColumn("block", block).select("k", "band", "bucket", "block", F.explode(others).alias("other"))
    placed = placed.select("k", "band", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt_out = placed.join(sets, "k").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return cut(dealt_out.mapInPandas(_compared(similarity), FOUND))


def text_key(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _rows(df: DataFrame, text: str = "text") -> DataFrame:
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("own"), text_key(text).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def near_duplicates(df: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """For each row: doc_id, class_id, n_copies, n_links, kept.

    class_id is the smallest doc_id of the component of linked texts (null sorts first and is reported as
    null); n_copies counts the rows of an equal text; n_links counts the different texts that are linked with the row's text. kept is true for one
    row of each class (a row that is repeated as a whole has it on each repeat). Null and empty texts are one class; an empty
    table gives an empty result; texts are read whole, however long.
    """
    rows = _rows(df)
    texts = signed(rows, n)
    found = linked(rows.select("k", "own", "text"), texts, similarity, n)
    degrees = found.groupBy("k").agg(F.sum("links").alias("n_links"))
    edges = found.where(F.col("k") != F.col("other")).select(F.col("k").alias("a"), F.col("other").alias("b"))
    classes = texts.select("k", "n_copies", F.col("own").alias("first"))
    rooted = classes.join(components(edges).withColumnRenamed("node", "k"), "k", "left").join(degrees, "k", "left")
    rooted = rooted.select("k", "n_copies", "first", F.coalesce("root", "k").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    lowest = rooted.groupBy("root").agg(F.min(F.struct("first", "k")).alias("lowest"))
    told = rooted.join(lowest, "root").select("k", "n_copies", "n_links", "first", F.col("lowest.first").alias("class_id"), F.col("lowest.k").alias("class_k"))
    return rows.select("doc_id", "own", "k").join(told, "k").select(
        "doc_id", F.when(F.col("class_id") != NULL_ID, F.col("class_id")).alias("class_id"), "n_copies", "n_links",
        ((F.col("k") == F.col("class_k")) & (F.col("own") == F.col("class_id"))).alias("kept"), "k",
    )


def deduplicated(df: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """df's rows and columns, one row of each class: that of the smallest doc_id (null first), of rows that repeat it one."""
    k, own = fresh(df, "text_k", "own_id")
    kept = near_duplicates(df, similarity, n).where("kept").select(F.col("k").alias(k), F.coalesce("doc_id", F.lit(NULL_ID)).alias(own)).distinct()
    rows = df.withColumns({k: text_key(), own: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))})
    return rows.join(kept, [k, own]).dropDuplicates([k, own]).select(named(df))
