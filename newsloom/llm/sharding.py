"""Sharding: vector bin packing of groups of equal texts by bytes, tokens and rows together.

Groups are gathered to items of bounded number: a group over a 64th of a shard is an item of its own, and
the rest fall by hash into lots, from coarse to fine. Items are placed largest first, each where the dot
product of its vector with the shard's residual capacity is highest among the shards with room for its
bytes. A group larger than a shard is cut into pieces of a shard's 16th, so that no row is dropped and no task
sees it whole; every other group stays in one shard.

Law: ``bytes`` (sizes near equal). A null text counts as an empty text of the same group; its text_crc32 is 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words

SHARDS = 40
OVERHEAD = 16
#: Lots at each of the levels below; level i has half the hash space of level i - 1 and the last two are alike.
LOTS = 1_024
LEVELS = 6


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; vectors: bytes, tokens, rows of each item, all >= 0."""
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1) * shards  # of one shard's even load
    left = np.ones((shards, share.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((np.arange(len(share)), -share[:, 1:].sum(axis=1), -share[:, 0])):
        room = np.flatnonzero(left[:, 0] >= share[i, 0])
        if len(room):
            best = room[np.argmax(left[room] @ share[i])]
        else:
            best = np.argmax(left[:, 0])
        out[i] = best
        left[best] -= share[i]
    return out


def sharded(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row's doc_id, size, text_crc32, law, shard, slot (gapless in its shard) and grown_shard (null).

    Rows that repeat a doc_id are rows of their own. Only sums per item (about LOTS * LEVELS lots, at most 64
    groups per shard and their pieces) reach the driver; texts do not move, only their hashes and sizes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), n_words(F.col("text")).alias("tokens"), F.xxhash64(text).alias("group"),
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return df.sparkSession.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    room = (max(1, total["size"] // shards), max(1, total["rows"] // shards))
    heavy = [
        (r["group"], int(min(max(16 * r["size"] / room[0], 16 * r["rows"] / room[1]), r["rows"])) + 1 if max(r["size"] / room[0], r["rows"] / room[1]) > 1 else 1)
        for r in rows.groupBy("group").agg(*sums).where((F.col("size") > room[0] / 64) | (F.col("rows") > room[1] / 64)).collect()
    ]
    # At most 128 groups for each shard are heavy.
    known = df.sparkSession.createDataFrame(heavy, "group long, pieces int")
    spread = F.pmod(F.hash("group"), F.lit(1 << LEVELS - 1))
    level = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        level = F.when(spread >= (1 << LEVELS - 2 - i), F.lit(i)).otherwise(level)
    lot = F.concat_ws("-", F.lit("lot"), level, F.pmod(F.xxhash64(F.col("group"), F.lit(1)), F.lit(LOTS)))
    own = F.concat_ws("-", F.lit("group"), "group", F.pmod(F.xxhash64("doc_id"), F.col("pieces")))
    items = rows.join(F.broadcast(known), "group", "left").select("doc_id", "size", "text_crc32", "tokens", "group", F.when(F.col("pieces").isNull(), lot).otherwise(own).alias("item"), "pieces")
    # A heavy group that is not cut still may have too many rows for one window: number it in pieces by hash.
    part = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(64)))
    items = items.withColumn("part", part)
    found = items.groupBy("item", "part").agg(*sums).orderBy("item", "part").collect()
    names: dict[str, int] = {}
    for r in found:
        names.setdefault(r["item"], len(names))
    vectors = np.zeros((len(names), 3))
    for r in found:
        vectors[names[r["item"]]] += (r["size"], r["tokens"], r["rows"])
    at = place(vectors, shards)
    filled = [0] * shards
    placed = []
    for r in found:
        shard = int(at[names[r["item"]]])
        placed.append((r["item"], r["part"], shard, filled[shard]))
        filled[shard] += r["rows"]
    where = df.sparkSession.createDataFrame(placed, "item string, part int, shard int, base long")
    number = F.row_number().over(Window.partitionBy("item", "part").orderBy(F.asc_nulls_first("doc_id"), "group"))
    return items.join(F.broadcast(where), ["item", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + number - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
