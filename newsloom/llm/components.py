"""Connected components of links by alternating large-star and small-star steps, each cut to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, narrow


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, large: bool, rows: int) -> DataFrame:
    """links: (a, b). Large: each node's larger neighbours to its smallest; small: its smaller ones and itself."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    if large:
        out = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = both.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return narrow(narrow(out.where(F.col("a") > F.col("b")), 2 * rows).distinct(), rows)


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node that has a link; links: (a, b), a <> b.

    A node with very many links is a join key that Spark splits, never a group that a task collects.
    """
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct())
    state = _state(now)
    while state[0]:
        now = cut(_star(_star(narrow(now, state[0]), True, state[0]), False, state[0]))
        last, state = state, _state(now)
        if state == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
