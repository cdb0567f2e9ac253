"""Arriving articles as a stream: drop exact duplicates inside the event window, keep a cumulative store.

An extension: the batch operators have no streaming counterpart to agree with. State is bounded by the
watermark: a key is forgotten 48 hours after the latest date seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions import text as T
from newsloom.functions import values as V
from newsloom.sources.sinks import Store

WINDOW = "48 hours"


def without_repeats(articles: DataFrame, window: str = WINDOW) -> DataFrame:
    """Articles (title, source, published_at, ...) whose title and source were not seen within the window; those without a date are dropped."""
    keyed = articles.withColumns({"published_ts": V.published_time("published_at"), "title_key": T.normalize_key(T.strip_source_suffix("title", "source")), "source_key": T.normalize_key("source")})
    dated = keyed.where(F.col("published_ts").isNotNull()).withWatermark("published_ts", window)
    return dated.dropDuplicatesWithinWatermark(["title_key", "source_key"]).drop("title_key", "source_key")


def counts_by_window(articles: DataFrame, label: str, window: str = "1 hour", late: str = WINDOW) -> DataFrame:
    """Articles per label and time window; a window closes when the watermark passes it."""
    dated = articles.withColumn("published_ts", V.published_time("published_at")).withWatermark("published_ts", late)
    return dated.groupBy(F.window("published_ts", window), label).agg(F.count(F.lit(1)).alias("n"))


def keep(results: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each batch of result rows (with ord) to the store; the last one of a key stays. The store's manifest has the number of this stream's last
    batch, so a batch that is replayed after a failure changes nothing."""

    def save(batch: DataFrame, number: int) -> None:
        store.save(batch, tag=(checkpoint, number))

    return results.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
