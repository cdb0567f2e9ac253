"""Sources: landed feeds, reviewed datasets, stored results, JSON cases. Nothing here opens the network.

A connector that does is a ``Source``: it lands what it fetched as files, and queries read the files.
"""

from __future__ import annotations

import heapq
import json
from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from newsloom.functions import text as T
from newsloom.functions import values as V

ARTICLE = S.StructType([S.StructField(c, S.StringType()) for c in ("keyword", "title", "link", "source", "published_at", "description", "content")])
RESULT = [
    "keyword", "title", "source", "published_at", "link", "description", "content", "classification_text", "model_category", "model_category_score", "model_confidence",
    "model_confidence_level", "score_margin", "final_category", "decision_source", "review_required", "final_decision_status", "rule_applied", "rule_reason", "rule_best_label",
    "rule_match_count", "top3_labels", "top3_scores", "created_at", "group_article_count", "related_articles", "review_reclassification",
]


class CollectionError(RuntimeError):
    """Articles could not be collected."""


class NetworkError(CollectionError):
    pass


class FeedError(CollectionError):
    pass


class Source(ABC):
    """Articles for a keyword."""

    @abstractmethod
    def fetch(self, spark: SparkSession, keyword: str, limit: int = 10) -> DataFrame: ...


class LandedFeeds(Source):
    """Feeds that a connector landed as ``<root>/<anything>.xml``, or a folder of them for each keyword."""

    def __init__(self, path: str):
        self.path = path

    def fetch(self, spark: SparkSession, keyword: str, limit: int = 10) -> DataFrame:
        return read_feed(spark, self.path, keyword, V.validate_limit(limit))


def search_urls(df: DataFrame, keyword: str = "keyword", days: int = 7) -> DataFrame:
    return df.withColumn("url", V.search_url(keyword, days))


_ITEM = "struct<title:string,link:string,pubDate:string,source:struct<_VALUE:string>,description:string>"


def parse_items(df: DataFrame, xml: str = "value", ord_: str = "ord") -> DataFrame:
    """ord, title, link, source, published_at, description of feed items given as XML text."""
    item = F.from_xml(F.col(xml), "title string, link string, pubDate string, source string, description string", {"rowTag": "item"})
    return _articles(df.withColumn("i", item), ord_)


def _articles(df: DataFrame, ord_: str) -> DataFrame:
    return df.select(
        F.col(ord_).alias("ord"), T.clean_text("i.title").alias("title"), T.clean_text("i.link").alias("link"), T.clean_text("i.source").alias("source"),
        V.rss_datetime(T.clean_text("i.pubDate")).alias("published_at"), T.normalize_description(T.strip_html(F.coalesce("i.description", F.lit("")))).alias("description"),
    )


def read_feed(spark: SparkSession, path: str, keyword: str, limit: int = 10) -> DataFrame:
    """The first ``limit`` items of each feed file, in order; of those, the ones that have a title and a link.

    Raises FeedError for a file that is no feed, or whose items all lack title or link; a feed without items is empty.
    """
    files = spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("file"), "value")
    # xpath would parse the whole document for each field: cut the items out, then read each on its own
    channel = F.rlike("value", F.lit(r"(?s)<channel[\s>]"))
    closed = F.rlike("value", F.lit(r"(?s)</channel>\s*</rss>\s*$"))
    broken = files.where(~channel | ~closed).count()
    if broken:
        raise FeedError(f"{broken} files are no feed")
    items = files.select("file", F.posexplode(F.slice(F.regexp_extract_all("value", F.lit(r"(?s)<item[\s>].*?</item>"), 0), 1, limit)).alias("place", "value"))
    rows = parse_items(items.withColumn("ord", F.struct("file", "place")))
    good = rows.where((F.col("title") != "") & (F.col("link") != ""))
    if good.isEmpty() and not items.isEmpty():
        raise FeedError("no item has a title and a link")
    return good.select(F.lit(keyword).alias("keyword"), "title", "link", "source", "published_at", "description", F.lit("").alias("content"), "ord")


def read_reviewed(spark: SparkSession, path: str) -> DataFrame:
    """A reviewed dataset (CSV with a header, UTF-8, byte order mark allowed): every column text, missing ''.

    Duplicate headers and rows with too few or too many fields are refused.
    """
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise ValueError("the dataset is empty")
    import csv

    names = next(csv.reader([head[0][0].lstrip("﻿")]))
    if len(names) != len(set(names)):
        raise ValueError(f"duplicate columns: {names}")
    schema = S.StructType([S.StructField(n, S.StringType()) for n in names])
    rows = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", multiLine=True, quote='"', escape='"', enforceSchema=True)
    return rows.fillna("")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results; an empty frame of the result columns if there are none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], S.StructType([S.StructField(c, S.StringType()) for c in RESULT]))


def load_cases(path: str, fields: list[str]) -> list[dict[str, str]]:
    """Cases of a small JSON file: an object with a list under 'cases', each with these fields as text."""
    with open(path, encoding="utf-8") as f:
        cases = json.load(f)["cases"]
    for c in cases:
        gone = [x for x in fields if not isinstance(c.get(x), str)]
        if gone:
            raise ValueError(f"case {c.get('id')}: missing {gone}")
    return cases


PICKED = "query_ord long, place long, event_id string, turn long"


def _picked(target: int):
    """Picks from a frame of (query_ord, place, event_id): a heap holds for each query the turn it is at and its next place."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["query_ord", "place"]).drop_duplicates(["query_ord", "event_id"])
        pools = {q: iter(list(zip(g["place"], g["event_id"]))) for q, g in frame.groupby("query_ord")}
        waiting = [(1, q) for q in sorted(pools)]
        met: set[str] = set()
        out: list[tuple] = []
        while waiting and len(out) < target:
            turn, q = heapq.heappop(waiting)
            found = next((x for x in pools[q] if x[1] not in met), None)
            if found is not None:
                met.add(found[1])
                out.append((q, found[0], found[1], turn))
                heapq.heappush(waiting, (turn + 1, q))
        return pd.DataFrame(out, columns=["query_ord", "place", "event_id", "turn"])

    return run


def round_robin(df: DataFrame, per_query: int, target: int) -> DataFrame:
    """Articles picked in turn from each query's pool, at most ``target`` and one per event, with the turn they were picked in (``turn``, or with
    underscores before it where df has such a column).

    df: query_ord, place, event_id, ... In its turn a query gives its first article whose event was not picked before, so an
    event met earlier costs no turn. Picks depend on one another: they are made in one task, from three columns of at most
    ``per_query`` rows of each query.
    """
    pool = df.where(F.col("place") < per_query).select(F.col("query_ord").cast("long").alias("query_ord"), F.col("place").cast("long").alias("place"), "event_id")
    picks = pool.groupBy(F.lit(0).alias("all")).applyInPandas(_picked(target), PICKED)
    rest = df.withColumns({"query_ord": F.col("query_ord").cast("long"), "place": F.col("place").cast("long")})
    name = "turn"
    while name in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return rest.join(picks.withColumnRenamed("turn", name), ["query_ord", "place", "event_id"])


def fetch_outcome(failure: Column, http_status: Column) -> Column:
    return V.fetch_status(failure, http_status)
