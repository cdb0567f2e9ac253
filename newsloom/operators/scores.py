"""Rankings kept between runs: each different article is ranked once for each rule set.

A table of rankings by (fingerprint of the rule set, hash of what is ranked). A run anti-joins its articles with what is kept, ranks the rest, writes
that as a batch of its own and joins the whole back, so its cost follows what is new. Another rule set is another folder: nothing
kept for one is ever read for another.

A batch counts once its write has ended (Spark's mark is there); one that was broken off is never read. Two runs at once may rank one article
twice: either result is the same, and one of them is taken. Articles that are alike in all fields are ranked once. A null field counts as empty, as it does to the rules.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import rules as R
from .ruleset import RuleSet

FIELDS = ("title", "description", "content")
KEPT = ("hits", "ranking", "rule_margin", "tied_labels")


def article_hash(fields: tuple[str, ...] = FIELDS) -> Column:
    """sha256 of the fields, each with its length, so that no text runs into the next."""
    parts = [x for c in fields for x in (F.length(F.coalesce(F.col(c), F.lit(""))).cast("string"), F.coalesce(F.col(c), F.lit("")))]
    return F.sha2(F.concat_ws(":", *parts), 256)


class ScoreTable:
    """Rankings under ``path``, a folder that the session's executors share. rank: (df, rules) -> df with KEPT, from ``fields`` alone."""

    def __init__(self, path: str, rules: RuleSet, rank: Callable[[DataFrame, RuleSet], DataFrame] = R.rank_articles, fields: tuple[str, ...] = FIELDS):
        self.rules, self.rank, self.fields = rules, rank, fields
        self.root, self.path = path, f"{path}/{rules.fingerprint()}"

    def _listed(self, spark: SparkSession, path: str) -> list[str]:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().toString() for x in fs.listStatus(at)] if fs.exists(at) else []

    def batches(self, spark: SparkSession) -> list[str]:
        """Folders of the batches that were written to their end."""
        return sorted(b for b in self._listed(spark, self.path) if any(f.endswith("/_SUCCESS") for f in self._listed(spark, b)))

    def kept(self, spark: SparkSession) -> DataFrame | None:
        found = self.batches(spark)
        return spark.read.parquet(*found) if found else None

    def ranked(self, df: DataFrame) -> tuple[DataFrame, int]:
        """df with KEPT of every row, and how many different articles had to be ranked for it."""
        spark = df.sparkSession
        keyed = df.drop(*KEPT).withColumn("article_hash", article_hash(self.fields))
        wanted, known, seen = keyed.select("article_hash", *self.fields).dropDuplicates(["article_hash"]), self.kept(spark), Observation()
        new = wanted if known is None else wanted.join(known.select("article_hash"), "article_hash", "left_anti")
        rows = self.rank(new, self.rules).select("article_hash", *KEPT).observe(seen, F.count(F.lit(1)).alias("n"))
        batch = f"{self.path}/{uuid.uuid4().hex}"
        rows.write.parquet(batch)
        n = seen.get["n"]
        if not n:  # an empty batch would only be listed
            self._delete(spark, batch)
        full = self.kept(spark)
        if full is None:
            full = spark.createDataFrame([], rows.schema)
        return keyed.join(full.dropDuplicates(["article_hash"]), "article_hash", "left").drop("article_hash"), n

    def _delete(self, spark: SparkSession, path: str) -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def forget_others(self, spark: SparkSession) -> int:
        """Delete what is kept for other rule sets; how many there were."""
        others = [x for x in self._listed(spark, self.root) if not x.endswith(f"/{self.rules.fingerprint()}")]
        for x in others:
            self._delete(spark, x)
        return len(others)
