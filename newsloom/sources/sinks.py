"""Sinks: the result table as CSV, a cumulative store with one row per key, additive migration, reports."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import values as V
from newsloom.operators import decide

from .feeds import RESULT

#: Columns that older stores lack, and what their rows get.
ADDED = {
    "model_confidence": None, "model_confidence_level": None, "decision_source": None, "review_required": None, "final_decision_status": None,
    "group_article_count": 1, "related_articles": "[]", "review_reclassification": "{}",
}


def result_rows(df: DataFrame, tiers: tuple[tuple[float, float], tuple[float, float]] = ((0.70, 0.10), (0.50, 0.05))) -> DataFrame:
    """The 27 result columns of decided articles: article columns, pred_*, decision (a struct), created_at, related_articles, retry (JSON text or null).

    tiers: score and margin of high and of medium confidence."""
    d = F.col("decision")
    applied = d["rule_applied"]
    refs = F.coalesce("related_articles", F.array().cast("array<struct<title:string,source:string,published_at:string,link:string>>"))
    own = {
        "classification_text": T.model_input(T.clean_text("title"), T.article_description("title", "description", "source"), T.clean_text("content")),
        "model_category": F.col("pred_label"), "model_category_score": F.round("pred_score", 4), "model_confidence": F.round("pred_score", 4),
        "model_confidence_level": decide.confidence_tier(F.col("pred_score"), F.col("pred_margin"), *tiers), "score_margin": F.round("pred_margin", 4), "final_category": d["final_label"],
        "decision_source": decide.decision_source(d["final_label"], applied), "review_required": decide.review_required(d["final_label"]), "final_decision_status": decide.decision_status(d["final_label"]),
        "rule_applied": F.when(applied, "Y").otherwise("N"), "rule_reason": d["rule_reason"], "rule_best_label": d["rule_best_label"], "rule_match_count": d["rule_match_count"],
        "top3_labels": F.array_join("pred_top_labels", ", "), "top3_scores": V.score_text(F.col("pred_top_scores")), "group_article_count": F.size(refs) + 1, "related_articles": F.to_json(refs),
        "review_reclassification": F.coalesce("retry", F.lit("{}")),
    }
    return df.select(*[own[c].alias(c) if c in own else F.col(c) for c in RESULT])


#: Result columns that are no text.
TYPES = {"model_category_score": "double", "model_confidence": "double", "score_margin": "double", "review_required": "boolean", "rule_match_count": "int", "group_article_count": "int"}


def no_result_rows(spark: SparkSession) -> DataFrame:
    """The result of a run that had no articles."""
    return spark.createDataFrame([], ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in RESULT))


def newest_first(df: DataFrame) -> DataFrame:
    """By published_at as text, descending, null last."""
    return df.orderBy(F.col("published_at").desc_nulls_last())


def write_table(df: DataFrame, path: str) -> str:
    """One CSV file with a header, byte order mark first, whole or not at all; the folder must exist.

    Rows are made in the cluster and stream through the driver one partition at a time.
    """
    import csv

    folder = os.path.dirname(os.path.abspath(path))
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    handle, name = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8-sig", newline="") as f:
            out = csv.writer(f)
            out.writerow(df.columns)
            for row in df.toLocalIterator():
                out.writerow(["" if x is None else x for x in row])
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """The result columns, newest first."""
    return write_table(newest_first(df.select(*RESULT)), path)


def write_csv_parts(df: DataFrame, path: str) -> None:
    """The same rows as part files, for tables that are too large for one."""
    newest_first(df.select(*RESULT)).write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def unique_key(keyword: str = "keyword", title: str = "title", source: str = "source") -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in (keyword, title, source)])


def latest(stored: DataFrame, new: DataFrame, batch: str = "batch_seq", ord_: str = "ord") -> DataFrame:
    """One row per unique_key: the last written. Both have batch (the write's number) and ord (the place in it)."""
    both = stored.unionByName(new, allowMissingColumns=True).withColumn("unique_key", unique_key())
    place = Window.partitionBy("unique_key").orderBy(F.desc(batch), F.desc(ord_))
    return both.withColumn("n", F.row_number().over(place)).where("n = 1").drop("n")


def migrated(df: DataFrame) -> DataFrame:
    """An older store's rows with the columns it lacks; three of them get a default, the others null."""
    types = {"model_confidence": "double", "review_required": "boolean", "group_article_count": "int"}
    out = df
    for name, value in ADDED.items():
        kind = types.get(name, "string")
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value).cast(kind))
        elif value is not None:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType)))
    return out


class StoreConflict(RuntimeError):
    """Another writer has made the version that this one was making; nothing of this save is in the store, and it can be tried again."""


class Store:
    """A cumulative Parquet store on any file system that the session reaches, of one row per unique key.

    Rows lie in ``buckets`` by the hash of their key. A version is a manifest that names the folder of each bucket: a save rewrites the buckets that
    its rows fall in and carries the others over by name, so what is written follows the batch, not the store. A manifest is made under its number,
    by a rename that fails where that number is there: of two writers one wins and the other gets StoreConflict. A save that is broken off leaves the version
    before. The ``kept`` last versions can be read; what only older ones name is deleted. The number of buckets is fixed by the first save.
    """

    def __init__(self, path: str, buckets: int = 64, kept: int = 2):
        self.path, self.buckets, self.kept = path.rstrip("/"), buckets, kept

    def _fs(self, spark: SparkSession):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        top = hadoop.Path(self.path)
        return hadoop, top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, spark: SparkSession) -> list[int]:
        """Numbers of the versions that can be read, ascending."""
        hadoop, fs = self._fs(spark)
        at = hadoop.Path(f"{self.path}/versions")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, spark: SparkSession, version: int | None = None) -> dict:
        """version, buckets (their number) and at (bucket -> folder under the store) of a version, the last one by default."""
        known = self.versions(spark)
        if version is None and not known:
            return {"version": 0, "buckets": self.buckets, "at": {}}
        hadoop, fs = self._fs(spark)
        stream = fs.open(hadoop.Path(f"{self.path}/versions/{known[-1] if version is None else version}.json"))
        try:
            return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, spark: SparkSession, manifest: dict) -> None:
        hadoop, fs = self._fs(spark)
        final = fs.makeQualified(hadoop.Path(f"{self.path}/versions/{manifest['version']}.json"))
        draft = hadoop.Path(final.getParent(), f"_{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(draft, final, options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise StoreConflict(f"version {manifest['version']} of {self.path} was made by another writer") from e
            raise

    def _read(self, spark: SparkSession, manifest: dict, wanted: set[int] | None = None) -> DataFrame | None:
        at = [f"{self.path}/{p}" for b, p in sorted(manifest["at"].items()) if wanted is None or int(b) in wanted]
        return migrated(spark.read.option("mergeSchema", "true").parquet(*at)) if at else None

    def load(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        return self._read(spark, self.manifest(spark, version))

    def save(self, rows: DataFrame, on: dict | None = None, tag: tuple[str, int] | None = None) -> int:
        """rows: the result columns and ord; the number of the version made, 0 without rows. on: the manifest that the save builds on, the last by default.
        tag: (writer, number) of a batch of a stream; a batch that the writer has saved already, or an earlier one, changes nothing, and 0 is returned."""
        spark = rows.sparkSession
        before = on or self.manifest(spark)
        tags = before.get("tags", {})
        if tag and tags.get(tag[0], -1) >= tag[1]:
            return 0
        bucket = F.pmod(F.xxhash64("unique_key"), F.lit(before["buckets"])).cast("int")
        new = rows.withColumns({"batch_seq": F.lit(before["version"] + 1).cast("long"), "unique_key": unique_key()}).withColumn("bucket", bucket)
        touched = {r[0] for r in new.select("bucket").distinct().collect()}  # as many as there are buckets
        if not touched:
            return 0
        old = self._read(spark, before, touched)
        both = (new if old is None else old.drop("bucket").unionByName(new.drop("bucket"), allowMissingColumns=True)).withColumn("bucket", bucket)
        # dealt by bucket once: keys meet, are sorted and are written where their bucket is
        last = both.repartition("bucket").withColumn("n", F.row_number().over(Window.partitionBy("bucket", "unique_key").orderBy(F.desc("batch_seq"), F.desc("ord")))).where("n = 1").drop("n")
        folder = f"data/{uuid.uuid4().hex}"
        last.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        made = {str(b): f"{folder}/bucket={b}" for b in sorted(touched)}
        try:
            self._commit(spark, {"version": before["version"] + 1, "buckets": before["buckets"], "at": before["at"] | made, "tags": tags | dict([tag] if tag else [])})
        except Exception:
            hadoop, fs = self._fs(spark)
            fs.delete(hadoop.Path(f"{self.path}/{folder}"), True)
            raise
        self._clear(spark)
        return before["version"] + 1

    def _clear(self, spark: SparkSession) -> None:
        """Delete versions beyond the kept ones, and the folders that only they name."""
        known = self.versions(spark)
        gone, stay = known[: -self.kept], known[-self.kept :]
        held = {p for v in stay for p in self.manifest(spark, v)["at"].values()}
        hadoop, fs = self._fs(spark)
        for v in gone:
            for p in set(self.manifest(spark, v)["at"].values()) - held:
                fs.delete(hadoop.Path(f"{self.path}/{p}"), True)
            fs.delete(hadoop.Path(f"{self.path}/versions/{v}.json"), False)


def write_candidates(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Candidates for review: CSV, refused over existing files unless asked for."""
    df.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, quote='"', escape='"')
