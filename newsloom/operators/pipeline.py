"""The whole run, and the retry of what is held for review.

collect -> clean titles -> group -> enrich? -> predict -> score rules -> decide -> retry? -> result rows.

Each step is written once. What gates and reports need to know of it (rows in, rows out, failed or impossible predictions, totals) is observed by that
write itself, so nothing is read a second time to be counted. A batch that fails says at which stage and why, and what was decided before
stays as partial results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newsloom.functions import text as T

from . import decide, dedup, extract, predict, rules, scores
from .ruleset import REVIEW, Policy, RuleSet

Classifier = Callable[[DataFrame], DataFrame]

# How a run may end.
STATUSES = ["SUCCESS", "NO_RESULTS", "NETWORK_ERROR", "COLLECTION_ERROR", "MODEL_ERROR"]
INPUT = "classification_text"


@dataclass
class Settings:
    rules: RuleSet
    classifier: Classifier
    labels: list[str] = field(default_factory=list)
    relaxed: Policy | None = None
    input_mode: str | None = None
    enrich_all: bool = False
    retry: bool = True
    entities: bool = True
    score_table: str | None = None  # folder of rankings that are kept between runs


# Stages that classify, and why a batch of them is not used.
STAGES = ["CLASSIFICATION", "RECLASSIFICATION"]
CAUSES = ["MODEL_INFERENCE_FAILURE", "PREDICTION_COUNT_MISMATCH", "MODEL_PREDICTION_FAILURE"]


class BatchFailure(Exception):
    """A batch whose predictions can't be used: cause is one of CAUSES."""

    def __init__(self, cause: str, message: str):
        super().__init__(message)
        self.cause = cause


class RunFailure(Exception):
    """A run that did not succeed, where its whole result is asked for."""


@dataclass
class Result:
    """status, rows (with a failed batch: what was decided before it, if anything), and of a failure its message, stage and cause.
    statistics: totals of rows, observed when they were written."""

    status: str
    rows: DataFrame | None = None
    error: str = ""
    stage: str = ""
    cause: str = ""
    statistics: dict = field(default_factory=dict)

    @property
    def succeeded(self) -> bool:
        return self.status in ("SUCCESS", "NO_RESULTS")

    def whole(self) -> DataFrame | None:
        """rows of a run that succeeded; of one that failed its failure is raised, so that partial results are never taken for the result."""
        if not self.succeeded:
            raise RunFailure(f"{self.status}: {self.stage} {self.cause}: {self.error}")
        return self.rows


def observed(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """df written, and these metrics of it, taken by the write."""
    seen = Observation()
    out = dedup.written(df.observe(seen, *metrics))
    if out.is_cached:  # nowhere to write to: kept in memory, which nothing has read yet
        out.count()
    return out, seen.get


def totals() -> list[Column]:
    """What a run reports, as metrics of its result."""
    d = F.col("decision")
    return [
        F.count(F.lit(1)).alias("classified_count"), F.coalesce(F.sum((F.size("related_articles") + 1).cast("long")), F.lit(0)).alias("collected_count"),
        F.count_if(d["rule_applied"]).alias("rule_applied_count"), F.count_if(d["final_label"] == REVIEW).alias("review_required_count"),
    ]


def with_input(df: DataFrame, own_description: str | None = None) -> DataFrame:
    """df with what the classifier reads; own_description: the column of the cleaned description, if df has one."""
    described = F.col(own_description) if own_description else T.article_description("title", "description", "source")
    return df.withColumn(INPUT, T.prepared_input(T.model_input(T.clean_text("title"), described, T.clean_text("content")), entities=False))


def articles_told() -> Column:
    """Which articles a table has, as a metric: two tables with as many rows have the same ord if this is the same (hashes, in any order)."""
    return F.sum(F.xxhash64("ord").cast("decimal(20,0)")).alias("articles")


def classified(df: DataFrame, s: Settings, n: int) -> DataFrame:
    """df (n articles) with pred_*, ranking and decision; BatchFailure if the classifier fails, loses, doubles or adds rows, or gives predictions that are none.

    Written out after the texts are prepared, after predictions, and again after ranking and decisions: what reads a text or a decision would
    otherwise repeat all that it is made of wherever it is read, and only predictions can fail as a batch: any other failure is no model's and is raised as it is.
    """
    texts, sent = observed(with_input(df.withColumn("own_description", T.article_description("title", "description", "source")), "own_description"), articles_told())
    try:
        predicted, told = observed(s.classifier(texts), articles_told(), *predict.problems(s.labels or list(s.rules.labels)))
    except Exception as e:  # whatever a model raises, here or in a task
        raise BatchFailure(CAUSES[0], str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__) from e
    if told["rows"] != n:
        raise BatchFailure(CAUSES[1], f"{n} texts, {told['rows']} predictions")
    if told["articles"] != sent["articles"]:
        raise BatchFailure(CAUSES[1], f"{n} texts, as many predictions, but not one of each")
    odd = {k: v for k, v in told.items() if k not in ("rows", "articles") and v}
    if odd:
        raise BatchFailure(CAUSES[2], ", ".join(f"{k}: {v} of {n}" for k, v in odd.items()))
    cleaned = predicted.withColumn("raw_description", F.col("description")).withColumn("description", F.col("own_description")).drop("own_description")
    ranked = scores.ScoreTable(s.score_table, s.rules).ranked(cleaned)[0] if s.score_table else rules.rank_articles(cleaned, s.rules)
    decided = ranked.withColumn("decision", decide.post_processed(s.rules, s.relaxed, s.input_mode))
    return dedup.written(decided.withColumn("description", F.col("raw_description")).drop("raw_description", "rule_text", "hits", "ranking", "rule_margin", "tied_labels"))


def retry_status(enabled: bool, has_pages: bool, changed: Column) -> Column:
    """How the retry of a row held for review goes; columns link, old_content, content, enrichment_status.

    Ordered: disabled, already enriched, has a body, no pages, no link, no body found, input unchanged, else PENDING.
    """
    none = lambda c: T.squeezed(c) == ""
    return (
        F.when(F.lit(not enabled), "DISABLED").when(F.col("already"), "ALREADY_ENRICHED").when(~none("old_content"), "CONTENT_PRESENT").when(F.lit(not has_pages), "NO_SCRAPER")
        .when(F.coalesce("link", F.lit("")) == "", "NO_LINK").when(none("content"), F.coalesce("enrichment_status", F.lit("NO_CONTENT"))).when(~changed, "UNCHANGED_INPUT").otherwise("PENDING")
    )


def retried(df: DataFrame, s: Settings, pages: DataFrame | None, already: bool = False) -> DataFrame:
    """Rows held for review get a body if their page has one, and are classified once more if that changes their input.

    Only those rows are read again; the others pass. Adds retry: JSON text of what the first decision was, for rows that were held.
    """
    held, rest = df.where(F.col("decision.final_label") == REVIEW), df.where(F.col("decision.final_label") != REVIEW)
    rest = rest.withColumn("retry", F.lit(None).cast("string"))
    old = held.withColumns({"old_content": F.col("content"), "old_input": F.col(INPUT), "first": F.struct("pred_label", "pred_score", "pred_margin", "decision"), "already": F.lit(already)})
    if pages is not None:
        old = dedup.written(extract.enriched(old, pages))
    else:
        old = old.withColumns({"enrichment_status": F.lit(None).cast("string"), "http_status": F.lit(None).cast("int"), "extraction": F.lit(None).cast("struct<content:string,method:string,reason:string,paragraph_count:int,candidate_count:int>")})
    old = with_input(old).withColumn("retry_status", retry_status(s.retry, pages is not None, F.col(INPUT) != F.col("old_input")))
    old, told = observed(old, F.count_if(F.col("retry_status") == "PENDING").alias("pending"))
    pending = old.where(F.col("retry_status") == "PENDING")
    again = classified(pending.drop(INPUT, "pred_label", "pred_score", "pred_margin", "pred_top_labels", "pred_top_scores", "decision"), s, told["pending"]).withColumn("retry_status", F.lit("RECLASSIFIED"))
    stays = old.where(F.col("retry_status") != "PENDING").withColumns({"content": F.col("old_content"), INPUT: F.col("old_input")})
    both = again.unionByName(stays)
    record = F.struct(
        F.col("retry_status").alias("status"), F.col("first.pred_label").alias("initial_model_category"), F.col("first.pred_score").alias("initial_model_score"), F.col("first.pred_margin").alias("initial_score_margin"),
        F.col("first.decision.final_label").alias("initial_final_category"), F.col("first.decision.rule_reason").alias("initial_rule_reason"),
        F.coalesce("enrichment_status", "retry_status").alias("enrichment_status"), "http_status", F.col("extraction.method").alias("extraction_method"), F.col("extraction.reason").alias("extraction_reason"),
    )
    return both.withColumn("retry", F.to_json(record)).drop("old_content", "old_input", "first", "already", "enrichment_status", "http_status", "extraction", "retry_status").unionByName(rest)


def run(articles: DataFrame, s: Settings, pages: DataFrame | None = None, created_at: str = "") -> Result:
    """articles: ord and the article columns. pages: fetched pages (url, html), for bodies."""
    named = articles.withColumn("title", T.strip_source_suffix("title", "source", s.entities))
    groups, told = observed(dedup.deduplicate(named, s.entities), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("group_article_count").cast("long")), F.lit(0)).alias("articles"))
    if not told["rows"]:
        return Result("NO_RESULTS", None, statistics={"collected_count": 0, "deduplicated_count": 0})
    counts = {"collected_count": told["articles"], "deduplicated_count": told["rows"]}
    if s.enrich_all and pages is not None:
        groups = extract.enriched(groups, pages).drop("enrichment_status", "http_status", "extraction")
    first, stage = None, STAGES[0]
    try:
        first = classified(groups.drop("group_article_count"), s, told["rows"])
        stage = STAGES[1]
        out = retried(first, s, pages, already=s.enrich_all)
    except BatchFailure as e:
        if first is None:
            return Result("MODEL_ERROR", None, str(e), stage, e.cause, counts)
        rows, found = observed(first.withColumns({"retry": F.lit(None).cast("string"), "created_at": F.lit(created_at)}), *totals())
        return Result("MODEL_ERROR", rows, str(e), stage, e.cause, found | counts)
    rows, found = observed(out.withColumn("created_at", F.lit(created_at)), *totals())
    return Result("SUCCESS", rows, statistics=found | counts)
