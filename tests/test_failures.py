"""Batches that fail: at which stage, why, and what stays."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import pipeline, predict, rules
from newsloom.operators.ruleset import FAILED, REVIEW
from newsloom.plans import articles as A
from newsloom.plans import catalogue
from newsloom.sources import sinks

AT = "2026-01-01T00:00:00+00:00"
KIND = "ord long, keyword string, title string, source string, link string, published_at string, description string, content string"


@pytest.fixture(scope="module")
def stories(spark):
    rows = [(i, "k", f"story number {i} the of and", f"s{i}", f"https://p.example/{i}", AT, "", "") for i in range(6)] + [(6, "k", "nothing to see here seven", "s", "https://p.example/6", AT, "", ""), (7, "k", "story number 0 the of and", "s0", "https://p.example/7", AT, "", "")]
    return spark.createDataFrame(rows, KIND)


def shares(df):
    return predict.by_shares(df, F.lower(F.col(pipeline.INPUT)), A.MODEL_WORDS)


def run(stories, classifier, pages=None, **kw):
    return pipeline.run(stories, pipeline.Settings(A.rule_set(), classifier, A.LABELS, entities=False, **kw), pages)


def raises(df):
    @F.udf("string")
    def broken(x):
        raise RuntimeError("no model today")

    return shares(df.withColumn("broken", broken("title")))


FAILING = {
    "MODEL_INFERENCE_FAILURE": [raises, lambda df: 1 / 0, lambda df: df.select("no such column")],
    "PREDICTION_COUNT_MISMATCH": [lambda df: shares(df).where("ord <> 3"), lambda df: shares(df).unionByName(shares(df).where("ord = 1"))],
    "MODEL_PREDICTION_FAILURE": [
        lambda df: shares(df).withColumn("pred_label", F.when(F.col("ord") == 2, FAILED).otherwise(F.col("pred_label"))), lambda df: shares(df).withColumn("pred_label", F.lit("strange")),
        lambda df: shares(df).withColumn("pred_score", F.lit(float("nan"))), lambda df: shares(df).withColumn("pred_margin", F.lit(2.0)), lambda df: shares(df).withColumn("pred_label", F.lit(None).cast("string")),
    ],
}


@pytest.mark.parametrize("cause,n", [(c, n) for c, all_ in FAILING.items() for n in range(len(all_))])
def test_first_batch(stories, cause, n):
    got = run(stories, FAILING[cause][n])
    assert (got.status, got.stage, got.cause, got.succeeded) == ("MODEL_ERROR", "CLASSIFICATION", cause, False)
    assert got.rows is None and got.error and got.statistics == {"collected_count": 8, "deduplicated_count": 7}


@pytest.mark.parametrize("cause,n", [("MODEL_INFERENCE_FAILURE", 0), ("PREDICTION_COUNT_MISMATCH", 0), ("MODEL_PREDICTION_FAILURE", 1)])
def test_a_failed_retry_leaves_the_first_decisions(spark, stories, cause, n):
    calls = []

    def second_fails(df):
        calls.append(1)
        if len(calls) == 1:
            return shares(df)
        return FAILING[cause][n](df) if cause != "PREDICTION_COUNT_MISMATCH" else shares(df).limit(0)

    body = "<article><p>" + "the council of the town and the harbour of the bay are for the plan was is " * 3 + "</p></article>"
    pages = spark.createDataFrame([(f"https://p.example/{i}", body) for i in range(8)], "url string, html string")
    good = run(stories, shares, pages)
    held = good.rows.where(F.col("retry").isNotNull()).count()
    assert good.status == "SUCCESS" and held and good.statistics["classified_count"] == good.statistics["deduplicated_count"] == 7 and good.statistics["collected_count"] == 8
    got = run(stories, second_fails, pages)
    assert (got.status, got.stage, got.cause) == ("MODEL_ERROR", "RECLASSIFICATION", cause) and len(calls) == 2
    left = got.rows.collect()
    assert len(left) == 7 and got.statistics["classified_count"] == 7 and got.statistics["review_required_count"] == sum(r["decision"]["final_label"] == REVIEW for r in left) == held


def test_statistics_are_those_of_the_rows(stories):
    got = run(stories, shares)
    rows = got.rows.collect()
    assert got.statistics["rule_applied_count"] == sum(bool(r["decision"]["rule_applied"]) for r in rows) and got.statistics["collected_count"] == 8
    assert run(stories.where("ord < 0"), shares).status == "NO_RESULTS"


def test_one_article_lost_and_one_doubled_is_no_result(stories):
    got = run(stories, lambda df: shares(df).where("ord <> 3").unionByName(shares(df).where("ord = 1")))
    assert (got.status, got.stage, got.cause, got.rows) == ("MODEL_ERROR", "CLASSIFICATION", "PREDICTION_COUNT_MISMATCH", None)


@pytest.mark.parametrize("where", ["plan", "task"])
def test_a_failure_that_is_no_models_is_raised(stories, monkeypatch, where):
    def broken(df, rules_):
        if where == "plan":
            raise RuntimeError("no ranking today")
        return real(df, rules_).withColumn("rule_margin", F.raise_error(F.lit("no ranking today")).cast("int"))

    real = rules.rank_articles
    monkeypatch.setattr(rules, "rank_articles", broken)
    with pytest.raises(Exception, match="no ranking today"):
        run(stories, shares)


def test_partial_rows_are_not_the_result_of_full_run(spark, monkeypatch):
    calls, real = [], predict.by_shares

    def second_fails(df, *args):
        calls.append(1)
        return real(df, *args) if len(calls) == 1 else real(df, *args).limit(0)

    monkeypatch.setattr(predict, "by_shares", second_fails)
    with pytest.raises(Exception, match="MODEL_ERROR: RECLASSIFICATION PREDICTION_COUNT_MISMATCH"):
        catalogue.full_run(spark, "/root/testdata/sf0.001").count()
    assert len(calls) == 2


def test_full_run_without_articles_has_no_rows(spark, stories, tmp_path):
    for name in ("documents", "pages"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    got = catalogue.full_run(spark, str(tmp_path))
    assert got.count() == 0 and got.dtypes == sinks.result_rows(run(stories, shares).rows).dtypes
