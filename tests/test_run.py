"""The whole run, on the small tables."""

import json

import pytest

from newsloom.operators.ruleset import REVIEW
from newsloom.plans import articles, catalogue
from newsloom.sources import feeds

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in catalogue.full_run(spark, D).collect()]


def test_rows_have_the_result_columns_and_every_article_once(spark, rows):
    assert rows and list(rows[0]) == feeds.RESULT
    links = [r["link"] for r in rows] + [x["link"] for r in rows for x in json.loads(r["related_articles"])]
    assert sorted(links) == sorted(f"https://news.example/{r['ord']}" for r in articles.articles(spark, D).select("ord").collect())
    assert all(r["group_article_count"] == 1 + len(json.loads(r["related_articles"])) for r in rows)


def test_decisions_agree_with_their_columns(rows):
    for r in rows:
        held = r["final_category"] == REVIEW
        assert r["decision_source"] == ("REVIEW" if held else "RULE" if r["rule_applied"] == "Y" else "MODEL")
        assert r["review_required"] == held and r["final_decision_status"] == ("REVIEW_REQUIRED" if held else "DECIDED")


def test_what_was_held_is_retried_once(rows):
    told = [(r, json.loads(r["review_reclassification"])) for r in rows if r["review_reclassification"] != "{}"]
    again = [(r, x) for r, x in told if x["status"] == "RECLASSIFIED"]
    assert again and all(x["initial_final_category"] == REVIEW for _, x in told)
    assert all(r["content"] and x["enrichment_status"] == "BODY_EXTRACTED" and x["extraction_method"] for r, x in again)
    assert all(r["final_category"] == REVIEW for r, x in told if x["status"] != "RECLASSIFIED")
    assert any(r["final_category"] != REVIEW for r, _ in again)
