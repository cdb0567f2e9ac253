"""Rankings that are kept between runs."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from newsloom.operators import rules, scores
from newsloom.plans import articles as A

KIND = "ord long, title string, description string, content string"


@pytest.fixture(scope="module")
def stories(spark):
    rows = [(i, f"the story {i} of", "und der" if i % 3 else None, "les des " * (i % 5)) for i in range(200)]
    return spark.createDataFrame([*rows, (200, *rows[7][1:]), (201, None, None, None), (202, "", "", "")], KIND)


def plain(df, rs):
    return sorted((r["ord"], r["rule_margin"], tuple(x["score"] for x in r["ranking"]), tuple(h["phrase"] for h in r["hits"]), tuple(r["tied_labels"])) for r in df.collect())


def test_only_what_is_new_is_ranked(spark, stories, tmp_path):
    rs = A.rule_set()
    want = plain(rules.rank_articles(stories, rs), rs)
    table = scores.ScoreTable(str(tmp_path), rs)
    full, n = table.ranked(stories.where("ord < 198"))
    assert n == 198 and plain(full, rs) == [x for x in want if x[0] < 198]
    full, n = table.ranked(stories)
    assert n == 3 and plain(full, rs) == want  # two articles and the empty one; 200 repeats another, 202 is like 201
    assert table.ranked(stories)[1] == 0 and len(table.batches(spark)) == 2
    changed = stories.withColumn("title", F.when(F.col("ord") == 5, "den nicht mit").otherwise(F.col("title")))
    full, n = table.ranked(changed)
    assert n == 1 and plain(full, rs) == plain(rules.rank_articles(changed, rs), rs)
    assert table.ranked(stories.where("ord < 0"))[0].collect() == []


def test_other_rules_read_nothing_of_these(spark, stories, tmp_path):
    rs = A.rule_set()
    other = replace(rs, version="2")
    scores.ScoreTable(str(tmp_path), rs).ranked(stories)
    assert scores.ScoreTable(str(tmp_path), other).ranked(stories)[1] == 201
    table = scores.ScoreTable(str(tmp_path), rs)
    assert table.forget_others(spark) == 1 and table.ranked(stories)[1] == 0 and scores.ScoreTable(str(tmp_path), other).kept(spark) is None


def test_a_broken_batch_is_not_read(spark, stories, tmp_path):
    rs = A.rule_set()
    table = scores.ScoreTable(str(tmp_path), rs)
    table.ranked(stories.where("ord < 100"))
    (batch,) = table.batches(spark)
    table._delete(spark, batch + "/_SUCCESS")
    assert table.kept(spark) is None and table.ranked(stories)[1] == 201


def test_a_ranking_is_used_again_only_under_its_rules(stories):
    rs = A.rule_set()
    once = rules.rank_articles(stories, rs)
    assert rules.ranked_once(once, rs) is once
    other = replace(rs, version="2")
    again = rules.ranked_once(once, other)
    assert again is not once and again.schema["ranking"].metadata["rules"] == other.fingerprint() and again.count() == stories.count()


def test_fields_do_not_run_together(spark):
    df = spark.createDataFrame([("a", "b:", "c"), ("a:1", "b", "c"), ("a", "b", ":c"), (None, "a", "")], "title string, description string, content string")
    assert df.select(scores.article_hash().alias("h")).distinct().count() == 4
