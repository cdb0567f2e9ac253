"""What keeps time and memory in bounds: texts and rankings are made once, Python holds a slice of a batch, pairs of copies are dealt."""

import random

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import dedup, pipeline, predict, rules
from newsloom.plans import articles as A
from newsloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_run_prepares_each_text_once(spark, monkeypatch):
    rows = [(i, "en", f"Title {i} of the day", "Source", f"u{i}", "2024-01-01T00:00:00", "A description of the &amp; day", "", []) for i in range(5)]
    df = spark.createDataFrame(rows, f"ord long, keyword string, title string, source string, link string, published_at string, description string, content string, related_articles array<{dedup.REFERENCE}>")
    plans, real = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda x: plans.append(plan(x)) or real(x))
    classifier = lambda x: predict.by_shares(x, F.lower(T.squeezed(pipeline.INPUT)), A.MODEL_WORDS)
    out = pipeline.classified(df, pipeline.Settings(A.rule_set(), classifier, A.LABELS), 5)
    assert max(p.count("기사제목") for p in plans) <= 2
    assert out.count() == 5 and "own_description" not in out.columns


def test_pairs_of_sets_are_all_pairs(spark):
    rng = random.Random(3)
    words = [["a", "b", "c", "d"], ["a", "b", "c", "정부는"], ["a", "b", "c", "정부는의"], ["q", "r", "s", "t"]]
    rows = [(i, sorted(rng.choice(words))) for i in range(60)]
    agree = lambda x, y: T.compatible_words(x, y)
    df = spark.createDataFrame(rows, "ord long, words array<string>")
    got = sorted(map(tuple, catalogue.pairs_of_sets(df, agree, block=4).collect()))
    each = df.alias("x").crossJoin(df.select(F.col("ord").alias("o"), F.col("words").alias("w"))).where((F.col("ord") < F.col("o")) & agree(F.col("words"), F.col("w")))
    assert got == sorted((r["ord"], r["o"]) for r in each.collect()) and len(got) > 400


def test_slices_keep_rows_in_order(spark):
    df = spark.range(0, 1_001, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("the x the "), F.col("id").cast("string"))).alias("t"))
    got = {r["id"]: r["s"] for r in df.select("id", rules.spans(F.col("t"), "[0-9]+").alias("s")).collect()}
    assert len(got) == 1_001 and all(got[i] is None if i % 7 == 0 else [(x["s"], x["e"]) for x in got[i]] == [(10, 10 + len(str(i)))] for i in got)
    assert T.SLICE < 1_001


def test_texts_are_ranked_once(spark):
    assert plan(catalogue.rule_scores(spark, SF)).count("ArrowEvalPython") == 1


def test_decisions_are_read_from_what_is_written(spark):
    assert all("ArrowEvalPython" not in plan(f(spark, SF)) for f in (catalogue.overall_metrics, catalogue.evidence_wilson))


def test_space_is_pythons(spark):
    odd = [chr(c) for c in range(1, 0x3100) if chr(c).isspace()]
    texts = ["".join(odd), *[f"a{c}b" for c in odd], *[f"a {c}b" for c in odd], *[f"a{c} b{c}" for c in odd], "a  b", " a b "]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(T.squeezed("t")).collect()]
    assert got == [" ".join(t.split()) for t in texts]


def test_shares_count_whole_words(spark):
    texts = ["the then the,the of", "los la que el", "", None, "è the éthe"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [(r["pred_label"], round(r["pred_score"], 4)) for r in predict.by_shares(rows, F.col("t"), A.MODEL_WORDS).orderBy("i").collect()]
    assert got == [("en", 1.0), ("es", 0.6667), ("en", 0.0), ("en", 0.0), ("en", 1.0)]


def test_values_at_ranks_are_exact(spark):
    keys = [random.Random(5).randrange(300) for _ in range(1_000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for parts in (2, 64):
        assert catalogue.values_at(df, "k", [-1, 0, 99, 500, 999], parts) == [sorted(keys)[max(r, 0)] for r in (-1, 0, 99, 500, 999)]


def test_a_batch_reads_its_range_of_the_table(spark, monkeypatch):
    """Each batch's rows are told by the reader; rows written apart would be read whole for each."""
    plans = []
    monkeypatch.setattr(catalogue.sinks.Store, "save", lambda self, rows: plans.append(plan(rows)))
    monkeypatch.setattr(catalogue.sinks.Store, "load", lambda self, spark: spark.createDataFrame([], "o_custkey long, o_orderstatus string, o_orderkey long, batch_seq long"))
    catalogue.store_batches(spark, SF)
    assert len(plans) == 10 and all("ExistingRDD" not in p and "LessThanOrEqual(o_orderkey" in p for p in plans)
