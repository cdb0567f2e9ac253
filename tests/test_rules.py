"""Rule scoring and decisions on fixed articles."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import decide, rules
from newsloom.operators.ruleset import FAILED, REVIEW, Policy, RuleSet, Term, normalized, phrase_pattern, proposals, validate


def rank(spark, texts, rs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    out = rules.rank(df.withColumn("rule_text", T.normalize_rule_text("t")), F.col("rule_text"), rs).orderBy("i").collect()
    return [{x["label"]: x for x in r["ranking"]} for r in out], out


def topics():
    """A few phrases for each topic that the articles below speak of: (label, strong ones, weak ones)."""
    few = [
        ("국제/통상", ["글로벌 공급망"], ["무역"]), ("생산/공급망", ["공급망"], ["공장"]), ("시장/산업", ["시장 점유율"], ["시장", "산업"]), ("정책/규제", ["탄소 규제", "정책"], []),
        ("기업동향", ["투자유치"], ["사업"]), ("금융/투자", ["공모가"], ["투자"]), ("노동/노사", ["노동조합", "파업"], ["임금"]), ("기술개발", [], ["기술", "연구", "개발"]),
    ]
    return RuleSet.of([{"label": label, "phrase": p, "strength": 2 if p in strong else 1} for label, strong, weak in few for p in strong + weak])


def test_spellings_match_with_and_without_spaces():
    finder = rules.Finder("ai 관련주")
    assert [list(finder.spans(t)) for t in ("xai관련주", "ai  관련주 ai관련주", "ai 관련")] == [[(1, 6)], [(0, 7), (8, 13)], []]
    assert list(rules.Finder("aa").spans("aa aaa aa")) == [(0, 2), (7, 9)] and list(rules.Finder("가가").spans("가가가가")) == [(0, 2), (2, 4)]


def test_a_long_text_takes_linear_time():
    import time

    matcher = rules.Matcher(RuleSet.of([{"label": "x" if i % 2 else "y", "phrase": w} for i, w in enumerate(["the", "of", "and", "on"])], labels=("x", "y", "other"), tie_priority={"x": 1, "y": 2}, other_label="other", technology_label="x"))
    took = []
    for n in (20_000, 200_000):
        began = time.process_time()
        matcher.hits("the end of it and on " * (n // 21))
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.001)


def test_longest_phrase_claims_its_text(spark):
    texts = ["글로벌 공급망 재편", "AI 시장 점유율 확대", "AI 시장 점유율 확대 시장 점유율", "탄소 규제 시행", "탄소규제 시행", "AI 스타트업 투자유치 성공", "정부가 ＡＩ 정책을 발표했다"]
    got, _ = rank(spark, texts, topics())
    assert got[0]["국제/통상"]["score"] == 2 and got[0]["생산/공급망"]["score"] == 0
    assert got[1]["시장/산업"]["score"] == 2 and got[1]["시장/산업"]["terms"] == ["시장 점유율"] == got[2]["시장/산업"]["terms"]
    assert got[3]["정책/규제"]["score"] == got[4]["정책/규제"]["score"] == 2
    assert got[5]["기업동향"]["score"] == 2 and got[5]["금융/투자"]["score"] == 0 and got[6]["정책/규제"]["score"] == 2


def mini(**kw):
    records = [{"label": "x", "phrase": "alpha"}, {"label": "y", "phrase": "beta"}, {"label": "x", "phrase": "cost os"}]
    return RuleSet.of(records, labels=("x", "y", "other"), tie_priority={"x": 20, "y": 10}, other_label="other", technology_label="x", **kw)


def test_ties_and_boundaries(spark):
    got, rows = rank(spark, ["alpha beta", "alphabet betas", "가alpha나"], mini())
    assert rows[0]["ranking"][0]["label"] == "y" and rows[0]["rule_margin"] == 0 and rows[0]["tied_labels"] == ["y", "x"]
    assert got[1]["x"]["score"] == 0 == got[1]["y"]["score"] and got[2]["x"]["score"] == 1


def test_matcher_equals_a_plain_scan():
    r = random.Random(5)
    words = ["ab", "abc", "bc", "가나", "나다", "c"]
    records = [{"label": "x" if i % 2 else "y", "phrase": w} for i, w in enumerate(words)]
    rs = RuleSet.of(records, labels=("x", "y", "other"), tie_priority={"x": 1, "y": 2}, other_label="other", technology_label="x")
    m = rules.Matcher(rs)
    for _ in range(300):
        text = "".join(r.choices("abc가나다 ", k=r.randint(0, 25)))
        taken, want = [False] * len(text), []
        for t in rs.scoring():
            hangul, at, found = any("가" <= c <= "힣" for c in t.phrase), 0, []
            while (i := text.find(t.phrase, at)) >= 0:
                j = i + len(t.phrase)
                edge = hangul or not ((i and text[i - 1].isascii() and text[i - 1].isalnum()) or (j < len(text) and text[j].isascii() and text[j].isalnum()))
                at = j if edge else i + 1
                if edge:
                    found.append((i, j))
            free = [(i, j) for i, j in found if not any(taken[i:j])]
            for i, j in free:
                taken[i:j] = [True] * (j - i)
            if free:
                want.append(t)
        assert m.hits(text) == want, text


def decided(spark, rs, rows, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, t string, pred_label string, pred_score double, pred_margin double")
    out = rules.rank(df.withColumn("rule_text", T.normalize_rule_text("t")), F.col("rule_text"), rs)
    return [r["d"] for r in out.withColumn("d", decide.decision(rs, **kw)).orderBy("i").collect()]


def test_decision_table(spark):
    rs = topics()
    got = decided(spark, rs, [
        ("기술", FAILED, 0.0, 0.0), ("무관", "스포츠", 0.55, 0.08), ("노동조합 파업 임금", "기술개발", 0.9, 0.5), ("노동조합 파업 임금", "스포츠", 0.9, 0.5),
        ("파업", "스포츠", 0.3, 0.01), ("연구", "스포츠", 0.45, 0.2), ("아무것도", "스포츠", 0.3, 0.2), ("아무것도", "스포츠", 0.52, 0.06), ("연구 시장", "스포츠", 0.3, 0.01), ("연구 개발 시장 산업", "스포츠", 0.3, 0.01),
    ])
    assert (got[0]["final_label"], got[0]["rule_applied"], got[0]["rule_reason"]) == (FAILED, False, "모델 분류 실패")
    assert got[1]["final_label"] == "스포츠" and got[1]["rule_reason"] == ""
    assert got[2]["final_label"] == "노동/노사" and got[2]["rule_reason"].startswith("기술개발 편향 보정: 노동/노사 규칙 점수 5, 근거 3개")
    assert got[3]["final_label"] == "스포츠" and got[4]["rule_reason"] == "규칙 보정: 노동/노사 규칙 점수 2, 근거 1개, 2위 대비 +2 (파업)"
    assert [got[i]["final_label"] for i in (5, 6, 7)] == [REVIEW, REVIEW, "스포츠"]
    assert got[5]["rule_reason"].startswith("규칙 점수 부족: 최고 1점") and got[6]["rule_reason"].startswith("근거 없음")
    assert got[8]["rule_reason"].startswith("규칙 점수 부족") and got[9]["rule_reason"].startswith("주제 간 점수 차이 부족: 2 대 2")


def test_conflict_and_unrelated(spark):
    base = [{"label": "x", "phrase": "alpha", "strength": 2}, {"label": "y", "phrase": "beta", "strength": 2, "origin": "development", "evidence_event_ids": ["e1", "e2"]}, {"label": "y", "phrase": "gamma"}]
    rs = RuleSet.of(base, labels=("x", "y", "other"), tie_priority={"x": 1, "y": 2}, other_label="other", technology_label="x", unrelated_groups=(("ball",), ("song",)), domain_terms=("chip",))
    got = decided(spark, rs, [("alpha beta gamma", "x", 0.3, 0.0), ("ball song alpha", "x", 0.9, 0.5), ("ball song chip alpha", "x", 0.3, 0.0)])
    assert got[0]["final_label"] == REVIEW and got[0]["rule_reason"].startswith("주제 근거 충돌: y, x")
    assert got[1]["final_label"] == "other" and got[1]["rule_applied"] and got[2]["final_label"] == "x"


def test_anchor_holds_a_body_only_match(spark):
    rs = topics()
    df = spark.createDataFrame([(1, "제목", "", "첫 문장. 둘째 문장. 파업 노동조합 교섭.")], "i long, title string, description string, content string")
    out = decide.with_anchor(rules.rank_articles(df, rs), rs).withColumns({"pred_label": F.lit("스포츠"), "pred_score": F.lit(0.3), "pred_margin": F.lit(0.0)})
    r = out.select(decide.decision(rs).alias("a"), decide.decision(rs, anchored=F.col("anchored")).alias("b")).first()
    assert r["a"]["final_label"] == "노동/노사" and r["b"]["final_label"] == REVIEW


def test_relaxed_policy_says_why(spark):
    rs = topics()
    df = spark.createDataFrame([("무관", "스포츠", 0.42, 0.03, "")], "t string, pred_label string, pred_score double, pred_margin double, content string")
    out = rules.rank(df.withColumn("rule_text", F.col("t")), F.col("rule_text"), rs)
    relaxed = Policy(ambiguity_score=0.41, ambiguity_margin=0.02, review_model_score=0.40)
    r = out.select(decide.post_processed(rs, relaxed, "without_body").alias("a"), decide.post_processed(rs, relaxed, "with_body").alias("b")).first()
    assert r["a"]["final_label"] == "스포츠" and r["a"]["rule_reason"].startswith("검증된 공통 판정 기준") and r["b"]["final_label"] == REVIEW


@pytest.mark.parametrize("change", [
    {"labels": ("x", "x", "other")}, {"other_label": "z"}, {"technology_label": "z"}, {"version": " "}, {"tie_priority": {"x": 1, "y": 1}}, {"domain_terms": ()}, {"unrelated_groups": ((),)},
    {"policy": Policy(min_rule_score=0)}, {"policy": Policy(ambiguity_score=0.9)}, {"policy": Policy(review_model_score=0.6)}, {"min_evidence_events": 0},
])
def test_bad_rule_sets_are_refused(change):
    with pytest.raises(ValueError):
        from dataclasses import replace

        validate(replace(mini(), **change))


def test_bad_terms_are_refused():
    for extra in ({"label": "y", "phrase": "ALPHA"}, {"label": "y", "phrase": "costos"}, {"label": "x", "phrase": " "}, {"label": "x", "phrase": "n", "strength": 3}, {"label": "x", "phrase": "n", "origin": "development"}):
        with pytest.raises(ValueError):
            from dataclasses import replace

            validate(replace(mini(), terms=(*mini().terms, Term(**extra))))
    with pytest.raises(ValueError):
        proposals([{"label": "x"}])
    assert mini().fingerprint() == mini().fingerprint() and len(phrase_pattern("ai 반도체")) > 3 and normalized(" ＡＩ&amp; ") == "ai&"
