"""Many phrases at once, spans near one another, phrases inside phrases: against plain loops."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from newsloom.operators import audit, rules
from newsloom.operators.ruleset import normalized, phrase_pattern

PIECES = ["ai", "관련주", "관련", "주", "시장", "점유율", "cost", "os", "a", "aa", "b2", "투자"]


def some_phrases(r, n):
    return sorted({normalized(r.choice(["", " "]).join(r.choices(PIECES, k=r.randint(1, 4)))) for _ in range(n)})


def some_text(r, n):
    return "".join(r.choice(PIECES) + r.choice(["", "", " ", "  ", "\n", ".", "\u3000"]) for _ in range(n))


def test_automaton_equals_one_search_for_each_phrase():
    r = random.Random(3)
    phrases = some_phrases(r, 120)
    finder = rules.Automaton(phrases)
    for _ in range(300):
        text = some_text(r, r.randint(0, 40))
        assert finder.spans(text) == {i: found for i, p in enumerate(phrases) if (found := list(rules.Finder(p).spans(text)))}, text
    assert rules.Automaton([]).spans("a b") == {} and finder.spans(" \n") == {}


def test_ten_thousand_phrases_cost_what_a_hundred_do():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    phrases = [f"{word()} {word()}" for _ in range(10_000)]
    text = " ".join(r.choice(phrases) if i % 20 == 0 else word() for i in range(60_000))
    took = []
    for n in (100, 10_000):
        finder = rules.Automaton(phrases[:n])
        began = time.process_time()
        found = finder.spans(text)
        took.append(time.process_time() - began)
    assert len(found) > 2000 and took[1] < 5 * max(took[0], 0.02)  # every place found costs something; a search for each phrase would cost a hundred times as much


def test_spans_are_linear_and_whole(spark):
    text = "the x " * 20_000
    began = time.time()
    (row,) = spark.createDataFrame([(text,), (None,)], "t string").where("t is not null").select(rules.spans(F.col("t"), "the").alias("s")).collect()
    assert [(x["s"], x["e"]) for x in row["s"]] == [m.span() for m in re.finditer("the", text)] and time.time() - began < 60


def test_warnings_near_evidence(spark):
    r = random.Random(5)
    words = ["취소", "공장", "발표", "않았다", "시장"]
    texts = [" ".join(r.choices([*words, *["말"] * 30], k=k)) for k in (0, 5, 300, 300, 20_000)]  # the last one is hot
    df = spark.createDataFrame([(str(i), t, "") for i, t in enumerate(texts)] + [("5", "공장 취소", "취소")], "id string, content string, title string")
    evidence = audit.phrase_evidence(df, [("x", "공장"), ("y", "시장")], ["title", "content"], normalize=False)
    warnings = audit.phrase_evidence(df, [("cancellation", "취소"), ("denial", "않았다")], ["title", "content"], normalize=False)
    got = sorted(tuple(x) for x in audit.context_warnings(evidence, warnings).collect())
    want = set()
    rows = [(str(i), "content", t) for i, t in enumerate(texts)] + [("5", "content", "공장 취소"), ("5", "title", "취소")]
    for id_, field, t in rows:
        seen = {w: [m.span() for m in re.finditer(w, t)] for w in words}
        for kind, w in (("cancellation", "취소"), ("denial", "않았다")):
            for a, z in seen[w]:
                for p in ("공장", "시장"):
                    if any(z >= s - 120 and a <= e + 120 for s, e in seen[p]):
                        want.add((id_, field, p, kind, w, a, z))
    assert got == sorted(want) and len(got) > 100
    assert ("5", "content", "공장", "cancellation", "취소", 3, 5) in got
    assert audit.context_warnings(evidence.where("id = 'x'"), warnings).collect() == []


def test_excerpts_and_matches(spark):
    df = spark.createDataFrame([("1", "머리 " * 60 + "AI  관련주 급등" + " 꼬리" * 60)], "id string, content string")
    (x,) = audit.phrase_evidence(df, [("x", "ai 관련주")], ["content"]).collect()
    assert x["matched"] == "ai 관련주" and (x["start"], x["end"]) == (180, 186) and x["excerpt"].startswith("리 머리") and len(x["excerpt"]) == 166
    with pytest.raises(ValueError):
        audit.phrase_evidence(df, [("x", str(i)) for i in range(audit.MOST_PHRASES + 1)], ["content"])


def test_phrases_inside_phrases(spark):
    r = random.Random(6)
    left, right = ([(r.choice("xy"), p) for p in some_phrases(random.Random(s), 60)] for s in (1, 2))
    got = {tuple(x) for x in audit.phrase_relations(audit.phrase_table(spark, left), audit.phrase_table(spark, right)).collect()}
    want = set()
    for a, p in left:
        for b, q in right:
            if p.replace(" ", "") == q.replace(" ", ""):
                want.add((a, p, b, q, "spacing_alias"))
            elif re.search(phrase_pattern(q), p) or re.search(phrase_pattern(p), q):
                want.add((a, p, b, q, "phrase_overlap"))
    assert got == want and len({x[-1] for x in got}) == 2
    table = audit.phrases_of(spark.createDataFrame(left, "a string, b string"), "a", "b")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, audit.phrase_table(spark, left).collect()))


def test_few_phrases_of_one_literal_are_searched_for_one_by_one(monkeypatch):
    """With the same spans as from the trie, which then holds the others alone."""
    phrases = ["a", "ab", "aba", "a b", "가 b", "가a", "aa", "ba", "반도체", "b a b", "aa a"]
    few = rules.Automaton(phrases)
    assert len(few.trie) == 5 and sorted(few.few) == [0, 1, 2, 6, 7, 8]
    monkeypatch.setattr(rules, "FEW", 0)
    many, r = rules.Automaton(phrases), random.Random(4)
    assert not many.few
    for _ in range(2_000):
        text = "".join(r.choices("aabb 가\t .반도체", k=r.randint(0, 25)))
        assert few.spans(text) == many.spans(text)
