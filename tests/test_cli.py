"""The command line on landed feeds and small reviewed datasets, with a rule set and a classifier that need no model."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from newsloom import cli
from newsloom.functions import text as T
from newsloom.operators import governance, pipeline, predict, profiles, reports, ruleset
from newsloom.plans import articles as A
from newsloom.sources import feeds

SENTENCES = {
    "en": "The council said that the harbour of the town was for this", "fr": "Le conseil dans les rues avec une ville que les gens", "de": "Der Rat sagt nicht zu und die Stadt ist sich mit ein",
    "es": "El consejo para los barrios como las calles del puerto en la", "other": "Lorem ipsum dolor sit amet consectetur",
}
NAMES = ["id", "event_id", "split", "keyword", "title", "link", "source", "published_at", "description", "content", "gold_label", "review_status", "reviewed_by", "suggested_label", "independent_event_check", "main_event", "main_event_evidence"]


def by_words():
    return lambda df: predict.by_shares(df, F.lower(T.squeezed(pipeline.INPUT)), A.MODEL_WORDS)


def broken():
    return predict.batched(lambda: (lambda texts: 1 / 0), pipeline.INPUT)


def case(split, label, n, **changes):
    row = dict.fromkeys(NAMES, "") | {
        "id": f"{split}-{label}-{n}", "event_id": f"{split}-{label}-{n}", "split": split, "keyword": f"{split} {n % 2}", "title": f"{SENTENCES[label]} {n}", "link": f"https://p.example/{split}/{label}/{n}",
        "source": "Paper", "gold_label": label, "review_status": "confirmed", "reviewed_by": "r", "independent_event_check": "confirmed", "main_event": "x", "main_event_evidence": "y",
    }
    return row | changes


def write(path, rows):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.DictWriter(f, NAMES)
        out.writeheader()
        out.writerows(rows)
    return str(path)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    records = [{"label": label, "phrase": p, "strength": s} for label, terms in A.TERMS.items() for p, s in terms.items()]
    (d / "rules.json").write_text(json.dumps({"rules": records, "labels": A.LABELS, "tie_priority": A.PRIORITY, "other_label": "other", "technology_label": "en", "domain_terms": ["the", "les", "der", "los"]}))
    assert ruleset.load(str(d / "rules.json")).fingerprint() == A.rule_set().fingerprint()
    write(d / "cases.csv", [case(s, x, n) for s in ("development", "evaluation") for x in A.LABELS for n in range(2)])
    item = "<item><title>{} {}</title><link>https://p.example/{}</link><pubDate>Mon, 0{} Jan 2024 00:00:00 GMT</pubDate><source>Paper</source></item>"
    for name in ("harbour", "town"):
        (d / "feeds" / name).mkdir(parents=True)
        (d / "feeds" / name / "a.xml").write_text("<rss><channel>" + "".join(item.format(t, name, f"{name}{i}", i + 1) for i, t in enumerate(SENTENCES.values())) + "</channel></rss>")
    spark.createDataFrame([(f"https://p.example/harbour{i}", "<article><p>" + f"{t}. " * 9 + "</p></article>") for i, t in enumerate(SENTENCES.values())], "url string, html string").write.parquet(str(d / "pages"))
    return d


def run(files, command, *options, model="tests.test_cli:by_words", rules=True):
    extra = (["--rules", str(files / "rules.json")] if rules else []) + (["--classifier", model] if model else [])
    return cli.main([command, *extra, *map(str, options)])


def test_options_are_checked(files, capsys):
    for wrong in ([], ["collect", "--limit", "0"], ["collect", "--limit", "101"], ["collect", "--limit", "x"], ["evaluate"], ["nothing"]):
        with pytest.raises(SystemExit) as e:
            cli.main(wrong)
        assert e.value.code == 2
    assert cli.main(["collect", "--keyword", "  "]) == 1 and cli.main(["collect", "--keyword", "a"]) == 1
    assert run(files, "collect", "--keyword", "a", model=None) == 1


def test_collect_writes_results_store_and_summary(spark, files, tmp_path, capsys):
    to = ("--csv", tmp_path / "r.csv", "--store", tmp_path / "store", "--feeds", files / "feeds" / "harbour", "--pages", files / "pages")
    assert run(files, "collect", "--keyword", "harbour", *to) == 0
    assert "Pipeline status: SUCCESS" in (told := capsys.readouterr().out) and "collected | 5" in told
    with open(tmp_path / "r.csv", encoding="utf-8-sig", newline="") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == feeds.RESULT and len(rows) == 5 and {r["final_category"] for r in rows} >= {"en", "fr", "de", "es"}
    assert [r["published_at"] for r in rows] == sorted((r["published_at"] for r in rows), reverse=True)
    assert spark.read.parquet(str(tmp_path / "store" / (tmp_path / "store" / "CURRENT").read_text())).count() == 5
    assert cli.main(["dashboard", "--csv", str(tmp_path / "r.csv"), "--category", "en"]) == 0
    assert "| 1 | 1 |" in (shown := capsys.readouterr().out) and SENTENCES["fr"] not in shown
    for command, name in (("audit-reasons", "reasons.json"), ("compare-body", "body.json")):
        options = [command, "--input", str(tmp_path / "r.csv"), "--output", str(tmp_path / name)]
        assert cli.main(options) == 0 and cli.main(options) == 1  # a report is never overwritten
    assert json.loads((tmp_path / "body.json").read_text())["total"] == 5


def test_nothing_is_saved_where_the_model_fails(files, tmp_path, capsys):
    to = ("--csv", tmp_path / "r.csv", "--feeds", files / "feeds" / "harbour", "--no-review-enrichment")
    assert run(files, "collect", "--keyword", "harbour", *to, model="tests.test_cli:broken") == 1
    assert "MODEL_ERROR" in capsys.readouterr().out and not (tmp_path / "r.csv").exists()


def test_no_articles_give_a_file_with_a_header(files, tmp_path, capsys):
    (tmp_path / "none.xml").write_text("<rss><channel></channel></rss>")
    assert run(files, "collect", "--keyword", "a", "--feeds", tmp_path / "none.xml", "--csv", tmp_path / "r.csv", "--no-review-enrichment") == 0
    assert "NO_RESULTS" in capsys.readouterr().out and (tmp_path / "r.csv").read_text("utf-8-sig").strip() == ",".join(feeds.RESULT)


def test_evaluate_reports_every_method(files, tmp_path):
    assert run(files, "evaluate", "--dataset", files / "cases.csv", "--output-dir", tmp_path, "--compare-legacy", "--compare-short-labels", "tests.test_cli:by_words", "--require-independent-events") == 0
    r = json.loads((tmp_path / "evaluation_results.json").read_text())
    assert set(r["reports"]) == {"model", "rules", "hybrid", "hybrid_before_rules", "legacy", "short_labels"} and r["reports"]["model"] | {"confusion": 0} == r["reports"]["short_labels"] | {"confusion": 0}
    assert r["reports"]["hybrid"]["total"] == 10 and [c["label"] for c in r["reports"]["hybrid"]["per_category"]] == A.LABELS and r["unseen_keywords_validated"]
    cases = [json.loads(x) for x in (tmp_path / "evaluation_cases.jsonl").read_text().splitlines()]
    right = sum(c["hybrid_label"] == c["gold_label"] for c in cases)
    assert len(cases) == 10 and r["reports"]["hybrid"]["accuracy"] == pytest.approx(right / 10)
    assert r["rule_review_validation"]["failures"] and "## Hybrid by keyword" in (tmp_path / "evaluation_report.md").read_text()


def test_datasets_that_are_not_ready_are_refused(files, tmp_path):
    both = write(tmp_path / "leak.csv", [case(s, x, n, event_id=f"{x}{n}") for s in ("development", "evaluation") for x in A.LABELS for n in range(2)])
    assert run(files, "evaluate", "--dataset", both, "--output-dir", tmp_path / "o", "--require-independent-events") == 1 and not (tmp_path / "o").exists()
    seen = write(tmp_path / "seen.csv", [case(s, x, n, keyword="same") for s in ("development", "evaluation") for x in A.LABELS for n in range(2)])
    assert run(files, "evaluate", "--dataset", seen, "--output-dir", tmp_path / "o", "--require-unseen-keywords") == 1
    open_ = write(tmp_path / "open.csv", [case("development", "en", n, review_status="pending" if n > 2 else "confirmed") for n in range(20)])
    assert run(files, "check-review", "--dataset", open_, "--report", tmp_path / "r.json", model=None) == 1
    r = json.loads((tmp_path / "r.json").read_text())
    assert (r["articles_requiring_completion"], r["incomplete_fields"], len(r["pending_article_ids_preview"])) == (17, {"confirmed_gold": 17}, 10)
    assert r["labels_needing_more_events"]["development"] == ["fr", "de", "es", "other"] and r["independent_events_per_label"]["development"]["en"] == 3
    assert run(files, "check-review", "--dataset", files / "cases.csv", model=None) == 0


def test_review_sheets_hold_no_predictions(files, tmp_path):
    with open(tmp_path / "c.json", "w") as f:
        json.dump({"dataset_role": "development", "cases": [case("development", "en", 0) | {"gold_label": "fr"}]}, f)
    rows = [case("", "en", n, gold_label="", review_status="", link="https://p.example/development/en/0" if not n else f"https://p.example/{n}") for n in range(3)]
    assert run(files, "prepare-review", "--dataset", write(tmp_path / "in.csv", rows), "--confirmed-json", tmp_path / "c.json", "--output", tmp_path / "out.csv", model=None) == 0
    with open(tmp_path / "out.csv", encoding="utf-8-sig", newline="") as f:
        got = {r["link"]: r for r in csv.DictReader(f)}
    assert len(got) == 3 and got["https://p.example/development/en/0"]["gold_label"] == "fr" and got["https://p.example/1"]["review_status"] == "pending"
    assert not json.loads((tmp_path / "out.readiness.json").read_text())["ready"]
    assert run(files, "prepare-review", "--dataset", tmp_path / "in.csv", "--output", tmp_path / "out.csv", model=None) == 1


def test_candidates_are_collected_in_turn_and_audited(spark, files, tmp_path):
    assert run(files, "collect-evaluation", "--feeds", files / "feeds", "--query", "harbour", "--query", "town", "--target-total", 3, "--output", tmp_path / "c", model=None, rules=False) == 0
    got = spark.read.csv(str(tmp_path / "c"), header=True)
    assert [r["keyword"] for r in got.collect()] == ["harbour", "town", "harbour"]
    dev = write(tmp_path / "dev.csv", [case("development", x, n) for x in ("en", "fr") for n in range(3)])
    assert run(files, "review-candidates", "--dataset", dev, "--output", tmp_path / "a.json", "--candidate", "en:harbour", "--candidate", "en: les gens", model=None) == 0
    a, b = json.loads((tmp_path / "a.json").read_text())["candidates"]
    assert (a["articles"], a["confirmed_rows"], a["events"], a["relations"], a["other_gold"]) == (3, 3, 3, [], {})
    assert b["other_gold"] == {"fr": 3} and {"category": "fr", "phrase": "les", "relation": "phrase_overlap", "conflict": True} in b["relations"]
    assert run(files, "review-candidates", "--dataset", files / "cases.csv", "--output", tmp_path / "b.json", "--candidate", "en:harbour", model=None) == 1
    for wrong in ("other:x", "en:", "harbour"):
        assert run(files, "review-candidates", "--dataset", dev, "--output", tmp_path / "b.json", "--candidate", wrong, model=None) == 1


def test_confidence_is_calibrated_and_bound_to_rules_and_model(files, tmp_path):
    many = write(tmp_path / "many.csv", [case("development", x, n) for x in A.LABELS for n in range(12)])
    out = tmp_path / "p" / "c.json"
    options = ("--dataset", many, "--output", out, "--minimum-support", 10, "--high-lower-bound", 0.7, "--medium-lower-bound", 0.1)
    assert run(files, "calibrate-confidence", *options) == 0 and run(files, "calibrate-confidence", *options) == 1  # the second needs --force
    p = json.loads(out.read_text())
    assert p["evidence"]["high_support"] >= 10 and p["thresholds"]["high_score"] >= p["thresholds"]["medium_score"]
    (tmp_path / "made.json").write_text(json.dumps({"schema_version": 1, "bindings": governance.bindings(A.rule_set(), "tests.test_cli:by_words"), "thresholds": {"high_score": 0.9, "high_margin": 0.9, "medium_score": 0.0, "medium_margin": 0.0}}))
    to = ("--keyword", "h", "--feeds", files / "feeds" / "harbour", "--no-review-enrichment", "--csv")
    assert run(files, "collect", *to, tmp_path / "r.csv", "--confidence-profile", tmp_path / "made.json") == 0
    with open(tmp_path / "r.csv", encoding="utf-8-sig", newline="") as f:
        for r in csv.DictReader(f):
            assert (r["model_confidence_level"] == "높음") == (float(r["model_category_score"]) >= 0.9 and float(r["score_margin"]) >= 0.9) and r["model_confidence_level"] != "낮음"
    (tmp_path / "made.json").write_text((tmp_path / "made.json").read_text().replace("by_words", "other"))
    assert run(files, "collect", *to, tmp_path / "s.csv", "--confidence-profile", tmp_path / "made.json") == 1 and not (tmp_path / "s.csv").exists()


def test_decisions_without_evidence_keep_the_policy(files, tmp_path):
    assert run(files, "calibrate-decision", "--dataset", files / "cases.csv", "--output", tmp_path / "d.json", "--minimum-support", 2, "--accuracy-lower-bound", 0.6) == 1 and not (tmp_path / "d.json").exists()
    assert run(files, "calibrate-decision", "--dataset", files / "cases.csv", "--output", tmp_path / "d.json", "--minimum-support", 1) == 1


def test_context_comparison_counts_what_changed(files, tmp_path):
    assert run(files, "compare-context", "--dataset", files / "cases.csv", "--output", tmp_path / "c.json") == 0
    r = json.loads((tmp_path / "c.json").read_text())
    assert r["total"] == 10 and r["changed"] == len(r["cases"])


# --- rule profiles ----------------------------------------------------------------------------------

RECORD = {"category": "en", "phrase": "harbour town", "strength": "WEAK", "evidence_event_ids": ["a", "b"]}
RESULT = {
    "status": "passed", "passed": True, "failures": [], "newly_automatic_count": 2, "newly_automatic_independent_events": 2, "newly_automatic_wrong_count": 0, "new_wrong_decision_count": 0, "previous_correct_harmed_count": 0,
    "baseline": {"total": 9, "review_count": 4, "automatic_count": 5, "wrong_automatic_count": 0}, "selected": {"total": 9, "review_count": 2, "automatic_count": 7, "wrong_automatic_count": 0},
    "per_rule_holdout": {"passed": True, "terms": [{"category": "en", "phrase": "harbour town", "passed": True, "correct_rule_independent_events": 2, "wrong_rule_count": 0}]},
}


def test_rule_profiles_round_trip(tmp_path):
    base = A.rule_set()
    rules = profiles.extended(base, [RECORD])
    assert profiles.records(rules) == [RECORD] and rules.baseline().fingerprint() == base.fingerprint()
    bound = governance.bindings(base, "m")
    governance.write_new_json(str(tmp_path / "p.json"), profiles.rule_profile(rules, RESULT, bound, "0" * 64))
    assert profiles.load_rule_profile(str(tmp_path / "p.json"), base, bound) == rules and profiles.load_rule_profile("", base, bound) is base
    with pytest.raises(governance.Rejected):
        profiles.load_rule_profile(str(tmp_path / "p.json"), base, governance.bindings(base, "other"))
    with pytest.raises(governance.Rejected):
        profiles.read_proposals(str(tmp_path / "p.json"), base)
    (tmp_path / "q.json").write_text(json.dumps({"schema_version": 1, "profile_type": profiles.PROPOSALS, "rules": [RECORD]}))
    assert profiles.read_proposals(str(tmp_path / "q.json"), base) == rules
    with pytest.raises(governance.Rejected):
        profiles.load_rule_profile(str(tmp_path / "q.json"), base, bound)


@pytest.mark.parametrize("change", [
    {"status": "failed"}, {"passed": 1.0}, {"failures": ["x"]}, {"newly_automatic_count": 1}, {"newly_automatic_independent_events": 3}, {"newly_automatic_wrong_count": 1}, {"previous_correct_harmed_count": False},
    {"baseline": None}, {"baseline": RESULT["selected"]}, {"selected": RESULT["selected"] | {"total": 8}}, {"selected": RESULT["selected"] | {"wrong_automatic_count": 8}}, {"per_rule_holdout": {"passed": True, "terms": []}},
    {"per_rule_holdout": {"passed": True, "terms": RESULT["per_rule_holdout"]["terms"] * 2}}, {"per_rule_holdout": {"passed": True, "terms": [RESULT["per_rule_holdout"]["terms"][0] | {"wrong_rule_count": 1}]}},
])
def test_results_that_do_not_carry_a_profile(change):
    assert not profiles.result_problems(RESULT, [("en", "harbour town")], 2)
    if change == {"passed": 1.0}:
        change = {"passed": 0}
    assert profiles.result_problems(RESULT | change, [("en", "harbour town")], 2)


@pytest.mark.parametrize("change", [{"category": "other"}, {"category": "x"}, {"phrase": " "}, {"phrase": None}, {"strength": 2}, {"strength": "MIDDLE"}, {"evidence_event_ids": ["a"]}, {"evidence_event_ids": "ab"}, {"more": 1}])
def test_records_that_are_no_rules(change):
    with pytest.raises(ValueError):
        profiles.extended(A.rule_set(), [RECORD | change])


def test_new_rules_are_validated_on_the_review(spark):
    rules = profiles.extended(A.rule_set(), [RECORD | {"phrase": "quay", "strength": "STRONG"}])
    df = spark.createDataFrame([tuple(case("evaluation", "en", n, title=f"Ferry at quay number {n}").values()) for n in range(3)] + [tuple(case("evaluation", "fr", 0).values())], ", ".join(f"{c} string" for c in NAMES))
    rows = reports.judged(df, rules, by_words())
    v = reports.review_validation(rows, rules)
    assert v["passed"] and (v["newly_automatic_count"], v["newly_automatic_independent_events"]) == (3, 3) and v["baseline"]["review_count"] == v["selected"]["review_count"] + 3
    assert not profiles.result_problems(v, [("en", "quay")], 2)
    v = reports.review_validation(rows.withColumn("gold", F.lit("fr")).withColumn("gold_label", F.lit("fr")), rules)
    assert not v["passed"] and v["newly_automatic_wrong_count"] == 3


def test_zero_shot_asks_by_description():
    asked = {}

    def model(sequences, candidate_labels, hypothesis_template, multi_label, batch_size):
        asked.update(labels=candidate_labels, template=hypothesis_template, multi=multi_label)
        return [{"labels": candidate_labels[::-1], "scores": [0.7, 0.3]} for _ in sequences]

    assert predict.zero_shot(lambda: model, ["a", "b"], {"a": "about a"})()(["x"]) == [{"b": 0.7, "a": 0.3}]
    assert asked == {"labels": ["about a", "b"], "template": predict.HYPOTHESIS, "multi": False}
    assert predict.zero_shot(lambda: model, ["a", "b"])()(["x"]) and asked["labels"] == ["a", "b"]
    for labels, described in (([], {}), (["a", "a"], {}), (["a", "b"], {"a": "b"}), (["a", "b"], {"a": " "})):
        with pytest.raises(ValueError):
            predict.zero_shot(lambda: model, labels, described)
