"""Reports: evaluation of methods on reviewed cases, readiness of a blind review, the tables of a dashboard, a run's summary.

All counts are aggregates; the driver gets numbers per label, keyword or method, never cases. Cases stream out line by line.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T

from . import audit, calibrate, decide, governance, metrics, pipeline, rules as R
from .ruleset import REVIEW, RuleSet, normalized

Classifier = Callable[[DataFrame], DataFrame]
MODEL, RULES, HYBRID, BEFORE, LEGACY, SHORT = "model", "rules", "hybrid", "hybrid_before_rules", "legacy", "short_labels"
CASE = ["id", "event_id", "gold_label", "keyword"]


# --- evaluation -------------------------------------------------------------------------------------


def _decided(df: DataFrame, rules: RuleSet, name: str) -> DataFrame:
    """df with one column more: the final label under other rules. Their ranking is dropped again."""
    out = R.rank_articles(df, rules).withColumn(name, decide.decision(rules)["final_label"])
    return out.drop("rule_text", "hits", "ranking", "rule_margin", "tied_labels")


def judged(cases: DataFrame, rules: RuleSet, classifier: Classifier, legacy: bool = False, short: Classifier | None = None) -> DataFrame:
    """Reviewed cases with a label by each method: model, rules, hybrid, hybrid_before_rules (no development terms), and if asked for legacy, short_labels."""
    out = classifier(pipeline.with_input(cases))
    if short is not None:
        marks = [c for c in out.columns if c.startswith("pred_")]
        kept = out.withColumnsRenamed({c: f"first_{c}" for c in marks})
        out = short(kept).withColumn(SHORT, F.col("pred_label")).drop(*marks).withColumnsRenamed({f"first_{c}": c for c in marks})
    out = out.withColumn("has_body", T.squeezed("content") != "").withColumn("description", T.article_description("title", "description", "source"))
    out = _decided(out, rules.baseline(), BEFORE)
    if legacy:
        out = _decided(out, rules.legacy(), LEGACY)
    out = R.rank_articles(out, rules)
    out = out.withColumn("decision", decide.decision(rules))
    return out.withColumns({MODEL: F.col("pred_label"), RULES: decide.rule_only(out, rules), HYBRID: F.col("decision.final_label"), "gold": F.col("gold_label")})


def methods(rows: DataFrame) -> list[str]:
    return [m for m in (MODEL, RULES, HYBRID, BEFORE, LEGACY, SHORT) if m in rows.columns]


def by_method(rows: DataFrame) -> DataFrame:
    """gold, keyword, method, pred: one row per case and method."""
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("pred")) for m in methods(rows)])
    return rows.select("gold", "keyword", F.explode(each).alias("m")).select("gold", "keyword", "m.method", "m.pred")


def holdout(rows: DataFrame, rules: RuleSet) -> dict:
    """For each development phrase: independent events that it got right, rows that it got wrong; passed if all have enough and none is wrong."""
    terms = [(t.label, t.phrase) for t in rules.terms if t.origin == "development"]
    if not terms:
        return {"passed": True, "terms": []}
    seen = {(r["label"], r["phrase"]): r for r in audit.rule_holdout(rows.select("hits", "gold_label", "decision.final_label", "decision.rule_applied", "event_id"), terms).collect()}
    out = []
    for label, phrase in terms:
        r = seen.get((label, normalized(phrase)))
        right, wrong = (r["correct_events"], r["wrong_rows"]) if r else (0, 0)
        out.append({"category": label, "phrase": phrase, "correct_rule_independent_events": right, "wrong_rule_count": wrong, "passed": right >= rules.min_evidence_events and not wrong})
    return {"passed": all(t["passed"] for t in out), "terms": out}


def review_validation(rows: DataFrame, rules: RuleSet) -> dict:
    """Whether development phrases shrink the review without a wrong or harmed decision, in the form that a rule profile carries."""
    labels = list(rules.labels)
    pairs = rows.select("gold", "event_id", F.col(BEFORE).alias("before"), F.col(HYBRID).alias("after"))
    r = audit.review_reduction(pairs, labels).first()

    def stage(c: str) -> list[Column]:
        done = F.col(c).isin(labels)
        return [F.count_if(F.col(c) == REVIEW).alias(f"{c}_review"), F.count_if(done).alias(f"{c}_automatic"), F.count_if(done & (F.col(c) != F.col("gold"))).alias(f"{c}_wrong")]

    s = pairs.agg(*stage("before"), *stage("after")).first()
    before, after = ({"total": r["total"], "review_count": s[f"{c}_review"], "automatic_count": s[f"{c}_automatic"], "wrong_automatic_count": s[f"{c}_wrong"]} for c in ("before", "after"))
    held = holdout(rows, rules)
    least = rules.min_evidence_events
    checks = {
        "no development phrase": bool(held["terms"]), "too few new automatic decisions": r["newly_automatic"] >= least, "too few independent events": r["newly_events"] >= least, "new automatic decisions are wrong": not r["newly_wrong"],
        "new wrong decisions": not r["new_wrong_decisions"], "correct decisions were harmed": not r["harmed"], "the review did not get smaller": after["review_count"] < before["review_count"],
        "a phrase lacks held-out evidence": held["passed"],
    }
    failed = [name for name, ok in checks.items() if not ok]
    return {
        "status": "failed" if failed else "passed", "passed": not failed, "failures": failed, "newly_automatic_count": r["newly_automatic"], "newly_automatic_independent_events": r["newly_events"],
        "newly_automatic_wrong_count": r["newly_wrong"], "new_wrong_decision_count": r["new_wrong_decisions"], "previous_correct_harmed_count": r["harmed"], "baseline": before, "selected": after, "per_rule_holdout": held,
    }


def _plain(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def evaluation(rows: DataFrame, rules: RuleSet, facts: dict | None = None) -> dict:
    """The report of judged() rows as one JSON value; facts are added to it (dataset, split, model)."""
    labels = list(rules.labels)
    governance.require_none(metrics.unknown_gold(rows, labels), "unknown gold label")
    long = by_method(rows)
    totals = {r["method"]: r for r in _plain(metrics.overall(long, labels, ["method"]))}
    classes, cells = _plain(metrics.per_class(long, labels, ["method"])), {m: _plain(metrics.confusion(long.where(F.col("method") == m), labels).where("n > 0")) for m in totals}
    bias = {r.pop("method"): r for r in _plain(metrics.label_bias(long, rules.technology_label, ["method"]))}
    keywords = _plain(metrics.overall(long.where(F.col("method") == HYBRID), labels, ["keyword"]).join(metrics.label_bias(long.where(F.col("method") == HYBRID), rules.technology_label, ["keyword"]), "keyword").orderBy("keyword"))
    fixes = metrics.rule_corrections(rows.select("gold", F.col(MODEL).alias("model"), F.col(HYBRID).alias("pred"), F.col("decision.rule_applied").alias("applied"))).first().asDict()
    report = {
        name: {k: v for k, v in totals[name].items() if k != "method"}
        | {"per_category": [{k: v for k, v in c.items() if k != "method"} for c in sorted((c for c in classes if c["method"] == name), key=lambda c: labels.index(c["label"]))], "confusion": cells[name]}
        for name in methods(rows) if name in totals
    }
    return (facts or {}) | {
        "labels": labels, "include_keyword": False, "rule_policy": {"version": rules.version, "matcher_version": rules.matcher_version, "fingerprint_sha256": rules.fingerprint(), "decision": asdict(rules.policy)},
        "baseline_rule_fingerprint_sha256": rules.baseline().fingerprint(), "reports": report, "rule_corrections": fixes, "rule_review_validation": review_validation(rows, rules), "technology_bias": bias, "per_keyword": keywords,
    }


def case_records(rows: DataFrame) -> DataFrame:
    """One JSON line per case: what each method said, and on what evidence."""
    first, second = F.get("ranking", 0), F.get("ranking", 1)
    wrong = lambda c: F.col(c) != F.col("gold")
    return rows.select(F.to_json(F.struct(
        *CASE, *[F.col(m).alias(f"{m}_label") for m in methods(rows)], F.col("pred_score").alias("model_score"), F.col("pred_margin").alias("model_margin"), "has_body",
        first["label"].alias("rule_best_label"), first["score"].alias("rule_best_score"), first["strong"].alias("rule_strong_match_count"), second["label"].alias("rule_second_label"), second["score"].alias("rule_second_score"),
        F.col("rule_margin").alias("rule_score_margin"), first["terms"].alias("matched_rule_terms"), (~wrong(BEFORE) & wrong(HYBRID)).alias("previous_correct_harmed"), (wrong(BEFORE) & ~wrong(HYBRID)).alias("previous_wrong_corrected"),
        F.col("decision.rule_applied").alias("hybrid_rule_applied"), F.col("decision.rule_reason").alias("hybrid_reason"),
    ), {"ignoreNullFields": "false"}).alias("value"))


def cell(x: object) -> str:
    return str(x).replace("|", "\\|").replace("\n", " ")


def evaluation_markdown(report: dict) -> str:
    names = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "coverage", "decided_accuracy", "review_rate", "error_count", "total"]
    parts = ["# Evaluation\n", metrics.markdown([(m, *[r[n] for n in names]) for m, r in report["reports"].items()], ["method", *names])]
    for m, r in report["reports"].items():
        parts += [f"## {m} by category\n", metrics.markdown([tuple(cell(v) if isinstance(v, str) else v for v in (c["label"], c["precision"], c["recall"], c["f1"], c["support"])) for c in r["per_category"]], ["category", "precision", "recall", "f1", "support"])]
    parts += ["## What rules changed\n", metrics.markdown(list(report["rule_corrections"].items()), ["count", "value"])]
    v = report["rule_review_validation"]
    parts += ["## New rules on the review\n", f"Status: {v['status']}; {v['newly_automatic_count']} newly automatic, {v['newly_automatic_wrong_count']} of them wrong, {v['previous_correct_harmed_count']} correct ones harmed."]
    parts += ["Open: " + "; ".join(v["failures"])] if v["failures"] else []
    parts += ["No rule is activated by this report; few cases say little about the accuracy to come.\n", "## Taken for technology\n"]
    parts += [metrics.markdown([(m, b["other_support"], b["false_positive_count"], b["false_positive_rate"]) for m, b in report["technology_bias"].items()], ["method", "other topics", "taken", "rate"])]
    parts += ["## Hybrid by keyword\n", metrics.markdown([(cell(k["keyword"]), k["total"], k["accuracy"], k["review_rate"], k["other_support"], k["false_positive_count"]) for k in report["per_keyword"]], ["keyword", "cases", "accuracy", "review rate", "other topics", "taken for technology"])]
    return "\n".join(parts)


def write_evaluation(rows: DataFrame, rules: RuleSet, folder: str, facts: dict | None = None) -> dict:
    """evaluation_results.json, evaluation_report.md and evaluation_cases.jsonl in folder, each replaced as a whole."""
    os.makedirs(folder, exist_ok=True)
    report = evaluation(rows, rules, facts)
    governance.replace_json(os.path.join(folder, "evaluation_results.json"), report)
    governance.replace_text(os.path.join(folder, "evaluation_report.md"), [evaluation_markdown(report)])
    governance.replace_text(os.path.join(folder, "evaluation_cases.jsonl"), (r["value"] + "\n" for r in case_records(rows).toLocalIterator()))
    return report


# --- readiness --------------------------------------------------------------------------------------


def readiness_report(df: DataFrame, labels: list[str], least_events: int = 2, shown: int = 10) -> dict:
    """Counts of a review's open work, and whether it can be evaluated: rows complete, splits apart, enough events for each label."""
    rows = audit.with_readiness(df, labels)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("ready").alias("ready"), F.count_if(~F.array_contains("missing", "confirmed_gold")).alias("confirmed")).first()
    missing, events = audit.readiness(df, labels)
    counts = {s: dict.fromkeys(labels, 0) for s in audit.SPLITS}
    for r in events.collect():
        counts[r["split"]][r["gold_label"]] = r["events"]
    few = {s: [x for x in labels if counts[s][x] < least_events] for s in audit.SPLITS}
    keys = {"events": calibrate.event_key(), "article_links": F.trim(F.coalesce("link", F.lit(""))), "keywords": T.normalize_key("keyword")}
    crossing = {f"{k}_crossing_splits": audit.crossing(df, c).count() for k, c in keys.items()}
    pending = [r["case_id"] for r in rows.where("not ready").select("case_id").orderBy("case_id").limit(shown).collect()]
    ready = total["n"] > 0 and total["ready"] == total["n"] and not any(crossing.values()) and not any(few.values())
    return {
        "schema_version": 1, "status": "ready_for_evaluation" if ready else "awaiting_review", "ready": ready, "independent_evaluation_completed": False, "article_count": total["n"], "confirmed_gold_count": total["confirmed"],
        "ready_article_count": total["ready"], "articles_requiring_completion": total["n"] - total["ready"], "incomplete_fields": {r["field"]: r["n"] for r in missing.orderBy("field").collect()},
        "pending_article_ids_preview": pending, **crossing, "minimum_independent_events_per_label": least_events, "independent_events_per_label": counts, "labels_needing_more_events": few, "labels": labels,
    }


def require_ready(df: DataFrame, labels: list[str], least_events: int = 2) -> dict:
    report = readiness_report(df, labels, least_events)
    if not report["ready"]:
        raise governance.Rejected(f"the review is not complete: {report['incomplete_fields']}, {report['labels_needing_more_events']}")
    return report


# --- stored results ---------------------------------------------------------------------------------

SHOWN = [
    "title", "source", "group_article_count", "model_category", "model_confidence", "model_confidence_level", "final_category", "decision_source", "final_decision_status", "review_required", "rule_reason", "published_at", "link",
]


def dashboard(results: DataFrame, categories: list[str] | None = None) -> dict[str, DataFrame]:
    """totals (one row), categories, articles, groups of stored results, which may be older and lack columns; categories: the chosen ones, none for all."""
    have = set(results.columns)
    rows = results.where(F.col("final_category").isin(categories)) if categories and "final_category" in have else results
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    totals = rows.agg(
        F.coalesce(F.sum(metrics.original_articles(col("group_article_count"))), F.lit(0)).alias("collected"), F.count(F.lit(1)).alias("representatives"),
        F.count_if(col("decision_source") == "RULE").alias("by_rule"), F.count_if(F.lower(col("review_required")).isin("true", "1", "y")).alias("review_required"),
    )
    kinds = metrics.category_counts(rows.where("final_category is not null"), "final_category") if "final_category" in have else rows.sparkSession.createDataFrame([], "final_category string, n long")
    refs = ("title", "source", "published_at", "link", "related_articles")
    return {"totals": totals, "categories": kinds, "articles": rows.select(*([c for c in SHOWN if c in have] or ["*"])), "groups": audit.exploded_groups(rows.select(*[col(c).alias(c) for c in refs]))}


def summary_markdown(results: DataFrame) -> str:
    """A run's summary of stored result rows."""
    flat = results.select("group_article_count", F.col("model_confidence_level").alias("confidence"), (F.col("rule_applied") == "Y").alias("applied"), F.col("final_category").alias("final_label"))
    numbers = metrics.summary(flat).first().asDict()
    kinds = [(cell(r["final_category"]), r["n"]) for r in metrics.category_counts(results, "final_category").orderBy(F.desc("n"), "final_category").collect()]
    return "# Summary\n\n" + metrics.markdown(list(numbers.items()), ["count", "articles"]) + "\n" + metrics.markdown(kinds, ["category", "articles"])


def probabilities_low(df: DataFrame, score: float, margin: float) -> dict:
    """The metrics of stored scores and margins."""
    return {c: audit.metric(df, c, least).first().asDict() for c, least in (("model_category_score", score), ("score_margin", margin)) if c in df.columns}


def context_comparison(rows: DataFrame) -> DataFrame:
    """Each case whose decision differs without and with an experiment (columns before, after, gold), with what that means."""
    before, after, gold = F.col("before"), F.col("after"), F.col("gold")
    return rows.where(before != after).withColumns({
        "harmed": (before == gold) & (after != gold), "corrected": (before != gold) & (after == gold), "wrong_automatic_to_review": (before != gold) & (before != REVIEW) & (after == REVIEW),
    })
