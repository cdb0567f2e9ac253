"""Gates: what must hold before rules, cases, samples or profiles are used. Each check returns the rows that break it."""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile
from collections.abc import Iterable, Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import values as V

from . import calibrate
from .ruleset import REVIEW, Policy, RuleSet, normalized, validate

CASE_COLUMNS = ["id", "split", "keyword", "title", "description", "gold_label", "review_status", "reviewed_by"]


class Rejected(ValueError):
    """A gate's checks failed."""


def require_none(rows: DataFrame, message: str, shown: int = 5) -> None:
    """Raise with a few examples if there are rows."""
    some = rows.limit(shown).collect()
    if some:
        raise Rejected(f"{message}: {[tuple(r) for r in some]}")


def _value(c: str):
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def case_problems(df: DataFrame, split: str, labels: list[str], explicit_events: bool = False) -> dict[str, DataFrame]:
    """Offending rows of a reviewed dataset, by check; all must be empty. df has the CASE_COLUMNS as text, event_id and suggested_label."""
    event = F.when(calibrate.event_key() != "", calibrate.event_key()).otherwise(V.event_id("title"))
    rows = df.withColumn("event", event)
    in_split = rows.where(_value("split") == split)
    both = rows.where(_value("split").isin("development", "evaluation")).groupBy("event").agg(F.count_distinct(_value("split")).alias("n")).where("n > 1")
    spark = df.sparkSession
    out = {
        "duplicate or empty id": df.groupBy(_value("id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("id") == "")),
        "event in both splits": both, "not confirmed": in_split.where(_value("review_status") != "confirmed").select("id"), "no reviewer": in_split.where(_value("reviewed_by") == "").select("id"),
        "suggested label": in_split.where(_value("suggested_label") != "").select("id"), "invalid gold label": in_split.where(~F.coalesce(F.col("gold_label").isin(labels), F.lit(False))).select("id", "gold_label"),
        "label without a case": spark.createDataFrame([(x,) for x in labels], "gold_label string").join(in_split.select("gold_label").distinct(), "gold_label", "left_anti"),
    }
    if explicit_events:
        out["no explicit event"] = df.where(_value("split").isin("development", "evaluation") & (calibrate.event_key() == "")).select("id")
    return out


def require_cases(df: DataFrame, split: str, labels: list[str], explicit_events: bool = False) -> DataFrame:
    """The split's rows, if every check holds."""
    gone = [c for c in CASE_COLUMNS if c not in df.columns]
    if gone:
        raise Rejected(f"missing columns: {gone}")
    for c in ("event_id", "suggested_label"):
        df = df if c in df.columns else df.withColumn(c, F.lit(""))
    for name, rows in case_problems(df, split, labels, explicit_events).items():
        require_none(rows, name)
    out = df.where(_value("split") == split)
    if out.isEmpty():
        raise Rejected(f"no rows of the split {split}")
    return out


def unseen_keywords(development: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Keywords that both have: evaluation on them is not independent."""
    key = T.normalize_key("keyword")
    return development.select(key.alias("keyword")).intersect(evaluation.select(key.alias("keyword"))).where("keyword <> ''")


def input_mode_problems(df: DataFrame, mode: str) -> DataFrame:
    """Rows whose content does not fit the declared mode: with_body or without_body."""
    if mode not in ("with_body", "without_body"):
        raise Rejected(f"unknown input mode: {mode}")
    empty = T.clean_text("content") == ""
    return df.where(empty if mode == "with_body" else ~empty)


def for_mode(df: DataFrame, mode: str) -> DataFrame:
    """df as evaluated without bodies (content blanked) or with them (which each row must have)."""
    if mode == "without_body":
        return df.withColumn("content", F.lit(""))
    require_none(input_mode_problems(df, mode).select("id"), "no body")
    return df


def sample_problems(df: DataFrame, labels: list[str]) -> dict[str, DataFrame]:
    """Offending rows of calibration samples: gold, pred_label, score, margin, event_id, keyword."""
    keywords = df.select(T.normalize_key("keyword", False).alias("k")).distinct()
    return {
        "invalid score or margin": calibrate.invalid_samples(df).select("score", "margin"), "invalid prediction": df.where(~F.coalesce(F.col("pred_label").isin(labels), F.lit(False))).select("pred_label"),
        "no event": df.where(calibrate.event_key() == "").select("event_id"), "event with two labels": df.groupBy(calibrate.event_key().alias("event")).agg(F.count_distinct("gold").alias("n")).where("n > 1"),
        "empty keyword": keywords.where("k = ''"), "fewer than two keywords": keywords.agg(F.count(F.lit(1)).alias("n")).where("n < 2"),
        "label without a sample": df.sparkSession.createDataFrame([(x,) for x in labels], "gold string").join(df.select("gold").distinct(), "gold", "left_anti"),
    }


def evidence_problems(rules: RuleSet, scored: DataFrame) -> DataFrame:
    """label, phrase, event, problem of development terms whose evidence does not hold.

    scored: reviewed rows with hits (rules.rank): event_id, split, review_status, gold_label, reviewed_by, suggested_label, hits.
    """
    terms = [(t.label, t.phrase, normalized(t.phrase), e.strip().casefold()) for t in rules.terms if t.origin == "development" for e in t.evidence_event_ids]
    want = scored.sparkSession.createDataFrame(terms, "label string, phrase string, normal string, event string")
    rows = scored.select(
        calibrate.event_key().alias("event"), ((_value("split") == "development") & (_value("review_status") == "confirmed")).alias("sound"), _value("gold_label").alias("gold"),
        (_value("reviewed_by") != "").alias("reviewer"), (_value("suggested_label") != "").alias("suggested"), "hits",
    ).where("event <> ''")
    both = want.join(rows, "event", "left")
    scores = F.exists("hits", lambda h: (h["label"] == F.col("label")) & (F.lower(h["phrase"]) == F.col("normal")))
    each = both.groupBy("label", "phrase", "event").agg(
        F.count("sound").alias("n"), F.bool_and(F.col("sound") & (F.col("gold") == F.col("label"))).alias("sound"), F.bool_and("reviewer").alias("reviewer"), F.bool_or("suggested").alias("suggested"), F.bool_or(scores).alias("scores"),
    )
    problem = (
        F.when(F.col("n") == 0, "event not in the dataset").when(~F.col("sound"), "not confirmed development data with that label").when(~F.col("reviewer"), "no reviewer")
        .when(F.col("suggested"), "suggested label").when(~F.col("scores"), "phrase does not score in the article")
    )
    return each.withColumn("problem", problem).where("problem is not null").select("label", "phrase", "event", "problem")


def errors_without_support(rules: RuleSet, scored: DataFrame) -> DataFrame:
    """label, phrase, event of development terms that fix no error: no row of the event with the phrase where the baseline (column baseline) was wrong."""
    terms = [(t.label, t.phrase, normalized(t.phrase), e.strip().casefold()) for t in rules.terms if t.origin == "development" for e in t.evidence_event_ids]
    want = scored.sparkSession.createDataFrame(terms, "label string, phrase string, normal string, event string")
    wrong = scored.where(F.col("baseline").isin(*rules.labels, REVIEW) & (F.col("baseline") != _value("gold_label"))).select(calibrate.event_key().alias("event"), F.explode("hits").alias("h"))
    wrong = wrong.select("event", F.col("h.label").alias("label"), F.lower("h.phrase").alias("normal")).distinct()
    return want.join(wrong, ["event", "label", "normal"], "left_anti").select("label", "phrase", "event")


def development_only(df: DataFrame) -> DataFrame:
    """Rows that may not be mined for candidates: of any other split than development or none."""
    return df.where(~F.lower(_value("split")).isin("", "development"))


# --- profiles: JSON files on the driver -------------------------------------------------------------


def write_new_json(path: str, value) -> None:
    """Write a report; fails if it exists or holds a number that JSON has no form for."""
    text = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False)
    with open(path, "x", encoding="utf-8") as f:
        f.write(text + "\n")


def replace_text(path: str, parts: Iterable[str]) -> None:
    """Write a file whole or not at all."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.writelines(parts)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def replace_json(path: str, value) -> None:
    """Write a profile whole or not at all."""
    replace_text(path, [json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False), "\n"])


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def confidence_profile(path: str, bindings: Mapping) -> tuple[tuple[float, float], tuple[float, float]]:
    """((high score, margin), (medium score, margin)) of a profile made for these bindings."""
    with open(path, encoding="utf-8") as f:
        p = json.load(f)
    if p.get("schema_version") != 1 or p.get("bindings") != dict(bindings):
        raise Rejected("the confidence profile was made for something else")
    return thresholds(p["thresholds"])


def thresholds(t: Mapping) -> tuple[tuple[float, float], tuple[float, float]]:
    names = ["high_score", "high_margin", "medium_score", "medium_margin"]
    if set(t) != set(names) or not all(isinstance(t[n], (int, float)) and not isinstance(t[n], bool) and math.isfinite(t[n]) and 0 <= t[n] <= 1 for n in names):
        raise Rejected("thresholds must be numbers from 0 to 1")
    if t["high_score"] < t["medium_score"] or t["high_margin"] < t["medium_margin"]:
        raise Rejected("the high tier is below the medium one")
    return (t["high_score"], t["high_margin"]), (t["medium_score"], t["medium_margin"])


def bindings(rules: RuleSet, model: str, input_mode: str = "") -> dict:
    """What a profile depends on; loading it under others is refused."""
    return {"rules": rules.fingerprint(), "labels": list(rules.labels), "model": model, "input_mode": input_mode}


def decision_profile(policy: Policy, evidence: Mapping, bound: Mapping) -> dict:
    """A profile from development and evaluation evidence: each a mapping of counts as calibrate.evidence has them."""
    for split in ("development", "evaluation"):
        _require_evidence(evidence[split])
    return {"schema_version": 2, "policy": asdict(policy), "evidence": dict(evidence), "bindings": dict(bound)}


def _require_evidence(e: Mapping) -> None:
    n, right = e["support"], e["correct"]
    ind, good = e["independent_support"], e["independent_correct"]
    if not (0 <= right <= n <= e["total"] and 0 <= good <= ind <= n):
        raise Rejected("evidence counts contradict each other")
    again = {"coverage": n / e["total"] if e["total"] else 0.0, "accuracy": right / n if n else 0.0, "lower_bound": wilson_bound(good, ind)}
    if any(not math.isclose(e[k], v, abs_tol=1e-12) for k, v in again.items()):
        raise Rejected("evidence rates don't follow from the counts")


def wilson_bound(correct: int, n: int, z: float = 1.96) -> float:
    if not n:
        return 0.0
    p = correct / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def load_decision_profile(path: str, rules: RuleSet, bound: Mapping) -> Policy:
    with open(path, encoding="utf-8") as f:
        p = json.load(f)
    if p.get("schema_version") != 2 or p.get("bindings") != dict(bound):
        raise Rejected("the decision profile was made for something else")
    for split in ("development", "evaluation"):
        _require_evidence(p["evidence"][split])
    policy = Policy(**p["policy"])
    base = rules.policy
    if policy != calibrate.gated(base, policy.ambiguity_score, policy.ambiguity_margin):
        raise Rejected("a profile may only relax the ambiguity gates")
    validate(rules.with_policy(**p["policy"]))
    return policy
