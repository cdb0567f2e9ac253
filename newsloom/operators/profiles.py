"""Rule profiles: development phrases become active only with the result of an independent evaluation, for one model and base rule set.

A profile is trusted local configuration. Files of proposals or audits are told apart by their type and never activate a rule.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import replace

from .governance import Rejected
from .ruleset import STRONG, WEAK, RuleSet, Term, normalized, proposals, validate

# Fixed values of the files.
PROPOSALS, CONFIRMED = "event_rule_candidates", "confirmed_event_rules"
STRENGTHS = {"WEAK": WEAK, "STRONG": STRONG}
REQUIREMENTS = {"human_confirmed": True, "events_disjoint": True, "unseen_keywords": True}
NOTE = "Trusted local configuration. Observed small-sample validation is not a guarantee for future keywords."


def _need(holds: bool, message: str) -> None:
    if not holds:
        raise Rejected(message)


def _read(path: str, kind: str) -> dict:
    with open(path, encoding="utf-8") as f:
        p = json.load(f)
    _need(isinstance(p, dict) and p.get("schema_version") == 1 and not isinstance(p["schema_version"], bool) and p.get("profile_type") == kind, f"{path} is no {kind} file")
    return p


def extended(base: RuleSet, records: object) -> RuleSet:
    """base with development terms: records of category, phrase, strength (WEAK or STRONG), evidence_event_ids."""
    _need(isinstance(records, list) and all(isinstance(r, dict) and set(r) == {"category", "phrase", "strength", "evidence_event_ids"} for r in records), "a rule has a category, phrase, strength and evidence_event_ids")
    for r in records:
        _need(r["category"] in base.labels and r["category"] != base.other_label, f"no category for rules: {r['category']}")
        _need(isinstance(r["phrase"], str) and bool(r["phrase"].strip()), "a phrase is a text")
        _need(isinstance(r["strength"], str) and r["strength"] in STRENGTHS, f"strength is one of {list(STRENGTHS)}")
    named = [{"label": r["category"], "phrase": r["phrase"].strip(), "strength": STRENGTHS[r["strength"]], "evidence_event_ids": r["evidence_event_ids"]} for r in records]
    return validate(replace(base, terms=(*base.terms, *proposals(named))))


def records(rules: RuleSet) -> list[dict]:
    """The development terms in the form that extended() takes, label by label."""
    word = {v: k for k, v in STRENGTHS.items()}
    own: list[Term] = sorted((t for t in rules.terms if t.origin == "development"), key=lambda t: rules.labels.index(t.label))
    return [{"category": t.label, "phrase": t.phrase, "strength": word[t.strength], "evidence_event_ids": list(t.evidence_event_ids)} for t in own]


def read_proposals(path: str, base: RuleSet) -> RuleSet:
    return extended(base, _read(path, PROPOSALS).get("rules"))


def parse_candidate(text: str, rules: RuleSet) -> tuple[str, str]:
    """'category:phrase' as (label, phrase)."""
    label, colon, phrase = (x.strip() for x in text.partition(":"))
    _need(bool(colon) and label in rules.labels and label != rules.other_label and bool(normalized(phrase)), f"not of the form category:phrase: {text}")
    return label, phrase


def _count(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


def result_problems(result: object, terms: Iterable[tuple[str, str]], least: int) -> list[str]:
    """What an evaluation's result lacks to carry these terms (label, phrase); least: independent events that each needs."""
    if not isinstance(result, Mapping):
        return ["no result"]
    out = [] if (result.get("status"), result.get("passed"), result.get("failures")) == ("passed", True, []) else ["the evaluation was not passed"]
    rows, events = result.get("newly_automatic_count"), result.get("newly_automatic_independent_events")
    if not (_count(rows) and _count(events) and least <= events <= rows):
        out.append("too few new automatic decisions on independent events")
    harm = ("newly_automatic_wrong_count", "new_wrong_decision_count", "previous_correct_harmed_count")
    out += [f"{k} must be 0" for k in harm if not (_count(result.get(k)) and result[k] == 0)]
    stages = [result.get(k) for k in ("baseline", "selected")]
    names = ("total", "review_count", "automatic_count", "wrong_automatic_count")
    if not all(isinstance(s, Mapping) and all(_count(s.get(n)) for n in names) for s in stages):
        out.append("counts before and after are missing")
    else:
        before, after = stages
        if any(not s["total"] or s["review_count"] + s["automatic_count"] > s["total"] or s["wrong_automatic_count"] > s["automatic_count"] for s in stages):
            out.append("counts contradict each other")
        if before["total"] != after["total"] or before["review_count"] <= after["review_count"]:
            out.append("the review did not get smaller on the same cases")
    held = result.get("per_rule_holdout")
    found = held.get("terms") if isinstance(held, Mapping) and held.get("passed") is True else None
    if not isinstance(found, list) or not all(isinstance(t, Mapping) for t in found):
        return [*out, "each phrase needs held-out evidence"]
    fine = [t for t in found if t.get("passed") is True and _count(t.get("correct_rule_independent_events")) and t["correct_rule_independent_events"] >= least and t.get("wrong_rule_count") == 0 and _count(t["wrong_rule_count"])]
    if len(fine) < len(found):
        out.append("a phrase's held-out evidence does not hold")
    if sorted((str(t.get("category")), str(t.get("phrase"))) for t in found) != sorted(set(terms)):
        out.append("held-out phrases are not the rules' phrases")
    return out


def _require_result(result: object, rules: RuleSet) -> None:
    problems = result_problems(result, [(r["category"], r["phrase"]) for r in records(rules)], rules.min_evidence_events)
    _need(not problems, "; ".join(problems))


def rule_profile(rules: RuleSet, result: Mapping, bindings: Mapping, dataset_sha256: str) -> dict:
    """A profile of the rule set's development terms, if the result carries them."""
    _require_result(result, rules)
    return {
        "schema_version": 1, "profile_type": CONFIRMED, "bindings": dict(bindings), "rules": records(rules), "dataset_sha256": dataset_sha256, "review_requirements": REQUIREMENTS,
        "validation": dict(result), "note": NOTE,
    }


def load_rule_profile(path: str | None, base: RuleSet, bindings: Mapping) -> RuleSet:
    """base, or base with the profile's terms where every check holds that it was made under; bindings: of the present model and base."""
    if not path:
        return base
    p = _read(path, CONFIRMED)
    _need(p.get("bindings") == dict(bindings), "the rule profile was made for another model, input or base rule set")
    _need(p.get("review_requirements") == REQUIREMENTS and all(v is True for v in p["review_requirements"].values()), "the rule profile needs confirmed cases, independent events and unseen keywords")
    _need(isinstance(p.get("dataset_sha256"), str) and re.fullmatch("[0-9a-fA-F]{64}", p["dataset_sha256"]) is not None, "the rule profile names no dataset")
    rules = extended(base, p.get("rules"))
    _require_result(p.get("validation"), rules)
    return rules
