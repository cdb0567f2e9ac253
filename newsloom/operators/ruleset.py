"""Rule sets: labels, phrases and thresholds; their checks and fingerprint. Driver-side, small.

A rule set is data: ``RuleSet.of`` takes records (label, phrase, strength, ...) from wherever they are
kept, such as a JSON file that ``load`` reads.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace

import pandas as pd

WEAK, STRONG = 1, 2
REVIEW, FAILED, OVERFLOW = "검토필요", "분류실패", "기타"

# The candidate labels in order, and the order in which ties between rule labels resolve.
LABELS = [
    "기술개발", "제품/서비스", "기업동향", "생산/공급망", "정책/규제", "금융/투자", "시장/산업", "노동/노사", "국제/통상",
    "교육/취업", "사회", "정치", "문화/연예", "스포츠", "건강/의료", "생활/환경", "기타/무관",
]
TIE_PRIORITY = {"금융/투자": 10, "노동/노사": 20, "국제/통상": 30, "정책/규제": 40, "생산/공급망": 50, "제품/서비스": 60, "기업동향": 70, "시장/산업": 80, "기술개발": 90}
DOMAIN_TERMS = ["반도체", "배터리", "이차전지", "2차전지", "ai", "인공지능", "디스플레이", "oled", "로봇", "전력", "에너지", "원전", "smr", "ess"]
LEGACY_UNRELATED = [
    ["프로야구", "야구"], ["축구", "농구", "배구"], ["경기 결과", "연장전"], ["선수", "감독"], ["연예", "배우", "가수", "아이돌"],
    ["드라마", "영화", "예능"], ["날씨", "기상"], ["여행", "축제", "맛집"], ["요리", "레시피"],
]

_HANGUL = re.compile(r"[가-힣ㄱ-ㅎㅏ-ㅣ]")


def normalized(text: str | None) -> str:
    return unicodedata.normalize("NFKC", " ".join(html.unescape(text or "").split())).casefold()


@dataclass(frozen=True)
class Term:
    label: str
    phrase: str
    strength: int = WEAK
    origin: str = "legacy"
    evidence_event_ids: tuple[str, ...] = ()
    context_only: bool = False


@dataclass(frozen=True)
class Policy:
    """Thresholds of the decision table."""

    model_keep_score: float = 0.55
    model_keep_margin: float = 0.08
    min_rule_score: int = 2
    min_rule_margin: int = 1
    strong_override_score: int = 4
    strong_override_margin: int = 2
    review_model_score: float = 0.40
    ambiguity_score: float = 0.50
    ambiguity_margin: float = 0.05


@dataclass(frozen=True)
class RuleSet:
    labels: tuple[str, ...]
    terms: tuple[Term, ...]
    tie_priority: Mapping[str, int]
    policy: Policy = Policy()
    other_label: str = "기타/무관"
    technology_label: str = "기술개발"
    no_override: frozenset[str] = frozenset()
    domain_terms: tuple[str, ...] = tuple(DOMAIN_TERMS)
    unrelated_groups: tuple[tuple[str, ...], ...] = ()
    min_evidence_events: int = 2
    version: str = "1"
    matcher_version: str = "1"
    _checked: bool = field(default=False, compare=False, repr=False)

    @property
    def direct_labels(self) -> list[str]:
        have = {t.label for t in self.terms}
        return [x for x in self.labels if x in have]

    @classmethod
    def of(cls, records: Iterable[Mapping], **options) -> RuleSet:
        terms = tuple(Term(**{**r, "evidence_event_ids": tuple(r.get("evidence_event_ids", ()))}) for r in records)
        return validate(cls(terms=terms, **({"labels": tuple(LABELS), "tie_priority": TIE_PRIORITY} | options)))

    def with_policy(self, **changes) -> RuleSet:
        return replace(self, policy=replace(self.policy, **changes))

    def baseline(self) -> RuleSet:
        """Without what was added in development."""
        return replace(self, terms=tuple(t for t in self.terms if t.origin != "development"))

    def legacy(self) -> RuleSet:
        """As before roles were told apart: context terms score, unrelated groups count."""
        base = self.baseline()
        kept = [x for x in base.labels if x in {t.label for t in base.terms} or x == base.other_label]
        return replace(base, labels=tuple(kept), terms=tuple(replace(t, context_only=False) for t in base.terms), unrelated_groups=tuple(map(tuple, LEGACY_UNRELATED)))

    def scoring(self) -> list[Term]:
        """Scoring terms in the order in which they claim text: longest first."""

        def order(t: Term):
            n = normalized(t.phrase)
            return -sum(c.isalnum() for c in n), -t.strength, self.tie_priority[t.label], n, t.label

        return sorted((t for t in self.terms if not t.context_only), key=order)

    def fingerprint(self) -> str:
        kept = {k: v for k, v in asdict(self).items() if k != "_checked"}
        kept["no_override"] = sorted(kept["no_override"])
        return hashlib.sha256(json.dumps(kept, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def load(path: str, **options) -> RuleSet:
    """A rule set from a JSON file: a list of records, or an object with them under rules and other fields of RuleSet beside."""
    with open(path, encoding="utf-8") as f:
        p = json.load(f)
    if isinstance(p, list):
        return RuleSet.of(p, **options)
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in p.items() if k != "rules"}
    if "policy" in given:
        given["policy"] = Policy(**given["policy"])
    if "unrelated_groups" in given:
        given["unrelated_groups"] = tuple(map(tuple, given["unrelated_groups"]))
    return RuleSet.of(p["rules"], **(given | {"no_override": frozenset(given.get("no_override", ()))} | options))


_OTHER = r"[^\W_가-힣ㄱ-ㅎㅏ-ㅣ]"
_SEAM = re.compile(rf"\s+|(?<={_HANGUL.pattern})(?={_OTHER})|(?<={_OTHER})(?={_HANGUL.pattern})")


def literals(phrase: str) -> list[str]:
    """The pieces of a phrase between which white space may stand or be absent: its words, cut where Hangul meets other letters."""
    return _SEAM.split(normalized(phrase))


def bounded(phrase: str) -> bool:
    """Whether a phrase must not touch ASCII letters or digits: one without Hangul."""
    return not _HANGUL.search(normalized(phrase))


def phrase_pattern(phrase: str) -> str:
    """Pattern of a phrase for Java and Python. The boundary is looked at around the match, which is the same as checking it
    afterwards unless the phrase can overlap itself (see overlaps_itself)."""
    body = r"\s*".join(map(re.escape, literals(phrase)))
    return rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])" if bounded(phrase) else body


def overlaps_itself(phrase: str) -> bool:
    n = normalized(phrase).replace(" ", "")
    return any(n.endswith(n[:k]) for k in range(1, len(n)))


def _need(holds: bool, message: str) -> None:
    if not holds:
        raise ValueError(message)


def _whole(x: object, least: int = 0) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= least


def _ascending(*xs: float) -> bool:
    return list(xs) == sorted(xs)


#: What holds of a rule set: name -> test.
SET_CHECKS = {
    "labels: each once": lambda r: len(set(r.labels)) == len(r.labels),
    "labels: those named apart are among them": lambda r: {r.other_label, r.technology_label} <= set(r.labels),
    "labels: every term has one": lambda r: {t.label for t in r.terms} <= set(r.labels),
    "labels: two or more have terms, the other label none": lambda r: len(r.direct_labels) > 1 and r.other_label not in r.direct_labels,
    "priorities: whole and different": lambda r: all(_whole(r.tie_priority.get(x)) for x in r.direct_labels) and len({r.tie_priority[x] for x in r.direct_labels}) == len(r.direct_labels),
    "versions: named": lambda r: all(v.strip() for v in (r.version, r.matcher_version)),
    "evidence: one event at least": lambda r: _whole(r.min_evidence_events, 1),
    "domain terms: some, none blank": lambda r: len(r.domain_terms) > 0 and all(map(normalized, r.domain_terms)),
    "unrelated groups: some in each, none blank": lambda r: all(len(g) > 0 and all(map(normalized, g)) for g in r.unrelated_groups),
    "policy: shares from 0 to 1": lambda r: all(0 <= getattr(r.policy, x) <= 1 for x in ("model_keep_score", "model_keep_margin", "review_model_score", "ambiguity_score", "ambiguity_margin")),
    "policy: rule scores whole, the least one above 0": lambda r: _whole(r.policy.min_rule_score, 1) and all(_whole(getattr(r.policy, x)) for x in ("min_rule_margin", "strong_override_score", "strong_override_margin")),
    "policy: gates ascend": lambda r: _ascending(r.policy.review_model_score, r.policy.ambiguity_score, r.policy.model_keep_score) and _ascending(r.policy.ambiguity_margin, r.policy.model_keep_margin),
    "policy: an override takes no less than a rule": lambda r: _ascending(r.policy.min_rule_score, r.policy.strong_override_score) and _ascending(r.policy.min_rule_margin, r.policy.strong_override_margin),
}


def _term_problems(rules: RuleSet) -> pd.DataFrame:
    """phrase, problem of each term that fails a check; terms are a frame, and so are the checks."""
    f = pd.DataFrame([(t.label, t.phrase, normalized(t.phrase), t.strength, t.origin, t.context_only, [x.strip().casefold() for x in t.evidence_event_ids]) for t in rules.terms],
                     columns=["label", "phrase", "normal", "strength", "origin", "context", "events"])
    spelling = f.groupby(f["normal"].str.replace(" ", ""))
    added = f["origin"] == "development"
    bad = {
        "blank": f["normal"] == "", "twice": f["normal"].duplicated(keep=False), "of two labels": spelling["label"].transform("nunique") > 1, "of two strengths": spelling["strength"].transform("nunique") > 1,
        "neither weak nor strong": ~f["strength"].map(lambda x: _whole(x) and x in (WEAK, STRONG)), "context neither true nor false": ~f["context"].map(lambda x: isinstance(x, bool)),
        "of unknown origin": ~f["origin"].isin(["legacy", "development"]), "with blank events": f["events"].map(lambda x: not all(x)), "with an event twice": f["events"].map(lambda x: len(set(x)) < len(x)),
        "added, but for context": added & (f["context"] == True), "added on too few events": added & (f["events"].map(len) < rules.min_evidence_events),  # noqa: E712
    }
    return pd.concat([pd.DataFrame({"phrase": f["phrase"][rows], "problem": name}) for name, rows in bad.items()])


def validate(rules: RuleSet) -> RuleSet:
    """The rule set, or ValueError that names every check that fails."""
    wrong = [name for name, holds in SET_CHECKS.items() if not holds(rules)]
    if rules.terms and not wrong:
        wrong = [f"{p!r}: {problem}" for p, problem in _term_problems(rules).itertuples(index=False)]
    if wrong:
        raise ValueError("rule set refused: " + "; ".join(wrong))
    return rules


def proposals(records: Iterable[Mapping], limit: int = 128) -> list[Term]:
    """Proposed development terms from records with exactly these fields."""
    rows = list(records)
    _need(0 < len(rows) <= limit, f"from 1 to {limit} proposals")
    wanted = {"label", "phrase", "strength", "evidence_event_ids"}
    for r in rows:
        _need(set(r) == wanted, f"a proposal has the fields {sorted(wanted)}")
        _need(r["strength"] in (WEAK, STRONG), "strength must be weak or strong")
        _need(isinstance(r["evidence_event_ids"], (list, tuple)) and all(isinstance(x, str) for x in r["evidence_event_ids"]), "evidence_event_ids must be texts")
    return [Term(r["label"], r["phrase"], r["strength"], "development", tuple(r["evidence_event_ids"])) for r in rows]
