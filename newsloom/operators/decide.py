"""From a prediction and a rule ranking to a decision, as one ordered ``when`` chain.

Columns in: pred_label, pred_score, pred_margin, and what rules.rank adds. Thresholds are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T

from . import rules as R
from .ruleset import FAILED, REVIEW, Policy, RuleSet


def confidence_tier(score: Column, margin: Column, high: tuple[float, float] = (0.70, 0.10), medium: tuple[float, float] = (0.50, 0.05)) -> Column:
    return F.when((score >= high[0]) & (margin >= high[1]), "높음").when((score >= medium[0]) & (margin >= medium[1]), "보통").otherwise("낮음")


def is_ambiguous(score: Column, margin: Column, least_score: float = 0.50, least_margin: float = 0.05) -> Column:
    return (score < least_score) | (margin < least_margin)


def prediction(labels: Column, scores: Column, k: int = 3) -> Column:
    """struct(label, score, margin, top_labels, top_scores) of parallel label and score arrays; ties in given order."""
    pairs = F.transform(F.arrays_zip(labels.alias("l"), scores.alias("s")), lambda x, i: F.struct((-x["s"]).alias("k"), i.alias("i"), x["l"].alias("label"), x["s"].alias("score")))
    # bound once by a one-element transform, as the sorted array is read in several places
    told = F.transform(F.array(F.array_sort(pairs)), lambda a: F.struct(
        F.get(a, 0)["label"].alias("label"), F.get(a, 0)["score"].alias("score"), (F.get(a, 0)["score"] - F.coalesce(F.get(a, 1)["score"], F.lit(0.0))).alias("margin"),
        F.transform(F.slice(a, 1, k), lambda x: x["label"]).alias("top_labels"), F.transform(F.slice(a, 1, k), lambda x: x["score"]).alias("top_scores"),
    ))
    return F.when(F.size(labels) > 0, F.get(told, 0)).otherwise(failed_prediction())


def failed_prediction() -> Column:
    return F.struct(F.lit(FAILED).alias("label"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"), F.array().cast("array<string>").alias("top_labels"), F.array().cast("array<double>").alias("top_scores"))


def conflict_labels(ranking: Column, hits: Column) -> Column:
    """Labels with strong hits, if there are two at least and a development term is among the hits; else none."""
    strong = F.transform(F.filter(ranking, lambda x: x["strong"] > 0), lambda x: x["label"])
    return F.when((F.size(strong) >= 2) & F.exists(hits, lambda h: h["origin"] == "development"), strong).otherwise(F.array().cast("array<string>"))


def _text(c: Column) -> Column:
    return c.cast("string")


def rule_reason(prefix: str, ranking: Column, margin: Column) -> Column:
    first = F.get(ranking, 0)
    shown = F.array_join(F.slice(first["terms"], 1, 3), ", ")
    body = F.concat(F.lit(f"{prefix}: "), first["label"], F.lit(" 규칙 점수 "), _text(first["score"]), F.lit(", 근거 "), _text(first["matches"]), F.lit("개, 2위 대비 +"), _text(margin))
    return F.when(shown == "", body).otherwise(F.concat(body, F.lit(" ("), shown, F.lit(")")))


def review_reason(ranking: Column, margin: Column, p: Policy) -> Column:
    first, second = F.get(ranking, 0), F.get(ranking, 1)
    return (
        F.when(first["score"] == 0, "근거 없음: 일치하는 규칙 키워드 없음, 모델 판단 불확실")
        .when(first["score"] < p.min_rule_score, F.concat(F.lit("규칙 점수 부족: 최고 "), _text(first["score"]), F.lit(f"점, 최소 {p.min_rule_score}점 필요, 모델 판단 불확실")))
        .otherwise(F.concat(F.lit("주제 간 점수 차이 부족: "), _text(first["score"]), F.lit(" 대 "), _text(second["score"]), F.lit(", 차이 "), _text(margin), F.lit(f"점, 최소 {p.min_rule_margin}점 필요, 모델 판단 불확실")))
    )


def _clear(ranking: Column, margin: Column, p: Policy) -> Column:
    return (F.get(ranking, 0)["score"] >= p.min_rule_score) & (margin >= p.min_rule_margin)


def rule_only(df: DataFrame, rules: RuleSet, anchored: Column | None = None) -> Column:
    """The label that rules alone give, or REVIEW."""
    p, ranking = rules.policy, F.col("ranking")
    ok = _clear(ranking, F.col("rule_margin"), p) & (F.lit(True) if anchored is None else anchored)
    return (
        F.when(R.unrelated_signals(F.col("rule_text"), rules) >= 2, rules.other_label)
        .when(F.size(conflict_labels(ranking, F.col("hits"))) > 0, REVIEW).when(ok, F.get(ranking, 0)["label"]).otherwise(REVIEW)
    )


def with_anchor(df: DataFrame, rules: RuleSet) -> DataFrame:
    """df with anchored: the best label also wins clearly on title, description and the body's first sentences (an experiment, off by default)."""
    body = T.lead_sentences(T.clean_text("content"))
    lead = F.concat_ws(" ", F.substring(T.clean_text("title"), 1, 250), F.substring(T.clean_text("description"), 1, 300), body)
    out = R.rank(df.withColumn("anchor_text", T.normalize_rule_text(lead)), F.col("anchor_text"), rules, prefix="anchor_")
    same = (F.get("anchor_ranking", 0)["label"] == F.get("ranking", 0)["label"]) & _clear(F.col("anchor_ranking"), F.col("anchor_rule_margin"), rules.policy)
    return out.withColumn("anchored", same).drop("anchor_text", "anchor_hits", "anchor_ranking", "anchor_rule_margin", "anchor_tied_labels")


def decision(rules: RuleSet, policy: Policy | None = None, anchored: Column | None = None) -> Column:
    """struct(final_label, rule_applied, rule_reason, rule_best_label, rule_match_count)."""
    p = policy or rules.policy
    ranking, margin, label = F.col("ranking"), F.col("rule_margin"), F.col("pred_label")
    score, gap = F.col("pred_score"), F.col("pred_margin")
    first = F.get(ranking, 0)
    conflict = conflict_labels(ranking, F.col("hits"))
    anchor = F.lit(True) if anchored is None else anchored
    confident = (score >= p.model_keep_score) & (gap >= p.model_keep_margin)
    clear = _clear(ranking, margin, p)
    strong = (first["score"] >= p.strong_override_score) & (margin >= p.strong_override_margin) & (first["strong"] >= 1) & (F.size(conflict) == 0) & anchor
    override = ~first["label"].isin(rules.technology_label, *rules.no_override)
    unrelated = R.unrelated_signals(F.col("rule_text"), rules)

    def made(final: Column | str, applied: bool, reason: Column | str, best: Column | None = None) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(
            lit(final).alias("final_label"), F.lit(applied).alias("rule_applied"), lit(reason).alias("rule_reason"),
            (first["label"] if best is None else best).alias("rule_best_label"), (first["matches"] if best is None else F.lit(0)).alias("rule_match_count"),
        )

    conflicted = F.concat(F.lit("주제 근거 충돌: "), F.array_join(conflict, ", "), F.lit("에 강한 근거 동시 확인, 신규 규칙 자동 보정 보류"))
    return (
        F.when(label == FAILED, made(FAILED, False, "모델 분류 실패", F.lit("")))
        .when(unrelated >= 2, made(rules.other_label, True, F.concat(F.lit("비관련 문맥 "), unrelated.cast("string"), F.lit("개 확인"))))
        .when(confident & (label == rules.technology_label) & (first["label"] != label) & override & strong, made(first["label"], True, rule_reason(f"{rules.technology_label} 편향 보정", ranking, margin)))
        .when(confident, made(label, False, ""))
        .when(F.size(conflict) > 0, made(REVIEW, False, conflicted))
        .when(clear & ~anchor, made(REVIEW, False, F.concat(F.lit("주요 사건 근거 부족: "), first["label"], F.lit(" 근거가 제목과 도입부에서 확인되지 않음"))))
        .when(clear, made(first["label"], True, rule_reason("규칙 보정", ranking, margin)))
        .when((score < p.review_model_score) | is_ambiguous(score, gap, p.ambiguity_score, p.ambiguity_margin), made(REVIEW, False, review_reason(ranking, margin, p)))
        .otherwise(made(label, False, ""))
    )


def post_processed(rules: RuleSet, relaxed: Policy | None = None, input_mode: str | None = None) -> Column:
    """The decision under a calibrated policy where the article has a body as the policy was calibrated for, else under the base policy.

    Where the relaxed policy newly keeps the model's label, the reason says so.
    """
    base = decision(rules)
    if relaxed is None:
        return base
    new = decision(rules, relaxed)
    fits = F.lit(True) if input_mode is None else ((T.squeezed("content") != "") if input_mode == "with_body" else (T.squeezed("content") == ""))
    newly = ~new["rule_applied"] & (new["final_label"] == F.col("pred_label")) & (base["final_label"] == REVIEW)
    fixed = lambda c: F.format_string("%.4f", c)
    why = F.concat(
        F.lit("검증된 공통 판정 기준으로 모델 유지: 모델 점수 "), fixed(F.col("pred_score")), F.lit(f" >= {relaxed.ambiguity_score:.4f}, 1순위와 2순위 점수 차이 "),
        fixed(F.col("pred_margin")), F.lit(f" >= {relaxed.ambiguity_margin:.4f}; 기본 기준 검토 사유: "), base["rule_reason"],
    )
    return F.when(fits & newly, new.withField("rule_reason", why)).when(fits, new).otherwise(base)


# --- derived columns of a decided row ---------------------------------------------------------------


def decision_source(final: Column, applied: Column) -> Column:
    return F.when(final == FAILED, "ERROR").when(final == REVIEW, "REVIEW").when(applied, "RULE").otherwise("MODEL")


def decision_status(final: Column) -> Column:
    return F.when(final == FAILED, "ERROR").when(final == REVIEW, "REVIEW_REQUIRED").otherwise("DECIDED")


def review_required(final: Column) -> Column:
    return final.isin(FAILED, REVIEW)


def review_state(final: Column, status: Column, source: Column, flag: Column, labels: list[str]) -> Column:
    """True, False, or null where columns of different ages don't tell."""
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    category = F.trim(F.coalesce(final, F.lit("")))
    yes = category.isin(FAILED, REVIEW) | up(status).isin("REVIEW_REQUIRED", "ERROR") | up(source).isin("REVIEW", "ERROR") | up(flag).isin("TRUE", "1", "Y", "YES")
    no = category.isin(*labels) | (up(status) == "DECIDED") | up(source).isin("MODEL", "RULE") | up(flag).isin("FALSE", "0", "N", "NO")
    return F.when(yes, True).when(no, False)


# How reasons begin, without white space, and what they count as.
REASON_BUCKETS = {"근거없음": "no_rule_evidence", "규칙점수부족": "insufficient_rule_score", "주제간점수차이부족": "insufficient_rule_margin", "주제근거충돌": "conflicting_rule_evidence", "주요사건근거부족": "insufficient_event_anchor"}


def reason_bucket(reason: Column, final: Column, status: Column | None = None, source: Column | None = None) -> Column:
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit("")))) == "ERROR"
    failed = F.trim(F.coalesce(final, F.lit(""))) == FAILED
    for c in (status, source):
        failed = failed if c is None else failed | up(c)
    bare = F.regexp_replace(F.coalesce(reason, F.lit("")), T.SPACE, "")
    out = F.when(failed, "model_error")
    for start, name in REASON_BUCKETS.items():
        out = out.when(F.startswith(bare, F.lit(start)), name)
    return out.when(bare != "", "other_recorded_reason").otherwise("reason_not_recorded")
