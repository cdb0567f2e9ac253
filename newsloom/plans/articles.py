"""The driver's tables seen as articles, cases and predictions; each view once for Spark and once as SQL.

title: the first line; description: the second; content: the rest; keyword: lang;
published: 2024-01-01 and doc_id hours. The rule set has function words of four languages as topics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import decide, predict, rules
from newsloom.operators.ruleset import REVIEW, Policy, RuleSet

LABELS = ["en", "fr", "de", "es", "other"]
TERMS = {
    "en": {"the": 1, "of": 1, "and": 1, "that": 2, "with": 1, "this": 2},
    "fr": {"les": 1, "des": 1, "une": 1, "dans": 2, "pour": 1, "avec": 2},
    "de": {"der": 1, "die": 1, "und": 1, "nicht": 2, "sich": 2, "mit": 1},
    "es": {"los": 1, "para": 2, "el": 1, "las": 1, "del": 1, "como": 2},
}
PRIORITY = {"en": 40, "fr": 20, "de": 10, "es": 30}
MODEL_WORDS = {
    "en": ["the", "of", "is", "was", "for", "are"], "fr": ["le", "la", "les", "que", "qui", "est"],
    "de": ["der", "die", "das", "ist", "zu", "ein"], "es": ["los", "la", "que", "el", "en", "es"],
}
CUES = ["token", "license", "http", "@", "!!", "###"]


def rule_set(**policy) -> RuleSet:
    records = [{"label": label, "phrase": p, "strength": s} for label, terms in TERMS.items() for p, s in terms.items()]
    return RuleSet.of(records, labels=tuple(LABELS), tie_priority=PRIORITY, other_label="other", technology_label="en", domain_terms=("the", "les", "der", "los"), policy=Policy(**policy))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def articles(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"), F.col("lang").alias("keyword"), "source", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("link"),
        F.get(lines, 0).alias("title"), F.coalesce(F.get(lines, 1), F.lit("")).alias("description"),
        F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n").alias("content"), "text",
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("published"),
    )


ARTICLES = """articles AS (
  SELECT doc_id AS ord, lang AS keyword, source, 'doc://' || doc_id AS link, string_split(text, chr(10))[1] AS title,
    coalesce(string_split(text, chr(10))[2], '') AS description, array_to_string(string_split(text, chr(10))[3:], chr(10)) AS content, text,
    TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS published
  FROM documents)"""


def body() -> F.Column:
    return F.lower(T.squeezed("text"))


BODY = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


def ranked(spark: SparkSession, d: str, rs: RuleSet | None = None) -> DataFrame:
    return rules.rank(articles(spark, d).withColumn("rule_text", body()), F.col("rule_text"), rs or rule_set())


def _has(p: str) -> str:
    return f"regexp_matches(body, '(^|[^A-Za-z0-9]){p}([^A-Za-z0-9]|$)')"


_ORDER = sorted(TERMS, key=lambda x: PRIORITY[x])
_score = lambda label, weight: " + ".join(f"CASE WHEN {_has(p)} THEN {weight(s)} ELSE 0 END" for p, s in TERMS[label].items())

#: ord, label, score, matches, strong, place (1 is best).
SCORES = (
    f"bodies AS (SELECT *, {BODY} AS body FROM articles),\n"
    "scores AS (\n" + "\n  UNION ALL ".join(
        f"SELECT ord, '{label}' AS label, {PRIORITY[label]} AS priority, {_score(label, lambda s: s)} AS score, {_score(label, lambda s: 1)} AS matches, {_score(label, lambda s: int(s > 1))} AS strong FROM bodies"
        for label in TERMS
    ) + "),\n"
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, priority) AS place FROM scores),\n"
    "best AS (SELECT a.ord, a.label AS best, a.score AS s1, a.matches AS m1, a.strong AS k1, b.score AS s2, a.score - b.score AS rule_margin FROM ranked a JOIN ranked b ON a.ord = b.ord WHERE a.place = 1 AND b.place = 2)"
)


def predicted(df: DataFrame) -> DataFrame:
    return predict.by_shares(df, body(), MODEL_WORDS)


_count = lambda ws: f"len(regexp_extract_all(padded, ' (?:{'|'.join(ws)}) '))"
#: ord, label, score (share), place.
PREDICTED = (
    f"padded AS (SELECT ord, ' ' || regexp_replace({BODY}, '[^a-zà-ÿß]+', '  ', 'g') || ' ' AS padded FROM articles),\n"
    "counts AS (SELECT ord, " + ", ".join(f"{_count(ws)} AS n_{k}" for k, ws in MODEL_WORDS.items()) + " FROM padded),\n"
    "shares AS (" + " UNION ALL ".join(f"SELECT ord, '{k}' AS label, {i} AS i, CASE WHEN {'+'.join(f'n_{x}' for x in MODEL_WORDS)} > 0 THEN CAST(n_{k} AS DOUBLE) / ({'+'.join(f'n_{x}' for x in MODEL_WORDS)}) ELSE 0.0 END AS score FROM counts" for i, k in enumerate(MODEL_WORDS)) + "),\n"
    "placed AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, i) AS place FROM shares),\n"
    "pred AS (SELECT a.ord, a.label AS pred_label, a.score AS pred_score, a.score - b.score AS pred_margin FROM placed a JOIN placed b ON a.ord = b.ord WHERE a.place = 1 AND b.place = 2)"
)


def decided(spark: SparkSession, d: str, rs: RuleSet | None = None) -> DataFrame:
    """Articles with pred_*, ranking, decision, gold."""
    rs = rs or rule_set()
    return predict.by_shares(ranked(spark, d, rs), F.col("rule_text"), MODEL_WORDS).withColumns({"decision": decide.decision(rs), "gold": F.col("keyword")})


def decision_sql(p: Policy = Policy(), name: str = "decided") -> str:
    """CTE: ord, pred_*, best..., final_label, applied, row (of the decision table)."""
    confident = f"(pred_score >= {p.model_keep_score} AND pred_margin >= {p.model_keep_margin})"
    clear = f"(s1 >= {p.min_rule_score} AND rule_margin >= {p.min_rule_margin})"
    strong = f"(s1 >= {p.strong_override_score} AND rule_margin >= {p.strong_override_margin} AND k1 >= 1)"
    row = f"CASE WHEN {confident} AND pred_label = 'en' AND best <> 'en' AND {strong} THEN 2 WHEN {confident} THEN 3 WHEN {clear} THEN 6 WHEN pred_score < {p.review_model_score} OR pred_score < {p.ambiguity_score} OR pred_margin < {p.ambiguity_margin} THEN 7 ELSE 8 END"
    return (
        f"{name}_rows AS (SELECT p.*, b.* EXCLUDE (ord), {row} AS row FROM pred p JOIN best b ON p.ord = b.ord),\n"
        f"{name} AS (SELECT *, CASE WHEN row IN (2, 6) THEN best WHEN row = 7 THEN '{REVIEW}' ELSE pred_label END AS final_label, row IN (2, 6) AS applied FROM {name}_rows)"
    )


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Documents as reviewed cases: confirmed where labels has them; split by parity; event by title."""
    a = articles(spark, d)
    known = table(spark, d, "labels").select(F.col("doc_id").alias("ord"), "quality", "toxic").dropDuplicates(["ord"])
    j = a.join(known, "ord", "left")
    return j.select(
        "ord", F.col("ord").cast("string").alias("id"), F.when(F.col("ord") % 2 == 0, "development").otherwise("evaluation").alias("split"), F.col("source").alias("keyword"), "title", "link",
        F.substring(F.sha2(F.lower(F.regexp_replace("title", "\\s+", "")), 256), 1, 16).alias("event_id"), F.col("keyword").alias("gold_label"),
        F.when(F.col("quality").isNotNull(), "confirmed").otherwise("pending").alias("review_status"), F.when(F.col("quality") == 1, "reviewer").otherwise("").alias("reviewed_by"),
        F.when(F.col("toxic") == 1, "en").otherwise("").alias("suggested_label"), F.when(F.col("quality") == 1, "confirmed").otherwise("pending").alias("independent_event_check"),
        F.col("title").alias("main_event"), F.col("description").alias("main_event_evidence"), "description", "content", "source",
    )


CASES = ARTICLES + """,
known AS (SELECT doc_id, any_value(quality) AS quality, any_value(toxic) AS toxic FROM labels GROUP BY doc_id),
cases AS (
  SELECT a.ord, CAST(a.ord AS VARCHAR) AS id, CASE WHEN a.ord % 2 = 0 THEN 'development' ELSE 'evaluation' END AS split, a.source AS keyword, title, link,
    left(sha256(lower(regexp_replace(title, '\\s+', '', 'g'))), 16) AS event_id, a.keyword AS gold_label, CASE WHEN quality IS NOT NULL THEN 'confirmed' ELSE 'pending' END AS review_status,
    CASE WHEN quality = 1 THEN 'reviewer' ELSE '' END AS reviewed_by, CASE WHEN toxic = 1 THEN 'en' ELSE '' END AS suggested_label,
    CASE WHEN quality = 1 THEN 'confirmed' ELSE 'pending' END AS independent_event_check, title AS main_event, description AS main_event_evidence, description, content, a.source
  FROM articles a LEFT JOIN known k ON a.ord = k.doc_id)"""
