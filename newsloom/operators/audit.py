"""Audits: phrases in articles and among each other, warnings near evidence, stored decisions, readiness, gold coverage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import values as V

from . import calibrate, decide
from .rules import automaton
from .ruleset import FAILED, REVIEW, RuleSet, normalized, phrase_pattern

#: Phrases that one automaton takes.
MOST_PHRASES = 200_000
#: Characters of the keys of an index of phrases.
GRAM = 6

# The splits of a reviewed dataset.
SPLITS = ["development", "evaluation"]

# Expressions near evidence that a person should look at.
WARNINGS = {
    "cancellation": ["취소", "철회", "중단", "무산", "연기", "폐지", "보류"],
    "denial": ["부인", "반박", "사실이 아니", "아니다", "않았다"],
    "comparison": ["대비", "비교", "달리", "반면"],
    "background": ["지난해", "앞서", "과거", "배경"],
}


def phrase_table(spark: SparkSession, phrases: list[tuple[str, str]]) -> DataFrame:
    """label, phrase, normal, alias, pattern of (label, phrase) pairs: as many rows as a person can review."""
    rows = [(label, p, normalized(p), normalized(p).replace(" ", ""), phrase_pattern(p)) for label, p in phrases]
    return spark.createDataFrame(rows, "label string, phrase string, normal string, alias string, pattern string")


def phrases_of(df: DataFrame, label: str, phrase: str) -> DataFrame:
    """A phrase_table() of a table's columns, made where the rows are."""

    @F.pandas_udf("normal string, pattern string")
    def written(phrases: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(normalized(p or ""), phrase_pattern(p or "")) for p in phrases], columns=["normal", "pattern"])

    rows = df.select(F.col(label).alias("label"), F.col(phrase).alias("phrase")).withColumn("w", written("phrase"))
    return rows.select("label", "phrase", "w.normal", F.replace(F.col("w.normal"), F.lit(" "), F.lit("")).alias("alias"), "w.pattern")


def article_fields(df: DataFrame) -> DataFrame:
    """title without its source, description without what it repeats, clean content; search keyword and source are no evidence."""
    return df.withColumns({"title": T.strip_source_suffix("title", "source"), "description": T.article_description("title", "description", "source"), "content": T.clean_text("content")})


def phrase_evidence(df: DataFrame, phrases: list[tuple[str, str]], fields: list[str] | None = None, normalize: bool = True) -> DataFrame:
    """id, field, label, phrase, start, end, matched, excerpt of every span; offsets count in the normalised field.

    One automaton holds all phrases (``MOST_PHRASES`` at most): one pass over the articles, no join, and a cost that does not grow with the phrases.
    A phrase that a text holds under several labels gives a span for each.
    """
    if len(phrases) > MOST_PHRASES:
        raise ValueError(f"{len(phrases)} phrases; an automaton takes {MOST_PHRASES} at most")
    names = fields or ["title", "description", "content"]
    long = df.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(F.col(n), F.lit("")).alias("text")) for n in names])).alias("f")).select("id", "f.field", "f.text")
    if normalize:
        long = long.withColumn("text", T.normalize_rule_text("text"))
    wanted = tuple(phrases)

    @F.pandas_udf("array<struct<label:string,phrase:string,start:int,end:int>>")
    def found(texts: pd.Series) -> pd.Series:
        finder = automaton(tuple(p for _, p in wanted))
        return pd.Series([[{"label": wanted[i][0], "phrase": wanted[i][1], "start": a, "end": b} for i, spans in sorted(finder.spans(t).items()) for a, b in spans] for t in texts], dtype=object)

    hits = long.select("id", "field", "text", F.explode(found("text")).alias("h"))
    return hits.select("id", "field", "h.label", "h.phrase", "h.start", "h.end", F.substring(F.col("text"), F.col("h.start") + 1, F.col("h.end") - F.col("h.start")).alias("matched"), T.excerpt(F.col("text"), F.col("h.start"), F.col("h.end")).alias("excerpt"))


def near_spans(left: DataFrame, right: DataFrame, on: list[str], within: int) -> DataFrame:
    """Pairs of left's (on, start, end, ...) and right's spans (on, r_start, r_end, ...) that are at most ``within`` apart.

    Offsets are cut into bins of ``within``; a span is in each bin that it touches, left's widened by ``within``, and a pair is made in the first bin that
    both are in. So a text's spans meet only those around them, however long the text is and however many it has.
    """
    bin_ = lambda c: F.floor(c / F.lit(within))
    low, high = F.col("start") - within, F.col("end") + within
    a = left.withColumns({"l_first": bin_(low), "bin": F.explode(F.sequence(bin_(low), bin_(high)))})
    b = right.withColumns({"r_first": bin_(F.col("r_start")), "bin": F.explode(F.sequence(bin_(F.col("r_start")), bin_(F.col("r_end"))))})
    near = (F.col("r_end") >= low) & (F.col("r_start") <= high) & (F.col("bin") == F.greatest("l_first", "r_first"))
    return a.join(b, [*on, "bin"]).where(near).drop("bin", "l_first", "r_first")


def context_warnings(evidence: DataFrame, warnings: DataFrame, within: int = 120) -> DataFrame:
    """Warnings (id, field, label as kind, start, end) that stand near evidence (id, field, phrase, start, end)."""
    w = warnings.select("id", "field", F.col("label").alias("kind"), F.col("matched").alias("warning"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = near_spans(evidence.select("id", "field", "phrase", "start", "end"), w, ["id", "field"], within)
    return pairs.select("id", "field", "phrase", "kind", "warning", F.col("r_start").alias("w_start"), F.col("r_end").alias("w_end")).distinct()


def _grams(df: DataFrame, size: int) -> DataFrame:
    """A row for each place of each distinct gram of so many characters of alias."""
    starts = F.sequence(F.lit(1), F.length("alias") - size + 1)
    return df.where(F.length("alias") >= size).withColumn("gram", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("alias"), i, F.lit(size))))))


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """i_label, i_phrase, o_label, o_phrase of each outer phrase that holds an inner one, white space at its seams or not; both are phrase_table()s.

    An inverted index in place of a comparison of all with all: a phrase (without white space) of ``GRAM`` characters or more is looked up by that of its
    grams which the fewest outer phrases hold, a shorter one by all of itself, in postings of that length. What the index gives is verified.
    """
    i = inner.select(*[F.col(c).alias(f"i_{c}") for c in inner.columns], "alias").where(F.length("alias") > 0)
    o = outer.select(*[F.col(c).alias(f"o_{c}") for c in outer.columns], "alias")
    postings = _grams(o, GRAM).select("gram", "o_label", "o_phrase", "o_normal")
    sizes = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    held = _grams(i.where(F.length("alias") >= GRAM), GRAM).join(sizes, "gram")  # a phrase with a gram that is in no outer one is in none either
    rarest = held.groupBy("i_label", "i_phrase", "i_pattern").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    pairs = rarest.join(postings, "gram")
    short = i.where(F.length("alias") < GRAM).select("i_label", "i_phrase", "i_pattern", F.col("alias").alias("gram"))
    for size in sorted(r[0] for r in short.select(F.length("gram")).distinct().collect()):  # under GRAM lengths
        pairs = pairs.unionByName(short.where(F.length("gram") == size).join(_grams(o, size).select("gram", "o_label", "o_phrase", "o_normal"), "gram"))
    return pairs.where(F.expr("rlike(o_normal, i_pattern)")).select("i_label", "i_phrase", "o_label", "o_phrase")


def phrase_relations(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """label, phrase, other_label, other_phrase, relation of phrases that are spellings of one another or contain one another.

    Both are phrase_table()s of any length: joins by equal keys alone.
    """
    of = lambda df, p: df.select(F.col("label").alias(f"{p}label"), F.col("phrase").alias(f"{p}phrase"), "alias")
    pair = ["label", "phrase", "other_label", "other_phrase"]
    same = of(candidates, "").join(of(terms, "other_"), "alias").select(*pair).distinct()
    over = containing(candidates, terms).toDF(*pair).unionByName(containing(terms, candidates).toDF("other_label", "other_phrase", "label", "phrase")).distinct()
    return same.withColumn("relation", F.lit("spacing_alias")).unionByName(over.join(same, pair, "left_anti").withColumn("relation", F.lit("phrase_overlap")))


def phrase_counts(evidence: DataFrame, articles: DataFrame) -> DataFrame:
    """For each candidate phrase: matching articles, confirmed development rows with its label, their different events."""
    rows = evidence.select("id", "label", "phrase").distinct().join(articles, "id")
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    confirmed = (low("split") == "development") & (low("review_status") == "confirmed") & (F.col("gold_label") == F.col("label")) & (low("reviewed_by") != "") & (low("event_id") != "") & (low("suggested_label") == "")
    return rows.groupBy("label", "phrase").agg(F.count(F.lit(1)).alias("articles"), F.count_if(confirmed).alias("confirmed_rows"), F.count_distinct(F.when(confirmed, calibrate.event_key())).alias("events"))


def rule_evidence(evidence: DataFrame) -> DataFrame:
    """id, label, phrase, fields, body_only: where each scored phrase occurs."""
    return evidence.groupBy("id", "label", "phrase").agg(F.array_sort(F.collect_set("field")).alias("fields"), (F.count_if(F.col("field") != "content") == 0).alias("body_only"))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows that agree on keys (null agrees with null) the first in order, ties by all other columns; with df's columns. One aggregate whose state is one
    row, made in the tasks first, so a key that very many rows have is no hot spot."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return first.select(*keys, *[F.col("first")[c].alias(c) for c in [*order, *rest]]).select(*df.columns)


# --- stored results ---------------------------------------------------------------------------------


def review_rollup(df: DataFrame, labels: list[str], score_threshold: float = 0.5, margin_threshold: float = 0.05) -> DataFrame:
    """Totals, and those of each keyword and each predicted category, in one pass (grouping sets).

    df: keyword, model_category, final_category, final_decision_status, decision_source, review_required, rule_reason,
    model_score, score_margin (all text), content.
    """
    named = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", "미상").otherwise(F.trim(F.col(c)))
    rows = df.select(
        named("keyword").alias("keyword"), named("model_category").alias("model_category"),
        decide.review_state(F.col("final_category"), F.col("final_decision_status"), F.col("decision_source"), F.col("review_required"), labels).alias("state"),
        decide.reason_bucket(F.col("rule_reason"), F.col("final_category"), F.col("final_decision_status"), F.col("decision_source")).alias("bucket"),
        V.probability("model_score").alias("score"), V.probability("score_margin").alias("margin"), (F.trim(F.coalesce("content", F.lit(""))) != "").alias("body"), "final_category",
    )
    low = (F.col("score") < score_threshold) & (F.col("margin") < margin_threshold)
    known = F.count("state")
    out = rows.groupingSets([[], ["keyword"], ["model_category"]], "keyword", "model_category").agg(
        F.count(F.lit(1)).alias("articles"), known.alias("known"), F.count_if("state").alias("review_required"), F.when(known > 0, F.count_if("state") / known).alias("review_rate"),
        F.count_if(F.col("final_category") == FAILED).alias("errors"), F.count_if(F.col("state") & (F.col("bucket") == "no_rule_evidence")).alias("no_rule_evidence"),
        F.count_if(F.col("state") & (F.col("bucket") == "insufficient_rule_score")).alias("insufficient_rule_score"), F.count("score").alias("valid_scores"),
        F.count_if(F.col("score") < score_threshold).alias("low_scores"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.count_if(F.col("state") & low).alias("review_low_both"), F.count_if("body").alias("with_body"), F.grouping_id("keyword", "model_category").alias("level"),
    )
    return out


def metric(df: DataFrame, column: str, threshold: float) -> DataFrame:
    x = V.probability(column)
    return df.agg(F.count(x).alias("valid"), F.count_if(x.isNull()).alias("invalid"), F.count_if(x < threshold).alias("below"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"))


# How a retry may have ended.
RETRY_STATUSES = "DISABLED ALREADY_ENRICHED CONTENT_PRESENT NO_SCRAPER NO_LINK NO_CONTENT UNCHANGED_INPUT PENDING FETCH_FAILED RECLASSIFIED TIMEOUT BLOCKED_HTTP HTTP_ERROR REQUEST_FAILED GOOGLE_NEWS_WRAPPER RSS_WRAPPER CONSENT_OR_BLOCK_PAGE NO_USABLE_PARAGRAPHS SOURCE_URL_UNRESOLVED UNSAFE_URL REDIRECT_LIMIT".split()


def retry_counts(df: DataFrame, column: str = "review_reclassification") -> DataFrame:
    """status, n of stored retry records (JSON text); unreadable or unknown ones are 'unknown', empty ones 'not_applicable'."""
    raw = F.trim(F.coalesce(F.col(column), F.lit("")))
    r = F.from_json(raw, "status string, initial_final_category string")
    status = F.when(F.regexp_replace(raw, r"\s", "") == "{}", "not_applicable").when(r["status"].isin(RETRY_STATUSES) & (r["initial_final_category"] == REVIEW), r["status"]).otherwise("unknown")
    return df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def exploded_groups(df: DataFrame) -> DataFrame:
    """Each group's representative and its references as rows; df: title, source, published_at, link, related_articles (JSON text). Groups of one are left out."""
    refs = F.from_json(F.coalesce("related_articles", F.lit("[]")), "array<struct<title:string,source:string,published_at:string,link:string>>")
    refs = F.filter(F.coalesce(refs, F.array().cast("array<struct<title:string,source:string,published_at:string,link:string>>")), lambda x: x.isNotNull())
    own = F.array(F.struct("title", "source", "published_at", "link"))
    each = df.withColumn("refs", refs).where(F.size("refs") > 0).select(F.col("title").alias("group_title"), F.posexplode(F.concat(own, "refs")).alias("place", "a"))
    return each.select("group_title", "place", *[F.coalesce(f"a.{c}", F.lit("")).alias(c) for c in ("title", "source", "published_at", "link")])


def replay(df: DataFrame) -> DataFrame:
    """Counts before and after bodies were added: columns before, after (labels), reclassified."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("before") == REVIEW).alias("review_before"), F.count_if(F.col("after") == REVIEW).alias("review_after"), F.count_if("reclassified").alias("reclassified"),
        F.count_if((F.col("before") == REVIEW) & ~F.col("after").isin(REVIEW, FAILED)).alias("resolved"), F.count_if(~F.col("before").isin(REVIEW, FAILED) & (F.col("before") != F.col("after"))).alias("automatic_changed"),
    )


# --- reviewed datasets ------------------------------------------------------------------------------


def _value(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def crossing(df: DataFrame, key: Column) -> DataFrame:
    """Keys that occur in both splits."""
    rows = df.select(key.alias("key"), _value("split").alias("split")).where((F.col("key") != "") & F.col("split").isin(SPLITS))
    return rows.groupBy("key").agg(F.count_distinct("split").alias("n")).where("n > 1").select("key")


def readiness_checks(entities: bool = True) -> dict[str, Column]:
    """What a row of a blind review needs; each a boolean, but for the uniqueness of its id."""
    reviewed = (_value("review_status") == "confirmed") & (_value("reviewed_by") != "")
    clean = lambda c: (T.clean_text(c, entities) != "")
    return {
        "article_title": clean("title"), "article_link": _value("link") != "", "confirmed_gold": reviewed & F.col("known_gold"), "explicit_event_id": _value("event_id") != "",
        "event_confirmation": _value("independent_event_check") == "confirmed", "split": _value("split").isin(SPLITS), "keyword": T.normalize_key("keyword", entities) != "",
        "main_event": clean("main_event"), "main_event_evidence": clean("main_event_evidence"), "no_suggested_label": _value("suggested_label") == "",
    }


def with_readiness(df: DataFrame, labels: list[str], entities: bool = True) -> DataFrame:
    """df with missing (names of failed checks) and ready."""
    ids = df.groupBy(_value("id").alias("case_id")).agg(F.count(F.lit(1)).alias("same_id"))
    rows = df.withColumns({"case_id": _value("id"), "known_gold": F.coalesce(F.col("gold_label").isin(labels), F.lit(False))}).join(ids, "case_id")
    checks = {"article_id": (F.col("case_id") != "") & (F.col("same_id") == 1)} | readiness_checks(entities)
    missing = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return rows.withColumn("missing", missing).withColumn("ready", F.size("missing") == 0)


def readiness(df: DataFrame, labels: list[str], entities: bool = True) -> tuple[DataFrame, DataFrame]:
    """Counts of missing fields, and independent events of ready rows for each split and label."""
    rows = with_readiness(df, labels, entities)
    missing = rows.select(F.explode("missing").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    events = rows.where("ready").groupBy("split", "gold_label").agg(F.count_distinct(calibrate.event_key()).alias("events"))
    return missing, events


def gold_exclusion(labels: list[str]) -> Column:
    """The first reason for which a row's gold does not count; null if it does."""
    return (
        F.when(_value("gold_label") == "", "missing_gold_label").when(~_value("gold_label").isin(labels), "invalid_gold_label").when(_value("review_status") != "confirmed", "not_confirmed")
        .when(_value("reviewed_by") == "", "missing_reviewer").when(_value("suggested_label") != "", "suggested_label_present")
    )


def gold_coverage(df: DataFrame, labels: list[str]) -> DataFrame:
    """label, articles, events, without_event, keywords of confirmed gold."""
    rows = df.where(gold_exclusion(labels).isNull())
    event = F.when(_value("event_id") != "", calibrate.event_key())
    return rows.groupBy(_value("gold_label").alias("label")).agg(F.count(F.lit(1)).alias("articles"), F.count_distinct(event).alias("events"), F.count_if(_value("event_id") == "").alias("without_event"), F.count_distinct(F.when(_value("keyword") != "", _value("keyword"))).alias("keywords"))


def review_reduction(df: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """before and after of new rules on the same rows: what became automatic, what of it is wrong, what was harmed."""
    before, after, gold = F.col("before"), F.col("after"), F.col("gold")
    new = (before == REVIEW) & after.isin(labels)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(before == REVIEW).alias("review_before"), F.count_if(after == REVIEW).alias("review_after"), F.count_if(new).alias("newly_automatic"),
        F.count_if(new & (after != gold)).alias("newly_wrong"), F.count_distinct(F.when(new & (calibrate.event_key() != ""), calibrate.event_key())).alias("newly_events"),
        F.count_if(after.isin(labels) & (after != gold) & (before != after)).alias("new_wrong_decisions"), F.count_if((before == gold) & (after != gold)).alias("harmed"),
    )


def prepared_review(candidates: DataFrame, confirmed: DataFrame) -> DataFrame:
    """One row per reference (link, else id): a confirmed case over a candidate, the last confirmed one, the first candidate; no stored prediction is kept.

    Both: ord, id, keyword, title, link, source, published_at, description, content; confirmed also gold_label, event_id, review_status, reviewed_by.
    """
    article = ["id", "keyword", "title", "link", "source", "published_at", "description", "content"]
    judged = ["gold_label", "event_id", "review_status", "reviewed_by"]
    reference = F.when(_value("link") != "", _value("link")).otherwise(F.col("id"))
    blank = {"gold_label": F.lit(""), "event_id": F.lit(""), "review_status": F.lit("pending"), "reviewed_by": F.lit("")}
    a = candidates.select(reference.alias("reference"), F.lit(0).alias("rank"), "ord", *article, *[blank[c].alias(c) for c in judged])
    b = confirmed.select(reference.alias("reference"), F.lit(1).alias("rank"), "ord", *article, *judged)
    both = a.unionByName(b)
    # first candidate, last confirmed
    best = F.struct("rank", F.when(F.col("rank") == 0, -F.col("ord")).otherwise(F.col("ord")))
    out = both.groupBy("reference").agg(F.max_by(F.struct(*article, *judged), best).alias("r"), F.max("rank").alias("from_confirmed"))
    return out.select("reference", "r.*", F.when(F.col("from_confirmed") == 1, "development").otherwise("").alias("split"))


def rule_holdout(df: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """For each development term (label, phrase): independent events it got right, rows it got wrong, matches of other topics.

    df: hits (array of label, phrase), gold_label, final_label, rule_applied, event_id.
    """
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(normalized(p)).alias("phrase")) for label, p in terms])
    each = df.select("gold_label", "final_label", "rule_applied", calibrate.event_key().alias("event"), F.explode(F.filter(pairs, lambda t: F.exists("hits", lambda h: (h["label"] == t["label"]) & (F.lower(h["phrase"]) == t["phrase"])))).alias("t"))
    used = F.col("rule_applied") & (F.col("final_label") == F.col("t.label"))
    own = F.col("gold_label") == F.col("t.label")
    return each.groupBy(F.col("t.label").alias("label"), F.col("t.phrase").alias("phrase")).agg(F.count_distinct(F.when(used & own & (F.col("event") != ""), F.col("event"))).alias("correct_events"), F.count_if(used & ~own).alias("wrong_rows"), F.count_if(~own).alias("other_topics"))


def rules_as_phrases(rules: RuleSet) -> list[tuple[str, str]]:
    return [(t.label, t.phrase) for t in rules.terms]
