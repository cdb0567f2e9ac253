"""The queries of this package over the driver's tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import values as V
from newsloom.operators import audit, calibrate, decide, dedup, extract, metrics, pipeline, predict, rules, scores
from newsloom.operators.ruleset import FAILED, REVIEW, Policy
from newsloom.sources import feeds, sinks

from . import articles as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LANGS = A.LABELS[:4]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def names(labels: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in labels)


SQUEEZED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"

# --- text ---------------------------------------------------------------------------------------------


@query(f"""WITH {A.ARTICLES}, t AS (SELECT ord, source, {SQUEEZED.format("title || ' - ' || source || '  | ' || upper(source)")} AS t FROM articles)
SELECT ord, trim(regexp_replace(t, '(?i)(?:\\s+[-|–—]\\s*' || source || '\\s*)+$', '')) AS title, lower(regexp_replace(trim(regexp_replace(t, '(?i)(?:\\s+[-|–—]\\s*' || source || '\\s*)+$', '')), '\\s+', '', 'g')) AS key FROM t""")
def clean_title_suffix(spark: SparkSession, d: str) -> DataFrame:
    a = A.articles(spark, d)
    long = F.concat("title", F.lit(" - "), "source", F.lit("  | "), F.upper("source"))
    stripped = T.strip_source_suffix(long, "source", entities=False)
    return a.select("ord", stripped.alias("title"), T.normalize_key(stripped, entities=False).alias("key"))


@query(f"""WITH {A.ARTICLES}, c AS (SELECT ord, {SQUEEZED.format("title")} AS t, {SQUEEZED.format("description")} AS d, {SQUEEZED.format("content")} AS b FROM articles)
SELECT ord, '기사제목: ' || left(t, 250) || CASE WHEN d <> '' THEN chr(10) || '기사설명: ' || left(d, 300) ELSE '' END || CASE WHEN b <> '' THEN chr(10) || '기사본문: ' || left(b, 500) ELSE '' END AS input,
  left({SQUEEZED.format("t || ' ' || b")}, 1200) AS prepared, left({SQUEEZED.format("t || ' ' || b")}, 1200) <> left(t, 1200) AS changed FROM c""")
def article_text_input(spark: SparkSession, d: str) -> DataFrame:
    a = A.articles(spark, d).withColumns({c: T.squeezed(c) for c in ("title", "description", "content")})
    both = F.concat("title", F.lit(" "), "content")
    return a.select("ord", T.model_input("title", "description", "content").alias("input"), T.prepared_input(both, entities=False).alias("prepared"), T.changed_input(F.col("title"), both, entities=False).alias("changed"))


_ND = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\[[^\\]]+\\]', ' ', 'g'), '\\([^)]*\\)', ' ', 'g'), '[\"''“”‘’]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH {A.ARTICLES}, n AS (SELECT ord, {_ND.format(SQUEEZED.format("description"))} AS x FROM articles)
SELECT ord, CASE WHEN len(regexp_extract_all(x, '[A-Za-z0-9가-힣]+')) >= 2 THEN x ELSE '' END AS description FROM n""")
def normalize_description(spark: SparkSession, d: str) -> DataFrame:
    return A.articles(spark, d).select("ord", T.normalize_description("description", entities=False).alias("description"))


@query(f"""WITH {A.ARTICLES}, n AS (SELECT ord, unnest(list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'))) AS number FROM articles) SELECT ord, number FROM n""")
def number_tokens(spark: SparkSession, d: str) -> DataFrame:
    return A.articles(spark, d).select("ord", F.explode(T.numbers("text")).alias("number"))


@query(f"WITH {A.ARTICLES}, c AS (SELECT unnest([{names(A.CUES)}]) AS cue) SELECT ord, cue FROM articles, c WHERE contains(title || ' ' || description, cue)")
def conflict_cues(spark: SparkSession, d: str) -> DataFrame:
    return A.articles(spark, d).select("ord", F.explode(T.conflict_cues(F.col("title"), F.col("description"), A.CUES)).alias("cue"))


@query(f"""WITH {A.ARTICLES} SELECT ord, CASE WHEN length({SQUEEZED.format("description")}) <= 60 THEN {SQUEEZED.format("description")} ELSE rtrim(left({SQUEEZED.format("description")}, 60)) || '...' END AS short,
  left(array_to_string(string_split_regex(regexp_replace({SQUEEZED.format("text")}, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' '), 500) AS lead FROM articles""")
def truncated_and_lead(spark: SparkSession, d: str) -> DataFrame:
    return A.articles(spark, d).select("ord", T.safe_truncate("description", 60, entities=False).alias("short"), T.lead_sentences(T.squeezed("text")).alias("lead"))


_TOK = "regexp_extract_all(lower(title), '[a-z0-9가-힣]+')"


@query(f"WITH {A.ARTICLES} SELECT ord, array_to_string({_TOK}, ' ') AS word_text, len(list_distinct({_TOK})) AS n_distinct FROM articles")
def title_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.tokens("title", fold=False)
    return A.articles(spark, d).select("ord", F.array_join(tokens, " ").alias("word_text"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


@query(f"""WITH {A.ARTICLES}, w AS (SELECT ord, list_sort(list_distinct({_TOK})) AS ws FROM articles WHERE len(list_distinct({_TOK})) >= 4)
SELECT a.ord AS ord_a, b.ord AS ord_b FROM w a JOIN w b ON a.ws = b.ws AND a.ord < b.ord""")
def word_set_compat(spark: SparkSession, d: str) -> DataFrame:
    a = A.articles(spark, d).select("ord", F.array_sort(F.array_distinct(T.tokens("title", fold=False))).alias("words")).where(F.size("words") >= 4)
    return pairs_of_sets(a, lambda x, y: T.compatible_words(x, y))


def pairs_of_sets(a: DataFrame, agree: Callable[[Column, Column], Column], block: int = 2_000) -> DataFrame:
    """ord_a < ord_b of a's rows (ord, words: sorted, different) whose sets agree. Sets are compared once for each two different ones that share
    canonical words, not once for each two rows; the rows of a set are dealt to blocks, so that no task has all pairs of a set that very many rows have."""
    a = dedup.written(a.withColumn("set", F.unhex(F.md5(F.array_join("words", " ").cast("binary")))))
    sets = a.groupBy("set").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64(T.canonical_words(F.col("words"))))
    sets = dedup.written(sets.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    other = sets.select("key", F.col("set").alias("set_b"), F.col("words").alias("words_b"), F.col("blocks").alias("blocks_b"))
    pairs = sets.join(other, "key").where((F.col("set") == F.col("set_b")) | agree(F.col("words"), F.col("words_b"))).select("set", "set_b", "blocks_b")
    left = a.join(pairs, "set").select(F.col("ord").alias("ord_a"), "set_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)).alias("block"))
    right = a.join(sets.select("set", "blocks"), "set").select(F.col("ord").alias("ord_b"), F.col("set").alias("set_b"), F.pmod(F.xxhash64("ord"), F.col("blocks")).cast("int").alias("block"))
    return left.hint("merge").join(right, ["set_b", "block"]).where(F.col("ord_a") < F.col("ord_b")).select("ord_a", "ord_b")


# --- values -------------------------------------------------------------------------------------------


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS zoned, 'not a date ' || event_id AS kept,
  CAST(epoch_us(date_trunc('second', ts) - INTERVAL 9 HOUR) AS BIGINT) AS zoned_us FROM events""")
def rss_dates(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").withColumn("t", F.date_format(F.col("ts").cast("timestamp"), "d MMM yyyy HH:mm:ss"))
    zoned = V.rss_datetime(F.concat("t", F.lit(" +0900")))
    return e.select("event_id", V.rss_datetime(F.concat(F.lit("Mon, "), "t", F.lit(" GMT"))).alias("utc"), zoned.alias("zoned"), V.rss_datetime(F.concat(F.lit("not a date "), F.col("event_id").cast("string"))).alias("kept"), F.unix_micros(V.published_time(zoned)).alias("zoned_us"))


@query(f"""WITH {A.ARTICLES} SELECT ord, left(sha256(lower(regexp_replace({SQUEEZED.format("title")}, '\\s+', '', 'g'))), 16) AS event_id, 'article-' || left(sha256(link), 16) AS by_link, 'article-' || left(sha256(title || '|' || source), 16) AS by_title
FROM articles WHERE trim(title) <> ''""")
def article_ids(spark: SparkSession, d: str) -> DataFrame:
    a = A.articles(spark, d).where(F.trim("title") != "")
    none = F.lit("")
    return a.select("ord", V.event_id("title", entities=False).alias("event_id"), V.article_id(none, F.col("link"), F.col("title"), F.col("source")).alias("by_link"), V.article_id(none, none, F.col("title"), F.col("source")).alias("by_title"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, regexp_replace(lower(host), '^www\\.', '') AS host, regexp_replace(path, '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: contains(x, '=') AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid)=') AND NOT suffix(x, '='))), '&') AS query,
  NOT regexp_matches(lower(host), '(^|\\.)(localhost|local|internal)$') AND contains(host, '.') AS public FROM u""")
def url_identity(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "pages")
    return p.select("page_id", V.url_identity("url").alias("u"), V.looks_public("url").alias("public")).select("page_id", "u.host", "u.path", "u.query", "public")


@query("SELECT DISTINCT source AS keyword, 'https://news.google.com/rss/search?q=' || url_encode(source || ' & ' || lang || ' when:7d') || '&hl=ko&gl=KR&ceid=KR:ko' AS url FROM documents")
def search_urls(spark: SparkSession, d: str) -> DataFrame:
    k = A.table(spark, d, "documents").select(F.col("source").alias("keyword"), F.concat("source", F.lit(" & "), "lang").alias("term")).distinct()
    return k.select("keyword", V.search_url("term").alias("url"))


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 13 = 0 THEN 'reset' ELSE '' END AS failure, 200 + CAST(event_id % 5 AS INTEGER) * 101 AS code FROM events)
SELECT event_id, CASE WHEN failure = 'timeout' THEN 'TIMEOUT' WHEN failure <> '' THEN 'REQUEST_FAILED' WHEN code IN (401, 403, 429, 451) THEN 'BLOCKED_HTTP' WHEN code >= 400 THEN 'HTTP_ERROR' ELSE 'SUCCESS' END AS status FROM s""")
def fetch_statuses(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return A.table(spark, d, "events").select("event_id", V.fetch_status(F.when(i % 11 == 0, "timeout").when(i % 13 == 0, "reset").otherwise(""), 200 + (i % 5).cast("int") * 101).alias("status"))


_P = "TRY_CAST(trim(x) AS DOUBLE)"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || l_discount WHEN 2 THEN CAST(l_quantity AS VARCHAR) ELSE 'n/a' END AS x FROM lineitem)
SELECT l_linenumber, count(*) AS rows, count(CASE WHEN {_P} BETWEEN 0 AND 1 THEN 1 END) AS valid, round(coalesce(sum(CASE WHEN {_P} BETWEEN 0 AND 1 THEN {_P} END), 0), 4) AS total FROM t GROUP BY 1""")
def probability_values(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    x = F.when(n == 0, "").when(n == 1, F.concat(F.lit(" "), F.col("l_discount").cast("string"))).when(n == 2, F.col("l_quantity").cast("string")).otherwise("n/a")
    t = A.table(spark, d, "lineitem").select("l_linenumber", V.probability(x).alias("p"))
    return t.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("rows"), F.count("p").alias("valid"), F.round(F.coalesce(F.sum("p"), F.lit(0.0)), 4).alias("total"))


# --- rules and decisions ------------------------------------------------------------------------------


@query(f"WITH {A.ARTICLES}, {A.SCORES} SELECT ord, label, score, matches, strong FROM scores")
def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    return A.ranked(spark, d).select("ord", F.explode("ranking").alias("r")).select("ord", "r.label", "r.score", "r.matches", "r.strong")


@query(f"WITH {A.ARTICLES}, {A.SCORES} SELECT ord, label, score, matches, strong FROM scores")
def rule_scores_kept(spark: SparkSession, d: str) -> DataFrame:
    """The same from a table of rankings that grows run by run: first the articles of one language, then all, of which only the others are ranked anew."""
    dedup.written(spark.range(1))  # sets the folder that the session names
    folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="newsloom-")
    table = scores.ScoreTable(f"{folder}/scores-{uuid.uuid4().hex}", A.rule_set(), lambda df, rs: rules.rank(df, F.col("rule_text"), rs), ("rule_text",))
    texts = A.articles(spark, d).select("ord", "keyword", A.body().alias("rule_text"))
    table.ranked(texts.where(F.col("keyword") == "en"))
    full, _ = table.ranked(texts)
    return full.select("ord", F.explode("ranking").alias("r")).select("ord", "r.label", "r.score", "r.matches", "r.strong")


@query(f"WITH {A.ARTICLES}, {A.SCORES} SELECT b.ord, best, s1, s2, rule_margin, (SELECT count(*) FROM scores s WHERE s.ord = b.ord AND s.score = b.s1) AS tied FROM best b")
def rule_ranking(spark: SparkSession, d: str) -> DataFrame:
    first, second = F.get("ranking", 0), F.get("ranking", 1)
    return A.ranked(spark, d).select("ord", first["label"].alias("best"), first["score"].alias("s1"), second["score"].alias("s2"), "rule_margin", F.size("tied_labels").cast("long").alias("tied"))


@query(f"WITH {A.ARTICLES}, {A.SCORES} SELECT CASE WHEN s1 >= 2 AND rule_margin >= 1 THEN best ELSE '{REVIEW}' END AS final_category, count(*) AS n FROM best GROUP BY 1")
def rule_only_counts(spark: SparkSession, d: str) -> DataFrame:
    r = A.ranked(spark, d)
    return metrics.category_counts(r.select(decide.rule_only(r, A.rule_set()).alias("final_category")), "final_category")


@query(f"""WITH {A.ARTICLES}, {A.PREDICTED} SELECT ord, max(CASE WHEN place = 1 THEN label END) AS pred_label, round(max(CASE WHEN place = 1 THEN score END), 6) AS pred_score,
  round(max(CASE WHEN place = 1 THEN score END) - max(CASE WHEN place = 2 THEN score END), 6) AS pred_margin, string_agg(label, ', ' ORDER BY place) AS top FROM placed WHERE place <= 3 GROUP BY ord""")
def topk_prediction(spark: SparkSession, d: str) -> DataFrame:
    p = A.predicted(A.articles(spark, d))
    return p.select("ord", "pred_label", F.round("pred_score", 6).alias("pred_score"), F.round("pred_margin", 6).alias("pred_margin"), F.array_join("pred_top_labels", ", ").alias("top"))


@query(f"""WITH {A.ARTICLES}, {A.PREDICTED} SELECT CASE WHEN pred_score >= 0.7 AND pred_margin >= 0.1 THEN '높음' WHEN pred_score >= 0.5 AND pred_margin >= 0.05 THEN '보통' ELSE '낮음' END AS tier,
  pred_score < 0.5 OR pred_margin < 0.05 AS ambiguous, count(*) AS n FROM pred GROUP BY 1, 2""")
def confidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    p, s, m = A.predicted(A.articles(spark, d)), F.col("pred_score"), F.col("pred_margin")
    return p.groupBy(decide.confidence_tier(s, m).alias("tier"), decide.is_ambiguous(s, m).alias("ambiguous")).agg(F.count(F.lit(1)).alias("n"))


_DECIDED = f"WITH {A.ARTICLES}, {A.SCORES}, {A.PREDICTED}, {A.decision_sql()}"


@query(f"""{_DECIDED} SELECT ord, pred_label, final_label, applied, best, m1 AS matches, CASE WHEN final_label = '{REVIEW}' THEN 'REVIEW' WHEN applied THEN 'RULE' ELSE 'MODEL' END AS decision_source,
  CASE WHEN final_label = '{REVIEW}' THEN 'REVIEW_REQUIRED' ELSE 'DECIDED' END AS status, final_label = '{REVIEW}' AS review_required FROM decided""")
def hybrid_decision(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("decision")
    return A.decided(spark, d).select(
        "ord", "pred_label", x["final_label"].alias("final_label"), x["rule_applied"].alias("applied"), x["rule_best_label"].alias("best"), x["rule_match_count"].alias("matches"),
        decide.decision_source(x["final_label"], x["rule_applied"]).alias("decision_source"), decide.decision_status(x["final_label"]).alias("status"), decide.review_required(x["final_label"]).alias("review_required"),
    )


@query(f"""{_DECIDED} SELECT CASE row WHEN 7 THEN CASE WHEN s1 = 0 THEN 'no_rule_evidence' WHEN s1 < 2 THEN 'insufficient_rule_score' ELSE 'insufficient_rule_margin' END WHEN 6 THEN 'other_recorded_reason' WHEN 2 THEN 'other_recorded_reason' ELSE 'reason_not_recorded' END AS bucket,
  CASE WHEN row = 6 THEN '규칙 보정: ' || best || ' 규칙 점수 ' || s1 || ', 근거 ' || m1 || '개, 2위 대비 +' || rule_margin ELSE '' END AS reason, count(*) AS n FROM decided GROUP BY 1, 2""")
def decision_reasons(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("decision")
    shown = F.when(F.startswith(x["rule_reason"], F.lit("규칙 보정")), F.regexp_replace(x["rule_reason"], r" \([^)]*\)$", "")).otherwise("")
    return A.decided(spark, d).groupBy(decide.reason_bucket(x["rule_reason"], x["final_label"]).alias("bucket"), shown.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- grouping -----------------------------------------------------------------------------------------


@query(f"""WITH {A.ARTICLES}, k AS (SELECT ord, lower(regexp_replace(title, '\\s+', '', 'g')) AS tk, source FROM articles)
SELECT min(ord) AS rep, count(*) AS n, count(*) - 1 AS n_references FROM k WHERE tk <> '' GROUP BY tk, source""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    a = A.articles(spark, d).select("ord", T.normalize_key("title", entities=False).alias("title_key"), "source").where("title_key <> ''")
    return a.groupBy("title_key", "source").agg(F.min("ord").alias("rep"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - 1).alias("n_references")).drop("title_key", "source")


def _stories(spark: SparkSession, d: str) -> DataFrame:
    return A.articles(spark, d).select("ord", "keyword", "title", "source", "link", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), "description", F.lit("").alias("content"))


@query()
def dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Complete-link groups within 48 hours: ordered first fit has no SQL form; tests compare with a plain loop."""
    return dedup.deduplicate(_stories(spark, d), entities=False, fold=False).select("ord", "group_article_count", F.transform("related_articles", lambda r: r["link"]).alias("references"))


@query("""WITH RECURSIVE a AS (SELECT source, doc_id AS ord, (doc_id * 7919) % 997 AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
r AS (SELECT DISTINCT source, 0::BIGINT AS place, []::STRUCT(rep BIGINT, lo BIGINT, hi BIGINT)[] AS gs, NULL::BIGINT AS ord, NULL::BIGINT AS rep FROM a UNION ALL
  SELECT source, place, CASE WHEN k IS NULL THEN list_append(gs, {'rep': ord, 'lo': h, 'hi': h}) ELSE list_transform(gs, lambda g: CASE WHEN g.rep = k THEN {'rep': g.rep, 'lo': least(g.lo, h), 'hi': greatest(g.hi, h)} ELSE g END) END, ord, coalesce(k, ord) FROM (
    SELECT a.source, a.place, a.ord, a.h, r.gs, list_filter(r.gs, lambda g: a.h >= g.hi - 48 AND a.h <= g.lo + 48)[1].rep AS k FROM r JOIN a ON a.source IS NOT DISTINCT FROM r.source AND a.place = r.place + 1))
SELECT ord, rep FROM r WHERE ord IS NOT NULL""")
def first_fit_48h(spark: SparkSession, d: str) -> DataFrame:
    """Reports of one title by each source, out of order in time: each joins the first group all of whose members are within 48 hours. Components of
    over 20 are cut into spans of ten days, which need rounds."""
    a = A.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.xxhash64("source").alias("comp"), F.coalesce("source", F.lit("")).alias("source_key"), ((F.col("doc_id") * 7919) % 997 * F.lit(3_600_000_000)).alias("us"))
    none, key = F.array().cast("array<string>"), F.col("comp")
    given = {"title_key": F.lit("t"), "source_key": F.col("source_key"), "us": F.col("us"), "exact": key, "near": key, "shown_title": F.lit("t"), "cues": none, "words": none, "n_distinct": F.lit(1), "word_text": F.lit("t"), "numbers": none,
             "description_words": none, "description_numbers": none, "description_text": F.lit("")}
    original = F.struct(*[given[c].alias(c) for c in dedup.ORIGINAL])
    return dedup.first_fit(a.select("comp", "ord", F.col("us").alias("at"), F.lit(False).alias("undated"), F.array(original).alias("originals")), whole=20, span_hours=240)


def pairs_48h(a: DataFrame, keys: list[str], at: str, id_: str) -> DataFrame:
    """Pairs of a's rows that agree on keys and are at most 48 hours apart, the other's columns with ``_b``. Time is cut into
    spans of 48 hours, which are part of the join key: a key that very many rows have is spread over its spans."""
    span = F.floor(F.unix_micros(at) / F.lit(48 * 3600 * 1_000_000))
    left = a.withColumn("span", span)
    right = a.select(*[F.col(c).alias(c if c in keys else f"{c}_b") for c in a.columns], F.explode(F.array(span - 1, span, span + 1)).alias("span"))
    return left.join(right, [*keys, "span"]).where((F.col(id_) < F.col(f"{id_}_b")) & V.within_hours(F.col(at), F.col(f"{at}_b"))).drop("span")


@query(f"""WITH {A.ARTICLES}, k AS (SELECT ord, lower(regexp_replace(title, '\\s+', '', 'g')) AS tk, source, published FROM articles)
SELECT a.ord AS ord_a, b.ord AS ord_b, a.source = b.source AS same_source FROM k a JOIN k b ON a.tk = b.tk AND a.ord < b.ord AND a.tk <> '' AND b.published BETWEEN a.published - INTERVAL 48 HOUR AND a.published + INTERVAL 48 HOUR""")
def same_title_48h(spark: SparkSession, d: str) -> DataFrame:
    a = A.articles(spark, d).select("ord", T.normalize_key("title", entities=False).alias("key"), "source", "published").where("key <> ''")
    return pairs_48h(a, ["key"], "published", "ord").select(F.col("ord").alias("ord_a"), "ord_b", (F.col("source") == F.col("source_b")).alias("same_source"))


@query("""SELECT a.event_type, count(*) AS pairs, min(abs(epoch_us(b.ts) - epoch_us(a.ts))) AS nearest_us FROM events a JOIN events b
  ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND b.ts BETWEEN a.ts - INTERVAL 48 HOUR AND a.ts + INTERVAL 48 HOUR GROUP BY 1""")
def event_pairs_48h(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    pairs = pairs_48h(e, ["user_id", "event_type"], "ts", "event_id")
    return pairs.groupBy("event_type").agg(F.count(F.lit(1)).alias("pairs"), F.min(F.abs(F.unix_micros("ts_b") - F.unix_micros("ts"))).alias("nearest_us"))


# --- metrics ------------------------------------------------------------------------------------------

METHODS = ["model", "rules", "hybrid"]
_LONG = f"""{_DECIDED}, base AS (SELECT a.keyword AS gold, a.source AS keyword, d.* EXCLUDE (row) FROM decided d JOIN articles a ON a.ord = d.ord),
long AS (SELECT gold, keyword, 'model' AS method, pred_label AS pred FROM base UNION ALL SELECT gold, keyword, 'rules', CASE WHEN s1 >= 2 AND rule_margin >= 1 THEN best ELSE '{REVIEW}' END FROM base UNION ALL SELECT gold, keyword, 'hybrid', final_label FROM base)"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    x = A.decided(spark, d)
    preds = {"model": F.col("pred_label"), "rules": decide.rule_only(x, A.rule_set()), "hybrid": F.col("decision.final_label")}
    x = dedup.written(x.select("gold", "source", *[p.alias(m) for m, p in preds.items()]))  # few short columns, read several times
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("pred")) for m in preds])
    return x.select("gold", F.col("source").alias("keyword"), F.explode(each).alias("m")).select("gold", "keyword", "m.method", "m.pred")


@query(f"""{_LONG}, g AS (SELECT unnest([{names(A.LABELS)}]) AS gold), p AS (SELECT unnest([{names([*A.LABELS, REVIEW, FAILED, "기타"])}]) AS pred),
c AS (SELECT gold, pred, count(*) AS n FROM long WHERE method = 'hybrid' GROUP BY 1, 2) SELECT g.gold, p.pred, coalesce(n, 0) AS n FROM g CROSS JOIN p LEFT JOIN c ON c.gold = g.gold AND c.pred = p.pred""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_long(spark, d).where("method = 'hybrid'"), A.LABELS)


_CLASS = f"""ls AS (SELECT unnest([{names(A.LABELS)}]) AS label),
pc AS (SELECT {{by}} label, count(CASE WHEN gold = label AND pred = label THEN 1 END) AS tp, count(CASE WHEN gold = label THEN 1 END) AS support, count(CASE WHEN pred = label THEN 1 END) AS predicted FROM long, ls GROUP BY {{by}} label),
pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM pc),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


@query(f"{_LONG}, {_CLASS.format(by='method,')} SELECT method, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.per_class(_long(spark, d), A.LABELS, ["method"])
    return m.select("method", "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


_OVERALL = f"""count(*) AS total, round(count(CASE WHEN pred IN ({names(A.LABELS)}) AND gold = pred THEN 1 END) / count(*), 6) AS accuracy, round(count(CASE WHEN pred IN ({names(A.LABELS)}) THEN 1 END) / count(*), 6) AS coverage,
  count(CASE WHEN pred = '{REVIEW}' THEN 1 END) AS review_count, count(CASE WHEN pred IN ({names(A.LABELS)}) AND gold <> pred THEN 1 END) AS wrong_decided_count"""


@query(f"""{_LONG}, {_CLASS.format(by='method,')}, o AS (SELECT method, {_OVERALL} FROM long GROUP BY method), ma AS (SELECT method, round(sum(f1) / {len(A.LABELS)}, 6) AS macro_f1 FROM f GROUP BY method) SELECT o.*, macro_f1 FROM o JOIN ma ON o.method = ma.method""")
def overall_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.overall(_long(spark, d), A.LABELS, ["method"])
    return m.select("method", "total", F.round("accuracy", 6).alias("accuracy"), F.round("coverage", 6).alias("coverage"), "review_count", "wrong_decided_count", F.round("macro_f1", 6).alias("macro_f1"))


@query(f"{_LONG} SELECT keyword, method, {_OVERALL} FROM long GROUP BY 1, 2")
def per_keyword_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.overall(_long(spark, d), A.LABELS, ["keyword", "method"])
    return m.select("keyword", "method", "total", F.round("accuracy", 6).alias("accuracy"), F.round("coverage", 6).alias("coverage"), "review_count", "wrong_decided_count")


@query(f"""{_LONG}, x AS (SELECT *, applied AND pred_label <> final_label AS changed FROM base) SELECT count(CASE WHEN applied THEN 1 END) AS rule_applied_count, count(CASE WHEN changed THEN 1 END) AS rule_changed_count,
  count(CASE WHEN applied AND gold <> final_label THEN 1 END) AS wrong_rule_count, count(CASE WHEN changed AND pred_label <> gold AND final_label = gold THEN 1 END) AS corrected_count, count(CASE WHEN changed AND pred_label = gold AND final_label <> gold THEN 1 END) AS harmful_change_count FROM x""")
def rule_corrections(spark: SparkSession, d: str) -> DataFrame:
    x = A.decided(spark, d).select("gold", F.col("pred_label").alias("model"), F.col("decision.final_label").alias("pred"), F.col("decision.rule_applied").alias("applied"))
    return metrics.rule_corrections(x).drop("wrong_rule_rate")


@query(f"""{_LONG} SELECT method, count(CASE WHEN gold <> 'en' THEN 1 END) AS other_support, count(CASE WHEN gold <> 'en' AND pred = 'en' THEN 1 END) AS false_positive_count,
  round(count(CASE WHEN gold <> 'en' AND pred = 'en' THEN 1 END) / count(CASE WHEN gold <> 'en' THEN 1 END), 6) AS false_positive_rate, count(CASE WHEN pred = 'en' THEN 1 END) AS predicted_count FROM long GROUP BY 1""")
def bias_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.label_bias(_long(spark, d), "en", ["method"])
    return m.withColumn("false_positive_rate", F.round("false_positive_rate", 6))


# --- calibration --------------------------------------------------------------------------------------

# Scores rounded to a few steps, so that the grid stays a grid.
_SAMPLES = f"""{_DECIDED}, relaxed_rows AS (SELECT ord, CASE WHEN row = 7 THEN pred_label ELSE final_label END AS relaxed FROM decided),
samples AS (SELECT d.ord, a.keyword AS gold, a.source AS keyword, left(sha256(lower(regexp_replace(title, '\\s+', '', 'g'))), 16) AS event_id, round(floor(pred_score * 20) / 20, 2) AS score, round(floor(pred_margin * 20) / 20, 2) AS margin,
  pred_label = a.keyword AS correct, final_label AS before, relaxed AS after FROM decided d JOIN articles a ON a.ord = d.ord JOIN relaxed_rows r ON r.ord = d.ord)"""


_RAW = _SAMPLES.replace("round(floor(pred_score * 20) / 20, 2)", "pred_score").replace("round(floor(pred_margin * 20) / 20, 2)", "pred_margin")


def _samples(spark: SparkSession, d: str, steps: int | None = 20) -> DataFrame:
    x = A.decided(spark, d)
    open_ = decide.decision(A.rule_set(), Policy(review_model_score=0.0, ambiguity_score=0.0, ambiguity_margin=0.0))["final_label"]
    step = lambda c: F.round(F.floor(F.col(c) * steps) / steps, 2) if steps else F.col(c)
    event = F.substring(F.sha2(F.lower(F.regexp_replace("title", "\\s+", "")), 256), 1, 16)
    return dedup.written(x.select("ord", "gold", F.col("source").alias("keyword"), event.alias("event_id"), step("pred_score").alias("score"), step("pred_margin").alias("margin"), (F.col("pred_label") == F.col("gold")).alias("correct"), F.col("decision.final_label").alias("before"), open_.alias("after")))


_W = "CASE WHEN {n} = 0 THEN 0.0 ELSE ({c} / {n} + 1.9208 / {n} - 1.96 * sqrt({c} / {n} * (1 - {c} / {n}) / {n} + 0.9604 / ({n} * {n}))) / (1 + 3.8416 / {n}) END"
_GRID = f"""gs AS (SELECT DISTINCT score FROM samples), gm AS (SELECT DISTINCT margin FROM samples),
gr AS (SELECT gs.score, gm.margin, count(*) AS support, count(CASE WHEN correct THEN 1 END) AS c FROM gs, gm, samples s WHERE s.score >= gs.score AND s.margin >= gm.margin GROUP BY 1, 2),
grid AS (SELECT score, margin, support, support / (SELECT count(*) FROM samples) AS coverage, c / support AS accuracy, {_W.format(n='support', c='c')} AS lower_bound FROM gr)"""


@query(f"{_SAMPLES}, {_GRID} SELECT score, margin, support, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy, round(lower_bound, 6) AS lower_bound FROM grid WHERE support >= 15 AND lower_bound >= 0.6")
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    g = calibrate.threshold_grid(_samples(spark, d), 0.6, 15)
    return g.select("score", "margin", "support", *[F.round(c, 6).alias(c) for c in ("coverage", "accuracy", "lower_bound")])


@query(f"{_RAW}, {_GRID} SELECT round(score, 9) AS score, round(margin, 9) AS margin, support, round(accuracy, 6) AS accuracy FROM grid WHERE support >= 15 AND lower_bound >= 0.6 ORDER BY support DESC, lower_bound DESC, accuracy DESC, score, margin LIMIT 1")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Over the scores as they are."""
    best = calibrate.best_threshold(calibrate.threshold_grid(_samples(spark, d, None), 0.6, 15, best=True))
    return best.select(F.round("score", 9).alias("score"), F.round("margin", 9).alias("margin"), "support", F.round("accuracy", 6).alias("accuracy"))


@query(f"""{_SAMPLES}, {_GRID}, h AS (SELECT score AS hs, margin AS hm, support AS hn, coverage AS hcov, accuracy AS ha, lower_bound AS hb FROM grid WHERE support >= 15 AND lower_bound >= 0.8),
lr AS (SELECT h.*, gs.score AS ms, gm.margin AS mm, count(*) AS support, count(CASE WHEN correct THEN 1 END) AS c FROM h, gs, gm, samples s
  WHERE gs.score <= hs AND gm.margin <= hm AND s.score >= gs.score AND s.margin >= gm.margin AND NOT (s.score >= hs AND s.margin >= hm) GROUP BY ALL),
lo AS (SELECT *, c / support AS ma, {_W.format(n='support', c='c')} AS mb FROM lr)
SELECT hs AS high_score, hm AS high_margin, hn AS high_support, round(hb, 6) AS high_lower_bound, ms AS medium_score, mm AS medium_margin, support AS medium_support, round(mb, 6) AS medium_lower_bound FROM
(SELECT *, row_number() OVER (PARTITION BY hs, hm ORDER BY support DESC, mb DESC, ma DESC, ms, mm) AS place FROM lo WHERE support >= 15 AND mb >= 0.6) WHERE place = 1 ORDER BY hn + support DESC, hn DESC, hb DESC, mb DESC, hs, hm LIMIT 1""")
def confidence_pair(spark: SparkSession, d: str) -> DataFrame:
    """High and medium thresholds together."""
    t = calibrate.tiers(_samples(spark, d), 0.80, 0.60)
    return t.select("high_score", "high_margin", "high_support", F.round("high_lower_bound", 6).alias("high_lower_bound"), "medium_score", "medium_margin", "medium_support", F.round("medium_lower_bound", 6).alias("medium_lower_bound"))


_EV = f"""ev AS (SELECT keyword, event_id, count(*) AS rows, count(CASE WHEN before <> '{REVIEW}' THEN 1 END) AS n, count(CASE WHEN before <> '{REVIEW}' AND before = gold THEN 1 END) AS r FROM samples GROUP BY 1, 2),
es AS (SELECT keyword, sum(rows) AS total, sum(n) AS support, sum(r) AS correct, count(CASE WHEN n > 0 THEN 1 END) AS independent_support, count(CASE WHEN n > 0 AND n = r THEN 1 END) AS independent_correct FROM ev GROUP BY 1)"""


@query(f"{_SAMPLES}, {_EV} SELECT keyword, CAST(total AS BIGINT) AS total, CAST(support AS BIGINT) AS support, CAST(correct AS BIGINT) AS correct, independent_support, independent_correct, round({_W.format(n='independent_support', c='independent_correct')}, 6) AS lower_bound FROM es")
def evidence_wilson(spark: SparkSession, d: str) -> DataFrame:
    e = calibrate.evidence(_samples(spark, d), "before", LANGS, ["keyword"])
    return e.select("keyword", "total", "support", "correct", "independent_support", "independent_correct", F.round("lower_bound", 6).alias("lower_bound"))


@query(f"""{_SAMPLES} SELECT keyword, count(*) AS total, count(CASE WHEN before <> '{REVIEW}' THEN 1 END) AS baseline_support, count(CASE WHEN after <> '{REVIEW}' THEN 1 END) AS selected_support,
  count(CASE WHEN before = '{REVIEW}' AND after <> '{REVIEW}' THEN 1 END) AS new_support, count(CASE WHEN before = '{REVIEW}' AND after = gold THEN 1 END) AS new_correct,
  count(CASE WHEN before <> '{REVIEW}' AND before <> after THEN 1 END) AS previous_changed, count(CASE WHEN before = gold AND after <> gold THEN 1 END) AS previous_harmed FROM samples GROUP BY 1""")
def policy_compare(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.compare(_samples(spark, d), A.LABELS, ["keyword"])


_OPEN = f"""opened AS (SELECT *, before = '{REVIEW}' AND after <> '{REVIEW}' AND score > 0 AND margin > 0 AS can FROM samples),
ps AS (SELECT DISTINCT score AS ps FROM opened WHERE can AND score <= 0.5 UNION SELECT 0.5), pm AS (SELECT DISTINCT margin AS pm FROM opened WHERE can AND margin <= 0.05 UNION SELECT 0.05),
sel AS (SELECT ps, pm, o.*, CASE WHEN can AND score >= ps AND margin >= pm THEN after ELSE before END AS chosen FROM ps, pm, opened o WHERE NOT (ps = 0.5 AND pm = 0.05)),
pe AS (SELECT ps, pm, event_id, count(CASE WHEN chosen <> '{REVIEW}' THEN 1 END) AS n, count(CASE WHEN chosen <> '{REVIEW}' AND chosen = gold THEN 1 END) AS r, count(CASE WHEN before = '{REVIEW}' AND chosen <> '{REVIEW}' THEN 1 END) AS nn, count(CASE WHEN before = '{REVIEW}' AND chosen <> '{REVIEW}' AND chosen = gold THEN 1 END) AS nr FROM sel GROUP BY 1, 2, 3),
gp AS (SELECT ps, pm, sum(n) AS selected_support, sum(nn) AS new_support, count(CASE WHEN n > 0 THEN 1 END) AS se, count(CASE WHEN n > 0 AND n = r THEN 1 END) AS sr, count(CASE WHEN nn > 0 THEN 1 END) AS ne, count(CASE WHEN nn > 0 AND nn = nr THEN 1 END) AS nre FROM pe GROUP BY 1, 2)"""


@query(f"""{_SAMPLES.replace("* 20) / 20", "* 100) / 100")}, {_OPEN} SELECT ps AS score, pm AS margin, CAST(selected_support AS BIGINT) AS selected_support, CAST(new_support AS BIGINT) AS new_support, se AS selected_events, round({_W.format(n='se', c='sr')}, 6) AS selected_lower_bound, ne AS new_events, round({_W.format(n='ne', c='nre')}, 6) AS new_lower_bound FROM gp WHERE new_support > 0""")
def decision_grid(spark: SparkSession, d: str) -> DataFrame:
    # finer steps: margins under the gate of 0.05 are what there is to open
    g = calibrate.decision_grid(_samples(spark, d, 100).withColumnRenamed("after", "relaxed"), A.LABELS)
    return g.select("score", "margin", "selected_support", "new_support", "selected_events", F.round("selected_lower_bound", 6).alias("selected_lower_bound"), "new_events", F.round("new_lower_bound", 6).alias("new_lower_bound"))


@query(f"""{_SAMPLES} SELECT gold, count(*) AS total, count(CASE WHEN before = '{REVIEW}' THEN 1 END) AS review_before, count(CASE WHEN after = '{REVIEW}' THEN 1 END) AS review_after, count(CASE WHEN before = '{REVIEW}' AND after <> '{REVIEW}' THEN 1 END) AS newly_automatic,
  count(CASE WHEN before = '{REVIEW}' AND after <> '{REVIEW}' AND after <> gold THEN 1 END) AS newly_wrong, count(DISTINCT CASE WHEN before = '{REVIEW}' AND after <> '{REVIEW}' THEN event_id END) AS newly_events FROM samples GROUP BY 1""")
def review_reduction(spark: SparkSession, d: str) -> DataFrame:
    return audit.review_reduction(_samples(spark, d), A.LABELS, ["gold"]).drop("new_wrong_decisions", "harmed")


# --- datasets and audits ------------------------------------------------------------------------------


@query(f"""WITH {A.CASES} SELECT 'event' AS kind, event_id AS key FROM cases GROUP BY event_id HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'keyword', keyword FROM cases GROUP BY keyword HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'link', link FROM cases GROUP BY link HAVING count(DISTINCT split) > 1""")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    c = A.cases(spark, d)
    kinds = {"event": calibrate.event_key(), "keyword": T.normalize_key("keyword", entities=False), "link": F.trim("link")}
    out = None
    for kind, key in kinds.items():
        part = audit.crossing(c, key).select(F.lit(kind).alias("kind"), "key")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {A.CASES}, l AS (SELECT unnest([{names(A.LABELS)}]) AS label) SELECT label FROM l WHERE label NOT IN (SELECT gold_label FROM cases WHERE review_status = 'confirmed')")
def missing_labels(spark: SparkSession, d: str) -> DataFrame:
    got = A.cases(spark, d).where("review_status = 'confirmed'").select(F.col("gold_label").alias("label"))
    return metrics.label_frame(got, A.LABELS).join(got, "label", "left_anti")


@query(f"""WITH {A.CASES}, u AS (SELECT event_id AS reference, 0 AS rank, -ord AS o, id, gold_label, FALSE AS c FROM cases UNION ALL SELECT event_id, 1, ord, id, gold_label, TRUE FROM cases WHERE review_status = 'confirmed' AND reviewed_by <> '')
SELECT reference, id, CASE WHEN c THEN gold_label ELSE '' END AS gold_label, CASE WHEN c THEN 'development' ELSE '' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY rank DESC, o DESC) AS n FROM u) WHERE n = 1""")
def confirmed_override(spark: SparkSession, d: str) -> DataFrame:
    c = A.cases(spark, d).withColumns({"link": F.col("event_id"), "published_at": F.lit("")})
    return audit.prepared_review(c, c.where("review_status = 'confirmed' and reviewed_by <> ''")).select("reference", "id", "gold_label", "split")


_CHECKS = {
    "article_title": f"{SQUEEZED.format('title')} <> ''", "article_link": "link <> ''", "confirmed_gold": f"review_status = 'confirmed' AND reviewed_by <> '' AND gold_label IN ({names(A.LABELS)})", "explicit_event_id": "event_id <> ''",
    "event_confirmation": "independent_event_check = 'confirmed'", "main_event": f"{SQUEEZED.format('main_event')} <> ''", "main_event_evidence": f"{SQUEEZED.format('main_event_evidence')} <> ''", "no_suggested_label": "suggested_label = ''",
}


@query(f"WITH {A.CASES} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS field, count(CASE WHEN NOT ({v}) THEN 1 END) AS n FROM cases" for k, v in _CHECKS.items()) + ") WHERE n > 0")
def readiness_missing(spark: SparkSession, d: str) -> DataFrame:
    return audit.readiness(A.cases(spark, d), A.LABELS, entities=False)[0]


@query(f"WITH {A.CASES} SELECT split, gold_label, count(DISTINCT event_id) AS events FROM cases WHERE " + " AND ".join(f"({v})" for v in _CHECKS.values()) + " GROUP BY 1, 2")
def readiness_events(spark: SparkSession, d: str) -> DataFrame:
    return audit.readiness(A.cases(spark, d), A.LABELS, entities=False)[1]


_EXCLUDED = f"CASE WHEN gold_label = '' THEN 'missing_gold_label' WHEN gold_label NOT IN ({names(['en', 'fr', 'de'])}) THEN 'invalid_gold_label' WHEN review_status <> 'confirmed' THEN 'not_confirmed' WHEN reviewed_by = '' THEN 'missing_reviewer' WHEN suggested_label <> '' THEN 'suggested_label_present' END"


@query(f"WITH {A.CASES} SELECT coalesce({_EXCLUDED}, 'counted') AS reason, count(*) AS n FROM cases GROUP BY 1")
def gold_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return A.cases(spark, d).groupBy(F.coalesce(audit.gold_exclusion(["en", "fr", "de"]), F.lit("counted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.CASES} SELECT gold_label AS label, count(*) AS articles, count(DISTINCT event_id) AS events, 0::BIGINT AS without_event, count(DISTINCT keyword) AS keywords FROM cases WHERE {_EXCLUDED} IS NULL GROUP BY 1")
def gold_coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.gold_coverage(A.cases(spark, d), ["en", "fr", "de"])


_STORED = f"""{_DECIDED}, st AS (SELECT a.source AS keyword, pred_label AS model_category, final_label, row, s1, round(pred_score, 4) AS score, round(pred_margin, 4) AS margin, trim(content) <> '' AS body FROM decided d JOIN articles a ON a.ord = d.ord)"""
_REV = f"final_label = '{REVIEW}'"


@query(f"""{_STORED} SELECT keyword, model_category, count(*) AS articles, count(CASE WHEN {_REV} THEN 1 END) AS review_required, round(count(CASE WHEN {_REV} THEN 1 END) / count(*), 6) AS review_rate, count(CASE WHEN {_REV} AND s1 = 0 THEN 1 END) AS no_rule_evidence,
  count(CASE WHEN {_REV} AND s1 = 1 THEN 1 END) AS insufficient_rule_score, count(CASE WHEN score < 0.5 THEN 1 END) AS low_scores, min(score) AS min_score, max(score) AS max_score, round(avg(score), 4) AS mean_score,
  count(CASE WHEN {_REV} AND score < 0.5 AND margin < 0.05 THEN 1 END) AS review_low_both, count(CASE WHEN body THEN 1 END) AS with_body FROM st GROUP BY GROUPING SETS ((), (keyword), (model_category))""")
def review_audit_rollup(spark: SparkSession, d: str) -> DataFrame:
    x, r = A.decided(spark, d), F.col("decision")
    stored = x.select(
        F.col("source").alias("keyword"), F.col("pred_label").alias("model_category"), r["final_label"].alias("final_category"), decide.decision_status(r["final_label"]).alias("final_decision_status"),
        decide.decision_source(r["final_label"], r["rule_applied"]).alias("decision_source"), F.lit("").alias("review_required"), r["rule_reason"].alias("rule_reason"),
        F.round("pred_score", 4).cast("string").alias("model_score"), F.round("pred_margin", 4).cast("string").alias("score_margin"), "content",
    )
    out = audit.review_rollup(stored, A.LABELS)
    return out.select("keyword", "model_category", "articles", "review_required", F.round("review_rate", 6).alias("review_rate"), "no_rule_evidence", "insufficient_rule_score", "low_scores", "min_score", "max_score", F.round("mean_score", 4).alias("mean_score"), "review_low_both", "with_body")


PHRASES = [("fr", "les"), ("fr", "dans"), ("de", "nicht"), ("de", "sich"), ("es", "para"), ("es", "los")]
_PH = ", ".join(f"('{a}', '{b}')" for a, b in PHRASES)


@query(f"""WITH {A.CASES}, ph(label, phrase) AS (VALUES {_PH}), m AS (SELECT c.*, p.label, p.phrase FROM cases c JOIN ph p ON regexp_matches(lower(title), '(^|[^A-Za-z0-9])' || p.phrase || '([^A-Za-z0-9]|$)')),
q AS (SELECT *, split = 'development' AND review_status = 'confirmed' AND gold_label = label AND reviewed_by <> '' AND suggested_label = '' AS ok FROM m)
SELECT label, phrase, count(*) AS articles, count(CASE WHEN ok THEN 1 END) AS confirmed_rows, count(DISTINCT CASE WHEN ok THEN event_id END) AS events FROM q GROUP BY 1, 2""")
def phrase_audit(spark: SparkSession, d: str) -> DataFrame:
    c = A.cases(spark, d)
    evidence = audit.phrase_evidence(c.withColumn("title", F.lower("title")), PHRASES, ["title"], normalize=False)
    return audit.phrase_counts(evidence, c.drop("label"))


@query("""WITH f AS (SELECT doc_id, lower(text) AS t, string_split(lower(text), 'the') AS parts FROM documents), p AS (SELECT doc_id, t, generate_subscripts(parts, 1) AS i, parts FROM f),
s AS (SELECT doc_id, list_sum(list_transform(parts[1:i], lambda x: length(x))) + 3 * (i - 1) AS pos FROM p WHERE i < len(parts)), w AS (SELECT doc_id, count(*) AS n, min(pos) AS first_at, max(pos) AS last_at FROM s GROUP BY 1)
SELECT doc_id, n, CAST(first_at AS BIGINT) AS first_at, CAST(last_at AS BIGINT) AS last_at FROM w""")
def phrase_spans(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.operators.rules import spans

    x = A.table(spark, d, "documents").select("doc_id", F.explode(spans(F.lower("text"), "the")).alias("s"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("s.s").cast("long").alias("first_at"), F.max("s.s").cast("long").alias("last_at"))


NEAR = [("background", "the"), ("comparison", "que"), ("background", "der")]
_NEAR = ", ".join(f"('{a}', '{b}')" for a, b in NEAR)


@query(f"""WITH ph(label, phrase, near) AS (SELECT *, false FROM (VALUES {_PH}) UNION ALL SELECT *, true FROM (VALUES {_NEAR})), t AS (SELECT doc_id AS id, lower(text) AS t FROM documents),
p AS (SELECT id, t, label, phrase, near, string_split(t, phrase) AS parts FROM t, ph WHERE contains(t, phrase)), u AS (SELECT id, t, label, phrase, near, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p),
s AS (SELECT *, CAST(sum(length(part)) OVER (PARTITION BY id, phrase ORDER BY i) AS BIGINT) + length(phrase) * (i - 1) AS a FROM u),
e AS (SELECT id, label, phrase, near, a, a + length(phrase) AS z FROM s WHERE i < n AND NOT (a > 0 AND regexp_matches(substr(t, a, 1), '[A-Za-z0-9]')) AND NOT regexp_matches(substr(t, a + length(phrase) + 1, 1), '[A-Za-z0-9]'))
SELECT DISTINCT x.id, 'text' AS field, x.phrase, w.label AS kind, w.phrase AS warning, w.a AS w_start, w.z AS w_end FROM e x JOIN e w ON w.id = x.id AND w.near AND NOT x.near AND w.z >= x.a - 120 AND w.a <= x.z + 120""")
def warning_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Warnings within 120 characters of evidence, in whole texts."""
    c = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return audit.context_warnings(audit.phrase_evidence(c, PHRASES, ["text"], normalize=False), audit.phrase_evidence(c, NEAR, ["text"], normalize=False))


def _lower(c: str) -> Column:
    """Folded case, as far as these texts need it."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def _windows(spark: SparkSession, d: str, sizes: range) -> DataFrame:
    """item_id, phrase: the runs of so many words of each item of benchmark."""
    words = A.table(spark, d, "benchmark").select("item_id", F.split(F.trim(F.regexp_replace(_lower("text"), r"\s+", " ")), " ").alias("w"))
    runs = [F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")) for n in sizes]  # noqa: B023
    each = [words.where(F.size("w") >= n).select("item_id", F.explode(run).alias("phrase")) for n, run in zip(sizes, runs)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.distinct()


_WORDS = "words AS (SELECT item_id, string_split(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')), ' ') AS w FROM benchmark)"
_FLEXIBLE = "'(^|[^A-Za-z0-9])' || replace(regexp_escape({0}), '\\ ', '\\s*') || '([^A-Za-z0-9]|$)'"


def _runs(name: str, low: int, high: int) -> str:
    return f"{name} AS (SELECT DISTINCT item_id, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, generate_series({low}, {high}) g(n)))"


@query(f"""WITH {_WORDS}, {_runs('a', 2, 2)}, {_runs('b', 3, 3)}, p AS (SELECT CAST(a.item_id AS VARCHAR) AS label, a.phrase, CAST(b.item_id AS VARCHAR) AS other_label, b.phrase AS other_phrase, replace(a.phrase, ' ', '') AS x, replace(b.phrase, ' ', '') AS y FROM a CROSS JOIN b),
q AS (SELECT *, x = y AS same, (contains(y, x) AND regexp_matches(other_phrase, {_FLEXIBLE.format('phrase')})) OR (contains(x, y) AND regexp_matches(phrase, {_FLEXIBLE.format('other_phrase')})) AS inside FROM p WHERE contains(y, x) OR contains(x, y))
SELECT label, phrase, other_label, other_phrase, CASE WHEN same THEN 'spacing_alias' ELSE 'phrase_overlap' END AS relation FROM q WHERE same OR inside""")
def phrase_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two words of the benchmark's items against its runs of three."""
    tables = [audit.phrases_of(_windows(spark, d, range(n, n + 1)).withColumn("label", F.col("item_id").cast("string")), "label", "phrase") for n in (2, 3)]
    return audit.phrase_relations(*tables)


@query(f"""WITH {_WORDS}, {_runs('r', 2, 8)}, p AS (SELECT DISTINCT phrase, replace(phrase, ' ', '') AS x, {_FLEXIBLE.format('phrase')} AS pattern FROM r), f AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS t FROM documents), t AS (SELECT doc_id, t, regexp_replace(t, '\\s+', '', 'g') AS y FROM f)
SELECT phrase, count(*) AS documents, min(doc_id) AS first_doc FROM p JOIN t ON contains(y, x) WHERE regexp_matches(t, pattern) GROUP BY phrase""")
def benchmark_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold each run of two to eight words of the benchmark (some ten thousand phrases), found in one pass."""
    phrases = [("benchmark", r["phrase"]) for r in _windows(spark, d, range(2, 9)).select("phrase").distinct().orderBy("phrase").limit(audit.MOST_PHRASES + 1).collect()]
    c = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), _lower("text").alias("text"))
    found = audit.phrase_evidence(c, phrases, ["text"], normalize=False).select("id", "phrase").distinct()
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("documents"), F.min("id").alias("first_doc"))


# --- stores, pages, runs ------------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders").withColumns({"keyword": F.col("o_custkey").cast("string"), "title": F.col("o_orderstatus"), "source": F.lit(""), "batch_seq": F.col("o_orderdate"), "ord": F.col("o_orderkey")})
    even = F.col("o_orderkey") % 2 == 0
    return sinks.latest(o.where(even), o.where(~even)).select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


def values_at(df: DataFrame, key: str, ranks: list[int], parts: int = 64) -> list:
    """The key's values at these ranks (from 0; below 0 the first), exactly: rows are counted by range of the key, and only the ranges that hold a rank are sorted, each by itself."""
    edges = sorted(set(df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []))  # under ``parts`` values
    ranged = df.select(F.col(key).alias("key"), sum(((F.col(key) >= F.lit(e)).cast("int") for e in edges), F.lit(0)).alias("part"))
    counts = sorted(map(tuple, ranged.groupBy("part").count().collect()))
    wanted, before = {}, 0
    for part, n in counts:
        wanted |= {max(r, 0): (part, max(r, 0) - before + 1) for r in ranks if before <= max(r, 0) < before + n}
        before += n
    placed = ranged.where(F.col("part").isin(sorted({p for p, _ in wanted.values()}))).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("key")))
    hit = F.lit(False)
    for part, place in set(wanted.values()):
        hit |= (F.col("part") == part) & (F.col("place") == place)
    found = {(r["part"], r["place"]): r["key"] for r in placed.where(hit).collect()}
    return [found[wanted[max(r, 0)]] for r in ranks]


@query("""WITH k AS (SELECT *, ntile(10) OVER (ORDER BY o_orderkey) AS batch FROM orders)
SELECT o_custkey, o_orderstatus, o_orderkey, CAST(batch AS BIGINT) AS batch_seq FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS n FROM k) WHERE n = 1""")
def store_batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders saved to a bucketed store in ten batches: of each customer and status the last order stays, with the batch it came in."""
    dedup.written(spark.range(1))  # sets the folder that the session names
    o = A.table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")  # not written: each batch reads its range of the table, which the reader can tell
    n = o.count()
    sizes = [n // 10 + (i < n % 10) for i in range(10)]
    ends = values_at(o, "o_orderkey", [sum(sizes[: i + 1]) - 1 for i in range(10)]) if n else []  # the last key of each batch
    store = sinks.Store(f"{spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix='newsloom-')}/store-{uuid.uuid4().hex}", buckets=16)
    rows = o.withColumns({"keyword": F.col("o_custkey").cast("string"), "title": F.col("o_orderstatus"), "source": F.lit(""), "ord": F.col("o_orderkey")})
    for low, high in zip([None, *ends], ends):
        store.save(rows.where((F.col("ord") <= high) & (F.lit(True) if low is None else F.col("ord") > low)))
    return store.load(spark).select("o_custkey", "o_orderstatus", "o_orderkey", "batch_seq")


@query("SELECT doc_id, CAST(NULL AS DOUBLE) AS model_confidence, 1 AS group_article_count, '[]' AS related_articles, '{}' AS review_reclassification FROM documents")
def schema_migration(spark: SparkSession, d: str) -> DataFrame:
    return sinks.migrated(A.table(spark, d, "documents")).select("doc_id", "model_confidence", "group_article_count", "related_articles", "review_reclassification")


@query(f"""WITH {A.ARTICLES}, k AS (SELECT *, count(*) OVER (PARTITION BY title, source) AS n, min(ord) OVER (PARTITION BY title, source) AS rep FROM articles WHERE trim(title) <> '') SELECT rep, row_number() OVER (PARTITION BY rep ORDER BY ord) - 1 AS place, link FROM k WHERE n > 1""")
def explode_groups(spark: SparkSession, d: str) -> DataFrame:
    a = A.articles(spark, d).where(F.trim("title") != "").select("ord", "title", "source", F.date_format("published", "yyyy-MM-dd").alias("published_at"), "link")
    g = a.groupBy("title", "source").agg(F.array_sort(F.collect_list(F.struct("ord", "link", "published_at"))).alias("m"))
    refs = F.to_json(F.transform(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), lambda x: F.struct(F.col("title"), F.col("source"), x["published_at"].alias("published_at"), x["link"].alias("link"))))
    stored = g.select(F.get("m", 0)["ord"].cast("string").alias("title"), "source", F.get("m", 0)["published_at"].alias("published_at"), F.get("m", 0)["link"].alias("link"), refs.alias("related_articles"))
    return audit.exploded_groups(stored).select(F.col("group_title").cast("long").alias("rep"), F.col("place").cast("long").alias("place"), "link")


_TEXT = "regexp_replace(block, '<[^>]*>', ' ', 'g')"
for _entity, _char in 2 * (("quot", '"'), ("lt", "<"), ("gt", ">"), ("#39", "''"), ("amp", "&")):  # by the parser, and by clean_text
    _TEXT = f"replace({_TEXT}, '&{_entity};', '{_char}')"


@query(f"""WITH b AS (SELECT page_id, unnest(string_split_regex(regexp_extract(html, '<article[^>]*>((?:.|\\n)*?)</article>', 1), '</?(?:p|div|section|li|blockquote|h1|h2|h3)(?:\\s[^>]*)?>|<br\\s*/?>|[\\n\\r]')) AS block FROM pages),
t AS (SELECT page_id, {SQUEEZED.format(_TEXT)} AS t FROM b), k AS (SELECT page_id, lower(replace(t, ' ', '')) AS k, any_value(length(t)) AS n FROM t WHERE length(t) >= 20 GROUP BY 1, 2),
s AS (SELECT page_id, sum(n) + count(*) - 1 AS size, count(*) AS n FROM k GROUP BY 1)
SELECT (SELECT count(*) FROM pages) AS pages, count(*) AS bodies, CAST(sum(size) AS BIGINT) AS characters, CAST(sum(n) AS BIGINT) AS blocks FROM s WHERE size >= 40""")
def article_bodies(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "pages").select(extract.article_body("html", F.lit(""), "url").alias("b"))
    body = F.col("b.method") == "ARTICLE_BLOCKS"
    return p.agg(F.count(F.lit(1)).alias("pages"), F.count_if(body).alias("bodies"), F.sum(F.when(body, F.length("b.content"))).cast("long").alias("characters"), F.sum(F.when(body, F.col("b.paragraph_count"))).cast("long").alias("blocks"))


@query()
def article_body(spark: SparkSession, d: str) -> DataFrame:
    """The extracted bodies themselves; fixtures test each branch."""
    return A.table(spark, d, "pages").select("page_id", extract.article_body("html", F.lit(""), "url").alias("b")).select("page_id", "b.*")


@query(f"""{_DECIDED}, x AS (SELECT a.ord, a.link, trim(a.content) AS old, p.html FROM decided d JOIN articles a ON a.ord = d.ord LEFT JOIN pages p ON p.page_id = a.ord WHERE final_label = '{REVIEW}')
SELECT CASE WHEN old <> '' THEN 'CONTENT_PRESENT' WHEN ord % 3 = 0 THEN 'NO_LINK' WHEN html IS NULL THEN 'REQUEST_FAILED' WHEN NOT regexp_matches(html, '\\S') THEN 'NO_CONTENT' ELSE 'PENDING' END AS status, count(*) AS n FROM x GROUP BY 1""")
def retry_outcomes(spark: SparkSession, d: str) -> DataFrame:
    # kept first: a filter on the decision would be pushed below all that it is made of, each reference written out
    kept = dedup.written(A.decided(spark, d).select("ord", "link", "content", F.col("decision.final_label").alias("final_label")))
    held = kept.where(F.col("final_label") == REVIEW)
    pages = A.table(spark, d, "pages").select(F.col("page_id").alias("ord"), F.col("html").alias("new"))
    j = held.join(pages, "ord", "left")
    rows = j.select(F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("link")).alias("link"), F.col("content").alias("old_content"), F.coalesce("new", F.lit("")).alias("content"), F.when(F.col("new").isNull(), "REQUEST_FAILED").alias("enrichment_status"), F.lit(False).alias("already"))
    return rows.groupBy(pipeline.retry_status(True, True, F.lit(True)).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_DECIDED} SELECT count(*) AS collected, count(*) AS representatives, count(CASE WHEN NOT (pred_score >= 0.5 AND pred_margin >= 0.05) THEN 1 END) AS low_confidence, count(CASE WHEN applied THEN 1 END) AS rule_applied, count(CASE WHEN {_REV} THEN 1 END) AS review_required, 0::BIGINT AS errors FROM decided""")
def summary_report(spark: SparkSession, d: str) -> DataFrame:
    x, r = A.decided(spark, d), F.col("decision")
    return metrics.summary(x.select(F.lit(1).alias("group_article_count"), decide.confidence_tier(F.col("pred_score"), F.col("pred_margin")).alias("confidence"), r["rule_applied"].alias("applied"), r["final_label"].alias("final_label")))


@query("""WITH RECURSIVE c AS (SELECT conv_id % 35 AS query_ord, substr(sha256(text), 1, 16) AS event_id, row_number() OVER (PARTITION BY conv_id % 35 ORDER BY conv_id, turn) AS place FROM conversations),
p AS (SELECT query_ord, list(event_id ORDER BY place) AS events FROM c WHERE place <= 40 GROUP BY 1), a AS (SELECT list(query_ord ORDER BY query_ord) AS qs, list(events ORDER BY query_ord) AS pools FROM p),
r AS (SELECT 0::BIGINT AS step, []::VARCHAR[] AS met, NULL::VARCHAR AS event_id UNION ALL
  SELECT step + 1, CASE WHEN e IS NULL THEN met ELSE list_append(met, e) END, e FROM (
    SELECT step, met, list_filter(pools[step % len(qs) + 1], lambda x: NOT list_contains(met, x))[1] AS e FROM r, a WHERE len(met) < 180 AND step < 41 * len(qs)))
SELECT qs[(step - 1) % len(qs) + 1] AS query_ord, (step - 1) // len(qs) + 1 AS pick, event_id FROM r, a WHERE event_id IS NOT NULL""")
def round_robin_pick(spark: SparkSession, d: str) -> DataFrame:
    """Turns in 35 pools; each pick depends on those before it."""
    c = A.table(spark, d, "conversations").withColumns({"query_ord": F.col("conv_id") % 35, "event_id": F.substring(F.sha2("text", 256), 1, 16)})
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("query_ord").orderBy("conv_id", "turn")) - 1)
    return feeds.round_robin(c, 40, 180).select("query_ord", F.col("_turn").alias("pick"), "event_id")


@query("""SELECT doc_id, source, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place FROM documents) WHERE place = 1""")
def first_wins_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows: of equal texts the first by doc_id."""
    return audit.first_of_each(A.table(spark, d, "documents").select("doc_id", "source", "lang", "text"), ["text"], ["doc_id"])


@query(f"""{_DECIDED}, t AS (SELECT CASE WHEN ord % 7 = 0 THEN '' WHEN ord % 11 = 0 THEN '1.5' ELSE CAST(round(pred_score, 3) AS VARCHAR) END AS x FROM decided), v AS (SELECT CASE WHEN TRY_CAST(x AS DOUBLE) BETWEEN 0 AND 1 THEN TRY_CAST(x AS DOUBLE) END AS x FROM t)
SELECT count(x) AS valid, count(*) - count(x) AS invalid, count(CASE WHEN x < 0.5 THEN 1 END) AS below, min(x) AS low, max(x) AS high, round(avg(x), 6) AS mean FROM v""")
def audit_metric(spark: SparkSession, d: str) -> DataFrame:
    """A stored score column as text, some of it empty and some out of range."""
    x = A.decided(spark, d)
    shown = F.when(F.col("ord") % 7 == 0, "").when(F.col("ord") % 11 == 0, "1.5").otherwise(F.round("pred_score", 3).cast("string"))
    return audit.metric(x.select(shown.alias("model_score")), "model_score", 0.5).withColumn("mean", F.round("mean", 6))


@query("""WITH c AS (SELECT label, list_transform(generate_series(1, len(any_value(embedding))), lambda i: i) AS dims FROM embeddings GROUP BY label) SELECT label, len(dims) AS dims FROM c""")
def embedding_labels(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "embeddings").groupBy("label").agg(F.first(F.size("embedding")).cast("long").alias("dims"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS cls, i, avg(x) AS c FROM e GROUP BY 1, 2),
p AS (SELECT vec_id, label, cls, sum(x * c) / nullif(sqrt(sum(x * x)) * sqrt(sum(c * c)), 0) AS cosine FROM e JOIN c USING (i) GROUP BY 1, 2, 3), s AS (SELECT *, greatest(0, coalesce(cosine, 0)) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls::VARCHAR) AS place FROM s) SELECT vec_id, label::VARCHAR AS gold, cls::VARCHAR AS pred_label, round(score, 6) AS pred_score FROM r WHERE place = 1""")
def centroid_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Nearest class centroid by cosine; as many centroids as classes reach the driver."""
    e = A.table(spark, d, "embeddings")
    each = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    rows = each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).orderBy("label").collect()
    centroids = {str(r["label"]): [float(x["x"]) for x in r["c"]] for r in rows}
    return predict.with_prediction(e, *predict.centroid_scores(e, "embedding", centroids)).select("vec_id", F.col("label").cast("string").alias("gold"), "pred_label", F.round("pred_score", 6).alias("pred_score"))


@query()
def full_run(spark: SparkSession, d: str) -> DataFrame:
    """The whole composition to result rows, with predictions by word shares; what is held for review is retried with the body of the page
    of its number. Made of ordered grouping, HTML and text functions that SQL lacks: a test holds its rows against what each step promises."""
    classifier = lambda df: predict.by_shares(df, F.lower(T.squeezed(pipeline.INPUT)), A.MODEL_WORDS)
    s = pipeline.Settings(A.rule_set(), classifier, A.LABELS, entities=False)
    address = lambda i: F.concat(F.lit("https://news.example/"), F.col(i).cast("string"))
    pages = A.table(spark, d, "pages").select(address("page_id").alias("url"), "html")
    out = pipeline.run(_stories(spark, d).withColumn("link", address("ord")), s, pages, created_at="2024-01-01T00:00:00+00:00")
    rows = out.whole()  # raises where a step failed
    return sinks.no_result_rows(spark) if rows is None else sinks.result_rows(rows)

