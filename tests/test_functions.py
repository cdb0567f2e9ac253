"""Text, date, URL and extraction functions on fixed values."""

import json
import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import values as V
from newsloom.operators import extract

BODY = "This is the first long sentence of the article body, long enough to count."
SECOND = "And this is a second sentence, which is also long enough to be counted here."


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, T.clean_text("a"), a=" A &amp;amp; B\x1c\n c ") == "A &amp; B c" and one(spark, T.clean_text("a"), a=None) == ""
    assert one(spark, T.strip_source_suffix("a", "b"), a="Title - News - NEWS", b="News") == "Title"
    assert one(spark, T.strip_source_suffix("a", "b"), a="Title - A.B", b="A.B") == "Title" and one(spark, T.strip_source_suffix("a", "b"), a="T - x", b="") == "T - x"
    assert one(spark, T.normalize_description("a"), a='[단독] "두 단어" (사진)') == "두 단어" and one(spark, T.normalize_description("a"), a="[x] y") == ""
    assert one(spark, T.article_description("t", "d", "s"), t="Big news", d="Big  NEWS  Daily", s="Daily") == "" and one(spark, T.article_description("t", "d", "s"), t="a", d="Other words Daily", s="Daily") == "Other words"
    assert one(spark, T.tokens("a"), a="[단독] 인재 육성한다 AI") == ["인재", "양성", "ai"] and one(spark, T.safe_truncate("a", 4), a="ab  cdef") == "ab c..."
    assert one(spark, T.strip_html("a"), a="<p>a<b>b</b></p>&lt;") == "a b <" and one(spark, T.lead_sentences("a"), a="A. B! C? D") == "A. B!"
    assert one(spark, T.model_input("t", "d", "c"), t="T", d="", c="C") == "기사제목: T\n기사본문: C"
    assert one(spark, T.compatible_words(F.split("a", " "), F.split("b", " ")), a="대학교는 인재", b="대학교 인재") and not one(spark, T.compatible_words(F.split("a", " "), F.split("b", " ")), a="대학교 신입", b="대학교 인재")
    assert T.sequence_similarity("abcd", "abcd") == 1.0


def test_values(spark):
    assert one(spark, V.rss_datetime("a"), a="Sun, 04 Oct 2026 10:00:00 GMT") == "2026-10-04T10:00:00+00:00" and one(spark, V.rss_datetime("a"), a="4 Oct 2026 10:00:00 +0900") == "2026-10-04T10:00:00+09:00" and one(spark, V.rss_datetime("a"), a="soon") == "soon"
    assert one(spark, V.published_time("a"), a="bad") is None and str(one(spark, V.published_time("a").cast("string"), a="2026-10-04T10:00:00+09:00")) == "2026-10-04 01:00:00"
    assert one(spark, V.score_text(F.array(F.lit(0.0001), F.lit(0.5), F.lit(1.0)))) == "0.0001, 0.5, 1.0" and one(spark, V.probability("a"), a="1.2") is None
    assert one(spark, V.wilson(F.lit(0), F.lit(0))) == 0.0 and one(spark, V.wilson(F.lit(18), F.lit(20))) == pytest.approx(0.6990, abs=1e-3)
    assert one(spark, V.url_identity("a")["query"], a="https://www.x.org/p/?b=2&utm_x=1&a=1#f") == "a=1&b=2"
    for url, fine in (("https://a.example/x", True), ("http://localhost/x", False), ("http://10.0.0.1/", False), ("https://u:p@a.example/", False), ("ftp://a.example/", False), ("https://a.example:8080/", False)):
        assert V.public_url(url) is fine
    with pytest.raises(ValueError):
        V.validate_limit(0)


def test_extraction_branches():
    def got(html, **kw):
        return extract.extract(html, **kw)[1:3]

    assert got(f"<div class='ads'>{BODY}</div><div id='articleBody'><p>{BODY}</p></div>") == ("BODY_CONTAINER_BLOCKS", "body_found")
    assert extract.extract(f"<div id='articleBody'>{BODY}<br>{SECOND}</div>")[3] == 2 and got(f"<div>{BODY}</div>") == ("", "no_usable_body")
    assert got(f"<div id='articleBody'>{BODY}</div><div class='news_body'>{SECOND}</div>") == ("", "multiple_body_candidates")
    assert extract.extract(f"<div id='articleBody'>{BODY}</div><div class='news_body'>{BODY}</div>")[0] == BODY
    assert got(f"<div id='articleBody'><a>{BODY}</a></div>")[0] == "" and got("<rss></rss>")[1] == "rss_document" and got("<title>Access Denied</title>")[1] == "consent_or_block_page"
    ld = '<script type="application/ld+json">{"@type":"NewsArticle","articleBody":"%s"}</script>'
    assert got(ld % BODY) == ("JSON_LD_BODY", "body_found") and got(ld % BODY + ld % SECOND)[1] == "multiple_structured_bodies"
    assert got(f"<article><p>{BODY}</p></article>")[0] == "ARTICLE_BLOCKS" and got(f"<article>{BODY}</article><article>{SECOND}</article>")[1] == "multiple_article_candidates"
    assert got(f"<main><p>{BODY}</p></main>")[0] == "MAIN_PARAGRAPHS" and got(f"<p>{BODY}</p>")[0] == "PAGE_PARAGRAPHS" and got("<div id='article'></div>")[1] == "empty_article_shell"
    story = 'Fusion.globalContent={"type":"story","website_url":"/a","headlines":{"basic":"T"},"content_elements":[{"type":"text","content":"%s"}]}' % BODY
    assert got(f"<script>{story}</script>", title="T", url="https://x.example/a")[0] == "ARC_STORY_JSON"
    assert extract.extract(f"<article>{'x' * 39}</article>")[0] == "" and extract.extract(f"<article>{'x' * 40}</article>")[0] != ""
    closed = story.replace('"type":"story"', '"type":"story","content_restrictions":{"restricted":true}')
    assert got(f"<script>{closed}</script>", title="T", url="https://x.example/a")[1] == "restricted_story_data" and got(f"<script>{story}</script>", title="U", url="https://x.example/a")[0] == ""


def test_a_fetched_page_counts_before_a_failed_one(spark):
    pages = spark.createDataFrame([("https://p.example/a", "BLOCKED_HTTP", None, 403), ("https://p.example/a", "SUCCESS", f"<article><p>{BODY}</p></article>", 200), ("https://p.example/b", "TIMEOUT", None, None)], "url string, status string, html string, http_status int")
    links = [("https://p.example/a", ""), ("https://p.example/b", "own text"), ("", ""), ("ftp://p.example/x", ""), ("https://p.example/c", "")]
    got = {r["link"]: (r["enrichment_status"], r["content"]) for r in extract.enriched(spark.createDataFrame([(u, "t", c) for u, c in links], "link string, title string, content string"), pages).collect()}
    assert got == {"https://p.example/a": ("BODY_EXTRACTED", BODY), "https://p.example/b": ("TIMEOUT", "own text"), "": ("NO_LINK", ""), "ftp://p.example/x": ("UNSAFE_URL", ""), "https://p.example/c": ("REQUEST_FAILED", "")}
