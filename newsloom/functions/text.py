"""Text functions as column expressions. Missing text is '' throughout; nulls become ''.

What Spark has no built-in for (HTML entities, NFKC with case folding, sequence similarity) is one Arrow
UDF each, and short-circuits on plain ASCII where it can.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: Python's white space; Java's own class misses U+001C-1F even in Unicode mode.
SPACE = "(?U)[\\s\\x1c-\\x1f]+"
WORD = "[A-Za-z0-9가-힣]+"
TOKEN = "[a-z0-9가-힣]+"
NUMBER = "[0-9]+(?:[.,][0-9]+)*"

# They must be as they are for results to agree.
NEWS_TAGS = ["단독", "종합", "속보", "포토", "영상"]
ALIASES = {"키운다": "양성", "양성한다": "양성", "육성": "양성", "육성한다": "양성"}
FILLERS = ["본격", "정식", "등", "및"]
PARTICLES = ["이", "가", "은", "는", "을", "를", "의", "에", "에서", "으로", "과", "와"]
CONFLICT_CUES = [
    "취소", "철회", "중단", "부인", "무산", "연기", "실패", "폐쇄", "해체", "불허", "감소", "증가", "축소", "확대", "인상", "인하",
    "승인", "거부", "반박", "재개", "종료", "않", "아니", "없", "불가", "해제",
]


def arrow_udf(kind: str):
    """A pandas UDF that is made at its first call: modules with one can be imported where no session is."""

    def wrap(f):
        @functools.wraps(f)
        def call(*cols):
            return F.pandas_udf(f, kind)(*cols)

        return call

    return wrap


#: Rows whose Python objects are held at a time.
SLICE = 200


def by_slices(make: Callable[[], Callable], kind: pa.DataType) -> Callable[..., Column]:
    """An Arrow UDF that calls make() once a task, and what that gives for each row. Only a slice of a batch is Python objects at a time, so that the memory of
    a worker follows neither the rows of a batch nor what is made of them. What it makes is costly: it is not made twice to move a filter."""

    def run(parts):
        f = make()
        for part in parts:
            columns = part if isinstance(part, tuple) else (part,)
            for at in range(0, len(columns[0]), SLICE):
                rows = zip(*[c.slice(at, SLICE).to_pylist() for c in columns])
                yield pa.array([f(*row) for row in rows], kind)

    def one(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(parts)

    def several(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from run(parts)

    return lambda *cols: F.arrow_udf(one if len(cols) == 1 else several, from_arrow_type(kind)).asNondeterministic()(*cols)


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


@arrow_udf("string")
def unescaped(s: pd.Series) -> pd.Series:
    """HTML character references decoded once."""
    return s.map(lambda x: html.unescape(x) if x and "&" in x else x)


@arrow_udf("string")
def folded(s: pd.Series) -> pd.Series:
    """NFKC, then case folding."""
    return s.map(lambda x: x if x is None else x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold())


def squeezed(c: Column | str) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(_text(c), SPACE, " "))


def clean_text(c: Column | str, entities: bool = True) -> Column:
    """Entities decoded once, white space squeezed. entities=False stays in the JVM, for text that has none."""
    return squeezed(unescaped(_text(c)) if entities else _text(c))


class _Stripper(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def _stripped(x: str | None) -> str:
    parser = _Stripper()
    parser.feed(x or "")
    parser.close()
    return " ".join(html.unescape(" ".join(parser.parts)).split())


@arrow_udf("string")
def strip_html(s: pd.Series) -> pd.Series:
    """Text nodes of a fragment, joined by a space and cleaned."""
    return s.map(_stripped, na_action=None)


def normalize_description(c: Column | str, entities: bool = True) -> Column:
    """Without [...] and (...), without quotes; '' if fewer than two words are left."""
    x = F.regexp_replace(clean_text(c, entities), r"\[[^\]]+\]", " ")
    x = F.regexp_replace(x, r"\([^)]*\)", " ")
    x = squeezed(F.regexp_replace(x, "[\"'“”‘’]", ""))
    return F.when(F.regexp_count(x, F.lit(WORD)) >= 2, x).otherwise("")


def normalize_key(c: Column | str, entities: bool = True) -> Column:
    return F.regexp_replace(F.lower(clean_text(c, entities)), SPACE, "")


def _quoted(source: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(source, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def strip_source_suffix(title: Column | str, source: Column | str, entities: bool = True) -> Column:
    """Drop trailing ' - source' as often as it stands there, whatever its case."""
    t, s = clean_text(title, entities), clean_text(source, entities)
    pattern = F.concat(F.lit("(?iuU)(?:\\s+[-|–—]\\s*"), _quoted(s), F.lit("\\s*)+$"))
    return F.when(s == "", t).otherwise(F.trim(F.regexp_replace(t, pattern, F.lit(""))))


def safe_truncate(c: Column | str, limit: int, entities: bool = True) -> Column:
    x = clean_text(c, entities)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, limit)), F.lit("...")))


def comparable(c: Column, fold: bool = True) -> Column:
    """Letters and digits alone, folded."""
    return F.array_join(F.regexp_extract_all(folded(c) if fold else F.lower(c), F.lit(WORD), 0), "")


def article_description(title: Column | str, description: Column | str, source: Column | str = "", entities: bool = True, fold: bool = True) -> Column:
    """The description without a trailing source; '' where it only repeats the source or the title."""
    d, s = clean_text(description, entities), clean_text(F.lit("") if isinstance(source, str) and not source else source, entities)
    pattern = F.concat(F.lit("(?iuU)\\s+(?:[-|–—]\\s*)?"), _quoted(s), F.lit("\\s*$"))
    cut = F.when(s == "", d).otherwise(F.trim(F.regexp_replace(d, pattern, F.lit(""))))
    only_source = (s != "") & (normalize_key(d, False) == normalize_key(s, False))
    own = comparable(cut, fold)
    return F.when(only_source | (own == "") | (own == comparable(_text(title), fold)), "").otherwise(cut)


def normalize_rule_text(c: Column | str) -> Column:
    return folded(clean_text(c))


def tokens(c: Column | str, fold: bool = True) -> Column:
    """Words of a title without its leading news tag; aliases made one."""
    x = F.regexp_replace(_text(c), "^(?U)\\s*\\[(?:" + "|".join(NEWS_TAGS) + ")\\](?U)\\s*", "")
    words = F.regexp_extract_all(folded(x) if fold else F.lower(x), F.lit(TOKEN), 0)
    table = F.create_map(*[F.lit(y) for pair in ALIASES.items() for y in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def numbers(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_text(c), F.lit(NUMBER), 0))


def conflict_cues(title: Column, description: Column, cues: list[str] | None = None) -> Column:
    """Cues that stand anywhere in title and description."""
    both = F.concat(_text(title), F.lit(" "), _text(description))
    return F.filter(F.array(*map(F.lit, cues or CONFLICT_CUES)), lambda cue: F.contains(both, cue))


def sequence_similarity(left: str, right: str) -> float:
    """The lower of both directions' matching-block ratios."""
    return min(SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in ((left, right), (right, left)))


@arrow_udf("double")
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([sequence_similarity(a or "", b or "") for a, b in zip(left, right)])


def _extends(a: Column, b: Column, particles: list[str]) -> Column:
    """a is b, or b with a particle, where b has three letters at least."""
    tail = F.substring(a, F.length(b) + 1, F.length(a))
    return (a == b) | ((F.length(b) >= 3) & F.startswith(a, b) & tail.isin(particles))


def compatible_words(left: Column, right: Column, particles: list[str] | None = None) -> Column:
    """Every word of either has its like in the other."""
    p = particles or PARTICLES

    def covered(x: Column, y: Column) -> Column:
        return F.forall(x, lambda a: F.exists(y, lambda b: _extends(a, b, p) | _extends(b, a, p)))

    return covered(left, right) & covered(right, left)


def canonical_words(words: Column, particles: list[str] | None = None, fillers: list[str] | None = None) -> Column:
    """Words less fillers and particles, sorted: compatible word sets have equal ones, so it can deal pairs to buckets."""
    ends = "|".join(sorted(map(re.escape, particles or PARTICLES), key=len, reverse=True))
    kept = F.filter(words, lambda w: ~w.isin(fillers or FILLERS))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.regexp_replace(w, f"^(.{{3,}}?)(?:{ends})+$", "$1"))))


def lead_sentences(c: Column | str, n: int = 2, limit: int = 500) -> Column:
    parts = F.split(_text(c), "(?<=[.!?。！？])(?U)\\s+")
    return F.substring(F.array_join(F.slice(parts, 1, n), " "), 1, limit)


def model_input(title: Column | str, description: Column | str, content: Column | str, keyword: Column | str | None = None) -> Column:
    """What a classifier reads: labelled title, description and body, each cut to its limit.

    The title's line is always there, the others only where they have text; the search keyword is left out
    unless it is given, as it would give a hint.
    """
    parts = [F.concat(F.lit("기사제목: "), F.substring(_text(title), 1, 250))]
    parts += [F.when(_text(c) != "", F.concat(F.lit(f"{name}: "), F.substring(_text(c), 1, n))) for name, c, n in (("기사설명", description, 300), ("기사본문", content, 500))]
    return F.concat_ws("\n", *([F.concat(F.lit("검색주제: "), _text(keyword))] if keyword is not None else []), *parts)


def legacy_input(title: Column | str, description: Column | str, content: Column | str) -> Column:
    """The earlier form, of raw fields."""
    named = [F.when(_text(c) != "", F.concat(F.lit(f"{name}: "), x)) for name, c, x in (("기사설명", description, _text(description)), ("기사본문요약", content, F.substring(_text(content), 1, 500)))]
    return F.concat_ws("\n", F.concat(F.lit("기사제목: "), _text(title)), *named)


def prepared_input(c: Column | str, limit: int = 1_200, entities: bool = True) -> Column:
    return F.substring(clean_text(c, entities), 1, limit)


def changed_input(before: Column, after: Column, limit: int = 1_200, entities: bool = True) -> Column:
    return prepared_input(before, limit, entities) != prepared_input(after, limit, entities)


def excerpt(text: Column, start: Column, end: Column, around: int = 80) -> Column:
    """The text from ``around`` characters before a span to as many after it."""
    begin = F.greatest(start - around, F.lit(0))
    return F.substring(text, begin + 1, F.least(F.length(text), end + around) - begin)
