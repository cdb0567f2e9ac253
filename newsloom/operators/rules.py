"""Scoring articles with phrase rules, as column expressions.

Terms claim text longest first; a span that overlaps a claimed one is void; a term scores once for however
many spans it keeps. Labels rank by score, then tie priority. Everything about one article happens in
its own row: the rules travel with the plan, so there is no join and no shuffle.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T

from .ruleset import RuleSet, Term, bounded, literals, phrase_pattern


def spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e>> of all matches of a pattern that do not overlap, as offsets from 0, in time linear in the text."""

    def finder():
        compiled = re.compile(pattern)
        return lambda t: None if t is None else [{"s": m.start(), "e": m.end()} for m in compiled.finditer(t)]

    return T.by_slices(finder, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))(text)


RANKED = pa.struct([
    ("hits", pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("strength", pa.int32()), ("origin", pa.string())]))),
    ("ranking", pa.list_(pa.struct([("label", pa.string()), ("score", pa.int32()), ("matches", pa.int32()), ("strong", pa.int32()), ("terms", pa.list_(pa.string()))]))),
])
_RUN = re.compile(r"\S+")
#: Phrases of one literal that are searched for one by one.
FEW = 64
_TOUCHING = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


class Finder:
    """Spans of one phrase. A phrase of one literal is searched as such; another's pattern only where all its literals occur."""

    def __init__(self, phrase: str):
        self.parts = literals(phrase)
        self.bounded = bounded(phrase)
        self.pattern = re.compile(phrase_pattern(phrase))

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        if len(self.parts) > 1:
            if all(p in text for p in self.parts):
                yield from (m.span() for m in self.pattern.finditer(text))
            return
        word = self.parts[0]
        at = text.find(word)
        while at >= 0:
            end = at + len(word)
            if not self.bounded or (text[at - 1 : at] not in _TOUCHING and text[end : end + 1] not in _TOUCHING):
                yield at, end
                at = text.find(word, end)
            else:
                at = text.find(word, at + 1)


class Automaton:
    """Spans of many phrases in one pass over a text, whose cost does not depend on how many phrases there are.

    One trie with failure links holds the phrases without white space, and runs over the text without white space. What it finds counts if white space
    of the text falls only between the phrase's literals, and a bounded phrase touches no ASCII letter or digit; of overlapping spans of one
    phrase the leftmost is kept, as Finder does for one phrase. Phrases of one literal, where there are ``FEW`` at most, are left to Finder: a search for each
    takes less than the steps of Python that each place in the trie costs.
    """

    def __init__(self, phrases: Sequence[str]):
        self.trie = ahocorasick.Automaton()
        whose: dict[str, list[int]] = {}
        self.seams: list[frozenset[int]] = []
        self.bounded = [bounded(p) for p in phrases]
        for i, phrase in enumerate(phrases):
            parts = literals(phrase)
            self.seams.append(frozenset(itertools.accumulate(map(len, parts[:-1]))))
            whose.setdefault("".join(parts), []).append(i)
        single = [i for i, p in enumerate(phrases) if len(literals(p)) == 1 and literals(p)[0]]
        self.few = {i: Finder(phrases[i]) for i in single} if len(single) <= FEW else {}
        for word, own in whose.items():
            if word and (left := [i for i in own if i not in self.few]):
                self.trie.add_word(word, (len(word), left))
        if len(self.trie):
            self.trie.make_automaton()

    def spans(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """phrase's number -> its spans, ascending; phrases without a span are left out."""
        out = {i: found for i, finder in self.few.items() if (found := list(finder.spans(text)))}
        if not len(self.trie) or not (parts := text.split()):
            return out
        heads = list(itertools.accumulate(map(len, parts[:-1]), initial=0))  # where each run begins in the text without white space
        starts: list[int] = []
        for last, (size, own) in self.trie.iter("".join(parts)):
            if not starts:
                starts = [m.start() for m in _RUN.finditer(text)]
            first = last + 1 - size
            a, b = bisect_right(heads, first) - 1, bisect_right(heads, last) - 1
            begin, end = starts[a] + first - heads[a], starts[b] + last - heads[b] + 1
            touches = text[begin - 1 : begin] in _TOUCHING or text[end : end + 1] in _TOUCHING
            for i in own:
                if touches and self.bounded[i] or a < b and any(heads[k] - first not in self.seams[i] for k in range(a + 1, b + 1)):
                    continue
                found = out.setdefault(i, [])
                if not found or begin >= found[-1][1]:
                    found.append((begin, end))
        return out


@lru_cache(maxsize=8)
def automaton(phrases: tuple[str, ...]) -> Automaton:
    """Made once for each Python worker."""
    return Automaton(phrases)


class Matcher:
    """Claims text for the terms of a rule set, longest first, in one pass over the text."""

    def __init__(self, rules: RuleSet):
        self.terms = rules.scoring()
        self.automaton = automaton(tuple(t.phrase for t in self.terms))
        self.order = sorted(rules.direct_labels, key=lambda x: (rules.tie_priority[x], x))

    def hits(self, text: str) -> list[Term]:
        claimed = bytearray(len(text))
        out = []
        for i, spans in sorted(self.automaton.spans(text).items()):
            free = [s for s in spans if claimed.find(1, *s) < 0]
            for begin, end in free:
                claimed[begin:end] = b"\1" * (end - begin)
            if free:
                out.append(self.terms[i])
        return out

    def ranking(self, hits: list[Term]) -> list[tuple]:
        rows = []
        for label in self.order:
            own = [t for t in hits if t.label == label]
            rows.append((label, sum(t.strength for t in own), len(own), sum(t.strength > 1 for t in own), [t.phrase for t in own]))
        return sorted(rows, key=lambda r: -r[1])  # stable: ties stay in priority order


def ranker(rules: RuleSet):
    """Arrow UDF from a normalised text to struct(hits, ranking). One pass per article: as nested JVM lambdas the
    same work was planned many times over, once for each column that reads it."""

    def ranked():
        matcher = Matcher(rules)

        def row(text: str | None) -> dict:
            hits = matcher.hits(text or "")
            named = [dict(zip(("label", "score", "matches", "strong", "terms"), r)) for r in matcher.ranking(hits)]
            return {"hits": [{"label": t.label, "phrase": t.phrase, "strength": t.strength, "origin": t.origin} for t in hits], "ranking": named}

        return row

    return T.by_slices(ranked, RANKED)


def rank(df: DataFrame, text: Column, rules: RuleSet, prefix: str = "") -> DataFrame:
    """df with hits, ranking (array<struct<label, score, matches, strong, terms>>, best first), rule_margin, tied_labels of a normalised text."""
    n = lambda x: f"{prefix}{x}"
    out = df.withColumn(n("ranked"), ranker(rules)(text))
    out = out.withColumns({n("hits"): F.col(f"{n('ranked')}.hits"), n("ranking"): F.col(f"{n('ranked')}.ranking")}).drop(n("ranked"))
    first, second = F.get(n("ranking"), 0), F.get(n("ranking"), 1)
    return out.withColumns({
        n("rule_margin"): first["score"] - second["score"],
        n("tied_labels"): F.transform(F.filter(F.col(n("ranking")), lambda x: x["score"] == first["score"]), lambda x: x["label"]),
    })


def rank_articles(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Rank title, description and content together. Description is the cleaned one (text.article_description). The ranking's column
    carries the rule set's fingerprint."""
    joined = T.normalize_rule_text(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "content")]))
    # the normalised text is computed by a UDF: name it once, so that it runs once
    return rank(df.withColumn("rule_text", joined), F.col("rule_text"), rules).withMetadata("ranking", {"rules": rules.fingerprint()})


def ranked_once(df: DataFrame, rules: RuleSet) -> DataFrame:
    """rank_articles, unless df has a ranking by the same rule set already (told by the column's metadata), of texts that have not changed since.
    Between runs scores.ScoreTable tells changed texts too."""
    kept = {"rule_text", "hits", "ranking", "rule_margin", "tied_labels"}
    if kept <= set(df.columns) and df.schema["ranking"].metadata.get("rules") == rules.fingerprint():
        return df
    return rank_articles(df.drop(*kept), rules)


def score_for(ranking: Column, label: str) -> Column:
    return F.get(F.filter(ranking, lambda x: x["label"] == label), 0)


def scores_by_label(ranking: Column, rules: RuleSet) -> Column:
    """map<label, score> in candidate order."""
    order = [x for x in rules.labels if x in rules.direct_labels]
    return F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*[score_for(ranking, x)["score"] for x in order]))


def unrelated_signals(text: Column, rules: RuleSet) -> Column:
    """0 if a domain term occurs, else how many groups of unrelated terms do."""
    has = lambda phrases: F.rlike(text, F.lit("|".join(f"(?:{phrase_pattern(p)})" for p in phrases)))
    count = sum((has(g).cast("int") for g in rules.unrelated_groups), F.lit(0))
    return F.when(has(rules.domain_terms), F.lit(0)).otherwise(count) if rules.unrelated_groups else F.lit(0)
