import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from newsloom.llm import langid, mixing, queries, tokens

VOWELS = {"xx": "aio", "yy": "eu"}


def words(r, lang, n):
    return ["".join(r.choice("bdfgkl") + r.choice(VOWELS[lang]) for _ in range(r.randint(2, 4))) for _ in range(n)]


def corpus():
    """Documents in two languages: exact copies, near copies, passages in several documents, and rows that hold nothing."""
    r = random.Random(4)
    rows, passage = [], words(r, "xx", 70)
    for i in range(60):
        lang = "xx" if i % 3 else "yy"
        text = words(r, lang, 120)
        if i % 6 == 1:
            text += passage + words(r, "xx", 20)
        rows.append((i, " ".join(text), lang, f"s{i % 2}"))
    for i in range(0, 30, 5):
        w = rows[i][1].split()
        rows.append((100 + i, rows[i][1], *rows[i][2:]))
        w[50] = "changed"
        rows.append((200 + i, " ".join(w), *rows[i][2:]))
    return rows + [(300, None, "xx", "s0"), (301, "", None, None), (302, "123 !!!", "yy", "s1"), (None, " ".join(words(r, "yy", 90)), None, None), rows[3]]


def plain(rows):
    """doc_id -> text of what the first three stages leave, by loops over all pairs and all windows."""
    told = [x for x in rows if any(c.isalpha() for c in x[1] or "")]
    told = sorted(set(told), key=lambda x: (-1 if x[0] is None else x[0], x[1]))
    sets = [set(zip(*[x[1].split()[k:] for k in range(5)])) for x in told]
    root = list(range(len(told)))
    for i in range(len(told)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    out, seen = {}, set()
    for i, (doc_id, text, _, source) in enumerate(told):
        if root[i] == i:
            w = text.split()
            gone = set()
            grams = [tuple(w[k : k + 30]) for k in range(len(w) - 29)]
            for k, g in enumerate(grams):
                if g in seen:
                    gone |= set(range(k, k + 30))
                seen.add(g)
            out[doc_id] = (" ".join(x for k, x in enumerate(w) if k not in gone), source)
    return out


def test_run_equals_a_plain_version(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = plain(rows)
    frame = spark.createDataFrame([(i, t, s) for i, (t, s) in left.items()], "doc_id long, text string, source string")
    copies = {x["doc_id"]: x["copies"] for x in mixing.rated(frame).collect()}
    t = tokens.encoder("words", tokens.public("word_bpe_49k.json")).tokenizer
    sizes = {i: len(t.encode(text, add_special_tokens=False).ids) + 1 for i, (text, _) in left.items()}
    pieces = Counter()
    for x in got:
        pieces[x["doc_id"]] += x["length"]
        assert x["doc_tokens"] == sizes[x["doc_id"]]
    assert pieces == Counter({i: sizes[i] * copies[i] for i in left if copies[i]})
    assert max(Counter(x["sequence_id"] for x in got)) < np.ceil(sum(pieces.values()) / 2048) + 1


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_tables(spark, name, stage):
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, "same words here and there", None, "a"), (3, "same words here and there", "en", None), (3, "same words here and there", "en", None), (4, "long " * 30_000, "en", "b")]
    wide = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr(
        "*", "cast(length(text) as long) as n_chars", "lang as score", "lang as k", "source as text_k", "doc_id as size", "doc_id as copies", "lang as span", "text as `a.b`"
    )
    out = stage(spark, wide, "")
    assert out.count() > 0 and (name == "sequences" or out.columns == wide.columns)
    none = stage(spark, wide.where("false"), "")
    assert none.count() == 0 and none.columns == out.columns


def test_language_without_labels_keeps_all(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string").selectExpr("*", "cast(null as string) as lang", "'a' as source")
    assert corpus_pipeline.language(spark, df, "").count() == 2


def test_profiles_equal_a_plain_version():
    """Distance, nearest language and score by dictionaries, as the definition says them."""
    r = random.Random(8)
    known = {lang: Counter() for lang in VOWELS}
    for lang, counts in known.items():
        for _ in range(20):
            v, n = langid.grams(" ".join(words(r, lang, 50)))
            counts.update(dict(zip(v.tolist(), n.tolist())))
    ranked = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:300]] for lang, c in known.items()}
    profiles = langid.Profiles(ranked)
    for lang in VOWELS:
        for text in (" ".join(words(r, lang, 30)), " ".join(words(r, "xx", 3) + words(r, "yy", 3)), "q", "\U00031234 w"):
            v, n = langid.grams(text)
            own = [g for g, _ in sorted(zip(v.tolist(), n.tolist()), key=lambda x: (-x[1], x[0]))[:300]]
            away = {k: sum(min(abs(gs.index(g) - i), 300) if g in gs else 300 for i, g in enumerate(own)) for k, gs in ranked.items()}
            best = min(sorted(away), key=lambda k: away[k])
            assert profiles.predict(text) == (best, pytest.approx(1 - away[best] / (300 * len(own))))
    assert profiles.predict("\U00031234")[0] != langid.UNKNOWN and langid.Profiles({}).predict("a") == (langid.UNKNOWN, 0.0)


def test_every_number_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 14)) and "pipeline" in queries.QUERIES
