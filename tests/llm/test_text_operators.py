"""Phrase mining, fill-in-middle and personal data against plain versions, on awkward tables."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import infill, phrases, pii

CALL = "call +1 (743) 555-3824 today"
CARD = "4785380592391139"
#: null, empty, blank, symbols, ties, repeats, very long, null id and lang, several lines, sentinels, letters beyond the plane
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, " \n ", None), (4, "a b. A B! a b", "en"), (5, "one two three four five " * 40, "en"), (6, "one two three four five " * 40, "fr"), (6, "one two three four five " * 40, "fr"),
    (None, "one two, three four\nfive", "en"), (8, "x " * 5000 + "end", "de"), (9, "has <S> in it", "en"), (10, "\U0001f600 naïve  café\t漢字\x0b", "fr"), (11, f"{CALL} and {CARD}.", "en"), (12, "tail  ", "en"), (13, "\x01a b \x01a b", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "1 as `f`", "2 as block", "3 as `a.b`").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


# --- phrases ------------------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    key = (lang, tuple(ws[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        inside = (any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 80 * a for (other, q), b in candidates.items() if other == lang and len(q) > len(p))
        if not any(inside):
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang, group in itertools.groupby(sorted(out, key=lambda x: (x[0], -x[6], -x[2], x[1].encode())), key=lambda x: x[0]):
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(group) if i < top]
    return ranked


def listed(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("block_words, least, top", [(1 << 21, 30, 2000), (50, 2, 7)])
def test_collocations_equal_a_plain_count(docs, block_words, least, top):
    r = random.Random(least)
    rows = [*ROWS, *((20 + i, " ".join(r.choices("red blue green old new house tree of the".split(), k=60)) + ". Of the old, of the", r.choice(["en", "fr", None])) for i in range(30))]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = listed(phrases.collocations(df, top=top, least=least, block_words=block_words))
    assert got == sorted(plain_collocations(rows, least, top)) and len(got) > 5


def test_collocations_of_awkward_tables(docs, empty):
    assert listed(phrases.collocations(docs, least=2)) == sorted(plain_collocations(ROWS, 2, 2000))
    assert listed(phrases.collocations(empty)) == []


def test_phrases_are_summed_in_parts_and_leave_nothing_behind(docs, monkeypatch):
    """Small parts and blocks; of what is stored for each level the totals and the phrases stay alone."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choices("red blue green old new house tree of the".split(), k=60)), r.choice(["en", "fr"])) for i in range(40)]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    folders, real = [], phrases._folder
    monkeypatch.setattr(phrases, "_folder", lambda x: folders.append(real(x)) or folders[-1])
    assert listed(phrases.collocations(df, top=50, least=3, block_words=300, part_words=200)) == sorted(plain_collocations(rows, 3, 50))
    path = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folders[0])
    left = {x.getPath().getName() for x in path.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).listStatus(path)}
    assert left == {"totals", "phrases1", "phrases2", "phrases3", "phrases4"}


def test_words_and_places():
    b, starts, ends, doc, place, keys = phrases.words(["en", "en", "fr"], ["Ab ab, AB".encode(), b"", b"ab"])
    assert [bytes(b[s:e]) for s, e in zip(starts, ends)] == [b"ab"] * 4 and doc.tolist() == [0, 0, 0, 2]
    assert place.tolist() == [0, 1, 3, 5] and len(set(keys.tolist())) == 2


# --- fill-in-middle -------------------------------------------------------------------------------------


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50
    form = "plain" if plain else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(units), form, None if plain else len(p), None if plain else len(m), sha(out), sha(text)


def test_infill_equals_a_plain_version(docs, empty):
    rows = [*ROWS, *((100 + i, f"<<S >P> a{i} <M b S> <\n", "en") for i in range(40))]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, infill string").repartition(3)
    got = Counter(tuple(r) for r in infill.transformed(df).collect())
    assert got == Counter(plain_infill(i, t) for i, t, _ in rows) and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.transformed(docs).count() == len(ROWS) and infill.transformed(empty).collect() == []
    kept = infill.arranged(df)
    assert kept.columns == ["doc_id", "text", "infill", "_infill"] and kept.where("_infill.form <> 'plain'").where("concat(_infill.prefix, _infill.middle, _infill.suffix) <> text").count() == 0


# --- personal data ----------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    r = random.Random(5)
    parts = ["a@b.c", "@", "x.y%z", ".", "..", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", CARD, "4785 3805-9239 1139", "0" * 13, "+1 (2", ") 555-3824", "+", "12345678", " ", "-", "é", "\n", "b-c.de", "_", "@x.y@z.w"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(3000)]
    for t in [*texts, "1" * 40000, "a" * 40000, "1." * 20000, "+1" * 20000, "a@" * 20000]:
        assert pii.base(t) == plain_base(t) if len(t) < 10000 else pii.base(t) is not None


def test_messages_are_exact_on_a_tree_and_agree_over_skips():
    w = pii.Weights()
    r = np.random.default_rng(1)
    w.unary, w.chain, w.same = r.normal(size=w.unary.shape), r.normal(size=w.chain.shape), r.random(5)
    g = pii.Graph("12 34 567 then 567 89", [])
    assert g.chain == [(0, 1), (1, 2), (3, 4)] and g.same == [(2, 3)] and not g.similar
    shape = np.array(g.shape) + pii._OFFSETS[:-1]
    own = w.unary[0] + w.unary[shape].sum(axis=1)
    p = np.zeros((5, 5))
    for labels in itertools.product(range(5), repeat=5):
        weight = np.exp(sum(own[i, k] for i, k in enumerate(labels)) + sum(w.chain[labels[a], labels[b]] for a, b in g.chain) + sum(w.same[labels[a]] * (labels[a] == labels[b]) for a, b in g.same))
        for i, k in enumerate(labels):
            p[i, k] += weight
    assert np.allclose(pii.marginals([g], w, 80), p / p.sum(axis=1, keepdims=True), atol=1e-6)


def found_in(text, w):
    ((own, more),) = pii.detect([text], w)
    return [(k, text[a:b]) for k, a, b in own], [(k, text[a:b]) for k, a, b in more]


@pytest.fixture(scope="module")
def weights(spark):
    r = random.Random(2)

    def card():
        while True:
            n = "".join(r.choices("0123456789", k=16))
            if pii.luhn(n):
                return n

    texts = [f"pay {card()} soon, call +1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)} or no. {r.randint(1, 99)} on {r.randint(1, 99)}.{r.randint(1, 9)}." for _ in range(300)]
    texts += [f"mail name{i}@mail{i % 9}.example.com now" for i in range(50)]
    texts += [f"order {n} is no card" for n in (str(r.randrange(10**15, 10**16)) for _ in range(300)) if not pii.luhn(n)]
    return pii.learn(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string").repartition(3))


def test_what_the_field_adds(weights):
    assert found_in(f"card {CARD} here, later 4785380592391138 (a slip)", weights) == ([("card", CARD)], [("card", "4785380592391138")])
    assert found_in("number 4785380592391138 alone, and again 4785380592391138", weights) == ([], [])  # refused by its check, and like no card
    own, more = found_in("+1 (743) 555-3824 or (743) 555-3824, room 204 in 1999", weights)
    assert own == [("phone", "+1 (743) 555-3824")] and more == [("phone", "(743) 555-3824")]
    assert found_in("two " + CARD + " " + CARD, weights) == ([], [("card", CARD), ("card", CARD)])  # the pattern takes both for one number
    assert found_in("nothing 12 here, version 3.0, 2024", weights) == ([], []) and found_in("", weights) == ([], [])
    assert found_in("mail ann.b7@x.example.com, later ann.b7 wrote", weights)[1] == [("email", "ann.b7")]


def test_results_depend_on_the_text_alone(weights):
    texts = [f"card {CARD} or 4785380592391138", None, "", "+1 (743) 555-3824 or (743) 555-3824", "7 " * 30000]
    each = [pii.detect([t], weights)[0] for t in texts]
    assert pii.detect(texts * 2, weights) == each * 2


def test_held_out_labels_are_recovered(weights):
    """Numbers whose base span is hidden by what is glued to them, each beside a plain copy: 9 of 10 come back, and no other number."""
    r, hit, wrong = random.Random(8), 0, 0
    for _ in range(100):
        digits = "".join(r.choices("123456789", k=15))
        n = next(digits + c for c in "0123456789" if pii.luhn(digits + c))
        other = next(x for x in (str(r.randrange(10**15, 10**16)) for _ in range(50)) if not pii.luhn(x))
        _, more = found_in(f"card {n} then {n} 77 and {other} end", weights)
        hit += ("card", n) in more
        wrong += any(other in t for _, t in more)
    assert hit >= 90 and wrong == 0


def test_personal_data_tables(docs, empty, weights):
    got = pii.found(docs, weights).collect()
    assert len(got) == len(ROWS) and {r["doc_id"] for r in got} == {r[0] for r in ROWS}
    for r in got:
        texts = [t for i, t, _ in ROWS if i == r["doc_id"]]
        spans = plain_base(texts[0])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(r["spans"].split(","))
    assert pii.found(empty).collect() == [] and pii.found(docs).count() == len(ROWS)
    shown = {r["doc_id"]: r["_redacted"] for r in pii.redacted(docs.withColumnRenamed("f", "redacted"), weights).collect()}
    assert shown[11] == "call [PHONE] today and [CARD]." and shown[1] is None and shown[2] == ""
    assert pii.masked("abcdef", [("card", 1, 3), ("phone", 2, 4)]) == "a[CARD]ef"
