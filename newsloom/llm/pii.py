"""Personal data by fixed patterns and a skip-chain conditional random field over each document.

Base spans come from the patterns of ``base``: e-mail and IP addresses, card numbers, phone numbers. They stay, and are the evidence of
the field. Its nodes are the tokens (runs without white space) that hold a digit or ``@``; any other token can be part of no kind, has the label
``O`` for certain, and so parts the chain. Neighbouring nodes share a transition potential. Skip edges join a token to the first token of the document
that is the same, and to the first that is similar: equal digits under other punctuation, one digit more, less or other, or the part of
an address before its ``@``. Loopy sum-product messages, ``ROUNDS`` rounds of them, carry what a base span tells to the places
that the patterns miss (a number with a slip, one glued to other digits, one without its prefix); a token whose most probable label is a
kind, with at least half of the probability, becomes a span, and neighbours of one kind one span (cards and phones).

The potentials are learned from the whole corpus by pseudo-likelihood: each token's label (that of the base span it meets, else O), its shape
and its neighbours' labels are one pattern; patterns are counted in Spark, and the ``PATTERNS`` most frequent reach the driver, where the weights are fitted, drawn
to a prior. A number that fails its kind's check (Luhn, parts of at most 255) shows what is no card and no address, unless it resembles a base span: then, and
where a pattern has swallowed a token with its neighbours and failed, the label is unknown, and nothing is learned from it.

Null texts are empty; empty texts, texts without a digit or @, and those of an empty table have no span; rows that repeat get equal results; of
overlapping matches of a kind the leftmost counts; texts are read whole, however long, in the task that holds them, in time near their length;
columns other than doc_id and text are kept by ``redacted`` and ignored elsewhere, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
ROUNDS = 40
#: Patterns (with their counts) that weights are fitted to at most.
PATTERNS = 20_000
RIDGE = 1.0
STEPS = 400
#: Digits of numbers that are compared up to one digit.
SIMILAR = range(8, 20)
HANDLE = 5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NEEDLE = re.compile(r"[0-9@]\S*+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TRIM = re.compile(r"[A-Za-z0-9@](?:.*[A-Za-z0-9@])?", re.S)


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Each @ with what stands before it, back to the match before, and the domain after it: as leftmost search finds them, without its retries."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end(), True
            last = m.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _ip_fits(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _card_fits(found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_fits(found: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", found)) <= 15


def matches(text: str) -> list[tuple[int, int, int, bool]]:
    """Kind (its place in KINDS), begin, end and whether the check holds, of each match of the patterns."""
    out = [(0, *m) for m in _emails(text)]
    for kind, pattern, fits in ((1, _IP, _ip_fits), (2, _CARD, _card_fits), (3, _PHONE, _phone_fits)):
        out += [(kind, m.start(), m.end(), fits(m.group())) for m in pattern.finditer(text)]
    return out


def base(text: str | None) -> list[tuple[str, int, int]]:
    """kind, begin, end of the base spans, by kind, then begin."""
    return [(KINDS[k], a, b) for k, a, b, good in matches(text or "") if good]


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


# --- the graph of a document -----------------------------------------------------------------

#: Values of each part of a token's shape: digits, @, dots, what it begins with, letters, what it is glued to, refused by a check.
SHAPE = (12, 3, 3, 3, 3, 3, 2)
_OFFSETS = np.concatenate(([1], 1 + np.cumsum(SHAPE)))  # 0 is the bias
N_SHAPE = int(_OFFSETS[-1])
_BUCKET = [0, 1, 1, 2, 3, 4, 4, 5, 5, 6, 6, 6, 6, 7, 7, 7, 8, 9, 9, 9]
NONE = len(LABELS)


class Graph:
    """Tokens of a text: begin, end (of the core), shape, label (0 without a base span), unknown (whether 0 means nothing), chain and skip edges."""

    def __init__(self, text: str, found: list[tuple[int, int, int, bool]]):
        self.begin, self.end, self.shape, self.label, self.unknown = [], [], [], [], []
        self.chain: list[tuple[int, int]] = []
        self.same: list[tuple[int, int]] = []
        self.similar: list[tuple[int, int]] = []
        spans = sorted((a, b, k, good) for k, a, b, good in found if good or k != 2 or b - a >= 13)  # a few digits are not an attempt at a card
        at, last, raw_end = 0, 0, -1
        live: list[tuple[int, int, int, bool]] = []
        first: dict = {}
        for m in _NEEDLE.finditer(text):
            a, b = m.start(), m.end()
            while a > last and not text[a - 1].isspace():
                a -= 1
            last = b
            core = _TRIM.search(text, a, b)
            begin, end = core.start(), core.end()
            if begin > a and text[begin - 1] in "+(":
                begin -= 1
            word = text[begin:end]
            while at < len(spans) and spans[at][0] < end:
                live.append(spans[at])
                at += 1
            live = [s for s in live if s[1] > begin]
            kinds = [k for x, y, k, good in live if good and x < end]
            i = len(self.begin)
            refused = not kinds and bool(_IP.fullmatch(word) or _CARD.fullmatch(word) and 13 <= len(_NOT_DIGIT.sub("", word)) <= 19 and not luhn(_NOT_DIGIT.sub("", word)))
            self.unknown.append(not kinds and not refused and any(x < end for x, *_ in live))
            self.label.append(1 + min(kinds) if kinds else 0)
            self.shape.append(_shape(text, a, begin, word, refused))
            self.begin.append(begin)
            self.end.append(end)
            if i and text[raw_end:a].strip(" ") == "":
                self.chain.append((i - 1, i))
            raw_end = b
            self._skips(i, word.lower(), first)
        for a, b in self.same + self.similar:  # a refused number that is like a base span
            for i, j in ((a, b), (b, a)):
                self.unknown[i] |= bool(self.shape[i][-1] and self.label[j])

    def _skips(self, i: int, word: str, first: dict) -> None:
        digits = _NOT_DIGIT.sub("", word)
        near = set()
        j = first.setdefault(("w", word), i) if len(word) > 2 else i
        if j != i:
            self.same.append((j, i))
        if len(digits) >= 7 and "@" not in word and not any(c.isalpha() for c in word):
            keys = [("d", digits)]
            if len(digits) in SIMILAR:  # one digit less of each of two numbers may be the same
                keys += [("d-", digits[:k] + digits[k + 1 :]) for k in range(len(digits))] + [("d-", digits)]
                keys += [("d", digits[:k] + digits[k + 1 :]) for k in range(len(digits))]
            known = [first[k] for k in keys if k in first]
            near.update(known)
            for k in keys[: 1 + (len(digits) + 1) * (len(digits) in SIMILAR)]:
                first.setdefault(k, i)
        local, _, domain = word.partition("@")
        if len(local) >= HANDLE and any(c.isdigit() for c in local):
            k = first.setdefault(("l", local), i)
            if k != i:
                near.add(k)
        self.similar += [(k, i) for k in sorted(near - {i, j})]


def _shape(text: str, a: int, begin: int, word: str, refused: bool) -> tuple[int, ...]:
    n = sum(map(word.count, "0123456789"))
    letters = [c for c in word if c.isalpha()] if len(word) < 64 else ["z"]
    head, _, tail = word.partition("@")
    glue = text[begin - 1 : begin] if begin > a else ""
    return (
        _BUCKET[n] if n < len(_BUCKET) else 11 if n > 30 else 10, 0 if "@" not in word else 2 if head and "." in tail else 1,
        2 if _IP.fullmatch(word) else int("." in word), {"+": 1, "(": 2}.get(word[:1], 0),
        0 if not letters else 1 if all(c in "abcdefABCDEF" for c in letters) else 2, 0 if not glue else 1 if glue in "\"'=" else 2, int(refused),
    )


# --- learning ---------------------------------------------------------------------------------


def _most(edges: list[tuple[int, int]], label: list[int], skip: list[bool]) -> list[int]:
    """For each node the most frequent label (ties: least) of the nodes it has such edges with, NONE without any."""
    seen: dict[int, list[int]] = {}
    for a, b in edges:
        for i, j in ((a, b), (b, a)):
            if not skip[j]:
                seen.setdefault(i, [0] * NONE)[label[j]] += 1
    return [max(range(NONE), key=lambda k: (seen[i][k], -k)) if i in seen else NONE for i in range(len(label))]


_RADIX = (*SHAPE, NONE, NONE + 1, NONE + 1, NONE + 1, NONE + 1)


def patterns(text: str | None) -> list[int]:
    """A number for each token that is learned from: shape, label, labels of the chain's neighbours, of same and of similar tokens."""
    if not text or not _NEEDLE.search(text):
        return []
    g = Graph(text, matches(text))
    before, after = [NONE] * len(g.label), [NONE] * len(g.label)
    for a, b in g.chain:
        before[b] = NONE if g.unknown[a] else g.label[a]
        after[a] = NONE if g.unknown[b] else g.label[b]
    same, similar = _most(g.same, g.label, g.unknown), _most(g.similar, g.label, g.unknown)
    out = []
    for i, unknown in enumerate(g.unknown):
        if not unknown:
            number = 0
            for value, radix in zip((*g.shape[i], g.label[i], before[i], after[i], same[i], similar[i]), _RADIX):
                number = number * radix + value
            out.append(number)
    return out


class Weights:
    """unary [N_SHAPE, labels], chain [labels, labels], same and similar [labels]: logarithms of potentials."""

    def __init__(self):
        n = NONE
        self.unary, self.chain, self.same, self.similar = np.zeros((N_SHAPE, n)), np.zeros((n, n)), np.full(n, 8.0), np.full(n, 6.0)
        self.unary[0, 0] = 2.0  # the prior: no kind without evidence, none for what a check refuses, equal labels for equal tokens
        self.unary[N_SHAPE - 1, 0] = 2.0
        self.chain[3, 3] = self.chain[4, 4] = 1.0

    def parts(self) -> list[np.ndarray]:
        return [self.unary, self.chain, self.same, self.similar]


def fitted(numbers: np.ndarray, counts: np.ndarray) -> Weights:
    """Weights of greatest pseudo-likelihood of these patterns, with a ridge around the prior; the same on every run."""
    w = Weights()
    if not len(numbers):
        return w
    order = np.argsort(numbers)
    values, rest = np.empty((len(numbers), len(_RADIX)), dtype=np.int64), numbers[order]
    for j in range(len(_RADIX) - 1, -1, -1):
        rest, values[:, j] = np.divmod(rest, _RADIX[j])
    c = counts[order].astype(np.float64)
    c *= min(1.0, 1e5 / c.sum())
    shape = values[:, : len(SHAPE)] + _OFFSETS[:-1]
    label, before, after, same, similar = values[:, len(SHAPE) :].T
    gold = np.eye(NONE)[label]
    pad = lambda m, axis: np.concatenate((m, np.zeros_like(m.take([0], axis))), axis)  # noqa: E731  a neighbour that is none weighs nothing
    prior = [p.copy() for p in w.parts()]
    first, second = [np.zeros_like(p) for p in prior], [np.zeros_like(p) for p in prior]
    for t in range(1, STEPS + 1):
        logits = w.unary[0] + w.unary[shape].sum(axis=1) + pad(w.chain, 0)[before] + pad(w.chain, 1).T[after]
        for s, near in ((w.same, same), (w.similar, similar)):
            logits += np.eye(NONE + 1)[near][:, :NONE] * s
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = (p - gold) * c[:, None]
        g = [np.zeros_like(x) for x in prior]
        g[0][0] = off.sum(axis=0)
        for j in range(len(SHAPE)):
            np.add.at(g[0], shape[:, j], off)
        chain = np.zeros((NONE + 1, NONE))
        np.add.at(chain, before, off)
        g[1] += chain[:NONE]
        chain[:] = 0
        np.add.at(chain, after, off)
        g[1] += chain[:NONE].T
        for k, near in ((2, same), (3, similar)):
            some = near < NONE
            np.add.at(g[k], near[some], off[some, near[some]])
        for x, x0, grad, m, v in zip(w.parts(), prior, g, first, second):
            grad += RIDGE * (x - x0)
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w.same, w.similar = np.maximum(w.same, 0), np.maximum(w.similar, 0)  # alike tokens never repel
    return w


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found, n = np.unique(np.array([p for t in batch["text"] for p in patterns(t)], dtype=np.int64), return_counts=True)
        yield pd.DataFrame({"pattern": found, "n": n})


def learn(df: DataFrame, limit: int = PATTERNS) -> Weights:
    """Weights from all texts. Counts are summed in the tasks first; a pattern that is very frequent is one row of each task."""
    counted = df.select("text").where(F.col("text").isNotNull()).mapInPandas(_count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "pattern").limit(limit).collect()
    return fitted(np.array([r["pattern"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64))


# --- inference --------------------------------------------------------------------------------


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(graphs: list[Graph], w: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of the labels of all tokens of these graphs, which have no edge in common, by sum-product messages.

    The number of rounds is fixed, so a document's result does not depend on those beside it.
    """
    sizes = np.cumsum([0] + [len(g.begin) for g in graphs])
    shape = np.array([s for g in graphs for s in g.shape], dtype=np.int64).reshape(-1, len(SHAPE)) + _OFFSETS[:-1]
    own = w.unary[0] + w.unary[shape].sum(axis=1)
    label = np.array([x for g in graphs for x in g.label], dtype=np.int64)
    own[label > 0] = -40.0
    own[label > 0, label[label > 0]] = 0.0
    edges, which = [], []
    for kind, name in enumerate(("chain", "same", "similar")):
        found = [(a + at, b + at) for g, at in zip(graphs, sizes) for a, b in getattr(g, name)]
        edges += found
        which += [kind] * len(found)
    if not edges:
        p = np.exp(own - own.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    e = np.array(edges, dtype=np.int64)
    table = np.stack([w.chain, np.diag(w.same), np.diag(w.similar)])[np.array(which)]
    source, target = np.concatenate((e[:, 0], e[:, 1])), np.concatenate((e[:, 1], e[:, 0]))
    table = np.concatenate((table, table.transpose(0, 2, 1)))  # [from label, to label]
    back = np.concatenate((np.arange(len(e), 2 * len(e)), np.arange(len(e))))
    sent = np.zeros((len(source), NONE))
    for _ in range(rounds):
        belief = own.copy()
        np.add.at(belief, target, sent)
        new = _log_sum((belief[source] - sent[back])[:, :, None] + table, 1)
        new -= new.max(axis=1, keepdims=True)
        sent = 0.5 * sent + 0.5 * new
    belief = own.copy()
    np.add.at(belief, target, sent)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _added(text: str, g: Graph, p: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the free tokens that most probably are of a kind; neighbours that make one card or phone number are one span."""
    out: list[list] = []
    linked = {b: a for a, b in g.chain}
    last, held = -2, 0
    for i in range(len(g.begin)):
        k = int(p[i].argmax())
        if g.label[i] or not k or p[i, k] < 0.5:
            continue
        digits = len(_NOT_DIGIT.sub("", text[g.begin[i] : g.end[i]]))
        if k >= 3 and out and linked.get(i) == last and out[-1][0] == KINDS[k - 1] and held + digits <= (19 if k == 3 else 15):
            out[-1][2] = g.end[i]
            held += digits
        else:
            out.append([KINDS[k - 1], g.begin[i], g.end[i]])
            held = digits
        last = i
    return [tuple(s) for s in out]


def detect(texts: list[str | None], w: Weights) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base spans and added spans of each text. Texts all of whose tokens have a base label need no messages."""
    out: list[tuple[list, list]] = []
    open_: list[tuple[int, Graph]] = []
    held = 0

    def close() -> None:
        p, at = marginals([g for _, g in open_], w), 0
        for i, g in open_:
            out[i][1].extend(_added(texts[i], g, p[at : at + len(g.begin)]))
            at += len(g.begin)
        open_.clear()

    for text in texts:
        found = matches(text) if text and _NEEDLE.search(text) else []
        out.append(([(KINDS[k], a, b) for k, a, b, good in found if good], []))
        if text and _NEEDLE.search(text):
            g = Graph(text, found)
            if not all(g.label):
                open_.append((len(out) - 1, g))
                held += len(g.begin)
                if held > 20_000:
                    close()
                    held = 0
    if open_:
        close()
    return out


FIELDS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _found(w: Weights):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, more in detect(batch["text"].tolist(), w):
                n = [sum(k == kind for k, _, _ in own) for kind in KINDS]
                rows.append((*n, hashlib.sha256(_written(own).encode()).hexdigest(), _written(own + more), len(more)))
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")][1:])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def found(df: DataFrame, w: Weights | None = None) -> DataFrame:
    """Every row's doc_id, base spans by kind (their numbers and sha256), all spans (as kind:begin:end), and how many the field added."""
    w = w or learn(df)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_found(w), FIELDS)


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span (or spans that overlap, by the first's kind) replaced by its kind in brackets."""
    if text is None or not spans:
        return text
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redacted(df: DataFrame, w: Weights | None = None) -> DataFrame:
    """df with a column ``redacted`` (under a fresh name if it has one): the text without its personal data."""
    w = w or learn(df)
    (name,) = fresh(df, "redacted")

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t, own + more) for t, (own, more) in zip(texts, detect(texts.tolist(), w))], dtype=object)

    return df.withColumn(name, mask("text"))
