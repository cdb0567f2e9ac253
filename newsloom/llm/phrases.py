"""Phrase collocation mining with vertical positional inverted lists.

Words are numbered along the corpus in blocks of about ``BLOCK_WORDS`` words, whole documents each, with a gap of one place between pieces, so neighbours in
a piece differ by one. A block's inverted file has, for each word, the list of its places; a phrase's frequency is the length
of its lists over all blocks, overlaps included, and is exact. A frequent phrase of k words is extended by merging its places with the postings of the
adjacent word: of those only the places are read that end a frequent phrase of k words themselves, since what is frequent has only
frequent parts. So a phrase of k + 1 words is a pair (left, right) of frequent phrases of k words, one place apart. Lists stay with their block; what is shuffled
to be summed is (left, right, length), a block's lists of one part packed in one row, and what comes back to a block is which of its phrases are frequent, packed as well.

Everything is counted per language (null: ``und``). Words are told apart by a 64-bit hash within a block, by their letters across blocks; frequent words
and frequent phrases get numbers of their own.

Null and empty texts have no words; rows that repeat count again; ties have a defined order; an empty table gives an empty one; a very long text is a block of its own
(a block is never cut inside a document); columns other than doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, mixed, span_hashes

LEAST = 30
LONGEST = 4
TOP = 2_000
#: A candidate goes if a longer one has this share of its occurrences, in percent.
COVERED = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Words of a block; a task holds one block and its lists.
BLOCK_WORDS = 1 << 20
#: Words of the corpus for each part that phrases are summed in; a task holds one part's lengths, of as many lists at most.
PART_WORDS = 1 << 21
#: Marks of words that are packed together.
GATHERED = 1 << 20
#: Bytes that are cut into words at a time.
CHUNK = 1 << 20
#: Parts that a language's candidates are ranked in before the parts' best meet.
RANKED_IN = 64

_KIND = np.zeros(256, dtype=np.int8)  # 0: of a word, 1: white space, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _chunks(langs: list, texts: list) -> Iterator[tuple[list[str], list[bytes]]]:
    held_langs: list[str] = []
    held: list[bytes] = []
    size = 0
    for lang, text in zip(langs, texts):
        held_langs.append(UNKNOWN if lang is None else lang)
        held.append(text.encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= CHUNK:
            yield held_langs, held
            held_langs, held, size = [], [], 0
    if held:
        yield held_langs, held


def words(langs: list[str], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes in lower case, and of each word: where it begins and ends, its document, its place (0.., a gap between pieces), its key."""
    b = _LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    kind = _KIND[b]
    edge = np.ones(len(b) + 2, dtype=np.int8)
    edge[1:-1] = kind != 0
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    breaks = np.flatnonzero(kind == 2)
    piece = np.searchsorted(breaks, starts)
    gap = np.ones(len(starts), dtype=np.int64)
    gap[1:] += piece[1:] != piece[:-1]
    keys = span_hashes(b, starts, ends)
    names, which = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
    salts = np.array([int(pd.util.hash_array(np.array([n], dtype=object))[0]) for n in names], dtype=np.uint64)
    return b, starts, ends, doc, np.cumsum(gap) - 1, mixed(keys ^ salts[which][doc]) if len(keys) else keys


def _packed(places: np.ndarray) -> bytes:
    """Steps from place to place, the first bytes of all numbers, then the second: runs that compress well."""
    return np.diff(places, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _places(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, dtype=np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(-1), dtype=np.int32)


FILE = "words long, places binary, sizes array<int>, terms array<string>, langs array<string>"


class _Block:
    """Words gathered for a block; each distinct word's letters are kept once."""

    def __init__(self):
        self.places, self.keys, self.n, self.at = [], [], 0, 0
        self.terms: dict[int, tuple[str, str]] = {}

    def add(self, langs: list[str], texts: list[bytes]) -> None:
        b, starts, ends, doc, place, keys = words(langs, texts)
        if not len(keys):
            return
        self.places.append(place + self.at)
        self.keys.append(keys)
        self.at += int(place[-1]) + 2
        self.n += len(keys)
        found, first = np.unique(keys, return_index=True)
        raw = b.tobytes()
        for k, s, e, d in zip(found.tolist(), starts[first].tolist(), ends[first].tolist(), doc[first].tolist()):
            if k not in self.terms:
                self.terms[k] = (raw[s:e].decode("utf-8", "replace"), langs[d])

    def closed(self) -> pd.DataFrame:
        keys, places = np.concatenate(self.keys), np.concatenate(self.places).astype(np.int32)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        own = keys[heads]
        named = [self.terms[k] for k in own.tolist()]
        sizes = np.diff(np.append(heads, len(keys))).astype(np.int32)
        return pd.DataFrame({"words": [self.n], "places": [_packed(places[order])], "sizes": [sizes], "terms": [[t for t, _ in named]], "langs": [[x for _, x in named]]})


def _inverted(block_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _Block()
        for batch in batches:
            for langs, texts in _chunks(batch["lang"].tolist(), batch["text"].tolist()):
                block.add(langs, texts)
                if block.n >= block_words:
                    yield block.closed()
                    block = _Block()
        if block.n:
            yield block.closed()

    return run


def _planes(numbers: np.ndarray, kind: str) -> bytes:
    """The first bytes of all numbers, then the second."""
    a = np.ascontiguousarray(numbers, dtype=kind)
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(planes, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


def _joined(arrays: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype=kind)


def _framed(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


#: Which lists of a part of a block are frequent (at, their numbers there) and the keys of their phrases, ascending.
MARKS = "block long, part int, at binary, keys binary"
#: A block's lists have a row of part -1 (places, sizes, how many lists are of each part), and a row for each part with what is summed: left, right, length.
LISTS = "block long, part int, places binary, sizes binary, counts array<int>, lefts binary, rights binary, lengths binary"
#: Marks, and rows of frequent phrases.
SUMMED = "block long, part int, at binary, keys binary, key long, left long, right long, f long"


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (block, i, key) as marks of part 0, so many rows of a block together as are held at a time."""

    def packed(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held).sort_values(["block", "key"])
        return _framed([(block, 0, _planes(own["i"], "<i4"), _planes(np.diff(own["key"], prepend=0), "<i8")) for block, own in rows.groupby("block")], MARKS)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= GATHERED:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def _extender(parts: int, last: bool):
    """The lists of a block's phrases of one word more, of frequent parts both; lists are in order of (part, left, right)."""

    def run(file: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if not len(file) or not len(marks):
            return _framed([], LISTS)
        block, places, sizes, counts = file[["block", "places", "sizes", "counts"]].iloc[0]
        sizes, places = _numbers(sizes, "<i4") if isinstance(sizes, bytes) else np.asarray(sizes), _places(places)
        first = np.append(0, np.cumsum(np.asarray(counts)))
        at = np.concatenate([_numbers(x, "<i4") + first[p] for p, x in zip(marks["part"], marks["at"])])
        key = np.zeros(len(sizes), dtype=np.int64)
        known = np.zeros(len(sizes), dtype=bool)
        key[at], known[at] = np.concatenate([np.cumsum(_numbers(x, "<i8")) for x in marks["keys"]]), True
        whose = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        held = known[whose]
        whose, places = whose[held], places[held]
        begins = np.full(int(places.max()) + 2, -1, dtype=np.int32)  # the frequent phrase that begins at each place
        begins[places] = whose
        begin = np.flatnonzero((begins[:-1] >= 0) & (begins[1:] >= 0)).astype(np.int32)
        if not len(begin):
            return _framed([], LISTS)
        pair = begins[begin].astype(np.int64) * len(sizes) + begins[begin + 1]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        left, right = (key[x] for x in np.divmod(pair[heads], len(sizes)))
        n = np.diff(np.append(heads, len(pair)))
        part = (mixed(mixed(left.astype(np.uint64)) ^ right.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        dealt = np.lexsort((right, left, part))
        left, right, n, heads = left[dealt], right[dealt], n[dealt], heads[dealt]
        edges = np.searchsorted(part[dealt], np.arange(parts + 1))
        rows: list[tuple] = []
        if not last:
            inside = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n - heads, n)
            rows.append((block, -1, _packed(begin[order][inside]), _planes(n, "<i4"), np.diff(edges).astype(np.int32), None, None, None))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[p], edges[p + 1])
            rows.append((block, p, None, None, None, _planes(np.diff(left[own], prepend=0), "<i8"), _planes(right[own], "<i8"), _planes(n[own], "<i4")))
        return _framed(rows, LISTS)

    return run


def _summer(least: int, parts: int, last: bool):
    """Sums a part's lengths over all blocks. Frequent phrases are numbered in order of (left, right): the key is that number times parts, plus the part."""

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        part = int(lists["part"].iloc[0])
        lengths = [_numbers(x, "<i4") for x in lists["lengths"]]
        left = _joined([np.cumsum(_numbers(x, "<i8")) for x in lists["lefts"]], "<i8")
        right = _joined([_numbers(x, "<i8") for x in lists["rights"]], "<i8")
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
        heads = np.flatnonzero(new)
        f = np.add.reduceat(np.concatenate(lengths)[order].astype(np.int64), heads)
        often = f >= least
        keys = (np.cumsum(often) - 1) * parts + part
        found = heads[often]
        out = pd.DataFrame({"key": keys[often], "left": left[found], "right": right[found], "f": f[often]})
        marks: list[tuple] = []
        if not last:
            phrase = np.empty(len(order), dtype=np.int64)
            phrase[order] = np.cumsum(new) - 1
            for block, own in zip(lists["block"], np.split(phrase, np.cumsum([len(x) for x in lengths])[:-1])):
                at = np.flatnonzero(often[own])
                if len(at):
                    marks.append((block, part, _planes(at, "<i4"), _planes(np.diff(keys[own[at]], prepend=0), "<i8")))
        columns = [c.split()[0] for c in SUMMED.split(", ")]
        frames = [x.reindex(columns=columns).astype({c: "Int64" for c in ("block", "part", "key", "left", "right", "f")}).astype({c: object for c in ("at", "keys")}) for x in (out, _framed(marks, MARKS))]
        frames = [x for x in frames if len(x)]
        whole = pd.concat(frames) if frames else pd.DataFrame(columns=columns)
        return whole.assign(**{c: whole[c].where(whole[c].notna(), None) for c in ("at", "keys")})

    return run


def _folder(df: DataFrame) -> str:
    cut(df.sparkSession.range(1))  # sets a folder where none is set
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/phrases-{uuid.uuid4().hex}"


#: Spark's setting by which the files of a query's shuffles go when the query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, path: str) -> DataFrame:
    """df written to the shared folder and read back; of what it was made of nothing stays on the executors' disks."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _exploded(lists: DataFrame, *names: str) -> DataFrame:
    """A row for each list: block, i (its number there), and these; the arrays themselves are in no row."""
    return lists.select("block", F.posexplode(F.arrays_zip(*names)).alias("i", "entry")).select("block", "i", *(F.col(f"entry.{n}") for n in names))


def _frequent(each: DataFrame, phrase: list[str], least: int) -> DataFrame:
    """The lists (block, i, phrase) of the phrases that occur so often, with f, the sum of their lengths n. A phrase has one row for each block it is in,
    so what meets for a phrase is its blocks, never its places; all lists are dealt once, and only the frequent ones' go on."""
    summed = each.withColumn("f", F.sum(F.col("n").cast("long")).over(Window.partitionBy(*phrase)))
    return summed.where(F.col("f") >= least).select("block", "i", *phrase, "f")


def _dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, where the session's file system has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Mined:
    """levels[k]: key, lang, f, w1.. (keys of its words), and for phrases left and right, of every frequent phrase of k words; totals: lang, n."""

    def __init__(self, levels: dict[int, DataFrame], totals: DataFrame):
        self.levels, self.totals = levels, totals


def mined(df: DataFrame, least: int = LEAST, longest: int = LONGEST, block_words: int = BLOCK_WORDS, part_words: int = PART_WORDS) -> Mined:
    """Every phrase of up to ``longest`` words that occurs ``least`` times in its language, with its exact frequency.

    Each level's lists, marks and frequent phrases are written to the shared folder once; lists and marks go when the next level's lists are written.
    """
    folder = _folder(df)
    rows = df.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text").where(F.col("text").isNotNull())
    lists = _stored(rows.mapInPandas(_inverted(block_words), FILE).withColumn("block", F.monotonically_increasing_id()), f"{folder}/1")
    total = _exploded(lists, "langs", "sizes").groupBy(F.col("langs").alias("lang")).agg(F.sum(F.col("sizes").cast("long")).alias("n"))
    total = _stored(total, f"{folder}/totals")
    each = _exploded(lists, "langs", "terms", "sizes").toDF("block", "i", "lang", "term", "n")
    often = _stored(_frequent(each, ["lang", "term"], least), f"{folder}/often1")
    numbered = _stored(often.select("lang", "term", "f").distinct().withColumn("id", F.monotonically_increasing_id()), f"{folder}/phrases1")
    row, task = F.col("id").bitwiseAND((1 << 33) - 1), F.shiftright("id", 33)
    tasks = (numbered.agg(F.max(task)).first()[0] or 0) + 1
    levels = {1: numbered.select("lang", "term", "f", (row * tasks + task).alias("key")).withColumn("w1", F.col("key"))}  # small numbers, which pack well
    marks = often.select("block", "i", "lang", "term").join(levels[1].select("lang", "term", "key"), ["lang", "term"]).select("block", "i", "key")
    marks = _stored(marks.mapInPandas(_gathered, MARKS), f"{folder}/marks1")
    _dropped(df.sparkSession, f"{folder}/often1")
    parts = int((total.agg(F.sum("n")).first()[0] or 0) // part_words) + 1
    file = lists.select("block", "places", "sizes", F.array(F.size("sizes")).alias("counts"))
    for k in range(2, longest + 1):
        frequent = marks.select(F.col("block").alias("of_block"), "part", "at", "keys").groupBy("of_block")
        lists = _stored(file.groupBy("block").cogroup(frequent).applyInPandas(_extender(parts, k == longest), LISTS), f"{folder}/{k}")
        _dropped(df.sparkSession, f"{folder}/{k - 1}")
        _dropped(df.sparkSession, f"{folder}/marks{k - 1}")
        each = lists.where("part >= 0").select("block", "part", "lefts", "rights", "lengths")
        marks = _stored(each.groupBy("part").applyInPandas(_summer(least, parts, k == longest), SUMMED), f"{folder}/marks{k}")
        first = levels[k - 1].select(F.col("key").alias("left"), "lang", *(f"w{j}" for j in range(1, k)))
        last = levels[k - 1].select(F.col("key").alias("right"), F.col(f"w{k - 1}").alias(f"w{k}"))
        levels[k] = _stored(marks.where("f is not null").select("key", "left", "right", "f").join(first, "left").join(last, "right"), f"{folder}/phrases{k}")
        marks, file = marks.where("at is not null").select("block", "part", "at", "keys"), lists.where("part = -1").select("block", "places", "sizes", "counts")
    for name in (longest, f"marks{longest}"):
        _dropped(df.sparkSession, f"{folder}/{name}")
    return Mined(levels, total)


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """Exact: the product may pass 64 bits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * a.cast("decimal(20,0)"), (l + r).cast("decimal(20,0)"))


def scored(found: Mined) -> DataFrame:
    """lang, words (keys), a, l, r, score of every candidate that no longer one covers."""
    longest = max(found.levels)
    f = {k: d.select(F.col("key"), F.col("f")) for k, d in found.levels.items()}
    outs = []
    for k in range(2, longest + 1):
        c = found.levels[k].select("key", "lang", "left", "right", F.col("f").alias("a"), F.array(*(f"w{j}" for j in range(1, k + 1))).alias("words"))
        if k < longest:  # the next level's phrases that begin or end with this one
            up = found.levels[k + 1]
            cover = up.select(F.explode(F.array("left", "right")).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
            c = c.join(cover, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < COVERED * F.col("a").cast("decimal(20,0)")))
        # Parts: heads[j] is the key of the first j words, tails[j] that of the last j; each step down is a join with the level below.
        heads, tails = {k - 1: "left"}, {k - 1: "right"}
        for j in range(k - 1, 1, -1):
            below = found.levels[j]
            c = c.join(below.select(F.col("key").alias(heads[j]), F.col("left").alias(f"head{j - 1}")), heads[j])
            c = c.join(below.select(F.col("key").alias(tails[j]), F.col("right").alias(f"tail{j - 1}")), tails[j])
            heads[j - 1], tails[j - 1] = f"head{j - 1}", f"tail{j - 1}"
        cuts = []
        for j in range(1, k):
            c = c.join(f[j].toDF(heads[j], f"l{j}"), heads[j]) if f"l{j}" not in c.columns else c
            c = c.join(f[k - j].toDF(tails[k - j], f"r{j}"), tails[k - j])
            cuts.append(F.struct(_score(F.col("a"), F.col(f"l{j}"), F.col(f"r{j}")).alias("score"), F.lit(j).alias("cut"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")))
        best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        outs.append(c.select("lang", "words", "a", best.alias("best")).select("lang", "words", "a", "best.l", "best.r", "best.score"))
    out = outs[0]
    for more in outs[1:]:
        out = out.unionByName(more)
    return out


def collocations(df: DataFrame, top: int = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` candidates, by score, then a, both descending, then the phrase's UTF-8 bytes.

    A language's candidates are ranked in parts by hash first, ties kept, and only the parts' best meet.
    """
    found = mined(df, **options)
    every = _stored(scored(found), _folder(df) + "/scored")
    order = [F.desc("score"), F.desc("a")]
    part = F.pmod(F.xxhash64("words"), F.lit(RANKED_IN))
    some = every.withColumn("place", F.rank().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= top)
    some = some.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place")
    some = some.withColumn("id", F.xxhash64("words"))
    terms = found.levels[1].select("key", "term")
    spelt = some.select("id", F.posexplode("words").alias("i", "key")).join(terms, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "term"))).alias("spelt"))
    out = some.join(spelt, "id").withColumn("phrase", F.array_join(F.col("spelt.term"), " "))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    return out.join(found.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
placed AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM listed WHERE len(ws) > 0),
totals AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
grams AS (SELECT lang, ws[i:i + k - 1] AS p, k FROM placed, (VALUES (1), (2), (3), (4)) v(k) WHERE i + k - 1 <= len(ws)),
f AS MATERIALIZED (SELECT lang, p, k, count(*) AS f FROM grams GROUP BY lang, p, k),
candidates AS MATERIALIZED (SELECT lang, p, k, f AS a FROM f WHERE k > 1 AND f >= 30),
covers AS (
  SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([p[1:k - 1], p[2:k]]) AS part FROM candidates WHERE k > 2) GROUP BY lang, part),
halves AS MATERIALIZED (SELECT lang, p, a, j, p[1:j] AS head, p[j + 1:k] AS tail FROM candidates, (VALUES (1), (2), (3)) v(j) WHERE j < k),
cuts AS (
  SELECT c.lang, c.p, c.a, j, h.f AS l, t.f AS r, (2000000::HUGEINT * c.a) // (h.f + t.f) AS score
  FROM halves c LEFT JOIN f h ON h.lang = c.lang AND h.p = c.head LEFT JOIN f t ON t.lang = c.lang AND t.p = c.tail),
best AS (SELECT lang, p, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
kept AS (SELECT b.* FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.part = b.p WHERE c.longer IS NULL OR 100::HUGEINT * c.longer < 80::HUGEINT * b.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score
  FROM kept)
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN totals USING (lang) WHERE rank <= 2000
"""
