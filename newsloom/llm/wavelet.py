"""Token-ID output: one wavelet matrix file per shard of consecutive documents.

File format ``NLWM`` (little-endian): a header of magic and six uint64 (version, documents, tokens,
levels, bits in a block, bytes of the directory), the directory (zeros per level; ones before each block;
where each block ends), the zstd-compressed document ids and token offsets, and the bit-planes as blocks
that are compressed one by one. Level 0 has the highest bit of every id in order; each next level has the
ids sorted stably by the bits before. ``access``, ``rank``, ``count`` and ``select`` open only the blocks
they need; ``tokens`` rebuilds everything from the planes.

Executors can write only where the session's writers reach, so ``write`` keeps the files as rows
(file_name, payload) of a Parquet table; ``export`` unpacks them to a local folder.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, deal_in_order, size_of
from .tokens import encoder, in_batches

MAGIC = b"NLWM"
HEADER = struct.Struct("<4s6Q")
BLOCK = 1 << 18
END = 0
NULL_ID = -(1 << 63)


def split(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where bits are off, and where they are on; numbers, as masks cost a wrong guess of the processor at every other bit."""
    return np.flatnonzero(~bits), np.flatnonzero(bits)


def pack(doc_ids: list[int | None], offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes: documents and all their ids one after another; offsets has one more than documents."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = max(1, int(ids.max(initial=0)).bit_length())
    a = ids.astype(np.uint16) if levels <= 16 else ids
    zip_ = zstandard.ZstdCompressor(level=1)
    zeros, before, ends, blocks = [], [], [], []
    size = 0
    for level in reversed(range(levels)):
        bits = (a >> a.dtype.type(level)) & a.dtype.type(1) != 0
        packed = np.packbits(bits, bitorder="little")
        z = len(ids) - int(np.count_nonzero(bits))
        below, ones = np.empty_like(a), 0
        for i in range(0, len(ids), BLOCK):
            blocks.append(zip_.compress(packed[i // 8 : (i + BLOCK) // 8].tobytes()))
            before.append(ones)
            size += len(blocks[-1])
            ends.append(size)
            off, on = split(bits[i : i + BLOCK])
            below[i - ones : i - ones + len(off)] = a[i : i + BLOCK].take(off)
            below[z + ones : z + ones + len(on)] = a[i : i + BLOCK].take(on)
            ones += len(on)
        zeros.append(z)
        a = below
    directory = np.array([*zeros, *before, *ends], dtype="<u8").tobytes()
    named = np.array([NULL_ID if x is None else x for x in doc_ids], dtype="<i8").tobytes()
    docs = zip_.compress(named + np.asarray(offsets, dtype="<u8").tobytes())
    return b"".join((HEADER.pack(MAGIC, 1, len(doc_ids), len(ids), levels, BLOCK, len(directory)), directory, struct.pack("<Q", len(docs)), docs, *blocks))


class WaveletFile:
    """Reads what pack() made."""

    def __init__(self, data: bytes):
        magic, version, docs, self.n, self.levels, self.block, size = HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a wavelet file of this version")
        at = HEADER.size
        table = np.frombuffer(data, "<u8", size // 8, at).astype(np.int64)
        at += size
        per = -(-self.n // self.block)
        self.zeros, rest = table[: self.levels], table[self.levels :]
        self.before, self.ends = rest[: self.levels * per], rest[self.levels * per :]
        (size,) = struct.unpack_from("<Q", data, at)
        both = zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size])
        self.doc_ids = np.frombuffer(both, "<i8", docs)
        self.offsets = np.frombuffer(both, "<u8", docs + 1, 8 * docs).astype(np.int64)
        self.data, self.start, self.per = data, at + 8 + size, per
        self._held: dict[int, np.ndarray] = {}

    def _bytes(self, k: int) -> np.ndarray:
        begin = self.start + (int(self.ends[k - 1]) if k else 0)
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[begin : self.start + int(self.ends[k])]), np.uint8)

    def _block(self, level: int, at: int) -> tuple[int, np.ndarray]:
        k = level * self.per + at // self.block
        if k not in self._held:
            if len(self._held) > 4 * self.levels:
                self._held.clear()
            self._held[k] = self._bytes(k)
        return k, self._held[k]

    def _ones(self, level: int, at: int) -> int:
        """Ones of a level before a position."""
        if at >= self.n:
            return self.n - int(self.zeros[level])
        k, b = self._block(level, at)
        at %= self.block
        full = int(np.bitwise_count(b[: at // 8]).sum())
        return int(self.before[k]) + full + (int(b[at // 8]) & ((1 << at % 8) - 1)).bit_count()

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.levels):
            _, b = self._block(level, at)
            bit = int(b[at % self.block // 8]) >> (at % 8) & 1
            ones = self._ones(level, at)
            value = value << 1 | bit
            at = int(self.zeros[level]) + ones if bit else at - ones
        return value

    def rank(self, token: int, at: int) -> int:
        """Occurrences of an id before a position."""
        if token >> self.levels:
            return 0
        begin, end = 0, min(at, self.n)
        for level in range(self.levels):
            i, j = self._ones(level, begin), self._ones(level, end)
            if token >> (self.levels - 1 - level) & 1:
                begin, end = int(self.zeros[level]) + i, int(self.zeros[level]) + j
            else:
                begin, end = begin - i, end - j
        return end - begin

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        return self.rank(token, self.n if end is None else end) - self.rank(token, begin)

    def _find(self, level: int, bit: int, nth: int) -> int:
        """Where the nth (from 0) such bit of a level stands."""
        lo = level * self.per
        ones = self.before[lo : lo + self.per]
        less = ones if bit else np.arange(self.per) * self.block - ones
        k = int(np.searchsorted(less, nth, side="right")) - 1
        bits = np.unpackbits(self._block(level, k * self.block)[1], bitorder="little")[: self.n - k * self.block]
        return k * self.block + int(np.flatnonzero(bits == bit)[nth - int(less[k])])

    def select(self, token: int, nth: int) -> int:
        """Where the nth (from 0) occurrence of an id stands."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        begin = 0
        for level in range(self.levels):
            ones = self._ones(level, begin)
            begin = int(self.zeros[level]) + ones if token >> (self.levels - 1 - level) & 1 else begin - ones
        at = begin + nth
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._find(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids in order, rebuilt from the planes."""
        value = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            planes = [self._bytes(level * self.per + k) for k in range(self.per)]
            bits = np.unpackbits(np.concatenate(planes) if planes else np.empty(0, np.uint8), bitorder="little")[: self.n] != 0
            above = np.empty_like(value)
            z = int(self.zeros[level])
            value[z:] |= value.dtype.type(1 << (self.levels - 1 - level))
            ones = 0
            for i in range(0, self.n, BLOCK):
                off, on = split(bits[i : i + BLOCK])
                part = above[i : i + BLOCK]
                part[off], part[on] = value[i - ones : i - ones + len(off)], value[z + ones : z + ones + len(on)]
                ones += len(on)
            value = above
        return value


FILES = "shard int, part int, file_name string, n_docs long, n_tokens long, payload binary"
#: Ids held for one file, two bytes each; a range of documents that has more goes on in the next file.
IDS_A_FILE = 16 << 20
#: Ranges of doc_id, and so the tasks that write, whatever the input's size.
SHARDS = 65_536
#: Files whose two numbers are broadcast, 32 MB; more are joined.
BROADCAST_FILES = 1_000_000


def _pack_shards(tokenizer: str, ids_a_file: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, part, held, names, parts = None, 0, 0, [], []

        def closed():
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            data = pack(names, offsets, np.concatenate(parts))
            row = (shard, part, f"shard-{shard:06d}-{part:06d}.nlwm", len(names), int(offsets[-1]), data)
            return pd.DataFrame([row], columns=["shard", "part", "file_name", "n_docs", "n_tokens", "payload"])

        encode = encoder("bytes", tokenizer)
        end = np.array([END], dtype=np.uint16)
        for batch in batches:
            done = 0
            for some in in_batches(batch["text"].tolist()):
                rows = zip(batch["shard"].iloc[done : done + len(some)], batch["doc_id"].iloc[done : done + len(some)], encode.ids(some), strict=True)
                done += len(some)
                for at, doc_id, ids in rows:
                    if parts and (at != shard or held + len(ids) + 1 > ids_a_file):
                        yield closed()
                        held, names, parts = 0, [], []
                        part = part + 1 if at == shard else 0
                    shard = at
                    names.append(None if pd.isna(doc_id) else int(doc_id))
                    parts.append(np.append(ids, end))
                    held += len(ids) + 1
        if parts:
            yield closed()

    return run


def shard_files(df: DataFrame, tokenizer: str, bytes_a_shard: int = 8 << 20, ids_a_file: int = IDS_A_FILE) -> DataFrame:
    """One row (FILES) for each file: a shard is a range of ascending doc_id (nulls first; ties by text), its files are parts of it in order.

    A shard's texts stream through one task in order; only the ids of one file, two bytes each, are held, however long the shard is
    (beyond SHARDS shards they grow with the input, and rows of one doc_id are one shard). One text is never cut, so a very long one
    makes its file longer. Null texts are empty: the end id alone. An empty table has no file.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    _, size = size_of(rows)
    shards = min(size // bytes_a_shard + 1, SHARDS)
    return (
        deal_in_order(rows, "doc_id", "shard", shards).repartition(shards, "shard")
        .sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "text")
        .mapInPandas(_pack_shards(tokenizer, ids_a_file), FILES)
    )


def write(df: DataFrame, path: str, tokenizer: str, **options) -> str:
    shard_files(df, tokenizer, **options).write.mode("errorifexists").parquet(path)
    return path


def export(files: DataFrame, folder: str) -> list[str]:
    """Unpack files, one at a time, to a local folder."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for row in files.select("file_name", "payload").toLocalIterator():
        with open(os.path.join(folder, row["file_name"]), "wb") as f:
            f.write(row["payload"])
        out.append(f.name)
    return out


READ = "shard int, part int, doc_id long, n_docs_before long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for shard, part, payload in zip(batch["shard"], batch["part"], batch["payload"]):
            f = WaveletFile(bytes(payload))
            ids, at = f.tokens().astype("<u4"), f.offsets
            frame = pd.DataFrame({
                "shard": shard, "part": part, "doc_id": pd.array(f.doc_ids, dtype="Int64"), "n_docs_before": range(len(f.doc_ids)), "start": at[:-1], "n_tokens": np.diff(at),
                "ids_crc32": [zlib.crc32(ids[i:j].data) for i, j in zip(at[:-1], at[1:])],
            })
            frame.loc[f.doc_ids == NULL_ID, "doc_id"] = pd.NA
            yield frame


def read(files: DataFrame) -> DataFrame:
    """A row for each document of the files, decoded: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    # Ids of a shard's earlier files, within the shard; and of earlier shards, which are SHARDS at most.
    inside = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    parts = files.select("shard", "part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within"))
    totals = parts.join(F.broadcast(shards), "shard").select("shard", "part", (F.col("base") + F.col("within")).alias("base"))
    docs = files.select("shard", "part", "payload").mapInPandas(_read, READ)
    both = docs.join(F.broadcast(totals) if files.count() <= BROADCAST_FILES else totals, ["shard", "part"])
    return both.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "shard")


def encoded_and_read(spark: SparkSession, df: DataFrame, tokenizer: str) -> DataFrame:
    """Write df's files under the folder in spark.checkpoint.dir and read them back."""
    cut(spark.range(1))  # sets a folder where none is set
    folder = spark.sparkContext.getCheckpointDir()
    path = write(df, f"{folder}/nlwm-{uuid.uuid4().hex}", tokenizer)
    return read(spark.read.schema(FILES).parquet(path))
