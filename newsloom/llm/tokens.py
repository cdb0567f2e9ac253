"""Exact ids of the public tokenizers, with a bounded memory of chunks that were encoded before.

No merge of these vocabularies reaches over white space, so a text's ids are its chunks' ids in turn.
Where that can't be relied on (runs of white space, rare controls), the whole text is encoded at once.

Texts are cut into chunks, and chunks looked up, in numpy over the UTF-8 bytes of many texts together: a chunk is known by
a 64-bit hash of its bytes, a table with open addressing holds where its ids stand in one array. Only chunks that the
table lacks become Python strings and reach the tokenizer. When the table is full, chunks that have not been met again
since they came are forgotten. At n different chunks about n^2 / 2^65 pairs would share a hash: 10^-7 at two million, twice what is kept.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from .common import span_hashes

#: Chunks remembered by one Python worker, about 70 MB; beyond, those that were met once are encoded again.
REMEMBERED = 1_000_000
AT_ONCE = 1_000_000
#: Bytes hashed together, which bounds what one very long text needs besides its chunks.
HASHED = 1 << 20
ODD = 0xFFFF
_HEAD = np.uint64(0xA24BAED4963EE407)


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memory:
    """Hash of a chunk -> its ids; a chunk that is no unit of its own has the count ODD."""

    def __init__(self, slots: int = 1 << 16):
        self.ids = np.empty(1 << 16, dtype=np.uint16)
        self.filled = self.entries = 0
        self._open(slots)

    def _open(self, slots: int) -> None:
        self.keys = np.zeros(slots, dtype=np.uint64)
        self.begins = np.zeros(slots, dtype=np.uint32)
        self.counts = np.zeros(slots, dtype=np.uint16)
        self.again = np.zeros(slots, dtype=bool)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        mask = len(self.keys) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == hashes, at, -1)
        todo = np.flatnonzero((held != hashes) & (held != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            held = self.keys[at[todo]]
            same = held == hashes[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same & (held != 0)]
        return out

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        """Slots for hashes that differ and are not in the table."""
        mask = len(self.keys) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = hashes[free]  # of several that want one slot, one gets it
            todo = todo[self.keys[at[todo]] != hashes[todo]]
            at[todo] = (at[todo] + 1) & mask
        return at

    def add(self, hashes: np.ndarray, ids: list[bytes | None]) -> None:
        """Hashes that differ and are not in the table, with uint16 ids; None, or too many for a count: odd."""
        ids = [x if x is not None and len(x) < 2 * ODD else None for x in ids]
        if 2 * (self.entries + len(hashes)) > len(self.keys):
            self._rebuild(self.keys != 0, 1 << (2 * (self.entries + len(hashes))).bit_length())
        flat = np.frombuffer(b"".join(x or b"" for x in ids), dtype=np.uint16)
        counts = np.array([ODD if x is None else len(x) // 2 for x in ids], dtype=np.uint16)
        room = self.filled + len(flat)
        if room > len(self.ids):
            grown = np.empty(2 * room, dtype=np.uint16)
            grown[: self.filled] = self.ids[: self.filled]
            self.ids = grown
        self.ids[self.filled : room] = flat
        size = np.where(counts == ODD, 0, counts).astype(np.int64)
        at = self._place(hashes)
        self.begins[at], self.counts[at], self.again[at] = self.filled + np.cumsum(size) - size, counts, False
        self.filled, self.entries = room, self.entries + len(hashes)

    def _rebuild(self, kept: np.ndarray, slots: int) -> None:
        at = np.flatnonzero(kept)
        keys, begins, counts, again = self.keys[at], self.begins[at], self.counts[at], self.again[at]
        self._open(max(1 << 16, slots))
        self.entries = len(keys)
        new = self._place(keys)
        self.begins[new], self.counts[new], self.again[new] = begins, counts, again

    def forget(self, most: int) -> None:
        """If there are more entries than that: keep those met again, and none of the marks."""
        if self.entries <= most:
            return
        kept = self.again if np.count_nonzero(self.again) <= most // 2 else np.zeros_like(self.again)
        self._rebuild(kept, 1 << (2 * max(1, int(np.count_nonzero(kept)))).bit_length())
        self.again[:] = False
        at = np.flatnonzero(self.keys)
        size = np.where(self.counts[at] == ODD, 0, self.counts[at]).astype(np.int64)
        self.ids = self.ids[spread(self.begins[at].astype(np.int64), size)]
        self.begins[at] = np.cumsum(size) - size
        self.filled = len(self.ids)


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for so many as sizes[0], then begins[1], ..."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


class _Encoder:
    """ids() of texts; a subclass says how bytes fall into chunks, which are sound, and how to encode many together."""

    separators: bytes

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        self.memory = Memory()
        self.parts = np.zeros(256, dtype=bool)
        self.parts[list(self.separators)] = True
        self.stops = {c: self.whole(c) for c in ".,"}

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint16)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """uint16 ids of each text."""
        if not texts:
            return []
        raw = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        seps = np.flatnonzero(self.parts[data])
        per = np.diff(np.searchsorted(seps, offsets)) + 1  # chunks of each text, empty ones with them
        starts = np.sort(np.concatenate((offsets[:-1], seps + 1)), kind="stable")
        ends = np.sort(np.concatenate((seps, offsets[1:])), kind="stable")
        first = np.cumsum(per) - per
        heads, lines, odd = self.marked(data, starts, ends, first, per)
        counts = np.zeros(len(starts), dtype=np.int64)
        begins = np.zeros(len(starts), dtype=np.int64)
        some = np.flatnonzero(ends > starts)
        if len(some):
            slots = self._slots(data, starts[some], ends[some], heads[some])
            found = self.memory.counts[slots]
            odd[some] |= found == ODD
            counts[some] = np.where(found == ODD, 0, found)
            begins[some] = self.memory.begins[slots]
        size = counts + lines
        out = np.empty(int(size.sum()), dtype=np.uint16)
        at = np.cumsum(size) - size
        if lines.any():
            out[at[lines]] = self.newline
            out[spread(at + lines, counts)] = self.memory.ids[spread(begins, counts)]
        else:
            out[:] = self.memory.ids[spread(begins, counts)]
        bounds = np.append(at[first], len(out))
        found = [out[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
        if odd.any():
            for i in np.unique(np.repeat(np.arange(len(texts)), per)[odd]):
                found[i] = self._ids(texts[i])
        self.memory.forget(REMEMBERED)
        return found

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), dtype=np.uint64)
        cuts = np.searchsorted(ends, np.arange(int(ends[0]) + HASHED, int(ends[-1]), HASHED), side="right") if len(ends) else []
        for i, j in zip(np.concatenate(([0], cuts)).astype(np.int64), np.append(cuts, len(starts)).astype(np.int64)):
            out[i:j] = span_hashes(data, starts[i:j], ends[i:j])
        out ^= np.where(heads, _HEAD, np.uint64(0))
        return np.maximum(out, np.uint64(1))

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where the table has each of these chunks; those it lacks are encoded first."""
        hashes = self._hashes(data, starts, ends, heads)
        slots = self.memory.find(hashes)
        self.memory.again[slots[slots >= 0]] = True
        gone = np.flatnonzero(slots < 0)
        if not len(gone):
            return slots
        new, which = np.unique(hashes[gone], return_index=True)
        at = gone[which]
        order = np.argsort(starts[at])
        self._learn(data, starts[at[order]], ends[at[order]], heads[at[order]], new[order])
        return self.memory.find(hashes)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray, hashes: np.ndarray) -> None:
        """Encode chunks that the table lacks. What ends in a full stop or comma after a letter is the rest's ids and the stop's."""
        raw = data.tobytes()
        names = [raw[i:j].decode() for i, j in zip(starts.tolist(), ends.tolist())]
        sound = [self.sound(x) for x in names]
        stop = np.array([ok and len(x) > 1 and x[-1] in self.stops and x[-2].isalpha() for x, ok in zip(names, sound)], dtype=bool)
        base = hashes.copy()
        if stop.any():
            base[stop] = self._hashes(data, starts[stop], ends[stop] - 1, heads[stop])
        known = self.memory.find(base)
        known = {h: self._held(s) for h, s in zip(base[known >= 0].tolist(), known[known >= 0].tolist())}
        base = base.tolist()
        need = {h: (x[:-1] if s else x, head) for h, x, s, head, ok in zip(base, names, stop.tolist(), heads.tolist(), sound) if ok and h not in known}
        for i in range(0, len(need), 20_000):
            some = dict(list(need.items())[i : i + 20_000]) if len(need) > 20_000 else need
            known.update(zip(some, self.encoded(list(some.values())), strict=True))
        made = {h: (known[b] + self.stops[x[-1]] if s else known[b]) if ok else None for h, b, x, s, ok in zip(hashes.tolist(), base, names, stop.tolist(), sound)}
        made.update((h, known[h]) for h in need if h not in made)
        self.memory.add(np.fromiter(made, dtype=np.uint64, count=len(made)), list(made.values()))

    def _held(self, slot: int) -> bytes:
        begin = int(self.memory.begins[slot])
        return self.memory.ids[begin : begin + int(self.memory.counts[slot])].tobytes()


class ByteEncoder(_Encoder):
    """Byte-level vocabulary: a chunk is what stands between spaces and newlines.

    Where each space or newline stands between two other characters than white space, a token begins
    at each and a newline is a token of its own. A chunk at the head of a line has no space before it and is
    told from one that has.
    """

    separators = b" \n"

    def __init__(self, path: str):
        super().__init__(path)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        (self.newline,) = self._ids("\n")

    def marked(self, data, starts, ends, first, per):
        """Which chunks are heads, which follow a newline, which make their text odd."""
        lines = np.zeros(len(starts), dtype=bool)
        inner = np.ones(len(starts), dtype=bool)
        inner[first] = False
        lines[inner] = data[starts[inner] - 1] == 10
        # an empty chunk stands in a run of white space, or at an end; a text of one line may begin with a space, or be empty
        odd = ends == starts
        odd[first] &= np.add.reduceat(lines, first) > 0
        return lines | ~inner, lines, odd

    def sound(self, chunk: str) -> bool:
        return not chunk[0].isspace() and not chunk[-1].isspace() and "<|" not in chunk

    def encoded(self, chunks: list[tuple[str, bool]]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        for head in (False, True):
            at = [i for i, c in enumerate(chunks) if c[1] == head]
            if at:
                joined = ("\n" if head else " ").join(chunks[i][0] for i in at)
                ids = self._ids(joined if head else f" {joined}")
                raw = ids.tobytes()
                if head:
                    marks = (2 * np.flatnonzero(ids == self.newline)).tolist()
                    spans = zip([0, *(x + 2 for x in marks)], [*marks, len(raw)], strict=True)
                else:
                    marks = (2 * np.append(np.flatnonzero(self.opens[ids]), len(ids))).tolist()
                    spans = zip(marks[:-1], marks[1:], strict=True)
                for i, (a, b) in zip(at, spans, strict=True):
                    out[i] = raw[a:b]
        return out


class WordEncoder(_Encoder):
    """Vocabulary with word ends that drops white space: a chunk is what stands between white space of ASCII."""

    separators = b" \t\n\x0b\x0c\r"
    newline = 0

    def __init__(self, path: str):
        super().__init__(path)
        (self.mark,) = self._ids("\x01")

    def marked(self, data, starts, ends, first, per):
        none = np.zeros(len(starts), dtype=bool)
        return none, none, none.copy()

    def sound(self, chunk: str) -> bool:
        return "\x01" not in chunk and "<|" not in chunk and not any(c in chunk for c in "\x1c\x1d\x1e\x1f")

    def encoded(self, chunks: list[tuple[str, bool]]) -> list[bytes]:
        ids = self._ids(" \x01 ".join(c for c, _ in chunks))
        raw, at = ids.tobytes(), (2 * np.flatnonzero(ids == self.mark)).tolist()
        return [raw[i:j] for i, j in zip([0, *(x + 2 for x in at)], [*at, len(raw)], strict=True)]


@lru_cache(maxsize=2)
def encoder(kind: str, path: str) -> _Encoder:
    """One per Python worker: 'bytes' or 'words'."""
    return {"bytes": ByteEncoder, "words": WordEncoder}[kind](path)


def in_batches(texts: list[str], limit: int = AT_ONCE) -> list[list[str]]:
    """Consecutive texts of at most limit characters together (or one that is longer)."""
    out: list[list[str]] = []
    held = 0
    for t in texts:
        if not out or held + len(t) > limit:
            out.append([])
            held = 0
        out[-1].append(t)
        held += len(t)
    return out


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
