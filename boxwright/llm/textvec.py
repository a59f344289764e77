"""Byte-level views of Arrow text columns.

Helpers for Python stages: they look at a whole Arrow batch of texts as one
byte buffer, find its words and hash them with numpy, so that no Python object
is made for a word.  Memory is bounded by ``BLOCK`` bytes of text (or by one
text, if that is longer).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step looks at.
BLOCK = 1_000_000

#: Words are runs of anything but these bytes (space, and tab to carriage return).
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: The first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed one by one.
_LONG = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and where each text starts and ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts that hold at most ``limit`` bytes, or one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the words before each text (n + 1 numbers)."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inside = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[inside] = solid[inside]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[offsets[1:][offsets[:-1] < offsets[1:]] - 1] |= solid[offsets[1:][offsets[:-1] < offsets[1:]] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands.

    Eight bytes at a time are mixed into the value by a step that isn't linear
    in them (sums of powers of a base would be: they give equal values for
    different texts, whatever the base).  Long spans go through BLAKE2.
    Different seeds give independent hashes.
    """
    size = ends - starts
    with np.errstate(over="ignore"):
        value = mix64((size.astype(np.uint64) + np.uint64(1)) * _STEP + np.uint64(seed) * _BASE)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # eight bytes from each place on
        todo, at, left = np.arange(len(starts)), starts, size
        for _ in range(_LONG // 8):
            on = (left > 0) & (size[todo] <= _LONG)
            if not on.all():
                todo, at, left = todo[on], at[on], left[on]
            if not len(todo):
                break
            lane = lanes[at] & _FIRST[np.minimum(left, 8)]
            value[todo] = mix64((value[todo] ^ lane) * _STEP + _BASE)
            at, left = at + 8, left - 8
    for k in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        value[k] = int.from_bytes(digest, "little")
    return value


def windows(hashes: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words, and the runs before each text.

    A text of fewer words (but at least one) has its whole sequence as its one run.
    """
    counts = np.diff(before)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], runs) + np.repeat(before[:-1], runs)
    length = np.repeat(np.minimum(counts, size), runs)
    with np.errstate(over="ignore"):
        out = length.astype(np.uint64) * _BASE
        for k in range(size):
            has = length > k
            if has.all():
                out = mix64(out * np.uint64(0x100000001B3) + hashes[at + k])
            else:
                out[has] = mix64(out[has] * np.uint64(0x100000001B3) + hashes[at[has] + k])
    return out, begin


def segment_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of segments, cut before each run of spaces that a plain character follows or one of ASCII goes before, and the segments before each text.

    Byte-level and piece tokenizers never join what such a space divides, so
    segments can be encoded one by one.  Pieces do join spaces with each other
    (and with U+2581, which stands for one), so a run is never cut within.  Plain
    characters are those of ASCII and of two-byte UTF-8 from U+00C0; none of them
    is white space.
    """
    first = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        ascii_ = (data > 0x20) & (data < 0x7F)
        plain = ascii_ | ((data >= 0xC3) & (data <= 0xDF))
        first[:-1] = (data[:-1] == 0x20) & plain[1:]
        first[1:] |= (data[1:] == 0x20) & ascii_[:-1]
        first[1:] &= (data[:-1] != 0x20) & (data[:-1] != 0x81)
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        first[ends] = False
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


class SegmentCache:
    """Encodes distinct segments once and remembers their ids, up to a bound.

    ``encode`` takes a list of byte strings and returns one id list for each.
    The memory is an open-addressing table of segment hashes; beyond ``limit``
    segments it starts anew, which changes speed only.  A hit counts only if a
    second, independent hash of the segment is the remembered one too; a segment
    that only shares the first is encoded by itself.
    """

    def __init__(self, encode, limit: int = 800_000, bits: int = 21):
        self.encode, self.limit, self.bits = encode, limit, bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.slots = np.zeros(1 << self.bits, dtype=np.int32)
        self.starts = np.zeros(1024, dtype=np.int64)
        self.lengths = np.zeros(1024, dtype=np.int32)
        self.checks = np.zeros(1024, dtype=np.uint64)
        self.ids = np.zeros(4096, dtype=np.int32)
        self.n, self.used = 0, 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of the hashes, -1 where unknown."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = np.full(len(hashes), -1, dtype=np.int64)
        place, todo = hashes & mask, np.arange(len(hashes))
        while len(todo):
            there = self.keys[place]
            hit = there == hashes[todo]
            slot[todo[hit]] = self.slots[place[hit]]
            on = ~hit & (there != 0)
            todo, place = todo[on], (place[on] + np.uint64(1)) & mask
        return slot

    def _add(self, hashes: np.ndarray, checks: np.ndarray, ids: list[list[int]]) -> None:
        """Distinct hashes that are not there yet."""
        lengths = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        flat = np.fromiter((x for one in ids for x in one), dtype=np.int32, count=int(lengths.sum()))
        n, used = self.n + len(ids), self.used + len(flat)
        while len(self.starts) < n:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.checks = np.concatenate([self.checks, np.zeros_like(self.checks)])
        while len(self.ids) < used:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : used] = flat
        self.lengths[self.n : n] = lengths
        self.checks[self.n : n] = checks
        self.starts[self.n : n] = self.used + np.cumsum(lengths) - lengths
        mask = np.uint64((1 << self.bits) - 1)
        place, todo = hashes & mask, np.arange(len(hashes))
        while len(todo):
            free = np.flatnonzero(self.keys[place] == 0)
            _, once = np.unique(place[free], return_index=True)
            won = free[once]
            self.keys[place[won]] = hashes[todo[won]]
            self.slots[place[won]] = self.n + todo[won]
            left = np.ones(len(todo), dtype=bool)
            left[won] = False
            todo, place = todo[left], (place[left] + np.uint64(1)) & mask
        self.n, self.used = n, used

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and the ids before each text (n + 1 numbers)."""
        starts, before = segment_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        hashes, checks = span_hashes(data, starts, ends), span_hashes(data, starts, ends, seed=1)
        hashes[hashes == 0] = 1
        raw: bytes | None = None

        def encoded(which: np.ndarray) -> list[list[int]]:
            nonlocal raw
            raw = data.tobytes() if raw is None else raw
            return self.encode([raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])

        slot = self._find(hashes)
        new = np.flatnonzero(slot < 0)
        if len(new):
            values, once = np.unique(hashes[new], return_index=True)
            if self.n + len(values) > self.limit:
                if len(values) > self.limit // 2:  # a block of its own words only
                    self.bits = max(self.bits, int(4 * len(values)).bit_length())
                    self.limit = max(self.limit, 2 * len(values))
                self.clear()
                new = np.arange(len(hashes))
                values, once = np.unique(hashes, return_index=True)
            which = new[once]
            self._add(values, checks[which], encoded(which))
            slot = self._find(hashes)
        known, begins, lengths = self.ids, self.starts[slot], self.lengths[slot].astype(np.int64)
        other = np.flatnonzero(self.checks[slot] != checks)
        if len(other):  # another segment has the same first hash
            extra = encoded(other)
            lengths[other] = [len(x) for x in extra]
            begins[other] = self.used + np.cumsum(lengths[other]) - lengths[other]
            known = np.concatenate([known[: self.used], np.fromiter((x for one in extra for x in one), dtype=np.int32)])
        upto = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(upto[-1]) + np.repeat(begins - upto[:-1], lengths)
        return known[at], upto[before]
