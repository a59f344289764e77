"""Hierarchical multi-length packing of token sequences.

Documents are tokenized and packed where they lie: every partition of the
input is packed by its own task, so nothing is shuffled, and a lost task is
simply run again with the same result.  In a partition

1. a document's whole windows of the longest tier become sequences of their own,
2. what is left of it is routed to the shortest tier (context size) that holds it,
3. each tier's windows are packed, longest documents first,
4. gaps of long windows are filled from the shorter tiers, the last one by
   cutting a shorter document at the gap,
5. windows are dealt into step groups with the same number of tokens each.

The window that is left open when a partition ends is cut along the binary
digits of its fill, so that it needs no padding either.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from boxwright.llm.textvec import SegmentCache, blocks, buffer_of

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, tier int, step_group bigint"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("tier", pa.int32()), ("step_group", pa.int64())]
)
#: Room for so many sequences in one partition.
_PER_PARTITION = 1 << 36

_encoders: dict[str, SegmentCache] = {}


def byte_bpe_path() -> str:
    """Where the public byte-level BPE vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def segment_encoder(path: str) -> SegmentCache:
    """This worker's encoder for a vocabulary file of the ``tokenizers`` library."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode(segments: list[bytes]) -> list[list[int]]:
            out: list[list[int]] = []
            for k in range(0, len(segments), 5000):  # the library's results are large beside their ids
                texts = [x.decode("utf-8", "replace") for x in segments[k : k + 5000]]
                out.extend(x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False))
            return out

        _encoders[path] = SegmentCache(encode)
    return _encoders[path]


class Packer:
    """Packs pieces ``(doc_id, start, ids, doc_tokens)`` into windows.

    ``rows`` gathers one tuple of SCHEMA for each piece.  ``pool`` bounds how
    many documents wait for a window.
    """

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_id: int = 0, pool: int = 4096):
        self.tiers, self.step_tokens, self.pool = tuple(sorted(tiers)), step_tokens, pool
        self.longest = self.tiers[-1]
        self.waiting: dict[int, list] = {}  # by length, the pieces
        self.lengths: list[int] = []  # of the waiting pieces, in order, each once
        self.count = 0
        self.sequence = self.group = first_id
        self.open_groups: dict[int, tuple[int, int]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.longest:
            self._write([(doc_id, at, ids[at : at + self.longest], n)], self.longest)
            at += self.longest
        if at < n:
            self._wait((doc_id, at, ids[at:], n))
        if self.count > self.pool:
            self._pack(self.pool // 4)

    def finish(self) -> None:
        self._pack(0)

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2])
        if n not in self.waiting:
            self.waiting[n] = []
            insort(self.lengths, n)
        self.waiting[n].append(piece)
        self.count += 1

    def _take(self, most: int) -> tuple | None:
        """The longest waiting piece of at most so many tokens."""
        k = bisect_right(self.lengths, most) - 1
        if k < 0:
            return None
        n = self.lengths[k]
        piece = self.waiting[n].pop()
        if not self.waiting[n]:
            del self.waiting[n], self.lengths[k]
        self.count -= 1
        return piece

    def _pack(self, leave: int) -> None:
        """Pack full windows, from the longest tier down, until so few pieces wait; 0: all of them."""
        while self.count > leave:
            longest = self.lengths[-1]
            tier = next(t for t in self.tiers if t >= longest)
            window, gap = [], tier
            while gap and (piece := self._take(gap)):
                window.append(piece)
                gap -= len(piece[2])
            if gap and self.lengths:  # only longer pieces wait: cut the shortest of them at the gap
                doc_id, start, ids, n = self._take(self.lengths[0])
                window.append((doc_id, start, ids[:gap], n))
                self._wait((doc_id, start + gap, ids[gap:], n))
                gap = 0
            if gap:
                self._cut_up(window, tier - gap)
            else:
                self._write(window, tier)

    def _cut_up(self, window: list, fill: int) -> None:
        """Write the last window as sequences whose sizes are powers of two."""
        at = 0
        while fill:
            size = 1 << (fill.bit_length() - 1)
            fill -= size
            part, room = [], size
            while room:
                doc_id, start, ids, n = window[at]
                part.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    window[at] = (doc_id, start + room, ids[room:], n)
                    room = 0
                else:
                    room -= len(ids)
                    at += 1
            self._write(part, size)

    def _write(self, pieces: list, size: int) -> None:
        group, room = self.open_groups.get(size, (None, 0))
        if room < size:
            group, room = self.group, max(self.step_tokens, size)
            self.group += 1
        self.open_groups[size] = (group, room - size)
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset, size, group))
            offset += len(ids)
        self.sequence += 1


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    tiers: tuple[int, ...] = (256, 512, 1024, 2048),
    step_tokens: int = 32_768,
    pool: int = 4096,
) -> DataFrame:
    """Pack every document's ids (and ``end_id``) into windows of the tiers' sizes.

    One row per piece, with SCHEMA's columns: ``start`` counts the document's
    ids before the piece, ``offset`` the sequence's; ``tier`` is the window's
    size, always equal to its fill; ``step_group`` numbers groups of windows of
    one size with at most ``step_tokens`` tokens (all groups but a partition's
    last of each size have exactly that many).

    Nulls: a null text is empty, so its only id is ``end_id``; a null id is kept
    as null.  Repeated rows are packed as often as they stand.  An empty table
    gives no rows.  Other columns are ignored.  A text may have any length: a
    task holds the ids of the texts in one block and of ``pool`` remainders.
    ``vocabulary`` is a path on the workers (None: their public byte-level BPE).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        cache = segment_encoder(vocabulary or byte_bpe_path())
        packer = Packer(tiers, step_tokens, (context.partitionId() if context else 0) * _PER_PARTITION, pool)
        end = np.array([end_id], dtype=np.int32)
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            names = batch.column(0).to_pylist()
            for lo, hi in blocks(offsets):
                part = offsets[lo : hi + 1]
                ids, before = cache.ids_of(data[part[0] : part[-1]], part - part[0])
                for k in range(hi - lo):
                    packer.add(names[lo + k], np.concatenate([ids[before[k] : before[k + 1]], end]))
                if len(packer.rows) >= 20_000:
                    yield _table(packer.rows)
                    packer.rows = []
        packer.finish()
        yield _table(packer.rows)

    chosen = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA)
