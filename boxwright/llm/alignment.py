"""Alignment of two tokenizers' tokens by lockstep merging.

Each text is encoded by a byte-level vocabulary (A) and by a SentencePiece one
(B); both give back the bytes of the text with a space before it.  A and B
tokens that end at one byte are linked and cut the tokens into groups.

All texts of a block are merged at once: one numpy vector of A pointers and one
of B pointers advance together, a step moves in every text the token that ends
first (both, where they end together, which emits a link and a cut), and texts
that are through leave the vectors.  A long text is several lanes of them, each
from a place where both tokenizers end a token.

How often a pair of ids is linked is counted over the corpus.  Of two tokens
that end together the shorter is the end of the longer, so the vocabularies
bound how many pairs there can be (some hundred thousand, listed once), and
their counts can be broadcast however large the corpus is.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.packing import byte_bpe_path
from boxwright.llm.pieces import piece_path
from boxwright.llm.textvec import BLOCK, SegmentCache, blocks, buffer_of, segment_spans
from boxwright.session import checkpoint_dir

#: Bytes of a lane, about.
LANE = 256
_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"
_SCORED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the others for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """One tokenizer: its ids' bytes, and a memory of segments that were encoded."""

    def __init__(self, raw: list[bytes], encode):
        self.size = np.array([len(x) for x in raw], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw, self.cache = raw, SegmentCache(encode)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.flat[np.arange(size.sum()) + np.repeat(self.at[ids] - before, size)]


def _byte_level(path: str) -> Vocabulary:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are plain text

    def encode(segments: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for k in range(0, len(segments), 5000):
            out.extend(x.ids for x in tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in segments[k : k + 5000]], add_special_tokens=False))
        return out

    byte = _byte_of_letter()
    return Vocabulary([bytes(byte[c] for c in tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size())], encode)


def _piece(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def bytes_of(i: int) -> bytes:
        name = model.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else name.replace("▁", " ").encode()

    space = [model.piece_to_id("▁")]  # a segment that is the space alone, before another one

    def encode(segments: list[bytes]) -> list[list[int]]:
        # every segment begins with a space, which the model puts there itself
        return [ids or space for ids in model.encode([s[1:].decode("utf-8", "replace") for s in segments], num_threads=1)]

    return Vocabulary([bytes_of(i) for i in range(model.vocab_size())], encode)


def _possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Codes ``a << 32 | b`` of all id pairs of which one's bytes end with the other's, in order."""

    def ends(of: list[bytes], others: list[bytes], swap: bool) -> Iterator[int]:
        ids: dict[bytes, list[int]] = {}
        for i, x in enumerate(others):
            if x:
                ids.setdefault(x, []).append(i)
        for i, x in enumerate(of):
            for k in range(len(x)):
                for j in ids.get(x[k:], ()):
                    yield j << 32 | i if swap else i << 32 | j

    return np.unique(np.fromiter([*ends(a, b, False), *ends(b, a, True)], dtype=np.int64))


@dataclass
class Aligned:
    """What a block of texts gives: counts of each, links (pair numbers) and the texts of its groups, with bounds."""

    n_a: np.ndarray
    n_b: np.ndarray
    ok: np.ndarray
    links: np.ndarray
    link_bounds: np.ndarray
    groups: np.ndarray
    group_bounds: np.ndarray


class Aligner:
    """Two vocabularies and the pairs of ids that can end together."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = _byte_level(a_path), _piece(b_path)
        self.pairs = _possible_pairs(self.a.raw, self.b.raw)
        # each id as text with the sign that follows it: of A "," or "|", of B "," or ";"
        names = [f"{i}{s}".encode() for v, signs in ((self.a, ",|"), (self.b, ",;")) for i in range(len(v.raw)) for s in signs]
        self.width = np.array([len(x) for x in names])
        self.names = np.zeros((len(names), self.width.max()), dtype=np.uint8)
        self.names[np.arange(self.names.shape[1]) < self.width[:, None]] = np.frombuffer(b"".join(names), dtype=np.uint8)

    def _tokens(self, vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, those before each text, and whether a text's tokens give back its bytes."""
        ids, before = vocabulary.cache.ids_of(data, offsets)
        ends = np.concatenate([[0], np.cumsum(vocabulary.size[ids])])[before]
        ok = np.diff(ends) == np.diff(offsets)
        same = vocabulary.bytes_of(ids[np.repeat(ok, np.diff(before))]) == data[np.repeat(ok, np.diff(offsets))]
        if not same.all():
            kept = np.flatnonzero(ok)
            wrong = np.searchsorted(np.cumsum(np.diff(offsets)[kept]), np.flatnonzero(~same), side="right")
            ok[kept[wrong]] = False
        return ids, before, ok

    def align(self, data: np.ndarray, offsets: np.ndarray) -> Aligned:
        """Texts that begin with a space (or are empty), one after another."""
        a, a_before, a_ok = self._tokens(self.a, data, offsets)
        b, b_before, b_ok = self._tokens(self.b, data, offsets)
        ok = a_ok & b_ok
        n_a, n_b = np.where(ok, np.diff(a_before), 0), np.where(ok, np.diff(b_before), 0)
        a, b = a[np.repeat(ok, np.diff(a_before))].astype(np.int64), b[np.repeat(ok, np.diff(b_before))].astype(np.int64)
        a_bounds, b_bounds = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        # bytes before the texts that take part, and where each token ends among them
        starts = np.cumsum(np.where(ok, np.diff(offsets), 0)) - np.where(ok, np.diff(offsets), 0)
        a_ends, b_ends = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        segments, _ = segment_spans(data, offsets)
        text = np.searchsorted(offsets, segments, side="right") - 1
        segments = (segments - offsets[text] + starts[text])[ok[text]]
        partner = lockstep(a_ends, b_ends, segments)
        cut_a = partner >= 0
        last_a, last_b = np.flatnonzero(cut_a), partner[cut_a]  # of each group
        links = np.searchsorted(self.pairs, a[last_a] << 32 | b[last_b])
        if len(links) and (self.pairs[np.minimum(links, len(self.pairs) - 1)] != (a[last_a] << 32 | b[last_b])).any():
            raise AssertionError("tokens that end together must end alike")
        # a group's A tokens, then its B tokens: each moves by the others' tokens before it
        cut_b = np.zeros(len(b), dtype=bool)
        cut_b[last_b] = True
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        codes = np.zeros(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]] = 2 * a + cut_a
        codes[np.arange(len(b)) + (last_a + 1)[group_b]] = 2 * (b + len(self.a.raw)) + cut_b
        rows = self.names[codes]
        upto = np.concatenate([[0], np.cumsum(self.width[codes])])
        return Aligned(n_a, n_b, ok, links.astype("<u4"), np.searchsorted(last_a, a_bounds), rows[rows != 0], upto[a_bounds + b_bounds])


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, safe: np.ndarray) -> np.ndarray:
    """For each A token the B token that ends at the same byte, -1 where none does.

    Ends rise, and the last ones are equal.  ``safe`` are bytes at which lanes may
    begin; those at which not both have an end are left out.
    """
    partner = np.full(len(a_ends), -1, dtype=np.int64)
    if not len(a_ends):
        return partner
    far = np.ones(len(safe), dtype=bool)
    far[1:] = safe[1:] // LANE != safe[:-1] // LANE
    at = np.unique(np.append(safe[far], 0))
    both = lambda ends: (at == 0) | (ends[np.searchsorted(ends, at, side="right") - 1] == at)
    at = at[both(a_ends) & both(b_ends)]
    pa_, pb = np.searchsorted(a_ends, at, side="right"), np.searchsorted(b_ends, at, side="right")
    to = np.append(pa_[1:], len(a_ends))
    while len(pa_):
        x, y = a_ends[pa_], b_ends[pb]
        same = x == y
        partner[pa_[same]] = pb[same]
        pa_, pb = pa_ + (x <= y), pb + (y <= x)
        live = pa_ < to
        if not live.all():
            pa_, pb, to = pa_[live], pb[live], to[live]
    return partner


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_path: str | None, b_path: str | None) -> Aligner:
    """This worker's aligner of two vocabulary files (None: the public ones)."""
    key = (a_path or byte_bpe_path(), b_path or piece_path())
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty."""
    filled = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][filled], 0x20), offsets + np.concatenate([[0], np.cumsum(filled)])


def _parts(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A long text in parts of about ``limit`` bytes, each from the start of a segment."""
    segments, _ = segment_spans(data, np.array([0, len(data)]))
    at = 0
    while at < len(data):
        k = np.searchsorted(segments, at + limit)
        to = int(segments[k]) if k < len(segments) else len(data)
        yield data[at:to]
        at = to


def _one(aligner: Aligner, data: np.ndarray, limit: int) -> tuple:
    """Columns of one long text, part after part."""
    n_a, n_b, links, sha = 0, 0, [], hashlib.sha256()
    for part in _parts(data, limit):
        found = aligner.align(part, np.array([0, len(part)]))
        if not found.ok[0]:
            return 0, 0, 0, "", b""
        sha.update((b";" if n_a else b"") + found.groups[:-1].tobytes())
        n_a, n_b = n_a + int(found.n_a[0]), n_b + int(found.n_b[0])
        links.append(found.links.tobytes())
    whole = b"".join(links)
    return n_a, n_b, len(whole) // 4, sha.hexdigest(), whole


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each text: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and links (numbers of the linked id pairs, unsigned 32-bit).

    A null, empty or unfaithful text (whose A or B tokens don't give back its
    bytes) has no tokens.  Null ids stay null, repeated rows are aligned each, an
    empty table gives no rows, other columns are ignored.  Memory is bounded by
    ``block`` bytes of text, and by the links of one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for lo, hi in blocks(offsets, block):
                joined, bounds = _with_space(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if hi - lo == 1 and len(joined) > block:
                    rows = [_one(aligner, joined, block)]
                else:
                    f = aligner.align(joined, bounds)
                    rows = []
                    for k in range(hi - lo):
                        links, text = f.links[f.link_bounds[k] : f.link_bounds[k + 1]], f.groups[f.group_bounds[k] : f.group_bounds[k + 1]]
                        rows.append((int(f.n_a[k]), int(f.n_b[k]), len(links), hashlib.sha256(text[:-1]).hexdigest() if len(text) else "", links.tobytes()))
                n_a, n_b, n, sha, links = (pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))
                # a link and a cut are emitted together: there are as many groups
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), n_a, n_b, n, n, sha, links], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """pair, n: how many links hold each id pair; every task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(aligner_of(a_path, b_path).pairs), dtype=np.int64)
        for batch in batches:
            for links in batch.column(0):
                found = np.frombuffer(links.as_buffer() or b"", dtype="<u4")
                if len(found) > len(total) // 8:
                    total += np.bincount(found, minlength=len(total))
                else:
                    np.add.at(total, found, 1)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def align_and_score(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``align`` (without the links), n_best (links whose count is the highest of their B id, ties included) and count_sum (over the links).

    A pair's count is taken over all rows.  The counts are broadcast: their
    number is bounded by the vocabularies, not by the corpus.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    # read twice: once for the counts, once for the scores
    align(docs, a_path, b_path, id_col, text_col).write.option("compression", "zstd").parquet(folder)
    aligned = spark.read.schema(_ALIGNED).parquet(folder)
    table = pair_counts(aligned, a_path, b_path).toArrow()
    counts = spark.sparkContext.broadcast((table["pair"].to_numpy(), table["n"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        count = np.zeros(len(aligner.pairs), dtype=np.int64)
        count[counts.value[0]] = counts.value[1]
        b = aligner.pairs & 0xFFFFFFFF
        highest = np.zeros(len(aligner.b.raw), dtype=np.int64)
        np.maximum.at(highest, b, count)
        best = count == highest[b]
        for batch in batches:
            found = [np.frombuffer(x.as_buffer() or b"", dtype="<u4") for x in batch.column("links")]
            n_best, total = [int(best[x].sum()) for x in found], [int(count[x].sum()) for x in found]
            same = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*same, pa.array(n_best, type=pa.int64()), pa.array(total, type=pa.int64()), batch.column("groups_sha256")], names=names)

    return aligned.mapInArrow(run, _SCORED)
