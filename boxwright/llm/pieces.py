"""SentencePiece encoding and decoding with a suffix array over the batch.

The words of a batch that weren't seen before are put one after another, and
the array of their suffixes is sorted.  Each vocabulary piece is then looked up
by binary search, which gives the range of suffixes that begin with it, so all
places where it occurs.  These edges are sorted by position and relaxed from
left to right, for all words at once.

Relaxing for a byte-pair vocabulary: the encoding of a prefix ends in exactly
one piece, and it is the one edge (a, b) whose piece may follow the last piece
of the encoding of the prefix up to a.  "May follow" means that merging the two
pieces' characters gives back just those two; it is worked out once for each
pair and remembered.

A segment begins before a space; no piece crosses one (checked when a model is
loaded), so segments are encoded one by one and remembered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.textvec import SegmentCache, blocks, buffer_of

#: How many pairs of pieces a worker remembers.
MOST_PAIRS = 2_000_000
_SPACE = "▁"


class PieceModel:
    """A byte-pair model with byte fallback, read from a SentencePiece file."""

    def __init__(self, path: str):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts: list[str] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = np.full(256, -1)
        self.byte_of: dict[int, int] = {}
        for i in range(reader.vocab_size()):
            text = reader.id_to_piece(i)
            self.texts.append(text)
            if reader.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                self.byte_of[i] = int(text[3:5], 16)
            elif not (reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i)):
                self.ids[text], self.scores[text] = i, reader.get_score(i)
                if _SPACE in text.lstrip(_SPACE):
                    raise ValueError(f"a piece crosses a space: {text!r}")
        self.silent = {i for i in range(reader.vocab_size()) if reader.is_control(i) or reader.is_unknown(i)}
        self.raw = [b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(_SPACE, " ").encode() for i, t in enumerate(self.texts)]
        # what merging never makes can't be an edge
        usable = sorted(t for t in self.ids if len(t) == 1 or self.merge(t) == [t])
        self.pieces = [(t.encode(), self.ids[t]) for t in usable]
        self.is_single = np.array([len(t) == 1 and t in self.ids for t in self.texts])
        self.longest = max(len(p) for p, _ in self.pieces)
        # pieces by their length in groups of eight bytes, with the least and greatest value of each group of bytes
        self.groups = []
        for width in range(1, (self.longest + 7) // 8 + 1):
            group = [(p, i) for p, i in self.pieces if (len(p) + 7) // 8 == width]
            bound = lambda k, fill: np.array([int.from_bytes(p[8 * k : 8 * k + 8].ljust(8, fill), "big") for p, _ in group], dtype=np.uint64)  # noqa: B023, E731
            if group:
                self.groups.append(([(bound(k, b"\0"), bound(k, b"\xff")) for k in range(width)], np.array([len(p) for p, _ in group]), np.array([i for _, i in group])))
        # pairs known so far, by left << 32 | right, in order, and whether they stay apart
        self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of a short string: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[x + y], -k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.scores), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the pieces stay as they are side by side. Negative ids are characters outside the vocabulary, which never merge."""
        out = np.ones(len(left), dtype=bool)
        asked = np.flatnonzero((left >= 0) & (right >= 0))
        codes = left[asked].astype(np.int64) << 32 | right[asked]
        at = np.searchsorted(self.pairs, codes)
        new = np.unique(codes[self.pairs[np.minimum(at, len(self.pairs) - 1)] != codes]) if len(self.pairs) else np.unique(codes)
        if len(new):
            if len(self.pairs) > MOST_PAIRS:
                self.pairs, self.apart, new = np.zeros(0, np.int64), np.zeros(0, bool), np.unique(codes)
            text = self.texts
            apart = [self.merge(text[c >> 32] + text[c & 0xFFFFFFFF]) == [text[c >> 32], text[c & 0xFFFFFFFF]] for c in new.tolist()]
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.apart = np.insert(self.pairs, place, new), np.insert(self.apart, place, apart)
            at = np.searchsorted(self.pairs, codes)
        out[asked] = self.apart[at] if len(asked) else True
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (UTF-8, spaces as in the model)."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words])
        starts = ends - [len(w) for w in words]
        n = len(data)
        if not n:
            return [[] for _ in words]
        longest = self.longest
        # suffixes by their first bytes, eight at a time; zeros beyond the word's end
        left = np.repeat(ends, ends - starts) - np.arange(n)
        padded = np.concatenate([data, np.zeros(longest + 16, np.uint8)])
        eight = np.zeros(n + longest + 8, dtype=np.uint64)
        for j in range(8):
            eight = (eight << np.uint64(8)) | padded[j : j + len(eight)]
        mask = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], dtype=np.uint64)  # the first k bytes
        keys = [eight[k : k + n] & mask[np.clip(left - k, 0, 8)] for k in range(0, min(longest, int((ends - starts).max())), 8)]
        order = np.argsort(keys[0], kind="stable")
        if len(keys) > 1:  # only long suffixes with equal first bytes need the others
            same = np.zeros(n + 1, dtype=bool)
            same[1:-1] = keys[0][order[1:]] == keys[0][order[:-1]]
            tied = np.flatnonzero((same[1:] | same[:-1]) & (left[order] > 0))
            sub = order[tied]
            order[tied] = sub[np.lexsort([k[sub] for k in keys[::-1]])]
        keys = [k[order] for k in keys]
        # every piece's range of suffixes, narrowed eight bytes at a time
        edges_at, edges_to, edges_id = [], [], []
        for bounds, size, ids in self.groups:
            if len(bounds) > len(keys):
                continue
            lo, hi = np.searchsorted(keys[0], bounds[0][0]), np.searchsorted(keys[0], bounds[0][1], side="right")
            for key, (low, high) in zip(keys[1:], bounds[1:], strict=False):
                for x in np.flatnonzero(hi > lo):
                    part = key[lo[x] : hi[x]]
                    lo[x], hi[x] = lo[x] + np.searchsorted(part, low[x]), lo[x] + np.searchsorted(part, high[x], side="right")
            many = hi - lo
            at = order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
            to = at + np.repeat(size, many)
            inside = np.repeat(size, many) <= left[at]  # zeros in a text could look like the end
            edges_at.append(at[inside])
            edges_to.append(to[inside])
            edges_id.append(np.repeat(ids, many)[inside])
        return self._relax(data, starts, ends, np.concatenate(edges_at), np.concatenate(edges_to), np.concatenate(edges_id))

    def _relax(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, to: np.ndarray, piece: np.ndarray) -> list[list[int]]:
        """All words at once, one end offset after another; of the edges that end in one place the longest first."""
        # characters outside the vocabulary are edges of their own
        head = np.flatnonzero((data & 0xC0) != 0x80)
        word = np.repeat(np.arange(len(starts)), ends - starts)
        after = np.minimum(np.append(head[1:], len(data)), ends[word[head]])
        singles = np.zeros(len(data), dtype=bool)
        singles[at[self.is_single[piece]]] = True
        odd = ~singles[head]
        at, to, piece = np.concatenate([at, head[odd]]), np.concatenate([to, after[odd]]), np.concatenate([piece, np.full(odd.sum(), -1)])
        order = np.lexsort((at, to))
        at, to, piece = at[order], to[order], piece[order]
        new = np.ones(len(to), dtype=bool)
        new[1:] = to[1:] != to[:-1]
        turn = np.arange(len(to)) - np.maximum.accumulate(np.where(new, np.arange(len(to)), 0))
        offset = to - starts[word[at]]
        order = np.lexsort((turn, offset))
        at, to, piece, turn, offset = at[order], to[order], piece[order], turn[order], offset[order]
        cuts = np.flatnonzero((offset[1:] != offset[:-1]) | (turn[1:] != turn[:-1])) + 1
        begins = at == starts[word[at]]
        # the last piece of the encoding up to each place (-2: none ends here), and where it begins; a word's first edges don't look at it
        last, back = np.full(len(data) + 1, -2, dtype=np.int64), np.zeros(len(data) + 1, dtype=np.int64)
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
            a, b, p, first = at[lo:hi], to[lo:hi], piece[lo:hi], begins[lo:hi]
            open_ = (last[b] == -2) & (first | (last[a] != -2))
            if not open_.any():
                continue
            a, b, p, first = a[open_], b[open_], p[open_], first[open_]
            ok = first.copy()
            ok[~first] = self.may_follow(last[a[~first]], p[~first])
            last[b[ok]], back[b[ok]] = p[ok], a[ok]
        # back from the words' ends
        here, live, steps = ends.copy(), np.arange(len(starts)), []
        while len(live):
            steps.append((live, last[here[live]], back[here[live]], here[live]))
            here[live] = back[here[live]]
            live = live[here[live] > starts[live]]
        words, ids, froms, tos = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((froms, words))
        words, ids, froms, tos = words[order], ids[order], froms[order], tos[order]
        raw = np.where(ids < 0, tos - froms, 1)  # bytes stand for characters outside the vocabulary
        upto = np.concatenate([[0], np.cumsum(raw)])
        flat = np.repeat(ids, raw)
        gaps = np.flatnonzero(flat < 0)
        inner = gaps - np.repeat(upto[:-1], raw)[gaps] + np.repeat(froms, raw)[gaps]
        flat[gaps] = self.byte_ids[data[inner]]
        counts = np.bincount(words, raw, minlength=len(starts)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
        out = flat.tolist()
        return [out[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes as UTF-8, the space put before the text taken away."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, tuple[PieceModel, SegmentCache]] = {}


def piece_path() -> str:
    """Where the public piece model lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_of(path: str) -> tuple[PieceModel, SegmentCache]:
    """This worker's model and its memory of segments (texts with plain spaces)."""
    if path not in _models:
        model = PieceModel(path)
        space = _SPACE.encode()
        _models[path] = model, SegmentCache(lambda segments: model.encode_words([s.replace(b" ", space) for s in segments]))
    return _models[path]


def ids_of_texts(path: str, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and ids of each text; a space is put before texts that aren't empty, as the model's own encoder does."""
    model, cache = model_of(path)
    data, offsets = buffer_of(texts)
    for lo, hi in blocks(offsets):
        part = offsets[lo : hi + 1]
        filled = np.diff(part) > 0
        joined = np.insert(data[part[0] : part[-1]], (part[:-1] - part[0])[filled], 0x20)
        ids, before = cache.ids_of(joined, part - part[0] + np.concatenate([[0], np.cumsum(filled)]))
        for k in range(hi - lo):
            yield lo + k, ids[before[k] : before[k + 1]]


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every row's whole text.

    Null and empty texts have no ids.  Null ids stay null, repeated rows are
    encoded alike, an empty table gives none, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ids for _, ids in ids_of_texts(vocabulary or piece_path(), batch.column(1))]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(rows: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row's ids; null or no ids: an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = model_of(vocabulary or piece_path())
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    chosen = rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return chosen.mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), n_chars of the decoded text, and same: whether it is the text.

    Rows are treated as by ``encode``; the round trip compares with the text, an empty one for null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or piece_path()
        model, _ = model_of(path)
        for batch in batches:
            rows = []
            for k, ids in ids_of_texts(path, batch.column(1)):
                text = model.decode(ids.tolist())
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(text), text == (batch.column(1)[k].as_py() or "")))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "n_ids", "ids_crc32", "n_chars", "same"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, n_chars bigint, same boolean")
