"""Token counts of whole texts, with huge documents encoded in overlapping chunks.

A huge document is cut into chunks that are dealt to all tasks.  Chunk k is
encoded together with the first ``overlap`` characters of chunk k + 1, and says
where its tokens begin there; chunk k + 1 says the same of its own beginning.
The two encodings are spliced at a stable common boundary: a place where a
token begins in both, and the same one.

Why such a place is proven: in byte-pair merging the sequence of tokens of a
text is the only one whose neighbours stay apart when they are merged by
themselves.  Up to the splice all neighbours are those of the first encoding,
the pair at the splice too (its right token is the same in both); from there on
they are those of the second.  So the spliced sequence is the encoding of the
whole.

Where two chunks have no such place (one letter for thousands of characters,
say), the document's chunks are joined two by two and the overlap is doubled,
until they have one or the document is one chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.pieces import piece_path
from boxwright.session import checkpoint_dir

#: Characters in a chunk, and in the overlap of two.
CHUNK, OVERLAP = 32_768, 1_024
#: Characters that the library gets in one call.
CALL = 500_000
_ID_BITS = 24
_CHUNKS = "row bigint, doc_id bigint, n_bytes bigint, n_tokens bigint, k bigint, base bigint, core string, after string"
_ENDS = "row bigint, doc_id bigint, n_bytes bigint, n_tokens bigint, k bigint, head array<bigint>, tail array<bigint>"


class Counter:
    """A SentencePiece byte-pair model that tells how many tokens a text has and where they begin."""

    def __init__(self, path: str):
        import sentencepiece

        if not path.endswith(".model"):
            raise ValueError(f"not a SentencePiece model: {path}")
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.vocab_size())
        names = [self.model.id_to_piece(i) for i in ids]
        byte = [int(n[3:5], 16) if self.model.is_byte(i) else -1 for i, n in zip(ids, names, strict=True)]
        self.is_byte = np.array([b >= 0 for b in byte])
        self.goes_on = np.array([b & 0xC0 == 0x80 and b >= 0 for b in byte])  # a byte within a character
        self.length = np.array([1 if b >= 0 else len(n) for b, n in zip(byte, names, strict=True)], dtype=np.int64)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def begins(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's ids, and the character at which each begins; the space that the model puts before a text is at -1.

        All bytes of a character outside the vocabulary begin where it does.
        """
        ids = np.array(self.model.encode(text), dtype=np.int64)
        within = np.append(self.goes_on[ids[1:]], False)
        size = np.where(self.is_byte[ids] & within, 0, self.length[ids])
        if size.sum() != len(text) + 1:
            raise ValueError("the model changes its texts, so its tokens have no places in them")
        return ids, np.cumsum(size) - size - 1


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """This worker's counter for a model file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have at most CALL characters together, or one text."""
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if k > at and held + n > CALL:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def _cut(docs: DataFrame, path: str | None, chunk: int, overlap: int) -> DataFrame:
    """A row with its count for each document of one chunk; for the others a row for each chunk, with its text and what follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("row", "doc_id", "n_bytes", "n_tokens", "k", "base")] + [("core", pa.string()), ("after", pa.string())])
        counter = counter_of(path or piece_path())
        for batch in batches:
            rows, ids, sizes = (batch.column(k).to_pylist() for k in range(3))
            for lo, hi in _groups(sizes):
                texts = batch.column(3).slice(lo, hi - lo).to_pylist()
                short = [k for k, t in enumerate(texts) if len(t) <= chunk + overlap]
                out = [(rows[lo + k], ids[lo + k], sizes[lo + k], n, 0, 0, None, None) for k, n in zip(short, counter.counts([texts[k] for k in short]), strict=True)]
                for k, t in enumerate(texts):
                    if len(t) > chunk + overlap:
                        # what is left of less than an overlap belongs to the last chunk
                        starts = range(0, len(t) - overlap, chunk)
                        for i, at in enumerate(starts):
                            to = at + chunk if i + 1 < len(starts) else len(t)
                            out.append((rows[lo + k], ids[lo + k], 0 if i else sizes[lo + k], None, i, at, t[at:to], t[to : to + overlap]))
                columns = list(zip(*out, strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("row", "doc_id", "n_bytes", "text").mapInArrow(run, _CHUNKS)


def _encode(chunks: DataFrame, path: str | None, overlap: int) -> DataFrame:
    """The tokens of each chunk with what follows it: how many, and those that begin in the overlap before and behind (place and id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int64())
        schema = pa.schema([(n, pa.int64()) for n in ("row", "doc_id", "n_bytes", "n_tokens", "k")] + [("head", lists), ("tail", lists)])
        counter = counter_of(path or piece_path())
        for batch in batches:
            n, heads, tails = [], [], []
            for k, base, core, after in zip(*(batch.column(c).to_pylist() for c in ("k", "base", "core", "after")), strict=True):
                ids, at = counter.begins(core + after)
                places = (at + base) << _ID_BITS | ids
                n.append(len(ids))
                heads.append(places[at < overlap] if k else None)
                tails.append(places[at >= len(core)] if after else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_bytes")), pa.array(n, type=pa.int64()), batch.column("k"), pa.array(heads, type=lists), pa.array(tails, type=lists)], schema=schema)

    # by chunk, so that one document is many tasks' work
    return chunks.repartition("row", "k").mapInArrow(run, _ENDS)


def _joints(encoded: DataFrame) -> DataFrame:
    """For each two chunks side by side: how many tokens the splice takes away, null where there is none."""
    none = F.lit(None).cast("array<bigint>")
    sides = F.array(F.struct(F.col("k").alias("j"), none.alias("head"), F.col("tail").alias("tail")), F.struct((F.col("k") - 1).alias("j"), F.col("head").alias("head"), none.alias("tail")))
    pairs = encoded.select("row", F.explode(sides).alias("s")).select("row", "s.*").filter("head is not null or tail is not null")
    both = pairs.groupBy("row", "j").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    place = lambda x: F.shiftright(x, _ID_BITS)
    cut = both.withColumn("at", place(F.array_min(F.array_intersect("tail", "head"))))
    lost: Column = F.size(F.filter("tail", lambda x: place(x) >= F.col("at"))) + F.size(F.filter("head", lambda x: place(x) < F.col("at")))
    return cut.select("row", F.when(F.col("at").isNotNull(), lost).alias("lost"))


def _widened(chunks: DataFrame, overlap: int) -> DataFrame:
    """Chunks joined two by two, each with what follows it over the (wider) overlap."""
    half = F.floor(F.col("k") / 2).cast("bigint")
    own = F.struct(half.alias("to"), F.lit(False).alias("behind"), F.col("core").alias("text"))
    ahead = F.struct((half - 1).alias("to"), F.lit(True).alias("behind"), F.substring("core", 1, overlap).alias("text"))
    begins = F.when((F.col("k") % 2 == 0) & (F.col("k") > 0), F.array(own, ahead)).otherwise(F.array(own))
    parts = chunks.select("row", "doc_id", "n_bytes", "k", "base", F.explode(begins).alias("p"))
    text = lambda behind: F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.when(F.col("p.behind") == behind, F.struct("k", "p.text")))), lambda x: x["text"]))
    here = lambda c: F.when(~F.col("p.behind"), F.col(c))
    return parts.groupBy("row", F.col("p.to").alias("k")).agg(
        F.max("doc_id").alias("doc_id"), F.sum(here("n_bytes")).alias("n_bytes"), F.min(here("base")).alias("base"), text(False).alias("core"), text(True).alias("after")
    )


def count_tokens(
    docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row's whole text.

    Counts are those of the SentencePiece library without begin and end tokens.
    Null and empty texts have none.  Null ids stay null, repeated rows are
    counted each, an empty table gives no rows, other columns are ignored.  A
    text may have any length: one of more than ``chunk + overlap`` characters is
    encoded in chunks.  ``vocabulary`` is a model file's path on the workers
    (None: the public one); a model that changes its texts is refused.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be within a chunk")
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    # written, so that rows keep their numbers: the texts of huge documents, a count for each other one
    _cut(numbered, vocabulary, chunk, overlap).write.option("compression", "zstd").parquet(folder)
    written = spark.read.schema(_CHUNKS).parquet(folder)
    result = written.filter("core is null").select("doc_id", "n_bytes", "n_tokens")
    chunks = written.filter("core is not null").drop("n_tokens")
    while True:
        encoded = _encode(chunks.select("row", "doc_id", "n_bytes", "k", "base", "core", "after"), vocabulary, overlap).checkpoint()
        joints = _joints(encoded).checkpoint()
        apart = joints.filter("lost is null").select("row").distinct()
        parts = encoded.select("row", "doc_id", "n_bytes", "n_tokens").union(joints.select("row", F.lit(None).cast("bigint"), F.lit(0).cast("bigint"), -F.col("lost")))
        sums = parts.join(apart, "row", "left_anti").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
        result = result.union(sums.select("doc_id", "n_bytes", "n_tokens"))
        if apart.isEmpty():
            break
        overlap *= 2
        chunks = _widened(chunks.join(apart, "row", "left_semi"), overlap).checkpoint()
    return result.withColumn("over_limit", F.col("n_tokens") > limit)
