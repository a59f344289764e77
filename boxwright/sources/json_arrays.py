"""Reading JSON arrays of objects with several tasks a file.

Small files are rows of a whole text each, and one pass cuts out their objects.
A larger file is read as text whose lines end at closing braces, which Spark can split
anywhere.  Whether a brace counts depends on all that lies before it (is it in a
string, how deep is it), so there are two passes, each over all splits at once:

1. every split tells what it would do to both: whether it has an odd number of
   quotes, and by how much it changes the depth if it begins outside and if it
   begins inside a string; running sums over a file's splits give where each
   really begins;
2. every split finds its objects' ends.  Objects within it are whole; what
   crosses to the next split is a few pieces, which are grouped and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.session import checkpoint_dir, ship_package

#: Files of so many bytes at most are small; those that Spark would split never are.
WHOLE_BYTES = 4 << 20
#: So many splits at most are broadcast (some 30 bytes each).
BROADCAST_SPLITS = 500_000
HEAD, MIDDLE, TAIL, WHOLE = 0, 1, 2, 3
_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_STEP = np.zeros(256, dtype=np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1


def _structure(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, quotes so far (odd or even) at each, and the change of depth that each would make outside a string."""
    data = np.frombuffer(text, dtype=np.uint8)
    quote = data == _QUOTE
    slash = data == _BACKSLASH
    if slash.any():
        at = np.arange(len(data))
        before = np.maximum.accumulate(np.where(slash, -1, at))  # the last byte that is no backslash
        run = np.append(0, (at - before)[:-1])  # backslashes right before each byte
        quote &= run % 2 == 0
    return data, np.cumsum(quote, dtype=np.int32) & 1, _STEP[data]


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of whole texts, each with what stands before it."""
    for batch in batches:
        for value in batch.column("value"):
            text = value.as_py()
            data, odd, step = _structure(text)
            depth = np.cumsum(np.where(odd == 0, step, np.int8(0)), dtype=np.int32)
            top = int(text.lstrip()[:1] == b"[")
            ends = (np.flatnonzero((data == ord("}")) & (odd == 0) & (depth == top)) + 1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([text[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)], type=pa.binary())], names=["text"])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """First row, end and text of each run of a batch's rows that lie in one split, with their closing braces."""
    file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if hi > lo:
            yield lo, hi, "".join(f"{v}}}" for v in batch.column("value").slice(lo, hi - lo).to_pylist()).encode()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        for lo, _, text in _runs(batch):
            _, odd, step = _structure(text)
            one = found.setdefault((batch.column("file")[lo].as_py(), batch.column("block")[lo].as_py()), [0, 0, 0, text.lstrip()[:1].decode("utf-8", "replace")])
            outside, inside = int(step[odd == 0].sum(dtype=np.int64)), int(step[odd == 1].sum(dtype=np.int64))
            one[1], one[2] = (one[1] + outside, one[2] + inside) if one[0] == 0 else (one[1] + inside, one[2] + outside)
            one[0] ^= int(odd[-1])
    columns = list(zip(*[(*k, *v) for k, v in found.items()], strict=True)) or [()] * 6
    kinds = [pa.int64()] * 5 + [pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["file", "block", "odd", "outside", "inside", "first"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole objects, and the pieces of those that begin or end in another split."""
    out: list[tuple[int, int, int, bytes]] = []
    at, state, held = None, {}, []

    def close() -> None:
        """The end of a split: what is left belongs to an object that goes on."""
        if at is not None and state["depth"] > state["top"]:
            out.append((*at, MIDDLE if state["going"] else TAIL, b"".join(held)))

    def table() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["file", "block", "kind", "text"])

    for batch in batches:
        for lo, _, text in _runs(batch):
            here = (batch.column("file")[lo].as_py(), batch.column("block")[lo].as_py())
            if here != at:
                close()
                held, at = [], here
                state = {c: batch.column(c)[lo].as_py() for c in ("odd", "depth", "top")}
                state["going"] = state["depth"] > state["top"]  # it begins within an object
            data, odd, step = _structure(text)
            depth = state["depth"] + np.cumsum(np.where((odd ^ state["odd"]) == 0, step, 0), dtype=np.int64)
            ends = np.flatnonzero((data == ord("}")) & ((odd ^ state["odd"]) == 0) & (depth == state["top"])) + 1
            begin = 0
            for end in ends.tolist():
                held.append(text[begin:end])
                out.append((*at, HEAD if state["going"] else WHOLE, b"".join(held)))
                held, begin, state["going"] = [], end, False
            held.append(text[begin:])
            state["odd"], state["depth"] = state["odd"] ^ int(odd[-1]), int(depth[-1])
        yield table()
    close()
    yield table()


def read_json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that hold a JSON array of objects each (or objects one after another), by ``schema``.

    Files may be larger than a task's memory; an object may not.  An object that
    its file doesn't close gives no row; one that doesn't fit the schema gives nulls.
    """
    ship_package(spark)
    checkpoint_dir(spark)
    split_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    small = F.col("_metadata.file_size") <= min(WHOLE_BYTES, split_bytes)  # prunes the list of files
    whole = spark.read.text(path, wholetext=True).filter(small).select(F.col("value").cast("binary").alias("value")).mapInArrow(_objects, "text binary")
    text = whole.unionByName(_split_objects(spark.read.option("lineSep", "}").text(path).filter(~small))).select(F.decode("text", "UTF-8").alias("text"))
    # what stands between two objects isn't part of the second
    return text.select(F.from_json(F.expr("substring(text, instr(text, '{'))"), schema).alias("x")).select("x.*")


def _split_objects(lines: DataFrame) -> DataFrame:
    """The objects of files that are read in splits, each with what stands before it."""
    source = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    splits = source.select("file", "block", "value").mapInArrow(_summaries, "file bigint, block bigint, odd bigint, outside bigint, inside bigint, first string").checkpoint()
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = splits.withColumn("at_odd", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    change = F.when(F.col("at_odd") == 0, F.col("outside")).otherwise(F.col("inside"))
    top = F.when(F.first("first").over(Window.partitionBy("file").orderBy("block")) == "[", 1).otherwise(0)
    starts = odd.select("file", "block", F.col("at_odd").alias("odd"), F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth"), top.cast("bigint").alias("top"))
    if splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        placed = source.join(F.broadcast(starts), ["file", "block"])
    else:
        placed = source.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "seq")
    parts = placed.select("file", "block", "value", "odd", "depth", "top").mapInArrow(_pieces, "file bigint, block bigint, kind int, text binary")
    # an object's number is the split that it begins in
    begun = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = parts.filter(F.col("kind") != WHOLE).withColumn("object", F.last(F.when(F.col("kind") == TAIL, F.col("block")), True).over(begun))
    joined = crossing.groupBy("file", "object").agg(F.sort_array(F.collect_list(F.struct("block", "kind", "text"))).alias("ps"))
    closed = joined.filter(F.exists("ps", lambda p: p["kind"] == HEAD)).select(F.aggregate("ps", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["text"])).alias("text"))
    return parts.filter(F.col("kind") == WHOLE).select("text").unionByName(closed)
