"""Running sums over an order that spans all tasks: a distributed prefix scan; and flags in such an order, packed.

Rows are dealt out by ranges of their whole order, so that rows that tie in its
first columns are spread too, and sorted in each partition.  Every partition is
then summed up by itself; the sums of the partitions before it, a row for each
partition and group, are its offsets; and each partition's own scan runs over
its rows where they lie.  So there is one shuffle, and no task gets more than
its share of the rows, however they are distributed over groups and values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from boxwright.session import checkpoint_dir, ship_package

#: Rows of a partition, about; with fewer rows there are as many partitions as a shuffle has.
ROWS_PER_TASK = 1_000_000
#: Flags of a block at most, or those of one batch, if it has more.
BLOCK = 1_000_000


def ordered(rows: DataFrame, by: tuple[str, ...], order: tuple[Column, ...]) -> DataFrame:
    """The rows in the order of ``by`` and ``order`` over numbered partitions (``_p``).

    Read three times (counted, sampled, sorted), so they should be cheap to read;
    checkpointed, so that each row keeps its partition.
    """
    return _placed(rows, by, order).checkpoint()


def _placed(rows: DataFrame, by: tuple[str, ...], order: tuple[Column, ...]) -> DataFrame:
    spark = rows.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_TASK))
    keys = (*[F.col(c) for c in by], *order)
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())


def _scan(rows: DataFrame, offsets: DataFrame, by: tuple[str, ...], kept: list[str], added: dict[str, type], work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``work`` over each partition's rows with their offsets and ``_g``, the number of their group in it; it gives the columns ``kept`` and those ``added``."""
    numbered = offsets.withColumn("_g", F.row_number().over(Window.partitionBy("_p").orderBy(*by)))
    # a row for each partition, and one more for each group
    joined = rows.join(F.broadcast(numbered), ["_p", *by])
    schema = StructType([rows.schema[c] for c in kept])
    for name, kind in added.items():
        schema = schema.add(name, kind())
    return joined.mapInArrow(work, schema)


def _groups(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group numbers of a batch's rows, and where each group starts and how many rows it has."""
    g = batch.column("_g").to_numpy()
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    return g, first, np.diff(np.append(first, len(g)))


def running_sums(placed: DataFrame, by: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """Adds for each of ``sums`` (whole numbers, not null) its sum over this row and all before it in the group.

    ``placed`` comes from ``ordered``; the groups are few (offsets are broadcast).
    """
    kept, names, n = placed.columns, list(sums), len(sums)
    totals = placed.groupBy("_p", *by).agg(*[F.sum(c).cast("bigint").alias(f"_0{k}") for k, c in enumerate(sums.values())])
    over = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", *by, *[F.coalesce(F.sum(f"_0{k}").over(over), F.lit(0)).alias(f"_0{k}") for k in range(n)])
    valued = placed.withColumns({f"_v{k}": c.cast("bigint") for k, c in enumerate(sums.values())})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = 0, [0] * n
        for batch in batches:
            if not batch.num_rows:
                continue
            g, first, size = _groups(batch)
            new = []
            for k in range(n):
                upto = np.cumsum(batch.column(f"_v{k}").to_numpy())
                before = np.where(first > 0, upto[first - 1], 0)
                if g[0] == last:  # the first group goes on from the batch before
                    before[0] -= carry[k]
                local = upto - np.repeat(before, size)
                carry[k] = int(local[-1])
                new.append(pa.array(local + batch.column(f"_0{k}").to_numpy(), type=pa.int64()))
            last = int(g[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *names])

    return _scan(valued, offsets, by, kept, dict.fromkeys(names, LongType), work)


def flag_blocks(rows: DataFrame, by: str, order: tuple[Column, ...], flag: str, extra: str) -> DataFrame:
    """The 0/1 column ``flag`` of the rows in the order of ``by`` and ``order``, packed: a bit for each row.

    _p and _k (the order of the blocks), ``by``, ``extra`` (a whole number, one
    for each group), n (rows), hits (those with 1), n_before and hits_before (of
    the group's blocks before) and bits.  A block holds rows of one group, BLOCK
    at most; blocks are checkpointed, the rows themselves are not written again.
    """
    kind = rows.schema[by].dataType.simpleString()
    packed = _placed(rows, (by,), order).select("_p", by, F.col(extra).cast("bigint").alias(extra), F.col(flag).cast("tinyint").alias("_flag"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, head, held, n = 0, None, [], 0

        def block() -> pa.RecordBatch:
            flags = np.concatenate(held)
            p, group, number = (c.slice(0, 1) for c in head)
            rest = [pa.array([x], type=t) for x, t in ((k, pa.int64()), (len(flags), pa.int64()), (int(flags.sum(dtype=np.int64)), pa.int64()), (np.packbits(flags).tobytes(), pa.binary()))]
            return pa.RecordBatch.from_arrays([p, group, number, *rest], names=["_p", by, extra, "_k", "n", "hits", "bits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, flags = batch.column(by), batch.column("_flag").to_numpy()
            codes = pc.fill_null(groups.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if n and (n + hi - lo > BLOCK or head[1][0].as_py() != groups[lo].as_py()):
                    yield block()
                    k, held, n = k + 1, [], 0
                if not n:
                    head = [batch.column(c).slice(lo, 1) for c in ("_p", by, extra)]
                held.append(flags[lo:hi])
                n += hi - lo
        if n:
            yield block()

    blocks = packed.mapInArrow(work, f"_p int, {by} {kind}, {extra} bigint, _k bigint, n bigint, hits bigint, bits binary").checkpoint()
    over = Window.partitionBy(by).orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("_p", "_k", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_before") for c in ("n", "hits")])
    return blocks.join(F.broadcast(before), ["_p", "_k"])  # a row for each block


def unpacked(bits: bytes, n: int) -> np.ndarray:
    """The flags of a block."""
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n)
