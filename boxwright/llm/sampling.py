"""Bounded samples that don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashed(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` distinct ids of least hash (all, if fewer), in a column named as ``id_col``.

    Null ids take no part, and an id that repeats counts once.  Where there are
    many more than ``n``, a bound on the hash, twice the share that is wanted,
    leaves about 2n of them to sort, so that no task gets n rows from each
    partition of a large table; should it leave fewer than n, it is left out.
    """
    h = F.xxhash64(id_col)
    ids = rows.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    count = ids.count()
    if count > 4 * n:
        fewer = ids.filter(h < -(1 << 63) + int((1 << 64) * (2 * n / count)))
        if fewer.limit(n).count() == n:
            ids = fewer
    return ids.orderBy(h, id_col).limit(n)


def one_row_each(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """One row of ``rows`` for each of the ``ids`` (which ``least_hashed`` bounded): the least one where an id repeats."""
    others = [c for c in rows.columns if c != id_col]
    joined = rows.join(F.broadcast(ids), id_col, "left_semi")  # as many ids as the sample has
    return joined.groupBy(id_col).agg(F.min(F.struct(*others)).alias("_least")).select(id_col, *[F.col(f"_least.{c}").alias(c) for c in others])
