"""Seeded splits, quotas and samples.

The order is that of md5(seed|id): the same in any engine, whatever the
partitioning.  What a sampler needs is not each row's rank but on which side of
a few ranks it lies.  So the keys are counted in a histogram of their first
digits, in each stratum: it says in which bin each of those ranks falls.  All
rows of other bins are placed by their bin alone, where they lie; only the rows
of the few cut bins are sorted.  No row is shuffled but those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.operators.scan import ordered, running_sums
from boxwright.session import checkpoint_dir

#: Hexadecimal digits of the key that the histogram starts with, and by which it grows.
DIGITS = 3
#: A cut bin of more rows than this gets a finer histogram.
ROWS_IN_A_BIN = 500_000
#: So many strata at most are broadcast.
BROADCAST_STRATA = 100_000


def shuffle_key(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")).cast("binary"))


def _cut(n: Column, share: float) -> Column:
    return F.floor(n * F.lit(float(share)))


def ranked(rows: DataFrame, id_col: str, by: str | None = None, seed: int = 42) -> DataFrame:
    """Adds ``rank`` (from 1, by the shuffle key, in each stratum) and ``total`` (of it), for joins by rank; strata are few.

    The rows are read three times.
    """
    strata = ("_of",)
    keyed = rows.withColumns({"_key": shuffle_key(id_col, seed), "_of": F.struct(F.lit(0) if by is None else F.col(by))})
    keyed = keyed.withColumn("_of", F.to_json("_of"))
    placed = running_sums(ordered(keyed, strata, (F.asc("_key"), F.asc(id_col))), strata, {"rank": F.lit(1)})
    totals = keyed.groupBy("_of").agg(F.count("*").alias("total"))
    return placed.join(F.broadcast(totals), "_of").drop("_of", "_key", "_p")  # a row for each stratum


def slots(rows: DataFrame, id_col: str, limits: Callable[[DataFrame], DataFrame], by: str | None = None, seed: int = 42) -> DataFrame:
    """Adds ``slot``: how many of its stratum's limits are smaller than the row's rank (by the shuffle key, from 1).

    ``limits`` gets a row for each stratum, ``by`` (absent without strata) and
    ``total``, and adds ``limits``, an array of whole numbers.  Rows of a null
    stratum are a stratum; rows of one id follow each other in any order.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    # a struct, so that rows without a stratum meet each other
    keyed = rows.withColumns({"_key": shuffle_key(id_col, seed), "_of": F.struct(F.lit(0) if by is None else F.col(by))})
    digits = 0
    while True:
        digits += DIGITS
        bin_ = F.substring("_key", 1, digits).alias("_bin")
        counts = keyed.groupBy("_of", bin_).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("_of").orderBy("_bin"))
        bins = counts.withColumns({"_upto": upto, "total": F.sum("n").over(Window.partitionBy("_of"))}).checkpoint()
        strata = bins.groupBy("_of").agg(F.first("total").alias("total"))
        if by is not None:
            strata = strata.withColumn(by, F.col(f"_of.{by}"))
        wanted = limits(strata).select("_of", "total", F.posexplode("limits").alias("_k", "_limit"))
        # the bin of each limit, how many of its rows lie at or under it, and whether others lie over it; none: before or behind all bins
        found = wanted.join(bins.select("_of", "_bin", "n", "_upto"), "_of").filter("_limit > _upto - n and _limit <= _upto")
        cut = found.select("_of", F.struct(F.col("_bin").alias("bin"), (F.col("_limit") - F.col("_upto") + F.col("n")).alias("rest"), (F.col("_limit") < F.col("_upto")).alias("open"), F.col("n").alias("n")).alias("c"))
        none = wanted.filter("_limit <= 0").select("_of", F.struct(F.lit("").alias("bin"), F.lit(0).cast("bigint").alias("rest"), F.lit(False).alias("open"), F.lit(0).cast("bigint").alias("n")).alias("c"))
        cuts = cut.union(none).groupBy("_of").agg(F.collect_list("c").alias("_cuts")).checkpoint()
        largest = F.max(F.array_max(F.transform(F.filter("_cuts", lambda c: c["open"]), lambda c: c["n"])))
        known = cuts.agg(F.count("*").alias("strata"), largest.alias("largest")).first()
        if digits >= 30 or (known["largest"] or 0) <= ROWS_IN_A_BIN:
            break
    if known["strata"] <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    placed = keyed.withColumn("_bin", bin_).join(cuts, "_of", "left")
    lower = F.coalesce(F.size(F.filter("_cuts", lambda c: c["bin"] < F.col("_bin"))), F.lit(0))
    here = F.coalesce(F.filter("_cuts", lambda c: c["open"] & (c["bin"] == F.col("_bin"))), F.array().cast("array<struct<bin:string,rest:bigint,open:boolean,n:bigint>>"))
    placed = placed.withColumns({"slot": lower, "_cuts": here})
    sure = placed.filter(F.size("_cuts") == 0)
    nth = F.row_number().over(Window.partitionBy("_of", "_bin").orderBy("_key", id_col))
    sorted_ = placed.filter(F.size("_cuts") > 0).withColumn("_nth", nth)
    exact = sorted_.withColumn("slot", F.col("slot") + F.size(F.filter("_cuts", lambda c: c["rest"] < F.col("_nth")))).drop("_nth")
    return sure.unionByName(exact).drop("_key", "_of", "_bin", "_cuts")


def _constant(*wanted: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """Limits that follow from a stratum's total."""
    return lambda strata: strata.withColumn("limits", F.array(*[w(F.col("total")).cast("bigint") for w in wanted]))


def _first(rows: DataFrame) -> DataFrame:
    return rows.filter("slot = 0").drop("slot")


def split(rows: DataFrame, id_col: str, shares: dict[str, float], rest: str, by: str | None = None, seed: int = 42) -> DataFrame:
    """``split`` from whole-number shares of each stratum, in order; what is left is ``rest``."""
    parts = list(shares.values())
    upto = [lambda n, k=k: sum((_cut(n, s) for s in parts[: k + 1]), F.lit(0)) for k in range(len(parts))]
    names = F.array(*[F.lit(x) for x in (*shares, rest)])
    return slots(rows, id_col, _constant(*upto), by, seed).withColumn("split", F.get(names, F.col("slot"))).drop("slot")


def sample(rows: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """K rows by the shuffle key (all, if fewer)."""
    return _first(slots(rows, id_col, _constant(lambda n: F.lit(k)), None, seed))


def sample_share(rows: DataFrame, id_col: str, ratio: float, seed: int = 42) -> DataFrame:
    """round(n x ratio) rows, half to even, at most all; a ratio of 1 or more is the table itself."""
    if ratio >= 1:
        return rows
    return _first(slots(rows, id_col, _constant(lambda n: F.bround(n * F.lit(float(ratio)))), None, seed))


def one_per_group(rows: DataFrame, id_col: str, by: str, seed: int = 42, k: int = 1) -> DataFrame:
    """The first row (or ``k`` rows) of each group."""
    return _first(slots(rows, id_col, _constant(lambda n: F.lit(k)), by, seed))


# fixed values: at most so many images of each condition; others take all
QUOTAS = {"snowy": 5000, "rainy": 5000, "dawn_dusk": 5000, "night": 6000}


def quota_sample(rows: DataFrame, id_col: str, size: int, caps: dict[str, int] | None = None, fill: str = "other", by: str = "condition", seed: int = 42) -> DataFrame:
    """Each condition up to its cap (none: all of it); ``fill`` gets what is missing to ``size``, maybe nothing."""
    caps = QUOTAS if caps is None else caps
    cap = F.lit(None).cast("bigint")
    for name, most in caps.items():
        cap = F.when(F.col(by) == name, F.lit(most)).otherwise(cap)

    def limits(strata: DataFrame) -> DataFrame:
        quota = F.least("total", F.coalesce(cap, F.col("total")))
        others = strata.withColumn("quota", F.when(F.coalesce(F.col(by) != fill, F.lit(True)), quota))
        # what the others take: one number, from a row for each condition
        taken = F.coalesce(F.sum(F.when(F.col(by).isNotNull(), F.col("quota"))).over(Window.partitionBy()), F.lit(0))
        return others.withColumn("limits", F.array(F.coalesce("quota", F.greatest(F.lit(size) - taken, F.lit(0))).cast("bigint"))).drop("quota")

    return _first(slots(rows, id_col, limits, by, seed))
