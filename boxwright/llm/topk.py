"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are rounded to integers, so scores are exact.  They are put into buckets
of similar length, and buckets into blocks of bounded size; queries into blocks
too.  Every (query block, vector block) pair is one task's work, so neither side
is ever whole in one place.

A first round compares every query with a fixed number of blocks, most of them of the
longest bucket, and yields a lower bound of its k-th best score.  In the second round a
query goes only to the buckets whose longest vector can reach that bound, and
only the queries that go to a bucket are dealt into blocks there: what the bounds
exclude is shuffled on neither side.  In each pair of blocks a query has the
cosine that a vector of that block needs at least: bound / (query length x
longest length in the block).  Near 1 few vectors can qualify, and those are
picked by single coordinates (a vector at that cosine is close to the query's
direction in each of them); for a low cosine only the prefix of long enough
vectors is taken.  What is left is verified by products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.session import checkpoint_dir

#: Vectors in a block, and queries in a query block, about.
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 512
#: Blocks of the longest bucket, and of each other one, in the first round.
FIRST_LONGEST, FIRST_OTHERS = 4, 1
#: Above this local cosine, coordinates prune; under it, lengths.
COORDINATE_COSINE = 0.6
FOCUS = 3


def quantize(vector: Column, scale: int = 1024) -> Column:
    """Each component times ``scale``, rounded down; null if the vector or a component is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1).astype(np.float64)


def _best(queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: highest score first, then smallest id."""
    order = np.lexsort((ids, -scores, queries))
    queries, scores, ids = queries[order], scores[order], ids[order]
    start = np.ones(len(queries), dtype=bool)
    start[1:] = queries[1:] != queries[:-1]
    place = np.arange(len(queries)) - np.maximum.accumulate(np.where(start, np.arange(len(queries)), 0))
    return queries[place < k], scores[place < k], ids[place < k]


def _candidates(q: np.ndarray, q_norm: float, bound: float, p: np.ndarray, p_norm: np.ndarray) -> np.ndarray:
    """Rows of ``p`` (longest first) whose product with ``q`` may reach ``bound``."""
    everything = np.arange(len(p))
    if bound <= 0 or q_norm == 0:
        return everything
    cosine = bound / (q_norm * p_norm[0]) if p_norm[0] > 0 else np.inf
    if cosine > 1 + 1e-9:
        return everything[:0]
    # length pruning: no vector shorter than bound / |q| reaches the bound
    rows = everything[: int(np.searchsorted(-p_norm, -(bound / q_norm) * (1 - 1e-9), side="right"))]
    if cosine < COORDINATE_COSINE:
        return rows
    # coordinate pruning: at cosine c, a unit vector's coordinate f is q_f c -+ sqrt((1 - q_f^2)(1 - c^2))
    unit = q / q_norm
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        slack = np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - cosine**2))) + 1e-9
        least = unit[f] * cosine - slack
        # the other side of the range holds for cosines of at least c too, if c is over |unit_f|
        most = unit[f] * cosine + slack if cosine > abs(unit[f]) else 1.0
        if unit[f] < 0:
            least, most = (least if cosine > abs(unit[f]) else -1.0), unit[f] * cosine + slack
        share = p[rows, f] / np.maximum(p_norm[rows], 1e-300)
        rows = rows[(share >= least) & (share <= most)]
    return rows


def _join_blocks(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, q_row, vec_id, score: each query's k best vectors in each block that it is dealt to."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], type=pa.int64()) for n in ("query_id", "q_row", "vec_id", "score")})
        if not left.num_rows or not right.num_rows:
            return empty
        q_id, p_id = left["q_id"].to_numpy(), right["id"].to_numpy()
        q_row, p_row = left["row"].to_numpy(), right["row"].to_numpy()
        bound = left["bound"].to_numpy(zero_copy_only=False).astype(float)
        q, p = _matrix(left["q_v"]), _matrix(right["v"])
        q_norm, p_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((p * p).sum(axis=1))
        order = np.argsort(-p_norm, kind="stable")
        p, p_norm, p_id, p_row = p[order], p_norm[order], p_id[order], p_row[order]
        found: list[tuple[np.ndarray, ...]] = []
        for i in range(len(q)):
            rows = _candidates(q[i], q_norm[i], bound[i], p, p_norm)
            rows = rows[p_row[rows] != q_row[i]]
            score = p[rows] @ q[i]
            hit = score >= bound[i]
            rows, score = rows[hit], score[hit]
            if len(rows) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[score >= least], score[score >= least]
            _, s, v = _best(np.zeros(len(rows)), score, p_id[rows], k)
            found.append((np.full(len(v), q_id[i]), np.full(len(v), q_row[i]), v, s.astype(np.int64)))
        a, b, c, d = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": a, "q_row": b, "vec_id": c, "score": d})

    pair = ("bucket", "part", "q_block")
    return queries.groupBy(*pair).cogroup(vectors.groupBy(*pair)).applyInArrow(run, "query_id bigint, q_row bigint, vec_id bigint, score bigint")


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of all blocks, of each query; each partition keeps its own k best before the shuffle."""
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "q_row", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, buckets: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors for each row of ``vectors`` for which ``queries`` holds.

    Score: inner product of the rounded vectors; ties go to the smaller id; a
    query is compared with every row but its own.  Fewer than k others: all of them.

    Vectors that are null, empty, or hold null or a non-finite component, take no
    part, nor do null ids.  Vectors of several lengths: each query meets those of
    its own length, one length after another.  Scores are exact; vectors whose
    squared length after rounding reaches 2^53 are an error, raised before any
    comparing of their length, as their products would not be.  Repeated ids: each
    row is a candidate, and a query with k results of its own.  An empty table
    gives no rows.  Other columns are ignored.
    """
    checkpoint_dir(vectors.sparkSession)
    rounded = vectors.withColumn("_q", queries).select(F.col(id_col).cast("bigint").alias("id"), quantize(F.col(vector_col), scale).alias("v"), F.coalesce("_q", F.lit(False)).alias("is_query"), F.monotonically_increasing_id().alias("row"))
    rounded = rounded.filter("id is not null and v is not null and size(v) > 0").withColumn("length2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).checkpoint()
    sizes = [r["size"] for r in rounded.filter("is_query").select(F.size("v").alias("size")).distinct().collect()]  # a table has one, or few
    out = rounded.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    for n in sorted(sizes):
        out = out.union(_top_k_of_one_length(rounded.filter(F.size("v") == n), k, buckets))
    return out


def _top_k_of_one_length(rounded: DataFrame, k: int, buckets: int) -> DataFrame:
    """``top_k`` of rounded vectors that have one length."""
    cuts = rounded.agg(F.max("length2").alias("most"), F.percentile_approx("length2", [i / buckets for i in range(1, buckets)], 10_000).alias("cuts")).first()
    if (cuts["most"] or 0) >= 2**53:
        raise ValueError("vectors are too long for exact scores: choose a smaller scale")
    edges = sorted(set(cuts["cuts"] or []))
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + (F.col("length2") > e).cast("int")
    placed = rounded.withColumn("bucket", bucket)
    sizes = {r["bucket"]: (-(-r["n"] // BLOCK_VECTORS), r["longest2"]) for r in placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("length2").alias("longest2")).collect()}  # ``buckets`` rows at most
    # by row, not by id, so that a repeated id is spread too
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), _of_bucket({b: parts for b, (parts, _) in sizes.items()})))
    asked = rounded.filter("is_query").select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), "length2", "row")
    first = {b: min(parts, FIRST_LONGEST if b == max(sizes) else FIRST_OTHERS) for b, (parts, _) in sizes.items()}

    def compare(queries: DataFrame, parts: dict[int, tuple[int, int]]) -> DataFrame:
        """Queries (with bounds) against these parts of each bucket, as far as their bounds reach."""
        ranges = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(sizes[b][1]).alias("longest2")) for b, (lo, hi) in parts.items()])
        reach = F.sqrt(F.col("length2")) * F.sqrt(F.col("_r.longest2")) * (1 + 1e-9)
        going = queries.withColumn("_r", F.explode(ranges)).filter((F.col("bound") <= 0) | (F.col("bound") <= reach)).select("q_id", "q_v", "bound", "row", "_r.bucket", "_r.lo", "_r.hi")
        q_blocks = {r["bucket"]: -(-r["n"] // BLOCK_QUERIES) for r in going.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        left = going.select(
            "q_id", "q_v", "bound", "row", "bucket", F.pmod(F.xxhash64("row", F.lit(1)), _of_bucket(q_blocks)).alias("q_block"), F.explode(F.sequence(F.col("lo").cast("bigint"), F.col("hi").cast("bigint") - 1)).alias("part")
        )
        here = placed.filter(F.col("bucket").isin(list(q_blocks)) & (F.col("part") >= _of_bucket({b: lo for b, (lo, _) in parts.items()})) & (F.col("part") < _of_bucket({b: hi for b, (_, hi) in parts.items()})))
        right = here.select("id", "v", "row", "bucket", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), _of_bucket(q_blocks) - 1)).alias("q_block"))
        return _join_blocks(left, right, k)

    least = F.lit(-(1 << 62)).cast("bigint")
    found = compare(asked.withColumn("bound", least), {b: (0, n) for b, n in first.items()}).checkpoint()
    rest = {b: (first[b], parts) for b, (parts, _) in sizes.items() if first[b] < parts}
    if rest:
        known = _best_of(found, k).filter(F.col("rank") == k).select(F.col("q_row").alias("row"), F.col("score").alias("bound"))
        bounded = asked.join(known, "row", "left").withColumn("bound", F.coalesce("bound", least)).checkpoint()
        found = found.union(compare(bounded, rest))
    return _best_of(found, k).drop("q_row")


def _of_bucket(values: dict[int, int]) -> Column:
    """A bucket's value, from a table of one entry for each bucket at most."""
    return F.element_at(F.create_map(*[F.lit(x) for b, v in values.items() for x in (b, v)]), F.col("bucket")).cast("bigint") if values else F.lit(0).cast("bigint")
