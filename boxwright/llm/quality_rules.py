"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Every text gets counts of words, symbols, repeated lines and repeated word
windows, and a score: the mean, over its words and word pairs, of the log ratio
between two multinomials over hash buckets.  One is counted from trusted
documents, the other from the whole corpus; the trusted one is smoothed with
the corpus one, so that a bucket which trusted texts never use has a finite
ratio.  Trusted documents are counted in two halves by id, and a document is
scored by the half it isn't in.  The threshold comes from the trusted
documents' own scores, so it follows the corpus and its size, not one data set.

Nothing but (text, bucket) counts meets in a shuffle; texts stay where they are
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.session import checkpoint_dir

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[^#*$%&|<>]+"
#: So many ids at most are broadcast (8 bytes each, under 64 MB as a hash table); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def _buckets(words: Column, buckets: int) -> Column:
    """Bucket numbers of all words and word pairs."""
    pairs = F.when(
        F.size(words) > 1,
        F.zip_with(words, F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))),
    ).otherwise(F.array().cast("array<int>"))
    return F.array_compact(F.concat(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")), pairs))


def _base(docs: DataFrame) -> DataFrame:
    """Adds the counts to (doc_id, text, _words, ...).

    Equal three-word windows are found by their 64-bit hashes, sorted with their
    places, so a text of n words takes n log n steps.
    """
    n = F.size("_words")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    out = docs.withColumns({"_lines": lines, "_windows": windows})
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumns(
        {
            "n_words": n.cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace(F.coalesce("text", F.lit("")), _SYMBOLS, "")).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_placed": placed,
        }
    )
    shared = F.filter(
        "_placed",
        lambda x, k: ((k > 0) & (F.get("_placed", k - 1)["h"] == x["h"])) | F.coalesce(F.get("_placed", k + 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(shared, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return out.withColumn("n_repeat_words", F.when(F.col("_placed").isNotNull(), covered).otherwise(0).cast("bigint")).drop("_lines", "_windows", "_placed")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _threshold(scored: DataFrame, deviations: float, lost: float) -> float:
    """A threshold for (score, _trusted) rows.

    Between the low bound (mean less deviations) and the high one (the quantile)
    there may be trusted documents in the width of their distribution, or others.
    The high bound holds if the corpus has at least twice as many documents there
    as the trusted ones would make expect.
    """
    known = scored.filter("_trusted").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev"), F.percentile_approx("score", lost, 10_000).alias("high"), F.count("*").alias("n")).first()
    if not known["n"]:
        return float("-inf")
    low, high = round(known["mean"] - deviations * known["dev"], 9), known["high"]
    if low >= high:
        return high
    between = (F.col("score") >= low) & (F.col("score") < high)
    there = scored.agg(F.count_if(between).alias("all"), F.count_if(between & F.col("_trusted")).alias("trusted"), F.count("*").alias("n")).first()
    return high if there["all"] * known["n"] >= 2 * there["trusted"] * there["n"] else low


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 16,
    prior: float = 1.0,
    deviations: float = 3.0,
    lost: float = 0.01,
    row_col: str | None = None,
) -> DataFrame:
    """Counts, score and verdict of every row of ``docs``.

    ``trusted`` has the ids (``id_col``) of trusted documents.  Returns doc_id,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, score and threshold.  A row is kept if it
    passes the base rules and its score isn't under the threshold.  That is never
    over the score that a share ``lost`` of the trusted documents (of those that
    pass the base rules) doesn't reach, and it is that score where the corpus has
    another population under it; else it is the mean of their scores less
    ``deviations`` standard deviations.

    Null and empty texts have no words and fail the base rules.  Null ids are
    kept as null and never trusted.  Repeated rows are judged and counted as
    often as they stand; ids may repeat.  Without trusted documents nothing is
    known against a text, so the base rules alone decide.  An empty table gives
    no rows.  Other columns, whatever their names, are ignored.  ``row_col``
    names a column with a number for each row, the same at each read; if given,
    it stands first in the result.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    ids = trusted.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct().withColumn("_trusted", F.lit(True))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # its size was checked
    base = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).alias("_row")] if row_col else []))
        .join(ids, F.col("doc_id") == F.col("_id"), "left")
        .withColumns({"_trusted": F.coalesce("_trusted", F.lit(False)), "_fold": F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)), F.lit(0)).cast("int")})
        .drop("_id")
    )
    base = base.withColumn("_words", words_of(F.col("text")))
    # what the corpus and each half of the trusted documents have in each bucket
    counted = (
        # outer, then a filter: for an inner one Spark would compute the buckets a second time
        base.select("_trusted", "_fold", F.explode_outer(_buckets(F.col("_words"), buckets)).alias("bucket"))
        .filter("bucket is not null")
        .groupBy("bucket")
        .agg(
            F.count("*").alias("raw"),
            F.sum((F.col("_trusted") & (F.col("_fold") == 1)).cast("bigint")).alias("t0"),  # for documents of half 0
            F.sum((F.col("_trusted") & (F.col("_fold") == 0)).cast("bigint")).alias("t1"),
        )
        .checkpoint()  # at most ``buckets`` rows
    )
    total = counted.agg(F.sum("raw"), F.sum("t0"), F.sum("t1")).first()
    raw, *halves = ((x or 0) for x in total)

    def ratio(count: str, n: int) -> Column:
        share = F.col(count) / F.lit(float(n)) / (F.col("raw") / F.lit(float(raw or 1))) if n else F.lit(1.0)
        return F.log((share + prior) / (1 + prior))

    table = counted.select("bucket", ratio("t0", halves[0]).alias("l0"), ratio("t1", halves[1]).alias("l1"))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keys = ["_row", "doc_id", "_trusted", "_fold", *stats]
    scored = (
        _base(base)
        .select(F.col("_row") if row_col else F.monotonically_increasing_id().alias("_row"), *keys[1:], _buckets(F.col("_words"), buckets).alias("_buckets"))
        .select(*keys, F.explode_outer("_buckets").alias("bucket"))
        .join(F.broadcast(table), "bucket", "left")  # ``buckets`` rows at most
        .groupBy(*keys)
        .agg(F.avg(F.when(F.col("_fold") == 0, F.col("l0")).otherwise(F.col("l1"))).alias("score"))
        .withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
        .withColumn("base_failed", base_failed())
        .checkpoint()
    )
    threshold = _threshold(scored.filter("not base_failed"), deviations, lost)
    row = [F.col("_row").alias(row_col)] if row_col else []
    return scored.select(
        *row, "doc_id", *stats, "base_failed", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score", F.lit(threshold).alias("threshold")
    )
