"""Interaction audit of document filters: what each one removes, in every order.

A document is marked by the first four filters on its own; the fifth, exact
repetition, is an existential self-join: a row is marked if a row with the same
hash, exactly the same text and a smaller doc_id exists.  The marks of that
join are united with those of the other filters and the bits of a document are
put together, so that it becomes one of 32 combinations.  All 120 orders, their
steps and the Shapley sums then follow from the counts of the combinations,
however many documents there are.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.session import checkpoint_dir

FILTERS = "ABCDE"
#: Words are runs of anything else.
_SPACES = " \t\n\x0b\x0c\r"
#: So many hashes at most are broadcast (8 bytes each).
BROADCAST_HASHES = 1_000_000
#: Rows of one text that one task compares, about.
ROWS_OF_A_TEXT = 10_000


def failures(text: Column) -> Column:
    """Bits 1 to 8 of a text that fails A (under 50 words), B (distinct words under 65 %), C (capitals over 5 %), D (holds a symbol)."""
    words = F.array_remove(F.split(F.translate(text, _SPACES[1:], " " * 5), " "), "")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    rules = (n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]"))
    bits = F.lit(0)
    for k, failed in enumerate(rules):
        bits = bits + F.when(failed, 1 << k).otherwise(0)
    return bits


def repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, h: the text's hash) for which a row with the same text and a smaller doc_id exists.

    Only rows whose hash stands more than once are moved with their texts.  The
    other side holds each text once, with its smallest doc_id; where a text has
    many rows, both sides are dealt out by a second key, as many parts as the
    count asks for.
    """
    parts = F.ceil(F.col("n") / ROWS_OF_A_TEXT).cast("int").alias("parts")
    seen = docs.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", parts).checkpoint()
    if seen.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
        seen = F.broadcast(seen)
    again = docs.join(seen, "h").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    # smallest ids within each part, then one row a text with the smallest of all
    first = again.filter("doc_id is not null").groupBy("h", "part", "text").agg(F.min("doc_id").alias("least"), F.max("parts").alias("parts"))
    first = first.groupBy("h", "text").agg(F.min("least").alias("least"), F.max("parts").alias("parts"))
    dealt = first.select("h", "text", "least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    a, b = again.alias("a"), dealt.alias("b")
    on = (F.col("a.h") == F.col("b.h")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.text") == F.col("b.text")) & (F.col("b.least") < F.col("a.doc_id"))
    return a.join(b, on, "left_semi").drop("parts", "part")


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, bits, n, good, toxic: documents by part and the filters they fail, and how many of them are labelled so."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    # rows of equal id and text fail the same filters, so id and hashes name a document
    key = ("doc_id", "h", "h2", "name")
    hashed = rows.select("doc_id", F.col("part").alias("name"), "text", F.xxhash64("text").alias("h"), F.hash("text", F.octet_length("text")).alias("h2"))
    single = hashed.select(*key, failures(F.col("text")).alias("bits"), F.lit(1).cast("bigint").alias("n")).groupBy(*key).agg(F.max("bits").alias("bits"), F.sum("n").alias("n"))
    again = repeats(hashed).select(*key, F.lit(1 << 4).alias("bits"), F.lit(0).cast("bigint").alias("n"))
    marked = single.union(again).groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    # rows without an id collapse here, so that they aren't one task's in the join
    counted = marked.groupBy("doc_id", F.col("name").alias("part"), "bits").agg(F.sum("n").alias("n"))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    labelled = counted.join(known, "doc_id", "left")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias("good" if c == "quality" else c)
    return labelled.groupBy("part", "bits").agg(F.sum("n").alias("n"), of("quality"), of("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    600 rows for each part (the values of ``part_col``; null: an empty string).
    Null texts are empty; they repeat each other like any text.  Rows of one id
    don't repeat each other; a null id repeats nothing and is repeated by
    nothing.  Repeated rows count each; a document is good or toxic if any of
    its labels says so.  An empty table gives no rows; other columns are ignored.
    """
    checkpoint_dir(docs.sparkSession)
    counts = combinations(docs, labels, id_col, text_col, part_col)
    # at most 32 combinations a part
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("found"))
    steps = F.transform(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]), lambda o: F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda k: F.struct(o.alias("filter_order"), k.alias("step"))))
    rows = parts.withColumn("s", F.explode(F.flatten(steps))).select("part", "s.*", "found")
    bit = lambda step: F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {step}, 1)) - 1)")
    earlier = F.when(F.col("step") > 1, bit(1)).otherwise(0)
    for k in range(2, len(FILTERS)):
        earlier = earlier + F.when(F.col("step") > k, bit(k)).otherwise(0)
    rows = rows.withColumns({"own": bit("step"), "before": earlier})
    zero = F.lit(0).cast("bigint")

    def total(which, value=lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("found", which), zero, lambda a, x: a + value(x))

    own, before = F.col("own"), F.col("before")
    fails = lambda x: x["bits"].bitwiseAND(own) != 0
    gone = lambda x: x["bits"].bitwiseAND(before) != 0
    now = lambda x: fails(x) & ~gone(x)
    # of the orders of the m filters that a document fails, one in m has this one first
    share = lambda x: x["n"] * (F.lit(120) / F.bit_count(x["bits"]))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda x: ~fails(x) & ~gone(x)).alias("kept"), total(now).alias("removed"), total(lambda x: fails(x) & gone(x)).alias("redundant"), total(lambda x: x["bits"] == own).alias("unique_fails"),
        total(now, lambda x: x["good"]).alias("good_lost"), total(now, lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: share(x).cast("bigint")).alias("shapley"),
    )
