"""Training-set construction: merging sources, oversampling, work orders for variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import Box, area, size_bucket
from boxwright.functions.names import copy_name
from boxwright.functions.vocab import class_name

# fixed values: how often an image with such a class stands in the training set
MULTIPLIERS = {"bicycle": 2, "motorcycle": 3, "bus": 3}
VARIANTS = ("fog", "rain", "snow", "shadow")


def merge_sources(sources: dict[str, DataFrame | None], validation_from: str | None = None) -> DataFrame:
    """Rows of all sources, tagged, with the source before their names.

    A source that is None is skipped.  Validation rows come from one source
    only, if one is named; test rows are never merged.
    """
    parts = []
    for name, rows in sources.items():
        if rows is None:
            continue
        kept = rows.filter(F.col("split") != "test")
        if validation_from is not None and name != validation_from:
            kept = kept.filter(F.col("split") != "val")
        parts.append(kept.withColumn("source_dataset", F.lit(name)).withColumn("new_image", F.concat(F.lit(f"{name}_"), F.col("image_id").cast("string"))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def multipliers(boxes: DataFrame, table: dict[str, int] | None = None) -> DataFrame:
    """The largest multiplier of each image's classes, at least 1."""
    value = F.lit(1)
    for name, k in (MULTIPLIERS if table is None else table).items():
        value = F.when(F.col("class_name") == name, k).otherwise(value)
    return boxes.groupBy("image_id").agg(F.max(value).alias("mult"))


def oversample(images: DataFrame, boxes: DataFrame, table: dict[str, int] | None = None) -> DataFrame:
    """Training images of rare classes again, as ``_os1``, ``_os2``...; ``copy`` is 0 for originals."""
    mult = F.when(F.col("split") == "train", F.coalesce("mult", F.lit(1))).otherwise(1)
    copies = images.join(multipliers(boxes, table), "image_id", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), mult - 1)))
    name = F.col("image_id").cast("string")
    return copies.withColumn("new_image", F.when(F.col("copy") > 0, copy_name(name, "os", F.col("copy"))).otherwise(name)).drop("mult")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Boxes of every class and of every size before and after, as (kind, name, n_before, n_after)."""
    named = lambda rows: rows.select(F.inline(F.array(
        F.struct(F.lit("class").alias("kind"), class_name(F.col("class_id")).alias("name")), F.struct(F.lit("size").alias("kind"), size_bucket(area(Box.of())).alias("name"))
    )))
    both = named(before).withColumn("_after", F.lit(0)).unionByName(named(after).withColumn("_after", F.lit(1)))
    return both.groupBy("kind", "name").agg(F.sum(1 - F.col("_after")).alias("n_before"), F.sum("_after").alias("n_after"))


def dominance(replay: DataFrame, adverse: DataFrame) -> DataFrame:
    """Whether replayed images outnumber the others."""
    rows = replay.select(F.lit(1).alias("r")).union(adverse.select(F.lit(0).alias("r")))
    counted = rows.agg(F.sum("r").alias("n_replay"), F.sum(1 - F.col("r")).alias("n_adverse"))
    return counted.fillna(0).withColumn("dominated", F.col("n_replay") > F.col("n_adverse"))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from md5 of the seed and the parts: the same in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def variant_plan(images: DataFrame, copies: int = 1, seed: int = 42) -> DataFrame:
    """Work orders for photometric variants of training images: kind, brightness and noise are drawn by hash."""
    numbered = images.withColumn("copy", F.explode(F.when(F.col("split") == "train", F.sequence(F.lit(0), F.lit(copies))).otherwise(F.array(F.lit(0)))))
    draw = lambda what: uniform(seed, F.col("image_id"), F.col("copy"), F.lit(what))
    kind = F.element_at(F.array(*[F.lit(v) for v in VARIANTS]), F.floor(draw("kind") * len(VARIANTS)).cast("int") + 1)
    is_copy = F.col("copy") > 0
    name = F.col("image_id").cast("string")
    noise = F.when(draw("noise") < 0.3, F.when(draw("which") < 0.5, "blur").otherwise("noise")).otherwise("none")
    return numbered.select(
        "image_id", "split", "copy",
        F.when(is_copy, copy_name(name, "waug", F.col("copy"))).otherwise(name).alias("new_image"),
        F.when(is_copy, kind).otherwise("original").alias("variant"),
        (is_copy & (draw("brightness") < 0.5)).alias("brightness"),
        F.when(is_copy, noise).otherwise("none").alias("noise"),
    )
