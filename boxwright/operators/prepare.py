"""From annotations as read to clean boxes: filters, joins of images and labels, counts, masks to boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions.geometry import Box, clamp, is_degenerate
from boxwright.functions.vocab import CLASSES, DRIVING_ALIASES, class_id, normalize_class


def frames_with_targets(frames: DataFrame, names: tuple[str, ...] = tuple(DRIVING_ALIASES)) -> DataFrame:
    """Frames that hold a label of a target class with a box. Names are lower-cased but not trimmed here."""
    return frames.filter(F.exists("labels", lambda x: F.coalesce(F.lower(x["category"]).isin(*names), F.lit(False)) & x["box2d"].isNotNull()))


def explode_labels(frames: DataFrame) -> DataFrame:
    """One row for each label of a frame: name, weather, timeofday, scene (``undefined`` if missing), category and box."""
    attribute = lambda c: F.coalesce(F.col(f"attributes.{c}"), F.lit("undefined")).alias(c)
    rows = frames.select("name", *[attribute(c) for c in ("weather", "timeofday", "scene")], F.explode_outer("labels").alias("x"))
    return rows.select("name", "weather", "timeofday", "scene", F.col("x.category").alias("category"), *[F.col(f"x.box2d.{c}").alias(c) for c in Box._fields])


def clean_boxes(raw: DataFrame, aliases: dict[str, str], width: Column, height: Column) -> DataFrame:
    """Normalised class ids and clamped boxes; unknown classes, degenerate boxes and boxes outside the image are dropped."""
    named = raw.withColumn("class_id", class_id(normalize_class(F.col("category"), aliases))).filter(F.col("class_id").isNotNull() & ~is_degenerate(Box.of()))
    box, ok = clamp(Box.of(), width, height)
    return named.filter(ok).withColumns(box.named())


def keep_weathers(images: DataFrame, wanted: tuple[str, ...] | str) -> DataFrame:
    """Images of the wanted weathers, or of all."""
    return images if wanted == "all" else images.filter(F.col("weather").isin(*wanted))


def keep_listed(images: DataFrame, **wanted: tuple[str, ...] | None) -> DataFrame:
    """Images whose condition, split or other named column is one of a list; None takes all."""
    for column, values in wanted.items():
        if values is not None:
            images = images.filter(F.col(column).isin(*values))
    return images


def with_boxes(images: DataFrame, boxes: DataFrame, keep_negatives: bool) -> DataFrame:
    """Images and how many boxes they have; those without any are dropped or kept as negatives."""
    counts = boxes.groupBy("image_id").agg(F.count("*").alias("num_objects"))
    joined = images.join(counts, "image_id", "left" if keep_negatives else "inner")
    return joined.withColumn("num_objects", F.coalesce("num_objects", F.lit(0)))


def match_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Each image (dir, stem) with its annotation, and how it was found.

    ``same_dir``: same folder and stem (several: the first path).  ``unique``:
    the only annotation of that stem anywhere.  Else ``missing`` or ``ambiguous``.
    """
    here = annotations.groupBy("dir", "stem").agg(F.min("annotation").alias("near"))
    anywhere = annotations.groupBy("stem").agg(F.count("*").alias("n"), F.min("annotation").alias("far"))
    joined = images.join(here, ["dir", "stem"], "left").join(anywhere, "stem", "left")
    found = F.when(F.col("near").isNotNull(), "same_dir").when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return joined.withColumn("found", found).withColumn("annotation", F.when(F.col("found") == "same_dir", F.col("near")).when(F.col("found") == "unique", F.col("far"))).drop("near", "far", "n")


def find_by_name(wanted: DataFrame, images: DataFrame) -> DataFrame:
    """The path of a wanted name: as a direct path, else the only image of that base name."""
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    direct = images.select(F.col("image_path").alias("name"), F.col("image_path").alias("direct"))
    named = images.groupBy(base(F.col("image_path")).alias("base")).agg(F.count("*").alias("n"), F.min("image_path").alias("only")).filter("n = 1").drop("n")
    joined = wanted.join(direct, "name", "left").withColumn("base", base(F.col("name"))).join(named, "base", "left")
    return joined.select("name", F.coalesce("direct", "only").alias("image_path"))


def pair_by_stem(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images and label files of the same split and stem."""
    return images.join(labels, ["split", "stem"])


def existing(frames: DataFrame, images: DataFrame) -> DataFrame:
    """Frames with ``present``: whether their image is there."""
    there = images.select("name").distinct().withColumn("_there", F.lit(True))
    return frames.join(there, "name", "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")


def choose_masks(images: DataFrame, instance: DataFrame, panoptic: DataFrame, described: DataFrame) -> DataFrame:
    """Which of three mask sources an image takes; never two of them.

    Instance ids, else panoptic with a description, else panoptic read as
    instance ids, else ``no_mask``.  All sides have ``key``.
    """
    flag = lambda df, name: df.select("key").distinct().withColumn(name, F.lit(True))
    joined = images.join(flag(instance, "i"), "key", "left").join(flag(panoptic, "p"), "key", "left").join(flag(described, "d"), "key", "left")
    source = F.when(F.col("i"), "instance").when(F.col("p") & F.col("d"), "panoptic").when(F.col("p"), "panoptic_as_instance").otherwise("no_mask")
    return joined.withColumn("mask_source", source).drop("i", "p", "d")


def segment_boxes(runs: DataFrame) -> DataFrame:
    """The bounding box of every segment of an image, from pixel runs [x_start, x_end)."""
    return runs.groupBy("image_id", "segment_id").agg(
        F.min("x_start").cast("double").alias("x1"), F.min("y").cast("double").alias("y1"),
        F.max("x_end").cast("double").alias("x2"), (F.max("y") + 1).cast("double").alias("y2"),
    )


def pack_id(r: Column, g: Column, b: Column) -> Column:
    """A segment id from a colour."""
    return r + g * 256 + b * 65536


def class_counts(boxes: DataFrame) -> DataFrame:
    """A1: boxes of every class, 0 for absent ones."""
    spark = boxes.sparkSession
    names = spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in CLASSES])).alias("class_id", "class_name"))
    counts = boxes.groupBy(F.col("class_id").cast("int").alias("class_id")).agg(F.count("*").alias("n"))
    return names.join(F.broadcast(counts), "class_id", "left").select("class_id", "class_name", F.coalesce("n", F.lit(0)).alias("n"))


def unknown_classes(raw: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """A5: names outside the vocabulary with their counts, ``<empty>`` for blank ones."""
    name = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    shown = F.when(name == "", "<empty>").otherwise(name).alias("category")
    return raw.filter(normalize_class(F.col("category"), aliases).isNull()).groupBy(shown).agg(F.count("*").alias("n"))


def distribution(images: DataFrame, column: str, exclude_split: str | None = None) -> DataFrame:
    """A3: images by a column, one split left out if asked for."""
    kept = images if exclude_split is None else images.filter(F.col("split") != exclude_split)
    return kept.groupBy(column).agg(F.count("*").alias("n"))


def classes_of_images(boxes: DataFrame) -> DataFrame:
    """The distinct classes of every image, in order."""
    return boxes.groupBy("image_id").agg(F.sort_array(F.collect_set("class_id")).alias("classes"))


def skip_reasons(rows: DataFrame) -> DataFrame:
    """A4: rows by reason, those without one left out."""
    return rows.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def kept_and_counted(rows: DataFrame, reasons: tuple[str, ...]) -> tuple[DataFrame, Observation]:
    """A4: the rows whose ``reason`` is null, and counts of the others by reason, taken in the pass that drops them.

    The counts are there (``.get``) once an action on the kept rows is through.
    """
    counts = Observation()
    observed = rows.observe(counts, *[F.count_if(F.col("reason") == r).alias(r) for r in reasons])
    return observed.filter("reason is null").drop("reason"), counts


def class_contract(classes: DataFrame, expected: tuple[str, ...] = CLASSES) -> DataFrame:
    """class_id, class_name and ok of a table of classes; one that is missing, unknown or out of order stops the job and is named."""
    names = classes.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in expected])).alias("class_id", "_expected"))
    given = classes.select(F.col("class_id").cast("int").alias("class_id"), "class_name").distinct()
    both = names.join(given, "class_id", "full")
    shown = lambda c: F.coalesce(c, F.lit("none"))
    wrong = F.concat(F.lit("class "), F.col("class_id").cast("string"), F.lit(" is "), shown("class_name"), F.lit(", not "), shown("_expected"))
    ok = F.when(F.equal_null("class_name", "_expected"), True).otherwise(F.raise_error(wrong).cast("boolean"))
    return both.select("class_id", "class_name", ok.alias("ok"))


def first_of(files: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key (the last one with a descending order column)."""
    w = Window.partitionBy(key).orderBy(order)
    return files.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
