"""Copy-paste plans: which crop goes where on which background. Geometry only, labels are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import Box, iou, size_bucket
from boxwright.functions.names import composite_name
from boxwright.operators.matching import once
from boxwright.operators.merge import uniform
from boxwright.operators.sampling import ranked
from boxwright.session import checkpoint_dir

# fixed values
PASTE_WEIGHTS = {"bicycle": 3, "motorcycle": 3, "bus": 3, "person": 1}
PERSON_MAX_AREA = 96 * 96
MIN_SIDE = 12
MAX_SHARE = 0.35


def instance_bank(boxes: DataFrame) -> DataFrame:
    """Crops of pasteable classes with ``reason``: why a crop is rejected, null if it isn't.

    ``boxes``: image_id, gt_idx, class_name, corners, width and height of the image.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    reason = (
        F.when(F.least(w, h) < MIN_SIDE, "crop_too_small")
        .when((w > F.col("width") * F.lit(MAX_SHARE)) | (h > F.col("height") * F.lit(MAX_SHARE)), "crop_too_large")
        .when((F.col("class_name") == "person") & (w * h >= PERSON_MAX_AREA), "person_not_small")
    )
    return boxes.filter(F.col("class_name").isin(*PASTE_WEIGHTS)).withColumns({"crop_w": w, "crop_h": h, "size_bucket": size_bucket(w * h), "reason": reason})


def draw_pastes(backgrounds: DataFrame, bank: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """For ``n`` composites a background each (with replacement) and 1 to 3 pastes: crop and scaled size.

    Classes are drawn by weight among those with crops, crops uniformly within a
    class, scales in [0.8, 1.2] with sides of at least 12 px.
    """
    spark = backgrounds.sparkSession
    checkpoint_dir(spark)
    pool = ranked(backgrounds.select("image_id", "width", "height"), "image_id", None, seed)
    # ranking reads its rows several times, and the bank is a join
    good = bank.filter("reason is null").select(F.concat_ws("|", "image_id", "gt_idx").alias("crop_id"), "class_name", "crop_w", "crop_h").checkpoint()
    crops = ranked(good, "crop_id", "class_name", seed)
    sizes = {r["class_name"]: r["n"] for r in good.groupBy("class_name").agg(F.count("*").alias("n")).collect()}  # a row for each class
    total = backgrounds.count()
    weights = [(c, w) for c, w in PASTE_WEIGHTS.items() if sizes.get(c)]
    whole, at = sum(w for _, w in weights) or 1, 0.0
    u = uniform(seed, F.col("no"), F.col("paste"), F.lit("class"))
    chosen: Column = F.lit(weights[-1][0] if weights else None).cast("string")
    for c, w in reversed(weights[:-1]):
        at = sum(x for name, x in weights[: [k for k, _ in weights].index(c) + 1])
        chosen = F.when(u * whole < at, c).otherwise(chosen)
    many = F.floor(uniform(seed, F.col("no"), F.lit("count")) * 3).cast("int") + 1
    rows = (
        spark.range(n if total and weights else 0)
        .withColumnRenamed("id", "no")
        .withColumn("rank", (F.floor(uniform(seed, F.col("no"), F.lit("bg")) * total) + 1).cast("bigint"))
        .join(pool.drop("total"), "rank")
        .drop("rank")
        .withColumn("paste", F.explode(F.sequence(F.lit(1), many)))
        .withColumn("class_name", chosen)
    )
    n_of = F.element_at(F.create_map(*[F.lit(x) for c, _ in weights for x in (c, sizes[c])]), F.col("class_name")) if weights else F.lit(1)
    rows = rows.withColumn("rank", (F.floor(uniform(seed, F.col("no"), F.col("paste"), F.lit("crop")) * n_of) + 1).cast("bigint")).join(crops.drop("total"), ["class_name", "rank"]).drop("rank")
    scale = F.lit(0.8) + uniform(seed, F.col("no"), F.col("paste"), F.lit("scale")) * F.lit(0.4)
    side = lambda c: F.greatest(F.floor(F.col(c) * scale), F.lit(MIN_SIDE)).cast("double")
    return rows.withColumns({"w": side("crop_w"), "h": side("crop_h")}).drop("crop_w", "crop_h")


def place(pastes: DataFrame, boxes: DataFrame, tries: int = 10, margin: int = 2, most: float = 0.2, seed: int = 42) -> DataFrame:
    """One row for each paste: its box, or reason ``overlap``, or ``crop_invalid`` where it can't fit.

    A fold over one composite's pastes and tries: a position is taken if its IoU
    with every box of the background and every taken one is under ``most``.
    """
    room = lambda side, s: F.greatest(F.col(side) - F.col(s) - 2 * margin, F.lit(0))
    where = lambda axis, side, s: lambda t: margin + F.floor(uniform(seed, F.col("no"), F.col("paste"), t, F.lit(axis)) * (room(side, s) + 1))
    at_x, at_y = where("x", "width", "w"), where("y", "height", "h")
    spots = F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda t: F.struct(at_x(t).cast("double").alias("x"), at_y(t).cast("double").alias("y")))
    fits = (F.col("w") + 2 * margin <= F.col("width")) & (F.col("h") + 2 * margin <= F.col("height"))
    listed = pastes.withColumn("p", F.struct("paste", "class_name", "crop_id", "w", "h", F.when(fits, spots).otherwise(F.slice(spots, 1, 0)).alias("spots")))
    grouped = listed.groupBy("no", "image_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    there = boxes.groupBy("image_id").agg(F.collect_list(F.struct(*Box._fields)).alias("there"))
    empty = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    full = grouped.join(there, "image_id", "left").withColumn("there", F.coalesce("there", empty))
    as_box = lambda s: Box(s["x1"], s["y1"], s["x2"], s["y2"])

    def step(acc: Column, p: Column) -> Column:
        boxed = F.transform(p["spots"], lambda s: F.struct(s["x"].alias("x1"), s["y"].alias("y1"), (s["x"] + p["w"]).alias("x2"), (s["y"] + p["h"]).alias("y2")))
        first = F.get(F.filter(boxed, lambda b: ~F.exists(acc["taken"], lambda o: iou(as_box(o), as_box(b)) >= most)), F.lit(0))

        def put(free: Column) -> Column:
            row = F.struct(
                p["paste"].alias("paste"), p["class_name"].alias("class_name"), p["crop_id"].alias("crop_id"), free.alias("box"),
                F.when(free.isNotNull(), F.lit(None)).when(F.size(p["spots"]) == 0, "crop_invalid").otherwise("overlap").cast("string").alias("reason"),
            )
            return F.struct(F.when(free.isNull(), acc["taken"]).otherwise(F.concat(acc["taken"], F.array(free))).alias("taken"), F.concat(acc["rows"], F.array(row)).alias("rows"))

        return once(first, put)

    rows = "array<struct<paste:int,class_name:string,crop_id:string,box:struct<x1:double,y1:double,x2:double,y2:double>,reason:string>>"
    start = F.struct(F.col("there").alias("taken"), F.array().cast(rows).alias("rows"))
    out = full.select("no", "image_id", F.explode(F.aggregate("ps", start, step, lambda acc: acc["rows"])).alias("r"))
    return out.select("no", "image_id", "r.paste", "r.class_name", "r.crop_id", *[F.col(f"r.box.{c}").alias(c) for c in Box._fields], "r.reason")


def composites(placed: DataFrame, boxes: DataFrame, n: int) -> DataFrame:
    """C4: labels of the first ``n`` composites that have a paste: the background's boxes and the pasted ones.

    Draw 3n composites beforehand: those without a paste are the ones redrawn.
    What is placed is read twice, so it is checkpointed.
    """
    checkpoint_dir(placed.sparkSession)
    good = placed.filter("reason is null").checkpoint()
    first = good.select("no", "image_id").distinct().orderBy("no").limit(n)
    named = first.withColumn("new_image", composite_name(F.col("image_id").cast("string"), F.col("no")))
    base = named.join(boxes.select("image_id", "class_name", *Box._fields), "image_id").select("no", "new_image", "class_name", *Box._fields, F.lit(False).alias("pasted"))
    added = good.join(named.select("no", "new_image"), "no").select("no", "new_image", "class_name", *Box._fields, F.lit(True).alias("pasted"))
    return base.unionByName(added)


def paste_statistics(bank: DataFrame, placed: DataFrame, boxes: DataFrame, images: DataFrame) -> DataFrame:
    """(kind, name, n): the bank, rejects by reason, pastes by class, source of the crop and size, boxes before and after by class and size.

    Sizes before pasting are those of images that hold a box of a pasteable class only.
    """
    size = size_bucket((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    count = lambda df, kind, name: df.groupBy(F.lit(kind).alias("kind"), name.alias("name")).agg(F.count("*").alias("n"))
    good = placed.filter("reason is null")
    sources = good.withColumn("image_id", F.split("crop_id", "\\|")[0].cast("bigint")).join(images.select("image_id", "source"), "image_id")
    based = boxes.join(bank.select("image_id").distinct(), "image_id", "left_semi")
    name = F.col("class_name")
    parts = [
        count(bank.filter("reason is null"), "bank", name),
        count(bank.filter("reason is not null"), "skipped", F.col("reason")),
        count(placed.filter("reason is not null"), "skipped", F.col("reason")),
        count(good, "pasted_class", name),
        count(sources, "pasted_source", F.col("source")),
        count(good, "pasted_size", size),
        *[count(df, kind, name) for df, kind in ((boxes, "before_class"), (boxes, "after_class"), (good, "after_class"))],
        *[count(df, kind, size) for df, kind in ((based, "before_size"), (based, "after_size"), (good, "after_size"))],
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind", "name").agg(F.sum("n").alias("n"))
