"""What became of every prediction and every box, and reports over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import area, size_bucket, to_text
from boxwright.functions.vocab import RARE_CLASSES, class_name
from boxwright.operators.matching import PREDICTION, box_of, choices, grouped, once, owners
from boxwright.session import checkpoint_dir

ERROR_TYPES = ("true_positive", "loose_box", "poor_localization", "wrong_class", "false_positive", "missed_object")


def error_table(predictions: DataFrame, boxes: DataFrame, least: float = 0.5, tight: float = 0.75, low: float = 0.1) -> DataFrame:
    """One row for each prediction, and one for each box that no prediction matched.

    image_id, pred_idx, gt_idx, class_id, class_name, error_type, gt_box,
    pred_box, iou, conf, box_area, size_bucket, note.  Areas are the box's for
    matches and missed objects, else the prediction's.

    An image's predictions and boxes meet in one group: what is matched, what
    the others overlap best (in any class) and what is missed come from one fold.
    """
    row = lambda p, g, value, matched: F.struct(p.alias("p"), g.alias("g"), value.alias("iou"), matched.alias("matched"))

    def rows(found: Column) -> Column:
        mine = lambda p, cs: F.transform(F.filter(cs, lambda c: (c["g"]["cls"] == p["cls"]) & (-c["o"] >= least)), lambda c: c["gt_idx"])

        def placed(own: Column) -> Column:
            def of(p: Column, i: Column) -> Column:
                taken = F.get(own, i)
                best = F.get(F.filter(F.get(found, i), lambda c: taken.isNull() | (c["gt_idx"] == taken)), F.lit(0))
                return once(best, lambda c: row(p, c["g"], -c["o"], taken.isNotNull()))

            missed = F.filter("gs", lambda g: ~F.coalesce(F.array_contains(own, g["gt_idx"]), F.lit(False)))
            lost = F.transform(missed, lambda g: row(F.lit(None).cast(PREDICTION), g, F.lit(None).cast("double"), F.lit(False)))
            return F.concat(F.transform("ps", of), lost)

        return once(owners(F.zip_with("ps", found, mine)), placed)

    all_rows = grouped(predictions, boxes, how="full").select("image_id", F.explode(once(choices(), rows)).alias("r")).select("image_id", "r.*")
    p, g, value = F.col("p"), F.col("g"), F.col("iou")
    is_lost, wrong, poor = p.isNull(), (value >= least) & (g["cls"] != p["cls"]), (value >= low) & (value < least) & (g["cls"] == p["cls"])
    kind = (
        F.when(is_lost, "missed_object").when(F.col("matched") & (value >= tight), "true_positive").when(F.col("matched"), "loose_box")
        .when(wrong, "wrong_class").when(poor, "poor_localization").otherwise("false_positive")
    )
    by_box = is_lost | F.col("matched")
    cls, of = F.when(by_box, g["cls"]).otherwise(p["cls"]), F.when(by_box, area(box_of(g))).otherwise(area(box_of(p)))
    return all_rows.select(
        "image_id",
        p["pred_idx"].alias("pred_idx"),
        g["gt_idx"].alias("gt_idx"),
        cls.alias("class_id"),
        class_name(cls).alias("class_name"),
        kind.alias("error_type"),
        to_text(box_of(g)).alias("gt_box"),
        F.when(is_lost, "").otherwise(to_text(box_of(p))).alias("pred_box"),
        F.when(is_lost, value).otherwise(F.coalesce(value, F.lit(0.0))).alias("iou"),
        (-p["o"]).alias("conf"),
        F.floor(of).cast("bigint").alias("box_area"),
        size_bucket(of).alias("size_bucket"),
        F.when(~by_box & wrong, F.concat(F.lit("gt_class="), class_name(g["cls"]))).otherwise("").alias("note"),
    )


def tally(errors: DataFrame) -> DataFrame:
    """Counts (``n``) of errors by class, size and kind, at most a few rows for each class.

    Checkpointed: ``by_class``, ``by_size`` and ``summary`` take it as they take the errors, which are then made once for all three.
    """
    checkpoint_dir(errors.sparkSession)
    return errors.groupBy("class_id", "class_name", "size_bucket", "error_type").agg(F.count("*").alias("n")).checkpoint()


def _counts(errors: DataFrame) -> dict[str, Column]:
    """The number of errors of each kind, from a table of errors or its ``tally``."""
    if "n" not in errors.columns:
        return {t: F.count_if(F.col("error_type") == t) for t in ERROR_TYPES}
    return {t: F.coalesce(F.sum(F.when(F.col("error_type") == t, F.col("n"))), F.lit(0)) for t in ERROR_TYPES}


def by_class(errors: DataFrame) -> DataFrame:
    """A row for each class with its counts of each kind, number of boxes and recall."""
    count = _counts(errors)
    n_gt = count["true_positive"] + count["loose_box"] + count["missed_object"]
    out = errors.groupBy("class_id", "class_name").agg(*[c.alias(t) for t, c in count.items()], n_gt.alias("n_gt"))
    found = F.col("true_positive") + F.col("loose_box")
    return out.withColumn("recall", F.round(F.coalesce(found / F.nullif(F.col("n_gt"), F.lit(0)), F.lit(0.0)), 4))


def by_size(errors: DataFrame) -> DataFrame:
    """Boxes, found ones and recall for each size of box."""
    gt = errors.filter(F.col("error_type").isin("true_positive", "loose_box", "missed_object"))
    count = _counts(gt)
    found = count["true_positive"] + count["loose_box"]
    return gt.groupBy("size_bucket").agg((found + count["missed_object"]).alias("n_gt"), found.alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_gt"), 4))


def summary(errors: DataFrame) -> DataFrame:
    """Counts, recall and the share of loose boxes among matches, in one row."""
    out = errors.agg(*[c.alias(t) for t, c in _counts(errors).items()])
    found = F.col("true_positive") + F.col("loose_box")
    safe = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)
    return out.withColumns({"recall": safe(found, found + F.col("missed_object")), "loose_ratio": safe(F.col("loose_box"), found)})


def by_image(errors: DataFrame) -> DataFrame:
    """Errors of each image (loose boxes too), and whether one concerns a rare class."""
    rare = F.col("class_name").isin(*RARE_CLASSES) & F.col("error_type").isin("missed_object", "wrong_class", "poor_localization")
    return errors.groupBy("image_id").agg(F.count_if(F.col("error_type") != "true_positive").alias("n_errors"), F.bool_or(rare).alias("rare_error"))


def worst_images(images: DataFrame, k: int = 20) -> DataFrame:
    """E5: the k images with errors, rare ones first, then most errors, then the smallest id."""
    return images.filter("n_errors > 0").orderBy(F.desc("rare_error"), F.desc("n_errors"), "image_id").limit(k)
