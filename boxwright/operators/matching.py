"""Matching predictions to ground truth. Four matchers with different rules.

Tables: ``boxes(image_id, gt_idx, class_id, x1, y1, x2, y2)`` and
``predictions(image_id, pred_idx, class_id, conf, x1, y1, x2, y2)``.  Both
are grouped by image (and class) and joined; matching is a fold over one image's
arrays, so each side is shuffled once and the state is bounded by an image.  In a
crowded image boxes are first put into the cells of a grid, whose lines lie where
the boxes are, so that only pairs that share a cell are looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions.geometry import Box, iou

BACKGROUND = -1
CORNERS = ",".join(f"{c}:double" for c in Box._fields)
#: With more pairs of a prediction and a box than this an image is crowded, and how many boxes a cell of its grid has, about.
CROWDED = 10_000
IN_A_CELL = 16
PREDICTION = f"struct<o:double,pred_idx:bigint,cls:int,{CORNERS}>"
BOX = f"struct<gt_idx:bigint,cls:int,{CORNERS}>"


def pairs(predictions: DataFrame, boxes: DataFrame, same_class: bool = False, least: float = 0.0) -> DataFrame:
    """All prediction-box pairs of an image (and class) with their IoU, where it is over 0 and at least ``least``; other pairs are never formed."""
    both = F.flatten(F.zip_with("ps", choices(least, same_class), lambda p, cs: F.transform(cs, lambda c: F.struct(p.alias("p"), c["g"].alias("g"), (-c["o"]).alias("iou")))))
    rows = grouped(predictions, boxes).select("image_id", F.explode(both).alias("r")).select("image_id", "r.*")
    side = lambda of: [F.col(f"{of}.{c}").alias(f"{of}_{c}") for c in Box._fields]
    return rows.select("image_id", "p.pred_idx", (-F.col("p.o")).alias("conf"), F.col("p.cls").alias("pred_class"), *side("p"), "g.gt_idx", F.col("g.cls").alias("gt_class"), *side("g"), "iou")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def box_of(s: Column) -> Box:
    return Box(*[s[c] for c in Box._fields])


def grouped(predictions: DataFrame, boxes: DataFrame, keys: tuple[str, ...] = ("image_id",), how: str = "inner", extra: tuple[str, ...] = ()) -> DataFrame:
    """A row for each image (and class): ``ps``, its predictions by falling confidence, then ``pred_idx``, and ``gs``, its boxes.

    Each side is shuffled once, by the keys; a group holds one image's rows.
    """
    corners = [F.col(c).cast("double").alias(c) for c in Box._fields]
    p = F.struct((-F.col("conf")).cast("double").alias("o"), F.col("pred_idx").cast("bigint").alias("pred_idx"), F.col("class_id").cast("int").alias("cls"), *corners)
    g = F.struct(F.col("gt_idx").cast("bigint").alias("gt_idx"), F.col("class_id").cast("int").alias("cls"), *corners)
    ps = predictions.groupBy(*keys, *extra).agg(F.sort_array(F.collect_list(p)).alias("ps"))
    gs = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(g)).alias("gs"))
    out = ps.join(gs, list(keys), how)
    return out.withColumns({"ps": F.coalesce("ps", F.array().cast(f"array<{PREDICTION}>")), "gs": F.coalesce("gs", F.array().cast(f"array<{BOX}>"))})


def _meet(a: Column, b: Column) -> Column:
    return (F.least(a["x2"], b["x2"]) > F.greatest(a["x1"], b["x1"])) & (F.least(a["y2"], b["y2"]) > F.greatest(a["y1"], b["y1"]))


def _in_grid(left: Column, right: Column) -> Column:
    """Like ``overlapping``, by a grid over ``right``.

    Its lines are quantiles of the boxes' left and upper edges.  A pair is found
    in one cell only, that of the left upper corner of what the two share.
    """
    n = F.size(right)
    lines = F.greatest(F.floor(F.sqrt(n / IN_A_CELL)).cast("int"), F.lit(1))  # as many columns as rows
    upto = lambda k: F.sequence(F.lit(0), k - 1)

    def cuts(edge: str) -> Column:
        at = lambda edges: F.transform(F.slice(upto(lines), 2, lines), lambda k: F.get(edges, F.floor(k * n / lines).cast("int")))
        return once(F.sort_array(F.transform(right, lambda g: g[edge])), at)

    def placed(boxes: Column, xs: Column, ys: Column) -> Column:
        line = lambda value, of: F.size(F.filter(of, lambda c: c <= value))
        return F.transform(boxes, lambda g: F.struct(g.alias("g"), line(g["x1"], xs).alias("l"), line(g["x2"], xs).alias("r"), line(g["y1"], ys).alias("t"), line(g["y2"], ys).alias("b")))

    def cells(boxes: Column) -> Column:
        column = lambda i: F.filter(boxes, lambda g: (g["l"] <= i) & (g["r"] >= i))
        rows = lambda some: F.transform(upto(lines), lambda j: F.filter(some, lambda g: (g["t"] <= j) & (g["b"] >= j)))
        return F.transform(upto(lines), lambda i: once(column(i), rows))

    def found(p: Column, grid: Column) -> Column:
        here = lambda i, j: F.filter(F.get(F.get(grid, i), j), lambda g: (F.greatest(g["l"], p["l"]) == i) & (F.greatest(g["t"], p["t"]) == j) & _meet(g["g"], p["g"]))
        row = lambda i: F.flatten(F.transform(F.sequence(p["t"], p["b"]), lambda j: here(i, j)))
        return F.transform(F.flatten(F.transform(F.sequence(p["l"], p["r"]), row)), lambda g: g["g"])

    def all_found(lines_: Column) -> Column:
        grid = lambda c: once(cells(placed(right, lines_["xs"], lines_["ys"])), c)
        return grid(lambda g: F.transform(placed(left, lines_["xs"], lines_["ys"]), lambda p: found(p, g)))

    return once(F.struct(cuts("x1").alias("xs"), cuts("y1").alias("ys")), all_found)


def overlapping(left: Column, right: Column) -> Column:
    """For each box of ``left`` those of ``right`` that share some area with it (arrays of structs with corners)."""
    each = F.transform(left, lambda p: F.filter(right, lambda g: _meet(g, p)))
    return F.when(F.size(left).cast("bigint") * F.size(right) > CROWDED, _in_grid(left, right)).otherwise(each)


def choices(least: float = 0.0, same_class: bool = False) -> Column:
    """For each of ``ps``, its boxes of ``gs`` with an IoU over 0 and at least ``least``: o (-IoU) and box, best first, then by ``gt_idx``."""

    def of(p: Column, near: Column) -> Column:
        rivals = F.filter(near, lambda g: g["cls"] == p["cls"]) if same_class else near
        scored = F.transform(rivals, lambda g: F.struct((-iou(box_of(g), box_of(p))).alias("o"), g["gt_idx"].alias("gt_idx"), g.alias("g")))
        return F.sort_array(F.filter(scored, lambda c: (c["o"] < 0) & (-c["o"] >= least)))

    return F.zip_with("ps", overlapping(F.col("ps"), F.col("gs")), of)


def owners(wanted: Column) -> Column:
    """The box that each prediction gets, in order: the first of those it wants that is free, null where none is."""

    def step(taken: Column, gts: Column) -> Column:
        return F.concat(taken, F.array(F.get(F.filter(gts, lambda g: ~F.coalesce(F.array_contains(taken, g), F.lit(False))), F.lit(0))))

    return F.aggregate(wanted, F.array().cast("array<bigint>"), step)


def _ids(chosen: Column) -> Column:
    return F.transform(chosen, lambda cs: F.transform(cs, lambda c: c["gt_idx"]))


def greedy(predictions: DataFrame, boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """M1: (image_id, pred_idx, gt_idx). By falling confidence, each takes the free box of its class with the highest IoU.

    Ties: input order of predictions (``pred_idx``), lowest ``gt_idx``.  Classes
    don't compete, so the groups are those of (image, class).
    """
    matched = once(owners(_ids(choices(least))), lambda own: F.transform("ps", lambda p, i: F.struct(p["pred_idx"].alias("pred_idx"), F.get(own, i).alias("gt_idx"))))
    rows = grouped(predictions, boxes, ("image_id", "class_id")).select("image_id", F.explode(matched).alias("m"))
    return rows.select("image_id", "m.pred_idx", "m.gt_idx").filter("gt_idx is not null")


def best_box(candidates: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Each prediction's pair with the highest IoU, then the lowest box."""
    w = Window.partitionBy(*keys, "pred_idx").orderBy(F.desc("iou"), "gt_idx")
    return candidates.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def best_owners(least: float) -> Column:
    """Like ``owners``, but a prediction wants its best box only, and that if its IoU is at least ``least``."""
    return owners(F.transform(choices(least), lambda cs: F.transform(F.slice(cs, 1, 1), lambda c: c["gt_idx"])))


def argmax(predictions: DataFrame, boxes: DataFrame, least: float = 0.5, by_class: bool = False) -> DataFrame:
    """M3 (class-blind) and M4 (``by_class``): image_id, pred_idx, gt_idx of pairs in which a prediction owns its best box.

    A prediction looks only at its best box, over all classes or its own; of
    those with the same box the most confident one owns it.  No second choice.
    """
    keys = ("image_id", "class_id") if by_class else ("image_id",)
    matched = once(best_owners(least), lambda own: F.transform("ps", lambda p, i: F.struct(p["pred_idx"].alias("pred_idx"), F.get(own, i).alias("gt_idx"))))
    rows = grouped(predictions, boxes, keys).select("image_id", F.explode(matched).alias("m"))
    return rows.select("image_id", "m.pred_idx", "m.gt_idx").filter("gt_idx is not null")


def confusion(predictions: DataFrame, boxes: DataFrame, conf: float = 0.25, least: float = 0.5) -> DataFrame:
    """A16 over M3: true_class, pred_class, n. ``BACKGROUND`` stands for none."""
    cell = lambda true, pred: F.struct(true.alias("true_class"), pred.alias("pred_class"))
    none = F.lit(BACKGROUND)

    def cells(own: Column) -> Column:
        true = lambda i: F.coalesce(F.get(F.filter("gs", lambda g: g["gt_idx"] == F.get(own, i)), F.lit(0))["cls"], none)
        missed = F.filter("gs", lambda g: ~F.coalesce(F.array_contains(own, g["gt_idx"]), F.lit(False)))
        return F.concat(F.transform("ps", lambda p, i: cell(true(i), p["cls"])), F.transform(missed, lambda g: cell(g["cls"], none)))

    images = grouped(predictions.filter(F.col("conf") >= conf), boxes, how="full")
    return images.select(F.explode(once(best_owners(least), cells)).alias("c")).select("c.*").groupBy("true_class", "pred_class").agg(F.count("*").alias("n"))


def suppress(predictions: DataFrame, most: float = 0.7) -> DataFrame:
    """Predictions left by non-maximum suppression in each (image, class).

    By falling confidence, a box is kept if its IoU with every kept one is at most ``most``.
    """
    box = F.struct((-F.col("conf")).alias("o"), "pred_idx", *Box._fields)
    ranked = predictions.groupBy("image_id", "class_id").agg(F.sort_array(F.collect_list(box)).alias("ps"))
    numbered = F.transform("ps", lambda p, i: F.struct(i.alias("i"), *[p[c].alias(c) for c in Box._fields]))

    def kept(own: Column) -> Column:
        # a box goes if a kept one before it overlaps it too much
        rivals = F.zip_with(own, overlapping(own, own), lambda p, near: F.transform(F.filter(near, lambda q: (q["i"] < p["i"]) & (iou(box_of(q), box_of(p)) > most)), lambda q: q["i"]))
        stays = F.aggregate(rivals, F.array().cast("array<boolean>"), lambda acc, js: F.concat(acc, F.array(~F.exists(js, lambda j: F.get(acc, j)))))
        return once(stays, lambda flags: F.filter("ps", lambda p, i: F.get(flags, i)))

    return ranked.select("image_id", "class_id", F.inline(once(numbered, kept))).select("image_id", "class_id", "pred_idx", (-F.col("o")).alias("conf"), *Box._fields)
