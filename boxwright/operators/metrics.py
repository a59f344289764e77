"""Precision, recall, average precision and mean average precision over match results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions.vocab import CLASSES
from boxwright.operators.matching import best_owners, choices, greedy, grouped, once, owners
from boxwright.operators.scan import flag_blocks, ordered, running_sums, unpacked
from boxwright.session import checkpoint_dir

THRESHOLDS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
HITS = tuple(f"h{k}" for k in range(len(THRESHOLDS)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def precision_recall(predictions: DataFrame, boxes: DataFrame, conf: float = 0.25, least: float = 0.5) -> DataFrame:
    """One row tp, fp, fn, precision, recall at one operating point."""
    kept = predictions.filter(F.col("conf") >= conf)
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    rows = one(greedy(kept, boxes, least), "tp").union(one(kept, "n_pred")).union(one(boxes, "n_gt"))
    counts = rows.agg(*[F.sum(F.when(F.col("what") == c, F.col("n"))).alias(c) for c in ("tp", "n_pred", "n_gt")])
    return counts.select(
        "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"),
        ratio(F.col("tp").cast("double"), F.col("n_pred")).alias("precision"), ratio(F.col("tp").cast("double"), F.col("n_gt")).alias("recall"),
    )


def flagged(predictions: DataFrame, boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """M4: every prediction of a class that has boxes, with tp 0/1 and the class' number of boxes.

    Checkpointed: curves read it several times, and it is far smaller than the matching.
    """
    checkpoint_dir(predictions.sparkSession)
    totals = boxes.groupBy("class_id").agg(F.count("*").alias("n_gt"))
    row = lambda own: F.transform("ps", lambda p, i: F.struct(p["pred_idx"].alias("pred_idx"), (-p["o"]).alias("conf"), F.get(own, i).isNotNull().cast("int").alias("tp")))
    rows = grouped(predictions, boxes, ("image_id", "class_id"), "left").select("image_id", "class_id", F.explode(once(best_owners(least), row)).alias("r"))
    # a row for each class
    return rows.select("image_id", "r.pred_idx", "class_id", "r.conf", "r.tp").join(F.broadcast(totals), "class_id").select("image_id", "pred_idx", "class_id", "conf", "n_gt", "tp").checkpoint()


def _in_order(flags: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Predictions of each class by (conf desc, image, prediction), over all tasks."""
    return ordered(flags, by, (F.desc("conf"), F.asc("image_id"), F.asc("pred_idx")))


def _running(placed: DataFrame, by: tuple[str, ...], hits: tuple[str, ...]) -> DataFrame:
    """Running counts of predictions (``cum_n``) and of each kind of hit (``cum_...``) of a class."""
    return running_sums(placed, by, {**{f"cum_{h}": F.col(h) for h in hits}, "cum_n": F.lit(1)})


def _curve(placed: DataFrame) -> DataFrame:
    out = _running(placed, ("class_id",), ("tp",))
    return out.withColumns({"recall": F.col("cum_tp") / (F.col("n_gt") + 1e-9), "precision": F.col("cum_tp") / (F.col("cum_n") + 1e-9)})


def curve(flags: DataFrame) -> DataFrame:
    """M6: recall and precision after each prediction."""
    return _curve(_in_order(flags, ("class_id",))).drop("_p")


def _precisions(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """For each of a batch's blocks that has hits, its row and the precision at each hit."""
    columns = [batch.column(c).to_pylist() for c in ("bits", "n", "n_before", "hits_before")]
    for row, (bits, n, n_before, hits_before) in enumerate(zip(*columns, strict=True)):
        at = np.flatnonzero(unpacked(bits, n))
        if len(at):
            yield row, np.arange(hits_before + 1, hits_before + len(at) + 1) / (at + (n_before + 1 + 1e-9))


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best precision of each block, null without hits."""
    for batch in batches:
        best: list[float | None] = [None] * batch.num_rows
        for row, precision in _precisions(batch):
            best[row] = float(precision.max())
        yield pa.RecordBatch.from_arrays([batch.column("_p"), batch.column("_k"), batch.column("class_id"), pa.array(best, pa.float64())], names=["_p", "_k", "class_id", "best"])


def _areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of its class' area that each block adds; ``later`` is the best precision after it."""
    for batch in batches:
        area, n_gt, later = [0.0] * batch.num_rows, batch.column("n_gt").to_pylist(), batch.column("later").to_pylist()
        for row, precision in _precisions(batch):
            envelope = np.maximum(np.maximum.accumulate(precision[::-1]), later[row])
            area[row] = float(envelope.sum() / (n_gt[row] + 1e-9))
        yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array(area, pa.float64())], names=["class_id", "area"])


def average_precision(flags: DataFrame) -> DataFrame:
    """M5: all-point interpolation, per class.

    Recall only moves at true positives, by the same step at each, and the
    envelope there is the best precision at this or a later one.  Once in order,
    predictions are a bit each, so both scans run over blocks of bits.
    """
    blocks = flag_blocks(flags, "class_id", (F.desc("conf"), F.asc("image_id"), F.asc("pred_idx")), "tp", "n_gt")
    kind = flags.schema["class_id"].dataType.simpleString()
    best = blocks.mapInArrow(_best, f"_p int, _k bigint, class_id {kind}, best double")
    after = Window.partitionBy("class_id").orderBy(F.desc("_p"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)
    later = best.select("_p", "_k", F.coalesce(F.max("best").over(after), F.lit(0.0)).alias("later"))
    areas = blocks.join(F.broadcast(later), ["_p", "_k"]).mapInArrow(_areas, f"class_id {kind}, area double")
    return areas.groupBy("class_id").agg(F.sum("area").alias("ap"))


def coco_flags(predictions: DataFrame, boxes: DataFrame, images: DataFrame | None = None, by: str | None = None, most: int = 100) -> DataFrame:
    """Every prediction with a hit (0/1) for each threshold, from one fold over its image and class.

    grp (``by``, a column of ``images``, or "all"), class_id, image_id, pred_idx,
    conf, h0.. (a hit at each of THRESHOLDS), in_top (among the ``most`` first of
    its image and class) and n_gt (boxes of its group and class, null for none).
    A prediction's hit doesn't depend on those after it, so the hits hold for the
    first ``most`` and for all.  Checkpointed.
    """
    checkpoint_dir(predictions.sparkSession)
    predictions, boxes = _grouped_by(predictions, images, by), _grouped_by(boxes, images, by)
    totals = boxes.groupBy("grp", "class_id").agg(F.count("*").alias("n_gt"))
    per_image = grouped(predictions, boxes, ("image_id", "class_id"), "left", ("grp",))

    def rows(found: Column) -> Column:
        at = lambda t: owners(F.transform(found, lambda cs: F.transform(F.filter(cs, lambda c: -c["o"] >= t), lambda c: c["gt_idx"])))
        row = lambda own: F.transform(
            "ps", lambda p, i: F.struct(p["pred_idx"].alias("pred_idx"), (-p["o"]).alias("conf"), (i < most).alias("in_top"), *[F.get(own[k], i).isNotNull().cast("int").alias(h) for k, h in enumerate(HITS)])
        )
        # where no two predictions have one best box, each owns its own at whatever threshold it reaches
        best = F.filter(F.transform(found, lambda cs: F.get(cs, F.lit(0))["gt_idx"]), lambda g: g.isNotNull())
        hit = lambda o, t: F.coalesce(-o >= t, F.lit(False)).cast("int")
        alone = lambda p, i: once(
            F.get(F.get(found, i), F.lit(0))["o"], lambda o: F.struct(p["pred_idx"].alias("pred_idx"), (-p["o"]).alias("conf"), (i < most).alias("in_top"), *[hit(o, t).alias(h) for h, t in zip(HITS, THRESHOLDS, strict=True)])
        )
        apart = once(best, lambda b: F.size(b) == F.size(F.array_distinct(b)))
        return F.when(apart, F.transform("ps", alone)).otherwise(once(F.array(*[at(t) for t in THRESHOLDS]), row))

    flags = per_image.select("grp", "class_id", "image_id", F.explode(once(choices(THRESHOLDS[0]), rows)).alias("r")).select("grp", "class_id", "image_id", "r.*")
    return flags.join(F.broadcast(totals), ["grp", "class_id"], "left").checkpoint()  # a row for each group and class


def _grouped_by(rows: DataFrame, images: DataFrame | None, by: str | None) -> DataFrame:
    if by is None:
        return rows.withColumn("grp", F.lit("all"))
    return rows.join(images.select("image_id", F.col(by).alias("grp")), "image_id")


def coco(predictions: DataFrame, boxes: DataFrame, images: DataFrame | None = None, by: str | None = None, most: int = 100) -> DataFrame:
    """M7: group, class_id, threshold, ap, ar by the public COCO protocol; M9 with ``by``, a column of ``images``.

    A prediction stays one row, with a hit for each threshold, and its running
    counts are taken in one sort.  101 recall points; recall as exact integers.
    """
    return _coco(coco_flags(predictions, boxes, images, by, most), _grouped_by(boxes, images, by))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch, class, threshold and hundredth of recall: the best precision at its hits, and the most hits so far."""
    for batch in batches:
        if not batch.num_rows:
            continue
        number = lambda c: pc.fill_null(batch.column(c).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        grp, cls = number("grp"), number("class_id")
        cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (cls[1:] != cls[:-1])) + 1
        run = np.zeros(batch.num_rows, dtype=np.int64)
        run[cuts] = 1
        run = np.cumsum(run)
        cum_n, n_gt = batch.column("cum_n").to_numpy(), batch.column("n_gt").to_numpy()
        at, ts, ks, ps, tps = [], [], [], [], []
        for t, h in zip(THRESHOLDS, HITS, strict=True):
            on = np.flatnonzero(batch.column(h).to_numpy() == 1)
            if not len(on):
                continue
            hits = batch.column(f"cum_{h}").to_numpy()[on]
            k = np.floor(100 * hits / n_gt[on]).astype(np.int32)
            first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (run[on][1:] != run[on][:-1])))  # both rise
            at.append(on[first])
            ts.append(np.full(len(first), t))
            ks.append(k[first])
            ps.append(np.maximum.reduceat(hits / cum_n[on], first))
            tps.append(np.maximum.reduceat(hits, first))
        if at:
            of = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([batch.column("grp").take(of), batch.column("class_id").take(of), *[pa.array(np.concatenate(x)) for x in (ts, ks, ps, tps)]], names=["grp", "class_id", "t", "k", "precision", "cum_tp"])


def _coco(flags: DataFrame, boxes: DataFrame) -> DataFrame:
    totals = boxes.groupBy("grp", "class_id").agg(F.count("*").alias("n_gt"))
    flags = flags.filter("in_top and n_gt is not null").drop("in_top")
    by_class = ("grp", "class_id")
    points = _running(_in_order(flags, by_class), by_class, HITS).select("grp", "class_id", "n_gt", "cum_n", *HITS, *[f"cum_{h}" for h in HITS])
    kinds = flags.schema
    steps = points.mapInArrow(_steps, f"grp {kinds['grp'].dataType.simpleString()}, class_id {kinds['class_id'].dataType.simpleString()}, t double, k int, precision double, cum_tp bigint")
    best = steps.groupBy("grp", "class_id", "t", "k").agg(F.max("precision").alias("p"), F.max("cum_tp").alias("tps"))
    # the best precision at recall k or beyond, for k = 0..100, from at most 101 values
    grids = best.groupBy("grp", "class_id", "t").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("o"), "p"))).alias("ks"), F.max("tps").alias("tps"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: F.coalesce(F.array_max(F.transform(F.filter("ks", lambda x: -x["o"] >= k), lambda x: x["p"])), F.lit(0.0)))
    ap = grids.select("grp", "class_id", "t", (F.aggregate(grid, F.lit(0.0), lambda a, x: a + x) / 101).alias("ap"), "tps")
    every = totals.withColumn("t", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    return (
        every.join(ap, ["grp", "class_id", "t"], "left")
        .select("grp", "class_id", F.col("t").alias("threshold"), F.coalesce("ap", F.lit(0.0)).alias("ap"), (F.coalesce("tps", F.lit(0)) / F.col("n_gt")).alias("ar"))
    )


def coco_summary(table: DataFrame) -> DataFrame:
    """map50, map50_95 and mar_100 of each group."""
    return table.groupBy("grp").agg(F.avg(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"), F.avg("ar").alias("mar_100"))


def table_by_group(predictions: DataFrame, boxes: DataFrame, images: DataFrame, by: str, conf: float = 0.25) -> DataFrame:
    """M9: grp, images, precision, recall (at ``conf`` and an IoU of 0.5), map50, map50_95, mar_100 of each group of images.

    Both kinds of metric come from one matching.  A group whose images have no
    boxes, or no predictions, has zeros.
    """
    flags = coco_flags(predictions, boxes, images, by)
    tagged = _grouped_by(boxes, images, by)
    sure = F.col("conf") >= conf
    hits = flags.groupBy("grp").agg(F.count_if(sure & (F.col(HITS[0]) == 1)).alias("tp"), F.count_if(sure).alias("n_pred"))
    n_gt = tagged.groupBy("grp").agg(F.count("*").alias("n_gt"))
    every = images.groupBy(F.col(by).alias("grp")).agg(F.count("*").alias("images"))
    joined = every.join(hits, "grp", "left").join(n_gt, "grp", "left").join(coco_summary(_coco(flags, tagged)), "grp", "left")
    tp = F.coalesce(F.col("tp"), F.lit(0)).cast("double")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("map50", "map50_95", "mar_100")]
    return joined.select("grp", "images", ratio(tp, F.col("n_pred")).alias("precision"), ratio(tp, F.col("n_gt")).alias("recall"), *zero)


def by_class_name(table: DataFrame, column: str = "ap") -> DataFrame:
    """M8: a row for each class name, null for classes without a value."""
    names = table.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in CLASSES])).alias("class_id", "class_name"))
    return names.join(table.select(F.col("class_id").cast("int").alias("class_id"), column), "class_id", "left").select("class_name", column)
