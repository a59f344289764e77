"""Operators against sequential loops and on edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.functions import names as N
from boxwright.functions import vocab as V
from boxwright.operators import copypaste, matching, prepare, runs, sampling
from boxwright.sources import readers, sinks

BOX = "image_id bigint, gt_idx bigint, class_id int, x1 double, y1 double, x2 double, y2 double"
PRED = "image_id bigint, pred_idx bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)


@pytest.fixture(scope="module")
def scene(spark):
    rng = random.Random(7)
    gts, preds = [], []
    for image in range(40):
        for k in range(rng.randint(0, 6)):
            x, y, w, h = rng.randint(0, 60), rng.randint(0, 60), rng.randint(10, 40), rng.randint(10, 40)
            gts.append((image, k, rng.randint(0, 2), float(x), float(y), float(x + w), float(y + h)))
        for k in range(rng.randint(0, 9)):
            near = [g for g in gts if g[0] == image]
            x, y, w, h = rng.randint(0, 60), rng.randint(0, 60), rng.randint(10, 40), rng.randint(10, 40)
            if near and rng.random() < 0.8:
                g = rng.choice(near)
                x, y, w, h = g[3] + rng.randint(-4, 4), g[4] + rng.randint(-4, 4), g[5] - g[3], g[6] - g[4]
            preds.append((image, k, rng.randint(0, 2), rng.choice([0.3, 0.5, 0.5, 0.9]), float(x), float(y), float(x + w), float(y + h)))
    return gts, preds, spark.createDataFrame(gts, BOX), spark.createDataFrame(preds, PRED)


def test_greedy_equals_loop(scene):
    gts, preds, boxes, predictions = scene
    want, used = set(), set()
    for p in sorted(preds, key=lambda p: (p[0], -p[3], p[1])):
        free = [(-iou(p[4:], g[3:]), g[1]) for g in gts if g[0] == p[0] and g[2] == p[2] and (g[0], g[1]) not in used and iou(p[4:], g[3:]) >= 0.5]
        if free:
            used.add((p[0], min(free)[1]))
            want.add((p[0], p[1], min(free)[1]))
    assert {tuple(r) for r in matching.greedy(predictions, boxes).collect()} == want
    assert {tuple(r) for r in matching.greedy(predictions.repartition(7), boxes.repartition(3)).collect()} == want


def test_argmax_equals_loop(scene):
    gts, preds, boxes, predictions = scene
    want, used = set(), set()
    for p in sorted(preds, key=lambda p: (p[0], -p[3], p[1])):
        near = [(-iou(p[4:], g[3:]), g[1]) for g in gts if g[0] == p[0]]
        if near and -min(near)[0] >= 0.5 and (p[0], min(near)[1]) not in used:
            used.add((p[0], min(near)[1]))
            want.add((p[0], p[1], min(near)[1]))
    assert {tuple(r) for r in matching.argmax(predictions, boxes).select("image_id", "pred_idx", "gt_idx").collect()} == want


def test_suppression_equals_loop(scene):
    _, preds, _, predictions = scene
    want = set()
    for key in {(p[0], p[2]) for p in preds}:
        kept = []
        for p in sorted((p for p in preds if (p[0], p[2]) == key), key=lambda p: (-p[3], p[1])):
            if all(iou(p[4:], k[4:]) <= 0.4 for k in kept):
                kept.append(p)
        want |= {(p[0], p[1]) for p in kept}
    assert {tuple(r) for r in matching.suppress(predictions, 0.4).select("image_id", "pred_idx").collect()} == want


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_vocabularies(spark):
    assert one(spark, V.normalize_class(F.col("c")), c=" Other Person ") == "person"
    assert one(spark, V.normalize_class(F.col("c"), V.DRIVING_ALIASES), c="other person") is None
    assert one(spark, V.normalize_class(F.col("c")), c="") is None
    assert one(spark, V.normalize_weather(F.col("c")), c="Partly_Cloudy") == "clear"
    assert one(spark, V.normalize_weather(F.col("c").cast("string")), c=None) == "unknown"
    assert one(spark, V.segment_class(F.col("c")), c=26003) == "car"
    assert one(spark, N.label_path(F.col("c")), c="/a/images/b/images/x.y.jpg") == "/a/images/b/labels/x.y.txt"


def test_boxes_outside_and_null(spark):
    rows = spark.createDataFrame([(-50.0, 0.0, -10.0, 20.0), (-5.0, 0.0, 10.0, 20.0), (None, 0.0, 5.0, 5.0), (9.0, 9.0, 9.0, 12.0)], "x1 double, y1 double, x2 double, y2 double")
    box, ok = G.clamp(G.Box.of(), F.lit(100), F.lit(100))
    assert [r[0] for r in rows.select(F.coalesce(ok, F.lit(False))).collect()] == [False, True, False, False]


def test_label_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 .5 .5 .1 .1\n1 .5 .5 .1\n2 .5 .5 .1 .1 .9\nx y z u v\n\n")
    assert readers.read_labels(spark, str(tmp_path)).count() == 1
    assert readers.read_labels(spark, str(tmp_path), exactly=False).count() == 2


def test_voc_without_objects(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<annotation><filename>a</filename></annotation>")
    (tmp_path / "b.xml").write_text("<annotation><object><name> Car </name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax></bndbox></object><object><name>bus</name></object></annotation>")
    rows = {tuple(r) for r in readers.read_voc(spark, str(tmp_path)).collect()}
    assert rows == {("a", None, None, None, None, None), ("b", "car", 1.0, 2.0, 3.0, 0.0)}


def test_manifest_and_guard(spark, tmp_path):
    rows = spark.createDataFrame([("train", "fog", "a.jpg")], "split string, weather string, output_image string")
    sinks.write_manifest(rows, str(tmp_path / "m"))
    assert readers.read_manifest(spark, str(tmp_path / "m")).columns == ["split", "weather", "image"]
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_manifest(rows, str(tmp_path / "m"))
    sinks.write_manifest(rows.drop("weather"), str(tmp_path / "m"), clean=True)
    with pytest.raises(ValueError, match="weather"):
        readers.read_manifest(spark, str(tmp_path / "m"))


def test_metrics_of_missing_runs(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"run": "a", "map50": 0.5, "per_class": {"car": {"map50": 0.1, "map50_95": 0.2}}}')
    rows, missing = readers.read_metrics(spark, {"a": str(tmp_path / "a.json"), "b": str(tmp_path / "b.json")})
    assert rows.count() == 1 and missing == ["b"]
    with pytest.raises(ValueError):
        readers.read_metrics(spark, {"b": str(tmp_path / "b.json")})
    with pytest.raises(KeyError):
        readers.dataset_path({"a": "/x"}, "b")


def test_image_listing(spark, tmp_path):
    for name in ("a.JPG", "b.txt", "c.png"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "list.txt").write_text("/x/y.jpg\n\n")
    assert readers.list_images(spark, str(tmp_path)).count() == 2
    assert readers.read_image_list(spark, [str(tmp_path / "list.txt"), str(tmp_path)]).count() == 3


def test_split_is_exact_and_stable(spark):
    rows = spark.range(90).withColumnRenamed("id", "image_id")
    first = sampling.split(rows, "image_id", {"train": 0.7, "val": 0.15}, "test")
    assert {r["split"]: r["count"] for r in first.groupBy("split").count().collect()} == {"train": 62, "val": 13, "test": 15}
    again = sampling.split(rows.repartition(9), "image_id", {"train": 0.7, "val": 0.15}, "test")
    assert first.exceptAll(again).isEmpty()


def test_pastes_keep_their_distance(spark):
    boxes = spark.createDataFrame([(i, k, "bus" if k else "person", 10.0 + 60 * k, 10.0, 50.0 + 60 * k, 60.0, 400, 300) for i in range(12) for k in range(3)], "image_id bigint, gt_idx bigint, class_name string, x1 double, y1 double, x2 double, y2 double, width int, height int")
    images = boxes.select("image_id", "width", "height").distinct()
    placed = copypaste.place(copypaste.draw_pastes(images, copypaste.instance_bank(boxes), 60), boxes)
    rows = placed.filter("reason is null").collect()
    assert rows
    there = {}
    for r in boxes.collect():
        there.setdefault(r.image_id, []).append((r.x1, r.y1, r.x2, r.y2))
    for no in {r.no for r in rows}:
        mine = [r for r in rows if r.no == no]
        fixed = list(there[mine[0].image_id])
        for r in sorted(mine, key=lambda r: r.paste):
            box = (r.x1, r.y1, r.x2, r.y2)
            assert all(iou(box, o) < 0.2 for o in fixed)
            fixed.append(box)


def test_single_seed_and_missing_baseline(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.0)], "run string, config int, map50 double")
    assert all(r["std"] == 0.0 for r in runs.seed_statistics(rows, "config", ("map50",)).collect())
    out = {r.run: r for r in runs.baseline_deltas(rows, "b").collect()}
    assert out["a"].map50_delta == 0.5 and out["a"].map50_delta_pct is None
    with pytest.raises(ValueError):
        runs.baseline_deltas(rows, "c")


def test_frames_without_attributes(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", ("foggy", None, None), [(" Car", (0.0, 0.0, 2.0, 2.0)), ("bus", None)])], readers.FRAMES)
    out = prepare.explode_labels(rows).collect()
    assert {r.weather for r in out} == {"undefined", "foggy"} and len(out) == 3
    assert prepare.frames_with_targets(rows).isEmpty()  # " Car" isn't trimmed here, the bus has no box


@pytest.fixture(params=["small", "crowded"])
def grid(request, monkeypatch):
    if request.param == "crowded":
        monkeypatch.setattr(matching, "CROWDED", 0)
        monkeypatch.setattr(matching, "IN_A_CELL", 1)


def test_pairs_of_small_and_crowded_images(scene, grid):
    gts, preds, boxes, predictions = scene
    want = {(p[0], p[1], g[1]): iou(p[4:], g[3:]) for p in preds for g in gts if p[0] == g[0] and iou(p[4:], g[3:]) > 0}
    got = {(r.image_id, r.pred_idx, r.gt_idx): r.iou for r in matching.pairs(predictions, boxes).collect()}
    assert got == pytest.approx(want)


def test_matchers_in_crowded_images(scene, monkeypatch):
    from boxwright.operators import errors, metrics

    _, _, boxes, predictions = scene
    matchers = {
        "greedy": lambda: matching.greedy(predictions, boxes),
        "argmax": lambda: matching.argmax(predictions, boxes, by_class=True),
        "suppress": lambda: matching.suppress(predictions, 0.3),
        "errors": lambda: errors.error_table(predictions, boxes),
        "coco": lambda: metrics.coco(predictions, boxes),
    }
    rows = lambda f: sorted(map(str, f().collect()))
    before = {k: rows(f) for k, f in matchers.items()}
    monkeypatch.setattr(matching, "CROWDED", 0)
    monkeypatch.setattr(matching, "IN_A_CELL", 1)
    for k, f in matchers.items():
        assert rows(f) == before[k], k


def test_one_image_of_twenty_thousand_boxes(spark):
    """As many predictions as boxes in one image, most of them in a few places; all matchers by a grid."""
    n = 20_000
    place = "floor(pow((id * 7919 % 20011) / 20011D, 2) * 8000) AS x, floor((id * 104729 % 20021) / 20021D * 6000) AS y"
    boxes = spark.sql(f"SELECT 1L AS image_id, id AS gt_idx, cast(id % 3 as int) AS class_id, cast(x as double) AS x1, cast(y as double) AS y1, x + 40D AS x2, y + 30D AS y2 FROM (SELECT id, {place} FROM range({n}))")
    predictions = boxes.selectExpr("image_id", "gt_idx AS pred_idx", "class_id", "(gt_idx * 31 % 1000) / 1000D AS conf", "x1 + 2 AS x1", "y1", "x2 + 2 AS x2", "y2")
    matched = matching.greedy(predictions, boxes).agg(F.count("*").alias("n"), F.count_if(F.col("pred_idx") == F.col("gt_idx")).alias("own")).first()
    assert matched.n >= 0.99 * n and matched.own > 0.5 * n
    left = matching.suppress(predictions, 0.3).count()
    assert n // 4 < left < n


def test_pastes_read_their_inputs_once(spark):
    """Ranking, sizes and both parts of the composites start from a checkpoint, not from the tables."""
    from boxwright.operators import copypaste

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    images = spark.range(40).selectExpr("id AS image_id", "1280 AS width", "720 AS height")
    rows = spark.range(200).selectExpr("id % 40 AS image_id", "id AS gt_idx", "'bus' AS class_name", "30D AS crop_w", "20D AS crop_h", "CAST(NULL AS STRING) AS reason")
    pastes = copypaste.draw_pastes(images, rows.mapInArrow(counted, rows.schema), 30)
    assert pastes.count() > 0 and read.value == 200
    placed = spark.range(20).selectExpr("id AS no", "id AS image_id", "'bus' AS class_name", "1D AS x1", "1D AS y1", "9D AS x2", "9D AS y2", "CAST(NULL AS STRING) AS reason")
    boxes = placed.select("image_id", "class_name", "x1", "y1", "x2", "y2")
    assert copypaste.composites(placed.mapInArrow(counted, placed.schema), boxes, 5).count() == 10 and read.value == 220


def test_reports_from_one_matching(scene, spark):
    """Reports take a tally for the errors, and it reads them once; without errors counts are 0."""
    from boxwright.operators import errors

    gts, preds, boxes, predictions = scene
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = errors.error_table(predictions, boxes)
    tally = errors.tally(errors.error_table(predictions.mapInArrow(counted, predictions.schema), boxes))
    for report in (errors.by_class, errors.by_size, errors.summary):
        got, want = report(tally), report(table)
        assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert read.value == len(preds)
    assert errors.summary(errors.tally(table.filter("false"))).collect() == errors.summary(table.filter("false")).collect()
