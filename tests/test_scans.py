"""Prefix scans over all tasks and selection by a histogram, against sorted lists."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from boxwright.operators import metrics, sampling, scan

FLAGS = "image_id bigint, pred_idx bigint, class_id int, conf double, n_gt bigint, tp int"


@pytest.fixture(scope="module")
def flags(spark):
    """Nine of ten rows at one confidence, most of them of one class; a class without hits."""
    draw = random.Random(2)
    rows = [(k // 5, k % 5, draw.choice([1, 1, 1, 1, 2, 3]), 0.5 if draw.random() < 0.9 else draw.random(), 9, 0) for k in range(6000)]
    rows = [(*r[:5], int(r[2] != 3 and draw.random() < 0.6)) for r in rows]
    return rows, spark.createDataFrame(rows, FLAGS).repartition(5).checkpoint()


@pytest.fixture(autouse=True)
def folder(spark):
    from boxwright.session import checkpoint_dir

    checkpoint_dir(spark)


def in_order(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], -r[3], r[0], r[1])):
        out[r[2]].append(r)
    return out


def test_ties_are_spread_over_tasks(flags, monkeypatch):
    monkeypatch.setattr(scan, "ROWS_PER_TASK", 400)
    placed = scan.ordered(flags[1], ("class_id",), (F.desc("conf"), F.asc("image_id"), F.asc("pred_idx")))
    sizes = [r["count"] for r in placed.groupBy("_p").count().collect()]
    assert len(sizes) >= 14 and max(sizes) <= 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("rows_per_task, batch", [(400, 37), (1_000_000, 10_000)])
def test_running_counts_and_average_precision(spark, flags, monkeypatch, rows_per_task, batch):
    monkeypatch.setattr(scan, "ROWS_PER_TASK", rows_per_task)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r.image_id, r.pred_idx): (r.cum_tp, r.cum_n) for r in metrics.curve(flags[1]).collect()}
        aps = {r.class_id: r.ap for r in metrics.average_precision(flags[1]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(flags[0])
    for cls, rows in in_order(flags[0]).items():
        tp, area, points = 0, 0.0, []
        for n, r in enumerate(rows, 1):
            tp += r[5]
            assert got[r[0], r[1]] == (tp, n)
            if r[5]:
                points.append(tp / (n + 1e-9))
        for k in reversed(range(len(points))):
            points[k] = max(points[k : k + 2])
        area = sum(p / (9 + 1e-9) for p in points)
        assert aps[cls] == pytest.approx(area, abs=1e-9)
    assert aps[3] == 0


def test_scans_of_an_empty_table(flags):
    nothing = flags[1].filter("false")
    assert metrics.curve(nothing).count() == 0 and metrics.average_precision(nothing).count() == 0


def key(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


@pytest.fixture(scope="module", params=[1_000_000, 3])
def pool(request, spark):
    draw = random.Random(8)
    rows = [(k, draw.choice(["a", "a", "a", "b", None]), "x") for k in range(700)] + [(1000, "c", "x")]
    before, sampling.ROWS_IN_A_BIN = sampling.ROWS_IN_A_BIN, request.param  # 3: finer histograms
    yield rows, spark.createDataFrame(rows, "id bigint, grp string, slot_ string").withColumnRenamed("slot_", "total").repartition(4)
    sampling.ROWS_IN_A_BIN = before


def test_samples_equal_sorting(pool):
    rows, table = pool
    ids = sorted((r[0] for r in rows), key=key)
    for k in (0, 1, 350, 701, 9999):
        assert sorted(r.id for r in sampling.sample(table, "id", k).collect()) == sorted(ids[:k])
    assert sorted(r.id for r in sampling.sample_share(table, "id", 0.5).collect()) == sorted(ids[: round(701 * 0.5)])
    assert sampling.sample_share(table, "id", 1.0).count() == 701


def test_splits_and_groups_equal_sorting(pool):
    rows, table = pool
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: key(r[0])):
        groups[r[1]].append(r[0])
    want = {}
    for ids in groups.values():
        n = len(ids)
        a, b = int(n * 0.7), int(n * 0.7) + int(n * 0.15)
        want |= {i: "train" if k < a else "val" if k < b else "test" for k, i in enumerate(ids)}
    assert {r.id: r.split for r in sampling.split(table, "id", {"train": 0.7, "val": 0.15}, "test", "grp").collect()} == want
    for k in (1, 3):
        assert Counter(r.id for r in sampling.one_per_group(table, "id", "grp", k=k).collect()) == Counter(i for ids in groups.values() for i in ids[:k])
    got = {r.id for r in sampling.quota_sample(table, "id", 400, {"a": 50}, fill="b", by="grp").collect()}
    assert got == set(groups["a"][:50] + groups[None] + groups["c"] + groups["b"][: 400 - 51])


def test_samples_of_repeated_ids_and_empty_tables(spark, pool):
    many = spark.createDataFrame([(7,)] * 90 + [(k,) for k in range(10)], "id bigint")
    assert sampling.sample(many, "id", 40).count() == 40
    nothing = pool[1].filter("false")
    assert sampling.sample(nothing, "id", 5).count() == 0 and sampling.split(nothing, "id", {"a": 0.5}, "b", "grp").count() == 0
    ranks = sorted(r["rank"] for r in sampling.ranked(many, "id").collect())
    assert ranks == list(range(1, 101))


def test_average_precision_writes_bits(spark, flags, monkeypatch):
    """After the sort predictions are bits in blocks of any size, not rows written again."""
    from pathlib import Path

    from boxwright.session import checkpoint_dir

    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("part-*"))
    table, before = flags[1].selectExpr("image_id", "pred_idx", "'c' || class_id AS class_id", "conf", "n_gt", "tp").checkpoint(), size()
    want = {r.class_id: r.ap for r in metrics.average_precision(table).collect()}
    assert len(want) == 3 and 0 < size() - before < 5 * len(flags[0])
    monkeypatch.setattr(scan, "BLOCK", 7)
    monkeypatch.setattr(scan, "ROWS_PER_TASK", 900)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r.class_id: r.ap for r in metrics.average_precision(table).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert got == pytest.approx(want, abs=1e-9)
