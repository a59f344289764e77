"""The label file sink, checks inside the plan, fallbacks and counts taken in a pass."""

import errno
import os
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from boxwright.functions.vocab import CLASSES
from boxwright.operators import prepare
from boxwright.sources import label_files, readers


@pytest.fixture(autouse=True)
def folder(spark):
    from boxwright.session import checkpoint_dir

    checkpoint_dir(spark)


def tree(path):
    return {str(p.relative_to(path)): p.read_text() for p in Path(path).rglob("*") if p.is_file()}


def test_label_files_have_their_names(spark, tmp_path):
    rows = spark.createDataFrame([(f"labels/{s}/{k}.txt", "x" * k or None) for s in ("train", "val") for k in range(20)], "name string, value string").repartition(5)
    label_files.write_files(rows, str(tmp_path))
    want = {f"labels/{s}/{k}.txt": "x" * k for s in ("train", "val") for k in range(20)}
    assert tree(tmp_path) == want
    label_files.write_files(rows.filter("name like '%/7.txt'"), str(tmp_path), clean=True)
    assert set(tree(tmp_path)) == {"labels/train/7.txt", "labels/val/7.txt"}
    label_files.write_files(rows.filter("false"), str(tmp_path))
    assert len(tree(tmp_path)) == 2


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(f"labels/{k}.txt" if k != 33 else "../out.txt", "x") for k in range(40)], "name string, value string").repartition(4)
    with pytest.raises(PySparkException, match="not a name"):
        label_files.write_files(rows, f"{tmp_path}/out")
    assert tree(tmp_path) == {}


def test_inventory_lists_folders_by_tasks(spark, tmp_path):
    for name in ("a.jpg", "b/c.PNG", "b/d/e/f.webp", "b/d/g.txt", "b/h", "i.JPEG.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        found = {r.image_path.removeprefix(f"{path}/") for r in readers.list_inventory(spark, path).collect()}
        assert found == {"a.jpg", "b/c.PNG", "b/d/e/f.webp"}
    (tmp_path / "empty").mkdir()
    assert readers.list_inventory(spark, f"{tmp_path}/empty").count() == 0
    with pytest.raises(PySparkException):
        readers.list_inventory(spark, f"{tmp_path}/nowhere").count()


def test_panoptic_fallback(spark, tmp_path):
    text = '{"categories": [{"id": 1, "name": "NAME"}], "annotations": [{"file_name": "k_gt_panoptic.png", "segments_info": [{"id": 5, "category_id": 1}]}]}'
    (tmp_path / "fog").mkdir()
    (tmp_path / "fog" / "a.json").write_text(text.replace("NAME", "first"))
    (tmp_path / "fog" / "b.json").write_text(text.replace("NAME", "last"))
    (tmp_path / "fog" / "c.json").write_text("{ not json")
    names = lambda root: [r.category_name for r in readers.read_panoptic(spark, root, f"{tmp_path}/fog/*.json").collect()]
    assert names(f"{tmp_path}/*.json") == ["last"] and names(f"{tmp_path}/nowhere") == ["last"]
    (tmp_path / "root.json").write_text(text.replace("NAME", "root"))
    assert names(f"{tmp_path}/*.json") == ["root"]
    with pytest.raises(PySparkException):
        readers.read_panoptic(spark, f"{tmp_path}/nowhere", f"{tmp_path}/neither").collect()


def test_class_contract(spark):
    table = lambda names: spark.createDataFrame(list(enumerate(names)), "class_id int, class_name string")
    assert prepare.class_contract(table(CLASSES)).filter("ok").count() == len(CLASSES)
    swapped = [CLASSES[1], CLASSES[0], *CLASSES[2:]]
    for wrong in (swapped, CLASSES[:-1], [*CLASSES, "tram"], []):
        with pytest.raises(PySparkException, match="class "):
            prepare.class_contract(table(wrong)).collect()


def test_unknown_datasets_stop_the_job(spark):
    rows, known = spark.createDataFrame([("a",), ("b",)], "dataset string"), spark.createDataFrame([("a", "/x")], "dataset string, path string")
    assert [tuple(r) for r in readers.with_dataset_paths(rows.filter("dataset = 'a'"), known).collect()] == [("a", "/x")]
    with pytest.raises(PySparkException, match="unknown dataset: b"):
        readers.with_dataset_paths(rows, known).collect()


def test_counts_come_from_the_pass_that_drops(spark, tmp_path):
    rows = spark.range(100).select("id", F.expr("CASE WHEN id % 10 = 0 THEN 'a' WHEN id % 7 = 0 THEN 'b' END").alias("reason"))
    kept, counts = prepare.kept_and_counted(rows, ("a", "b", "c"))
    kept.write.parquet(f"{tmp_path}/kept")
    assert counts.get == {"a": 10, "b": 13, "c": 0} and spark.read.parquet(f"{tmp_path}/kept").count() == 77


def test_run_folders_are_dropped(spark):
    from boxwright.session import drop_run_folders, run_folder

    drop_run_folders(spark)
    path = run_folder(spark, "test")
    spark.range(3).write.parquet(path)
    assert readers.path_exists(spark, path)
    assert drop_run_folders(spark) == 1 and not readers.path_exists(spark, path)


def test_names_of_files_stay_with_the_tasks(spark, tmp_path, monkeypatch):
    """Files are moved by tasks: nothing that lists their names comes to the driver."""
    seen = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: seen.append(n := collect(df)) or n)
    rows = spark.range(3000).selectExpr("concat('a/', id % 2, '/', id, '.txt') AS name", "'x' AS value").repartition(3)
    label_files.write_files(rows, f"{tmp_path}/out", clean=True)
    assert len(list((tmp_path / "out").rglob("*.txt"))) == 3000 and not list((tmp_path / "out").glob("_staging*"))
    assert seen and all(len(x) <= 1 for x in seen) and not hasattr(label_files, "Written")


def test_voc_files_and_shuffles_are_bounded(spark, monkeypatch, tmp_path):
    from boxwright import session
    from boxwright.plans import io
    from boxwright.plans.queries import QUERIES

    monkeypatch.setattr(io, "_folder", lambda spark: f"{tmp_path}/voc")
    monkeypatch.setattr(io, "FILE_ROWS", 100, raising=False)
    QUERIES["s2_read_voc"](spark, "/root/testdata/sf0.001").collect()
    files = [p.read_text().count("<annotation>") for p in (tmp_path / "voc").glob("part-*")]
    assert sum(files) > 1000 and max(files) <= 100
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    session.spread(spark, "/root/testdata/sf0.1/lineitem.parquet", 100_000)
    try:
        assert int(spark.conf.get(key)) > 100
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_label_files_are_read_back_by_tasks(spark, tmp_path, monkeypatch):
    """The driver knows no file's name, empty files are read too, and a task reads about as many as it is given."""
    from boxwright.plans.queries import QUERIES

    monkeypatch.setattr(label_files, "FILES", 500)
    found = QUERIES["k8_label_files"](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() == [] and found.rdd.getNumPartitions() == 1500 // 500 + 1
    rows = found.collect()
    assert len(rows) == len({(r.split, r.name) for r in rows}) == 1500 and min(r.n_lines for r in rows) == 0
    texts = [("a.txt", "one\ntwo"), ("b/c.txt", ""), ("b/d.log", "x" * 2_000_000), ("b/e.txt", "é")]
    label_files.write_files(spark.createDataFrame(texts, "name string, value string"), str(tmp_path))
    listed = readers.list_inventory(spark, str(tmp_path), (".txt", ".log"))
    assert {(r.image_path.removeprefix(f"{tmp_path}/"), r.value) for r in readers.read_files(listed).collect()} == set(texts)
    with pytest.raises(PySparkException):
        readers.read_files(spark.createDataFrame([(f"{tmp_path}/nowhere.txt",)], "image_path string")).collect()


def inodes(path):
    return [p.stat().st_ino for p in Path(path).rglob("*") if p.is_file()]


def test_an_inventory_of_empty_files_takes_few_inodes(spark, tmp_path, monkeypatch):
    """Empty files are names of a few where that is asked for; other files, and files that are replaced, stay their own."""
    from boxwright.plans import io
    from boxwright.plans.queries import QUERIES

    monkeypatch.setattr(io, "_folder", lambda spark: f"{tmp_path}/s6")
    assert len(QUERIES["s6_image_inventory"](spark, "/root/testdata/sf0.001").collect()) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_orderkey % 7 < 5").count()
    assert len(inodes(f"{tmp_path}/s6/tree")) == 1500 and len(set(inodes(f"{tmp_path}/s6/tree"))) <= 8
    monkeypatch.setattr(label_files, "LINKS", 30)
    rows = spark.range(200).selectExpr("concat('a/', id % 2, '/', id, '.jpg') AS name", "CASE WHEN id >= 190 THEN 'text' WHEN id % 3 = 0 THEN '' END AS value").coalesce(1)
    want = {f"a/{k % 2}/{k}.jpg": "text" if k >= 190 else "" for k in range(200)}
    out = tmp_path / "out"
    label_files.write_files(rows, str(out), linked=True)
    assert tree(out) == want and len(set(inodes(out))) == 7 + 10 and max(p.stat().st_nlink for p in out.rglob("*.jpg")) == 30
    label_files.write_files(rows.unionAll(rows).selectExpr("name", "'' AS value"), str(out), linked=True)
    assert tree(out) == dict.fromkeys(want, "")
    label_files.write_files(rows.filter("name = 'a/0/4.jpg'").selectExpr("name", "'new' AS value"), str(out))
    assert tree(out) == dict.fromkeys(want, "") | {"a/0/4.jpg": "new"}
    label_files.write_files(rows, f"{tmp_path}/own")
    assert tree(tmp_path / "own") == want and len(set(inodes(tmp_path / "own"))) == 200


def test_a_disk_that_allows_no_more_names(tmp_path, monkeypatch):
    blank, old = tmp_path / "blank", tmp_path / "old.jpg"
    blank.write_text("")
    old.write_text("old")

    def refused(a, b):
        raise OSError(errno.EMLINK if not Path(b).exists() else errno.EEXIST, "refused")

    monkeypatch.setattr(os, "link", refused)
    for name in ("new.jpg", "old.jpg", "old.jpg"):
        label_files._link(str(blank), f"{tmp_path}/{name}")
    assert tree(tmp_path) == {"blank": "", "new.jpg": "", "old.jpg": ""} and len(set(inodes(tmp_path))) == 3


def test_folders_are_listed_by_as_many_tasks(spark, tmp_path):
    """However short the paths of the folders are, they aren't all listed by one task."""
    for k in range(12):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "a.jpg").write_text("")
    found = readers.list_inventory(spark, str(tmp_path))
    parts = [r.n for r in found.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == 12 and len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) == 4 and max(parts) <= 4
