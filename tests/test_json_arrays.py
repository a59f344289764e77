"""JSON arrays read by several tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from boxwright.sources import json_arrays, readers

SCHEMA = "name STRING, n BIGINT, xs ARRAY<STRUCT<a: STRING, b: STRUCT<c: BIGINT>>>"


def objects(n, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice('ab{}[]",:\\ é日\n') for _ in range(draw.randint(0, 12)))
    return [{"name": word(), "n": k, "xs": [{"a": word(), "b": {"c": draw.randint(0, 9)}} for _ in range(draw.randint(0, 4))]} for k in range(n)]


@pytest.fixture(params=[300, 1 << 27])
def split_bytes(request, spark):
    conf = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_objects_across_splits(spark, tmp_path, split_bytes, monkeypatch):
    want = []
    for k, indent in enumerate((None, 2, None)):
        found = objects(20 if split_bytes < 1000 else 300, k)
        want += [x | {"n": x["n"] + 1000 * k} for x in found]
        (tmp_path / f"{k}.json").write_text(json.dumps([x | {"n": x["n"] + 1000 * k} for x in found], indent=indent, ensure_ascii=k == 2), encoding="utf-8")
    (tmp_path / "one.json").write_text(' {"name": "alone", "n": -1, "xs": []}\n')
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "none.json").write_text("")
    (tmp_path / "cut.json").write_text('[{"name": "good", "n": -2, "xs": []}, {"name": "cut')
    want += [{"name": "alone", "n": -1, "xs": []}, {"name": "good", "n": -2, "xs": []}]
    for most in (500_000, 0):  # starts broadcast, and joined by a shuffle
        monkeypatch.setattr(json_arrays, "BROADCAST_SPLITS", most)
        got = json_arrays.read_json_arrays(spark, str(tmp_path), SCHEMA).collect()
        assert sorted((r.asDict(True) for r in got), key=lambda r: r["n"]) == sorted(want, key=lambda r: r["n"])


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    frames = [{"name": f"f{k}", "attributes": {"weather": "clear"}, "labels": [{"category": "car", "box2d": {"x1": 1.0, "y1": 2.0, "x2": 3.0, "y2": 4.0}}] * 20} for k in range(3000)]
    (tmp_path / "labels.json").write_text(json.dumps(frames))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        read = readers.read_frames(spark, str(tmp_path / "labels.json"))
        tasks = read.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r["count"] for r in tasks) == 3000 and len([r for r in tasks if r["count"] > 100]) >= 4


def test_small_files_need_no_pass_over_splits(spark, tmp_path, monkeypatch):
    def summaries(batches):
        if any(b.num_rows for b in batches):
            raise ValueError("a small file was summed up by splits")
        yield from ()

    monkeypatch.setattr(json_arrays, "_summaries", summaries)
    want = []
    for k in range(3):
        want += [x | {"n": x["n"] + 1000 * k} for x in objects(50, k)]
        (tmp_path / f"{k}.json").write_text(json.dumps(want[-50:], indent=k or None))
    got = json_arrays.read_json_arrays(spark, str(tmp_path), SCHEMA).collect()
    assert sorted((r.asDict(True) for r in got), key=lambda r: r["n"]) == want
