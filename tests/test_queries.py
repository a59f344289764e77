import pytest

from boxwright.plans.queries import ORACLE, QUERIES
from tests.compare import check, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, con, name):
    check(QUERIES[name](spark, sf_dir), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_known_totals(spark):
    row = QUERIES["a20_error_summary"](spark, "/root/testdata/sf0.01").first()
    assert (row.true_positive, row.loose_box, row.poor_localization, row.wrong_class, row.missed_object, row.false_positive) == (37554, 382, 9344, 3188, 22064, 925)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_optional_parts():
    """The registry works where the optional subpackage and the pipeline are gone."""
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("boxwright.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert "m1_greedy_match" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_panoptic_files_are_bounded(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from boxwright.plans import io
    from boxwright.plans.queries import QUERIES

    monkeypatch.setattr(io, "_folder", lambda spark: f"{tmp_path}/panoptic")
    total = QUERIES["s4_read_panoptic"](spark, "/root/testdata/sf0.01").agg(F.sum("n")).first()[0]
    sizes = [r.n for r in spark.read.json(f"{tmp_path}/panoptic").select(F.size("annotations").alias("n")).collect()]
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    segment = F.expr("CASE WHEN l_suppkey % 4 = 0 THEN 24 + l_partkey % 10 ELSE (24 + l_partkey % 10) * 1000 + l_suppkey % 3 END")
    assert total == lines.select("l_orderkey", segment).distinct().count()
    assert sum(sizes) == lines.select("l_orderkey").distinct().count() and max(sizes) < 1500


def test_labels_of_one_split_are_written_by_several_tasks(spark, tmp_path):
    from boxwright.sources import sinks

    images = spark.range(40).selectExpr("'train' AS split", "id AS image_id", "100 AS width", "50 AS height")
    boxes = spark.range(20).selectExpr("id AS image_id", "1 AS gt_idx", "2 AS class_id", "10D AS x1", "10D AS y1", "20D AS x2", "30D AS y2")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_labels(images, boxes, f"{tmp_path}/labels")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    files = list((tmp_path / "labels").glob("split=train/image_id=*/part-*"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1
