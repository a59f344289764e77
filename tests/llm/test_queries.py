import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxwright.llm import topk
from boxwright.llm.queries import oracle_sql, queries
from tests.compare import check, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, sf_dir, con, name):
    check(queries()[name](spark, sf_dir), con, oracle_sql()[name])


@pytest.mark.parametrize("k", [3, 10])
def test_top_k_with_ties_and_odd_vectors(spark, k):
    rows = [(i, [float((i * 7) % 5), 1.0, float(i % 3)]) for i in range(400)] + [(1000, [100.0, 0.0, 0.0]), (2000, [0.0, 0.0, 0.0]), (1, None), (3, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("clash"))
    good = [(i, [int(1024 * x) for x in v]) for i, v in rows[:402]]
    found = topk.top_k(table, F.col("vec_id") % 50 == 0, k, buckets=4).collect()
    for q, v in good:
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q))[:k]
            assert [(-r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == scores
    assert topk.top_k(table.filter("false"), F.col("vec_id") % 50 == 0, k).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
        assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
        assert 0 < docs.count() <= left, name
        left = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == left
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == left


def test_top_k_of_vectors_of_several_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [3.0, 3.0]), (3, [9.0]), (4, [9.0, 9.0, 9.0]), (5, []), (2, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") == 0, 5).collect())
    assert found == [(1, 2, 9 << 20), (2, 1, 4 << 20), (3, 2, 3 << 20)]


def test_top_k_of_repeated_queries_and_of_each_length(spark):
    """Each row of an id has its own results, and meets the vectors of its own length."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 7.0]), (3, [3.0, 0.0]), (4, [0.0, 4.0]), (0, [1.0]), (5, [2.0]), (6, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted((r["rank"], r.vec_id, r.score >> 20) for r in topk.top_k(table, F.col("vec_id") == 0, 2).collect())
    assert found == [(1, 1, 5), (1, 2, 7), (1, 5, 2), (2, 3, 3), (2, 4, 4)]
    same = spark.createDataFrame([(0, [1.0, 1.0])] * 3, "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.score >> 20) for r in topk.top_k(same, F.col("vec_id") == 0, 5).collect()] == [(0, 2)] * 6


def test_top_k_refuses_what_would_not_be_exact(spark):
    table = spark.createDataFrame([(0, [3e6, 1.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="exact"):
        topk.top_k(table, F.col("vec_id") == 0)


def test_top_k_in_many_blocks(spark, monkeypatch):
    """Both rounds, with blocks of a few rows, lengths that differ much, and a repeated id."""
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(topk, "FIRST_LONGEST", 1)
    draw = random.Random(5)
    rows = [(i if i % 3 else 7, [draw.gauss(0, 1) * 4.0 ** (i % 6) for _ in range(6)]) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    found = topk.top_k(table, F.col("vec_id") % 20 == 1, 5, buckets=6).collect()
    asked = [(i, v) for i, v in good if i % 20 == 1]
    assert len(found) == 5 * len(asked)
    for q, v in asked:
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == scores
