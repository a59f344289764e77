"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the words of a text (runs of letters, in lower case) and their
prefixes of 4 to 8 bytes, held as 64-bit hashes.  The model has one weight per
feature, shared by all thresholds: P(grade <= k) = sigmoid(threshold_k - w.x).
A text's severity is its expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.sampling import least_hashed, one_row_each
from boxwright.llm.textvec import blocks, buffer_of, span_hashes

PREFIXES = (4, 5, 6, 7, 8)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FILTER_BITS = 22


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the two-byte capitals of Latin-1."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def feature_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All features of the texts, repeated as they occur, and the text of each."""
    data = _lower(data)
    letter = _LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    inside = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][inside], offsets[1:][inside] - 1
    first[begin] = letter[begin]
    last[end] = letter[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    hashes, docs = [span_hashes(data, starts, ends)], [doc]
    for n in PREFIXES:
        long = ends - starts > n
        with np.errstate(over="ignore"):
            hashes.append(span_hashes(data, starts[long], starts[long] + n) + np.uint64(n))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


@dataclass
class OrdinalModel:
    """keys: feature hashes, sorted; weights: one for each; thresholds: rising, one below each grade from 1."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.near = None

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known features as (text, feature number, log1p of the count)."""
        if self.near is None:
            self.near = np.zeros(1 << _FILTER_BITS, dtype=bool)
            self.near[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        hashes, docs = feature_hashes(data, offsets)
        maybe = np.flatnonzero(self.near[hashes >> np.uint64(64 - _FILTER_BITS)])
        if not len(maybe) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        hashes, docs = hashes[maybe], docs[maybe]
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        pair, counts = np.unique(docs[hit] * len(self.keys) + at[hit], return_counts=True)
        return pair // len(self.keys), pair % len(self.keys), np.log1p(counts)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and threshold (columns)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        docs, features, values = self.values(data, offsets)
        return np.bincount(docs, self.weights[features] * values, minlength=len(offsets) - 1)


def fit_ordinal(
    rows: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, l2: float = 3e-4, steps: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood (Adam on all rows)."""
    n, cuts = len(grades), max(int(grades.max()), 1)
    share = np.array([(grades <= k).mean() for k in range(cuts)]).clip(0.01, 0.99)
    theta = np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + np.arange(cuts) * 1e-2)
    # thresholds are the first one and the logs of the steps to the next
    raw = np.concatenate([theta[:1], np.log(np.diff(theta))])
    x = np.zeros(n_features + cuts)
    x[n_features:] = raw
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, raw = x[:n_features], x[n_features:]
        jump = np.exp(raw[1:])
        theta = np.concatenate([raw[:1], raw[0] + np.cumsum(jump)])
        s = np.bincount(rows, w[features] * values, minlength=n)
        below = 1 / (1 + np.exp(np.clip(s[:, None] - theta[None, :], -60, 60)))  # P(grade <= k)
        edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        p = np.maximum(edge[i, grades + 1] - edge[i, grades], 1e-9)
        up, down = slope[i, grades + 1] / p, slope[i, grades] / p
        g_s = (up - down) / n  # of the negative log-likelihood, by score
        g_theta = (np.bincount(grades, -up, minlength=cuts + 1)[:cuts] + np.bincount(grades, down, minlength=cuts + 1)[1:]) / n
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(features, g_s[rows] * values, minlength=n_features) + l2 * w, tail[:1], tail[1:] * jump])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x = x - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    raw = x[n_features:]
    return x[:n_features], np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to one row per text and distinct feature: feature, label."""
    for batch in batches:
        data, offsets = buffer_of(batch.column(1))
        labels = np.asarray(batch.column(0))
        for lo, hi in blocks(offsets):
            part = offsets[lo : hi + 1]
            hashes, docs = feature_hashes(data[part[0] : part[-1]], part - part[0])
            order = np.lexsort((docs, hashes))
            hashes, docs = hashes[order], docs[order]
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), pa.array(labels[lo:hi][docs[new]], type=pa.int32())], names=["feature", "label"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = 10_000,
    max_features: int = 4096,
    min_docs: int = 3,
    grades: int = 4,
) -> OrdinalModel:
    """Fit a model on a bounded sample of labelled rows.

    Bounds, all of them on fitting only (scoring reads every text whole):
    ``sample_rows``: the labelled documents of least hashed id, the same ones
    whatever the partitioning, one row for each id (the least label and text,
    where an id repeats); ``max_features``: the model's size, the features of
    the sample with the most evidence times the root of their documents, among
    those that at least ``min_docs`` positive documents hold and that are more
    than e times as common in these as in the others.

    Labels of more than two values are grades.  For 0/1 labels the grades above
    0 are made here, from the texts: positive documents in equal parts by how
    much of the evidence (words that are far more common in positive documents)
    they hold.  They order documents by amount, not by a judge's severity.  Null
    labels and ids take no part; without any labelled document every grade is 0.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id is not null and _label is not null")
    # labels that documents have; then as many ids as are wanted, and one label and text for each
    there = known.join(docs.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct(), "_id", "left_semi")
    chosen = least_hashed(there, "_id", sample_rows).persist()
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    sample = one_row_each(texts, chosen, "_id").join(one_row_each(known, chosen, "_id"), "_id").select("_label", "_text").persist()
    try:
        positive, negative = F.sum((F.col("label") > 0).cast("int")), F.sum((F.col("label") <= 0).cast("int"))
        total = sample.agg(F.sum((F.col("_label") > 0).cast("int")), F.sum((F.col("_label") <= 0).cast("int"))).first()
        n_pos, n_neg = total[0] or 0, total[1] or 0
        evidence = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
        table = (
            sample.mapInArrow(_features_of, "feature bigint, label int")
            .groupBy("feature")
            .agg(positive.alias("pos"), negative.alias("neg"))
            .filter(F.col("pos") >= min_docs)
            .withColumn("evidence", evidence)
            .filter("evidence > 1")
            .orderBy(F.desc(F.col("evidence") * F.sqrt("pos")), "feature")
            .limit(max_features)
            .select("feature", "evidence")
            .toPandas()
        )
        keys = table["feature"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        keys, strong = keys[order], table["evidence"].to_numpy(dtype=float)[order] > np.log(20)
        model = OrdinalModel(keys, np.zeros(len(keys)), np.zeros(1))

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = buffer_of(batch.column(1))
                for lo, hi in blocks(offsets):
                    part = offsets[lo : hi + 1]
                    rows, features, values = model.values(data[part[0] : part[-1]], part - part[0])
                    cut = np.searchsorted(rows, np.arange(hi - lo + 1))
                    lists = [pa.ListArray.from_arrays(pa.array(cut, type=pa.int32()), pa.array(x)) for x in (features.astype(np.int32), values.astype(np.float64))]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *lists], names=["label", "features", "vals"])

        found = sample.mapInArrow(known, "label int, features array<int>, vals array<double>").collect()
    finally:
        sample.unpersist()
        chosen.unpersist()
    if not len(keys) or not found:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(max(grades - 1, 1), 30.0))
    found.sort(key=lambda r: (r.label, r.features, r.vals))
    label = np.array([r.label for r in found])
    rows = np.repeat(np.arange(len(found)), [len(r.features) for r in found])
    features = np.array([f for r in found for f in r.features], dtype=np.int64)
    values = np.array([v for r in found for v in r.vals], dtype=float)
    grade = np.maximum(label, 0)
    if grade.max() <= 1 and grades > 2:
        mass = np.bincount(rows, np.expm1(values) * strong[features], minlength=len(found))
        held = mass[(grade > 0) & (mass > 0)]
        steps = np.quantile(held, np.arange(1, grades - 1) / (grades - 1)) if len(held) else []
        grade = np.where(grade > 0, 1 + sum((mass > s).astype(int) for s in steps), 0)
    weights, thresholds = fit_ordinal(rows, features, values, grade, len(keys))
    return OrdinalModel(keys, weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, severity (expected grade; for 0/1 labels the grades are ``train``'s own), p_toxic (P(grade >= 1)) and toxic (p_toxic above ``threshold``) of every row.

    The whole text counts.  A null text is empty and gets the score of no
    features; a null id stays null; repeated rows are scored as often as they
    stand; an empty table gives none.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            found = [np.zeros(0)]
            for lo, hi in blocks(offsets):
                part = offsets[lo : hi + 1]
                found.append(model.scores(data[part[0] : part[-1]], part - part[0]))
            above = model.above(np.concatenate(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] > threshold)],
                names=["doc_id", "severity", "p_toxic", "toxic"],
            )

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, severity double, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text isn't toxic."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(at))
            keep = [np.zeros(0, dtype=bool)]
            for lo, hi in blocks(offsets):
                part = offsets[lo : hi + 1]
                keep.append(model.above(model.scores(data[part[0] : part[-1]], part - part[0]))[:, 0] <= threshold)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
