"""Quality scores by regularised quadratic discriminant analysis.

A text becomes a short vector of transformed statistics.  Each class has a mean
and a covariance over the labelled texts' vectors, shrunk toward the pooled
covariance and toward a multiple of the identity.  The score is the logistic
function of the difference of the two log densities (and of the classes' log
frequencies), divided by a temperature; the Cholesky factors are made once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.textvec import blocks, buffer_of, lower_ascii, span_hashes, windows, word_spans
from boxwright.session import checkpoint_dir

FEATURES = (
    "symbols", "pipes", "capitals", "exclamations", "digits", "stops", "other_marks",
    "repeats_of_previous", "word_variety", "repeated_windows", "word_length", "log_words",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_CLASSES = [
    _table(b"#*$%&<>@^~=+_\\"),
    _table(b"|"),
    _table(bytes(range(65, 91))),
    _table(b"!?"),
    _table(b"0123456789"),
    _table(b".,;:"),
    _table(b"()[]{}/'\"`-"),
]
_STRIP = _table(b".,;:!?#*$%&|<>()[]{}\"'")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text.

    Shares of bytes or words go through a square root, so that rare marks count
    and a few more of many don't; counts through a logarithm.  A text without
    words has the values of an empty one: no share of anything.
    """
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    out = np.zeros((n, len(FEATURES)))
    for k, table in enumerate(_CLASSES):
        upto = np.concatenate([[0], np.cumsum(table[data])])
        out[:, k] = np.sqrt(np.diff(upto[offsets]) / size)
    starts, ends, before = word_spans(data, offsets)
    words = np.diff(before)
    if len(starts):
        # a word without its last mark, so that "so, so" repeats
        short = ends - (_STRIP[data[ends - 1]] & (ends - starts > 1))
        hashes = span_hashes(lower_ascii(data), starts, short)
        doc = np.repeat(np.arange(n), words)
        again = np.zeros(len(starts), dtype=bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        safe = np.maximum(words, 1)
        out[:, 7] = np.sqrt(np.bincount(doc, again, minlength=n) / safe)
        distinct = np.zeros(n)
        repeated = np.zeros(n)
        runs, begin = windows(hashes, before, 3)
        for k in np.flatnonzero(words).tolist():
            distinct[k] = len(np.unique(hashes[before[k] : before[k + 1]]))
            repeated[k] = 1 - len(np.unique(runs[begin[k] : begin[k + 1]])) / max(1, begin[k + 1] - begin[k])
        # texts of n words have about n**0.8 different ones, whatever they say
        out[:, 8] = np.where(words > 0, np.log(np.maximum(distinct, 1)) - 0.8 * np.log(safe), 0)
        out[:, 9] = np.sqrt(repeated)
        out[:, 10] = np.log1p(np.bincount(doc, ends - starts, minlength=n) / safe)
    out[:, 11] = np.log1p(words)
    return out


@dataclass
class Discriminant:
    """For both classes: means, inverse Cholesky factors, log normalisers; the log odds of class 1."""

    means: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray
    log_odds: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whiten[k].T
            density.append(-0.5 * (z * z).sum(axis=1) - self.logdet[k])
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0] + self.log_odds) / self.temperature, -50, 50)))


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (FEATURES) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for lo, hi in blocks(offsets):
                part = offsets[lo : hi + 1]
                x = statistics(data[part[0] : part[-1]], part - part[0])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * len(FEATURES), type=pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], lists], names=["doc_id", "x"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, x array<double>")


def fit(labelled: DataFrame, pooled: float = 0.15, ridge: float = 0.02, temperature: float = 2.0) -> Discriminant:
    """A model of (label 0/1, x) rows, from sums over all of them.

    Two passes: means, then products around the common mean, which keep their
    digits.  Only one row of sums for each class comes to the driver.  With a
    class missing, both have the other's (or, without rows, unit) moments, so
    only the classes' frequencies count.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    labelled = labelled.filter("label in (0, 1)").withColumn("label", F.col("label").cast("int"))
    centre = [v or 0.0 for v in labelled.agg(*[F.avg(F.col("x")[i]) for i in range(d)]).first()]
    off = [F.col("x")[i] - F.lit(centre[i]) for i in range(d)]
    sums = [F.sum(off[i]).alias(f"s{i}") for i in range(d)] + [F.sum(off[i] * off[j]).alias(f"p{i}_{j}") for i, j in pairs]
    rows = {r["label"]: r for r in labelled.groupBy("label").agg(F.count("*").alias("n"), *sums).collect()}
    count, mean, cov = np.zeros(2), np.zeros((2, d)), np.stack([np.eye(d)] * 2)
    for k, r in rows.items():
        count[k] = r["n"]
        mean[k] = [r[f"s{i}"] / r["n"] for i in range(d)]
        for i, j in pairs:
            cov[k, i, j] = cov[k, j, i] = r[f"p{i}_{j}"] / r["n"] - mean[k, i] * mean[k, j]
        mean[k] += centre
    for k in (0, 1):
        if not count[k] and count[1 - k]:
            mean[k], cov[k] = mean[1 - k], cov[1 - k]
    both = (cov * count[:, None, None]).sum(axis=0) / max(count.sum(), 1) if count.sum() else np.eye(d)
    scale = np.maximum(np.diag(both), 1e-6)
    whiten, logdet = [], []
    for k in (0, 1):
        shrunk = (1 - pooled) * cov[k] + pooled * both + ridge * np.diag(scale) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        logdet.append(np.log(np.diag(factor)).sum())
    return Discriminant(mean, np.stack(whiten), np.array(logdet), float(np.log((count[1] + 1) / (count[0] + 1))), temperature)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    threshold: float = 0.3,
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Labels are learned only where crc32(id as text) mod ``folds`` isn't 0; the
    others are held out.  Labels and ids are no features.  The whole text counts.

    A null text is an empty one; empty texts get the score of their vector.  A
    null id is never labelled nor held out.  Labels other than 0 and 1 (null
    too) are ignored; repeated label rows count as often as they stand, and so
    do repeated documents.  An empty table gives no rows.  Other columns are
    ignored.
    """
    checkpoint_dir(docs.sparkSession)
    x = vectors(docs, id_col, text_col).checkpoint()
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(folds))
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label")).filter(fold("_id") != 0)
    model = fit(x.join(known, x["doc_id"] == known["_id"]).select("label", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    placed = x.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "x")
    return placed.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
