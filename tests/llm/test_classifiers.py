"""The quality classifier and the toxicity model against plain computations of the same formulas."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxwright.llm import quality_classifier, textvec, toxicity
from tests.llm.test_text_operators import docs_of

# quality classifier


def shares(text):
    """The twelve statistics of a text, one by one."""
    data = text.encode()
    size = max(len(data), 1)
    kinds = (b"#*$%&<>@^~=+_\\", b"|", bytes(range(65, 91)), b"!?", b"0123456789", b".,;:", b"()[]{}/'\"`-")
    out = [math.sqrt(sum(c in kind for c in data) / size) for kind in kinds]
    strip = b".,;:!?#*$%&|<>()[]{}\"'"
    whole = data.split()
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = [(w[:-1] if len(w) > 1 and w[-1] in strip else w).translate(lower) for w in whole]
    n = max(len(words), 1)
    out.append(math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / n))
    out.append(math.log(max(len(set(words)), 1)) - 0.8 * math.log(n) if words else 0.0)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [tuple(words)] if words else []
    out.append(math.sqrt(1 - len(set(windows)) / len(windows)) if windows else 0.0)
    out.append(math.log1p(sum(map(len, whole)) / n))
    return [*out, math.log1p(len(words))]


def log_density(x, mean, cov):
    off = x - mean
    return -0.5 * off @ np.linalg.solve(cov, off) - 0.5 * np.linalg.slogdet(cov)[1]


def test_classifier_equals_its_formulas(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    x = {i: np.array(shares(t)) for i, t in texts.items()}
    known = [(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0 and r.doc_id in x]
    groups = [np.array([x[i] for i, q in known if q == k]) for k in (0, 1)]
    covs = [np.cov(g.T, bias=True) for g in groups]
    both = sum(len(g) * c for g, c in zip(groups, covs)) / len(known)
    shrunk = [0.85 * c + 0.15 * both + 0.02 * np.diag(np.maximum(np.diag(both), 1e-6)) + 1e-6 * np.eye(len(both)) for c in covs]
    odds = math.log((len(groups[1]) + 1) / (len(groups[0]) + 1))
    found = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert set(found) == set(x)
    for i, v in x.items():
        z = (log_density(v, groups[1].mean(axis=0), shrunk[1]) - log_density(v, groups[0].mean(axis=0), shrunk[0]) + odds) / 2
        assert found[i].score == pytest.approx(1 / (1 + math.exp(-max(min(z, 50), -50))), abs=1e-6)
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and found[i].predicted == int(found[i].score >= 0.3)


def test_statistics_of_odd_texts():
    texts = ["", " \n", "a", "A! A, a", "é|日 {x}", "one two three one two three", "x" * 300, None]
    data, offsets = textvec.buffer_of(pa.array(texts))
    assert quality_classifier.statistics(data, offsets) == pytest.approx(np.array([shares(t or "") for t in texts]))


# toxicity


def features_of(text):
    """Words (runs of letters, in lower case) and their prefixes of 4 to 8 bytes, with the hash that names each."""
    lower = bytearray()
    for k, c in enumerate(data := text.encode()):
        latin = k and data[k - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97
        lower.append(c + 32 if 65 <= c <= 90 or latin else c)
    words, word = [], bytearray()
    for c in [*lower, 32]:
        if 97 <= c <= 122 or c >= 128:
            word.append(c)
        elif word:
            words.append(bytes(word))
            word = bytearray()
    name = lambda w, n: (int(textvec.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) + n) % (1 << 64)
    return Counter([name(w, 0) for w in words] + [name(w[:n], n) for w in words for n in (4, 5, 6, 7, 8) if len(w) > n])


def test_scores_equal_the_formula(spark):
    draw = random.Random(6)
    texts = [" ".join(draw.choice(["Nice", "words,", "ugly", "HÄSSLICHkeit", "horrible-things", "x1y"]) for _ in range(draw.randint(0, 30))) for _ in range(40)] + [None, ""]
    keys = sorted({k for t in texts for k in features_of(t or "")})[::2]
    weights, thresholds = np.array([draw.gauss(0, 1) for _ in keys]), np.array([0.2, 1.5, 2.0])
    model = toxicity.OrdinalModel(np.array(keys, dtype=np.uint64), weights, thresholds)
    got = {r.doc_id: r for r in toxicity.score(docs_of(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        counts = features_of(text or "")
        s = sum(w * math.log1p(counts[k]) for k, w in zip(keys, weights) if k in counts)
        above = [1 / (1 + math.exp(t - s)) for t in thresholds]
        assert got[i].severity == pytest.approx(sum(above)) and got[i].p_toxic == pytest.approx(above[0]) and got[i].toxic == (above[0] > 0.3)
    left = {r.doc_id for r in toxicity.drop_toxic(docs_of(spark, texts), model).collect()}
    assert left == {i for i, r in got.items() if not r.toxic}


def loss(x, rows, features, values, grades, n_features, l2):
    """Penalised mean negative log-likelihood, from P(grade <= k) = sigmoid(threshold_k - w.x)."""
    w, thresholds = x[:n_features], x[n_features:]
    total = 0.0
    for i, g in enumerate(grades):
        s = sum(w[f] * v for r, f, v in zip(rows, features, values) if r == i)
        below = [0.0, *[1 / (1 + math.exp(s - t)) for t in thresholds], 1.0]
        total -= math.log(max(below[g + 1] - below[g], 1e-9))
    return total / len(grades) + l2 / 2 * sum(w**2)


def test_fit_is_the_least_loss():
    draw = random.Random(9)
    grades = np.array([draw.randint(0, 3) for _ in range(60)])
    entries = [(i, f, draw.random() + (f == g)) for i, g in enumerate(grades) for f in range(4) if draw.random() < 0.8]
    rows, features, values = (np.array(c) for c in zip(*entries))
    weights, thresholds = toxicity.fit_ordinal(rows, features, values, grades, 4, l2=0.05, steps=3000)
    assert (np.diff(thresholds) > 0).all()
    x = np.concatenate([weights, thresholds])
    of = lambda y: loss(y, rows.tolist(), features.tolist(), values.tolist(), grades.tolist(), 4, 0.05)
    for k in range(len(x)):
        step = np.eye(len(x))[k] * 1e-4
        assert abs(of(x + step) - of(x - step)) / 2e-4 < 2e-3, k
    assert all(of(x + np.array([draw.gauss(0, 0.2) for _ in x])) > of(x) for _ in range(20))


def test_training_and_scoring_of_odd_rows(spark):
    """Null and repeated ids, repeated label rows, null labels: as the docstrings say."""
    texts = ["good plain words " * 3, "vile nasty vile nasty"] * 8
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, "vile nasty", "en"), (0, texts[0], "en"), (1, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _label string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(16)] + [(0, 0), (1, 1), (2, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows)
    by_text = {(r[0], r[1]): s for r, s in zip(rows, found)}
    assert by_text[None, "vile nasty"].doc_id is None and by_text[None, "vile nasty"].toxic and not by_text[0, texts[0]].toxic
    assert [s.toxic for s in found[:16]] == [False, True] * 8
    assert docs.count() - toxicity.drop_toxic(docs, model).count() == sum(s.toxic for s in found)
    quality = quality_classifier.classify(docs, labels.withColumnRenamed("toxic", "quality")).collect()
    assert len(quality) == len(rows) and all(0 <= r.score <= 1 for r in quality) and not any(r.held_out for r in quality if r.doc_id is None)
    same = [r.score for r in quality if r.doc_id == 0]
    assert len(same) == 2 and same[0] == same[1]
    assert quality_classifier.classify(docs.filter("false"), labels.select("doc_id", F.col("toxic").alias("quality"))).count() == 0
