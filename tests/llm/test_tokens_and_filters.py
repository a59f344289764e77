"""Alignment of tokenizers, filter audit and token counts against brute force and the libraries."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxwright.llm import alignment, filter_audit, textvec, token_counts
from tests.llm.test_text_operators import docs_of


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def odd_texts(sf_dir, spark):
    draw = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    texts += [None, "", " ", "  ", "a", "<|endoftext|> x<s></s>", "▁a b", "a▁", "日本語 テキスト\n\n  x", "\x00\r\n x", "one two", "one two"]
    texts += ["".join(draw.choice("abc é日😀\n\t<|>") for _ in range(2000)), "".join(draw.choice("a b") for _ in range(2000)), "日本" * 600, "a" * 5000, " " * 3000]
    return [*texts, " ".join(f"word{k}" for k in range(3000))]


# tokenizer alignment


def brute_alignment(texts, pieces):
    level = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    level.encode_special_tokens = True
    byte = {c: b for b, c in bytes_to_letters().items()}
    found, counts = [], Counter()
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a, b = (level.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        raw_a = [bytes(byte[c] for c in level.id_to_token(i)) for i in a]
        raw_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            found.append(None)
            continue
        end_a = {int(e): k for k, e in enumerate(np.cumsum([len(x) for x in raw_a]))}
        end_b = {int(e): k for k, e in enumerate(np.cumsum([len(x) for x in raw_b]))}
        ends, x, y, groups, links = sorted(set(end_a) & set(end_b)), 0, 0, [], []
        for e in ends:
            groups.append(",".join(map(str, a[x : end_a[e] + 1])) + "|" + ",".join(map(str, b[y : end_b[e] + 1])))
            links.append((a[end_a[e]], b[end_b[e]]))
            x, y = end_a[e] + 1, end_b[e] + 1
        counts.update(links)
        found.append((len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    row = lambda f: (f[0], f[1], len(f[2]), len(f[2]), sum(counts[p] == best[p[1]] for p in f[2]), sum(counts[p] for p in f[2]), f[3])
    return [row(f) if f else (0, 0, 0, 0, 0, 0, "") for f in found]


def bytes_to_letters():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def test_alignment_equals_brute_force(spark, sf_dir, pieces):
    texts = odd_texts(sf_dir, spark)
    want = brute_alignment(texts, pieces)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align_and_score(docs_of(spark, texts).repartition(3)).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert alignment.align_and_score(docs_of(spark, ["x"]).filter("doc_id < 0")).count() == 0


def test_runs_of_spaces_are_encoded_whole(pieces):
    """Pieces join spaces with each other, so a cut within a run of them gives other ids."""
    draw = random.Random(5)
    texts = ["x  1", "   3.14", " 1,000", "a  ф", "é   é", "x\n  y", "z ", "▁ a", *("".join(draw.choice(["a", "1", "é", "日", "."] + [" ", "\n"] * 3) for _ in range(20)) for _ in range(300))]
    level = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    aligner = alignment.aligner_of(None, None)
    data, bounds = alignment._with_space(*textvec.buffer_of(pa.array(texts)))
    for vocabulary, encode in ((aligner.a, lambda t: level.encode(" " + t, add_special_tokens=False).ids), (aligner.b, pieces.encode)):
        ids, before = vocabulary.cache.ids_of(data, bounds)
        assert [ids[x:y].tolist() for x, y in zip(before[:-1], before[1:], strict=True)] == [encode(t) for t in texts]


def test_long_texts_are_aligned_in_parts(spark, sf_dir, pieces):
    texts = [t for t in odd_texts(sf_dir, spark) if t]
    columns = ["doc_id", "n_a", "n_b", "n_links", "groups_sha256", "links"]
    rows = lambda block: {r.doc_id: tuple(r) for r in alignment.align(docs_of(spark, texts), block=block).select(*columns).collect()}
    assert rows(700) == rows(1_000_000)


def test_lockstep_from_unsafe_places():
    """Lanes begin only where both have an end."""
    a, b = np.array([300, 520, 700, 1100]), np.array([200, 520, 900, 1100])
    assert alignment.lockstep(a, b, np.array([0, 300, 520, 900])).tolist() == [-1, 1, -1, 3]
    assert alignment.lockstep(a[:0], b[:0], np.zeros(0, int)).tolist() == []


def test_alignment_of_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "one two"), (5, "one two"), (5, "one two"), (5, None)], "doc_id bigint, text string")
    got = sorted(map(tuple, alignment.align_and_score(rows).select("doc_id", "n_links", "n_best", "count_sum").collect()), key=str)
    assert got == sorted([(None, 2, 2, 6), (5, 2, 2, 6), (5, 2, 2, 6), (5, 0, 0, 0)], key=str)


# filter audit


def brute_audit(rows, labels):
    split = lambda t: t.encode().split()
    text = lambda r: r[1] or ""
    least = {}
    for r in rows:
        if r[0] is not None:
            least[text(r)] = min(least.get(text(r), r[0]), r[0])
    rules = {
        "A": lambda r: len(split(text(r))) < 50,
        "B": lambda r: 100 * len(set(split(text(r)))) < 65 * len(split(text(r))),
        "C": lambda r: 100 * sum("A" <= c <= "Z" for c in text(r)) > 5 * len(text(r)),
        "D": lambda r: any(c in "#$%&*|" for c in text(r)),
        "E": lambda r: r[0] is not None and least[text(r)] < r[0],
    }
    fails = [{f for f, rule in rules.items() if rule(r)} for r in rows]
    orders, shapley, out = ["".join(p) for p in permutations("ABCDE")], Counter(), {}
    for o in orders:
        for r, failed in zip(rows, fails):
            first = next((f for f in o if f in failed), None)
            if first:
                shapley[r[2] or "", first] += 1
    for part in {r[2] or "" for r in rows}:
        here = [(r, failed) for r, failed in zip(rows, fails) if (r[2] or "") == part]
        for o in orders:
            for k, f in enumerate(o):
                left = [(r, x) for r, x in here if not x & set(o[:k])]
                gone = [r for r, x in left if f in x]
                lost = lambda which: sum(any(i == r[0] and (q, t)[which] == 1 for i, q, t in labels) for r in gone)  # noqa: B023, E731
                redundant = sum(f in x for _, x in here) - len(gone)
                out[part, o, k + 1] = (len(left) - len(gone), len(gone), redundant, sum(x == {f} for _, x in here), lost(0), lost(1), shapley[part, f])
    return out


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "ROWS_OF_A_TEXT", 3)
    draw = random.Random(4)
    texts = [None, "", "x", "A # b", " \n ", " é a", *[" ".join(draw.choice(["a", "Bc", "d$", "e", "FGH", f"w{k}"]) for k in range(n)) for n in (3, 60, 49, 50, 120)], *[" ".join(f"u{k}" for k in range(n)) for n in (49, 50, 80)]]
    rows = [(draw.choice([None, *range(40)]), draw.choice(texts), draw.choice(["a", "b", None, ""])) for _ in range(150)]
    rows += [(k, "the same " * 30, "a") for k in range(200, 230)] + [(300, "q", "b")] * 3
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for k in [*range(30), *range(20), *range(200, 215)]] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"part": F.lit(1), "bits": F.lit(2), "h": F.lit(3), "n": F.lit("x")}).repartition(4)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = brute_audit(rows, labels)
    for most in (1_000_000, 0):  # hashes broadcast, and joined by a shuffle
        monkeypatch.setattr(filter_audit, "BROADCAST_HASHES", most)
        got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, table).collect()}
        assert got == want
    assert filter_audit.audit(docs.filter("false"), table).count() == 0
    assert filter_audit.audit(docs, table.filter("false")).agg(F.sum("good_lost")).first()[0] == 0


# token counts


@pytest.mark.parametrize("chunk, overlap", [(7, 3), (200, 20), (32_768, 1024)])
def test_counts_equal_the_library(spark, sf_dir, pieces, chunk, overlap):
    texts = odd_texts(sf_dir, spark) if overlap > 3 else [t if t is None else t[:400] for t in odd_texts(sf_dir, spark)]
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.count_tokens(docs_of(spark, texts).repartition(3), limit=500, chunk=chunk, overlap=overlap).collect()}
    counts = [len(pieces.encode(t or "")) for t in texts]
    assert [got[k] for k in range(len(texts))] == [(len((t or "").encode()), n, n > 500) for t, n in zip(texts, counts)]


def test_counts_of_null_and_repeated_ids(spark, pieces):
    long = "some words, " * 900
    rows = spark.createDataFrame([(None, long), (5, long), (5, long), (None, None)], "doc_id bigint, text string")
    n = len(pieces.encode(long))
    got = sorted(map(tuple, token_counts.count_tokens(rows, chunk=512, overlap=32).select("doc_id", "n_tokens").collect()), key=str)
    assert got == sorted([(None, n), (5, n), (5, n), (None, 0)], key=str)
    assert token_counts.count_tokens(rows.filter("false"), chunk=512, overlap=32).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        token_counts.count_tokens(rows, chunk=5, overlap=9)
