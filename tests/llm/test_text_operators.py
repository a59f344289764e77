"""Operators on texts: brute force, exact round trips, held-out accuracy and edge rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from boxwright.llm import html_extract, license_scan, near_dedup, packing, pieces, quality_classifier, quality_rules, textvec, toxicity, url_filter
from boxwright.llm.queries import queries

DOCS = "doc_id bigint, text string, lang string, _id int, rep string, kept string, n_words string"


def docs_of(spark, texts):
    """A table with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, "en", 1, "x", "y", "z") for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, tiny, repeated and very long texts."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    return docs_of(spark, [None, "", " \n\t", "one", "one", "a b c", "A B C", long, long + " tail", "é\u0000\u2003x y\u00a0z"])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("doc_id < 0")


def words(text):
    return (text or "").encode().split()


def test_word_spans_and_hashes():
    texts = ["a bb  ccc", "", " x", "bb", None, "\ta\n"]
    data, offsets = textvec.buffer_of(pa.array(texts))
    starts, ends, before = textvec.word_spans(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [w for t in texts for w in words(t)]
    assert np.diff(before).tolist() == [len(words(t)) for t in texts]
    h = textvec.span_hashes(data, starts, ends)
    assert h[1] == h[4] and h[0] == h[5] and len(set(h.tolist())) == 4


# quality rules


def expected_rules(rows, trusted, buckets, prior=1.0, deviations=3.0):
    x64 = lambda *ws: __import__("functools").reduce(lambda seed, w: xxhash.xxh64(w, seed=seed).intdigest(), ws, 42)
    bucket = lambda h: (h - (1 << 64) if h >= 1 << 63 else h) % buckets
    grams = {i: [bucket(x64(a)) for a in words(t)] + [bucket(x64(a, b)) for a, b in zip(words(t), words(t)[1:])] for i, t in rows}
    fold = {i: zlib.crc32(str(i).encode()) % 2 for i, _ in rows}
    raw = Counter(g for v in grams.values() for g in v)
    out = {}
    halves = [Counter(g for i, v in grams.items() if i in trusted and fold[i] != f for g in v) for f in (0, 1)]
    for i, v in grams.items():
        t = halves[fold[i]]
        n, m = sum(t.values()), sum(raw.values())
        ratio = lambda g: np.log(((t[g] / n / (raw[g] / m) if n else 1.0) + prior) / (1 + prior))  # noqa: B023, E731
        out[i] = float(np.mean([ratio(g) for g in v])) if v else 0.0
    return out


def test_quality_rules_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 10, 80, 200])))) for k in range(60)]
    rows += [(60 + k, " ".join(f"zz{rng.randint(0, 9999)}###" for _ in range(100))) for k in range(6)]
    rows += [(70, "la la la " * 40), (71, None), (72, "x\nx\n \nx y\n" * 30), (73, "#*$%&|<> a#b \u00a7 ^ ~ <<>>")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    trusted = [i for i, t in rows if t and i < 60 and i % 2]
    found = {r.doc_id: r for r in quality_rules.judge(table, spark.createDataFrame([(i,) for i in trusted], "doc_id bigint"), buckets=1 << 12).collect()}
    want = expected_rules(rows, set(trusted), 1 << 12)
    for i, text in rows:
        w = words(text)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = Counter(tri)
        repeated = {k + j for k, t in enumerate(tri) if count[t] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if x.split()]
        r = found[i]
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert r.score == pytest.approx(want[i], abs=1e-6)
        assert r.kept == (not r.base_failed and r.score >= r.threshold)
    assert not any(found[60 + k].kept for k in range(6))


def test_quality_rules_on_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint")
    rows = {r.doc_id: r for r in quality_rules.judge(odd, none).collect()}
    assert len(rows) == 10 and rows[0].n_words == 0 and rows[0].base_failed and rows[7].n_words == 60_000
    assert quality_rules.judge(empty, none).count() == 0


# near-duplicates


def brute_components(rows, size, num):
    sets = {}
    for i, t in rows:
        w = words(t.lower() if t and t.isascii() else t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, num):
    rng = random.Random(size)
    vocab = [f"w{k}" for k in range(4000)]
    rows, k = [], 0
    for group in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 9, 40])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [text[at], rng.choice(vocab)]])
            rows.append((k, " ".join(text).upper() if rng.random() < 0.1 else " ".join(text)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "w1 w2"), (k + 3, "W1  w2"), (k + 4, "w2 w1")]
    want, n = brute_components(rows, size, num)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in near_dedup.near_duplicates(table, size=size, num=num).collect()}
    assert {i: r.component_id for i, r in found.items()} == want
    assert {i: r.n_shingles for i, r in found.items()} == n
    assert all(r.kept == (r.component_id == i) for i, r in found.items())


def test_near_duplicates_on_odd_rows(spark, odd, empty):
    rows = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(odd).collect()}
    assert rows == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9}
    assert near_dedup.near_duplicates(empty).count() == 0
    null = near_dedup.near_duplicates(odd.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))).filter("doc_id is null").collect()
    assert len(null) == 4 and all(r.kept and r.component_id is None for r in null)


def test_near_duplicates_with_repeated_ids(spark, monkeypatch):
    """Rows are judged by their own texts, and each class has one set, whatever ids repeat."""
    text = lambda a, n=60: " ".join(f"{a}{k}" for k in range(n))
    rows = [(5, text("a"))] * 30 + [(6, text("a") + " tail")] + [(7, text(c)) for c in "bcdef"] + [(8, text("b") + " tail"), (9, text("g")), (4, text("c") + " tail")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    sizes = []
    compare = near_dedup._compare
    monkeypatch.setattr(near_dedup, "_compare", lambda rows, sets, *a: sizes.append((sets.count(), sets.select("rep").distinct().count())) or compare(rows, sets, *a))
    found = near_dedup.near_duplicates(table).collect()
    assert all(a == b == 6 for a, b in sizes) and len(sizes) == 2
    assert Counter((r.doc_id, r.component_id, r.kept) for r in found) == {(5, 5, True): 30, (6, 5, False): 1, (7, 7, True): 4, (7, 4, False): 1, (8, 7, False): 1, (9, 9, True): 1, (4, 4, True): 1}


def test_pipeline_judges_rows(spark, tmp_path):
    """Null and repeated ids: every row by its own verdict, and one row of each group."""
    import corpus_pipeline

    text = lambda a, n=60: " ".join(f"{a}{k}" for k in range(n))
    rows = [(None, "too short"), (1, text("a")), (1, "too short"), (2, text("b")), (2, text("b")), (3, text("b") + " tail"), (None, text("c")), (None, text("c")), (4, text("c") + " tail"), (None, text("d")), (None, text("d"))]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in good.collect()) == Counter(r for r in rows if r[1] != "too short")
    kept = corpus_pipeline.drop_near_duplicates(spark, good, str(tmp_path))
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == {(1, text("a")): 1, (2, text("b")): 1, (4, text("c") + " tail"): 1, (None, text("d")): 1}


def test_collections_bound_the_misses():
    for s in (0.8, 0.85):
        m = near_dedup.collections_for(s, 3)
        p = s**3
        assert (1 - p) ** m + m * p * (1 - p) ** (m - 1) <= 2e-5


# packing and pieces


def test_packing_holds_every_id_once(spark, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.byte_bpe_path())
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in odd.select("doc_id", "text").collect()}
    rows = packing.pack(odd.repartition(2)).collect()
    for i, ids in want.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())
    assert packing.pack(empty).count() == 0


def test_segments_are_safe_to_encode_alone():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.byte_bpe_path())
    cache = packing.segment_encoder(packing.byte_bpe_path())
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "'ll", "é", "\u2003", "\u00a0", "1", "!", "日", "<|endoftext|>", "\t"]) for _ in range(20))
        data, offsets = textvec.buffer_of(pa.array([text]))
        assert cache.ids_of(data, offsets)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_equal_the_library_and_come_back(spark, odd, sf_dir):
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_path())
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    texts += [r.text for r in odd.select("text").collect()] + ["a  b", "日本 \U0001f600", "--------=====", " " * 40 + "x", "<0x41> <s>", "aaaaaaaaaaaaa"]
    found = {k: ids.tolist() for k, ids in pieces.ids_of_texts(pieces.piece_path(), pa.array(texts))}
    assert [found[k] for k in range(len(texts))] == [reader.encode(t or "") for t in texts]
    encoded = pieces.encode(odd)
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert back == {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").collect()}
    assert all(r.same for r in pieces.round_trip(odd).collect())


# classifiers


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries()["op8_quality_classifier"](spark, d).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs, labels.filter(~held))
    assert (np.diff(model.thresholds) > 0).all()
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "said").join(labels.filter(held), "doc_id").collect()
    assert np.mean([r.said for r in rows if r.toxic]) > 0.85
    assert np.mean([r.said for r in rows if not r.toxic]) < 0.01


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert quality_classifier.classify(odd, labels).count() == 10
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(odd, labels.filter("false")).collect())
    assert quality_classifier.classify(empty, labels).count() == 0
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == 10 and toxicity.score(empty, model).count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert not any(r.toxic for r in toxicity.score(odd, toxicity.train(odd, labels.filter("false"))).collect())


# pages, urls, licenses


def test_html_model_and_odd_pages():
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>Some <b>bo</b>ld text,\n with words.<br>More text here.</p></article><footer>&copy; x</footer></body></html>"
    model = html_extract.fit([page.replace("words", f"words{k}") for k in range(5)])
    assert model.extract(page) == "Title Some bold text, with words. More text here."
    assert model.extract(None) == "" == model.extract("")
    assert model.extract("<p>cut &am") in ("cut &am", "") and isinstance(model.extract("<div" * 50), str)
    deep = "<div>" * 3000 + "<p>Deep text, with words and marks.</p>"
    assert isinstance(model.extract(deep), str)


def test_extraction_loses_nothing_to_unclosed_elements():
    plain = "<html><body>{}<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>Some text, with words.{}</p><p>More text, here.</p></article><footer>Foot</footer></body></html>"
    model = html_extract.fit([plain.format("", "").replace("words", f"words{k}") for k in range(5)])
    want = "Title Some text, with words. More text, here."
    assert model.extract(plain.format("", "")) == want
    for ahead in (
        "<form><datalist id=x><option value=a><option value=b></datalist></form>",
        "<form><datalist id=x><option value=a><option value=b></form>",
        "<div><noscript><img src=x></div>", "<div><object data=x><param name=y></div>", "<div><svg><path d=x></div>", "<div><math><mi></div>", "<svg><path d=x>", "<math><mrow>",
        "<form><select><option>One<option>Two</form>", "<select><option>One<optgroup><option>Two", "<div><template><p>Hidden</div>", "<script>if (a < b) '<p>'</script x>", "<textarea><p></textarea/>",
    ):
        assert model.extract(plain.format(ahead, "")) == want, ahead
    assert model.extract(plain.format("", " Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.")) == "Title Some text, with words. Then x=2 holds. More text, here."
    for inside in ("noscript", "object"):
        assert "A fallback, with words." in model.extract(plain.format("", "").replace("<p>More", f"<{inside}><p>A fallback, with words.</p></{inside}><p>More"))
    assert model.extract(plain.format("", "<select><option>One</select><template><b>Two</b></template>")) == want
    options = html_extract.parse("<datalist><option>One<option>Two</datalist>")
    assert [options[0][node] for node, _, _ in options[3]] == ["option", "option"] and options[1] == [-1, 0, 1, 1]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    parents = np.array([-1, 0, 0, 1, 1, 2])
    unary, pair = rng.normal(size=6), rng.normal(size=(2, 2))
    total, on = 0.0, np.zeros(6)
    for bits in range(64):
        s = [(bits >> k) & 1 for k in range(6)]
        p = np.exp(sum(unary[k] * s[k] for k in range(6)) + sum(pair[s[parents[k]], s[k]] for k in range(1, 6)))
        total += p
        on += p * np.array(s)
    assert np.allclose(html_extract.marginals(parents, unary, pair), on / total)


def test_extraction_of_the_table(spark):
    import html
    import re

    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in queries()["op9_html_extraction"](spark, d).collect():
        inner = pages[r.page_id].split("<article>", 1)[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner))
        assert r.text == " ".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_cascade_is_exact(spark):
    keys = [f"h{k}.example.com/p{k % 7}/" for k in range(3000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    for listed in (keys[::3], keys[:2], [], keys):
        cascade = url_filter.build_cascade(universe, listed)
        assert {r.key for r in universe.filter(cascade.contains(F.xxhash64("key"))).collect()} == set(listed)


def test_two_hundred_thousand_blocked_hosts(spark):
    """A list as long as a public blocklist, one in a thousand of it in the urls; long urls too."""
    hosts = [f"ad{k}.example{k % 97}.net" for k in range(200_000)]
    rows = [(k, f"https://www.{h if k % 2 else 'fine' + h}/a" + "/long" * (2000 if k < 4 else 1)) for k, h in enumerate(hosts[::1000])]
    found = url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), (), (), hosts).collect()
    assert {r.page_id: r.verdict for r in found} == {k: "block" if k % 2 else "allow" for k, _ in rows}


def test_urls_on_odd_rows(spark):
    rows = [(1, None), (2, "nothing"), (3, "http://WWW.Example.com/en/x?y"), (4, "https://a.b.net/es/"), (5, "x://com"), (6, "http://com/"), (7, "a://b://c/d"), (7, "a://b://c/d"), (None, "http://x.ads-track.example.org/")]
    table = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(table, ("com/", "www.example.com/en/"), ("net/es/", "example.com/en/"), ("ads-track.example.org",)).collect()}
    assert found[1] == found[2] == ("", "", None, "allow")
    assert found[3] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert found[4][2:] == ("net/es/", "block") and found[5][2] is None and found[6][2] == "com/"
    assert found[7][:2] == ("b:", "//c/d") and found[None][2:] == (None, "block")
    assert url_filter.judge_urls(table.filter("false"), ("com/",), ()).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(table, (), ()).collect()} == {"allow"}


def test_licenses_equal_brute_force(spark, odd, empty):
    t = license_scan.TEMPLATES
    rng = random.Random(2)
    filler = lambda n: " ".join(f"f{rng.randint(0, 99)}" for _ in range(n))
    texts = [filler(30) + " " + t[k].upper() + " " + filler(n) for k in t for n in (0, 400)] + [filler(100), t["MIT-grant"][:120], t["MIT-grant"].replace("limitation", "x"), None, ""]
    found = {(r.doc_id, r.license): r.containment for r in license_scan.scan(docs_of(spark, texts)).collect()}
    shingle = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    split = lambda s: __import__("regex").findall(r"[\p{L}\p{N}]+", (s or "").lower())
    want = {}
    for i, text in enumerate(texts):
        for name, template in t.items():
            share = len(shingle(split(text)) & shingle(split(template))) / len(shingle(split(template)))
            if share >= 0.8:
                want[i, name] = share
    assert set(found) == set(want), (set(found) - set(want), set(want) - set(found))
    assert found == pytest.approx(want)
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0 and license_scan.scan(odd, {}).count() == 0


def test_license_bands_bound_the_misses():
    rng = random.Random(9)
    for n, longest in ((1, 5), (4, 12), (20, 35), (300, 700)):
        template = {rng.getrandbits(64) - (1 << 63) for _ in range(n)}
        bits = license_scan._bits([template], 0.8, 1e-3, 2 * longest)
        bands, missed, held = set(license_scan.bands_of(template, bits)), 0, -(-8 * n // 10)
        for _ in range(400):
            window = set(rng.sample(sorted(template), held)) | {rng.getrandbits(64) - (1 << 63) for _ in range(2 * longest - held)}
            missed += not bands & set(license_scan.bands_of(window, bits))
        assert missed <= 3, (n, bits, missed)


def test_licenses_by_row(spark):
    """Null and repeated ids: each row has its own result."""
    notice = license_scan.TEMPLATES["BSD-3-Clause"]
    rows = [(None, notice), (None, "x " * 40 + notice), (7, notice), (7, notice), (7, "nothing here")]
    found = Counter((r.doc_id, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert found == {(None, "BSD-3-Clause"): 2, (7, "BSD-3-Clause"): 2}


def thue_morse(order, letters):
    """Words that a sum of powers of a base, modulo a power of two, doesn't tell from their mirror."""
    return "".join(letters[bin(k).count("1") % 2] for k in range(1 << order))


def test_hashes_tell_thue_morse_words_apart(spark):
    texts = [thue_morse(k, x) for k in (3, 4, 5, 6, 10, 12) for x in ("ab", "ba")]
    data, offsets = textvec.buffer_of(pa.array(texts))
    for seed in (0, 1):
        assert len(set(textvec.span_hashes(data, offsets[:-1], offsets[1:], seed=seed).tolist())) == len(texts)
    rows = near_dedup.near_duplicates(docs_of(spark, texts)).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in rows)
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.byte_bpe_path())
    cache = packing.segment_encoder(packing.byte_bpe_path())
    ids, before = cache.ids_of(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(before, before[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    reader = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_path())
    found = {k: ids.tolist() for k, ids in pieces.ids_of_texts(pieces.piece_path(), pa.array(texts))}
    assert [found[k] for k in range(len(texts))] == [reader.encode(t) for t in texts]


def test_segments_with_one_hash_keep_their_ids(monkeypatch):
    """The second hash tells segments apart that share the first."""
    real = textvec.span_hashes
    monkeypatch.setattr(textvec, "span_hashes", lambda data, starts, ends, seed=0: real(data, starts, ends, seed) if seed else real(data, starts, ends) % np.uint64(3) + np.uint64(1))
    cache = textvec.SegmentCache(lambda segments: [list(x) for x in segments])
    for text in ("one two three four five", "six one seven two", "two two eight"):
        data, offsets = textvec.buffer_of(pa.array([text]))
        assert bytes(cache.ids_of(data, offsets)[0].tolist()).decode() == text
