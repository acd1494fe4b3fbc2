"""Operators on single documents or pages."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quiltgraph.llm import boosting, common, dom, language, pieces, pii, quality, queries, rules, tokenfile

WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def base_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


def test_pii_base(spark, sf, docs):
    truth = {r.doc_id: base_spans(r.text) for r in docs.collect()}
    for r in queries.op1_pii(spark, sf).collect():
        spans = truth[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [spans.count(f"{k}:") for k in BASE]
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_pii_odd_texts(spark, odd, empty):
    texts = [None, "", "a@b.c+d@e.f x@y..z é q@r.st-", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", "4111 1111 1111 1111", "+1 (555) 123-4567 ++49 30 1234567..8 +12", "x" * 20_000 + "@a.b", "7" * 30_000, "1.2" * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("base", F.lit(1)).withColumn("spans", F.lit(2))
    for r in pii.find(df).select("n", pii.listed("base").alias("b")).collect():
        assert r.b == base_spans(texts[r.n])
    assert pii.find(odd).count() == odd.count() and pii.find(empty).count() == 0


def test_pii_adds_and_redacts(spark):
    df = spark.createDataFrame([("call (555) 123-4567 now or mail bob at example dot com",), ("on 2024-01-02 we read pages 120-130 of version 3.4.5",), (None,)], "text string")
    got = [r.redacted for r in pii.redact(df).select("redacted").collect()]
    assert got == ["call [PHONE] now or mail [EMAIL]", "on 2024-01-02 we read pages 120-130 of version 3.4.5", None]


def test_running_folds(spark):
    """Running sums and maxima of arrays of any length, across blocks."""
    rng = random.Random(1)
    rows = [([rng.randrange(-9, 99) for _ in range(n)],) for n in (0, 1, 2, 255, 256, 257, 600, 5000)]
    df = spark.createDataFrame(rows, "x array<int>")
    got = df.select(pii.running(F.col("x"), lambda a, b: a + b, F.lit(0)), pii.running(F.col("x"), F.greatest, F.lit(-100))).collect()
    assert [list(map(list, r)) for r in got] == [[np.cumsum(x).tolist(), np.maximum.accumulate(np.array(x, int)).tolist()] for (x,) in rows]


def brute_features(kind, value, before, after):
    number, before = re.sub("[^0-9]", "", value), before.lower()
    parts = [p for p in re.split("[^0-9A-Za-z]+", value) if p]
    has = lambda p, x: float(regex.search(p, x) is not None)
    found = {
        "kind": kind, "length": len(value), "digits": len(number), "letters": len(re.sub("[^A-Za-z]", "", value)), "groups": len(parts), "first": len(parts[0]), "last": len(parts[-1]), "paren": "(" in value,
        "luhn": 13 <= len(number) <= 19 and luhn(number), "brand": has(pii.BRAND, number), "dashes": value.count("-"), "dots": value.count("."), "spaces": value.count(" "), "slashes": value.count("/") + value.count("_"), "colons": value.count(":"),
        "date": has(pii.DATE, value), "spelled": has(pii.SPELLED, value), "ending": has(pii.ENDING, value), "zero": number.startswith("0"), "distinct": len(set(value)), "hex": has("^[0-9a-f]+$", value), "cases": has("[a-z]", value) + has("[A-Z]", value) + has("[0-9]", value),
        "quoted": has(r"[\x22']$", before), "assigned": has(r"[:=]\x20{0,2}[\x22']?$", before), **{f"near_{k}": has(p, before) for k, p in pii.CONTEXTS.items()}, "joined": has(r"[0-9A-Za-z][./_+-]?$", before) + has(r"^[./_+-]?[0-9A-Za-z]", after), "percent": has(r"^[\x20]?[%€$£]|^[,.][0-9]", after),
    }
    return [float(found[k]) for k in pii.FEATURES]


def brute_added(text, model):
    """Added spans of a text: candidates of every generator one by one, scored, taken greedily."""
    base = [tuple(map(int, s.split(":")[1:])) for s in base_spans(text).split(",") if s]
    candidates = set()
    for kind, pattern, _ in pii.GENERATORS.values():
        at = 0
        for m in regex.finditer(pattern, text):
            before = text[at : m.start()]
            candidates.add((pii.ALL.index(kind), m.start(), m.end(), (text[:at] + before)[-pii.BEFORE :] if len(before) < pii.BEFORE else before[-pii.BEFORE :], text[m.end() : m.end() + pii.AFTER]))
            at = m.end()
    rows = [c for c in sorted(candidates) if all(c[2] <= a or c[1] >= b for a, b in base)]
    if not rows:
        return []
    margin = model.trees.margin(np.array([brute_features(k, text[a:b], before, after) for k, a, b, before, after in rows]))
    taken = []
    for m, (k, a, b, *_) in sorted(zip(margin, rows), key=lambda x: (-x[0], x[1][:3])):
        if m >= model.thresholds[k] and all(b <= c or a >= d for _, c, d in taken):
            taken.append((k, a, b))
    return sorted(taken)


def planted(docs, n):
    """Sentences with spans, and with numbers that are none, put between the words of documents: (text, planted (kind, start, end))."""
    rng, found = random.Random(6), []
    sentences = pii.written_sentences(n, seed=77)
    for i, (said, kind, start, end) in enumerate(sentences):
        words = docs[i % len(docs)].split()[:200]
        at = rng.randrange(len(words) + 1)
        head = " ".join(words[:at]) + "\n"
        found.append((head + said + "\n" + " ".join(words[at:]), [(kind, len(head) + start, len(head) + end)] if kind >= 0 else []))
    return found


def test_pii_added_by_brute_force(spark, docs):
    """Added spans equal those found one candidate at a time; most of what is planted is found, little else is."""
    rows = planted([r.text or "" for r in docs.collect()], 1200)
    model = pii.default_model(spark)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "n int, text string")
    got = {r.n: (sorted((s.kind, s.start, s.end) for s in [*r.spans, *r.secrets] if s.score != 2.0), [(s.start, s.end) for s in r.base]) for r in pii.find(df, model=model).collect()}
    for i in range(0, len(rows), 4):
        assert got[i][0] == brute_added(rows[i][0], model), rows[i][0]
    right = wrong = missed = 0
    for i, (_, truth) in enumerate(rows):
        added, base = got[i]
        near = lambda s, t: s[0] == t[0] and abs(s[1] - t[1]) <= 1 and abs(s[2] - t[2]) <= 1
        own = [s for s in added if any(near(s, t) for t in truth)]
        right, wrong = right + len(own), wrong + len(added) - len(own)
        missed += sum(not any(near(s, t) for s in added) and not any(a < t[2] and b > t[1] for a, b in base) for t in truth)
    print("added spans: precision", right / (right + wrong), "recall", right / (right + missed), "of", right + missed)
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.85


def test_pii_long_texts(spark):
    """Texts of thousands of spans take seconds, and columns of any name stay."""
    began = time.time()
    texts = [" ".join(f"a{i}@b{i}.com" for i in range(20_000)), " ".join(f"call (555) {i % 900 + 100}-{i % 9000 + 1000} or a{i}@b.org, 10.0.{i % 200}.7" for i in range(4000)), " ".join(str(i) for i in range(30_000))]
    df = spark.createDataFrame([(t, i, 1, 2, 3, 4) for i, t in enumerate(texts)], "text string, __text int, base int, row int, loose int, digit int")
    got = sorted(pii.redact(df).select("__text", "row", "loose", "digit", F.size("base").alias("n"), F.size("spans").alias("m"), "redacted").collect())
    assert [tuple(r)[:4] for r in got] == [(i, 2, 3, 4) for i in range(3)]
    assert [(r.n, r.redacted.count("[EMAIL]")) for r in got] == [(20_000, 20_000), (8000, 4000), (0, 0)]
    assert got[1].m >= 11_000 and got[1].redacted.startswith("call [PHONE] or [EMAIL], [IP] call")
    assert time.time() - began < 90


def test_boosting_compiles(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x, y)
    assert ((model.margin(x) > 0) == y).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r[0] for r in df.select(model.column([F.col(c) for c in "abc"])).collect()]
    assert np.allclose(got, model.margin(x))


@pytest.fixture(scope="module")
def codec():
    return pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(codec, docs):
    texts = [r.text for r in docs.collect()] + ["", "  hello  world ", " ", "x\x00y\nz", "日本語 テスト😀", "a" * 300, " " * 70 + "x", "▁a"]
    expected = codec.library.encode(texts)
    assert [codec.encode(t).tolist() for t in texts] == expected
    assert [codec.decode(np.array(i, np.int32)) for i in expected] == [codec.library.decode(i) for i in expected]
    assert all(codec.decode(codec.encode(t)) == t for t in texts if "▁" not in t)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdefthe ▁é\n0日"), max_size=60))
def test_streaming_equals_the_library(text):
    c = pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
    assert list(c.stream(c.normalize(text))) == c.library.encode(text)


def test_stream_holds_a_window(codec):
    committed, fed = [], []

    def characters():
        for ch in "▁the▁quick▁brown▁fox" * 500:
            fed.append(ch)
            yield ch

    lag = 0
    for i in codec.stream(characters()):
        committed.append(i)
        lag = max(lag, len(fed) - sum(len(codec.names[x]) for x in committed))
    assert lag <= 6 * codec.longest


def test_pieces_are_merged_once_and_not_for_each_pair(docs, monkeypatch):
    """op2: whether two pieces can be neighbours follows from the merges of each; words give what the stream gives."""
    calls = []
    monkeypatch.setattr(pieces.Codec, "merged", lambda self, text, *a, f=pieces.Codec.merged: calls.append(text) or f(self, text, *a))
    c = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r.text or "" for r in docs.limit(200).collect()] + ["x\u0000é\U0001f600 aaaaaaa  \n\n-- ***"]
    for text in texts:
        assert c.encode(text).tolist() == list(c.stream(c.normalize(text)))
    assert len(calls) == len(set(calls)) and set(calls) <= set(c.names)
    for pair, fits in list(c.fits.items())[:3000]:
        before, piece = (c.names[pair // len(c.names) - 1] if pair >= len(c.names) else ""), c.names[pair % len(c.names)]
        assert fits == (c.merged(before + piece) == [x for x in (before, piece) if x])


def test_pieces_query(spark, odd, empty, codec):
    got = pieces.encode(odd, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert all(r.n_tokens == len(r.ids) for r in got) and pieces.encode(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def article(source):
    inner = source[source.index("<article>") + 9 : source.index("</article>")]
    import html

    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def test_html_pages(spark, sf):
    truth = {r.page_id: article(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op3_html(spark, sf).collect()
    assert {r.page_id: r.text for r in got} == truth and all(r.n_chars == len(r.text) for r in got)


def test_html_raw_elements_after_wide_letters(spark, empty):
    """A letter whose lower case is two code points does not shift what follows a script; tables may be empty."""
    source = "<html><body><article><p>" + "İ" * 20 + "</p><SCRIPT>var a = '<p>no</p>';</sCript><p>second paragraph here with words</p></article></body></html>"
    assert dom.extract(source, dom.default_model()) == "İ" * 20 + " second paragraph here with words"
    none = spark.createDataFrame([], "page_id bigint, url string, html string, text int")
    assert dom.main_text(none).count() == 0 and dom.main_text(none).columns == ["page_id", "url", "text", "n_chars"]
    long = "<article>" + "<p>some words &amp; more</p>" * 40_000 + "</article>"
    assert dom.extract(long, dom.default_model()) == " ".join(["some words & more"] * 40_000)


def test_html_pages_of_plain_blocks():
    """Without containers or class words the words of short blocks tell."""
    prose = "<p>The river rose for three days before the bridge was closed, and nobody in the village slept.</p>"
    for apart in ("Copyright 2020 us", "&copy; 2021 River News", "We use cookies to make this site better", "Subscribe to our newsletter", "Share this story"):
        source = f"<html><body><div>{prose}{prose}</div><div>{apart}</div></body></html>"
        text = dom.extract(source, dom.default_model())
        assert text == " ".join([re.sub("<[^>]*>", "", prose)] * 2), (apart, text)
    long = "<p>In the end the copyright of the book went to the school, whose teachers had kept every page of it in a box for years and years, until a lawyer from the city came.</p>"
    assert "copyright of the book" in dom.extract(f"<html><body><div>{prose}{long}{prose}</div></body></html>", dom.default_model())


def test_html_held_out_layouts():
    model, right, total = dom.default_model(), 0, 0
    for source, labels in dom.labelled_pages(80, seed=99):
        page = dom.Page(source)
        found, with_text = model.marginals(page)[0], {e for e, _, _ in page.pieces if e >= 0}
        right += sum((found[i] > 0.5) == bool(labels[i]) for i in with_text)
        total += len(with_text)
    assert right / total > 0.98


def test_html_marginals_are_exact():
    """Sum-product against enumeration of all labelings of a small page."""
    from itertools import product
    from math import exp

    model, page = dom.default_model(), dom.Page("<body><nav><p>a</p></nav><article><h1>t</h1><p>some words</p><div class='ad'>x</div></article></body>")
    names, n = dom.features(page), len(page.tags)
    own = [sum(model.weights.get(f, 0.0) for f in x) for x in names]
    totals, z = [0.0] * n, 0.0
    for labels in product((0, 1), repeat=n):
        w = exp(sum(own[i] for i in range(n) if labels[i]) + sum(model.edges.get((dom.kind(page, page.parents[i]), labels[page.parents[i]], labels[i]), 0.0) for i in range(1, n)))
        z += w
        totals = [t + w * y for t, y in zip(totals, labels)]
    assert np.allclose([t / z for t in totals], model.marginals(page)[0])


def test_html_odd_pages(spark):
    model = dom.default_model()
    assert dom.extract("<article><p>a<b>b</b>c<br>d &amp; &lt;e&gt; &am</p><div class='comments'><p>reader</p></div></article><div cla", model) == "abc d & <e> &am"
    assert dom.extract('<article><p>x <a href="y>z</a> w</article>', model) == "x z w"
    assert dom.extract("<article>" * 3000 + "deep" + "</article>" * 3000, model) == "deep"
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<!-- open"), (3, "u", "<script>if (a<b) {")]
    assert [r.text for r in dom.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()] == [""] * 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=600), st.integers(0, 12))
def test_elias_fano(values, shift):
    values = np.sort(np.array(values, np.int64) << shift)
    ef = tokenfile.EliasFano.from_bytes(memoryview(tokenfile.EliasFano.of(values).to_bytes()))
    assert (ef.all() == values).all() and [ef.select(i) for i in range(0, len(values), 17)] == values[::17].tolist()
    if len(values) > 300:
        assert len(ef.to_bytes()) < len(values) * (3 + max(0, np.log2(max(1, values[-1] / len(values)))) / 8 + 0.5)


@pytest.fixture(scope="module")
def wordy():
    return public_tokenizers.path("word_bpe_49k.json")


def test_token_words_equal_whole_texts(wordy):
    texts = ["", None, "İstanbul Å Ünïcode don't we'll IT'S a'S\x1cb ćd é ́x ﬁ ² ½ ΑΣ σς", "<|endoftext|> a<|startoftext|>b", "x" * 5000 + " y " * 3, "日本語 テスト。 ok z q\u0085r", "naïve!!! CAFÉ%%% a.b,c ..", "ẞß ŒǅÞ"]
    e, plain = tokenfile.Encoder(wordy), Tokenizer.from_file(wordy)
    assert e.encode(texts) == [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def tokens_brute(rows, wordy):
    plain, at, found = Tokenizer.from_file(wordy), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        found.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return found


def test_token_output(spark, sf, docs, wordy):
    got = queries.op4_token_output(spark, sf).orderBy("start").collect()
    assert [tuple(r) for r in got] == tokens_brute([(r.doc_id, r.text) for r in docs.collect()], wordy)


def test_token_files_odd(odd, empty, wordy, tmp_path):
    manifest = tokenfile.write(odd, f"{tmp_path}/t", wordy, shard_ids=500)
    got = tokenfile.read(manifest, f"{tmp_path}/t").orderBy("start").collect()
    assert [tuple(r) for r in got] == tokens_brute([(r.doc_id, r.text) for r in odd.collect()], wordy)
    assert manifest.count() >= 3
    path = manifest.orderBy("part", "shard").first().path
    shard = tokenfile.Shard(open(path, "rb").read())
    assert shard.document(0).tolist() == [2]
    assert tokenfile.read(tokenfile.write(empty, f"{tmp_path}/e", wordy), f"{tmp_path}/e").count() == 0


def test_token_files_of_wide_ids(spark, wordy, tmp_path, empty):
    """Ids over the whole range of 64 bits, and an id that a third of the rows share."""
    rng = random.Random(2)
    ids = [-(2**63), -(2**63) + 5, -1, 0, 1, 2**63 - 5, 2**63 - 1, None, None] + [rng.randrange(-(2**63), 2**63) for _ in range(50)] + [77] * 30
    rows = [(d, rng.choice(["a b", "cat", None, f"dog {rng.randrange(9)}"])) for d in ids]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    manifest = tokenfile.write(df, f"{tmp_path}/w", wordy, shard_ids=40)
    got = [tuple(r) for r in tokenfile.read(manifest, f"{tmp_path}/w").orderBy("start").collect()]
    assert got == tokens_brute(rows, wordy)
    for some in ([], [2**63 - 1], [-(2**63), 2**63 - 1], [-(2**63)] * 3 + [0, 2**63 - 1]):
        shard = tokenfile.Shard(tokenfile.pack(some, [1] * len(some), b"\1\0" * len(some), 2))
        assert shard.doc_ids() == some and [shard.document(i).tolist() for i in range(len(some))] == [[1]] * len(some)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op5_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q in labels.items() if got[i].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95


def brute_ngrams(text, bits):
    """Numbers of a text's n-grams, one at a time."""
    crc, whole, found, words = (lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass"))), 1 << 64, set(), (text or "").split()
    p, q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    put = lambda h: found.add((h % whole >> 40) & ((1 << bits) - 1))
    for i, w in enumerate(words):
        put(crc(w.lower()) * p)
        put(crc(quality.shape(w)) * q)
        if i:
            put((crc(words[i - 1].lower()) * q + crc(w.lower())) * p)
            put((crc(quality.shape(words[i - 1])) * p + crc(quality.shape(w))) * q)
        for k in range(1, 5):
            if i >= k and len({x.lower() for x in words[i - k : i + 1]}) == 1:
                put(k * 0x165667B19E3779F9)
    return found


def test_quality_query_by_brute_force(spark, sf, docs):
    """Every score from n-grams counted one at a time and the model's weights; the weights from counted classes."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in queries.op5_quality(spark, sf).collect()}
    for r in docs.collect():
        margin = sum(float(model.weights[f]) for f in brute_ngrams(r.text, model.bits)) + model.bias
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-(model.scale * margin + model.shift)))) < 1e-6
    rows, y = [np.array([1, 2]), np.array([2]), np.array([2, 3]), np.array([0])], np.array([1, 1, 0, 0])
    counts = [[1 + sum(f in r for r, k in zip(rows, y) if k == label) for f in range(4)] for label in (0, 1)]
    assert np.allclose(quality.ratios(rows, y, 4), [np.log(b / sum(counts[1])) - np.log(a / sum(counts[0])) for a, b in zip(*counts)])


def test_fitting_rows_are_bounded(spark):
    """Rows of repeated ids and long texts do not make the driver's share grow; the choice does not depend on partitions."""
    rows = [(i % 40, "x" * (i % 7) + str(i % 60), "ab"[i % 2]) for i in range(4000)] + [(1, "y" * 9000, "a"), (2, None, "b"), (3, "z", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    take = lambda d: common.fitting_rows(common.bounded_sample(d, "lang", 20), "lang", 20, chars=400)
    got = take(df)
    assert got == take(df.repartition(7)) and 20 < len(got) <= 80 and sum(len(r[0]) for r in got) <= 400
    assert all(sum(r[1] == k for r in got) <= 40 for k in "ab") and len({r[:2] for r in got}) > 20


def test_dual_descent_finds_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(8) < 0.4) for _ in range(40)]
    y = (np.array([len(r) for r in rows]) + rng.normal(0, 1, 40) > 3).astype(float)
    scale, cost = np.ones(8), np.full(40, 0.5)
    w, b = quality.dual_descent(rows, y, scale, cost, epochs=3000)
    x = np.array([[*(1.0 * np.isin(range(8), r)), 1.0] for r in rows])
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - (2 * y - 1) * (x @ v))).sum()
    best = loss(np.append(w, b))
    assert all(loss(np.append(w, b) + rng.normal(0, s, 9)) >= best - 1e-6 for s in (0.3, 0.03, 0.003) for _ in range(200))


def test_quality_odd(spark, odd, empty):
    for labels in ([], [(3, 1)], [(3, 1), (6, 0), (6, 0), (None, 1), (8, None)]):
        model = quality.fit(odd, spark.createDataFrame(labels, "doc_id bigint, quality int"))
        got = quality.score(odd.withColumn("score", F.lit(1)), model).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, model).count() == 0 and quality.keep_good(odd, spark.createDataFrame([(3, 1)], "doc_id bigint, quality int")).columns == odd.columns


def base_counts(text):
    w = WORD.findall(text or "")
    c, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_rules(spark, sf, docs, odd, empty):
    truth = {r.doc_id: base_counts(r.text) for r in docs.collect()}
    got = queries.op6_quality_rules(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == truth and not any(r.base_failed and r.kept for r in got)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = [("a b c " * 40 + " ".join(f"w{i}" for i in range(200)) + " a b c",), ("x y z\nx y z\n\n x y z",), ("a a a a a",), (None,), ("\x0b\x0c\r",), (" ".join(f"v{i % 90}" for i in range(400)),)]
    some = rules.judge(spark.createDataFrame(rows, "text string").withColumn("kept", F.lit("clash"))).select(*names).collect()
    assert [tuple(r) for r in some] == [base_counts(t) for t, in rows]
    assert rules.judge(odd).count() == odd.count() and rules.judge(empty).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op10_language(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def brute_subwords(word, bits):
    """Rows of the table of a word and its n-grams, one character at a time."""
    m, whole, codes = 0x9E3779B97F4A7C15, 1 << 64, [ord(c) for c in f"<{word}>"]
    total = 0
    for i, c in enumerate(codes):
        x = (c + i * 0x10FFFF) * m % whole
        total += (x ^ x >> 29) * m
    rows = [(total % whole) * m % whole >> 64 - bits]
    for n in range(2, 6):
        for i in range(len(codes) - n + 1):
            h = codes[i] * m % whole
            for c in codes[i + 1 : i + n]:
                h = ((h ^ h >> 31) ^ c) * m % whole
            rows.append(h >> 64 - bits)
    return rows


def test_language_query_by_brute_force(spark, sf, docs):
    """Every prediction from subwords hashed one character at a time and averaged."""
    model = language.fit(docs)
    got = {r.doc_id: r for r in queries.op10_language(spark, sf).collect()}
    known = {}
    for r in docs.collect():
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        total, n = np.zeros(len(model.names)), 0
        for w in re.findall(r"[^\W\d_]+", r.text.lower()):
            if w not in known:
                rows = brute_subwords(w, model.bits)
                known[w] = model.logits[rows].sum(0), len(rows)
            total, n = total + known[w][0], n + known[w][1]
        z = np.exp((total / max(n, 1) + model.bias) / model.temperature)
        assert got[r.doc_id].lang_pred == model.names[int(z.argmax())] and abs(got[r.doc_id].score - z.max() / z.sum()) < 1e-6


def test_language_odd(odd, empty):
    model = language.fit(odd)
    got = language.predict(odd, model).collect()
    for r, (text,) in zip(got, odd.select("text").collect()):
        if not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("de", "en") and 0 <= r.score <= 1
    assert language.predict(empty, language.fit(empty)).count() == 0


def test_subwords_do_not_depend_on_company():
    alone = sorted(x for r, _ in language.subwords(["straße"]) for x in r.tolist())
    rows = language.subwords(["a", "straße", "zz"])
    assert alone == sorted(x for r, w in rows for x in r[w == 1].tolist())


def test_memo_is_bounded():
    memo = common.Memo(len, limit=10)
    assert [memo["x" * i] for i in range(100)] == list(range(100)) and len(memo) <= 10


def test_rules_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.sql(queries.oracle_sql()["op6_quality_rules"])
    got = queries.op6_quality_rules(spark, sf).select(*found.columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def test_pii_chains_of_overlapping_spans(spark, monkeypatch):
    """Candidates are taken by score, each that overlaps none taken before, however many lie between."""
    rng = random.Random(2)
    cases = [[(0, 0, 10, 9.0), (1, 8, 20, 8.0), (2, 18, 30, 7.0)], [(0, 0, 100, 9.0), *((1, i, i + 2, 1.0) for i in range(1, 40, 3))], []]
    cases += [[(rng.randrange(3), a, a + rng.randint(1, 12), float(rng.randint(1, 4))) for a in (rng.randrange(60) for _ in range(14))] for _ in range(30)]
    # no two of a case share kind, start and score, so that the order is whole
    cases = [list({(s[0], s[1], s[3]): s for s in sorted(set(case))}.values()) for case in cases]
    truth = []
    for case in cases:
        taken = []
        for s in sorted(case, key=lambda s: (-s[3], s[0], s[1])):
            if all(s[1] >= o[2] or s[2] <= o[1] for o in taken):
                taken.append(s)
        truth.append(sorted(s[:3] for s in taken))
    rows = [((i, "t"), "t", [], [(k, a, b, str(v), "", "", None) for k, a, b, v in sorted(case, key=lambda s: s[1:3])]) for i, case in enumerate(cases)]
    made = spark.createDataFrame(rows, f"row struct<doc_id:bigint,text:string>, text string, base {pii.SPAN}, loose {pii.SPAN}")
    monkeypatch.setattr(pii, "proposed", lambda docs: made)
    monkeypatch.setattr(pii, "features", lambda s: [s["value"].cast("double")] * len(pii.FEATURES))
    trees = type("Trees", (), {"column": staticmethod(lambda x: x[0])})
    got = pii.find(made.select("row.*"), model=pii.Model(trees, (0.0,) * len(pii.ALL))).collect()
    assert [sorted((s.kind, s.start, s.end) for s in r.spans) for r in sorted(got, key=lambda r: r.doc_id)] == truth
