"""Operators that compare documents, and the pipeline."""

import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quiltgraph.llm import common, decontaminate, lines, queries, simhash


class Sets:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def unite(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    """(fingerprint, component) by row number."""
    prints, sets = [brute_print(t) for _, t in rows], Sets()
    for i, p in enumerate(prints):
        for j in range(i + 1):
            if (p ^ prints[j]).bit_count() <= 3:
                sets.unite(i, j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = sets.find(i)
            low[r] = min(low.get(r, doc_id), doc_id)
    return [(p, low.get(sets.find(i))) for i, p in enumerate(prints)]


def test_simhash_query(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    truth = {d: (f"{p:016x}", c) for (d, _), (p, c) in zip(rows, brute_classes(rows))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, sf).collect()} == truth


def test_simhash_odd(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    truth = sorted((str(d), p, str(c)) for (d, _), (p, c) in zip(rows, brute_classes(rows)))
    got = simhash.near_duplicates(odd).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == truth
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    # one row of each group, ids shared by different texts and missing ids included: that with the smallest id
    prints, sets = [brute_print(t) for _, t in rows], Sets()
    for i, x in enumerate(prints):
        sets.find(i)
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3:
                sets.unite(i, j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(sets.find(i), []).append((d is None, d))
    left = sorted((d is None, d) for d, in kept.select("doc_id").collect())
    assert left == sorted(min(g, key=lambda x: (x[0], x[1] or 0)) for g in groups.values()) and 9 in [d for _, d in left]
    assert simhash.drop_near_duplicates(empty).count() == 0
    clash = odd.withColumnRenamed("lang", "__key").withColumnRenamed("source", "fp")
    assert sorted(map(str, simhash.drop_near_duplicates(clash).collect())) == sorted(map(str, kept.withColumnRenamed("lang", "__key").withColumnRenamed("source", "fp").collect()))


@pytest.mark.parametrize("full", [1, 12, 2048])
def test_simhash_links_of_full_halves(spark, monkeypatch, full):
    """Many fingerprints around one centre, with all, some or no buckets split by quarters."""
    monkeypatch.setattr(simhash, "FULL", full)
    rng = random.Random(5)
    centre, values = rng.getrandbits(64), set()
    for _ in range(160):
        x = rng.getrandbits(64) if rng.random() < 0.3 else centre
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    values = np.array(sorted(values), np.uint64)
    sets = Sets()
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ v) <= 3):
            sets.unite(i, int(j))
    got = Sets()
    place = {int(v): i for i, v in enumerate(values)}
    edges = simhash.links(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")).collect()
    for r in edges:
        a, b = r.a % 2**64, r.b % 2**64
        assert (a ^ b).bit_count() <= 3
        got.unite(place[a], place[b])
    assert [got.find(i) for i in range(len(values))] == [sets.find(i) for i in range(len(values))]


def test_components(spark):
    rng, sets = random.Random(3), Sets()
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(7, 7)]
    for a, b in edges:
        sets.unite(a, b)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: sets.find(x) for e in edges if e[0] != e[1] for x in e}
    assert common.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


def brute_lines(rows):
    """Lines to take out, by row (doc_id, text)."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, first, shingles = [], {}, []
    for d, t in rows:
        for at, line in enumerate((t or "").split("\n")):
            if x := lines.normal(line):
                seen.append((x, (d, t), at))
                first.setdefault(x, len(seen) - 1)
    texts, sets = list(first), Sets()
    for i, x in enumerate(texts):
        shingles.append(set(lines.shingles([x])[0].tolist()))
        sets.find(i)
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            if both / (len(shingles[i]) + len(shingles[j]) - both) >= 0.8:
                sets.unite(i, j)
    number, kept, gone = {x: i for i, x in enumerate(texts)}, set(), {}
    for x, row, at in seen:
        root = sets.find(number[x])
        if root in kept:
            gone.setdefault(row, set()).add(at)
        kept.add(root)
    return gone


def after(row, gone):
    return None if row[1] is None else "\n".join(x for i, x in enumerate(row[1].split("\n")) if i not in gone.get(row, ()))


def test_line_dedup(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    pool = [" ".join(word() for _ in range(rng.randint(6, 25))) for _ in range(25)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(pool) if rng.random() < 0.5 else " ".join(word() for _ in range(12))
            if rng.random() < 0.3:
                parts = line.split()
                parts[rng.randrange(len(parts))] = "q"
                line = " ".join(parts)
            text.append(rng.choice(["", "  "]) + line.upper() if rng.random() < 0.1 else line)
        rows.append((d, "\n".join([*text, *([""] if rng.random() < 0.3 else [])])))
    gone = brute_lines(rows)
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {d: got[d].text for d, _ in rows} == {d: after((d, t), gone) for d, t in rows}
    assert {d: got[d].n_removed for d, _ in rows} == {d: len(gone.get((d, t), ())) for d, t in rows}


def test_line_dedup_odd(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id not in (4, 9)]
    gone = brute_lines(rows)
    got = lines.dedup(odd.where("doc_id is null or doc_id not in (4, 9)").withColumn("n_lines", F.lit("clash"))).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(d), str(after((d, t), gone))) for d, t in rows)
    assert lines.dedup(odd).count() == odd.count() and lines.dedup(empty).count() == 0


def test_line_signatures():
    rng = random.Random(1)
    same = missed = 0
    for _ in range(400):
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(200))
        b = list(a)
        b[rng.randrange(200)] = "Z"
        b = "".join(b)
        x, y = lines.normal(a), lines.normal(b)
        if lines.jaccard(x, y) >= 0.8:
            same += 1
            k = lines.band_keys(lines.signatures([x, y]))
            missed += not (k[0] == k[1]).any()
    assert same > 300 and missed / same < 0.02


def similar_mates(texts):
    """Pairs of lines that share a band and reach the similarity."""
    found = {}
    for i, keys in enumerate(lines.band_keys(lines.signatures(texts)).tolist()):
        for k in keys:
            found.setdefault(k, []).append(i)
    pairs = {(i, j) for here in found.values() for i in here for j in here if i < j}
    return [(i, j) for i, j in pairs if lines.jaccard(texts[i], texts[j]) >= 0.8]


def test_short_lines(spark):
    """Lines of few shingles: every two bucket mates similar enough end in one class."""
    texts = [f"chapter {n}".encode() for n in [227, 2274, *range(0, 3000, 7)]] + [f"{w} part {n} of the book".encode() for w in "abc" for n in range(200)]
    texts = sorted(set(texts))
    pairs = similar_mates(texts)
    assert len(pairs) > 100 and (texts.index(b"chapter 227"), texts.index(b"chapter 2274")) in pairs
    docs = lines.keyed(spark.createDataFrame([(i, x.decode()) for i, x in enumerate(texts)], "doc_id bigint, text string"))
    root = {r.number: r.root for r in lines.classes(common.written(lines.line_table(docs), "lines")).collect()}
    number = lines.numbers(texts)[0].tolist()
    assert [(texts[i], texts[j]) for i, j in pairs if root.get(number[i], -1) != root.get(number[j], -2)] == []


def test_short_pair(spark):
    """Two headings at 0.8 that share bands, and no third line that links them."""
    assert similar_mates([b"chapter 227", b"chapter 2274"]) == [(0, 1)]
    got = lines.dedup(spark.createDataFrame([(1, "chapter 227"), (2, "chapter 2274")], "doc_id bigint, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "chapter 227", 2: ""}


def templates(rng):
    """Lines of a few templates, many much alike, some that are near to one only."""
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    made = set()
    for _ in range(4):
        body = [rng.choice(words) for _ in range(28)]
        for _ in range(60):
            line = body[:]
            for _ in range(rng.choice([0, 1, 1, 1, 2, 8])):
                line[rng.randrange(28)] = rng.choice(words)
            made.add(" ".join(line))
    return sorted(x.encode() for x in made)


@pytest.mark.parametrize("apart", [True, False])
def test_linked_is_whole(spark, monkeypatch, apart):
    """All pairs of a group, in blocks of a few lines, join as all pairs at once do."""
    monkeypatch.setattr(lines, "CENTRES", 1)
    texts = templates(random.Random(21))
    sets = Sets()
    for i, x in enumerate(texts):
        sets.find(i)
        for j in range(i):
            if lines.jaccard(x, texts[j]) >= 0.8:
                sets.unite(i, j)
    assert 4 < len({sets.find(i) for i in range(len(texts))}) < len(texts) / 2
    rows = spark.createDataFrame([(7, i, x, 9) for i, x in enumerate(texts)], "root bigint, number bigint, text binary, blocks int")

    def in_block(numbers, columns, lead):
        edges = [(min(numbers[i] for i in tree), numbers[j]) for tree in lines.forest(columns[0], 0.8) for j in tree]
        return tuple(zip(*[(a, b) for a, b in edges if lead or a != b])) or ((), ())

    got = Sets()
    for r in lines.linked(rows, ["text"], in_block, apart).collect():
        got.unite(r.a, r.b)
    assert [got.find(i) for i in range(len(texts))] == [sets.find(i) for i in range(len(texts))]


def test_large_buckets_and_clusters(spark, monkeypatch):
    """Lines of templates, with all buckets and clusters large: every two bucket mates similar enough end in one class."""
    for name, n in (("BUCKET_LINES", 8), ("BLOCK_LINES", 8), ("EACH", 1), ("CENTRES", 1)):
        monkeypatch.setattr(lines, name, n)
    texts = templates(random.Random(22))
    pairs = similar_mates(texts)
    docs = lines.keyed(spark.createDataFrame([(i, x.decode()) for i, x in enumerate(texts)], "doc_id bigint, text string"))
    root = {r.number: r.root for r in lines.classes(common.written(lines.line_table(docs), "lines")).collect()}
    number = lines.numbers(texts)[0].tolist()
    assert len(pairs) > 200 and [(texts[i], texts[j]) for i, j in pairs if root.get(number[i], -1) != root.get(number[j], -2)] == []


def test_lines_of_any_length_may_meet():
    """No similar pair fails the test in the bucket, around the length where it changes too."""
    rng, tested = random.Random(8), 0
    for n in [1, 2, 5, 12, 40, 100, 200, 240, 250, 260, 275, 300, 315, 330, 400, 900]:
        for _ in range(60):
            a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n + 7))
            cut = rng.randint(0, max(1, n // 5))
            b = a[cut:] if rng.random() < 0.5 else a + "".join(rng.choice("xyz") for _ in range(cut))
            x, y = lines.normal(a), lines.normal(b)
            if not x or not y or lines.jaccard(x, y) < 0.8:
                continue
            made = [r.reshape(-1, lines.RECORD) for r in lines.records([x, y])]
            bins = [(lines.unpacked(r[:, -3], r[:, -2]), r[:, -1]) for r in made]
            common_kinds = [(i, j) for i in range(len(made[0])) for j in range(len(made[1])) if (made[0][i, -1] > 0) == (made[1][j, -1] > 0)]
            assert any(lines.near((bins[0][0][i], bins[0][1][i]), (bins[1][0][j], bins[1][1][j])) for i, j in common_kinds)
            tested += 1
    assert tested > 500


ITEM = "Tom has 5 apples and gives 3 apples to Anna . How many apples does Tom have after 2 days ?"


@pytest.mark.parametrize(
    "text, found",
    [
        ("x y z " + ITEM + " bla bla", True),
        ("so Jim has 7 apples and gives 4 apples to Mary. How many apples does Jim have after 9 days ?", True),
        ("so Jim has 7 apples and gives 4 apples to Mary. How many apples does Jim have after 9 full days ?", True),
        ("Tom has 5 apples and gives 3 apples to Anna. nothing else of it is here at all", False),
        ("Jim has 7 apples and gives 7 apples to Jim. How many apples does Bob have after 7 days ?", False),
        ("", False),
    ],
)
def test_templates(text, found):
    index = decontaminate.Index.of([(1, ITEM), (2, ""), (3, None)])
    assert bool(decontaminate.contained(text, decontaminate.Words(), index)) == found


def test_decontamination_query(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    truth = {(d.doc_id, i.item_id) for d in docs.collect() for i in items if i.text in d.text}
    assert {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, sf).collect()} == truth


@pytest.mark.parametrize(
    "text",
    [
        "x y z " + ITEM.upper() + " BLA BLA",
        "x y z " + ITEM.lower() + " bla bla",
        "TOM HAS 7 APPLES AND GIVES 4 APPLES TO ANNA. HOW MANY APPLES DOES TOM HAVE AFTER 9 DAYS ?",
        "".join(c.upper() if i % 2 else c.lower() for i, c in enumerate(ITEM)),
    ],
)
def test_templates_in_other_case(text):
    index = decontaminate.Index.of([(1, ITEM), (2, ""), (3, None)])
    assert [i for i, _ in decontaminate.contained(text, decontaminate.Words(), index)] == [0]


def test_template_in_pieces():
    """24 words with 15, or 300, others in the middle: 16 of 20 windows are left."""
    item = [f"w{chr(97 + i)}" for i in range(24)]
    index = decontaminate.Index.of([(1, " ".join(item))])
    for n in (15, 300):
        text = [*item[:12], *(f"x{chr(97 + i % 26)}" for i in range(n)), *item[12:]]
        assert decontaminate.contained(" ".join(text), decontaminate.Words(), index) == [(0, 0.8)]
    # a value that stands for another in each piece: the windows with it do not all count
    item[3] = item[20] = "Tom"
    index = decontaminate.Index.of([(1, " ".join(item))])
    text = ["Jim" if i == 3 else "Bob" if i == 20 else w for i, w in enumerate(item)]
    assert decontaminate.contained(" ".join([*text[:12], *["x"] * 40, *text[12:]]), decontaminate.Words(), index) == []


def share_of_windows(text, item):
    """Share of an item's five-word windows, in lower case and without punctuation at the edges, that are in a text."""
    bare = lambda x: [w for w in (re.sub(r"^\W+|\W+$", "", w) for w in x.lower().split()) if w]
    windows = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    there = set(windows(bare(text)))
    return sum(w in there for w in windows(bare(item))) / len(windows(bare(item)))


def test_decontamination_in_other_case(spark, sf):
    """Documents of another size that hold an item in capitals, among others; truth in lower case."""
    large = sf.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{large}/documents.parquet").where("doc_id in (8376, 6420, 1699) or doc_id < 300")
    items = spark.read.parquet(f"{large}/benchmark.parquet")
    truth = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if share_of_windows(d.text, i.text) >= 0.8}
    assert {(8376, 101), (6420, 37), (1699, 130)} <= truth
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == truth


def pairs_of(docs, items):
    index, words = decontaminate.Index.of(list(enumerate(items))), decontaminate.Words()
    return [[i for i, _ in decontaminate.contained(t, words, index)] for t in docs]


def test_decontamination_by_values():
    """The templates' placeholders count where words stand with them and each value keeps its place."""
    item = "Tom has 5 apples and gives 3 apples to Anna . How many apples does Tom have after 2 days ?"
    other = "Mia has 12 apples and gives 7 apples to Carl . How many apples does Mia have after 9 days ?"
    same = "then {} takes {} coins , then {} loses {} coins , then {} finds {} coins , then {} sells {} coins"
    long = " ".join(f"word{i} more" for i in range(300))
    tail = " Round it to a whole number and put it in a box at the end of the page"
    cut = (other + tail).replace("Carl . How", f"Carl . {long} How")
    partial = "Mia has 12 apples and gives 7 apples to Carl . How many apples does Mia now " + long
    assert pairs_of([item, other, f"{long} {other} {long}", f"{partial} {other.replace('12', '4').replace('7 ', '1 ')}"], [item]) == [[0]] * 4
    assert pairs_of([long, "Mia has 12 apples and gives 7 apples", "apples " * 30], [item]) == [[]] * 3
    # numbers alone are not enough: their windows are those of the numbers
    assert pairs_of(["10 20 30 40 50 60 70", "1 2 3 4 5 6", "x 1 2 3 4 5 6 7 8"], ["1 2 3 4 5 6"]) == [[], [0], [0]]
    assert pairs_of(["Ann Bob Carol Dave Eve Fay", "ANN BOB carol dave EVE"], ["Ann Bob Carol Dave Eve"]) == [[0], [0]]
    assert pairs_of([same.format(*["Mia", 8] * 4), same.format("Mia", 8, "Joe", 2, "Ann", 4, "Bob", 6)], [same.format(*["Tom", 5] * 4)]) == [[0], []]
    assert pairs_of([cut], [item + tail]) == [[0]]


def test_decontamination_of_tables():
    """Tables of numbers and texts of one word take seconds, whole and re-parameterised."""
    rng, began = random.Random(4), time.time()
    numbers = " ".join(str(rng.randrange(10)) for _ in range(5000))
    rows = " ".join(f"row {i} has {rng.randrange(100)} units" for i in range(1000))
    again = " ".join(f"row {i + 4000} has {1000 + i} units" for i in range(1000))
    same = "0 " * 5000
    found = pairs_of([numbers, "7 " + numbers, same, "1 " * 5000, "a " * 5000, rows, f"{same} {rows} {numbers}"], [numbers, same, "a " * 4000, rows])
    assert found == [[0], [0], [1], [], [2], [3], [0, 1, 3]]
    assert pairs_of([again], [rows]) in ([[]], [[0]])
    assert time.time() - began < 60


def test_words_start_anew():
    words, few = decontaminate.Words(), decontaminate.Words()
    few.memo.limit = 7
    for text in ["a b c d e", "5kg , of Tom's $5", "d e f g h a b c d e f i j k l", "", "a $5 Tom"]:
        assert (words.hashes(text) == few.hashes(text)).all()


def test_decontamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (None, "seven small birds"), (4, "")], "item_id bigint, text string")
    for block in (10**6, 3):  # one block, and a block for each item
        got = decontaminate.leaks(odd, items, block_windows=block).collect()
        assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == sorted((str(d), i) for d in (3, 4, 4, 5) for i in ("1", "None"))
    assert decontaminate.leaks(empty, items).count() == 0 == decontaminate.leaks(odd, items.limit(0)).count()
    left = decontaminate.drop_leaks(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 4


def test_pipeline_odd(spark, sf, odd, empty):
    """Odd rows, an empty table and columns of clashing names go through all stages; clean rows stay."""
    import corpus_pipeline

    for start in (odd.withColumns({"__key": F.lit(1), "__quality": F.lit("q"), "row": F.lit(2), "first": F.lit(None).cast("int"), "gone": F.lit(3), "count": F.lit(4)}), empty):
        found = start
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, found, sf)
            assert name == "sentencepiece" or made.columns == start.columns
            found = common.written(made, name)
        assert found.count() <= start.count() and {"doc_id", "ids", "n_tokens", "decoded"} <= set(found.columns)


def test_pipeline(spark, sf, docs):
    """Each stage against brute force on its own input."""
    import corpus_pipeline

    found, inputs = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = found.collect()
        made = stage(spark, found, sf)
        if name != "sentencepiece":
            assert made.columns == docs.columns
        found = common.written(made, name)
    names = [n for n, _ in corpus_pipeline.STAGES]
    outputs = dict(zip(names, [*(inputs[n] for n in names[1:]), found.collect()]))
    rows = lambda xs: [(r.doc_id, r.text) for r in xs]
    good = {r.doc_id: r.predicted for r in queries.op5_quality(spark, sf).collect()}
    assert sorted(rows(outputs["quality_classifier"])) == sorted(x for x in rows(docs.collect()) if good[x[0]])
    gone = brute_lines(rows(inputs["line_dedup"]))
    assert sorted(rows(outputs["line_dedup"])) == sorted((d, after((d, t), gone)) for d, t in rows(inputs["line_dedup"]))
    assert all(r.n_chars == len(r.text) for r in outputs["line_dedup"])
    before = rows(inputs["simhash_dedup"])
    assert sorted(rows(outputs["simhash_dedup"])) == sorted(x for x, (_, c) in zip(before, brute_classes(before)) if c == x[0])
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    assert sorted(rows(outputs["decontamination"])) == sorted(x for x in rows(inputs["decontamination"]) if not any(i.text in x[1] for i in items))
    assert sorted((r.doc_id, r.decoded) for r in outputs["sentencepiece"]) == sorted(rows(inputs["sentencepiece"]))
