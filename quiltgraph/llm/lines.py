"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.

Lines are compared in lower case with white space collapsed. A line's signature is a one-permutation
MinHash of its eight-byte shingles: one hash a shingle, the least value in each of ``BANDS * ROWS`` bins,
empty bins filled from the next full one. Lines that share a band meet in its bucket, where all are tested
against each other by a few bytes: lines of fewer than ``LONG`` shingles by counts of their shingles in bins,
a bound that no similar pair fails; longer ones by their signatures, which a similar pair fails with probability
below 1e-6. The components of these loose links are clusters. Within a cluster every line is compared by the exact
Jaccard similarity of the shingle sets, and the components of verified links are found. The first line of each
component stays.

Large buckets and clusters are dealt out in blocks (:func:`linked`): lines meet in their block, then the blocks'
representatives meet, and what is still apart from the largest component meets all others. A group of copies of one
template is one component after the second step, so it costs in proportion to its lines; no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIMILARITY = 0.8
#: At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8^4)^9 = 0.991, at 0.9 with 0.9998.
BANDS, ROWS = 9, 4
RECORD = BANDS + 3
SHINGLE = 8  # bytes
#: Bins of the sketch or counts that go with a line into its buckets, four bits each, and how many equal ones
#: of the sketch link long lines: lines that share little have 3 or 4, lines at 0.35 about 12, at 0.8 about 26.
SKETCH, LOOSE = 32, 12
#: Distinct shingles from which lines are linked by sketches: no bin is then filled from another's value, and
#: twelve of 32 equal places are missed with probability below 1e-6 at 0.8.
LONG = 256
#: Lines of a bucket up to which many buckets' pairs are tested at once.
FEW = 16
#: Lines of a bucket, and lines or bytes of lines of a cluster, compared in one task; larger ones are dealt out in blocks.
#: A bucket's lines are counted by those whose number divides by ``EACH``: what is missed by chance is little larger.
BUCKET_LINES, BLOCK_LINES, BLOCK_BYTES = 4096, 200, 2_000_000
EACH = 64
#: Blocks' worth of trees' centres compared in one task.
CENTRES = 5
#: Rows of large groups up to which they are broadcast (16 bytes each); beyond, they are joined.
BROADCAST_ROWS = 100_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def normal(line: str) -> bytes:
    """What of a line is compared; empty for a line without a word."""
    return " ".join(line.lower().split()).encode("utf-8", "surrogatepass")


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of non-empty lines, one after another as numbers, and each line's count. A shorter line is one, padded."""
    sizes = np.array([len(x) for x in lines], np.int64)
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    data = (b"\0" * SHINGLE).join(lines) + b"\0" * SHINGLE
    every = np.ndarray(len(data) - SHINGLE + 1, "<u8", data, strides=(1,))
    starts = np.concatenate([[0], np.cumsum(sizes + SHINGLE)[:-1]])
    return every[np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())], counts


def signatures(lines: list[bytes], bins: int = BANDS * ROWS) -> np.ndarray:
    """``(len(lines), bins)`` one-permutation MinHash values."""
    found, counts = shingles(lines)
    h = found * _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    place = (np.repeat(np.arange(len(lines), dtype=np.uint64) * np.uint64(bins), counts) + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32))).astype(np.int64)
    none = np.uint64(1 << 40)
    least = np.full(len(lines) * bins, none)
    np.minimum.at(least, place, h & np.uint64(0xFFFFFFFF))
    least = least.reshape(len(lines), bins)
    gaps = np.flatnonzero((least == none).any(1))
    if len(gaps):
        given, filled = least[gaps], least[gaps].copy()
        for d in range(1, bins):
            empty = filled == none
            if not empty.any():
                break
            other = np.roll(given, -d, 1)
            take = empty & (other != none)
            filled[take] = other[take] + np.uint64(d) * np.uint64(1 << 33)
        least[gaps] = filled
    return least


def band_keys(values: np.ndarray) -> np.ndarray:
    """``(lines, BANDS)`` keys of the signatures' bands as bigint."""
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), 1))
    for r in range(ROWS):
        keys = (keys ^ values[:, r::ROWS][:, :BANDS]) * _MIX[0]
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def sketches(values: np.ndarray) -> np.ndarray:
    """``(lines, 2)`` bigint: four mixed bits of each of the first ``SKETCH`` values."""
    bits = ((values[:, :SKETCH] * _MIX[0]) >> np.uint64(60)).reshape(len(values), 2, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)


def profiles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles each of at most 1024 lines has, and ``(lines, 2)`` bigint: how many of them, modulo 16, lie in each of ``SKETCH`` bins."""
    found, counts = shingles(lines)
    h = found * _MIX[1]
    h ^= h >> np.uint64(29)
    h *= _MIX[0]
    keys = (np.repeat(np.arange(len(lines), dtype=np.uint64), counts) << np.uint64(54)) | (h >> np.uint64(10))
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    bins = np.bincount((keys >> np.uint64(49)).astype(np.int64), minlength=len(lines) * SKETCH).reshape(len(lines), 2, 16)
    return bins.sum((1, 2)), ((bins.astype(np.uint64) & np.uint64(15)) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)


def records(lines: list[bytes], similarity: float = SIMILARITY) -> list[np.ndarray]:
    """For each line ``RECORD`` numbers: keys of its bands, the sketch or counts, and the count of shingles, negative with a sketch.

    Lines that can be similar both to shorter and to longer ones than ``LONG`` have both records.
    """
    values, (n, bins) = signatures(lines), profiles(lines)
    keys = band_keys(values)
    short = np.concatenate([keys, bins, n[:, None]], 1)
    long = np.concatenate([keys ^ np.int64(0x5BD1E995), sketches(values), -n[:, None]], 1)
    return [np.concatenate([*([x] if m * similarity < LONG else []), *([y] if m >= LONG else [])]) for x, y, m in zip(short, long, n.tolist())]


def near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Which pairs of bucket mates, given as (bins, count), may be similar."""
    (x, n), (y, m) = a, b
    sized = np.minimum(np.abs(n), np.abs(m)) >= similarity * np.maximum(np.abs(n), np.abs(m)) - 1e-9
    d = (x - y) & np.uint8(15)
    # the sets differ in at least as many shingles as the counts of their bins
    alike = np.minimum(d, np.uint8(16) - d).sum(-1) <= (np.abs(n) + np.abs(m)) * ((1 - similarity) / (1 + similarity)) + 1e-9
    return sized & np.where(n > 0, alike, (d == 0).sum(-1) >= LOOSE)


def unpacked(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``(lines, SKETCH)`` numbers of four bits."""
    x = np.ascontiguousarray(np.stack([low, high], 1)).view(np.uint8)
    return np.concatenate([x & np.uint8(15), x >> np.uint8(4)], 1)


def jaccard(a: bytes, b: bytes) -> float:
    x, y = (np.unique(shingles([s])[0]) for s in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def keyed(docs: DataFrame, key: str = "__key") -> DataFrame:
    """``docs`` with ``key``: rows equal in doc_id and this hash of both are one document."""
    return docs.withColumn(key, F.xxhash64("doc_id", "text"))


def numbers(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each line. The first stands for it in links; lines are the same if both are."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def line_table(docs: DataFrame, similarity: float = SIMILARITY, key: str = "__key") -> DataFrame:
    """``(key, doc_id, line, number, check, bands, text)`` of every line with a word; the last two once a task for each number.

    ``bands`` has one or two of the line's :func:`records`, ``text`` what of it is compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in common.slices(batch, 500):
                keys, ids, places, lines = [], [], [], []
                for key, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    for at, line in enumerate((text or "").split("\n")):
                        if x := normal(line):
                            keys.append(key)
                            ids.append(doc_id)
                            places.append(at)
                            lines.append(x)
                if not lines:
                    continue
                number, check = numbers(lines)
                if len(seen) > common.MEMO_ENTRIES:
                    seen.clear()
                new = [i for i, x in enumerate(number.tolist()) if not (x in seen or seen.add(x))]
                made = [x for at in range(0, len(new), 1000) for x in records([lines[i] for i in new[at : at + 1000]], similarity)]
                bands = np.concatenate([np.empty(0, np.int64), *made])
                ends = np.zeros(len(lines) + 1, np.int32)
                ends[np.array(new, np.int64) + 1] = [len(x) for x in made]
                texts: list[bytes | None] = [None] * len(lines)
                for i in new:
                    texts[i] = lines[i]
                columns = [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(number), pa.array(check)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(bands)), pa.array(texts, pa.binary())],
                    names=["key", "doc_id", "line", "number", "check", "bands", "text"],
                )

    return docs.select(key, F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "key bigint, doc_id bigint, line int, number bigint, check bigint, bands array<bigint>, text binary")


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of sorted numeric batches, with starts and ends of the runs of rows equal in the first column that differ in the second."""
    rest: list[list[np.ndarray]] = []

    def whole(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*parts)]

    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if rest and columns[0][-1] == rest[0][0][0]:  # the run goes on
            rest.append(columns)
            continue
        columns = whole([*rest, columns])
        starts = np.concatenate([[0], np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1])
        # most runs are one line, or one line that several tasks have sent
        full = np.flatnonzero(columns[1][starts[:-1]] != columns[1][starts[1:] - 1])
        yield columns, starts[:-1][full], starts[1:][full]
        rest = [[x[starts[-1] :] for x in columns]]
    if rest:
        columns = whole(rest)
        if columns[1][0] != columns[1][-1]:
            yield columns, np.array([0]), np.array([len(columns[0])])


def loose(numbers: np.ndarray, bins: np.ndarray, sizes: np.ndarray, similarity: float = SIMILARITY, lead: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The trees of the lines of one bucket linked by :func:`near`, each line tested against all not yet reached, as stars around the least number.

    With ``lead`` every tree's centre is linked to itself too, a line alone as well.
    """
    left, right, rest = [], [], np.arange(len(numbers))
    while len(rest) > (not lead):
        front, tree, rest = [rest[0]], [rest[:1]], rest[1:]
        while front and len(rest):
            x = front.pop()
            found = near((bins[x], sizes[x]), (bins[rest], sizes[rest]), similarity)
            if found.any():
                tree.append(rest[found])
                front += rest[found].tolist()
                rest = rest[~found]
        members = np.sort(numbers[np.concatenate(tree)])
        left.append(np.full(len(members) - (not lead), members[0]))
        right.append(members[not lead :])
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))


def mates(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b)``: loose links that join all similar lines of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, number, low, high, size), starts, ends in sorted_groups(batches):
            many = ends - starts
            rows = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (number[rows][1:] != number[rows][:-1]) | (band[rows][1:] != band[rows][:-1])
            rows = rows[fresh]
            if not len(rows):
                continue
            band, number, size, bins = band[rows], number[rows], size[rows], unpacked(low[rows], high[rows])
            starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
            ends = np.append(starts[1:], len(band))
            many, found = ends - starts, []
            # small buckets: each line with the one d places further on
            few = np.repeat(np.where(many <= FEW, ends, 0), many)
            for d in range(1, FEW):
                x = np.flatnonzero(np.arange(len(band)) + d < few)
                if not len(x):
                    break
                x = x[near((bins[x], size[x]), (bins[x + d], size[x + d]), similarity)]
                found.append((number[x], number[x + d]))
            for i in np.flatnonzero(many > FEW):
                here = slice(starts[i], ends[i])
                found.append(loose(number[here], bins[here], size[here], similarity))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

    def in_block(numbers: list[int], columns: list[list[int]], lead: bool) -> tuple[list[int], list[int]]:
        low, high, size = (np.array(x, np.int64) for x in columns)
        return tuple(x.tolist() for x in loose(np.array(numbers, np.int64), unpacked(low, high), size, similarity, lead))

    def buckets(some: DataFrame) -> DataFrame:
        one = [some.where(F.size("bands") > at).select(F.explode(F.slice("bands", at + 1, BANDS)).alias("band"), "number", *(F.col("bands")[at + BANDS + i].alias(n) for i, n in enumerate(("low", "high", "size")))) for at in (0, RECORD)]
        return one[0].unionAll(one[1])

    rows = lines.where(F.size("bands") > 0)
    every = buckets(rows)
    counted = buckets(rows.where(F.col("number") % EACH == 0)).groupBy("band").agg((EACH * F.count_distinct("number")).alias("n"))
    large = common.written(counted.where(F.col("n") > BUCKET_LINES).select("band", F.ceil(F.col("n") / BUCKET_LINES).cast("int").alias("blocks")), "large-buckets")
    n_large, links = large.count(), None
    if n_large:
        side = F.broadcast if n_large <= BROADCAST_ROWS else lambda x: x
        links = linked(every.join(side(large), "band").withColumnRenamed("band", "root").distinct(), ["low", "high", "size"], in_block, apart=False)
        every = every.join(side(large), "band", "left_anti")
    found = every.repartition("band").sortWithinPartitions("band", "number").mapInArrow(run, "a bigint, b bigint")
    return found if links is None else found.unionAll(links)


def compared(rows: DataFrame, columns: list[str], compare: Callable, lead: bool = False) -> DataFrame:
    """``(a, b)`` from ``compare`` (numbers, columns, ``lead``) of the distinct lines of each (root, i, j) of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            if len(found) > (not lead):
                a, b = compare(list(found), list(zip(*found.values())), lead)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for *here, number, row in zip(*(batch.column(i).to_pylist() for i in range(4)), zip(*(batch.column(4 + i).to_pylist() for i in range(len(columns))))):
                if here != key:
                    yield from out()
                    key, found = here, {}
                found[number] = row
        yield from out()

    rows = rows.select("root", "i", "j", "number", *columns)
    return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "number").mapInArrow(run, "a bigint, b bigint")


def linked(rows: DataFrame, columns: list[str], compare: Callable, apart: bool) -> DataFrame:
    """``(a, b)``: edges that join exactly what all pairs of ``rows(root, blocks, number, *columns)`` of one root join.

    ``compare`` gives the trees of a block's lines as stars; ``blocks`` is how many a root's lines make. First
    each block's lines are compared, then the centres of the blocks' trees, in pairs of larger blocks. Lines that
    are then not of their root's largest component are compared with all others of the root. If the roots are
    ``apart``, no line being in two, the edges are stars.
    """
    block = lambda n: F.pmod(F.xxhash64("number", F.lit("block")), n).cast("int")
    every = common.written(rows, "line-groups")
    first = common.written(compared(every.withColumns({"i": block(F.col("blocks")), "j": F.lit(0)}), columns, compare, lead=True), "line-blocks")
    leading = every.join(first.where("a = b").select(F.col("a").alias("number")).distinct(), "number", "left_semi")
    size = leading.groupBy("root").agg(F.count("*").alias("led")).join(every.groupBy("root").agg(F.count("*").alias("n")), "root")
    dealt = leading.join(size, "root").withColumn("many", F.ceil(F.col("led") * F.col("blocks") / F.col("n") / CENTRES).cast("int")).withColumn("own", block(F.col("many")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    second = common.written(compared(pairs, columns, compare), "line-centres")
    # a line's centre (the least, if it is in several roots), and the centre's component
    parts = common.components(second, "line-groups")
    centres = first.select(F.col("b").alias("number"), F.col("a").alias("centre")).groupBy("number").agg(F.min("centre").alias("centre"))
    placed = every.join(centres, "number").join(parts.select(F.col("node").alias("centre"), F.col("root").alias("part")), "centre", "left")
    placed = common.written(placed.withColumn("part", F.coalesce("part", "centre")), "line-parts")
    main = placed.groupBy("root", "part").count().groupBy("root").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    main = common.written(main.where("n > most"), "line-mains")
    stars = placed.select(F.col("part").alias("a"), F.col("number").alias("b")) if apart else first.unionAll(second)
    if main.isEmpty():
        return stars.where("a <> b")
    # of each root that has any: its m lines outside the main component, in blocks, meet all in blocks
    across = placed.join(main, "root").withColumn("across", F.ceil((F.col("n") - F.col("most")) * F.col("blocks") / F.col("n")).cast("int"))
    rest = across.where("part <> main").withColumn("i", block(F.col("across"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = across.withColumn("j", block(F.col("blocks"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    third = compared(rest.unionByName(others), columns, compare)
    if not apart:
        return stars.where("a <> b").unionAll(third)
    part = lambda end: placed.select(F.col("number").alias(end), F.col("part").alias(f"part_{end}"))
    ends = third.join(part("a"), "a").join(part("b"), "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
    tops = common.components(ends, "line-parts").select(F.col("node").alias("a"), F.col("root").alias("top"))
    return stars.join(tops, "a", "left").select(F.coalesce("top", "a").alias("a"), "b").where("a <> b")


def texts_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(number, check, text)``: the compared text of each line of ``wanted(number)``; of different lines with one number, the least."""
    every = lines.where("text is not null").select("number", "check", "text").join(wanted, "number", "left_semi")
    return every.groupBy("number").agg(F.min(F.struct("text", "check")).alias("line")).select("number", "line.check", "line.text")


def forest(lines: list[bytes], similarity: float) -> list[list[int]]:
    """The trees of the lines linked at ``similarity`` or more, each line compared with all not yet reached.

    The shingles a line shares with every other one are counted from postings.
    """
    found, counts = shingles(lines)
    owner = np.repeat(np.arange(len(lines)), counts)
    order = np.lexsort((owner, found))
    found, owner = found[order], owner[order]
    fresh = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])  # sets
    found, owner = found[fresh], owner[fresh]
    sizes = np.bincount(owner, minlength=len(lines))
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    ends = np.append(starts[1:], len(found))
    posting = np.repeat(np.arange(len(starts)), ends - starts)
    by_line = np.argsort(owner, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    left, trees = np.ones(len(lines), bool), []
    for first in range(len(lines)):
        if not left[first]:
            continue
        left[first] = False
        trees.append([first])
        front = [first]
        while front and left.any():
            x = front.pop()
            p = posting[by_line[bounds[x] : bounds[x + 1]]]
            many = ends[p] - starts[p]
            rows = np.repeat(starts[p] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            both = np.bincount(owner[rows], minlength=len(lines))
            near = np.flatnonzero(left & (both >= similarity * (sizes + sizes[x] - both) - 1e-9))
            left[near] = False
            trees[-1] += near.tolist()
            front += near.tolist()
    return trees


def verified(clusters: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b)``: edges that connect exactly the lines that pairs at ``similarity`` connect within ``clusters(node, root)``."""

    def in_block(numbers: list[int], columns: list[list[bytes]], lead: bool) -> tuple[list[int], list[int]]:
        trees = [sorted(numbers[i] for i in tree) for tree in forest(columns[0], similarity)]
        # stars around the least number, so that components need few rounds or none
        edges = [(tree[0], x) for tree in trees for x in tree[not lead :]]
        return [a for a, _ in edges], [b for _, b in edges]

    rows = common.written(texts.select("number", "text").join(clusters.withColumnRenamed("node", "number"), "number"), "line-clusters")
    sizes = rows.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_LINES, F.col("bytes") / BLOCK_BYTES)).cast("int")
    large = common.written(sizes.select("root", blocks.alias("blocks")).where("blocks > 1"), "large-clusters")
    n_large, links = large.count(), None
    if n_large:
        side = F.broadcast if n_large <= BROADCAST_ROWS else lambda x: x
        links = linked(rows.join(side(large), "root"), ["text"], in_block, apart=True)
        rows = rows.join(side(large), "root", "left_anti")
    found = compared(rows.withColumns({"i": F.lit(0), "j": F.lit(0)}), ["text"], in_block)
    return found if links is None else found.unionAll(links)


def classes(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(number, check, root)``: the components of fuzzily equal lines, those of two lines or more."""
    with common.scratch(lines.sparkSession):
        clusters = common.components(mates(lines, similarity), "line-mates")
        texts = common.written(texts_of(lines, clusters.select(F.col("node").alias("number"))), "line-texts")
        roots = common.components(verified(clusters, texts, similarity), "line-components")
        return common.written(roots.withColumnRenamed("node", "number").join(texts.select("number", "check"), "number"), "line-classes", keep=True)


def removals(docs: DataFrame, similarity: float = SIMILARITY, key: str = "__key") -> DataFrame:
    """``(key, doc_id, lines)``: places of the lines to take out of each of the :func:`keyed` documents that have such."""
    lines = common.written(line_table(docs, similarity, key), "lines", compression="zstd")  # as large as the texts
    roots = classes(lines, similarity)
    # order of documents: by id, null first, then by key
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "key", "line")
    known = lines.groupBy("number", "check").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    known = common.written(known.join(roots, ["number", "check"], "left").where("root is not null or n > 1").select("number", "check", "root", "first"), "line-known")
    # lines in no component apart, so that they do not meet in one task
    alone, grouped = known.where("root is null"), known.where("root is not null")
    # written, so that the join reads two plain exchanges and a large component's partition can be split
    lowest = common.written(grouped.groupBy("root").agg(F.min("first").alias("lowest")), "line-firsts")
    repeated = alone.select("number", "check", "first").unionAll(grouped.join(lowest, "root").select("number", "check", F.col("lowest").alias("first")))
    gone = lines.select("number", "check", "key", "doc_id", "line").join(repeated, ["number", "check"])
    gone = gone.where("not (key = first.key and line = first.line and doc_id <=> first.doc_id)")
    return gone.groupBy("key", "doc_id").agg(F.collect_set("line").alias("lines"))


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_lines``, ``n_removed``.

    Of the lines of a component the first one stays, by doc_id (null first), key and place; the others
    go, in the same document too. Lines without a word stay. Null texts stay null and have no lines; a
    text of which nothing is left is empty. Rows equal in doc_id and text count as one document and come
    out alike. Other columns stay, but for ones named ``n_lines`` or ``n_removed``; an empty table gives
    an empty one. A document's own lines are held in one row, as its text is.
    """
    key, gone, parts = common.unused(docs.columns, "key", "gone", "parts")
    marked = keyed(docs.drop("n_lines", "n_removed"), key)
    with common.scratch(docs.sparkSession):
        out = common.written(removals(marked.select(key, "doc_id", "text"), similarity, key).withColumnRenamed("lines", gone), "line-removals", keep=True)
    # hinted, so that no size makes it another plan: documents are shuffled once, and never sorted
    joined = marked.join(out.hint("shuffle_hash"), (marked[key] == out["key"]) & marked["doc_id"].eqNullSafe(out["doc_id"]), "left").drop(out["key"], out["doc_id"])
    cut = joined.withColumn(parts, F.split("text", "\n", -1))
    # the places that stay, by a hash set, so that a document takes time in proportion to its lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(parts), i)), "\n")
    counted = cut.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)), "n_removed": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)), "text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)})
    return counted.select(*(c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")), "n_lines", "n_removed")
