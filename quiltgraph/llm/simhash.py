"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Where two fingerprints differ by at most three bits,
one half differs by at most one, so both share that half with one bit taken out. Each distinct
fingerprint is indexed under its 64 one-wildcard half variants; an equality on the variant brings
the candidates of a bucket together and the whole distance is verified. Buckets yield spanning
forests, never all pairs; connected components follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits that linked fingerprints may differ by. Two halves and one wildcard cover three.
MAX_BITS = 3
#: Distinct fingerprints of a half from which its buckets are split by the variants of the other half's quarters.
FULL = 2048
#: Rows of full halves up to which they are broadcast (24 bytes each); beyond, they are joined.
BROADCAST_ROWS = 100_000


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """SimHash of the ``size``-word shingles of ``text``: 0 without words, the whole sequence if fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= size:
        return digest(join(words), seed)
    hashes = np.fromiter((digest(join(x), seed) for x in zip(*(words[i:] for i in range(size)))), np.uint64, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` (the fingerprint's 64 bits as bigint) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.per_document(batches, text, lambda texts: {"fp": pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))}, keep)

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", fp bigint")


def forest(values: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of ``values`` (distinct uint64), linked at ``bits`` or fewer differing bits."""
    rest, edges = values, []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= bits
            if near.any():
                found = rest[near]
                edges += [(int(at), int(x)) for x in found]
                front += list(found)
                rest = rest[~near]
    return edges


def variants(distinct: DataFrame) -> DataFrame:
    """``(key, part, fp)``: each fingerprint under its 64 one-wildcard half variants.

    A bucket beyond ``FULL`` fingerprints a half is split by the same rule once more: its fingerprints
    differ by at most three bits in the other half, so by at most one in one of its quarters, and meet
    under one of the 32 one-wildcard variants of the quarters. Rows grow in proportion, and ``key`` and
    ``part`` leave 2^18 fingerprints to a bucket at most.
    """
    halves = distinct.select("fp", F.posexplode(F.array(F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32))).alias("seg", "half"))
    full = common.written(halves.groupBy("seg", "half").count().where(F.col("count") > FULL).select("seg", "half", F.lit(True).alias("full")), "full-halves")
    # a half variant: segment, wildcard, the other bits
    each = halves.select("fp", "seg", "half", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    mask = F.expr("shiftleft(1L, bit)")
    key = F.expr("shiftleft(cast(seg * 32 + bit as bigint), 32)").bitwiseOR(F.col("half").bitwiseAND(F.bitwise_not(mask))).alias("key")
    n_full = full.count()
    if not n_full:
        return each.select(key, F.lit(0).alias("part"), "fp")
    side = F.broadcast if n_full <= BROADCAST_ROWS else lambda x: x
    # a bucket holds a half and its twin, and is split if either is full
    each = each.withColumn("twin", F.col("half").bitwiseXOR(mask)).join(side(full), ["seg", "half"], "left")
    each = each.join(side(full.select("seg", F.col("half").alias("twin"), F.col("full").alias("twin_full"))), ["seg", "twin"], "left")
    each = each.select(key, "fp", F.coalesce("full", "twin_full", F.lit(False)).alias("split"), F.expr("shiftrightunsigned(fp, 32 * (1 - seg)) & 4294967295L").alias("other"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(31)), _quarter)
    return each.select("key", F.explode(F.when(F.col("split"), parts).otherwise(F.array(F.lit(0)))).alias("part"), "fp")


def _quarter(i):
    """Variant ``i`` of the column ``other``: its wildcard is bit ``i % 16`` of quarter ``i / 16``; numbered from 1 on, 0 is no variant."""
    quarter = F.call_function("shiftrightunsigned", F.col("other"), F.when(i < 16, 0).otherwise(16)).bitwiseAND(0xFFFF)
    masked = quarter.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), i % 16)))
    return (i.cast("bigint") * 65536 + masked + 1).cast("int")


def links(distinct: DataFrame) -> DataFrame:
    """``(a, b)``: edges that connect exactly those ``fp`` of ``distinct`` that linked pairs connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in buckets(batches):
            if edges := forest(values):
                yield pa.RecordBatch.from_arrays([pa.array(np.array([e[i] for e in edges], np.uint64).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    dealt = variants(distinct).repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The fingerprints of the sorted rows' buckets of two or more."""
    rest = None
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "part", "fp")]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns)]
        key, part, _ = columns
        starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1])
        yield from full_buckets(columns, starts[:-1], starts[1:])
        rest = [x[starts[-1] :] for x in columns]  # the last may go on
    if rest is not None:
        yield from full_buckets(rest, np.array([0]), np.array([len(rest[0])]))


def full_buckets(columns: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets with two or more rows. Past wildcard 0 of a half, or of a quarter, only those whose rows differ in the wildcard's bit."""
    many = np.flatnonzero(ends - starts > 1)
    for i in many:
        a, b = starts[i], ends[i]
        values, code = columns[2][a:b].view(np.uint64), int(columns[0][a]) >> 32
        quarter = (int(columns[1][a]) - 1) >> 16 if columns[1][a] else 0
        # half 0 has bits 0-31 and codes 0-31, half 1 the next; the quarters are those of the other half
        wild = [code] * (code % 32 > 0) + [32 * (code < 32) + quarter] * (quarter % 16 > 0)
        bits = [(values >> np.uint64(at)) & np.uint64(1) for at in wild]
        if all(x.any() and not x.all() for x in bits):
            yield values


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Fingerprints link at :data:`MAX_BITS` or fewer differing bits; ``component_id`` is the smallest id
    reachable, the row's own included. A null or wordless text has fingerprint 0 and links like any
    other. A null id is kept and is never a component id, which is null where no row of the component
    has one. Repeated rows come out as often as they went in; an empty table gives an empty one; other
    columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with common.scratch(docs.sparkSession):
        prints = common.written(fingerprints(rows), "fingerprints", keep=True)
        known = _known(prints, {"component_id": F.min("doc_id")})
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def _known(prints: DataFrame, lowest: dict[str, Column]) -> DataFrame:
    """``fp`` and, by name, the minima ``lowest`` over all rows of its component, of every fingerprint."""
    distinct = common.written(prints.groupBy("fp").agg(*(c.alias(n) for n, c in lowest.items())), "distinct-fingerprints")
    roots = common.components(links(distinct.select("fp")), "simhash-components")
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(*(F.min(n).alias(n) for n in lowest))
    return common.written(labelled.select("fp", "root").join(least, "root").drop("root"), "simhash-classes", keep=True)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (null last), then the smallest hash of id and text.

    Of rows equal in id and text one is left, with the least values of its other columns. Only the
    rows that go are joined with the documents, which are shuffled once at any size.
    """
    spark, (key,) = docs.sparkSession, common.unused(docs.columns, "key")
    mark = F.xxhash64("doc_id", "text")
    with common.scratch(spark):
        prints = common.written(fingerprints(docs.select("doc_id", "text", mark.alias("key")), keep=("doc_id", "key")), "fingerprints")
        known = _known(prints, {"first": F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))})
        judged = prints.join(known, "fp").select("doc_id", "key", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))).alias("first"))
        counted = common.written(judged.groupBy("doc_id", "key", "first").count().where("count > 1 or not first"), "simhash-rows", keep=True)
    same = lambda side: (F.col(key) == side["key"]) & docs["doc_id"].eqNullSafe(side["doc_id"])
    gone, again = counted.where("not first"), counted.where("first")
    marked = docs.withColumn(key, mark)
    # hinted, so that no size makes it another plan: a hash table of a partition's rows that go
    kept = marked.join(gone.hint("shuffle_hash"), same(gone), "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    once = kept.join(again, same(again), "left_anti").select(docs.columns)
    merged = kept.join(again, same(again), "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("rest"))
    return once.unionByName(merged.select(*(F.col(c) if c.lower() in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns)))
