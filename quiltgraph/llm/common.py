"""What the operators share: the shared folder, written tables, word memos, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries of a word memo; beyond it the memo starts anew (about 200 bytes an entry).
MEMO_ENTRIES = 400_000

_local: str | None = None
#: Folders of the tables written within each open :func:`scratch`.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    global _local
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = "file://" + tempfile.mkdtemp(prefix="quiltgraph-")
    return _local


def written(df: DataFrame, name: str, keep: bool = False, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and outlives executors.

    Within :func:`scratch` it goes with the others at its end; with ``keep`` only with the next outer one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that :func:`written` made and that nothing will read again."""
    delete(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, the tables that :func:`written` makes within and does not keep. Nothing read later may rest on them.

    The driver then collects its garbage, whereupon Spark removes the shuffle files of jobs that are done:
    otherwise they stay on the executors' disks until it happens to.
    """
    _open.append([])
    try:
        yield _open[-1]
    finally:
        delete(spark, _open.pop())
        gc.collect()
        spark._jvm.System.gc()


def unused(columns: list[str], *names: str) -> list[str]:
    """The ``names``, each with as many underscores before it as no column's name needs to clash with it."""
    taken = {c.lower() for c in columns}
    mark = "__"
    while any(mark + n.lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


class Memo(dict):
    """Maps a key to ``make(key)``; starts anew beyond ``limit`` entries, so memory stays bounded."""

    def __init__(self, make: Callable, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def per_document(batches: Iterator[pa.RecordBatch], column: str, rows: Callable[[list], dict[str, pa.Array]], keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches of the columns ``keep`` and of those that ``rows`` makes from the values of ``column``."""
    for batch in batches:
        for part in slices(batch):
            made = rows(part.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *made.values()], names=[*keep, *made])


def slices(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def is_held_out(doc_id: str) -> Column:
    """Whether a document belongs to the fold that no model learns from (null ids do not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _is_stars(star: DataFrame) -> bool:
    """Whether every ``a`` has one ``b`` and none is a ``b`` itself."""
    ends = star.select(F.col("a").alias("node"), F.lit(2).alias("up"), F.lit(0).alias("down")).unionAll(star.select("b", F.lit(0), F.lit(1)))
    # 2 for a node with one b, 1 for a root; anything beyond is neither
    return (ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n")).agg(F.max("n")).first()[0] or 0) <= 2


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)`` (bigint): ``(node, root)`` with the smallest node as root.

    Alternating large-star and small-star rounds until the edges are stars. Every round is grouped
    minima and one equality join, written to the shared folder; nothing is gathered on the driver
    but one number. Nodes without an edge are not returned.
    """
    spark = edges.sparkSession
    with scratch(spark) as rounds:
        star = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        while not _is_stars(star):
            with scratch(spark):
                both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(star.select(F.col("b"), F.col("a")))
                # written, so that a join with it reads two plain exchanges and a hub's partition can be split
                low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
                large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
                large = written(large, name)
                low = large.groupBy("a").agg(F.min("b").alias("m"))
                small = large.join(low, "a")
                small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct()
                star = written(small, name, keep=True)
            delete(spark, rounds[:-1])  # the round before
            del rounds[:-1]
        return written(star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(star.select("b", "b").distinct()), name, keep=True)


#: Labels that a model can learn (the commonest), and characters of text that it is fitted on in all.
MOST_LABELS, FIT_CHARS = 1000, 50_000_000


def bounded_sample(rows: DataFrame, label: str, per_label: int, key: str = "doc_id") -> DataFrame:
    """About ``per_label`` of the ``rows`` of each label, chosen by a hash of ``key``, with that hash as ``place``.

    Labels are counted over all rows; a row stays where its hash lies in the first
    ``per_label / count`` of the range, so the choice does not depend on order or partitions. Null labels
    and all but the ``MOST_LABELS`` commonest are dropped. Rows of one key stay or go together.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.col("count").desc(), label).limit(MOST_LABELS)
    shares = counts.select(label, F.least(F.lit(float(per_label)) / F.col("count"), F.lit(1.0)).alias("share"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key)), 11)
    return rows.withColumn("place", place).join(F.broadcast(shares), label).where(F.col("place") < F.col("share") * F.lit(float(1 << 53))).drop("share")  # a row for each label


def fitting_rows(sample: DataFrame, label: str, per_label: int, chars: int = FIT_CHARS) -> list[tuple[str, object, int]]:
    """``(text, label, place)`` of a :func:`bounded_sample` with a column ``text``, on the driver: whole texts, ``chars`` in all at most.

    Rows equal in place, text and label count once. Of each label at most ``2 * per_label`` rows are taken,
    by place, then by a hash of the text, and of those the ones that fit in the label's equal part of
    ``chars``. What is chosen is told from sizes, before any text leaves the executors.
    """
    marked = sample.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.xxhash64("text"))
    sizes = marked.groupBy(label, "place", "digest").agg(F.max(F.length("text")).alias("size"))
    ranked = sizes.withColumn("n", F.row_number().over(Window.partitionBy(label).orderBy("place", "digest"))).where(F.col("n") <= 2 * per_label)
    rows = ranked.select(label, "place", "digest", "size").collect()
    left = dict.fromkeys({r[0] for r in rows}, chars // max(1, len({r[0] for r in rows})))
    taken = []
    for r in sorted(rows, key=lambda r: (r.place, r.digest, str(r[0]))):
        if r.size <= left[r[0]]:
            left[r[0]] -= r.size
            taken.append((r[0], r.place, r.digest))
    if not taken:
        return []
    chosen = sample.sparkSession.createDataFrame(taken, f"`{label}` {dict(sample.dtypes)[label]}, place bigint, digest bigint")  # as many as rows were taken
    found = marked.join(F.broadcast(chosen), [label, "place", "digest"]).groupBy(label, "place", "digest").agg(F.min("text").alias("text")).collect()
    return [(r.text, r[0], r.place) for r in sorted(found, key=lambda r: (r.place * 0x9E3779B97F4A7C15 % (1 << 64), r.place, r.digest, str(r[0])))]


def sigmoid_fit(margins, labels, weights, rounds: int = 100) -> tuple[float, float]:
    """``(a, b)`` of the weighted logistic fit of ``labels`` on ``a * margin + b``, by Newton's method."""
    import numpy as np

    x = np.stack([np.asarray(margins, float), np.ones(len(margins))], 1)
    y, w, p = np.asarray(labels, float), np.asarray(weights, float), np.zeros(2)
    # labels drawn in from 0 and 1 as Platt proposes, so that separable margins have a finite fit
    y = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (w * (y - q)) - 1e-9 * p)
        p = p + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])
