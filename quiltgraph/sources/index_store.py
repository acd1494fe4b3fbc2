"""Stored indexes: the graph and its motifs as Parquet, with a manifest that binds them to their source.

Paths are Hadoop paths; the manifest is text written by Spark, so a store only Spark reads will do.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import motifs
from ..operators.graph import Graph

VERSION = 1


class Status(Enum):
    READY = "ready"
    MISSING = "missing"
    STALE = "stale"
    INVALID = "invalid"


@dataclass
class Index:
    graph: Graph
    triangles: DataFrame
    four_cycles: DataFrame | None
    summary: dict


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fingerprint(graph: Graph) -> str:
    """Digest of a graph's rows, whatever their order or partitions."""
    def parts(df: DataFrame) -> tuple:
        h = F.xxhash64(*df.columns).cast("decimal(38,0)")
        return tuple(df.agg(F.count("*"), F.sum(h), F.sum(h % 1000003)).first())

    key = repr((parts(graph.vertices.select("vid", "raw_label")), parts(graph.edges.select("src", "dst", "elabel"))))
    return hashlib.sha256(key.encode()).hexdigest()


def save(graph: Graph, folder: str, four_cycles: bool = True) -> None:
    """Writes vertices, edges, triangles and, if asked, four-cycles, edge tables sorted by their source within files."""
    spark = graph.vertices.sparkSession
    tables = {"vertices": graph.vertices, "edges": graph.edges, "triangles": motifs.triangle_index(graph)} | ({"four_cycles": motifs.four_cycle_index(graph)} if four_cycles else {})
    for name, df in tables.items():
        keys = ["vid"] if name == "vertices" else ["src", "dst"]
        df.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{folder}/{name}")
    summary = motifs.summary(graph).first().asDict() if four_cycles else {}
    meta = {"version": VERSION, "sha256": fingerprint(graph), "built_at": time.time(), "tables": sorted(tables), "summary": summary}
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{folder}/meta").collect()))


def status(spark: SparkSession, folder: str, graph: Graph | None = None) -> Status:
    """Missing without a manifest; invalid if it or a table it names cannot be read; stale if the graph has changed."""
    if not exists(spark, f"{folder}/meta/_SUCCESS"):
        return Status.MISSING
    try:
        meta = manifest(spark, folder)
    except ValueError:
        return Status.INVALID
    if meta.get("version") != VERSION or not all(exists(spark, f"{folder}/{t}/_SUCCESS") for t in meta.get("tables", [None])):
        return Status.INVALID
    return Status.STALE if graph is not None and fingerprint(graph) != meta["sha256"] else Status.READY


def load(spark: SparkSession, folder: str) -> Index:
    """The index, whose graph has its triangles and, if they were stored, its four-cycles: the filters look them up."""
    if (found := status(spark, folder)) is not Status.READY:
        raise FileNotFoundError(f"index at {folder} is {found.value}")
    meta = manifest(spark, folder)
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    triangles, four_cycles = read("triangles"), read("four_cycles") if "four_cycles" in meta["tables"] else None
    return Index(Graph(read("vertices"), read("edges"), triangles, four_cycles), triangles, four_cycles, meta["summary"])
