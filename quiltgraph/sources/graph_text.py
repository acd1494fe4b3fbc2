"""The text graph format: ``t V E``, ``v id label [degree]``, ``e src dst [label]``."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, build
from ..plans.pattern import Pattern


def tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(vid, raw_label)`` and ``(src, dst, elabel)`` of a graph file; labels not given are 0."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    at = lambda i, kind: F.try_element_at("p", F.lit(i)).try_cast(kind)
    vertices = parts.where(F.col("p")[0] == "v").select(at(2, "bigint").alias("vid"), F.coalesce(at(3, "int"), F.lit(0)).alias("raw_label"))
    edges = parts.where(F.col("p")[0] == "e").select(at(2, "bigint").alias("src"), at(3, "bigint").alias("dst"), F.coalesce(at(4, "int"), F.lit(0)).alias("elabel"))
    return vertices, edges


def read(spark: SparkSession, path: str) -> Graph:
    return build(*tables(spark, path))


def lines(graph: Graph) -> DataFrame:
    """``(line, part, a, b)``: the lines of a graph with what they are ordered by."""
    head = graph.vertices.agg(F.count("*").alias("v"), F.coalesce(F.sum("deg"), F.lit(0)).alias("d"))
    none = F.lit(0).cast("bigint")
    first = head.select(F.concat_ws(" ", F.lit("t"), "v", (F.col("d") / 2).cast("bigint")).alias("line"), F.lit(0).alias("part"), none.alias("a"), none.alias("b"))
    vertices = graph.vertices.select(F.concat_ws(" ", F.lit("v"), "vid", "raw_label", "deg").alias("line"), F.lit(1).alias("part"), F.col("vid").alias("a"), none.alias("b"))
    edges = graph.edges.where("src < dst").select(F.concat_ws(" ", F.lit("e"), "src", "dst", "elabel").alias("line"), F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return first.unionByName(vertices).unionByName(edges)


def write(graph: Graph, path: str) -> None:
    """Text files under ``path`` that in order of their names are one graph file."""
    lines(graph).orderBy("part", "a", "b").select("line").write.mode("overwrite").text(path)


def read_pattern(path: str) -> Pattern:
    """A pattern file, read on the driver."""
    labels: dict[int, int] = {}
    edges: dict[tuple[int, int], int] = {}
    for line in Path(path).read_text().splitlines():
        kind, *rest = line.split() or [""]
        if kind == "v":
            labels[int(rest[0])] = int(rest[1]) if len(rest) > 1 else 0
        elif kind == "e":
            a, b = int(rest[0]), int(rest[1])
            edges[min(a, b), max(a, b)] = int(rest[2]) if len(rest) > 2 else 0
    return Pattern(tuple(labels[v] for v in sorted(labels)), tuple((a, b, e) for (a, b), e in sorted(edges.items())))


def query_list(path: str) -> list[str]:
    """Pattern file names: each token of a list file."""
    return Path(path).read_text().split()
