"""Discovery of graph files: a folder for each dataset, with ``<name>.graph`` in it."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import graph_text, index_store


@dataclass(frozen=True)
class Dataset:
    id: str
    num_vertices: int
    num_edges: int
    labels: tuple[int, ...]
    index_status: str
    path: str

    def as_dict(self) -> dict:
        return asdict(self)


def describe(spark: SparkSession, path: str, index: str | None = None) -> Dataset:
    vertices, edges = graph_text.tables(spark, path)
    labels = tuple(vertices.agg(F.sort_array(F.collect_set("raw_label"))).first()[0])
    state = index_store.status(spark, index) if index else index_store.Status.MISSING
    return Dataset(Path(path).stem, vertices.count(), edges.count(), labels, state.value, path)


def discover(spark: SparkSession, root: str, index_root: str | None = None) -> list[Dataset]:
    found = sorted(p for p in Path(root).glob("*/*.graph") if p.stem == p.parent.name)
    return [describe(spark, str(p), f"{index_root}/{p.stem}" if index_root else None) for p in found]
