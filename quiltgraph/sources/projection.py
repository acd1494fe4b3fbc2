"""Labeled graphs made from the relational tables, over all their rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, Linked
from ..storage import stamps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vertex(key: str, kind: int, kinds: int):
    return (F.col(key) * kinds + kind).cast("bigint")


def _label(kinds: int) -> Callable[[str], Column]:
    """The label of a vertex: 10 times its kind and its key's remainder by 3."""
    return lambda vid: (F.pmod(vid, F.lit(kinds)) * 10 + F.pmod(F.floor(F.col(vid) / kinds), F.lit(3))).cast("int")


def shipments(spark: SparkSession, sf_dir: str, edge_labels: bool = False) -> Linked:
    """Orders (kind 0), parts (1) and suppliers (2), linked where a line item has both.

    With ``edge_labels`` an edge has the code of the least return flag of its line items, else 0.
    """
    code = F.ascii("l_returnflag") - F.lit(ord("A")) if edge_labels else F.lit(0)
    items = table(spark, sf_dir, "lineitem")
    ends = {"o": _vertex("l_orderkey", 0, 3), "p": _vertex("l_partkey", 1, 3), "s": _vertex("l_suppkey", 2, 3)}
    links = [items.select(ends[a].alias("src"), ends[b].alias("dst"), code.cast("int").alias("elabel")) for a, b in ("op", "po", "ps", "sp", "os", "so")]
    return Linked(reduce(DataFrame.unionByName, links), _label(3), "shipments")


def baskets(spark: SparkSession, sf_dir: str) -> Linked:
    """Orders (kind 0), parts (1), customers (2) and nations (3): order-part, order-customer, customer-nation."""
    o, p = _vertex("l_orderkey", 0, 4), _vertex("l_partkey", 1, 4)
    pairs = [("lineitem", o, p), ("orders", _vertex("o_orderkey", 0, 4), _vertex("o_custkey", 2, 4)), ("customer", _vertex("c_custkey", 2, 4), _vertex("c_nationkey", 3, 4))]
    links = [table(spark, sf_dir, t).select(x.alias("src"), y.alias("dst"), F.lit(0).alias("elabel")) for t, a, b in pairs for x, y in ((a, b), (b, a))]
    return Linked(reduce(DataFrame.unionByName, links), _label(4), "baskets")


_built: dict[tuple, Graph] = {}


def once(make: Callable[..., Graph], spark: SparkSession, sf_dir: str, **options) -> Graph:
    """The graph of an application: what is asked of it is built once, and again when its tables' files have changed."""
    files = tuple(stamps(spark, [f for t in ("lineitem", "orders", "customer") for f in table(spark, sf_dir, t).inputFiles()]))
    key = (spark.sparkContext.applicationId, make.__name__, sf_dir, tuple(sorted(options.items())), files)
    if key not in _built:
        _built[key] = make(spark, sf_dir, **options)
    return _built[key]
