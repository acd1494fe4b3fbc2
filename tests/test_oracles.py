"""Registered queries against their SQL, run by DuckDB on the same tables."""

import sys

import duckdb
import pytest

from quiltgraph import catalog
from quiltgraph.sources import projection

TABLES = "region nation customer supplier part orders lineitem events".split()
#: The slowest are left to the driver's own comparison.
SLOW = {"cs_edges_r2", "cs_refined_r2", "kcore", "cs_sizes_fixpoint", "coloring"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(set(catalog.ENTRIES) - SLOW))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(catalog.oracle_sql()[name])
    places = [list(found.columns).index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=repr)


def test_entry_points(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and set(catalog.ENTRIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_points_without_a_dependency(monkeypatch):
    """Where the training-data queries cannot be imported the others are still there."""
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(catalog.ENTRIES) and set(entry.oracle_sql()) == set(catalog.oracle_sql())


#: Queries whose candidates need no more than a part of the graph.
PARTIAL = """
neighbor_safety
estimate_end_to_end
cs_mode_triangles
cs_refined_r2
graph_sample_estimate
cs_sizes_fixpoint
cs_edges_r2
best_order_compat
progress_pct
best_order
cs_mode_none
cs_mode_edge_matching
cs_mode_vertex_matching
bipartite_edge_safety
bipartite_safety
""".split()


@pytest.mark.parametrize("name", PARTIAL)
def test_no_whole_graph_is_built(spark, sf, monkeypatch, name):
    monkeypatch.setattr(projection, "_built", {})
    catalog.queries()[name](spark, sf).count()
    assert projection._built and not any({"ends", "vertices", "_whole"} & set(vars(g)) for g in projection._built.values())


#: Queries that need the whole graph's triangles, not its edge table.
UNBUILT = """
triangle_count
triangle_index
edge_support
""".split()


@pytest.mark.parametrize("name", UNBUILT)
def test_triangles_build_no_edge_table(spark, sf, monkeypatch, name):
    monkeypatch.setattr(projection, "_built", {})
    catalog.queries()[name](spark, sf).count()
    assert projection._built and not any("_whole" in vars(g) for g in projection._built.values())
