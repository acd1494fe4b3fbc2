"""Registered queries of the graph engine over the relational tables, and their SQL oracles.

Each entry of :data:`ENTRIES` is a query over whole tables with the SQL that gives the same rows.
``shipments`` links orders, parts and suppliers of line items; ``baskets`` links orders, parts,
customers and nations (see :mod:`quiltgraph.sources.projection`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics, stats
from .operators import candidates, estimator, graph, graph_sampling, matcher, motifs, tree_sampling
from .plans import orders, ranking
from .plans.pattern import Pattern, ValidationError, cycle, normalize, path
from .service import Service, ServiceError
from .sources import graph_text, index_store
from .sources.projection import baskets, once, shipments, table
from .storage import shared_dir, written
from .streaming import events

Query = Callable[[SparkSession, str], DataFrame]

TRIANGLE = cycle(0, 10, 20)
PATH3 = path(0, 10, 1)
PATH4 = path(0, 10, 1, 20)
STAR = Pattern((0, 10, 11, 20), ((0, 1, 0), (0, 2, 0), (0, 3, 0)))
DIAMOND = Pattern((0, 10, 1, 20), ((0, 1, 0), (0, 3, 0), (1, 2, 0), (1, 3, 0), (2, 3, 0)))
SQUARE = cycle(0, 10, 1, 20)  # on baskets: order, part, order, customer
LABELED = Pattern((0, 10, 20), ((0, 1, 0), (0, 2, 0), (1, 2, 13)))
#: Spanning tree, seed and trials of the sampling queries, fixed so that SQL can follow them.
TREE = tree_sampling.Tree(1, ((1, 0), (1, 2)))
SEED, TRIALS, BUDGET = 7, 2000, 4000
WAITING, WINDOW_MS = ("view", "click"), 3_600_000

# --- SQL of the graphs -------------------------------------------------------------------------

_SHIP = """
items AS MATERIALIZED (SELECT DISTINCT l_orderkey * 3 AS o, l_partkey * 3 + 1 AS p, l_suppkey * 3 + 2 AS s, {code} AS c FROM lineitem),
und AS MATERIALIZED (SELECT least(a, b) AS a, greatest(a, b) AS b, min(c) AS elabel FROM
  (SELECT o AS a, p AS b, c FROM items UNION ALL SELECT p, s, c FROM items UNION ALL SELECT o, s, c FROM items) GROUP BY 1, 2)"""
_BASKET = """
und AS MATERIALIZED (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, 0 AS elabel FROM
  (SELECT l_orderkey * 4 AS a, l_partkey * 4 + 1 AS b FROM lineitem UNION ALL SELECT o_orderkey * 4, o_custkey * 4 + 2 FROM orders
   UNION ALL SELECT c_custkey * 4 + 2, c_nationkey::BIGINT * 4 + 3 FROM customer))"""


def _graph_sql(edges: str, kinds: int) -> str:
    return f"""WITH RECURSIVE {edges},
both_ways AS MATERIALIZED (SELECT a AS src, b AS dst, elabel FROM und UNION ALL SELECT b, a, elabel FROM und),
dg AS (SELECT src AS vid, count(*)::INTEGER AS deg FROM both_ways GROUP BY 1),
raw AS (SELECT vid, deg, ((vid % {kinds}) * 10 + (vid // {kinds}) % 3)::INTEGER AS raw_label FROM dg),
codes AS (SELECT raw_label, (row_number() OVER (ORDER BY min(vid)) - 1)::INTEGER AS label FROM raw GROUP BY 1),
v AS MATERIALIZED (SELECT vid, raw_label, label, deg FROM raw JOIN codes USING (raw_label)),
e AS MATERIALIZED (SELECT src, dst, elabel::INTEGER AS elabel, x.label AS src_label, y.label AS dst_label, x.deg AS src_deg, y.deg AS dst_deg, x.raw_label AS src_raw, y.raw_label AS dst_raw
  FROM both_ways JOIN v x ON x.vid = src JOIN v y ON y.vid = dst)"""


SHIP = _graph_sql(_SHIP.format(code="0"), 3)
SHIP_LABELED = _graph_sql(_SHIP.format(code="(ascii(l_returnflag) - ascii('A'))"), 3)
BASKET = _graph_sql(_BASKET, 4)


def _embeddings(p: Pattern) -> str:
    """FROM and WHERE of all embeddings of a pattern."""
    order = orders.exact(p)[0] if p.size > 1 else (0,)
    parts, seen = [f"(SELECT vid AS v FROM v WHERE raw_label = {p.labels[order[0]]}) c{order[0]}"], [order[0]]
    for b in order[1:]:
        back = [a for a in seen if a in p.neighbors[b]]
        first = f"(SELECT src, dst AS v FROM e WHERE src_raw = {p.labels[back[0]]} AND dst_raw = {p.labels[b]} AND elabel = {p.edge_label[back[0], b]}) c{b} ON c{b}.src = c{back[0]}.v"
        more = "".join(f" AND EXISTS (SELECT 1 FROM e WHERE src = c{a}.v AND dst = c{b}.v AND elabel = {p.edge_label[a, b]})" for a in back[1:])
        unlike = "".join(f" AND c{a}.v <> c{b}.v" for a in seen if p.labels[a] == p.labels[b] and a not in p.neighbors[b])
        parts.append(f"JOIN {first}{more}{unlike}")
        seen.append(b)
    return "FROM " + " ".join(parts)


def _count_sql(p: Pattern, start: str = SHIP) -> str:
    return f"{start} SELECT count(*)::BIGINT AS n {_embeddings(p)}"


# --- SQL of candidate spaces -------------------------------------------------------------------


def _initial_sql(p: Pattern) -> str:
    """CTEs ``cv0(qv, v)`` and ``ce0(qs, qd, src, dst)`` of the first candidates."""
    needed = ", ".join(f"({v}, {p.labels[v]}, {len(p.neighbors[v])})" for v in range(p.size))
    pairs = ", ".join(f"({a}, {b}, {e}, {p.labels[a]}, {p.labels[b]})" for (a, b), e in sorted(p.edge_label.items()))
    return f""",
qv(qv, raw_label, q_deg) AS (VALUES {needed}),
qe(qs, qd, elabel, src_raw, dst_raw) AS (VALUES {pairs}),
va AS (SELECT qv, vid AS v FROM v JOIN qv USING (raw_label) WHERE deg >= q_deg),
ea AS (SELECT qs, qd, src, dst FROM e JOIN qe USING (elabel, src_raw, dst_raw) WHERE (qs, src) IN (SELECT (qv, v) FROM va) AND (qd, dst) IN (SELECT (qv, v) FROM va)),
{_support_sql("cv0", "ea")}, {_alive_sql("ce0", "ea", "cv0")}"""


def _support_sql(name: str, edges: str) -> str:
    return f"{name} AS (SELECT qs AS qv, src AS v FROM {edges} GROUP BY qs, src HAVING count(DISTINCT qd) = (SELECT q_deg FROM qv WHERE qv.qv = {edges}.qs))"


def _alive_sql(name: str, edges: str, vertices: str) -> str:
    return f"{name} AS (SELECT qs, qd, src, dst FROM {edges} WHERE (qs, src) IN (SELECT (qv, v) FROM {vertices}) AND (qd, dst) IN (SELECT (qv, v) FROM {vertices}))"


def _neighbor_sql(name: str, edges: str, p: Pattern) -> str:
    rows = ", ".join(f"({v}, {label}, {n}, {len({x for u, x in p.neighbor_labels if u == v})})" for (v, label), n in p.neighbor_labels.items())
    return f"""{name} AS (SELECT qs AS qv, src AS v FROM (
  SELECT c.qs, c.src, r.labels FROM {edges} c JOIN qv d ON d.qv = c.qd JOIN (VALUES {rows}) r(qs, raw_label, needed, labels) ON r.qs = c.qs AND r.raw_label = d.raw_label
  GROUP BY c.qs, c.src, r.raw_label, r.needed, r.labels HAVING count(DISTINCT c.dst) >= r.needed) GROUP BY qs, src, labels HAVING count(*) = labels)"""


def _triangle_sql(name: str, edges: str, p: Pattern, support: bool) -> str:
    tests = [
        f"(qs, qd) <> ({a}, {b}) OR EXISTS (SELECT 1 FROM {edges} f JOIN {edges} g ON g.dst = f.dst WHERE f.qs = {a} AND f.qd = {w} AND f.src = {edges}.src AND g.qs = {b} AND g.qd = {w} AND g.src = {edges}.dst)"
        for a, b, w in p.triangles
    ]
    if support:
        many = {(a, b): sum(t[:2] == (a, b) for t in p.triangles) for a, b in p.edge_label}
        tests += [f"(qs, qd) <> ({a}, {b}) OR (src, dst) IN (SELECT (src, dst) FROM support WHERE n >= {n})" for (a, b), n in many.items() if n]
    return f"{name} AS (SELECT * FROM {edges} WHERE " + " AND ".join(f"({t})" for t in tests or ["true"]) + ")"


def _square_sql(name: str, edges: str, p: Pattern) -> str:
    tests = []
    for a, b, x, y, ax, by in p.four_cycles:
        diagonals = (f" AND EXISTS (SELECT 1 FROM {edges} d WHERE d.qs = {a} AND d.qd = {x} AND d.src = {edges}.src AND d.dst = f.dst)" if ax else "") + (f" AND EXISTS (SELECT 1 FROM {edges} d WHERE d.qs = {b} AND d.qd = {y} AND d.src = {edges}.dst AND d.dst = g.dst)" if by else "")
        tests.append(
            f"((qs, qd) <> ({a}, {b}) OR EXISTS (SELECT 1 FROM {edges} f JOIN {edges} h ON h.src = f.dst JOIN {edges} g ON g.dst = h.dst WHERE f.qs = {b} AND f.qd = {x} AND f.src = {edges}.dst AND f.dst <> {edges}.src"
            f" AND h.qs = {x} AND h.qd = {y} AND g.qs = {a} AND g.qd = {y} AND g.src = {edges}.src AND g.dst <> {edges}.dst{diagonals}))"
        )
    return f"{name} AS (SELECT * FROM {edges} WHERE " + " AND ".join(tests or ["true"]) + ")"


def _back_sql(name: str, edges: str) -> str:
    return f"{name} AS (SELECT * FROM {edges} WHERE (qd, qs, dst, src) IN (SELECT (qs, qd, src, dst) FROM {edges}))"


#: Triangles from lower to higher (degree, id), then every turn of each.
_TURNED = """,
up AS MATERIALIZED (SELECT src AS a, dst AS b, dst_deg AS b_deg FROM e WHERE (src_deg, src) < (dst_deg, dst)),
open AS MATERIALIZED (SELECT x.a, x.b, y.b AS c FROM up x JOIN up y ON y.a = x.a AND (x.b_deg, x.b) < (y.b_deg, y.b)),
tri AS MATERIALIZED (SELECT o.a, o.b, o.c FROM open o JOIN up z ON z.a = o.b AND z.b = o.c),
turned AS MATERIALIZED (SELECT a AS src, b AS dst, c AS w FROM tri UNION ALL SELECT b, a, c FROM tri UNION ALL SELECT a, c, b FROM tri UNION ALL SELECT c, a, b FROM tri UNION ALL SELECT b, c, a FROM tri UNION ALL SELECT c, b, a FROM tri)"""
_SUPPORT = f"""{_TURNED},
support AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM turned GROUP BY 1, 2)"""


def _cycles_sql() -> str:
    """Every turn of each four-cycle x-m1-y-m2, found from the pairs of paths between opposite ends, x the highest."""
    ring, turns = ("x", "m1", "y", "m2"), []
    for step in (1, -1):
        for i in range(4):
            a, b, c, d = (ring[(i + step * k) % 4] for k in range(4))
            across = lambda p, q: "xy" if {p, q} == {"x", "y"} else "mm"
            turns.append(f"SELECT {a} AS src, {b} AS dst, {c} AS x, {d} AS y, {across(a, c)} AS diag_src, {across(b, d)} AS diag_dst FROM ring")
    return f""",
half AS MATERIALIZED (SELECT p.src AS mid, p.dst AS x, q.dst AS y FROM e p JOIN e q ON q.src = p.src WHERE (p.dst_deg, p.dst) > (p.src_deg, p.src) AND (p.dst_deg, p.dst) > (q.dst_deg, q.dst)),
whole AS MATERIALIZED (SELECT a.x, a.mid AS m1, a.y, b.mid AS m2 FROM half a JOIN half b ON b.x = a.x AND b.y = a.y AND a.mid < b.mid),
ring AS MATERIALIZED (SELECT w.*, f.src IS NOT NULL AS xy, g.src IS NOT NULL AS mm FROM whole w LEFT JOIN e f ON f.src = w.x AND f.dst = w.y LEFT JOIN e g ON g.src = w.m1 AND g.dst = w.m2)
{" UNION ALL ".join(turns)}"""


def _rounds_sql(p: Pattern, rounds: int, support: bool) -> str:
    """CTEs ``cv<r>`` and ``ce<r>`` of rounds 1 to ``rounds``."""
    found = []
    for r in range(rounds):
        found += [
            _neighbor_sql(f"nv{r}", f"ce{r}", p), _alive_sql(f"na{r}", f"ce{r}", f"nv{r}"), _triangle_sql(f"nt{r}", f"na{r}", p, support), _square_sql(f"ns{r}", f"nt{r}", p),
            _back_sql(f"nb{r}", f"ns{r}"), _support_sql(f"cv{r + 1}", f"nb{r}"), _alive_sql(f"ce{r + 1}", f"nb{r}", f"cv{r + 1}"),
        ]
    return ",\n" + ",\n".join(found)


# --- SQL of orders and scores ------------------------------------------------------------------


def _orders_sql(p: Pattern, width: int | None = None, start: str = "WITH RECURSIVE ") -> str:
    """CTE ``ords(order_id, ord)``; ``ord`` is a list."""
    rank = {v: i for i, v in enumerate(orders.ranked(p))}
    vertices = ", ".join(f"({v}, {rank[v]})" for v in range(p.size))
    links = ", ".join(f"({a}, {b})" for a, b in sorted(p.edge_label))
    head = f"{start}pv(v, r) AS (VALUES {vertices}), pe(a, b) AS (VALUES {links}),\n"
    grow = "SELECT DISTINCT list_append(ord, pe.b) AS ord, list_append(ranks, pv.r) AS ranks FROM {level} JOIN pe ON list_contains(ord, pe.a) AND NOT list_contains(ord, pe.b) JOIN pv ON pv.v = pe.b"
    cut = (lambda q: q) if width is None else (lambda q: f"SELECT ord, ranks FROM (SELECT *, row_number() OVER (ORDER BY ranks) AS n FROM ({q})) WHERE n <= {width}")
    levels = [f"l1 AS ({cut('SELECT [v] AS ord, [r] AS ranks FROM pv')})"] + [f"l{k} AS ({cut(grow.format(level=f'l{k - 1}'))})" for k in range(2, p.size + 1)]
    return head + ",\n".join(levels) + f",\nords AS (SELECT (row_number() OVER (ORDER BY ranks) - 1)::INTEGER AS order_id, ord FROM l{p.size})"


_JOIN = "array_to_string(ord, ',')"


def _scores_sql(p: Pattern) -> str:
    """CTEs up to ``scores(order_id, k, est, weight, score)`` with exact prefix cardinalities on shipments."""
    keys = sorted({orders.prefix_key(o[:k]) for o in orders.exact(p) for k in range(1, p.size + 1)})
    counts = " UNION ALL ".join(f"SELECT '{k}' AS prefix_key, count(*)::DOUBLE AS est {_embeddings(p.induced(map(int, k.split(','))))}" for k in keys)
    return f"""{SHIP},
ests AS ({counts}),
{_orders_sql(p, start="")},
pref AS (SELECT order_id, k::INTEGER AS k, array_to_string(list_sort(ord[1:k]), ',') AS prefix_key FROM ords, range(1, {p.size + 1}) t(k)),
scores AS (SELECT order_id, k, est, 1.0::DOUBLE AS weight, sum(est) OVER (PARTITION BY order_id ORDER BY k) AS score FROM pref JOIN ests USING (prefix_key))"""


# --- queries -----------------------------------------------------------------------------------


def _shipments(spark: SparkSession, sf: str, edge_labels: bool = False) -> graph.Graph:
    return once(shipments, spark, sf, edge_labels=edge_labels)


def _baskets(spark: SparkSession, sf: str) -> graph.Graph:
    return once(baskets, spark, sf)


def _space(spark: SparkSession, sf: str, pattern: Pattern, rounds: int, of: Query = _shipments, support: bool = False) -> candidates.CandidateSpace:
    """The candidates after so many rounds."""
    g = of(spark, sf)
    v, e = candidates.initial(g, pattern)
    triangles = candidates.data_triangles(g, pattern, e) if rounds else None
    for _ in range(rounds):
        v, e = candidates.refine(pattern, v, e, triangles=triangles, support=support)
    return candidates.CandidateSpace(pattern, v, e)


def _planned(spark: SparkSession, sf: str, pattern: Pattern = TRIANGLE) -> tuple[DataFrame, DataFrame]:
    """Orders, and their scores from exact prefix cardinalities."""
    found = orders.orders_frame(spark, pattern)
    prefixes = orders.prefixes_frame(spark, pattern, found)
    g = _shipments(spark, sf)
    return found, ranking.progress(prefixes, written(ranking.exact_estimates(g, pattern, prefixes), "estimates"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _graph_summary(spark, sf):
    return graph.summary(_shipments(spark, sf))


def _core_bound(rounds: int) -> Query:
    return lambda spark, sf: graph.core_bounds(_baskets(spark, sf), rounds)


def _core_sql(rounds: int) -> str:
    steps = "".join(
        f""",
b{r + 1} AS (SELECT vid, least(bound, coalesce(h, 0))::INTEGER AS bound FROM b{r} LEFT JOIN (SELECT src AS vid, max(least(bound, pos)) AS h FROM
  (SELECT src, bound, row_number() OVER (PARTITION BY src ORDER BY bound DESC) AS pos FROM e JOIN b{r} ON b{r}.vid = e.dst) GROUP BY 1) USING (vid))"""
        for r in range(rounds)
    )
    return f"{BASKET},\nb0 AS (SELECT vid, deg AS bound FROM v){steps} SELECT vid, bound FROM b{rounds}"


def _tree_frames(spark, sf):
    space = _space(spark, sf, TRIANGLE, 0)
    return space, tree_sampling.subtree_counts(space, TREE)


def _candidate_tree_counts(spark, sf):
    _, counts = _tree_frames(spark, sf)
    return counts[TREE.root].select("v", "n")


def _tree_hits(spark, sf):
    space, g = _space(spark, sf, TRIANGLE, 0), _shipments(spark, sf)
    return tree_sampling.hits(g, space, TREE, tree_sampling.sampled(space, TREE, 0, TRIALS, SEED)).select("trial", "v0", "v1", "v2")


def _tree_estimate(spark, sf):
    space, g = _space(spark, sf, TRIANGLE, 0), _shipments(spark, sf)
    hit = tree_sampling.hits(g, space, TREE, tree_sampling.sampled(space, TREE, 0, TRIALS, SEED)).agg(F.count("*").alias("successes"))
    return hit.crossJoin(tree_sampling.tree_total(space, TREE)).select("successes", "total", F.round(F.col("successes") / F.lit(TRIALS) * F.col("total"), 6).alias("estimate"))


_TREE_SQL = f"""{SHIP}{_initial_sql(TRIANGLE)},
roots AS (SELECT v, ((SELECT count(*) FROM ce0 WHERE qs = 1 AND qd = 0 AND src = v) * (SELECT count(*) FROM ce0 WHERE qs = 1 AND qd = 2 AND src = v))::DOUBLE AS n FROM cv0 WHERE qv = 1),
rooted AS MATERIALIZED (SELECT v, n, sum(n) OVER (ORDER BY v % {tree_sampling.BUCKETS}, v) AS high, sum(n) OVER () AS total FROM roots WHERE n > 0)"""
_DRAW = "('0x' || substr(md5({seed} || ':' || trial || ':' || {q}), 1, 8))::BIGINT / 4294967296.0"
_HITS_SQL = f"""{_TREE_SQL},
trials AS MATERIALIZED (SELECT range AS trial, {", ".join(_DRAW.format(seed=f"'{SEED}'", q=f"'{q}'") + f" AS u{q}" for q in range(3))} FROM range({TRIALS})),
step AS MATERIALIZED (SELECT qs, qd, src, dst, row_number() OVER (PARTITION BY qs, qd, src ORDER BY dst) AS high, count(*) OVER (PARTITION BY qs, qd, src) AS total FROM ce0 WHERE qs = 1),
drawn AS MATERIALIZED (SELECT trial, a.dst AS v0, r.v AS v1, c.dst AS v2 FROM trials
  JOIN rooted r ON r.high - r.n <= floor(u1 * r.total) AND floor(u1 * r.total) < r.high
  JOIN step a ON a.qd = 0 AND a.src = r.v AND a.high - 1 <= floor(u0 * a.total) AND floor(u0 * a.total) < a.high
  JOIN step c ON c.qd = 2 AND c.src = r.v AND c.high - 1 <= floor(u2 * c.total) AND floor(u2 * c.total) < c.high),
hit AS MATERIALIZED (SELECT trial, v0, v1, v2 FROM drawn JOIN e ON e.src = v0 AND e.dst = v2)"""


def _strata(spark, sf):
    space = _space(spark, sf, PATH4, 0)
    return _rounded(graph_sampling.estimate(space, BUDGET, order=(0, 1, 2, 3), seed=SEED, least=4, checkpoint=False))


def _strata_sql() -> str:
    def level(k: int, v: int, row: list[str]) -> str:
        cols = ", ".join(f"f.{c}" for c in row)
        key = " || ':' || ".join(["'7'", *(f"f.{c}" for c in row), "c.dst"])
        return f"""x{k} AS (SELECT {cols}, c.dst AS v{v}, w, ub, count(*) OVER (PARTITION BY {cols}) AS n,
  row_number() OVER (PARTITION BY {cols} ORDER BY ('0x' || substr(md5({key}), 1, 8))::BIGINT, c.dst) AS place
  FROM f{k - 1} f JOIN ce0 c ON c.qs = {v - 1} AND c.qd = {v} AND c.src = f.v{v - 1}),
y{k} AS (SELECT *, least(greatest(ceil(n * 0.5), 4), ub, n)::BIGINT AS kept FROM x{k}),
f{k} AS (SELECT {", ".join([*row, f"v{v}"])}, w * n / kept AS w, greatest(ub // kept, 1) AS ub FROM y{k} WHERE place <= kept)"""

    return f"""{SHIP}{_initial_sql(PATH4)},
f0 AS (SELECT v AS v0, 1.0::DOUBLE AS w, greatest({BUDGET} // (SELECT count(*) FROM cv0 WHERE qv = 0), 1) AS ub FROM cv0 WHERE qv = 0),
{level(1, 1, ["v0"])},
{level(2, 2, ["v0", "v1"])}
SELECT round(sum(w), 6) AS estimate FROM f2 f JOIN ce0 c ON c.qs = 2 AND c.qd = 3 AND c.src = f.v2"""


def _extendable(spark, sf):
    space = _space(spark, sf, TRIANGLE, 0)
    frontier = space.edges.where("qs = 0 and qd = 1").select(F.col("src").alias("v0"), F.col("dst").alias("v1"))
    return graph_sampling.extended(space, frontier, (0, 1), 2).groupBy("v0", "v1").agg(F.count("*").alias("n"))


def _root_choice(spark, sf):
    return spark.createDataFrame([(candidates.root_of(_shipments(spark, sf), TRIANGLE),)], "root int")


def _matching(spark, sf):
    space = _space(spark, sf, STAR, 0)
    return candidates.matching_filter(STAR, space.vertices, space.edges).select("qv", "v")


def _hall_sql(p: Pattern, vertices: str = "cv0", edges: str = "ce0") -> str:
    """Hall's condition: every set of pattern neighbours has as many candidate neighbours."""
    tests = []
    for u in range(p.size):
        near = p.neighbors[u]
        for mask in range(1, 1 << len(near)):
            some = [n for i, n in enumerate(near) if mask >> i & 1]
            tests.append(f"(qv <> {u} OR (SELECT count(DISTINCT dst) FROM {edges} WHERE qs = {u} AND src = v AND qd IN ({', '.join(map(str, some))})) >= {len(some)})")
    return f"SELECT qv, v FROM {vertices} WHERE " + " AND ".join(tests)


def _usable_sql(p: Pattern, edges: str = "ce0") -> str:
    """Candidate edges with which the other pattern neighbours can still be matched: Hall's condition without the edge's ends."""
    tests = []
    for u in range(p.size):
        for q in p.neighbors[u]:
            rest = [n for n in p.neighbors[u] if n != q]
            for mask in range(1, 1 << len(rest)):
                some = [n for i, n in enumerate(rest) if mask >> i & 1]
                tests.append(f"((c.qs, c.qd) <> ({u}, {q}) OR (SELECT count(DISTINCT o.dst) FROM {edges} o WHERE o.qs = {u} AND o.src = c.src AND o.dst <> c.dst AND o.qd IN ({', '.join(map(str, some))})) >= {len(some)})")
    return f"SELECT c.qs, c.qd, c.src, c.dst FROM {edges} c WHERE " + " AND ".join(tests or ["true"])


def _mode_sql(p: Pattern, start: str, structure: candidates.Structure, neighborhood: candidates.Neighborhood) -> str:
    """Candidate edges after one round of a filter mode."""
    kind, ways = candidates.Structure, candidates.Neighborhood
    if neighborhood is ways.EDGE_MATCHING:
        parts = [f"um AS ({_usable_sql(p)})", _back_sql("ub", "um"), _alive_sql("na", "ub", "cv0")]
    else:
        nv = _neighbor_sql("nv", "ce0", p) if neighborhood is ways.LABELS else f"nv AS ({_hall_sql(p)})"
        parts = [nv, _alive_sql("na", "ce0", "nv")]
    parts.append("nt AS (SELECT * FROM na)" if structure is kind.NONE else _triangle_sql("nt", "na", p, True))
    parts.append(_square_sql("ns", "nt", p) if structure is kind.FOUR_CYCLES else "ns AS (SELECT * FROM nt)")
    parts += [_back_sql("nb", "ns"), _support_sql("cv1", "nb"), _alive_sql("ce1", "nb", "cv1")]
    return f"{start}{_initial_sql(p)}{'' if structure is kind.NONE else _SUPPORT},\n" + ",\n".join(parts) + " SELECT qs, qd, src, dst FROM ce1"


def _mode(p: Pattern, structure: candidates.Structure, neighborhood: candidates.Neighborhood) -> Query:
    return lambda spark, sf: candidates.build(_shipments(spark, sf), p, structure, neighborhood, max_rounds=1).edges.select("qs", "qd", "src", "dst")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _from_text(spark, sf):
    """Edges of the graph after it was written as text and read again."""
    path = _folder(spark, "graph-text")
    graph_text.write(_shipments(spark, sf), path)
    return graph_text.read(spark, path).edges


def _stored_index(spark, sf, of: Query, four_cycles: bool = False) -> index_store.Index:
    folder = _folder(spark, "index")
    index_store.save(of(spark, sf), folder, four_cycles=four_cycles)
    return index_store.load(spark, folder)


def _index_states(spark, sf):
    """States of an index before it is written, after, when the graph has changed, and when a table is gone."""
    places = table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("src"), (F.col("c_nationkey") * 2 + 1).cast("bigint").alias("dst"), F.lit(0).alias("elabel"))
    made = lambda edges: graph.build(edges.select(F.col("src").alias("vid")).union(edges.select("dst")).distinct().withColumn("raw_label", F.lit(0)), edges)
    g, folder = made(places).stored("index-states"), _folder(spark, "index")
    states = [index_store.status(spark, folder, g)]
    index_store.save(g, folder, four_cycles=False)
    states += [index_store.status(spark, folder, g), index_store.status(spark, folder, made(places.where("src > 2")))]
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/triangles/_SUCCESS")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, False)
    states.append(index_store.status(spark, folder, g))
    return spark.createDataFrame([(i, x.value) for i, x in enumerate(states)], "step int, status string")


#: A pattern as JSON, with ids that are not ranks, an edge without a label and one given twice.
_QUERY = {"vertices": [{"id": 40, "label": 20}, {"id": 10, "label": 0}, {"id": 30, "label": 10}], "edges": [{"source": 40, "target": 10}, {"id": 9, "source": 10, "target": 30, "label": 0}, {"source": 30, "target": 40}, {"source": 10, "target": 40}]}
_REFUSED = {
    "disconnected": {"vertices": [{"id": 0}, {"id": 1}, {"id": 2}], "edges": [{"source": 0, "target": 1}]},
    "self_loop": {"vertices": [{"id": 0}], "edges": [{"source": 0, "target": 0}]},
    "unknown_endpoint": {"vertices": [{"id": 0}], "edges": [{"source": 0, "target": 99}]},
    "duplicate_id": {"vertices": [{"id": 0}, {"id": 0}], "edges": []},
    "empty": {"vertices": [], "edges": []},
}


def _pattern_json(spark, sf):
    found = normalize(json.loads(json.dumps(_QUERY)))
    rows = [("v", i, found.ids[i], x) for i, x in enumerate(found.labels)] + [("e", a, b, x) for a, b, x in found.edges]
    return spark.createDataFrame(rows, "part string, a int, b int, label int")


def _refusals(spark, sf):
    rows = []
    for name, query in _REFUSED.items():
        try:
            normalize(query)
        except ValidationError as e:
            rows.append((name, e.code))
    return spark.createDataFrame(rows, "case string, code string")


def _payloads(spark, sf):
    """Payloads of a match order's prefixes, and whether they come back whole."""
    rows = []
    for k in range(1, DIAMOND.size + 1):
        prefix = orders.prefix(DIAMOND, (0, 1, 2, 3), k)
        payload = json.loads(json.dumps(estimator.payload_of(prefix)))
        rows.append((k, payload["num_vertices"], payload["num_edges"], estimator.of_payload(payload) == prefix))
    return spark.createDataFrame(rows, "k int, num_vertices int, num_edges int, whole boolean")


def _pattern_motifs(spark, sf):
    rows = [("triangle", a, b, w, None, None, None) for a, b, w in DIAMOND.triangles] + [("four_cycle", *c) for c in DIAMOND.four_cycles]
    return spark.createDataFrame(rows, "motif string, a int, b int, x int, y int, ax boolean, by boolean")


def _pattern_motifs_sql() -> str:
    links = ", ".join(f"({a}, {b})" for a, b in sorted(DIAMOND.edge_label))
    return f"""WITH pe(a, b) AS (VALUES {links})
SELECT 'triangle' AS motif, p.a, p.b, q.b AS x, NULL::INTEGER AS y, NULL::BOOLEAN AS ax, NULL::BOOLEAN AS by FROM pe p JOIN pe q ON q.a = p.a JOIN pe r ON r.a = p.b AND r.b = q.b
UNION ALL SELECT 'four_cycle', p.a, p.b, q.b, r.b, (p.a, q.b) IN (SELECT (a, b) FROM pe), (p.b, r.b) IN (SELECT (a, b) FROM pe) FROM pe p JOIN pe q ON q.a = p.b AND q.b <> p.a JOIN pe r ON r.a = q.b AND r.b NOT IN (p.a, p.b) JOIN pe s ON s.a = r.b AND s.b = p.a"""


def _core_candidates(spark, sf):
    g = _baskets(spark, sf)
    return candidates.vertex_candidates(g, SQUARE, graph.core_numbers(g))


def _core_candidates_sql() -> str:
    needed = ", ".join(f"({v}, {SQUARE.labels[v]}, {len(SQUARE.neighbors[v])}, {SQUARE.cores[v]})" for v in range(SQUARE.size))
    return _core_sql(24).replace("SELECT vid, bound FROM b24", f"SELECT qv, vid AS v FROM b24 JOIN v USING (vid) JOIN (VALUES {needed}) q(qv, raw_label, q_deg, q_core) USING (raw_label) WHERE deg >= q_deg AND bound >= q_core")


def _static_order(spark, sf):
    order = graph_sampling.static_order(_space(spark, sf, TRIANGLE, 0))
    return spark.createDataFrame(list(enumerate(order)), "position int, qv int")


def _query_tree(spark, sf):
    tree = tree_sampling.spanning_tree(_space(spark, sf, TRIANGLE, 0))
    return spark.createDataFrame([(min(e), max(e), tree.root) for e in tree.edges], "a int, b int, root int")


def _tree_settled(spark, sf):
    space = _space(spark, sf, TRIANGLE, 0)
    found = tree_sampling.estimate(_shipments(spark, sf), space, TREE, SEED)
    return spark.createDataFrame([(found.trials, found.successes, found.total, round(found.estimate, 6), found.gave_up)], "trials bigint, successes bigint, total double, estimate double, gave_up boolean")


#: Trials up to which the SQL of the stop rule looks.
_LOOKS = 4000


def _settled_sql() -> str:
    """The first look from 1000 trials on, each 100, whose successes are as many as the confidence bounds take to lie near the rate."""
    needed, least = [], 1
    for trials in range(tree_sampling.FIRST, _LOOKS + 1, tree_sampling.STEP):
        # more successes have closer bounds, and the number needed hardly changes from look to look
        while not stats.settled(trials, least):
            least += 8 if least < 64 else 1
        while least > 1 and stats.settled(trials, least - 1):
            least -= 1
        needed.append((trials, least))
    return f"""{_HITS_SQL.replace(f"FROM range({TRIALS})", f"FROM range({_LOOKS})")},
looks(trials, least) AS (VALUES {", ".join(map(str, needed))}),
seen AS (SELECT trials, least, (SELECT count(*) FROM hit WHERE trial < trials) AS successes FROM looks),
stopped AS (SELECT trials, successes FROM seen WHERE successes >= least ORDER BY trials LIMIT 1)
SELECT trials::BIGINT AS trials, successes, (SELECT sum(n) FROM roots) AS total, round(successes / trials::DOUBLE * (SELECT sum(n) FROM roots), 6) AS estimate, false AS gave_up FROM stopped"""


def _estimated(spark, sf):
    found = estimator.estimate(_shipments(spark, sf), PATH3)
    return spark.createDataFrame([(found["estimate"], found["trees"], found["method"], found["trials"], found["successes"])], "estimate double, trees double, method string, trials bigint, successes bigint")


def _exact_counts(spark, sf) -> Callable[[Pattern], float]:
    g = _shipments(spark, sf).part(TRIANGLE)
    return lambda p: float(matcher.count(g, p).first()[0])


def _beam_by_score(spark, sf):
    found = ranking.beam_by_score(_shipments(spark, sf), TRIANGLE, _exact_counts(spark, sf), 2)
    return spark.createDataFrame([(i, ",".join(map(str, o))) for i, o in enumerate(found)], "place int, ord string")


def _beam_by_score_sql() -> str:
    """Each level keeps two orders: by score, then by the place of what they grew from, then by the rank of what was added."""
    rank = ", ".join(f"({v}, {r})" for r, v in enumerate(orders.ranked(TRIANGLE)))
    grown, parent = "", None
    for k in range(1, _N + 1):
        source = "" if parent is None else f" JOIN b{parent} b ON b.head = p.ord[1:{k - 1}]"
        place = "0" if parent is None else "b.place"
        grown += f""",
g{k} AS (SELECT DISTINCT p.ord[1:{k}] AS head, p.score, {place} AS parent, r.r FROM parts p JOIN ranks r ON r.v = p.ord[{k}]{source} WHERE p.k = {k}),
b{k} AS (SELECT head, row_number() OVER (ORDER BY score, parent, r) AS place FROM g{k} QUALIFY place <= 2)"""
        parent = k
    return f"""{_scores_sql(TRIANGLE)},
ranks(v, r) AS (VALUES {rank}),
parts AS (SELECT ord, k, score FROM scores JOIN ords USING (order_id)){grown}
SELECT (place - 1)::INTEGER AS place, array_to_string(head, ',') AS ord FROM b{_N}"""


def _generated(p: Pattern, width: int | None = None) -> Query:
    return lambda spark, sf: spark.createDataFrame([(i, ",".join(map(str, o))) for i, o in enumerate(orders.generate(p, width))], "order_id int, ord string")


def _served(spark, sf):
    """A planning session in process, with exact counts for estimates."""
    service = Service(spark)
    service.register("shipments", _shipments(spark, sf))
    query = {"vertices": [{"id": 5 * i, "label": x} for i, x in enumerate(TRIANGLE.labels)], "edges": [{"source": 5 * a, "target": 5 * b} for a, b, _ in TRIANGLE.edges]}
    return service, service.create_session("shipments", query, estimate=_exact_counts(spark, sf))


def _served_ranking(spark, sf):
    service, session = _served(spark, sf)
    return spark.createDataFrame([(r["order_id"], ",".join(map(str, r["order"])), r["score"], r["rank"]) for r in service.result(session.id)["ranking"]], "order_id int, ord string, score double, rank int")


def _served_events(spark, sf):
    """How often each event came in the session's stream."""
    service, session = _served(spark, sf)
    events_of = [e for m in service.stream(session.id) for e in (m["data"]["events"] if m["event"] == "batch_update" else [m])]
    return spark.createDataFrame([(e["event"],) for e in events_of], "event string").groupBy("event").agg(F.count("*").alias("n"))


def _served_count(spark, sf):
    service, session = _served(spark, sf)
    return service.execute(session.id)


def _served_datasets(spark, sf):
    service = Service(spark)
    service.register("shipments", _shipments(spark, sf))
    service.register("unbuilt", index=_folder(spark, "no-index"))
    return spark.createDataFrame([(d["id"], d["num_vertices"], d["num_edges"], len(d["labels"]), d["index_status"]) for d in service.datasets()], "id string, num_vertices bigint, num_edges bigint, num_labels int, index_status string")


def _served_errors(spark, sf):
    """Status and code of requests that are refused."""
    service, rows = Service(spark), []
    service.register("shipments", _shipments(spark, sf))
    service.register("unbuilt", index=_folder(spark, "no-index"))
    tries = {
        "no_dataset": lambda: service.create_session("nonexistent", _QUERY), "not_ready": lambda: service.create_session("unbuilt", _QUERY), "no_session": lambda: service.snapshot("none"),
        **{name: (lambda q=q: service.create_session("shipments", q)) for name, q in _REFUSED.items()},
    }
    for name, call in tries.items():
        try:
            call()
        except ServiceError as e:
            rows.append((name, e.status, e.code))
    return spark.createDataFrame(rows, "request string, status int, code string")


def _events_ms(spark, sf):
    return table(spark, sf, "events").withColumn("ms", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) div 1000"))


def _batches(spark, sf):
    return events.batches(_events_ms(spark, sf), "user_id", "ms", "event_type", "event_id", WINDOW_MS, WAITING)


_BATCH_SQL = f"""WITH RECURSIVE ev AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type IN ('view', 'click') AS waits, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
fold AS (SELECT user_id, i, ms, waits, ms AS start, 1::BIGINT AS b FROM ev WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.ms, e.waits, CASE WHEN e.waits AND f.waits AND e.ms < f.start + {WINDOW_MS} THEN f.start ELSE e.ms END, CASE WHEN e.waits AND f.waits AND e.ms < f.start + {WINDOW_MS} THEN f.b ELSE f.b + 1 END
  FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, min(start) AS batch_start_ms, max(ms) AS last_ms, count(*)::BIGINT AS n_events, NOT bool_and(waits) AS immediate FROM fold GROUP BY user_id, b"""


def _tumbling(spark, sf):
    found = events.tumbling(table(spark, sf, "events"), "ts", "event_type", "1 hour")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event", "n")


def _session(spark, sf):
    found, scores = _planned(spark, sf)
    return events.session_events(found, scores, TRIANGLE.size)


def _session_sql() -> str:
    return f"""{_scores_sql(TRIANGLE)},
every AS (SELECT 0 AS stage, 0 AS level, 0 AS o, i AS part, e AS event, NULL::INTEGER AS order_id, NULL::INTEGER AS k, NULL::DOUBLE AS value FROM (VALUES (0, 'index_loading'), (1, 'index_loaded'), (2, 'session_started')) t(i, e)
 UNION ALL SELECT 1, 0, order_id, 0, 'order_generated', order_id, NULL, NULL FROM ords
 UNION ALL SELECT 2, k, order_id, 0, 'prefix_progress', order_id, k, est FROM scores UNION ALL SELECT 2, k, order_id, 1, 'score_updated', order_id, k, score FROM scores
 UNION ALL SELECT 2, k, 2147483647, 2, 'ranking_updated', NULL, k, NULL FROM scores GROUP BY k
 UNION ALL SELECT 3, 0, 0, 0, 'session_completed', NULL, NULL, min(score) FROM scores WHERE k = {TRIANGLE.size})"""


def _qerrors(spark, sf):
    stats = written(graph.label_stats(_shipments(spark, sf).labelled), "label-stats")
    uniform = stats.crossJoin(F.broadcast(stats.agg((F.sum("n") / F.count("*")).alias("est"))))  # one row
    return _rounded(metrics.summary(uniform, metrics.qerror("n", "est")).crossJoin(uniform.agg(F.sum(metrics.log_qerror("n", "est")).alias("log_total"))))


def _exact(pattern: Pattern, of: Callable = _shipments) -> Query:
    return lambda spark, sf: matcher.count(of(spark, sf), pattern)


def _cs_vertices(pattern: Pattern, rounds: int, of: Query = _shipments, support: bool = False) -> Query:
    return lambda spark, sf: _space(spark, sf, pattern, rounds, of, support).vertices.select("qv", "v")


def _cs_edges(pattern: Pattern, rounds: int, of: Query = _shipments, support: bool = False) -> Query:
    return lambda spark, sf: _space(spark, sf, pattern, rounds, of, support).edges.select("qs", "qd", "src", "dst")


def _filtered(kind: str, pattern: Pattern, of: Query = _shipments) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        space = _space(spark, sf, pattern, 0, of)
        if kind == "neighbors":
            return candidates.neighbor_filter(pattern, space.vertices, space.edges)
        if kind == "triangles":
            return candidates.triangle_filter(pattern, space.edges, candidates.data_triangles(of(spark, sf), pattern, space.edges))
        return candidates.four_cycle_filter(pattern, space.edges)

    return run


def _space_at_fixpoint(spark, sf):
    space = candidates.build(_shipments(spark, sf), TRIANGLE)
    return space.vertices.groupBy("qv").agg(F.count("*").alias("n_vertices"))


def _of_scores(make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: make(*_planned(spark, sf))


def _joined(df: DataFrame) -> DataFrame:
    return df.select("order_id", F.array_join("ord", ",").alias("ord"))


_N = TRIANGLE.size
#: Name: query, SQL or a function that makes it (None where SQL cannot say it).
ENTRIES: dict[str, tuple[Query, str | Callable[[], str] | None]] = {
    "graph_vertices": (lambda s, d: shipments(s, d).vertices, f"{SHIP} SELECT vid, raw_label, label, deg FROM v"),
    "graph_edges": (lambda s, d: shipments(s, d).edges, f"{SHIP} SELECT src, dst, elabel, src_label, dst_label, src_deg, dst_deg FROM e"),
    "graph_edges_labeled": (lambda s, d: shipments(s, d, edge_labels=True).edges.select("src", "dst", "elabel"), f"{SHIP_LABELED} SELECT src, dst, elabel FROM e"),
    "graph_summary": (_graph_summary, f"{SHIP} SELECT count(*) AS num_vertices, sum(deg)::BIGINT AS num_directed_edges, count(DISTINCT label) AS num_labels, max(deg) AS max_degree, round(sum(deg) / count(*), 6) AS avg_degree FROM v"),
    "label_recode": (lambda s, d: graph.label_codes(_shipments(s, d).labelled.select("vid", "raw_label")), f"{SHIP} SELECT raw_label, label FROM codes"),
    "label_stats": (lambda s, d: _rounded(graph.label_stats(_shipments(s, d).labelled)), f"{SHIP} SELECT label, count(*) AS n, round((0.0001 + count(*)) / (SELECT count(*) FROM v), 6) AS prob FROM v GROUP BY 1"),
    "label_entropy": (lambda s, d: _rounded(graph.label_entropy(_shipments(s, d).labelled)), f"{SHIP}, p AS (SELECT (0.0001::DOUBLE + count(*)) / (SELECT count(*) FROM v) AS p FROM v GROUP BY label) SELECT round(sum(-p * log2(p)), 6) AS entropy FROM p"),
    "vertices_by_label_rank": (lambda s, d: graph.vertices_by_label(_shipments(s, d).vertices), f"{SHIP} SELECT label, vid, deg, row_number() OVER (PARTITION BY label ORDER BY deg DESC, vid) AS position FROM v"),
    "degree_distribution": (lambda s, d: graph.degree_distribution(_shipments(s, d).vertices), f"{SHIP} SELECT deg, count(*) AS n FROM v GROUP BY 1"),
    "incident_edges": (lambda s, d: graph.incident(_shipments(s, d), 4).select("src", "dst", "elabel", "dst_label", "dst_deg"), f"{SHIP} SELECT src, dst, elabel, dst_label, dst_deg FROM e WHERE src = 4"),
    "edge_lookup": (
        lambda s, d: graph.edge_between(_shipments(s, d), table(s, d, "lineitem").select((F.col("l_orderkey") * 3).alias("src"), (F.col("l_linenumber") * 3 + 1).cast("bigint").alias("dst")).distinct()),
        f"{SHIP} SELECT q.src, q.dst, e.elabel FROM (SELECT DISTINCT l_orderkey * 3 AS src, (l_linenumber * 3 + 1)::BIGINT AS dst FROM lineitem) q LEFT JOIN e ON e.src = q.src AND e.dst = q.dst",
    ),
    "kcore_bound_r3": (_core_bound(3), _core_sql(3)),
    "kcore": (lambda s, d: graph.core_numbers(_baskets(s, d)), _core_sql(24).replace("SELECT vid, bound FROM b24", "SELECT vid, bound AS core FROM b24")),
    "degeneracy": (lambda s, d: graph.core_numbers(_baskets(s, d)).agg(F.max("core").alias("degeneracy")), _core_sql(24).rsplit("SELECT", 1)[0] + "SELECT max(bound) AS degeneracy FROM b24"),
    "coloring": (
        # a proper coloring is not unique: what is compared is that no edge joins equal colors and all vertices have one
        lambda s, d: _color_check(s, d),
        f"{BASKET} SELECT count(*) AS colored, 0::BIGINT AS conflicts FROM v",
    ),
    "triangle_index": (lambda s, d: motifs.triangle_index(_shipments(s, d)), f"{SHIP}{_TURNED} SELECT src, dst, w FROM turned"),
    "triangle_count": (lambda s, d: motifs.triangles(_shipments(s, d)).agg(F.count("*").alias("triangles")), f"{SHIP} SELECT count(*) // 6 AS triangles FROM e x JOIN e y ON y.src = x.src JOIN e z ON z.src = x.dst AND z.dst = y.dst"),
    "edge_support": (lambda s, d: motifs.edge_support(_shipments(s, d)), f"{SHIP}{_SUPPORT} SELECT src, dst, n FROM support"),
    "four_cycle_index": (lambda s, d: motifs.four_cycle_index(_baskets(s, d)), f"{BASKET}{_cycles_sql()}"),
    "four_cycle_count": (lambda s, d: motifs.four_cycle_count(_shipments(s, d)), f"{SHIP} SELECT (sum(n * (n - 1) // 2) // 2)::BIGINT AS four_cycles FROM (SELECT x.dst AS u, y.dst AS w, count(*) AS n FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2)"),
    "motif_summary": (
        lambda s, d: motifs.summary(_baskets(s, d)),
        f"{BASKET} SELECT (SELECT count(*) // 6 FROM e x JOIN e y ON y.src = x.src JOIN e z ON z.src = x.dst AND z.dst = y.dst) AS triangle_count,"
        " (SELECT (sum(n * (n - 1) // 2) // 2)::BIGINT FROM (SELECT x.dst AS u, y.dst AS w, count(*) AS n FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2)) AS four_cycle_count, round(avg(deg), 6) AS avg_degree, max(deg) AS max_degree FROM v",
    ),
    "root_choice": (_root_choice, f"{SHIP}, q(qv, raw_label) AS (VALUES (0, 0), (1, 10), (2, 20)) SELECT qv::INTEGER AS root FROM q LEFT JOIN v USING (raw_label) GROUP BY qv ORDER BY count(vid), qv DESC LIMIT 1"),
    "root_candidates": (lambda s, d: candidates.vertex_candidates(_shipments(s, d), TRIANGLE), f"{SHIP}{_initial_sql(TRIANGLE)} SELECT qv, v FROM va"),
    "initial_cs_vertex": (_cs_vertices(TRIANGLE, 0), f"{SHIP}{_initial_sql(TRIANGLE)} SELECT qv, v FROM cv0"),
    "initial_cs_edge": (_cs_edges(TRIANGLE, 0), f"{SHIP}{_initial_sql(TRIANGLE)} SELECT qs, qd, src, dst FROM ce0"),
    "neighbor_safety": (_filtered("neighbors", STAR), f"{SHIP}{_initial_sql(STAR)}, {_neighbor_sql('nv', 'ce0', STAR)} SELECT qv, v FROM nv"),
    "triangle_safety": (_filtered("triangles", TRIANGLE), f"{SHIP}{_initial_sql(TRIANGLE)}{_SUPPORT}, {_triangle_sql('nt', 'ce0', TRIANGLE, True)} SELECT qs, qd, src, dst FROM nt"),
    "fourcycle_safety": (_filtered("squares", SQUARE, _baskets), f"{BASKET}{_initial_sql(SQUARE)}, {_square_sql('ns', 'ce0', SQUARE)} SELECT qs, qd, src, dst FROM ns"),
    "edge_support_filter": (
        lambda s, d: candidates.support_filter(PATH3, (v := candidates.vertex_candidates(g := _shipments(s, d), PATH3)), candidates.edge_candidates(g, PATH3, v)),
        f"{SHIP}{_initial_sql(PATH3)} SELECT qv, v FROM cv0",
    ),
    "bipartite_safety": (_matching, f"{SHIP}{_initial_sql(STAR)} {_hall_sql(STAR)}"),
    "cs_refined_r2": (_cs_vertices(TRIANGLE, 2, support=True), f"{SHIP}{_initial_sql(TRIANGLE)}{_SUPPORT}{_rounds_sql(TRIANGLE, 2, True)} SELECT qv, v FROM cv2"),
    "cs_edges_r2": (_cs_edges(TRIANGLE, 2, support=True), f"{SHIP}{_initial_sql(TRIANGLE)}{_SUPPORT}{_rounds_sql(TRIANGLE, 2, True)} SELECT qs, qd, src, dst FROM ce2"),
    "cs_square_r2": (_cs_vertices(SQUARE, 2, _baskets), f"{BASKET}{_initial_sql(SQUARE)}{_rounds_sql(SQUARE, 2, False)} SELECT qv, v FROM cv2"),
    "cs_sizes_fixpoint": (_space_at_fixpoint, f"{SHIP}{_initial_sql(TRIANGLE)}{_SUPPORT}{_rounds_sql(TRIANGLE, 4, True)} SELECT qv, count(*) AS n_vertices FROM cv4 GROUP BY 1"),
    "spanning_tree_weights": (
        lambda s, d: _rounded(tree_sampling.edge_weights(_space(s, d, TRIANGLE, 0))),
        f"{SHIP}{_initial_sql(TRIANGLE)} SELECT qs, qd, count(*) AS n, round(count(*) / ((SELECT count(*) FROM cv0 WHERE qv = qs)::DOUBLE * (SELECT count(*) FROM cv0 WHERE qv = qd)), 6) AS density FROM ce0 WHERE qs < qd GROUP BY qs, qd",
    ),
    "candidate_tree_counts": (_candidate_tree_counts, f"{_TREE_SQL} SELECT v, n FROM roots WHERE n > 0"),
    "candidate_tree_total": (lambda s, d: tree_sampling.tree_total(_space(s, d, TRIANGLE, 0), TREE), f"{_TREE_SQL} SELECT sum(n) AS total FROM roots"),
    "tree_sample_hits": (_tree_hits, f"{_HITS_SQL} SELECT trial, v0, v1, v2 FROM hit"),
    "tree_estimate": (_tree_estimate, f"{_HITS_SQL} SELECT count(*) AS successes, (SELECT sum(n) FROM roots) AS total, round(count(*) / {float(TRIALS)} * (SELECT sum(n) FROM roots), 6) AS estimate FROM hit"),
    "extendable_candidates": (_extendable, f"{SHIP}{_initial_sql(TRIANGLE)} SELECT x.src AS v0, x.dst AS v1, count(*) AS n FROM ce0 x JOIN ce0 y ON y.qs = 0 AND y.qd = 2 AND y.src = x.src JOIN ce0 z ON z.qs = 1 AND z.qd = 2 AND z.src = x.dst AND z.dst = y.dst WHERE x.qs = 0 AND x.qd = 1 GROUP BY 1, 2"),
    "graph_sample_estimate": (_strata, _strata_sql()),
    "exact_vertex": (_exact(Pattern((0,), ())), _count_sql(Pattern((0,), ()))),
    "exact_path3": (_exact(PATH3), _count_sql(PATH3)),
    "exact_path4": (_exact(PATH4), _count_sql(PATH4)),
    "exact_triangle": (_exact(TRIANGLE), _count_sql(TRIANGLE)),
    "exact_square": (_exact(SQUARE, _baskets), _count_sql(SQUARE, BASKET)),
    "exact_diamond": (_exact(DIAMOND), _count_sql(DIAMOND)),
    "exact_star3": (_exact(STAR), _count_sql(STAR)),
    "exact_same_label_path": (_exact(path(0, 10, 0)), _count_sql(path(0, 10, 0))),
    "exact_edge_labeled": (_exact(LABELED, lambda s, d: _shipments(s, d, edge_labels=True)), _count_sql(LABELED, SHIP_LABELED)),
    "match_triangle": (lambda s, d: matcher.match(_shipments(s, d), TRIANGLE), f"{SHIP}{_TURNED} SELECT t.src AS v0, t.dst AS v1, t.w AS v2 FROM turned t JOIN v x ON x.vid = t.src AND x.raw_label = 0 JOIN v y ON y.vid = t.dst AND y.raw_label = 10 JOIN v z ON z.vid = t.w AND z.raw_label = 20"),
    "orders_exact_triangle": (lambda s, d: _joined(orders.orders_frame(s, TRIANGLE)), f"{_orders_sql(TRIANGLE)} SELECT order_id, {_JOIN} AS ord FROM ords"),
    "orders_exact_path4": (lambda s, d: _joined(orders.orders_frame(s, path(0, 0, 1, 0))), f"{_orders_sql(path(0, 0, 1, 0))} SELECT order_id, {_JOIN} AS ord FROM ords"),
    "orders_beam": (lambda s, d: _joined(orders.orders_frame(s, DIAMOND, 5)), f"{_orders_sql(DIAMOND, 5)} SELECT order_id, {_JOIN} AS ord FROM ords"),
    "prefix_edges": (
        lambda s, d: orders.prefix_edges_frame(s, DIAMOND, orders.orders_frame(s, DIAMOND)),
        f"{_orders_sql(DIAMOND)}, h AS (SELECT order_id, k::INTEGER AS k, list_sort(ord[1:k]) AS head FROM ords, range(1, {DIAMOND.size + 1}) t(k))"
        " SELECT order_id, k, (list_position(head, a) - 1)::INTEGER AS a, (list_position(head, b) - 1)::INTEGER AS b, 0 AS elabel FROM h JOIN pe ON a < b AND list_contains(head, a) AND list_contains(head, b)",
    ),
    "prefix_cardinality": (
        lambda s, d: ranking.exact_estimates(_shipments(s, d), TRIANGLE, orders.prefixes_frame(s, TRIANGLE, orders.orders_frame(s, TRIANGLE))),
        f"{_scores_sql(TRIANGLE)} SELECT prefix_key, est FROM ests",
    ),
    "order_scores": (_of_scores(lambda o, x: x), f"{_scores_sql(TRIANGLE)} SELECT order_id, k, est, weight, score FROM scores"),
    "order_ranking_by_level": (_of_scores(lambda o, x: ranking.ranking_by_level(x)), f"{_scores_sql(TRIANGLE)} SELECT k, order_id, score, row_number() OVER (PARTITION BY k ORDER BY score, order_id)::INTEGER AS rank FROM scores"),
    "order_ranking_final": (
        _of_scores(lambda o, x: ranking.final_ranking(o, x, _N)),
        f"{_scores_sql(TRIANGLE)} SELECT order_id, {_JOIN} AS ord, score, row_number() OVER (ORDER BY score, order_id)::INTEGER AS rank FROM scores JOIN ords USING (order_id) WHERE k = {_N}",
    ),
    "order_topk": (
        _of_scores(lambda o, x: ranking.top(ranking.final_ranking(o, x, _N), 3)),
        f"{_scores_sql(TRIANGLE)} SELECT order_id, {_JOIN} AS ord, score, row_number() OVER (ORDER BY score, order_id)::INTEGER AS rank FROM scores JOIN ords USING (order_id) WHERE k = {_N} ORDER BY score, order_id LIMIT 3",
    ),
    "best_order": (_of_scores(lambda o, x: ranking.best(x, _N)), f"{_scores_sql(TRIANGLE)} SELECT order_id, score FROM scores WHERE k = {_N} ORDER BY score, order_id LIMIT 1"),
    "best_order_compat": (_of_scores(lambda o, x: ranking.best_so_far(x)), f"{_scores_sql(TRIANGLE)} SELECT k, order_id, score FROM scores ORDER BY score, k, order_id LIMIT 1"),
    "score_pivot": (
        _of_scores(lambda o, x: ranking.pivot(x, list(range(5)))),
        f"{_scores_sql(TRIANGLE)} SELECT k, " + ", ".join(f"max(score) FILTER (order_id = {i}) AS order_{i}" for i in range(5)) + " FROM scores GROUP BY k",
    ),
    "progress_pct": (_of_scores(lambda o, x: ranking.progress_percent(x, _N, 6)), f"{_scores_sql(TRIANGLE)} SELECT k, round(least(100.0::DOUBLE, 100.0::DOUBLE * sum(count(*)) OVER (ORDER BY k) / {_N * 6}), 6) AS percent FROM scores GROUP BY k"),
    "session_events": (_session, f"{_session_sql()} SELECT row_number() OVER (ORDER BY stage, level, o, part) - 1 AS seq, event, order_id, k, value FROM every"),
    "session_fold": (
        lambda s, d: events.folded(_session(s, d)),
        f"{_session_sql()} SELECT 'session_completed' AS last_event, count(*) FILTER (event = 'order_generated') AS total_orders, count(*) FILTER (event = 'prefix_progress') AS points, max(value) FILTER (event = 'session_completed') AS best_score FROM every",
    ),
    "degeneracy_order": (lambda s, d: graph.degeneracy_order(graph.core_numbers(_baskets(s, d))), _core_sql(24).replace("SELECT vid, bound FROM b24", "SELECT vid, bound AS core, row_number() OVER (ORDER BY bound DESC, vid) AS position FROM b24")),
    "root_candidates_core": (_core_candidates, _core_candidates_sql()),
    "bipartite_edge_safety": (lambda s, d: candidates.matching_filter(STAR, (x := _space(s, d, STAR, 0)).vertices, x.edges, drop_edges=True), f"{SHIP}{_initial_sql(STAR)} {_usable_sql(STAR)}"),
    "cs_mode_none": (_mode(TRIANGLE, candidates.Structure.NONE, candidates.Neighborhood.LABELS), _mode_sql(TRIANGLE, SHIP, candidates.Structure.NONE, candidates.Neighborhood.LABELS)),
    "cs_mode_triangles": (_mode(DIAMOND, candidates.Structure.TRIANGLES, candidates.Neighborhood.LABELS), _mode_sql(DIAMOND, SHIP, candidates.Structure.TRIANGLES, candidates.Neighborhood.LABELS)),
    "cs_mode_vertex_matching": (_mode(STAR, candidates.Structure.NONE, candidates.Neighborhood.VERTEX_MATCHING), _mode_sql(STAR, SHIP, candidates.Structure.NONE, candidates.Neighborhood.VERTEX_MATCHING)),
    "cs_mode_edge_matching": (_mode(STAR, candidates.Structure.NONE, candidates.Neighborhood.EDGE_MATCHING), _mode_sql(STAR, SHIP, candidates.Structure.NONE, candidates.Neighborhood.EDGE_MATCHING)),
    "cs_square_indexed": (
        lambda s, d: candidates.build(_stored_index(s, d, _baskets, four_cycles=True).graph, SQUARE, max_rounds=1).edges.select("qs", "qd", "src", "dst"),
        f"{BASKET}{_initial_sql(SQUARE)}{_rounds_sql(SQUARE, 1, False)} SELECT qs, qd, src, dst FROM ce1",
    ),
    "text_graph": (_from_text, f"{SHIP} SELECT src, dst, elabel, src_label, dst_label, src_deg, dst_deg FROM e"),
    "index_support": (lambda s, d: motifs.edge_support(_stored_index(s, d, _shipments).graph), f"{SHIP}{_SUPPORT} SELECT src, dst, n FROM support"),
    "index_states": (_index_states, "SELECT * FROM (VALUES (0, 'missing'), (1, 'ready'), (2, 'stale'), (3, 'invalid')) t(step, status)"),
    "pattern_json": (_pattern_json, "SELECT * FROM (VALUES ('v', 0, 10, 0), ('v', 1, 30, 10), ('v', 2, 40, 20), ('e', 0, 1, 0), ('e', 0, 2, 0), ('e', 1, 2, 0)) t(part, a, b, label)"),
    "pattern_refusals": (_refusals, "SELECT * FROM (VALUES ('disconnected', 'DISCONNECTED_GRAPH'), ('self_loop', 'SELF_LOOP'), ('unknown_endpoint', 'INVALID_EDGE_ENDPOINT'), ('duplicate_id', 'DUPLICATE_VERTEX_ID'), ('empty', 'EMPTY_GRAPH')) t(\"case\", code)"),
    "pattern_motifs": (_pattern_motifs, _pattern_motifs_sql()),
    "prefix_payloads": (
        _payloads,
        f"WITH pe(a, b) AS (VALUES {', '.join(f'({a}, {b})' for a, b, _ in DIAMOND.edges)}) SELECT k::INTEGER AS k, k::INTEGER AS num_vertices, (SELECT count(*) FROM pe WHERE a < k AND b < k)::INTEGER AS num_edges, true AS whole FROM range(1, {DIAMOND.size + 1}) t(k)",
    ),
    "query_tree": (
        _query_tree,
        f"{SHIP}{_initial_sql(TRIANGLE)}, w AS (SELECT qs, qd, count(*) / ((SELECT count(*) FROM cv0 WHERE qv = qs)::DOUBLE * (SELECT count(*) FROM cv0 WHERE qv = qd)) AS density FROM ce0 WHERE qs < qd GROUP BY qs, qd)"
        " SELECT qs AS a, qd AS b, (SELECT qv FROM cv0 GROUP BY qv ORDER BY count(*), qv LIMIT 1) AS root FROM w ORDER BY density, qs, qd LIMIT 2",  # a cycle's tree leaves out its last edge
    ),
    "static_order": (_static_order, f"{SHIP}{_initial_sql(TRIANGLE)} SELECT (row_number() OVER (ORDER BY count(*), qv) - 1)::INTEGER AS position, qv FROM cv0 GROUP BY qv"),
    "tree_estimate_settled": (_tree_settled, _settled_sql),
    "estimate_end_to_end": (_estimated, f"{SHIP} SELECT count(*)::DOUBLE AS estimate, count(*)::DOUBLE AS trees, 'trees' AS method, 1000::BIGINT AS trials, 1000::BIGINT AS successes {_embeddings(PATH3)}"),
    "beam_by_score": (_beam_by_score, _beam_by_score_sql()),
    "orders_generated": (_generated(path(0, 0, 1, 0)), f"{_orders_sql(path(0, 0, 1, 0))} SELECT order_id, {_JOIN} AS ord FROM ords"),
    "orders_generated_beam": (_generated(DIAMOND, 5), f"{_orders_sql(DIAMOND, 5)} SELECT order_id, {_JOIN} AS ord FROM ords"),
    "service_ranking": (_served_ranking, f"{_scores_sql(TRIANGLE)} SELECT order_id, {_JOIN} AS ord, score, row_number() OVER (ORDER BY score, order_id)::INTEGER AS rank FROM scores JOIN ords USING (order_id) WHERE k = {_N}"),
    "service_events": (
        _served_events,
        f"{_orders_sql(TRIANGLE)} SELECT event, (CASE WHEN per = 'order' THEN n WHEN per = 'prefix' THEN n * {_N} WHEN per = 'level' THEN {_N} ELSE 1 END)::BIGINT AS n FROM (SELECT count(*) AS n FROM ords),"
        " (VALUES ('index_loading', ''), ('index_loaded', ''), ('session_started', ''), ('order_generated', 'order'), ('prefix_progress', 'prefix'), ('score_updated', 'prefix'), ('ranking_updated', 'level'), ('best_order_selected', ''), ('session_completed', '')) t(event, per)",
    ),
    "service_execute": (_served_count, _count_sql(TRIANGLE)),
    "service_datasets": (_served_datasets, f"{SHIP} SELECT 'shipments' AS id, count(*) AS num_vertices, (sum(deg) // 2)::BIGINT AS num_edges, count(DISTINCT raw_label)::INTEGER AS num_labels, 'ready' AS index_status FROM v UNION ALL SELECT 'unbuilt', NULL, NULL, 0, 'missing'"),
    "service_errors": (
        _served_errors,
        "SELECT * FROM (VALUES ('no_dataset', 404, 'DATASET_NOT_FOUND'), ('not_ready', 409, 'INDEX_NOT_READY'), ('no_session', 404, 'SESSION_NOT_FOUND'), ('disconnected', 422, 'DISCONNECTED_GRAPH'), ('self_loop', 422, 'SELF_LOOP'), ('unknown_endpoint', 422, 'INVALID_EDGE_ENDPOINT'),"
        " ('duplicate_id', 422, 'DUPLICATE_VERTEX_ID'), ('empty', 422, 'EMPTY_GRAPH')) t(request, status, code)",
    ),
    "event_batches": (_batches, _BATCH_SQL),
    "event_tumbling": (_tumbling, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS event, count(*) AS n FROM events GROUP BY 1, 2"),
    "qerror_summary": (
        _qerrors,
        f"{SHIP}, q AS (SELECT greatest(avg(count(*)) OVER (), 1) / greatest(count(*), 1) AS q FROM v GROUP BY label) SELECT round(sum(q), 6) AS total, round(avg(q), 6) AS average, round(stddev_pop(q), 6) AS std, round(sum(log10(q)), 6) AS log_total FROM q",
    ),
}


def _color_check(spark: SparkSession, sf: str) -> DataFrame:
    g = _baskets(spark, sf)
    colors = graph.colored(g)
    ends = g.edges.where("src < dst").select("src", "dst").join(colors.select(F.col("vid").alias("src"), F.col("color").alias("a")), "src").join(colors.select(F.col("vid").alias("dst"), F.col("color").alias("b")), "dst")
    return colors.agg(F.count("color").alias("colored")).crossJoin(ends.agg(F.coalesce(F.sum((F.col("a") == F.col("b")).cast("bigint")), F.lit(0).cast("bigint")).alias("conflicts")))  # a row each


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, (_, sql) in ENTRIES.items() if sql}
