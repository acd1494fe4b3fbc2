import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quiltgraph import storage
from quiltgraph.functions import stats
from quiltgraph.operators import candidates, estimator, graph, graph_sampling, matcher, matching, motifs, tree_sampling
from quiltgraph.operators.candidates import Neighborhood, Structure
from quiltgraph.plans.pattern import Pattern, cycle, path
from quiltgraph.sources import graph_text, index_store


def made(spark, n=24, m=60, labels=3, seed=1):
    rng = random.Random(seed)
    edges = set()
    while len(edges) < m:
        a, b = rng.sample(range(n), 2)
        edges.add((min(a, b), max(a, b)))
    of = {v: rng.randrange(labels) for v in range(n)}
    g = graph.build(spark.createDataFrame(list(of.items()), "vid bigint, raw_label int"), spark.createDataFrame([(a, b, 0) for a, b in edges], "src bigint, dst bigint, elabel int"))
    return g.stored("test"), of, edges


@pytest.fixture(scope="module")
def small(spark):
    return made(spark)


def embeddings(of, edges, p: Pattern):
    linked = edges | {(b, a) for a, b in edges}
    found, choices = set(), [[v for v in of if of[v] == x] for x in p.labels]
    for c in itertools.product(*choices):
        if len(set(c)) == p.size and all((c[a], c[b]) in linked for a, b, _ in p.edges):
            found.add(c)
    return found


PATTERNS = [Pattern((0,), ()), path(0, 1), path(0, 1, 0), cycle(0, 1, 2), cycle(0, 0, 1), cycle(0, 1, 0, 2), Pattern((0, 1, 2, 0), ((0, 1, 0), (0, 2, 0), (1, 2, 0), (2, 3, 0))), path(0, 7)]


@pytest.mark.parametrize("p", PATTERNS)
def test_exact_matches(small, p):
    g, of, edges = small
    truth = embeddings(of, edges, p)
    assert {tuple(r) for r in matcher.match(g, p).collect()} == truth


@pytest.mark.parametrize("p", PATTERNS[2:7])
@pytest.mark.parametrize("near", [Neighborhood.LABELS, Neighborhood.VERTEX_MATCHING, Neighborhood.EDGE_MATCHING])
def test_candidates_hold_every_embedding(small, p, near):
    g, of, edges = small
    space = candidates.build(g, p, neighborhood=near, max_rounds=1)
    truth = embeddings(of, edges, p)
    vs, es = {tuple(r) for r in space.vertices.collect()}, {tuple(r) for r in space.edges.collect()}
    assert {(u, c[u]) for c in truth for u in range(p.size)} <= vs
    assert {(a, b, c[a], c[b]) for c in truth for a, b in p.edge_label} <= es
    assert {tuple(r) for r in matcher.match(g, p, space=space).collect()} == truth


def test_candidate_trees_bound_and_estimates(small):
    g, of, edges = small
    p = cycle(0, 1, 2)
    truth = len(embeddings(of, edges, p))
    space = candidates.build(g, p, Structure.NONE)
    tree = tree_sampling.spanning_tree(space)
    assert tree_sampling.tree_total(space, tree).first()[0] >= truth
    found = tree_sampling.estimate(g, space, tree)
    assert truth == 0 or abs(found.estimate - truth) <= 0.3 * truth
    assert graph_sampling.estimate(space, 10**6).first()[0] == truth  # a budget for everything is exact


def test_strata_are_unbiased(small):
    g, of, edges = small
    p = path(0, 1, 0, 2)
    truth, space = len(embeddings(of, edges, p)), candidates.build(g, p, Structure.NONE, max_rounds=0)
    found = [graph_sampling.estimate(space, 40, seed=s, least=1, checkpoint=False).first()[0] for s in range(12)]
    assert abs(sum(found) / len(found) - truth) < 0.35 * truth


def test_estimator_api(small):
    g, of, edges = small
    e = estimator.Estimator()
    assert not e.is_loaded()
    e.load(g)
    e.set_option(num_threads=4, structure_filter="3")
    assert e.num_vertices() == 24 and e.num_edges() == 120
    p = path(0, 1)
    got = e.estimate_prefix(estimator.payload_of(p))
    assert abs(got["estimate"] - len(embeddings(of, edges, p))) < 1e-6
    assert e.estimate_prefix(Pattern((0, 9), ((0, 1, 0),)))["estimate"] == 0.0  # a label the data lacks


def test_motifs_and_cores(small):
    g, of, edges = small
    linked = edges | {(b, a) for a, b in edges}
    near = {v: {b for a, b in linked if a == v} for v in of}
    index = {tuple(r) for r in motifs.triangle_index(g).collect()}
    assert index == {(a, b, w) for a, b in linked for w in near[a] & near[b]}
    squares = {(a, b, x, y) for a, b in linked for x in near[b] - {a} for y in near[x] & near[a] if y != b}
    got = motifs.four_cycle_index(g).collect()
    assert {tuple(r)[:4] for r in got} == squares and len(got) == len(squares)
    assert all(r.diag_src == (r.x in near[r.src]) and r.diag_dst == (r.y in near[r.dst]) for r in got)
    assert motifs.four_cycle_count(g).first()[0] == len(squares) // 8
    left, core, k = {v: set(x) for v, x in near.items()}, {}, 0
    while left:
        v = min(left, key=lambda x: (len(left[x]), x))
        k = max(k, len(left[v]))
        core[v] = k
        for u in left.pop(v):
            left[u].discard(v)
    assert {r.vid: r.core for r in graph.core_numbers(g).collect()} == core
    colors = {r.vid: r.color for r in graph.colored(g).collect()}
    assert set(colors) == set(of) and all(colors[a] != colors[b] for a, b in edges)


def test_matching():
    rng = random.Random(2)
    for _ in range(300):
        left = {a: sorted(rng.sample(range(5), rng.randint(1, 4))) for a in range(rng.randint(1, 4))}
        pairs = {x for c in itertools.product(*left.values()) if len(set(c)) == len(c) for x in zip(left, c)}
        assert matching.usable(left) == pairs


def test_bounds():
    low, high = stats.clopper_pearson(100, 50)
    assert abs(low - 0.39832) < 1e-4 and abs(high - 0.60168) < 1e-4
    assert stats.clopper_pearson(10, 0)[0] == 0 and stats.clopper_pearson(10, 10)[1] == 1
    assert abs(stats.clopper_pearson(10, 0)[1] - 0.30850) < 1e-4
    assert not stats.settled(1000, 0) and stats.settled(1000, 500)


def test_text_and_index(spark, tmp_path):
    (tmp_path / "g").mkdir()
    file = tmp_path / "g" / "g.graph"
    file.write_text("t 4 4\nv 0 5 2\nv 1 5\nv 2\nv 3 9 1\ne 0 1\ne 1 2 3\ne 2 0\ne 2 3 0\n")
    g = graph_text.read(spark, str(file))
    assert {tuple(r) for r in g.vertices.collect()} == {(0, 5, 0, 2), (1, 5, 0, 2), (2, 0, 1, 3), (3, 9, 2, 1)}
    assert {(r.src, r.dst, r.elabel) for r in g.edges.collect()} >= {(1, 2, 3), (2, 1, 3), (0, 1, 0)}
    graph_text.write(g, str(tmp_path / "out"))
    text = "\n".join(p.read_text().strip() for p in sorted((tmp_path / "out").glob("part-*")) if p.read_text().strip())
    assert text.splitlines()[0] == "t 4 4" and "e 1 2 3" in text
    (tmp_path / "again.graph").write_text(text)
    assert index_store.fingerprint(graph_text.read(spark, str(tmp_path / "again.graph"))) == index_store.fingerprint(g)
    folder = f"file://{tmp_path}/index"
    assert index_store.status(spark, folder) is index_store.Status.MISSING
    index_store.save(g, folder)
    assert index_store.status(spark, folder, g) is index_store.Status.READY
    index = index_store.load(spark, folder)
    assert index.triangles.count() == 6 and index.four_cycles.count() == 0 and index.summary["triangle_count"] == 1
    other = graph.build(g.vertices.select("vid", "raw_label"), g.edges.where("src < dst and src <> 0").select("src", "dst", "elabel"))
    assert index_store.status(spark, folder, other) is index_store.Status.STALE
    from quiltgraph.sources import datasets

    found = datasets.discover(spark, str(tmp_path))
    assert [(d.id, d.num_vertices, d.num_edges, d.labels, d.index_status) for d in found] == [("g", 4, 4, (0, 5, 9), "missing")]
    assert graph_text.read_pattern(str(file)).edges == ((0, 1, 0), (0, 2, 0), (1, 2, 3), (2, 3, 0))


def test_empty_graph(spark):
    g = graph.build(spark.createDataFrame([], "vid bigint, raw_label int"), spark.createDataFrame([], "src bigint, dst bigint, elabel int"))
    assert matcher.count(g, cycle(0, 1, 2)).first()[0] == 0
    assert estimator.estimate(g, cycle(0, 1, 2))["estimate"] == 0.0
    assert motifs.four_cycle_count(g).first()[0] == 0


def linked(spark, rows, name="linked"):
    """A graph over links whose labels are the remainders of ids by 3, and the same built whole."""
    links = spark.createDataFrame(rows, "src bigint, dst bigint, elabel int")
    both = links.unionByName(links.selectExpr("dst AS src", "src AS dst", "elabel"))
    label = lambda vid: F.pmod(F.col(vid), F.lit(3)).cast("int")
    ends = links.selectExpr("src AS vid").union(links.selectExpr("dst")).where("vid is not null").distinct().withColumn("raw_label", label("vid"))
    return graph.Linked(both, label, name), graph.build(ends, links)


LINKS = [(0, 1, 2), (1, 0, 1), (0, 2, 0), (1, 2, 0), (3, 1, 0), (3, 3, 0), (6, None, 0), (9, 10, 5), (9, 10, 4), (9, 11, 0), (10, 11, 0)]


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)


@pytest.mark.parametrize("slices", [1, 3])
def test_linked_graph_is_the_built_one(spark, monkeypatch, slices):
    """Whole, in slices: repeats, loops and missing ends as where all is built at once."""
    monkeypatch.setattr(graph.Linked, "_slices", lambda self: slices)
    g, whole = linked(spark, LINKS)
    assert rows_of(g.vertices) == rows_of(whole.vertices)
    assert rows_of(g.edges, *whole.edges.columns) == rows_of(whole.edges)


def test_labels_need_no_edges(spark):
    """label statistics build neither edges nor degrees."""
    g, whole = linked(spark, LINKS)
    assert rows_of(graph.label_stats(g.labelled)) == rows_of(graph.label_stats(whole.vertices))
    assert not {"ends", "vertices", "_whole"} & set(vars(g))


def test_incident_needs_no_whole_graph(spark):
    """a vertex's edges are found without those of others, degrees of its neighbours included."""
    g, whole = linked(spark, LINKS)
    for vid in (0, 3, 6, 9, 77):
        assert rows_of(graph.incident(g, vid), *whole.edges.columns) == rows_of(graph.incident(whole, vid))
    assert not {"ends", "vertices", "_whole"} & set(vars(g))


def test_matching_judges_each_shape_once(spark):
    """candidates with as many partners of each kind are one case, however many they are."""
    star = Pattern((0, 1, 2), ((0, 1, 0), (0, 2, 0)))
    links = [(3 * i, 3 * (i + j) + k, 0) for i in range(40) for j in range(4) for k in (1, 2)]
    g, _ = linked(spark, links)
    v, e = candidates.initial(g, star)
    plan = candidates.matching_filter(star, v, e)
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    assert {tuple(r) for r in plan.where("qv = 0").collect()} == {(0, 3 * i) for i in range(40)}


@pytest.mark.parametrize("slices", [1, 3])
def test_triangles_in_slices(spark, monkeypatch, slices):
    """F7, F11, F16: found slice by slice and without the whole graph, as in the whole."""
    monkeypatch.setattr(graph.Linked, "_slices", lambda self: slices)
    rng = random.Random(4)
    g, whole = linked(spark, LINKS + [(rng.randrange(20), rng.randrange(20), 0) for _ in range(80)])
    assert rows_of(motifs.triangles(g)) == rows_of(motifs.triangles(whole)) != []
    assert rows_of(motifs.edge_support(g)) == rows_of(motifs.edge_support(whole))
    assert rows_of(motifs.triangle_index(g)) == rows_of(motifs.triangle_index(whole))
    assert "_whole" not in vars(g)


def test_shuffle_files_of_the_last_job_go(spark, tmp_path):
    """F16, F7: a slice does not lie on disk while the next is shuffled."""
    files = lambda: {name for name in re.findall(r"shuffle_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n"))}
    before = files()
    spark.range(1000).repartition("id").groupBy("id").count().write.parquet(f"{tmp_path}/rows")
    assert files() - before
    storage.collect(spark)
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before


def test_triangles_need_no_table_of_both_ways(spark, monkeypatch):
    """F16, F7: no table has every edge both ways, and triangles and their support are written once."""
    made = []
    monkeypatch.setattr(graph, "folder", lambda s, name, f=graph.folder: made.append(name.split("-", 1)[1]) or f(s, name))
    rng = random.Random(5)
    # hubs among vertices of label 1 and 2, each of label 0 has one neighbour of either
    g, whole = linked(spark, [e for i in range(60) for b, c in [(rng.randrange(4) * 3 + 1, rng.randrange(4) * 3 + 2)] for e in ((3 * i, b, 0), (3 * i, c, 0), (b, c, 0))])
    assert rows_of(motifs.triangles(g)) == rows_of(motifs.triangles(whole)) != []
    assert rows_of(motifs.triangle_index(g)) == rows_of(motifs.triangle_index(whole))
    assert "ends" not in made and "edges" not in made
    assert rows_of(motifs.edge_support(g)) == rows_of(motifs.edge_support(g)) == rows_of(motifs.edge_support(whole))
    assert made.count("support") == made.count("triangles") == 1


@pytest.mark.parametrize("p", [cycle(0, 1, 2), Pattern((0, 1, 0, 2), ((0, 1, 0), (0, 3, 0), (1, 2, 0), (1, 3, 0), (2, 3, 0))), Pattern((0, 1, 2, 0), ((0, 1, 0), (0, 2, 0), (1, 2, 0), (2, 3, 0)))])
def test_triangle_filter_shuffles_no_edge_outside_triangles(small, monkeypatch, p):
    """Only candidate edges in a triangle of the data are joined with triangles; what is left is as by brute force."""
    g, _, linked = small
    both, seen = linked | {(b, a) for a, b in linked}, []
    monkeypatch.setattr(candidates, "near_triangles", lambda *a, f=candidates.near_triangles: seen.append(f(*a)) or seen[-1])
    space = candidates.build(g, p, Structure.TRIANGLES, max_rounds=0)
    edges = {tuple(r) for r in space.edges.collect()}
    found = {tuple(r) for r in candidates.triangle_filter(p, space.edges, motifs.triangle_index(g)).collect()}
    thirds = {(a, b): sum(t[:2] == (a, b) for t in p.triangles) for a, b in p.edge_label}
    common = lambda s, d: sum((s, w) in both and (d, w) in both for w in range(24))
    whole = lambda a, b, s, d: all(any((a, w, s, v) in edges and (b, w, d, v) in edges for v in range(24)) for x, y, w in p.triangles if (x, y) == (a, b))
    assert found == {e for e in edges if whole(*e) and common(*e[2:]) >= thirds[e[:2]]}
    assert {tuple(r) for r in seen[0].collect()} == {e for e in edges if thirds[e[:2]] and common(*e[2:])}
    assert {(b, a, d, s) for a, b, s, d in found} == found


def test_part_sends_links_only_of_degrees_above_two(spark, monkeypatch):
    """F2 and others: up to a degree of 2 a vertex is a row of each task, and no part stands in for one that asks for more."""
    seen = []
    monkeypatch.setattr(graph.Linked, "_distinct", lambda self, links, f=graph.Linked._distinct: seen.append(links) or f(self, links))
    g, whole = linked(spark, LINKS)
    degrees = {r.vid: r.deg for r in whole.vertices.collect()}
    part = g.part(cycle(0, 1, 2))
    assert len(seen) == 1  # the edges
    assert {r.vid: r.deg for r in part.vertices.collect()} == {v: min(n, 2) for v, n in degrees.items()}
    star = Pattern((0, 1, 2, 1), ((0, 1, 0), (0, 2, 0), (0, 3, 0)))
    assert g.part(path(0, 1)) is part and g.part(star) is not part
    assert {r.vid: r.deg for r in g.part(star).vertices.collect()} == {v: n if v % 3 == 0 else min(n, 2) for v, n in degrees.items()}
