import pytest

from quiltgraph.plans import orders
from quiltgraph.plans.pattern import Pattern, ValidationError, cycle, normalize, path


def query(vertices, edges):
    return {"vertices": [{"id": i, "label": x} for i, x in vertices], "edges": [{"source": a, "target": b} for a, b in edges]}


def test_normalize_ranks_ids():
    p = normalize(query([(10, 0), (40, 0), (30, 1), (20, 0)], [(10, 20), (20, 30), (30, 40)]))
    assert p.ids == (10, 20, 30, 40) and p.labels == (0, 0, 1, 0) and p.edges == ((0, 1, 0), (1, 2, 0), (2, 3, 0))


@pytest.mark.parametrize(
    "q, code",
    [
        (query([], []), "EMPTY_GRAPH"),
        (query([(1, 0), (1, 0)], [(1, 1)]), "DUPLICATE_VERTEX_ID"),
        (query([(1, 0), (2, 0)], [(1, 3)]), "INVALID_EDGE_ENDPOINT"),
        (query([(1, 0), (2, 0)], [(1, 1)]), "SELF_LOOP"),
        (query([(1, 0), (2, 0), (3, 0), (4, 0)], [(1, 2)]), "DISCONNECTED_GRAPH"),
        ({"vertices": [{"id": 0}, {"id": 1}], "edges": [{"source": 0, "target": 1, "label": 1}, {"source": 1, "target": 0, "label": 2}]}, "CONFLICTING_EDGES"),
    ],
)
def test_normalize_refuses(q, code):
    with pytest.raises(ValidationError) as e:
        normalize(q)
    assert e.value.code == code
    if code == "DISCONNECTED_GRAPH":
        assert e.value.details["unreachable"] == [3, 4]


def test_equal_parallel_edges_collapse():
    assert normalize(query([(0, 0), (1, 0)], [(0, 1), (1, 0)])).edges == ((0, 1, 0),)


def test_orders():
    assert len(orders.exact(cycle(0, 0, 1))) == 6
    four = orders.exact(path(0, 0, 1, 0))
    assert len(four) == 8 == len(set(four))
    for o in four:
        assert all(set(o[:k]) & set(path(0, 0, 1, 0).neighbors[o[k]]) for k in range(1, 4))
    assert len(orders.beam(cycle(0, 0, 0, 0), 5)) == 5
    assert orders.generate(cycle(0, 0, 1)) == orders.exact(cycle(0, 0, 1)) == orders.generate(cycle(0, 0, 1))
    assert len(orders.generate(path(*range(9)))) == orders.BEAM


def test_prefixes():
    p = cycle(0, 0, 1)
    assert [(orders.prefix(p, (2, 0, 1), k).size, len(orders.prefix(p, (2, 0, 1), k).edges)) for k in (1, 2, 3)] == [(1, 0), (2, 1), (3, 3)]
    assert orders.prefix(p, (2, 0, 1), 2).labels == (0, 1)


def test_pattern_structure():
    k4 = Pattern((0,) * 4, tuple((a, b, 0) for a in range(4) for b in range(a + 1, 4)))
    assert k4.cores == (3, 3, 3, 3) and len(k4.triangles) == 24 and len(k4.four_cycles) == 24
    assert path(0, 1, 2).cores == (1, 1, 1) and path(0, 0, 0).apart == ((0, 2),)


def test_order_frames(spark):
    for p, width in ((cycle(0, 0, 1), None), (path(0, 0, 1, 0), None), (cycle(0, 1, 0, 1), 3)):
        rows = orders.orders_frame(spark, p, width).orderBy("order_id").collect()
        assert [tuple(r.ord) for r in rows] == (orders.exact(p) if width is None else orders.beam(p, width))
        for r in orders.prefixes_frame(spark, p, orders.orders_frame(spark, p, width)).collect():
            sub = orders.prefix(p, tuple(rows[r.order_id].ord), r.k)
            assert (r.num_vertices, r.num_edges) == (sub.size, len(sub.edges))
