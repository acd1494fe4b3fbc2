"""Patterns (small query graphs): validation, structure and motifs, all on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

#: More than this many vertices or edges are refused.
MAX_VERTICES, MAX_EDGES = 50, 250


class ValidationError(ValueError):
    """A pattern that cannot be planned: ``code``, a message and details."""

    def __init__(self, code: str, message: str, details: dict | None = None):
        super().__init__(message)
        self.code, self.message, self.details = code, message, details or {}


@dataclass(frozen=True)
class Pattern:
    """Labels of vertices 0..n-1 and undirected edges (a, b, label), a < b, each once."""

    labels: tuple[int, ...]
    edges: tuple[tuple[int, int, int], ...]
    ids: tuple[int, ...] = field(default=(), compare=False)  # the caller's ids, by vertex

    @property
    def size(self) -> int:
        return len(self.labels)

    @cached_property
    def edge_label(self) -> dict[tuple[int, int], int]:
        """Label of each edge, in both directions."""
        return {k: e for a, b, e in self.edges for k in ((a, b), (b, a))}

    @cached_property
    def neighbors(self) -> tuple[tuple[int, ...], ...]:
        return tuple(tuple(b for b in range(self.size) if (a, b) in self.edge_label) for a in range(self.size))

    @cached_property
    def cores(self) -> tuple[int, ...]:
        """Core numbers, by peeling a vertex of least remaining degree each time."""
        left = {v: set(self.neighbors[v]) for v in range(self.size)}
        core, k = [0] * self.size, 0
        while left:
            v = min(left, key=lambda x: (len(left[x]), x))
            k = max(k, len(left[v]))
            core[v] = k
            for u in left.pop(v):
                left[u].discard(v)
        return tuple(core)

    @cached_property
    def triangles(self) -> tuple[tuple[int, int, int], ...]:
        """(a, b, w) for every directed edge (a, b) and common neighbour w."""
        return tuple((a, b, w) for a, b in sorted(self.edge_label) for w in self.neighbors[a] if (b, w) in self.edge_label)

    @cached_property
    def four_cycles(self) -> tuple[tuple[int, int, int, int, bool, bool], ...]:
        """(a, b, x, y, whether a-x, whether b-y) for every directed edge (a, b) of a cycle a-b-x-y."""
        return tuple((a, b, x, y, (a, x) in self.edge_label, (b, y) in self.edge_label) for a, b in sorted(self.edge_label) for x in self.neighbors[b] if x != a for y in self.neighbors[x] if y not in (a, b) and (y, a) in self.edge_label)

    @cached_property
    def neighbor_labels(self) -> dict[tuple[int, int], int]:
        """How many neighbours of each label a vertex has, by (vertex, label)."""
        found: dict[tuple[int, int], int] = {}
        for a in range(self.size):
            for b in self.neighbors[a]:
                found[a, self.labels[b]] = found.get((a, self.labels[b]), 0) + 1
        return found

    @cached_property
    def apart(self) -> tuple[tuple[int, int], ...]:
        """Pairs that injectivity has to be tested for: equal labels, not adjacent (edges have no loops)."""
        return tuple((a, b) for a in range(self.size) for b in range(a + 1, self.size) if self.labels[a] == self.labels[b] and (a, b) not in self.edge_label)

    def induced(self, vertices: Iterable[int]) -> Pattern:
        """The sub-pattern on ``vertices``, renumbered in ascending order."""
        kept = sorted(set(vertices))
        place = {v: i for i, v in enumerate(kept)}
        return Pattern(tuple(self.labels[v] for v in kept), tuple((place[a], place[b], e) for a, b, e in self.edges if a in place and b in place))


def path(*labels: int) -> Pattern:
    return Pattern(labels, tuple((i, i + 1, 0) for i in range(len(labels) - 1)))


def cycle(*labels: int) -> Pattern:
    n = len(labels)
    return Pattern(labels, tuple(sorted((min(i, (i + 1) % n), max(i, (i + 1) % n), 0) for i in range(n))))


def normalize(query: Mapping) -> Pattern:
    """Pattern of ``{"vertices": [{id, label}], "edges": [{source, target, label}]}``.

    Ids are ranked in ascending order. Refused: no vertices, repeated ids, edges with unknown ends,
    loops, unconnected vertices, and edges given twice with different labels (equal ones collapse). A
    single vertex needs no edge.
    """
    vertices, edges = list(query.get("vertices") or ()), list(query.get("edges") or ())
    if not vertices:
        raise ValidationError("EMPTY_GRAPH", "a pattern needs a vertex")
    ids = [int(v["id"]) for v in vertices]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValidationError("DUPLICATE_VERTEX_ID", f"vertex ids given twice: {twice}", {"duplicate_ids": twice})
    if len(ids) > MAX_VERTICES or len(edges) > MAX_EDGES:
        raise ValidationError("TOO_LARGE", f"at most {MAX_VERTICES} vertices and {MAX_EDGES} edges")
    rank = {v: i for i, v in enumerate(sorted(ids))}
    found: dict[tuple[int, int], int] = {}
    for e in edges:
        ends = int(e["source"]), int(e["target"])
        if unknown := [v for v in ends if v not in rank]:
            raise ValidationError("INVALID_EDGE_ENDPOINT", f"no such vertex: {unknown[0]}", {"edge": list(ends)})
        if ends[0] == ends[1]:
            raise ValidationError("SELF_LOOP", f"edge from {ends[0]} to itself", {"vertex": ends[0]})
        key, label = tuple(sorted(rank[v] for v in ends)), int(e.get("label") or 0)
        if found.setdefault(key, label) != label:
            raise ValidationError("CONFLICTING_EDGES", f"edge {ends} has two labels", {"edge": list(ends)})
    by_id = {int(v["id"]): int(v.get("label") or 0) for v in vertices}
    order = tuple(sorted(ids))
    pattern = Pattern(tuple(by_id[v] for v in order), tuple((a, b, e) for (a, b), e in sorted(found.items())), order)
    reached, front = {0}, [0]
    while front:
        for b in pattern.neighbors[front.pop()]:
            if b not in reached:
                reached.add(b)
                front.append(b)
    if len(reached) < pattern.size:
        unreachable = [order[v] for v in range(pattern.size) if v not in reached]
        raise ValidationError("DISCONNECTED_GRAPH", f"not connected to the rest: {unreachable}", {"unreachable": unreachable})
    return pattern


class UnionFind:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def unite(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b
