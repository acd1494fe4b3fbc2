"""Bipartite matching for the neighbourhood filters; a side is a vertex's few pattern neighbours."""

from __future__ import annotations


def maximum(left: dict[int, list[int]], fixed: dict[int, int] | None = None) -> dict[int, int]:
    """Partner of each left node in a maximum matching (augmenting paths); ``fixed`` pairs are taken out first."""
    fixed = fixed or {}
    taken = set(fixed.values())
    owner: dict[int, int] = {}

    def place(a: int, tried: set[int]) -> bool:
        for b in left[a]:
            if b not in tried and b not in taken:
                tried.add(b)
                if b not in owner or place(owner[b], tried):
                    owner[b] = a
                    return True
        return False

    for a in left:
        if a not in fixed:
            place(a, set())
    return {a: b for b, a in owner.items()} | fixed


def usable(left: dict[int, list[int]]) -> set[tuple[int, int]]:
    """The pairs that lie in a matching of all left nodes; none if there is no such matching.

    Along alternating paths: a pair outside the matching is usable if its right node is free or can be
    freed, that is, reaches a free right node or the pair closes an alternating cycle.
    """
    match = maximum(left)
    if len(match) < len(left):
        return set()
    owner = {b: a for a, b in match.items()}
    # an edge a -> a2 where a could take what a2 has
    gives = {a: {owner[b] for b in bs if b in owner and owner[b] != a} for a, bs in left.items()}
    loose = {a for a, bs in left.items() if any(b not in owner for b in bs)}

    def reach(start: int) -> set[int]:
        seen, front = {start}, [start]
        while front:
            for c in gives[front.pop()]:
                if c not in seen:
                    seen.add(c)
                    front.append(c)
        return seen

    reached = {a: reach(a) for a in left}
    found = set()
    for a, bs in left.items():
        for b in bs:
            if match[a] == b or b not in owner:
                found.add((a, b))
            else:
                other = owner[b]  # has to move on: to a free node, or round to what a leaves
                if reached[other] & loose or a in reached[other]:
                    found.add((a, b))
    return found
