"""Cardinality by stratified sampling of the candidate graph, level by level.

The frontier holds a row for each partial embedding kept, with the weight it stands for. Each level joins
the candidate edges of all pattern edges to matched vertices, drops used vertices, and keeps some of a
row's children without replacement; weights grow by children found over children kept, so the final sum
is unbiased. Budgets are handed down in equal shares, at least one.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..storage import written
from .candidates import CandidateSpace

UB_INITIAL, STRATA_RATIO = 100_000, 0.5


def budget(size: int, successes: int, initial: int = UB_INITIAL) -> int:
    """Partial embeddings to visit, fewer where tree sampling had successes."""
    return ceil(initial * size / sqrt(successes + 1))


def least_children(size: int, candidates: int) -> int:
    """Children kept of each row at least."""
    return 2 if candidates > 10_000 or size > 20 else 4


def static_order(space: CandidateSpace) -> tuple[int, ...]:
    """Root with the fewest candidates; then the most matched neighbours, then the fewest candidates."""
    pattern = space.pattern
    sizes = {r.qv: r.n for r in space.vertices.groupBy("qv").agg(F.count("*").alias("n")).collect()}
    order = [min(range(pattern.size), key=lambda v: (sizes.get(v, 0), v))]
    while len(order) < pattern.size:
        left = [v for v in range(pattern.size) if v not in order and set(pattern.neighbors[v]) & set(order)]
        order.append(min(left, key=lambda v: (-len(set(pattern.neighbors[v]) & set(order)), sizes.get(v, 0), v)))
    return tuple(order)


def extended(space: CandidateSpace, frontier: DataFrame, done: tuple[int, ...], v: int) -> DataFrame:
    """The frontier's rows with each vertex that fits: in the candidate edges of all matched neighbours, and unused."""
    pattern = space.pattern
    found = frontier
    for i, a in enumerate(x for x in done if x in pattern.neighbors[v]):
        step = space.edges.where((F.col("qs") == a) & (F.col("qd") == v)).select(F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{v}"))
        found = found.join(step, [f"v{a}"] if i == 0 else [f"v{a}", f"v{v}"], "inner" if i == 0 else "left_semi")
    for a in done:
        if pattern.labels[a] == pattern.labels[v]:
            found = found.where(F.col(f"v{a}") != F.col(f"v{v}"))
    return found


def estimate(space: CandidateSpace, ub: int, order: tuple[int, ...] | None = None, seed: int = 0, ratio: float = STRATA_RATIO, least: int | None = None, checkpoint: bool = True) -> DataFrame:
    """One row: the estimate. ``order`` starts at the root, all of whose candidates are visited."""
    pattern = space.pattern
    order = static_order(space) if order is None else order
    least = least_children(pattern.size, space.vertices.count()) if least is None else least
    roots = space.vertices.where(F.col("qv") == order[0]).select(F.col("v").alias(f"v{order[0]}"), F.lit(1.0).alias("w"))
    if pattern.size == 1:
        return roots.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("estimate"))
    n_roots = roots.agg(F.count("*").alias("roots"))  # one row
    frontier = roots.crossJoin(F.broadcast(n_roots)).withColumn("ub", F.greatest(F.floor(F.lit(ub) / F.col("roots")), F.lit(1)).cast("bigint")).drop("roots")
    for k, v in enumerate(order[1:], 1):
        done = order[:k]
        row = [f"v{a}" for a in done]
        found = extended(space, frontier, done, v)
        if k == len(order) - 1:
            return found.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("estimate"))
        here = Window.partitionBy(*row)
        found = found.withColumn("n", F.count("*").over(here)).withColumn("place", F.row_number().over(here.orderBy(draw(seed, *(F.col(c) for c in row), F.col(f"v{v}")), F.col(f"v{v}"))))
        kept = F.least(F.greatest(F.ceil(F.col("n") * ratio), F.lit(least)), F.col("ub"), F.col("n")).cast("bigint")
        found = found.withColumn("kept", kept).where("place <= kept")
        frontier = found.select(*row, f"v{v}", (F.col("w") * F.col("n") / F.col("kept")).alias("w"), F.greatest(F.floor(F.col("ub") / F.col("kept")), F.lit(1)).cast("bigint").alias("ub"))
        frontier = written(frontier, "frontier") if checkpoint and k + 2 < len(order) else frontier
    raise AssertionError("unreachable")


