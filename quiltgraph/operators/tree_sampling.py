"""Cardinality by candidate trees: counted by sum-product, sampled in proportion, tested for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import RANGE, draw
from ..functions.stats import settled
from ..plans.pattern import Pattern, UnionFind
from ..storage import written
from .candidates import CandidateSpace
from .graph import Graph

#: Trials before the first look, between looks, and when to give up with so few successes.
FIRST, STEP, LAST, FEW = 1000, 100, 50_000, 10
#: Groups that the root's candidates are summed in before they are summed up.
BUCKETS = 256


@dataclass(frozen=True)
class Tree:
    """A spanning tree of a pattern: ``(parent, child)`` in breadth-first order from the root."""

    root: int
    edges: tuple[tuple[int, int], ...]

    def children(self, v: int) -> list[int]:
        return [b for a, b in self.edges if a == v]


def rooted(pattern: Pattern, edges: list[tuple[int, int]], root: int) -> Tree:
    linked, order, front = {frozenset(e) for e in edges}, [], [root]
    seen = {root}
    while front:
        a = front.pop(0)
        for b in pattern.neighbors[a]:
            if b not in seen and frozenset((a, b)) in linked:
                seen.add(b)
                order.append((a, b))
                front.append(b)
    return Tree(root, tuple(order))


def edge_weights(space: CandidateSpace) -> DataFrame:
    """``(qs, qd, n, density)`` of each pattern edge: candidate edges, and their share of the pairs of candidates."""
    sizes = space.vertices.groupBy("qv").agg(F.count("*").alias("c"))  # a row for each pattern vertex
    counts = space.edges.where("qs < qd").groupBy("qs", "qd").agg(F.count("*").alias("n"))
    both = counts.join(sizes.select(F.col("qv").alias("qs"), F.col("c").alias("cs")), "qs").join(sizes.select(F.col("qv").alias("qd"), F.col("c").alias("cd")), "qd")
    return both.select("qs", "qd", "n", (F.col("n") / (F.col("cs").cast("double") * F.col("cd"))).alias("density"))


def spanning_tree(space: CandidateSpace, by: str = "density") -> Tree:
    """The tree of least total weight (``density`` or ``n``; ties by vertices), rooted where candidates are fewest."""
    pattern = space.pattern
    weights = sorted((r[by], r.qs, r.qd) for r in edge_weights(space).collect())
    sets = UnionFind(pattern.size)
    edges = [(a, b) for _, a, b in weights if sets.unite(a, b)]
    sizes = {r.qv: r.n for r in space.vertices.groupBy("qv").agg(F.count("*").alias("n")).collect()}
    return rooted(pattern, edges, min(range(pattern.size), key=lambda v: (sizes.get(v, 0), v)))


def subtree_counts(space: CandidateSpace, tree: Tree) -> dict[int, DataFrame]:
    """By pattern vertex ``(v, n)``: how many candidate trees of its subtree hang at each candidate (only those with any)."""
    found: dict[int, DataFrame] = {}
    for u in [*(b for _, b in reversed(tree.edges)), tree.root]:
        here = space.vertices.where(F.col("qv") == u).select("v", F.lit(1.0).alias("n"))
        for c in tree.children(u):
            below = space.edges.where((F.col("qs") == u) & (F.col("qd") == c)).join(found[c].select(F.col("v").alias("dst"), F.col("n").alias("m")), "dst").groupBy(F.col("src").alias("v")).agg(F.sum("m").alias("m"))
            here = here.join(below, "v").select("v", (F.col("n") * F.col("m")).alias("n"))
        found[u] = here
    return found


def tree_total(space: CandidateSpace, tree: Tree) -> DataFrame:
    """One row: the number of candidate trees."""
    return subtree_counts(space, tree)[tree.root].agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("total"))


@dataclass
class Sums:
    """What trees are drawn from: the root's candidates and their buckets, and each tree edge's children, with running sums."""

    roots: DataFrame
    buckets: DataFrame
    steps: dict[tuple[int, int], DataFrame]


def sums(space: CandidateSpace, tree: Tree, store: bool = False) -> Sums:
    """Inverse distribution functions as running sums: of the root's candidates within buckets, and of each
    parent's children, so that no task orders all candidates. ``store`` writes them, to be read for many draws."""
    keep = written if store else lambda df, name: df
    counts = {u: keep(df, "tree-counts") for u, df in subtree_counts(space, tree).items()}
    inside = Window.partitionBy("bucket").orderBy("v")
    roots = keep(counts[tree.root].withColumn("bucket", F.pmod("v", F.lit(BUCKETS)).cast("int")).withColumn("high", F.sum("n").over(inside)), "tree-roots")
    buckets = roots.groupBy("bucket").agg(F.sum("n").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row for each bucket
    buckets = keep(buckets.withColumn("start", before).withColumn("total", F.sum("sum").over(Window.partitionBy())), "tree-buckets")
    steps = {}
    for a, b in tree.edges:
        step = space.edges.where((F.col("qs") == a) & (F.col("qd") == b)).join(counts[b].withColumnRenamed("v", "dst"), "dst")
        step = step.withColumn("high", F.sum("n").over(Window.partitionBy("src").orderBy("dst"))).withColumn("total", F.sum("n").over(Window.partitionBy("src")))
        steps[a, b] = keep(step.select(F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{b}"), (F.col("high") - F.col("n")).alias("low"), "high", "total"), "tree-steps")
    return Sums(roots, buckets, steps)


def sampled(space: CandidateSpace, tree: Tree, first: int, last: int, seed: int = 0, of: Sums | None = None) -> DataFrame:
    """``(trial, v0, v1, ...)`` for trials ``first`` to ``last - 1``: a candidate tree each, drawn in proportion."""
    spark, of = space.vertices.sparkSession, of or sums(space, tree)
    pick = lambda q: F.floor(draw(seed, F.col("trial"), q) / F.lit(float(RANGE)) * F.col("total"))
    root = f"v{tree.root}"
    trials = spark.range(first, last).withColumnRenamed("id", "trial").crossJoin(F.broadcast(of.buckets)).withColumn("r", pick(tree.root)).where("start <= r and r < start + sum")  # BUCKETS rows
    trials = trials.join(of.roots.select("bucket", F.col("v").alias(root), (F.col("high") - F.col("n")).alias("low"), "high"), "bucket").where("low <= r - start and r - start < high").select("trial", root)
    for (a, b), step in of.steps.items():
        trials = trials.join(step, f"v{a}").where((F.col("low") <= pick(b)) & (pick(b) < F.col("high"))).drop("low", "high", "total")
    return trials


def hits(graph: Graph, space: CandidateSpace, tree: Tree, trials: DataFrame) -> DataFrame:
    """The sampled trees that are embeddings: all different, and with the edges outside the tree."""
    pattern, of_tree = space.pattern, {frozenset(e) for e in tree.edges}
    for a in range(pattern.size):
        for b in range(a + 1, pattern.size):
            if pattern.labels[a] == pattern.labels[b]:
                trials = trials.where(F.col(f"v{a}") != F.col(f"v{b}"))
    for a, b, label in pattern.edges:
        if frozenset((a, b)) not in of_tree:
            real = graph.part(pattern).edges.where(F.col("elabel") == label).select(F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{b}"))
            trials = trials.join(real, [f"v{a}", f"v{b}"], "left_semi")
    return trials


@dataclass
class TreeEstimate:
    estimate: float
    total: float
    trials: int
    successes: int
    gave_up: bool


def estimate(graph: Graph, space: CandidateSpace, tree: Tree, seed: int = 0, chunk: int = 10_000) -> TreeEstimate:
    """Looks after 1000 trials and each 100 more, until the rate is settled, or at 50 000 with too few successes.

    Trials are drawn in chunks; only the number of successes in each hundred comes to the driver.
    """
    total = tree_total(space, tree).first()[0]
    if not total:
        return TreeEstimate(0.0, 0.0, 0, 0, False)
    of = sums(space, tree, store=True)
    drawn = trials = successes = 0
    while True:
        size = max(FIRST, min(chunk, LAST - drawn if drawn < LAST else chunk))
        found = hits(graph, space, tree, sampled(space, tree, drawn, drawn + size, seed, of))
        by_step = {r.step: r.n for r in found.groupBy(F.floor(F.col("trial") / STEP).alias("step")).agg(F.count("*").alias("n")).collect()}
        for step in range(drawn // STEP, (drawn + size) // STEP):
            trials, successes = (step + 1) * STEP, successes + by_step.get(step, 0)
            if trials >= FIRST and (settled(trials, successes) or trials == LAST and successes <= FEW):
                return TreeEstimate(successes / trials * total, total, trials, successes, trials == LAST and successes <= FEW)
        drawn += size
