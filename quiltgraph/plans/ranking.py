"""Scores and rankings of match orders from the cardinalities of their prefixes.

``estimates(prefix_key, est)`` has a row for each distinct vertex set; ``prefixes(order_id, k, prefix_key)``
are those of :func:`quiltgraph.plans.orders.prefixes_frame`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import matcher
from ..operators.candidates import CandidateSpace
from ..operators.graph import Graph
from . import orders as plans
from .pattern import Pattern

TOP = 10


def weight(k: Column) -> Column:
    """What a prefix of ``k`` vertices counts."""
    return F.lit(1.0)


def exact_estimates(graph: Graph, pattern: Pattern, prefixes: DataFrame, space_of: Callable[[Pattern], CandidateSpace] | None = None) -> DataFrame:
    """Exact cardinality of each distinct prefix, one plan for all; at most 2**|V| - 1 of them."""
    keys = sorted(r.prefix_key for r in prefixes.select("prefix_key").distinct().collect())
    graph, parts = graph.part(pattern), []
    for key in keys:
        sub = pattern.induced(map(int, key.split(",")))
        parts.append(matcher.count(graph, sub, space=space_of(sub) if space_of else None).select(F.lit(key).alias("prefix_key"), F.col("n").cast("double").alias("est")))
    return reduce(DataFrame.unionByName, parts)


def estimated(spark: SparkSession, pattern: Pattern, keys: list[str], estimate: Callable[[Pattern], float]) -> DataFrame:
    """``(prefix_key, est)`` by a function of the sub-pattern, called once for each key."""
    return spark.createDataFrame([(k, float(estimate(pattern.induced(map(int, k.split(",")))))) for k in keys], "prefix_key string, est double")


def progress(prefixes: DataFrame, estimates: DataFrame, weigh: Callable[[Column], Column] = weight) -> DataFrame:
    """``(order_id, k, est, weight, score)``: the running score of each order."""
    each = prefixes.select("order_id", "k", "prefix_key").join(F.broadcast(estimates), "prefix_key").withColumn("weight", weigh(F.col("k")))
    running = Window.partitionBy("order_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select("order_id", "k", "est", "weight", F.sum(F.col("weight") * F.col("est")).over(running).alias("score"))


def ranking_by_level(scores: DataFrame) -> DataFrame:
    """``(k, order_id, score, rank)`` after every level, lowest score first, ties by order id."""
    return scores.select("k", "order_id", "score", F.row_number().over(Window.partitionBy("k").orderBy("score", "order_id")).alias("rank"))


def final_ranking(orders: DataFrame, scores: DataFrame, size: int) -> DataFrame:
    """``(order_id, ord, score, rank)``; ``ord`` as a comma-joined string."""
    last = ranking_by_level(scores).where(F.col("k") == size)
    return last.join(F.broadcast(orders), "order_id").select("order_id", F.array_join("ord", ",").alias("ord"), "score", "rank")


def top(ranking: DataFrame, n: int = TOP) -> DataFrame:
    return ranking.where(F.col("rank") <= n)


def best(scores: DataFrame, size: int) -> DataFrame:
    """One row ``(order_id, score)``: the lowest final score, ties by order id."""
    return scores.where(F.col("k") == size).agg(F.min(F.struct("score", "order_id")).alias("b")).select("b.order_id", "b.score")


def best_so_far(scores: DataFrame) -> DataFrame:
    """``(k, order_id, score)``: what a running minimum over partial scores, in (k, order_id) order, settles on first.

    As scores only grow this is decided at the first level; kept for comparison with :func:`best`.
    """
    return scores.agg(F.min(F.struct("score", "k", "order_id")).alias("b")).select("b.k", "b.order_id", "b.score")


def pivot(scores: DataFrame, order_ids: list[int]) -> DataFrame:
    """``k`` and the score of each of the orders as a column."""
    return scores.groupBy("k").pivot("order_id", order_ids).agg(F.first("score")).select("k", *(F.col(str(i)).alias(f"order_{i}") for i in order_ids))


def progress_percent(scores: DataFrame, size: int, n_orders: int) -> DataFrame:
    """``(k, percent)`` of the prefixes evaluated after each level."""
    per_level = scores.groupBy("k").agg(F.count("*").alias("n"))
    done = F.sum("n").over(Window.orderBy("k"))  # a row for each level
    return per_level.select("k", F.round(F.least(F.lit(100.0), 100.0 * done / (size * n_orders)), 6).alias("percent"))


def beam_by_score(graph: Graph, pattern: Pattern, estimate: Callable[[Pattern], float], width: int = plans.BEAM) -> list[tuple[int, ...]]:
    """Orders grown level by level, keeping the ``width`` of lowest accumulated score; prefixes are estimated once each."""
    known: dict[str, float] = {}

    def score(order: tuple[int, ...]) -> float:
        total = 0.0
        for k in range(1, len(order) + 1):
            key = plans.prefix_key(order[:k])
            if key not in known:
                known[key] = float(estimate(pattern.induced(order[:k])))
            total += known[key]
        return total

    return plans.beam(pattern, width, score)
