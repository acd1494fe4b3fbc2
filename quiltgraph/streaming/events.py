"""Planning events and their debounced batches.

An event that can wait opens a window at its own time; events that can wait and come before the window
ends share one batch. An event that cannot wait closes the open batch and goes out alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_MS = 75
#: The names of the events that go out at once, and of those that can wait.
IMMEDIATE = ("index_loading", "index_loaded", "session_started", "session_completed", "session_failed", "best_order_selected", "order_generated", "execution_started", "execution_completed")
BATCHABLE = ("prefix_progress", "score_updated", "ranking_updated")
TERMINAL = ("session_completed", "session_failed")


def waits(event: Column, batchable: tuple[str, ...] = BATCHABLE) -> Column:
    """Whether an event can wait; unknown ones cannot."""
    return event.isin(*batchable)


class Batcher:
    """Messages from events as they come; an open batch is due ``window_ms`` after its first event."""

    def __init__(self, window_ms: float = WINDOW_MS):
        self.window_ms, self.held, self.opened = window_ms, [], 0.0

    def flush(self) -> list[dict]:
        held, self.held = self.held, []
        return held if len(held) < 2 else [{"event": "batch_update", "data": {"events": held, "count": len(held)}}]

    def due(self, now: float) -> list[dict]:
        """What has waited long enough."""
        return self.flush() if self.held and now >= self.opened + self.window_ms else []

    def push(self, at: float, name: str, data: dict) -> list[dict]:
        """The messages that an event at a time sets free."""
        out = self.due(at)
        if name in BATCHABLE:
            self.opened = self.opened if self.held else at
            self.held.append({"event": name, "data": data})
            return out
        return [*out, *self.flush(), {"event": name, "data": data}]


def batch_list(events: list[tuple[float, str, dict]], window_ms: float = WINDOW_MS) -> Iterator[dict]:
    """The messages for one session's events ``(ms, name, data)`` in order, up to a terminal one."""
    batcher = Batcher(window_ms)
    for at, name, data in events:
        yield from batcher.push(at, name, data)
        if name in TERMINAL:
            return
    yield from batcher.flush()


def batches(events: DataFrame, key: str, ts_ms: str, name: str, order: str, window_ms: int, batchable: tuple[str, ...] = BATCHABLE) -> DataFrame:
    """``(key, batch_start_ms, last_ms, n_events, immediate)`` of every message of a stored event table.

    A gap of a window or an immediate event ends any batch, so each key's events fall apart into runs by
    a window function; within a run the windows are laid off by a fold over its times.
    """
    here = Window.partitionBy(key).orderBy("ms", "ord")
    each = events.select(key, F.col(ts_ms).alias("ms"), F.col(order).alias("ord"), waits(F.col(name), batchable).alias("waits"))
    each = each.withColumn("before", F.lag("ms").over(here)).withColumn("after_now", ~F.coalesce(F.lag("waits").over(here), F.lit(False)))
    starts = ~F.col("waits") | F.col("after_now") | F.col("before").isNull() | (F.col("ms") >= F.col("before") + window_ms)
    each = each.withColumn("run", F.sum(starts.cast("long")).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    runs = each.groupBy(key, "run").agg(F.array_sort(F.collect_list("ms")).alias("times"), F.first("waits").alias("waits"))
    empty = F.array().cast("array<struct<start:bigint,last:bigint,n:bigint>>")

    def fold(a: Column, t: Column) -> Column:
        fresh = F.struct(t.alias("start"), t.alias("last"), F.lit(1).cast("bigint").alias("n"))
        joins = (F.size(a) > 0) & (t < F.try_element_at(a, F.lit(-1))["start"] + window_ms)
        longer = F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), t.alias("last"), (F.try_element_at(a, F.lit(-1))["n"] + 1).alias("n"))
        return F.when(joins, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(a, F.array(fresh)))

    laid = runs.select(key, "waits", F.explode(F.aggregate("times", empty, fold)).alias("b"))
    return laid.select(key, F.col("b.start").alias("batch_start_ms"), F.col("b.last").alias("last_ms"), F.col("b.n").alias("n_events"), (~F.col("waits")).alias("immediate"))


def tumbling(events: DataFrame, ts: str, name: str, window: str) -> DataFrame:
    """``(window_start, event, n)``: fixed windows, the approximation that needs no state."""
    return events.groupBy(F.window(ts, window).alias("w"), F.col(name).alias("event")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event", "n")


def watermarked(stream: DataFrame, ts: str, name: str, window: str, late: str) -> DataFrame:
    """:func:`tumbling` over a stream, with events up to ``late`` behind."""
    return tumbling(stream.withWatermark(ts, late), ts, name, window)


def stream_batches(stream: DataFrame, key: str, ts_ms: str, name: str, window_ms: int = WINDOW_MS, batchable: tuple[str, ...] = BATCHABLE) -> DataFrame:
    """The messages of a stream of events, as :func:`batches` gives them: state is the open batch of each key.

    A batch goes out with the first later event that it does not hold, or when no event came for a
    window of processing time.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n = state.get if state.exists else (0, 0, 0)
        out: list[tuple] = []
        if state.hasTimedOut:
            if n:
                out.append((start, last, n, False))
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values(ts_ms, kind="stable")
            for at, event in zip(rows[ts_ms], rows[name]):
                if n and (event not in batchable or at >= start + window_ms):
                    out.append((start, last, n, False))
                    n = 0
                if event in batchable:
                    start, last, n = (start if n else int(at)), int(at), n + 1
                else:
                    out.append((int(at), int(at), 1, True))
            state.update((int(start), int(last), int(n)))
            state.setTimeoutDuration(max(window_ms, 1))
        if out:
            made = pd.DataFrame(out, columns=["batch_start_ms", "last_ms", "n_events", "immediate"])
            made.insert(0, key, k[0])
            yield made

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, batch_start_ms bigint, last_ms bigint, n_events bigint, immediate boolean", "start bigint, last bigint, n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def session_events(orders: DataFrame, scores: DataFrame, size: int) -> DataFrame:
    """``(seq, event, order_id, k, value)``: the events of a planning session, in the order they are sent.

    Loading, start, an event for each order; then for each level an estimate and a score for each order
    and a ranking; then the end.
    """
    spark = orders.sparkSession
    none, nothing = F.lit(None).cast("int"), F.lit(None).cast("double")
    row = lambda stage, k, o, part, event, oid, kk, value: [F.lit(stage).alias("stage"), k.alias("level"), o.alias("o"), F.lit(part).alias("part"), F.lit(event).alias("event"), oid.alias("order_id"), kk.alias("k"), value.alias("value")]
    zero, one = F.lit(0), spark.range(1)
    oid, k = F.col("order_id").cast("int"), F.col("k").cast("int")
    parts = [one.select(*row(0, zero, zero, i, e, none, none, nothing)) for i, e in enumerate(("index_loading", "index_loaded", "session_started"))]
    parts.append(orders.select(*row(1, zero, oid, 0, "order_generated", oid, none, nothing)))
    parts.append(scores.select(*row(2, k, oid, 0, "prefix_progress", oid, k, F.col("est"))))
    parts.append(scores.select(*row(2, k, oid, 1, "score_updated", oid, k, F.col("score"))))
    parts.append(scores.select(k.alias("k")).distinct().select(*row(2, F.col("k"), F.lit(2147483647), 2, "ranking_updated", none, F.col("k"), nothing)))
    lowest = scores.where(F.col("k") == size).agg(F.min("score").alias("score"))
    parts.append(lowest.select(*row(3, zero, zero, 0, "session_completed", none, none, F.col("score"))))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # a session has some rows for each prefix, so its order is one small window
    return every.select((F.row_number().over(Window.orderBy("stage", "level", "o", "part")) - 1).cast("bigint").alias("seq"), "event", "order_id", "k", "value")


def folded(events: DataFrame) -> DataFrame:
    """One row of what a client knows after the events: the last event, counts, best score."""
    return events.agg(F.max_by("event", "seq").alias("last_event"), F.count_if(F.col("event") == "order_generated").alias("total_orders"), F.count_if(F.col("event") == "prefix_progress").alias("points"), F.max(F.when(F.col("event") == "session_completed", F.col("value"))).alias("best_score"))
