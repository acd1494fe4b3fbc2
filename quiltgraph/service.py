"""Planning sessions in process: what a planning server offers, without HTTP."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import SparkSession

from pyspark.sql import functions as F

from .operators import estimator, matcher
from .operators.graph import Graph
from .plans import orders as plans
from .plans.pattern import Pattern, ValidationError, normalize
from .sources import index_store
from .streaming import events

#: Orders in a ranking message.
TOP = 10


class SessionStatus(Enum):
    PENDING = "pending"
    RUNNING = "running"
    COMPLETED = "completed"
    FAILED = "failed"


class ServiceError(Exception):
    """A refused request: a status as in HTTP, and a code."""

    def __init__(self, status: int, code: str, message: str, details: dict | None = None):
        super().__init__(message)
        self.status, self.code, self.message, self.details = status, code, message, details or {}

    def as_dict(self) -> dict:
        return {"error": {"code": self.code, "message": self.message, "details": self.details}, "request_id": uuid.uuid4().hex[:12]}


@dataclass
class Order:
    order_id: int
    order: tuple[int, ...]
    score: float = 0.0
    estimates: list[float] = field(default_factory=list)


@dataclass
class Session:
    id: str
    dataset: str
    pattern: Pattern
    status: SessionStatus = SessionStatus.PENDING
    orders: list[Order] = field(default_factory=list)
    best_order_id: int | None = None
    best_score: float | None = None
    error: str | None = None
    created_at: float = field(default_factory=time.time)
    completed_at: float | None = None
    log: list[tuple[float, str, dict]] = field(default_factory=list)  # replayable
    changed: threading.Condition = field(default_factory=threading.Condition, repr=False)

    def push(self, name: str, **data) -> None:
        with self.changed:
            self.log.append((time.time() * 1000, name, data))
            self.changed.notify_all()

    def ranking(self) -> list[Order]:
        return sorted(self.orders, key=lambda o: (o.score, o.order_id))


class Service:
    """Datasets by name, and sessions that rank match orders of a pattern over them."""

    def __init__(self, spark: SparkSession, options: estimator.Options = estimator.Options()):
        self.spark, self.options = spark, options
        self._graphs: dict[str, Graph | None] = {}
        self._indexes: dict[str, str | None] = {}
        self.sessions: dict[str, Session] = {}
        self._lock = threading.Lock()

    def register(self, name: str, graph: Graph | None = None, index: str | None = None) -> None:
        """A dataset: a graph at hand, or the folder of a stored index, which need not be there yet."""
        self._graphs[name], self._indexes[name] = graph, index

    def health(self) -> dict:
        return {"status": "ok", "datasets": len(self._graphs)}

    def index_status(self, name: str) -> str:
        """``ready`` too for a graph at hand without an index."""
        index, graph = self._indexes[name], self._graphs[name]
        return index_store.status(self.spark, index).value if index and graph is None else "ready"

    def datasets(self) -> list[dict]:
        """A record for each dataset by name; counts and labels where it can be read."""
        return [self.describe(name) for name in sorted(self._graphs)]

    def describe(self, name: str) -> dict:
        found = {"id": name, "num_vertices": None, "num_edges": None, "labels": [], "index_status": self.index_status(name)}
        if found["index_status"] == "ready":
            graph = self.dataset(name)
            row = graph.vertices.agg(F.count("*"), F.coalesce(F.sum("deg"), F.lit(0)), F.sort_array(F.collect_set("raw_label"))).first()  # a number for each label
            found |= {"num_vertices": row[0], "num_edges": row[1] // 2, "labels": list(row[2])}
        return found

    def dataset(self, name: str) -> Graph:
        """The graph, loaded from its index at first use: 404 for an unknown name, 409 for an index that is not ready."""
        if name not in self._graphs:
            raise ServiceError(404, "DATASET_NOT_FOUND", f"no dataset {name}")
        if self._graphs[name] is None:
            if (status := self.index_status(name)) != "ready":
                raise ServiceError(409, "INDEX_NOT_READY", f"the index of {name} is {status}", {"index_status": status})
            self._graphs[name] = index_store.load(self.spark, self._indexes[name]).graph
        return self._graphs[name]

    def create_session(self, dataset: str, query: Mapping, beam_width: int | None = None, estimate: Callable[[Pattern], float] | None = None, wait: bool = True) -> Session:
        """Validates the query and plans it; with ``wait`` off, in a thread. ``estimate`` replaces the estimator."""
        graph = self.dataset(dataset)
        try:
            pattern = normalize(query)
        except ValidationError as e:
            raise ServiceError(422, e.code, e.message, e.details) from e
        session = Session(uuid.uuid4().hex[:12], dataset, pattern)
        with self._lock:
            self.sessions[session.id] = session
        work = threading.Thread(target=self._run, args=(session, graph, beam_width, estimate), daemon=True)
        work.start()
        if wait:
            work.join()
        return session

    def _run(self, session: Session, graph: Graph, beam_width: int | None, estimate: Callable[[Pattern], float] | None) -> None:
        pattern = session.pattern
        estimate = estimate or (lambda p: estimator.estimate(graph, p, self.options)["estimate"])
        try:
            session.status = SessionStatus.RUNNING
            session.push("index_loading", dataset_id=session.dataset)
            session.push("index_loaded", dataset_id=session.dataset)
            session.push("session_started", session_id=session.id)
            made, total = plans.generate(pattern, beam_width), pattern.size
            for i, order in enumerate(made):
                session.orders.append(Order(i, order))
                session.push("order_generated", order_id=i, order=list(order), total_orders=len(made))
            known: dict[str, float] = {}  # a prefix is its vertex set
            for k in range(1, total + 1):
                for o in session.orders:
                    key = plans.prefix_key(o.order[:k])
                    if key not in known:
                        known[key] = float(estimate(pattern.induced(o.order[:k])))
                    o.estimates.append(known[key])
                    o.score += known[key]
                    session.push("prefix_progress", order_id=o.order_id, order=list(o.order), prefix_index=k, total_prefixes=total, estimated_cardinality=known[key], weight=1.0, accumulated_score=o.score)
                    session.push("score_updated", order_id=o.order_id, score=o.score, prefix_index=k)
                top = [{"rank": r, "order_id": o.order_id, "order": list(o.order), "score": o.score, "prefix_index": k, "total_prefixes": total} for r, o in enumerate(session.ranking()[:TOP], 1)]
                session.push("ranking_updated", top_k=top, total_orders=len(made))
            best = session.ranking()[0]
            session.best_order_id, session.best_score = best.order_id, best.score
            session.push("best_order_selected", order_id=best.order_id, order=list(best.order), score=best.score)
            session.status, session.completed_at = SessionStatus.COMPLETED, time.time()
            session.push("session_completed", session_id=session.id, best_order_id=best.order_id, best_order=list(best.order), best_score=best.score, total_orders_evaluated=len(made))
        except Exception as e:
            session.status, session.completed_at, session.error = SessionStatus.FAILED, time.time(), str(e)
            session.push("session_failed", session_id=session.id, error={"code": type(e).__name__, "message": str(e)})

    def _session(self, session_id: str) -> Session:
        if session_id not in self.sessions:
            raise ServiceError(404, "SESSION_NOT_FOUND", f"no session {session_id}")
        return self.sessions[session_id]

    def snapshot(self, session_id: str) -> dict:
        s = self._session(session_id)
        return {"session_id": s.id, "status": s.status.value, "total_orders": len(s.orders), "best_order_id": s.best_order_id, "best_score": s.best_score, "ranking": [{"order_id": o.order_id, "score": o.score} for o in s.ranking()[:10]]}

    def stream(self, session_id: str) -> Iterator[dict]:
        """The session's messages from its first event on, as they come; can be read again, with the same messages."""
        s, batcher, read = self._session(session_id), events.Batcher(), 0
        while True:
            with s.changed:
                if read == len(s.log):
                    left = batcher.opened + batcher.window_ms - time.time() * 1000 if batcher.held else None
                    s.changed.wait(None if left is None else max(left, 0) / 1000)
                fresh, read = s.log[read:], len(s.log)
            # without news a batch is due by the clock; events are judged by their own times
            out = batcher.due(time.time() * 1000) if not fresh else []
            for at, name, data in fresh:
                out += batcher.push(at, name, data)
                if name in events.TERMINAL:
                    yield from out
                    return
            yield from out

    def result(self, session_id: str) -> dict:
        s = self._session(session_id)
        if s.status is SessionStatus.FAILED:
            raise ServiceError(500, "SESSION_FAILED", s.error or "failed")
        if s.status is not SessionStatus.COMPLETED:
            raise ServiceError(409, "SESSION_NOT_COMPLETED", "the session is still running")
        return {"session_id": s.id, "best_order_id": s.best_order_id, "best_score": s.best_score, "ranking": [{"order_id": o.order_id, "order": list(o.order), "score": o.score, "prefix_estimates": o.estimates, "rank": r} for r, o in enumerate(s.ranking(), 1)]}

    def execute(self, session_id: str):
        """One row: the number of embeddings, found by joining in the best order."""
        s = self._session(session_id)
        if s.best_order_id is None:
            raise ServiceError(409, "SESSION_NOT_COMPLETED", "no order has been chosen")
        return matcher.count(self.dataset(s.dataset), s.pattern, s.orders[s.best_order_id].order)
