import json
import threading

import pytest

from quiltgraph.operators import graph
from quiltgraph.service import Service, ServiceError, SessionStatus
from quiltgraph.sources import index_store
from quiltgraph.streaming import events

TRIANGLE = {"vertices": [{"id": 0, "label": 0}, {"id": 1, "label": 0}, {"id": 2, "label": 1}], "edges": [{"source": 0, "target": 1}, {"source": 1, "target": 2}, {"source": 0, "target": 2}]}


@pytest.fixture(scope="module")
def service(spark):
    rows = [(0, 0), (1, 0), (2, 1), (3, 0)]
    g = graph.build(spark.createDataFrame(rows, "vid bigint, raw_label int"), spark.createDataFrame([(0, 1, 0), (1, 2, 0), (0, 2, 0), (2, 3, 0)], "src bigint, dst bigint, elabel int"))
    s = Service(spark)
    s.register("tiny", g.stored("tiny"))
    return s


def test_errors(service):
    for dataset, q, status in (("none", TRIANGLE, 404), ("tiny", {"vertices": [{"id": 0}, {"id": 1}], "edges": []}, 422)):
        with pytest.raises(ServiceError) as e:
            service.create_session(dataset, q)
        assert e.value.status == status and e.value.as_dict()["error"]["code"] == e.value.code
    with pytest.raises(ServiceError):
        service.snapshot("nope")
    assert service.health() == {"status": "ok", "datasets": 1}
    assert service.datasets() == [{"id": "tiny", "num_vertices": 4, "num_edges": 4, "labels": [0, 1], "index_status": "ready"}]


def test_index_that_is_not_ready(spark, service, tmp_path):
    s = Service(spark)
    s.register("later", index=f"{tmp_path}/index")
    with pytest.raises(ServiceError) as e:
        s.create_session("later", TRIANGLE)
    assert (e.value.status, e.value.code) == (409, "INDEX_NOT_READY") and s.datasets()[0]["index_status"] == "missing"
    index_store.save(service.dataset("tiny"), f"{tmp_path}/index")
    graph = s.dataset("later")
    assert s.datasets()[0]["num_edges"] == 4 and graph.triangles.count() == 6 and graph.four_cycles.count() == 0
    assert s.execute(s.create_session("later", TRIANGLE).id).first()[0] == 2


def test_live_stream(service):
    """Messages come before the session ends, and the same ones when read again."""
    go, got = threading.Event(), []

    def slow(p):
        if p.size == 3:
            assert go.wait(60)
        return float(p.size)

    s = service.create_session("tiny", TRIANGLE, estimate=slow, wait=False)
    for message in service.stream(s.id):
        got.append(message)
        if message["event"] in ("batch_update", "prefix_progress") and not go.is_set():
            assert s.status is SessionStatus.RUNNING
            go.set()
    assert go.is_set() and got[-1]["event"] == "session_completed" and got[0]["event"] == "index_loading"
    assert sum(len(m["data"]["events"]) if m["event"] == "batch_update" else 1 for m in got) == len(s.log)
    assert list(service.stream(s.id)) == got


def test_session(service):
    s = service.create_session("tiny", TRIANGLE, estimate=lambda p: float(10 * p.size + sum(p.labels)))
    assert s.status is SessionStatus.COMPLETED and len(s.orders) == 6
    result = service.result(s.id)
    assert result["best_score"] == min(r["score"] for r in result["ranking"]) == 10 + 20 + 31
    assert [r["rank"] for r in result["ranking"]] == list(range(1, 7))
    messages = list(service.stream(s.id))
    assert messages[0]["event"] == "index_loading" and messages[-1]["event"] == "session_completed"
    assert list(service.stream(s.id)) == messages  # replayable
    assert service.execute(s.id).first()[0] == 2
    assert service.snapshot(s.id)["total_orders"] == 6
    json.dumps(messages)


def test_session_with_the_estimator(service):
    s = service.create_session("tiny", {"vertices": TRIANGLE["vertices"][1:], "edges": [{"source": 1, "target": 2}]})
    assert service.result(s.id)["best_score"] == 1 + 3


def test_failed_session(service):
    def broken(p):
        raise RuntimeError("boom")

    s = service.create_session("tiny", TRIANGLE, estimate=broken)
    assert s.status is SessionStatus.FAILED
    with pytest.raises(ServiceError) as e:
        service.result(s.id)
    assert e.value.status == 500 and list(service.stream(s.id))[-1]["event"] == "session_failed"


def test_batches():
    log = [(0, "session_started", {}), (10, "score_updated", {"i": 1}), (50, "prefix_progress", {"i": 2}), (84, "score_updated", {"i": 3}), (85, "score_updated", {"i": 4}), (90, "something", {}), (91, "score_updated", {}), (92, "session_completed", {}), (93, "score_updated", {})]
    got = list(events.batch_list(log))
    assert [m["event"] for m in got] == ["session_started", "batch_update", "score_updated", "something", "score_updated", "session_completed"]
    assert got[1]["data"]["count"] == 3


def test_stored_and_streamed_batches_agree(spark, tmp_path):
    rows, at = [], 0
    for i in range(60):
        at += (7 * i) % 50
        rows.append((i % 3, at, "score_updated" if i % 7 else "order_generated", i))
    df = spark.createDataFrame(rows, "key int, ms bigint, event string, i int").coalesce(1)
    stored = {tuple(r) for r in events.batches(df, "key", "ms", "event", "i", 75).collect()}
    expected = set()
    for key in range(3):
        start = last = n = 0
        for _, ms, event, _ in (r for r in rows if r[0] == key):
            if n and (event not in events.BATCHABLE or ms >= start + 75):
                expected.add((key, start, last, n, False))
                n = 0
            if event in events.BATCHABLE:
                start, last, n = (start if n else ms), ms, n + 1
            else:
                expected.add((key, ms, ms, 1, True))
        if n:
            expected.add((key, start, last, n, False))
    assert stored == expected
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = events.stream_batches(stream, "key", "ms", "event").writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = {tuple(r) for r in spark.table("batches").collect()}
    assert streamed <= expected and len(expected - streamed) <= 3  # a key's last batch stays open


def test_watermarked(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, 'a' AS event FROM range(180)")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = events.watermarked(stream, "ts", "event", "1 hour", "0 seconds").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.n for r in spark.table("hours").collect()} <= {60}
