import json
import logging
import threading
import time

import pytest

from sparklode.api import Api
from sparklode.client import Handler, Sender, payload, sample_rows
from sparklode.operators import compaction, search, tiering
from sparklode.operators.store import Store
from sparklode.plans.request import QueryRequest
from sparklode.sources.push import answered, decode_msgpack, encode_msgpack
from sparklode.streaming.ingest import ingest, payload_stream
from sparklode.streaming.service import Loop, Service, compact_all, tier


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), str(tmp_path / "cold"), grace=0)


def call(api, method, path, body=None, **headers):
    status, kind, data = api.handle(method, f"/api/v1/{path}", body if isinstance(body, bytes) else json.dumps(body).encode(), {k.replace("_", "-"): v for k, v in headers.items()})
    return status, json.loads(data) if kind == "application/json" else decode_msgpack(data)


def test_requests(store):
    api = Api(store)
    assert call(api, "POST", "query", {}) == (200, {"status": "success", "data": []})
    pushed = payload([(5, "first é", {"app": "web"}), (6, "second", {"app": "db"})])
    assert call(api, "POST", "push", pushed, Content_Type="application/json") == (200, {"status": "success"})
    assert call(api, "POST", "push", encode_msgpack(payload([(7, "third", {"zone": "eu"})])), Content_Type="application/msgpack")[0] == 200
    status, found = call(api, "POST", "query", {"query": '{app=~"web|db"}', "line": "replaced", "limit": 1})
    assert (status, found["data"]) == (200, [{"timestamp": 6, "line": "second", "labels": {"app": "db"}}])
    assert call(api, "GET", "labels") == (200, {"status": "success", "data": ["app", "zone"]}) == call(api, "GET", "labels", Accept="application/msgpack")
    assert call(api, "GET", "stats")[1]["data"]["segments_total"] == 0
    assert call(api, "GET", "auth") == (200, {"required": False})
    for bad in (b"{", b"[1]", {"query": "{app=web}"}, {"limit": "many"}, {"matchers": [3]}):
        assert call(api, "POST", "query", bad)[0] == 400
    assert call(api, "POST", "query", {"matchers": [{"name": "a", "value": "(", "type": "=~"}]})[0] == 500
    for body, kind in ((b"{", "application/json"), (b"3", "application/json"), (b"\xc1", "application/msgpack"), (b"", "text/plain"), (b'{"streams": []}', "application/json"), (b'{"streams": [3]}', "application/json")):
        assert call(api, "POST", "push", body, Content_Type=kind)[0] == 400
    assert call(api, "GET", "nowhere")[0] == 404


def test_key(store):
    api, taken = Api(store, key="secret", push=lambda p: taken.append(p), durable=False), []
    assert call(api, "GET", "stats")[0] == 401 == call(api, "POST", "query", {}, Authorization="Bearer other")[0]
    assert call(api, "GET", "auth", Authorization="Bearer secret") == (200, {"required": True})
    assert call(api, "POST", "push", payload([(1, "x", {"a": "b"})]), Content_Type="application/json")[0] == 202 and len(taken) == 1


def test_search_plan(store):
    rows = list(sample_rows(40))
    for i in range(2):
        store.flush(store.spark.createDataFrame([(payload(rows[i * 20 : (i + 1) * 20])["streams"],)], "streams array<struct<stream:map<string,string>,values:array<array<string>>>>"), batch=i)
    name = compaction.compact(store, 2, 2, now=1000)
    tiering.rotate(store, age=1, now=5000)
    api = Api(store)
    status, plan = call(api, "POST", "search/plan", {"limit": 10, "query": "not looked at"})
    assert status == 200 and plan["data"] == [] and [s["id"] for s in plan["segments"]] == [name] and plan["expires_at"].endswith("Z") and plan["limit"] == 10
    assert search.query_paths(store.spark, [plan["segments"][0]["url"]], QueryRequest(limit=10)).count() == 10
    assert call(api, "POST", "search/plan", b"no")[0] == 400
    assert call(Api(store, remote=False), "POST", "search/plan", {})[0] == 400


def test_messagepack_round_trip():
    for value in (None, True, False, 0, 127, 128, 255, 256, 70000, 1 << 40, (1 << 64) - 1, -1, -32, -33, -200, -40000, -(1 << 40), 1.5, "", "é" * 20, "x" * 300, "y" * 70000, b"\0" * 300, [], [1] * 20, {"a": {"b": ["c"]}}, {str(i): i for i in range(70)}):
        assert decode_msgpack(encode_msgpack(value)) == value


def test_a_bad_body_costs_no_other(spark):
    good = payload([(1, "x", {"a": "b"})])
    bodies = [("application/json", json.dumps(good).encode()), ("application/json", b"{no"), ("application/msgpack", encode_msgpack(good)), ("application/msgpack", b"\xc1"), ("application/protobuf", b"\xff"), ("text/plain", b""), (None, None), ("application/json", b'{"streams": []}')]
    found = answered(spark.createDataFrame(bodies, "content_type string, body binary")).collect()
    assert len(found) == 8 and sum(r["rejected"] is None for r in found) == 2
    assert {"At least one stream is required", "the body is not JSON"} <= {r["rejected"] for r in found}


def test_loops_and_ordered_shutdown(spark, store, tmp_path):
    rows = list(sample_rows(80))
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(4):
        (inbox / f"{i}.json").write_text(json.dumps(payload(rows[i * 20 : (i + 1) * 20])) + "\n")
    service = Service(store, ingest(store, payload_stream(store, str(inbox), 1), str(tmp_path / "ckpt"), {"processingTime": "100 milliseconds"}), compact_every=0.2, min_files=2)
    service.close()
    assert not service.ingest.isActive and not any(x.thread.is_alive() for x in service.loops)
    assert search.query(store.catalog, QueryRequest(limit=5000)).count() == 80
    compact_all(store, 2, 128)
    assert store.catalog.read().where("kind = 'flush'").count() < 2
    assert tier(store, age=0, grace=0)[0] >= 1 and search.query(store.catalog, QueryRequest(limit=5000)).count() == 80


def test_a_loop_outlives_errors():
    turns, done = [], threading.Event()

    def work():
        turns.append(1)
        if len(turns) == 3:
            done.set()
        raise OSError("not now")

    loop = Loop(work, 0.01)
    assert done.wait(10)
    loop.stop()
    assert loop.errors >= 3 and not loop.thread.is_alive()
    with pytest.raises(ValueError, match="positive"):
        Loop(work, 0)


def test_sender_batches_retries_and_counts_what_it_drops():
    pushed, failures = [], [1, 1]

    def push(body):
        if failures:
            failures.pop()
            raise OSError("try again")
        pushed.append(body)

    sender = Sender(push, batch=10, interval=0.05)
    for i in range(25):
        sender.add(i, f"line {i}", {"n": str(i % 2)})
    sender.close()
    values = [v for body in pushed for s in body["streams"] for v in s["values"]]
    assert sorted(int(t) for t, _ in values) == list(range(25)) and sender.dropped == 0 and len(pushed) >= 3
    held = threading.Event()
    slow = Sender(lambda body: held.wait(5), batch=1, capacity=2)
    for i in range(20):
        slow.add(i, "x", {"a": "b"})
        time.sleep(0.001)
    held.set()
    slow.close()
    assert slow.dropped > 0
    lost = Sender(lambda body: (_ for _ in ()).throw(OSError("down")), retries=1)
    lost.add(1, "x", {"a": "b"})
    lost.close()
    assert lost.dropped == 1


def test_handler():
    pushed = []
    sender = Sender(pushed.append, interval=0.05)
    logger = logging.getLogger("sparklode-test")
    logger.propagate, logger.handlers = False, [Handler(sender, app="web")]
    logger.warning("slow %d", 3, extra={"fields": {"ms": 12}})
    try:
        raise KeyError("gone")
    except KeyError:
        logger.exception("failed")
    sender.close()
    streams = {s["stream"]["level"]: s for body in pushed for s in body["streams"]}
    first, second = (json.loads(streams[k]["values"][0][1]) for k in ("warning", "error"))
    assert (first["msg"], first["ms"], first["level"], streams["warning"]["stream"]["app"]) == ("slow 3", 12, "WARNING", "web") and "gone" in second["error"]
