import io
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklode import cli
from sparklode.client import payload, sample_rows
from sparklode.operators import compaction, search, tiering
from sparklode.operators.pruning import describe, prune
from sparklode.operators.store import Store, flatten, flush_name, parse_bounds, segment_name
from sparklode.plans.request import Matcher, QueryRequest
from sparklode.sources.push import PushError, decode, decode_msgpack, decoded, invalid
from sparklode.sources.schema import PUSH_SCHEMA
from sparklode.streaming.ingest import ingest, payload_stream
from sparklode.streaming.tail import Poller, log_stream, tail


def frame(spark, *payloads):
    return spark.createDataFrame([(p["streams"],) for p in payloads], PUSH_SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), str(tmp_path / "cold"), grace=0)


def keyed(rows):
    return sorted((r["timestamp"], r["line"], tuple(sorted(r["labels"].items()))) for r in rows)


def fill(store, n=9, size=40):
    rows = list(sample_rows(n * size))
    for i in range(n):
        store.flush(frame(store.spark, payload(rows[i * size : (i + 1) * size])), batch=i)
    return rows


def test_flatten_skips_bad_timestamps(spark):
    p = {"streams": [{"stream": {"a": "b"}, "values": [["5", "five"], ["+6", "six"], [" 7", "no"], ["7\n", "no"], ["1.5", "no"], ["", "no"], ["99999999999999999999", "no"], ["-8", None]]}]}
    assert sorted((r["timestamp"], r["line"]) for r in flatten(frame(spark, p)).collect()) == [(-8, ""), (5, "five"), (6, "six")]


def test_label_keys_survive_bad_timestamps(store):
    store.flush(frame(store.spark, {"streams": [{"stream": {"only": "x"}, "values": [["", "bad"]]}]}), batch=1)
    assert [r["key"] for r in store.catalog.label_keys().collect()] == ["only"]
    row = store.catalog.read().first()
    assert (row["min_timestamp"], row["max_timestamp"], row["row_count"]) == (0, 0, 0)


def test_payload_validation():
    assert invalid({"streams": []}) == "At least one stream is required"
    assert invalid({"streams": [{"stream": {}, "values": [["1", "x"]]}]}) == "Each stream requires labels"
    assert invalid({"streams": [{"stream": {"a": "b"}, "values": []}]}) == "Each stream requires a value"
    assert invalid({"streams": [{"stream": {"a": "b"}, "values": [["x", "y"]]}]}) is None


def test_codecs(spark):
    want = {"streams": [{"stream": {"app": "web"}, "values": [["17", "hé"]]}]}
    text = lambda s: bytes([0xA0 | len(s.encode())]) + s.encode()
    packed = b"\x81" + text("streams") + b"\x91\x82" + text("stream") + b"\x81" + text("app") + text("web") + text("values") + b"\x91\x92" + text("17") + text("hé")
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    proto = field(1, field(1, field(1, b"app") + field(2, b"web")) + field(2, field(1, b"17") + field(2, "hé".encode())))
    assert decode(packed, "application/msgpack") == want == decode(proto, "application/protobuf; v=1") == decode(json.dumps(want).encode(), "application/json")
    for bad in (b"\x92\x01", b"\xc1"):
        with pytest.raises(PushError):
            decode_msgpack(bad)
    with pytest.raises(PushError):
        decode(b"", "text/plain")
    bodies = spark.createDataFrame([("application/msgpack", packed), ("application/protobuf", proto), ("application/json", json.dumps(want).encode())], "content_type string, body binary")
    assert [r.asDict(True) for r in decoded(bodies).collect()] == [want] * 3


def test_names():
    assert parse_bounds(segment_name(5, 7, 9)) == (5, 7) == parse_bounds(flush_name(3, 5, 7, 1) + ".parquet")
    assert [parse_bounds(n) for n in ("segment-5", "bucket-1-2", "", "other", "segment-a-b-c", "segment-1-2-3-4")] == [None] * 6


def test_compaction_conserves_rows_and_swaps_at_once(store):
    rows = fill(store)
    before = keyed(search.query(store.catalog, QueryRequest(limit=5000)).collect())
    assert before == sorted((t, line, tuple(sorted(labels.items()))) for t, line, labels in rows)
    name = compaction.compact(store, now=1000)
    assert keyed(search.query(store.catalog, QueryRequest(limit=5000)).collect()) == before
    assert [(r["id"], r["kind"], r["row_count"]) for r in store.catalog.read().collect()] == [(name, "segment", len(rows))]
    store.catalog.purge()
    assert store.files.names(f"{store.root}/flush") == [] and compaction.compact(store) is None
    assert store.catalog.stats().first().asDict() == {"segments_total": 1, "segments_local": 1, "segments_remote": 0, "rows_total": len(rows), "min_timestamp": rows[0][0], "max_timestamp": rows[-1][0]}


def test_compaction_deals_rows_of_one_time_to_tasks_of_bounded_size(store, monkeypatch):
    """By rows and by bytes, also where all timestamps are equal."""
    rows = [(7, f"line {i}", {"a": "b"}) for i in range(400)]
    for limit in ({"ROWS_PER_FILE": 50}, {"BYTES_PER_FILE": 500}):
        with monkeypatch.context() as patch:
            for name, value in limit.items():
                patch.setattr(compaction, name, value, raising=False)
            for i in range(2):
                store.flush(frame(store.spark, payload(rows[i * 200 : (i + 1) * 200])), batch=i)
            path = f"{store.root}/segments/{compaction.compact(store, 2)}"
        sizes = [r["count"] for r in search.scan(store.spark, [path]).groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) >= 5 and max(sizes) < 150 and sum(sizes) == 400
        store.catalog.remove(path.rpartition("/")[2])


def test_flush_of_the_same_batch_replaces(store):
    for _ in range(2):
        store.flush(frame(store.spark, payload(sample_rows(5))), batch=3)
    assert search.query(store.catalog, QueryRequest()).count() == 5 and store.catalog.read().count() == 1


def test_overlapping_writers_lose_nothing(spark, tmp_path):
    """Flushes of several stores on one root at once, and a compaction between them: every row stays visible, once."""
    from concurrent.futures import ThreadPoolExecutor

    rows = list(sample_rows(96))
    stores = [Store(spark, str(tmp_path / "store")) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(stores[i % 4].flush, frame(spark, payload(rows[i * 8 : (i + 1) * 8])), batch=i, index=i % 4) for i in range(12)]
        jobs.append(pool.submit(compaction.compact, stores[0], 2, 4))
        for job in jobs:
            job.result()
    assert keyed(search.query(stores[0].catalog, QueryRequest(limit=5000)).collect()) == sorted((t, line, tuple(sorted(labels.items()))) for t, line, labels in rows)


def test_catalog_changes_are_made_upon_each_other(store):
    """A change that finds its version taken is made again upon it; rows that it needs and that have gone are a conflict."""
    from sparklode.operators.catalog import Conflict

    fill(store, n=2)
    catalog, ids = store.catalog, sorted(r["id"] for r in store.catalog.read().collect())
    create, taken = store.files.create, []

    def late(path, text):
        if not taken:
            taken.append(path)
            Store(store.spark, store.root, grace=0).catalog.remove(ids[0])  # another writer comes first
        return create(path, text)

    store.files.create = late
    catalog.mark_remote({ids[1]: "there"}, 7)
    assert [(r["id"], r["remote_url"], r["uploaded_at"]) for r in catalog.read().collect()] == [(ids[1], "there", 7)]
    with pytest.raises(Conflict):
        catalog.change(remove=ids, needed=ids)
    assert catalog.read().count() == 1


def test_catalog_merges_parts(store):
    from sparklode.operators import catalog as module

    one = fill(store, n=1, size=3) and store.catalog.read().first()
    for i in range(40):
        store.catalog.upsert(store.spark.createDataFrame([one.asDict() | {"id": f"segment-{i % 30:02d}", "kind": "segment", "sealed_at": i}], module.CATALOG_SCHEMA))
    parts = store.catalog._version()[1]["parts"]
    assert len(parts) <= module.MOST_PARTS and sorted((r["id"], r["sealed_at"]) for r in store.catalog.read(False).collect()) == [(f"segment-{i:02d}", i + 30 if i < 10 else i) for i in range(30)]
    store.catalog.purge()
    assert len([n for n in store.files.names(store.catalog.folder) if n.startswith("part-")]) <= module.MOST_PARTS + 1


def test_searches_planned_before_a_compaction_keep_their_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = fill(store, n=8, size=5)
    planned = search.query(store.catalog, QueryRequest(limit=5000))
    assert compaction.compact(store)
    store.catalog.purge()
    assert planned.count() == len(rows) == search.query(store.catalog, QueryRequest(limit=5000)).count()


def test_failed_moves_change_nothing(store, monkeypatch):
    rows = fill(store, n=8, size=5)
    rename = type(store.files).rename

    def half(self, source, target):
        rename(self, source, target)
        for name in [n for n in self.names(target) if n.endswith(".parquet")]:
            self.delete(f"{target}/{name}")

    for broken in (half, lambda self, source, target: (_ for _ in ()).throw(OSError("no"))):
        monkeypatch.setattr(type(store.files), "rename", broken)
        with pytest.raises(OSError):
            compaction.compact(store)
        with pytest.raises(OSError):
            store.flush(frame(store.spark, payload(sample_rows(5))), batch=3)
        monkeypatch.setattr(type(store.files), "rename", rename)
        assert search.query(store.catalog, QueryRequest(limit=5000)).count() == len(rows)
    assert store.catalog.read().count() == 8


def test_one_bad_source_costs_only_its_rows(store):
    fill(store, n=3, size=5)
    bad = store.catalog.read().orderBy("min_timestamp").first()["local_path"]
    for name in store.files.names(bad):
        if name.endswith(".parquet"):
            with open(f"{bad}/{name}", "wb") as f:
                f.write(b"not parquet")
    rows, errors = search.rows_and_errors(store.catalog, QueryRequest())
    assert len(rows) == 10 and [r["timestamp"] for r in rows] == sorted((r["timestamp"] for r in rows), reverse=True)
    assert len(errors) == 1 and errors[0].startswith(bad)


def test_digest_of_a_payload_is_worked_out_once(spark):
    """Below the explode: above it, every entry would serialise its whole payload."""
    plan = flatten(frame(spark, payload(sample_rows(5))))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    assert max(i for i, x in enumerate(lines) if "Generate" in x) < min(i for i, x in enumerate(lines) if "to_json" in x.lower() or "structstojson" in x.lower())


def test_compression_level(spark, tmp_path):
    sizes = {}
    for level in ("fastest", "best"):
        store = Store(spark, str(tmp_path / level), level=level)
        store.flush(frame(spark, payload(sample_rows(3000))), batch=1)
        sizes[level] = store.files.size(f"{store.root}/flush")
    assert sizes["best"] < sizes["fastest"]
    with pytest.raises(KeyError):
        Store(spark, str(tmp_path), level="none")


def test_tiering_and_rebuild(store):
    fill(store)
    name = compaction.compact(store, now=1000)
    full = keyed(search.query(store.catalog, QueryRequest(limit=5000)).collect())
    assert tiering.rotate(store, age=10, now=1005)[0] == 0 and tiering.rotate(store, age=10, now=2000)[0] == 1
    assert search.query(store.catalog, QueryRequest(local_only=True)).count() == 0
    assert tiering.sweep(store, grace=10, now=2005) == 0 and tiering.sweep(store, grace=10, now=3000) == 1
    store.catalog.purge()
    assert store.catalog.read().first()["local_path"] is None and not store.files.exists(f"{store.root}/segments/{name}")
    assert keyed(search.query(store.catalog, QueryRequest(limit=5000)).collect()) == full
    request = QueryRequest(limit=50, line="request")
    assert search.search_plan(store.spark, search.plan(store.catalog, request), request).collect() == search.query(store.catalog, request).collect()
    store.catalog.remove(name)
    assert tiering.reconcile_remote(store) == 1 and tiering.reconcile_remote(store) == 0
    row = store.catalog.read().first()
    assert (row["row_count"], row["label_keys"], row["trigrams"], row["location"]) == (0, [], None, "remote")
    assert keyed(search.query(store.catalog, QueryRequest(limit=5000, line="GET")).collect())
    store.catalog.remove(name)
    assert tiering.reconcile_remote(store, backfill=True) == 1 and store.catalog.read().first()["row_count"] == 360


def test_reconcile(store):
    fill(store)
    name = compaction.compact(store, now=1000)
    store.catalog.remove(name)
    compaction.reconcile(store)
    row = store.catalog.read().first()
    assert (row["id"], row["row_count"], row["sealed_at"], row["location"]) == (name, 360, 0, "local")
    store.files.delete(f"{store.root}/segments/{name}")
    compaction.reconcile(store)
    assert store.catalog.read().count() == 0


def test_pruning_is_sound_and_waves_agree(store):
    fill(store, n=6)
    catalog = store.catalog.read().cache()
    r = random.Random(5)
    pruned = 0
    for _ in range(12):
        matchers = tuple(Matcher(*m) for m in r.sample([("service", "web", "="), ("app", "app-3", "="), ("level", "err", "=~"), ("env", "prod", "!="), ("none", "x", "=")], r.randrange(3)))
        start = r.choice((0, 1_700_000_000_100_000_000))
        request = QueryRequest(start, r.choice((0, start + 60_000_000)), matchers, r.choice(("", "GET", "zzz", "latency_ms", "err")), 30)
        paths = [x["local_path"] for x in catalog.collect()]
        kept = prune(catalog, request).count()
        pruned += len(paths) - kept
        want = search.query_paths(store.spark, paths, request).collect()
        assert search.query(store.catalog, request).collect() == want == search.query_waves(store.catalog, request, wave_rows=1).collect()
    assert pruned
    one = QueryRequest(matchers=(Matcher("none", "x"),))
    assert search.sources(store.catalog, one) == []


def test_waves_read_no_source_again_and_again(store, monkeypatch):
    """Flush files whose times interleave, so that every wave has rows that are needed."""
    rows = list(sample_rows(400))
    for i in range(8):
        store.flush(frame(store.spark, payload(rows[i::8])), batch=i)
    request = QueryRequest(limit=40)
    want = search.query(store.catalog, request).collect()
    read, scan = [], search.scan
    monkeypatch.setattr(search, "scan", lambda spark, paths: read.extend(paths) or scan(spark, paths))
    assert search.query_waves(store.catalog, request, wave_rows=1).collect() == want
    assert len(set(read)) == 8 and len(read) <= 16
    read.clear()
    last = QueryRequest(limit=3)  # the newest row is in one file, and the last row that is needed in another
    assert search.query_waves(store.catalog, last, wave_rows=1).collect() == want[:3]
    assert len(set(read)) < 8


@pytest.mark.parametrize("times", [(-9, -7, -5, -3, -1, 0), (-3, 0, 0, 0, 2, 2), (4, 4, 4, 4, 4, 4)])
def test_waves_with_times_about_zero_and_equal_ones(store, times):
    for i in range(3):
        for j in (0, 3):
            store.flush(frame(store.spark, {"streams": [{"stream": {"a": "b"}, "values": [[str(times[i + j]), f"{i} {j}"]]}]}), batch=i + j)
    for limit in range(1, 7):
        for start in (0, -7, -3):
            request = QueryRequest(start=start, limit=limit)
            assert search.query_waves(store.catalog, request, wave_rows=1).collect() == search.query(store.catalog, request).collect()


def test_flush_works_payloads_out_once(store):
    """Unless a value without a readable timestamp may have keys that no row has; a stream without values is rejected with its payload."""
    good = {"stream": {"a": "1", "b": "2"}, "values": [["5", "x"]]}
    for batch, (more, times, keys) in enumerate((([], 1, ["a", "b"]), ([{"stream": {"c": "1"}, "values": [["no", "y"]]}], 2, ["a", "b", "c"]), ([{"stream": {"d": "1"}, "values": []}], 1, []))):
        seen = store.spark.sparkContext.accumulator(0)
        rows = store.spark.sparkContext.parallelize([([good, *more],)], 1).map(lambda r, seen=seen: (seen.add(1), r)[1])
        name = store.flush(store.spark.createDataFrame(rows, PUSH_SCHEMA), batch=batch)
        assert seen.value == times
        assert store.catalog.read().where(F.col("id") == name).first()["label_keys"] == keys
    name = store.flush(store.spark.createDataFrame([([],)], PUSH_SCHEMA), batch=9)
    assert store.catalog.read().where(F.col("id") == name).first()["label_keys"] == []


def test_description_against_brute_force(spark):
    """Short, empty, null, long and non-ASCII lines, null labels and values, interleaved ids: the same as row by row; and no line is exploded into its trigrams."""
    r = random.Random(3)
    lines = [None, "", "a", "AB", "aBc", "é", "日本", "x" * 70_000, *("".join(r.choice("abCDé日 \0") for _ in range(r.randrange(60))) for _ in range(300))]
    labels = [None, {}, {"a": "b"}, {"a": None}, {"é": "", "Z": "\0"}, {"a": "c", "b": "b"}]
    rows = [(i % 7 if i % 11 else None, i, line, labels[i % 6]) for i, line in enumerate(lines * 2)]
    logs = spark.createDataFrame(rows, "id long, timestamp long, line string, labels map<string,string>").coalesce(2)
    want = {}
    for of, _, line, pairs in rows:
        keys, both, grams = want.setdefault(of, (set(), set(), set()))
        data = "".join(c.lower() if "A" <= c <= "Z" else c for c in line or "").encode()
        grams.update(int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2))
        keys.update(pairs or {})
        both.update(f"{k}\0{v}" for k, v in (pairs or {}).items() if v is not None)
    want.pop(None)
    for batch in ("10000", "5"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {x["id"]: (x["label_keys"], x["label_pairs"], x["trigrams"]) for x in describe(logs).where("id is not null").collect()}
        assert got == {k: tuple(map(sorted, v)) for k, v in want.items()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = describe(logs)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert max(i for i, x in enumerate(plan) if "Generate" in x) < min(i for i, x in enumerate(plan) if "MapInArrow" in x)


def test_trigrams_cross_chunks(monkeypatch):
    from sparklode.functions import trigrams as module

    data, offsets = np.frombuffer(b"abcdefgXYZ" * 9, np.uint8), np.array([3, 3, 4, 11, 13, 16, 90])
    want = sorted(int.from_bytes(bytes(data[i : i + 3]).lower(), "big") for a, b in zip(offsets[:-1], offsets[1:], strict=True) for i in range(a, b - 2))
    for chunk in range(1, 12):
        monkeypatch.setattr(module, "CHUNK", chunk)
        assert sorted(np.concatenate(list(module.trigrams(data, offsets))).tolist()) == want


def test_streaming_ingest_and_tail(spark, store, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    rows = list(sample_rows(60))
    for i in range(3):
        (inbox / f"{i}.json").write_text(json.dumps(payload(rows[i * 20 : (i + 1) * 20])) + "\n" + json.dumps({"streams": []}) + "\n")
    for _ in range(2):
        q = ingest(store, payload_stream(store, str(inbox), 1), str(tmp_path / "ckpt"), {"availableNow": True})
        q.awaitTermination()
    assert search.query(store.catalog, QueryRequest(limit=5000)).count() == 60
    request = QueryRequest(matchers=(Matcher("service", "web"),))
    out = tail(log_stream(spark, f"{store.root}/flush"), request).writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    out.awaitTermination()
    want = {(t, line) for t, line, labels in rows if labels.get("service") == "web"}
    assert {(r["timestamp"], r["line"]) for r in spark.sql("select * from tailed").collect()} == want
    late = [(rows[0][0] - 59 * 60 * 10**9, "late", {"service": "web"})]
    store.flush(frame(spark, payload(late)), batch=77)
    q = tail(log_stream(spark, f"{store.root}/flush"), request).writeStream.format("memory").queryName("tailed_late").option("checkpointLocation", str(tmp_path / "late")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert "late" in {r["line"] for r in spark.sql("select line from tailed_late").collect()}
    want |= {(t, line) for t, line, _ in late}
    poller = Poller(lambda r: search.query(store.catalog, r), request)
    first = poller.poll()
    assert [r["timestamp"] for r in first] == sorted(t for t, _ in want) and poller.poll() == []


def test_cli(store):
    fill(store, n=1, size=3)
    out = io.StringIO()
    cli.main(["--root", store.root, "search", "{}", "--limit", "2"], store.spark, out)
    assert len(out.getvalue().splitlines()) == 2 and out.getvalue().startswith("2023-11-14T22:13:20.002Z {")
    assert cli.render([{"timestamp": 5, "line": "x", "labels": {"b": 'q"\n', "a": "é"}}]) == '1970-01-01T00:00:00.000000005Z {a="é", b="q\\"\\n"} x\n'
    assert cli.window(10**18, since=10, until=5) == (10**18 - 10, 10**18 - 5)
    assert cli.window(0, start="1970-01-01T00:00:01.5Z", end="2000000000") == (1_500_000_000, 2_000_000_000)
    with pytest.raises(ValueError, match="after"):
        cli.window(0, start="2", end="1")
    with pytest.raises(ValueError, match="RFC3339"):
        cli.parse_time("yesterday")
    assert cli.parse_duration("1h30m") == 5400 * 10**9


def test_label_sets(store):
    fill(store, n=1)
    sets = search.by_label_set(search.scan(store.spark, [r["local_path"] for r in store.catalog.read().collect()]))
    assert sets.agg(F.sum(F.size("values"))).first()[0] == 40
    many = store.spark.range(1000).select(F.col("id").alias("timestamp"), F.lit("x").alias("line"), F.create_map(F.lit("a"), F.lit("b")).alias("labels"), F.col("id").cast("string").alias("row_id"))
    sizes = [r["n"] for r in search.by_label_set(many).select(F.size("values").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100 and len(sizes) == 10
