"""Query registry of the log engine: name -> (spark, sf_dir) -> DataFrame, and the DuckDB statement for each."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.trigrams import keyword_trigrams
from ..operators import compaction, pruning, search, tiering
from ..operators.catalog import stats
from ..operators.search import by_label_set, label_keys, merge, newest, query_frame, select
from ..operators.store import Store, flatten
from ..sources import views
from ..sources.schema import PUSH_SCHEMA
from ..streaming.tail import distinct_lines, log_stream, tail
from .request import Matcher, QueryRequest
from .selector import parse_selector

SEGMENT_ROWS = 2500
START, END = 1_704_300_000_000_000_000, 1_704_700_000_000_000_000  # a window inside the events

_ns = "epoch_us(ts) * 1000"
_line = "event_type || ' user=' || user_id || ' ' || props"
_shard = "CAST(user_id % 4 AS VARCHAR)"
EVENTS = f"(SELECT event_id, {_ns} AS timestamp, {_line} AS line, event_type, {_shard} AS shard FROM events)"
MISSING = f"(SELECT event_id, {_ns} AS timestamp, {_line} AS line, event_type, CASE WHEN event_id % 3 <> 0 THEN {_shard} END AS shard FROM events)"
DOCUMENTS = "(SELECT doc_id, 1700000000000000000 + doc_id * 1000000 AS timestamp, text AS line, lang, source FROM documents)"
CONVERSATIONS = "(SELECT conv_id, turn, 1700000000000000000 + conv_id * 1000000 + turn AS timestamp, text AS line, role FROM conversations)"
PAGES = "(SELECT page_id, 1700000000000000000 + page_id * 1000000 AS timestamp, html AS line, nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') AS host FROM pages)"
LOWER = f"translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(name: str, request: QueryRequest, where: str = "TRUE", limit: int = 100, missing: bool = False) -> None:
    """A search over the event log."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = query_frame(views.events_log(spark, sf_dir, missing), request)
        return found.select("timestamp", "line", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["shard"].alias("shard"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT timestamp, line, event_type, shard FROM {MISSING if missing else EVENTS} WHERE {where} ORDER BY timestamp DESC, event_id DESC LIMIT {limit}"


def _m(*matchers: tuple[str, str, str], **more) -> QueryRequest:
    return QueryRequest(matchers=tuple(Matcher(*m) for m in matchers), **more)


_register("topk_newest", QueryRequest())
_register("limit_reset_over_cap", QueryRequest(limit=5001))
_register("limit_negative", QueryRequest(limit=-1))
_register("limit_explicit", QueryRequest(limit=7), limit=7)
_register("limit_largest", QueryRequest(limit=5000), limit=5000)
_register("window_closed", QueryRequest(start=START, end=END), f"timestamp BETWEEN {START} AND {END}")
_register("window_start_only", QueryRequest(start=START), f"timestamp >= {START}")
_register("window_end_only", QueryRequest(end=END), f"timestamp <= {END}")
_register("window_reversed", QueryRequest(start=END, end=START), f"timestamp >= {END} AND timestamp <= {START}")
_register("label_eq", _m(("event_type", "error", "=")), "event_type = 'error'")
_register("label_empty_type", _m(("event_type", "error", "")), "event_type = 'error'")
_register("label_neq", _m(("event_type", "error", "!=")), "event_type IS DISTINCT FROM 'error'")
_register("label_eq_missing", _m(("shard", "", "=")), "shard = ''", missing=True)
_register("label_neq_missing", _m(("shard", "1", "!=")), "shard IS DISTINCT FROM '1'", missing=True)
_register("label_re", _m(("event_type", "err|cli", "=~")), "regexp_matches(coalesce(event_type, ''), 'err|cli')")
_register("label_nre", _m(("event_type", "^c.*k$", "!~")), "NOT regexp_matches(coalesce(event_type, ''), '^c.*k$')")
_register("label_re_missing", _m(("shard", ".*", "=~")), "regexp_matches(coalesce(shard, ''), '.*')", missing=True)
_register("label_nre_missing", _m(("shard", "[12]", "!~")), "NOT regexp_matches(coalesce(shard, ''), '[12]')", missing=True)
_register("label_unknown_name", _m(("nowhere", "x", "!=")))
_register("label_unknown_type", _m(("event_type", "error", "~~")))
_register("keyword", QueryRequest(line="user=8 "), f"contains({LOWER}, 'user=8 ')")
_register("keyword_short", QueryRequest(line="8"), f"contains({LOWER}, '8')")
_register("keyword_wildcards", QueryRequest(line="user=_%"), f"contains({LOWER}, 'user=_%')")

_matchers, _keyword = parse_selector('{event_type="error", shard=~"[0-2]", shard!="1", event_type!~"^view$"} |= "K\\": 6"')
_register("selector_full", QueryRequest(matchers=_matchers, line=_keyword, start=0, limit=500), f"event_type = 'error' AND regexp_matches(coalesce(shard, ''), '[0-2]') AND shard IS DISTINCT FROM '1' AND NOT regexp_matches(event_type, '^view$') AND contains({LOWER}, 'k\": 6')", limit=500)


def _query(name: str, oracle: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = oracle
        return f

    return add


def _documents(request: QueryRequest):
    return lambda spark, sf_dir: query_frame(views.documents_log(spark, sf_dir), request).select("timestamp", "line", F.col("labels")["lang"].alias("lang"))


for _name, _word, _extra in (("keyword_case", "THE", ""), ("keyword_unicode_case", "É", ""), ("keyword_documents", "data", "")):
    _query(_name, f"SELECT timestamp, line, lang FROM {DOCUMENTS} WHERE contains({LOWER}, '{_word if _word == 'É' else _word.lower()}') ORDER BY timestamp DESC, doc_id DESC LIMIT 100")(_documents(QueryRequest(line=_word)))


@_query("search_conversations", f"SELECT timestamp, line, role FROM {CONVERSATIONS} WHERE role = 'user' AND contains({LOWER}, 'th') ORDER BY timestamp DESC, conv_id DESC, turn DESC LIMIT 50")
def _search_conversations(spark, sf_dir):
    found = query_frame(views.conversations_log(spark, sf_dir), _m(("role", "user", "="), line="th", limit=50))
    return found.select("timestamp", "line", F.col("labels")["role"].alias("role"))


@_query("search_pages", f"SELECT timestamp, line, host FROM {PAGES} WHERE host IS DISTINCT FROM 'm.example.net' AND NOT regexp_matches(coalesce(host, ''), '\\.org$') ORDER BY timestamp DESC, page_id DESC LIMIT 100")
def _search_pages(spark, sf_dir):
    found = query_frame(views.pages_log(spark, sf_dir), _m(("host", "m.example.net", "!="), ("host", r"\.org$", "!~")))
    return found.select("timestamp", "line", F.col("labels")["host"].alias("host"))


@_query("labels_keys", f"SELECT 'event_type' AS key FROM {MISSING} WHERE event_type IS NOT NULL GROUP BY 1 UNION SELECT 'shard' FROM {MISSING} WHERE shard IS NOT NULL GROUP BY 1 ORDER BY key")
def _labels_keys(spark, sf_dir):
    return label_keys(views.events_log(spark, sf_dir, missing=True))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log, dealt to segments of SEGMENT_ROWS ids each."""
    return views.events_log(spark, sf_dir, missing=True).withColumn("id", F.expr(f"event_id div {SEGMENT_ROWS}"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of these segments; those of even number are remote."""
    return pruning.describe(segmented(spark, sf_dir)).withColumn("location", F.when(F.col("id") % 2 == 0, "remote").otherwise("local"))


_SEGMENTS = f"(SELECT event_id // {SEGMENT_ROWS} AS id, min(timestamp) AS lo, max(timestamp) AS hi, count(*) AS n, count(shard) AS with_shard FROM {MISSING} GROUP BY 1)"


@_query("segment_catalog", f"SELECT id, lo AS min_timestamp, hi AS max_timestamp, n AS row_count, CASE WHEN with_shard > 0 THEN 'event_type,shard' ELSE 'event_type' END AS label_keys FROM {_SEGMENTS}")
def _segment_catalog(spark, sf_dir):
    return catalog(spark, sf_dir).select("id", "min_timestamp", "max_timestamp", "row_count", F.array_join("label_keys", ",").alias("label_keys"))


@_query("stats", f"SELECT count(*) AS segments_total, count(*) FILTER (id % 2 = 1) AS segments_local, count(*) FILTER (id % 2 = 0) AS segments_remote, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_total, coalesce(min(lo), 0) AS min_timestamp, greatest(coalesce(max(hi), 0), 0) AS max_timestamp FROM {_SEGMENTS}")
def _stats(spark, sf_dir):
    return stats(catalog(spark, sf_dir))


@_query("prune_time", f"SELECT id FROM {_SEGMENTS} WHERE hi >= {START} AND lo <= {END}")
def _prune_time(spark, sf_dir):
    return pruning.overlapping(catalog(spark, sf_dir), START, END).select("id")


@_query("prune_label", f"SELECT DISTINCT event_id // {SEGMENT_ROWS} AS id FROM {MISSING} WHERE shard = '3'")
def _prune_label(spark, sf_dir):
    return pruning.may_match(catalog(spark, sf_dir), _m(("shard", "3", "="), ("event_type", "error", "!="))).select("id")


_KEYWORD = "user=77"
_GRAMS = sorted({_KEYWORD[i : i + 3] for i in range(len(_KEYWORD) - 2)})


@_query("prune_trigram", " INTERSECT ".join(f"SELECT DISTINCT event_id // {SEGMENT_ROWS} AS id FROM {EVENTS} WHERE contains({LOWER}, '{g}')" for g in _GRAMS))
def _prune_trigram(spark, sf_dir):
    return pruning.may_contain(catalog(spark, sf_dir), _KEYWORD).select("id")


@_query("segment_trigrams", f"SELECT event_id // {SEGMENT_ROWS} AS id, count(DISTINCT g) AS trigrams FROM (SELECT event_id, unnest(list_transform(generate_series(1, length(l) - 2), lambda i: substring(l, CAST(i AS INTEGER), 3))) AS g FROM (SELECT event_id, {LOWER} AS l FROM {EVENTS})) GROUP BY 1")
def _segment_trigrams(spark, sf_dir):
    return catalog(spark, sf_dir).select("id", F.size("trigrams").cast("long").alias("trigrams"))


@_query("hot_cold_merge", f"SELECT timestamp, line FROM {EVENTS} WHERE event_type = 'view' ORDER BY timestamp DESC, event_id DESC LIMIT 200")
def _hot_cold_merge(spark, sf_dir):
    request = _m(("event_type", "view", "="), limit=200)
    logs = views.events_log(spark, sf_dir)
    cold = F.col("timestamp") < START
    return merge(query_frame(logs.where(~cold), request), query_frame(logs.where(cold), request), request.effective_limit).select("timestamp", "line")


@_query("ingest_flatten", f"SELECT timestamp, line, event_type FROM {EVENTS} WHERE event_id % 7 <> 0")
def _ingest_flatten(spark, sf_dir):
    """Events as push payloads, every seventh with a timestamp that can't be read; through validation and flattening."""
    t = views.events_log(spark, sf_dir)
    stamp = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit(" "), F.col("timestamp").cast("string"))).otherwise(F.col("timestamp").cast("string"))
    values = F.collect_list(F.array(stamp, F.col("line")))
    streams = t.groupBy(F.col("labels")["event_type"].alias("event_type"), (F.col("event_id") % 50).alias("batch")).agg(values.alias("values"))
    entry = F.struct(F.create_map(F.lit("event_type"), F.col("event_type")).alias("stream"), F.col("values"))
    payloads = streams.groupBy("batch").agg(F.collect_list(entry).alias("streams")).select(F.col("streams").cast(PUSH_SCHEMA["streams"].dataType))
    return flatten(payloads).select("timestamp", "line", F.col("labels")["event_type"].alias("event_type"))


@_query("compaction_conserves", f"SELECT event_id // {SEGMENT_ROWS} AS id, count(*) AS n, CAST(sum(timestamp // 1000) AS BIGINT) AS total, CAST(sum(length(line)) AS BIGINT) AS characters FROM {EVENTS} GROUP BY 1")
def _compaction_conserves(spark, sf_dir):
    """What segments hold after their rows have been dealt by time and sorted within."""
    sorted_rows = segmented(spark, sf_dir).repartitionByRange(4, "timestamp").sortWithinPartitions("timestamp", "row_id")
    return sorted_rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.expr("timestamp div 1000")).alias("total"), F.sum(F.length("line")).alias("characters"))


@_query("tail_dedupe", f"SELECT DISTINCT timestamp, line FROM {CONVERSATIONS} WHERE role = 'assistant'")
def _tail_dedupe(spark, sf_dir):
    logs = select(views.conversations_log(spark, sf_dir), _m(("role", "assistant", "=")))
    return distinct_lines(logs.unionByName(logs.withColumn("labels", F.create_map(F.lit("role"), F.lit("again")))))


@_query("label_sets", f"SELECT event_type, shard, count(*) AS n, min(timestamp) AS first_timestamp FROM {MISSING} GROUP BY 1, 2")
def _label_sets(spark, sf_dir):
    """Values grouped by label set, as clients send them."""
    sets = by_label_set(views.events_log(spark, sf_dir, missing=True))
    sets = sets.groupBy("labels").agg(F.sum(F.size("values")).alias("n"), F.min(F.get("values", F.lit(0))["timestamp"]).alias("first_timestamp")).withColumn("m", F.map_from_entries("labels"))
    return sets.select(F.col("m")["event_type"].alias("event_type"), F.col("m")["shard"].alias("shard"), "n", "first_timestamp")


@_query("explicit_sources", f"SELECT timestamp, line FROM (SELECT timestamp, line, lpad(CAST(event_id AS VARCHAR), 19, '0') AS r FROM {EVENTS} UNION ALL SELECT timestamp, line, lpad(CAST(doc_id AS VARCHAR), 19, '0') FROM {DOCUMENTS}) ORDER BY timestamp DESC, r DESC LIMIT 300")
def _explicit_sources(spark, sf_dir):
    columns = ["timestamp", "line", "row_id"]
    both = views.events_log(spark, sf_dir).select(*columns).unionByName(views.documents_log(spark, sf_dir).select(*columns))
    return newest(both, 300).select("timestamp", "line")


def lifecycle(spark: SparkSession, batches: int = 8, missing: bool = False):
    """A store below a new folder of the shared ones, and a function that flushes the event log into it as that many batches of payloads."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="store")
    root = f"{folder.rstrip('/')}/store-{uuid.uuid4().hex}"
    store = Store(spark, root, f"{root}-cold")

    def flush(sf_dir: str) -> None:
        logs = views.events_log(spark, sf_dir, missing)
        values = F.array(F.array(F.col("timestamp").cast("string"), F.col("line")))
        entry = F.struct(F.col("labels").alias("stream"), values.alias("values"))
        chunk = (F.col("event_id") / 100).cast("long")  # a payload is what a client sends at once
        payloads = logs.groupBy(chunk.alias("chunk")).agg(F.collect_list(entry).alias("streams"))
        payloads = payloads.select("chunk", F.col("streams").cast(PUSH_SCHEMA["streams"].dataType))
        for b in range(batches):
            store.flush(payloads.where(F.col("chunk") % batches == b).select("streams"), batch=b)

    return store, flush


def _shown(found: DataFrame) -> DataFrame:
    return found.select("timestamp", "line", F.col("labels")["event_type"].alias("event_type"))


_MATCH = _m(("event_type", "error", "="), line="user=", limit=3000)
_MATCHED = f"SELECT timestamp, line, event_type FROM {EVENTS} WHERE event_type = 'error' AND contains({LOWER}, 'user=') ORDER BY timestamp DESC, event_id DESC LIMIT 3000"


@_query("store_flush_query", _MATCHED)
def _store_flush_query(spark, sf_dir):
    """Payloads -> validation -> flush files -> catalog -> pruned search."""
    store, flush = lifecycle(spark)
    flush(sf_dir)
    return _shown(search.query(store.catalog, _MATCH))


@_query("store_compact_waves", _MATCHED)
def _store_compact_waves(spark, sf_dir):
    """Half of the flush files compacted into a segment, then searched newest first beside the others."""
    store, flush = lifecycle(spark)
    flush(sf_dir)
    compaction.compact(store, 2, 4)
    return _shown(search.query_waves(store.catalog, _MATCH, wave_rows=2000))


@_query("store_tiered_plan", _MATCHED)
def _store_tiered_plan(spark, sf_dir):
    """Segments moved to the remote root and swept, flush files that stay hot, then the plan of both and its merge."""
    store, flush = lifecycle(spark)
    flush(sf_dir)
    compaction.compact(store, 2, 4)
    tiering.rotate(store, age=0)
    tiering.sweep(store, grace=0)
    found = search.plan(store.catalog, _MATCH)
    return _shown(search.search_plan(spark, found, _MATCH))


@_query("store_catalog_rows", f"SELECT count(*) AS row_count, min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp, 'event_type,shard' AS label_keys FROM {EVENTS}")
def _store_catalog_rows(spark, sf_dir):
    """What the catalog says of a segment made of all flush files, after it was lost and made again from the disk."""
    store, flush = lifecycle(spark, missing=True)
    flush(sf_dir)
    store.catalog.remove(compaction.compact(store, 2, 8))
    compaction.reconcile(store)
    return store.catalog.read(False).select("row_count", "min_timestamp", "max_timestamp", F.array_join("label_keys", ",").alias("label_keys"))


@_query("store_rebuilt_from_remote", _MATCHED)
def _store_rebuilt_from_remote(spark, sf_dir):
    """An empty catalog filled from a listing of the remote root, and searched."""
    store, flush = lifecycle(spark)
    flush(sf_dir)
    name = compaction.compact(store, 2, 8)
    tiering.rotate(store, age=0)
    store.catalog.remove(name)
    tiering.reconcile_remote(store)
    return _shown(search.query(store.catalog, _MATCH))


@_query("store_tail", f"SELECT DISTINCT timestamp, line FROM {EVENTS} WHERE event_type = 'error'")
def _store_tail(spark, sf_dir):
    """What a live tail shows of flush files."""
    store, flush = lifecycle(spark, 2)
    flush(sf_dir)
    logs = tail(log_stream(spark, f"{store.root}/flush"), _m(("event_type", "error", "="))).select("timestamp", "line")
    at = f"{store.root}-tail"
    logs.writeStream.format("parquet").option("path", at).option("checkpointLocation", f"{at}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("timestamp long, line string").parquet(at)


assert keyword_trigrams(_KEYWORD) == sorted(int.from_bytes(g.encode(), "big") for g in _GRAMS)
