"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and is then timed; the value is the sum over the log engine's queries. ``ingest`` pushes sample rows through
validation, flattening and the flush writer; its rate is in ``ingest_lines_per_s``. ``search_pruned`` and ``search_unpruned`` read the same
store with and without skipping segments.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = ["topk_newest", "window_closed", "label_eq", "label_re", "keyword", "keyword_documents", "selector_full", "search_pages", "labels_keys", "stats", "prune_trigram", "ingest_flatten", "tail_dedupe", "label_sets"]


def timed(f) -> float:
    start = time.perf_counter()
    f()
    return round(time.perf_counter() - start, 4)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession, functions as F

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sparklode.operators import compaction, search
    from sparklode.operators.store import Store
    from sparklode.plans.registry import QUERIES
    from sparklode.plans.request import Matcher, QueryRequest
    from sparklode.sources import views
    from sparklode.sources.schema import PUSH_SCHEMA

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    queries = {}
    for name in HEADLINE:
        noop(QUERIES[name](spark, sf_dir))
        queries[name] = timed(lambda name=name: noop(QUERIES[name](spark, sf_dir)))

    folder = tempfile.mkdtemp(prefix="bench")
    try:
        store = Store(spark, f"{folder}/store")
        logs = views.events_log(spark, sf_dir)
        entry = F.struct(F.create_map(F.lit("event_type"), F.col("labels")["event_type"]).alias("stream"), F.array(F.array(F.col("timestamp").cast("string"), "line")).alias("values"))
        payloads = logs.withColumn("bucket", F.expr("event_id div 12500")).groupBy("bucket").agg(F.collect_list(entry).alias("streams")).select("bucket", F.col("streams").cast(PUSH_SCHEMA["streams"].dataType)).cache()
        n, flushes = logs.count(), range(-(-payloads.count() // 4))
        payloads = payloads.repartition(int(cpus)).cache()
        payloads.count()
        queries["ingest"] = timed(lambda: [store.flush(payloads.where(F.floor(F.col("bucket") / 4) == b).select("streams"), batch=b) for b in flushes])
        if len(flushes) < 2:
            store.flush(payloads.where("false").select("streams"), batch=len(flushes))
        queries["compaction"] = timed(lambda: compaction.compact(store, min_files=2))
        request = QueryRequest(matchers=(Matcher("event_type", "error"),), line="user=4", end=logs.agg(F.min("timestamp")).first()[0] + 10**12)
        paths = [r["local_path"] for r in store.catalog.read().collect()]
        for name, run in (("search_pruned", lambda: search.query(store.catalog, request)), ("search_unpruned", lambda: search.query_paths(spark, paths, request))):
            noop(run())
            queries[name] = timed(lambda run=run: noop(run()))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "log engine queries, total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "ingest_lines_per_s": round(n / queries["ingest"]), "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
