"""Search: the newest rows that meet a request, from a DataFrame, from paths, or from the segments of a store."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.predicates import condition
from ..plans.request import QueryRequest
from ..sources.files import Files
from ..sources.schema import LOG_SCHEMA
from .catalog import Catalog
from .pruning import prune


def select(logs: DataFrame, request: QueryRequest) -> DataFrame:
    """Rows of ``logs`` that meet the request. Filters come before the limit, patterns included, so the answer doesn't depend on files."""
    return logs.where(condition(logs.sparkSession, request))


def newest(logs: DataFrame, limit: int) -> DataFrame:
    return logs.orderBy(F.desc("timestamp"), F.desc("row_id")).limit(limit)


def query_frame(logs: DataFrame, request: QueryRequest) -> DataFrame:
    """timestamp, line, labels (and row_id) of the newest matching rows."""
    return newest(select(logs, request), request.effective_limit)


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of the given flush files or segments; none for no paths. A file that has gone meanwhile is an error, and never rows less."""
    return spark.read.schema(LOG_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], LOG_SCHEMA)


def query_paths(spark: SparkSession, paths: list[str], request: QueryRequest) -> DataFrame:
    """Explicit sources: neither catalog nor pruning."""
    return query_frame(scan(spark, paths), request)


def sources(catalog: Catalog, request: QueryRequest) -> list:
    """Catalog rows that may hold matches, newest first, each with the path to read, the local copy where there is one: (row, path)."""
    kept = prune(catalog.read(), request)
    if request.local_only:
        kept = kept.where("location = 'local'")
    rows = kept.select("id", "location", "local_path", "remote_url", "min_timestamp", "max_timestamp", "row_count").orderBy(F.desc("max_timestamp"), "id").collect()
    there = Files(catalog.spark).present(r["local_path"] for r in rows)
    return [(r, path) for r in rows if (path := r["local_path"] if r["local_path"] in there else r["remote_url"])]


def query(catalog: Catalog, request: QueryRequest) -> DataFrame:
    condition(catalog.spark, request)  # an invalid pattern fails before anything is listed
    return query_paths(catalog.spark, [path for _, path in sources(catalog, request)], request)


def rows_and_errors(catalog: Catalog, request: QueryRequest) -> tuple[list, list[str]]:
    """The newest matching rows of all sources that can be read, and what is wrong with the others. One bad source costs only its own rows."""
    condition(catalog.spark, request)
    found, errors = sources(catalog, request), []
    paths = [path for _, path in found]
    try:
        return query_paths(catalog.spark, paths, request).collect(), errors  # MAX_LIMIT rows at most
    except Exception:  # noqa: BLE001  which source it was is found by trying each
        rows = []
        for path in paths:
            try:
                rows += query_paths(catalog.spark, [path], request).collect()
            except Exception as error:  # noqa: BLE001
                errors.append(f"{path}: {str(error).splitlines()[0]}")
        return sorted(rows, key=lambda r: (r["timestamp"], r["row_id"]), reverse=True)[: request.effective_limit], errors


def query_waves(catalog: Catalog, request: QueryRequest, wave_rows: int = 50_000_000) -> DataFrame:
    """As ``query``, but the newest segments first, and no more once all others are older than the last row that is needed.

    A wave reads its own segments only, and of them the times of the newest matching rows. The rows themselves are read once, in the end, from
    where the last row that is needed lies, so no segment is read more than twice however many waves there are.
    """
    spark, limit = catalog.spark, request.effective_limit
    condition(spark, request)
    rest, taken, times = sources(catalog, request), [], []
    while rest:
        wave, size = [], 0
        while rest and (not size or size + (rest[0][0]["row_count"] or 0) <= wave_rows):
            row, path = rest.pop(0)
            size += max(1, row["row_count"] or 0)
            wave.append(path)
        taken += wave
        if not rest:
            break
        found = select(scan(spark, wave), request).select("timestamp").orderBy(F.desc("timestamp")).limit(limit)
        times = sorted([*times, *(r["timestamp"] for r in found.collect())], reverse=True)[:limit]  # limit of each wave at most
        if len(times) == limit:
            request = replace(request, start=times[-1] or request.start)  # so many rows are as new as that
            rest = [(row, path) for row, path in rest if row["max_timestamp"] >= times[-1]]
        wave_rows *= 4
    return query_paths(spark, taken, request)


@dataclass
class Plan:
    """What is hot has been searched; cold paths are for the caller to search and merge."""

    hot: DataFrame
    cold_paths: list[str]
    cold_ids: list[str]
    limit: int
    warnings: list[str] = field(default_factory=list)


def plan(catalog: Catalog, request: QueryRequest) -> Plan:
    """Hot and cold parts from one reading of the catalog; a segment is in exactly one of them."""
    spark = catalog.spark
    condition(spark, request)
    rows = prune(catalog.read(), request).select("id", "location", "local_path", "remote_url").orderBy(F.desc("max_timestamp"), "id").collect()
    there = Files(spark).present(p for r in rows for p in (r["local_path"], r["remote_url"]))
    hot = [r["local_path"] for r in rows if r["location"] == "local" and r["local_path"] in there]
    cold = [r for r in rows if r["location"] == "remote"]
    lost = [f"{r['id']}: {r['remote_url']} can't be found" for r in cold if r["remote_url"] not in there]
    cold = [r for r in cold if r["remote_url"] in there]
    return Plan(query_paths(spark, hot, request), [r["remote_url"] for r in cold], [r["id"] for r in cold], request.effective_limit, lost)


def merge(hot: DataFrame, cold: DataFrame, limit: int) -> DataFrame:
    return newest(hot.unionByName(cold), limit)


def search_plan(spark: SparkSession, found: Plan, request: QueryRequest) -> DataFrame:
    """The plan carried out: the same rows as the full query."""
    return merge(found.hot, query_paths(spark, found.cold_paths, request), found.limit)


def label_keys(logs: DataFrame) -> DataFrame:
    """key: all label keys of ``logs``, sorted."""
    return logs.select(F.explode(F.map_keys("labels")).alias("key")).distinct().orderBy("key")


def by_label_set(logs: DataFrame, batch: int = 100) -> DataFrame:
    """Rows as clients push them: labels as sorted entries, and at most ``batch`` (timestamp, line) values, oldest first; as many rows as a label set needs.

    A label set of many rows is dealt to parts of about 100 batches, so none has to fit into one task.
    """
    rows = logs.select(F.array_sort(F.map_entries("labels")).alias("labels"), "timestamp", "line", "row_id")
    sizes = rows.groupBy("labels").agg(F.ceil(F.count("*") / (100 * batch)).alias("parts"))
    rows = rows.join(sizes, "labels").withColumn("part", F.pmod(F.xxhash64("row_id", "timestamp"), F.col("parts")))
    order = Window.partitionBy("labels", "part").orderBy("timestamp", "row_id")
    rows = rows.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / batch))
    return rows.groupBy("labels", "part", "chunk").agg(F.array_sort(F.collect_list(F.struct("timestamp", "line"))).alias("values")).drop("part", "chunk")
