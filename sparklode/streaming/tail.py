"""Live tail: new matching rows as they are flushed, each timestamp and line once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.predicates import condition
from ..plans.request import QueryRequest
from ..sources.schema import LOG_SCHEMA

OVERLAP = 5_000_000  # nanoseconds that a poll goes back behind the last row seen
POLL_LIMIT = 500


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of flush files below ``folder`` as they appear."""
    return spark.readStream.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(folder)


def tail(logs: DataFrame, request: QueryRequest, delay: str = "10 minutes") -> DataFrame:
    """The rows of a stream that meet the request; of equal (timestamp, line), whatever their labels, the first of those that arrive within ``delay``.

    The watermark is on the time of arrival, so a row is shown however old its own timestamp is, and the state stays bounded.
    """
    found = logs.where(condition(logs.sparkSession, request)).withColumn("arrived", F.current_timestamp())
    return found.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["timestamp", "line"]).drop("arrived")


def distinct_lines(logs: DataFrame) -> DataFrame:
    """What a tail shows of a finite set of rows."""
    return logs.select("timestamp", "line").distinct()


class Poller:
    """Tail by repeated queries: each starts a little before the last row seen and returns what is new, oldest first."""

    def __init__(self, search, request: QueryRequest):
        self.search, self.request, self.last, self.seen = search, request, request.start, set()

    def poll(self) -> list:
        start = max(self.request.start, self.last - OVERLAP) if self.last else self.request.start
        request = QueryRequest(start, self.request.end, self.request.matchers, self.request.line, POLL_LIMIT)
        rows = [r for r in self.search(request).collect()[::-1] if (r["timestamp"], r["line"]) not in self.seen]  # POLL_LIMIT rows at most
        fresh = list({(r["timestamp"], r["line"]): r for r in reversed(rows)}.values())[::-1]
        if rows:
            self.last = max(self.last, max(r["timestamp"] for r in rows))
        self.seen = {k for k in self.seen if k[0] >= self.last - OVERLAP} | {(r["timestamp"], r["line"]) for r in fresh}
        return fresh
