"""A store of logs under a root folder: flush files from ingest, segments from compaction, a catalog of both."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..sources.push import rejection
from ..sources.schema import CATALOG_SCHEMA, LOG_SCHEMA
from .catalog import GRACE, Catalog
from .pruning import describe

WIDTH = 19  # digits of a timestamp in a name
_BOUNDS = re.compile(r"(?:segment|bucket-[^-]*)-(\d+)-(\d+)-[^-]*\Z")
_SUFFIX = re.compile(r"(?:\.[0-9a-f]{8})?(?:\.parquet)?(?:\.partial)?\Z")
LEVELS = {"fastest": 1, "default": 3, "better": 7, "best": 11}  # of zstandard


def segment_name(low: int, high: int, sealed_at: int) -> str:
    return f"segment-{low:0{WIDTH}d}-{high:0{WIDTH}d}-{sealed_at:0{WIDTH}d}"


def flush_name(index: int, low: int, high: int, sequence: int) -> str:
    return f"bucket-{index}-{low:0{WIDTH}d}-{high:0{WIDTH}d}-{sequence:0{WIDTH}d}"


def parse_bounds(name: str) -> tuple[int, int] | None:
    """Bounds in a flush or segment name; None for names without, which have to be opened."""
    m = _BOUNDS.fullmatch(_SUFFIX.sub("", name, count=1))
    return (int(m[1]), int(m[2])) if m else None


def parse_timestamp(text: Column) -> Column:
    """Nanoseconds of a decimal text with an optional sign; null for all else, also where Spark's own cast would trim."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("long"))


def valid_payloads(payloads: DataFrame) -> DataFrame:
    return payloads.where(rejection(F.col("streams")).isNull())


def flatten(payloads: DataFrame, unread: Observation | None = None) -> DataFrame:
    """Rows of payloads; values without a readable timestamp are left out, a missing line is empty. ``unread`` gets n, the number of values left out.

    row_id orders rows of equal timestamp: a digest of the payload, then the positions of stream and value, the
    same however often a task runs.
    """
    digest = F.lpad(F.hex(F.xxhash64(F.to_json(F.struct("streams")))), 16, "0")
    payloads = payloads.select(digest.alias("digest"), "streams")  # below the explode: once for a payload, not for each of its entries
    streams = payloads.select("digest", F.posexplode("streams").alias("i", "entry"))
    values = streams.select("digest", "i", F.col("entry.stream").alias("labels"), F.posexplode("entry.values").alias("j", "value"))
    number = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    rows = values.select(
        parse_timestamp(F.get("value", F.lit(0))).alias("timestamp"), F.coalesce(F.get("value", F.lit(1)), F.lit("")).alias("line"), "labels",
        F.concat_ws("-", "digest", number("i"), number("j")).alias("row_id"),
    )
    rows = rows.observe(unread, F.count_if(F.col("timestamp").isNull()).alias("n")) if unread else rows
    return rows.where("timestamp is not null").select(*LOG_SCHEMA.fieldNames())


class Store:
    """``level`` is the compression of flush files, one of LEVELS; segments always get the best. Files out of use stay for ``grace`` seconds."""

    def __init__(self, spark: SparkSession, root: str, remote_root: str | None = None, level: str = "fastest", grace: float = GRACE):
        self.spark, self.root, self.level = spark, root.rstrip("/"), LEVELS[level]
        self.remote_root = (remote_root or f"{self.root}/remote").rstrip("/")
        self.catalog = Catalog(spark, self.root, grace)
        self.files = self.catalog.files

    def write(self, rows: DataFrame, beside: str, level: int) -> tuple[int, int, int]:
        """Write log rows to ``beside``: their number and bounds (0 without rows), observed while they are written."""
        seen = Observation()
        zero = lambda c: F.coalesce(c, F.lit(0))
        rows = rows.observe(seen, F.count("*").alias("n"), zero(F.min("timestamp")).alias("lo"), zero(F.max("timestamp")).alias("hi"))
        rows.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(beside)
        return seen.get["n"], seen.get["lo"], seen.get["hi"]

    def move(self, beside: str, path: str, rows: int) -> None:
        """Move what was written to its place, and see that all of it is there before anything refers to it."""
        self.files.rename(beside, path)
        if (there := self.spark.read.schema(LOG_SCHEMA).parquet(path).count()) != rows:
            self.files.delete(path)
            raise OSError(f"{there} of {rows} rows are at {path}")

    def flush(self, payloads: DataFrame, batch: int | None = None, index: int = 0) -> str:
        """Write a batch of payloads as one flush file and catalog it; the same batch number replaces what it wrote before.

        The payloads are worked out once; the rows' bounds come with that, keys and filters from one reading of the file. Only if values without a readable
        timestamp were left out, whose streams may have keys that no row has, the payloads are worked out again. Every attempt has a
        path of its own, so what an earlier attempt wrote stays readable until it is out of use.
        """
        batch = time.time_ns() if batch is None else batch
        prefix = f"bucket-{index}-"
        again = self.catalog.read().where(F.col("id").startswith(prefix) & F.col("id").endswith(f"-{batch:0{WIDTH}d}")).select("id", "local_path").collect()
        payloads = valid_payloads(payloads)
        attempt = uuid.uuid4().hex[:8]
        unread = Observation()
        n, low, high = self.write(flatten(payloads, unread), beside := f"{self.root}/flush/.partial-{index}-{batch}-{attempt}", self.level)
        keys = F.coalesce("label_keys", F.array().cast("array<string>"))
        if unread.get["n"]:  # keys of accepted streams, which all have values, are kept even if none of these has a readable timestamp
            found = payloads.select(F.explode("streams").alias("s")).select(F.explode(F.map_keys("s.stream")).alias("key")).distinct()
            keys = F.array(*(F.lit(k) for k in sorted(r["key"] for r in found.collect()))).cast("array<string>")  # bounded by the variety of keys
        name = flush_name(index, low, high, batch)
        self.move(beside, path := f"{self.root}/flush/{name}.{attempt}", n)
        described = describe(self.spark.read.schema(LOG_SCHEMA).parquet(path).withColumn("id", F.lit(name)))
        one = self.spark.createDataFrame([(name,)], "id string").join(described, "id", "left")
        added = catalog_rows(one, "flush", F.lit(path), F.lit(0)).withColumn("label_keys", keys)
        self.catalog.change(add=added, remove=[r["id"] for r in again if r["id"] != name], trash=[r["local_path"] for r in again], ids=[name])
        return name


def catalog_rows(described: DataFrame, kind: str, path: Column, sealed_at: Column) -> DataFrame:
    """Catalog rows of local files from what ``describe`` says; nothing said counts as empty."""
    zero = {k: F.coalesce(k, F.lit(0)).cast("long") for k in ("min_timestamp", "max_timestamp", "row_count")}
    rest = {
        "kind": F.lit(kind), "location": F.lit("local"), "local_path": path, "remote_url": F.lit(None).cast("string"),
        "sealed_at": sealed_at.cast("long"), "uploaded_at": F.lit(0).cast("long"),
    }
    return described.withColumns(zero | rest).select(*CATALOG_SCHEMA.fieldNames())
