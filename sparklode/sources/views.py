"""Log views over other tables: timestamp (ns), line, labels, row_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EPOCH = 1_700_000_000_000_000_000


def _labels(**columns: Column) -> Column:
    """A map of labels that leaves out those that are null."""
    pairs = [p for k, c in columns.items() for p in (F.lit(k), c)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def row_id(*numbers: Column | str) -> Column:
    return F.concat(*(F.lpad((F.col(n) if isinstance(n, str) else n).cast("string"), 19, "0") for n in numbers))


def events_log(spark: SparkSession, sf_dir: str, missing: bool = False) -> DataFrame:
    """Lines of events, labelled by type and shard; with ``missing`` every third event lacks its shard."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    shard = (F.col("user_id") % 4).cast("string")
    return t.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp"),
        F.concat("event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" "), F.col("props")).alias("line"),
        _labels(event_type=F.col("event_type"), shard=F.when(F.col("event_id") % 3 != 0, shard) if missing else shard).alias("labels"),
        row_id("event_id").alias("row_id"), "event_id",
    )


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return t.select((F.lit(EPOCH) + F.col("doc_id") * 1_000_000).alias("timestamp"), F.col("text").alias("line"), _labels(lang=F.col("lang"), source=F.col("source")).alias("labels"), row_id("doc_id").alias("row_id"), "doc_id")


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select((F.lit(EPOCH) + F.col("conv_id") * 1_000_000 + F.col("turn")).alias("timestamp"), F.col("text").alias("line"), _labels(role=F.col("role")).alias("labels"), row_id("conv_id", "turn").alias("row_id"), "conv_id", "turn")


def pages_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, labelled by host; a page whose url has none lacks the label."""
    t = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return t.select((F.lit(EPOCH) + F.col("page_id") * 1_000_000).alias("timestamp"), F.col("html").alias("line"), _labels(host=F.when(host != "", host)).alias("labels"), row_id("page_id").alias("row_id"), "page_id")
