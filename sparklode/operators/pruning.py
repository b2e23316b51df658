"""Which segments may hold matches, by catalog columns alone: window, keyword trigrams, label pairs. Never drops a segment that has some."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.trigrams import MOST_TRIGRAMS, items, keyword_trigrams, label_pair
from ..plans.request import QueryRequest

ITEMS = [T.StructField("kind", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("numbers", T.ArrayType(T.IntegerType()))]


def overlapping(catalog: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """Segments whose bounds meet the inclusive window; 0 leaves a side open."""
    if start:
        catalog = catalog.where(F.col("max_timestamp") >= start)
    return catalog.where(F.col("min_timestamp") <= end) if end else catalog


def may_contain(catalog: DataFrame, keyword: str) -> DataFrame:
    """Segments that have all trigrams of the keyword, or none recorded; keywords of under three bytes prune nothing."""
    wanted = keyword_trigrams(keyword)
    if not wanted:
        return catalog
    lacking = F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col("trigrams")))
    return catalog.where(F.col("trigrams").isNull() | (lacking == 0))


def may_match(catalog: DataFrame, request: QueryRequest) -> DataFrame:
    """Segments that have all label pairs asked for by equality, or none recorded."""
    for m in request.matchers:
        if m.type in ("", "="):
            catalog = catalog.where(F.col("label_pairs").isNull() | F.array_contains("label_pairs", label_pair(m.name, m.value)))
    return catalog


def prune(catalog: DataFrame, request: QueryRequest) -> DataFrame:
    return may_match(may_contain(overlapping(catalog, request.start, request.end), request.line), request)


def describe(logs: DataFrame, by: str = "id") -> DataFrame:
    """A row for each value of column ``by``: bounds, row_count, label_keys, label_pairs, trigrams, by grouped aggregation.

    Keys, pairs and trigrams are taken from the rows in one reading, by arrays of bytes, and made distinct in each task and again before they are collected, so what is
    collected for a segment is bounded by its variety and not by its rows: at most 2^24 trigrams, of which more than MOST_TRIGRAMS are left out.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    bounds = logs.groupBy(by).agg(zero(F.min("timestamp")).alias("min_timestamp"), zero(F.max("timestamp")).alias("max_timestamp"), F.count("*").alias("row_count"))
    logs.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))  # workers find this library where the driver does
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    said_of = T.StructType([T.StructField(by, logs.schema[by].dataType), *ITEMS])
    seen = logs.select(by, labels.alias("labels"), F.coalesce("line", F.lit("")).cast("binary").alias("line")).mapInArrow(items, said_of)
    seen = seen.select(by, "kind", "text", F.explode_outer("numbers").alias("number")).distinct()
    part = F.when(F.col("kind") == 2, F.shiftright("number", 12)).otherwise(-1)  # 4096 trigrams at most are collected as single values
    seen = seen.groupBy(by, "kind", part.alias("part")).agg(F.count("*").alias("n"), F.collect_list("text").alias("texts"), F.collect_list("number").alias("numbers"))
    texts = lambda kind: F.array_sort(F.flatten(F.collect_list(F.when(F.col("kind") == kind, F.col("texts")))))
    said = seen.groupBy(by).agg(
        texts(0).alias("label_keys"), texts(1).alias("label_pairs"), zero(F.sum(F.when(F.col("kind") == 2, F.col("n")))).alias("n"),
        F.flatten(F.collect_list(F.when(F.col("kind") == 2, F.col("numbers")))).alias("trigrams"),
    )
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    out = bounds.join(said, by, "left")
    return out.select(
        by, "min_timestamp", "max_timestamp", "row_count", F.coalesce("label_keys", empty("string")).alias("label_keys"), F.coalesce("label_pairs", empty("string")).alias("label_pairs"),
        F.when(zero(F.col("n")) == 0, empty("int")).when(F.col("n") <= MOST_TRIGRAMS, F.array_sort("trigrams")).alias("trigrams"),
    )
