"""Connected components of links between ids: in one task up to LOCAL links, else by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import cut

LOCAL = 500_000  # links that one task takes: 8 MB


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in the links and the smallest id of the component of each, by hooking roots to smaller ones and pointer jumping."""
    ids, place = np.unique(np.r_[a, b], return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    parent = np.arange(len(ids))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return ids, ids[parent]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (further := parent[parent] != parent).any():
            parent[further] = parent[parent[further]]


def _within(batches):
    pairs = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if pairs:
        found = smallest(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["id", "component"])


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """id, component (its smallest id) for every id in ``links`` (a, b); ids without links have no row.

    The star steps are grouped minima joined back to the edges; nothing of the graph is collected. The number of edges never
    grows, and each round is cut, so a lost executor costs a round at most.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.limit(LOCAL + 1).count() <= LOCAL:
        return cut(edges.repartitionById(1, F.lit(0)).mapInArrow(_within, "id long, component long"))
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit((1 << 40) - 1))).alias("g")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components: edges still changed after {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
