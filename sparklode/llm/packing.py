"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenised once, in Arrow batches. What decides the packing is only how many pieces there are of
each length: at most ``capacity`` numbers, whatever the corpus. From this histogram the driver works out bin
patterns (greedy decreasing fill, then the best-two-fit exchange), each with the number of bins that follow it. Pieces are then
numbered within their length by per-partition counts and prefix sums, and number and length give sequence and offset by a
join with the pattern table, whose size depends on ``capacity`` alone.

Defined results: a null text counts as empty (one end token); an empty table gives an empty result; repeated rows
and repeated ids are packed as often as they occur; other columns are ignored; a null doc_id is carried as null; a special token's
string in a text is that token, as the tokenizers file has it.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ._common import cut, prepare

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"

_ENCODERS: dict[tuple[str, str], object] = {}


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """Paths of the vocabulary: the tokenizers file that defines the ids, and the same as ranks for a faster library."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def encoder(paths: tuple[str, str]):
    """From text to ids: the byte-level BPE at ``paths``, its added tokens found in the text first. Kept once for each worker."""
    if paths not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(paths[0], encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        with open(paths[1], "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[paths] = tiktoken.Encoding(paths[1], pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    encoding, special = _ENCODERS[paths], _ENCODERS[paths].special_tokens_set
    return lambda text: encoding.encode(text, allowed_special=special, disallowed_special=()) if any(s in text for s in special) else encoding.encode_ordinary(text)


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids: full ones, but for the first, which takes what is left."""
    first = n % capacity or min(n, capacity)
    return [first] + [capacity] * ((n - first) // capacity)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece; (part, k) numbers the pieces of one length within their partition."""
    prepare(docs.sparkSession)
    paths = paths or vocabulary()

    def tokenise(batches):
        encode, part, seen = encoder(paths), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids), capacity)):
                    row = doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    seen[length] += 1
                    start += length
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenise, PIECES)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, lo, hi, sequence, offset): pieces numbered lo..hi-1 of that length go to sequences from
    ``sequence`` on, one each, at ``offset``.

    Each pattern is what best-two-fit does for one bin: the largest piece that fits, again and again; then, if two
    pieces that are left fill the room of the bin's smallest piece and the gap better than that piece, they replace it.
    A pattern serves as many bins as the counts of its lengths allow.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    used = np.zeros(capacity + 1, np.int64)
    slots, sequence = [], 0
    while left.any():
        spare, gap, items = left.copy(), capacity, []
        while gap and len(fit := np.flatnonzero(spare[: gap + 1])):
            size = int(fit[-1])
            n = min(int(spare[size]), gap // size)
            items += [size] * n
            spare[size] -= n
            gap -= size * n
        if gap and len(items) > 1:
            room, best = gap + items[-1], items[-1]
            sizes = np.flatnonzero(spare[:room])
            pair, i, j = None, 0, len(sizes) - 1
            while i <= j:
                total = int(sizes[i] + sizes[j])
                if total > room or (i == j and spare[sizes[i]] < 2):
                    j -= 1
                    continue
                if total > best:
                    best, pair = total, (int(sizes[j]), int(sizes[i]))
                i += 1
            if pair:
                items = [*items[:-1], *pair]
        lengths, need = np.unique(items, return_counts=True)
        times = int((left[lengths] // need).min())
        offset = 0
        for size in items:
            slots.append((size, int(used[size]), int(used[size]) + times, sequence, offset))
            used[size] += times
            left[size] -= times
            offset += size
        sequence += times
    return slots


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    cuts = cut(pieces(docs, capacity, end_id, paths))
    counts = cut(cuts.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    slots = spark.createDataFrame(plan_bins(histogram, capacity), "length long, lo long, hi long, seq long, offset long").alias("s")
    ranked = cuts.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("k")).alias("p")
    at = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(slots), at).select("doc_id", "piece", "start", "p.length", "ids_crc32", (F.col("seq") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")  # slots: bounded by capacity, not by rows
