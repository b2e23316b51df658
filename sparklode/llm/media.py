"""Media columns: recordings as binary columns, chroma fingerprints of them, and alignment of recordings by their fingerprints.

A recording is 16-bit mono PCM with its sample rate. Its chroma frames hold the energy of each of the 12 pitch classes in overlapping windows.
Filters over the integral image of these frames compare two regions each; a filter's value falls into one of four ranges, coded in two bits, and
16 filters make a packed 32-bit integer for each frame. Two recordings are aligned by the histogram of the offsets at which they share keys;
at the most frequent offset the share of differing bits over their overlap decides, if it is at most MOST_ERRORS. A key is half of the bits of a
frame with half of those of another, GAPS frames later: so bits may differ in either half, and yet unrelated recordings hardly share one.

Recordings with equal fingerprints are folded into classes before anything is compared. Fingerprints travel, keys do not; all recordings are looked up
in blocks of queries, and tried with all that share LEAST_HITS keys at one offset. What that finds of the recordings within MOST_ERRORS is in the README.

Defined results: null, empty and too short recordings have an empty fingerprint and match nothing but each other's kind, which
is one class; an odd last byte is ignored; ties go to the offset nearest 0, then the smaller one, and to the smaller id; repeated ids
count as recordings of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import cut, partitions, prepare
from ._exchange import dealt
from ._words import U, mix

WINDOW, HOP = 512, 64  # samples
LOWEST, HIGHEST = 110.0, 880.0  # Hz
SPAN = 16  # frames that the widest filter covers
GAPS = (6, 12, 24)  # frames between the two of a key
LEAST_HITS, MOST_ERRORS = 2, 0.2
BLOCK_BYTES = 1 << 20  # of fingerprints of the queries that a task holds, 12 keys for each 4
FRAMES, AT_ONCE = 1 << 16, 1 << 22  # looked up at a time; hits, or frames compared, at a time
#: kind of region, first pitch class, pitch classes and frames of each filter, by rule.
FILTERS = [(kind, first, height, width) for kind, heights in ((0, (3, 6)), (1, (2, 4)), (2, (4, 6))) for height in heights for first, width in ((0, 4), (12 - height, 8), ((12 - height) // 2, 16))][:16]
LIMITS = (-0.25, 0.0, 0.25)
NOTES, RATE = 64, 2000


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by 12 pitch classes, each frame of length 1 or silent."""
    n = (len(samples) - WINDOW) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), WINDOW)[::HOP] * np.hanning(WINDOW).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hertz = np.fft.rfftfreq(WINDOW, 1 / rate)
    heard = (hertz >= LOWEST) & (hertz <= min(HIGHEST, rate / 2))
    pitch = np.round(12 * np.log2(hertz[heard] / LOWEST)).astype(int) % 12
    out = power[:, heard] @ np.eye(12)[pitch]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-3, out / np.maximum(size, 1e-3), 0.0)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """A packed 32-bit integer for each frame from which all filters fit."""
    frames = chroma(samples, rate)
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(frames) + 1, 13))
    integral[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)
    region = lambda t0, t1, p0, p1: integral[at + t1, p1] - integral[at + t0, p1] - integral[at + t1, p0] + integral[at + t0, p0]
    out = np.zeros(n, np.uint32)
    for k, (kind, first, height, width) in enumerate(FILTERS):
        if kind == 0:  # upper against lower half of the pitch classes
            middle = first + height // 2
            a, b = region(0, width, first, middle), region(0, width, middle, first + height)
        elif kind == 1:  # earlier against later half of the frames
            a, b = region(0, width // 2, first, first + height), region(width // 2, width, first, first + height)
        else:  # one diagonal against the other
            middle, half = first + height // 2, width // 2
            a = region(0, half, first, middle) + region(half, width, middle, first + height)
            b = region(0, half, middle, first + height) + region(half, width, first, middle)
        step = np.digitize(np.log((0.01 + a) / (0.01 + b)), LIMITS)
        out |= ((step ^ step >> 1).astype(np.uint32)) << np.uint32(2 * k)
    return out


def rendered(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """id, audio (PCM), rate: each vector played as a tune, a note of 1/16 s for each of its numbers."""
    prepare(vectors.sparkSession)
    size = RATE // 16
    time = np.arange(size) / RATE
    shape = np.hanning(size)
    tones = np.array([np.sin(2 * np.pi * 220 * 2 ** (p / 12) * time) * shape for p in range(12)])

    def played(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                notes = np.nan_to_num(np.array(v or [], float))
                pitch = np.clip(np.floor(6 + 24 * notes), 0, 11).astype(int)
                out.append((tones[pitch] * 12000).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([RATE] * len(out), pa.int32())], ["id", "audio", "rate"])

    return vectors.select(F.col("id").cast("long"), vector).mapInArrow(played, "id long, audio binary, rate int")


def fingerprinted(media: DataFrame) -> DataFrame:
    """id, fingerprint (packed integers, little-endian) of ``media`` (id, audio, rate)."""
    prepare(media.sparkSession)

    def done(batches):
        for batch in batches:
            audio, rate = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            prints = [fingerprint(np.frombuffer(a or b"", "<i2", len(a or b"") // 2), r or RATE).astype("<u4").tobytes() for a, r in zip(audio, rate, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["id", "fingerprint"])

    return media.select(F.col("id").cast("long"), "audio", F.col("rate").cast("int")).mapInArrow(done, "id long, fingerprint binary")


def keys_of(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a fingerprint and the frame of each: every half of a frame with every half of the frame a gap later."""
    x, keys, place = ints.astype(np.uint64), [], []
    for g, gap in enumerate(GAPS):
        for a in (0, 16):
            for b in (0, 16):
                first, second = x[:-gap] >> U(a) & U(0xFFFF), x[gap:] >> U(b) & U(0xFFFF)
                keys.append(mix(first << U(16) | second | U(g << 40 | a << 34 | b << 33)))
                place.append(np.arange(len(first), dtype=np.int32))
    return np.concatenate(keys), np.concatenate(place)


def bit_errors(at: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], of: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Share of differing bits over the overlap of fingerprints a[of] and b[to] at the offsets ``at``."""
    sides = [(np.concatenate(x), np.cumsum(n) - n, n) for x, n in ((x, np.array([len(f) for f in x])) for x in (a, b))]
    (x, x0, nx), (y, y0, ny) = sides
    left, right = np.maximum(0, at), np.maximum(0, -at)
    n = np.minimum(nx[of] - left, ny[to] - right)
    out = np.ones(len(at))
    some = np.flatnonzero(n > 0)
    for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(n[some]) // AT_ONCE)) + 1) if len(some) else []:
        m = n[part]
        begin = np.cumsum(m) - m
        step = np.arange(m.sum()) - np.repeat(begin, m)
        bits = np.bitwise_count(x[np.repeat(x0[of[part]] + left[part], m) + step] ^ y[np.repeat(y0[to[part]] + right[part], m) + step])
        out[part] = np.add.reduceat(bits.astype(np.int64), begin) / (32 * m)
    return out


def all_keys(prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the fingerprints, whose they are (ascending), and their frames."""
    found = [keys_of(x) for x in prints]
    return np.concatenate([k for k, _ in found]), np.repeat(np.arange(len(found)), [len(k) for k, _ in found]), np.concatenate([p for _, p in found]).astype(np.int64)


def best_offsets(index: tuple[np.ndarray, ...], queries: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """query, target (their places), offset and hits of all that share at least LEAST_HITS keys at their most frequent offset. index: sorted keys of the queries, whose, frames."""
    known, whose, frame = index
    key, owner, place = all_keys(targets)
    order = np.argsort(key)
    low, high = np.zeros((2, len(key)), np.int64)
    low[order], high[order] = (np.searchsorted(known, key[order], side) for side in ("left", "right"))
    hit = np.flatnonzero(high > low)
    n = (high - low)[hit]
    longest = max(map(len, targets))
    span = longest + max(map(len, queries))
    total = np.cumsum(np.bincount(owner[hit], n, len(targets))).astype(np.int64)
    out, first = [], 0
    while first < len(targets):
        base = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, base + AT_ONCE, "right")))  # whole targets, one at least
        here = slice(*np.searchsorted(owner[hit], (first, last)))
        codes, counts = [], []
        for part in np.array_split(np.arange(here.start, here.stop), int(n[here].sum()) // AT_ONCE + 1):
            m, right = n[part], np.repeat(hit[part], n[part])
            left = np.repeat(low[hit[part]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            code, count = np.unique((owner[right] * len(queries) + whose[left]) * span + (frame[left] - place[right] + longest), return_counts=True)
            codes.append(code)
            counts.append(count)
        code, hits = codes[0], counts[0]
        if len(codes) > 1:
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            hits = np.bincount(back, np.concatenate(counts), len(code)).astype(np.int64)
        code, hits = code[hits >= LEAST_HITS], hits[hits >= LEAST_HITS]
        pair, at = code // span, code % span - longest
        order = np.lexsort((at, np.abs(at), -hits, pair))
        order = order[np.r_[True, pair[order][1:] != pair[order][:-1]][: len(order)]]
        out.append((pair[order] % len(queries), pair[order] // len(queries), at[order], hits[order]))
        first = last
    return tuple(np.concatenate(x) for x in zip(*out))


def matches(classes: DataFrame, parts: int) -> DataFrame:
    """query, code, target, at (offset), hits, error, size of all pairs within MOST_ERRORS; ``classes``: id, code, size, fingerprint, asked.

    A task has a block of the queries, whose keys it sorts, and looks a share of all classes up in them: what chance makes of single hits
    stays in its memory. Fingerprints travel once for each block, and a block's queries once for each share.
    """
    asked = classes.where("asked")
    blocks = max(1, -(-(asked.agg(F.sum(F.length("fingerprint")).alias("n")).first()["n"] or 0) // BLOCK_BYTES))
    place = lambda n, salt: F.pmod(F.xxhash64("code", "id", F.lit(salt)), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["id", "code", "size", "fingerprint"]
    a = asked.select(spread(parts).alias("share"), place(blocks, 1).alias("block"), F.lit(0).alias("side"), *columns)
    b = classes.select(place(parts, 2).alias("share"), spread(blocks).alias("block"), F.lit(1).alias("side"), *columns)
    schema = "query long, code long, target long, at int, hits int, error double, size long"

    def compared(batches):
        index, queries, ids, codes = None, [], [], []
        for batch in batches:
            side, data = batch.column(0).to_numpy(), batch.column(4).to_pylist()
            prints = [np.frombuffer(x, "<u4") for x in data]
            cut_at = int((side == 0).sum())
            queries += prints[:cut_at]
            ids += batch.column(1).to_pylist()[:cut_at]
            codes += batch.column(2).to_pylist()[:cut_at]
            if cut_at == len(side) or not queries:
                continue
            if index is None:
                key, whose, frame = all_keys(queries)
                order = np.argsort(key)
                index = key[order], whose[order], frame[order]
                del key, whose, frame, order
            others, sizes = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            frames = np.cumsum([len(x) for x in prints])
            for part in np.split(np.arange(cut_at, len(side)), np.flatnonzero(np.diff(frames[cut_at:] // FRAMES)) + 1):
                targets = [prints[i] for i in part]
                q, t, at, hits = best_offsets(index, queries, targets)
                error = bit_errors(at, queries, targets, q, t) if len(q) else np.zeros(0)
                near = [i for i in np.flatnonzero(error <= MOST_ERRORS).tolist() if queries[q[i]].tobytes() != targets[t[i]].tobytes()]  # not itself
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[q[i]] for i in near], pa.int64()), pa.array([codes[q[i]] for i in near], pa.int64()), pa.array([others[part[t[i]]] for i in near], pa.int64()), pa.array(at[near].astype(np.int32), pa.int32()),
                        pa.array(hits[near].astype(np.int32), pa.int32()), pa.array(error[near], pa.float64()), pa.array([sizes[part[t[i]]] for i in near], pa.int64()),
                    ],
                    [c.split()[0] for c in schema.split(", ")],
                )

    both = a.unionByName(b).select((F.col("block") * parts + F.col("share")).alias("to"), "side", *columns)
    return dealt(both, blocks * parts).sortWithinPartitions("side").select("side", *columns).mapInArrow(compared, schema)


def align(media: DataFrame, queries) -> DataFrame:
    """For each recording of ``media`` (id, audio, rate) that the condition ``queries`` on id holds for: id, n_frames, class_id,
    n_matches, best_id, best_offset, best_error. Matches are the other recordings of its class and those of classes that align with it.
    """
    spark = media.sparkSession
    parts = partitions(spark, media)
    prints = cut(fingerprinted(media).withColumn("asked", F.coalesce(queries, F.lit(False))))
    key = F.sha2("fingerprint", 256)
    classes = prints.groupBy(key.alias("key")).agg(F.min("id").alias("class_id"), F.count("*").alias("size"), F.max("asked").alias("asked"), F.first("fingerprint").alias("fingerprint"), F.sort_array(F.array(F.min("id"), F.max("id"))).alias("ends"))
    classes = cut(classes)
    near = matches(classes.select(F.col("class_id").alias("id"), F.xxhash64("fingerprint").alias("code"), "size", "fingerprint", "asked").where(F.length("fingerprint") > 0), parts)
    near = near.groupBy("query", "code").agg(F.sum("size").alias("others"), F.min(F.struct("error", F.col("target").alias("id"), "at")).alias("best"))
    asked = prints.where("asked").select("id", key.alias("key"), (F.length("fingerprint") / 4).cast("long").alias("n_frames"))
    found = asked.join(classes.select("key", "class_id", "size", "ends", F.xxhash64("fingerprint").alias("own")), "key").join(near, (F.col("class_id") == F.col("query")) & (F.col("own") == F.col("code")), "left")
    twin = F.when(F.col("size") > 1, F.when(F.col("class_id") != F.col("id"), F.col("class_id")).otherwise(F.col("ends")[1]))
    return found.select(
        "id", "n_frames", "class_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_matches"),
        F.coalesce(twin, F.col("best.id")).alias("best_id"), F.when(twin.isNotNull(), F.lit(0)).otherwise(F.col("best.at")).alias("best_offset"),
        F.when(twin.isNotNull(), F.lit(0.0)).otherwise(F.col("best.error")).alias("best_error"),
    )
