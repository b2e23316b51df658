"""Exact removal of repeated byte strings across documents, by suffix arrays over shards of repeated text.

A string of ``size`` bytes that occurs in two documents has the same minimiser in both: the GRAM-byte piece of least hash in it. So first
the minimisers of all texts are exchanged by 32 bits of their hash beside those that choose the partition, with 64 bits of a hash of the text around each
and the minimiser itself, so far as strings with that minimiser reach. What has the same surroundings as a document with a smaller id is a repeat through and through. Where the surroundings differ, the
first document of each of them is asked for the text itself. It goes to the shard of its minimiser, which builds the suffix
array of all it gets that may repeat by induced sorting, compares neighbours by permuted common prefixes, and so finds every string of ``size`` bytes that
another surrounding from a document with a smaller id also has. Documents then meet the runs found for them and are cut.

Texts are shuffled packed with the runs of their partition, twice; minimisers travel packed. A shard gets each surrounding
once, however many documents share it.

Defined results: a null text counts as empty; texts of under ``size`` bytes lose nothing; rows with the same id don't remove
each other's bytes; rows with a null id neither lose bytes nor make others lose any; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import cut, partitions, prepare
from ._exchange import dealt, pack, packed
from ._words import _BYTE, U, _power, mix
from .suffix_array import common_prefixes, suffix_array

SIZE, GRAM = 50, 16
BLOCK = 4 << 20  # bytes of text worked on at a time
SHARD = 6 << 20  # bytes of surroundings in one suffix array, but for a single minimiser's
SIDE = (SIZE - GRAM) // 2  # a string of SIZE bytes with a minimiser has so many bytes before it or behind it
NONE = 0xFF  # no byte of UTF-8
REACH = 2 * SIZE - GRAM  # bytes around a minimiser
STEP = 9  # places of a string that are looked at together for rows that can't have one in common
RUNS = ["i8", "u4"], ["i4", "i4"]  # of a document: id, crc32 of its text; of a run: begin, end


def minimisers(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions of the minimisers of all strings of SIZE bytes in ``data`` that don't run beyond ``end``, their document's end; and hashes of prefixes."""
    n = len(data)
    power, inverse = _power(n)
    total = np.r_[U(0), np.cumsum(_BYTE[data] * power, dtype=np.uint64)]
    if n < SIZE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), total
    grams = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    bits = U(24)
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width, span = SIZE - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    starts = np.flatnonzero(np.arange(n - SIZE + 1) + SIZE <= end[: n - SIZE + 1])
    at = np.unique((least[starts] & U((1 << 24) - 1)).astype(np.int64))
    return at, grams[at], total


def blocks(batches):
    """(ids, texts) of the rows, at most about BLOCK bytes at a time."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
        start = 0
        while start < len(ids):
            end, size = start, 0
            while end < len(ids) and (size == 0 or size + len(texts[end]) <= BLOCK):
                size += len(texts[end])
                end += 1
            yield ids[start:end], texts[start:end]
            start = end


def _pieces(texts: list[bytes]):
    """Texts longer than a block are taken in overlapping pieces: (number of the text, where the piece begins, its bytes)."""
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), BLOCK):
            yield k, at, max(0, at - REACH), text[max(0, at - REACH) : at + BLOCK + REACH]


def _minimised(texts: list[bytes]):
    """text number, position, hash, hash of the surroundings of each minimiser of the texts; whole texts, in one block or piece by piece."""
    long = [k for k, t in enumerate(texts) if len(t) > BLOCK]
    parts = [(list(range(len(texts))), [0] * len(texts), texts, None)] if not long else [([k], [begin], [piece], core) for k, core, begin, piece in _pieces(texts)]
    for numbers, shift, some, core in parts:
        lengths = np.array([len(t) for t in some], np.int64)
        data = np.frombuffer(b"".join(some), np.uint8)
        ends = np.cumsum(lengths)
        at, grams, total = minimisers(data, np.repeat(ends, lengths))
        of = np.searchsorted(ends, at, side="right")
        begin = np.maximum(ends[of] - lengths[of], at - (SIZE - GRAM))
        end = np.minimum(ends[of], at + SIZE)
        around = mix((total[end] - total[begin]) * _power(len(data))[1][begin] if len(at) else np.zeros(0, np.uint64))
        around = mix(around + (at - begin).astype(np.uint64) * U(1000003) + (end - at).astype(np.uint64))
        of, at = np.array(numbers)[of], at - (ends - lengths)[of] + np.array(shift, np.int64)[of]
        if core is not None:  # what lies at the edge of a piece is found in the next one
            inside = (at >= core) & (at < core + BLOCK)
            of, at, grams, around = of[inside], at[inside], grams[inside], around[inside]
        yield of, at, grams, around


def index(docs: DataFrame, parts: int) -> DataFrame:
    """Minimisers of all texts, packed and dealt out by hash."""

    def indexed(batches):
        for ids, texts in blocks(batches):
            crcs = np.array([zlib.crc32(t) for t in texts], np.uint32)
            for of, at, grams, around in _minimised(texts):
                yield from pack(parts, grams, of, [np.array(ids, np.int64), crcs], [(grams // U(parts)).astype(np.uint32), around, at.astype(np.int32)])

    return dealt(docs.mapInArrow(indexed, "to int, blob binary"), parts)


def _to_documents(parts: int, ids, crcs, of, shards, begins, ends, kind: int):
    """Rows (kind, to, shard, blob) of runs or requests, dealt by document."""
    if not len(of):
        return
    used, of = np.unique(of, return_inverse=True)
    ids, crcs = ids[used], crcs[used]
    for batch in pack(parts, ((ids ^ ids >> 13) % parts).astype(np.uint64)[of], of, [ids, crcs], [begins.astype(np.int32), ends.astype(np.int32)]):
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), batch.column(0), pa.array([shards] * n, pa.int32()), batch.column(1)], ["kind", "to", "shard", "blob"])


ROWS = "kind int, to int, shard int, blob binary"


def repeats(minimised: DataFrame, parts: int) -> DataFrame:
    """kind 0: runs that are repeats through and through; kind 1: requests (position, 0) for the text around a minimiser."""

    def found(batches):
        blobs, shard = [], 0
        for batch in batches:
            blobs += batch.column(1).to_pylist()
            shard = batch.column(0)[0].as_py()
        if not blobs:
            return
        (ids, crcs), owner, (gram, around, at) = packed(blobs, *MINIMISED)
        del blobs
        doc = ids[owner]
        order = np.lexsort((doc, around, gram))
        gram, around, doc, owner, at = (x[order] for x in (gram, around, doc, owner, at))
        fresh = np.r_[True, gram[1:] != gram[:-1]]
        other = fresh | np.r_[True, around[1:] != around[:-1]]
        first = doc[np.flatnonzero(other)][np.cumsum(other) - 1]  # smallest document with these surroundings
        again = doc > first
        group = np.cumsum(fresh) - 1
        begins = np.flatnonzero(fresh)
        varied = np.add.reduceat(other.astype(np.int64), begins) > 1
        lo, hi = np.minimum.reduceat(doc, begins), np.maximum.reduceat(doc, begins)
        ask = ~again & (varied & (lo < hi))[group]
        yield from _to_documents(parts, ids, crcs, owner[again], shard, at[again] - (SIZE - GRAM), at[again] + SIZE, 0)
        yield from _to_documents(parts, ids, crcs, owner[ask], shard, at[ask], at[ask] * 0, 1)

    return minimised.mapInArrow(found, ROWS)


MINIMISED = ["i8", "u4"], ["u4", "u8", "i4"]


def with_texts(docs: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """Texts and packed rows of the same documents in one partition, the rows first: to, shard, blob, doc_id, text."""
    rows = rows.select("to", "shard", "blob", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    to = F.coalesce(F.pmod(F.col("doc_id").bitwiseXOR(F.shiftright("doc_id", 13)), F.lit(parts)).cast("int"), F.lit(0))
    texts = docs.select(to.alias("to"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("blob"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.unionByName(texts).repartitionById(parts, F.col("to")).sortWithinPartitions(F.col("text").isNotNull())


def _met(batches):
    """Once the rows are all read: (ids, texts, look), look(id, text) giving shard, begin and end of what the rows have of that document."""
    waiting: dict[int, list[bytes]] = {}
    known = None
    for batch in batches:
        some = [(d, t.encode("utf-8", "replace")) for d, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True) if t is not None]
        for shard, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if blob is not None:
                waiting.setdefault(shard, []).append(blob)
        if not some:
            continue
        if known is None:
            got = [(shard, packed(blobs, *RUNS)) for shard, blobs in waiting.items()]
            known = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([g[0][0][g[1]] for _, g in got], [g[0][1][g[1]] for _, g in got], [np.full(len(g[1]), s) for s, g in got], [g[2][0] for _, g in got], [g[2][1] for _, g in got])]
            order = np.argsort(known[0], kind="stable")
            known = [k[order] for k in known]
            waiting.clear()

        def look(doc, text, known=known):
            a, b = np.searchsorted(known[0], [doc, doc + 1]) if doc is not None else (0, 0)
            own = known[1][a:b] == zlib.crc32(text) if b > a else np.zeros(0, bool)
            return known[2][a:b][own], known[3][a:b][own], known[4][a:b][own]

        yield [d for d, _ in some], [t for _, t in some], look


def surroundings(met: DataFrame, parts: int) -> DataFrame:
    """What shards have asked for: REACH bytes around a minimiser, NONE where the document has none."""

    def sent(batches):
        kept: list[tuple] = []

        def flush():
            ids = np.array([k[0] for k in kept], np.int64)
            crcs = np.array([k[1] for k in kept], np.uint32)
            of = np.repeat(np.arange(len(kept)), [len(k[2]) for k in kept])
            shard, at, text = (np.concatenate([k[i] for k in kept]) for i in (2, 3, 4))
            kept.clear()
            return pack(parts, shard.astype(np.uint64), of, [ids, crcs], [at.astype(np.int32), text])

        size = 0
        for ids, texts, look in _met(batches):
            for doc, text in zip(ids, texts, strict=True):
                shard, at, _ = look(doc, text)
                if not len(at):
                    continue
                data = np.r_[np.full(SIZE, NONE, np.uint8), np.frombuffer(text, np.uint8), np.full(SIZE, NONE, np.uint8)]
                around = data[at[:, None] + np.arange(SIZE - (SIZE - GRAM), SIZE + SIZE)]
                kept.append((doc, zlib.crc32(text), shard, at, np.ascontiguousarray(around).view(f"V{REACH}").ravel()))
                size += len(at)
                if size > 1 << 17:
                    yield from flush()
                    size = 0
        if kept:
            yield from flush()

    return dealt(met.mapInArrow(sent, "to int, blob binary"), parts)


def repeated_runs(around: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, begin, end (in its bytes) of the runs of strings of SIZE bytes that a row with a smaller document has too; ``around`` has a text a row."""
    text = np.ascontiguousarray(np.c_[around, np.full(len(around), NONE, np.uint8)]).ravel()
    order = suffix_array(text, SIZE)
    lack = around == NONE
    left, right = lack[:, : SIZE - GRAM].sum(axis=1), lack[:, SIZE - GRAM :].sum(axis=1)
    place = np.arange(REACH + 1)
    fits = (place >= left[:, None]) & (place + SIZE <= REACH - right[:, None])
    order = order[fits.ravel()[order]]
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    shared = common_prefixes(text, order, SIZE)  # of strings that fit, each with the one before
    row, column = order // (REACH + 1), order % (REACH + 1)
    begins = np.flatnonzero(np.r_[True, shared[order[1:]] < SIZE])
    least = np.minimum.reduceat(doc[row], begins)
    again = doc[row] > np.repeat(least, np.diff(np.r_[begins, len(row)]))
    mask = np.zeros((len(around), REACH - SIZE + 3), np.int8)
    mask[row[again], column[again] + 1] = 1
    edge = np.diff(mask, axis=1)
    of, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    return of, begin, end - 1 + SIZE


def may_repeat(around: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows that may have a string of SIZE bytes, with their minimiser in it, that another document's row has too.

    Such a string begins at one of the first SIZE - GRAM + 1 bytes, of which each STEP have all but STEP - 1 of their strings' bytes in common:
    a row whose bytes there are no other document's, by a hash, for none of these steps, takes no part. Equal bytes have equal hashes.
    """
    kept = np.zeros(len(around), bool)
    for first in range(0, SIZE - GRAM + 1, STEP):
        begin, end = min(first + STEP - 1, SIZE - GRAM), first + SIZE
        key = np.zeros(len(around), np.uint64)
        for at in (*range(begin, end - 8, 8), end - 8):
            key = mix(key + np.ascontiguousarray(around[:, at : at + 8]).view(np.uint64).ravel())
        order = np.argsort(key)
        begins = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]][: len(key)])
        if len(begins):
            others = np.minimum.reduceat(doc[order], begins) < np.maximum.reduceat(doc[order], begins)
            kept[order[np.repeat(others, np.diff(np.r_[begins, len(key)]))]] = True
    return np.flatnonzero(kept)


def _chunks(order: np.ndarray, fresh: np.ndarray, most: int):
    """Slices of ``order`` that end where a group begins (``fresh``), of at most ``most`` rows, but for a single group's."""
    start = 0
    while start < len(order):
        later = fresh[fresh > start]
        fit = later[later <= start + most]
        end = len(order) if len(order) - start <= most else int(fit[-1]) if len(fit) else int(later[0]) if len(later) else len(order)
        yield order[start:end]
        start = end


def _shards(around: np.ndarray, order: np.ndarray, fresh: np.ndarray):
    """Rows of each suffix array: minimisers together, SHARD bytes at most. A minimiser with more is split by the SIDE bytes before it, and again
    by those behind it: a string of SIZE bytes has all of the one or of the other, so equal strings meet in one of the two."""
    most = SHARD // REACH
    for part in _chunks(order, fresh, most):
        if len(part) <= most:
            yield part
            continue
        for side in (slice(SIZE - GRAM - SIDE, SIZE - GRAM), slice(SIZE, SIZE + SIDE)):
            key = np.unique(around[part, side], axis=0, return_inverse=True)[1].ravel()
            within = np.argsort(key, kind="stable")
            yield from _chunks(part[within], np.flatnonzero(np.r_[True, np.diff(key[within]) > 0]), most)


def shard_runs(sent: DataFrame, parts: int) -> DataFrame:
    """kind 0: runs of documents, from the suffix arrays of the shards."""

    def found(batches):
        blobs = [blob for batch in batches for blob in batch.column(1).to_pylist()]
        if not blobs:
            return
        (ids, crcs), owner, (at, text) = packed(blobs, ["i8", "u4"], ["i4", f"V{REACH}"])
        del blobs
        around = text.view(np.uint8).reshape(-1, REACH)
        some = may_repeat(around, ids[owner])
        owner, at, around = owner[some], at[some], around[some]
        words = np.ascontiguousarray(around[:, SIZE - GRAM : SIZE]).view(np.uint64)
        gram = mix(words[:, 0] + mix(words[:, 1]))
        order = np.argsort(gram, kind="stable")
        fresh = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]][: len(gram)])
        for part in _shards(around, order, fresh):
            of, begin, stop = repeated_runs(around[part], ids[owner[part]])
            of = part[of]
            yield from _to_documents(parts, ids, crcs, owner[of], 0, at[of] - (SIZE - GRAM) + begin, at[of] - (SIZE - GRAM) + stop, 0)

    return sent.mapInArrow(found, ROWS)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text); with ``keep_text`` also kept, the remaining bytes."""
    spark = docs.sparkSession
    prepare(spark)
    parts = partitions(spark, docs)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = docs.where("doc_id is not null")
    found = cut(repeats(index(known, parts), parts))
    sent = surroundings(with_texts(known, found.where("kind = 1"), parts), parts)
    runs = cut(shard_runs(sent, parts))
    runs = found.where("kind = 0").unionByName(runs)

    def kept(batches):
        for ids, texts, look in _met(batches):
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                n = len(text)
                _, begin, end = look(doc, text)
                if len(begin):
                    step = np.bincount(np.clip(begin, 0, n), minlength=n + 1) - np.bincount(np.clip(end, 0, n), minlength=n + 1)
                    gone = np.cumsum(step[:n]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                else:
                    spans, left = 0, text
                rows.append((doc, n, n - len(left), spans, hashlib.sha256(left).hexdigest(), left))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            names = [c.split()[0] for c in KEPT.split(", ")] + ["kept"]
            yield pa.RecordBatch.from_arrays(columns if keep_text else columns[:5], names if keep_text else names[:5])

    return with_texts(docs, runs, parts).mapInArrow(kept, KEPT + ", kept binary" * keep_text)
