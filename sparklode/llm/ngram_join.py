"""Exact Jaccard self-join of shingle sets by universe partition and the pigeonhole principle.

Sizes are split into bands [2^k, 2^(k+1)). In a band, hashing splits the universe of shingles into m segments. Two linked sets r and s differ in
at most H = (|r| + |s|) / 7 shingles, so of any H + 1 segments one holds the same shingles in both; a doubled segment, matched
also by its one-deletion neighbourhood, counts for two. A set goes into its own band, and into the next one where partners can be that large.
m is half again as large as H + 1 needs, which leaves slack: allocation gives no weight to the costly segments,
empty ones and ones that more than FEW sets share, and the small bands double segments. A small set that
can't be allocated enough weight is looked up by the shingles of least hash, at one of which any partner meets it; of LONE shingles and more such
a set hardly ever occurs, and then all sets of such sizes are joined by their rarest shingles. A set whose cheap segments are too few is ``heavy``.

Candidates of a segment that few sets share are all pairs; of one that many share, pairs with its smallest id. What heavy
sets share beyond that is tried once more across the components found so far, by their rarest shingles: what makes segments
hot, passages that many documents share, is left out of these prefixes. Every candidate is verified on the sets themselves. Map tasks fold equal sets first; signatures travel packed; sets with many partners are salted.

Defined results: texts without a word have an empty set and no links; a null id is carried with a null component; rows with the
same id are documents of their own, told apart by their text; equal texts are linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import NODE, ROW, cut, numbered, opened, partitions, prepare, sealed
from ._components import components
from ._exchange import dealt, pack, packed
from ._rarity import SKETCH, rarity
from ._words import U, mix, shingle_sets

SHINGLE = 5
FEW = 8  # sets that share a segment and are compared pair by pair
SLACK = 1.5
DOUBLED = 5  # the highest band whose segments have one-deletion neighbourhoods
LONE = 16  # shingles
SALTS = 256  # parts that the partners of a set are split into
BATCH_BYTES, BATCH_DOCS = 8 << 20, 60_000
FOUND = "kind int, a long, b long, n int, slack int, need int"


def segments(band: int) -> int:
    top = (2 << band) - 1
    return int(np.ceil(SLACK * 2 * top / 7)) + 1


def instances(n: int) -> list[tuple[int, int]]:
    """(band, H) of every band that a set of n shingles goes into."""
    band = n.bit_length() - 1
    most = 4 * n // 3
    out = [(band, (n + min(most, (2 << band) - 1)) // 7)]
    return out + [(band + 1, (n + most) // 7)] if most >= 2 << band else out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures and the number of the set of each; for each set its slack, the weight of its segments beyond H + 1 (below 0: not
    enough), and its need: any partner shares at least so many of its segments.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    need = np.full(len(sets), 1 << 30, np.int64)
    slack = np.full(len(sets), 1 << 30, np.int64)
    groups: dict[int, list[tuple[int, int]]] = {}
    for i, n in enumerate(sizes.tolist()):
        for band, h in instances(n) if n else ():
            groups.setdefault(band, []).append((i, h))
    found, owner = [], []
    for band, members in groups.items():
        m, own = segments(band), np.array([i for i, _ in members])
        tokens = np.concatenate([sets[i] for i in own])
        local = np.repeat(np.arange(len(own)), sizes[own])
        place = local * m + ((tokens >> U(32)) * U(m) >> U(32)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, spread = place[order], mix(tokens[order])
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        total, size = np.add.reduceat(spread, first), np.diff(np.r_[first, len(place)])
        at, segment = place[first] // m, place[first] % m
        salt = mix((np.uint64(band << 32) + segment.astype(np.uint64)) * U(0x9E3779B97F4A7C15))
        found.append(mix(total + salt))
        owner.append(own[at])
        weight, most = np.bincount(at, minlength=len(own)), np.array([h for _, h in members])
        np.minimum.at(need, own, np.maximum(1, weight - most) if band > DOUBLED else 1)
        if band <= DOUBLED:
            weight = weight + np.bincount(at, size > 1, len(own)).astype(np.int64)
            less = np.repeat(size > 1, size)
            found.append(mix((np.repeat(total, size) - spread + np.repeat(salt, size))[less]))
            owner.append(np.repeat(own[at], size)[less])
        np.minimum.at(slack, own, weight - most - 1)
    return (np.concatenate(found), np.concatenate(owner), slack, need) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), slack, need)


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"to": pa.int32(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], list(kinds)) if n else None


def _pack(parts: int, sig: np.ndarray, owner: np.ndarray, ids: np.ndarray, sizes: np.ndarray, kind: int):
    """Rows (to, blob): the ids and sizes of the sets in the blob, and 40 bits of each signature with its set's place there."""
    to = (sig % U(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(parts + 1)).tolist()
    rest, owner = (sig // U(parts))[order], owner[order]
    tos, blobs = [], []
    for p in range(parts):
        a, b = cuts[p], cuts[p + 1]
        if b > a:
            here, place = np.unique(owner[a:b], return_inverse=True)
            head = np.array([kind, len(here), b - a], np.int64).tobytes()
            tos.append(p)
            blobs.append(b"".join([head, ids[here].tobytes(), sizes[here].astype(np.int32).tobytes(), rest[a:b].astype(np.uint32).tobytes(), (rest[a:b] >> U(32)).astype(np.uint8).tobytes(), place.astype(np.uint16).tobytes()]))
        if blobs and (len(blobs) == 64 or p == parts - 1):
            yield _rows(to=tos, blob=blobs)
            tos, blobs = [], []
    if blobs:
        yield _rows(to=tos, blob=blobs)


def index(docs: DataFrame, parts: int) -> DataFrame:
    """Packed signatures of every distinct set of a map task, and about every document, dealt out by signature."""
    prepare(docs.sparkSession)

    def indexed(batches):
        known: dict[tuple, int] = {}
        waiting: list[tuple[int, np.ndarray]] = []
        about: list[tuple[int, int, int]] = []

        def flush():
            sets = [s for _, s in waiting]
            ids, sizes = np.array([i for i, _ in waiting], np.int64), np.array([len(s) for s in sets], np.int64)
            sig, owner, slack, need = signatures(sets)
            yield from _pack(parts, sig, owner, ids, sizes, 0)
            for kind, some in ((1, sizes < 4 * LONE // 3), (2, (slack < 0) & (sizes < LONE))):
                some = np.flatnonzero(some & (sizes > 0)).tolist()
                least = [sets[k][: len(sets[k]) - (3 * len(sets[k]) + 3) // 4 + 1] for k in some]
                if some:
                    yield from _pack(parts, mix(np.concatenate(least) ^ U(0x10E5)), np.repeat(some, [len(x) for x in least]), ids, sizes, kind)
            at = {int(i): (int(s), int(x)) for i, s, x in zip(ids, slack, need, strict=True)}
            info = np.array([[d, r, n, *at.get(d, (0, 1))] for d, r, n in about], np.int64).reshape(-1, 5)
            if len(info):
                to = (mix(info[:, 0].astype(np.uint64)) % U(parts)).astype(np.int64)
                some = np.unique(to)
                yield _rows(to=some.tolist(), blob=[np.array([3, 0, (to == p).sum()], np.int64).tobytes() + info[to == p].tobytes() for p in some])
            waiting.clear()
            about.clear()

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (size == 0 or size + len(texts[end]) < BATCH_BYTES // 4):
                    size += len(texts[end])
                    end += 1
                for doc, own in zip(ids[start:end], shingle_sets(texts[start:end], SHINGLE), strict=True):
                    key = (len(own), int(own.sum(dtype=np.uint64)), int(mix(own ^ U(0xABCDEF)).sum(dtype=np.uint64)))
                    first = known.setdefault(key, doc) if len(own) else doc
                    about.append((doc, first, len(own)))
                    if first == doc and len(own):
                        waiting.append((doc, own))
                start = end
                if sum(len(s) for _, s in waiting) > BATCH_BYTES // 6 or len(about) > BATCH_DOCS:
                    yield from flush()
        yield from flush()

    return dealt(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(indexed, "to int, blob binary"), parts)


def candidates(dealt_out: DataFrame) -> DataFrame:
    """kind 0: a document (a), the equal one before it (b), n, slack, need; kind 1: a pair and the number (n) of segments that it was found by; kind 2: a shared segment (a) of the set b."""

    def found(batches):
        table: dict[str, list] = {"ids": [], "n": [], "sig": [], "set": []}
        small: dict[int, list] = {1: [], 2: []}
        base = 0
        for batch in batches:
            for to, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind, k, n = np.frombuffer(blob, np.int64, 3).tolist()
                if kind == 3:
                    info = np.frombuffer(blob, np.int64, 5 * n, 24).reshape(-1, 5)
                    yield _found(0, *info.T)
                    continue
                ids, sizes = np.frombuffer(blob, np.int64, k, 24), np.frombuffer(blob, np.int32, k, 24 + 8 * k)
                at = 24 + 12 * k
                low, high, place = np.frombuffer(blob, np.uint32, n, at), np.frombuffer(blob, np.uint8, n, at + 4 * n), np.frombuffer(blob, np.uint16, n, at + 5 * n)
                sig = low.astype(np.int64) | high.astype(np.int64) << 32
                if kind:
                    small[kind].append((sig, ids[place], sizes[place].astype(np.int64)))
                    continue
                table["ids"].append(ids)
                table["n"].append(sizes)
                table["sig"].append(sig)
                table["set"].append(place.astype(np.int32) + base)
                base += k
                part = to
        yield from _looked_up(*([np.concatenate(x) for x in zip(*small[kind], strict=True)] for kind in (1, 2))) if small[2] else ()
        small.clear()
        if not base:
            return
        ids, n, sig, sets = (np.concatenate(table.pop(k)) for k in ("ids", "n", "sig", "set"))
        order = np.argsort(sig, kind="stable")
        sig, sets = sig[order], sets[order]
        ids, inverse = np.unique(ids, return_inverse=True)
        size = np.zeros(len(ids), np.int64)
        size[inverse] = n
        sets = inverse[sets]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        length = np.diff(np.r_[first, len(sig)])
        pairs = []
        for k in range(2, FEW + 1):
            runs = sets[first[length == k][:, None] + np.arange(k)]
            pairs += [(runs[:, i], runs[:, j]) for i in range(k) for j in range(i + 1, k)]
        hot = first[length > FEW], length[length > FEW]
        for a, k in zip(*(x.tolist() for x in hot), strict=True):
            run = np.unique(sets[a : a + k])
            pairs.append((np.full(len(run) - 1, run[0]), run[1:]))
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            a, b = np.minimum(a, b), np.maximum(a, b)
            near = (a != b) & (4 * np.minimum(size[a], size[b]) >= 3 * np.maximum(size[a], size[b]))
            both, shared = np.unique(a[near] * len(ids) + b[near], return_counts=True)
            yield _found(1, ids[both // len(ids)], ids[both % len(ids)], shared)
        if len(hot[0]):
            at = np.concatenate([np.arange(a, a + k) for a, k in zip(*hot, strict=True)])
            yield _found(2, sig[at] << 20 | part, ids[sets[at]], size[sets[at]])

    def batched(batches):
        for got in found(batches):
            if got is not None:
                for start in range(0, got.num_rows, 1 << 16):
                    yield got.slice(start, 1 << 16)

    return dealt_out.mapInArrow(batched, FOUND)


def _looked_up(known: list[np.ndarray], asked: list[np.ndarray]):
    """Pairs of the sets ``asked`` with those ``known`` (each: signature, id, size) at a signature, if their sizes allow a link."""
    order = np.argsort(known[0], kind="stable")
    sig, ids, sizes = (x[order] for x in known)
    first, last = np.searchsorted(sig, asked[0]), np.searchsorted(sig, asked[0], side="right")
    for some in np.array_split(np.arange(len(first)), max(1, int((last - first).sum()) // 2_000_000 + 1)):
        n = (last - first)[some]
        a = np.repeat(some, n)
        b = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = (asked[1][a] != ids[b]) & (4 * np.minimum(asked[2][a], sizes[b]) >= 3 * np.maximum(asked[2][a], sizes[b]))
        pairs = np.unique(np.sort(np.c_[asked[1][a[near]], ids[b[near]]], axis=1), axis=0)
        if len(pairs):
            yield _found(1, pairs[:, 0], pairs[:, 1], np.full(len(pairs), 1 << 20))


def _found(kind: int, a, b, *more) -> pa.RecordBatch:
    zero = np.zeros(len(a), np.int32)
    columns = [zero + kind, a, b, *more, *[zero] * (3 - len(more))]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), t, safe=False) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])


def heavy_sets(docs: DataFrame, heavy: DataFrame) -> DataFrame:
    """doc_id, component and own (the packed set) of the documents in ``heavy`` (doc_id, component)."""

    def made(batches):
        for batch in batches:
            own = [s.tobytes() for s in shingle_sets([(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()], SHINGLE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], ["doc_id", "component", "own"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(heavy.hint("shuffle_hash"), "doc_id").select("doc_id", "component", "text")
    return texts.mapInArrow(made, "doc_id long, component long, own binary")


def set_hashes(batches):
    for batch in batches:
        for own in batch.column(2).to_pylist():
            yield np.frombuffer(own, np.uint64)


def prefix_pairs(sets: DataFrame, counts: np.ndarray, parts: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that share one of the |s| - ceil(0.75 |s|) + 1 rarest shingles of either, by length and position."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)  # SKETCH bytes

    def sent(batches):
        counts = shared.value
        for batch in batches:
            ids, part = np.array(batch.column(0).to_pylist(), np.int64), np.array(batch.column(1).to_pylist(), np.int64)
            keys, owner, place, sizes = [], [], [], np.zeros(len(ids), np.int32)
            for k, own in enumerate(batch.column(2).to_pylist()):
                own = np.frombuffer(own, np.uint64)
                n = sizes[k] = len(own)
                rarest = own[np.argsort(counts[(own & U(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << U(56) | own >> U(8), kind="stable")][: n - (3 * n + 3) // 4 + 1]
                keys.append(rarest)
                owner.append(np.full(len(rarest), k))
                place.append(np.arange(len(rarest), dtype=np.int32))
            if keys:
                key = np.concatenate(keys)
                yield from pack(parts, key, np.concatenate(owner), [ids, part, sizes], [key, np.concatenate(place)])

    def found(batches):
        blobs = [b for batch in batches for b in batch.column(1).to_pylist()]
        (ids, part, sizes), owner, (key, place) = packed(blobs, ["i8", "i8", "i4"], ["u8", "i4"])
        order = np.lexsort((part[owner], key))
        key, owner, place = key[order], owner[order], place[order].astype(np.int64)
        group = np.r_[True, key[1:] != key[:-1]][: len(key)]
        first = np.flatnonzero(group)
        last = np.r_[first[1:], len(key)]
        mixed = part[owner[first]] != part[owner[last - 1]] if len(first) else np.zeros(0, bool)
        # The rows of a group are in the order of their components; each is paired with those of later ones.
        run = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[owner[1:]] != part[owner[:-1]])][: len(key)])
        beyond = np.r_[run[1:], len(key)][np.searchsorted(run, np.arange(len(key)), side="right") - 1]
        end = last[np.searchsorted(first, np.arange(len(key)), side="right") - 1] if len(first) else beyond
        left = np.flatnonzero(np.repeat(mixed, last - first) & (end > beyond)) if len(first) else np.zeros(0, np.int64)
        done = np.zeros(0, np.int64)
        distinct = np.unique(ids)
        for some in np.array_split(left, max(1, int((end[left] - beyond[left]).sum()) // 2_000_000 + 1)):
            n = end[some] - beyond[some]
            a = np.repeat(some, n)
            b = np.repeat(beyond[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x, y = sizes[owner[a]].astype(np.int64), sizes[owner[b]].astype(np.int64)
            fits = (4 * np.minimum(x, y) >= 3 * np.maximum(x, y)) & (7 * np.minimum(x - place[a], y - place[b]) >= 3 * (x + y))
            p, q = np.searchsorted(distinct, ids[owner[a[fits]]]), np.searchsorted(distinct, ids[owner[b[fits]]])
            done = np.unique(np.r_[done, np.minimum(p, q) * len(distinct) + np.maximum(p, q)])
        for start in range(0, len(done), 1 << 16):
            pair = done[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(distinct[pair // len(distinct)]), pa.array(distinct[pair % len(distinct)])], ["a", "b"])

    return dealt(sets.mapInArrow(sent, "to int, blob binary"), parts).mapInArrow(found, "a long, b long")


def verify(docs: DataFrame, pairs: DataFrame, parts: int, kept: str = "text") -> DataFrame:
    """The pairs (a, b) whose sets are at least 0.75 alike. ``docs`` has their texts, or as ``own`` their sets. The text of a document is shuffled once, its set once for each partner; a with many partners is salted."""
    salted = pairs.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS)).cast("int"))  # at most one more copy of the set of a for each partner
    wanted = salted.select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), "salt").unionByName(salted.select(F.col("a").alias("doc_id"), F.col("a").alias("hub"), "salt").distinct())
    wanted = wanted.groupBy("doc_id").agg(F.collect_list("hub").alias("hubs"), F.collect_list("salt").alias("salts"))
    texts = docs.select(F.col("doc_id").cast("long"), kept).join(wanted.hint("shuffle_hash"), "doc_id")

    def sets(batches):
        for batch in batches:
            for doc, text, hubs, salts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = text if kept == "own" else shingle_sets([(text or "").encode("utf-8", "replace")], SHINGLE)[0].tobytes()
                for start in range(0, len(hubs), 256):
                    some = hubs[start : start + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(salts[start : start + 256], pa.int32()), pa.array([doc] * len(some), pa.int64()), pa.array([own] * len(some), pa.binary())], ["hub", "salt", "doc", "own"])

    def compared(batches):
        of, centres = None, []
        for batch in batches:
            a, b = [], []
            for hub, salt, doc, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = np.frombuffer(own, np.uint64)
                if of != (hub, salt):
                    of, centres = (hub, salt), []
                if doc == hub:
                    centres.append(own)
                    continue
                for centre in centres:
                    at = np.searchsorted(centre, own)
                    both = int((centre[np.minimum(at, len(centre) - 1)] == own).sum()) if len(centre) else 0
                    if both and 100 * both >= 75 * (len(centre) + len(own) - both):
                        a.append(hub)
                        b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    spread = texts.mapInArrow(sets, "hub long, salt int, doc long, own binary").repartition(parts, "hub", "salt")
    return spread.sortWithinPartitions("hub", "salt", F.col("doc") != F.col("hub"), "doc").mapInArrow(compared, "a long, b long")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, not null and each once, and text)."""
    spark = docs.sparkSession
    parts = partitions(spark, docs)
    found = cut(candidates(index(docs, parts)))
    about = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("equal"), F.col("n").alias("n_shingles"), "slack", "need")
    hot = found.where("kind = 2").select(F.col("a").alias("segment"), F.col("b").alias("id"), F.col("n").alias("size"))
    limits = about.where("equal = doc_id").groupBy("doc_id").agg(F.min("slack").alias("slack"), F.min("need").alias("need"))
    limits = limits.join(hot.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("hot")), "doc_id", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    limits = cut(limits.select("doc_id", (F.col("need") - F.col("hot")).alias("need"), (F.col("hot") > F.col("slack")).alias("heavy")))
    # A pair that shares fewer segments than each of the two needs with any partner, hot ones aside, can't be linked.
    pairs = found.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for side in ("a", "b"):
        pairs = pairs.join(limits.select(F.col("doc_id").alias(side), F.col("need").alias(f"need_{side}")), side)
    pairs = pairs.where("n >= need_a and n >= need_b").select("a", "b")
    lone = about.where(f"slack < 0 and n_shingles >= {LONE}").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi")).first()
    if lone["lo"] is not None:
        some = about.where((4 * F.col("n_shingles") >= 3 * lone["lo"]) & (3 * F.col("n_shingles") <= 4 * lone["hi"])).select("doc_id", F.col("doc_id").alias("component"))
        sets = cut(heavy_sets(docs, some))
        pairs = pairs.unionByName(prefix_pairs(sets, rarity(sets, set_hashes), parts)).distinct()
    pairs = cut(pairs)
    links = cut(about.where("equal <> doc_id").select(F.col("doc_id").alias("a"), F.col("equal").alias("b")).unionByName(verify(docs, pairs, parts)))
    classes = components(links)
    heavy = cut(limits.where("heavy").select(F.col("doc_id").alias("id")).join(classes, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("component", "id").alias("component")))
    if heavy.limit(1).count():
        sets = cut(heavy_sets(docs, heavy))
        more = prefix_pairs(sets, rarity(sets, set_hashes), parts).distinct().join(pairs, ["a", "b"], "left_anti")
        more = cut(verify(sets.select("doc_id", "own"), cut(more), parts, "own"))
        if more.limit(1).count():
            classes = components(links.unionByName(more))
    out = about.select("doc_id", F.col("n_shingles").cast("long")).join(classes, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    rows, repeated = numbered(docs.select("doc_id", "text"))
    known = rows.where(f"{NODE} is not null")
    found = joined(known.select(F.col(NODE).alias("doc_id"), "text"))
    if repeated:  # numbers are in the order of ids, so the smallest number of a component has its smallest id
        ids = known.select(F.col(NODE).alias("node"), F.col("doc_id").alias("id"))
        found = found.join(ids, F.col("doc_id") == F.col("node")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
        found = found.join(ids, F.col("component_id") == F.col("node")).select("doc_id", "n_shingles", F.col("id").alias("component_id"))
    none = F.lit(None).cast("long")
    return found.unionByName(rows.where(f"{NODE} is null").select(none.alias("doc_id"), none.alias("n_shingles"), none.alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first row of ``docs`` (doc_id, text, ...) of each component, all columns: that of the smallest id, of those the one of the least hash of its text; null ids stay."""
    rows, _ = numbered(sealed(docs))
    found = joined(rows.where(f"{NODE} is not null").select(F.col(NODE).alias("doc_id"), "text"))
    kept = cut(found.where("doc_id = component_id").select(F.col("doc_id").alias(NODE)))
    return opened(rows.join(kept, NODE, "left_semi").select("text", ROW).unionByName(rows.where(f"{NODE} is null").select("text", ROW)), docs.columns)
