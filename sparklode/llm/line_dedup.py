"""Line dedup: exact set-similarity join of lines by prefix, length and position, and removal of later matches.

A line's tokens are its distinct word shingles of ``SHINGLE`` words; a line of fewer words has its whole sequence as its one token. Tokens
are ordered by rarity: counts come from a sketch of fixed size over all lines; any order that is the same everywhere keeps the join exact, the sketch only makes it cheap. Two lines of x and y tokens that are at
least 0.75 alike share one of the x - ceil(0.75 x) + 1 rarest of the one and likewise of the other; their lengths and
the positions of the shared token bound their overlap. What passes is verified on the lines themselves. A line goes if any
earlier line, by doc_id and line number, matches it, whether that one goes as well or not.

Equal lines are folded first, in map tasks and then by a hash of their token set; lines of one token match equal ones only and end there. Of a token that many lines share, each
is tried at first only with the NEAREST earlier ones, of WINDOW, by parities of their tokens: one match is enough, so that a group of near copies
costs pairs in proportion to its lines. Lines that this leaves unmatched, and that have more to try, are then tried with all earlier ones but
copies, if their parities differ in few enough places, which no match can fail.

Defined results: lines with fewer words than a shingle match lines of the same words; lines without words are kept; a null text stays null and
has no lines; a document may be left with an empty text, which ``dedup`` keeps; rows with the same id are documents of their own, in the order
of a hash of their text; so repeated rows lose what the first of them keeps; rows with a null id are left alone; an empty table gives an empty
result; other columns are carried along, but ``dedup`` replaces those named n_lines and n_removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import NODE, ROW, cut, numbered, opened, partitions, prepare, sealed
from ._exchange import pack, packed
from ._rarity import SKETCH, rarity
from ._words import _ODD, U, mix, word_hashes
from .substring_dedup import BLOCK, blocks

SHINGLE = 5
FEW = 8  # lines that share a token and are tried pair by pair
NEAREST = 2  # earlier lines that a line is tried with at first for each token that more lines share
WINDOW = 4096  # earlier lines that these are chosen from
LOOKED_UP = 50_000  # pairs whose documents are picked by a broadcast of their ids
OFTEN = 16  # on the scale of the rarity: from twice the mean counter on, a token's lines go with their parities
BITS = [f"bits{i}" for i in range(4)]  # parities of a line's tokens by a hash of each, 64 in each column
ROWS = "kind int, token long, doc long, line int, n int, at int, other_doc long, other_line int, " + ", ".join(f"{b} long" for b in BITS)
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), *(pa.int64() for _ in BITS))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line (counted over all texts) and hash of every shingle, or of the words of a line too short for one; and the number of each text's first line."""
    data = b"\n".join(texts)
    start, found = word_hashes(data)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    begin = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    first = np.searchsorted(ends, begin[:-1])
    of = np.searchsorted(ends, start)
    lines, runs = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if (size := len(found) - SHINGLE + 1) > 0:
        runs = mix(sum((found[i : size + i] * _ODD[i] for i in range(SHINGLE)), U(0)))
        inside = of[:size] == of[SHINGLE - 1 :]
        lines, runs = of[:size][inside], runs[inside]
    if len(found):
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        n = np.diff(np.r_[begin, len(of)])
        begin, n = begin[n < SHINGLE], n[n < SHINGLE]
        whole = n.astype(np.uint64) * U(77)
        for i in range(SHINGLE - 1):
            whole[n > i] += found[begin[n > i] + i] * _ODD[i]
        lines, runs = np.r_[lines, of[begin]], np.r_[runs, mix(whole)]
    return lines, runs, first


def line_tokens(texts: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and line number of each line that has tokens; line (its place in these) and hash of each distinct token, by line.

    Tokens of a line are in the order of their hashes, or with ``counts`` of rarity and then of their hashes.
    """
    of, runs, first = shingles(texts)
    if not len(of):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    key = runs if counts is None else counts[(runs & U(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << U(56) | runs >> U(8)
    lines, place = np.unique(of, return_inverse=True)
    order = np.argsort(key)
    order = order[np.argsort(place[order].astype(np.uint16 if len(lines) < 1 << 16 else np.int64), kind="stable")]  # small numbers are sorted by radix
    place, runs = place[order], runs[order]
    fresh = np.r_[True, (place[1:] != place[:-1]) | (runs[1:] != runs[:-1])]
    text = np.searchsorted(first, lines, side="right") - 1
    return text, lines - first[text], place[fresh], runs[fresh]


def parities(token: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each set, which begin at ``begin``, 4 numbers of 64 bits: no more of them differ between two sets than tokens do."""
    place = mix(token ^ U(0x3C6EF372FE94F82B))
    bit = U(1) << (place & U(63))
    return np.stack([np.bitwise_xor.reduceat(np.where(place >> U(62) == U(i), bit, U(0)), begin) for i in range(len(BITS))], axis=1)


def may_match(n: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the lengths of sets x and y, and the places of a token that they share, leave room for a match."""
    least = -(-3 * (n[x] + n[y]) // 7)
    return (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])) & (np.minimum(n[x] - at[x], n[y] - at[y]) >= least)


def nearest(first: np.ndarray, length: np.ndarray, n: np.ndarray, at: np.ndarray, parity: np.ndarray, bits: np.ndarray, keep: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (earlier, later) of each posting of these runs with the ``keep`` of the ``window`` before it that it may match and whose parities differ least; and the postings with others to try.

    A run is the postings of a token in the order of their lines; ``parity[bits]`` are those of the postings. One that doesn't differ at all is enough.
    """
    rank = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    posting = np.repeat(first, length) + rank
    tried = np.minimum(rank, window)
    xs, ys, left = [], [], [posting[rank > window]]
    for some in np.split(np.arange(len(posting)), np.flatnonzero(np.diff(np.cumsum(tried) >> 18)) + 1):
        y = np.repeat(posting[some], tried[some])
        x = y - 1 - np.arange(len(y)) + np.repeat(np.cumsum(tried[some]) - tried[some], tried[some])
        fits = may_match(n, at, x, y)
        x, y = x[fits], y[fits]
        differ = np.bitwise_count(parity[bits[x]] ^ parity[bits[y]]).sum(axis=1).astype(np.int64)
        fits = 7 * differ <= n[x] + n[y]
        x, y, differ = x[fits], y[fits], differ[fits]
        order = np.lexsort((x, differ, y))
        x, y, differ = x[order], y[order], differ[order]
        begin = np.flatnonzero(np.r_[True, y[1:] != y[:-1]][: len(y)])
        count = np.diff(np.r_[begin, len(y)])
        place = np.arange(len(y)) - np.repeat(begin, count)
        taken = (place < keep) & ((place == 0) | (np.repeat(differ[begin], count) > 0))
        xs.append(x[taken])
        ys.append(y[taken])
        left.append(y[~taken])
    return np.concatenate(xs), np.concatenate(ys), np.unique(np.concatenate(left))


def sketch(docs: DataFrame) -> np.ndarray:
    return rarity(docs, lambda batches: (shingles(texts)[1] for _, texts in blocks(batches)))


def index(docs: DataFrame, counts: np.ndarray, parts: int) -> DataFrame:
    """Prefix tokens (kind 0; kind 3, with the set's parities, where a token is frequent) and set hashes (kind 1) of the lines, each set once for each block, and what equals a line of its block (kind 2)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # SKETCH bytes

    def rows(kind: int, batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([kind] * batch.num_rows, pa.int32()), batch.column(0), batch.column(1)], ["kind", "to", "blob"])

    def indexed(batches):
        counts = shared.value
        for ids, texts in blocks(batches):
            text, number, line, token = line_tokens(texts, counts)
            if not len(text):
                continue
            ids = np.array(ids, np.int64)
            n = np.bincount(line)
            begin = np.cumsum(n) - n
            key = mix(np.add.reduceat(mix(token ^ U(0x5DEECE66D)), begin) + n.astype(np.uint64))
            order = np.lexsort((number, ids[text], key))
            fresh = np.r_[True, key[order][1:] != key[order][:-1]]
            first = np.zeros(len(n), bool)
            first[order[fresh]] = True
            leader = order[fresh][np.cumsum(fresh) - 1]
            lost = order[~fresh]
            head = leader[~fresh]
            own = [ids]
            yield from rows(2, pack(parts, ids[text[lost]].astype(np.uint64), text[lost], own, [number[lost].astype(np.int32), ids[text[head]], number[head].astype(np.int32)]))
            kept = np.flatnonzero(first)
            yield from rows(1, pack(parts, key[kept], text[kept], own, [key[kept], number[kept].astype(np.int32)]))
            at = np.arange(len(line)) - begin[line]
            prefix = n - (3 * n + 3) // 4 + 1
            chosen = (at < prefix[line]) & first[line] & (n[line] > 1)
            often = chosen & (counts[(token & U(SKETCH - 1)).astype(np.int64)] >= OFTEN)
            for kind, some in ((0, chosen & ~often), (3, often)):
                of = line[some]
                fields = [token[some], at[some].astype(np.uint16), np.minimum(n[of], 1 << 30).astype(np.int32), number[of].astype(np.int32)]
                if kind == 3 and len(of):
                    these = np.zeros(len(n), bool)
                    these[of] = True
                    fields += [*parities(token[these[line]], np.cumsum(n[these]) - n[these])[np.cumsum(these)[of] - 1].T]
                yield from rows(kind, pack(parts, token[some], text[of], own, fields))

    return docs.mapInArrow(indexed, "kind int, to int, blob binary").repartitionById(parts, F.col("to"))


def _batch(kind: int | np.ndarray, **columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in ROWS.split(", ")]
    n = len(next(iter(columns.values())))
    columns["kind"] = np.full(n, kind)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(columns.get(c, np.zeros(n))).astype(np.int64), pa.int64()).cast(t, safe=False) for c, t in zip(names, _TYPES, strict=True)], names)


def candidates(indexed: DataFrame) -> DataFrame:
    """kind 0: a line that equals an earlier one; kind 1: a line (doc, line) and an earlier one to try; kind 2 and 3: a posting of a token that many share, 3 if its line has more earlier ones to try."""

    def found(batches):
        kept: dict[int, list[bytes]] = {0: [], 1: [], 2: [], 3: []}
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept[kind].append(blob)
        (ids,), owner, (line, _, _) = packed(kept[2], ["i8"], ["i4", "i8", "i4"])
        yield _batch(0, doc=ids[owner], line=line)
        (ids,), owner, (key, line) = packed(kept[1], ["i8"], ["u8", "i4"])
        doc = ids[owner]
        order = np.lexsort((line, doc, key))
        again = np.r_[False, key[order][1:] == key[order][:-1]][: len(order)]
        yield _batch(0, doc=doc[order][again], line=line[order][again])
        (ids,), owner, (token, at, n, line) = packed(kept[0], ["i8"], ["u8", "u2", "i4", "i4"])
        (more_ids,), more_owner, more = packed(kept[3], ["i8"], ["u8", "u2", "i4", "i4", *["u8"] * len(BITS)])
        kept.clear()
        rare = len(token)  # those from here on have parities, the others zeros; a token's are all of one kind
        parity = np.vstack([np.zeros((1, len(BITS)), np.uint64), np.stack(more[4:], axis=1)])
        doc = np.r_[ids[owner], more_ids[more_owner]]
        token, at, n, line = (np.concatenate(x) for x in zip((token, at, n, line), more[:4], strict=True))
        order = np.lexsort((line, doc, token))
        token, at, n, line, doc = (x[order] for x in (token, at.astype(np.int64), n.astype(np.int64), line, doc))
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
        length = np.diff(np.r_[first, len(token)])
        x, y = [], []
        for k in range(2, FEW + 1):
            runs = first[length == k]
            for j in range(1, k):
                x += [runs + i for i in range(j)]
                y += [runs + j] * j
        many = first[length > FEW], length[length > FEW]
        if len(many[0]):
            own = np.maximum(order - rare + 1, 0)
            near, later, more = nearest(*many, n, at, parity, own, NEAREST, WINDOW)
            x.append(near)
            y.append(later)
            of = np.zeros(len(token), np.int64)
            of[more] = 1
            hot = np.concatenate([np.arange(a, a + k) if of[a : a + k].any() else np.zeros(0, np.int64) for a, k in zip(*many, strict=True)])
            bits = dict(zip(BITS, parity[own[hot]].T.copy().view(np.int64), strict=True))
            yield _batch(2 + of[hot], token=token[hot].view(np.int64), doc=doc[hot], line=line[hot], n=n[hot], at=at[hot], **bits)
        if x:
            x, y = np.concatenate(x), np.concatenate(y)
            fits = may_match(n, at, x, y)
            pair = np.unique(np.c_[doc[y[fits]], line[y[fits]], doc[x[fits]], line[x[fits]]], axis=0)
            yield _batch(1, doc=pair[:, 0], line=pair[:, 1], other_doc=pair[:, 2], other_line=pair[:, 3])

    def batched(batches):
        for got in found(batches):
            for start in range(0, got.num_rows, 1 << 16):
                yield got.slice(start, 1 << 16)

    return indexed.mapInArrow(batched, ROWS)


def wanted_sets(docs: list[int], texts: list[str | None], wanted: list[list]) -> Iterator[tuple]:
    """hub_doc, hub_line, salt, doc, line and the tokens of each wanted line that has some; only wanted lines are looked at, those of many documents at once."""
    lines, asked, size = [], [], 0
    for k, (doc, text, some) in enumerate(zip(docs, texts, wanted, strict=True)):
        parts = (text or "").encode("utf-8", "replace").split(b"\n")
        place = {n: len(lines) + i for i, n in enumerate({w["line"] for w in some if w["line"] < len(parts)})}
        lines += [parts[n] for n in place]
        size += sum(len(parts[n]) for n in place)
        asked += [(place[w["line"]], w["hub_doc"], w["hub_line"], w["salt"], doc, w["line"]) for w in some if w["line"] in place]
        if size >= BLOCK or k == len(docs) - 1:
            of, _, line, token = line_tokens(lines)
            cuts = np.searchsorted(line, np.arange(len(of) + 1)).tolist()
            own = {n: token[cuts[i] : cuts[i + 1]].tobytes() for i, n in enumerate(of.tolist())}
            yield from ((*row, own[n]) for n, *row in asked if n in own)
            lines, asked, size = [], [], 0


def verify(docs: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """doc, line of the pairs (doc, line, other_doc, other_line) that are at least 0.75 alike; a line with many partners is salted."""
    hub = [F.col("other_doc").alias("hub_doc"), F.col("other_line").alias("hub_line")]
    salted = pairs.withColumn("salt", F.pmod(F.hash("doc", "line"), F.lit(64)))
    wanted = salted.select("doc", "line", *hub, "salt").unionByName(salted.select(F.col("other_doc").alias("doc"), F.col("other_line").alias("line"), *hub, "salt").distinct())
    wanted = wanted.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("line", "hub_doc", "hub_line", "salt")).alias("wanted"))
    texts = docs.join(wanted.hint("shuffle_hash"), "doc_id")  # texts needn't be sorted
    schema = "hub_doc long, hub_line int, salt int, doc long, line int, own binary"
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())

    def sets(batches):
        for batch in batches:
            rows = list(wanted_sets(*(batch.column(i).to_pylist() for i in range(3))))
            for start in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[start : start + 1024]], t) for i, t in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])

    def compared(batches):
        of, centres = None, []
        for batch in batches:
            out = []
            for hub_doc, hub_line, salt, doc, line, own in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                own = np.frombuffer(own, np.uint64)
                if of != (hub_doc, hub_line, salt):
                    of, centres = (hub_doc, hub_line, salt), []
                if (doc, line) == (hub_doc, hub_line):
                    centres.append(own)
                    continue
                for centre in centres:
                    both = int((centre[np.minimum(np.searchsorted(centre, own), len(centre) - 1)] == own).sum())
                    if 100 * both >= 75 * (len(centre) + len(own) - both):
                        out.append((doc, line))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32())], ["doc", "line"])

    spread = texts.select("doc_id", "text", "wanted").mapInArrow(sets, schema).repartition(parts, "hub_doc", "hub_line", "salt")
    own_last = (F.col("doc") != F.col("hub_doc")) | (F.col("line") != F.col("hub_line"))
    return spread.sortWithinPartitions("hub_doc", "hub_line", "salt", own_last).mapInArrow(compared, "doc long, line int")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc, line (from 0): every line that an earlier one matches. ``docs``: doc_id, each once, and text."""
    prepare(docs.sparkSession)
    parts = partitions(docs.sparkSession, docs)
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    found = cut(candidates(index(docs, sketch(docs), parts)))
    equal = found.where("kind = 0").select("doc", "line")
    copies = equal.distinct()
    pairs = found.where("kind = 1").select("doc", "line", "other_doc", "other_line").distinct()
    pairs = cut(pairs.join(copies, ["doc", "line"], "left_anti"))
    matched = cut(verify(docs, pairs, parts).unionByName(equal).distinct())
    many = found.where("kind >= 2").join(copies, ["doc", "line"], "left_anti")  # what matches a copy matches the first one
    open_lines = many.where("kind = 3").select("token", "doc", "line", "n", "at", *BITS).join(matched, ["doc", "line"], "left_anti")
    x = many.select("token", F.col("doc").alias("other_doc"), F.col("line").alias("other_line"), F.col("n").alias("m"), F.col("at").alias("other_at"), *(F.col(b).alias(f"other_{b}") for b in BITS))
    earlier = F.struct("other_doc", "other_line") < F.struct("doc", "line")
    fits = (4 * F.least("n", "m") >= 3 * F.greatest("n", "m")) & (7 * F.least(F.col("n") - F.col("at"), F.col("m") - F.col("other_at")) >= 3 * (F.col("n") + F.col("m")))
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"other_{b}"))) for b in BITS), F.lit(0))  # at most as many tokens as are in one set only, a seventh of both where sets match
    more = open_lines.join(x, "token").where(earlier & fits & (7 * differ <= F.col("n") + F.col("m"))).select("doc", "line", "other_doc", "other_line").distinct()
    more = cut(more.join(pairs, ["doc", "line", "other_doc", "other_line"], "left_anti"))
    if not (n := more.count()):
        return matched
    if n <= LOOKED_UP:
        docs = docs.join(F.broadcast(more.select(F.explode(F.array("doc", "other_doc")).alias("doc_id")).distinct()), "doc_id", "left_semi")
    return cut(matched.unionByName(verify(docs, more, parts)).distinct())


def without_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``ROW``, text, n_lines and n_removed of ``rows`` (NODE, text, ROW), with the lines (doc, line) removed from the text."""
    gone = lines.groupBy(F.col("doc").alias(NODE)).agg(F.array_sort(F.collect_list("line")).alias("gone"))
    rows = rows.join(gone.hint("shuffle_hash"), NODE, "left").withColumn("lines", F.split("text", "\n", -1))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i)), "\n")
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return rows.select(ROW, F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"), count("lines").alias("n_lines"), count("gone").alias("n_removed"))


def _deduplicated(docs: DataFrame) -> DataFrame:
    rows = numbered(sealed(docs))[0]
    return without_lines(rows, repeated_lines(rows.select(F.col(NODE).alias("doc_id"), "text")))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) without repeated lines, and n_lines, n_removed."""
    kept = [F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    return _deduplicated(docs).select(*kept, "text", "n_lines", "n_removed")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...), all columns, without repeated lines; a row that has lost its last line with a word goes."""
    found = _deduplicated(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return opened(found, docs.columns)
