"""Byte trigrams of lines and label pairs of rows: what a segment may hold, for skipping those that can't match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .predicates import lowered

MOST_TRIGRAMS = 200_000  # of a segment; more say little, so it is scanned
CHUNK = 1 << 20  # bytes of lines whose trigrams are worked out at a time
REMEMBERED = 100_000  # keys and pairs that a task knows it has said
_LOWER = np.arange(256, dtype=np.int32)
_LOWER[65:91] += 32


def trigrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of three bytes of the lowered lines ``data[offsets[i]:offsets[i + 1]]``, as b0 << 16 | b1 << 8 | b2, CHUNK places at a time."""
    ends = offsets[1:]
    for start in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        b = _LOWER[data[start : min(start + CHUNK + 2, int(offsets[-1]))]]
        if len(b) < 3:
            return
        inside = np.ones(len(b), bool)
        near = ends[np.searchsorted(ends, start) : np.searchsorted(ends, start + len(b), side="right")] - start
        for back in (1, 2):  # the last two bytes of a line begin none
            inside[near[near >= back] - back] = False
        yield ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])[inside[:-2]]


class _Seen:
    """Trigrams of the id that a task is at; those of other ids are forgotten, and said again."""

    def __init__(self):
        self.at, self.known, self.said = object(), np.zeros(1 << 24, bool), []

    def fresh(self, of, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if of != self.at:
            for numbers in self.said:
                self.known[numbers] = False
            self.at, self.said = of, []
        before = len(self.said)
        for found in trigrams(data, offsets):
            numbers = np.unique(found[~self.known[found]])
            self.known[numbers] = True
            self.said.append(numbers)
        return np.concatenate([np.zeros(0, np.int32), *self.said[before:]])


def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, kind, text, numbers of rows (id, labels, line): label keys (kind 0), label pairs (1), trigrams of lines (2). Few are said more than once by a task."""
    seen, said = _Seen(), set()
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).dictionary_encode(null_encoding="encode")
        code = ids.indices.to_numpy(zero_copy_only=False)
        if (np.diff(code) < 0).any():
            order = np.argsort(code, kind="stable")
            batch, code = batch.take(pa.array(order)), code[order]
        names = ids.dictionary.to_pylist()
        out = []  # place among the names, kind, text, numbers
        labels = batch.column(1)
        bounds = labels.offsets.to_numpy()
        keys, values = (x.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode(null_encoding="encode") for x in (labels.keys, labels.items))
        of = np.repeat(code, np.diff(bounds)).astype(np.int64)
        k, v = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (keys, values))
        many = max(1, len(values.dictionary))
        entry, where = np.unique(k * many + v, return_inverse=True)
        names_of = (keys.dictionary.to_pylist(), values.dictionary.to_pylist())
        for both in np.unique(of * max(1, len(entry)) + where).tolist():
            place, e = divmod(both, len(entry))
            key, value = (x[i] for x, i in zip(names_of, divmod(int(entry[e]), many), strict=True))
            for kind, text in ((0, key), (1, None if value is None else label_pair(key, value))):
                if text is not None and (what := (names[place], kind, text)) not in said:
                    said.add(what)
                    out.append((place, kind, text, None))
        if len(said) > REMEMBERED:
            said.clear()
        lines = batch.column(2).cast(pa.large_binary())
        _, offsets, data = lines.buffers()
        offsets = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(code)], strict=True):
            if len(numbers := seen.fresh(names[code[a]], data, offsets[a : b + 1])):
                out.append((int(code[a]), 2, None, numbers))
        if out:
            numbers = [n if n is not None else np.zeros(0, np.int32) for *_, n in out]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, numbers)]), pa.int32()), pa.array(np.concatenate(numbers).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array([o[0] for o in out])), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string()), lists], ["id", "kind", "text", "numbers"])


def keyword_trigrams(keyword: str) -> list[int]:
    data = lowered(keyword).encode("utf-8", "surrogatepass")
    return sorted({int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2)})


def label_pair(key: str, value: str) -> str:
    return f"{key}\0{value}"
