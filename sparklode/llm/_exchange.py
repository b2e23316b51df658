"""Exchange of packed arrays: what would be many millions of tiny rows goes through the shuffle as a few large binaries.

A map task hands records (an array for each field, and a 64-bit key) to ``deal``, which yields a row (to, blob) for each reduce
partition; ``collected`` in the reduce task gives all records of its partition back as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = "to int, blob binary"


def deal(key: np.ndarray, fields: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows for the reduce partitions; records of equal key meet in one."""
    if not len(key):
        return
    to = (key % np.uint64(parts)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(parts + 1))
    fields = [f[order] for f in fields]
    rows = [(p, b"".join([int(b - a).to_bytes(8, "little"), *(f[a:b].tobytes() for f in fields)])) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
    for start in range(0, len(rows), 64):
        some = rows[start : start + 64]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.binary())], ["to", "blob"])


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """The rows of ``deal``, each in the partition that it names."""
    return df.repartitionById(parts, F.col("to"))


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def collected(batches, kinds: list[str]) -> list[np.ndarray]:
    """All records of a reduce partition, an array for each field."""
    found = [unpack(blob, kinds) for batch in batches for blob in batch.column("blob").to_pylist()]
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, k) for k in kinds]


def _place(owners: int) -> str:
    """Type of the place of one of so many owners."""
    return "u2" if owners <= 1 << 16 else "u4"


def pack(parts: int, key: np.ndarray, owner: np.ndarray, about: list[np.ndarray], fields: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (to, blob) for the reduce partitions; a blob has what is said about the owners of its records once, not for each record."""
    to = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(parts + 1)).tolist()
    owner, fields = owner[order], [f[order] for f in fields]
    tos, blobs = [], []
    for p in range(parts):
        a, b = cuts[p], cuts[p + 1]
        if b > a:
            here, place = np.unique(owner[a:b], return_inverse=True)
            tos.append(p)
            blobs.append(b"".join([np.array([len(here), b - a], np.int64).tobytes(), *(x[here].tobytes() for x in about), place.astype(_place(len(here))).tobytes(), *(f[a:b].tobytes() for f in fields)]))
        if blobs and (len(blobs) == 32 or p == parts - 1):
            yield pa.RecordBatch.from_arrays([pa.array(tos, pa.int32()), pa.array(blobs, pa.binary())], ["to", "blob"])
            tos, blobs = [], []
    if blobs:
        yield pa.RecordBatch.from_arrays([pa.array(tos, pa.int32()), pa.array(blobs, pa.binary())], ["to", "blob"])


def packed(blobs: list[bytes], about: list[str], fields: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """What ``pack`` was given, of all blobs together: about, owner, fields."""
    tables, owners, columns, base = [], [], [], 0
    for blob in blobs:
        k, n = np.frombuffer(blob, np.int64, 2).tolist()
        at, got = 16, []
        for kind, size in [*((a, k) for a in about), (_place(k), n), *((f, n) for f in fields)]:
            got.append(np.frombuffer(blob, kind, size, at))
            at += size * np.dtype(kind).itemsize
        tables.append(got[: len(about)])
        owners.append(got[len(about)].astype(np.int64) + base)
        columns.append(got[len(about) + 1 :])
        base += k
    if not blobs:
        return [np.zeros(0, a) for a in about], np.zeros(0, np.int64), [np.zeros(0, f) for f in fields]
    return [np.concatenate(x) for x in zip(*tables)], np.concatenate(owners), [np.concatenate(x) for x in zip(*columns)]
