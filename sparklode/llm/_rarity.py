"""How rare tokens are, by a sketch of fixed size: counts of tokens by hash. It orders tokens; it never decides what matches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._exchange import dealt
from ._words import U

SKETCH = 1 << 20  # counters


def rarity(df: DataFrame, hashes: Callable) -> np.ndarray:
    """Counts of the tokens of ``df`` on a scale of 256 steps, SKETCH of them whatever the corpus; ``hashes`` makes arrays of hashes of batches."""

    def counted(batches):
        total = np.zeros(SKETCH, np.int64)
        for found in hashes(batches):
            total += np.bincount((found & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        if not total.any():
            return
        total = np.minimum(total, (1 << 16) - 1).astype(np.uint16)
        for part in range(8):
            size = SKETCH // 8
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total[part * size : (part + 1) * size].tobytes()], pa.binary())], ["to", "blob"])

    def added(batches):
        total, part = np.zeros(SKETCH // 8, np.int64), None
        for batch in batches:
            for to, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.frombuffer(blob, np.uint16)
                part = to
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["to", "blob"])

    got = dealt(df.mapInArrow(counted, "to int, blob binary"), 8).mapInArrow(added, "to int, blob binary").collect()  # 8 rows of a fixed size
    total = np.zeros(SKETCH, np.int64)
    for r in got:
        total[r["to"] * (SKETCH // 8) : (r["to"] + 1) * (SKETCH // 8)] = np.frombuffer(r["blob"], np.int64)
    return np.minimum(255, 16 * np.log2(np.maximum(total / max(1.0, total.mean()), 1.0))).astype(np.uint8)
