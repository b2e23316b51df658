"""Compaction: many small flush files become one segment, sorted by time, in one step of the catalog."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from .catalog import Conflict
from .pruning import describe
from .search import scan
from .store import LEVELS, Store, catalog_rows, segment_name

MIN_FILES, MAX_FILES = 8, 128
ROWS_PER_FILE, BYTES_PER_FILE = 1_000_000, 64 << 20  # of a segment; a task sorts the rows of one file, and BYTES_PER_FILE are of flush files


def limits(min_files: int = MIN_FILES, max_files: int = MAX_FILES) -> tuple[int, int]:
    """A least number under 2, and a largest under the least, are set to the defaults."""
    low = min_files if min_files > 1 else MIN_FILES
    return low, max_files if max_files >= low else MAX_FILES


def compact(store: Store, min_files: int = MIN_FILES, max_files: int = MAX_FILES, now: int | None = None, below: int | None = None) -> str | None:
    """Merge the oldest flush files into a segment; its id, or None if there are too few. With ``below`` only batches of smaller numbers are merged.

    Rows are dealt by ranges of time (and of row_id where times are equal), one for each ROWS_PER_FILE rows or BYTES_PER_FILE bytes, and sorted within, so what
    a task sorts doesn't grow with the input, and a segment's files and row groups have narrow bounds. Readers go by the
    catalog, which swaps the sources for the segment at once: rows are never seen twice, and never missing, as the sources' files stay for the
    store's grace time for searches that were planned before. The swap takes place only if the segment has as many rows as its
    sources and no other compaction has taken one of them meanwhile; else this one's segment is dropped and the result is None.
    """
    low, high = limits(min_files, max_files)
    flushed = store.catalog.read().where("kind = 'flush'")
    if below is not None:
        flushed = flushed.where(F.substring_index("id", "-", -1).cast("long") < below)
    found = flushed.orderBy("min_timestamp", "id").limit(high).select("id", "local_path", "row_count", "label_keys").collect()
    if len(found) < low:
        return None
    now = time.time_ns() if now is None else now
    rows = sum(r["row_count"] or 0 for r in found)
    beside = f"{store.root}/segments/.partial-{now}-{uuid.uuid4().hex[:8]}"
    logs = scan(store.spark, [r["local_path"] for r in found])
    size = sum(store.files.size(r["local_path"]) for r in found)
    files = max(1, -(-rows // ROWS_PER_FILE), -(-size // BYTES_PER_FILE))
    written, first, last = store.write(logs.repartitionByRange(files, "timestamp", "row_id").sortWithinPartitions("timestamp", "row_id"), beside, LEVELS["best"])
    if written != rows:
        raise OSError(f"{written} of {rows} rows were read from the flush files")
    name = segment_name(first, last, now)
    store.move(beside, path := f"{store.root}/segments/{name}", rows)
    described = describe(scan(store.spark, [path]).withColumn("id", F.lit(name)))
    described = store.spark.createDataFrame([(name,)], "id string").join(described, "id", "left")
    keys = sorted({k for r in found for k in r["label_keys"] or ()})
    added = catalog_rows(described, "segment", F.lit(path), F.lit(now)).withColumn("label_keys", F.array(*map(F.lit, keys)).cast("array<string>"))
    ids = [r["id"] for r in found]
    try:
        store.catalog.change(add=added, remove=ids, needed=ids, trash=[r["local_path"] for r in found], ids=[name])
    except Conflict:
        store.files.delete(path)
        return None
    return name


def reconcile(store: Store) -> None:
    """Make the catalog agree with the segments on disk: add those it lacks, drop local rows whose files have gone, note local copies.

    Remote rows stay, and a remote segment doesn't become local again. Added rows count as sealed at 0, so they may be rotated at once.
    """
    folder = f"{store.root}/segments"
    disk = [n for n in store.files.names(folder) if n.startswith("segment-")]  # moved there as a whole; unfinished ones have other names
    listed = store.spark.createDataFrame([(n, f"{folder}/{n}") for n in disk], "id string, path string")
    known = store.catalog.read(False).select("id", "location", "local_path")
    missing = [r["id"] for r in listed.join(known, "id", "left_anti").collect()]
    gone = [r["id"] for r in known.where("location = 'local'").join(listed, "id", "left_anti").collect()]
    regained = {r["id"]: r["path"] for r in known.where("local_path is null").join(listed, "id").collect()}
    if missing:
        logs = None
        for n in missing:
            one = scan(store.spark, [f"{folder}/{n}"]).withColumn("id", F.lit(n))
            logs = one if logs is None else logs.unionByName(one)
        rows = store.spark.createDataFrame([(n,) for n in missing], "id string").join(describe(logs), "id", "left")
        store.catalog.upsert(catalog_rows(rows, "segment", F.concat(F.lit(f"{folder}/"), F.col("id")), F.lit(0)))
    if gone:
        store.catalog.remove(*gone)
    if regained:
        store.catalog.set_local_path(regained)
