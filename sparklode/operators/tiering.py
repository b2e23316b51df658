"""Tiering: old segments move to the remote root; their local copies go after a grace time; the catalog can be rebuilt from a listing."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..sources.schema import CATALOG_SCHEMA
from .pruning import describe
from .search import scan
from .store import Store, parse_bounds

ROTATE_AFTER, GRACE = 24 * 3600 * 10**9, 3600 * 10**9  # nanoseconds


def rotate(store: Store, age: int = ROTATE_AFTER, now: int | None = None) -> tuple[int, list[str]]:
    """Copy local segments sealed at least ``age`` ago and flip them to remote once the copy has the size of the original.

    How many were rotated, and why others were not: those stay local for the next time.
    """
    now = time.time_ns() if now is None else now
    urls, failed = {}, []
    for r in store.catalog.to_rotate(now - max(0, age)).select("id", "local_path").collect():
        target = f"{store.remote_root}/{r['id']}"
        try:
            size = store.files.size(r["local_path"])
            if size < 0:
                raise FileNotFoundError(r["local_path"])
            beside = f"{store.remote_root}/.partial-{r['id']}"  # a listing never shows a part of a segment under its name
            store.files.delete(beside)
            store.files.copy(r["local_path"], beside)
            if (copied := store.files.size(beside)) != size:
                raise OSError(f"{copied} of {size} bytes arrived")
            store.files.delete(target)  # of an attempt that ended before the catalog knew of it
            store.files.rename(beside, target)
            urls[r["id"]] = target
        except Exception as error:  # noqa: BLE001  one segment's trouble doesn't keep others from moving
            failed.append(f"{r['id']}: {error}")
    if urls:
        store.catalog.mark_remote(urls, now)
    return len(urls), failed


def sweep(store: Store, grace: int = GRACE, now: int | None = None) -> int:
    """Delete local copies of segments uploaded at least ``grace`` ago."""
    now = time.time_ns() if now is None else now
    rows = store.catalog.to_sweep(now - max(0, grace)).select("id", "local_path").collect()
    if rows:  # the catalog first: searches planned before still read the local copies, for the store's grace time
        store.catalog.clear_local_path(*(r["id"] for r in rows), trash=[r["local_path"] for r in rows])
    return len(rows)


def reconcile_remote(store: Store, backfill: bool = False) -> int:
    """Catalog remote segments that it lacks from their names; how many. Only names without bounds are opened, or all with ``backfill``.

    Rows made from a name have row_count 0 and no keys or filters, so they are always scanned within their bounds.
    """
    names = [n for n in store.files.names(store.remote_root) if n.startswith("segment-")]
    listed = store.spark.createDataFrame([(n,) for n in names], "id string")
    missing = [r["id"] for r in listed.join(store.catalog.read(False), "id", "left_anti").collect()]
    bare = {n: parse_bounds(n) for n in missing}
    rows = [(n, "segment", "remote", None, f"{store.remote_root}/{n}", b[0], b[1], 0, [], 0, 0, None, None) for n, b in bare.items() if b and not backfill]
    added = store.spark.createDataFrame(rows, CATALOG_SCHEMA)
    opened = [n for n, b in bare.items() if backfill or not b]
    for n in opened:
        said = describe(scan(store.spark, [f"{store.remote_root}/{n}"]).withColumn("id", F.lit(n)))
        rest = {"kind": F.lit("segment"), "location": F.lit("remote"), "local_path": F.lit(None).cast("string"), "remote_url": F.lit(f"{store.remote_root}/{n}"), "sealed_at": F.lit(0).cast("long"), "uploaded_at": F.lit(0).cast("long")}
        added = added.unionByName(said.withColumns(rest).select(*CATALOG_SCHEMA.fieldNames()))
    if missing:
        store.catalog.upsert(added)
    return len(missing)
