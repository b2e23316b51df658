"""The catalog: one row for each flush file and segment, kept as immutable parts of Parquet and numbered versions that list them.

A version says which parts make up the catalog and which ids of each no longer hold. A change writes a part with its own rows only, then creates
the next version's file, which fails if another writer was first; the change is then made again upon that writer's version. So no
change is lost, a reader sees the state before or after and nothing between, and rows with large filters aren't written again by
every change: parts are merged now and then, small ones first. Files that a change has put out of use are deleted
by a later one, GRACE after, when no reader that was planned before can need them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import Files
from ..sources.schema import CATALOG_SCHEMA

MOST_PARTS = 16
GRACE = 3600.0  # seconds that files out of use are kept
ATTEMPTS = 100
KEPT_VERSIONS, KEPT_SECONDS = 64, 600.0


class Conflict(RuntimeError):
    """Another writer has changed the rows that a change builds upon."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str, grace: float = GRACE):
        self.spark, self.root, self.files, self.grace = spark, root.rstrip("/"), Files(spark), grace

    @property
    def folder(self) -> str:
        return f"{self.root}/catalog"

    def _version(self) -> tuple[int, dict]:
        """Number and content of the current version."""
        while names := [n for n in self.files.names(self.folder) if n.startswith("version-")]:
            if text := self.files.read(f"{self.folder}/{names[-1]}"):
                return int(names[-1].split("-")[1]), json.loads(text)
        return 0, {"parts": [], "trash": [], "recent": []}

    def _read(self, parts: list[dict]) -> DataFrame:
        rows = None
        for part in parts:
            some = self.spark.read.schema(CATALOG_SCHEMA).parquet(f"{self.folder}/{part['name']}")
            some = some.where(~F.col("id").isin(part["gone"])) if part["gone"] else some
            rows = some if rows is None else rows.unionByName(some)
        return self.spark.createDataFrame([], CATALOG_SCHEMA) if rows is None else rows

    def read(self, all_kinds: bool = True) -> DataFrame:
        """Rows of the current version; columns that an older part lacks are null."""
        rows = self._read(self._version()[1]["parts"])
        return rows if all_kinds else rows.where("kind = 'segment'")

    def _write(self, rows: DataFrame, ids: Iterable[str] | None = None) -> dict:
        """A part of ``rows``: its name, their ids, and which of them no longer hold."""
        name = f"part-{uuid.uuid4().hex}"
        rows.select(*CATALOG_SCHEMA.fieldNames()).coalesce(1).write.parquet(f"{self.folder}/{name}")
        ids = [r["id"] for r in self.spark.read.parquet(f"{self.folder}/{name}").select("id").collect()] if ids is None else ids
        return {"name": name, "ids": sorted(ids), "gone": []}

    def change(self, add: DataFrame | Callable[[DataFrame], DataFrame] | None = None, remove: Iterable[str] = (), needed: Iterable[str] = (), trash: Iterable[str] = (), ids: Iterable[str] | None = None) -> None:
        """Remove rows by id and add rows, replacing those of the same id, in one step.

        ``add`` may be made from the rows there are; ``ids`` are those of its rows, where they are known. Rows named by ``needed`` have to be there still, or the change is a Conflict and
        nothing is done. The paths in ``trash`` are deleted by a change after the grace time.
        """
        remove, needed, trash = set(remove), set(needed), list(trash)
        fixed = self._write(add, ids) if add is not None and not callable(add) else None
        for _ in range(ATTEMPTS):
            number, version = self._version()
            parts, now, commit = version["parts"], time.time(), uuid.uuid4().hex
            if lost := needed - {i for p in parts for i in p["ids"] if i not in p["gone"]}:
                raise Conflict(f"no longer in the catalog: {sorted(lost)}")
            part = fixed or (self._write(add(self._read(parts))) if add is not None else None)
            out = remove | set(part["ids"] if part else ())
            parts = [p | {"gone": sorted({*p["gone"], *out.intersection(p["ids"])})} for p in parts]
            kept = self._merged([*(p for p in parts if len(p["gone"]) < len(p["ids"])), *([part] if part and part["ids"] else [])])
            names = {p["name"] for p in kept}
            idle = [f"{self.folder}/{p['name']}" for p in [*parts, *([part] if part else [])] if p["name"] not in names]
            due = [path for path, at in version["trash"] if at + self.grace <= now]
            for path in due:
                self.files.delete(path)
            waiting = [x for x in version["trash"] if x[0] not in due] + [[path, now] for path in (*trash, *idle)]
            text = json.dumps({"parts": kept, "trash": waiting, "recent": [*version["recent"], commit][-KEPT_VERSIONS:]})
            if self.files.create(f"{self.folder}/version-{number + 1:012d}", text) and self._holds(number + 1, commit):
                if number % KEPT_VERSIONS == 0:
                    self._clean(now)
                return
            for p in [*kept, *([part] if part and part is not fixed else [])]:
                if p is not fixed and p["name"] not in {q["name"] for q in parts}:  # written for this attempt only
                    self.files.delete(f"{self.folder}/{p['name']}")
            time.sleep(0.01)
        raise Conflict(f"{ATTEMPTS} other changes came first")

    def _holds(self, number: int, commit: str) -> bool:
        """Whether later versions build on this one. They don't where its number had been used and cleaned away while this writer stood still."""
        now, version = self._version()
        if now == number or commit in version["recent"]:
            return True
        self.files.delete(f"{self.folder}/version-{number:012d}")
        return False

    def _merged(self, parts: list[dict]) -> list[dict]:
        """Once there are too many parts, the last ones become one: so many that the part before them is larger than all of them."""
        if len(parts) <= MOST_PARTS:
            return parts
        live = [len(p["ids"]) - len(p["gone"]) for p in parts]
        at, size = len(parts) - 1, live[-1]
        while at and (live[at - 1] <= size or at > MOST_PARTS // 2):
            at -= 1
            size += live[at]
        return [*parts[:at], self._write(self._read(parts[at:]))]

    def _clean(self, now: float) -> None:
        """Delete versions that are neither recent in number nor in time."""
        ages = {n: age for n, age in self.files.ages(self.folder, now).items() if n.startswith("version-")}
        for name in sorted(ages)[:-KEPT_VERSIONS]:
            if ages[name] > KEPT_SECONDS:
                self.files.delete(f"{self.folder}/{name}")

    def purge(self) -> None:
        """Delete what has been out of use for the grace time."""
        self.change()

    def upsert(self, rows: DataFrame) -> None:
        self.change(add=rows)

    def remove(self, *ids: str) -> None:
        self.change(remove=ids)

    def _set(self, ids: Iterable[str], trash: Iterable[str] = (), **values) -> None:
        hit = F.col("id").isin(list(ids))
        self.change(add=lambda rows: rows.where(hit).withColumns({k: v.cast(CATALOG_SCHEMA[k].dataType) for k, v in values.items()}), trash=trash)

    def mark_remote(self, urls: dict[str, str], at: int) -> None:
        url = F.create_map(*(F.lit(x) for pair in urls.items() for x in pair))
        self._set(urls, location=F.lit("remote"), remote_url=url[F.col("id")], uploaded_at=F.lit(at))

    def clear_local_path(self, *ids: str, trash: Iterable[str] = ()) -> None:
        self._set(ids, trash, local_path=F.lit(None).cast("string"))

    def set_local_path(self, paths: dict[str, str]) -> None:
        path = F.create_map(*(F.lit(x) for pair in paths.items() for x in pair))
        self._set(paths, local_path=path[F.col("id")])

    def segments(self) -> DataFrame:
        """Segments, the latest first."""
        return self.read(all_kinds=False).orderBy(F.desc("max_timestamp"), "id")

    def to_rotate(self, sealed_before: int) -> DataFrame:
        return self.read(False).where((F.col("location") == "local") & (F.col("sealed_at") <= sealed_before)).orderBy("sealed_at", "id")

    def to_sweep(self, uploaded_before: int) -> DataFrame:
        kept = (F.col("location") == "remote") & F.col("local_path").isNotNull() & (F.col("uploaded_at") <= uploaded_before)
        return self.read(False).where(kept).orderBy("uploaded_at", "id")

    def label_keys(self) -> DataFrame:
        """key: label keys of all flush files and segments, sorted; also keys whose rows were all rejected."""
        return self.read().select(F.explode("label_keys").alias("key")).distinct().orderBy("key")

    def stats(self) -> DataFrame:
        return stats(self.read(all_kinds=False))


def stats(segments: DataFrame) -> DataFrame:
    """One row: counts by location, rows, bounds. Without segments all are 0; a largest timestamp below 0 reads 0."""
    remote = F.count_if(F.col("location") == "remote")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return segments.agg(
        F.count("*").alias("segments_total"), (F.count("*") - remote).alias("segments_local"), remote.alias("segments_remote"),
        zero(F.sum("row_count")).alias("rows_total"), zero(F.min("min_timestamp")).alias("min_timestamp"), F.greatest(zero(F.max("max_timestamp")), F.lit(0)).alias("max_timestamp"),
    )
