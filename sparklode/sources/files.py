"""Files of the store by Spark's own file systems, so that a root may lie wherever Spark can read."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str | None) -> bool:
        if not path:
            return False
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        """Bytes of all files under a path, -1 if there is none."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else -1

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, source: str, target: str) -> None:
        """Move a file or folder; the target must not exist. What the file system reports as not done is an error."""
        fs, p = self._at(source)
        to = self.jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(p, to):
            raise OSError(f"{source} could not be renamed to {target}")

    def copy(self, source: str, target: str) -> None:
        (from_fs, p), (to_fs, q) = self._at(source), self._at(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, p, to_fs, q, False, True, self.conf)

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def present(self, paths: Iterable[str | None]) -> set[str]:
        """Those of the paths that exist, by one listing for each folder that they lie in."""
        folders: dict[str, set[str]] = {}
        for path in filter(None, paths):
            folder, _, name = path.rstrip("/").rpartition("/")
            folders.setdefault(folder, set()).add(name)
        return {f"{folder}/{name}" for folder, names in folders.items() for name in names.intersection(self.names(folder))}

    def create(self, path: str, text: str) -> bool:
        """Create a file with all of its text at once, unless there is one already; whether this call created it.

        On a local disk a hard link decides who is first, elsewhere a rename that doesn't replace, which HDFS does atomically.
        """
        fs, p = self._at(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.getUri().getScheme() == "file":
            try:
                os.link(beside.toUri().getPath(), p.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(beside, False)
        if not fs.exists(p) and fs.rename(beside, p):
            return True
        fs.delete(beside, False)
        return False

    def ages(self, path: str, now: float) -> dict[str, float]:
        """Seconds since each file or folder below ``path`` changed, by name."""
        fs, p = self._at(path)
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in fs.listStatus(p)} if fs.exists(p) else {}
