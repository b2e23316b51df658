"""What runs beside ingest: compaction and tiering at intervals, and shutting all of it down in order."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery

from ..operators.compaction import compact
from ..operators.store import Store
from ..operators.tiering import GRACE, ROTATE_AFTER, rotate, sweep

COMPACT_EVERY, TIER_EVERY = 30.0, 60.0  # seconds
log = logging.getLogger(__name__)


class Loop:
    """Calls ``work`` every ``interval`` seconds until it is stopped; an error is logged and doesn't end it."""

    def __init__(self, work: Callable[[], object], interval: float):
        if interval <= 0:
            raise ValueError("an interval is positive")
        self.work, self.interval, self.stopping, self.errors = work, interval, threading.Event(), 0
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        while not self.stopping.wait(self.interval):
            try:
                self.work()
            except Exception:  # noqa: BLE001  the next turn may well succeed
                self.errors += 1
                log.exception("%s failed", getattr(self.work, "__name__", self.work))

    def stop(self) -> None:
        """Wait for a turn under way and end."""
        self.stopping.set()
        self.thread.join()


def compact_all(store: Store, min_files: int, max_files: int) -> int:
    """Compact until too few flush files are left, then delete what has been out of use for long enough; how many segments were made."""
    made = 0
    while compact(store, min_files, max_files):
        made += 1
    store.catalog.purge()
    return made


def tier(store: Store, age: int = ROTATE_AFTER, grace: int = GRACE) -> tuple[int, int]:
    """Move old segments, then delete the local copies of those moved long ago: how many of each. What couldn't be moved is logged."""
    moved, failed = rotate(store, age)
    for reason in failed:
        log.warning("not moved: %s", reason)
    return moved, sweep(store, grace)


class Service:
    """Ingest with its loops. ``compact_every`` of 0 leaves compaction out, ``tier_every`` of 0 tiering; negative ages count as the defaults."""

    def __init__(self, store: Store, ingest: StreamingQuery | None = None, compact_every: float = COMPACT_EVERY, tier_every: float = 0.0, min_files: int = 8, max_files: int = 128, age: int = ROTATE_AFTER, grace: int = GRACE):
        self.store, self.ingest = store, ingest
        age, grace = age if age >= 0 else ROTATE_AFTER, grace if grace >= 0 else GRACE
        self.loops = [Loop(lambda: compact_all(store, min_files, max_files), compact_every)] if compact_every > 0 else []
        self.loops += [Loop(lambda: tier(store, age, grace), tier_every)] if tier_every > 0 else []

    def close(self, timeout: float = 60.0) -> None:
        """First what has arrived is flushed and ingest stops, then the loops end; nothing that was accepted is lost, and nothing is half done."""
        if self.ingest is not None and self.ingest.isActive:
            try:
                self.ingest.processAllAvailable()
            finally:
                self.ingest.stop()
                self.ingest.awaitTermination(int(timeout))
        for loop in self.loops:
            loop.stop()
