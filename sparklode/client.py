"""Clients: log rows collected, grouped by label set and pushed in batches; a logging handler; a generator of sample logs."""

from __future__ import annotations

import json
import logging
import queue
import random
import threading
import time
from collections.abc import Callable, Iterable, Iterator

BATCH, INTERVAL, QUEUE, RETRIES = 100, 1.0, 4096, 2


def payload(rows: Iterable[tuple[int, str, dict[str, str]]]) -> dict:
    """A push payload of (timestamp, line, labels) rows, one stream for each label set."""
    streams: dict[tuple, dict] = {}
    for timestamp, line, labels in rows:
        entry = streams.setdefault(tuple(sorted(labels.items())), {"stream": dict(labels), "values": []})
        entry["values"].append([str(timestamp), line])
    return {"streams": list(streams.values())}


class Sender:
    """Pushes rows from a bounded queue in the background; rows that don't fit are dropped and counted."""

    def __init__(self, push: Callable[[dict], None], batch: int = BATCH, interval: float = INTERVAL, capacity: int = QUEUE, retries: int = RETRIES):
        self.push, self.batch, self.interval, self.retries = push, batch, interval, retries
        self.rows: queue.Queue = queue.Queue(capacity)
        self.dropped = 0
        self.closing = threading.Event()
        self.worker = threading.Thread(target=self._work, daemon=True)
        self.worker.start()

    def add(self, timestamp: int, line: str, labels: dict[str, str]) -> None:
        try:
            self.rows.put_nowait((timestamp, line, labels))
        except queue.Full:
            self.dropped += 1

    def _work(self) -> None:
        while not (self.closing.is_set() and self.rows.empty()):
            batch, until = [], time.monotonic() + self.interval
            while len(batch) < self.batch and (left := until - time.monotonic()) > 0:
                try:
                    batch.append(self.rows.get(timeout=min(left, 0.05)))
                except queue.Empty:
                    if self.closing.is_set():
                        break
            if batch:
                self._send(batch)

    def _send(self, batch: list) -> None:
        for attempt in range(self.retries + 1):
            try:
                self.push(payload(batch))
                return
            except Exception:  # noqa: BLE001  whatever the transport raises
                time.sleep(0.01 * 2**attempt)
        self.dropped += len(batch)

    def close(self) -> None:
        """Send what is queued and stop."""
        self.closing.set()
        self.worker.join()


class Handler(logging.Handler):
    """Log records as JSON lines with static labels and their level."""

    def __init__(self, sender: Sender, **labels: str):
        super().__init__()
        self.sender, self.labels = sender, labels

    def emit(self, record: logging.LogRecord) -> None:
        body = {"level": record.levelname, "msg": record.getMessage()} | getattr(record, "fields", {})
        if record.exc_info and record.exc_info[1] is not None:
            body["error"] = repr(record.exc_info[1])
        self.sender.add(int(record.created * 1e9), json.dumps(body, default=str), self.labels | {"level": record.levelname.lower()})


def sample_rows(n: int, seed: int = 42, start: int = 1_700_000_000_000_000_000) -> Iterator[tuple[int, str, dict[str, str]]]:
    """Rows of few label sets, a millisecond apart: web access lines and JSON application lines."""
    r = random.Random(seed)
    for i in range(n):
        at, host, env = start + i * 1_000_000, f"host-{r.randrange(20):02d}", r.choice(("prod", "staging"))
        if r.random() < 0.5:
            line = f'10.0.{r.randrange(256)}.{r.randrange(256)} - - "GET /item/{r.randrange(1000)} HTTP/1.1" {r.choice((200, 200, 200, 404, 500))} {r.randrange(20000)}'
            yield at, line, {"service": "web", "env": env, "host": host}
        else:
            level = r.choices(("debug", "info", "warn", "error"), (2, 10, 2, 1))[0]
            line = json.dumps({"level": level, "msg": f"request {r.randrange(10**6)}", "latency_ms": r.randrange(500)})
            yield at, line, {"app": f"app-{r.randrange(6)}", "env": env, "level": level, "host": host}
