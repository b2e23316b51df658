"""Command line: search a store, show labels and statistics, compact and move segments."""

from __future__ import annotations

import argparse
import json
import re
import sys
import time
from calendar import timegm

from .plans.request import QueryRequest
from .plans.selector import parse_selector

_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.(\d{1,9})\d*)?([Zz]|[+-]\d\d:\d\d)")
_ESCAPES = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", '"': '\\"', "\\": "\\\\"}


def parse_duration(text: str) -> int:
    """Nanoseconds of 90s, 1h30m, 1.5h and the like."""
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text)
    if text != "0" and "".join(a + b for a, b in parts) != text.lstrip("+"):
        raise ValueError(f"{text!r} is not a duration")
    return int(sum(float(a) * _UNITS[b] for a, b in parts))


def parse_time(text: str) -> int:
    """Nanoseconds of a decimal number of them or an RFC 3339 time."""
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if (m := _RFC3339.fullmatch(text)) is None:
        raise ValueError(f"{text!r} is not unix nanoseconds or an RFC3339 time")
    zone = 0 if m[8] in "Zz" else (1 if m[8][0] == "+" else -1) * (int(m[8][1:3]) * 3600 + int(m[8][4:6]) * 60)
    return (timegm(tuple(int(m[i]) for i in range(1, 7))) - zone) * 10**9 + int((m[7] or "0").ljust(9, "0"))


def window(now: int, since: int = 0, until: int = 0, start: str = "", end: str = "") -> tuple[int, int]:
    """Inclusive bounds, 0 for open ones; absolute times go before relative ones."""
    low = parse_time(start) if start else now - since if since > 0 else 0
    high = parse_time(end) if end else now - until if until > 0 else 0
    if low and high and low > high:
        raise ValueError(f"start ({low}) is after end ({high})")
    return low, high


def quoted(text: str) -> str:
    """In double quotes, with escapes for what doesn't print."""
    return '"' + "".join(_ESCAPES.get(c) or (c if c.isprintable() else f"\\x{ord(c):02x}" if ord(c) < 128 else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}") for c in text) + '"'


def format_time(nanoseconds: int) -> str:
    seconds, rest = divmod(nanoseconds, 10**9)
    fraction = f".{rest:09d}".rstrip("0") if rest else ""
    t = time.gmtime(seconds)
    return f"{t.tm_year:04d}-{t.tm_mon:02d}-{t.tm_mday:02d}T{t.tm_hour:02d}:{t.tm_min:02d}:{t.tm_sec:02d}{fraction}Z"


def format_labels(labels: dict[str, str]) -> str:
    return "{" + ", ".join(f"{k}={quoted(labels[k])}" for k in sorted(labels)) + "}"


def render(rows: list, output: str = "text") -> str:
    """Rows of a result, newest first, as lines of text or as a JSON array."""
    if output == "json":
        return json.dumps([{"timestamp": r["timestamp"], "line": r["line"], "labels": r["labels"]} for r in rows], indent=2, ensure_ascii=False) + "\n"
    return "".join(f"{format_time(r['timestamp'])} {format_labels(r['labels'])} {r['line']}\n" for r in rows)


def main(arguments: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="sparklode", description=__doc__)
    parser.add_argument("--root", required=True, help="folder of the store")
    commands = parser.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", help="the newest matching rows")
    search.add_argument("selector", nargs="?", default="{}")
    for flag in ("--since", "--until"):
        search.add_argument(flag, type=parse_duration, default=0)
    for flag in ("--start", "--end"):
        search.add_argument(flag, default="")
    search.add_argument("--limit", type=int, default=100)
    search.add_argument("--output", choices=("text", "json"), default="text")
    search.add_argument("--hot", action="store_true", help="local segments only")
    for name, about in (("labels", "label keys"), ("stats", "statistics of segments"), ("compact", "merge flush files"), ("rotate", "move old segments"), ("sweep", "delete local copies of moved segments"), ("reconcile", "rebuild the catalog from what is stored")):
        commands.add_parser(name, help=about)
    given = parser.parse_args(arguments)
    if given.command == "search":
        matchers, line = parse_selector(given.selector)
        low, high = window(time.time_ns(), given.since, given.until, given.start, given.end)
        request = QueryRequest(low, high, matchers, line, given.limit, given.hot)

    from pyspark.sql import SparkSession

    from .operators import compaction, search as searching, tiering
    from .operators.store import Store

    store = Store(spark or SparkSession.builder.getOrCreate(), given.root)
    if given.command == "search":
        out.write(render(searching.query_waves(store.catalog, request).collect(), given.output))  # MAX_LIMIT rows at most
    elif given.command == "labels":
        out.write("".join(f"{r['key']}\n" for r in store.catalog.label_keys().collect()))
    elif given.command == "stats":
        out.write(json.dumps(store.catalog.stats().first().asDict(), indent=2) + "\n")
    elif given.command == "compact":
        out.write(f"{compaction.compact(store) or 'too few flush files'}\n")
    elif given.command == "rotate":
        done, failed = tiering.rotate(store)
        out.write("".join([f"{done} rotated\n", *(f"{f}\n" for f in failed)]))
    elif given.command == "sweep":
        out.write(f"{tiering.sweep(store)} swept\n")
    else:
        compaction.reconcile(store)
        out.write(f"{tiering.reconcile_remote(store)} remote segments added\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
