"""The one query shape of the store: a window, label matchers, a keyword, a limit."""

from __future__ import annotations

from dataclasses import dataclass, field

DEFAULT_LIMIT, MAX_LIMIT = 100, 5000


@dataclass(frozen=True)
class Matcher:
    """``type`` is one of = != =~ !~; empty means =; any other type puts no condition on rows."""

    name: str
    value: str
    type: str = "="


@dataclass(frozen=True)
class QueryRequest:
    """start and end are inclusive nanoseconds, 0 for unbounded. With ``local_only`` remote segments aren't read."""

    start: int = 0
    end: int = 0
    matchers: tuple[Matcher, ...] = field(default_factory=tuple)
    line: str = ""
    limit: int = 0
    local_only: bool = False

    @property
    def effective_limit(self) -> int:
        """A limit that is not positive or too large is reset to the default, not clamped."""
        return self.limit if 0 < self.limit <= MAX_LIMIT else DEFAULT_LIMIT

    @classmethod
    def from_dict(cls, body: dict) -> QueryRequest:
        """Of a decoded request body; a selector under ``query`` that isn't blank replaces matchers and line."""
        from .selector import parse_selector

        matchers = tuple(Matcher(m.get("name", ""), m.get("value", ""), m.get("type", "")) for m in body.get("matchers") or ())
        line = body.get("line", "")
        if (body.get("query") or "").strip():
            matchers, line = parse_selector(body["query"])
        return cls(int(body.get("start", 0)), int(body.get("end", 0)), matchers, line, int(body.get("limit", 0)), bool(body.get("local_only", False)))
