"""Requests and responses of the log engine's interface, without a server: from a body to a status and an answer.

A web framework only has to call ``Api.handle``. Bodies are bytes; answers are encoded as JSON, labels as MessagePack if that is asked for.
"""

from __future__ import annotations

import hmac
import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from .functions.regex import RegexError
from .operators import search
from .operators.store import Store
from .plans.request import QueryRequest
from .plans.selector import SelectorError
from .sources.push import PushError, decode, encode_msgpack, invalid
from .sources.schema import PUSH_SCHEMA

PLAN_VALID = timedelta(minutes=15)


@dataclass
class Answer:
    status: int
    body: dict

    def encoded(self, accept: str = "", msgpack: bool = False) -> tuple[str, bytes]:
        """Content type and bytes; MessagePack only where the caller allows it and the request accepts it."""
        if msgpack and "application/msgpack" in accept:
            return "application/msgpack", encode_msgpack(self.body)
        return "application/json", json.dumps(self.body, ensure_ascii=False).encode()


def _error(status: int, message: object) -> Answer:
    return Answer(status, {"status": "error", "error": str(message)})


class Api:
    """``push`` takes decoded payloads; by default each request is flushed at once (200). With a queue in front of a stream, say ``durable=False`` (202)."""

    def __init__(self, store: Store, key: str = "", push: Callable[[dict], None] | None = None, durable: bool = True, remote: bool = True):
        self.store, self.key, self.durable, self.remote = store, key, durable, remote
        self.push = push or (lambda payload: store.flush(store.spark.createDataFrame([(payload["streams"],)], PUSH_SCHEMA)))

    def allowed(self, authorization: str) -> bool:
        """Whether a request with this header may pass; without a key all may."""
        return not self.key or hmac.compare_digest(authorization.encode(), f"Bearer {self.key}".encode())

    def push_request(self, body: bytes, content_type: str) -> Answer:
        try:
            payload = decode(body, content_type)
            if not isinstance(payload, dict):
                raise PushError("a payload is an object")
            reason = invalid(payload)
        except (PushError, TypeError, AttributeError, ValueError) as error:
            return _error(400, error)
        if reason:
            return _error(400, reason)
        self.push(payload)
        return Answer(200 if self.durable else 202, {"status": "success"})

    def query(self, body: bytes) -> Answer:
        """The newest matching rows, an empty list if there are none; sources that can't be read are named beside them."""
        try:
            request = QueryRequest.from_dict(_object(body))
        except (SelectorError, ValueError, TypeError, AttributeError) as error:
            return _error(400, error)
        try:
            rows, errors = search.rows_and_errors(self.store.catalog, request)
        except RegexError as error:
            return _error(500, error)
        found = {"status": "success", "data": [_row(r) for r in rows]}
        return Answer(200, found | {"warnings": errors} if errors else found)

    def labels(self) -> Answer:
        return Answer(200, {"status": "success", "data": [r["key"] for r in self.store.catalog.label_keys().collect()]})  # bounded by the variety of keys

    def stats(self) -> Answer:
        return Answer(200, {"status": "success", "data": self.store.catalog.stats().first().asDict()})

    def auth(self) -> Answer:
        return Answer(200, {"required": bool(self.key)})

    def search_plan(self, body: bytes, now: datetime | None = None) -> Answer:
        """What is hot, searched, and the cold segments that are left after pruning, for the caller to search until ``expires_at``. A selector is not looked at."""
        if not self.remote:
            return _error(400, "there is no remote store")
        try:
            request = QueryRequest.from_dict(_object(body) | {"query": ""})
            plan = search.plan(self.store.catalog, request)
        except RegexError as error:
            return _error(500, error)
        except (ValueError, TypeError, AttributeError) as error:
            return _error(400, error)
        until = (now or datetime.now(timezone.utc)) + PLAN_VALID
        segments = [{"id": i, "url": path} for i, path in zip(plan.cold_ids, plan.cold_paths, strict=True)]
        return Answer(200, {"status": "success", "data": [_row(r) for r in plan.hot.collect()], "segments": segments, "limit": plan.limit, "expires_at": until.isoformat().replace("+00:00", "Z"), "warnings": plan.warnings})

    def handle(self, method: str, path: str, body: bytes = b"", headers: dict[str, str] | None = None) -> tuple[int, str, bytes]:
        """Status, content type and bytes for a request. Everything but pushing needs the key, if there is one."""
        headers = {k.lower(): v for k, v in (headers or {}).items()}
        routes = {
            ("POST", "/api/v1/query"): lambda: self.query(body), ("POST", "/api/v1/search/plan"): lambda: self.search_plan(body), ("GET", "/api/v1/labels"): self.labels,
            ("GET", "/api/v1/stats"): self.stats, ("GET", "/api/v1/auth"): self.auth, ("POST", "/api/v1/push"): lambda: self.push_request(body, headers.get("content-type", "")),
        }
        route = routes.get((method, path))
        if route is None:
            answer = _error(404, f"nothing at {method} {path}")
        elif path != "/api/v1/push" and not self.allowed(headers.get("authorization", "")):
            answer = _error(401, "the key is missing or wrong")
        else:
            answer = route()
        return answer.status, *answer.encoded(headers.get("accept", ""), path == "/api/v1/labels")


def _object(body: bytes) -> dict:
    found = json.loads(body)
    if not isinstance(found, dict):
        raise ValueError("the body is not an object")
    return found


def _row(row) -> dict:
    return {"timestamp": row["timestamp"], "line": row["line"], "labels": row["labels"]}
