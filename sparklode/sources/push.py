"""Push payloads: what log shippers send, as JSON, MessagePack or protobuf, in one shape."""

from __future__ import annotations

import json
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .schema import PUSH_SCHEMA

#: What an invalid payload is answered with.
NO_STREAM = "At least one stream is required"
NO_LABELS = "Each stream requires labels"
NO_VALUES = "Each stream requires a value"


class PushError(ValueError):
    """The payload can't be decoded or isn't valid."""


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Payloads from files of one JSON object a line."""
    return spark.read.schema(PUSH_SCHEMA).json(path)


def from_json(body: Column) -> Column:
    return F.from_json(body, PUSH_SCHEMA)


def decode_msgpack(data: bytes):
    """The value that ``data`` holds: maps, arrays, strings, binaries, integers, floats, booleans and nil."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise PushError("the message ends too early")
        at += n
        return data[at - n : at]

    def number(n: int, signed: bool = False) -> int:
        return int.from_bytes(take(n), "big", signed=signed)

    def value():
        kind = number(1)
        if kind < 0x80:
            return kind
        if kind >= 0xE0:
            return kind - 256
        if kind < 0x90 or kind in (0xDE, 0xDF):
            size = kind & 15 if kind < 0x90 else number(2 if kind == 0xDE else 4)
            return {value(): value() for _ in range(size)}
        if kind < 0xA0 or kind in (0xDC, 0xDD):
            return [value() for _ in range(kind & 15 if kind < 0xA0 else number(2 if kind == 0xDC else 4))]
        if kind < 0xC0 or kind in (0xD9, 0xDA, 0xDB):
            return take(kind & 31 if kind < 0xC0 else number(1 << kind - 0xD9)).decode("utf-8", "replace")
        if kind in (0xC4, 0xC5, 0xC6):
            return take(number(1 << kind - 0xC4))
        if kind in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[kind]
        if kind in (0xCA, 0xCB):
            return struct.unpack(">f" if kind == 0xCA else ">d", take(4 if kind == 0xCA else 8))[0]
        if 0xCC <= kind <= 0xD3:
            return number(1 << (kind & 3), kind >= 0xD0)
        raise PushError(f"unknown type {kind:#x}")

    return value()


def _fields(data: bytes):
    """(number, payload) of each length-delimited field of a protobuf message; others are skipped."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            if at >= len(data) or shift > 63:
                raise PushError("a broken variable-length number")
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 2:
            size = varint()
            if at + size > len(data):
                raise PushError("the message ends too early")
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind == 0:
            varint()
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise PushError(f"unknown wire type {kind}")


def decode_protobuf(data: bytes) -> dict:
    """Payload{1: stream entries}, entry{1: map of labels, 2: values}, value{1: timestamp, 2: line}; all leaves are strings."""
    text = lambda parts, k: parts.get(k, b"").decode("utf-8", "replace")
    streams = []
    for number, entry in _fields(data):
        if number != 1:
            continue
        labels, values = {}, []
        for part, body in _fields(entry):
            inner = dict(_fields(body))
            if part == 1:
                labels[text(inner, 1)] = text(inner, 2)
            elif part == 2:
                values.append([text(inner, 1), text(inner, 2)])
        streams.append({"stream": labels, "values": values})
    return {"streams": streams}


def decode(body: bytes, content_type: str) -> dict:
    """A payload by its content type; protobuf is looked for first, then MessagePack, then JSON."""
    if "application/protobuf" in content_type:
        return decode_protobuf(body)
    if "application/msgpack" in content_type:
        payload = decode_msgpack(body)
        for stream in payload.get("streams") or ():
            if any(len(v) != 2 for v in stream.get("values") or ()):
                raise PushError("a value has a timestamp and a line")
        return payload
    if "application/json" in content_type:
        try:
            return json.loads(body)
        except ValueError as error:
            raise PushError("the body is not JSON") from error
    raise PushError(f"unsupported content type {content_type!r}")


def invalid(payload: dict) -> str | None:
    """Why a decoded payload is rejected; None if it isn't. Timestamps are not looked at here."""
    streams = payload.get("streams") or ()
    if not streams:
        return NO_STREAM
    for stream in streams:
        if not stream.get("stream"):
            return NO_LABELS
        if not stream.get("values"):
            return NO_VALUES
    return None


def rejection(streams: Column) -> Column:
    """``invalid`` as a column: the reason, or null."""
    reason = lambda s: F.when(F.coalesce(F.size(F.map_keys(s["stream"])), F.lit(0)) <= 0, NO_LABELS).when(F.coalesce(F.size(s["values"]), F.lit(0)) <= 0, NO_VALUES)
    first = F.get(F.filter(F.transform(streams, reason), lambda r: r.isNotNull()), F.lit(0))
    return F.when(F.coalesce(F.size(streams), F.lit(0)) <= 0, F.lit(NO_STREAM)).otherwise(first)


def answered(bodies: DataFrame) -> DataFrame:
    """streams and rejected of each of ``bodies`` (content_type, body binary): the payload, or why there is none. A bad body costs no other.

    JSON goes through Spark's parser, the other two through Arrow batches.
    """
    as_json = F.contains(F.coalesce("content_type", F.lit("")), F.lit("application/json")) & ~F.contains(F.coalesce("content_type", F.lit("")), F.lit("application/protobuf")) & ~F.contains(F.coalesce("content_type", F.lit("")), F.lit("application/msgpack"))

    def rows(batches):
        for batch in batches:
            payloads, errors = [], []
            for kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    payloads.append(json.dumps(decode(body or b"", kind or "")))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  whatever is wrong with a body is its sender's to hear
                    payloads.append(None)
                    errors.append(str(error) or type(error).__name__)
            yield pa.RecordBatch.from_arrays([pa.array(payloads, pa.string()), pa.array(errors, pa.string())], ["json", "error"])

    other = bodies.where(~as_json).select("content_type", "body").mapInArrow(rows, "json string, error string")
    mine = bodies.where(as_json).select(F.col("body").cast("string").alias("json"), F.lit(None).cast("string").alias("error"))
    parsed = mine.unionByName(other).withColumn("p", F.from_json("json", PUSH_SCHEMA, {"mode": "PERMISSIVE"}))
    broken = F.when(F.col("error").isNull() & F.try_parse_json("json").isNull(), F.lit("the body is not JSON"))
    return parsed.select(F.col("p.streams").alias("streams"), F.coalesce("error", broken, rejection(F.col("p.streams"))).alias("rejected"))


def decoded(bodies: DataFrame) -> DataFrame:
    """The payloads of ``bodies`` that are accepted."""
    return answered(bodies).where("rejected is null").select("streams")


def encode_msgpack(value) -> bytes:
    """``value`` (maps, lists, texts, bytes, integers, floats, booleans, None) as MessagePack."""
    if value is None or isinstance(value, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[value]
    if isinstance(value, int):
        if -32 <= value < 128:
            return struct.pack("b", value)
        code, form = next((c, f) for c, f, low, high in _INTEGERS if low <= value < high)
        return bytes([code]) + struct.pack(form, value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        data = value.encode("utf-8", "surrogatepass")
        return _head(len(data), (0xA0, 32), (0xD9, 0xDA, 0xDB)) + data
    if isinstance(value, bytes):
        return _head(len(value), None, (0xC4, 0xC5, 0xC6)) + value
    if isinstance(value, dict):
        return _head(len(value), (0x80, 16), (None, 0xDE, 0xDF)) + b"".join(encode_msgpack(k) + encode_msgpack(v) for k, v in value.items())
    return _head(len(value), (0x90, 16), (None, 0xDC, 0xDD)) + b"".join(map(encode_msgpack, value))


_INTEGERS = [(0xCC, ">B", 0, 1 << 8), (0xCD, ">H", 0, 1 << 16), (0xCE, ">I", 0, 1 << 32), (0xCF, ">Q", 0, 1 << 64), (0xD0, ">b", -(1 << 7), 0), (0xD1, ">h", -(1 << 15), 0), (0xD2, ">i", -(1 << 31), 0), (0xD3, ">q", -(1 << 63), 0)]


def _head(size: int, short: tuple[int, int] | None, codes: tuple) -> bytes:
    """Kind and size of what follows; ``codes`` are the kinds with sizes of 1, 2 and 4 bytes."""
    if short and size < short[1]:
        return bytes([short[0] | size])
    width = next(i for i, code in enumerate(codes) if code is not None and size < 1 << (8 << i))
    return bytes([codes[width]]) + size.to_bytes(1 << width, "big")
