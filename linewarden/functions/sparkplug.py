"""Binary broker payloads: the wire format of Sparkplug B, in both directions.

A payload is a sequence of numbered fields. The tables below name the fields that a tag
change needs, and how each is written; all others are skipped by their wire type.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from linewarden.session import ship

ship(__name__)

# Field numbers of a payload and of a metric, with their kind.
PAYLOAD_FIELDS = {1: ("timestamp", "varint"), 2: ("metrics", "bytes")}
METRIC_FIELDS = {
    1: ("name", "text"),
    4: ("datatype", "varint"),
    7: ("is_null", "varint"),
    10: ("int_value", "varint"),
    11: ("long_value", "varint"),
    12: ("float_value", "float"),
    13: ("double_value", "double"),
    14: ("boolean_value", "boolean"),
    15: ("string_value", "text"),
}
# Bits of the signed data types, by their number.
SIGNED_BITS = {1: 8, 2: 16, 3: 32, 4: 64}
INT64, STRING = 4, 12
# Wire types.
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5

BODY = "struct<line_id: string, timestamp: double, metrics: map<string, string>>"
_BODY = pa.struct(
    [
        ("line_id", pa.string()),
        ("timestamp", pa.float64()),
        ("metrics", pa.map_(pa.string(), pa.string())),
    ]
)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if shift > 63:
            raise ValueError("a number is too long")
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Number, wire type and raw value of every field; an error if the bytes end too soon."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if not number:
            raise ValueError("no field has number 0")
        if wire == VARINT:
            value, at = _varint(data, at)
            yield number, wire, value
            continue
        if wire == BYTES:
            size, at = _varint(data, at)
        elif wire in (FIXED64, FIXED32):
            size = 8 if wire == FIXED64 else 4
        else:
            raise ValueError(f"wire type {wire}")
        if at + size > len(data):
            raise ValueError("a field ends behind the payload")
        yield number, wire, data[at : at + size]
        at += size


_WIRES = {
    "varint": VARINT, "boolean": VARINT, "text": BYTES, "bytes": BYTES,
    "float": FIXED32, "double": FIXED64,
}


def _read(kind: str, wire: int, raw: int | bytes):
    if wire != _WIRES[kind]:
        raise ValueError(f"{kind} in wire type {wire}")
    if kind == "text":
        return raw.decode("utf-8")
    if kind in ("float", "double"):
        return struct.unpack("<f" if kind == "float" else "<d", raw)[0]
    return bool(raw) if kind == "boolean" else raw


def _metric(data: bytes) -> tuple[str, str | None]:
    """Name and value, as text; a null value stays one."""
    got: dict = {}
    for number, wire, raw in fields(data):
        if number in METRIC_FIELDS:
            name, kind = METRIC_FIELDS[number]
            got[name] = _read(kind, wire, raw)
    value = next((got[k] for k in got if k.endswith("_value")), None)
    if got.get("is_null"):
        value = None
    bits = SIGNED_BITS.get(got.get("datatype"))
    if bits and ("int_value" in got or "long_value" in got) and value is not None:
        value &= (1 << bits) - 1
        value -= (value >> (bits - 1)) << bits
    if isinstance(value, bool):
        value = "true" if value else "false"
    return got["name"], None if value is None else str(value)


def decode(data: bytes | None) -> dict | None:
    """Timestamp in milliseconds and metrics in their order; None for broken bytes.

    A metric without a name makes the payload broken; of metrics that share a name the last
    one counts.
    """
    if data is None:
        return None
    try:
        timestamp, metrics = None, {}
        for number, wire, raw in fields(data):
            if number in PAYLOAD_FIELDS:
                name, kind = PAYLOAD_FIELDS[number]
                value = _read(kind, wire, raw)
                if name == "timestamp":
                    timestamp = float(value)
                else:
                    key, text = _metric(value)
                    metrics[key] = text
    except (ValueError, IndexError, KeyError):
        return None
    return {"line_id": None, "timestamp": timestamp, "metrics": list(metrics.items())}


def decode_binary(payload: Column) -> Column:
    """A binary payload in the shape of ``operators.tags.decode_json``; null if broken.

    The line is not part of a payload: it is the edge node of the topic.
    """

    @F.arrow_udf(BODY)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for payloads in batches:
            yield pa.array([decode(p) for p in payloads.to_pylist()], _BODY)

    return of(payload)


def _written(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, wire: int, value: bytes | int) -> bytes:
    tag = _written(number << 3 | wire)
    if wire == VARINT:
        return tag + _written(value)
    return tag + (_written(len(value)) if wire == BYTES else b"") + value


def encode(timestamp: int, metrics: list[tuple[str, str | int | None]]) -> bytes:
    """A payload of whole numbers, texts and nulls."""
    out = _field(1, VARINT, timestamp)
    for name, value in metrics:
        metric = _field(1, BYTES, name.encode())
        metric += _field(4, VARINT, INT64 if isinstance(value, int) else STRING)
        if value is None:
            metric += _field(7, VARINT, 1)
        elif isinstance(value, int):
            metric += _field(11, VARINT, value & (1 << 64) - 1)
        else:
            metric += _field(15, BYTES, value.encode())
        out += _field(2, BYTES, metric)
    return out
