"""Spatial values as bytes: a type byte and big-endian 32-bit floats; states and their deltas have a mask of what is there."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from . import binary
from .binary import Bytes
from .values import RecordError

# Type bytes, and how many floats the plain types have.
TYPES = {"position2d": 0x01, "position": 0x02, "rotation": 0x03, "velocity": 0x04, "acceleration": 0x05, "box": 0x06, "quaternion": 0x07, "path": 0x08, "transform": 0x09, "state": 0x0A, "position_delta": 0x0B, "rotation_delta": 0x0C, "delta": 0x0D}
SIZES = {"position2d": 2, "position": 3, "rotation": 3, "velocity": 3, "acceleration": 3, "box": 6, "quaternion": 4, "transform": 9, "position_delta": 3, "rotation_delta": 3}
STATE_ALIAS = 0x10
PARTS = ("position", "rotation", "velocity", "acceleration")
DELTAS = {0x01: "position", 0x02: "rotation", 0x03: "state"}


def _floats(values: list[float]) -> bytes:
    return struct.pack(f">{len(values)}f", *values)


def _parts(parts: dict) -> bytes:
    there = [n for n in PARTS if parts.get(n) is not None]
    return bytes([sum(1 << PARTS.index(n) for n in there)]) + b"".join(_floats(parts[n]) for n in there)


def write(kind: str, value: object) -> bytes:
    """value: a list of floats; for a path a list of triples; for a state a dict of parts; for a delta (kind, value)."""
    head = bytes([TYPES[kind]])
    if kind == "path":
        return head + struct.pack(">I", len(value)) + b"".join(map(_floats, value))
    if kind == "state":
        return head + _parts(value)
    if kind == "delta":
        what, inner = value
        code = next(k for k, v in DELTAS.items() if v == what)
        return head + bytes([code]) + (_parts(inner) if what == "state" else _floats(inner))
    if len(value) != SIZES[kind]:
        raise RecordError("InvalidLength", f"{kind}: {len(value)} floats")
    return head + _floats(value)


def read(data: bytes) -> tuple[str, object]:
    b = Bytes(bytes(data))
    code = b.byte()
    kind = "state" if code == STATE_ALIAS else next((k for k, v in TYPES.items() if v == code), None)
    floats = lambda n: list(struct.unpack(f">{n}f", b.take(4 * n)))

    def parts() -> dict:
        mask = b.byte()
        return {n: floats(3) if mask & (1 << k) else None for k, n in enumerate(PARTS)}

    if kind is None:
        raise RecordError("InvalidTypeTag", f"0x{code:02X}")
    if kind == "path":
        return kind, [floats(3) for _ in range(b.unpack(">I"))]
    if kind == "state":
        return kind, parts()
    if kind == "delta":
        what = DELTAS.get(inner := b.byte())
        if what is None:
            raise RecordError("InvalidTypeTag", f"delta 0x{inner:02X}")
        return kind, (what, parts() if what == "state" else floats(3))
    return kind, floats(SIZES[kind])


FLAT = "struct<kind:string,what:string,position:array<float>,rotation:array<float>,velocity:array<float>,acceleration:array<float>,points:array<array<float>>>"


def decode_column(df: DataFrame, data: str, *keys: str, out: str = "value") -> DataFrame:
    """keys, out and error: plain values are one point of `points`."""

    def one(raw: bytes) -> dict:
        kind, value = read(raw)
        what = None
        if kind == "delta":
            what, value = value
        if isinstance(value, dict):
            return {"kind": kind, "what": what, **value}
        return {"kind": kind, "what": what, "points": value if kind == "path" else [value]}

    return binary._over(df, list(keys), data, out, one, FLAT)


def encode_column(df: DataFrame, kind: str, values: str, *keys: str, out: str = "data") -> DataFrame:
    """A column of float arrays (arrays of them for paths) as bytes."""
    return binary._over(df, list(keys), values, out, lambda v: write(kind, v), "binary")
