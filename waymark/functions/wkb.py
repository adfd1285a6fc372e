"""Well-known binary and text of points, lines and polygons."""

from __future__ import annotations

import struct

import numpy as np

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)


def _coords(xy: np.ndarray) -> bytes:
    return struct.pack("<I", len(xy)) + np.ascontiguousarray(xy, "<f8").tobytes()


def point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, POINT, x, y)


def line(xy: np.ndarray) -> bytes:
    return struct.pack("<BI", 1, LINE) + _coords(xy)


def polygon(rings: list[np.ndarray]) -> bytes:
    return struct.pack("<BII", 1, POLYGON, len(rings)) + b"".join(_coords(r) for r in rings)


def multi(kind: int, parts: list[bytes]) -> bytes:
    return struct.pack("<BII", 1, kind, len(parts)) + b"".join(parts)


def decode(data: bytes):
    """(kind, value): coordinates for points and lines, rings for polygons, a list of such pairs for the others."""
    value, end = _decode(data, 0)
    if end != len(data):
        raise ValueError("bytes left over")
    return value


def _decode(data: bytes, at: int):
    order = "<" if data[at] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if kind == POINT:
        return (kind, np.frombuffer(data, order + "f8", 2, at)), at + 16
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if kind == LINE:
        return (kind, np.frombuffer(data, order + "f8", 2 * n, at).reshape(-1, 2)), at + 16 * n
    out = []
    for _ in range(n):
        if kind == POLYGON:
            (m,) = struct.unpack_from(order + "I", data, at)
            out.append(np.frombuffer(data, order + "f8", 2 * m, at + 4).reshape(-1, 2))
            at += 4 + 16 * m
        elif kind in (MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION):
            part, at = _decode(data, at)
            out.append(part)
        else:
            raise ValueError(f"geometry kind {kind}")
    return (kind, out), at


def line_parts(geometry) -> list[np.ndarray]:
    """Lines of a geometry: itself, or the direct lines of a multi-line or collection; nested ones are not looked into."""
    kind, value = geometry
    if kind == LINE:
        return [value]
    if kind in (MULTILINE, COLLECTION):
        return [v for k, v in value if k == LINE]
    return []


def text(geometry, digits: int = 9) -> str:
    """Well-known text with rounded coordinates and no trailing zeros."""
    kind, value = geometry
    number = lambda v: f"{v:.{digits}f}".rstrip("0").rstrip(".")
    pairs = lambda xy: ", ".join(f"{number(x)} {number(y)}" for x, y in xy)
    if kind == POINT:
        return f"POINT ({pairs([value])})"
    if kind == LINE:
        return f"LINESTRING ({pairs(value)})"
    if kind == POLYGON:
        return "POLYGON (" + ", ".join(f"({pairs(r)})" for r in value) + ")"
    names = {MULTIPOINT: "MULTIPOINT", MULTILINE: "MULTILINESTRING", MULTIPOLYGON: "MULTIPOLYGON", COLLECTION: "GEOMETRYCOLLECTION"}
    inner = [text(g, digits) for g in value]
    return f"{names[kind]} ({', '.join(inner if kind == COLLECTION else [t[t.index('(') :] for t in inner])})"
