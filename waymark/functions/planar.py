"""Planar geometry: clipping by boxes and polygons, containment, and a Transverse Mercator projection, over columns and arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters of EPSG:2039 (GRS 1980): semi-major axis, inverse flattening, origin, scale, false easting and northing.
TM = {"a": 6378137.0, "inv_f": 298.257222101, "lat0": 31.734393611111111, "lon0": 35.204516944444445, "k0": 1.0000067, "fe": 219529.584, "fn": 626907.39}


def _series() -> tuple[float, float, list[float]]:
    n = 1 / (2 * TM["inv_f"] - 1)
    a = TM["a"] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    return n, a, alpha


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres, by the Krüger series to third order (sub-millimetre within some degrees of the meridian).

    The datum's shift against WGS 84, some tens of metres, is not applied: lengths, areas and distances do not need it.
    """
    n, a, alpha = _series()
    e = 2 * math.sqrt(n) / (1 + n)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    conformal = lambda s: F.sinh(atanh(s) - e * atanh(e * s))
    t, dl = conformal(F.sin(F.radians(lat))), F.radians(lon - TM["lon0"])
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    s0 = math.sin(math.radians(TM["lat0"]))
    xi0 = math.atan(math.sinh(math.atanh(s0) - e * math.atanh(e * s0)))
    m0 = xi0 + sum(c * math.sin(2 * (j + 1) * xi0) for j, c in enumerate(alpha))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return TM["k0"] * a * east + TM["fe"], TM["k0"] * a * (north - m0) + TM["fn"]


#: Liang-Barsky clipping of (x1, y1)-(x2, y2) by the box xmin..ymax, as shared expressions.
_P = ("-(x2-x1)", "(x2-x1)", "-(y2-y1)", "(y2-y1)")
_Q = ("(x1-xmin)", "(xmax-x1)", "(y1-ymin)", "(ymax-y1)")
CLIP_STEPS: list[dict[str, str]] = [
    {
        "t0": "greatest(0e0," + ",".join(f"case when {p}<0 then {q}/{p} else 0e0 end" for p, q in zip(_P, _Q, strict=True)) + ")",
        "t1": "least(1e0," + ",".join(f"case when {p}>0 then {q}/{p} else 1e0 end" for p, q in zip(_P, _Q, strict=True)) + ")",
        "outside": " or ".join(f"({p}=0 and {q}<0)" for p, q in zip(_P, _Q, strict=True)),
    },
    {"cx1": "x1+t0*(x2-x1)", "cy1": "y1+t0*(y2-y1)", "cx2": "x1+t1*(x2-x1)", "cy2": "y1+t1*(y2-y1)"},
]
CLIPPED = "not outside and t0<t1"


def rings_contain(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd containment of points in a polygon's rings (holes included); points on an edge are outside."""
    inside, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            edge |= (cross == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
            if ay != by:
                over = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
                inside ^= over
    return inside & ~edge


def clip_line(line: np.ndarray, rings: list[np.ndarray]) -> list[np.ndarray]:
    """Parts of a polyline (n x 2) inside a polygon given by closed rings, in order along the line.

    Segments are cut wherever they cross a ring's edge; pieces whose midpoint is inside are kept and joined where they meet.
    Stretches along an edge count as inside.
    """
    parts: list[list[np.ndarray]] = []
    edges = [(r[:-1], r[1:]) for r in rings]
    for p, q in zip(line[:-1], line[1:], strict=True):
        d = q - p
        cuts = [0.0, 1.0]
        for a, b in edges:
            e = b - a
            det = d[0] * e[:, 1] - d[1] * e[:, 0]
            w = a - p
            with np.errstate(divide="ignore", invalid="ignore"):
                t = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / det
                u = (w[:, 0] * d[1] - w[:, 1] * d[0]) / det
            cuts += t[(det != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)].tolist()
            if (length := float(d @ d)) > 0:
                flat = (det == 0) & (w[:, 0] * d[1] - w[:, 1] * d[0] == 0)
                ends = np.concatenate([(w[flat] @ d) / length, ((b[flat] - p) @ d) / length])
                cuts += ends[(ends > 0) & (ends < 1)].tolist()
        cuts = sorted(set(cuts))
        for t0, t1 in zip(cuts[:-1], cuts[1:], strict=True):
            m = p + d * ((t0 + t1) / 2)
            on = any(np.any((np.abs((b[:, 0] - a[:, 0]) * (m[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (m[0] - a[:, 0])) <= 1e-15) & (np.minimum(a, b) <= m + 1e-15).all(axis=1) & (m - 1e-15 <= np.maximum(a, b)).all(axis=1)) for a, b in edges)
            if on or rings_contain(m[:1], m[1:], rings)[0]:
                s, e = p + d * t0, p + d * t1
                if parts and np.array_equal(parts[-1][-1], s):
                    parts[-1].append(e)
                else:
                    parts.append([s, e])
    return [np.array(x) for x in parts]


def ring_area(ring: np.ndarray) -> float:
    """Signed area of a closed ring."""
    return float(((ring[:-1, 0] * ring[1:, 1]) - (ring[1:, 0] * ring[:-1, 1])).sum() / 2)


def rings_distance(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Distance of points to a polygon: 0 inside or on its edge, else to the nearest edge."""
    out = np.full(len(x), np.inf)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
            dx, dy = bx - ax, by - ay
            length = dx * dx + dy * dy
            t = np.clip(((x - ax) * dx + (y - ay) * dy) / length, 0, 1) if length else np.zeros(len(x))
            out = np.minimum(out, np.hypot(x - ax - t * dx, y - ay - t * dy))
    out[rings_contain(x, y, rings)] = 0
    return out


def buffered_contain(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray], buffer: float, clip: list[np.ndarray]) -> np.ndarray:
    """Whether points lie within `buffer` of one polygon and strictly inside another: a clipped buffer as a predicate."""
    return (rings_distance(x, y, rings) <= buffer) & rings_contain(x, y, clip)
