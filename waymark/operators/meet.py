"""Locations and pieces of segments that meet in a cell, held against each other in blocks.

A join of rows would make a row for each pair. Here rows of a cell are packed into lists first, the lists are joined on the
cell, and numpy goes through the pairs of two lists: bounds for every pair, the distance for those that the bounds leave.
No cell has to lie in one task: a large one is several lists, and adaptive execution can split the join.

Spark takes lists, and what explode() makes, for about as large as the files that they come from. Left to itself it broadcasts
tables of which the driver can hold neither the rows nor the hash table, so joins on cells say that both sides are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import sphere
from waymark.sources import staging

#: Rows of a list at most; pairs that are held at once.
BLOCK_ROWS, PAIRS_AT_ONCE = 512, 1 << 18
#: Rows of both lists from which a matrix product is worth its call.
DENSE = 128
#: Bytes of an Arrow batch at most; stays set in the session.
BATCH_BYTES = 16 << 20
#: What rounding may add to a bound: a chord, and what is divided by the length of a segment's normal.
SLACK, NORMAL_SLACK = 1e-12, 4e-15

#: Columns that the kernels read.
_OF_PLACES, _OF_PIECES = ("px", "py", "pz"), ("ax", "ay", "az", "ex", "ey", "ez", "piece", "of")

Batches = Iterator[pa.RecordBatch]


def _packed(batches: Batches, keys: list[str]) -> Batches:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        first = np.zeros(n, bool)
        first[0] = True
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            first[1:] |= v[1:] != v[:-1]
        begins = np.flatnonzero(first)
        first |= (np.arange(n) - np.repeat(begins, np.diff(begins, append=n))) % BLOCK_ROWS == 0
        begins = np.flatnonzero(first)
        rest = [c for c in batch.schema.names if c not in keys]
        rows = pa.StructArray.from_arrays([batch.column(c) for c in rest], rest)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, n).astype(np.int32)), rows)
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(begins)) for k in keys), lists], [*keys, "rows"])


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and rows: lists of rows that share the keys, which have no nulls; several for one key where there are many."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    item = T.StructType([f for f in rows.schema.fields if f.name not in keys])
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("rows", T.ArrayType(item))])
    if keys:
        rows = rows.hint("rebalance", *keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(lambda batches: _packed(batches, keys), schema)


def _numbers(rows: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])


class Pieces:
    """Pieces of segments (ax..ez, piece, of) as arrays, with a middle, how far the piece's points are from it, and the normal."""

    def __init__(self, rows: pa.RecordBatch):
        self.a, self.e = (_numbers(rows, [f"{p}{c}" for c in "xyz"]) for p in "ae")
        self.piece, self.of = _numbers(rows, ["piece", "of"])
        first, self.middle, last = (self._at((self.piece + k) / self.of) for k in (0, 0.5, 1))
        self.half = np.sqrt(np.maximum(*(((self.middle - x) ** 2).sum(0) for x in (first, last))))
        (ax, ay, az), (ex, ey, ez) = self.a, self.e
        self.n = np.stack([ay * ez - az * ey, az * ex - ax * ez, ax * ey - ay * ex])
        self.nn = self.n[0] * self.n[0] + self.n[1] * self.n[1] + self.n[2] * self.n[2]
        length = np.sqrt(np.maximum(self.nn, 1e-300))
        self.loose = NORMAL_SLACK / length
        self.normal = self.n / length

    def _at(self, t: np.ndarray) -> np.ndarray:
        u = self.a + t * (self.e - self.a)
        return u / np.sqrt(np.maximum((u * u).sum(0), 1e-300))


def _angles(p: np.ndarray, s: Pieces, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sphere.STEPS and the point of sphere.CLOSEST for places p and the segments of pieces k: angles, and points."""
    (px, py, pz), (nx, ny, nz), (ax, ay, az), (ex, ey, ez), nn = p, s.n[:, k], s.a[:, k], s.e[:, k], s.nn[k]
    pn = px * nx + py * ny + pz * nz
    cx, cy, cz = px * nn - nx * pn, py * nn - ny * pn, pz * nn - nz * pn
    inside = (nn > 0) & ((ay * cz - az * cy) * nx + (az * cx - ax * cz) * ny + (ax * cy - ay * cx) * nz >= 0)
    inside &= (cy * ez - cz * ey) * nx + (cz * ex - cx * ez) * ny + (cx * ey - cy * ex) * nz >= 0
    da = (px - ax) * (px - ax) + (py - ay) * (py - ay) + (pz - az) * (pz - az)
    de = (px - ex) * (px - ex) + (py - ey) * (py - ey) + (pz - ez) * (pz - ez)
    with np.errstate(divide="ignore", invalid="ignore"):
        across = np.arcsin(np.minimum(1, np.abs(pn) / np.sqrt(nn)))
        c = np.stack([cx, cy, cz]) / np.sqrt(cx * cx + cy * cy + cz * cz)
    angle = np.where(inside, across, 2 * np.arcsin(np.minimum(1, np.sqrt(np.minimum(da, de)) / 2)))
    return angle, np.where(inside, c, np.where(da <= de, s.a[:, k], s.e[:, k]))


def _runs(batch: pa.RecordBatch, nearest: bool = False) -> Iterator[tuple]:
    """For parts of a batch (places, pieces: two lists each row): the rows of both, places as an array, Pieces, and for each
    pair the place and the piece; pairs of a place are neighbours. nearest: without some pairs of which another is nearer."""
    (pl, sl), (places, pieces) = (tuple(batch.column(c).value_lengths().to_numpy() for c in ("places", "pieces")), (pa.RecordBatch.from_struct_array(batch.column(c).flatten()) for c in ("places", "pieces")))
    if not places.num_rows or not pieces.num_rows:
        return
    p, s = _numbers(places, ["px", "py", "pz"]), Pieces(pieces)
    pe, se = np.cumsum(pl), np.cumsum(sl)
    dense = nearest & (np.minimum(pl, sl) >= DENSE)
    most = _numbers(places, ["most"])[0] if "most" in places.schema.names else np.full(places.num_rows, 2.0)
    for b in np.flatnonzero(dense):
        i, k = _dense(p, s, pe[b] - pl[b], pe[b], se[b] - sl[b], se[b], most)
        if len(i):
            yield places, pieces, p, s, i, k
    many, start = np.repeat(np.where(dense, 0, sl), pl).astype(np.int64), np.repeat(se - sl, pl).astype(np.int64)
    ends = np.cumsum(many)
    at = 0
    while at < len(many):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        n = many[at:to]
        i = np.repeat(np.arange(at, to), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start[at:to], n)
        if len(i):
            yield places, pieces, p, s, i, k
        at = to


def _dense(p: np.ndarray, s: Pieces, p0: int, p1: int, s0: int, s1: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of two long lists without those whose piece is surely farther than another's middle, by one matrix product;
    chords from it are rounded by some 1e-8."""
    dot = p[:, p0:p1].T @ s.middle[:, s0:s1]
    bound = np.minimum(np.sqrt(np.maximum(0, 2 - 2 * dot.max(1))), most[p0:p1]) + 1e-7
    i, k = np.nonzero(dot >= 1 - (bound[:, None] + s.half[s0:s1]) ** 2 / 2 - 1e-14)
    return i + p0, k + s0


def _chord(p: np.ndarray, s: Pieces, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """From places to the middles of pieces."""
    x, y, z = (p[c][i] - s.middle[c][k] for c in range(3))
    return np.sqrt(x * x + y * y + z * z)


def _beside(p: np.ndarray, s: Pieces, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """From places to the planes of segments: no point of the segment is nearer."""
    return np.abs(p[0][i] * s.normal[0][k] + p[1][i] * s.normal[1][k] + p[2][i] * s.normal[2][k]) - s.loose[k]


def _least(i: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each pair's least value among its place's pairs."""
    begins = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    return np.repeat(np.minimum.reduceat(values, begins), np.diff(begins, append=len(i)))


def _rows(places: pa.RecordBatch, pieces: pa.RecordBatch, i: np.ndarray, k: np.ndarray, more: dict, names: list[str]) -> pa.RecordBatch:
    def column(c: str):
        if c in more:
            return pa.array(more[c])
        return places.column(c).take(pa.array(i)) if c in places.schema.names else pieces.column(c).take(pa.array(k))

    return pa.RecordBatch.from_arrays([column(c) for c in names], names)


def _could_be_nearest(batches: Batches, names: list[str]) -> Batches:
    for batch in batches:
        for places, pieces, p, s, i, k in _runs(batch, True):
            chord = _chord(p, s, i, k)
            least = chord - s.half[k]
            bound = _least(i, chord)
            if "most" in places.schema.names:
                bound = np.minimum(bound, _numbers(places, ["most"])[0][i])
            kept = np.flatnonzero(least <= bound + SLACK)
            i, k, bound = i[kept], k[kept], bound[kept]
            kept = np.flatnonzero(_beside(p, s, i, k) <= bound + SLACK)
            i, k, bound = i[kept], k[kept], bound[kept]
            if not len(i):
                continue
            angle = _angles(p[:, i], s, k)[0]
            slack = SLACK + s.loose[k]
            # A chord is no longer than its arc, and a bound is a chord.
            kept = (angle <= _least(i, angle + slack) + slack) & (2 * np.sin(angle / 2) <= bound + SLACK + slack)
            if kept.any():
                yield _rows(places, pieces, i[kept], k[kept], {}, names)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Metres as round() of SQL has them, half up by their decimal digits; those are made only where the product leaves the half in
    doubt."""
    scaled = x * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    doubt = np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-6 + 4 * np.spacing(scaled)
    out[doubt] = [float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in x[doubt].tolist()]
    return out


def _within(batches: Batches, radius_m: float, names: list[str], digits: int | None) -> Batches:
    reach = radius_m / sphere.RADIUS * (1 + 1e-9) + SLACK  # a chord is no longer than its arc
    for batch in batches:
        for places, pieces, p, s, i, k in _runs(batch):
            kept = np.flatnonzero(_chord(p, s, i, k) - s.half[k] <= reach)
            i, k = i[kept], k[kept]
            kept = np.flatnonzero(_beside(p, s, i, k) <= reach)
            i, k = i[kept], k[kept]
            angle, q = _angles(p[:, i], s, k)
            # A pair meets at several pieces; the one with the closest point on it counts. Sines of the arcs to both ends say where it is.
            d = [((q - end[:, k]) ** 2).sum(0) for end in (s.a, s.e)]
            sa, se = (np.sqrt(x) * np.sqrt(np.maximum(0, 1 - x / 4)) for x in d)
            share = np.divide(sa, sa + se, out=np.zeros_like(sa), where=sa + se > 0)
            distance = angle * sphere.RADIUS
            kept = (distance <= radius_m) & (np.minimum(np.floor(share * s.of[k]), s.of[k] - 1) == s.piece[k])
            if kept.any():
                (x, y, z), rad = q[:, kept], float(sphere.RAD.removesuffix("e0"))
                more = {"distance_m": distance[kept] if digits is None else rounded(distance[kept], digits)}
                if "near_lon" in names or "near_lat" in names:
                    more |= {"near_lon": np.arctan2(y, x) / rad, "near_lat": np.arcsin(np.clip(z, -1, 1)) / rad}
                yield _rows(places, pieces, i[kept], k[kept], more, names)


def _covered(batches: Batches, radius_m: float, names: list[str]) -> Batches:
    radius = radius_m / sphere.RADIUS
    reach, sure = radius * (1 + 1e-9) + SLACK, 2 * np.sin(min(radius, 3) / 2) * (1 - 1e-9) - SLACK
    for batch in batches:
        for places, pieces, p, s, i, k in _runs(batch):
            chord = _chord(p, s, i, k)
            least = _least(i, chord)
            found = [i[chord <= sure]]
            kept = np.flatnonzero((least > sure) & (chord - s.half[k] <= reach))
            found.append(i[kept][_angles(p[:, i[kept]], s, k[kept])[0] * sphere.RADIUS <= radius_m])
            i = np.unique(np.concatenate(found))
            if len(i):
                yield _rows(places, pieces, i, i, {}, names)


def _met(places: DataFrame, pieces: DataFrame, keys: list[str], kernel: Callable[[Batches], Batches], schema: T.StructType, few: bool = False) -> DataFrame:
    """few: places are known to be few, so that they are broadcast."""
    how = "broadcast(p)" if few else "merge(p, s)" if keys else "shuffle_replicate_nl(p, s)"
    both = f"select /*+ {how} */ p.rows as places, s.rows as pieces from {{p}} as p " + (f"join {{s}} as s using ({', '.join(keys)})" if keys else "cross join {s} as s")
    p, s = packed(places, keys), packed(pieces, keys)
    return places.sparkSession.sql(both, p=p, s=s).mapInArrow(kernel, schema)


def _fields(places: DataFrame, pieces: DataFrame, names: list[str] | None, dropped: set[str]) -> list[T.StructField]:
    every = {f.name: f for d in (pieces, places) for f in d.schema.fields}
    return [every[c] for c in (names or [c for d in (places, pieces) for c in d.columns if c not in dropped])]


def could_be_nearest(places: DataFrame, pieces: DataFrame, keys: list[str], names: list[str], few: bool = False) -> DataFrame:
    """Columns of places (px, py, pz; most: a chord in which it has a segment) and pieces for pairs that meet and of which no other
    in the same lists is surely nearer. few: places are broadcast."""
    schema = T.StructType(_fields(places, pieces, names, set()))
    return _met(places, pieces, keys, lambda batches: _could_be_nearest(batches, names), schema, few)


def within(places: DataFrame, pieces: DataFrame, keys: list[str], radius_m: float, names: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Columns of both, distance_m, near_lon, near_lat: pairs within the radius, each once. names: these columns alone; others are
    neither packed nor made. digits: distance_m rounded to so many decimals."""
    numbers = [T.StructField(c, T.DoubleType()) for c in ("distance_m", "near_lon", "near_lat")]
    every = _fields(places, pieces, None, {*keys, "piece", "of"}) + numbers
    schema = T.StructType([f for c in names for f in every if f.name == c] if names else every)
    names = schema.names
    places, pieces = (d.select(*(c for c in d.columns if c in {*keys, *needed, *names})) for d, needed in ((places, _OF_PLACES), (pieces, _OF_PIECES)))
    return _met(places, pieces, keys, lambda batches: _within(batches, radius_m, names, digits), schema)


def covered(places: DataFrame, pieces: DataFrame, keys: list[str], radius_m: float, names: list[str]) -> DataFrame:
    """Columns of places within the radius of a piece that they meet, once for each pair of lists at most."""
    schema = T.StructType(_fields(places, pieces, names, set()))
    return _met(places, pieces, keys, lambda batches: _covered(batches, radius_m, names), schema)


#: Lists of neighbours: all of a list lies within `reach` of (bx, by, bz); (wx, wy, wz) is a point of one of its segments.
_BALL = ("bx", "by", "bz", "wx", "wy", "wz", "reach")
#: Bits of a whole number, each moved to three times its place.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _balls(batches: Batches, of_pieces: bool) -> Batches:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        s = Pieces(batch) if of_pieces else None
        at, half = (s.middle, s.half) if s else (_numbers(batch, ["px", "py", "pz"]), np.zeros(n))
        begins = np.arange(0, n, BLOCK_ROWS)
        many = np.diff(begins, append=n)
        centre = np.add.reduceat(at, begins, axis=1) / many
        away = np.sqrt(((at - np.repeat(centre, many, axis=1)) ** 2).sum(0))
        middle = [b + int(away[b : b + m].argmin()) for b, m in zip(begins, many, strict=True)]
        reach = np.maximum.reduceat(away + half, begins)
        rows = pa.StructArray.from_arrays(batch.columns, batch.schema.names)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, n).astype(np.int32)), rows)
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (*centre, *at[:, middle], reach)), lists], [*_BALL, "rows"])


def in_balls(rows: DataFrame, at: dict[str, str], of_pieces: bool) -> DataFrame:
    """id, what _BALL names and rows, staged: lists of neighbours, by the places x, y, z in the unit ball that `at` gives."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    steps = [{c: f"cast(floor(({v} + 1e0) * 1048575e0) as bigint)" for c, v in at.items()}]
    steps += [{c: f"({c} | shiftleft({c}, {k})) & {mask}L" for c in at} for k, mask in _SPREAD]
    key, (x, y, z) = "__key", at
    ordered = sphere.with_steps(rows, [*steps, {key: f"{x} | shiftleft({y}, 1) | shiftleft({z}, 2)"}]).drop(*at)
    item = T.StructType([f for f in rows.schema.fields])
    schema = T.StructType([*(T.StructField(c, T.DoubleType()) for c in _BALL), T.StructField("rows", T.ArrayType(item))])
    lists = ordered.repartitionByRange(key).sortWithinPartitions(key).drop(key).mapInArrow(lambda batches: _balls(batches, of_pieces), schema)
    return staging.staged(lists.withColumn("id", F.monotonically_increasing_id()), "neighbours")


def _with_most(batches: Batches) -> Batches:
    for batch in batches:
        (places, pieces), (pl, sl) = ([batch.column(c).flatten() for c in ("places", "pieces")], [batch.column(c).value_lengths().to_numpy() for c in ("places", "pieces")])
        if not len(places):
            continue
        p, s = _numbers(pa.RecordBatch.from_struct_array(places), ["px", "py", "pz"]), Pieces(pa.RecordBatch.from_struct_array(pieces))
        pe, se = np.cumsum(pl), np.cumsum(sl)
        most = np.concatenate([np.sqrt(np.maximum(0, 2 - 2 * (p[:, b - m : b].T @ s.middle[:, e - k : e]).max(1))) + 1e-7 for b, m, e, k in zip(pe, pl, se, sl, strict=True)])
        names = [f.name for f in places.type]
        rows = pa.StructArray.from_arrays([*places.flatten(), pa.array(most)], [*names, "most"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, pe).astype(np.int32)), rows)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _BALL), pa.array(np.maximum.reduceat(most, pe - pl)), lists], [*_BALL, "most", "rows"])


def could_be_nearest_of_all(places: DataFrame, pieces: DataFrame, names: list[str], tasks: int) -> DataFrame:
    """As could_be_nearest, with every list of places held against every list of pieces: by the balls that they lie in, and by their
    rows unless all pieces of the one are surely farther from all places of the other than what each has in a list nearby."""
    spark = places.sparkSession
    p = in_balls(places, {f"__{c}": f"p{c}" for c in "xyz"}, False)
    s = in_balls(pieces, {f"__{c}": f"(a{c} + e{c}) / 2e0" for c in "xyz"}, True)
    gap = lambda of: " + ".join(f"(p.b{c} - s.{of}{c}) * (p.b{c} - s.{of}{c})" for c in "xyz")
    closest = f"(select /*+ shuffle_replicate_nl(p, s) */ p.id as id, min_by(s.id, {gap('w')}) as other from {{p}} as p cross join {{s}} as s group by p.id)"
    balls = ", ".join(f"p.{c}" for c in _BALL)
    met = spark.sql(f"select /*+ merge(p, n, s) */ {balls}, p.rows as places, s.rows as pieces from {{p}} as p join {closest} as n on p.id = n.id join {{s}} as s on n.other = s.id", p=p, s=s)
    item = T.StructType([*p.schema["rows"].dataType.elementType.fields, T.StructField("most", T.DoubleType())])
    schema = T.StructType([*(p.schema[c] for c in _BALL), T.StructField("most", T.DoubleType()), T.StructField("rows", T.ArrayType(item))])
    # Few bytes make many pairs: lists are dealt over all cores.
    bounded = met.mapInArrow(_with_most, schema).repartition(tasks)
    both = f"select /*+ shuffle_replicate_nl(p, s) */ p.rows as places, s.rows as pieces from {{p}} as p join {{s}} as s on {gap('b')} <= pow(p.reach + s.reach + p.most + 1e-9, 2)"
    schema = T.StructType(_fields(places, pieces, names, set()))
    return spark.sql(both, p=bounded, s=s).mapInArrow(lambda batches: _could_be_nearest(batches, names), schema)
