"""Nearest segment of every location, exactly, on the whole sphere and in one pass.

Points are unit vectors, and cells are cubes of a grid in space, so neither the poles nor the antimeridian are special. A
segment's arc is cut into pieces no longer than a cell; each lies in the cell of its middle. Any point within r of the arc
is within r and half a cell of the middle of a piece: cells that this ball touches hold all candidates.

Grids of several sizes are used at once, each cell four times as wide as the one before. The finest cell that holds a
location together with some piece bounds the distance to its nearest segment; that bound is the location's own radius, and
it searches the grid whose cells are about that wide. So dense regions are searched in small cells and empty ones in large
cells, and no cell has to be chosen for both. A grid finer than those searched bounds distances where segments are many.
Everything is an equi-join on cells, which adaptive execution can split.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import sphere
from waymark.operators import meet
from waymark.sources import staging

FIRST_RADIUS_M, LAST_RADIUS_M = 1000, 1_024_000
#: Width of a grid's cells over that of the next finer one; the finest is a quarter of the mean segment, at least a metre.
WIDER = 4
#: Grids finer than the finest that is searched; they bound distances alone, by the middles of its pieces.
BOUNDING = 1
#: Places within a cell that a witness is rounded to, per axis.
PLACES = 1024
#: Pieces of a segment that are listed at once.
LISTED = 1024
#: Locations that are broadcast to the pieces, at most: some tens of cells each.
FEW = 4096
KEPT = ("location_id", "road_id", "road_class", "distance_m", "near_lon", "near_lat")


def with_units(locations: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    return sphere.with_steps(locations, [sphere.LOCATION_UNIT]), sphere.with_steps(segments, [sphere.SEGMENT_UNIT])


def measured(pairs: DataFrame, closest: bool = True) -> DataFrame:
    return sphere.with_steps(pairs, sphere.STEPS + (sphere.CLOSEST if closest else []))


def _cell(x: str, width: str) -> str:
    """Number of the cell along one axis, from 0 on."""
    return f"cast(floor(({x} + 2e0) / {width}) as bigint)"


#: Two numbers that stand for a cell cx, cy, cz of a grid.
_KEYS = {"ga": f"cx * {1 << 31}L + cy", "gb": "cz * 64L + level"}


def _grids(finest: float) -> dict[int, float]:
    """Widths of cells by level, from the finest to one cell that holds everything."""
    out = [finest]
    while out[-1] < 4:
        out.append(out[-1] * WIDER)
    return dict(enumerate(out))


def _each_level(source: str, widths: dict[int, float]) -> str:
    """The rows of a source with level and width, one for each grid."""
    grids = ", ".join(f"named_struct('level', {k}L, 'width', {w!r}D)" for k, w in widths.items())
    return f"(select * except (g), g.level as level, g.width as width from (select *, explode(array({grids})) as g from {source}))"


def _pieces(source: str, widths: dict[int, float], least: float = 0.0) -> str:
    """Segments with ga, gb, level, width, mx, my, mz, cx, cy, cz, piece, of: a row for each piece in each grid. Segments without
    coordinates have none. least: pieces are cut no shorter, however small the cells.

    Steps along the chord are longest where it is nearest to the centre, by the factor 1 / sqrt(1 - chord^2 / 4).
    """
    known = f"(select *, (ax-ex)*(ax-ex)+(ay-ey)*(ay-ey)+(az-ez)*(az-ez) as chord2 from {source})"
    each = _each_level(f"(select * from {known} where chord2 is not null and not isnan(chord2))", widths)
    steps = [
        {"of": f"greatest(1L, ceil(sqrt(chord2) / sqrt(greatest(1e-3, 1e0 - chord2 / 4e0)) / greatest(width, {least!r}D) * 1.000000001e0))"},
        {"first": f"explode(sequence(0L, of - 1L, {LISTED}L))"},
        {"piece": f"explode(sequence(first, least(first + {LISTED - 1}L, of - 1L)))"},
        {"t": "(piece + 0.5e0) / of"},
        {f"u{c}": f"a{c} + t * (e{c} - a{c})" for c in "xyz"},
        {"uu": "sqrt(ux*ux + uy*uy + uz*uz)"},
        {f"m{c}": f"u{c} / uu" for c in "xyz"},
        {f"c{c}": _cell(f"m{c}", "width") for c in "xyz"},
        _KEYS,
    ]
    return sphere.steps_sql(each, steps)


def _around(source: str) -> str:
    """Rows of a source (px, py, pz, level, width, reach) with ga and gb, one for each cell that the ball about the point
    touches, without the cells that lie wholly inside or outside of the sphere."""
    for c in "xyz":
        source = sphere.steps_sql(source, [{f"c{c}": f"explode(sequence({_cell(f'(p{c} - reach)', 'width')}, {_cell(f'(p{c} + reach)', 'width')}))"}])
    low, high = ({c: f"((c{c} + {k}) * width - 2e0)" for c in "xyz"} for k in (0, 1))
    near = " + ".join(f"pow(greatest({low[c]}, -{high[c]}, 0e0), 2)" for c in "xyz")
    far = " + ".join(f"pow(greatest(abs({low[c]}), abs({high[c]})), 2)" for c in "xyz")
    return sphere.steps_sql(f"(select * from {source} where {near} <= 1.000000001e0 and {far} >= 0.999999999e0)", [_KEYS])


def _finest(segments: DataFrame) -> float | None:
    """Width of the finest cells; None if there are no segments."""
    chord = F.expr("sqrt((ax-ex)*(ax-ex)+(ay-ey)*(ay-ey)+(az-ez)*(az-ez))")
    units = sphere.with_steps(segments.select("x1", "y1", "x2", "y2"), [sphere.SEGMENT_UNIT])
    row = units.agg(F.avg(F.nanvl(chord, F.lit(None).cast("double"))).alias("mean")).first()
    return None if row["mean"] is None else max(row["mean"] / 4, 1 / sphere.RADIUS)


def _bounded(places: str, pieces: str, widths: dict[int, float]) -> str:
    """location_id, px, py, pz, most: no location is farther than `most` (a chord) from its nearest segment.

    The witness of a cell is the place of one piece in it, rounded; as the coarsest cell holds all, everyone has one.
    """
    rounded = [f"cast(least(floor(((m{c} + 2e0) / width - c{c}) * {PLACES}), {PLACES - 1}) as bigint)" for c in "xyz"]
    place = f"({rounded[0]} * {PLACES} + {rounded[1]}) * {PLACES} + {rounded[2]}"
    witness = f"(select ga as wa, gb as wb, min({place}) as place from {pieces} group by ga, gb)"
    own = sphere.steps_sql(_each_level(places, widths), [{f"c{c}": _cell(f"p{c}", "width") for c in "xyz"}, _KEYS])
    bits = {"x": f"(place div {PLACES**2})", "y": f"(place div {PLACES}) % {PLACES}", "z": f"place % {PLACES}"}
    gap = " + ".join(f"pow(p{c} + 2e0 - (c{c} + ({v} + 0.5e0) / {PLACES}) * width, 2)" for c, v in bits.items())
    return f"(select /*+ merge(o, w) */ location_id, px, py, pz, min(sqrt({gap}) + width / {PLACES}e0) as most from {own} as o join {witness} as w on ga = wa and gb = wb group by location_id, px, py, pz)"


def _radius(first_m: float) -> str:
    """The first of first_m, 2 first_m, 4 first_m, ... that reaches the distance."""
    first = f"{float(first_m)!r}D"
    r = f"(case when distance_m <= {first} then {first} else {first} * pow(2e0, ceil(log2(distance_m / {first}))) end)"
    # The logarithm is rounded; the radius must be the least that reaches.
    return f"case when {r} < distance_m then {r} * 2 when {r} > {first} and {r} / 2 >= distance_m then {r} / 2 else {r} end"


def nearest(locations: DataFrame, segments: DataFrame, first_radius_m: float = FIRST_RADIUS_M) -> DataFrame:
    """location_id, road_id, road_class, distance_m, near_lon, near_lat, radius_m (the first of the doubled radii from
    first_radius_m on that reaches the segment). Ties go to the smaller road_id as text, null last.

    It is an error if a location has no coordinates and, when the rows are read, if it has no segment within LAST_RADIUS_M. No
    locations: no rows. Segments without coordinates take no part. Rows of one location_id are one location of several
    places. Arcs of up to 170 degrees are exact.
    """
    spark = locations.sparkSession
    locations, segments = locations.select("location_id", "lon", "lat"), segments.select("road_id", "road_class", "x1", "y1", "x2", "y2")
    finest = _finest(segments)
    if finest is None:
        if locations.isEmpty():
            return locations.selectExpr("location_id", "'' as road_id", "'' as road_class", "0e0 as distance_m", "0e0 as near_lon", "0e0 as near_lat", "0e0 as radius_m")
        raise RuntimeError("no segments")
    widths = _grids(finest)
    ends = ", ".join(f"{p}{c}" for p in "ae" for c in "xyz")
    # Few statements, as each step of a DataFrame would analyse all steps before it again.
    made = lambda grids: _pieces(f"(select road_id, road_class, {ends} from {sphere.unit_sql('{segments}', sphere.SEGMENT_UNIT)})", grids, finest)
    bounding = {-k: finest / WIDER**k for k in range(BOUNDING, 0, -1)} | widths
    wrong = "lon is null or isnan(lon) or lat is null or isnan(lat)"
    placed = f"(select location_id, case when {wrong} then raise_error('a location without coordinates') else px end as px, py, pz from {sphere.unit_sql('{locations}', sphere.LOCATION_UNIT)})"
    level = f"cast(least(greatest(ceil(log2(most / {finest!r}D) / {math.log2(WIDER)!r}D), 0), {len(widths) - 1}) as bigint)"
    width = f"element_at(array({', '.join(f'{w!r}D' for w in widths.values())}), cast(level as int) + 1)"
    bound = sphere.steps_sql(_bounded(placed, "pieces", bounding), [{"level": level}, {"width": width}, {"reach": "(most + width / 2e0) * 1.000000001e0 + 1e-12"}])
    # The bounds say which grids are searched; the others' pieces are not made, moved and packed.
    bounds = staging.staged(spark.sql(f"with pieces as (select * from {made(bounding)}) select * from {bound}", locations=locations, segments=segments), "nearest-bounds")
    asking = {r["level"]: r["count"] for r in bounds.groupBy("level").count().collect()}
    searched = {k: widths[k] for k in asking} or widths
    pieces = spark.sql(f"select road_id, road_class, {ends}, piece, of, ga, gb from {made(searched)}", segments=segments)
    asked = spark.sql(f"select location_id, px, py, pz, most, ga, gb from {_around('{bounds}')}", bounds=bounds)
    pairs = meet.could_be_nearest(asked, pieces, ["ga", "gb"], ["location_id", "px", "py", "pz", "road_id", "road_class", *ends.split(", ")], sum(asking.values()) <= FEW)
    best = f"(select location_id, min(struct(distance_m, road_id is null as last, road_id, road_class, {ends}, px, py, pz)) as w from {sphere.steps_sql('{pairs}', sphere.STEPS)} group by location_id)"
    won = sphere.steps_sql(f"(select location_id, w.* except (distance_m, last) from {best})", sphere.STEPS + sphere.CLOSEST)
    far = f"case when distance_m > {LAST_RADIUS_M} then raise_error('a location without a segment within {LAST_RADIUS_M} m') else {_radius(first_radius_m)} end as radius_m"
    return spark.sql(f"select {', '.join(KEPT)}, {far} from {won}", pairs=pairs)


def exhaustive(locations: DataFrame, segments: DataFrame) -> DataFrame:
    """The nearest segment by all pairs, without cells: every pair is held against a bound, alone or with all pairs of two lists, and
    the distances of those that could be nearest decide. As in SQL, a pair without all coordinates counts as half a meridian apart."""
    segments = segments.select("road_id", "road_class", "x1", "y1", "x2", "y2")
    places, lines = with_units(locations.select("location_id", "lon", "lat"), segments)
    ends = [f"{p}{c}" for p in "ae" for c in "xyz"]
    sound = lambda *columns: F.expr(" and ".join(f"{c} is not null and not isnan({c})" for c in columns))
    lines, odd = lines.select("road_id", "road_class", *ends), places.where(~sound("px", "pz"))
    whole = lines.where(sound(*ends)).withColumns({"piece": F.lit(0), "of": F.lit(1)})
    tasks = max(2 * places.sparkSession.sparkContext.defaultParallelism, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["location_id", "px", "py", "pz", "road_id", "road_class", *ends]
    pairs = meet.could_be_nearest_of_all(places.where(sound("px", "pz")).select(*names[:4]), whole, names, tasks)
    # Segments without coordinates are all as far away: the first by road_id stands for them.
    last = lines.where(~sound(*ends)).agg(F.min(F.struct(F.col("road_id").isNull().alias("last"), *lines.columns)).alias("w")).where("w is not null").select("w.*")
    for some, others in ((odd, lines), (places, last)):
        pairs = pairs.unionByName(some.crossJoin(others.hint("shuffle_replicate_nl")).select(*names))
    pairs = measured(pairs)
    order = F.struct("distance_m", F.col("road_id").isNull().alias("last"), "road_id", "road_class", "near_lon", "near_lat")
    return pairs.groupBy("location_id").agg(F.min(order).alias("w")).select("location_id", "w.*").select(*KEPT)


def within(locations: DataFrame, segments: DataFrame, radius_m: float, names: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """All pairs within a radius, each once for each pair of rows: all columns of both, distance_m, near_lon, near_lat; or those in
    names, so that a pair costs no more than what is asked of it. digits: decimals that distance_m is rounded to.

    Cells are as wide as the radius, or as a quarter of the mean segment where that is more. Rows without coordinates have
    no pairs.
    """
    return meet.within(*_asked(locations, segments, radius_m), ["ga", "gb"], radius_m, names, digits)


def covered(locations: DataFrame, segments: DataFrame, radius_m: float) -> DataFrame:
    """location_id, once each, of the locations with a segment within a radius: no pairs are made."""
    asked, pieces = _asked(locations.select("location_id", "lon", "lat"), segments.select("x1", "y1", "x2", "y2"), radius_m)
    return meet.covered(asked, pieces, ["ga", "gb"], radius_m, ["location_id"]).distinct()


def _asked(locations: DataFrame, segments: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """Locations with ga and gb, a row for each cell that pieces within the radius can be in, and pieces with their cell."""
    spark = locations.sparkSession
    radius = radius_m / sphere.RADIUS
    width = max(radius, _finest(segments) or radius, 1 / sphere.RADIUS)
    real = f"(select * from {sphere.unit_sql('{locations}', sphere.LOCATION_UNIT)} where not (px is null or isnan(px) or pz is null or isnan(pz)))"
    asked = _around(f"(select *, 0L as level, {width!r}D as width, {(radius + width / 2) * (1 + 1e-9) + 1e-12!r}D as reach from {real})")
    extra = "level, width, chord2, first, t, uu, ux, uy, uz, mx, my, mz, cx, cy, cz"
    pieces = spark.sql(f"select * except ({extra}) from {_pieces(sphere.unit_sql('{segments}', sphere.SEGMENT_UNIT), {0: width})}", segments=segments)
    return spark.sql(f"select * except (level, width, reach, cx, cy, cz) from {asked}", locations=locations), pieces


def unresolved(locations: DataFrame, hits: DataFrame) -> DataFrame:
    return locations.join(hits.select("location_id").hint("merge"), "location_id", "left_anti")
