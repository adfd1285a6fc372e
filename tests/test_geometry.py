import math

import numpy as np
import pytest

from waymark.functions import planar, sphere, wkb
from waymark.operators import nearest, points, results, roads

SQUARE = [np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], float)]
HOLED = [*SQUARE, np.array([[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]], float)]


def test_codec_and_line_parts():
    a, b = np.array([[0, 0], [1, 1]], float), np.array([[1, 1], [2, 1]], float)
    both = wkb.multi(wkb.MULTILINE, [wkb.line(a), wkb.line(b)])
    assert [p.tolist() for p in wkb.line_parts(wkb.decode(both))] == [a.tolist(), b.tolist()]
    assert [p.tolist() for p in wkb.line_parts(wkb.decode(wkb.line(a)))] == [a.tolist()]
    assert wkb.line_parts(wkb.decode(wkb.polygon(SQUARE))) == []
    nested = wkb.multi(wkb.COLLECTION, [both, wkb.line(b)])
    assert len(wkb.line_parts(wkb.decode(nested))) == 1
    assert wkb.text(wkb.decode(wkb.point(34.5, 31.25))) == "POINT (34.5 31.25)"
    assert wkb.text(wkb.decode(both)) == "MULTILINESTRING ((0 0, 1 1), (1 1, 2 1))"


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ([[-5, 5], [15, 5]], [[[0, 5], [4, 5]], [[6, 5], [10, 5]]]),
        ([[1, 1], [2, 2], [3, 1]], [[[1, 1], [2, 2], [3, 1]]]),
        ([[-1, -1], [-2, 5]], []),
        ([[-5, 0], [5, 0]], [[[0, 0], [5, 0]]]),
        ([[5, 2], [20, 2], [20, 8], [5, 8]], [[[5, 2], [10, 2]], [[10, 8], [5, 8]]]),
    ],
)
def test_clip_with_a_hole(line, want):
    got = planar.clip_line(np.array(line, float), HOLED)
    assert [p.tolist() for p in got] == want


def test_containment_is_strict():
    x, y = np.array([5.0, 0.0, 2.0, 4.0, 5.0, 11.0]), np.array([5.0, 5.0, 2.0, 5.0, 3.0, 5.0])
    assert planar.rings_contain(x, y, HOLED).tolist() == [False, False, True, False, True, False]


def test_polygon_clip_numbers_before_it_drops(spark):
    rows = [("a", "primary", bytearray(wkb.line(np.array([[-5, 5], [15, 5]], float)))), ("b", "path", None)]
    got = roads.polygon_clip(spark.createDataFrame(rows, "id string, road_class string, geometry binary"), [r.tolist() for r in HOLED]).collect()
    assert sorted((r.road_id, r.length) for r in got) == [("a#0", 4.0), ("a#1", 4.0)]


def test_projection_and_points(spark):
    df = spark.createDataFrame([(35.204516944444445, 31.734393611111111), (35.2, 32.0), (35.2, 32.001)], "lon double, lat double")
    e, n = planar.project(df.lon, df.lat)
    got = df.select(e.alias("e"), n.alias("n")).collect()
    assert abs(got[0].e - 219529.584) < 1e-3 and abs(got[0].n - 626907.39) < 1e-3
    assert abs((got[2].n - got[1].n) - 110.889) < 0.02
    assert points.draw(SQUARE, 500, 7).tolist() == points.draw(SQUARE, 500, 7).tolist()
    assert planar.rings_contain(*points.draw(HOLED, 300, 1).T, HOLED).all()
    assert points.draw(SQUARE, 0, 1).shape == (0, 2)


LOCATIONS = "location_id long, lon double, lat double"
SEGMENTS = "road_id string, road_class string, x1 double, y1 double, x2 double, y2 double"


def test_nearest_by_hand(spark):
    locations = spark.createDataFrame([(1, 0.5, 0.1), (2, 3.0, 0.0)], LOCATIONS)
    segments = spark.createDataFrame([("s#10", "a", 0.0, 0.0, 1.0, 0.0), ("s#2", "a", 0.0, 0.0, 1.0, 0.0), ("t", "a", 1.0, 0.0, 2.0, 0.0)], SEGMENTS)
    got = {r.location_id: r for r in nearest.nearest(locations, segments).collect()}
    assert got[1].road_id == "s#10"  # text order
    assert abs(got[1].distance_m - math.radians(0.1) * sphere.RADIUS) < 1e-3 and abs(got[1].near_lat) < 1e-9
    assert got[2].road_id == "t" and got[2].radius_m == 128_000 and abs(got[2].near_lon - 2) < 1e-9
    assert nearest.nearest(locations.limit(0), segments).count() == 0
    with pytest.raises(RuntimeError):
        nearest.nearest(locations, segments.limit(0))


def test_grid_equals_exhaustive_with_long_segments(spark):
    rng = np.random.default_rng(5)
    locations = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([-20, 40], [20, 70], (60, 2)))], LOCATIONS)
    ends = rng.uniform([-20, 40], [20, 70], (40, 2))
    segments = spark.createDataFrame([(f"r{i}", "a", float(x), float(y), float(x + dx), float(y + dy)) for i, ((x, y), (dx, dy)) in enumerate(zip(ends, rng.uniform(-6, 6, (40, 2)), strict=True))], SEGMENTS)
    a, b = nearest.nearest(locations, segments, 64_000), nearest.exhaustive(locations, segments)
    assert results.difference(a, b, 1e-6).where("failed or not same_road").count() == 0
    assert a.count() == 60


def test_lookup_and_checks(spark):
    d = spark.createDataFrame([(1,), (2,), (2,)], "division_id long")
    assert roads.lookup(d, 1).count() == 1
    for missing in (2, 3):
        with pytest.raises(RuntimeError):
            roads.lookup(d, missing)
    with pytest.raises(RuntimeError):
        results.one_to_one(d, "division_id")
    named = spark.sql("select named_struct('common', map('en', 'Here')) as a, named_struct('common', array(struct('en', 'Here'))) as b")
    assert named.select(roads.english(named.a), roads.english_of_pairs(named.b)).first()[:] == ("Here", "Here")


def test_missing_distance_fails(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", None), (3, "x", float("nan"))], "location_id long, road_id string, distance_m double")
    b = spark.createDataFrame([(1, "y", 1.5), (2, "x", 1.0), (3, "x", 1.0)], "location_id long, road_id string, distance_m double")
    assert {r.location_id: r.failed for r in results.difference(a, b, 1.0).collect()} == {1: False, 2: True, 3: True}


def around_the_sphere():
    """Locations and segments about the antimeridian, both poles and elsewhere: near ones, far ones, long ones, points."""
    rng = np.random.default_rng(5)
    spots = [(180.0, 10.0), (-180.0, -40.0), (0.0, 90.0), (77.0, -90.0), (10.0, 50.0), (90.0, 0.0)]
    wrap = lambda x: (x + 180) % 360 - 180
    locations, segments = [], []
    for n, (lon, lat) in enumerate(spots):
        for k in range(25):
            a, b = rng.normal(0, 0.02 * 4 ** (k % 4), 2)
            y = float(np.clip(lat + b, -90, 90))
            locations.append((1000 * n + k, float(wrap(lon + (a if abs(lat) < 89 else 180 * rng.uniform(-1, 1)))), y))
            p, q, r, s = rng.normal(0, 0.02 * 4 ** (k % 4), 4)
            x1 = lon + (p if abs(lat) < 89 else 180 * rng.uniform(-1, 1))
            y1 = float(np.clip(lat + q, -90, 90))
            segments.append((f"s{n}-{k}", "c", float(wrap(x1)), y1, float(wrap(x1 + (r if k % 5 else 0.0))), float(np.clip(y1 + (s if k % 5 else 0.0), -90, 90))))
    locations += [(9000, 179.999, 10.0), (9001, -179.999, 10.0), (9002, 30.0, 89.0), (9003, -150.0, 89.0)]
    segments += [("near", "c", -179.999, 10.0, -179.999, 10.0002), ("far", "c", 179.9, 10.0, 179.91, 10.0), ("over", "c", 179.9, 12.0, -179.9, 12.3), ("long", "c", 160.0, 20.0, -150.0, 25.0), (None, "c", 30.0, 89.0, 31.0, 89.0), ("gone", "c", None, 1.0, 2.0, 2.0)]
    return locations, segments


@pytest.fixture(scope="module")
def sphere_tables(spark):
    locations, segments = around_the_sphere()
    return spark.createDataFrame(locations, "location_id long, lon double, lat double"), spark.createDataFrame(segments, "road_id string, road_class string, x1 double, y1 double, x2 double, y2 double")


def test_nearest_on_the_whole_sphere(sphere_tables):
    locations, segments = sphere_tables
    got = {r.location_id: r for r in nearest.nearest(locations, segments).collect()}
    want = {r.location_id: r for r in nearest.exhaustive(locations, segments.where("x1 is not null")).collect()}
    assert got.keys() == want.keys() and got[9000].road_id == "near" and got[9000].distance_m == pytest.approx(219.0, abs=0.1)
    for k, w in want.items():
        g = got[k]
        assert (g.road_id, round(g.distance_m, 6), round(g.near_lon, 9), round(g.near_lat, 9)) == (w.road_id, round(w.distance_m, 6), round(w.near_lon, 9), round(w.near_lat, 9))
        assert g.radius_m >= g.distance_m and (g.radius_m == 1000 or g.radius_m / 2 < g.distance_m)


@pytest.mark.parametrize("radius", [300.0, 5000.0, 200_000.0])
def test_pairs_within_a_radius_on_the_whole_sphere(sphere_tables, radius):
    locations, segments = sphere_tables
    got = nearest.within(locations, segments, radius).select("location_id", "road_id", "distance_m").collect()
    every = nearest.measured(locations.transform(lambda d: nearest.with_units(d, segments)[0]).crossJoin(nearest.with_units(locations, segments)[1])).where("x1 is not null")
    want = [r for r in every.select("location_id", "road_id", "distance_m").collect() if r.distance_m <= radius]
    assert sorted((r.location_id, r.road_id or "") for r in got) == sorted((r.location_id, r.road_id or "") for r in want)


def test_nearest_with_little_input(spark, sphere_tables):
    locations, segments = sphere_tables
    assert nearest.nearest(locations.limit(0), segments).collect() == [] == nearest.nearest(locations.limit(0), segments.limit(0)).collect()
    with pytest.raises(RuntimeError):
        nearest.nearest(locations, segments.limit(0))
    with pytest.raises(Exception, match="without a segment within"):
        nearest.nearest(locations, segments.where("road_id = 's4-1'")).collect()
    with pytest.raises(Exception, match="without coordinates"):
        nearest.nearest(spark.createDataFrame([(1, None, 2.0)], "location_id long, lon double, lat double"), segments).collect()


def test_many_boxes_meet_through_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    boxes = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.uniform(0, 10, (2, 60)), *rng.uniform(0, 4, (2, 60)), strict=True))]
    lines = [(f"r{i}", *map(float, rng.uniform(-1, 13, 4))) for i in range(80)]
    b = spark.createDataFrame(boxes, "division_id long, xmin double, ymin double, xmax double, ymax double")
    s = spark.createDataFrame(lines, "road_id string, x1 double, y1 double, x2 double, y2 double")
    few = sorted(map(tuple, roads.box_clip(s, b).select("road_id", "division_id", "cx1", "cy2").collect()))
    monkeypatch.setattr(roads, "MOST_BROADCAST", 5)
    assert few and sorted(map(tuple, roads.box_clip(s, b).select("road_id", "division_id", "cx1", "cy2").collect())) == few


def test_difference_wants_one_row_each(spark):
    a = spark.createDataFrame([(1, "r", 1.0), (1, "s", 2.0)], "location_id long, road_id string, distance_m double")
    with pytest.raises(Exception, match="not unique"):
        results.difference(a, a, 1.0).collect()
