"""Operators on locations and segments where many of both share a cell: lists are joined, not rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import sphere
from waymark.operators import meet, nearest
from waymark.plans.catalog import QUERIES


def unit(lon, lat):
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)


@pytest.fixture(scope="module")
def dense(spark):
    """Locations, segments and the distance of each to each, found by sampling no bound at all."""
    rng = np.random.default_rng(3)
    at, ends = rng.uniform(0, 0.05, (700, 2)), rng.uniform(0, 0.05, (900, 4))
    ends[:, 2:] = ends[:, :2] + rng.normal(0, 0.02, (900, 2))
    p, a, e = unit(*at.T)[:, None], unit(*ends[:, :2].T), unit(*ends[:, 2:].T)
    n = np.cross(a, e)
    n /= np.linalg.norm(n, axis=1)[:, None]
    foot = p - (p * n).sum(-1)[..., None] * n
    inside = ((np.cross(a, foot) * n).sum(-1) >= 0) & ((np.cross(foot, e) * n).sum(-1) >= 0)
    ends_away = np.minimum(np.linalg.norm(p - a, axis=-1), np.linalg.norm(p - e, axis=-1))
    away = sphere.RADIUS * np.where(inside, np.arcsin(np.abs((p * n).sum(-1))), 2 * np.arcsin(ends_away / 2))
    locations = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "location_id long, lon double, lat double")
    segments = spark.createDataFrame([(f"r{i}", "c", *map(float, x)) for i, x in enumerate(ends)], "road_id string, road_class string, x1 double, y1 double, x2 double, y2 double")
    return locations, segments, away


def joined_as_lists(df) -> bool:
    """No join meets rows that have a road's or a place's numbers of their own."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return "MapInArrow" in plan and "places#" in plan and "pieces#" in plan


def test_nearest_meets_lists(dense):
    locations, segments, away = dense
    got = nearest.nearest(locations, segments)
    assert joined_as_lists(got)
    rows = {r.location_id: r for r in got.collect()}
    assert len(rows) == 700
    for i, r in rows.items():
        assert r.road_id == f"r{away[i].argmin()}" and r.distance_m == pytest.approx(away[i].min(), abs=1e-4)


def test_lists_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(meet, "BLOCK_ROWS", 7)
    rows = spark.range(100).selectExpr("id % 3 as key", "id", "cast(id as string) as name")
    lists = meet.packed(rows, ["key"]).collect()
    assert sorted((r.key, x.id, x.name) for r in lists for x in r.rows) == sorted((k % 3, k, str(k)) for k in range(100))


@pytest.mark.parametrize("radius", [20.0, 300.0])
def test_covered_meets_lists_and_makes_no_pairs(dense, radius):
    locations, segments, away = dense
    got = nearest.covered(locations, segments, radius)
    assert joined_as_lists(got) and got.columns == ["location_id"]
    want = np.flatnonzero((away <= radius).any(1)).tolist()
    assert 0 < len(want) and sorted(r.location_id for r in got.collect()) == want


def test_within_meets_lists(dense):
    locations, segments, away = dense
    got = nearest.within(locations, segments, 500.0)
    assert joined_as_lists(got)
    pairs = sorted((r.location_id, int(r.road_id[1:])) for r in got.select("location_id", "road_id").collect())
    assert pairs == sorted(map(tuple, np.argwhere(away <= 500.0).tolist()))


def test_within_makes_only_what_is_asked(dense):
    locations, segments, away = dense
    got = nearest.within(locations, segments, 500.0, ["location_id", "distance_m"])
    assert joined_as_lists(got) and got.columns == ["location_id", "distance_m"]
    lists = re.findall(r"MapInArrow _packed.*|MapInArrow.*rows#.*", got._jdf.queryExecution().analyzed().toString())
    assert lists and not any(c in x for x in lists for c in ("road_class", "x1", "lon#"))
    assert sorted(r.location_id for r in got.collect()) == np.argwhere(away <= 500.0)[:, 0].tolist()


def test_within_rounds_as_sql_does(spark, sf, dense):
    """The kernel rounds: round() on each of so many pairs took a tenth of the query's CPU seconds."""
    locations, segments, _ = dense
    assert "round(" not in QUERIES["dwithin_join"](spark, sf)._jdf.queryExecution().analyzed().toString()
    names = ["location_id", "road_id", "distance_m"]
    got = nearest.within(locations, segments, 500.0, names, 3)
    want = nearest.within(locations, segments, 500.0, names).withColumn("distance_m", F.round("distance_m", 3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rng = np.random.default_rng(5)
    x = np.concatenate([[0.0, 0.0005, 0.0015, 0.0025, 1.0005, 4999.9995, 2e7], rng.integers(0, 5_000_000, 4000) / 1000 + 0.0005, rng.uniform(0, 5000, 4000)])
    x = np.concatenate([x, np.nextafter(x, np.inf), np.nextafter(x[1:], 0)])
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", F.round("x", 3).alias("r")).orderBy("i").collect()
    assert meet.rounded(x, 3).tolist() == [r.r for r in rows]


def test_nearest_lists_searched_grids_alone(dense):
    """The bounds are staged first; they say which grids' pieces are needed."""
    locations, segments, _ = dense
    plan = nearest.nearest(locations, segments)._jdf.queryExecution().analyzed().toString()
    listed = re.findall(r"named_struct\(level, (\d+)", plan)
    assert 0 < len(listed) < len(nearest._grids(nearest._finest(segments))) / 2


def test_nearest_bounds_are_near(dense, monkeypatch):
    """A bound as wide as a cell of the finest searched grid made each location some 18 rows, and of many pairs none was surely nearer."""
    locations, segments, away = dense
    kept = []
    monkeypatch.setattr(nearest.staging, "staged", lambda df, name, f=nearest.staging.staged: kept.append(f(df, name)) or kept[-1])
    assert nearest.nearest(locations, segments).count() == 700
    bounds, finest = {r.location_id: r for r in kept[0].collect()}, nearest._finest(segments)
    assert len(bounds) == 700
    assert all(r.most >= 2 * np.sin(away[i].min() / sphere.RADIUS / 2) for i, r in bounds.items())
    assert np.median([r.most for r in bounds.values()]) < finest / 4
    asked = locations.sparkSession.sql(f"select * from {nearest._around('{bounds}')}", bounds=kept[0]).count()
    assert asked < 10 * 700


def test_exhaustive_meets_lists(spark, dense):
    locations, segments, away = dense
    got = nearest.exhaustive(locations, segments.unionByName(spark.createDataFrame([("gone", "c", None, 1.0, 2.0, 2.0)], segments.schema)))
    assert joined_as_lists(got)
    rows = {r.location_id: r for r in got.collect()}
    assert {i: r.road_id for i, r in rows.items()} == {i: f"r{x.argmin()}" for i, x in enumerate(away)}
    nowhere = spark.createDataFrame([(1, None, 2.0)], locations.schema)
    assert [r.road_id for r in nearest.exhaustive(nowhere, segments).collect()] == ["r0"]


@pytest.mark.parametrize("name", ["cross_result_diff", "cross_result_report", "mismatch_samples"])
def test_compared_results_are_made_one_by_one(spark, sf, name):
    """A statement on several results reads them staged; their plans together took more memory than the driver has."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" not in plan and "near_lon" in plan
