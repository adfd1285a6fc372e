"""Tables that outgrow the driver: no join may send them through it, whatever Spark takes them for."""

import numpy as np
import pyarrow as pa
import pytest

from waymark.operators import meet, nearest
from waymark.plans.catalog import QUERIES

BROADCAST = ("BroadcastHashJoin", "BroadcastNestedLoopJoin")


@pytest.fixture
def willing(spark):
    """A session that broadcasts whatever it takes for less than 1 GB, which is every table here."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1g")
    yield spark
    spark.conf.set(key, before)


@pytest.fixture
def planned(monkeypatch):
    """Plans of what is staged on the way, and of a result."""
    plans = []
    kept = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())
    monkeypatch.setattr(nearest.staging, "staged", lambda df, name, f=nearest.staging.staged: kept(df) or f(df, name))
    return lambda df: kept(df) or plans


@pytest.mark.parametrize("name", ["anti_unresolved", "dwithin_semi", "distance_pairs"])
def test_lists_are_not_broadcast(willing, planned, sf, name):
    plans = planned(QUERIES[name](willing, sf))
    assert "SortMergeJoin" in plans[-1] and not any(x in p for p in plans for x in BROADCAST)


@pytest.mark.parametrize("name", ["cross_result_diff", "offroad_check", "closest_point", "cross_result_report", "mismatch_samples", "nearest_general_driving", "nearest_service_rural", "radius_buckets", "nearest_bucketed", "union_all_buckets"])
def test_nearest_and_its_results_are_not_broadcast(willing, planned, monkeypatch, sf, name):
    """Locations count as many here; on the way, bounds are joined with witnesses."""
    monkeypatch.setattr(nearest, "FEW", 0)
    plans = planned(QUERIES[name](willing, sf))
    assert len(plans) > 1 and "SortMergeJoin" in plans[0]
    large = [line for p in plans for line in p.splitlines() if any(x in line for x in BROADCAST)]
    # What the two reports compare are joins themselves, and Spark takes a join for as large as the product of its sides.
    assert not [x for x in large if name not in ("cross_result_report", "mismatch_samples") or "[location_id#" not in x]


@pytest.mark.parametrize("name", ["coverage_1km"])
def test_one_row_alone_is_broadcast(willing, planned, sf, name):
    """Two counts meet, and nothing else goes through the driver."""
    plans = planned(QUERIES[name](willing, sf))
    assert "SortMergeJoin" in plans[-1] and "BroadcastHashJoin" not in plans[-1] and plans[-1].count("BroadcastNestedLoopJoin") == 1


def test_few_locations_are_broadcast(willing, planned, sf):
    """A hundred locations: the pieces stay where they are."""
    plans = planned(nearest.nearest(willing.sql("select 1L as location_id, 35.0d as lon, 31.0d as lat"), QUERIES["bbox_prune"](willing, sf).selectExpr("road_id", "road_class", "34.9d as x1", "31.0d as y1", "34.91d as x2", "31.01d as y2")))
    assert "BroadcastHashJoin" in plans[-1]


def test_exhaustive_skips_lists_that_are_far(willing):
    """Four groups at four ends of the world: lists are held against each other by the balls that they lie in, and no list is broadcast."""
    rng = np.random.default_rng(7)
    at = np.concatenate([rng.normal(c, 0.2, (600, 2)) for c in ((0, 0), (90, 40), (179.9, 0), (-90, -60))])
    ends = at[rng.permutation(len(at))] + rng.normal(0, 0.05, (len(at), 2))
    locations = willing.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "location_id long, lon double, lat double")
    segments = willing.createDataFrame([(f"r{i}", "c", *map(float, x), float(x[0] + 0.03), float(x[1] - 0.02)) for i, x in enumerate(ends)], "road_id string, road_class string, x1 double, y1 double, x2 double, y2 double")
    got = nearest.exhaustive(locations, segments)
    cartesian = [x for x in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "CartesianProduct" in x]
    assert any("reach" in x for x in cartesian)
    rows = {r.location_id: r for r in got.collect()}
    want = {r.location_id: r for r in nearest.nearest(locations, segments).collect()}
    assert len(rows) == len(at) and {i: (r.road_id, r.distance_m) for i, r in rows.items()} == {i: (r.road_id, r.distance_m) for i, r in want.items()}


def test_lists_without_a_pair():
    """A place that has something nearer than a whole list has no pair in it, nor has a batch of such lists."""
    places = pa.array([[{"px": 1.0, "py": 0.0, "pz": 0.0, "most": 1e-6}] * 200])
    piece = {"ax": 0.0, "ay": 1.0, "az": 0.0, "ex": 0.0, "ey": 0.8, "ez": 0.6, "piece": 0, "of": 1}
    batch = pa.RecordBatch.from_arrays([places, pa.array([[piece] * 200])], ["places", "pieces"])
    assert not list(meet._could_be_nearest(iter([batch]), ["px"]))
