"""Every registered query against its SQL."""

import duckdb
import pytest

from waymark.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(records):
    def plain(v):
        return tuple(v) if isinstance(v, list) else v

    return sorted((tuple(plain(v) for v in r) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    want = duck.sql(f"select {', '.join(names)} from ({ORACLES[name]}) q")
    assert sorted(duck.sql(ORACLES[name]).columns) == names
    assert rows(tuple(r) for r in got.select(*names).collect()) == rows(want.fetchall())


def test_rows_only(spark, sf):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, sf).count() > 0


def test_bbox_reaches_the_scan(spark, tmp_path):
    from waymark.operators import roads

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    spark.sql("select 's' as id, 1.0d x1, 2.0d x2, 3.0d y1, 4.0d y2").transform(roads.with_box).write.parquet(str(tmp_path / "r"))
    out = roads.prune(spark.read.parquet(str(tmp_path / "r")), 0.0, 0.0, 5.0, 5.0).select("id")
    plan = out._jdf.queryExecution().toString()
    assert "LessThanOrEqual(bbox.xmin,5.0)" in plan and "GreaterThanOrEqual(bbox.ymax,0.0)" in plan
