import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from waymark.operators import provenance as prov
from waymark.sources import config, readers, writers
from waymark.streaming import inventory as inv

A = ("A", "", "L1", "2026-01-01T00:00:00Z", 0.8, False)
B = ("B", "/height", "L2", "2026-02-01T00:00:00Z", 0.5, True)
FILES = ([[A], [A, B], [], None, [None]], [[B, A], [("A", "", "L3", None, None, None)], [(None,) * 6]])
SCHEMA = f"feature_id long, sources array<{prov.ITEM}>"


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(list(enumerate(x for f in FILES for x in f)), SCHEMA)


def test_worked_example(lists):
    assert tuple(prov.totals(lists).first()) == (8, 8)
    assert {r.cardinality: r.features for r in prov.cardinality(lists).collect()} == {0: 1, 1: 4, 2: 2, None: 1}
    assert tuple(prov.anomalies(lists).first()) == (1, 1, 1, 2, 2)
    by = {(r.dataset, r.property): r for r in prov.catalog(lists).collect()}
    a, b, n = by["A", ""], by["B", "/height"], by[None, None]
    assert (a["items"], a.features, a.first_position, a.later_position) == (4, 4, 3, 1)
    assert (b["items"], b.features, b.first_position, b.later_position, b.mean_confidence, b.with_between) == (2, 2, 1, 1, 0.5, 2)
    assert (n["items"], n.features, n.first_position, n.mean_confidence, n.scope) == (2, 2, 2, None, "missing")
    licenses = {(r.dataset, r.property): json.loads(r.licenses) for r in prov.licenses(lists).collect()}
    assert licenses == {("A", ""): ["L1", "L3"], ("B", "/height"): ["L2"], (None, None): [None]}
    combos = {r.combination: (r.features, r.status) for r in prov.combinations(lists).collect()}
    assert combos == {'[["A",""]]': (2, "valid"), '[["A",""],["B","/height"]]': (2, "valid"), "[]": (1, "empty"), "null": (1, "null"), "[[null,null]]": (2, "valid")}
    assert all(r.passed for r in prov.reconciled(lists).collect())


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tuple(prov.totals(none).first()) == (0, 0)
    assert prov.catalog(none).count() == prov.combinations(none).count() == 0


def test_kept_per_file(spark, tmp_path):
    paths = []
    for k, rows in enumerate(FILES):
        path = str(tmp_path / f"f{k}.parquet")
        spark.createDataFrame([(r,) for r in rows], f"sources array<{prov.ITEM}>").coalesce(1).write.parquet(str(tmp_path / f"d{k}"))
        pq.write_table(pq.read_table(next((tmp_path / f"d{k}").glob("*.parquet"))), path)
        paths.append(path)
    checks = str(tmp_path / "checks")
    first, read = inv.inventory(spark, paths, checks)
    want = sorted(map(tuple, first.collect()))
    assert read == 2 and ("cardinality", "1", 4) in want and ("anomaly", "null_items", 1) in want
    again, read = inv.inventory(spark, paths[::-1], checks)
    assert read == 0 and sorted(map(tuple, again.collect())) == want
    t = pq.read_table(paths[1])
    pq.write_table(pa.concat_tables([t, t]), paths[1])
    changed, read = inv.inventory(spark, paths, checks)
    assert read == 1 and ("cardinality", "1", 6) in set(map(tuple, changed.collect()))
    stream = inv.follow(spark, str(tmp_path / "d*"), f"sources array<{prov.ITEM}>", str(tmp_path / "out"), str(tmp_path / "cp"))
    stream.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("kind = 'cardinality' and key = '1'").groupBy().sum("n").first()[0] == 4


@pytest.fixture
def files(tmp_path):
    """The worked example as files of two-row groups, with item fields that the inventory doesn't use."""
    kind = pa.list_(pa.struct([("property", pa.string()), ("dataset", pa.string()), ("license", pa.string()), ("record_id", pa.string()), ("update_time", pa.string()), ("confidence", pa.float64()), ("between", pa.list_(pa.float64()))]))
    paths = []
    for k, rows in enumerate(FILES):
        lists = [r and [x and {"dataset": x[0], "property": x[1], "license": x[2], "update_time": x[3], "confidence": x[4], "between": [0.0, 1.0] if x[5] else None, "record_id": "r"} for x in r] for r in rows]
        paths.append(str(tmp_path / f"part-{k}.parquet"))
        pq.write_table(pa.table({"id": [str(i) for i in range(len(rows))], "sources": pa.array(lists, kind)}), paths[-1], row_group_size=2)
    return paths


def test_published_inventory(spark, files, tmp_path):
    names = ("catalog.csv", "combinations.csv", "cardinality.csv", "summary.json")
    checks = str(tmp_path / "checks")
    first = inv.publish(spark, files, checks, str(tmp_path / "one"))
    again = inv.publish(spark, files[::-1], checks, str(tmp_path / "two"))
    assert (first["read"], again["read"]) == (2, 0) and first["complete"] and (first["features"], first["items"]) == (8, 8)
    assert first["anomalies"] == {"null_lists": 1, "empty_lists": 1, "null_items": 1, "missing_dataset": 2, "missing_property": 2}
    assert all((tmp_path / "one" / n).read_bytes() == (tmp_path / "two" / n).read_bytes() for n in names)
    lines = (tmp_path / "one/catalog.csv").read_text().splitlines()
    assert len(lines) == 4 and lines[1].startswith("A,,4,4,3,1,") and '"[""L1"",""L3""]"' in lines[1] and lines[2].startswith("B,/height,2,2,1,1,")
    assert (tmp_path / "one/cardinality.csv").read_text() == "key,n\n0,1\n1,4\n2,2\nnull,1\n"
    smoke = inv.publish(spark, files, checks, str(tmp_path / "three"), smoke=True)
    assert not smoke["complete"] and (smoke["files"], smoke["features"]) == (1, 2)
    assert (tmp_path / "three/smoke/summary.json").exists() and not (tmp_path / "three/summary.json").exists()
    assert inv.publish(spark, files, checks, str(tmp_path / "four"))["read"] == 0


def test_nothing_is_published_if_checks_fail(spark, files, tmp_path, monkeypatch):
    monkeypatch.setattr(inv, "checks", lambda *a: {"all_files": True, "features_as_in_footers": False})
    with pytest.raises(RuntimeError, match="features_as_in_footers"):
        inv.publish(spark, files, str(tmp_path / "checks"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError, match="lack or mistype"):
        inv.checked_lists(spark.sql("select array(named_struct('dataset', 1)) as sources"))


def test_wrong_schema_writes_nothing(spark, tmp_path):
    pq.write_table(pa.table({"sources": ["x"]}), tmp_path / "x.parquet")
    with pytest.raises(ValueError, match="must be a list"):
        inv.inventory(spark, [str(tmp_path / "x.parquet")], str(tmp_path / "checks"))
    assert not (tmp_path / "checks").exists()


def test_sources_and_sinks(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.discover(str(tmp_path / "*.none"))
    (tmp_path / "gpu.csv").write_text("timestamp, utilization.gpu [%], memory.used [MiB]\n2026/01/01, 39 %, 3972 MiB\n")
    assert readers.telemetry(spark, str(tmp_path / "gpu.csv")).first()[:] == ("2026/01/01", 39.0, 3972.0)
    (tmp_path / "run1.json").write_text('{"engine": "a",\n "measurements": [{"kind": "cold", "s": 1.5}]}')
    assert readers.documents(spark, str(tmp_path / "run*.json")).selectExpr("explode(measurements.s) as s").first().s == 1.5
    df = spark.sql("select id as road_id, cast('x' as binary) as geometry, struct(id+0.0d as xmin, 0.0d as ymin, id+1.0d as xmax, 2.0d as ymax) as bbox from range(25)")
    path = str(tmp_path / "one.parquet")
    assert writers.geoparquet_file(df, path, ["LineString"], row_group_size=10) == 25
    meta = pq.read_metadata(path)
    geo = json.loads(meta.metadata[b"geo"])
    assert meta.num_row_groups >= 3 and geo["version"] == "1.1.0" and geo["columns"]["geometry"]["bbox"] == [0.0, 0.0, 25.0, 2.0]
    assert readers.first_row_group(spark, path, ["road_id"]).count() <= 10
    assert readers.footers(spark, [path]).first().rows == 25
    assert writers.manifest(df, path, [], {})["rows"] == 25
    writers.csv(spark.sql("select 'a,b' as n, 1.5d as v"), str(tmp_path / "c.csv"), {"v": 6})
    assert (tmp_path / "c.csv").read_text() == 'n,v\n"a,b",1.500000\n'
    with writers.published(str(tmp_path / "bundle")) as d:
        writers.atomic_json(f"{d}/m.json", {"ü": 1})
    assert "ü" in (tmp_path / "bundle/m.json").read_text()
    with pytest.raises(FileExistsError), writers.published(str(tmp_path / "bundle")):
        pass
    with pytest.raises(RuntimeError), writers.published(str(tmp_path / "other")):
        raise RuntimeError
    assert not (tmp_path / "other").exists() and not list(tmp_path.glob(".staging-*"))


def test_settings():
    assert config.expand("${A:-x} ${B}", {"A": "", "B": "b"}) == "x b"
    with pytest.raises(KeyError):
        config.expand("${B}", {})
    assert config.expand("${a} ${B", {}) == "${a} ${B" and config.expand("${A:-}x", {}) == "x"
    assert config.slug("a-1") == "a-1"
    for bad in ("a--b", "a_", "a-", "-a", "A", ""):
        with pytest.raises(ValueError):
            config.slug(bad)
    with pytest.raises(ValueError):
        config.slug("../x")
    assert len(config.digest("x")) == 64 and len(config.run_id()) == 16
