"""Registered queries over the derived relations, and the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import planar, sphere
from waymark.operators import nearest as near
from waymark.operators import provenance as prov
from waymark.operators import report, results, roads
from waymark.sources import staging
from waymark.sources.fixtures import relation, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_relations(sql)
        return f

    return register


BOX = {"xmin": 34.6, "ymin": 30.5, "xmax": 35.1, "ymax": 32.0}
ROUNDED = "round(distance_m, 3) as distance_m"
PAIRS = f"(select * from {sphere.unit_sql('locations', sphere.LOCATION_UNIT)} l cross join {sphere.unit_sql('segments', sphere.SEGMENT_UNIT)} r)"
MEASURED = sphere.steps_sql(PAIRS, sphere.STEPS)
IN_TIER = {t: "road_class in (" + ",".join(f"'{c}'" for c in cs) + ")" for t, cs in roads.TIERS.items()}


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "locations")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "segments")


def _roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments to be found by their key: sorted, as Spark takes them for a few MB and would broadcast them all."""
    return _segments(spark, sf_dir).hint("merge")


def _round(df: DataFrame) -> DataFrame:
    return df.withColumn("distance_m", F.round("distance_m", 3))


# --- boundaries and roads -------------------------------------------------------------------------------------------


@query("select division_id, name, country, subtype from divisions where country='IL' and subtype='country' and is_land")
def boundary_filter(spark, sf_dir):
    return roads.boundary(relation(spark, sf_dir, "divisions"), "IL", "country").select("division_id", "name", "country", "subtype")


@query("select division_id, name, xmin, ymin, xmax, ymax from divisions where division_id=7")
def division_lookup(spark, sf_dir):
    return roads.lookup(relation(spark, sf_dir, "divisions"), 7).select("division_id", "name", "xmin", "ymin", "xmax", "ymax")


@query("select division_id, name from divisions where (subtype='locality' and name like 'I%') or (country='IL' and subtype='country')")
def either_filter(spark, sf_dir):
    d = relation(spark, sf_dir, "divisions")
    return d.where(((F.col("subtype") == "locality") & F.col("name").startswith("I")) | ((F.col("country") == "IL") & (F.col("subtype") == "country"))).select("division_id", "name")


@query(f"select road_id, road_class from segments where least(x1,x2)<={BOX['xmax']}e0 and greatest(x1,x2)>={BOX['xmin']}e0 and least(y1,y2)<={BOX['ymax']}e0 and greatest(y1,y2)>={BOX['ymin']}e0")
def bbox_prune(spark, sf_dir):
    return roads.prune(roads.with_box(_segments(spark, sf_dir)), **BOX).select("road_id", "road_class")


@query(f"select road_id, road_class from segments where {IN_TIER['service_rural']}")
def road_class_filter(spark, sf_dir):
    return _segments(spark, sf_dir).where(F.col("road_class").isin(*roads.RURAL)).select("road_id", "road_class")


@query("select road_id, " + ", ".join(f"{e} as is_{t}" for t, e in IN_TIER.items()) + " from segments")
def tier_flags(spark, sf_dir):
    return roads.tier_flags(_segments(spark, sf_dir)).select("road_id", *[f"is_{t}" for t in roads.TIERS])


@query("select cast(count(*) as bigint) as n_rows, " + ", ".join(f"cast(sum(case when {e} then 1 else 0 end) as bigint) as n_{t}" for t, e in IN_TIER.items()) + " from segments")
def tier_counts(spark, sf_dir):
    return roads.tier_flags(_segments(spark, sf_dir)).agg(F.count("*").alias("n_rows"), *[F.sum(F.col(f"is_{t}").cast("long")).alias(f"n_{t}") for t in roads.TIERS])


LENGTH = "sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2))"


@query(f"select road_class, count(*) as n, round(sum({LENGTH}),6) as total, round(min({LENGTH}),9) as shortest, round(max({LENGTH}),9) as longest from segments group by road_class")
def class_stats(spark, sf_dir):
    d = _segments(spark, sf_dir).withColumn("len", F.expr(LENGTH))
    return d.groupBy("road_class").agg(F.count("*").alias("n"), F.round(F.sum("len"), 6).alias("total"), F.round(F.min("len"), 9).alias("shortest"), F.round(F.max("len"), 9).alias("longest")).orderBy(F.col("total").desc())


CLIP = sphere.steps_sql("(select * from segments s join divisions d on least(x1,x2)<=xmax and greatest(x1,x2)>=xmin and least(y1,y2)<=ymax and greatest(y1,y2)>=ymin)", planar.CLIP_STEPS)


@query(f"select road_id, division_id, round(cx1,9) as cx1, round(cy1,9) as cy1, round(cx2,9) as cx2, round(cy2,9) as cy2 from {CLIP} where {planar.CLIPPED}")
def box_clip_segments(spark, sf_dir):
    out = roads.box_clip(_segments(spark, sf_dir), relation(spark, sf_dir, "divisions"))
    return out.select("road_id", "division_id", *[F.round(c, 9).alias(c) for c in ("cx1", "cy1", "cx2", "cy2")])


@query("""select concat(split_part(road_id,'#',1),'#',cast(k as varchar)) as road_id, k as part from segments, (values (0),(1),(2)) v(k)
 where k < case cast(substr(split_part(road_id,'#',1),4) as bigint)%3 when 0 then 3 when 1 then 1 else 2 end and not (k=1 and road_class='path')""")
def fragment_explode(spark, sf_dir):
    s = _segments(spark, sf_dir).withColumn("id", F.split("road_id", "#")[0])
    two = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    one = F.slice(two, 1, 1)
    n = F.substring("id", 4, 20).cast("long") % 3
    second = F.when(F.col("road_class") == "path", one).otherwise(two)
    parts = F.when(n == 0, F.array(two, second, two)).when(n == 1, F.array(two)).otherwise(F.array(two, second))
    return roads.fragments(s.withColumn("parts", parts)).select("road_id", F.col("part").cast("int").alias("part"))


@query("""select count(*) as n_rows, count(distinct road_id) as n_ids, cast(sum(case when road_id is null or (x1=x2 and y1=y2) then 1 else 0 end) as bigint) as n_invalid,
 list_sort(list(distinct road_class)) as classes from segments""")
def validity_agg(spark, sf_dir):
    return roads.validity(_segments(spark, sf_dir))


@query("select min(least(x1,x2)) as xmin, min(least(y1,y2)) as ymin, max(greatest(x1,x2)) as xmax, max(greatest(y1,y2)) as ymax from segments")
def bounds_agg(spark, sf_dir):
    return _segments(spark, sf_dir).agg(F.min(F.least("x1", "x2")).alias("xmin"), F.min(F.least("y1", "y2")).alias("ymin"), F.max(F.greatest("x1", "x2")).alias("xmax"), F.max(F.greatest("y1", "y2")).alias("ymax"))


@query("select road_id, road_class from segments order by road_class, road_id limit 100")
def sample_head(spark, sf_dir):
    return _segments(spark, sf_dir).select("road_id", "road_class").orderBy("road_class", "road_id").limit(100)


@query()
def projected_length(spark, sf_dir):
    return roads.planar_length(_segments(spark, sf_dir)).select("road_id", F.round("length_m", 3).alias("length_m"))


# --- nearest feature ------------------------------------------------------------------------------------------------


@query(f"select location_id, road_id, {ROUNDED} from {MEASURED} where distance_m<=5000e0")
def dwithin_join(spark, sf_dir):
    return near.within(_locations(spark, sf_dir), _segments(spark, sf_dir), 5000.0, ["location_id", "road_id", "distance_m"], 3)


@query(f"select location_id, road_id, {ROUNDED} from {MEASURED} where distance_m<=2000e0 and {IN_TIER['arterial']}")
def distance_pairs(spark, sf_dir):
    arterial = _segments(spark, sf_dir).where(F.col("road_class").isin(*roads.ARTERIAL))
    return _round(near.within(_locations(spark, sf_dir), arterial, 2000.0, ["location_id", "road_id", "distance_m"]))


@query(f"select distinct location_id from {MEASURED} where distance_m<=1000e0")
def dwithin_semi(spark, sf_dir):
    return near.covered(_locations(spark, sf_dir), _segments(spark, sf_dir), 1000.0)


@query(f"select (select count(*) from locations) as locations, count(distinct location_id) as covered from {MEASURED} where distance_m<=1000e0")
def coverage_1km(spark, sf_dir):
    locations = _locations(spark, sf_dir)
    n = near.covered(locations, _segments(spark, sf_dir), 1000.0).agg(F.count("location_id").alias("covered"))
    return locations.agg(F.count("*").alias("locations")).crossJoin(n)


@query(f"select location_id from locations where location_id not in (select location_id from {MEASURED} where distance_m<=1000e0)")
def anti_unresolved(spark, sf_dir):
    locations = _locations(spark, sf_dir)
    return near.unresolved(locations, near.covered(locations, _segments(spark, sf_dir), 1000.0)).select("location_id")


RANKED = f"(select *, row_number() over (partition by location_id order by distance_m, road_id) as rn from {MEASURED})"
FIRST = f"select location_id, road_id, road_class, {ROUNDED} from {RANKED} where rn=1"


@query(FIRST)
def nearest_exhaustive(spark, sf_dir):
    return _round(near.exhaustive(_locations(spark, sf_dir), _segments(spark, sf_dir))).select("location_id", "road_id", "road_class", "distance_m")


@query(FIRST)
def nearest_bucketed(spark, sf_dir):
    return _round(near.nearest(_locations(spark, sf_dir), _segments(spark, sf_dir), 8000)).select("location_id", "road_id", "road_class", "distance_m")


def _tier_query(tier: str):
    ranked = f"(select *, row_number() over (partition by location_id order by distance_m, road_id) as rn from {MEASURED} where {IN_TIER[tier]})"

    def f(spark, sf_dir):
        s = _segments(spark, sf_dir).where(F.col("road_class").isin(*roads.TIERS[tier]))
        return _round(near.nearest(_locations(spark, sf_dir), s, 8000)).select("location_id", "road_id", "road_class", "distance_m")

    f.__name__ = f"nearest_{tier}"
    query(f"select location_id, road_id, road_class, {ROUNDED} from {ranked} where rn=1")(f)


for _tier in roads.TIERS:
    _tier_query(_tier)


@query(f"select location_id, round(near_lon,7) as near_lon, round(near_lat,7) as near_lat from {sphere.steps_sql('(select * exclude (rn) from ' + RANKED + ' where rn=1)', sphere.CLOSEST)}")
def closest_point(spark, sf_dir):
    out = near.nearest(_locations(spark, sf_dir), _segments(spark, sf_dir), 8000)
    return out.select("location_id", F.round("near_lon", 7).alias("near_lon"), F.round("near_lat", 7).alias("near_lat"))


BUCKET = "cast(1000*pow(2, greatest(0, ceil(log2(distance_m/1000e0)))) as double)"


@query(f"select {BUCKET} as radius_m, count(*) as locations from {RANKED} where rn=1 group by 1")
def radius_buckets(spark, sf_dir):
    return near.nearest(_locations(spark, sf_dir), _segments(spark, sf_dir)).groupBy("radius_m").agg(F.count("*").alias("locations"))


@query(f"select location_id, road_id, {BUCKET} as radius_m from {RANKED} where rn=1")
def union_all_buckets(spark, sf_dir):
    return near.nearest(_locations(spark, sf_dir), _segments(spark, sf_dir)).select("location_id", "road_id", "radius_m")


@query(f"select location_id, road_id, {ROUNDED} from {RANKED} where rn=1 order by location_id limit 50")
def topk_oracle(spark, sf_dir):
    first = _locations(spark, sf_dir).orderBy("location_id").limit(50)
    return _round(near.exhaustive(first, _segments(spark, sf_dir))).select("location_id", "road_id", "distance_m")


@query(f"select location_id, road_id as road_a, road_id as road_b, true as same_road, false as failed from {RANKED} where rn=1 order by location_id limit 100")
def oracle_diff(spark, sf_dir):
    locations, segments = _locations(spark, sf_dir), _segments(spark, sf_dir)
    first = locations.orderBy("location_id").limit(100)
    return results.difference(near.nearest(first, segments, 8000), near.exhaustive(first, segments), 1.0).select("location_id", "road_a", "road_b", "same_road", "failed")


AGAIN = f"(select *, row_number() over (partition by location_id order by distance_m, road_id) as rn from {MEASURED} where {IN_TIER['general_driving']})"


@query(f"""select a.location_id, a.road_id as road_a, b.road_id as road_b, round(abs(a.distance_m-b.distance_m),3) as delta_m, a.road_id=b.road_id as same_road,
 abs(a.distance_m-b.distance_m)>1e0 as failed from {RANKED} a join {AGAIN} b on a.location_id=b.location_id where a.rn=1 and b.rn=1""")
def cross_result_diff(spark, sf_dir):
    a, b = (_staged_nearest_of(spark, sf_dir, t) for t in (None, "general_driving"))
    return results.difference(a, b, 1.0).withColumn("delta_m", F.round("delta_m", 3)).select("location_id", "road_a", "road_b", "delta_m", "same_road", "failed")


def _nearest_sql(tier: str | None) -> str:
    """The result of nearest() as SQL over all pairs."""
    where = f" where {IN_TIER[tier]}" if tier else ""
    ranked = f"(select *, row_number() over (partition by location_id order by distance_m, road_id) as rn from {MEASURED}{where})"
    return f"(select location_id, road_id, distance_m, near_lon, near_lat from {sphere.steps_sql(f'(select * exclude (rn) from {ranked} where rn=1)', sphere.CLOSEST)})"


def _nearest_of(spark, sf_dir, tier: str | None) -> DataFrame:
    s = _segments(spark, sf_dir)
    return near.nearest(_locations(spark, sf_dir), s.where(F.col("road_class").isin(*roads.TIERS[tier])) if tier else s, 8000)


def _staged_nearest_of(spark, sf_dir, tier: str | None) -> DataFrame:
    """For statements on several results: each is made once and alone, so that the driver never holds the plans of all."""
    return staging.staged(_nearest_of(spark, sf_dir, tier), f"nearest-{tier or 'every'}")


@query(f"select location_id, round(off_m,3) as off_m from {report.on_roads_sql(_nearest_sql(None), 'segments')}")
def offroad_check(spark, sf_dir):
    text = f"select location_id, round(off_m,3) as off_m from {report.on_roads_sql('{result}', '{segments}')}"
    return spark.sql(text, result=_nearest_of(spark, sf_dir, None), segments=_roads(spark, sf_dir))


COMPARED, TOLERANCE_M = ("arterial", "general_driving"), 1.0


def _compared(a: str, b: str, segments: str) -> str:
    return report.comparison_sql(a, b, segments, TOLERANCE_M)


@query(" union all ".join(f"select * from {report.summary_sql(_compared(_nearest_sql(t), _nearest_sql(None), 'segments'), t, TOLERANCE_M, 'select count(*) from locations')}" for t in COMPARED))
def cross_result_report(spark, sf_dir):
    parts = [f"select * from {report.summary_sql(_compared('{' + t + '}', '{every}', '{segments}'), t, TOLERANCE_M, 'select count(*) from {locations}')}" for t in COMPARED]
    results_of = {t: _staged_nearest_of(spark, sf_dir, t) for t in COMPARED}
    return spark.sql(" union all ".join(parts), every=_staged_nearest_of(spark, sf_dir, None), segments=_roads(spark, sf_dir), locations=_locations(spark, sf_dir), **results_of)


@query(f"""select road_tier, location_id, road_a, road_b, round(delta_m,3) as delta_m from (select *, row_number() over (partition by road_tier order by location_id) as nth from
 ({' union all '.join(f"select '{t}' as road_tier, * from {_compared(_nearest_sql(t), _nearest_sql(None), 'segments')}" for t in COMPARED)}) u where failed) v where nth<={report.MOST_SAMPLES}""")
def mismatch_samples(spark, sf_dir):
    every, segments = _staged_nearest_of(spark, sf_dir, None), _roads(spark, sf_dir)
    found = None
    for t in COMPARED:
        rows = spark.sql(f"select * from {_compared('{a}', '{b}', '{segments}')}", a=_staged_nearest_of(spark, sf_dir, t), b=every, segments=segments)
        one = report.samples(rows, F.lit(t))
        found = one if found is None else found.unionByName(one)
    return found.select("road_tier", "location_id", "road_a", "road_b", F.round("delta_m", 3).alias("delta_m"))


# --- provenance -----------------------------------------------------------------------------------------------------


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prov.nested(relation(spark, sf_dir, "features"), relation(spark, sf_dir, "source_items"))


@query("select (select count(*) from features) as features, count(*) as items from source_items")
def prov_totals(spark, sf_dir):
    return prov.totals(_lists(spark, sf_dir))


@query("""select cast(case when list_state='null' then null else coalesce(n,0) end as varchar) as cardinality, count(*) as features, case when list_state='null' then 'null' else 'valid' end as status
 from features f left join (select feature_id, count(*) as n from source_items group by 1) i on i.feature_id=f.feature_id group by 1, 3""")
def prov_cardinality(spark, sf_dir):
    return prov.cardinality(_lists(spark, sf_dir)).withColumn("cardinality", F.col("cardinality").cast("string"))


@query("""select (select cast(sum(case when list_state='null' then 1 else 0 end) as bigint) from features) as null_lists,
 (select cast(sum(case when list_state='empty' then 1 else 0 end) as bigint) from features) as empty_lists,
 cast(sum(case when item_is_null then 1 else 0 end) as bigint) as null_items, cast(sum(case when dataset is null then 1 else 0 end) as bigint) as missing_dataset,
 cast(sum(case when property is null then 1 else 0 end) as bigint) as missing_property from source_items""")
def prov_anomalies(spark, sf_dir):
    return prov.anomalies(_lists(spark, sf_dir))


@query("""select dataset, property, count(*) as items, count(distinct feature_id) as features, count(license) as with_license, min(update_time) as min_update_time,
 max(update_time) as max_update_time, count(confidence) as with_confidence, min(cast(confidence as double)) as min_confidence, max(cast(confidence as double)) as max_confidence,
 round(avg(cast(confidence as double)),9) as mean_confidence, cast(sum(case when between_present then 1 else 0 end) as bigint) as with_between,
 case when property is null then 'missing' when property='' then 'whole_feature' else 'field' end as scope from source_items group by dataset, property""")
def prov_catalog(spark, sf_dir):
    return prov.catalog(_lists(spark, sf_dir)).drop("first_position", "later_position").withColumn("mean_confidence", F.round("mean_confidence", 9))


@query("""select dataset, property, cast(sum(case when pos=0 then 1 else 0 end) as bigint) as first_position, cast(sum(case when pos>0 then 1 else 0 end) as bigint) as later_position
 from source_items group by dataset, property""")
def prov_positions(spark, sf_dir):
    return prov.catalog(_lists(spark, sf_dir)).select("dataset", "property", "first_position", "later_position")


@query("select dataset, property, count(distinct feature_id) as features from source_items group by dataset, property")
def prov_feature_counts(spark, sf_dir):
    return prov.catalog(_lists(spark, sf_dir)).select("dataset", "property", "features")


@query("""select dataset, property, concat('[', string_agg(case when license is null then 'null' else concat('"',license,'"') end, ',' order by license nulls first), ']') as licenses
 from (select distinct dataset, property, license from source_items) d group by dataset, property""")
def prov_licenses(spark, sf_dir):
    return prov.licenses(_lists(spark, sf_dir))


@query("""select dataset, property, count(*) as items, count(distinct feature_id) as features, cast(sum(case when pos=0 then 1 else 0 end) as bigint) as first_position,
 cast(sum(case when pos>0 then 1 else 0 end) as bigint) as later_position, count(license) as with_license, min(update_time) as min_update_time, max(update_time) as max_update_time,
 count(confidence) as with_confidence, min(cast(confidence as double)) as min_confidence, max(cast(confidence as double)) as max_confidence,
 round(avg(cast(confidence as double)),9) as mean_confidence, cast(sum(case when between_present then 1 else 0 end) as bigint) as with_between,
 case when property is null then 'missing' when property='' then 'whole_feature' else 'field' end as scope,
 concat('[', string_agg(distinct case when license is null then 'null' else concat('"',license,'"') end, ',' order by case when license is null then 'null' else concat('"',license,'"') end desc), ']') as licenses
 from source_items group by dataset, property""")
def prov_incremental(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    parts = [prov.partial_catalog(lists.where(F.col("feature_id") % 3 == k)) for k in range(3)]
    merged = prov.merged_catalog(parts[0].unionByName(parts[1]).unionByName(parts[2])).withColumn("mean_confidence", F.round("mean_confidence", 9))
    return merged.withColumn("licenses", prov.text_of(F.sort_array("licenses", asc=False)))


KEY = "('[' || coalesce('\"' || dataset || '\"','null') || ',' || coalesce('\"' || property || '\"','null') || ']')"
COMBOS = f"""(select f.feature_id, case when list_state='null' then 'null' when list_state='empty' then '[]' else c end as combination from features f
 left join (select feature_id, concat('[', string_agg({KEY}, ',' order by {KEY}), ']') as c from source_items group by 1) i on i.feature_id=f.feature_id)"""


@query(f"select combination, count(*) as features, case combination when 'null' then 'null' when '[]' then 'empty' else 'valid' end as status from {COMBOS} group by combination")
def prov_combinations(spark, sf_dir):
    return prov.combinations(_lists(spark, sf_dir)).drop("combination_id")


@query(f"select distinct sha256(combination) as combination_id, combination from {COMBOS}")
def prov_combination_ids(spark, sf_dir):
    return prov.combinations(_lists(spark, sf_dir)).select("combination_id", "combination")


@query("select unnest(['cardinality_features','cardinality_items','combination_features','catalog_items','catalog_positions','first_positions']) as name, true as passed")
def prov_reconcile(spark, sf_dir):
    return prov.reconciled(_lists(spark, sf_dir))


# --- runs and results -----------------------------------------------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "measurements")


@query("""select m.engine, m.road_tier, n, min_s, max_s, round(median_s,9) as median_s, round(p95_s,9) as p95_s, round(median(abs(elapsed_seconds-median_s)),9) as mad_s from measurements m join
 (select engine, road_tier, count(*) as n, min(elapsed_seconds) as min_s, max(elapsed_seconds) as max_s, median(elapsed_seconds) as median_s, quantile_cont(elapsed_seconds,0.95) as p95_s
  from measurements where kind='measured' group by 1,2) s on s.engine=m.engine and s.road_tier=m.road_tier where kind='measured' group by all""")
def run_stats_median_mad_p95(spark, sf_dir):
    out = results.timings(_runs(spark, sf_dir), ["engine", "road_tier"])
    return out.select("engine", "road_tier", "n", "min_s", "max_s", *[F.round(c, 9).alias(c) for c in ("median_s", "p95_s", "mad_s")])


@query("select engine, road_tier, run_id, sequence from (select *, row_number() over (partition by engine, road_tier order by sequence desc, run_id) as rn from measurements) x where rn=1")
def latest_run_selection(spark, sf_dir):
    return results.latest(_runs(spark, sf_dir), ["engine", "road_tier"], "sequence", "run_id").select("engine", "road_tier", "run_id", "sequence")


@query("select run_id, sequence, elapsed_seconds from (select *, max(elapsed_seconds) over (partition by run_id) as m from measurements) x where elapsed_seconds=m")
def full_resource_rows(spark, sf_dir):
    return results.group_maxima(_runs(spark, sf_dir), ["run_id"], "elapsed_seconds").select("run_id", "sequence", "elapsed_seconds")


RUNS_SQL = """select run_id, engine, road_tier, cast(split_part(run_id,'-',2) as int)+1 as cpus, 10000 as location_count, 5 as repetitions,
 cast(split_part(run_id,'-',2) as int)<3 or road_tier<>'arterial' as passed, road_tier='service_rural' and engine='gpu' as dirty, max(sequence) as created_at from measurements group by 1,2,3"""
TIMED_SQL = """select m.run_id, median_s, round(median(abs(elapsed_seconds-median_s)),9) as mad_s from measurements m join
 (select run_id, median(elapsed_seconds) as median_s from measurements where kind='measured' group by 1) s on s.run_id=m.run_id where kind='measured' group by 1,2"""
LATEST_SQL = f"""select * from (select *, row_number() over (partition by engine, road_tier, cpus order by created_at desc, run_id) as nth from ({RUNS_SQL}) r
 where passed and not dirty) x where nth=1"""
ONE_SQL = f"({LATEST_SQL} and engine='cpu' and road_tier='general_driving' and cpus=1)"
PUBLISHED_SQL = f"""select r.*, t.median_s, t.mad_s, case when engine='cpu' and road_tier='general_driving' and (select count(*) from {ONE_SQL} q)=1 then
 (select max(u.median_s) from {ONE_SQL} q join ({TIMED_SQL}) u on u.run_id=q.run_id)/t.median_s end as su from ({LATEST_SQL}) r join ({TIMED_SQL}) t on t.run_id=r.run_id"""


def _run_list(spark, sf_dir) -> DataFrame:
    cpus = F.split("run_id", "-")[1].cast("int") + 1
    rows = _runs(spark, sf_dir).groupBy("run_id", "engine", "road_tier").agg(F.max("sequence").alias("created_at")).withColumn("cpus", cpus)
    facts = {"location_count": F.lit(10_000), "repetitions": F.lit(5), "passed": (F.col("cpus") < 4) | (F.col("road_tier") != "arterial"), "dirty": (F.col("road_tier") == "service_rural") & (F.col("engine") == "gpu")}
    return rows.withColumns(facts)


@query(f"""select run_id, engine, road_tier, cpus, round(mad_s/median_s,6) as relative_mad, mad_s/median_s>0.1e0 as high_variability, round(location_count/median_s,6) as locations_per_s,
 round(su,9) as speedup, round(su/cpus,9) as efficiency from ({PUBLISHED_SQL}) p""")
def run_publication(spark, sf_dir):
    timed = results.timings(_runs(spark, sf_dir), ["run_id"]).withColumn("mad_s", F.round("mad_s", 9))
    out = report.published(report.publishable(_run_list(spark, sf_dir), 10_000, 5), timed, "cpu", "general_driving", 0.1)
    rounded = [F.round(c, k).alias(c) for c, k in (("relative_mad", 6), ("locations_per_s", 6), ("speedup", 9), ("efficiency", 9))]
    return out.select("run_id", "engine", "road_tier", "cpus", "high_variability", *rounded)


@query("""select r.run_id, max(cast(sequence%101 as double)) filter (where r.engine='gpu') as gpu_peak_percent, round(avg(cast(sequence%101 as double)) filter (where r.engine='gpu'),9) as gpu_mean_percent,
 max(cast(sequence%16303 as double)) filter (where r.engine='gpu') as gpu_peak_mib from measurements r group by r.run_id""")
def gpu_summary(spark, sf_dir):
    from waymark.sources.readers import without_unit

    cells = _runs(spark, sf_dir).where("engine = 'gpu'").select("run_id", F.format_string("%d %%", F.col("sequence") % 101).alias("u"), F.format_string(" %d MiB", F.col("sequence") % 16303).alias("m"))
    telemetry = cells.select("run_id", without_unit(F.col("u")).alias("utilization"), without_unit(F.col("m")).alias("memory"))
    return report.gpu_peaks(_run_list(spark, sf_dir), telemetry).withColumn("gpu_mean_percent", F.round("gpu_mean_percent", 9))


CPUS = "select sequence%4+1 as cpus, median(elapsed_seconds) as median_s from measurements where kind='measured' group by 1"


@query(f"select cpus, round(b/median_s,9) as speedup, round(b/median_s/cpus,9) as efficiency from ({CPUS}) x, (select median_s as b from ({CPUS}) y where cpus=1) z")
def speedup_efficiency(spark, sf_dir):
    rows = _runs(spark, sf_dir).where("kind = 'measured'").groupBy((F.col("sequence") % 4 + 1).alias("cpus")).agg(F.percentile("elapsed_seconds", 0.5).alias("median_s"))
    return results.speedups(rows).select("cpus", F.round("speedup", 9).alias("speedup"), F.round("efficiency", 9).alias("efficiency"))


@query("""select road_tier, round(max(case when engine='cpu' then median_s end),9) as cpu, round(max(case when engine='gpu' then median_s end),9) as gpu from
 (select engine, road_tier, median(elapsed_seconds) as median_s from measurements where kind='measured' group by 1,2) x group by road_tier""")
def engine_tier_pivot(spark, sf_dir):
    rows = results.timings(_runs(spark, sf_dir), ["engine", "road_tier"])
    return results.pivot(rows, "road_tier", "engine", ["cpu", "gpu"], "median_s").select("road_tier", F.round("cpu", 9).alias("cpu"), F.round("gpu", 9).alias("gpu"))


@query("select run_id, max(elapsed_seconds) as peak, round(avg(elapsed_seconds),9) as mean, count(*) as samples from measurements group by run_id")
def telemetry_peaks(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("run_id").agg(F.max("elapsed_seconds").alias("peak"), F.round(F.avg("elapsed_seconds"), 9).alias("mean"), F.count("*").alias("samples"))


@query("select run_id, list_sort(list(distinct road_tier)) as tiers from measurements group by run_id")
def distinct_sets(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("run_id").agg(F.sort_array(F.collect_set("road_tier")).alias("tiers"))


@query("select sequence, cast(sequence%101 as double) as percent, cast(sequence%16303 as double) as mib from measurements")
def csv_unit_parse(spark, sf_dir):
    from waymark.sources.readers import without_unit

    cells = _runs(spark, sf_dir).select("sequence", F.concat((F.col("sequence") % 101).cast("string"), F.lit(" %")).alias("u"), F.concat(F.lit(" "), (F.col("sequence") % 16303).cast("string"), F.lit(" MiB")).alias("m"))
    return cells.select("sequence", without_unit(F.col("u")).alias("percent"), without_unit(F.col("m")).alias("mib"))


@query("select sha256(string_agg(concat(cast(location_id as varchar),',',printf('%.9f',lon),',',printf('%.9f',lat)), chr(10) order by location_id)) as checksum from locations")
def result_checksum(spark, sf_dir):
    return results.checksum(_locations(spark, sf_dir), "location_id", ["location_id", "lon", "lat"])
