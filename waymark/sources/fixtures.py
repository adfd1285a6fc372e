"""Relations of the data model derived from the star schema; the same statements run in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {"divisions": ("nation",), "locations": ("customer",), "segments": ("part",), "source_items": ("lineitem",), "features": ("orders", "lineitem"), "measurements": ("events",)}

RELATIONS = {
    "divisions": """select cast(n_nationkey as bigint) as division_id, n_name as name,
 case when n_nationkey%5=0 then 'IL' when n_nationkey%5=1 then 'XW' else 'ZZ' end as country,
 case when n_nationkey%2=0 then 'country' else 'locality' end as subtype, n_nationkey%3<>2 as is_land,
 34.3e0+(n_nationkey%5)*0.25e0 as xmin, 29.5e0+(n_nationkey%7)*0.5e0 as ymin,
 34.3e0+(n_nationkey%5)*0.25e0+0.3e0 as xmax, 29.5e0+(n_nationkey%7)*0.5e0+0.6e0 as ymax from nation""",
    "locations": """select c_custkey as location_id, 34.3e0+((c_custkey*7919)%100003)/100003e0*1.3e0 as lon,
 29.5e0+((c_custkey*104729)%100003)/100003e0*3.7e0 as lat from customer""",
    "segments": """select concat('seg',cast(p_partkey as string),'#0') as road_id,
 case p_partkey%12 when 0 then 'motorway' when 1 then 'trunk' when 2 then 'primary' when 3 then 'secondary' when 4 then 'tertiary'
 when 5 then 'unclassified' when 6 then 'residential' when 7 then 'living_street' when 8 then 'service' when 9 then 'track'
 when 10 then 'footway' else 'path' end as road_class,
 34.3e0+((p_partkey*15485863)%100003)/100003e0*1.3e0 as x1, 29.5e0+((p_partkey*32452843)%100003)/100003e0*3.7e0 as y1,
 34.3e0+((p_partkey*15485863)%100003)/100003e0*1.3e0+((p_partkey*31)%11-5.5e0)/100e0 as x2,
 29.5e0+((p_partkey*32452843)%100003)/100003e0*3.7e0+((p_partkey*17)%13-6.5e0)/100e0 as y2 from part""",
    "source_items": """select l_orderkey as feature_id, cast(row_number() over (partition by l_orderkey order by
 l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate,l_discount,l_tax)-1 as bigint) as pos,
 case when l_partkey%29=0 then true else false end as item_is_null,
 case when l_partkey%29=0 or l_partkey%31=0 then null else concat('DS-',l_returnflag) end as dataset,
 case when l_partkey%29=0 or l_partkey%37=0 then null when l_linestatus='F' then '' else '/height' end as property,
 case when l_partkey%29=0 or l_suppkey%4=0 then null else concat('L',cast(l_suppkey%3 as string)) end as license,
 case when l_partkey%29=0 or l_suppkey%5=0 then null else cast(cast(l_shipdate as date) as string) end as update_time,
 case when l_partkey%29=0 or l_suppkey%7=0 then null else l_discount end as confidence,
 l_partkey%29<>0 and l_linenumber%3=0 as between_present from lineitem""",
    "features": """select o_orderkey as feature_id, case when n is null then (case when o_orderkey%2=0 then 'null' else 'empty' end)
 else 'valid' end as list_state from orders left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) z on l_orderkey=o_orderkey""",
    "measurements": """select concat(event_type,'-',cast(user_id%4 as string)) as run_id,
 case when user_id%2=0 then 'cpu' else 'gpu' end as engine,
 case event_type when 'click' then 'arterial' when 'view' then 'general_driving' else 'service_rural' end as road_tier,
 case when event_id%7=0 then 'cold' when event_id%7=1 then 'warmup' else 'measured' end as kind,
 event_id as sequence, value as elapsed_seconds from events""",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    text = RELATIONS[name]
    for t in sources:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **sources)


def with_relations(sql: str) -> str:
    """The statement with the relations that it names as common table expressions."""
    used = [n for n in RELATIONS if n in sql]
    return ("with " + ", ".join(f"{n} as ({RELATIONS[n]})" for n in used) + " " if used else "") + sql
