"""Two results of the same locations held against each other and against the roads they name; summaries of published runs.

Comparisons are one statement that Spark and DuckDB share, with the names of its tables as parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import sphere

MOST_SAMPLES = 100
_POINT = sphere.unit("near_lon", "near_lat", "p")


def on_roads_sql(result: str, roads: str) -> str:
    """Rows of a result (location_id, road_id, distance_m, near_lon, near_lat) with reported_m and off_m: how far the near point is
    from the road that the row names, found by its key; null if there is no such road."""
    keyed = f"(select road_id as key, ax, ay, az, ex, ey, ez from {sphere.unit_sql(roads, sphere.SEGMENT_UNIT)})"
    named = f"(select location_id, road_id, distance_m as reported_m, near_lon, near_lat from {result})"
    met = f"(select * from {sphere.unit_sql(named, _POINT)} n left join {keyed} k on road_id = key)"
    return f"(select location_id, road_id, reported_m, px, py, pz, case when key is null then null else distance_m end as off_m from {sphere.steps_sql(met, sphere.STEPS)})"


def comparison_sql(a: str, b: str, roads: str, tolerance_m: float) -> str:
    """location_id, road_a, road_b, delta_m, point_delta_m, off_a_m, off_b_m, other_road, failed.

    A row fails if distances or near points differ by more than the tolerance, or a near point is off its road or its road is
    unknown. Another road alone is no failure: it is explained by a tie.
    """
    chord = "(x.px-y.px)*(x.px-y.px)+(x.py-y.py)*(x.py-y.py)+(x.pz-y.pz)*(x.pz-y.pz)"
    rows = f"""(select x.location_id as location_id, x.road_id as road_a, y.road_id as road_b, abs(x.reported_m-y.reported_m) as delta_m,
 2e0*{sphere.RADIUS}e0*asin(least(1e0,sqrt({chord})/2e0)) as point_delta_m, x.off_m as off_a_m, y.off_m as off_b_m,
 coalesce(x.road_id<>y.road_id, not (x.road_id is null and y.road_id is null)) as other_road
 from {on_roads_sql(a, roads)} x join {on_roads_sql(b, roads)} y on x.location_id=y.location_id)"""
    good = " and ".join(f"coalesce({c}<={float(tolerance_m)!r}, false)" for c in ("delta_m", "point_delta_m", "off_a_m", "off_b_m"))
    return f"(select *, not ({good}) as failed from {rows})"


def summary_sql(rows: str, tier: str, tolerance_m: float, expected: str) -> str:
    """One row about a tier's comparison; it passed if every expected location was compared once and none failed."""
    over = lambda c: f"cast(coalesce(sum(case when coalesce({c}>{float(tolerance_m)!r}, true) then 1 else 0 end),0) as bigint)"
    return f"""(select '{tier}' as road_tier, count(*) as checked_rows, {over('delta_m')} as distance_mismatches, round(max(delta_m),3) as max_delta_m,
 {over('point_delta_m')} as point_mismatches, round(max(point_delta_m),3) as max_point_delta_m, {over('off_a_m')} as off_road_a, {over('off_b_m')} as off_road_b,
 cast(sum(case when other_road then 1 else 0 end) as bigint) as different_roads, cast(sum(case when other_road and failed then 1 else 0 end) as bigint) as unexplained_roads,
 count(*)=({expected}) and count(distinct location_id)=count(*) and sum(case when failed then 1 else 0 end)=0 as passed from {rows})"""


def samples(rows: DataFrame, tier: Column, most: int = MOST_SAMPLES) -> DataFrame:
    """The first failed rows of each tier by location_id."""
    failed = rows.withColumn("road_tier", tier).where("failed")
    return failed.withColumn("nth", F.row_number().over(Window.partitionBy("road_tier").orderBy("location_id"))).where(F.col("nth") <= most).drop("nth")


def publishable(runs: DataFrame, locations: int, repetitions: int) -> DataFrame:
    """The latest run of each engine, tier and number of CPUs among those that are complete, right and of clean code."""
    fit = runs.where((F.col("location_count") == locations) & (F.col("repetitions") == repetitions) & F.col("passed") & ~F.coalesce("dirty", F.lit(False)))
    order = Window.partitionBy("engine", "road_tier", "cpus").orderBy(F.col("created_at").desc(), "run_id")
    return fit.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def published(runs: DataFrame, timed: DataFrame, engine: str, headline_tier: str, variable_from: float) -> DataFrame:
    """Runs with the statistics of their timings (run_id, median_s, mad_s, ...): relative_mad, high_variability, locations_per_s, and
    speedup and efficiency for one engine's headline tier, if exactly one of its runs had one CPU."""
    out = runs.join(timed, "run_id").withColumn("relative_mad", F.col("mad_s") / F.col("median_s"))
    out = out.withColumn("high_variability", F.col("relative_mad") > variable_from).withColumn("locations_per_s", F.col("location_count") / F.col("median_s"))
    scaled = (F.col("engine") == engine) & (F.col("road_tier") == headline_tier)
    one = out.where(scaled & (F.col("cpus") == 1)).agg(F.count("*").alias("__n"), F.max("median_s").alias("__base"))
    out = out.crossJoin(one).withColumn("speedup", F.when(scaled & (F.col("__n") == 1), F.col("__base") / F.col("median_s")))
    return out.withColumn("efficiency", F.col("speedup") / F.col("cpus")).drop("__n", "__base")


def gpu_peaks(runs: DataFrame, telemetry: DataFrame) -> DataFrame:
    """run_id with the peak and mean utilisation and the peak memory of its telemetry; nulls for a run without any."""
    peaks = telemetry.groupBy("run_id").agg(F.max("utilization").alias("gpu_peak_percent"), F.avg("utilization").alias("gpu_mean_percent"), F.max("memory").alias("gpu_peak_mib"))
    return runs.select("run_id").join(peaks, "run_id", "left")
