"""Checks and statistics over result sets and timed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def difference(a: DataFrame, b: DataFrame, tolerance_m: float) -> DataFrame:
    """location_id, road_a, road_b, delta_m, same_road, failed: two results of the same locations side by side.

    A missing distance fails; a different road does not if the distances agree. Two rows of one location in a result are an
    error when the rows are read.
    """
    x, y = (single(d, "location_id", ["road_id", "distance_m"]).withColumnsRenamed({"road_id": f"road_{k}", "distance_m": f"distance_{k}"}) for d, k in ((a, "a"), (b, "b")))
    out = x.join(y.hint("merge"), "location_id").withColumn("delta_m", F.abs(F.col("distance_a") - F.col("distance_b")))
    return out.withColumn("same_road", F.col("road_a").eqNullSafe(F.col("road_b"))).withColumn("failed", F.col("delta_m").isNull() | F.isnan("delta_m") | (F.col("delta_m") > tolerance_m))


def single(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The key and columns of rows; a repeated key is an error when they are read. Shuffles by the key, as a join on it would."""
    n = F.when(F.count("*") > 1, F.raise_error(F.lit(f"{key} is not unique"))).otherwise(F.lit(True))
    kept = rows.groupBy(key).agg(F.first(F.struct(*columns)).alias("r"), n.alias("ok"))
    return kept.where("ok").select(key, "r.*")


def one_to_one(a: DataFrame, key: str) -> DataFrame:
    """The rows, if the key is unique."""
    if not a.groupBy(key).count().where("count > 1").isEmpty():
        raise RuntimeError(f"{key} is not unique")
    return a


def timings(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: n, min, max, median, 95th percentile (linear) and median absolute deviation of measured elapsed_seconds."""
    m = runs.where("kind = 'measured'")
    med = m.groupBy(*keys).agg(F.count("*").alias("n"), F.min("elapsed_seconds").alias("min_s"), F.max("elapsed_seconds").alias("max_s"), F.percentile("elapsed_seconds", 0.5).alias("median_s"), F.percentile("elapsed_seconds", 0.95).alias("p95_s"))
    mad = m.join(med.select(*keys, "median_s"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("elapsed_seconds") - F.col("median_s")), 0.5).alias("mad_s"))
    return med.join(mad, keys)


def latest(runs: DataFrame, keys: list[str], newest: str, tie: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(newest).desc(), F.col(tie).asc())
    return runs.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def group_maxima(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that have their group's largest value."""
    return runs.withColumn("__m", F.max(value).over(Window.partitionBy(*keys))).where(F.col(value) == F.col("__m")).drop("__m")


def speedups(rows: DataFrame) -> DataFrame:
    """rows: cpus, median_s. speedup and efficiency against the one row of 1 CPU; null unless there is exactly one."""
    one = rows.where("cpus = 1").agg(F.count("*").alias("__n"), F.max("median_s").alias("__base"))
    out = rows.crossJoin(one).withColumn("speedup", F.when(F.col("__n") == 1, F.col("__base") / F.col("median_s")))
    return out.drop("__n", "__base").withColumn("efficiency", F.col("speedup") / F.col("cpus"))


def pivot(rows: DataFrame, by: str, across: str, values: list[str], value: str) -> DataFrame:
    """One row per `by`, a column per value of `across`; two rows for one cell are an error, as is none for the whole row."""
    return rows.groupBy(by).pivot(across, values).agg(F.when(F.count(value) <= 1, F.first(value)).otherwise(F.raise_error(F.lit("two rows for one cell"))))


def checksum(result: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """sha256 over the rows as lines, by key; doubles with nine decimals. One line is gathered per row: for results of up to
    about a million rows."""
    parts = [F.format_string("%.9f", c) if dict(result.dtypes)[c] == "double" else F.col(c).cast("string") for c in columns]
    lines = result.select(F.col(key).alias("k"), F.concat_ws(",", *parts).alias("line"))
    return lines.agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l")).select(F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 256).alias("checksum"))
