"""A compact bundle of sources: one boundary, and the segments that meet its box, published as a whole or not at all."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import roads
from waymark.sources import writers


def load_table(df: DataFrame, name: str) -> int:
    """Replaces a managed table with df and checks that every row arrived."""
    spark, want = df.sparkSession, df.count()
    df.write.mode("overwrite").saveAsTable(name)
    got = spark.table(name).count()
    if got != want:
        raise RuntimeError(f"{name} has {got} rows, not {want}")
    return got


def build(divisions: DataFrame, segments: DataFrame, division_id: int, folder: str) -> dict:
    """Writes the division and its segments with their boxes, reads the counts back, and publishes folder with a manifest."""
    spark = divisions.sparkSession
    one = roads.lookup(divisions, division_id)
    box = one.select("xmin", "ymin", "xmax", "ymax").first()
    kept = roads.prune(roads.with_box(segments), **box.asDict())
    with writers.published(folder) as staging:
        counts = {}
        for name, df in (("division", one), ("segments", kept)):
            writers.parquet_folder(df, os.path.join(staging, name))
            counts[name] = spark.read.parquet(os.path.join(staging, name)).count()
        if counts["division"] != 1:
            raise RuntimeError("the boundary is not one row")
        files = sorted(os.path.join(d, f) for d, _, fs in os.walk(staging) for f in fs if f.endswith(".parquet"))
        manifest = {"division_id": division_id, "counts": counts, "bounds": box.asDict(), "sha256": {os.path.relpath(f, staging): writers.file_sha256(f) for f in files}}
        writers.atomic_json(os.path.join(staging, "manifest.json"), manifest)
    return manifest


def union_boxes(parts: DataFrame) -> DataFrame:
    """Bounds of the union of boxes: one row."""
    return parts.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
