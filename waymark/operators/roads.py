"""Boundaries and road networks: selection, pruning by boxes, exact clipping, tiers and statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import planar, sphere, wkb

# The road classes of each tier, and those that no tier has.
ARTERIAL = ("motorway", "trunk", "primary", "secondary")
GENERAL = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street")
RURAL = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "track")
EXCLUDED = ("footway", "path", "steps", "pedestrian", "cycleway", "bridleway", "raceway", "unknown")
TIERS = {"arterial": ARTERIAL, "general_driving": GENERAL, "service_rural": RURAL}


def boundary(divisions: DataFrame, country: str, subtype: str) -> DataFrame:
    return divisions.where((F.col("country") == country) & (F.col("subtype") == subtype) & F.col("is_land"))


def lookup(divisions: DataFrame, division_id: int) -> DataFrame:
    """The one division of this id; any other number of rows is an error."""
    out = divisions.where(F.col("division_id") == division_id)
    if out.limit(2).count() != 1:
        raise RuntimeError(f"division {division_id} is not exactly one row")
    return out


def english(names):
    """The English common name of a names column, whether its `common` is a map or a list of pairs."""
    return F.element_at(names["common"], "en")


def english_of_pairs(names):
    return F.element_at(F.map_from_entries(names["common"]), "en")


def with_box(segments: DataFrame) -> DataFrame:
    return segments.withColumn("bbox", F.struct(F.least("x1", "x2").alias("xmin"), F.greatest("x1", "x2").alias("xmax"), F.least("y1", "y2").alias("ymin"), F.greatest("y1", "y2").alias("ymax")))


def prune(boxed: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Rows whose bbox meets the box; touching counts. On a Parquet scan the four comparisons are pushed down."""
    b = F.col("bbox")
    return boxed.where((b["xmin"] <= xmax) & (b["xmax"] >= xmin) & (b["ymin"] <= ymax) & (b["ymax"] >= ymin))


def tier_flags(roads: DataFrame) -> DataFrame:
    return roads.withColumns({f"is_{t}": F.col("road_class").isin(*c) for t, c in TIERS.items()})


#: Boxes that are sent to every task; more than that meet segments through grid cells.
MOST_BROADCAST = 10_000


def box_clip(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each segment's part in each box, without parts of no length.

    Up to MOST_BROADCAST boxes are broadcast. More are joined on cells as wide as a mean box; a pair counts in the one cell
    that holds the lower left corner of what both bounds share.
    """
    b = boxes.select("division_id", "xmin", "ymin", "xmax", "ymax")
    low = {c: F.least(f"{c}1", f"{c}2") for c in "xy"}
    high = {c: F.greatest(f"{c}1", f"{c}2") for c in "xy"}
    meets = (low["x"] <= F.col("xmax")) & (high["x"] >= F.col("xmin")) & (low["y"] <= F.col("ymax")) & (high["y"] >= F.col("ymin"))
    if b.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        met = segments.join(F.broadcast(b), meets)
    else:
        mean = b.agg(*[F.avg(F.col(f"{c}max") - F.col(f"{c}min")).alias(c) for c in "xy"]).first()
        step = {c: max(mean[c] or 0.0, 1e-9) for c in "xy"}
        cell = lambda v, c: F.floor(v / step[c])
        spread = lambda df, lo, hi: df.withColumn("gx", F.explode(F.sequence(cell(lo("x"), "x"), cell(hi("x"), "x")))).withColumn("gy", F.explode(F.sequence(cell(lo("y"), "y"), cell(hi("y"), "y"))))
        left, right = spread(segments, low.get, high.get), spread(b, lambda c: F.col(f"{c}min"), lambda c: F.col(f"{c}max"))
        corner = [cell(F.greatest(low[c], F.col(f"{c}min")), c) == F.col(f"g{c}") for c in "xy"]
        met = left.join(right, ["gx", "gy"]).where(meets & corner[0] & corner[1]).drop("gx", "gy")
    return sphere.with_steps(met, planar.CLIP_STEPS).where(planar.CLIPPED)


def polygon_clip(roads: DataFrame, rings: list[list[list[float]]]) -> DataFrame:
    """Line fragments of roads (id, road_class, geometry as WKB) inside a polygon: road_id, source_segment_id, road_class,
    geometry, length (in degrees).

    The polygon's rings travel with the function: one boundary, of bounded size. Fragments are numbered before those
    without length are dropped, so numbers may have gaps; road_id is the segment's id, '#' and the number.
    """
    shape = [np.array(r, float) for r in rings]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, c, g in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if g is None:
                    continue
                parts = [p for line in wkb.line_parts(wkb.decode(g)) for p in planar.clip_line(line, shape)]
                for k, p in enumerate(parts):
                    length = float(np.sqrt((np.diff(p, axis=0) ** 2).sum(axis=1)).sum())
                    if length > 0 and np.isfinite(p).all():
                        out.append((f"{i}#{k}", i, c, wkb.line(p), length))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.binary(), pa.float64()), strict=True)], ["road_id", "source_segment_id", "road_class", "geometry", "length"])

    return roads.select(F.col("id").cast("string"), "road_class", "geometry").mapInArrow(work, "road_id string, source_segment_id string, road_class string, geometry binary, length double")


def fragments(lines: DataFrame) -> DataFrame:
    """road_id = id#part for an array column `parts` of lines: numbered first, then those with fewer than two points go."""
    return lines.select("*", F.posexplode("parts").alias("part", "line")).where(F.size("line") >= 2).withColumn("road_id", F.concat_ws("#", "id", "part"))


def validity(roads: DataFrame) -> DataFrame:
    """One row: rows, distinct ids, rows without id, rows without length, bounds of all."""
    dead = F.col("road_id").isNull() | F.col("x1").isNull() | F.col("x2").isNull() | F.isnan("x1") | ((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2")))
    return roads.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("road_id").alias("n_ids"),
        F.sum(dead.cast("long")).alias("n_invalid"),
        F.sort_array(F.collect_set("road_class")).alias("classes"),
    )


def planar_length(segments: DataFrame) -> DataFrame:
    e1, n1 = planar.project(F.col("x1"), F.col("y1"))
    e2, n2 = planar.project(F.col("x2"), F.col("y2"))
    return segments.withColumns({"e1": e1, "n1": n1, "e2": e2, "n2": n2}).withColumn("length_m", F.sqrt((F.col("e1") - F.col("e2")) ** 2 + (F.col("n1") - F.col("n2")) ** 2)).drop("e1", "n1", "e2", "n2")
