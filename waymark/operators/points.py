"""Reproducible sample points in a polygon: seeded rejection sampling in a projected plane."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from waymark.functions.planar import rings_contain


def draw(rings: list[np.ndarray], count: int, seed: int) -> np.ndarray:
    """count x 2 points strictly inside the rings, from numpy's PCG64 stream of this seed.

    A batch has the larger of 1024 and twice the missing number; all its x are drawn before all its y. A smaller count is
    not a prefix of a larger one.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    every = np.concatenate(rings)
    (xmin, ymin), (xmax, ymax) = every.min(axis=0), every.max(axis=0)
    kept: list[np.ndarray] = []
    have = 0
    while have < count:
        n = max(1024, 2 * (count - have))
        x = rng.uniform(xmin, xmax, n)
        y = rng.uniform(ymin, ymax, n)
        good = rings_contain(x, y, rings)
        kept.append(np.stack([x[good], y[good]], axis=1)[: count - have])
        have += len(kept[-1])
    return np.concatenate(kept) if kept else np.zeros((0, 2))


def points(spark: SparkSession, rings: list[np.ndarray], count: int, seed: int) -> DataFrame:
    """location_id (from 0, in order of drawing), seed, x, y."""
    xy = draw(rings, count, seed)
    rows = [(i, seed, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "location_id long, seed long, x double, y double")
