import json
import os

import numpy as np
import pytest

from waymark.functions import planar
from waymark.operators import bundle
from waymark.sources.fixtures import relation

SQUARE = [np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], float)]
WIDE = [np.array([[-2, -2], [12, -2], [12, 12], [-2, 12], [-2, -2]], float)]


def test_buffer_as_predicate():
    x, y = np.array([5.0, 13.0, 11.0, 11.0, -3.0]), np.array([5.0, 5.0, 11.0, 5.0, 5.0])
    assert planar.rings_distance(x, y, SQUARE).tolist() == pytest.approx([0, 3, 2**0.5, 1, 3])
    assert planar.buffered_contain(x, y, SQUARE, 1.2, WIDE).tolist() == [True, False, False, True, False]


def test_bundle(spark, sf, tmp_path):
    folder = str(tmp_path / "bundle")
    divisions, segments = relation(spark, sf, "divisions"), relation(spark, sf, "segments")
    made = bundle.build(divisions, segments, 7, folder)
    assert made["counts"]["division"] == 1 and made["counts"]["segments"] > 0
    with open(os.path.join(folder, "manifest.json")) as f:
        assert json.load(f) == made
    with pytest.raises(FileExistsError):
        bundle.build(divisions, segments, 7, folder)
    with pytest.raises(RuntimeError):
        bundle.build(divisions, segments, -1, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert bundle.union_boxes(divisions).count() == 1


def test_load_table(spark):
    assert bundle.load_table(spark.range(7), "loaded") == 7
    assert bundle.load_table(spark.range(3), "loaded") == 3
