"""Contour segments lie on the level, join at their ends, and close around a hill."""

from collections import Counter

import numpy as np
import pytest

from fieldloom.operators import contours


def grid(spark, f, n=12, skip=()):
    rows = [(i, j, i * 0.5, j * 0.25, float(f(i * 0.5, j * 0.25)) if (i, j) not in skip else None) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "i int, j int, x double, y double, z double")


def test_a_plane_has_straight_contours(spark):
    got = contours.contour_segments(grid(spark, lambda x, y: 2 * x + 4 * y), [3.1, 7.0]).collect()
    assert {r.level for r in got} == {3.1, 7.0}
    for r in got:
        assert 2 * r.x1 + 4 * r.y1 == pytest.approx(r.level) and 2 * r.x2 + 4 * r.y2 == pytest.approx(r.level) and (r.x1, r.y1) <= (r.x2, r.y2)


def test_contours_of_a_hill_are_closed(spark):
    f = lambda x, y: np.exp(-((x - 2.7) ** 2) / 2 - (y - 1.3) ** 2)
    got = contours.contour_segments(grid(spark, f), [0.5]).collect()
    ends = Counter((round(x, 9), round(y, 9)) for r in got for x, y in ((r.x1, r.y1), (r.x2, r.y2)))
    assert len(got) > 10 and set(ends.values()) == {2}


def test_flat_fields_and_gaps(spark):
    assert contours.contour_segments(grid(spark, lambda x, y: 1.0), [1.0, 0.5]).count() == 0
    whole = contours.contour_segments(grid(spark, lambda x, y: x), [1.3]).count()
    assert contours.contour_segments(grid(spark, lambda x, y: x, skip={(2, 3)}), [1.3]).count() == whole - 4
