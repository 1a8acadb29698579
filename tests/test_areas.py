"""Named areas from GeoJSON, and points in and near them, against the distances of brute force."""

import json

import numpy as np
import pytest

from fieldloom.functions.geo import np_polygon_km
from fieldloom.operators import areas
from fieldloom.sources import polygons


def star(x, y, r, n, rng):
    at = np.sort(rng.uniform(0, 2 * np.pi, n))
    reach = r * rng.uniform(0.4, 1, n)
    return [[float(x + a * np.cos(t)), float(y + a * np.sin(t))] for a, t in zip(reach, at, strict=True)]


@pytest.fixture(scope="module")
def collection(tmp_path_factory):
    rng = np.random.default_rng(5)
    hole = [[103.0, 29.0], [105.0, 29.0], [105.0, 31.0], [103.0, 31.0], [103.0, 29.0]]
    shapes = {
        "Ring": ("Polygon", [[[100.0, 26.0], [108.0, 26.0], [108.0, 34.0], [100.0, 34.0]], hole]),  # one ring closed, one not
        "Twin": ("MultiPolygon", [[star(115, 22, 3, 40, rng)], [star(120, 40, 4, 25, rng)]]),
        "Over": ("Polygon", [star(108, 30, 5, 60, rng)]),
        "Far": ("Polygon", [star(-60, -40, 6, 30, rng)]),
    }
    path = tmp_path_factory.mktemp("areas") / "areas.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": k, "rank": 3}, "geometry": {"type": t, "coordinates": c}} for k, (t, c) in shapes.items()]}))
    return shapes, str(path)


def parts(shapes, names):
    return [[np.asarray(r) for r in p] for k in names for p in (shapes[k][1] if shapes[k][0] == "MultiPolygon" else [shapes[k][1]])]


def test_areas_are_read_by_name(spark, collection):
    shapes, path = collection
    every = polygons.read_areas(spark, path)
    assert {(r.name, r.part, r.ring, len(r.points)) for r in every.collect()} == {("Ring", 0, 0, 4), ("Ring", 0, 1, 5), ("Twin", 0, 0, 40), ("Twin", 1, 0, 25), ("Over", 0, 0, 60), ("Far", 0, 0, 30)}
    assert {r.name for r in polygons.read_areas(spark, path, ["Far", "None"]).collect()} == {"Far"}
    assert polygons.edges(polygons.read_areas(spark, path, ["Ring"])).count() == 8


@pytest.mark.parametrize("names", [["Ring", "Twin", "Over"], ["Ring"], ["Far"]])
@pytest.mark.parametrize("km", [0.0, 1.0, 50.0, 150.0])
def test_points_within_a_distance(spark, collection, names, km):
    shapes, path = collection
    rng = np.random.default_rng(8)
    lon, lat = np.concatenate((rng.uniform(95, 128, 1500), rng.uniform(-70, -50, 200))), np.concatenate((rng.uniform(15, 48, 1500), rng.uniform(-50, -30, 200)))
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lon, lat, strict=True))] + [(-1, None, 30.0), (0, float(lon[0]), float(lat[0]))], "id int, lon double, lat double")
    got = sorted(r.id for r in areas.within(points, polygons.edges(polygons.read_areas(spark, path, names)), km).collect())
    distance = np.min([np_polygon_km(lon, lat, p) for p in parts(shapes, names)], axis=0)
    want = np.flatnonzero(distance <= km).tolist()
    assert got == sorted(want + [0] * (0 in want)) and 0 < len(want) < 1600


def test_holes_are_outside(spark, collection):
    _, path = collection
    points = spark.createDataFrame([(1, 104.0, 30.0), (2, 101.0, 30.0), (3, 99.0, 30.0)], "id int, lon double, lat double")
    found = areas.inside(points, polygons.edges(polygons.read_areas(spark, path, ["Ring"])))
    assert [tuple(r) for r in found.collect()] == [(101.0, 30.0, "Ring")]
