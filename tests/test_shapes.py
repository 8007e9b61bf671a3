import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airstrata.operators import places, polygons
from airstrata.sources import files

RINGS = "kind string, name string, priority int, ring array<struct<lat:double,lon:double>>, holes array<array<struct<lat:double,lon:double>>>"


def star(rng, lat, lon, size, corners):
    turn = np.sort(rng.uniform(0, 2 * math.pi, corners))
    far = size * rng.uniform(0.3, 1.0, corners)
    return [(float(lat + r * math.sin(t)), float(lon + r * math.cos(t))) for t, r in zip(turn, far)]


def holds(rings, lat, lon):
    n = 0
    for ring in rings:
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
            n += (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
    return n % 2 == 1


@pytest.mark.parametrize("cell", [1.0, 0.25])
def test_points_in_regions_with_holes(spark, cell):
    rng = np.random.default_rng(5)
    regions = []
    for i in range(12):
        lat, lon, size = rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.1, 1.5, 6.0])
        regions.append(("a" if i % 2 else "b", f"r{i}", 1, star(rng, lat, lon, size, int(rng.integers(3, 40))), [star(rng, lat, lon, size / 4, 7) for _ in range(i % 3)]))
    box = [(0.0, 0.0), (0.0, 4.0), (3.0, 4.0), (3.0, 0.0)]  # along the borders of cells
    regions += [("a", "box", 1, box, [[(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]]), ("a", "box", 1, [(10.0, 10.0), (10.0, 11.0), (11.0, 10.0)], None), ("a", "none", 1, None, None), ("a", "point", 1, [(5.5, 5.5)], None)]
    points = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.uniform(-24, 24, (3000, 2)))]
    points += [(3000 + i, y + 0.5 * (i % 2), x + 0.25 * (i % 3)) for i, (y, x) in enumerate((float(y), float(x)) for y in range(-3, 6) for x in range(-3, 6))] + [(9999, None, 1.0)]
    df = spark.createDataFrame(regions + regions[:2], RINGS)
    got = {(r.id, r.name) for r in polygons.containing(spark.createDataFrame(points, "id long, lat double, lon double"), df, ["id"], cell).collect()}
    edge = lambda y, x: y in (0.0, 1.0, 2.0, 3.0) or x in (0.0, 1.0, 2.0, 4.0)  # noqa: E731  on an edge of the box
    for i, y, x in points[:-1]:
        for _, name, _, ring, holes in regions:
            if ring and name == "box" and ring == box and edge(y, x):
                continue
            if ring and holds([ring, *(holes or [])], y, x):
                assert (i, name) in got
            elif not (name == "box" and any(n == name and r and holds([r, *(h or [])], y, x) for _, n, _, r, h in regions)):
                assert (i, name) not in got
    assert not any(i == 9999 or n in ("none", "point") for i, n in got)


def test_an_edge_goes_to_the_cells_that_it_passes_only(spark):
    ring = [(0.5, 0.5), (40.5, 40.5), (40.5, 40.6)]
    index = polygons.indexed(spark.createDataFrame([("a", "long", 1, ring, None)], RINGS))
    assert index.count() < 130 and index.agg(F.max(F.size("_sides"))).first()[0] <= 3


def test_circles_are_round(spark):
    for y, x, km in ((0.0, 0.0, 500.0), (60.0, 20.0, 100.0), (-33.0, 151.0, 5.0)):
        ring = spark.range(1).select(polygons.circle(F.lit(y), F.lit(x), km).alias("r")).first().r
        for p in ring:
            a, b = math.radians(y), math.radians(p.lat)
            away = 2 * 6371.0 * math.asin(math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(p.lon - x) / 2) ** 2))
            assert abs(away - km) < km * 1e-4


def test_geojson_keeps_holes(spark, tmp_path):
    outer, hole = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    text = '{"features": [{"properties": {"name": "x"}, "geometry": {"type": "Polygon", "coordinates": [%s, %s]}}, {"properties": {"name": "y"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[8, 8], [9, 8], [9, 9], [8, 8]]], [%s]]}}]}' % (outer, hole, hole)
    (tmp_path / "r.json").write_text(text)
    regions = files.geojson_regions(spark, str(tmp_path / "r.json"), "zone")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 8.2, 8.7), (4, 3.5, 1.5), (5, 5.0, 5.0)], "id int, lat double, lon double")
    got = sorted((r.id, r.name) for r in polygons.containing(points, regions, ["id"]).collect())
    assert got == [(1, "x"), (2, "y"), (3, "y"), (4, "x")]


def away(lat, lon, lat2, lon2):
    a, b = np.radians(lat), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1.0, h)))


@pytest.mark.parametrize("n,k", [(300, 4), (3, 5), (0, 2)])
def test_nearest_anywhere_is_the_nearest(spark, n, k):
    rng = np.random.default_rng(3)
    a = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(rng.uniform(-89, 89, 60), rng.uniform(-180, 180, 60)))] + [(60, 30.01, 70.01), (61, None, 4.0), (62, 90.0, 0.0)]
    b = [(i, float(30 + rng.normal() * 0.05) if i % 5 else float(rng.uniform(-85, 85)), float(70 + rng.normal() * 0.05) if i % 5 else float(rng.uniform(-180, 180))) for i in range(n)]
    b += [(n, *b[0][1:]), (n + 1, None, 1.0)] if n else []
    got = places.nearest_anywhere(spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "other long, lat2 double, lon2 double"), "id", "other", k)
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in got._jdf.queryExecution().toString()
    mine = {(r.id, r["rank"]): (r.other, r.km) for r in got.collect()}
    there = [x for x in b if x[1] is not None]
    for i, y, x in a:
        want = sorted((float(away(y, x, y2, x2)), j) for j, y2, x2 in there)[:k] if y is not None else []
        assert len([1 for key in mine if key[0] == i]) == len(want)
        for rank, (km, _) in enumerate(want, 1):
            assert abs(mine[i, rank][1] - km) < 1e-6
    if n == 300:
        assert len({mine[60, rank][0] for rank in range(1, 5)}) == 4


def test_points_beside_segments(spark):
    rng = np.random.default_rng(8)
    points = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(rng.uniform(-3, 3, 900), rng.uniform(177, 183, 900)))]
    points = [(i, y, (x + 180) % 360 - 180) for i, y, x in points] + [(900, 70.02, 10.0), (901, 70.0, 10.9), (902, None, 0.0)]
    segments = [(i, float(y), float(x), float(y + d), float(x + e)) for i, (y, x, d, e) in enumerate(zip(rng.uniform(-3, 3, 80), rng.uniform(177, 183, 80), rng.normal(size=80), rng.normal(size=80)))]
    segments = [(i, a, (b + 180) % 360 - 180, c, (d + 180) % 360 - 180) for i, a, b, c, d in segments]
    segments += [(80, 70.0, 9.0, 70.0, 11.0), (81, 0.5, 179.9, 0.5, 179.9), (82, -2.9, -179.0, 2.9, -179.0)]
    got = {(r.id, r.seg): (r.km, r.along) for r in places.near_segments(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(segments, "seg int, lat1 double, lon1 double, lat2 double, lon2 double"), 25.0).collect()}
    turn = lambda x: (x + 180) % 360 - 180
    want = {}
    for i, y, x in points[:-1]:
        for s, y1, x1, y2, x2 in segments:
            k = math.cos(math.radians(y))
            dx, dy, px, py = turn(x2 - x1) * k, y2 - y1, turn(x - x1) * k, y - y1
            t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            km = math.hypot(px - t * dx, py - t * dy) * polygons.KM_PER_DEGREE
            if km <= 25.0:
                want[i, s] = (km, t)
    assert set(got) == set(want) and len(want) > 500
    assert all(abs(got[key][0] - want[key][0]) < 1e-6 and abs(got[key][1] - want[key][1]) < 1e-6 for key in want)
    assert (901, 80) in got and (900, 80) in got


def test_segments_of_paths(spark):
    rows = spark.createDataFrame([("a", 1, 0.0, 0.0, 5), ("a", 2, None, 1.0, 6), ("a", 3, 1.0, 1.0, 7), ("a", 4, 2.0, 1.0, None), ("b", 1, 9.0, 9.0, 1), ("c", 1, None, None, 1)], "path string, step int, lat double, lon double, v int")
    got = sorted(map(tuple, places.segments_of(rows, ["path"], "step", ["v"]).collect()))
    assert got == [("a", 1, 0.0, 0.0, 1.0, 1.0, 5, 7), ("a", 3, 1.0, 1.0, 2.0, 1.0, 7, None), ("b", 1, 9.0, 9.0, 9.0, 9.0, 1, 1)]


def test_close_pairs_come_once(spark):
    rng = np.random.default_rng(2)
    points = [(int(i), int(i % 2), float(y), float(x)) for i, y, x in zip(rng.permutation(700), [*rng.uniform(-0.2, 0.2, 400), *rng.uniform(89.6, 90, 150), *rng.uniform(-0.2, 0.2, 150)], [*rng.uniform(9.8, 10.2, 400), *rng.uniform(-180, 180, 150), *(((rng.uniform(179.8, 180.2, 150)) + 180) % 360 - 180)])]
    df = spark.createDataFrame(points, "id int, day int, lat double, lon double")
    for km in (3.0, 25.0):
        got = [(r.id, r.id2) for r in places.close_pairs(df, "id", km, ["day"]).collect()]
        want = {(min(a[0], b[0]), max(a[0], b[0])) for a in points for b in points if a[0] != b[0] and a[1] == b[1] and away(*a[2:], *b[2:]) <= km}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
