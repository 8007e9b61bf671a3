import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airstrata import registry
from airstrata.functions.exprs import bearing
from airstrata.operators import graph, merging, places, polygons, screening, series, trajectories
from airstrata.plans import quality, statistics
from airstrata.sources import publish
from airstrata.streaming import feed
from tests.conftest import SF

LARGER = "/root/testdata/sf0.01"


def test_products_are_not_empty(spark):
    names = ["validated", "merge_states", "instrument_qc", "screened_hours", "daily_publish", "episodes", "day_episodes", "offline_runs", "flat_lines", "dedup_groups", "fire_exposure", "revision_log", "station_provinces"]
    assert not [n for n in names if not registry.queries()[n](spark, SF).limit(1).count()]
    # The smallest tables have no site of long plateaus, and no group of three sites.
    assert quality.city_outliers(spark, LARGER).count() > 10
    totals = quality.screened_hours(spark, LARGER).agg(F.sum("spikes").alias("s"), F.sum("stuck").alias("k")).first()
    assert totals.s > 10 and totals.k > 100
    assert quality.validated(spark, SF).where("state = 'INVALID'").count() > 10


def flat(values, least=6, tolerance=1.0):
    """Anchored flat lines of (low, high) hours, by the rule as it is told."""
    out, anchor, n = [], None, 0
    for i, v in enumerate([*values, None]):
        ok = v is not None and abs(v[1] - v[0]) <= tolerance
        mid = (v[0] + v[1]) / 2 if ok else None
        if n and ok and abs(mid - anchor) <= tolerance:
            n += 1
            continue
        if n >= least:
            out.append((i - n, n, anchor))
        anchor, n = (mid, 1) if ok else (None, 0)
    return out


def test_anchored_flat_lines_equal_brute_force(spark):
    r, rows, want = np.random.default_rng(8), [], []
    for k in range(12):
        x, values = 50.0, []
        for _ in range(150):
            x = x + float(r.normal(0, 0.25)) if r.random() < 0.93 else float(r.integers(0, 90))
            values.append(None if r.random() < 0.02 else (x, x + float(r.random()) * 1.1))
        rows += [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), *(v or (None, None))) for i, v in enumerate(values)]
        want += [(k, a, float(n), mid) for a, n, mid in flat(values)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, low double, high double")
    got = screening.anchored_flat_lines(df, "k", "t", "low", "high").collect()
    assert sorted((x.k, int((x.begins - datetime.datetime(2024, 1, 1)).total_seconds() // 3600), x.hours, round(x.value, 6)) for x in got) == sorted((k, a, n, round(v, 6)) for k, a, n, v in want) and len(want) > 20
    assert all((x.ends - x.begins).total_seconds() == x.hours * 3600 for x in got)


def test_percentiles_equal_numpy(spark):
    r = np.random.default_rng(3)
    values = {"a": r.normal(0, 50, 997).round(1), "b": np.repeat(7.0, 30), "c": np.array([1.5]), "d": r.integers(0, 4, 200).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, own in values.items() for v in own] + [("a", None)], "k string, v double")
    for x in series.percentiles(df, ["k"], "v", (0.1, 0.5, 0.95), 10.0).collect():
        assert np.allclose([x.p10, x.p50, x.p95], np.percentile(values[x.k], [10, 50, 95])) and x.n == len(values[x.k])


def test_radius_pairs_on_the_whole_sphere(spark):
    r = np.random.default_rng(5)
    points = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(np.degrees(np.arcsin(r.uniform(-1, 1, 500))), r.uniform(-180, 180, 500)))]
    points += [(500 + i, 89.9 - i % 3, -180.0 + i * 30) for i in range(12)] + [(600, 0.0, 179.9), (601, 0.1, -179.9), (602, 75.0, 180.0), (603, 75.1, -180.0), (604, -90.0, 0.0), (605, -89.5, 170.0)]
    a = spark.createDataFrame(points, "i int, lat double, lon double")
    for km in (50.0, 700.0):
        got = {(x.i, x.j) for x in places.within_radius(a, a.toDF("j", "lat2", "lon2"), km).collect()}

        def far(p, q):
            s = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
            return 2 * 6371.0 * math.asin(min(1, math.sqrt(s)))

        assert got == {(p[0], q[0]) for p in points for q in points if far(p, q) <= km}


def test_components_and_upserts(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 110)] + [(7, 7)]
    parts = {}
    for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect():
        parts.setdefault(x.label, set()).add(x.node)
    assert parts == {0: set(range(21)), 100: set(range(100, 110))}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    old = spark.createDataFrame([(1, 5.0, None), (2, 6.0, 7.0)], "k int, a double, b double")
    new = spark.createDataFrame([(1, None, 9.0, None), (2, 6.0 + 1e-12, 8.0, ["a"]), (3, 1.0, None, None)], "k int, a double, b double, gone array<string>")
    assert sorted(tuple(x) for x in merging.upsert(old, new, ["k"], ["a", "b"], "gone").collect()) == [(1, 5.0, 9.0, "updated"), (2, None, 8.0, "updated"), (3, 1.0, None, "inserted")]
    assert [tuple(x) for x in merging.revisions(old, new, ["k"], ["a", "b"]).collect()] == [(2, "b", 7.0, 8.0)]


def test_feed_upserts_batch_by_batch(spark, tmp_path):
    schema, at = "station int, ts timestamp, v double", lambda d: datetime.datetime(2024, 1, d)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    seen = []
    for n, rows in enumerate([[(1, at(1), 5.0), (2, at(1), 6.0)], [(1, at(2), None), (3, at(2), 7.0)], [(2, at(3), 8.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert feed.upserted(stream, str(tmp_path / "store"), ["station"], ["v"], str(tmp_path / "check")) == n
        seen.append({x.station: x.v for x in feed.current(spark, str(tmp_path / "store")).collect()})
    assert seen == [{1: 5.0, 2: 6.0}, {1: 5.0, 2: 6.0, 3: 7.0}, {1: 5.0, 2: 8.0, 3: 7.0}]


def test_paths_follow_the_wind(spark):
    grid = [("a", h, 850.0, r, c, 10.0, 0.0) for h in range(0, 13, 6) for r in range(-8, 9, 4) for c in range(-8, 9, 4)]
    grid += [("b", h, p, r, c, -(r / 2.0) * 2.0, (c / 2.0) * 2.0) for h in (0, 12) for p in (700.0, 900.0) for r in range(-8, 9) for c in range(-8, 9)]
    field = spark.createDataFrame(grid, "group string, hour int, level double, row int, col int, u double, v double")
    starts = spark.createDataFrame([("a", 1, 12.0, 0.0, 0.0, 850.0), ("b", 2, 12.0, 1.0, 0.0, 800.0)], "group string, id long, hour double, lat double, lon double, level double")
    rows = trajectories.integrated(starts, field, 12, 0.0, 0.0, 0.5).orderBy("group", "step").collect()
    own = [x for x in rows if x.group == "a"]
    assert [x.step for x in own] == list(range(13)) and own[-1].hour == 0.0
    assert abs(own[-1].lat) < 1e-9 and abs(own[-1].lon + 12 * 36_000 / trajectories.METRES_PER_DEGREE) < 1e-6
    # A turning wind keeps its distance from the middle.
    assert all(abs(math.hypot(x.lat, x.lon) - 1) < 0.01 for x in rows if x.group == "b")
    assert trajectories.members(starts, 0.1).count() == 18
    spread = trajectories.sectors(spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 100.0), ("a", 350.0)], "group string, deg double"), F.col("deg")).orderBy("sector").collect()
    assert [(x.sector, x.share, x.main, x.agrees) for x in spread] == [(0.0, 0.75, True, True), (90.0, 0.25, False, True)]
    lines = spark.createDataFrame([("  1 1 24 1 2 3 0 0 -5.0 31.5 74.2 500.0 900.0",), ("header text",)], "value string")
    assert [tuple(x) for x in trajectories.parsed_endpoints(lines).collect()] == [(1, -5.0, 31.5, 74.2, 500.0)]
    cells = spark.createDataFrame([(1, float(i)) for i in range(9)], "day int, frp double")
    assert sorted(x.frp for x in trajectories.planned_clusters(cells).collect()) == [6.0, 7.0, 8.0]


def test_calibration_is_monotone_and_helps(spark):
    rows = statistics.calibrated(spark, SF).collect()
    for fold in range(5):
        own = sorted((x.said, x.calibrated) for x in rows if x.fold == fold)
        assert all(b[1] >= a[1] - 1e-9 for a, b in zip(own, own[1:]))
    error = lambda c: sum(abs(x[c] - x.seen) for x in rows)
    assert rows and error("calibrated") < error("said")


def test_published_days(spark, tmp_path):
    df = spark.sql("SELECT date'2024-01-01' + cast(id / 10 AS int) AS date, id FROM range(30)")
    at = str(tmp_path / "days")
    assert publish.publish_missing(df, at, "2024-01-01", "2024-01-02", 10) == ["2024-01-01", "2024-01-02"]
    assert publish.publish_missing(df, at, "2024-01-01", "2024-01-03", 10) == ["2024-01-03"]
    assert publish.publish_missing(df, at, "2024-01-01", "2024-01-03", 10) == []
    with pytest.raises(ValueError):
        publish.publish_missing(df.where("id < 25"), at, "2024-01-01", "2024-01-03", 10, overwrite=True)
    times = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id AS int), 0, 0) AS ts, id FROM range(72)")
    publish.by_day(times, str(tmp_path / "readings"), "ts")
    rows = publish.between(spark, str(tmp_path / "readings"), "ts", "2024-01-02 06:00:00", "2024-01-02 09:00:00")
    assert sorted(x.id for x in rows.collect()) == [30, 31, 32]
    assert "PartitionFilters: [isnotnull(date" in rows._jdf.queryExecution().toString()
    fresh = publish.with_fresher_days(df, df.where("date = date'2024-01-02'").selectExpr("date", "id + 100 AS id").limit(1), "date")
    assert fresh.count() == 21


def test_borders(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([(1.0, 1.0, ring), (3.0, 1.0, ring)], "lat double, lon double, ring array<struct<lat:double,lon:double>>")
    got = df.select(polygons.inside(polygons.edges(F.col("ring")), F.col("lat"), F.col("lon")).alias("i"), polygons.border_km(polygons.edges(F.col("ring")), F.col("lat"), F.col("lon")).alias("km"), bearing(F.col("lat"), F.col("lon"), F.lit(90.0), F.lit(0.0)).alias("b")).collect()
    assert [x.i for x in got] == [True, False] and all(abs(x.km - 111.195) < 0.1 for x in got)
