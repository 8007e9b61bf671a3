"""What the findings of the third round are about, on small tables that the code before them failed."""

from __future__ import annotations

import pytest

from airstrata.operators import places


@pytest.fixture
def sizes(monkeypatch):
    """The rows of both sides of every radius join."""
    out, join = [], places.within_radius

    def counted(a, b, km, also=None):
        out.append((a.count(), b.count()))
        return join(a, b, km, also)

    monkeypatch.setattr(places, "within_radius", counted)
    return out


def _shared(spark, n):
    """Stations on six places and sites on seven, however many there are."""
    at = "cast(30 + id % {0} * 0.1 as double) {1}", "cast(70 + id % {0} * 0.2 as double) {1}"
    a = spark.range(n).selectExpr("id as station", at[0].format(6, "lat"), at[1].format(6, "lon"))
    return a, spark.range(n).selectExpr("id as site", at[0].format(7, "lat2"), at[1].format(7, "lon2"))


def test_points_of_one_place_are_searched_once(spark, sizes):
    a, b = _shared(spark, 200)
    got = {(r.station, r["rank"]): (r.site, round(r.km, 6)) for r in places.nearest(a, b, "station", "site", 60.0, 5).collect()}
    assert sizes and all(x <= 6 and y <= 7 for x, y in sizes)
    every = places.haversine_km(*[places.F.col(c) for c in ("lat", "lon", "lat2", "lon2")])
    pairs = sorted((r.station, r.km, r.site) for r in a.crossJoin(b).withColumn("km", every).where("km <= 60").collect())
    want, rank = {}, {}
    for station, km, site in pairs:
        rank[station] = rank.get(station, 0) + 1
        if rank[station] <= 5:
            want[station, rank[station]] = (site, round(km, 6))
    assert got == want


def test_nearest_stops_at_its_limit(spark):
    a = spark.createDataFrame([(1, 30.0, 70.0), (2, 80.0, -100.0), (3, None, 0.0)], "station int, lat double, lon double")
    b = spark.createDataFrame([(7, 30.5, 70.0), (8, 31.5, 70.0), (9, 30.0, None)], "site int, lat2 double, lon2 double")
    got = [(r.station, r["rank"], r.site) for r in places.nearest(a, b, "station", "site", 100.0, 2).collect()]
    assert got == [(1, 1, 7)]


@pytest.mark.parametrize("name", ["idw", "neighbours_radius"])
def test_radius_products_pair_places(spark, sizes, monkeypatch, name):
    from airstrata.plans import fires

    a, b = _shared(spark, 200)
    monkeypatch.setattr(fires, "stations", lambda *_: a.withColumn("active", fires.F.lit(True)))
    monkeypatch.setattr(fires, "_sites", lambda *_: b)
    got = fires.QUERIES[name](spark, "")
    pairs = a.crossJoin(b).withColumn("km", places.haversine_km(*[places.F.col(c) for c in ("lat", "lon", "lat2", "lon2")])).where(f"km <= {150 if name == 'idw' else 60}")
    assert (got.agg(fires.F.sum("n")).first()[0] if name == "idw" else got.count()) == pairs.count()
    assert sizes and all(x <= 6 and y <= 7 for x, y in sizes)


def _joined_unfolded(df):
    """Generates that reach a join before any aggregate, by the optimized plan."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    nodes = [(len(x) - len(x.lstrip(" :+-")), x.lstrip(" :+-").split(" ")[0]) for x in lines]
    out = 0
    for i, (depth, name) in enumerate(nodes):
        if name == "Generate":
            above = []
            for d, parent in reversed(nodes[:i]):
                if d < depth:
                    depth = d
                    above.append(parent)
            out += next((x for x in above if x in ("Join", "Aggregate")), "") == "Join"
    return out


def test_bin_bias_joins_folded_values_alone(spark):
    from airstrata.plans import statistics

    assert _joined_unfolded(statistics.bin_bias(spark, "/root/testdata/sf0.001")) == 0


def test_calibrated_reads_its_days_not_the_hours(spark):
    from airstrata.plans import statistics

    assert "Generate" not in statistics.calibrated(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_signal_has_tasks_by_its_sites(spark, tmp_path):
    from airstrata.sources import tables

    spark.range(9000).selectExpr("id as s_suppkey", "cast(id % 25 as int) as s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert tables.signal(spark, str(tmp_path)).rdd.getNumPartitions() >= 9


def test_segments_by_the_plain_formula_to_the_bit(spark):
    import random

    r = random.Random(7)
    at = lambda a: round(a + r.random(), 2)
    points = spark.createDataFrame([(i, at(30), at(70)) for i in range(60)], "id int, lat double, lon double").selectExpr("*", "cos(radians(lat)) as k")
    segments = spark.createDataFrame([(i, at(30), at(70), at(30), at(70)) for i in range(60)], "seg int, lat1 double, lon1 double, lat2 double, lon2 double")
    rows = places.near_segments(points, segments, 25.0).collect()
    assert len(rows) > 200
    for p in rows:
        dx, dy, px, py = p.lon2 - p.lon1, p.lat2 - p.lat1, p.lon - p.lon1, p.lat - p.lat1
        along = max(0.0, min(1.0, (px * p.k * dx * p.k + py * dy) / ((dx * p.k) * (dx * p.k) + dy * dy)))
        assert p.along == along


def test_thin_days_of_all_years_are_judged(spark):
    from airstrata.plans import fire_days

    years = {r.day.year for r in fire_days.suspect_fire_days(spark, "/root/testdata/sf0.01").collect()}
    assert years == set(range(1995, 2002))


@pytest.mark.parametrize("km", [1.0, 40.0, 900.0, 6000.0])
def test_close_pairs_are_all_found_once_from_few_rows(spark, km):
    import numpy as np

    r = np.random.default_rng(11)
    dense = [(30 + a, 70 + b) for a, b in r.uniform(0, 8 * km / 111, (300, 2))] if km < 500 else []
    sphere = list(zip(np.degrees(np.arcsin(r.uniform(-1, 1, 150))), r.uniform(-180, 180, 150)))
    poles = [(89.99 - i % 3 * km / 200, -180.0 + i * 30) for i in range(12)] + [(0.0, 179.999), (0.001, -179.999), (75.0, 180.0), (75.001, -180.0), (-90.0, 0.0), (-89.999, 170.0), (90.0, 5.0)]
    rows = [(i, i % 2, float(min(90.0, max(-90.0, y))), float(x)) for i, (y, x) in enumerate([*dense, *sphere, *poles])]
    points = spark.createDataFrame(rows, "id int, day int, lat double, lon double")
    got = [(p.id, p.id2) for p in places.close_pairs(points, "id", km, ["day"]).collect()]
    far = places.haversine_km(*[places.F.col(c) for c in ("lat", "lon", "lat2", "lon2")])
    other = points.selectExpr("id as id2", "day", "lat as lat2", "lon as lon2")
    want = {(p.id, p.id2) for p in points.join(other, "day").where("id < id2").where(far <= km).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_names_that_keys_share_are_compared_once(spark, monkeypatch):
    import difflib

    from airstrata.plans import feeds

    names = ["lahore north 1", "lahore north 2", "tide", "diet", "lahore nort 12", "karachi"]
    rows = [(g, k, names[(k * 5 + g) % 6]) for g in (1, 2) for k in range(40)]
    got = feeds.alike(spark.createDataFrame(rows, "city int, station int, name string"), "city", "station", "name")
    want = sorted((a, b, round(difflib.SequenceMatcher(None, x, y).ratio(), 3)) for g, a, x in rows for h, b, y in rows if g == h and a < b)
    assert sorted((r.a, r.b, r.ratio) for r in got.collect()) == [w for w in want if w[2] >= 0.9]
    text = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    eval_at = next(i for i, x in enumerate(text) if "ArrowEvalPython" in x)
    assert any("Join Inner" in x for x in text[:eval_at])


def test_snapshot_adds_up_readings_in_their_order(spark, tmp_path):
    import datetime
    import random

    import duckdb

    from airstrata.plans import directory

    r, rows = random.Random(3), []
    while len(rows) < 3 * 40:
        a, b = round(r.uniform(1, 60), 2), round(r.uniform(1, 40), 2)
        c = round(106.2 - a - b, 2)
        if c > 0 and ((a + b) + c > 106.2) != (a + (b + c) > 106.2):
            rows += [(len(rows) + i, datetime.datetime(2024, 1, 15, i), len(rows) // 3, "view", v) for i, v in enumerate((a, b, c))]
    rows.append((len(rows), datetime.datetime(2024, 1, 15), 999, "view", float("inf")))  # the last band has no end
    for part in (0, 1):  # of each station the first reading is in a file of its own
        own = [x for x in rows if (x[0] % 3 == 0) == (part == 0)]
        df = spark.createDataFrame(own, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").selectExpr("*", "'{}' as props")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet') ORDER BY event_id")
    for t in ("customer", "nation", "region", "lineitem", "supplier", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = con.execute("SET threads = 1").execute(directory.ORACLE["snapshot"])
    names, bands = [d[0] for d in want.description], want.fetchone()
    got = directory.snapshot(spark, str(tmp_path)).first()
    assert [got[f"band_{i}"] for i in range(6)] == [bands[names.index(f"band_{i}")] for i in range(6)]


def test_new_chunks_are_encoded_many_at_once(monkeypatch):
    import numpy as np

    from airstrata.llm.tokens import Encoder, vocabulary_path

    enc, given = Encoder(vocabulary_path()), []
    direct = enc.direct
    monkeypatch.setattr(enc, "direct", lambda texts: given.extend(texts) or direct(texts))
    words = [f"{a}{b}" for a in ("word", "Été", "漢字", "x1", "don't", "!?", "<|endoftext|>") for b in range(40)]
    texts = [" ".join(words), "\n\n\t".join(reversed(words)) + " \n", "", " ", ",a, b.c ."]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(enc.known) > 500 and len(given) < 40
    # An id that reaches over the end of a chunk: each is encoded alone.
    assert enc.joined(["ab", "out"]) == direct(["ab", "out"])


def test_texts_are_projected_together_as_alone():
    import pyarrow as pa

    from airstrata.llm import packing

    table = packing.signs()
    texts = ["", "a", "ab", "abc", "é" * packing.BLOCK, "", *(f"text {i} " * i for i in range(300)), "x" * packing.BLOCK, "ab"]
    got = packing.projected(pa.array(["left out", *texts]).slice(1), table)
    assert (got == [packing.project(t.encode(), table) for t in texts]).all()
    assert packing.projected(pa.array(["", ""]), table).shape == (2, packing.DIMS)
