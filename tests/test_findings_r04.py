"""What the findings of the fourth round are about, on small tables that the code before them failed."""

from __future__ import annotations


def test_exact_mean_is_the_sum_rounded_once(spark):
    import math
    import random

    from pyspark.sql import functions as F

    from airstrata.functions.exprs import exact_mean

    r, groups = random.Random(5), [[], [None], [0.1], [0.1, 0.2], [-0.0, 0.1, None, -0.3], [1e9, 0.01, -1e9], [1e300, 1.0], [float("inf"), 1.0], [2.0**33] * 2]
    groups += [[round(r.uniform(-60, 500), r.randint(0, 9)) for _ in range(r.randint(1, 40))] for _ in range(300)]
    rows = [(i, x) for i, g in enumerate(groups) for x in g]
    got = {x.k: x.v for x in spark.createDataFrame(rows, "k int, v double").repartition(7).groupBy("k").agg(exact_mean(F.col("v")).alias("v")).collect()}
    for i, g in enumerate(groups):
        own = [x for x in g if x is not None]
        assert got.get(i) == (math.fsum(own) / len(own) if own else None), g


def test_days_on_the_limit_count_by_their_exact_sum(spark, tmp_path):
    import datetime
    import itertools
    import random

    from airstrata.plans import directory

    r, rows, station = random.Random(3), [], 0
    while station < 600:  # stations whose three hours, and whose three readings of one hour, have a mean of 35 that one order puts above it
        a, b = round(r.uniform(1, 60), 2), round(r.uniform(1, 40), 2)
        c = round(105 - a - b, 2)
        if c > 0 and len({x + y + z > 105 for x, y, z in itertools.permutations((a, b, c))}) == 2:
            for own in itertools.permutations((a, b, c)):
                for minutes in (60, 10):
                    rows += [(len(rows) + i, datetime.datetime(2024, 1, 15, 3) + datetime.timedelta(minutes=minutes * i), station, "view", v) for i, v in enumerate(own)]
                    station += 1
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").selectExpr("*", "'{}' as props")
    df.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = directory.station_overview(spark, str(tmp_path)).collect()
    assert len(got) == station and all((x.days_above, x.days, x.mean_30d) == (0, 1, 35.0) for x in got)


def test_ratios_of_many_pairs_are_those_of_difflib():
    import difflib
    import random

    from airstrata.plans import feeds

    r, pairs = random.Random(1), [("", ""), ("", "x"), ("x" * 250 + "abc", "x" * 250 + "abd"), ("a" * 199, "a" * 150 + "b")]
    for alphabet in ("ab", "0123456789", "aé漢😀b "):
        for _ in range(1500):
            a = [r.choice(alphabet) for _ in range(r.randint(0, 30))]
            b = list(a)
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(b) + 1)
                b[at : at + r.randint(0, 1)] = r.choice(["", "x", r.choice(alphabet)])
            pairs.append(("".join(a), "".join(b)))
    assert feeds.ratios(*zip(*pairs)) == [round(difflib.SequenceMatcher(None, a, b).ratio(), 3) for a, b in pairs]


def test_names_of_one_form_meet_few_others(spark):
    from pyspark.sql import functions as F

    from airstrata.plans import feeds

    rows = spark.range(3000).select(F.lit("one").alias("city"), "id", F.format_string("customer#%09d", F.col("id") * 7).alias("name"))
    found = feeds.alike(rows, "city", "id", "name").count()
    names = rows.select(F.col("city").alias("_in"), F.col("name").alias("_name"))
    sizes = spark.createDataFrame([("one", 18, 17, True)], "_in string, _m int, _shared long, short boolean")
    met = feeds._short_pairs(names, sizes)
    assert 1000 < found <= met.distinct().count() <= 2 * found and met.count() <= 4 * found  # of 4.5 million pairs


def test_pairs_of_paths_and_fires_are_folded_where_they_meet(spark):
    import re

    from airstrata.plans import geometry

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = geometry.path_fires(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    names = [re.sub(r"#\d+L?", "", k).split(", ") for k in keys]
    assert ["path"] in names and not any("path" in x and "id" in x for x in names)


def test_segments_meet_the_points_that_lie_near_anywhere(spark):
    import math
    import random

    from airstrata.operators import places

    r = random.Random(9)
    starts = [(r.uniform(-89.9, 89.9), r.uniform(-180, 180)) for _ in range(150)] + [(r.choice([-88, 0, 60, 89.5]) + r.random() / 3, r.choice([-180.0, 179.8, 0.0])) for _ in range(80)]
    segments, points = [], []
    for i, (y, x) in enumerate(starts):
        for k in range(3):
            dy, dx = r.choice([0.0, r.uniform(-1.5, 1.5)]), r.choice([0.0, r.uniform(-1.5, 1.5)])
            segments.append((3 * i + k, y, x, max(-90.0, min(90.0, y + dy)), (x + dx + 180) % 360 - 180))
            points.append((len(points), max(-90.0, min(90.0, y + r.uniform(-0.6, 0.6))), (x + r.uniform(-2, 2) + 180) % 360 - 180))
    turn = lambda v: v if abs(v) <= 180 else (v + 180) % 360 - 180
    want = set()
    for s, y1, x1, y2, x2 in segments:
        for p, y, x in points:
            k, dx, dy, px, py = math.cos(math.radians(y)), turn(x2 - x1), y2 - y1, turn(x - x1), y - y1
            size = (dx * k) ** 2 + dy**2
            at = max(0.0, min(1.0, (px * k * dx * k + py * dy) / size)) if size else 0.0
            km = math.hypot(px * k - at * dx * k, py - at * dy) * places.KM_PER_DEGREE
            assert abs(km - 25) > 1e-6
            if km <= 25:
                want.add((p, s))
    rows = places.near_segments(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(segments, "seg int, lat1 double, lon1 double, lat2 double, lon2 double"), 25.0).select("id", "seg").collect()
    assert len(rows) == len(want) > 300 and {tuple(x) for x in rows} == want
