import datetime
import difflib
import random

import pytest

from airstrata import registry
from airstrata.functions.exprs import PM25_POINTS, category, index_of
from airstrata.operators import series
from airstrata.plans import feeds, fires, observations
from airstrata.sources import publish
from airstrata.sources.tables import stations
from airstrata.streaming import feed
from tests.conftest import SF
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF).columns
    else:
        assert compare(spark, SF, query, sql) is None


def test_index_at_its_edges(spark):
    rows = spark.sql("SELECT * FROM VALUES (0.0D, 0, 'Good'), (9.0D, 50, 'Good'), (9.05D, 50, 'Good'), (9.1D, 51, 'Moderate'), (35.4D, 100, 'Moderate'), (325.4D, 500, 'Hazardous'), (-1.0D, null, 'Unknown'), (double('NaN'), null, 'Unknown'), (double('infinity'), null, 'Unknown'), (null, null, 'Unknown') AS t(x, want, band)")
    for r in rows.select("*", index_of(rows.x, PM25_POINTS).alias("got"), category(index_of(rows.x, PM25_POINTS)).alias("named")).collect():
        assert (r.got, r.named) == (r.want, r.band)


def test_spikes_and_stuck_runs(spark):
    values = [10, 10, 400, 10, 12, 300, 310, 12, 12, 12, None, 12]
    df = spark.createDataFrame([(1, i, None if v is None else float(v)) for i, v in enumerate(values)], "k int, t int, v double")
    got = [r.spike for r in series.spikes(df, "k", "t", "v").orderBy("t").collect()]
    assert [i for i, s in enumerate(got) if s] == [2, 5, 6]
    assert [r.t for r in series.stuck(df, "k", "t", "v", 3).where("stuck").orderBy("t").collect()] == [7, 8, 9]


def test_publish_replaces_partitions_and_marks_success(spark, tmp_path):
    a = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, date string").selectExpr("v", "date(date) AS date")
    path = str(tmp_path / "out")
    publish.publish(a, path)
    publish.publish(a.where("v = 2").selectExpr("v + 10 AS v", "date"), path)
    assert sorted(r.v for r in publish.published(spark, path).collect()) == [1, 12]
    assert [str(r.date) for r in publish.missing_days(spark, path, "2024-01-01", "2024-01-03").collect()] == ["2024-01-03"]
    merged = publish.merge_series(a, a.where("v = 2").selectExpr("v + 5 AS v", "date"), ["date"])
    assert sorted(r.v for r in merged.collect()) == [1, 7]
    with pytest.raises(FileNotFoundError):
        publish.published(spark, str(tmp_path / "none"))


def test_empty_input_gives_empty_results(spark):
    none = spark.createDataFrame([], "k int, t timestamp_ntz, v double")
    assert series.hourly(none, "k", "t", "v").count() == 0
    assert series.spikes(none, "k", "t", "v").count() == 0
    assert series.latest_by(none, ["k"], "t", "v").count() == 0


def test_cell_clusters_equal_brute_force(spark):
    cells = {}
    for r in fires.detections(spark, SF).selectExpr("date_format(day, 'yyyy-MM') AS month", "cy", "cx").distinct().collect():
        cells.setdefault(r.month, set()).add((r.cy, r.cx))
    want = set()
    for month, left in cells.items():
        while left:
            found, todo = set(), [left.pop()]
            while todo:
                y, x = todo.pop()
                found.add((y, x))
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            want.add((month, *min(found), len(found)))
    assert {(r.month, r.cluster_y, r.cluster_x, r.cells) for r in fires.cell_clusters(spark, SF).collect()} == want


def test_gaps_of_all_hours_equal_brute_force(spark):
    hours = [(r.station, r.hour) for r in observations.hourly_agg(spark, SF).collect()]
    seen, step = set(hours), datetime.timedelta(hours=1)
    first, last = min(h for _, h in hours), max(h for _, h in hours)
    spine = [first + i * step for i in range((last - first) // step + 1)]
    gone = {s: [h for h in spine if (s, h) not in seen] for s in {s for s, _ in hours}}
    assert observations.gapfill(spark, SF).count() == len(gone) * len(spine)
    assert {(r.station, r.missing, r.first_missing) for r in observations.reading_gaps(spark, SF).collect()} == {(s, len(g), g[0]) for s, g in gone.items() if g}
    nulls = {(r.station, r.hour) for r in observations.gapfill(spark, SF).where("pm25 is null").collect()}
    runs = set()
    for s in gone:
        own = sorted(h for k, h in nulls if k == s)
        starts = [i for i, h in enumerate(own) if i == 0 or h - own[i - 1] > step] + [len(own)]
        runs |= {(s, own[a], own[b - 1], b - a) for a, b in zip(starts, starts[1:]) if b - a >= 3}
    assert {(r.station, r.begins, r.ends, r.hours) for r in observations.uptime_offline(spark, SF).collect()} == runs


def ratio(a, b):
    return round(difflib.SequenceMatcher(None, a, b).ratio(), 3)


def test_name_similarity_equals_brute_force(spark):
    rows = stations(spark, SF).collect()
    want = {(a.station, b.station, ratio(a.name.lower(), b.name.lower())) for a in rows for b in rows if a.city == b.city and a.station < b.station}
    assert {tuple(r) for r in feeds.name_similarity(spark, SF).collect()} == {x for x in want if x[2] >= 0.9}


def test_alike_names_of_all_lengths_equal_brute_force(spark):
    r, names = random.Random(11), ["", "", "x", "x", "xy", "yx", "aaaaaaaaaa", "aaaaaaaaaaa", None]
    for n in range(2, 42):
        base = [r.choice("abcd ") for _ in range(n)]
        for _ in range(6):
            own = list(base)
            for _ in range(r.randint(0, max(1, n // 7))):
                at = r.randrange(len(own) + 1)
                own[at : at + r.randint(0, 1)] = r.choice(["", "z", "é", "ab"])
            names.append("".join(own))
    df = spark.createDataFrame([(i, "one", t) for i, t in enumerate(names)], "k int, city string, name string")
    want = {(i, j, ratio(a, b)) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and a is not None and b is not None}
    assert {tuple(x) for x in feeds.alike(df, "city", "k", "name").collect()} == {x for x in want if x[2] >= 0.9}


def test_drained_feed_is_read_from_files(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for _ in range(2):
        events.repartition(2).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    stream = stream.selectExpr("event_id", "user_id AS station", "timestamp(ts) AS ts", "value AS pm25").withWatermark("ts", "9000 hours")
    rows, hours = feed.drained(feed.deduplicated(stream), "append"), feed.drained(feed.hourly(stream), "update", ["station", "hour"])
    assert rows.inputFiles() and hours.inputFiles()
    assert sorted(r.event_id for r in rows.collect()) == sorted(r.event_id for r in events.collect())
    assert hours.agg({"n": "sum"}).first()[0] == 2 * events.where("value is not null").count()
    assert feed.drained(feed.hourly(stream.where("false")), "update", ["station", "hour"]).count() == 0
