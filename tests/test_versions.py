import csv
import datetime
import io
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from airstrata.sources import exports, publish, texts, versions
from airstrata.streaming import feed, sessions

SCHEMA = "id long, v double, day string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def held(spark, path, version=None, where=None):
    return sorted(map(tuple, versions.read(spark, path, version, where).collect()), key=str)


def test_versions_replace_partitions_and_stay_readable(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert versions.replace(rows(spark, (1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, None), (4, 4.0, "x/y=z %")), path, "day") == 0
    assert versions.replace(rows(spark, (5, 5.0, "a")), path, "day") == 1
    assert held(spark, path) == [(2, 2.0, "b"), (3, 3.0, None), (4, 4.0, "x/y=z %"), (5, 5.0, "a")]
    assert held(spark, path, 0) == [(1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, None), (4, 4.0, "x/y=z %")]
    assert held(spark, path, None, "b".__eq__) == [(2, 2.0, "b")]
    assert len(versions.read(spark, path, None, "b".__eq__).inputFiles()) == 1
    assert versions.drop(spark, path, lambda p: p == versions._NULL) == 2
    assert versions.rewrite(spark, path, "day", lambda df: df.where("id < 5").withColumn("v", F.col("v") + 1), lambda p: p in "ab") == 3
    assert held(spark, path) == [(2, 3.0, "b"), (4, 4.0, "x/y=z %")]
    assert versions.merge(rows(spark, (6, 6.0, "b"), (7, 7.0, "c")), path, "day", lambda old, new: old.union(new)) == 4
    assert held(spark, path) == [(2, 3.0, "b"), (4, 4.0, "x/y=z %"), (6, 6.0, "b"), (7, 7.0, "c")]
    for n in range(5, 25):
        assert versions.replace(rows(spark, (n, float(n), "z")), path, "day") == n
    assert (24, 24.0, "z") in held(spark, path) and held(spark, path, 4) == held(spark, path, 5, lambda p: p != "z")
    assert [h["version"] for h in versions.history(spark, path)] == list(range(25))
    assert versions.replace(rows(spark, (1, 1.0, "q")), path, "day", whole=True) == 25 and held(spark, path) == [(1, 1.0, "q")]


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(rows(spark, (1, 1.0, "a"), (2, 2.0, "b")), path, "day")
    before = held(spark, path)
    with pytest.raises(Exception, match="(?i)division|raise|error"):
        versions.replace(rows(spark, (9, 9.0, "a"), (8, 8.0, "b")).withColumn("v", F.when(F.col("id") == 8, F.raise_error(F.lit("dies"))).otherwise(F.col("v"))), path, "day")
    versions._written(rows(spark, (9, 9.0, "a")), path, "day")  # files are there, the commit is not
    assert held(spark, path) == before and versions.versions(spark, path) == [0]
    assert versions.vacuum(spark, path) == []  # they may be a running writer's
    assert len(versions.vacuum(spark, path, least_hours=0.0)) >= 1
    assert held(spark, path) == before


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(rows(spark, (1, 1.0, "a"), (2, 2.0, "b")), path, "day")
    a = versions._written(rows(spark, (3, 3.0, "a")), path, "day")
    b = versions._written(rows(spark, (4, 4.0, "b")), path, "day")
    schema = versions._schema(rows(spark, (1, 1.0, "a")))
    assert versions._commit(spark, path, 0, "first", schema, a, [], set()) == 1
    with pytest.raises(versions.Conflict):
        versions._commit(spark, path, 0, "same", schema, a, [], set())
    with pytest.raises(versions.Conflict):
        versions._commit(spark, path, 0, "read it", schema, b, [], {"a"})
    assert versions._commit(spark, path, 0, "other", schema, b, [], set()) == 2
    assert held(spark, path) == [(3, 3.0, "a"), (4, 4.0, "b")]


def test_readers_meet_whole_versions_while_partitions_are_swapped(spark, tmp_path):
    path = str(tmp_path / "t")
    load = lambda n: rows(spark, *[(i, float(n), p) for i, p in enumerate("abc")])
    versions.replace(load(0), path, "day")
    wrong, done = [], threading.Event()

    def look():
        while not done.is_set():
            found = {r.v for r in versions.read(spark, path).collect()}
            if len(found) != 1:
                wrong.append(found)

    reader = threading.Thread(target=look)
    reader.start()
    for n in range(1, 6):
        versions.replace(load(n), path, "day")
    done.set()
    reader.join()
    assert not wrong and {r.v for r in versions.read(spark, path).collect()} == {5.0}


def test_vacuum_and_retain(spark, tmp_path):
    path = str(tmp_path / "t")
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    df = spark.createDataFrame([(i, at(1 + i // 4, 6 * (i % 4))) for i in range(20)], "id long, ts timestamp_ntz").withColumn("day", F.col("ts").cast("date"))
    versions.replace(df, path, "day")
    versions.retain(spark, path, "day", "ts", "2024-01-03 12:00:00")
    assert sorted(r.id for r in versions.read(spark, path).collect()) == list(range(10, 20))
    assert len(versions.vacuum(spark, path, keep=1, least_hours=0.0)) == 3
    assert sorted(r.id for r in versions.read(spark, path).collect()) == list(range(10, 20))
    assert versions.read(spark, path).where("day = date'2024-01-04'").count() == 4


def test_csv_comes_back_as_it_was(spark):
    data = [(1, 'say "hi", ok'), (2, 'x,"'), (3, "a\nb"), (4, "c\rd"), (5, None), (6, ""), (7, '""')]
    pieces = list(exports.streamed_csv(spark.createDataFrame(data, "id int, s string").coalesce(1).sortWithinPartitions("id"), flush=2))
    got = list(csv.reader(io.StringIO("".join(pieces), newline="")))
    assert got == [["id", "s"], *[[str(i), s or ""] for i, s in data]] and len(pieces) == 4


def test_pointers_are_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "latest")
    assert texts.put(spark, path, "1") and texts.put(spark, path, "é 2") and texts.text_at(spark, path) == "é 2"
    assert not texts.put(spark, path, "3", replace=False) and texts.text_at(spark, path) == "é 2"
    assert texts.put(spark, str(tmp_path / "new"), "4", replace=False)
    assert not [n for n in texts.names_in(spark, str(tmp_path)) if n.endswith(".tmp")]
    wrong, done = [], threading.Event()

    def look():
        while not done.is_set():
            try:
                json.loads(open(path).read())
            except Exception as e:  # noqa: BLE001
                wrong.append(e)

    texts.put(spark, path, json.dumps(0))
    reader = threading.Thread(target=look)
    reader.start()
    for n in range(40):
        texts.put(spark, path, json.dumps(n))
    done.set()
    reader.join()
    assert not wrong


def test_a_publish_that_dies_leaves_no_marker(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, date string").withColumn("date", F.to_date("date"))
    publish.publish(df, path)
    with pytest.raises(Exception, match="dies"):
        publish.publish(df.withColumn("v", F.when(F.col("v") == 2, F.raise_error(F.lit("dies"))).otherwise(F.col("v"))), path)
    with pytest.raises(FileNotFoundError):
        publish.published(spark, path)


READ = "station long, ts timestamp, pm25 double"


def feed_of(spark, folder, data, files, shuffled):
    data = list(data)
    if shuffled:
        random.Random(4).shuffle(data)
    step = -(-len(data) // files)
    for n in range(files):
        spark.createDataFrame(data[n * step : (n + 1) * step], READ).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(READ).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_rows_do_not_overwrite_newer_ones(spark, tmp_path):
    at = lambda d: datetime.datetime(2024, 1, d)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(READ).parquet(str(tmp_path / "in"))
    for data in ([(1, at(2), 2.0)], [(1, at(1), 1.0), (2, at(1), None)]):
        spark.createDataFrame(data, READ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed.upserted(stream, str(tmp_path / "store"), ["station"], ["pm25"], str(tmp_path / "check"))
    got = {r.station: (r.pm25, r.pm25_at) for r in feed.current(spark, str(tmp_path / "store")).collect()}
    assert got == {1: (2.0, at(2)), 2: (None, None)}
    assert feed.current(spark, str(tmp_path / "none")) is None


def test_a_shuffled_feed_gives_the_batch_result(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    data = [(i % 7, start + datetime.timedelta(minutes=37 * i), None if i % 11 == 0 else float(i * 7919 % 400)) for i in range(1000)]
    stream = feed_of(spark, tmp_path / "in", data, 10, True)
    feed.upserted(stream, str(tmp_path / "store"), ["station"], ["pm25"], str(tmp_path / "check"))
    want = {}
    for s, t, v in sorted((x for x in data if x[2] is not None), key=lambda x: x[1]):
        want[s] = v
    assert {r.station: r.pm25 for r in feed.current(spark, str(tmp_path / "store")).collect()} == want
    touched = [h["put"] for h in versions.history(spark, str(tmp_path / "store"))]
    assert len(touched) == 10 and max(touched) <= 7


def batch_sessions(data, above, gap):
    out = []
    for s in sorted({x[0] for x in data}):
        run = []
        for _, t, v in sorted(x for x in data if x[0] == s and x[2] is not None and x[2] > above):
            if run and t - run[-1][0] > gap:
                out.append((s, run[0][0], run[-1][0], len(run), max(v for _, v in run)))
                run = []
            run.append((t, v))
        if run:
            out.append((s, run[0][0], run[-1][0], len(run), max(v for _, v in run)))
    return sorted(out)


def test_sessions_join_in_any_order_and_leave_the_state(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    data = [(i % 3, start + datetime.timedelta(hours=2 * i, minutes=i % 50), float(i * 7919 % 400)) for i in range(120)]
    want = batch_sessions(data, 200.0, datetime.timedelta(hours=6))
    shuffled = feed_of(spark, tmp_path / "a", data, 4, True).withWatermark("ts", "60 days")
    got = feed.drained(sessions.open_sessions(shuffled, 200.0), "update", ["station", "begins"]).collect()
    assert sorted(map(tuple, got)) == want
    ordered = feed_of(spark, tmp_path / "b", data, 5, False).withWatermark("ts", "6 hours")
    query = sessions.open_sessions(ordered, 200.0).writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in map(json.loads, (p.json for p in query.recentProgress)) if p["stateOperators"]]
    held_ = [p for p in kept if p]
    assert held_ and max(held_) < 40 and len(want) > 25
