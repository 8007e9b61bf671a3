import datetime
import json

import pytest
from pyspark.sql import functions as F

from airstrata.operators import polygons
from airstrata.sources import exports, files

T = datetime.datetime


def test_fire_csv_of_both_layouts(spark, tmp_path):
    (tmp_path / "new.csv").write_text("latitude,longitude,frp,confidence,acq_date,acq_time,satellite\n31.5,74.3,10.5,high,2024-01-02,930,N20\nbad,74.3,1,h,2024-01-02,930,N20\n31.6,74.4,x,nominal,2024-01-02,2561,N21\n")
    (tmp_path / "old.csv").write_text("longitude,latitude,frp,confidence,acq_date,satellite,more\n74.3,31.5,3,l,2020-01-02,N,1\n999,31.5,3,l,2020-01-02,N,1\n")
    new, old = ([tuple(r) for r in files.fire_csv(spark, str(tmp_path / f)).orderBy("latitude").collect()] for f in ("new.csv", "old.csv"))
    assert new == [(31.5, 74.3, 10.5, "h", datetime.date(2024, 1, 2), T(2024, 1, 2, 9, 30), "N20", "timed"), (31.6, 74.4, 0.0, "n", datetime.date(2024, 1, 2), None, "N21", "timed")]
    assert old == [(31.5, 74.3, 3.0, "l", datetime.date(2020, 1, 2), None, "N", "dated")]


def test_station_days_fall_back_to_parquet(spark, tmp_path):
    spark.createDataFrame([("a", "A", "X", 1.0, 2.0, 30.0, 20), ("b", "B", "X", 1.0, 2.0, 40.0, 5)], "station_id string, station_name string, city_name string, latitude double, longitude double, pm25_mean double, pm25_valid_hours int").write.parquet(str(tmp_path / "p"))
    rows = files.station_days(spark, str(tmp_path / "d.json"), str(tmp_path / "p"), 10).collect()
    assert [(r.station_id, r.name, r.pm25, r.complete) for r in rows] == [("a", "A", 30.0, True)]
    (tmp_path / "d.json").write_text(json.dumps([{"station_id": "c", "name": "C", "city": "Y", "pm25": 5, "valid_hours": 12}]))
    rows = files.station_days(spark, str(tmp_path / "d.json"), str(tmp_path / "p"), 10).collect()
    assert [(r.station_id, r.pm25, r.lat, r.complete) for r in rows] == [("c", 5.0, None, False)]


def test_forecasts_and_manifests(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"station_id": "a", "generated_at": "2024-01-02T03:00:00", "forecasts": [{"horizon_hours": 24, "value": 9.5}, {"horizon": "D+2", "pm25": 8}, {"horizon": "6h"}, {"value": 3}]}))
    assert [(r.horizon, r.value) for r in files.forecasts(spark, str(tmp_path / "f.json")).orderBy("horizon").collect()] == [(24, 9.5), (48, 8.0)]
    (tmp_path / "m.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    assert files.manifest(spark, str(tmp_path / "none"), str(tmp_path / "m.jsonl")).count() == 2
    with pytest.raises(FileNotFoundError):
        files.manifest(spark, str(tmp_path / "none"))
    assert files.latest_of(spark, lambda s: files.manifest(s, str(tmp_path / "none")), lambda s: s.range(3)).count() == 3


def test_geojson_regions_hold_points(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
    shapes = [{"properties": {"name": "one"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"name": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[10, 0], [12, 0], [10, 2], [10, 0]]], [[[20, 20], [21, 20], [21, 21], [20, 20]]]]}}, {"properties": {"name": "no"}, "geometry": {"type": "Point", "coordinates": [1, 1]}}]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))
    regions = files.geojson_regions(spark, str(tmp_path / "g.json"), "district")
    assert regions.count() == 3
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 10.5), (3, 1.9, 11.9), (4, 20.2, 20.9), (5, None, 1.0)], "id int, lat double, lon double")
    got = {r.id: r.district for r in polygons.attributed(points, regions, "id", ["district"]).collect()}
    assert got == {1: "one", 2: "two", 3: None, 4: "two", 5: None}
    near = polygons.near_border(points.withColumn("own", F.lit("one")), regions, ["id"], "own", 200.0).collect()
    assert {(r.id, r.within) for r in near} == {(1, True)} and abs(near[0].km - 111.2) < 0.5


def test_payloads(spark):
    df = spark.createDataFrame([("s", json.dumps([{"a": 1, "b": "x"}, {"a": 2}]))], "k string, j string")
    assert [tuple(r) for r in files.rows_of_json(df, "j", "a: int, b: string").collect()] == [("s", 1, "x"), ("s", 2, None)]
    hours = spark.createDataFrame([("s", {"03 Jan 14:30": 5.0, "03 Jan 14:50": 6.0, "soon": 1.0})], "k string, v map<string,double>")
    assert [tuple(r) for r in files.labelled_hours(hours, "k", "v", 2024).collect()] == [("s", T(2024, 1, 3, 14), 6.0)]
    one = lambda v, name, interval, at: {"value": v, "parameter": {"name": name, "units": "ug/m3"}, "period": {"interval": interval, "datetimeTo": {"utc": at}}}
    page = json.dumps({"meta": {"found": ">3"}, "results": [one(7.5, "pm2.5", "01:00:00", "2024-01-02T04:00:00Z"), one(1, "pm25", "00:15:00", "2024-01-02T04:00:00Z"), one(None, "no2", "01:00:00", "2024-01-02T04:00:00Z"), one(1, "um003", "01:00:00", "2024-01-02T04:00:00Z"), one(1, "pm10", "01:00:00", "2025-01-02T04:00:00Z"), one(1, "pm10", "01:00:00", None)]})
    good, bad = files.measurement_pages(spark.createDataFrame([(page,)], "j string"), "j", "2024-01-03 00:00:00")
    assert [tuple(r) for r in good.collect()] == [(T(2024, 1, 2, 3), "pm25", 7.5, "ug/m3")]
    assert {r.why: r.n for r in bad.collect()} == {"sub_hourly": 1, "no_value": 1, "unknown_parameter": 1, "ts_future": 1, "ts_missing": 1}
    load = json.dumps({"current": {"ts": "2024-01-02T03:00:00", "p2": 9.0, "hu": 40}, "history": [{"ts": "2024-01-02T02:00:00", "p2": 8.0}, {"p2": 1.0}]})
    rows = files.provider_readings(spark.createDataFrame([(load,), ("{}",)], "j string"), "j").orderBy("at", "field").collect()
    assert [(r.at.hour, r.field, r.value, r.part) for r in rows] == [(2, "pm25", 8.0, "history"), (3, "humidity", 40.0, "current"), (3, "pm25", 9.0, "current")]
    assert files.schema_drift(df, {"k": "string", "j": "int", "z": "date"}) == [("j", "int", "string"), ("z", "date", "none")]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n,{i}" if i % 2 else None, "2024-01-0%d" % (i % 2 + 1)) for i in range(10)], "id int, name string, day string").withColumn("date", F.to_date("day"))
    at = lambda name: str(tmp_path / name)
    exports.write_csv(df, at("csv"), 4, ["id"])
    assert [r.id for r in spark.read.option("header", True).csv(at("csv")).orderBy("id").collect()] == ["0", "1", "2", "3"]
    text = "".join(exports.streamed_csv(df.select("id", "name").orderBy("id"), 3, 1))
    assert text == 'id,name\n0,\n1,"n,1"\n2,\n'
    exports.write_typed(df, at("typed"), {"id": "long", "day": "int"})
    assert spark.read.parquet(at("typed")).dtypes == [("id", "bigint"), ("day", "int")]
    exports.publish_days(df, at("days"), {"rule": "all"}, ["name"])
    assert json.loads(open(at("days/_provenance.json")).read()) == {"rule": "all", "rows_by_day": {"2024-01-01": 5, "2024-01-02": 5}}
    assert spark.read.parquet(at("days")).count() == 10 and spark.read.json(at("days/_stations")).count() == 6
    for day in ("a", "b"):
        exports.replace_json(df.where(f"id < {len(day) + (day == 'b')}"), at("json"), "fires", day)
    assert exports.read_latest(spark, at("json")).count() == 2
    for run, n in (("r1", 3), ("r2", 5)):
        exports.write_run(df.where(f"id < {n}"), at("runs"), run)
    assert exports.read_latest(spark, at("runs")).count() == 5
    exports.rewrite_years(df, at("years"), "date", "r1")
    assert [tuple(r)[::2] for r in exports.read_latest(spark, at("years/_manifest")).orderBy("date").collect()] == [(2024, 5), (2024, 5)]
    bodies = spark.createDataFrame([('{"b":1,"a":2}',), ('{"a":2,"b":1}',), ('{"a":3}',)], "j string")
    assert exports.archive(bodies, at("raw"), "j").count() == 2 == exports.archive(bodies, at("raw"), "j").count()
    one = json.loads(exports.feature_collection(df.selectExpr("id", "id + 0.5 AS lat", "id * 2.0 AS lon").orderBy("id"), "lat", "lon", ["id"], "ok", 2))
    assert one["truncated"] and one["features"][1] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.0, 1.5]}, "properties": {"id": 1}}
    exports.write_series_csv(df.select("id", "day").limit(3), at("series"), ["source: test", "unit: none"], ["id"])
    assert [r.value for r in spark.read.text(at("series")).collect()] == ["# source: test", "# unit: none", "id,day", "0,2024-01-01", "1,2024-01-02", "2,2024-01-01"]
