"""Sinks and foreign files: a table goes out in a format into the shared folder and comes back through the scan of that format."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import polygons
from ..session import shared_dir, table
from ..sources import exports, files, publish, texts
from ..sources.tables import readings, sql, stations
from . import fire_days, geometry


def _at(spark, name):
    return f"{shared_dir(spark)}/airstrata/{name}-{uuid.uuid4().hex}"


def csv_files(spark, sf_dir):
    """Stations as CSV with a header, the first 700 by number."""
    path = _at(spark, "csv")
    exports.write_csv(stations(spark, sf_dir).select("station", "name", "city", "active", "lat"), path, 700, ["station"])
    return spark.read.option("header", True).schema("station long, name string, city string, active boolean, lat double").csv(path)


def streamed_text(spark, sf_dir):
    """A text export of a thousand rows at most, in pieces, with quotes, commas and line ends in its fields."""
    path = _at(spark, "streamed") + ".csv"
    rows = stations(spark, sf_dir).select("station", F.concat("name", F.lit(', "'), "provider", F.lit('"\nsecond line')).alias("note"), F.when(F.col("active"), F.col("city")).alias("city")).orderBy("station")
    texts.put(spark, path, "".join(exports.streamed_csv(rows, 1000)))
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("station long, note string, city string").csv(path)


def typed_files(spark, sf_dir):
    """Orders as Parquet of given types; texts that are none of the type are null."""
    path, o = _at(spark, "typed"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(o % 10 == 0, "n/a").otherwise(o.cast("string")).alias("id"), F.when(o % 7 == 0, "?").otherwise(F.col("o_totalprice").cast("string")).alias("value"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    exports.write_typed(rows, path, {"id": "long", "value": "double", "day": "date"})
    return spark.read.parquet(path).groupBy(F.year("day").alias("year")).agg(F.count("id").alias("ids"), F.sum("id").alias("sum_of_ids"), F.count("value").alias("known"), rounded(F.sum("value"), 2).alias("value"), F.count("*").alias("n"))


def _dated(spark, sf_dir):
    return readings(spark, sf_dir).select("station", "ts", "pm25", "source", F.col("ts").cast("date").alias("date"))


def published_days(spark, sf_dir):
    """Days published at first, one of them anew with fewer rows, then those that are missing; what the table has in the end."""
    path, rows = _at(spark, "days"), _dated(spark, sf_dir)
    publish.publish(rows.where("date <= date'2024-01-10'"), path)
    publish.publish(rows.where("date = date'2024-01-04' and station % 2 = 0"), path)
    publish.publish_missing(rows, path, "2024-01-08", "2024-01-20")
    return publish.published(spark, path).groupBy("date").agg(F.count("*").alias("n"), F.max("pm25").alias("peak"))


def provenance(spark, sf_dir):
    """Rows by day as the provenance file tells them, beside the list of stations that goes with it."""
    path = _at(spark, "daily")
    exports.publish_days(_dated(spark, sf_dir), path, {"rule": "all"}, ["station"])
    told = json.loads(texts.text_at(spark, f"{path}/_provenance.json"))["rows_by_day"]  # a row a day
    counts = spark.createDataFrame(sorted(told.items()), "day string, n long")
    listed = spark.read.schema("station long").json(f"{path}/_stations").agg(F.count("*").alias("stations"))
    return counts.join(F.broadcast(listed))


def pointers(spark, sf_dir):
    """What the pointers lead to after two products and two runs: the later of each."""
    path, rows = _at(spark, "pointers"), stations(spark, sf_dir).select("station", "city")
    for day, k in (("2024-01-01", 2), ("2024-01-02", 3)):
        exports.replace_json(rows.where(f"station % {k} = 0"), f"{path}/product", "stations", day)
        exports.write_run(rows.where(f"station % {k + 3} = 0"), f"{path}/runs", f"run-{day}")
    return exports.read_latest(spark, f"{path}/product").select(F.lit("product").alias("kind"), "station", "city").union(exports.read_latest(spark, f"{path}/runs").select(F.lit("run"), "station", "city"))


def year_store(spark, sf_dir):
    """The manifest of a store of detections by year after all years, and one of them again."""
    path, rows = _at(spark, "years"), fire_days.fires(spark, sf_dir).select("id", "day", "frp")
    exports.rewrite_years(rows, path, "day", "first")
    exports.rewrite_years(rows.where("year(day) = 1997 and frp > 20"), path, "day", "second")
    return exports.read_latest(spark, f"{path}/_manifest").groupBy("year").agg(F.count("*").alias("days"), F.sum("n").alias("n"))


def archived(spark, sf_dir):
    """Payloads kept once each by the digest of their canonical form, however often they come."""
    path, rows = _at(spark, "raw"), table(spark, sf_dir, "events").select("props")
    exports.archive(rows, path, "props")
    return exports.archive(rows, path, "props").select("digest").distinct()


def features(spark, sf_dir):
    """Stations as GeoJSON features, one a line, and read back."""
    path = _at(spark, "features")
    exports.feature_lines(stations(spark, sf_dir), "lat", "lon", ["station", "city"]).write.text(path)
    rows = spark.read.schema("geometry struct<coordinates: array<double>>, properties struct<station: long, city: string>").json(path)
    return rows.select("properties.station", "properties.city", F.get("geometry.coordinates", 1).alias("lat"), F.get("geometry.coordinates", 0).alias("lon"))


def series_file(spark, sf_dir):
    """The nation's daily means as one CSV with two comment lines in front, and read back."""
    path = _at(spark, "series")
    days = readings(spark, sf_dir).groupBy(F.col("ts").cast("date").alias("day")).agg(rounded(F.avg("pm25")).alias("pm25"), F.count("*").alias("n"))
    exports.write_series_csv(days, path, ["source: readings", "unit: ug/m3"], ["day"])
    lines = spark.read.text(path)
    cells = F.split("value", ",")
    rows = lines.where("value not like '#%' and value not like 'day,%'").select(F.get(cells, 0).cast("date").alias("day"), F.get(cells, 1).cast("double").alias("pm25"), F.get(cells, 2).cast("long").alias("n"))
    return rows.join(F.broadcast(lines.agg(F.count_if(F.col("value").like("#%")).alias("comments"))))


def station_day_files(spark, sf_dir):
    """Station days from Parquet files under other names of their columns, and from JSON where there is some."""
    path = _at(spark, "station-days")
    rows = readings(spark, sf_dir).where("pm25 is not null").groupBy("station", F.col("ts").cast("date").alias("day")).agg(F.avg("pm25").alias("v"), F.count_distinct(F.hour("ts")).alias("h"))
    named = rows.groupBy("station").agg(F.max("v").alias("v"), F.sum("h").alias("h")).join(stations(spark, sf_dir), "station")
    named.select(F.col("station").cast("string").alias("id"), F.col("name").alias("station_name"), F.col("city").alias("city_name"), F.col("lat").alias("latitude"), F.col("v").alias("pm25_mean")).write.parquet(f"{path}/a/part=1")
    named.where("station % 3 = 0").select(F.col("station").cast("string").alias("station_id"), F.col("v").alias("pm25"), F.col("h").alias("pm25_valid_hours")).write.parquet(f"{path}/a/part=2")
    texts.put(spark, f"{path}/b.json", '[{"station_id": "x1", "pm25": 12.5, "valid_hours": 20}, {"pm25": 3.0}, {"station_id": "x2", "pm25": "?", "valid_hours": 3}]')
    parquet = files.station_days(spark, f"{path}/none.json", f"{path}/a")
    return parquet.union(files.station_days(spark, f"{path}/b.json", f"{path}/a", least_hours=4)).select("station_id", "city", rounded("pm25").alias("pm25"), F.col("valid_hours").cast("long").alias("hours"), "complete")


def fire_csv_files(spark, sf_dir):
    """Detections from CSV of two layouts, with and without pass times, some places unreadable."""
    path = _at(spark, "fires")
    rows = fire_days.fires(spark, sf_dir)
    place = F.when(F.col("id") % 23 == 0, "n/a").otherwise(F.col("lat").cast("string"))
    clock = F.concat(F.floor(F.col("minute") / 60).cast("string"), F.lpad((F.col("minute") % 60).cast("string"), 2, "0"))
    first = rows.select(place.alias("latitude"), F.col("lon").alias("longitude"), "frp", F.when(F.col("confidence") == "h", "High").otherwise(F.upper("confidence")).alias("confidence"), F.col("day").alias("acq_date"), clock.alias("acq_time"), "satellite")
    second = rows.select(F.col("lat"), F.col("lon"), F.when(F.col("id") % 5 == 0, "bad").otherwise(F.col("frp").cast("string")).alias("frp"), "confidence", F.col("day").alias("acq_date"))
    out = None
    for name, df in (("a", first), ("b", second)):
        df.write.option("header", True).csv(f"{path}/{name}")
        own = files.fire_csv(spark, f"{path}/{name}")
        out = own if out is None else out.union(own)
    return out.groupBy("layout", "confidence", F.year("day").alias("year")).agg(F.count("*").alias("n"), F.count("at").alias("timed"), rounded(F.sum("frp"), 2).alias("frp"), F.max("at").alias("last"), rounded(F.avg("latitude")).alias("lat"))


def forecast_files(spark, sf_dir):
    """A forecast product as JSON lists, a file for each source, and read back as rows."""
    path, rows = _at(spark, "forecasts"), readings(spark, sf_dir)
    entry = F.struct(F.concat(F.hour("ts").cast("string"), F.when(F.hour("ts") < 4, "d").otherwise("h")).alias("horizon"), F.when(F.hour("ts") % 5 == 0, F.hour("ts")).alias("horizon_hours"), F.when(F.hour("ts") % 3 != 0, F.col("pm25")).alias("value"), F.when(F.hour("ts") % 2 == 0, F.col("pm25")).alias("pm25"))
    own = rows.groupBy("source", "station").agg(F.collect_list(entry).alias("forecasts"))  # a station's readings
    lists = own.groupBy("source").agg(F.to_json(F.collect_list(F.struct(F.col("station").cast("string").alias("station_id"), F.lit("2024-01-31T00:00:00").alias("generated_at"), "forecasts"))).alias("value"))
    lists.write.partitionBy("source").text(path)
    return files.forecasts(spark, path).groupBy("horizon").agg(F.count("*").alias("n"), F.count_distinct("station_id").alias("stations"), rounded(F.sum("value"), 2).alias("value"), F.max("made").alias("made"))


def manifest_files(spark, sf_dir):
    """A manifest from the first of its forms that is there: lines of JSON before Parquet."""
    path, rows = _at(spark, "manifest"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows.where("n_nationkey < 10").write.json(f"{path}/a.jsonl")
    rows.write.parquet(f"{path}/b")
    pick = lambda *names: files.manifest(spark, *[f"{path}/{n}" for n in names]).select("n_nationkey", "n_name")
    return pick("none", "a.jsonl", "b").withColumn("form", F.lit("lines")).union(pick("none", "b", "a.jsonl").withColumn("form", F.lit("parquet")))


def geojson_counts(spark, sf_dir):
    """Stations in regions that went out as GeoJSON, holes and all, and came back."""
    path = _at(spark, "regions")
    ring = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["lon"], p["lat"]))
    shape = F.struct(F.lit("Polygon").alias("type"), F.concat(F.array(ring(F.col("ring"))), F.coalesce(F.transform("holes", ring), F.array().cast("array<array<array<double>>>"))).alias("coordinates"))
    one = geometry._holed(spark, sf_dir).where("kind = 'province'").agg(F.collect_list(F.struct(F.create_map(F.lit("name"), F.col("name")).alias("properties"), shape.alias("geometry"))).alias("features"))  # a row a region
    one.select(F.to_json(F.struct("features")).alias("value")).write.text(path)
    found = polygons.containing(stations(spark, sf_dir), files.geojson_regions(spark, path, "province"), ["station"])
    return found.groupBy("name").agg(F.count("*").alias("stations"), F.sum("station").alias("sum_of_ids"))


def payload_rows(spark, sf_dir):
    """Providers' payloads, one a station, as rows: what is current, the history, values under their codes."""
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("pm25").alias("p2"), F.when(F.hour("ts") % 2 == 0, F.col("pm25") * 2).alias("p1"))
    rows = readings(spark, sf_dir).where("pm25 is not null").groupBy("station").agg(F.max_by(entry, "ts").alias("current"), F.collect_list(entry).alias("history"))  # a station's readings
    payloads = rows.select(F.to_json(F.struct("current", "history")).alias("body"))
    return files.provider_readings(payloads, "body").groupBy("field", "part").agg(F.count("*").alias("n"), rounded(F.sum("value"), 2).alias("value"), F.max("at").alias("last"))


def label_maps(spark, sf_dir):
    """Maps from labels of hours to values, one a station, as rows; some labels are no time."""
    label = F.when(F.minute("ts") == 7, "soon").otherwise(F.date_format("ts", "dd MMM HH:mm"))
    rows = readings(spark, sf_dir).where("pm25 is not null").groupBy("station", label.alias("label")).agg(F.max("pm25").alias("v"))
    maps = rows.groupBy("station").agg(F.map_from_entries(F.collect_list(F.struct("label", "v"))).alias("values"))  # a station's readings
    return files.labelled_hours(maps, "station", "values", 2024)


def page_rows(spark, sf_dir):
    """Pages of measurements, one a day: what is let in by hour and parameter, and what is refused by reason."""
    e, hour = F.col("event_id"), F.date_trunc("hour", "ts")
    at = F.when(e % 31 == 0, "soon").when(e % 37 == 0, "2031-01-01T00:00:00Z").otherwise(F.date_format(hour, "yyyy-MM-dd'T'HH:00:00'Z'"))
    one = F.struct(F.when(e % 41 != 0, F.col("value")).alias("value"), F.struct(F.when(e % 3 == 0, "PM2.5").when(e % 43 == 0, "radon").otherwise("pm10").alias("name"), F.lit("ug/m3").alias("units")).alias("parameter"), F.struct(F.when(e % 29 == 0, "00:15:00").otherwise("01:00:00").alias("interval"), F.struct(at.alias("utc")).alias("datetimeTo")).alias("period"))
    pages = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.to_json(F.struct(F.collect_list(one).alias("results"))).alias("body"))  # a page a day
    good, bad = files.measurement_pages(pages, "body", "2024-02-01 00:00:00")
    return good.groupBy(F.lit("let in").alias("what"), "field").agg(F.count("*").alias("n"), F.max("hour").alias("last")).union(bad.select(F.lit("refused"), "why", "n", F.lit(None).cast("timestamp_ntz")))


QUERIES = {
    f.__name__: f
    for f in (
        csv_files, streamed_text, typed_files, published_days, provenance, pointers, year_store, archived, features, series_file, station_day_files, fire_csv_files, forecast_files, manifest_files, geojson_counts, payload_rows, label_maps, page_rows,
    )
}

ORACLE = {
    "csv_files": sql("SELECT station, name, city, active, lat FROM s ORDER BY station LIMIT 700"),
    "streamed_text": sql("""SELECT station, name || ', "' || provider || '"' || chr(10) || 'second line' AS note, CASE WHEN active THEN city END AS city FROM s ORDER BY station LIMIT 1000"""),
    "typed_files": """SELECT year(o_orderdate) AS year, count(*) FILTER (o_orderkey % 10 <> 0) AS ids, sum(o_orderkey) FILTER (o_orderkey % 10 <> 0)::BIGINT AS sum_of_ids, count(*) FILTER (o_orderkey % 7 <> 0) AS known,
        round(sum(o_totalprice) FILTER (o_orderkey % 7 <> 0) + 1e-9, 2) AS value, count(*) AS n FROM orders GROUP BY 1""",
    "published_days": sql("SELECT ts::DATE AS date, count(*) AS n, max(pm25) AS peak FROM r WHERE ts < TIMESTAMP '2024-01-21' AND (ts::DATE <> DATE '2024-01-04' OR station % 2 = 0) GROUP BY 1"),
    "provenance": sql("SELECT ts::DATE::VARCHAR AS day, count(*) AS n, (SELECT count(DISTINCT station) FROM r) AS stations FROM r GROUP BY 1"),
    "pointers": sql("SELECT 'product' AS kind, station, city FROM s WHERE station % 3 = 0 UNION ALL SELECT 'run', station, city FROM s WHERE station % 6 = 0"),
    "year_store": sql(f"{fire_days._F} SELECT year(day)::INT AS year, count(DISTINCT day) AS days, count(*)::BIGINT AS n FROM f0 WHERE year(day) <> 1997 OR frp > 20 GROUP BY 1"),
    "archived": """SELECT DISTINCT sha256('{"k":"' || json_extract_string(props, '$.k') || '"}') AS digest FROM events""",
    "features": sql("SELECT station, city, lat, lon FROM s"),
    "series_file": sql("SELECT ts::DATE AS day, round(avg(pm25), 4) AS pm25, count(*) AS n, 2::BIGINT AS comments FROM r GROUP BY 1"),
    "station_day_files": sql("""a AS (SELECT station, max(v) AS v, sum(h)::BIGINT AS h FROM (SELECT station, avg(pm25) AS v, count(DISTINCT hour(ts)) AS h FROM r WHERE pm25 IS NOT NULL GROUP BY station, ts::DATE) GROUP BY station),
        b AS (SELECT s.station, city, v, h FROM a JOIN s USING (station))
        SELECT station::VARCHAR AS station_id, city, round(v, 4) AS pm25, NULL::BIGINT AS hours, false AS complete FROM b UNION ALL SELECT station::VARCHAR, NULL, round(v, 4), h, h >= 18 FROM b WHERE station % 3 = 0 UNION ALL SELECT 'x1', NULL, 12.5, 20, true"""),
    "fire_csv_files": sql(f"""{fire_days._F}, u AS (SELECT 'timed' AS layout, confidence, day, frp, minute, lat FROM f0 WHERE id % 23 <> 0 UNION ALL SELECT 'dated', confidence, day, CASE WHEN id % 5 = 0 THEN 0 ELSE frp END, NULL, lat FROM f0)
        SELECT layout, confidence, year(day)::INT AS year, count(*) AS n, count(minute) AS timed, round(sum(frp) + 1e-9, 2) AS frp, max(day::TIMESTAMP + to_minutes(minute)) AS last, round(avg(lat), 4) AS lat FROM u GROUP BY ALL"""),
    "forecast_files": sql("""e AS (SELECT station, hour(ts) AS h, CASE WHEN hour(ts) % 3 <> 0 OR hour(ts) % 2 = 0 THEN pm25 END AS value FROM r)
        SELECT (CASE WHEN h % 5 <> 0 AND h < 4 THEN h * 24 ELSE h END)::INT AS horizon, count(*) AS n, count(DISTINCT station) AS stations, round(sum(value) + 1e-9, 2) AS value, TIMESTAMP '2024-01-31' AS made FROM e WHERE value IS NOT NULL GROUP BY 1"""),
    "manifest_files": "SELECT n_nationkey, n_name, 'lines' AS form FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, n_name, 'parquet' FROM nation",
    "geojson_counts": sql(f"{geometry._H}, i AS (SELECT station, he.name FROM s, he WHERE kind = 'province' AND {geometry._ODD} GROUP BY ALL HAVING count(*) % 2 = 1) SELECT name, count(*) AS stations, sum(station)::BIGINT AS sum_of_ids FROM i GROUP BY name"),
    "payload_rows": sql("""g AS (SELECT station, date_trunc('second', ts)::TIMESTAMP AS at_, hour(ts) AS h, pm25, ts = max(ts) OVER (PARTITION BY station) AS cur FROM r WHERE pm25 IS NOT NULL),
        p AS (SELECT 'pm25' AS field, 'history' AS part, at_, pm25 AS v FROM g UNION ALL SELECT 'pm10', 'history', at_, pm25 * 2 FROM g WHERE h % 2 = 0 UNION ALL SELECT 'pm25', 'current', at_, pm25 FROM g WHERE cur UNION ALL SELECT 'pm10', 'current', at_, pm25 * 2 FROM g WHERE cur AND h % 2 = 0)
        SELECT field, part, count(*) AS n, round(sum(v) + 1e-9, 2) AS value, max(at_) AS last FROM p GROUP BY ALL"""),
    "label_maps": sql("""m AS (SELECT station, date_trunc('minute', ts)::TIMESTAMP AS at_, max(pm25) AS v FROM r WHERE pm25 IS NOT NULL AND minute(ts) <> 7 GROUP BY ALL) SELECT station, date_trunc('hour', at_)::TIMESTAMP AS hour, arg_max(v, at_) AS value FROM m GROUP BY ALL"""),
    "page_rows": sql("""m AS (SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS h, CASE WHEN event_id % 31 = 0 THEN 'ts_missing' WHEN event_id % 37 = 0 THEN 'ts_future' WHEN event_id % 29 = 0 THEN 'sub_hourly' WHEN event_id % 41 = 0 THEN 'no_value' WHEN event_id % 43 = 0 AND event_id % 3 <> 0 THEN 'unknown_parameter' END AS why,
          CASE WHEN event_id % 3 = 0 THEN 'pm25' ELSE 'pm10' END AS field FROM events), g AS (SELECT DISTINCT h - INTERVAL 1 HOUR AS hour, field FROM m WHERE why IS NULL)
        SELECT 'let in' AS what, field, count(*) AS n, max(hour)::TIMESTAMP AS last FROM g GROUP BY field UNION ALL SELECT 'refused', why, count(*), NULL FROM m WHERE why IS NOT NULL GROUP BY why"""),
}
