"""Products that select: filters built from options, areas, windows of calendar days, lookups with fallbacks, listings, briefs."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import category, haversine_km, index_of, local_day, rounded
from ..operators import places, selecting, series
from ..session import shared_dir, table
from ..sources import versions
from ..sources.tables import AS_OF, SIGNAL, readings, signal, sql, stations
from .observations import _CATEGORY, _index_sql, _points

_NOW = f"timestamp_ntz'{AS_OF}'"


def filtered_stations(spark, sf_dir, **options):
    """The station list under options: country, cities, ids, providers, a box, a pattern, with a shadow provider left out unless asked for."""
    options = options or {"country": "asia", "providers": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "box": (24.5, 62.0, 36.0, 76.0), "pattern": "customer#0000%"}
    rows = selecting.stations_where(stations(spark, sf_dir), shadow="HOUSEHOLD", **options)
    return rows.select("station", F.coalesce("city", F.lit("Unknown city")).alias("city"), "provider")


def area_members(spark, sf_dir):
    """How many stations each kind of area has: the country, a region, a city, all within 100 km of a place."""
    rows = stations(spark, sf_dir)
    kinds = [("national", None), ("country", "EUROPE"), ("city", "FRANCE"), ("radius", (30.0, 70.0, 100.0))]
    parts = [selecting.area(rows, kind, what).agg(F.count("*").alias("stations"), F.min("station").alias("first")).withColumn("kind", F.lit(kind)) for kind, what in kinds]
    return reduce(lambda a, b: a.unionByName(b), parts)


def calendar_windows(spark, sf_dir):
    """Orders of the same ten days of every year, as a disjunction of half-open windows, which a scan can prune by."""
    day = F.col("o_orderdate")
    windows = [(day >= F.expr(f"timestamp_ntz'{y}-03-05 00:00:00'")) & (day < F.expr(f"timestamp_ntz'{y}-03-15 00:00:00'")) for y in range(1992, 2002)]
    rows = table(spark, sf_dir, "orders").where(reduce(or_, windows))
    return rows.groupBy(F.year(day).alias("year")).agg(F.count("*").alias("n"), rounded(F.avg("o_totalprice"), 2).alias("mean"))


def three_valued_gate(spark, sf_dir):
    """Readings that a gate lets pass: states that are not refused, and unknown ones too; and those of a JSON path's value."""
    rows = readings(spark, sf_dir).withColumn("qc", F.when(F.col("station") % 4 != 0, F.col("qc")))
    passes = F.col("qc").isNull() | ~F.col("qc").isin("INVALID", "SUSPECT")
    even = F.get_json_object("props", "$.k").try_cast("int") % 2 == 0
    return rows.where(passes).groupBy("qc", even.alias("even_k")).agg(F.count("*").alias("n"))


def star_paths(spark, sf_dir):
    """Stations with what city and region they have by way of the city, where some have none: left joins of dimensions."""
    key = F.when(F.col("c_custkey") % 6 != 0, F.col("c_nationkey"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", key.alias("n_nationkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), "n_nationkey", "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.groupBy(F.coalesce("r_name", F.lit("Unknown region")).alias("region")).agg(F.count("*").alias("stations"), F.count_distinct("n_name").alias("cities"), F.count_distinct(F.when(F.col("c_custkey") % 2 == 0, F.col("n_name"))).alias("even_cities"))


def lagged_spine(spark, sf_dir):
    """Correlation of two daily series with the second 0 to 2 days later, on a spine of days: a missing day shifts nothing."""
    days = signal(spark, sf_dir).where("h % 24 < 12 and floor(h / 24) % 7 <> 3").groupBy(F.col("hour").cast("date").alias("day")).agg(F.avg("pm25").alias("x"))
    pm = readings(spark, sf_dir).groupBy(F.col("ts").cast("date").alias("day")).agg(F.avg("pm25").alias("y"))
    later = [pm.select(F.date_sub("day", k).alias("day"), F.col("y").alias(f"y{k}")) for k in range(3)]
    rows = reduce(lambda a, b: a.join(b, "day", "left"), later, days)
    return rows.agg(*[rounded(F.corr("x", f"y{k}")).alias(f"lag{k}") for k in range(3)], F.count("*").alias("days"))


def devices_at_sites(spark, sf_dir):
    """Sites with the nearest station within half a kilometre, or none."""
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), (24 + (F.col("s_suppkey") * 37 % 1300) / 100.0 + 0.002).alias("lat"), (61 + (F.col("s_suppkey") * 53 % 1600) / 100.0).alias("lon"))
    near = places.nearest(sites, stations(spark, sf_dir).select("station", F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "site", "station", 0.5, 1)
    return sites.select("site").join(near.select("site", "station", rounded("km").alias("km")), "site", "left")


def manifest_union(spark, sf_dir):
    """Two listings by key: what both know (the newer wins field by field), what one alone does, and since when."""
    rows = stations(spark, sf_dir)
    old = rows.where("station % 4 <> 0").select("station", F.col("name").alias("old_name"), F.lit("2024-01-01").alias("old_seen"))
    new = rows.where("station % 3 <> 0").select("station", F.when(F.col("station") % 5 != 0, F.upper("name")).alias("new_name"), F.lit("2024-01-31").alias("new_seen"))
    both = old.join(new, "station", "full_outer")
    return both.select("station", F.coalesce("new_name", "old_name").alias("name"), F.coalesce("old_seen", "new_seen").alias("first_seen"), F.coalesce("new_seen", "old_seen").alias("last_seen"), F.when(F.col("old_seen").isNull(), "new").when(F.col("new_seen").isNull(), "gone").otherwise("both").alias("state"))


def labels_by_code(spark, sf_dir):
    """Codes with their labels from a fixed map, the unknown ones as they are."""
    labels = F.create_map(*[F.lit(x) for pair in (("view", "seen"), ("click", "chosen"), ("purchase", "bought")) for x in pair])
    return readings(spark, sf_dir).groupBy(F.coalesce(F.element_at(labels, F.col("source")), F.concat(F.lit("other: "), F.col("source"))).alias("label")).agg(F.count("*").alias("n"))


def city_hours(spark, sf_dir):
    """The hourly aggregate of cities that longer periods are read from: mean, samples and stations; and days of it weighted by stations."""
    rows = readings(spark, sf_dir).where("qc <> 'INVALID'").join(stations(spark, sf_dir), "station")
    hours = rows.groupBy("city", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.avg("pm25").alias("pm25"), F.count("*").alias("samples"), F.count_distinct("station").alias("stations"))
    days = hours.groupBy("city", local_day(F.col("hour")).alias("day"))
    return days.agg(rounded(F.sum(F.col("pm25") * F.col("stations")) / F.sum("stations")).alias("pm25"), F.sum("samples").alias("samples"), F.max("stations").alias("most_stations"), F.count("*").alias("hours"))


def median_places(spark, sf_dir):
    """Cities at the median of their stations' coordinates, and how many stations are beyond 600 km of it."""
    rows = stations(spark, sf_dir)
    middle = rows.groupBy("city").agg(F.median("lat").alias("mlat"), F.median("lon").alias("mlon"))
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon")) > 600
    return rows.join(middle, "city").groupBy("city").agg(rounded(F.max("mlat")).alias("lat"), rounded(F.max("mlon")).alias("lon"), F.count_if(far).alias("far"), F.count("*").alias("stations"))


def sums_over_days(spark, sf_dir):
    """Sums of a stored aggregate over a set of days, by group."""
    store = signal(spark, sf_dir).groupBy("group", F.col("hour").cast("date").alias("day")).agg(F.sum("pm25").alias("total"), F.count("pm25").alias("n"))
    days = readings(spark, sf_dir).where("pm25 > 98").select(F.col("ts").cast("date").alias("day")).distinct()
    return store.join(days, "day", "left_semi").groupBy("group").agg(rounded(F.sum("total"), 2).alias("total"), F.sum("n").alias("n"), F.count("*").alias("days"))


def latest_two(spark, sf_dir):
    """The two latest readings of each station by time, then id, and the last known value of its series."""
    w = Window.partitionBy("station").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    last = rows.groupBy("station").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("ts", "event_id"))).alias("last_known"))
    return rows.withColumn("n", F.row_number().over(w)).where("n <= 2").join(last, "station").select("station", F.col("n").cast("long").alias("n"), "event_id", "v", "last_known")


def ranked_cities(spark, sf_dir):
    """Cities by their latest values, ranked from six stations on, with the rank as text."""
    now = series.latest_by(readings(spark, sf_dir), ["station"], "ts", "pm25").join(stations(spark, sf_dir), "station").groupBy("city").agg(rounded(F.avg("pm25")).alias("pm25"), F.count("*").alias("stations")).where("stations >= 6")
    top = now.orderBy(F.desc("pm25"), "city").limit(5)
    n = F.row_number().over(Window.orderBy(F.desc("pm25"), "city"))
    end = F.when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return top.select("city", "pm25", "stations", F.concat(n.cast("string"), end).alias("rank"))


def recursive_hours(spark, sf_dir):
    """An hour spine from a recursive query, with the readings of each."""
    rows = readings(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    first, last = rows.agg(F.min("hour"), F.max("hour")).first()
    hours = int((last - first).total_seconds() // 3600) if first else -1
    # Each step of the recursion doubles the hours, so that its depth is the logarithm of their number.
    spine = spark.sql(
        """WITH RECURSIVE t(n, k) AS (SELECT 0L, 0 UNION ALL SELECT n + b * shiftleft(1L, k), k + 1 FROM t, (VALUES (0), (1)) v(b) WHERE k < :levels)
           SELECT timestampadd(HOUR, CAST(n AS INT), :first) AS hour FROM t WHERE k = :levels AND n <= :hours""",
        args={"levels": max(hours, 1).bit_length(), "first": first, "hours": hours},
    ).select(F.col("hour").cast("timestamp_ntz").alias("hour"))
    return spine.join(rows, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def station_detail(spark, sf_dir):
    """Stations with their latest reading, its category, and forecasts at four horizons as one row."""
    now = series.latest_by(readings(spark, sf_dir), ["station"], "ts", "pm25")
    horizons = [24, 48, 72, 96]
    said = readings(spark, sf_dir).select("station", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"), (F.col("pm25") + F.hour("ts")).alias("v")).groupBy("station").pivot("horizon", horizons).agg(rounded(F.avg(F.col("v") + F.col("horizon") / 24)))
    rows = now.join(said, "station", "left").join(stations(spark, sf_dir).select("station", "name", "city"), "station")
    return rows.select("station", "name", "city", "ts", "pm25", category(index_of(F.col("pm25"), _points())).alias("category"), *[F.col(str(h)).alias(f"h{h}") for h in horizons])


def incidents(spark, sf_dir):
    """The worst stations of each country in a day, those above 75, or the three worst where none is; thirty at most."""
    now = series.latest_by(readings(spark, sf_dir).where(f"ts > {_NOW} - interval 24 hours"), ["station"], "ts", "pm25").join(stations(spark, sf_dir), "station")
    w = Window.partitionBy("country")
    rows = now.withColumn("any", F.max("pm25").over(w) > 75).withColumn("n", F.row_number().over(w.orderBy(F.desc("pm25"), "station")))
    return rows.where("(any and pm25 > 75 and n <= 30) or (not any and n <= 3)").select("country", "station", "pm25", F.col("n").cast("long").alias("n"))


def directory_lists(spark, sf_dir):
    """Distinct countries, cities and providers with their counts, as one list."""
    rows = stations(spark, sf_dir)
    return reduce(lambda a, b: a.unionByName(b), [rows.groupBy(F.lower(c).alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(c)) for c in ("country", "city", "provider")])


def fetch_health(spark, sf_dir):
    """The last 24 hours with a fetch of every source: how many, how many empty, the latest, and a status."""
    runs = readings(spark, sf_dir).groupBy("source", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("run")).agg(F.count("*").alias("n"), F.count_if(F.col("qc") == "INVALID").alias("bad"))
    few = series.top_k(runs, ["source"], 24, F.desc("run"))
    out = few.groupBy("source").agg(F.count("*").alias("runs"), F.count_if(F.col("n") < 3).alias("thin"), F.max("run").alias("latest"), F.sum("n").alias("rows"))
    return out.withColumn("status", F.when(F.col("thin") * 2 > F.col("runs"), "failing").when(F.col("thin") > 0, "degraded").otherwise("healthy"))


def desk_overview(spark, sf_dir):
    """Forecasts above a level by country and horizon, with a share and the worst city of each."""
    rows = readings(spark, sf_dir).join(stations(spark, sf_dir), "station").select("country", "city", (F.dayofmonth("ts") % 3).alias("horizon"), (F.col("pm25") + F.dayofmonth("ts")).alias("v"))
    cities = rows.groupBy("country", "horizon", "city").agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.count_if(F.col("v") > 75).alias("above"))
    return cities.groupBy("country", "horizon").agg(F.sum("n").alias("n"), rounded(F.sum("above") / F.sum("n")).alias("share"), F.max_by("city", F.struct("m", "city")).alias("worst"))


def daily_brief(spark, sf_dir):
    """The brief of a day: stations by band, the five worst cities as text, and the bias of yesterday's value as a forecast."""
    days = readings(spark, sf_dir).where("ts >= timestamp_ntz'2024-01-19 00:00:00' and ts < timestamp_ntz'2024-01-21 00:00:00'").join(stations(spark, sf_dir), "station").groupBy("city", "station", F.col("ts").cast("date").alias("day")).agg(F.avg("pm25").alias("v"))
    today, before = (days.where(f"day = date'2024-01-{d}'") for d in (20, 19))
    worst = today.groupBy("city").agg(F.avg("v").alias("m")).orderBy(F.desc("m"), "city").limit(5)
    text = worst.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("m", "city")), False), lambda x: x["city"]), ", ").alias("worst"))
    bands = today.agg(F.count("*").alias("stations"), F.count_if(F.col("v") <= 35.4).alias("fair"), F.count_if(F.col("v") > 55.4).alias("unhealthy"))
    bias = today.join(before.select("station", F.col("v").alias("w")), "station").agg(rounded(F.avg(F.col("w") - F.col("v"))).alias("bias"), F.count("*").alias("matched"))
    return bands.crossJoin(F.broadcast(text)).crossJoin(F.broadcast(bias))  # one row each


def resolved_places(spark, sf_dir):
    """Places asked for by name, resolved as a city, else a station, else a country, else nothing."""
    rows = stations(spark, sf_dir)
    asked = rows.select(F.col("station").alias("ask"), F.when(F.col("station") % 4 == 0, F.lower("city")).when(F.col("station") % 4 == 1, F.upper("name")).when(F.col("station") % 4 == 2, F.upper("country")).otherwise(F.lit("nowhere")).alias("name"))
    return selecting.resolved(asked, "name", [("city", rows, "city"), ("station", rows, "name"), ("country", rows, "country")]).select("ask", "name", "kind", rounded("lat").alias("lat"), rounded("lon").alias("lon"))


def nearest_source(spark, sf_dir):
    """Points asked for, with the nearest source, or a reason: beyond 30 km, or none at all."""
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point"), (23 + (F.col("s_suppkey") * 71 % 1500) / 100.0).alias("lat"), (60 + (F.col("s_suppkey") * 29 % 1800) / 100.0).alias("lon"))
    near = places.nearest(points, stations(spark, sf_dir).select("station", F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "point", "station", 200.0, 1)
    rows = points.select("point").join(near, "point", "left")
    return rows.select("point", F.when(F.col("km") <= 30, F.col("station")).alias("station"), rounded("km", 3).alias("km"), F.when(F.col("km").isNull(), "none").when(F.col("km") > 30, "too_far").otherwise("found").alias("status"))


def guarded_backfill(spark, sf_dir):
    """A backfill that fills units day by day only where they are missing and the source attests them: days that need it
    are rewritten in a versioned table, the others' files stay; and what it changed, from the versions before and after."""
    path = f"{shared_dir(spark)}/airstrata/backfill-{uuid.uuid4().hex}"
    rows = readings(spark, sf_dir).withColumn("units", F.when(F.col("station") % 3 == 0, "ug/m3")).withColumn("day", F.col("ts").cast("date"))
    first = versions.replace(rows, path, "day", "load")
    wanted = F.col("units").isNull() & F.col("pm25").isNotNull() & (F.col("source") == "view")
    days = {str(r.day) for r in versions.read(spark, path, first).where(wanted).select("day").distinct().collect()}  # a row a day
    last = versions.rewrite(spark, path, "day", lambda old: old.withColumn("units", F.when(wanted, "ug/m3").otherwise(F.col("units"))), days.__contains__, "backfill")
    count = lambda v: versions.read(spark, path, v).groupBy("day").agg(F.count("*").alias("n"), F.count("units").alias("attested"))
    return count(last).join(count(first).select("day", F.col("attested").alias("before")), "day").select("day", "n", (F.col("attested") - F.col("before")).alias("changed"), "attested")


def push_times(spark, sf_dir):
    """Push readings with their own time where the event's id tells one within five seconds of arrival, else that of arrival."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 13 - 6) * 1_000_000).alias("micros"))
    own = F.timestamp_micros("micros").cast("timestamp_ntz")
    near = F.abs(F.col("micros") - F.unix_micros(F.col("ts").cast("timestamp"))) <= 5_000_000
    return e.select("event_id", F.when(near, own).otherwise(F.col("ts")).alias("at"), near.alias("own"))


QUERIES = {
    f.__name__: f
    for f in (
        filtered_stations, area_members, calendar_windows, three_valued_gate, star_paths, lagged_spine, devices_at_sites, manifest_union, labels_by_code, city_hours, median_places, sums_over_days, latest_two, ranked_cities, recursive_hours,
        station_detail, incidents, directory_lists, fetch_health, desk_overview, daily_brief, resolved_places, nearest_source, guarded_backfill, push_times,
    )
}

_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))))"
_S = SIGNAL.strip()
_LATEST = "n AS (SELECT DISTINCT ON (station) station, ts, pm25 FROM r ORDER BY station, ts DESC)"
ORACLE = {
    "filtered_stations": sql("SELECT station, city, provider FROM s WHERE lower(country) = 'asia' AND provider IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND lat BETWEEN 24.5 AND 36 AND lon BETWEEN 62 AND 76 AND name ILIKE 'customer#0000%'"),
    "area_members": sql(f"""SELECT 'national' AS kind, count(*) AS stations, min(station) AS first FROM s UNION ALL SELECT 'country', count(*), min(station) FROM s WHERE country = 'EUROPE' UNION ALL SELECT 'city', count(*), min(station) FROM s WHERE city = 'FRANCE'
        UNION ALL SELECT 'radius', count(*), min(station) FROM (SELECT station, {_KM} AS km FROM (SELECT *, 30.0::DOUBLE AS lat2, 70.0::DOUBLE AS lon2 FROM s)) WHERE km <= 100"""),
    "calendar_windows": sql("SELECT year(day)::INT AS year, count(*) AS n, round(avg(value) + 1e-9, 2) AS mean FROM o WHERE strftime(day, '%m-%d') BETWEEN '03-05' AND '03-14' GROUP BY ALL"),
    "three_valued_gate": sql("g AS (SELECT CASE WHEN station % 4 <> 0 THEN qc END AS qc, (props->>'$.k')::INT % 2 = 0 AS even_k FROM r) SELECT qc, even_k, count(*) AS n FROM g WHERE qc IS NULL OR qc NOT IN ('INVALID', 'SUSPECT') GROUP BY ALL"),
    "star_paths": sql("c AS (SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN c_nationkey END AS k FROM customer) SELECT coalesce(r_name, 'Unknown region') AS region, count(*) AS stations, count(DISTINCT n_name) AS cities, count(DISTINCT n_name) FILTER (c_custkey % 2 = 0) AS even_cities FROM c LEFT JOIN nation ON n_nationkey = k LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY ALL"),
    "lagged_spine": sql(f"""{_S}, d AS (SELECT hour::DATE AS day, avg(pm25) AS x FROM q WHERE h % 24 < 12 AND (h // 24) % 7 <> 3 GROUP BY ALL), p AS (SELECT ts::DATE AS day, avg(pm25) AS y FROM r GROUP BY ALL)
        SELECT round(corr(x, a.y), 4) AS lag0, round(corr(x, b.y), 4) AS lag1, round(corr(x, c.y), 4) AS lag2, count(*) AS days FROM d LEFT JOIN p a ON a.day = d.day LEFT JOIN p b ON b.day = d.day + 1 LEFT JOIN p c ON c.day = d.day + 2"""),
    "devices_at_sites": sql(f"""z AS (SELECT s_suppkey AS site, 24 + (s_suppkey * 37 % 1300) / 100.0::DOUBLE + 0.002 AS lat, 61 + (s_suppkey * 53 % 1600) / 100.0::DOUBLE AS lon FROM supplier), p AS (SELECT site, station, {_KM} AS km FROM z, (SELECT station, lat AS lat2, lon AS lon2 FROM s) b),
        b AS (SELECT DISTINCT ON (site) * FROM p WHERE km <= 0.5 ORDER BY site, km, station) SELECT z.site, station, round(km, 4) AS km FROM z LEFT JOIN b USING (site)"""),
    "manifest_union": sql("""od AS (SELECT station, name FROM s WHERE station % 4 <> 0), nw AS (SELECT station, CASE WHEN station % 5 <> 0 THEN upper(name) END AS name FROM s WHERE station % 3 <> 0)
        SELECT coalesce(od.station, nw.station) AS station, coalesce(nw.name, od.name) AS name, CASE WHEN od.station IS NULL THEN '2024-01-31' ELSE '2024-01-01' END AS first_seen, CASE WHEN nw.station IS NULL THEN '2024-01-01' ELSE '2024-01-31' END AS last_seen,
               CASE WHEN od.station IS NULL THEN 'new' WHEN nw.station IS NULL THEN 'gone' ELSE 'both' END AS state FROM od FULL JOIN nw ON od.station = nw.station"""),
    "labels_by_code": sql("SELECT CASE source WHEN 'view' THEN 'seen' WHEN 'click' THEN 'chosen' WHEN 'purchase' THEN 'bought' ELSE 'other: ' || source END AS label, count(*) AS n FROM r GROUP BY ALL"),
    "city_hours": sql("""h AS (SELECT city, date_trunc('hour', ts) AS hour, avg(pm25) AS pm25, count(*) AS samples, count(DISTINCT station) AS stations FROM r JOIN s USING (station) WHERE qc <> 'INVALID' GROUP BY ALL)
        SELECT city, (hour + INTERVAL 5 HOUR)::DATE AS day, round(sum(pm25 * stations) / sum(stations), 4) AS pm25, sum(samples)::BIGINT AS samples, max(stations) AS most_stations, count(*) AS hours FROM h GROUP BY ALL"""),
    "median_places": sql(f"""m AS (SELECT city, median(lat) AS lat2, median(lon) AS lon2 FROM s GROUP BY city) SELECT city, round(any_value(lat2), 4) AS lat, round(any_value(lon2), 4) AS lon, count(*) FILTER ({_KM} > 600) AS far, count(*) AS stations FROM s JOIN m USING (city) GROUP BY city"""),
    "sums_over_days": sql(f"""{_S}, st AS (SELECT "group", hour::DATE AS day, sum(pm25) AS total, count(pm25) AS n FROM q GROUP BY ALL) SELECT "group", round(sum(total) + 1e-9, 2) AS total, sum(n)::BIGINT AS n, count(*) AS days FROM st WHERE day IN (SELECT ts::DATE FROM r WHERE pm25 > 98) GROUP BY "group" """),
    "latest_two": sql("""e0 AS (SELECT user_id AS station, ts, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts DESC, event_id DESC) AS n FROM e0), l AS (SELECT station, arg_max(v, (ts, event_id)) FILTER (v IS NOT NULL) AS last_known FROM e0 GROUP BY station)
        SELECT station, n, event_id, v, last_known FROM k JOIN l USING (station) WHERE n <= 2"""),
    "ranked_cities": sql(f"""{_LATEST}, c AS (SELECT city, round(avg(pm25), 4) AS pm25, count(*) AS stations FROM n JOIN s USING (station) GROUP BY city HAVING count(*) >= 6), k AS (SELECT *, row_number() OVER (ORDER BY pm25 DESC, city) AS i FROM c)
        SELECT city, pm25, stations, i || CASE i WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END AS rank FROM k WHERE i <= 5"""),
    "recursive_hours": sql("k AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM r), (SELECT max(ts) FROM r), INTERVAL 1 HOUR))::TIMESTAMP AS hour) SELECT hour, (SELECT count(*) FROM r WHERE date_trunc('hour', ts) = hour) AS n FROM k"),
    "station_detail": sql(f"""{_LATEST}, f AS (SELECT station, {', '.join(f'round(avg(pm25 + hour(ts) + {h // 24}), 4) AS h{h}' for h in (24, 48, 72, 96))} FROM r GROUP BY station)
        SELECT station, name, city, ts, pm25, {_CATEGORY.format(i=f'({_index_sql("pm25")})')} AS category, h24, h48, h72, h96 FROM n JOIN s USING (station) LEFT JOIN f USING (station)""").replace(", f AS (SELECT station, round", ", fc AS (SELECT station, round").replace("LEFT JOIN f USING", "LEFT JOIN fc USING"),
    "incidents": sql(f"""n AS (SELECT DISTINCT ON (station) station, pm25 FROM r WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR ORDER BY station, ts DESC), k AS (SELECT country, station, pm25, max(pm25) OVER (PARTITION BY country) > 75 AS a, row_number() OVER (PARTITION BY country ORDER BY pm25 DESC, station) AS n FROM n JOIN s USING (station))
        SELECT country, station, pm25, n FROM k WHERE (a AND pm25 > 75 AND n <= 30) OR (NOT a AND n <= 3)"""),
    "directory_lists": sql("SELECT lower(country) AS name, count(*) AS n, 'country' AS kind FROM s GROUP BY ALL UNION ALL SELECT lower(city), count(*), 'city' FROM s GROUP BY ALL UNION ALL SELECT lower(provider), count(*), 'provider' FROM s GROUP BY ALL"),
    "fetch_health": sql("""g AS (SELECT source, date_trunc('hour', ts)::TIMESTAMP AS run, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run DESC) AS i FROM g), a AS (SELECT source, count(*) AS runs, count(*) FILTER (n < 3) AS thin, max(run) AS latest, sum(n)::BIGINT AS rows FROM k WHERE i <= 24 GROUP BY source)
        SELECT *, CASE WHEN thin * 2 > runs THEN 'failing' WHEN thin > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM a"""),
    "desk_overview": sql("""c AS (SELECT country, day(ts)::INT % 3 AS horizon, city, avg(pm25 + day(ts)) AS m, count(*) AS n, count(*) FILTER (pm25 + day(ts) > 75) AS above FROM r JOIN s USING (station) GROUP BY ALL)
        SELECT country, horizon, sum(n)::BIGINT AS n, round(sum(above) / sum(n), 4) AS share, arg_max(city, (m, city)) AS worst FROM c GROUP BY ALL"""),
    "daily_brief": sql("""d AS (SELECT city, station, ts::DATE AS day, avg(pm25) AS v FROM r JOIN s USING (station) WHERE ts >= TIMESTAMP '2024-01-19' AND ts < TIMESTAMP '2024-01-21' GROUP BY ALL), t AS (SELECT * FROM d WHERE day = DATE '2024-01-20'), w AS (SELECT city, avg(v) AS m FROM t GROUP BY city ORDER BY m DESC, city LIMIT 5),
        b AS (SELECT round(avg(d.v - t.v), 4) AS bias, count(*) AS matched FROM t JOIN d ON d.station = t.station AND d.day = DATE '2024-01-19')
        SELECT (SELECT count(*) FROM t) AS stations, (SELECT count(*) FROM t WHERE v <= 35.4) AS fair, (SELECT count(*) FROM t WHERE v > 55.4) AS unhealthy, (SELECT string_agg(city, ', ' ORDER BY m DESC, city) FROM w) AS worst, bias, matched FROM b"""),
    "resolved_places": sql("""a AS (SELECT station AS ask, CASE station % 4 WHEN 0 THEN lower(city) WHEN 1 THEN upper(name) WHEN 2 THEN upper(country) ELSE 'nowhere' END AS name FROM s),
        c AS (SELECT lower(city) AS k, avg(lat) AS lat, avg(lon) AS lon FROM s GROUP BY ALL), t AS (SELECT lower(name) AS k, avg(lat) AS lat, avg(lon) AS lon FROM s GROUP BY ALL), g AS (SELECT lower(country) AS k, avg(lat) AS lat, avg(lon) AS lon FROM s GROUP BY ALL)
        SELECT ask, name, CASE WHEN c.k IS NOT NULL THEN 'city' WHEN t.k IS NOT NULL THEN 'station' WHEN g.k IS NOT NULL THEN 'country' END AS kind, round(coalesce(c.lat, t.lat, g.lat), 4) AS lat, round(coalesce(c.lon, t.lon, g.lon), 4) AS lon FROM a LEFT JOIN c ON c.k = lower(name) LEFT JOIN t ON t.k = lower(name) LEFT JOIN g ON g.k = lower(name)""".replace("FROM a LEFT JOIN c ON c.k = lower(name) LEFT JOIN t ON t.k = lower(name) LEFT JOIN g ON g.k = lower(name)", "FROM a LEFT JOIN c ON c.k = lower(a.name) LEFT JOIN t ON t.k = lower(a.name) LEFT JOIN g ON g.k = lower(a.name)")),
    "nearest_source": sql(f"""z AS (SELECT s_suppkey AS point, 23 + (s_suppkey * 71 % 1500) / 100.0::DOUBLE AS lat, 60 + (s_suppkey * 29 % 1800) / 100.0::DOUBLE AS lon FROM supplier), p AS (SELECT point, station, {_KM} AS km FROM z, (SELECT station, lat AS lat2, lon AS lon2 FROM s) b), b AS (SELECT DISTINCT ON (point) * FROM p WHERE km <= 200 ORDER BY point, km, station)
        SELECT z.point, CASE WHEN km <= 30 THEN station END AS station, round(km + 1e-9, 3) AS km, CASE WHEN km IS NULL THEN 'none' WHEN km > 30 THEN 'too_far' ELSE 'found' END AS status FROM z LEFT JOIN b USING (point)"""),
    "guarded_backfill": sql("""u AS (SELECT ts::DATE AS day, CASE WHEN station % 3 = 0 THEN 'ug/m3' END AS units, pm25, source FROM r), v AS (SELECT *, CASE WHEN units IS NULL AND pm25 IS NOT NULL AND source = 'view' THEN 'ug/m3' ELSE units END AS new FROM u) SELECT day, count(*) AS n, count(*) FILTER (new IS DISTINCT FROM units) AS changed, count(new) AS attested FROM v GROUP BY day"""),
    "push_times": sql("SELECT event_id, CASE WHEN abs(event_id % 13 - 6) <= 5 THEN ts + to_seconds((event_id % 13 - 6)::DOUBLE) ELSE ts END AS at, abs(event_id % 13 - 6) <= 5 AS own FROM events"),
}
