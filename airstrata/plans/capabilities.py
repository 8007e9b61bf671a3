"""The capabilities of `airstrata.api` called with options, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions.exprs import rounded
from ..session import table
from ..sources.tables import AS_OF, daily, readings, sql, stations
from . import fire_days
from .observations import _CATEGORY, _index_sql

_KM = fire_days._KM
#: Of a query: a window of time, a list of stations, texts that are periods or none.
FROM, UNTIL, LISTED = "2024-01-10 06:00:00", "2024-01-20 00:00:00", [1, 3, 7, 20, 33, 58, 77, 101]


def _net(spark, sf_dir) -> api.Network:
    return api.Network(readings(spark, sf_dir), stations(spark, sf_dir))


def _r(df, *names):
    return df.withColumns({n: rounded(n) for n in names})


def period_dates(spark, sf_dir):
    """First and last days of periods told as a year, a month or a day, blanks around them; null for other texts."""
    o, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    kinds = [F.date_format(day, "yyyy"), F.date_format(day, "yyyy-MM"), day.cast("string"), F.lit(" "), F.concat(F.lit("  "), F.date_format(day, "yyyy"), F.lit(" ")), F.lit("1996-13"), F.concat(F.lit("x"), day.cast("string"))]
    rows = table(spark, sf_dir, "orders").select(o.alias("id"), F.element_at(F.array(*kinds), (o % 7 + 1).cast("int")).alias("text"))
    return rows.select("id", "text", api.period_day(F.col("text")).alias("start"), api.period_day(F.col("text"), end=True).alias("end"))


def hotspots_by_option(spark, sf_dir):
    """Cities by the greatest value of the window, three stations at least; stations by mean, of two providers; countries and
    the nation by latest values."""
    net = _net(spark, sf_dir)
    parts = [
        ("city max", api.hotspots(net, "city", "max", FROM, UNTIL, 15, 3), "city"), ("station mean", api.hotspots(net.of(providers=["BUILDING", "MACHINERY"]), "station", "mean", FROM, UNTIL, 12), "station"),
        ("country latest", api.hotspots(net, "country", "latest", None, UNTIL), "country"), ("national latest", api.hotspots(net, "national", "latest"), None),
    ]
    out = None
    for name, df, key in parts:
        own = df.select(F.lit(name).alias("what"), (F.col(key).cast("string") if key else F.lit("all")).alias("name"), rounded("value").alias("value"), "stations", "aqi", "category")
        out = own if out is None else out.union(own)
    return out


def network_summary(spark, sf_dir):
    """One row of the whole network's latest values, and stations by category."""
    rows = api.summary(_net(spark, sf_dir), FROM, UNTIL)
    return _r(rows, "mean", "median").select("stations", "reporting", "mean", "median", "max", F.element_at("categories", "Good").alias("good"), F.element_at("categories", "Moderate").alias("moderate"))


def history_of_list(spark, sf_dir):
    """Hours of a fixed list of stations in a window, a row for every hour that any of them has."""
    rows = api.history(_net(spark, sf_dir).of(ids=LISTED), "station", FROM, UNTIL, fill=True)
    return rows.select("station", F.col("at").alias("hour"), rounded("value").alias("value"), "n")


def history_of_cities(spark, sf_dir):
    """Days of every city, from station-days of two known hours or more."""
    rows = api.history(_net(spark, sf_dir), "city", None, None, "day", least_hours=2)
    return rows.select("city", F.col("at").cast("date").alias("day"), rounded("value").alias("value"), "n")


def trend_of_countries(spark, sf_dir):
    """What the halves of each country's hours say."""
    return _r(api.trend(_net(spark, sf_dir), "country", least=1.0), "before", "after")


def coverage_of_providers(spark, sf_dir):
    """Readings, hours and completeness by provider."""
    return _r(api.coverage(_net(spark, sf_dir), "provider", FROM, UNTIL), "completeness")


def inventory_of_cities(spark, sf_dir):
    """Stations registered, active and reporting within two days, by city."""
    return api.inventory(_net(spark, sf_dir), "2024-01-20 12:00:00", "city", 48)


def uptime_of_stations(spark, sf_dir):
    """Availability and outages of a day or more."""
    return _r(api.uptime(_net(spark, sf_dir), least_hours=24), "availability")


def movers(spark, sf_dir):
    """The biggest changes of stations between two days."""
    return _r(api.compare(_net(spark, sf_dir), "2024-01-20", "2024-01-10", "station", 5.0, 25), "value", "other", "change")


def nearest_to_sites(spark, sf_dir):
    """The three stations of one country nearest to every site, however far, with the way there and their latest reading."""
    j = F.col("s_suppkey")
    sites = table(spark, sf_dir, "supplier").select(j.alias("site"), (20 + (j * 41 % 2300) / 100.0).alias("lat"), (55 + (j * 59 % 2600) / 100.0).alias("lon"))
    rows = api.nearest_stations(_net(spark, sf_dir).of(country="ASIA"), sites, "site", 3, None, FROM, UNTIL)
    return rows.select("site", "rank", "station", rounded("km", 3).alias("km"), rounded("bearing", 2).alias("bearing"), "ts", "pm25")


def _forecasts(spark, sf_dir):
    """Cycles of a nowcast: a day's readings as what was said, a lead for each of four hours."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("made"), u.alias("entry"), F.array(u + 1000, u + 2000).alias("members"), (u * 10).alias("sensor"), (F.hour("ts") % 4).alias("lead"), F.when(e % 5 != 0, F.col("value")).alias("value"))


def nowcast_by_option(spark, sf_dir):
    """The latest cycle: entries of a city, and those that three stations are meant by."""
    f, s = _forecasts(spark, sf_dir), stations(spark, sf_dir)
    parts = [("city", api.nowcast(f, s, city=" nation_3 "))] + [(of, api.nowcast(f, s, of=of)) for of in ("5", "1017", "330")]
    out = None
    for name, df in parts:
        own = df.select(F.lit(name).alias("asked"), "entry", "lead", "value")
        out = own if out is None else out.union(own)
    return out.groupBy("asked", "entry", "lead").agg(F.count("*").alias("n"), F.max("value").alias("value"))


def nowcast_cycles(spark, sf_dir):
    """Each cycle's entries, those with a value, and its leads."""
    rows = api.nowcast_summary(_forecasts(spark, sf_dir))
    return rows.select("made", "n_stations", "n_forecastable", rounded("share").alias("share"), F.concat_ws(",", F.transform("leads", lambda x: x.cast("string"))).alias("leads"))


def provider_stations(spark, sf_dir):
    """A provider's stations with their latest reading before a time, and its age."""
    return _r(api.providers(_net(spark, sf_dir), "FURNITURE", None, UNTIL), "lat", "lon", "age_hours")


def alias_evidence(spark, sf_dir):
    """Which stations new places may be: places are the stations' own, moved and renamed."""
    k = F.col("station")
    s = stations(spark, sf_dir)
    new = s.where("station % 2 = 0").select(k.alias("place"), F.concat(F.substring("name", 1, 9), F.lpad((k + k % 4).cast("string"), 9, "0")).alias("name"), F.concat(F.lit("The "), F.initcap("provider"), F.lit(" Office")).alias("owner"), (F.col("lat") + (k % 7 - 3) * 0.0005).alias("lat"), F.col("lon").alias("lon"))
    known = s.select(k.alias("known"), F.col("name").alias("known_name"), "provider", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return api.alias_candidates(new, known, 1200.0, 3)


def audit(spark, sf_dir):
    """Stations whose entry is contradicted: by the province that holds them, by a namesake in their city, by their name, by silence."""
    k = F.col("station")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("_rk"), F.col("r_name").alias("registered"))
    named = F.when(k % 50 == 0, F.concat(F.lit("Test "), F.col("name"))).when(k % 40 == 1, "Main Station").otherwise(F.col("name"))
    rows = stations(spark, sf_dir).withColumn("name", named).join(region, k % 5 == F.col("_rk")).drop("_rk")
    net = api.Network(readings(spark, sf_dir), rows)
    out = api.registry_audit(net, fire_days.regions(spark, sf_dir).where("kind = 'province'"), "registered", AS_OF, days=5)
    return out.where("mismatch or duplicate or test or stale")


def seasons_of_values(spark, sf_dir):
    """Seasons of daily values: totals, and the days on which a twentieth, the half and nine tenths of them are reached."""
    rows = api.seasons(daily(spark, sf_dir), "day", "value", (0.05, 0.5, 0.9))
    return rows.select("season", rounded("total", 2).alias("total"), "days", "t5", "t50", "t90")


QUERIES = {
    f.__name__: f
    for f in (
        period_dates, hotspots_by_option, network_summary, history_of_list, history_of_cities, trend_of_countries, coverage_of_providers, inventory_of_cities, uptime_of_stations, movers, nearest_to_sites,
        nowcast_by_option, nowcast_cycles, provider_stations, alias_evidence, audit, seasons_of_values,
    )
}

_V = "v AS (SELECT * FROM r WHERE qc <> 'INVALID' AND pm25 IS NOT NULL)"
_IN = f"ts >= TIMESTAMP '{FROM}' AND ts < TIMESTAMP '{UNTIL}'"
_I = _index_sql("value")
_H = "hh AS (SELECT station, date_trunc('hour', ts)::TIMESTAMP AS at_, avg(pm25) AS value FROM v GROUP BY ALL)"
_FC = "fc AS (SELECT date_trunc('day', ts)::TIMESTAMP AS made, user_id AS entry, [user_id + 1000, user_id + 2000] AS members, user_id * 10 AS sensor, hour(ts) % 4 AS lead, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events)"
_PLAIN = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_G = "list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr(lower({0}), i, 2))"
ORACLE = {
    "period_dates": """WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN ' '
          WHEN 4 THEN '  ' || strftime(o_orderdate, '%Y') || ' ' WHEN 5 THEN '1996-13' ELSE 'x' || strftime(o_orderdate, '%Y-%m-%d') END AS text, o_orderdate::DATE AS day FROM orders)
        SELECT id, text, CASE WHEN id % 7 IN (0, 4) THEN make_date(year(day), 1, 1) WHEN id % 7 = 1 THEN date_trunc('month', day)::DATE WHEN id % 7 = 2 THEN day END AS start,
               CASE WHEN id % 7 IN (0, 4) THEN make_date(year(day), 12, 31) WHEN id % 7 = 1 THEN last_day(day) WHEN id % 7 = 2 THEN day END AS "end" FROM t""",
    "hotspots_by_option": sql(f"""{_V}, a AS (SELECT 'city max' AS what, city AS name, max(pm25) AS value, count(DISTINCT station) AS stations FROM v JOIN s USING (station) WHERE {_IN} GROUP BY city HAVING count(DISTINCT station) >= 3 ORDER BY value DESC, name LIMIT 15),
        b AS (SELECT 'station mean' AS what, station, avg(pm25) AS value, 1 AS stations FROM v JOIN s USING (station) WHERE {_IN} AND provider IN ('BUILDING', 'MACHINERY') GROUP BY station ORDER BY value DESC, station LIMIT 12),
        c AS (SELECT 'country latest' AS what, country AS name, avg(pm25) AS value, count(*) AS stations FROM (SELECT station, arg_max(pm25, ts) AS pm25 FROM v WHERE ts < TIMESTAMP '{UNTIL}' GROUP BY station) JOIN s USING (station) GROUP BY country ORDER BY value DESC, name LIMIT 10),
        d AS (SELECT 'national latest' AS what, 'all' AS name, avg(pm25) AS value, count(*) AS stations FROM (SELECT station, arg_max(pm25, ts) AS pm25 FROM v GROUP BY station) JOIN s USING (station)),
        e AS (SELECT * FROM a UNION ALL SELECT what, station::VARCHAR, value, stations FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d)
        SELECT what, name, round(value, 4) AS value, stations, {_I} AS aqi, {_CATEGORY.format(i=f"({_I})")} AS category FROM e"""),
    "network_summary": sql(f"""{_V}, n AS (SELECT station, arg_max(pm25, ts) AS value FROM v WHERE {_IN} GROUP BY station), j AS (SELECT s.station, value, {_CATEGORY.format(i=f"({_I})")} AS c FROM s LEFT JOIN n USING (station))
        SELECT count(*) AS stations, count(value) AS reporting, round(avg(value), 4) AS mean, round(median(value), 4) AS median, max(value) AS max, nullif(count(*) FILTER (value IS NOT NULL AND c = 'Good'), 0) AS good, nullif(count(*) FILTER (value IS NOT NULL AND c = 'Moderate'), 0) AS moderate FROM j"""),
    "history_of_list": sql(f"""{_V}, h AS (SELECT station, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(pm25) AS value FROM v WHERE {_IN} GROUP BY ALL),
        k AS (SELECT station, unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour FROM s WHERE station IN ({", ".join(map(str, LISTED))}))
        SELECT station, hour, round(value, 4) AS value, (value IS NOT NULL)::BIGINT AS n FROM k LEFT JOIN h USING (station, hour)"""),
    "history_of_cities": sql(f"""{_V}, {_H}, d AS (SELECT station, at_::DATE AS day, avg(value) AS value FROM hh GROUP BY ALL HAVING count(*) >= 2) SELECT city, day, round(avg(value), 4) AS value, count(*) AS n FROM d JOIN s USING (station) GROUP BY ALL"""),
    "trend_of_countries": sql(f"""{_V}, {_H}, c AS (SELECT country, at_, avg(value) AS value FROM hh JOIN s USING (station) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY at_) <= count(*) OVER (PARTITION BY country) // 2 AS first FROM c),
        m AS (SELECT country, avg(value) FILTER (first) AS before, avg(value) FILTER (NOT first) AS after FROM k GROUP BY country)
        SELECT country, round(before, 4) AS before, round(after, 4) AS after, CASE WHEN after - before > 1 THEN 'rising' WHEN after - before < -1 THEN 'falling' WHEN after - before IS NOT NULL THEN 'steady' END AS trend FROM m"""),
    "coverage_of_providers": sql(f"""x AS (SELECT *, date_trunc('hour', ts) AS h FROM r WHERE pm25 IS NOT NULL AND {_IN}), sp AS (SELECT date_diff('hour', min(h), max(h)) + 1 AS span FROM x)
        SELECT provider, count(DISTINCT station) AS n_stations, count(*) AS readings, min(ts) AS first, max(ts) AS last, count(DISTINCT (station, h)) AS hours, round(count(DISTINCT (station, h)) / (count(DISTINCT station) * any_value(span)), 4) AS completeness FROM x JOIN s USING (station), sp GROUP BY provider"""),
    "inventory_of_cities": sql("""q AS (SELECT DISTINCT station FROM r WHERE ts > TIMESTAMP '2024-01-18 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00') SELECT city, count(*) AS registered, count(*) FILTER (active) AS active, count(q.station) AS reporting FROM s LEFT JOIN q USING (station) GROUP BY city"""),
    "uptime_of_stations": sql(f"""{_V}, h AS (SELECT DISTINCT station, date_trunc('hour', ts)::TIMESTAMP AS hour FROM v), e AS (SELECT min(hour) AS a, max(hour) AS b FROM h), own AS (SELECT DISTINCT station FROM h JOIN s USING (station)),
        k AS (SELECT station, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM own, e), g AS (SELECT k.station, k.hour, h.hour IS NULL AS gone FROM k LEFT JOIN h ON h.station = k.station AND h.hour = k.hour),
        i AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY hour) - row_number() OVER (PARTITION BY station, gone ORDER BY hour) AS run FROM g), oo AS (SELECT station, count(*) AS n FROM i WHERE gone GROUP BY station, run),
        p AS (SELECT station, count(*) AS hours, count(*) FILTER (NOT gone) AS known FROM g GROUP BY station)
        SELECT p.station, hours, known, round(known / hours, 4) AS availability, count(*) FILTER (n >= 24) AS outages, coalesce(max(n) FILTER (n >= 24), 0) AS longest FROM p LEFT JOIN oo USING (station) GROUP BY ALL"""),
    "movers": sql(f"""{_V}, {_H}, d AS (SELECT station, at_::DATE AS day, avg(value) AS value FROM hh GROUP BY ALL), j AS (SELECT a.station, a.value, b.value AS other, a.value - b.value AS change FROM d a JOIN d b ON a.station = b.station AND a.day = DATE '2024-01-20' AND b.day = DATE '2024-01-10' JOIN s ON s.station = a.station)
        SELECT station, round(value, 4) AS value, round(other, 4) AS other, round(change, 4) AS change FROM j WHERE abs(change) > 5 ORDER BY abs(j.change) DESC, station LIMIT 25"""),
    "nearest_to_sites": sql(f"""{_V}, z AS (SELECT s_suppkey AS site, 20 + (s_suppkey * 41 % 2300) / 100.0::DOUBLE AS lat, 55 + (s_suppkey * 59 % 2600) / 100.0::DOUBLE AS lon FROM supplier), t AS (SELECT station, lat AS lat2, lon AS lon2 FROM s WHERE country = 'ASIA'),
        p AS (SELECT site, station, lat, lon, lat2, lon2, {_KM} AS km FROM z, t), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, station) AS rank FROM p QUALIFY rank <= 3), n AS (SELECT DISTINCT ON (station) station, ts, pm25 FROM v WHERE {_IN} ORDER BY station, ts DESC)
        SELECT site, rank::INT AS rank, k.station, round(km + 1e-9, 3) AS km, round((degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360) % 360 + 1e-9, 2) AS bearing, ts, pm25 FROM k LEFT JOIN n USING (station)"""),
    "nowcast_by_option": sql(f"""{_FC}, l AS (SELECT fc.*, city FROM fc LEFT JOIN s ON station = entry WHERE made = (SELECT max(made) FROM fc)),
        a AS (SELECT 'city' AS asked, * FROM l WHERE lower(city) = 'nation_3' UNION ALL SELECT q, l.* FROM l, (VALUES ('5'), ('1017'), ('330')) t(q) WHERE entry::VARCHAR = q OR list_contains(members, q::BIGINT) OR sensor = q::BIGINT)
        SELECT asked, entry, lead::INT AS lead, count(*) AS n, max(value) AS value FROM a GROUP BY ALL"""),
    "nowcast_cycles": sql(f"""{_FC}, e AS (SELECT made, entry, bool_or(value IS NOT NULL) AS fit FROM fc GROUP BY ALL), g AS (SELECT made, string_agg(lead::VARCHAR, ',' ORDER BY lead) AS leads FROM (SELECT DISTINCT made, lead FROM fc) GROUP BY made)
        SELECT made, count(*) AS n_stations, count(*) FILTER (fit) AS n_forecastable, round(count(*) FILTER (fit) / count(*), 4) AS share, any_value(leads) AS leads FROM e JOIN g USING (made) GROUP BY made"""),
    "provider_stations": sql(f"""n AS (SELECT DISTINCT ON (station) station, ts, pm25, qc FROM r WHERE pm25 IS NOT NULL AND ts < TIMESTAMP '{UNTIL}' ORDER BY station, ts DESC)
        SELECT s.station, name, city, round(lat, 4) AS lat, round(lon, 4) AS lon, active, ts, pm25, qc, round((epoch(TIMESTAMP '{UNTIL}') - floor(epoch(ts))) / 3600, 4) AS age_hours FROM s LEFT JOIN n USING (station) WHERE provider = 'FURNITURE'"""),
    "alias_evidence": sql(f"""n AS (SELECT station AS place, substr(name, 1, 9) || lpad((station + station % 4)::VARCHAR, 9, '0') AS nm, 'The ' || upper(substr(provider, 1, 1)) || lower(substr(provider, 2)) || ' Office' AS owner, lat + (station % 7 - 3) * 0.0005::DOUBLE AS lat, lon FROM s WHERE station % 2 = 0),
        p AS (SELECT place, nm, owner, b.station AS known, b.name, provider, {_KM} AS km FROM n, (SELECT station, name, provider, lat AS lat2, lon AS lon2 FROM s) b), q AS (SELECT *, {_G.format("nm")} AS ga, {_G.format("name")} AS gb FROM p WHERE km <= 1.2),
        k AS (SELECT place, known, provider, round(km * 1000, 1) AS metres, round(2 * len(list_intersect(list_distinct(ga), list_distinct(gb))) / (len(list_distinct(ga)) + len(list_distinct(gb))), 3) AS likeness, contains(lower(owner), lower(provider)) AS hint FROM q)
        SELECT place, (row_number() OVER (PARTITION BY place ORDER BY metres, likeness DESC, known))::INT AS rank, known, provider, metres, likeness, hint FROM k QUALIFY rank <= 3"""),
    "audit": sql(f"""{fire_days._P}, t AS (SELECT station, CASE WHEN station % 50 = 0 THEN 'Test ' || name WHEN station % 40 = 1 THEN 'Main Station' ELSE name END AS nm, city, lat, lon, r_name AS registered FROM s JOIN region ON r_regionkey = station % 5),
        pv AS (SELECT t.station, e.name FROM t, e WHERE kind = 'province' AND {fire_days._HOLDS} GROUP BY ALL HAVING count(*) % 2 = 1), p1 AS (SELECT station, min(name) AS region FROM pv GROUP BY ALL),
        z AS (SELECT DISTINCT station FROM r WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY AND ts <= TIMESTAMP '{AS_OF}'),
        od AS (SELECT t.station, registered, region, region IS NOT NULL AND NOT contains({_PLAIN.format("region")}, {_PLAIN.format("registered")}) AND NOT contains({_PLAIN.format("registered")}, {_PLAIN.format("region")}) AS mismatch,
              count(*) OVER (PARTITION BY {_PLAIN.format("city")}, {_PLAIN.format("nm")}) > 1 AS duplicate, regexp_matches(nm, '(?i)\\btest\\b') AS test, z.station IS NULL AS stale FROM t LEFT JOIN p1 USING (station) LEFT JOIN z USING (station))
        SELECT * FROM od WHERE coalesce(mismatch, false) OR duplicate OR test OR stale"""),
    "seasons_of_values": sql("""d AS (SELECT CASE WHEN month(day) >= 7 THEN year(day) ELSE year(day) - 1 END::INT AS season, day, sum(value) AS v FROM o GROUP BY ALL), k AS (SELECT *, sum(v) OVER (PARTITION BY season ORDER BY day) AS c, sum(v) OVER (PARTITION BY season) AS t FROM d)
        SELECT season, round(max(t) + 1e-9, 2) AS total, count(*) FILTER (v > 0) AS days, min(day) FILTER (c >= 0.05 * t) AS t5, min(day) FILTER (c >= 0.5 * t) AS t50, min(day) FILTER (c >= 0.9 * t) AS t90 FROM k GROUP BY season"""),
}
