"""Products from station readings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import CATEGORIES, category, hour_of, index_of, local_day, rounded, season, truncated
from ..operators import series
from ..sources.tables import AS_OF, readings, sql, stations

# The index table as SQL, for the checks.
_INDEX = "CASE WHEN {x} IS NULL OR {x} < 0 THEN NULL {whens} END::BIGINT"


def _index_sql(x: str) -> str:
    from ..functions.exprs import PM25_POINTS

    c = f"(floor({x} * 10 + 1e-9) / 10)"
    line = lambda p: f"round_even({p[2]}.0 + ({c} - {p[0]}) * {(p[3] - p[2]) / (p[1] - p[0])!r}, 0)"
    whens = " ".join(f"WHEN {c} <= {p[1]} THEN {line(p)}" for p in PM25_POINTS) + f" ELSE {line(PM25_POINTS[-1])}"
    return _INDEX.format(x=x, whens=whens)


_CATEGORY = "CASE WHEN {i} IS NULL THEN 'Unknown' " + " ".join(f"WHEN {{i}} <= {most} THEN '{name}'" for most, name in CATEGORIES) + " ELSE 'Beyond Index' END"
_HOUR = "h AS (SELECT station, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(pm25) AS pm25, count(pm25) AS n FROM r GROUP BY ALL)"
_MARKED = f"""{_HOUR},
a AS (SELECT *, lag(pm25) OVER w AS p1, lag(pm25, 2) OVER w AS p2, lead(pm25) OVER w AS n1 FROM h WINDOW w AS (PARTITION BY station ORDER BY hour)),
b AS (SELECT *, coalesce(abs(pm25 - p1) > 250 AND abs(n1 - p1) <= 1, false) AS one,
             coalesce(abs(p1 - p2) > 250 AND abs(pm25 - p2) > 250 AND abs(n1 - p2) <= 1, false) AS two FROM a),
c AS (SELECT *, one OR two OR coalesce(lead(two) OVER (PARTITION BY station ORDER BY hour), false) AS spike FROM b)"""
_GOOD = f"{_MARKED}, g AS (SELECT station, hour, n, CASE WHEN NOT spike THEN pm25 END AS pm25 FROM c)"
_DAY = f"{_GOOD}, d AS (SELECT station, hour::DATE AS day, avg(pm25) AS pm25, max(pm25) AS pm25_max, count(pm25) AS hours FROM g GROUP BY ALL)"


def _hours(spark, sf_dir):
    return series.hourly(readings(spark, sf_dir), "station", "ts", "pm25")


def _good(spark, sf_dir, *days):
    """Hourly means without impossible values, spikes and stuck runs. With `days`, of these alone: readings of the days
    and one to each side are read, which is more than the 18 hours that a run needs to count; hours without a reading
    are no part of a run."""
    rows = readings(spark, sf_dir)
    if days:
        near = [f"ts >= timestamp_ntz'{d} 00:00:00' - interval 1 day and ts < timestamp_ntz'{d} 00:00:00' + interval 2 days" for d in days]
        rows = rows.where(" or ".join(f"({x})" for x in near))
    hours = series.hourly(rows, "station", "ts", "pm25")
    marked = series.stuck(series.spikes(series.bounded(hours, "pm25"), "station", "hour", "pm25"), "station", "hour", "pm25")
    if days:
        marked = marked.where(F.col("hour").cast("date").cast("string").isin(*days))
    return marked.withColumn("pm25", F.when(~F.col("spike") & ~F.col("stuck"), F.col("pm25"))).select("station", "hour", "pm25", "n")


def _days(spark, sf_dir, *days):
    return _good(spark, sf_dir, *days).groupBy("station", F.col("hour").cast("date").alias("day")).agg(F.avg("pm25").alias("pm25"), F.max("pm25").alias("pm25_max"), F.count("pm25").alias("hours"))


def _r4(name):
    return rounded(name, 4).alias(name)


def hourly_agg(spark, sf_dir):
    return _hours(spark, sf_dir).select("station", "hour", _r4("pm25"), "n")


def qc_spike(spark, sf_dir):
    return series.spikes(series.bounded(_hours(spark, sf_dir), "pm25"), "station", "hour", "pm25").groupBy("station").agg(F.count_if("spike").alias("n_spikes"), F.count("*").alias("hours"))


def qc_flatline(spark, sf_dir):
    low = _hours(spark, sf_dir).withColumn("pm25", F.floor(F.col("pm25") / 200))
    return series.stuck(low, "station", "hour", "pm25", 3).groupBy("station").agg(F.count_if("stuck").alias("n_stuck"))


def daily_station(spark, sf_dir):
    return _days(spark, sf_dir).select("station", "day", _r4("pm25"), _r4("pm25_max"), "hours", (F.col("hours") >= 18).alias("complete"))


def hotspots_city(spark, sf_dir):
    """Cities by their stations' mean on the last day, worst first."""
    day = _days(spark, sf_dir, "2024-01-30").join(stations(spark, sf_dir), "station")
    rows = day.groupBy("city").agg(rounded(F.avg("pm25"), 4).alias("pm25"), F.count("pm25").alias("stations")).where("stations >= 1")
    return rows.orderBy(F.desc("pm25"), "city").limit(10).withColumn("category", category(index_of(F.col("pm25"), _points())))


def _points():
    from ..functions.exprs import PM25_POINTS

    return PM25_POINTS


def latest_per_station(spark, sf_dir):
    return series.latest_by(readings(spark, sf_dir).where("pm25 is not null"), ["station"], "ts", "pm25", "source").select("station", "ts", "pm25", "source")


def latest_preferred(spark, sf_dir):
    """The latest good reading, or the latest of any state where there is none."""
    return series.latest(readings(spark, sf_dir), ["station"], F.desc(F.col("qc") == "OK"), F.desc("ts")).select("station", "ts", "pm25", "qc")


def top3_per_city(spark, sf_dir):
    now = series.latest_by(readings(spark, sf_dir), ["station"], "ts", "pm25").join(stations(spark, sf_dir), "station")
    return series.top_k(now, ["city"], 3, F.desc_nulls_last("pm25"), F.col("station")).select("city", F.col("rank").cast("long").alias("rank"), "station", "pm25")


def station_map(spark, sf_dir):
    """Active stations with their latest reading of the last six hours that is neither invalid nor suspect."""
    recent = readings(spark, sf_dir).where(F.expr(f"qc = 'OK' and ts > timestamp_ntz'{AS_OF}' - interval 6 hours and ts <= timestamp_ntz'{AS_OF}'"))
    now = series.latest_by(recent, ["station"], "ts", "pm25")
    return stations(spark, sf_dir).where("active").join(now, "station", "left").select("station", "city", "ts", "pm25", category(index_of(F.col("pm25"), _points())).alias("category"))


def hotspots_station(spark, sf_dir):
    end = F.expr(f"timestamp_ntz'{AS_OF}'")
    recent = readings(spark, sf_dir).where((F.col("ts") >= end - F.expr("interval 24 hours")) & (F.col("ts") <= end) & (F.col("qc") != "INVALID"))
    now = series.latest_by(recent, ["station"], "ts", "pm25").join(stations(spark, sf_dir), "station")
    return now.orderBy(F.desc("pm25"), "station").limit(20).select("station", "name", "city", "pm25", index_of(F.col("pm25"), _points()).alias("aqi"))


def band_counts(spark, sf_dir):
    now = series.latest_by(readings(spark, sf_dir), ["station"], "ts", "pm25")
    return now.groupBy(category(index_of(F.col("pm25"), _points())).alias("category")).agg(F.count("*").alias("n"))


def _spine(hours, start, end):
    """Every station with every hour from start to end; where start is None, of the readings' own first to last hour."""
    if start is not None:
        return series.spine(hours, "station", start, end)
    ends = hours.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    return hours.select("station").distinct().crossJoin(F.broadcast(ends)).select("station", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))  # ends: one row


def gapfill(spark, sf_dir, start=None, end=None):
    hours = _hours(spark, sf_dir)
    if start is not None:
        hours = hours.where(f"hour between timestamp_ntz'{start}' and timestamp_ntz'{end}'")
    return _spine(hours, start, end).join(hours, ["station", "hour"], "left").select("station", "hour", _r4("pm25"), F.coalesce("n", F.lit(0)).alias("n"))


def reading_gaps(spark, sf_dir, start=None, end=None):
    hours = _hours(spark, sf_dir)
    gone = _spine(hours, start, end).join(hours, ["station", "hour"], "left_anti")
    return gone.groupBy("station").agg(F.count("*").alias("missing"), F.min("hour").alias("first_missing"))


def uptime_offline(spark, sf_dir, start=None, end=None):
    """Runs of three missing hours or more."""
    hours = _hours(spark, sf_dir)
    filled = _spine(hours, start, end).join(hours, ["station", "hour"], "left")
    w = Window.partitionBy("station").orderBy("hour")
    runs = series.islands(filled, "station", "hour", F.col("pm25").isNull() != F.lag(F.col("pm25").isNull()).over(w)).where("pm25 is null")
    return runs.groupBy("station", "run").agg(F.min("hour").alias("begins"), F.max("hour").alias("ends"), F.count("*").alias("hours")).where("hours >= 3").drop("run")


def episodes_hour(spark, sf_dir):
    """Sessions of hours above 250 with gaps of two hours at most and three readings at least."""
    high = _hours(spark, sf_dir).where("pm25 > 250")
    w = Window.partitionBy("station").orderBy("hour")
    runs = series.islands(high, "station", "hour", F.col("hour") - F.lag("hour").over(w) > F.expr("interval 2 hours"))
    rows = runs.groupBy("station", "run").agg(F.min("hour").alias("begins"), F.max("hour").alias("ends"), F.count("*").alias("readings"), rounded(F.max("pm25"), 4).alias("peak"), F.max_by("hour", F.struct("pm25", "hour")).alias("peak_at"))
    return rows.where("readings >= 3").select("station", "begins", "ends", "readings", "peak", "peak_at", rounded(F.least(F.lit(1.0), (F.col("peak") - 250) / 50), 4).alias("severity"))


def diurnal(spark, sf_dir):
    rows = readings(spark, sf_dir).where("qc != 'INVALID'").select(F.hour("ts").cast("long").alias("hour"), "pm25")
    found = series.percentiles(rows, ["hour"], "pm25", (0.1, 0.5, 0.9), 1.0)
    return found.select("hour", *[_r4(f"p{q}") for q in (10, 50, 90)], "n")


def diurnal_weekend(spark, sf_dir):
    weekend = (F.weekday("ts") >= 5).alias("weekend")
    return readings(spark, sf_dir).groupBy(weekend, F.hour("ts").cast("long").alias("hour"), season(F.month("ts")).alias("season")).agg(rounded(F.avg("pm25"), 4).alias("pm25"), F.count("*").alias("n"))


def history_trend(spark, sf_dir):
    """Means of the first and second half of each series and the direction between them."""
    w = Window.partitionBy("station").orderBy("hour")
    own = Window.partitionBy("station")
    rows = _hours(spark, sf_dir).withColumn("first", F.row_number().over(w) <= F.floor(F.count("*").over(own) / 2))
    means = rows.groupBy("station").agg(rounded(F.avg(F.when(F.col("first"), F.col("pm25"))), 4).alias("before"), rounded(F.avg(F.when(~F.col("first"), F.col("pm25"))), 4).alias("after"))
    delta = F.col("after") - F.col("before")
    return means.select("*", F.when(delta > 5, "rising").when(delta < -5, "falling").otherwise("stable").alias("trend"))


def period_stats_day(spark, sf_dir):
    """Country means by local day: hours, then station-days of six hours or more, then stations."""
    rows = readings(spark, sf_dir).where("qc != 'INVALID'").groupBy("station", hour_of(F.col("ts")).alias("hour")).agg(F.avg("pm25").alias("pm25"))
    days = rows.groupBy("station", local_day(F.col("hour")).alias("day")).agg(F.avg("pm25").alias("pm25"), F.count("pm25").alias("hours")).where("hours >= 2")
    return days.join(stations(spark, sf_dir), "station").groupBy("country", "day").agg(rounded(F.avg("pm25"), 4).alias("pm25"), F.count("*").alias("stations"), rounded(F.median("pm25"), 4).alias("median"))


def rolling7(spark, sf_dir):
    days = _days(spark, sf_dir)
    return days.select("station", "day", rounded(series.rolling_mean(days, "station", "day", "pm25", 7, 3), 4).alias("mean7"))


def compare_dates(spark, sf_dir):
    """Stations that moved by more than five between two days, largest moves first."""
    days = _days(spark, sf_dir, "2024-01-10", "2024-01-20").select("station", "day", "pm25")
    a, b = (days.where(f"day = date '{d}'").select("station", F.col("pm25").alias(n)) for d, n in (("2024-01-10", "before"), ("2024-01-20", "after")))
    rows = a.join(b, "station").withColumn("delta", rounded(F.col("after") - F.col("before"), 4)).where("abs(delta) > 5")
    return rows.orderBy(F.desc(F.abs("delta")), "station").limit(10).select("station", _r4("before"), _r4("after"), "delta")


def data_coverage(spark, sf_dir):
    rows = readings(spark, sf_dir).groupBy("source").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.count_distinct("station").alias("stations"))
    hours = F.greatest(F.lit(1.0), (F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))) / 3600.0)
    return rows.withColumn("completeness", rounded(F.least(F.lit(1.0), F.col("n") / (F.col("stations") * hours)), 4))


def inventory(spark, sf_dir):
    """Registered, active and reporting stations by provider: a mark join on who has reported."""
    seen = readings(spark, sf_dir).select("station").distinct().withColumn("reporting", F.lit(True))
    rows = stations(spark, sf_dir).join(seen, "station", "left").groupBy("provider")
    return rows.agg(F.count("*").alias("registered"), F.count_if("active").alias("active"), F.count_if("reporting").alias("reporting"))


def freshness(spark, sf_dir):
    recent = F.col("ts") >= F.expr(f"timestamp_ntz'{AS_OF}' - interval 24 hours")
    return readings(spark, sf_dir).groupBy("source").agg(F.max("ts").alias("latest"), F.count_distinct(F.when(recent, F.col("station"))).alias("active_24h"))


def qc_verdict(spark, sf_dir):
    rows = readings(spark, sf_dir).groupBy("station").agg(F.count("*").alias("n"), F.count_if(F.col("qc") == "INVALID").alias("invalid"), rounded(F.stddev_pop("pm25"), 4).alias("spread"))
    share = F.col("invalid") / F.col("n")
    return rows.select("*", rounded(share, 4).alias("invalid_share"), F.when(share > 0.3, "fail").when((share > 0.15) | (F.col("spread") < 1), "warn").otherwise("pass").alias("verdict"))


def aqi(spark, sf_dir):
    i = index_of(F.col("pm25"), _points())
    return readings(spark, sf_dir).select("station", "ts", rounded(truncated(F.col("pm25")), 1).alias("concentration"), i.alias("aqi"), category(i).alias("category"))


def merge_qc(spark, sf_dir):
    """Flags of a reading, as one string, and the state that they give."""
    flags = F.array_compact(F.array(F.when(F.col("pm25") > 450, "high"), F.when(F.col("pm25") < 1, "low"), F.when(F.col("qc") == "INVALID", "error")))
    return readings(spark, sf_dir).select("station", "ts", F.array_join(flags, ";").alias("flags"), F.when(F.array_contains(flags, "error"), "INVALID").when(F.size(flags) > 0, "SUSPECT").otherwise("OK").alias("state"))


def json_extract(spark, sf_dir):
    flow = F.get_json_object("props", "$.k").try_cast("long")
    return readings(spark, sf_dir).groupBy((flow % 10).alias("flow")).agg(F.count("*").alias("n"), rounded(F.avg("pm25"), 4).alias("pm25"))


def pivot_sources(spark, sf_dir):
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = readings(spark, sf_dir).groupBy(F.col("ts").cast("date").alias("day")).pivot("source", kinds).agg(rounded(F.avg("pm25"), 4))
    return rows.select("day", *kinds)


def unpivot_values(spark, sf_dir):
    rows = _days(spark, sf_dir).select("station", "day", "pm25", "pm25_max").unpivot(["station", "day"], ["pm25", "pm25_max"], "parameter", "value")
    return rows.where("value is not null").select("station", "day", "parameter", _r4("value"))


def keyset_page(spark, sf_dir):
    """The 50 readings before a cursor of time and station, newest first."""
    cursor = F.struct(F.expr("timestamp_ntz'2024-01-20 12:00:00'").alias("ts"), F.lit(50).cast("long").alias("station"))
    return readings(spark, sf_dir).where(F.struct("ts", "station") < cursor).orderBy(F.desc("ts"), F.desc("station")).limit(50).select("ts", "station", "pm25")


def weekly(spark, sf_dir):
    week = F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")
    return readings(spark, sf_dir).join(stations(spark, sf_dir), "station").groupBy("city", week).agg(rounded(F.avg("pm25"), 4).alias("pm25"), F.count("*").alias("n"), F.count_distinct("station").alias("stations"))


QUERIES = {f.__name__: f for f in (hourly_agg, qc_spike, qc_flatline, daily_station, hotspots_city, latest_per_station, latest_preferred, top3_per_city, station_map, hotspots_station, band_counts, gapfill, reading_gaps, uptime_offline, episodes_hour, diurnal, diurnal_weekend, history_trend, period_stats_day, rolling7, compare_dates, data_coverage, inventory, freshness, qc_verdict, aqi, merge_qc, json_extract, pivot_sources, unpivot_values, keyset_page, weekly)}

_SPINE = "k AS (SELECT station, unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT station FROM h))"
_NOW = "n AS (SELECT station, arg_max(pm25, ts) AS pm25 FROM r GROUP BY station)"

ORACLE = {
    "hourly_agg": sql(f"{_HOUR} SELECT station, hour, round(pm25, 4) AS pm25, n FROM h"),
    "qc_spike": sql(f"{_MARKED} SELECT station, count(*) FILTER (spike) AS n_spikes, count(*) AS hours FROM c GROUP BY station"),
    "qc_flatline": sql(f"""{_HOUR}, v AS (SELECT station, hour, floor(pm25 / 200) AS x FROM h),
        a AS (SELECT *, coalesce((x <> lag(x) OVER w)::INT, 1) AS b FROM v WINDOW w AS (PARTITION BY station ORDER BY hour)),
        c AS (SELECT *, sum(b) OVER (PARTITION BY station ORDER BY hour) AS run FROM a),
        e AS (SELECT station, count(*) OVER (PARTITION BY station, run) AS k FROM c) SELECT station, count(*) FILTER (k >= 3) AS n_stuck FROM e GROUP BY station"""),
    "daily_station": sql(f"{_DAY} SELECT station, day, round(pm25, 4) AS pm25, round(pm25_max, 4) AS pm25_max, hours, hours >= 18 AS complete FROM d"),
    "hotspots_city": sql(f"""{_DAY}, c2 AS (SELECT city, round(avg(pm25), 4) AS pm25, count(pm25) AS stations FROM d JOIN s USING (station) WHERE day = DATE '2024-01-30' GROUP BY city)
        SELECT city, pm25, stations, {_CATEGORY.format(i=f'({_index_sql("pm25")})')} AS category FROM c2 WHERE stations >= 1 ORDER BY pm25 DESC, city LIMIT 10"""),
    "latest_per_station": sql("SELECT DISTINCT ON (station) station, ts, pm25, source FROM r WHERE pm25 IS NOT NULL ORDER BY station, ts DESC"),
    "latest_preferred": sql("SELECT DISTINCT ON (station) station, ts, pm25, qc FROM r ORDER BY station, qc = 'OK' DESC, ts DESC"),
    "top3_per_city": sql(f"{_NOW} SELECT * FROM (SELECT city, row_number() OVER (PARTITION BY city ORDER BY pm25 DESC NULLS LAST, station) AS rank, station, pm25 FROM n JOIN s USING (station)) WHERE rank <= 3"),
    "station_map": sql(f"""x AS (SELECT DISTINCT ON (station) station, ts, pm25 FROM r WHERE qc = 'OK' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '{AS_OF}' ORDER BY station, ts DESC)
        SELECT station, city, ts, pm25, {_CATEGORY.format(i=f'({_index_sql("pm25")})')} AS category FROM s LEFT JOIN x USING (station) WHERE active"""),
    "hotspots_station": sql(f"""x AS (SELECT DISTINCT ON (station) station, pm25 FROM r WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{AS_OF}' AND qc <> 'INVALID' ORDER BY station, ts DESC)
        SELECT station, name, city, pm25, {_index_sql("pm25")} AS aqi FROM x JOIN s USING (station) ORDER BY pm25 DESC, station LIMIT 20"""),
    "band_counts": sql(f"{_NOW} SELECT {_CATEGORY.format(i=f'({_index_sql("pm25")})')} AS category, count(*) AS n FROM n GROUP BY ALL"),
    "gapfill": sql(f"{_HOUR}, {_SPINE} SELECT station, hour, round(pm25, 4) AS pm25, coalesce(n, 0) AS n FROM k LEFT JOIN h USING (station, hour)"),
    "reading_gaps": sql(f"{_HOUR}, {_SPINE} SELECT station, count(*) AS missing, min(hour) AS first_missing FROM k ANTI JOIN h USING (station, hour) GROUP BY station"),
    "uptime_offline": sql(f"""{_HOUR}, {_SPINE}, a AS (SELECT station, hour, pm25 FROM k LEFT JOIN h USING (station, hour)),
        b AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY hour) - row_number() OVER (PARTITION BY station, pm25 IS NULL ORDER BY hour) AS run FROM a)
        SELECT station, min(hour) AS begins, max(hour) AS ends, count(*) AS hours FROM b WHERE pm25 IS NULL GROUP BY station, run HAVING count(*) >= 3"""),
    "episodes_hour": sql(f"""{_HOUR}, a AS (SELECT *, coalesce((hour - lag(hour) OVER (PARTITION BY station ORDER BY hour) > INTERVAL 2 HOUR)::INT, 1) AS b FROM h WHERE pm25 > 250),
        c AS (SELECT *, sum(b) OVER (PARTITION BY station ORDER BY hour) AS run FROM a),
        e AS (SELECT station, min(hour) AS begins, max(hour) AS ends, count(*) AS readings, round(max(pm25), 4) AS peak, arg_max(hour, pm25) AS peak_at FROM c GROUP BY station, run)
        SELECT *, round(least(1.0, (peak - 250) / 50), 4) AS severity FROM e WHERE readings >= 3"""),
    "diurnal": sql("SELECT extract(hour FROM ts)::BIGINT AS hour, round(quantile_cont(pm25, 0.1), 4) AS p10, round(quantile_cont(pm25, 0.5), 4) AS p50, round(quantile_cont(pm25, 0.9), 4) AS p90, count(pm25) AS n FROM r WHERE qc <> 'INVALID' GROUP BY ALL"),
    "diurnal_weekend": sql("""SELECT isodow(ts) >= 6 AS weekend, extract(hour FROM ts)::BIGINT AS hour, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'pre_monsoon'
        WHEN month(ts) BETWEEN 6 AND 9 THEN 'monsoon' ELSE 'post_monsoon' END AS season, round(avg(pm25), 4) AS pm25, count(*) AS n FROM r GROUP BY ALL"""),
    "history_trend": sql(f"""{_HOUR}, a AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY hour) <= floor(count(*) OVER (PARTITION BY station) / 2) AS first FROM h),
        m AS (SELECT station, round(avg(pm25) FILTER (first), 4) AS before, round(avg(pm25) FILTER (NOT first), 4) AS after FROM a GROUP BY station)
        SELECT *, CASE WHEN after - before > 5 THEN 'rising' WHEN after - before < -5 THEN 'falling' ELSE 'stable' END AS trend FROM m"""),
    "period_stats_day": sql("""h AS (SELECT station, date_trunc('hour', ts) AS hour, avg(pm25) AS pm25 FROM r WHERE qc <> 'INVALID' GROUP BY ALL),
        d AS (SELECT station, (hour + INTERVAL 5 HOUR)::DATE AS day, avg(pm25) AS pm25 FROM h GROUP BY ALL HAVING count(pm25) >= 2)
        SELECT country, day, round(avg(pm25), 4) AS pm25, count(DISTINCT station) AS stations, round(median(pm25), 4) AS median FROM d JOIN s USING (station) GROUP BY ALL"""),
    "rolling7": sql(f"""{_DAY} SELECT station, day, round(CASE WHEN count(pm25) OVER w >= 3 THEN avg(pm25) OVER w END, 4) AS mean7 FROM d
        WINDOW w AS (PARTITION BY station ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""),
    "compare_dates": sql(f"""{_DAY}, x AS (SELECT a.station, a.pm25 AS p, b.pm25 AS q, round(b.pm25 - a.pm25, 4) AS delta FROM d a JOIN d b USING (station) WHERE a.day = DATE '2024-01-10' AND b.day = DATE '2024-01-20')
        SELECT station, round(p, 4) AS before, round(q, 4) AS after, delta FROM x WHERE abs(delta) > 5 ORDER BY abs(delta) DESC, station LIMIT 10"""),
    "data_coverage": sql("""a AS (SELECT source, min(ts) AS first, max(ts) AS last, count(*) AS n, count(DISTINCT station) AS stations FROM r GROUP BY source)
        SELECT *, round(least(1.0, n / (stations * greatest(1.0, (floor(epoch(last)) - floor(epoch(first))) / 3600.0))), 4) AS completeness FROM a"""),
    "inventory": sql("SELECT provider, count(*) AS registered, count(*) FILTER (active) AS active, count(*) FILTER (station IN (SELECT station FROM r)) AS reporting FROM s GROUP BY provider"),
    "freshness": sql(f"SELECT source, max(ts) AS latest, count(DISTINCT station) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS active_24h FROM r GROUP BY source"),
    "qc_verdict": sql("""a AS (SELECT station, count(*) AS n, count(*) FILTER (qc = 'INVALID') AS invalid, round(stddev_pop(pm25), 4) AS spread FROM r GROUP BY station)
        SELECT *, round(invalid / n, 4) AS invalid_share, CASE WHEN invalid / n > 0.3 THEN 'fail' WHEN invalid / n > 0.15 OR spread < 1 THEN 'warn' ELSE 'pass' END AS verdict FROM a"""),
    "aqi": sql(f"SELECT station, ts, round(floor(pm25 * 10 + 1e-9) / 10, 1) AS concentration, {_index_sql('pm25')} AS aqi, {_CATEGORY.format(i=f'({_index_sql("pm25")})')} AS category FROM r"),
    "merge_qc": sql("""SELECT station, ts, concat_ws(';', CASE WHEN pm25 > 450 THEN 'high' END, CASE WHEN pm25 < 1 THEN 'low' END, CASE WHEN qc = 'INVALID' THEN 'error' END) AS flags,
        CASE WHEN qc = 'INVALID' THEN 'INVALID' WHEN pm25 > 450 OR pm25 < 1 THEN 'SUSPECT' ELSE 'OK' END AS state FROM r"""),
    "json_extract": sql("SELECT (props->>'$.k')::BIGINT % 10 AS flow, count(*) AS n, round(avg(pm25), 4) AS pm25 FROM r GROUP BY ALL"),
    "pivot_sources": sql("SELECT ts::DATE AS day, " + ", ".join(f"round(avg(pm25) FILTER (source = '{k}'), 4) AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")) + " FROM r GROUP BY ALL"),
    "unpivot_values": sql(f"{_DAY} SELECT station, day, 'pm25' AS parameter, round(pm25, 4) AS value FROM d WHERE pm25 IS NOT NULL UNION ALL SELECT station, day, 'pm25_max', round(pm25_max, 4) FROM d WHERE pm25_max IS NOT NULL"),
    "keyset_page": sql("SELECT ts, station, pm25 FROM r WHERE (ts, station) < (TIMESTAMP '2024-01-20 12:00:00', 50) ORDER BY ts DESC, station DESC LIMIT 50"),
    "weekly": sql("SELECT city, date_trunc('week', ts)::TIMESTAMP AS week, round(avg(pm25), 4) AS pm25, count(*) AS n, count(DISTINCT station) AS stations FROM r JOIN s USING (station) GROUP BY ALL"),
}
