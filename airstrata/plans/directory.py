"""Products about stations and cities: detail pages, period statistics at every scope, snapshots, listings, availability, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import category, exact_mean, index_of, local_day, rounded
from ..operators import places, series
from ..sources.tables import AS_OF, readings, sql, stations
from .observations import _CATEGORY, _index_sql, _points

_NOW = f"timestamp_ntz'{AS_OF}'"


def _at(hours):
    return F.expr(f"{_NOW} - interval {hours} hours")


def _good(spark, sf_dir):
    return readings(spark, sf_dir).where("qc <> 'INVALID'")


def city_detail(spark, sf_dir):
    """Stations of every city with their latest reading, those of the last three hours first, of a day after that."""
    now = series.latest_by(_good(spark, sf_dir).where(F.col("ts") > _at(24)), ["station"], "ts", "pm25")
    rows = stations(spark, sf_dir).join(now, "station").withColumn("tier", F.when(F.col("ts") >= _at(3), 0).otherwise(1))
    order = Window.partitionBy("city").orderBy("tier", F.desc("pm25"), "station")
    return rows.select("city", "station", "ts", "pm25", "tier", F.row_number().over(order).cast("long").alias("place"))


def city_trend(spark, sf_dir):
    """Hourly means of each city over the last day."""
    rows = _good(spark, sf_dir).where((F.col("ts") > _at(24)) & (F.col("ts") <= _at(0))).join(stations(spark, sf_dir), "station")
    return rows.groupBy("city", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(rounded(F.avg("pm25")).alias("pm25"), F.count_distinct("station").alias("stations"))


#: What a period is cut into, as an expression over the local day.
PERIODS = {"day": "cast(day as string)", "month": "date_format(day, 'yyyy-MM')", "year": "date_format(day, 'yyyy')", "all": "'all'"}


def period_stats(spark, sf_dir, scope, period, pollutant="pm25", least_hours=2, calendar_day=None):
    """Statistics of a scope (station, city, country, national) by period over local days: hours, then station-days of
    `least_hours` or more, then the mean, median, extremes and counts of these. `calendar_day` (MM-dd) keeps that day of each year.

    Medians are exact: station-days are few beside readings, and a group's are spread by value first."""
    rows = _good(spark, sf_dir).withColumn("pm10", F.col("pm25") * 1.5).withColumn("v", F.col(pollutant))
    if calendar_day:
        rows = rows.where(F.date_format(local_day(F.col("ts")), "MM-dd") == calendar_day)
    hours = rows.groupBy("station", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.avg("v").alias("v"))
    days = hours.groupBy("station", local_day(F.col("hour")).alias("day")).agg(F.avg("v").alias("v"), F.count("v").alias("n")).where(F.col("n") >= least_hours)
    where = stations(spark, sf_dir).select("station", F.lit("all").alias("national"), "city", "country")
    days = days.join(where, "station").select(F.col(scope).cast("string").alias("name"), F.expr(PERIODS[period]).alias("period"), "station", "day", "v")
    out = days.groupBy("name", "period").agg(
        rounded(F.avg("v")).alias("mean"), rounded(F.median("v")).alias("median"), rounded(F.max("v")).alias("max"), rounded(F.min("v")).alias("min"), F.count("*").alias("station_days"), F.count_distinct("station").alias("stations"), F.count_distinct("day").alias("days"),
    )
    return out


def _stats(scope, period, pollutant="pm25", calendar_day=None):
    def query(spark, sf_dir):
        return period_stats(spark, sf_dir, scope, period, pollutant, calendar_day=calendar_day)

    return query


def _stats_sql(scope, period, pollutant="pm25", calendar_day=None):
    name = {"station": "s.station::VARCHAR", "national": "'all'", "city": "city", "country": "country"}[scope]
    cut = {"day": "day::VARCHAR", "month": "strftime(day, '%Y-%m')", "year": "strftime(day, '%Y')", "all": "'all'"}[period]
    value = "pm25 * 1.5" if pollutant == "pm10" else "pm25"
    keep = f"AND strftime(ts + INTERVAL 5 HOUR, '%m-%d') = '{calendar_day}'" if calendar_day else ""
    return sql(f"""h AS (SELECT station, date_trunc('hour', ts) AS hour, avg({value}) AS v FROM r WHERE qc <> 'INVALID' {keep} GROUP BY ALL),
        d AS (SELECT station, (hour + INTERVAL 5 HOUR)::DATE AS day, avg(v) AS v FROM h GROUP BY ALL HAVING count(v) >= 2),
        j AS (SELECT {name} AS name, {cut} AS period, d.station, day, v FROM d JOIN s ON s.station = d.station)
        SELECT name, period, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(max(v), 4) AS max, round(min(v), 4) AS min, count(*) AS station_days, count(DISTINCT station) AS stations, count(DISTINCT day) AS days FROM j GROUP BY ALL""")


_SCOPES = {
    "period_station_month": ("station", "month"), "period_city_day": ("city", "day"), "period_city_month_pm10": ("city", "month", "pm10"), "period_country_month": ("country", "month"), "period_national_day": ("national", "day"),
    "period_national_year": ("national", "year"), "period_country_all": ("country", "all"), "period_same_date": ("city", "year", "pm25", "01-15"),
}


def snapshot(spark, sf_dir):
    """One day of the past: the national mean, counts by band, and the mean of the three days to each side.

    A station's mean may lie on a band's limit, so its readings are added up in their order."""
    day = F.to_date(F.lit("2024-01-15"))
    rows = readings(spark, sf_dir, "event_id").where("qc <> 'INVALID'").withColumn("day", F.col("ts").cast("date")).where(F.col("day").between(F.date_sub(day, 3), F.date_add(day, 3)))
    means = series.mean_in_order(rows, ["station", "day"], ["event_id"], "pm25", "v")
    own = F.when(F.col("day") == day, F.col("v"))
    limits = (-1, 9, 35.4, 55.4, 125.4, 225.4)
    cut = [F.count_if((own > a) & (own <= b) if b else own > a).alias(f"band_{i}") for i, (a, b) in enumerate(zip(limits, (*limits[1:], None)))]
    return means.agg(rounded(F.avg(own)).alias("mean"), F.count(own).alias("stations"), *cut, rounded(F.avg(F.when(F.col("day") != day, F.col("v")))).alias("around"))


def cities_list(spark, sf_dir):
    """Cities with their stations, those that report, the latest value, the mean and its category, of two stations or more."""
    now = series.latest_by(_good(spark, sf_dir), ["station"], "ts", "pm25")
    rows = stations(spark, sf_dir).join(now, "station", "left").groupBy("city", "country")
    out = rows.agg(F.count("*").alias("stations"), F.count("pm25").alias("reporting"), F.max("ts").alias("latest"), rounded(F.avg("pm25")).alias("pm25"), rounded(F.avg("lat")).alias("lat"), rounded(F.avg("lon")).alias("lon")).where("reporting >= 2")
    return out.withColumn("category", category(index_of(F.col("pm25"), _points())))


def city_hourly_spine(spark, sf_dir):
    """Each city's hourly mean of the latest reading in the hour of every station, on a spine of all hours; hours without any stay."""
    rows = _good(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    last = series.latest_by(rows, ["station", "hour"], "ts", "pm25").join(stations(spark, sf_dir), "station").groupBy("city", "hour").agg(rounded(F.avg("pm25")).alias("pm25"), F.count("*").alias("stations"))
    hours = rows.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))
    spine = stations(spark, sf_dir).select("city").distinct().join(F.broadcast(hours))  # hours of the readings' range
    return spine.join(last, ["city", "hour"], "left").withColumn("aqi", index_of(F.col("pm25"), _points()))


def station_overview(spark, sf_dir):
    """Availability and means over one, seven and thirty days, and days above a limit, on which a day's mean may lie."""
    rows = _good(spark, sf_dir).where((F.col("ts") > _at(720)) & (F.col("ts") <= _at(0)))
    hours = rows.groupBy("station", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(exact_mean(F.col("pm25")).alias("v"))
    within = lambda h: F.col("hour") > _at(h)
    days = hours.groupBy("station", F.col("hour").cast("date").alias("day")).agg(exact_mean(F.col("v")).alias("d")).groupBy("station").agg(F.count_if(F.col("d") > 35).alias("days_above"), F.count("*").alias("days"))
    out = hours.groupBy("station").agg(*[rounded(F.avg(F.when(within(h), F.col("v")))).alias(f"mean_{n}") for h, n in ((24, "1d"), (168, "7d"), (720, "30d"))], rounded(F.count("*") / 720).alias("availability"))
    return out.join(days, "station")


def downsampled(spark, sf_dir):
    """Every station's series in as many seconds a bucket as keep it to 20 points, with means and extremes."""
    ends = readings(spark, sf_dir).groupBy("station").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    epoch = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    step = F.greatest(F.lit(1), F.ceil((epoch("b") - epoch("a") + 1) / 20))
    rows = readings(spark, sf_dir).join(ends.select("station", epoch("a").alias("a"), step.alias("step")), "station")
    bucket = F.floor((epoch("ts") - F.col("a")) / F.col("step"))
    return rows.groupBy("station", "step", bucket.alias("bucket")).agg(rounded(F.avg("pm25")).alias("pm25"), F.min("pm25").alias("low"), F.max("pm25").alias("high"), F.count("*").alias("n"))


def report_rows(spark, sf_dir):
    """Hourly rows of some cities' stations for a report, with duplicate names flagged, and whether more than the limit of 500 there are."""
    names = stations(spark, sf_dir).withColumn("name", F.when(F.col("station") % 50 == 0, F.lit("twin")).otherwise(F.col("name")))
    names = names.withColumn("twin", F.count("*").over(Window.partitionBy("city", "name")) > 1)
    hours = series.hourly(_good(spark, sf_dir), "station", "ts", "pm25").join(names.select("station", "name", "city", "twin"), "station")
    few = hours.orderBy("hour", "station").limit(501)  # one more than the limit shows that there are more
    n = Window.orderBy("hour", "station")
    ranked = few.withColumn("row", F.row_number().over(n)).withColumn("more", F.max("row").over(Window.partitionBy(F.lit(1))) > 500)
    return ranked.where("row <= 500").select("hour", "station", "name", "twin", "more", rounded("pm25").alias("pm25"))


def spelling_variants(spark, sf_dir):
    """City names that differ in case and signs only, as one, with what they sum to."""
    odd = F.when(F.col("station") % 3 == 0, F.upper("city")).when(F.col("station") % 3 == 1, F.regexp_replace("city", " ", "-")).otherwise(F.initcap("city"))
    rows = stations(spark, sf_dir).withColumn("spelled", odd)
    return rows.groupBy(F.regexp_replace(F.lower("spelled"), "[^a-z0-9]", "").alias("key")).agg(F.count_distinct("spelled").alias("spellings"), F.count("*").alias("stations"), F.min("spelled").alias("first"))


def first_last_seen(spark, sf_dir):
    """Every station with its first and last reading and what it is, also where it has none."""
    seen = readings(spark, sf_dir).groupBy("station").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.min_by("source", "ts").alias("first_source"), F.count("*").alias("n"))
    return stations(spark, sf_dir).select("station", "provider").join(seen, "station", "left")


def nearest_city(spark, sf_dir):
    """Stations without a city get the one whose centre is nearest; the others keep theirs."""
    rows = stations(spark, sf_dir)
    centres = rows.groupBy("city").agg(F.avg("lat").alias("lat2"), F.avg("lon").alias("lon2")).withColumnRenamed("city", "near")
    homeless = rows.where("station % 10 = 0").select("station", "lat", "lon")
    found = places.nearest(homeless, centres, "station", "near", 500.0, 1).select("station", "near", rounded("km", 3).alias("km"))
    return rows.select("station", F.when(F.col("station") % 10 != 0, F.col("city")).alias("city")).join(found, "station", "left").select("station", F.coalesce("city", "near").alias("city"), "km")


def reporting_providers(spark, sf_dir):
    """Providers with stations that report in the last day (semi join), and those that have none (anti join)."""
    recent = readings(spark, sf_dir).where(F.col("ts") > _at(24)).select("station")
    rows = stations(spark, sf_dir)
    some = rows.join(recent, "station", "left_semi").groupBy("provider").agg(F.count("*").alias("n")).withColumn("kind", F.lit("reporting"))
    return some.unionByName(rows.join(recent, "station", "left_anti").groupBy("provider").agg(F.count("*").alias("n")).withColumn("kind", F.lit("silent")))


def above_average(spark, sf_dir):
    """Stations whose latest value is above the mean of all (a scalar subquery) and of their city (a correlated one)."""
    now = series.latest_by(readings(spark, sf_dir), ["station"], "ts", "pm25").join(stations(spark, sf_dir), "station").select("station", "city", "pm25")
    every = now.agg(F.avg("pm25").alias("every"))
    cities = now.groupBy("city").agg(F.avg("pm25").alias("own"))
    rows = now.crossJoin(F.broadcast(every)).join(cities, "city")  # one row
    return rows.where("pm25 > every and pm25 > own").select("station", "city", "pm25", rounded("every").alias("every"), rounded("own").alias("own"))


def city_numbers(spark, sf_dir):
    """Dense numbers for cities by name; only the few names are ranked, and joined back."""
    names = stations(spark, sf_dir).select(F.coalesce("city", F.lit("Unknown")).alias("city")).distinct()
    return names.withColumn("number", F.dense_rank().over(Window.orderBy("city")).cast("long"))


def day_sets(spark, sf_dir):
    """Days by which kinds of reading have them: both, the first alone, the second alone."""
    day = lambda kind: readings(spark, sf_dir).where(F.col("source") == kind).where(f"weekday(ts) <> {len(kind) % 5}").select(F.col("ts").cast("date").alias("day")).distinct()
    a, b = day("view"), day("purchase")
    return a.intersect(b).withColumn("kind", F.lit("both")).union(a.exceptAll(b).withColumn("kind", F.lit("first"))).union(b.exceptAll(a).withColumn("kind", F.lit("second")))


def common_kind(spark, sf_dir):
    """The most frequent kind of reading of each city (the least name of equal ones), and whether any is invalid."""
    rows = readings(spark, sf_dir).join(stations(spark, sf_dir), "station").groupBy("city", "source").agg(F.count("*").alias("n"), F.bool_or(F.col("qc") == "INVALID").alias("bad"))
    return rows.groupBy("city").agg(F.min_by("source", F.struct(-F.col("n"), "source")).alias("kind"), F.max("n").alias("n"), F.bool_or("bad").alias("any_invalid"))


def histogram_map(spark, sf_dir):
    """Counts by band as one map a country."""
    now = series.latest_by(readings(spark, sf_dir), ["station"], "ts", "pm25").join(stations(spark, sf_dir), "station")
    counts = now.groupBy("country", category(index_of(F.col("pm25"), _points())).alias("band")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("band", "n")))  # seven bands at most
    return counts.groupBy("country").agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["band"], p["n"].cast("string"))), ";").alias("bands"))


def volatile_cities(spark, sf_dir):
    """Hours in which a city's mean moved by more than 30 against two hours before, or passed 90."""
    rows = _good(spark, sf_dir).join(stations(spark, sf_dir), "station").groupBy("city", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.avg("pm25").alias("pm25"))
    w = Window.partitionBy("city").orderBy("hour")
    rows = rows.withColumn("before", F.when(F.lag("hour", 2).over(w) == F.col("hour") - F.expr("interval 2 hours"), F.lag("pm25", 2).over(w)))
    flags = F.array_compact(F.array(F.when(F.abs(F.col("pm25") - F.col("before")) > 30, "volatile"), F.when(F.col("pm25") > 90, "hotspot")))
    return rows.withColumn("flags", F.array_join(flags, ";")).where("flags <> ''").select("city", "hour", rounded("pm25").alias("pm25"), rounded("before").alias("before"), "flags")


def prior_mean_test(spark, sf_dir):
    """Days on which a country's mean passes the mean of the three days before by half, today or yesterday."""
    days = _good(spark, sf_dir).join(stations(spark, sf_dir), "station").groupBy("country", F.col("ts").cast("date").alias("day")).agg(F.avg("pm25").alias("v"))
    w = Window.partitionBy("country").orderBy("day")
    prior = F.when(F.count("v").over(w.rowsBetween(-3, -1)) >= 2, F.avg("v").over(w.rowsBetween(-3, -1)))
    rows = days.withColumn("prior", prior).withColumn("up", F.coalesce(F.col("v") > 1.05 * F.col("prior"), F.lit(False)).cast("int"))
    return rows.withColumn("either", F.max("up").over(w.rowsBetween(-1, 0)) == 1).where("either").select("country", "day", rounded("v").alias("v"), rounded("prior").alias("prior"), (F.col("up") == 1).alias("today"))


def qc_neighbours(spark, sf_dir):
    """Stations beside the median of those within 60 km: the ratio, and the verdict on divergence."""
    means = _good(spark, sf_dir).groupBy("station").agg(F.avg("pm25").alias("v")).join(stations(spark, sf_dir).select("station", "lat", "lon"), "station")
    pairs = places.within_radius(means, means.select(F.col("station").alias("other"), F.col("v").alias("v2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), 60.0).where("station <> other")
    rows = pairs.groupBy("station").agg(F.max("v").alias("v"), F.median("v2").alias("median"), F.count("*").alias("neighbours")).where("neighbours >= 3")
    ratio = F.col("v") / F.col("median")
    return rows.select("station", rounded("v").alias("v"), rounded("median").alias("median"), "neighbours", F.when(ratio > 1.5, "high").when(ratio < 0.5, "low").otherwise("ok").alias("divergence"))


def nearest_with_latest(spark, sf_dir):
    """The three nearest active stations of each inactive one within 80 km, with their latest values."""
    rows = stations(spark, sf_dir)
    near = places.nearest(rows.where("not active").select("station", "lat", "lon"), rows.where("active").select(F.col("station").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "station", "other", 80.0, 3)
    now = series.latest_by(readings(spark, sf_dir), ["station"], "ts", "pm25").select(F.col("station").alias("other"), "ts", "pm25")
    return near.join(now, "other", "left").select("station", F.col("rank").cast("long").alias("rank"), "other", rounded("km", 3).alias("km"), "ts", "pm25")


def match_audit(spark, sf_dir):
    """What was ingested against what the provider says: match, value_mismatch, pending, stale."""
    rows = readings(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    ours = series.latest_by(rows.where("source <> 'signup'"), ["station"], "ts", "pm25").select("station", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ours_at"), F.col("pm25").alias("ours"))
    theirs = series.latest_by(rows.where("source <> 'view'"), ["station"], "ts", "pm25").select("station", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("theirs_at"), F.col("pm25").alias("theirs"))
    both = ours.join(theirs, "station", "full_outer")
    state = F.when(F.col("ours_at").isNull() | (F.col("ours_at") < F.col("theirs_at")), "pending").when(F.col("theirs_at").isNull() | (F.col("theirs_at") < F.col("ours_at")), "stale").when(F.abs(F.col("ours") - F.col("theirs")) <= 1e-9, "match").otherwise("value_mismatch")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("stations"))


def driver_shares(spark, sf_dir):
    """Shares of calm, fires and other causes in each city's day by two steps of its spread and mean alone; they sum to one.
    `causes.forecast_drivers` has the whole rule."""
    days = _good(spark, sf_dir).join(stations(spark, sf_dir), "station").groupBy("city", F.col("ts").cast("date").alias("day")).agg(F.avg("pm25").alias("v"), F.stddev_pop("pm25").alias("spread"), F.count("*").alias("n"))
    calm = F.when(F.col("spread") < 25, 0.5).when(F.col("spread") < 30, 0.3).otherwise(0.1)
    fire = F.when(F.col("v") > 60, 0.4).otherwise(0.1)
    rest = F.greatest(F.lit(0.1), 1 - calm - fire)
    total = calm + fire + rest
    return days.select("city", "day", rounded(calm / total).alias("calm"), rounded(fire / total).alias("fire"), rounded(rest / total).alias("other"))


def top_by(spark, sf_dir, column="pm25", descending=True):
    """The ten first cities by a column that callers may choose from a list."""
    allowed = {"pm25": "pm25", "stations": "stations", "city": "city"}
    if column not in allowed:
        raise ValueError(f"{column!r} is not one of {sorted(allowed)}")
    order = F.desc_nulls_last(allowed[column]) if descending else F.asc_nulls_first(allowed[column])
    return cities_list(spark, sf_dir).orderBy(order, "city").limit(10).select("city", "stations", "pm25")


QUERIES = {
    f.__name__: f
    for f in (
        city_detail, city_trend, snapshot, cities_list, city_hourly_spine, station_overview, downsampled, report_rows, spelling_variants, first_last_seen, nearest_city, reporting_providers, above_average, city_numbers, day_sets,
        common_kind, histogram_map, volatile_cities, prior_mean_test, qc_neighbours, nearest_with_latest, match_audit, driver_shares, top_by,
    )
} | {name: _stats(*args) for name, args in _SCOPES.items()}

_LATEST = "n AS (SELECT DISTINCT ON (station) station, ts, pm25 FROM r ORDER BY station, ts DESC)"
_LATEST_GOOD = "n AS (SELECT DISTINCT ON (station) station, ts, pm25 FROM r WHERE qc <> 'INVALID' ORDER BY station, ts DESC)"
_CITIES = f"{_LATEST_GOOD}, c AS (SELECT city, country, count(*) AS stations, count(pm25) AS reporting, max(ts) AS latest, round(avg(pm25), 4) AS pm25, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon FROM s LEFT JOIN n USING (station) GROUP BY ALL HAVING count(pm25) >= 2)"
_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))))"
ORACLE = {
    "city_detail": sql(f"""n AS (SELECT DISTINCT ON (station) station, ts, pm25 FROM r WHERE qc <> 'INVALID' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR ORDER BY station, ts DESC),
        t AS (SELECT city, station, ts, pm25, CASE WHEN ts >= TIMESTAMP '{AS_OF}' - INTERVAL 3 HOUR THEN 0 ELSE 1 END AS tier FROM s JOIN n USING (station)) SELECT *, row_number() OVER (PARTITION BY city ORDER BY tier, pm25 DESC, station) AS place FROM t"""),
    "city_trend": sql(f"SELECT city, date_trunc('hour', ts)::TIMESTAMP AS hour, round(avg(pm25), 4) AS pm25, count(DISTINCT station) AS stations FROM r JOIN s USING (station) WHERE qc <> 'INVALID' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{AS_OF}' GROUP BY ALL"),
    "snapshot": sql("""m AS (SELECT station, ts::DATE AS day, avg(pm25) AS v FROM r WHERE qc <> 'INVALID' AND ts::DATE BETWEEN DATE '2024-01-12' AND DATE '2024-01-18' GROUP BY ALL), ow AS (SELECT *, CASE WHEN day = DATE '2024-01-15' THEN v END AS own FROM m)
        SELECT round(avg(own), 4) AS mean, count(own) AS stations, count(*) FILTER (own > -1 AND own <= 9) AS band_0, count(*) FILTER (own > 9 AND own <= 35.4) AS band_1, count(*) FILTER (own > 35.4 AND own <= 55.4) AS band_2, count(*) FILTER (own > 55.4 AND own <= 125.4) AS band_3,
               count(*) FILTER (own > 125.4 AND own <= 225.4) AS band_4, count(*) FILTER (own > 225.4) AS band_5, round(avg(v) FILTER (day <> DATE '2024-01-15'), 4) AS around FROM ow"""),
    "cities_list": sql(f"{_CITIES} SELECT *, {_CATEGORY.format(i=f'({_index_sql("pm25")})')} AS category FROM c"),
    "city_hourly_spine": sql(f"""l AS (SELECT DISTINCT ON (station, date_trunc('hour', ts)) station, date_trunc('hour', ts)::TIMESTAMP AS hour, pm25 FROM r WHERE qc <> 'INVALID' ORDER BY station, date_trunc('hour', ts), ts DESC),
        m AS (SELECT city, hour, round(avg(pm25), 4) AS pm25, count(*) AS stations FROM l JOIN s USING (station) GROUP BY ALL), k AS (SELECT city, unnest(generate_series((SELECT min(hour) FROM l), (SELECT max(hour) FROM l), INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT city FROM s))
        SELECT city, hour, pm25, stations, {_index_sql("pm25")} AS aqi FROM k LEFT JOIN m USING (city, hour)"""),
    "station_overview": sql(f"""h AS (SELECT station, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(pm25) AS v FROM r WHERE qc <> 'INVALID' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR AND ts <= TIMESTAMP '{AS_OF}' GROUP BY ALL),
        d AS (SELECT station, count(*) FILTER (d > 35) AS days_above, count(*) AS days FROM (SELECT station, hour::DATE AS day, avg(v) AS d FROM h GROUP BY ALL) GROUP BY station)
        SELECT station, round(avg(v) FILTER (hour > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR), 4) AS mean_1d, round(avg(v) FILTER (hour > TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR), 4) AS mean_7d, round(avg(v) FILTER (hour > TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR), 4) AS mean_30d, round(count(*) / 720, 4) AS availability,
               any_value(days_above) AS days_above, any_value(days) AS days FROM h JOIN d USING (station) GROUP BY station"""),
    "downsampled": sql("""e AS (SELECT station, floor(epoch(min(ts)))::BIGINT AS a, greatest(1, ceil((floor(epoch(max(ts))) - floor(epoch(min(ts))) + 1) / 20))::BIGINT AS step FROM r GROUP BY station)
        SELECT station, step, ((floor(epoch(ts))::BIGINT - a) // step)::BIGINT AS bucket, round(avg(pm25), 4) AS pm25, min(pm25) AS low, max(pm25) AS high, count(*) AS n FROM r JOIN e USING (station) GROUP BY ALL"""),
    "report_rows": sql("""nm AS (SELECT station, city, CASE WHEN station % 50 = 0 THEN 'twin' ELSE name END AS name FROM s), tw AS (SELECT *, count(*) OVER (PARTITION BY city, name) > 1 AS twin FROM nm),
        h AS (SELECT station, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(pm25) AS pm25 FROM r WHERE qc <> 'INVALID' GROUP BY ALL), j AS (SELECT hour, station, name, twin, pm25, count(*) OVER () > 500 AS more FROM h JOIN tw USING (station))
        SELECT hour, station, name, twin, more, round(pm25, 4) AS pm25 FROM j ORDER BY hour, station LIMIT 500"""),
    "spelling_variants": sql("""v AS (SELECT CASE station % 3 WHEN 0 THEN upper(city) WHEN 1 THEN replace(city, ' ', '-') ELSE array_to_string(list_transform(string_split(lower(city), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS spelled FROM s)
        SELECT regexp_replace(lower(spelled), '[^a-z0-9]', '', 'g') AS key, count(DISTINCT spelled) AS spellings, count(*) AS stations, min(spelled) AS first FROM v GROUP BY ALL"""),
    "first_last_seen": sql("SELECT s.station, provider, f.first, f.last, first_source, n FROM s LEFT JOIN LATERAL (SELECT min(ts) AS first, max(ts) AS last, arg_min(source, ts) AS first_source, nullif(count(*), 0) AS n FROM r WHERE r.station = s.station) f ON true"),
    "nearest_city": sql(f"""c AS (SELECT city AS near, avg(lat) AS lat2, avg(lon) AS lon2 FROM s GROUP BY city), d AS (SELECT station, near, {_KM} AS km FROM s, c WHERE station % 10 = 0 AND {_KM} <= 500), b AS (SELECT DISTINCT ON (station) * FROM d ORDER BY station, km, near)
        SELECT s.station, CASE WHEN s.station % 10 <> 0 THEN city ELSE near END AS city, round(km + 1e-9, 3) AS km FROM s LEFT JOIN b USING (station)"""),
    "reporting_providers": sql(f"SELECT provider, count(*) AS n, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.station = s.station AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) THEN 'reporting' ELSE 'silent' END AS kind FROM s GROUP BY ALL"),
    "above_average": sql(f"{_LATEST}, j AS (SELECT station, city, pm25 FROM n JOIN s USING (station)) SELECT station, city, pm25, round((SELECT avg(pm25) FROM j), 4) AS every, round((SELECT avg(pm25) FROM j k WHERE k.city = j.city), 4) AS own FROM j WHERE pm25 > (SELECT avg(pm25) FROM j) AND pm25 > (SELECT avg(pm25) FROM j k WHERE k.city = j.city)"),
    "city_numbers": sql("SELECT DISTINCT city, dense_rank() OVER (ORDER BY city) AS number FROM s"),
    "day_sets": sql("""a AS (SELECT DISTINCT ts::DATE AS day FROM r WHERE source = 'view' AND isodow(ts) - 1 <> 4), b AS (SELECT DISTINCT ts::DATE AS day FROM r WHERE source = 'purchase' AND isodow(ts) - 1 <> 3)
        SELECT coalesce(a.day, b.day) AS day, CASE WHEN b.day IS NULL THEN 'first' WHEN a.day IS NULL THEN 'second' ELSE 'both' END AS kind FROM a FULL JOIN b ON a.day = b.day"""),
    "common_kind": sql("c AS (SELECT city, source, count(*) AS n, bool_or(qc = 'INVALID') AS bad FROM r JOIN s USING (station) GROUP BY ALL) SELECT city, arg_min(source, (-n, source)) AS kind, max(n) AS n, bool_or(bad) AS any_invalid FROM c GROUP BY city"),
    "histogram_map": sql(f"{_LATEST}, c AS (SELECT country, {_CATEGORY.format(i=f'({_index_sql("pm25")})')} AS band, count(*) AS n FROM n JOIN s USING (station) GROUP BY ALL) SELECT country, string_agg(band || '=' || n, ';' ORDER BY band) AS bands FROM c GROUP BY country"),
    "volatile_cities": sql("""h AS (SELECT city, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(pm25) AS pm25 FROM r JOIN s USING (station) WHERE qc <> 'INVALID' GROUP BY ALL),
        l AS (SELECT *, CASE WHEN lag(hour, 2) OVER w = hour - INTERVAL 2 HOUR THEN lag(pm25, 2) OVER w END AS before FROM h WINDOW w AS (PARTITION BY city ORDER BY hour)),
        fl AS (SELECT *, concat_ws(';', CASE WHEN abs(pm25 - before) > 30 THEN 'volatile' END, CASE WHEN pm25 > 90 THEN 'hotspot' END) AS flags FROM l) SELECT city, hour, round(pm25, 4) AS pm25, round(before, 4) AS before, flags FROM fl WHERE flags <> ''"""),
    "prior_mean_test": sql("""d AS (SELECT country, ts::DATE AS day, avg(pm25) AS v FROM r JOIN s USING (station) WHERE qc <> 'INVALID' GROUP BY ALL),
        p AS (SELECT *, CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END AS prior FROM d WINDOW w AS (PARTITION BY country ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
        u AS (SELECT *, coalesce(v > 1.05 * prior, false) AS up FROM p), e AS (SELECT *, up OR coalesce(lag(up) OVER (PARTITION BY country ORDER BY day), false) AS either FROM u) SELECT country, day, round(v, 4) AS v, round(prior, 4) AS prior, up AS today FROM e WHERE either"""),
    "qc_neighbours": sql(f"""m AS (SELECT station, avg(pm25) AS v FROM r WHERE qc <> 'INVALID' GROUP BY station), j AS (SELECT station, v, lat, lon FROM m JOIN s USING (station)), p AS (SELECT a.station, a.v, b.v AS v2, lat, lon, lat2, lon2 FROM j a, (SELECT station AS other, v, lat AS lat2, lon AS lon2 FROM j) b WHERE a.station <> b.other),
        g AS (SELECT station, max(v) AS v, median(v2) AS median, count(*) AS neighbours FROM p WHERE {_KM} <= 60 GROUP BY station HAVING count(*) >= 3)
        SELECT station, round(v, 4) AS v, round(median, 4) AS median, neighbours, CASE WHEN v / median > 1.5 THEN 'high' WHEN v / median < 0.5 THEN 'low' ELSE 'ok' END AS divergence FROM g"""),
    "nearest_with_latest": sql(f"""{_LATEST}, p AS (SELECT a.station, other, {_KM} AS km FROM s a, (SELECT station AS other, lat AS lat2, lon AS lon2 FROM s WHERE active) b WHERE NOT a.active), q AS (SELECT station, row_number() OVER (PARTITION BY station ORDER BY km, other) AS rank, other, km FROM p WHERE km <= 80)
        SELECT q.station, rank, other, round(km + 1e-9, 3) AS km, ts, pm25 FROM q LEFT JOIN n ON n.station = other WHERE rank <= 3"""),
    "match_audit": sql("""a AS (SELECT DISTINCT ON (station) station, date_trunc('hour', ts) AS ours_at, pm25 AS ours FROM r WHERE source <> 'signup' ORDER BY station, ts DESC), b AS (SELECT DISTINCT ON (station) station, date_trunc('hour', ts) AS theirs_at, pm25 AS theirs FROM r WHERE source <> 'view' ORDER BY station, ts DESC)
        SELECT CASE WHEN ours_at IS NULL OR ours_at < theirs_at THEN 'pending' WHEN theirs_at IS NULL OR theirs_at < ours_at THEN 'stale' WHEN abs(ours - theirs) <= 1e-9 THEN 'match' ELSE 'value_mismatch' END AS state, count(*) AS stations FROM a FULL JOIN b ON a.station = b.station GROUP BY ALL"""),
    "driver_shares": sql("""d AS (SELECT city, ts::DATE AS day, avg(pm25) AS v, stddev_pop(pm25) AS spread FROM r JOIN s USING (station) WHERE qc <> 'INVALID' GROUP BY ALL),
        c AS (SELECT city, day, CASE WHEN spread < 25 THEN 0.5 WHEN spread < 30 THEN 0.3 ELSE 0.1 END::DOUBLE AS calm, CASE WHEN v > 60 THEN 0.4 ELSE 0.1 END::DOUBLE AS fire FROM d), t AS (SELECT *, greatest(0.1::DOUBLE, 1 - calm - fire) AS rest FROM c)
        SELECT city, day, round(calm / (calm + fire + rest), 4) AS calm, round(fire / (calm + fire + rest), 4) AS fire, round(rest / (calm + fire + rest), 4) AS other FROM t"""),
    "top_by": sql(f"{_CITIES} SELECT city, stations, pm25 FROM c ORDER BY pm25 DESC NULLS LAST, city LIMIT 10"),
} | {name: _stats_sql(*args) for name, args in _SCOPES.items()}
