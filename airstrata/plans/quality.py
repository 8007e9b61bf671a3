"""Products of screening: field bounds, flags and states, spikes, stuck hours, episodes, outages, outliers, daily publish."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import rounded
from ..operators import screening, series
from ..sources.tables import SIGNAL, WIDE, signal, sql, wide_readings

FIELDS = ["pm25", "pm10", "no2", "humidity", "temp_c", "wind_speed_ms", "wind_dir_deg"]


def validated(spark, sf_dir):
    """Every reading with impossible values quarantined field by field."""
    rows = screening.quarantined(wide_readings(spark, sf_dir), FIELDS)
    return rows.select("id", *[rounded(f).alias(f) for f in FIELDS], F.array_join("flags", ";").alias("flags"), F.array_join("present", ";").alias("present"), "state")


def merge_states(spark, sf_dir):
    """Stored states and flags of readings that meet the next reading of their station."""
    rows = screening.quarantined(wide_readings(spark, sf_dir), FIELDS)
    w = Window.partitionBy("station").orderBy("ts", "id")
    rows = rows.withColumn("new", F.lead("flags").over(w)).withColumn("now", F.lead("present").over(w)).where("new is not null")
    state = F.when(F.col("id") % 5 == 0, "OK").when(F.col("id") % 11 == 0, "INVALID").otherwise(F.col("state"))
    old = F.when((F.col("id") % 5 != 0) & (F.col("id") % 11 == 0), F.array_union("flags", F.array(F.lit("pm25_oor")))).otherwise(F.col("flags"))
    merged = screening.merged_flags(state, old, F.col("new"), F.col("now"))
    return rows.select("id", merged.alias("m")).select("id", "m.state", F.array_join("m.flags", ";").alias("flags"))


def instrument_qc(spark, sf_dir):
    flags = screening.instrument_flags(*[F.col(c) for c in ("pm25", "humidity", "temp_c", "pressure_kpa", "wind_speed_ms")])
    rows = wide_readings(spark, sf_dir).withColumn("pm25", F.when(F.col("id") % 97 == 0, 999.0).when(F.col("id") % 101 != 0, F.col("pm25")))
    return rows.withColumn("f", flags).select("id", F.array_join("f", ";").alias("flags"), screening.instrument_state(F.col("f")).alias("state"))


def units_attested(spark, sf_dir):
    """Units only where a provider attests them and a value is there."""
    units = {"view": {"pm25": "ug/m3", "pm10": "ug/m3"}, "click": {"pm25": "ug/m3"}}
    unit = lambda f: F.when(F.col(f).isNotNull(), F.coalesce(*[F.when(F.col("provider") == p, F.lit(u.get(f))) for p, u in units.items()]))
    return wide_readings(spark, sf_dir).groupBy("provider", unit("pm25").alias("units_pm25"), unit("pm10").alias("units_pm10")).agg(F.count("*").alias("n"))


def _screened(spark, sf_dir):
    rows = series.spikes(series.bounded(signal(spark, sf_dir), "pm25"), "station", "hour", "pm25")
    rows = rows.withColumn("pm25", F.when(~F.col("spike"), F.col("pm25")))
    return series.stuck(rows, "station", "hour", "pm25")


def screened_hours(spark, sf_dir):
    """What screening does to each site's hours: impossible values, then spikes, then runs of 18 equal hours."""
    return _screened(spark, sf_dir).groupBy("station").agg(F.count("*").alias("hours"), F.count_if("spike").alias("spikes"), F.count_if("stuck").alias("stuck"), F.count(F.when(~F.col("stuck"), F.col("pm25"))).alias("good"))


def daily_publish(spark, sf_dir):
    """Daily means of screened hours, with median, 95th percentile, valid hours and completeness (18 hours)."""
    rows = _screened(spark, sf_dir).withColumn("v", F.when(~F.col("stuck"), F.col("pm25")))
    days = rows.groupBy("station", F.col("hour").cast("date").alias("date"))
    # 24 hours a group: exact percentiles of a day are bounded.
    return days.agg(
        rounded(F.avg("v")).alias("pm25_mean"), F.max("v").alias("pm25_max"), rounded(F.median("v")).alias("pm25_median"), rounded(F.percentile("v", F.lit(0.95))).alias("pm25_p95"),
        F.count("v").alias("pm25_valid_hours"), (F.count("v") >= 18).alias("pm25_complete"), F.min_by("group", "hour").alias("group"),
    )


def _sessions(rows):
    w = Window.partitionBy("station").orderBy("hour")
    return series.islands(rows, "station", "hour", F.col("hour") - F.lag("hour").over(w) > F.expr("interval 2 hours"))


def episodes(spark, sf_dir):
    """Hours above 250 in runs with gaps of two hours at most, of three readings or more, with peak and severity."""
    runs = _sessions(signal(spark, sf_dir).where("pm25 > 250 and pm25 <= 900")).groupBy("station", "run")
    rows = runs.agg(F.min("hour").alias("begins"), F.max("hour").alias("ends"), F.count("*").alias("readings"), F.max("pm25").alias("peak"), F.min_by("hour", F.struct(-F.col("pm25"), "hour")).alias("peak_at")).where("readings >= 3")
    return rows.select("station", "begins", "ends", "readings", "peak", "peak_at", rounded(F.least(F.lit(1.0), (F.col("peak") - 250) / 50)).alias("severity"))


def day_episodes(spark, sf_dir):
    """Days whose mean is above 150, in runs of consecutive days."""
    days = signal(spark, sf_dir).groupBy("station", F.col("hour").cast("date").alias("day")).agg(F.avg("pm25").alias("mean")).where("mean > 150")
    w = Window.partitionBy("station").orderBy("day")
    runs = series.islands(days, "station", "day", F.datediff("day", F.lag("day").over(w)) > 1).groupBy("station", "run")
    return runs.agg(F.min("day").alias("begins"), F.max("day").alias("ends"), F.count("*").alias("days"), rounded(F.max("mean")).alias("peak")).drop("run")


def offline_runs(spark, sf_dir):
    """Runs of three hours or more without a usable value; each ends at the next hour that has one."""
    gone = signal(spark, sf_dir).withColumn("off", F.col("pm25").isNull() | (F.col("h") % (40 + F.col("station") % 7) < 4))
    w = Window.partitionBy("station").orderBy("hour")
    runs = series.islands(gone, "station", "hour", F.col("off") != F.lag("off").over(w)).where("off").groupBy("station", "run")
    rows = runs.agg(F.min("hour").alias("begins"), (F.max("hour") + F.expr("interval 1 hour")).alias("ends"), F.count("*").alias("hours")).where("hours >= 3")
    return rows.drop("run")


def flat_lines(spark, sf_dir):
    """Anchored flat lines of six hours or more; the anchor moves with each run, which no window expresses."""
    rows = signal(spark, sf_dir).withColumn("low", F.col("pm25") + (F.col("h") % 3) / 4).withColumn("high", F.col("pm25") + 0.5)
    return screening.anchored_flat_lines(rows, "station", "hour", "low", "high")


def city_outliers(spark, sf_dir):
    """Site-days above three times their group's median of the day and above 50, in groups of three sites or more."""
    days = signal(spark, sf_dir).groupBy("group", "station", F.col("hour").cast("date").alias("day")).agg(F.avg(F.when(F.col("station") % 9 == 0, F.col("pm25") * 6).otherwise(F.col("pm25"))).alias("pm25"))
    middle = days.groupBy("group", "day").agg(F.median("pm25").alias("median"), F.count("pm25").alias("sites")).where("sites >= 3")
    rows = days.join(middle, ["group", "day"]).where("pm25 > 3 * median and pm25 > 50")
    return rows.select("group", "station", "day", rounded("pm25").alias("pm25"), rounded("median").alias("median"))


def three_level_mean(spark, sf_dir):
    """Hours to site-days of 18 hours or more, to group-days, to the group's mean and its spread over days."""
    sites = signal(spark, sf_dir).groupBy("group", "station", F.col("hour").cast("date").alias("day")).agg(F.avg("pm25").alias("v"), F.count("pm25").alias("n")).where("n >= 18")
    days = sites.groupBy("group", "day").agg(F.avg("v").alias("v"), F.count("*").alias("sites"))
    return days.groupBy("group").agg(rounded(F.avg("v")).alias("mean"), rounded(F.stddev_pop("v")).alias("spread"), F.sum("sites").alias("site_days"), F.count("*").alias("days"))


def qc_summary(spark, sf_dir):
    """Flags kept beside the values: shares of hours by flag and the flags of each hour as one string."""
    rows = signal(spark, sf_dir).withColumn("sentinel", F.col("pm25").isin(*series.SENTINELS))
    rows = series.stuck(series.spikes(rows, "station", "hour", "pm25"), "station", "hour", "pm25")
    names = ["sentinel", "spike", "stuck"]
    flags = F.array_join(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in names])), ";")
    return rows.groupBy(flags.alias("flags")).agg(F.count("*").alias("hours"), F.count_distinct("station").alias("sites"), rounded(F.avg("pm25")).alias("mean"))


QUERIES = {f.__name__: f for f in (validated, merge_states, instrument_qc, units_attested, screened_hours, daily_publish, episodes, day_episodes, offline_runs, flat_lines, city_outliers, three_level_mean, qc_summary)}


def _fault_sql(f):
    least, most = screening.BOUNDS[f]
    return f"CASE WHEN {f} < {least} THEN '{'negative' if least == 0 else 'below_min'}' WHEN {f} > {most} THEN 'above_max' END"


_V = f"""{WIDE.strip()},
v0 AS (SELECT *, {', '.join(f'{_fault_sql(f)} AS b_{f}' for f in FIELDS)} FROM x),
v AS (SELECT id, station, ts, provider, {', '.join(f'CASE WHEN b_{f} IS NULL THEN {f} END AS {f}' for f in FIELDS)},
      list_sort(list_filter([{', '.join(f"'v:{f}:' || b_{f}" for f in FIELDS)}], lambda y: y IS NOT NULL)) AS flags,
      list_filter([{', '.join(f"CASE WHEN b_{f} IS NULL AND {f} IS NOT NULL THEN '{f}' END" for f in FIELDS)}], lambda y: y IS NOT NULL) AS present FROM v0),
vs AS (SELECT *, CASE WHEN len(list_filter(flags, lambda y: y LIKE 'v:pm25:%')) > 0 THEN 'INVALID' ELSE 'raw' END AS state FROM v)"""
_Q = f"""{SIGNAL.strip()},
b0 AS (SELECT station, "group", hour, h, CASE WHEN pm25 NOT IN (-1, 999, 1000) AND pm25 BETWEEN 0 AND 1000 THEN pm25 END AS pm25 FROM q),
b1 AS (SELECT *, lag(pm25) OVER w AS p1, lag(pm25, 2) OVER w AS p2, lead(pm25) OVER w AS n1 FROM b0 WINDOW w AS (PARTITION BY station ORDER BY hour)),
b2 AS (SELECT *, coalesce(abs(pm25 - p1) > 250 AND abs(n1 - p1) <= 1, false) AS one, coalesce(abs(p1 - p2) > 250 AND abs(pm25 - p2) > 250 AND abs(n1 - p2) <= 1, false) AS two FROM b1),
b3 AS (SELECT *, one OR two OR coalesce(lead(two) OVER (PARTITION BY station ORDER BY hour), false) AS spike FROM b2),
b4 AS (SELECT station, "group", hour, h, spike, CASE WHEN NOT spike THEN pm25 END AS pm25 FROM b3),
b5 AS (SELECT *, (pm25 IS DISTINCT FROM lag(pm25) OVER w OR pm25 IS NULL)::INT AS fresh FROM b4 WINDOW w AS (PARTITION BY station ORDER BY hour)),
b6 AS (SELECT *, sum(fresh) OVER (PARTITION BY station ORDER BY hour) AS run FROM b5),
b7 AS (SELECT *, pm25 IS NOT NULL AND count(pm25) OVER (PARTITION BY station, run) >= 18 AS stuck FROM b6)"""
_S = SIGNAL.strip()
ORACLE = {
    "validated": sql(f"{_V} SELECT id, {', '.join(f'round({f}, 4) AS {f}' for f in FIELDS)}, array_to_string(flags, ';') AS flags, array_to_string(present, ';') AS present, state FROM vs"),
    "merge_states": sql(f"""{_V}, a AS (SELECT *, lead(flags) OVER w AS new, lead(present) OVER w AS now FROM vs WINDOW w AS (PARTITION BY station ORDER BY ts, id)),
        b AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'OK' WHEN id % 11 = 0 THEN 'INVALID' ELSE state END AS st, CASE WHEN id % 5 <> 0 AND id % 11 = 0 THEN list_append(flags, 'pm25_oor') ELSE flags END AS old, new, now FROM a WHERE new IS NOT NULL),
        c AS (SELECT id, st, st = 'OK' OR (st = 'INVALID' AND list_contains(old, 'pm25_oor')) AS keep, list_sort(list_distinct(list_concat(old, new))) AS every,
              list_sort(list_distinct(list_concat(list_filter(old, lambda f: NOT (f LIKE 'v:%' AND list_contains(now, split_part(f, ':', 2)))), new))) AS remaining FROM b)
        SELECT id, CASE WHEN keep THEN st WHEN len(list_filter(remaining, lambda f: f LIKE 'v:pm25:%')) > 0 THEN 'INVALID' ELSE 'raw' END AS state, array_to_string(CASE WHEN keep THEN every ELSE remaining END, ';') AS flags FROM c"""),
    "instrument_qc": sql(f"""{WIDE.strip()}, y AS (SELECT * REPLACE (CASE WHEN id % 97 = 0 THEN 999.0 WHEN id % 101 <> 0 THEN pm25 END AS pm25) FROM x),
        z AS (SELECT id, CASE WHEN pm25 IS NULL THEN 'pm25_missing' WHEN pm25 IN (-1, 999, 1000) THEN 'pm25_sentinel' WHEN pm25 < 0 OR pm25 > 1000 THEN 'pm25_oor' END AS m, * FROM y)
        SELECT id, concat_ws(';', m, CASE WHEN humidity > 90 THEN 'high_rh' END, CASE WHEN humidity < 0 OR humidity > 100 THEN 'humidity_oor' END, CASE WHEN temp_c < -60 OR temp_c > 80 THEN 'temp_oor' END,
               CASE WHEN pressure_kpa < 50 OR pressure_kpa > 120 THEN 'pressure_oor' END, CASE WHEN wind_speed_ms < 0 OR wind_speed_ms > 150 THEN 'wind_oor' END) AS flags, CASE WHEN m IS NULL THEN 'OK' ELSE 'INVALID' END AS state FROM z"""),
    "units_attested": sql(f"""{WIDE.strip()} SELECT provider, CASE WHEN pm25 IS NOT NULL AND provider IN ('view', 'click') THEN 'ug/m3' END AS units_pm25,
        CASE WHEN pm10 IS NOT NULL AND provider = 'view' THEN 'ug/m3' END AS units_pm10, count(*) AS n FROM x GROUP BY ALL"""),
    "screened_hours": sql(f"{_Q} SELECT station, count(*) AS hours, count(*) FILTER (spike) AS spikes, count(*) FILTER (stuck) AS stuck, count(CASE WHEN NOT stuck THEN pm25 END) AS good FROM b7 GROUP BY station"),
    "daily_publish": sql(f"""{_Q}, c0 AS (SELECT *, CASE WHEN NOT stuck THEN pm25 END AS v FROM b7)
        SELECT station, hour::DATE AS date, round(avg(v), 4) AS pm25_mean, max(v) AS pm25_max, round(median(v), 4) AS pm25_median, round(quantile_cont(v, 0.95), 4) AS pm25_p95, count(v) AS pm25_valid_hours, count(v) >= 18 AS pm25_complete, min("group") AS "group" FROM c0 GROUP BY ALL"""),
    "episodes": sql(f"""{_S}, a AS (SELECT *, coalesce((hour - lag(hour) OVER (PARTITION BY station ORDER BY hour) > INTERVAL 2 HOUR)::INT, 1) AS b FROM q WHERE pm25 > 250 AND pm25 <= 900),
        c AS (SELECT *, sum(b) OVER (PARTITION BY station ORDER BY hour) AS run FROM a),
        e AS (SELECT station, min(hour) AS begins, max(hour) AS ends, count(*) AS readings, max(pm25) AS peak, min(hour) FILTER (pm25 = m) AS peak_at FROM (SELECT *, max(pm25) OVER (PARTITION BY station, run) AS m FROM c) GROUP BY station, run)
        SELECT *, round(least(1.0, (peak - 250) / 50), 4) AS severity FROM e WHERE readings >= 3"""),
    "day_episodes": sql(f"""{_S}, d AS (SELECT station, hour::DATE AS day, avg(pm25) AS mean FROM q GROUP BY ALL HAVING avg(pm25) > 150),
        i AS (SELECT *, day - row_number() OVER (PARTITION BY station ORDER BY day)::INT AS run FROM d)
        SELECT station, min(day) AS begins, max(day) AS ends, count(*) AS days, round(max(mean), 4) AS peak FROM i GROUP BY station, run"""),
    "offline_runs": sql(f"""{_S}, a AS (SELECT *, pm25 IS NULL OR h % (40 + station % 7) < 4 AS off FROM q),
        b AS (SELECT *, h - row_number() OVER (PARTITION BY station, off ORDER BY h) AS run FROM a)
        SELECT station, min(hour) AS begins, max(hour) + INTERVAL 1 HOUR AS ends, count(*) AS hours FROM b WHERE off GROUP BY station, run HAVING count(*) >= 3"""),
    "city_outliers": sql(f"""{_S}, d AS (SELECT "group", station, hour::DATE AS day, avg(CASE WHEN station % 9 = 0 THEN pm25 * 6 ELSE pm25 END) AS pm25 FROM q GROUP BY ALL),
        m AS (SELECT "group", day, median(pm25) AS median FROM d GROUP BY ALL HAVING count(pm25) >= 3)
        SELECT "group", station, day, round(pm25, 4) AS pm25, round(median, 4) AS median FROM d JOIN m USING ("group", day) WHERE pm25 > 3 * median AND pm25 > 50"""),
    "three_level_mean": sql(f"""{_S}, d AS (SELECT "group", station, hour::DATE AS day, avg(pm25) AS v FROM q GROUP BY ALL HAVING count(pm25) >= 18), e AS (SELECT "group", day, avg(v) AS v, count(*) AS sites FROM d GROUP BY ALL)
        SELECT "group", round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS spread, sum(sites)::BIGINT AS site_days, count(*) AS days FROM e GROUP BY "group" """),
    "qc_summary": sql(f"""{_S}, b1 AS (SELECT *, lag(pm25) OVER w AS p1, lag(pm25, 2) OVER w AS p2, lead(pm25) OVER w AS n1 FROM q WINDOW w AS (PARTITION BY station ORDER BY hour)),
        b2 AS (SELECT *, coalesce(abs(pm25 - p1) > 250 AND abs(n1 - p1) <= 1, false) AS one, coalesce(abs(p1 - p2) > 250 AND abs(pm25 - p2) > 250 AND abs(n1 - p2) <= 1, false) AS two FROM b1),
        b3 AS (SELECT *, one OR two OR coalesce(lead(two) OVER (PARTITION BY station ORDER BY hour), false) AS spike, (pm25 IS NULL OR pm25 IS DISTINCT FROM p1)::INT AS fresh FROM b2),
        b4 AS (SELECT *, sum(fresh) OVER (PARTITION BY station ORDER BY hour) AS run FROM b3), b5 AS (SELECT *, pm25 IS NOT NULL AND count(pm25) OVER (PARTITION BY station, run) >= 18 AS stuck FROM b4)
        SELECT concat_ws(';', CASE WHEN pm25 IN (-1, 999, 1000) THEN 'sentinel' END, CASE WHEN spike THEN 'spike' END, CASE WHEN stuck THEN 'stuck' END) AS flags, count(*) AS hours, count(DISTINCT station) AS sites, round(avg(pm25), 4) AS mean FROM b5 GROUP BY ALL"""),
}
