"""Products from stores that are kept: arrays in tiles, running sums, rollups by what changed, readings laid out for joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import tables
from ..functions.exprs import rounded
from ..operators import windows
from ..session import shared_dir, staged, table
from ..sources import arrays, layout, rollups, versions
from ..sources.tables import readings, sql, stations
from .fire_days import _W

#: Share of a day's usual detections from which it is assessable, and days of a window of findings.
ASSESSABLE, WINDOW_DAYS = 0.6, 14
#: Rows of vectors that make up one time of the array, cells of a block, and a value of no data.
ROWS_A_TIME, BLOCK, NO_DATA = 60, (20, 16), 0.25


def _array(spark, sf_dir):
    """The embeddings as an array: sixty vectors a time, a row each, a column a dimension; large values are no data."""
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(v, F.posexplode("embedding").alias("col", "value"))
    return rows.select((F.floor(v / ROWS_A_TIME) * 10).alias("time"), (v % ROWS_A_TIME).alias("row"), "col", F.when(F.abs("value") <= NO_DATA, F.col("value").cast("double")).alias("value"))


def _tiles(spark, sf_dir):
    path = f"{shared_dir(spark)}/airstrata/tiles-{uuid.uuid4().hex}"
    arrays.write_tiles(_array(spark, sf_dir), path, 32)
    return path


def array_blocks(spark, sf_dir):
    """Means of blocks of the whole array, and how many of their cells are known."""
    rows = arrays.block_means(arrays.read_tiles(spark, _tiles(spark, sf_dir)), *BLOCK)
    return rows.select("time", "by", "bx", rounded("mean", 6).alias("mean"), "n_valid", "n")


def array_slice(spark, sf_dir):
    """The window of the array at the stored time that is nearest to 27: rows 5 to 20, columns 30 to 50."""
    rows = arrays.nearest_slice(spark, _tiles(spark, sf_dir), 27, (5, 20), (30, 50))
    return rows.select("time", "row", "col", rounded("value", 6).alias("value"))


def _region_days(spark, sf_dir):
    """Days of each nation's detections: mean power, coverage against its usual count, whether assessable, and what is
    normal for the month."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("region")), F.col("l_suppkey") == F.col("s_suppkey"))
    days = rows.groupBy("region", F.col("l_shipdate").cast("date").alias("day")).agg(F.avg("l_quantity").alias("value"), F.count("*").alias("n"))
    usual = days.groupBy("region").agg(F.avg("n").alias("usual"))
    normal = days.groupBy("region", F.month("day").alias("month")).agg(F.avg("value").alias("expected"))
    days = days.join(usual, "region").withColumn("coverage", F.least(F.lit(1.0), F.col("n") / F.col("usual"))).withColumn("ok", F.col("coverage") >= ASSESSABLE)
    return days.join(normal, (days.region == normal.region) & (F.month("day") == normal.month)).select(days.region, "day", "value", "coverage", "ok", "expected")


_SUMS = ["days", "assessable", "value", "expected", "coverage"]


def _running(spark, sf_dir):
    ok = F.col("ok")
    sums = {"days": F.lit(1), "assessable": ok.cast("int"), "value": F.when(ok, F.col("value")), "expected": F.when(ok, F.col("expected")), "coverage": F.col("coverage")}
    return staged(windows.running_sums(_region_days(spark, sf_dir), "region", "day", sums, F.lit(True)), "running-sums")


def _summary(rows):
    mean = F.try_divide("value", "assessable")
    return rows.withColumns({"mean": mean, "percent": 100 * F.try_divide(mean, F.try_divide("expected", "assessable"))})


def region_windows(spark, sf_dir):
    """A window of days for every order, up to two months long: days with data and assessable ones, mean, percent of what
    is normal, and the last day with data, each from two look-ups in the store of running sums."""
    o = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(o.alias("window"), (F.col("o_custkey") % 25).alias("region"), F.date_sub(F.col("o_orderdate").cast("date"), (o % 60).cast("int")).alias("start"), F.date_add(F.col("o_orderdate").cast("date"), (o % 3).cast("int") - 1).alias("end"))
    rows = _summary(windows.over_windows(_running(spark, sf_dir), asked, "region", "day", "start", "end", _SUMS))
    return rows.select("window", "days", "assessable", rounded("mean").alias("mean"), rounded("percent", 1).alias("percent"), "last_day")


def window_findings(spark, sf_dir):
    """Of each region the last two weeks that it has, the same weeks a year before, and the change."""
    store = _running(spark, sf_dir)
    last = store.groupBy("region").agg(F.max("last_day").alias("end"))
    years = F.explode(F.array(*[F.struct(F.lit(k).alias("back"), F.add_months("end", -12 * k).alias("end")) for k in (0, 1)]))
    asked = last.select("region", years.alias("y")).select("region", "y.back", "y.end").withColumn("start", F.date_sub("end", WINDOW_DAYS - 1))
    rows = _summary(windows.over_windows(store, asked, "region", "day", "start", "end", _SUMS))
    now, then = (F.max(F.when(F.col("back") == k, F.col("mean"))) for k in (0, 1))
    pick = lambda c: F.max(F.when(F.col("back") == 0, F.col(c))).alias(c)
    out = rows.groupBy("region").agg(pick("last_day"), pick("days"), pick("assessable"), rounded(now).alias("mean"), rounded(F.max(F.when(F.col("back") == 0, F.col("percent"))), 1).alias("percent"), rounded(F.max(F.when(F.col("back") == 0, F.col("coverage"))) / WINDOW_DAYS, 3).alias("coverage"), rounded(100 * (now / then - 1), 1).alias("change"))
    return out


def _day_sums(rows):
    good = F.when(F.col("qc") != "INVALID", F.col("pm25"))
    return rows.groupBy("station", "day").agg(F.sum(good).alias("total"), F.count(good).alias("n"), F.max(good).alias("peak"))


def kept_rollup(spark, sf_dir):
    """Station days from a rollup that is kept: built from the early readings, brought up to date by the late ones, of
    which each commit touches some days; folded to stations."""
    base = f"{shared_dir(spark)}/airstrata/rollup-{uuid.uuid4().hex}"
    raw, rollup = f"{base}/readings", f"{base}/days"
    rows = readings(spark, sf_dir).withColumn("day", F.to_date("ts"))
    # Late: what comes from one source of some stations, some days after.
    late = (F.col("source") == "view") & (F.col("station") % 10 == 0) & (F.dayofmonth("day") % 9 == 0)
    versions.replace(rows.where(~late), raw, "day", "load")
    rollups.refresh(spark, raw, rollup, "day", _day_sums)
    versions.merge(rows.where(late), raw, "day", lambda old, new: new if old is None else old.unionByName(new), "late")
    touched = rollups.refresh(spark, raw, rollup, "day", _day_sums)
    out = versions.read(spark, rollup).groupBy("station").agg(F.count_if(F.col("n") > 0).alias("days"), F.sum("n").alias("readings"), rounded(F.sum("total") / F.sum("n")).alias("mean"), F.max("peak").alias("peak"))
    return out.withColumn("days_renewed", F.lit(len(touched)))


def latest_rows(spark, sf_dir):
    """The latest reading of each station, by a table function in SQL."""
    tables.register(spark)
    readings(spark, sf_dir).select("station", "ts", "pm25", "source").createOrReplaceTempView("_readings_of_latest_rows")
    return spark.sql("SELECT station, ts, pm25, source FROM latest_row(TABLE(_readings_of_latest_rows), 'station', 'ts')")


def wind_directions(spark, sf_dir):
    """Where the wind of each city and day comes from, by an aggregate in Python called from SQL."""
    tables.register(spark)
    table(spark, sf_dir, "orders").selectExpr("o_custkey % 25 AS city", "CAST(o_orderdate AS DATE) AS day", "CAST(o_orderkey * 37 % 360 AS DOUBLE) AS deg", "CAST(o_orderkey % 12 + 0.5 AS DOUBLE) AS speed").createOrReplaceTempView("_winds_of_directions")
    rows = spark.sql("SELECT city, day, wind_mean(deg, speed) AS deg FROM _winds_of_directions GROUP BY city, day")
    return rows.select("city", "day", rounded("deg", 3).alias("deg"))


def laid_out(spark, sf_dir):
    """Readings and stations in equal buckets by station, readings in partitions by day."""
    tag = uuid.uuid4().hex
    rows = layout.by_day_and_key(readings(spark, sf_dir), f"readings_{tag}", "ts", "station")
    return rows, layout.by_key(stations(spark, sf_dir), f"stations_{tag}", "station")


def listed_days(spark, sf_dir):
    """City means of the days that a list names: only these are read, and readings meet their stations without an exchange."""
    rows, places = laid_out(spark, sf_dir)
    listed = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.expr("date_add(date'2024-01-01', cast(n_nationkey as int))").alias("day")).distinct()
    chosen = rows.join(F.broadcast(listed), "day").where("qc <> 'INVALID'")  # a row a day
    own = places.select("station", "city").hint("merge")
    return chosen.join(own, "station").groupBy("city", "day").agg(rounded(F.avg("pm25")).alias("pm25"), F.count("*").alias("n"), F.count_distinct("station").alias("stations"))


QUERIES = {f.__name__: f for f in (array_blocks, array_slice, region_windows, window_findings, kept_rollup, latest_rows, wind_directions, listed_days)}

_A = f"a AS (SELECT vec_id // {ROWS_A_TIME} * 10 AS time, (vec_id % {ROWS_A_TIME})::INT AS row, (k - 1)::INT AS col, CASE WHEN abs(embedding[k]) <= {NO_DATA} THEN embedding[k]::DOUBLE END AS value FROM embeddings, range(1, 65) t(k))"
_RD = f"""d0 AS (SELECT s_nationkey AS region, l_shipdate::DATE AS day, avg(l_quantity) AS value, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
d AS (SELECT region, day, value, least(1.0, n / avg(n) OVER (PARTITION BY region)) AS coverage, n / avg(n) OVER (PARTITION BY region) >= {ASSESSABLE} AS ok, avg(value) OVER (PARTITION BY region, month(day)) AS expected FROM d0)"""
_WIN = """coalesce(count(day), 0) AS days, count(*) FILTER (ok) AS assessable, avg(value) FILTER (ok) AS mean, 100 * avg(value) FILTER (ok) / avg(expected) FILTER (ok) AS percent, max(day) AS last_day, coalesce(sum(coverage), 0) AS coverage"""
ORACLE = {
    "array_blocks": f"WITH {_A} SELECT time, row // {BLOCK[0]} AS by, col // {BLOCK[1]} AS bx, round(avg(value) + 1e-9, 6) AS mean, count(value) AS n_valid, count(*) AS n FROM a GROUP BY ALL",
    "array_slice": f"WITH {_A} SELECT time, row, col, round(value + 1e-9, 6) AS value FROM a WHERE time = 30 AND row BETWEEN 5 AND 20 AND col BETWEEN 30 AND 50",
    "region_windows": sql(f"""{_RD}, w AS (SELECT o_orderkey AS "window", o_custkey % 25 AS region, o_orderdate::DATE - (o_orderkey % 60)::INT AS a, o_orderdate::DATE + (o_orderkey % 3)::INT - 1 AS b FROM orders),
        j AS (SELECT "window", a <= b AS fit, {_WIN} FROM w LEFT JOIN d ON d.region = w.region AND day BETWEEN a AND b GROUP BY ALL)
        SELECT "window", CASE WHEN fit THEN days END AS days, CASE WHEN fit THEN assessable END AS assessable, round(mean + 1e-9, 4) AS mean, round(percent + 1e-9, 1) AS percent, last_day FROM j"""),
    "window_findings": sql(f"""{_RD}, l AS (SELECT region, max(day) AS b, 0 AS back FROM d GROUP BY ALL), w AS (SELECT * FROM l UNION ALL SELECT region, (b - INTERVAL 1 YEAR)::DATE, 1 FROM l),
        j AS (SELECT w.region, back, {_WIN} FROM w LEFT JOIN d ON d.region = w.region AND day BETWEEN b - {WINDOW_DAYS - 1} AND b GROUP BY ALL)
        SELECT region, max(last_day) FILTER (back = 0) AS last_day, max(days) FILTER (back = 0) AS days, max(assessable) FILTER (back = 0) AS assessable, round(max(mean) FILTER (back = 0) + 1e-9, 4) AS mean, round(max(percent) FILTER (back = 0) + 1e-9, 1) AS percent,
               round(max(coverage) FILTER (back = 0) / {WINDOW_DAYS} + 1e-9, 3) AS coverage, round(100 * (max(mean) FILTER (back = 0) / max(mean) FILTER (back = 1) - 1) + 1e-9, 1) AS change FROM j GROUP BY region"""),
    "kept_rollup": sql("""x AS (SELECT station, ts::DATE AS day, CASE WHEN qc <> 'INVALID' THEN pm25 END AS v, source = 'view' AND station % 10 = 0 AND day(ts) % 9 = 0 AS late FROM r), k AS (SELECT count(DISTINCT day) AS days_renewed FROM x WHERE late),
        y AS (SELECT station, day, sum(v) AS total, count(v) AS n, max(v) AS peak FROM x GROUP BY ALL) SELECT station, count(*) FILTER (n > 0) AS days, sum(n)::BIGINT AS readings, round(sum(total) / sum(n) + 1e-9, 4) AS mean, max(peak) AS peak, any_value(days_renewed)::INT AS days_renewed FROM y, k GROUP BY station"""),
    "latest_rows": sql("SELECT DISTINCT ON (station) station, ts, pm25, source FROM r ORDER BY station, ts DESC, pm25, source"),
    "wind_directions": sql(f"{_W} SELECT city, day, round(deg + 1e-9, 3) AS deg FROM w"),
    "listed_days": sql("""SELECT city, ts::DATE AS day, round(avg(pm25), 4) AS pm25, count(*) AS n, count(DISTINCT station) AS stations FROM r JOIN s USING (station)
        WHERE qc <> 'INVALID' AND ts::DATE IN (SELECT DATE '2024-01-01' + n_nationkey::INT FROM nation WHERE n_regionkey = 2) GROUP BY ALL"""),
}
