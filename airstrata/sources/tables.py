"""The domain's tables bound to the given ones, and the same bindings in SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

AS_OF = "2024-01-31 00:00:00"


def readings(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    qc = F.when(F.col("event_type") == "error", "INVALID").when(F.col("event_type") == "signup", "SUSPECT").otherwise("OK")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", F.col("value").alias("pm25"), F.col("event_type").alias("source"), qc.alias("qc"), "props", *also)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations with their city and country; both dimensions are a few rows of fixed size, so Spark may broadcast them."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        key.alias("station"), F.col("c_name").alias("name"), F.col("n_name").alias("city"), F.col("r_name").alias("country"), F.col("c_mktsegment").alias("provider"), (F.col("c_acctbal") > 0).alias("active"),
        (24 + (key * 37 % 1300) / 100.0).alias("lat"), (61 + (key * 53 % 1600) / 100.0).alias("lon"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fire detections: day, power, confidence, day or night, and the region of the supplier."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    cell = F.col("l_partkey") * 7 + F.col("l_suppkey") * 13
    return rows.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").alias("frp"), F.col("l_returnflag").alias("confidence"),
        F.col("l_linestatus").alias("daynight"), F.col("n_name").alias("district"), F.col("n_regionkey").alias("country"), (cell % 40).alias("cy"), ((cell / 40).cast("long") % 40).alias("cx"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("id"))


SQL = """
r AS (SELECT user_id AS station, ts, value AS pm25, event_type AS source, props,
             CASE event_type WHEN 'error' THEN 'INVALID' WHEN 'signup' THEN 'SUSPECT' ELSE 'OK' END AS qc FROM events),
s AS (SELECT c_custkey AS station, c_name AS name, n_name AS city, r_name AS country, c_mktsegment AS provider, c_acctbal > 0 AS active,
             24 + (c_custkey * 37 % 1300) / 100.0::DOUBLE AS lat, 61 + (c_custkey * 53 % 1600) / 100.0::DOUBLE AS lon
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT l_orderkey AS id, l_linenumber AS line, l_shipdate::DATE AS day, l_extendedprice AS frp, l_returnflag AS confidence, l_linestatus AS daynight,
             n_name AS district, n_regionkey AS country, (l_partkey * 7 + l_suppkey * 13) % 40 AS cy, ((l_partkey * 7 + l_suppkey * 13) // 40) % 40 AS cx
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
o AS (SELECT o_orderdate::DATE AS day, o_totalprice AS value, o_orderkey AS id FROM orders)"""


def sql(body: str) -> str:
    """A query over r (readings), s (stations), f (detections) and o (daily values); rounds to four digits as `rounded` does."""
    body = body.replace(", 4)", " + 1e-9, 4)")
    return f"WITH {SQL.strip()}{',' if body.lstrip()[:6].upper() != 'SELECT' else ''}\n{body}"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test signal: 720 hours of each site, with plateaus of one to thirty hours, jumps, sentinels and missing hours.

    Sites are dealt before their hours are made, a thousand to a task at most on average: windows by site then need no
    exchange of hours, and what one task sorts does not grow with the sites."""
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_nationkey").alias("group"))
    sites = sites.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sites.count() // 1000)), "station")
    rows = sites.withColumn("h", F.explode(F.expr("sequence(0L, 719L)")))
    step = F.floor(F.col("h") / (1 + F.col("station") % 30))
    base = ((F.col("station") * 7919 + step * 104729) % 400).cast("double")
    value = F.when((F.col("station") + 3 * F.col("h")) % 53 == 0, None).when((F.col("station") * F.col("h")) % 211 == 5, F.when(F.col("h") % 2 == 0, 999.0).otherwise(-1.0))
    value = value.when((F.col("station") + F.col("h")) % 97 == 0, base + 500).otherwise(base)
    hour = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(h as int), 0, 0)")
    return rows.select("station", "group", hour.alias("hour"), "h", value.alias("pm25"))


SIGNAL = """
g0 AS (SELECT s_suppkey AS station, s_nationkey AS "group", h::BIGINT AS h, ((s_suppkey * 7919 + (h // (1 + s_suppkey % 30)) * 104729) % 400)::DOUBLE AS base FROM supplier, range(720) t(h)),
q AS (SELECT station, "group", TIMESTAMP '2024-01-01' + to_hours(h::INT) AS hour, h,
             CASE WHEN (station + 3 * h) % 53 = 0 THEN NULL WHEN (station * h) % 211 = 5 THEN CASE WHEN h % 2 = 0 THEN 999.0 ELSE -1.0 END
                  WHEN (station + h) % 97 = 0 THEN base + 500 ELSE base END::DOUBLE AS pm25 FROM g0)"""


def wide_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with several measured fields, some of them impossible."""
    e, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), F.col("user_id").alias("station"), "ts", F.when(e % 29 == 0, -v).when(e % 31 == 0, v * 20).otherwise(v).alias("pm25"), F.when(e % 7 != 0, v * 1.5).alias("pm10"),
        ((e * 13) % 140).cast("double").alias("no2"), ((e * 7) % 130 - 10).cast("double").alias("humidity"), ((e * 11) % 150 - 65).cast("double").alias("temp_c"),
        ((e * 17) % 90 + 40).cast("double").alias("pressure_kpa"), ((e * 3) % 160 - 2).cast("double").alias("wind_speed_ms"), ((e * 37) % 400).cast("double").alias("wind_dir_deg"), F.col("event_type").alias("provider"),
    )


WIDE = """
x AS (SELECT event_id AS id, user_id AS station, ts, CASE WHEN event_id % 29 = 0 THEN -value WHEN event_id % 31 = 0 THEN value * 20 ELSE value END AS pm25, CASE WHEN event_id % 7 <> 0 THEN value * 1.5 END AS pm10,
             ((event_id * 13) % 140)::DOUBLE AS no2, ((event_id * 7) % 130 - 10)::DOUBLE AS humidity, ((event_id * 11) % 150 - 65)::DOUBLE AS temp_c,
             ((event_id * 17) % 90 + 40)::DOUBLE AS pressure_kpa, ((event_id * 3) % 160 - 2)::DOUBLE AS wind_speed_ms, ((event_id * 37) % 400)::DOUBLE AS wind_dir_deg, event_type AS provider FROM events)"""
