"""Scans of files from elsewhere: tolerant CSV, JSON products, manifests, GeoJSON, provider payloads, sources with fallbacks.

Rows that cannot be read are left out and counted, never raised on; columns of another layout are found under their
other names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def first_of(df: DataFrame, name: str, *others: str, kind: str = "string") -> Column:
    """The first known of several columns of which a layout has some; null of `kind` where it has none."""
    have = [F.col(f"`{c}`") for c in (name, *others) if c in df.columns]
    return F.coalesce(*have).try_cast(kind).alias(name) if have else F.lit(None).cast(kind).alias(name)


def fire_csv(spark: SparkSession, path: str) -> DataFrame:
    """Detections from CSV of either layout (with or without pass times). Columns go by the header; rows without a
    place that can be read are left out; a bad number elsewhere is null."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    d = lambda name, *others: first_of(raw, name, *others, kind="double")
    digits = F.lpad(first_of(raw, "acq_time"), 4, "0")
    day = first_of(raw, "acq_date", kind="date")
    at = F.when(digits.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$"), F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), digits), F.lit("yyyy-MM-dd HHmm")).cast("timestamp_ntz"))
    rows = raw.select(
        d("latitude", "lat"), d("longitude", "lon"), F.coalesce(d("frp"), F.lit(0.0)).alias("frp"), F.lower(F.substring(first_of(raw, "confidence"), 1, 1)).alias("confidence"), day.alias("day"), at.alias("at"),
        F.coalesce(first_of(raw, "satellite"), F.lit("")).alias("satellite"), F.lit("timed" if "acq_time" in raw.columns else "dated").alias("layout"),
    )
    return rows.where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))


DAILY = {"station_id": ("id", "string"), "name": ("station_name", "string"), "city": ("city_name", "string"), "lat": ("latitude", "double"), "lon": ("longitude", "double"), "pm25": ("pm25_mean", "double"), "valid_hours": ("pm25_valid_hours", "int")}


def station_days(spark: SparkSession, json_path: str, parquet_path: str, least_hours: int = 0) -> DataFrame:
    """Station days from a JSON list where there is one, else from Parquet files whose columns may have other names."""
    if exists(spark, json_path):
        raw = spark.read.option("multiLine", True).json(json_path)
    else:
        raw = spark.read.option("mergeSchema", True).parquet(parquet_path)
    rows = raw.select(*[first_of(raw, name, other, kind=kind) for name, (other, kind) in DAILY.items()])
    hours = F.coalesce("valid_hours", F.lit(0))
    return rows.where(F.col("station_id").isNotNull() & (hours >= least_hours)).withColumn("complete", hours >= 18)


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    """A forecast product as rows (station, horizon in hours, value, low, high); entries without a value are left out."""
    schema = "station_id string, generated_at string, forecasts array<struct<horizon: string, horizon_hours: int, value: double, pm25: double, low: double, high: double>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    rows = raw.select("station_id", F.to_timestamp("generated_at").cast("timestamp_ntz").alias("made"), F.explode("forecasts").alias("f"))
    hours = F.coalesce("f.horizon_hours", F.regexp_extract("f.horizon", "([0-9]+)", 1).try_cast("int") * F.when(F.col("f.horizon").rlike("(?i)d"), 24).otherwise(1))
    out = rows.select("station_id", "made", hours.alias("horizon"), F.coalesce("f.value", "f.pm25").alias("value"), "f.low", "f.high")
    return out.where("value is not null and horizon is not null")


def manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several manifests that is there: Parquet folders, or lines of JSON."""
    for path in paths:
        if exists(spark, path):
            return spark.read.json(path) if path.endswith((".jsonl", ".json")) else spark.read.parquet(path)
    raise FileNotFoundError(", ".join(paths))


_RING = "array<array<array<double>>>"


def geojson_regions(spark: SparkSession, path: str, kind: str, name: str = "name", priority: int = 1) -> DataFrame:
    """Regions (kind, name, priority, ring, holes) from the polygons and multipolygons of GeoJSON: a row for each polygon."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    shape = F.col("f.geometry.coordinates")
    many = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(shape, f"array<{_RING}>")).when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(shape, _RING)))
    # The last point of a ring repeats the first.
    ring = lambda r: F.transform(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), lambda c: F.struct(F.get(c, 1).alias("lat"), F.get(c, 0).alias("lon")))
    parts = rows.select(F.element_at("f.properties", name).alias("name"), F.explode(many).alias("p")).where("size(get(p, 0)) >= 4")
    holes = F.transform(F.filter(F.slice("p", F.lit(2), F.greatest(F.size("p"), F.lit(1))), lambda r: F.size(r) >= 4), ring)
    return parts.select(F.lit(kind).alias("kind"), "name", F.lit(priority).alias("priority"), ring(F.get("p", 0)).alias("ring"), holes.alias("holes"))


def rows_of_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows of a JSON list held in a column, each beside what else its row has."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.inline(F.from_json(column, f"array<struct<{schema}>>")))


def labelled_hours(df: DataFrame, key: str, values: str, year: int) -> DataFrame:
    """(key, hour, value) of a map from labels such as '03 Jan 14:30' to values: hours at their start, the last of equal
    ones; labels that are no time are left out."""
    rows = df.select(key, F.explode(values).alias("label", "value"))
    at = F.try_to_timestamp(F.concat_ws(" ", F.lit(str(year)), F.trim("label")), F.lit("yyyy dd MMM HH:mm")).cast("timestamp_ntz")
    rows = rows.withColumn("at", at).where("at is not null and value is not null")
    return rows.groupBy(key, F.date_trunc("hour", "at").cast("timestamp_ntz").alias("hour")).agg(F.max_by("value", "at").alias("value"))


PAGE = "results array<struct<value: double, parameter: struct<name: string, units: string>, period: struct<interval: string, datetimeTo: struct<utc: string>>>>"


def measurement_pages(df: DataFrame, column: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of pages of measurements: an hour's value by parameter; rejected by reason: no time, sub-hourly,
    in the future, no value, unknown parameter."""
    rows = df.select(F.explode(F.from_json(column, PAGE)["results"]).alias("m"))
    at = F.try_to_timestamp("m.period.datetimeTo.utc").cast("timestamp_ntz")
    rows = rows.select(F.lower(F.regexp_replace("m.parameter.name", "[._]", "")).alias("field"), "m.parameter.units", "m.value", F.col("m.period.interval").alias("interval"), at.alias("at"))
    why = F.when(F.col("at").isNull(), "ts_missing").when(F.col("at") > F.expr(f"timestamp_ntz'{now}' + interval 1 hour"), "ts_future").when(~F.coalesce(F.col("interval") == "01:00:00", F.lit(False)), "sub_hourly")
    why = why.when(F.col("value").isNull(), "no_value").when(~F.col("field").isin("pm25", "pm10", "o3", "no2", "so2", "co"), "unknown_parameter")
    rows = rows.withColumn("why", why)
    good = rows.where("why is null").groupBy(F.date_trunc("hour", F.col("at") - F.expr("interval 1 hour")).cast("timestamp_ntz").alias("hour"), "field").agg(F.max_by("value", "at").alias("value"), F.max_by("units", "at").alias("units"))
    return good, rows.where("why is not null").groupBy("why").agg(F.count("*").alias("n"))


def provider_readings(df: DataFrame, column: str) -> DataFrame:
    """Current and past readings of a provider's payload as rows (at, field, value, part), with codes as field names."""
    entry = "struct<ts: string, p2: double, p1: double, tp: double, hu: double>"
    codes = {"p2": "pm25", "p1": "pm10", "tp": "temp_c", "hu": "humidity"}
    raw = df.select(F.from_json(column, f"current {entry}, history array<{entry}>").alias("d"))
    parts = F.concat(F.array(F.struct(F.lit("current").alias("part"), F.col("d.current").alias("e"))), F.coalesce(F.transform("d.history", lambda e: F.struct(F.lit("history").alias("part"), e.alias("e"))), F.array().cast(f"array<struct<part: string, e: {entry}>>")))
    rows = raw.select(F.explode(parts).alias("x")).select("x.part", F.try_to_timestamp("x.e.ts").cast("timestamp_ntz").alias("at"), F.inline(F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"x.e.{code}").alias("value")) for code, name in codes.items()])))
    return rows.where("at is not null and value is not null").select("at", "field", "value", "part")


def schema_drift(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str, str]]:
    """(column, expected, found) of each column that is missing, of another type, or not expected."""
    found = dict(df.dtypes)
    names = [*expected, *(c for c in found if c not in expected)]
    return [(c, expected.get(c, "none"), found.get(c, "none")) for c in names if expected.get(c) != found.get(c)]


def latest_of(spark: SparkSession, *readers) -> DataFrame | None:
    """The first of several readers whose files are there; anything else that a reader raises is raised."""
    for read in readers:
        try:
            return read(spark)
        except FileNotFoundError:
            continue
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None
