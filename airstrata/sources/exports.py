"""Sinks: CSV with headers and caps, typed Parquet, daily partitions with provenance, manifests, archives, GeoJSON."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import publish
from .texts import put

#: Rows of an export unless asked otherwise, and at most.
DEFAULT_ROWS, MOST_ROWS = 500_000, 5_000_000


def write_csv(df: DataFrame, path: str, max_rows: int = DEFAULT_ROWS, order: list[str] | None = None) -> None:
    """CSV with a header, no more rows than the cap, in order where one is given."""
    rows = df.orderBy(*order) if order else df
    rows.limit(min(max_rows, MOST_ROWS)).write.mode("overwrite").option("header", True).csv(path)


def streamed_csv(df: DataFrame, max_rows: int = DEFAULT_ROWS, flush: int = 500) -> Iterator[str]:
    """The same as text in pieces of `flush` rows; the driver holds one partition's rows at a time."""
    text = io.StringIO(newline="")
    out = csv.writer(text, lineterminator="\n")
    out.writerow(df.columns)
    for n, row in enumerate(df.limit(min(max_rows, MOST_ROWS)).toLocalIterator(prefetchPartitions=False), 1):
        out.writerow(row)
        if n % flush == 0:
            yield text.getvalue()
            text.seek(0)
            text.truncate()
    if text.tell():
        yield text.getvalue()


def write_typed(df: DataFrame, path: str, types: dict[str, str]) -> None:
    """Parquet with the given types, dictionaries and Snappy; a value that is none of its type is null."""
    df.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()]).write.mode("overwrite").option("compression", "snappy").option("parquet.enable.dictionary", True).parquet(path)


def publish_days(df: DataFrame, path: str, provenance: dict, station_columns: list[str]) -> None:
    """Daily partitions, then a slim list of stations, then the provenance of the screening, with counts by day."""
    publish(df, path, "date")
    spark = df.sparkSession
    done = spark.read.parquet(path)
    done.select(*station_columns).distinct().coalesce(1).write.mode("overwrite").json(f"{path}/_stations")
    days = {str(r.date): r.n for r in done.groupBy("date").agg(F.count("*").alias("n")).collect()}  # one row a day
    put(spark, f"{path}/_provenance.json", json.dumps(provenance | {"rows_by_day": days}, sort_keys=True))


def replace_json(df: DataFrame, path: str, name: str, day: str) -> None:
    """A small product as lines of JSON in a dated folder, and the pointer `latest` to it."""
    at = f"{name}-{day}"
    df.coalesce(1).write.mode("overwrite").json(f"{path}/{at}")
    put(df.sparkSession, f"{path}/latest", at)


def write_run(df: DataFrame, path: str, run: str) -> None:
    """A manifest as a run's Parquet, then the pointer to it; a run that does not end leaves the old one in place."""
    df.write.mode("overwrite").parquet(f"{path}/runs/{run}")
    put(df.sparkSession, f"{path}/latest", f"runs/{run}")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """What the pointer of `replace_json` or `write_run` tells."""
    at = spark.read.text(f"{path}/latest").first()[0]
    return spark.read.parquet(f"{path}/{at}") if at.startswith("runs/") else spark.read.json(f"{path}/{at}")


def rewrite_years(df: DataFrame, path: str, day: str, run: str) -> None:
    """A store of detections by year: the years present are replaced, then the manifest of days and rows is."""
    publish(df.withColumn("year", F.year(day)), path, "year")
    store = df.sparkSession.read.parquet(path)
    write_run(store.groupBy("year", day).agg(F.count("*").alias("n")), f"{path}/_manifest", run)


def archive(df: DataFrame, path: str, payload: str) -> DataFrame:
    """Append payloads by the digest of their canonical JSON, those alone that are not there; returns the digests."""
    spark = df.sparkSession
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(payload, "map<string,string>")))))
    rows = df.select(F.sha2(canonical, 256).alias("digest"), F.col(payload).alias("body")).groupBy("digest").agg(F.min("body").alias("body"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        rows = rows.join(spark.read.schema("digest string, body string").json(path).select("digest"), "digest", "left_anti")
    rows.write.mode("append").option("compression", "gzip").json(path)
    return spark.read.schema("digest string, body string").json(path).select("digest")


def feature_lines(df: DataFrame, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """A GeoJSON feature a row, as text; a large collection stays in as many files as it has tasks."""
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def feature_collection(df: DataFrame, lat: str, lon: str, properties: list[str], status: str, most: int = 10_000) -> str:
    """One GeoJSON text of at most `most` features, with its status and whether there are more."""
    rows = [r.value for r in feature_lines(df, lat, lon, properties).limit(most + 1).collect()]
    return json.dumps({"type": "FeatureCollection", "status": status, "truncated": len(rows) > most, "features": [json.loads(x) for x in rows[:most]]})


def write_series_csv(df: DataFrame, path: str, comments: list[str], order: list[str]) -> None:
    """A short series as CSV with comment lines in front, in one file."""
    names = df.columns
    head = df.sparkSession.createDataFrame([(0, i, f"# {c}") for i, c in enumerate([*comments])] + [(1, 0, ",".join(names))], "part int, n long, value string")
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    rows = df.orderBy(*order).select(F.lit(2).alias("part"), F.monotonically_increasing_id().alias("n"), line.alias("value"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("part", "n").select("value").write.mode("overwrite").text(path)
