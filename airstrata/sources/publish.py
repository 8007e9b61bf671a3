"""Sinks: partitioned Parquet with a success marker last, and reads gated by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _marker(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish(df: DataFrame, path: str, partition: str = "date") -> None:
    """Write by partition, replacing only the partitions present, then the marker. The marker goes first, so that a table
    whose partitions are being replaced one by one does not read as whole; `versions` has tables that can be read
    meanwhile. Rows of a partition meet in tasks by a shuffle that Spark may split, so a large partition is several
    files rather than one task."""
    store, marker = _marker(df.sparkSession, path)
    store.delete(marker, False)
    rows = df.hint("rebalance", F.col(partition))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    store.create(marker, True).close()


def published(spark: SparkSession, path: str) -> DataFrame:
    """A published table; a folder whose first write did not end has no success marker and is refused."""
    store, marker = _marker(spark, path)
    if not store.exists(marker):
        raise FileNotFoundError(f"{path} has no success marker")
    return spark.read.parquet(path)


def missing_days(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Days of a range that are not published yet."""
    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS date")
    return days.join(published(spark, path).select("date").distinct(), "date", "left_anti")


def merge_series(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both; where keys meet, the new one's."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def publish_missing(df: DataFrame, path: str, start: str, end: str, least_rows: int = 1, overwrite: bool = False) -> list[str]:
    """Publish the days of a range that are not there yet (all, with `overwrite`), and return them.

    A day of fewer rows than `least_rows` is taken for cut short: it raises before anything is written. The days are as
    many as the range has."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS date")
    wanted = missing_days(spark, path, start, end) if there and not overwrite else days
    rows = df.join(F.broadcast(wanted), "date", "left_semi")  # a row a day
    counts = {str(r.date): r.n for r in rows.groupBy("date").agg(F.count("*").alias("n")).collect()}
    short = sorted(d for d, n in counts.items() if n < least_rows)
    if short:
        raise ValueError(f"days that look cut short: {', '.join(short)}")
    if counts:
        publish(rows, path, "date")
    return sorted(counts)


def by_day(df: DataFrame, path: str, ts: str) -> None:
    """Readings partitioned by day, so that a range of time reads the days that it touches only."""
    publish(df.withColumn("date", F.to_date(ts)), path, "date")


def between(spark: SparkSession, path: str, ts: str, start: str, end: str) -> DataFrame:
    """Readings of a half-open range of time from a table that `by_day` wrote: other days' files are not listed for it."""
    day = F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return published(spark, path).where(day & (F.col(ts) >= F.expr(f"timestamp_ntz'{start}'")) & (F.col(ts) < F.expr(f"timestamp_ntz'{end}'")))


def with_fresher_days(store: DataFrame, fresh: DataFrame, day: str) -> DataFrame:
    """A store with the days that are there anew in place of its own."""
    return store.join(fresh.select(day).distinct(), day, "left_anti").unionByName(fresh, allowMissingColumns=True)
