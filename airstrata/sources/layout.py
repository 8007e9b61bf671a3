"""Readings laid out for joins and pruning: a partition a day, and within it buckets by station, sorted.

A join by station of tables with equal buckets needs no exchange of readings, and a join with a list of days reads the
days that are on it only, which Spark finds out as it runs. Tables are the catalog's, so that it knows their buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 8


def by_day_and_key(df: DataFrame, name: str, ts: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Write readings as a table of the catalog, and read it: a task holds one bucket, so a day is `buckets` files."""
    rows = df.withColumn("day", F.to_date(ts)).repartition(buckets, key)
    rows.write.mode("overwrite").partitionBy("day").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def by_key(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Write a table that readings are joined with, in the same buckets."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)
