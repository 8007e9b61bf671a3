"""Sums over any window of days from two look-ups in a store of running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_sums(days: DataFrame, key: str, day: str, sums: dict[str, Column], known: Column) -> DataFrame:
    """(key, day, each sum, last_day): from the day before the first on, for each day of the whole range, the sums so far
    of each key, and its last day so far where `known` holds. A key's days are one window: as many as the years have."""
    each = days.groupBy(key, day).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(n) for n, c in sums.items()], F.max(F.when(known, F.col(day))).alias("last_day"))
    ends = days.agg(F.date_sub(F.min(day), 1).alias("a"), F.max(day).alias("b"))
    spine = days.select(key).distinct().join(F.broadcast(ends)).select(key, F.explode(F.sequence("a", "b")).alias(day))  # one row of ends
    w = Window.partitionBy(key).orderBy(day)
    rows = spine.join(each, [key, day], "left")
    return rows.select(key, day, *[F.sum(F.coalesce(n, F.lit(0))).over(w).alias(n) for n in sums], F.max("last_day").over(w).alias("last_day"))


def over_windows(store: DataFrame, windows: DataFrame, key: str, day: str, start: str, end: str, sums: list[str]) -> DataFrame:
    """The windows (key, start, end: both included) with the sums over each, and the last known day in it. Days outside the
    store count nothing, nor does a key that it has not; a window that ends before it starts has null sums."""
    ends = store.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))  # one row
    inside = lambda c: F.greatest("_a", F.least("_b", c))
    rows = windows.join(F.broadcast(ends)).withColumn("_from", inside(F.date_sub(start, 1))).withColumn("_to", inside(F.col(end)))
    at = lambda c, tag: store.select(F.col(key).alias(f"_k{tag}"), F.col(day).alias(f"_d{tag}"), *[F.col(s).alias(f"_{s}{tag}") for s in sums], F.col("last_day").alias(f"_last{tag}"))
    for c, tag in (("_from", 1), ("_to", 2)):
        rows = rows.join(at(c, tag), (F.col(key) == F.col(f"_k{tag}")) & (F.col(c) == F.col(f"_d{tag}")), "left")
    right = F.col(start) <= F.col(end)
    last = F.when(right & (F.col("_last2") >= F.col(start)), F.col("_last2"))
    return rows.select(*windows.columns, *[F.when(right, F.coalesce(F.col(f"_{s}2") - F.col(f"_{s}1"), F.lit(0))).alias(s) for s in sums], last.alias("last_day"))
