"""Operators on keyed time series: latest rows, buckets, gaps, runs and screening.

Every window is partitioned by the series' key, so a task holds one series at a time; bucket means combine before the
shuffle. Nulls: a null value never wins over a value, breaks runs, and is left out of means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import hour_of

# Screening limits of hourly PM2.5.
SENTINELS, MOST, JUMP, RETURN, STUCK_HOURS = (-1.0, 999.0, 1000.0), 1000.0, 250.0, 1.0, 18


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_by(df: DataFrame, keys: list[str], ts: str, *values: str) -> DataFrame:
    """Latest values by aggregation, without sorting series: rows combine within tasks before the shuffle."""
    newest = F.max_by(F.struct(ts, *values), F.struct(ts, *values))
    return df.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def hourly(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return df.groupBy(key, hour_of(F.col(ts)).alias("hour")).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def mean_in_order(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Means of each key from sums taken in the given order, for means that are held against limits: the last bit of a
    sum depends on its order, and `avg` adds up tasks' sums as they come. Running sums spill; no task holds a key's values."""
    own = Window.partitionBy(*keys).orderBy(*order, value).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.select(*keys, F.sum(value).over(own).alias("_sum"), F.count(value).over(own).alias("_n"), F.count("*").over(own).alias("_at"))
    return sums.groupBy(*keys).agg(F.max_by(F.try_divide("_sum", "_n"), "_at").alias(name))


def spine(df: DataFrame, key: str, start: str, end: str, step: str = "1 hour", name: str = "hour") -> DataFrame:
    """Every key with every step from start to end, inclusive."""
    steps = F.explode(F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}', interval {step})"))
    return df.select(key).distinct().select(key, steps.alias(name))


def islands(df: DataFrame, key: str, ts: str, new_run: Column) -> DataFrame:
    """Adds `run`, a number that grows at each row where `new_run` holds."""
    w = Window.partitionBy(key).orderBy(ts)
    return df.withColumn("_new", F.coalesce(new_run, F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(w)).drop("_new")


def bounded(df: DataFrame, value: str) -> DataFrame:
    """Sentinels and impossible values as nulls."""
    good = ~F.col(value).isin(*SENTINELS) & F.col(value).between(0, MOST)
    return df.withColumn(value, F.when(good, F.col(value)))


def spikes(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Adds `spike`: one hour that jumps and returns, or either hour of a two-hour plateau that does."""
    w = Window.partitionBy(key).orderBy(ts)
    at = lambda k: F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w)
    x = F.col(value)
    one = (F.abs(x - at(1)) > JUMP) & (F.abs(at(-1) - at(1)) <= RETURN)
    two = (F.abs(at(1) - at(2)) > JUMP) & (F.abs(x - at(2)) > JUMP) & (F.abs(at(-1) - at(2)) <= RETURN)
    df = df.withColumn("_one", F.coalesce(one, F.lit(False))).withColumn("_two", F.coalesce(two, F.lit(False)))
    return df.withColumn("spike", F.col("_one") | F.col("_two") | F.coalesce(F.lead("_two").over(w), F.lit(False))).drop("_one", "_two")


def stuck(df: DataFrame, key: str, ts: str, value: str, hours: int = STUCK_HOURS) -> DataFrame:
    """Adds `stuck`: the value is one of `hours` or more equal values in a row."""
    w = Window.partitionBy(key).orderBy(ts)
    runs = islands(df, key, ts, ~(F.col(value) == F.lag(value).over(w)))
    size = F.count(value).over(Window.partitionBy(key, "run"))
    return runs.withColumn("stuck", F.col(value).isNotNull() & (size >= hours)).drop("run")


def rolling_mean(df: DataFrame, key: str, ts: str, value: str, rows: int, least: int = 1) -> Column:
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...], width: float) -> DataFrame:
    """Exact percentiles (between ranks, linear) of each group, as columns p10, p50, ..., with the count n.

    No task holds a group's values: values are counted by buckets of `width`, the buckets that hold the wanted ranks are
    found, and only the values there are counted one by one. Nulls are left out."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_b", F.floor(F.col("_v") / width))
    own = Window.partitionBy(*keys).orderBy("_b")
    buckets = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c")).withColumn("_base", F.sum("_c").over(own) - F.col("_c")).withColumn("n", F.sum("_c").over(Window.partitionBy(*keys)))
    wanted = F.explode(F.array(*[F.struct(F.lit(int(round(q * 100))).alias("q"), F.lit(float(q)).alias("share"), F.lit(up).alias("up")) for q in shares for up in (False, True)]))
    rank = F.when(F.col("_w.up"), F.ceil(F.col("_w.share") * (F.col("n") - 1))).otherwise(F.floor(F.col("_w.share") * (F.col("n") - 1)))
    hit = buckets.withColumn("_w", wanted).withColumn("_rank", rank).where((F.col("_rank") >= F.col("_base")) & (F.col("_rank") < F.col("_base") + F.col("_c")))
    near = hit.select(*keys, "_b", "_base").distinct()
    values = rows.join(near, [*keys, "_b"]).groupBy(*keys, "_b", "_base", "_v").agg(F.count("*").alias("_c"))
    upto = F.col("_base") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    values = values.select(*keys, "_b", "_v", (upto - F.col("_c")).alias("_from"), upto.alias("_to"))
    found = hit.select(*keys, "_b", "n", "_w.q", "_w.up", "_w.share", "_rank").join(values, [*keys, "_b"]).where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    at = lambda q, up: F.max(F.when((F.col("q") == q) & (F.col("up") == F.lit(up)), F.col("_v")))
    part = lambda q: (q * (F.max("n") - 1)) % 1
    out = [(at(int(round(q * 100)), False) + (at(int(round(q * 100)), True) - at(int(round(q * 100)), False)) * part(q)).alias(f"p{int(round(q * 100))}") for q in shares]
    return found.groupBy(*keys).agg(*out, F.max("n").alias("n"))
