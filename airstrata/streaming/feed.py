"""The reading feed as a stream: hourly means, exceedance sessions, deduplication, upserts of micro-batches.

State is bounded by the watermark in update and append mode; `sessions` runs in complete mode, which keeps their state
(one row a session), `streaming.sessions.open_sessions` in update mode. Readings later than the watermark are left to the
batch reconciliation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import versions

LATE = "72 hours"


def readings(spark: SparkSession, folder: str, pattern: str = "events.parquet", late: str = LATE, files: int | None = None) -> DataFrame:
    """The feed of a folder's files; `files`: how many make up a micro-batch, all that are there if None."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).options(**{"maxFilesPerTrigger": files} if files else {}).parquet(folder)
    return rows.select("event_id", F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("pm25")).withWatermark("ts", late)


def hourly(stream: DataFrame) -> DataFrame:
    return stream.groupBy("station", F.window("ts", "1 hour").alias("w")).agg(F.avg("pm25").alias("pm25"), F.count("pm25").alias("n")).select("station", F.col("w.start").cast("timestamp_ntz").alias("hour"), "pm25", "n")


def sliding(stream: DataFrame, length: str = "7 days", every: str = "1 day") -> DataFrame:
    """Means over windows that overlap; a reading counts in each of them."""
    rows = stream.groupBy("station", F.window("ts", length, every).alias("w")).agg(F.avg("pm25").alias("pm25"), F.count("pm25").alias("n"), F.max("pm25").alias("peak"))
    return rows.select("station", F.col("w.start").cast("timestamp_ntz").alias("begins"), "pm25", "n", "peak")


def sessions(stream: DataFrame, above: float = 250.0, gap: str = "6 hours") -> DataFrame:
    rows = stream.where(F.col("pm25") > above).groupBy("station", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("readings"), F.max("pm25").alias("peak"))
    return rows.select("station", F.col("w.start").cast("timestamp_ntz").alias("begins"), "readings", "peak")


def deduplicated(stream: DataFrame) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(["event_id"])


def drained(df: DataFrame, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there and return its rows, which executors write to the shared folder.

    A micro-batch that runs again overwrites its own rows. In complete mode each batch overwrites the last one's; in
    update mode the latest batch's row of each of `keys` counts, and none where it has the column `gone` set."""
    spark, name = df.sparkSession, f"feed_{uuid.uuid4().hex}"
    base = shared_dir(spark)
    rows = f"{base}/{name}-rows"
    # So that a feed without any batch reads as empty.
    spark.createDataFrame([], df.schema).withColumn("_batch", F.lit(0).cast("long")).write.parquet(f"{rows}/none")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{rows}/{'all' if mode == 'complete' else number}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{rows}/*")
    if mode == "update":
        rest = [c for c in df.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
        out = out.where("not gone").drop("gone") if "gone" in rest else out
    return out.select(*[c for c in df.columns if c in out.columns])


#: Folders that a store of latest values is dealt into by its keys; a micro-batch rewrites those that it touches.
BUCKETS = 16


def upserted(stream: DataFrame, path: str, keys: list[str], fields: list[str], checkpoint: str, ts: str = "ts", buckets: int = BUCKETS) -> int:
    """Merge a stream into a store of the latest known value of each field, micro-batch by micro-batch; returns the
    store's version.

    What is latest goes by the readings' own time, which the store keeps beside each field, and at equal times by the
    greater value: so the order in which readings arrive does not matter, nor that a batch runs again. A null never
    erases. Each batch commits the buckets of keys that it touches to a versioned table, and leaves the others."""

    def latest(rows: DataFrame, pair) -> DataFrame:
        return rows.groupBy("bucket", *keys).agg(*[F.max(pair(c)).alias(c) for c in fields])

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        new = latest(rows, lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("at"), F.col(c).alias("value"))))
        versions.merge(new, path, "bucket", lambda old, own: own if old is None else latest(old.unionByName(own), F.col), f"batch {number}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return versions.state(stream.sparkSession, path)[0]


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The values of a store and, as field_at, their times; None where there is none."""
    if versions.state(spark, path)[0] < 0:
        return None
    rows = versions.read(spark, path, version)
    pairs = [c for c, t in rows.dtypes if t.startswith("struct<at:")]
    return rows.select(*[c for c in rows.columns if c not in (*pairs, "bucket")], *[F.col(f"{c}.value").alias(c) for c in pairs], *[F.col(f"{c}.at").alias(f"{c}_at") for c in pairs])
