"""Merging batches into stores: fill-only and field-aware upserts, revisions, replacement by key, windows, ageing, identity.

All are joins and aggregations by key; a batch that runs again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import haversine_km


def next_window(through: Column, now: Column, overlap_hours: int, window_hours: int, backfill_hours: int) -> Column:
    """(from, to): from what is done less the overlap; the whole backfill where nothing is done."""
    hours = lambda n: F.expr(f"interval {n} hours")
    done = F.least(through, now)
    to = F.least(now, done + hours(window_hours))
    start = F.when(through.isNull(), now - hours(backfill_hours)).otherwise(done - hours(overlap_hours))
    return F.struct(start.alias("from"), F.when(through.isNull() | (to <= start), now).otherwise(to).alias("to"))


def reconcile_windows(through: Column, lookback_days: int, overlap_hours: int, chunk_days: int) -> Column:
    """Windows from the lookback up to the overlap, in chunks."""
    end, first = through - F.expr(f"interval {overlap_hours} hours"), through - F.expr(f"interval {lookback_days} days")
    step = F.expr(f"interval {chunk_days} days")
    starts = F.filter(F.sequence(first, end, step), lambda a: a < end)
    return F.transform(starts, lambda a: F.struct(a.alias("from"), F.least(a + step, end).alias("to")))


def first_values(df: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """One row a key with the first known value of each field in an order: rows combine within tasks."""
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields])


def _both(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    old = store.withColumn("_had", F.lit(True))
    return old.join(new.select(*keys, *[F.col(c).alias(f"{c}_new") for c in new.columns if c not in keys]).withColumn("_came", F.lit(True)), keys, "full_outer")


def upsert(store: DataFrame, new: DataFrame, keys: list[str], fields: list[str], withdraw: str) -> DataFrame:
    """The store after a batch, with `state`: inserted, updated or unchanged. A null of the batch never erases; a field
    that its column `withdraw` lists does."""
    rows = _both(store, new, keys)
    gone = lambda c: F.coalesce(F.array_contains(f"{withdraw}_new", c), F.lit(False))
    value = {c: F.when(~gone(c), F.coalesce(f"{c}_new", c)) for c in fields}
    same = F.lit(True)
    for c in fields:
        same = same & value[c].eqNullSafe(F.col(c))
    state = F.when(F.col("_had").isNull(), "inserted").when(F.col("_came").isNull() | same, "unchanged").otherwise("updated")
    return rows.select(*keys, *[v.alias(c) for c, v in value.items()], state.alias("state"))


def revisions(store: DataFrame, new: DataFrame, keys: list[str], fields: list[str], close: float = 1e-9) -> DataFrame:
    """(keys, field, old, new) of known values that differ by more than `close`, absolute and relative."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("old"), F.col(f"{c}_new").alias("new")) for c in fields])
    rows = _both(store, new, keys).select(*keys, F.inline(pairs))
    return rows.where(F.abs(F.col("old") - F.col("new")) > F.greatest(F.lit(close), close * F.greatest(F.abs("old"), F.abs("new"))))


def replaced(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The store with the rows of the batch in place of its own where keys meet."""
    return store.join(new.select(*keys), keys, "left_anti").unionByName(new)


def aged(old: DataFrame, listed: DataFrame, fetched: DataFrame, key: str, scope: str) -> DataFrame:
    """(key, misses) of an inventory after a run: none for what is listed, one more for what the run could have seen."""
    seen = fetched.select(scope).union(listed.select(scope)).distinct().withColumn("_seen", F.lit(1))
    rest = old.join(listed.select(key), key, "left_anti").join(seen, scope, "left").select(key, (F.col("misses") + F.coalesce("_seen", F.lit(0))).alias("misses"))
    return listed.select(key, F.lit(0).cast("long").alias("misses")).unionByName(rest)


def identity_events(old: DataFrame, new: DataFrame, key: str, km: float = 0.5) -> DataFrame:
    """(key, event): what a listing (name2, lat2, lon2) says of a registry (name, lat, lon) by key. A name that another
    of the registry has is a conflict, which goes before all else."""
    owners = old.groupBy(F.col("name").alias("name2")).agg(F.min(key).alias("_a"), F.max(key).alias("_b"))
    rows = old.join(new.withColumn("_listed", F.lit(True)), key, "full_outer").join(owners, "name2", "left")
    other = (F.col("_a") != F.col(key)) | (F.col("_b") != F.col(key))
    moved = haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) > km
    event = F.when(F.col("_listed").isNull(), "unlisted").when(~F.col("name2").eqNullSafe(F.col("name")) & F.coalesce(other, F.lit(False)), "conflict").when(F.col("name").isNull(), "new")
    return rows.select(key, event.when(moved, "moved").when(F.col("name2") != F.col("name"), "renamed").otherwise("kept").alias("event"))


def merged_metadata(old: Column, new: Column, mark: str) -> Column:
    """The new map over the old one, but for keys that the old one marks as curated (`mark` before their name)."""
    kept = F.map_filter(new, lambda k, _: ~F.coalesce(F.map_contains_key(old, F.concat(F.lit(mark), k)), F.lit(False)))
    rest = F.map_filter(old, lambda k, _: ~F.map_contains_key(kept, k))
    return F.map_concat(rest, kept)


def appended_history(history: Column, entry: Column, most: int) -> Column:
    """A history with one more entry, of which the last `most` stay."""
    longer = F.concat(history, F.array(entry))
    return F.slice(longer, F.greatest(F.lit(1), F.size(longer) - most + 1), F.lit(most))
