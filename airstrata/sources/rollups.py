"""Aggregates that are kept up to date by what changed: a versioned table of partial sums by day beside one of readings.

The readings' log tells which days a commit touched. A refresh works those out anew, from those days' readings alone, and
replaces their sums; it notes the version of readings that it has seen, so nothing is missed or done twice, however late
a reading comes. Sums, counts and extremes by the finest key fold to any coarser one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import versions

_SEEN = "seen "


def seen(spark: SparkSession, rollup: str) -> int:
    """The version of readings that a rollup has; -1 if it has none."""
    return max((int(h["what"].removeprefix(_SEEN)) for h in versions.history(spark, rollup) if h["what"].startswith(_SEEN)), default=-1)


def refresh(spark: SparkSession, readings: str, rollup: str, partition: str, sums: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Bring a rollup up to the readings' latest version; returns the partitions that were worked out anew. `sums` makes
    the rollup's rows, with the partition's column, of readings."""
    at, _, folders = versions.state(spark, readings)
    before = versions.state(spark, readings, seen(spark, rollup))[2] if seen(spark, rollup) >= 0 else {}
    changed = {p for p in {*folders, *before} if folders.get(p) != before.get(p)}
    if not changed and versions.versions(spark, rollup):
        return []
    rows = sums(versions.read(spark, readings, at, changed.__contains__))
    old = versions.state(spark, rollup)[2]
    new = versions._written(rows, rollup, partition)
    versions._commit(spark, rollup, versions.state(spark, rollup)[0], f"{_SEEN}{at}", versions._schema(rows), new, [p for p in changed if p in old and p not in new], changed)
    return sorted(changed)
