"""Screening of readings: bounds field by field, flags and states, the merge of states, anchored flat lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of each field (least, most; None is open), and the fields whose flags make a reading invalid.
BOUNDS = {
    "pm25": (0.0, 2000.0), "pm10": (0.0, 5000.0), "no2": (0.0, 2000.0), "humidity": (0.0, 100.0),
    "temp_c": (-60.0, 80.0), "wind_speed_ms": (0.0, 150.0), "wind_dir_deg": (0.0, 360.0),
}
PRIMARY = ("pm25", "aqi_us")
# Instrument bounds.
SENTINELS, CEILING, HIGH_HUMIDITY = (-1.0, 999.0, 1000.0), 1000.0, 90.0
INSTRUMENT = {"humidity": (0.0, 100.0), "temp": (-60.0, 80.0), "pressure": (50.0, 120.0), "wind": (0.0, 150.0)}


def fault(field: str, value: Column) -> Column:
    """Why a value is impossible, or null."""
    least, most = BOUNDS[field]
    low = "negative" if least == 0 else "below_min"
    out = F.when(F.isnan(value) | (F.abs(value) == float("inf")), "nonfinite").when(value < least, low)
    return out.when(value > most, "above_max")


def quarantined(df: DataFrame, fields: list[str]) -> DataFrame:
    """Impossible values as nulls, with `flags` (v:field:reason, sorted), `present` fields and the `state`."""
    flags = F.array_compact(F.array(*[F.concat(F.lit(f"v:{f}:"), fault(f, F.col(f))) for f in fields]))
    df = df.withColumn("flags", F.array_sort(flags))
    good = {f: F.when(fault(f, F.col(f)).isNull(), F.col(f)) for f in fields}
    df = df.withColumns(good)
    present = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]))
    return df.withColumn("present", present).withColumn("state", state_of(F.col("flags")))


def field_of(flag: Column) -> Column:
    """The field that a validation flag names; null for other flags."""
    return F.when(flag.startswith("v:"), F.element_at(F.split(flag, ":"), 2))


def state_of(flags: Column) -> Column:
    """INVALID when a validation flag names a primary field."""
    return F.when(F.exists(flags, lambda f: F.coalesce(field_of(f).isin(*PRIMARY), F.lit(False))), "INVALID").otherwise("raw")


def merged_flags(state: Column, old: Column, new: Column, present: Column) -> Column:
    """State and flags of a stored reading that meets an incoming one: curated ones stay, those found invalid by other
    means too, and validation flags heal for the fields that are now present."""
    union = F.array_sort(F.array_union(old, new))
    other = F.exists(old, lambda f: ~f.startswith("v:"))
    left = F.array_sort(F.array_union(F.filter(old, lambda f: ~F.coalesce(F.array_contains(present, field_of(f)), F.lit(False))), new))
    keep = state.isin("OK", "SUSPECT") | ((state == "INVALID") & other)
    keep = F.coalesce(keep, F.lit(False))
    return F.struct(F.when(keep, state).otherwise(state_of(left)).alias("state"), F.when(keep, union).otherwise(left).alias("flags"))


def instrument_flags(pm25: Column, humidity: Column, temp: Column, pressure: Column, wind: Column) -> Column:
    out = lambda name, x: F.when((x < INSTRUMENT[name][0]) | (x > INSTRUMENT[name][1]), f"{name}_oor")
    main = F.when(pm25.isNull(), "pm25_missing").when(pm25.isin(*SENTINELS), "pm25_sentinel").when((pm25 < 0) | (pm25 > CEILING), "pm25_oor")
    return F.array_compact(F.array(main, F.when(humidity > HIGH_HUMIDITY, "high_rh"), out("humidity", humidity), out("temp", temp), out("pressure", pressure), out("wind", wind)))


def instrument_state(flags: Column) -> Column:
    return F.when(F.exists(flags, lambda f: f.startswith("pm25_")), "INVALID").otherwise("OK")


FLAT = "begins timestamp_ntz, ends timestamp_ntz, hours double, value double"


def anchored_flat_lines(df: DataFrame, key: str, ts: str, low: str, high: str, hours: float = 6.0, tolerance: float = 1.0, step_hours: float = 1.0) -> DataFrame:
    """Runs of buckets that stay within `tolerance` of the first one's middle, of `hours` or more.

    The anchor is where the run before ended, so each series is walked in order: one series is a task's whole load.
    A missing bucket, or one that varies by more than the tolerance, ends a run."""
    least = max(2, int(hours / step_hours))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        when, mid = pdf[ts].tolist(), ((pdf[high] + pdf[low]) / 2).where((pdf[high] - pdf[low]).abs() <= tolerance).tolist()
        after = [*when[1:], when[-1] + pd.Timedelta(hours=step_hours)]
        out, begin = [], None

        def close(stop: int) -> None:
            if begin is not None and stop - begin >= least:
                out.append((when[begin], after[stop - 1], (stop - begin) * step_hours, mid[begin]))

        for i, x in enumerate(mid):
            flat = x == x
            if begin is not None and not (flat and abs(x - mid[begin]) <= tolerance):
                close(i)
                begin = None
            if flat and begin is None:
                begin = i
        close(len(mid))
        rows = pd.DataFrame(out, columns=["begins", "ends", "hours", "value"])
        rows.insert(0, key, pdf[key].iloc[0])
        return rows

    return df.select(key, ts, low, high).groupBy(key).applyInPandas(walk, f"{key} {dict(df.dtypes)[key]}, {FLAT}")
