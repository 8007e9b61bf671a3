"""Functions of tables and aggregates in Python, beside the built-in forms that do the same: for SQL users who call them."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException


class LatestRow:
    """latest_row(TABLE(t), 'key', 'ts'): the last row by `ts` of each key of any table; its columns are the table's own."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, ts: AnalyzeArgument) -> AnalyzeResult:
        names = rows.dataType.fieldNames()
        for a in (key, ts):
            if a.value not in names:
                raise ValueError(f"no column {a.value!r}; there are {', '.join(names)}")
        order = [OrderingColumn(ts.value, ascending=False, overrideNullsFirst=False), *[OrderingColumn(n) for n in names if n not in (key.value, ts.value)]]
        return AnalyzeResult(schema=rows.dataType, partitionBy=[PartitioningColumn(key.value)], orderBy=order)

    def eval(self, rows, key, ts):
        if not getattr(self, "done", False):
            self.done = True
            yield tuple(rows)
            return
        raise SkipRestOfInputTableException("the first row of a key is its last reading")


def wind_mean(degrees: pa.Array, speed: pa.Array) -> float:
    """The direction that a speed-weighted mean of winds comes from; None where they cancel out."""
    turn = pc.multiply(degrees, math.pi / 180)
    u, v = (pc.mean(pc.multiply(pc.negate(speed), f(turn))).as_py() for f in (pc.sin, pc.cos))
    return None if u is None or v is None or math.hypot(u, v) < 1e-9 else (630 - math.degrees(math.atan2(v, u))) % 360


def register(spark: SparkSession) -> None:
    """Make `latest_row` and `wind_mean` known to SQL."""
    spark.udtf.register("latest_row", F.udtf(LatestRow))
    spark.udf.register("wind_mean", F.arrow_udf(wind_mean, "double", F.ArrowUDFType.GROUPED_AGG))
