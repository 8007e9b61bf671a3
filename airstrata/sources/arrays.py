"""Arrays on a grid (time, row, col, value) as tiles in files: a Spark data source that writes and reads them.

A tile is one Arrow file: the values of a square of cells at one time, in order of rows and columns; a value that is not
known is null. The last step of a write is the list of tiles, so a write that dies leaves no array. Reading makes a task of each
few tiles, and of the tiles only those that a filter on time, row or col can want: the list tells their places, so the
others are not opened. Paths are any that Arrow's file systems know. `options`: tile (cells a side, 64 if not told).

Rows must come with the cells of a tile together, as `write_tiles` sees to; values are doubles.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

TILE, AT_ONCE = 64, 16
SCHEMA = "time long, row int, col int, value double"
_LIST = "_tiles.json"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArrayWriter(self.options["path"], int(self.options.get("tile", TILE)))


@dataclass
class Tiles(InputPartition):
    names: list[str]
    limits: dict[str, tuple[float, float]]


class ArrayReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        #: Of each column the least and the most that filters let through.
        self.limits = {"time": (-np.inf, np.inf), "row": (-np.inf, np.inf), "col": (-np.inf, np.inf)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, value = f.attribute[0] if hasattr(f, "attribute") else None, getattr(f, "value", None)
            if column in self.limits and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)):
                low, high = self.limits[column]
                at = f.value if isinstance(f, In) else (value,)
                if isinstance(f, (EqualTo, In)):
                    low, high = max(low, min(at)), min(high, max(at))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = max(low, value)
                else:
                    high = min(high, value)
                self.limits[column] = (low, high)
            yield f  # Spark looks at the rows too: limits only choose tiles

    def tiles(self) -> list[str]:
        """The tiles that can hold what the filters want."""
        store, at = _files(self.path)
        with store.open_input_file(f"{at}/{_LIST}") as f:
            known = json.loads(f.read())
        meets = lambda t, c, a, b: t[a] <= self.limits[c][1] and t[b] >= self.limits[c][0]
        return [t["name"] for t in known if meets(t, "time", "time", "time") and meets(t, "row", "row", "last_row") and meets(t, "col", "col", "last_col")]

    def partitions(self) -> list[Tiles]:
        names = self.tiles()
        return [Tiles(names[i : i + AT_ONCE], self.limits) for i in range(0, len(names), AT_ONCE)] or [Tiles([], self.limits)]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        store, at = _files(self.path)
        for name in partition.names:
            with store.open_input_file(f"{at}/{name}") as f:
                yield from pa.ipc.open_file(f).read_all().to_batches()


@dataclass
class Written(WriterCommitMessage):
    tiles: list[dict]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, tile: int):
        self.path, self.tile = path, tile

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """A file for each tile of this task. Rows come sorted by time and tile, so one tile is held at a time."""
        store, at = _files(self.path)
        store.create_dir(at, recursive=True)
        out, held, now = [], [], None

        def flush() -> None:
            rows = pa.Table.from_batches(held).sort_by([("row", "ascending"), ("col", "ascending")]).combine_chunks()
            name = f"{uuid.uuid4().hex}.arrow"
            with store.open_output_stream(f"{at}/{name}") as f, pa.ipc.new_file(f, rows.schema) as sink:
                sink.write_table(rows)
            row, col = rows.column("row").to_numpy(), rows.column("col").to_numpy()
            out.append({"name": name, "time": now[0], "row": int(row.min()), "last_row": int(row.max()), "col": int(col.min()), "last_col": int(col.max())})

        for batch in batches:
            batch = batch.select(["time", "row", "col", "value"])
            key = np.stack([batch.column("time").to_numpy(), batch.column("row").to_numpy() // self.tile, batch.column("col").to_numpy() // self.tile], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)] if len(key) else []
            for a, b in zip(cuts, cuts[1:]):
                if held and tuple(key[a].tolist()) != now:
                    flush()
                    held = []
                now = tuple(key[a].tolist())
                held.append(batch.slice(a, b - a))
        if held:
            flush()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _files(self.path)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/{_LIST}.new") as f:
            f.write(json.dumps([t for m in messages if m for t in m.tiles]).encode())
        store.move(f"{at}/{_LIST}.new", f"{at}/{_LIST}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _files(self.path)
        for m in messages:
            for t in m.tiles if m else []:
                store.delete_file(f"{at}/{t['name']}")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArraySource)


def write_tiles(df: DataFrame, path: str, tile: int = TILE) -> None:
    """Write an array (time, row, col, value) as tiles; cells without a time or a place are left out, of equal cells the
    greatest value counts. Cells of a tile meet in one task: a tile is a bounded square."""
    register(df.sparkSession)
    rows = df.select(F.col("time").cast("long"), F.col("row").cast("int"), F.col("col").cast("int"), F.col("value").cast("double")).where("time is not null and row is not null and col is not null")
    rows = rows.groupBy("time", "row", "col").agg(F.max("value").alias("value"))
    key = ["time", F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)]
    rows.repartition(*key).sortWithinPartitions(*key).write.format("tiles").option("tile", tile).mode("append").save(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("tiles").load(path)


def nearest_slice(spark: SparkSession, path: str, time: int, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The window of rows and columns (ends included) at the stored time nearest to one, the earlier of two; the list of
    tiles tells the times, so only that time's tiles are read."""
    store, at = _files(path)
    with store.open_input_file(f"{at}/{_LIST}") as f:
        times = {t["time"] for t in json.loads(f.read())}
    near = min(times, key=lambda t: (abs(t - time), t), default=None)
    out = read_tiles(spark, path)
    return out.where(F.col("time") == F.lit(near) if near is not None else F.lit(False)).where(F.col("row").between(*rows) & F.col("col").between(*cols))


def block_means(array: DataFrame, height: int, width: int) -> DataFrame:
    """(time, by, bx, mean, n_valid, n): of each block of cells the mean of what is known, and how many are."""
    key = ["time", F.floor(F.col("row") / height).alias("by"), F.floor(F.col("col") / width).alias("bx")]
    return array.groupBy(*key).agg(F.avg("value").alias("mean"), F.count("value").alias("n_valid"), F.count("*").alias("n"))
