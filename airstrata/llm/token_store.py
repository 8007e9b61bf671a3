"""A store of token ids: one concatenated id array in key order, its document boundaries Elias-Fano encoded.

Tasks of a range-sorted table write blocks of about `block_ids` ids. A block holds its ids, its keys and the ends of
its documents as an Elias-Fano sequence: about 2 + log2(ids / documents) bits for each document, in place of 64. A
sampled select structure finds the k-th end without decoding the rest. Blocks are rows of a Parquet folder, so that
any store that Spark writes and reads can hold them.

Cases: a null text is empty and has the end id alone; null keys come first; equal keys are ordered by the text's hash,
and repeated rows are stored each; an empty table gives an empty store; a document is never cut, so a block is as
large as its largest document needs; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, stage_path, whole
from .tokens import END_ID, encoder, slices

BLOCK_IDS = 1 << 20
SAMPLE = 256
BLOCK_SCHEMA = "part int, block int, local_start long, n_ids long, keys binary, ids binary, bounds binary"
_HEAD = struct.Struct("<QQB7x")


def ef_encode(values: np.ndarray, upper: int) -> bytes:
    """A sorted sequence of values from 0 to `upper`: low bits packed, high bits in unary, every SAMPLE-th place."""
    n = len(values)
    low = max(0, int(np.floor(np.log2(max(1, upper) / max(1, n)))))
    v = np.asarray(values, dtype=np.uint64)
    bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
    at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros((upper >> low) + n + 1, dtype=np.uint8)
    high[at] = 1
    samples = at[::SAMPLE].astype("<u4") if n else np.zeros(0, "<u4")
    return _HEAD.pack(n, upper, low) + samples.tobytes() + lows.tobytes() + np.packbits(high, bitorder="little").tobytes()


class EliasFano:
    """Reads what `ef_encode` wrote."""

    def __init__(self, data: bytes):
        self.n, upper, self.low = _HEAD.unpack_from(data)
        at = _HEAD.size
        k = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", k, at)
        at += 4 * k
        size = -(-self.n * self.low // 8)
        self.lows = np.frombuffer(data, np.uint8, size, at)
        self.high = np.frombuffer(data, np.uint8, -1, at + size)

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low:
            return np.zeros(count, np.int64)
        a, b = first * self.low, (first + count) * self.low
        bits = np.unpackbits(self.lows[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a].reshape(count, self.low)
        return bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

    def select(self, k: int) -> int:
        """The k-th value: from the nearest sampled place on, over the high bits that hold at most SAMPLE ones."""
        block = k // SAMPLE
        a = int(self.samples[block])
        b = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[a // 8 : -(-(b + 1) // 8)], bitorder="little"))
        at = ones[np.searchsorted(ones, a % 8) + k % SAMPLE] + 8 * (a // 8)
        return int((at - k) << self.low | int(self._lows(k, 1)[0]))

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return (at - np.arange(self.n) << self.low) | self._lows(0, self.n)


def ordered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents range-partitioned and sorted by key; equal keys are spread by the text's hash."""
    df = docs.select(F.col(key).cast("long").alias("key"), whole(text).alias("text")).withColumn("h", F.xxhash64("text"))
    return df.repartitionByRange("key", "h").sortWithinPartitions("key", "h").withColumn("part", F.spark_partition_id())


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, block_ids: int = BLOCK_IDS, **columns: str) -> None:
    """Encode documents after the sort, where they stream by in order, and write blocks."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        keys, ids, ends, n, part, block, start = [], [], [], 0, None, 0, 0

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u4")
            flat = flat.astype("<u2") if not len(flat) or flat.max() < 1 << 16 else flat
            # width of an id and the null keys, then the keys
            known = np.array([k is not None for k in keys])
            head = struct.pack("<II", flat.itemsize, len(keys)) + np.packbits(known).tobytes()
            own = head + np.array([k or 0 for k in keys], "<i8").tobytes()
            row = [[part], [block], [start], [n], [own], [flat.tobytes()], [ef_encode(np.array(ends), n)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["part", "block", "local_start", "n_ids", "keys", "ids", "bounds"])

        for batch in batches:
            at = 0
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            own = batch.column("key").to_pylist()
            for some in slices(batch.column("text").to_pylist()):
                for code in enc.encode(some):
                    keys.append(own[at])
                    ids.append(code + end)
                    n += len(code) // 4 + 1
                    ends.append(n)
                    at += 1
                    if n >= block_ids:
                        yield flush()
                        keys, ids, ends, start, n, block = [], [], [], start + n, 0, block + 1
        if keys:
            yield flush()

    ordered(docs, **columns).select("key", "text", "part").mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def block_keys(own: bytes) -> tuple[list[int | None], int]:
    """Keys of a block and the bytes of an id."""
    width, n = struct.unpack_from("<II", own)
    known = np.unpackbits(np.frombuffer(own, np.uint8, -(-n // 8), 8))[:n]
    values = np.frombuffer(own, "<i8", n, 8 + -(-n // 8))
    return [int(v) if k else None for k, v in zip(known, values)], width


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document from the files alone.

    The ids before each part come from one row for each part, so that table is bounded by the writer's tasks."""
    rows = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("part", F.coalesce(before, F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("base", "local_start", "keys", "ids", "bounds")}
                keys, width = block_keys(row["keys"])
                ids = np.frombuffer(row["ids"], f"<u{width}").astype("<u4")
                ends = EliasFano(row["bounds"]).all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(starts + row["base"] + row["local_start"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return rows.join(F.broadcast(base), "part").select("base", "local_start", "keys", "ids", "bounds").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, part: int, block: int, k: int) -> np.ndarray:
    """The ids of the k-th document of a block: two selects and a slice."""
    row = spark.read.schema(BLOCK_SCHEMA).parquet(path).where((F.col("part") == part) & (F.col("block") == block)).select("keys", "ids", "bounds").first()
    ef, (_, width) = EliasFano(row.bounds), block_keys(row.keys)
    a = ef.select(k - 1) if k else 0
    return np.frombuffer(row.ids, f"<u{width}")[a : ef.select(k)].astype(np.uint32)


def op9_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents to a store, and read every document's place back from its files."""
    path = stage_path(spark, "token-store")
    write_store(documents(spark, sf_dir), path)
    return read_store(spark, path)
