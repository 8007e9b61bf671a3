"""Packing along a space-filling curve.

Each document becomes a hashed vector of its byte trigrams, projected by fixed random signs to a few dimensions and
squashed to a grid; its Hilbert key orders it. Documents are range-sorted by that key, encoded as they stream by, and
their ids fill sequences one after another along the curve, so that neighbours share sequences and only the very last
sequence is padded.

Cases: a null text is empty and has the end id alone; equal keys are ordered by the text's hash, then by id, so that
repeated rows spread over tasks; an empty table gives an empty result; a document of any length is cut at sequence
ends; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage_path, whole
from .tokens import END_ID, encoder, slices

SEQUENCE = 1024
#: Dimensions, bits for each, buckets of the hashed vector, and how far the mean sign is stretched before squashing.
DIMS, BITS, BUCKETS, STRETCH = 3, 16, 1 << 16, 12.0
#: Bytes whose trigrams are looked up at once.
BLOCK = 1 << 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ORDERED = "doc_id long, part int, local_start long, n_ids long, ids binary"


def signs(dims: int = DIMS, buckets: int = BUCKETS, seed: int = 20240) -> np.ndarray:
    """The projection: for each bucket a bit for each dimension, 21 bits apart, so that one sum adds up all of them."""
    bits = np.random.default_rng(seed).integers(0, 2, (dims, buckets)).astype(np.uint64)
    return sum(bits[d] << np.uint64(21 * d) for d in range(dims))


def _hashes(b: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams of some bytes."""
    c = b.astype(np.uint32)
    return (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)


def project(text: bytes, table: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Mean sign over the hashed byte trigrams of a text, for each dimension; 1 for a bit, -1 for none."""
    b = np.frombuffer(text, np.uint8)
    if len(b) < 3:
        b = np.concatenate([b, np.zeros(3 - len(b), np.uint8)])
    total = np.zeros(dims, np.int64)
    for at in range(0, len(b) - 2, BLOCK):
        both = int(table[_hashes(b[at : at + BLOCK + 2])].sum(dtype=np.uint64))
        total += [both >> 21 * d & (1 << 21) - 1 for d in range(dims)]
    return 2 * total / (len(b) - 2) - 1


def projected(texts: pa.Array, table: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """`project` of each text of an Arrow column without nulls; short texts that lie together are summed up at once, in
    blocks that stay in a core's cache."""
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    out, at = np.empty((len(raw), dims)), 0
    while at < len(raw):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
        starts, sizes = ends[at:stop] - ends[at], np.diff(ends[at : stop + 1])
        some = np.flatnonzero((sizes >= 3) & (sizes <= BLOCK))
        if len(some):
            values = np.append(table[_hashes(data[ends[at] : ends[stop]])], np.uint64(0))
            bounds = np.stack([starts[some], starts[some] + sizes[some] - 2], 1).ravel()
            both = np.add.reduceat(values, bounds)[::2]
            for d in range(dims):
                out[at + some, d] = 2 * (both >> np.uint64(21 * d) & np.uint64((1 << 21) - 1)).astype(np.int64) / (sizes[some] - 2) - 1
        for i in np.flatnonzero((sizes < 3) | (sizes > BLOCK)).tolist():
            out[at + i] = project(data[ends[at + i] : ends[at + i + 1]].tobytes(), table, dims)
        at = stop
    return out


def hilbert_key(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of `grid` (points by dimensions, whole numbers below 2**bits).

    The usual bit transform: undo the excess rotations from the highest bit down, Gray-code across dimensions, then
    interleave the bits of all dimensions."""
    x = [grid[:, d].astype(np.uint64) for d in range(grid.shape[1])]
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        q, low = one << np.uint64(bit), (one << np.uint64(bit)) - one
        for d in range(len(x)):
            high = (x[d] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        turn = np.where(x[-1] & q, turn ^ (q - one), turn)
    x = [v ^ turn for v in x]
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for v in x:
            key = key << one | (v >> np.uint64(bit)) & one
    return key.astype(np.int64)


def curve_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, curve): the documents with their places on the curve."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = signs()
        for batch in batches:
            if batch.num_rows:
                means = projected(batch.column("text"), table)
                grid = ((np.tanh(means * STRETCH) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(hilbert_key(grid), pa.int64())], ["doc_id", "text", "curve"])

    df = docs.select(F.col(key).cast("long").alias("doc_id"), whole(text).alias("text"))
    return df.mapInArrow(place, "doc_id long, text string, curve long")


def encoded_along_curve(placed: DataFrame, path: str, vocabulary: str | None = None, frugal: bool = False) -> None:
    """Range-sort by the curve and write each document's ids with its place in its part. With `frugal` a worker forgets
    the chunks that it knows after each task: that takes longer, and leaves the memory to the stages that follow."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, start = encoder(vocabulary), np.array([END_ID], "<u4").tobytes(), 0
        for batch in batches:
            own, parts, at = batch.column("doc_id").to_pylist(), batch.column("part"), 0
            for some in slices(batch.column("text").to_pylist()):
                codes = [c + end for c in enc.encode(some)]
                sizes = np.array([len(c) // 4 for c in codes], np.int64)
                starts = start + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at : at + len(codes)], pa.int64()), parts[at : at + len(codes)], pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([short(c) for c in codes], pa.binary())],
                    ["doc_id", "part", "local_start", "n_ids", "ids"],
                )
                at += len(codes)
        if frugal:
            enc.known = {}

    df = placed.withColumn("h", F.xxhash64("text")).repartitionByRange("curve", "h", "doc_id").sortWithinPartitions("curve", "h", "doc_id")
    df.withColumn("part", F.spark_partition_id()).select("doc_id", "text", "part").mapInArrow(encode, ORDERED).write.option("compression", "zstd").parquet(path)


def short(code: bytes) -> bytes:
    """Ids in 16 bits where they fit, with the width in front."""
    ids = np.frombuffer(code, "<u4")
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\x04" + code


def long_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def packed(spark: SparkSession, path: str, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of the sequences. The ids before each part come from one row for each part of the sort."""
    rows = spark.read.schema(ORDERED).parquet(path)
    before, bases = 0, {}
    for r in rows.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row for each task of the sort
        bases[r.part], before = before, before + r.n

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(8)]
            for doc, part, local, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "local_start", "ids"))):
                ids, first = long_ids(data), bases[part] + local
                cuts = [0, *range(length - first % length, len(ids), length), len(ids)]
                for a, b in zip(cuts, cuts[1:]):
                    for x, v in zip(out, (doc, a, b - a, zlib.crc32(ids[a:b]), len(ids), (first + a) // length, (first + a) % length, ids[a:b].tobytes() if with_ids else None)):
                        x.append(v)
            names = PIECES.replace(" long", "").split(", ")
            arrays = [pa.array(x, pa.int64()) for x in out[:7]] + ([pa.array(out[7], pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    return rows.mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, vocabulary: str | None = None, with_ids: bool = False, frugal: bool = False) -> DataFrame:
    """Documents in sequences of `length` ids along the curve: a row for each piece, with its ids if asked for."""
    path = stage_path(docs.sparkSession, "curve")
    encoded_along_curve(curve_keys(docs, key, text), path, vocabulary, frugal)
    return packed(docs.sparkSession, path, length, with_ids)


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    return pack(documents(spark, sf_dir))
