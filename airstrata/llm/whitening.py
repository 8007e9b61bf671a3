"""Whitening of embeddings by an exact scatter of whole numbers.

Entries are scaled and rounded down to whole numbers x. Each distinct vector counts once. Tasks subtract a shift, the
floor of each dimension's mean, and add up y and the products y*y' without any rounding: blocks of rows are small enough
for every sum of a block to stay below 2**53, where floating point is exact, or are added as Python's integers where one
product alone passes that. A task's sums leave it in limbs of 30 bits, which Spark adds up as whole numbers of its own.
From n, S and C the driver forms n*C - S*S' in integers of any size: the shift drops out of it, and n*n times the
covariance is had with no rounding at all. Only then are entries divided, each rounded once, and decomposed by `eigh`.

What reaches the driver, and the model that goes to all tasks, is of the square of the dimension, whatever the rows.
Copies of a vector combine within tasks before the shuffle. A component's sign is that of its largest entry, so that it is
the same for all rows and runs.

Cases: rows whose vector is null or holds null, NaN or infinity are dropped; of several lengths that of most distinct vectors
counts, the shorter one at a tie, and other rows are dropped; vectors of length 0 have no components; products beyond 64
bits are kept as they would be by hand, and entries beyond 64 bits as the nearest of 64; components without variance (a
single distinct vector, or dimensions that depend on each other) are left out, so a row may have fewer than asked for; null
ids and repeated rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import discard, stage

SCALE, COMPONENTS = 256, 4
#: Bits of a limb; sums of limbs of up to 2**33 tasks stay within 64 bits.
LIMB = 30
WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


class Model(NamedTuple):
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # a column a component


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the rows that stay, with whole numbers."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(vector).isNotNull() & good).select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * scale)).alias("x"))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector of the commonest length once, written to the shared folder."""
    distinct = stage(rows.select("x").distinct(), "distinct-vectors")
    sizes = distinct.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()  # a row a length
    fit = distinct.where(F.size("x") == (sizes["size"] if sizes else 0))
    fit.staged_at = distinct.staged_at
    return fit


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A row a vector; of Python's integers where a number comes near 64 bits."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x if largest(x) < 1 << 62 else x.astype(object)


def largest(x: np.ndarray) -> int:
    return max(-int(x.min()), int(x.max())) if x.size else 0


def exact_sums(y: np.ndarray) -> list[int]:
    return (y if largest(y) * len(y) < 1 << 63 else y.astype(object)).sum(axis=0).tolist()


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y, as Python's integers."""
    rows = (1 << 53) // max(largest(y) ** 2, 1)
    if y.dtype == object or not rows:
        y = y.astype(object)
        return y.T @ y
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), rows):
        block = y[at : at + rows].astype(np.float64)
        total += (block.T @ block).astype(np.int64).astype(object)
    return total


def limbs(cells: list[int]) -> Iterator[tuple[int, int, int]]:
    """(cell, limb, value) of whole numbers of any size; a limb has its number's sign."""
    for cell, value in enumerate(cells):
        sign, rest, k = (-1 if value < 0 else 1), abs(value), 0
        while rest:
            yield cell, k, sign * (rest & (1 << LIMB) - 1)
            rest, k = rest >> LIMB, k + 1


def summed(df: DataFrame, cells_of, cells: int) -> list[int]:
    """The sums over all tasks of what `cells_of` makes of each batch's column x: that many whole numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * cells
        for batch in batches:
            if batch.num_rows:
                total = [a + b for a, b in zip(total, cells_of(batch.column("x")))]
        rows = list(zip(*limbs(total))) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64())], ["cell", "limb", "value"])

    out = [0] * cells
    for r in df.select("x").mapInArrow(add, "cell int, limb int, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value")).collect():  # limbs of a row a cell
        out[r.cell] += r.value << LIMB * r.limb
    return out


def scatter(fit: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of each dimension, and n*X'X - S*S', all exact."""
    n, *sums = summed(fit, lambda x: [len(x), *exact_sums(matrix(x, width))], 1 + width)
    shift = [s // n for s in sums]
    upper = np.triu_indices(width)

    def shifted(x: pa.ListArray) -> list[int]:
        x = matrix(x, width)
        y = x - np.array(shift, object if x.dtype == object or max(map(abs, shift), default=0) >= 1 << 62 else np.int64)
        return [*exact_sums(y), *exact_products(y)[upper]]

    cells = summed(fit, shifted, width + len(upper[0]))
    own, products = cells[:width], np.zeros((width, width), object)
    products[upper] = cells[width:]
    products.T[upper] = cells[width:]
    return n, sums, n * products - np.outer(np.array(own, object), np.array(own, object))


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The components of most variance of a fit list; none of an empty one."""
    first = fit.select(F.size("x").alias("size")).first()
    if first is None or not first["size"]:
        return None
    n, sums, exact = scatter(fit, first["size"])
    values, vectors = np.linalg.eigh(np.array([[a / (n * n) for a in row] for row in exact], np.float64))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > len(values) * np.finfo(float).eps * max(values.max(), 0)]
    chosen = vectors[:, order]
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(order))])
    return Model(n, sums, sum(exact.diagonal()) / (n * n), values[order], chosen * signs)


def projected(x: np.ndarray, model: Model) -> tuple[list[int], np.ndarray]:
    """The exact deviation of each row, and its whitened places."""
    most = largest(x) * model.n + max(map(abs, model.sums), default=0)
    kind = np.int64 if x.dtype != object and most * most * len(model.sums) < 1 << 63 else object
    centred = x.astype(kind) * model.n - np.array(model.sums, kind)
    return (centred * centred).sum(axis=1).tolist(), (centred / model.n).astype(np.float64) @ (model.vectors / np.sqrt(model.values))


def identity_error(fit: DataFrame, model: Model) -> float:
    """The largest entry, by size, of the whitened fit list's covariance less the identity. The rows are centred already."""
    k, width = len(model.values), len(model.sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = projected(matrix(batch.column("x"), width), model)[1]
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], ["cell", "value"])

    cells = fit.select("x").mapInArrow(add, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # a row a cell
    cov = np.zeros(k * k)
    for r in cells:
        cov[r.cell] = r.value / model.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max(initial=0))


def whitened(df: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """A row for each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    rows = whole_vectors(df, key, vector, scale)
    fit = fit_list(rows)
    model = fitted(fit, components)
    if model is None or not len(model.values):
        discard(fit)
        return df.sparkSession.createDataFrame([], f"{WHITENED}, identity_error double")
    error, width, k = identity_error(fit, model), len(model.sums), len(model.values)
    discard(fit)  # the model is all that the result needs of it

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, w = projected(matrix(batch.column("x"), width), model)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(batch.num_rows), k)))
            columns = [
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(ids), model.n)),
                pa.array([d for d in deviation for _ in range(k)], pa.decimal128(38, 0)), pa.array(w.ravel()), pa.array(np.tile(model.values / model.trace, batch.num_rows)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.where(F.size("x") == width).mapInArrow(project, WHITENED).withColumn("identity_error", F.lit(error))


def op12_exact_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the four components of most variance."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
