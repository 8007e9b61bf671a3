"""Best-fit packing in rounds: groups pack on their own, what they cannot fill goes on to larger groups.

A document is encoded and ends with an id of its own. One longer than a sequence is cut from its end on, so that all its
pieces but the first are full sequences; these need no packing. The other pieces are dealt by a hash into groups of about
`GROUP` pieces, so that each group is like the whole table whatever its order. A group puts its pieces, longest first,
each into the sequence that it leaves the least room in. Sequences with at most `SLACK` ids of room are done. The others
go to the next round as items of their own, in an eighth as many groups, where they are fitted into one another, until one
group has seen all or a round joins fewer than one in a thousand. A group is never more than about `GROUP` pieces, however
many stay underfull, so no task grows with the table. Rows are pieces with their places; a sequence that moves takes all
its pieces along.

Sequences are named by the first piece in them. With `with_ids` the ids of every piece come along.

Cases: a null text is empty and has the end id alone; repeated rows are packed each; null ids are kept; an empty table gives
an empty result; a document of any length is cut as above; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage
from .tokens import encoder, slices

SEQUENCE, END_ID = 1024, 2
#: Pieces of a group, room that a finished sequence may have, and how many groups meet in one of the next round.
GROUP, SLACK, FAN_IN = 20_000, 2, 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", item long, sequence_id long, offset long"


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """All documents' pieces: the rest of `length` first, then full ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            own, at = batch.column("doc_id").to_pylist(), 0
            for some in slices(value.as_py() for value in batch.column("text")):
                out = [[] for _ in range(6)]
                for doc, code in zip(own[at:], enc.encode(some)):
                    ids = np.frombuffer(code + end, "<u4")
                    cuts = [0, *range(len(ids) % length or length, len(ids), length), len(ids)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for x, v in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b]), ids[a:b].tobytes())):
                            x.append(v)
                at += len(some)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def best_fit(sizes: np.ndarray, names: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sequence each item goes to, and its place there. Items go largest first, at a tie that of the least name;
    each into the sequence with the least room that holds it, or opens one."""
    order = np.lexsort((names, -sizes))
    owner, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_, used = [[] for _ in range(room + 1)], 0  # sequences by the room that they have; bit r of `used`: there are some
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = used >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            sequence = open_[left].pop()
            if not open_[left]:
                used ^= 1 << left
        else:
            left, sequence = room, i
        owner[i], place[i] = sequence, room - left
        if left > size:
            open_[left - size].append(sequence)
            used |= 1 << left - size
    return names[owner], place


def fitted_group(rows: pa.Table, room: int) -> pa.Table:
    """The pieces of a group with the sequences and places that they have now."""
    names, which = np.unique(rows.column("sequence_id").to_numpy(), return_inverse=True)
    sizes = np.bincount(which, weights=rows.column("length").to_numpy()).astype(np.int64)
    owner, place = best_fit(sizes, names, room)
    rows = rows.set_column(rows.schema.get_field_index("offset"), "offset", pa.array(rows.column("offset").to_numpy() + place[which]))
    rows = rows.set_column(rows.schema.get_field_index("sequence_id"), "sequence_id", pa.array(owner[which]))
    own, at = np.unique(owner[which], return_inverse=True)
    filled = np.bincount(at, weights=rows.column("length").to_numpy()).astype(np.int64)
    return rows.append_column("filled", pa.array(filled[at]))


def packed(items: DataFrame, room: int = SEQUENCE, group: int = GROUP, slack: int = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """Rows of PLACED, all shorter than `room`, in as few sequences as the rounds find; `sequence_id` is the item at first."""
    done, now, n, groups = None, items, items.count(), None
    entering = n
    while n:
        least = -(-n // group)
        groups = least if groups is None else max(least, -(-groups // fan_in))
        dealt = now.withColumn("g", F.pmod(F.xxhash64("sequence_id", F.lit(groups)), F.lit(groups)))
        fitted = dealt.groupBy("g").applyInArrow(lambda rows: fitted_group(rows.drop_columns(["g"]), room), PLACED + ", filled long")
        fitted = stage(fitted, "fitted")
        first, open_ = F.col("offset") == 0, F.col("filled") < room - slack
        n, underfull, left = fitted.agg(F.count(F.when(open_, 1)), F.count(F.when(first & open_, 1)), F.count(F.when(first, 1))).first()
        last = groups == 1 or left > 0.999 * entering
        out = (fitted if last else fitted.where(~open_)).drop("filled")
        done = out if done is None else done.union(out)
        if last:
            break
        now, entering = fitted.where(open_).drop("filled"), underfull
    return items if done is None else done


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """Documents in few sequences of `length` ids: a row for each piece, with its ids if asked for."""
    cut = stage(pieces(docs, key, text, length, end_id, vocabulary, with_ids).withColumn("item", F.monotonically_increasing_id()), "pieces")
    rows = cut.drop("ids").withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long")})
    placed = rows.where(F.col("length") == length).union(packed(rows.where(F.col("length") < length), length, group))
    if with_ids:
        placed = placed.join(cut.select("item", "ids"), "item")
    return placed.drop("item")


def op13_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return pack(documents(spark, sf_dir))
