"""Exact Jaccard self-join of documents' word shingles with count-vector R-trees.

1. A document's shingles are hashed; equal sets fold into one class, whose least key stands for it.
2. Two sets with a Jaccard index of t or more share one of the first n - ceil(t n) + 1 shingles under any order of all
   shingles. Each class goes to the cells of those; shingles that many documents hold come last in the order, so that
   passages of many documents make no large cells. The order decides the speed, never the result.
3. Cells of the same least class are one cell: a group of edited copies, which fills a cell for each shingle of its
   prefixes with about the same classes, has few least classes.
4. Each shingle hash belongs to one of a power of two of groups, about one for each shingle. A class's point is its
   counts by group. The sum of the lesser counts over all groups bounds the overlap of two sets; the sum against the
   largest counts below a node of an R-tree bounds it for all points there. A cell's tree is searched with each of its
   points, and of the pairs that the bound lets through, those that connect what is not yet connected go on.
5. These pairs are verified on the whole sets. Where one fails, all pairs that the bound lets through in its cell and
   that are not connected by others are verified too, so that no link between different parts is lost.
6. Components of the verified links give the result.

A cell of more than `BLOCK` classes is searched in blocks. What different blocks may still link is searched pair by
pair of blocks, in cells that hold several components after the first verification; blocks of the component that has
most of a cell meet those of the others only. A cell of S classes in as many components makes S * S / BLOCK rows.

Cases: null and empty texts and texts without words have no shingles and link with nothing; a text of fewer than
five words is one shingle; repeated rows and equal texts are in one component; a component's id is its least non-null
key; an empty table gives an empty result; texts of any length are taken whole; other columns are ignored. Shingles
and classes are told apart by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, documents, stage, whole
from .components import components

WORDS, PERCENT = 5, 80
#: Classes in one tree, children of a tree's node, shingles for each group of a point, pairs verified in one task group.
BLOCK, FAN, PER_GROUP, GROUP = 2048, 16, 1, 256
#: Most groups in a tree: points of very long texts are folded there, and compared in full after the search.
TREE_GROUPS = 1024
#: Most shingles that come last in the order, and what lossy counting in a task keeps at most.
MOST_FREQUENT, MOST_COUNTED = 100_000, 400_000
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


class Words:
    """Hashes of the words of byte strings, A-Z in lower case: a polynomial over a random number for each byte, from
    running sums, so that all words of a block are hashed in a few array operations."""

    def __init__(self, seed: int = 20240):
        random = np.random.default_rng(seed)
        self.codes = random.integers(1, 1 << 64, 256, np.uint64)
        self.codes[ord("A") : ord("Z") + 1] = self.codes[ord("a") : ord("z") + 1]
        self.base = random.integers(0, 1 << 61, dtype=np.uint64) * np.uint64(8) + np.uint64(5)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverses = np.ones(0, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base)]), dtype=np.uint64)
                self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.inverse)]), dtype=np.uint64)

    def block(self, data: np.ndarray) -> np.ndarray:
        """Of bytes that neither begin nor end within a word of the text."""
        self.grow(len(data) + 1)
        inside = np.concatenate([[False], ~self.blank[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverses[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)

    def __call__(self, text: bytes, at_once: int = 1 << 20) -> np.ndarray:
        data, out, at = np.frombuffer(text, np.uint8), [], 0
        while len(data) - at > at_once:
            cut = at + at_once
            while cut < len(data) and not self.blank[data[cut]]:
                cut += 1
            out.append(self.block(data[at:cut]))
            at = cut
        return np.concatenate([*out, self.block(data[at:])])


class Shingler:
    """Distinct shingle hashes of texts, sorted."""

    def __init__(self, words: int):
        self.words, self.hashes = words, Words()

    def all(self, text: str | None) -> np.ndarray:
        """Shingle hashes in the order of the text, repeated ones too."""
        data, k = (text or "").encode(), self.words
        h = self.hashes(data)
        if len(h) < k:
            words = data.lower().split()
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
        n = len(h) - k + 1
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total += h[i : i + n] * np.uint64(_MIX[i % len(_MIX)] + 2 * (i // len(_MIX)))
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        return total ^ total >> np.uint64(29)

    def __call__(self, text: str | None) -> np.ndarray:
        return np.unique(self.all(text))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def point(shingles: np.ndarray) -> bytes:
    """Counts by group, four bits each; groups double until no count passes them."""
    groups = 16
    while groups * PER_GROUP < len(shingles):
        groups *= 2
    while True:
        counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max(initial=0) < 16:
            return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
        groups *= 2


def unpacked(data: bytes) -> np.ndarray:
    """The counts of a point."""
    both = np.frombuffer(data, np.uint8)
    out = np.empty(2 * len(both), np.uint8)
    out[::2], out[1::2] = both & 15, both >> 4
    return out


class Tree:
    """A packed R-tree over points: each level has the largest counts and the size range below each node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Strips by size, and by the count that varies most within a strip.
        order = np.argsort(sizes, kind="stable")
        spread = int(np.argmax(points.std(axis=0))) if len(points) > FAN else 0
        strip = np.arange(len(order)) // (FAN * FAN)
        self.order = order[np.lexsort((points[order, spread], strip))]
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FAN:
            top, low, high = self.levels[-1]
            cuts = np.arange(0, len(top), FAN)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def search(self, p: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Places (in the given order) of all points that the bound does not exclude for a query point."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            at = at[(low[at] * percent <= 100 * n) & (high[at] * 100 >= percent * n)]
            bound = np.minimum(top[at], p).sum(axis=1, dtype=np.int64)
            # Overlap is at least percent / (100 + percent) of both sizes together.
            at = at[bound * (100 + percent) >= percent * (n + np.maximum(low[at], -(-percent * n // 100)))]
            if depth:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def folded(points: list[np.ndarray], groups: int) -> np.ndarray:
    return np.stack([p.reshape(-1, groups).sum(axis=0, dtype=np.uint16) for p in points])


class Bounds:
    """Whether the bound lets a pair of points through; what a task has found is kept, as pairs meet in many cells."""

    def __init__(self, percent: int, most: int = 300_000):
        self.percent, self.most, self.known = percent, most, {}

    def __call__(self, a: tuple, b: tuple, p: np.ndarray, q: np.ndarray) -> bool:
        """For two rows (id, size, ...) and their points."""
        key = (a[0], b[0]) if a[0] < b[0] else (b[0], a[0])
        if key not in self.known:
            if len(self.known) > self.most:
                self.known.clear()
            least, largest = sorted((a[1], b[1]))
            go = 100 * least >= self.percent * largest
            if go:
                if len(p) != len(q):
                    p, q = folded([p, q], min(len(p), len(q)))
                go = int(np.minimum(p, q).sum()) * (100 + self.percent) >= self.percent * (a[1] + b[1])
            self.known[key] = go
        return self.known[key]


def cell_pairs(token: int, rows: list[tuple], percent: int, bounds: Bounds) -> list[tuple[int, int]]:
    """Pairs of a cell that the bound lets through; rows are (id, size, point, side) or (id, size, point, side, label)
    in order of size and id. With no labels, only pairs that connect what is not yet connected; with labels, all
    between different labels, in the first of the open cells that a pair shares: rows are then (id, size, point, side,
    label, the id's open cells in order). With two sides, only pairs across them."""
    forest, two, out = len(rows[0]) == 4, len({r[3] for r in rows}) == 2, []
    open_cells = None if forest else [set(r[5]) for r in rows]
    part = np.arange(len(rows)) if forest else np.array([r[4] for r in rows])
    side = np.array([r[3] for r in rows])

    def take(x: int, partners: np.ndarray) -> None:
        """Partners come in order; all are before x."""
        if forest:
            _, first = np.unique(part[partners], return_index=True)
            partners = partners[np.sort(first)]
        for y in partners.tolist():
            if not forest and next(c for c in rows[x][5] if c in open_cells[y]) != token:
                continue
            out.append((min(rows[x][0], rows[y][0]), max(rows[x][0], rows[y][0])))
            if forest:
                part[part == part[x]] = part[y]

    points = [unpacked(r[2]) for r in rows]
    if len(rows) <= FAN:
        for x in range(1, len(rows)):
            for y in range(x):
                if part[x] != part[y] and not (two and side[x] == side[y]) and bounds(rows[x], rows[y], points[x], points[y]):
                    take(x, np.array([y]))
        return out
    n = np.array([r[1] for r in rows], np.int64)
    widths = np.array([min(len(p), TREE_GROUPS) for p in points])
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        # Pairs of different widths are found in the tree of the lesser one, from the points that have it.
        near = np.flatnonzero((widths >= width) & (n * percent <= 100 * n[own].max()) & (n * 100 >= percent * n[own].min()))
        flat = folded([points[i] for i in near], width)
        tree = Tree(flat, n[near])
        for at in np.flatnonzero(widths[near] == width).tolist():
            x = int(near[at])
            found = np.sort(near[tree.search(flat[at], int(n[x]), percent)])
            found = found[(part[found] != part[x]) & ((widths[found] != width) | (found < x))]
            found = found[side[found] != side[x]] if two else found
            if len(points[x]) > TREE_GROUPS:
                found = np.array([y for y in found.tolist() if bounds(rows[x], rows[y], points[x], points[y])], np.int64)
            take(x, found)
    return out


def frequent(docs: DataFrame, words: int, percent: int) -> np.ndarray:
    """Shingles that many documents hold, sorted: counted over all texts, by lossy counting within each task.

    A task drops what it has seen less often than once in `MOST_COUNTED` places, so its memory and what it sends on
    are bounded; the sums over tasks are cut at `MOST_FREQUENT` entries, which bounds what reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, waiting, held = Shingler(words), {}, [], 0
        # About where prefixes end: the part of all hashes that a prefix has.
        cut = np.uint64((100 - percent) * (1 << 64) // 100)

        def take() -> None:
            values, counts = np.unique(np.concatenate(waiting), return_counts=True)
            for v, c in zip(values.tolist(), counts.tolist()):
                seen[v] = seen.get(v, 0) + c
            waiting.clear()
            floor = 1
            while len(seen) > MOST_COUNTED:
                for v in [v for v, c in seen.items() if c <= floor]:
                    del seen[v]
                floor *= 2

        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = shingles.all(text)
                waiting.append(np.unique(own[own <= cut]))
                held += len(waiting[-1])
                if held > 200_000:
                    take()
                    held = 0
        if waiting:
            take()
        top = [(v, c) for v, c in seen.items() if c >= 4]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in top], pa.uint64()).view(pa.int64()), pa.array([c for _, c in top], pa.int64())], ["shingle", "n"])

    found = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n >= 32")
    rows = found.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def signatures(docs: DataFrame, often: np.ndarray, words: int, percent: int) -> DataFrame:
    """(key, h, n, cid, tokens, point) of each document: its class, its prefix by the order (cut to 32 bits) and its point."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            n, cid, tokens, points = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                n.append(len(own))
                cid.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63))
                late = often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own if len(often) else np.zeros(len(own), bool)
                tokens.append(np.concatenate([own[~late], own[late]])[: prefix_size(len(own), percent)].astype(np.uint32).view(np.int32))
                points.append(point(own))
            ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens) if tokens else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("h"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), flat, pa.array(points, pa.binary())], ["key", "h", "n", "cid", "tokens", "point"])

    return docs.select("key", "h", "text").mapInArrow(sign, "key long, h long, n long, cid long, tokens array<int>, point binary")


def search(cells: DataFrame, percent: int, labelled: bool) -> DataFrame:
    """(token, a, b) of each unit (token, i, j) of `cells`: rows cid, n, point, side and, if labelled, label
    and the class's open cells."""
    names = ["token", "i", "j", "cid", "n", "point", "side", *["label", "open"] * labelled]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, out, bounds = None, [], [], Bounds(percent)

        def end() -> None:
            if len(rows) > 1:
                out.extend((unit[0], a, b) for a, b in cell_pairs(unit[0], rows, percent, bounds))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64()))], ["token", "a", "b"])

        for batch in batches:
            for token, i, j, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if unit != (token, i, j):
                    end()
                    unit, rows = (token, i, j), []
                rows.append(tuple(row))
            if len(out) > 20_000:
                yield made()
                out = []
        end()
        yield made()

    return cells.select(*names).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "cid").mapInArrow(pairs, "token long, a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, ok) of distinct pairs of classes, on their whole shingle sets. A class's partners are met in groups of
    about `GROUP`, so that one with many is not met in one task."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("shares"))
    dealt = stage(pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share")), "pairs")
    centres = dealt.select("a", "share").distinct().select("a", "share", F.col("a").alias("cid"), F.lit(0).alias("side"))
    rows = centres.union(dealt.select("a", "share", F.col("b").alias("cid"), F.lit(1).alias("side"))).join(texts, "cid")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, own, base = Shingler(words), None, None
        for batch in batches:
            out = []
            for a, share, cid, side, text in zip(*(batch.column(c).to_pylist() for c in ("a", "share", "cid", "side", "text"))):
                now = shingles(text)
                if side == 0:
                    own, base = (a, share), now
                    continue
                assert own == (a, share)
                both = len(np.intersect1d(base, now, assume_unique=True))
                out.append((a, cid, 100 * both >= percent * (len(base) + len(now) - both)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "ok"])

    return rows.repartition("a", "share").sortWithinPartitions("a", "share", "side").select("a", "share", "cid", "side", "text").mapInArrow(check, "a long, b long, ok boolean")


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Documents as (key, n, cid), and (a, b) links between classes that connect all that similar documents connect."""
    often = frequent(docs, words, percent)
    signed = stage(signatures(docs, often, words, percent), "signatures")
    members = signed.select("key", "h", "n", "cid")
    # Rows of a class have equal tokens and points, so any of them stands for it.
    one = stage(signed.where("n > 0").dropDuplicates(["cid"]), "classes")
    held = stage(shared(one.select("cid", F.explode("tokens").alias("token"))), "cells")
    cells = united(held)
    discard(held)
    points = one.select("cid", "n", "point")
    first = cells.join(points, "cid").select("token", F.col("block").alias("i"), F.col("block").alias("j"), "cid", "n", "point", F.lit(0).alias("side"))
    first = stage(search(first, percent, False), "found")
    pairs = stage(first.select("a", "b").distinct(), "candidates")
    texts = class_texts(docs, one, pairs)
    checked = stage(verified(pairs, texts, words, percent), "checked")
    discard(texts)
    good = checked.where("ok").select("a", "b")
    failed = checked.where("not ok").select("a", "b")
    # Cells with a failed pair, and those of several blocks, are searched again between components. Points join last.
    again = first.join(failed, ["a", "b"], "left_semi").select("token").union(cells.where("blocks > 1").select("token")).distinct()
    label = components(good).withColumnRenamed("node", "cid")
    open_ = cells.join(again, "token").join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    open_ = stage(open_, "open")
    several = open_.groupBy("token").agg((F.min("label") != F.max("label")).alias("several")).where("several").select("token")
    open_ = stage(open_.join(stage(several, "several"), "token"), "open-several")
    own = points.join(open_.groupBy("cid").agg(F.sort_array(F.collect_set("token")).alias("open")), "cid")
    second = search(unconnected(open_).join(own, "cid"), percent, True).select("a", "b").distinct()
    second = stage(second.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "second")
    texts = class_texts(docs, one, second)
    more = stage(verified(second, texts, words, percent).where("ok").select("a", "b"), "more")
    # What the result reads from here on: signatures, checked pairs and the further links.
    discard(one, first, pairs, texts, open_, second)
    return members, good.union(more)


def shared(rows: DataFrame) -> DataFrame:
    """The rows (cid, token) of tokens that several classes hold."""
    held = rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    return rows.join(held, "token", "left_semi")


def united(held: DataFrame) -> DataFrame:
    """(token, cid, block, blocks): the cells to search, from the rows (token, cid) of tokens that classes share. Cells
    of the same least class are one, told by that class."""
    least = stage(held.groupBy("token").agg(F.min("cid").alias("least")), "least")
    cells = stage(held.join(least, "token").select(F.col("least").alias("token"), "cid").distinct(), "united-cells")
    discard(least)
    sizes = stage(cells.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "large-cells")
    blocks = F.coalesce("blocks", F.lit(1))
    return cells.join(sizes, "token", "left").select("token", "cid", F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"), blocks.alias("blocks"))


def class_texts(docs: DataFrame, one: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cid, text) of the classes in some pairs, each told by one document (key, h) that has its set."""
    wanted = stage(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "wanted")
    own = one.join(wanted, "cid", "left_semi").select("cid", F.xxhash64("key", "h").alias("_id"))
    rows = docs.select(F.xxhash64("key", "h").alias("_id"), "text").join(own, "_id").dropDuplicates(["_id"])
    return stage(rows.select("cid", "text"), "texts")


def unconnected(cells: DataFrame) -> DataFrame:
    """Units (token, i, j) of open cells, with sides where a unit has two: the blocks in which classes of different
    labels meet. In a cell of several blocks, blocks of its main label meet those of the other labels, and these each
    other."""
    columns = ["cid", "side", "label"]
    unit = lambda df, i, j, side: df.select("token", i.cast("int").alias("i"), j.cast("int").alias("j"), *[side.alias(c) if c == "side" else c for c in columns])
    one = unit(cells.where("blocks = 1"), F.lit(0), F.lit(0), F.lit(0))
    several = cells.where("blocks > 1")
    by = several.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token")
    rest_blocks = F.ceil((F.sum("c") - F.max("c")) / BLOCK).cast("int")
    main = stage(by.agg(F.max_by("label", F.struct("c", "label")).alias("main"), rest_blocks.alias("rest_blocks")), "main-labels")
    several = several.join(main, "token")
    is_main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("cid"), F.when(is_main, F.col("blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    several = several.withColumn("own", own)
    to = lambda df, n: df.withColumn("to", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    out = unit(to(several.where(is_main), "rest_blocks"), -1 - F.col("own"), F.col("to"), F.lit(1))
    rest = several.where(~is_main)
    out = out.union(unit(to(rest, "blocks"), -1 - F.col("to"), F.col("own"), F.lit(2)))
    side = F.when(F.col("own") == F.col("to"), 0).when(F.col("own") < F.col("to"), 1).otherwise(2)
    return one.union(out).union(unit(to(rest, "rest_blocks"), F.least("own", "to"), F.greatest("own", "to"), side))


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, h, n_shingles, component_id, first) of every document: h is its text's hash, and `first` holds for the
    one of a component with the least key, nulls last, and of these the least h; also for all without shingles."""
    own = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(whole(text)).alias("h"), whole(text).alias("text"))
    members, edges = links(own, words, percent)
    labelled = members.join(components(edges).withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    labelled = stage(labelled, "labels")
    place = F.struct(F.col("key").isNull(), "key", "h")
    # Written: a component of very many documents can then be split in the join.
    least = stage(labelled.where("n > 0").groupBy("label").agg(F.min("key").alias("least"), F.min(place).alias("_first")), "components")
    rows = labelled.join(least, "label", "left")
    none = F.col("n") == 0
    return rows.select("key", "h", F.col("n").alias("n_shingles"), F.when(none, F.col("key")).otherwise(F.col("least")).alias("component_id"), (none | place.eqNullSafe(F.col("_first"))).alias("first"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The first document of each component, with its columns. Rows equal in key and text are one document, of which
    one row stays; rows equal in key alone are documents of their own."""
    found = joined(docs, key, text, words, percent).where("first").select(F.xxhash64("key", "h").alias("_id")).distinct()
    rows = docs.select(F.xxhash64(F.col(key).cast("long"), F.xxhash64(whole(text))).alias("_id"), F.struct(*docs.columns).alias("_row"))
    again = F.row_number().over(Window.partitionBy("_id").orderBy("_id"))
    rows = rows.join(found, "_id", "left_semi").withColumn("_again", again).where("_again = 1")
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op10_count_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return joined(documents(spark, sf_dir)).select(F.col("key").alias("doc_id"), "n_shingles", "component_id")
