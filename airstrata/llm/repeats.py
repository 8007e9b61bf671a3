"""Suffix-array dedup by a run-length index: bytes covered by a string of `length` bytes that starts elsewhere too.

1. Every window of `length` bytes picks an anchor, the place of the least hash of 8 bytes in it, so that equal windows
   have equal anchors at equal distances. Window starts are cut into chunks by anchor and distance; all windows of a
   chunk share a core of LENGTH - CHUNK + 1 bytes. A chunk's context is all that its windows cover.
2. A core held once can hold no repeat and drops out; that leaves little of most corpora. Equal contexts fold into one
   by aggregation before anything is grouped by core; a context held twice or more is a match over its whole length.
3. The contexts of a core go to an index, many cores at a time. The core, equal in all of them, is one symbol of the
   indexed string, so a context has at most 2 * CHUNK symbols. The suffixes are sorted, the Burrows-Wheeler transform
   of the string is run-length compressed, and the suffix places at run ends are sampled. At run ends alone can the
   longest match of a place begin anew; from them the matching statistics stream over the string, falling by one at
   each symbol. A match of CHUNK symbols is a window that starts elsewhere too.
4. A context gives at most one interval, as all its windows share the core. Intervals go back to every place of
   the context and are merged in each document.

A core with more contexts than `MOST` would grow beyond a task: its windows are hashed one by one and counted by
aggregation, which is exact too.

A string that repeats has parts that do. So longer repeats are looked for within the spans of shorter ones alone
(`within`), which is exact and spares most of a corpus a second index.

With `keep_first` a window stays where it is held first, by key, then text hash, then place, and goes from all others.
Windows overlap, so a first one may lose bytes to another window that is held earlier still; of every byte that goes,
an equal one stays in an earlier holder.

Cases: a null text is empty; documents of fewer than `length` bytes lose nothing; rows equal in key and text are one
document, rows equal in key alone are told apart by the text's hash; equal texts under different keys all lose their
bytes, or all but the first; a null key is the first of all; an empty table gives an empty result; texts of any length
are taken whole; other columns are ignored or, in `deduped`, kept, whatever their names. Cores and contexts are told
apart by 64 and 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, stage, whole

LENGTH = 400
#: Window starts in a chunk.
CHUNK = 256
#: The same for passages of about fifty words, at five bytes a word with the blank behind it.
PASSAGE, PASSAGE_CHUNK = 256, 128
#: Contexts in one index, and the most contexts of one core that go to an index.
MOST = 4096
_GRAM = 8
SPANS = "array<struct<a:int,b:int>>"


def anchors(data: bytes, length: int) -> np.ndarray:
    """For each window start, the place of the leftmost least gram hash in the window."""
    n, wide = len(data) - _GRAM + 1, length - _GRAM + 1
    words = np.empty(n, "<u8")
    for off in range(min(_GRAM, n)):
        own = words[off::_GRAM]
        own[:] = np.frombuffer(data, "<u8", len(own), off)
    words *= np.uint64(0x9E3779B97F4A7C15)
    words ^= words >> np.uint64(29)
    words *= np.uint64(0xBF58476D1CE4E5B9)
    low = (words & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    have = 1
    while 2 * have <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[: n - wide + 1], low[wide - have : wide - have + n - wide + 1])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def chunks(data: bytes, length: int, chunk: int, base: int = 0) -> Iterator[tuple[int, int, int]]:
    """(core hash, context hash, place) of each chunk of a text, or of a part of one that starts at `base`. A place is the context's start, its length and the
    core's distance from the start, as one whole number of 32, 16 and 16 bits."""
    if len(data) < length:
        return
    at = anchors(data, length)
    starts = np.arange(len(at))
    kind = (at - starts) // chunk
    new = np.flatnonzero(np.diff(at * (length // chunk + 1) + kind, prepend=-1))
    last = np.append(new[1:], len(at)) - 1
    core = at[new] - kind[new] * chunk
    size = length - chunk + 1
    for s, e, c, k in zip(new.tolist(), (last + length).tolist(), core.tolist(), kind[new].tolist()):
        yield xxhash.xxh3_64_intdigest(data[c : c + size], k) - (1 << 63), xxhash.xxh3_64_intdigest(data[s:e], c - s) - (1 << 63), base + s << 32 | e - s << 16 | c - s


class RunLengthIndex:
    """A run-length compressed Burrows-Wheeler transform of a string of whole numbers, with sampled run ends.

    Symbols are below 2**16; the string ends in a symbol that is nowhere else, as does every part of it that matches
    must not leave. So ranks all differ in the end, and no tie is left to chance in the order of the suffixes."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        s = symbols.astype(np.uint64)
        padded = np.concatenate([s + np.uint64(1), np.zeros(4, np.uint64)])
        key = padded[:n] << np.uint64(48) | padded[1 : n + 1] << np.uint64(32) | padded[2 : n + 2] << np.uint64(16) | padded[3 : n + 3]
        self.levels, have = [], 4
        while True:
            order = np.argsort(key)
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
            self.levels.append((have, rank))
            if rank[order[-1]] == n - 1:
                break
            after = np.zeros(n, np.uint64)
            after[: n - have] = rank[have:].astype(np.uint64) + np.uint64(1)
            key = rank.astype(np.uint64) << np.uint64(32) | after
            have *= 2
        bwt = symbols[order - 1]
        heads = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.n, self.symbols = n, symbols
        self.run_symbols, self.run_starts = bwt[np.concatenate([[0], heads])], np.concatenate([[0], heads])
        self.head_places, self.tail_places = order[heads], order[heads - 1]
        self.common = self._common(self.head_places, self.tail_places)

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at p and q, from the ranks at each depth."""
        p, q, out = p.copy(), q.copy(), np.zeros(len(p), np.int64)

        def step(by: int, same: np.ndarray) -> None:
            out[same] += by
            p[same] += by
            q[same] += by

        for have, rank in reversed(self.levels):
            inside = np.maximum(p, q) < self.n
            step(have, inside & (rank[np.minimum(p, self.n - 1)] == rank[np.minimum(q, self.n - 1)]))
        for _ in range(3):
            inside = np.maximum(p, q) < self.n
            step(1, inside & (self.symbols[np.minimum(p, self.n - 1)] == self.symbols[np.minimum(q, self.n - 1)]))
        return out

    def later(self, places: np.ndarray, part: np.ndarray, least: int) -> np.ndarray:
        """Which of these places, all there are with matches of `least` symbols, have one in an earlier part."""
        if not len(places):
            return np.zeros(0, bool)
        order = np.argsort(self.levels[-1][1][places])
        p = places[order]
        new = np.concatenate([[True], self._common(p[:-1], p[1:]) < least])
        first = np.minimum.reduceat(part[order], np.flatnonzero(new))
        out = np.empty(len(places), bool)
        out[order] = part[order] != first[np.cumsum(new) - 1]
        return out

    def matching_statistics(self) -> np.ndarray:
        """Of each place, the length of the longest match with another place; each run end starts one for both."""
        own = np.zeros(self.n, np.int64)
        own[self.head_places] = self.common
        own[self.tail_places] = np.maximum(own[self.tail_places], self.common)
        place = np.arange(self.n)
        return np.maximum.accumulate(own + place) - place


def matched(contexts: list[tuple[int, bytes, int]], chunk: int, size: int, keep_first: bool = False) -> list[tuple[int, int]]:
    """(first, last) matched window start in each context (core, bytes, core start); (0, -1) if there is none. With
    `keep_first` of the windows alone that an earlier context has too."""
    cores = {c: 256 + i for i, c in enumerate(dict.fromkeys(c for c, _, _ in contexts))}
    parts, lengths = [], []
    for i, (core, data, at) in enumerate(contexts):
        parts += [np.frombuffer(data, np.uint8, at).astype(np.uint16), np.array([cores[core]], np.uint16), np.frombuffer(data, np.uint8, -1, at + size).astype(np.uint16), np.array([256 + len(cores) + i], np.uint16)]
        lengths.append(at + 2 + len(data) - at - size)
    index, ends = RunLengthIndex(np.concatenate(parts)), np.cumsum(lengths)
    hits = np.flatnonzero(index.matching_statistics() >= chunk)
    if keep_first:
        hits = hits[index.later(hits, np.searchsorted(ends, hits, "right"), chunk)]
    first, last = np.searchsorted(hits, ends - lengths), np.searchsorted(hits, ends) - 1
    base = ends - lengths
    return [(int(hits[a] - s), int(hits[b] - s)) if a <= b else (0, -1) for a, b, s in zip(first, last, base)]


def _keyed(docs: DataFrame, key: str, text: str, within: str | None) -> DataFrame:
    spans = F.lit(None).cast(SPANS) if within is None else F.col(within)
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(whole(text)).alias("h"), whole(text).alias("text"), spans.alias("within"))


def _places(keyed: DataFrame, length: int, chunk: int) -> DataFrame:
    """A row for each chunk of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "context", "key", "h", "place"]
        for batch in batches:
            out = [[] for _ in names]
            for n, (key, h, text, within) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "h", "text", "within"))), 1):
                data = text.encode()
                for a, b in [(0, len(data))] if within is None else [(x["a"], x["b"]) for x in within]:
                    for core, context, place in chunks(data[a:b], length, chunk, a):
                        for x, v in zip(out, (core, context, key, h, place)):
                            x.append(v)
                if out[0] and (len(out[0]) > 50_000 or n == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)
                    out = [[] for _ in names]

    return keyed.mapInArrow(rows, "core long, context long, key long, h long, place long")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, chunk: int = CHUNK, keep_first: bool = False, within: str | None = None) -> DataFrame:
    """(key, h, spans): the merged intervals (start, end in bytes) of each document that has any; h is its text's hash.
    `within` names a column with the spans of shorter repeats."""
    keyed = _keyed(docs, key, text, within).where(F.octet_length("text") >= length)
    places = _places(keyed, length, chunk)
    # Rows equal in key and text count once: a place is told by key, h and place.
    own = F.xxhash64("key", "h", "place")
    more = F.min(own) != F.max(own)
    # Written first: both sides of the join then have exchanges of their own, and AQE splits a core of very many places.
    repeated = stage(places.groupBy("core").agg(more.alias("more")).where("more").select("core"), "cores")
    held = stage(places.join(repeated, "core", "left_semi"), "places")
    contexts = held.groupBy("core", "context").agg(F.min(F.struct("key", "h", "place")).alias("first"), more.alias("twice"))
    contexts = stage(contexts, "contexts")
    sizes = contexts.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    texts = stage(_with_bytes(keyed, contexts.join(sizes, "core")), "context-bytes")
    found = _indexed(texts.where(F.col("n") <= MOST), chunk, length, keep_first)
    found = found.unionByName(_counted(texts.where(F.col("n") > MOST), length, keep_first))
    # A context that is held twice matches over its whole length; its first place too, unless firsts are kept.
    found = contexts.join(found, ["core", "context"], "left").where(F.col("twice") | F.col("lo").isNotNull())
    # Written for the same reason: places of one core are many.
    found = stage(found.select("core", "context", "first", "twice", "lo", "hi"), "matches")
    whole_context = F.col("twice") & (~F.struct("key", "h", "place").eqNullSafe(F.col("first")) if keep_first else F.lit(True))
    start = F.shiftright("place", 32).cast("int")
    lo, hi = F.when(whole_context, F.lit(0)).otherwise(F.col("lo")), F.when(whole_context, _part("place", 16)).otherwise(F.col("hi"))
    marks = held.join(found, ["core", "context"]).select("key", "h", F.struct((start + lo).alias("a"), (start + hi).alias("b")).alias("span")).where("span.a is not null")
    return merged(marks)


def _part(place: str, shift: int) -> Column:
    return F.shiftright(place, shift).bitwiseAND(F.lit(0xFFFF)).cast("int")


def merged(marks: DataFrame) -> DataFrame:
    """(key, h, spans) of rows (key, h, span): intervals that meet or overlap as one, in a pass over the sorted ones."""
    order = Window.partitionBy("key", "h").orderBy("span.a", "span.b")
    reach = F.max("span.b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = marks.withColumn("new", F.coalesce(reach < F.col("span.a"), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("key", "h", "run").agg(F.struct(F.min("span.a").alias("a"), F.max("span.b").alias("b")).alias("span"))
    return runs.groupBy("key", "h").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def _with_bytes(keyed: DataFrame, contexts: DataFrame) -> DataFrame:
    """The bytes of each context, cut from the first document that holds it."""
    own = contexts.select("core", "context", "n", "first", F.col("first.key").alias("_key"), F.col("first.h").alias("_h"), F.col("first.place").alias("place"))
    part = F.substring(F.col("text").cast("binary"), F.shiftright("place", 32).cast("int") + 1, _part("place", 16))
    rows = keyed.join(own, F.col("_key").eqNullSafe(F.col("key")) & (F.col("_h") == F.col("h")))
    return rows.select("core", "context", "n", "first", _part("place", 0).alias("core_at"), part.alias("data"))


def _indexed(texts: DataFrame, chunk: int, length: int, keep_first: bool) -> DataFrame:
    """Matched intervals of the contexts of all cores that fit an index; the cores of a partition share indexes."""
    size = length - chunk + 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

        def flush(rows: list) -> pa.RecordBatch:
            hits = [(r[0], r[1], a, b + length) for r, (a, b) in zip(rows, matched([(r[0], r[2], r[3]) for r in rows], chunk, size, keep_first)) if b >= a]
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], k) for i, k in enumerate(kinds)], ["core", "context", "lo", "hi"])

        held, own = [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("core", "context", "data", "core_at"))):
                if own and own[-1][:2] == row[:2]:
                    continue  # a repeated row's
                if own and own[0][0] != row[0]:
                    if len(held) + len(own) > MOST:
                        yield flush(held)
                        held = []
                    held, own = held + own, []
                own.append(row)
        if len(held) + len(own) > MOST:
            yield flush(held)
            held = []
        if held or own:
            yield flush(held + own)

    rows = texts.repartition("core").sortWithinPartitions("core", "first", "context").select("core", "context", "data", "core_at")
    return rows.mapInArrow(search, "core long, context long, lo int, hi int")


def _counted(texts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for cores with too many contexts: all their windows, hashed and counted by aggregation."""
    rows = texts.select("core", "context", "first", "data", "core_at", F.explode(F.sequence(F.lit(0), F.octet_length("data") - F.lit(length))).alias("s"))
    window = F.substring(F.col("data"), F.col("s") + 1, F.lit(length))
    rows = rows.select("core", "context", "first", "s", F.xxhash64(window).alias("w"), (F.col("s") - F.col("core_at")).alias("d"))
    often = rows.groupBy("core", "w", "d").agg(F.min(F.struct("first", "context")).alias("least"), (F.min("context") != F.max("context")).alias("many")).where("many")
    rows = rows.join(often, ["core", "w", "d"]).where(F.col("context") != F.col("least.context") if keep_first else F.lit(True))
    return rows.groupBy("core", "context").agg(F.min("s").alias("lo"), (F.max("s") + F.lit(length)).alias("hi"))


def with_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """(_row, _spans): the documents, each as one struct, and their spans, an empty array where there are none."""
    spans = repeated_spans(docs, key, text, **options).select(F.col("key").alias("_key"), F.col("h").alias("_h"), F.col("spans").alias("_spans"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).cast("long").alias("_k"), F.xxhash64(whole(text)).alias("_t"))
    rows = rows.join(spans, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_h")), "left")
    return rows.select("_row", F.coalesce("_spans", F.array().cast(SPANS)).alias("_spans"))


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes that are left, as one."""
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the parts of characters at their ends, so that what is left is text."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_used_up: bool = False, **options: int) -> DataFrame:
    """The documents with their columns, repeated passages cut from `text` at whole characters; null stays null. With
    `drop_used_up`, documents go that lose all their words.

    Documents that lose nothing pass by as they are; of the others text and spans alone go to Python."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts.to_pylist(), spans.to_pylist()):
            data = t.encode()
            out.append(without(data, whole_characters(data, [(x["a"], x["b"]) for x in own])).decode() if own else t)
        return pa.array(out, pa.string())

    rows = with_spans(docs.withColumn(text, F.col(text).cast("string")), key, text, **options)
    new = F.when(F.size("_spans") == 0, F.col("_row")[text]).otherwise(F.col("_cut"))
    some = F.size("_spans") > 0
    # A document without spans hands an empty text over.
    rows = rows.withColumn("_cut", cut(F.when(some, F.col("_row")[text]).otherwise(F.lit("")), "_spans"))
    if drop_used_up:
        rows = rows.where(~some | F.col("_cut").rlike(WORD))
    return rows.select(*[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def op4_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses, and a digest of the bytes that are left; `n_passage_bytes` are the bytes of passages
    of about fifty words that repeat, many of which are shorter than what is removed."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans, passages in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_long", "_short"))):
                data, own = (text or "").encode(), [(x["a"], x["b"]) for x in spans]
                out.append((doc, len(data), sum(b - a for a, b in own), len(own), hashlib.sha256(without(data, own)).hexdigest(), sum(x["b"] - x["a"] for x in passages)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = with_spans(docs, length=PASSAGE, chunk=PASSAGE_CHUNK).select("_row.doc_id", "_row.text", F.col("_spans").alias("_short"))
    # Written: few of the documents have a span that can hold a longer repeat, and those alone are looked at again.
    rows = stage(rows, "passages")
    can = F.exists("_short", lambda x: x["b"] - x["a"] >= LENGTH)
    some = with_spans(rows.where(can), within="_short").select("_row.*", F.col("_spans").alias("_long"))
    none = rows.where(~can).withColumn("_long", F.array().cast(SPANS))
    return some.unionByName(none).mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")
