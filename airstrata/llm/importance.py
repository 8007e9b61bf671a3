"""Resampling towards a target distribution: documents are drawn as their words weigh in a target against the corpus.

Features are runs of consecutive words, hashed to buckets by the CRC of their bytes. Every task grows a trie of the words
that it meets: a node is a run, holds its count and the CRC state of its bytes, and a child continues that state by one
word, so no run is ever put together as a string. A task adds its nodes to totals of buckets, which Spark merges. In the
second pass nodes hold the gain of their bucket, and a document's weight is the sum along its paths. Adding Gumbel noise
by key and taking the highest scores draws without replacement in proportion to exp(weight / 1000).

A trie that has reached `MOST_NODES` is emptied into the totals and grows anew, so a task's memory is bounded by that
and one document. Gains are a row a bucket, a number of rows that the parameter fixes; they go to all tasks.

Cases: a null text has no words, no features and weight 0; a null id is hashed as the empty string and comes last among
ties; equal ids are ordered as stored; an empty target or corpus gives gains from the added ones alone; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import LOWER, UPPER, documents, stage

BUCKETS, RUN, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
MOST_NODES = 1_000_000
SCORED = "doc_id long, n_words long, n_features long, weight long"
#: Bytes of a word: digits, letters, and all of characters beyond ASCII; A-Z become a-z, the rest blanks.
_WORD_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def word_bytes(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


class WordTrie(dict):
    """Nodes by (parent, word); node 0 is the root. `gains`: of each bucket, which new nodes take on."""

    def __init__(self, buckets: int, gains: np.ndarray | None = None):
        self.buckets, self.gains = buckets, gains
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.state, self.count, self.gain = [0], [0], [0]

    def __missing__(self, step: tuple[int, bytes]) -> int:
        parent, word = step
        state = zlib.crc32(b" " + word, self.state[parent]) if parent else zlib.crc32(word)
        self[step] = node = len(self.state)
        self.state.append(state)
        self.count.append(0)
        if self.gains is not None:
            self.gain.append(int(self.gains[state % self.buckets]))
        return node

    def levels(self, words: list[bytes], run: int) -> Iterator[list[int]]:
        """The nodes of all runs of one word, then of two, up to `run`."""
        nodes = [0] * len(words)
        for more in range(min(run, len(words))):
            nodes = list(map(self.__getitem__, zip(nodes, words[more:])))
            yield nodes

    def add(self, words: list[bytes], run: int) -> None:
        for nodes in self.levels(words, run):
            for node, n in Counter(nodes).items():
                self.count[node] += n

    def weight(self, words: list[bytes], run: int) -> tuple[int, int]:
        """Number of runs and the sum of their gains."""
        n = total = 0
        for nodes in self.levels(words, run):
            n += len(nodes)
            total += sum(map(self.gain.__getitem__, nodes))
        return n, total

    def totals(self) -> np.ndarray:
        """Counts of nodes by bucket."""
        out = np.zeros(self.buckets, np.int64)
        np.add.at(out, np.array(self.state[1:], np.int64) % self.buckets, np.array(self.count[1:], np.int64))
        return out


def bucket_totals(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, sums = WordTrie(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column("text"):
                trie.add(word_bytes(value.as_py() or ""), run)
                if len(trie) > MOST_NODES:
                    sums += trie.totals()
                    trie.empty()
        sums += trie.totals()
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(sums[own])], ["bucket", "n"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets, from totals of both: a thousand times the logarithm of the ratio of shares, each
    bucket counted once more than it is there, rounded down."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    each = both.union(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    sums = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return each.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, gains: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the gains along the paths of each document."""
    table_ = np.zeros(buckets, np.int64)
    for r in gains.collect():  # a row a bucket
        table_[r.bucket] = r.gain
    sent = docs.sparkSession.sparkContext.broadcast(table_)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(buckets, sent.value)
        for batch in batches:
            out = []
            for value in batch.column("text"):
                words = word_bytes(value.as_py() or "")
                out.append((len(words), *trie.weight(words, run)))
                if len(trie) > MOST_NODES:
                    trie.empty()
            sums = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(sums[:, i]) for i in range(3))], SCORED.replace(" long", "").split(", "))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(walk, SCORED)


def noise(seed: int, key: str = "doc_id") -> F.Column:
    """A thousand times a Gumbel variable that the key decides, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows with `rank`, from 1 on for the highest scores, ties to smaller ids; null for rows not drawn. Rows with
    `least_words` words are range-sorted; a task numbers its own, and the rows of earlier tasks come from one row a task."""
    spark = scored.sparkSession
    rows = stage(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    enough = rows.where(F.col("n_words") >= least_words).repartitionByRange(*order).sortWithinPartitions(*order)
    place = stage(enough.withColumn("place", F.monotonically_increasing_id()), "scores-in-order")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, bases = 0, []
    for r in place.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each task of the sort
        bases.append((r.part, before))
        before += r["count"]
    bases = F.broadcast(spark.createDataFrame(bases, "part long, base long"))
    rank = F.col("base") + within + 1
    ranked = place.join(bases, part == F.col("part")).withColumn("rank", F.when(rank <= percent * before // 100, rank))
    rest = rows.where(F.coalesce(F.col("n_words"), F.lit(0)) < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").union(rest.select(*scored.columns, "rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document, drawn towards the texts of `target`."""
    gains = bucket_gains(bucket_totals(docs, text, buckets, run), bucket_totals(target, target_text, buckets, run), buckets)
    scored = weighed(docs, gains, key, text, buckets, run).withColumn("score", F.col("weight") + noise(seed))
    return drawn(scored, percent, least_words)


def op11_word_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents drawn towards the benchmark's words."""
    return resampled(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: The polynomial of the CRC in SQL: its table by eight steps for each byte, then a fold over the bytes of each word.
OP11_SQL = rf"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS entry FROM range(256) t(i)),
feature AS (SELECT true AS own, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
            UNION ALL SELECT false, NULL, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
word AS (SELECT word, hex(encode(word)) AS x, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM feature GROUP BY word),
hashed AS (SELECT word, s, t, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)),
             lambda a, b: xor(a >> 8, entry[(xor(a, b) & 255) + 1]))) % {BUCKETS} AS bucket FROM word, crc),
bucket AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM bucket),
weight AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM feature JOIN hashed USING (word) JOIN gain USING (bucket) WHERE own GROUP BY doc_id),
score AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN weight USING (doc_id)),
place AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM score WHERE n_features >= {LEAST_WORDS})
SELECT score.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM score LEFT JOIN place USING (doc_id)"""
