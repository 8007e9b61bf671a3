"""Substring dedup by sliding sentence spans.

A run is consecutive sentences, `span` of them or as many more as make `least_words` words. The run that begins at
each sentence is hashed, the hashes are counted over all documents, and a sentence goes if a run that covers it is
held earlier: by a smaller key, or before it in the same document. The least number of words keeps stock sentences,
which meet by chance, from counting as passages. Sentences are cut after a full stop, exclamation or question mark with
white space behind it, and at line ends; they are compared without the white space around them.

Cases: a null text has no sentences and stays null; a document of fewer sentences or words than a run has loses
nothing; rows equal in key and text are one document and get equal results; rows equal in key alone are told apart by
the text's hash; null keys come first; an empty table gives an empty result; texts of any length are taken whole; other
columns are ignored or, in `deduped`, kept, whatever their names: an added one whose name is taken gets underscores
behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SQL_WS, WS, WS_RUN, documents, free_name, stage, whole, without_places

#: Least sentences and least words of a run.
SPAN, LEAST_WORDS = 2, 16
_CUT = "\x01"


def pieces(text: Column) -> Column:
    """The sentences of a text with the white space after them; joined they are the text."""
    marked = F.regexp_replace(text, r"([.!?][\x20\x09-\x0D]+|\n+)", rf"$1{_CUT}")
    return F.filter(F.split(marked, _CUT), lambda x: x != "")


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(WS))


def runs_of(sentences: Column, counts: Column, span: int, least_words: int) -> Column:
    """(i, n, run): for each sentence that a run begins at, its place, the run's sentences and its hash. A run has at
    most `least_words` sentences or `span` of them, as each has a word."""

    def length(i: Column) -> Column:
        words, out = F.get(counts, i), None
        for n in range(1, max(span, least_words) + 1):
            words = words + F.get(counts, i + (n - 1)) if n > 1 else words
            if n >= span:
                out = F.when(words >= least_words, n) if out is None else out.when(words >= least_words, n)
        return out

    places = F.when(F.size(sentences) >= span, F.sequence(F.lit(0), F.size(sentences) - span)).otherwise(F.array().cast("array<int>"))
    runs = F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), length(i).alias("n"))), lambda r: r["n"].isNotNull())
    return F.transform(runs, lambda r: F.struct(r["i"].alias("i"), r["n"].alias("n"), F.xxhash64(F.slice(sentences, r["i"] + 1, r["n"])).alias("run")))


def first_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(_k, _h, _at): the sentences of each document that a non-first repeated run covers, as an array of places.

    Hashes that occur once drop out in an aggregation that combines within each task, so that a run held by a third of
    all documents is a row a task there; the join that finds its holders again is one that AQE can split."""
    df = docs.select(F.col(key).alias("_k"), whole(text).alias("_t"))
    df = df.select("_k", F.xxhash64("_t").alias("_h"), F.filter(F.transform(pieces(F.col("_t")), trimmed), lambda x: x != "").alias("_s"))
    df = df.select("_k", "_h", "_s", F.transform("_s", lambda x: F.size(F.split(x, WS_RUN))).alias("_c"))
    rows = df.select("_k", "_h", F.explode(runs_of(F.col("_s"), F.col("_c"), span, least_words)).alias("_r")).select("_k", "_h", "_r.i", "_r.n", "_r.run")
    place = F.struct("_k", "_h", "i")
    again = rows.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("run", "first")
    later = rows.join(stage(again, "runs"), "run").where(place > F.col("first"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("i", "n")), lambda r: F.sequence(r["i"], r["i"] + r["n"] - 1))))
    return later.groupBy("_k", "_h").agg(covered.alias("_at"))


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(_row, _p, _at): each document, its sentences with the white space after them, and the places of those that go."""
    gone = first_spans(docs, key, text, span, least_words).withColumnsRenamed({"_k": "_gk", "_h": "_gh"})
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_k"), F.xxhash64(whole(text)).alias("_h"))
    rows = rows.join(gone, F.col("_k").eqNullSafe(F.col("_gk")) & (F.col("_h") == F.col("_gh")), "left")
    # A piece of white space alone is no sentence.
    parts = F.filter(pieces(whole(f"_row.`{text}`")), lambda x: trimmed(x) != "")
    return rows.select("_row", parts.alias("_p"), F.coalesce("_at", F.array().cast("array<int>")).alias("_at"))


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with their columns, `text` without covered sentences, and n_sentences and n_removed.

    Documents that lose nothing keep their text as it is; from others, pieces of white space alone go too."""
    rows = marked(docs, key, text, span, least_words)
    new = F.when(F.size("_at") == 0, F.col("_row")[text]).otherwise(F.array_join(without_places(F.col("_p"), F.col("_at")), ""))
    return rows.select(
        *[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns],
        F.size("_p").cast("long").alias(free_name(docs.columns, "n_sentences")), F.size("_at").cast("long").alias(free_name(docs.columns, "n_removed")),
    )


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document, how many go, and a digest of the text that is left."""
    rows = deduped(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_sentences", "n_removed", F.sha2(whole().cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p0 AS (SELECT doc_id, t, list_filter(string_split(regexp_replace(t, '([.!?][\x20\x09-\x0D]+|\n+)', '\1' || chr(1), 'g'), chr(1)),
                                     lambda x: trim(x, {SQL_WS}) <> '') AS p FROM d),
s AS (SELECT doc_id, p, list_transform(p, lambda x: trim(x, {SQL_WS})) AS s FROM p0),
w AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS c FROM s),
q AS (SELECT doc_id, s, i, unnest(range({SPAN}, {max(SPAN, LEAST_WORDS)} + 1)) AS n, c
      FROM (SELECT doc_id, s, c, unnest(range(1, len(s) + 1)) AS i FROM w)),
r AS (SELECT doc_id, i, min(n) AS n, arg_min(array_to_string(s[i:i + n - 1], chr(1)), n) AS run
      FROM q WHERE i + n - 1 <= len(s) AND list_sum(c[i:i + n - 1]) >= {LEAST_WORDS} GROUP BY doc_id, i),
later AS (SELECT doc_id, i, n FROM (SELECT doc_id, i, n, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM r) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM later)),
kept AS (SELECT a.doc_id, string_agg(a.x, '' ORDER BY a.i) FILTER (g.i IS NULL) AS x, count(g.i) AS n
         FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM p0) a
         LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY a.doc_id)
SELECT d.doc_id, len(s.s)::BIGINT AS n_sentences, coalesce(kept.n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN coalesce(kept.n, 0) = 0 THEN d.t ELSE coalesce(kept.x, '') END) AS kept_sha256
FROM d JOIN s USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
