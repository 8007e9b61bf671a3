"""Quality rules from the frequency of lines across documents, with DataFrame operations only.

Lines are normalised and hashed, and the distinct documents of a host that hold each line are counted. A line that
more documents hold than the limit allows is removed from all of them but the first (smallest key), and a document
that loses most of its words that way is rejected. The limit is a count, the same for a host of any size. Copies are
documents as any others, so that of many copies of a page the first alone is left whole.

Cases: a null text has no words and fails the base rules; a null host is a host of its own; rows equal in key, text
and host are one document and get equal results; rows equal in key alone are told apart by the text's hash, and the
first is the one of the least hash; null keys come first; an empty table gives an empty result; texts of any length
are taken whole; other columns of the input are ignored or, in `clean`, kept, whatever their names. Lines, hosts and
documents are told apart by 64 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SQL_WS, WORD, WS, blanks, documents, lines, normal_lines, sql_normal_line, stage, whole, without_places, words

SYMBOLS = "#*$%&|<>"
#: A line is removed when more distinct documents of its host hold it.
MAX_DOCS = 10
#: A document is rejected when fewer words, or a smaller share of its words, are left.
MIN_LEFT, MIN_LEFT_SHARE = 50, 0.3


def repeat_words(df: DataFrame, w: str = "w") -> DataFrame:
    """Adds n_repeat_words: words inside 3-word windows that the text holds twice or more.

    Window hashes with their place in the low bits are sorted as plain longs; those whose hash bits meet a neighbour's
    are compared again as words, so that no result rests on a hash."""
    bits = F.ceil(F.log2(F.size(w) + F.lit(2))).cast("int")
    df = df.withColumn("_bits", bits)
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    mask = F.expr("shiftleft(-1L, _bits)")
    df = df.withColumn("_mask", mask)
    df = df.withColumn("_sorted", F.sort_array(F.transform(starts, lambda i: window(i).bitwiseAND(F.col("_mask")).bitwiseOR(i.cast("long")))))
    near = lambda x, i, d: F.get("_sorted", i + d).bitwiseAND(F.col("_mask")) == x.bitwiseAND(F.col("_mask"))
    df = df.withColumn("_met", F.filter("_sorted", lambda x, i: F.coalesce(near(x, i, 1), F.lit(False)) | (F.when(i > 0, near(x, i, -1)).otherwise(False))))
    place = lambda x: x.bitwiseAND(F.bitwise_not(F.col("_mask"))).cast("int")
    gram = lambda p: F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))
    df = df.withColumn("_met", F.sort_array(F.transform("_met", lambda x: F.struct(gram(place(x)).alias("g"), place(x).alias("p")))))
    same = lambda x, i, d: F.get("_met", i + d)["g"] == x["g"]
    df = df.withColumn("_twice", F.filter("_met", lambda x, i: F.coalesce(same(x, i, 1), F.lit(False)) | (F.when(i > 0, same(x, i, -1)).otherwise(False))))
    df = df.withColumn("_at", F.sort_array(F.transform("_twice", lambda x: x["p"])))
    steps = F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3))).cast("long"))
    return df.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_bits", "_mask", "_sorted", "_met", "_twice", "_at")


def base_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts of each document's whole text and the verdict of the base rules; all within the scan's stage."""
    t = F.col("_t")
    df = docs.select(F.col(key).alias("doc_id"), document_hash(key, text, host).alias("_doc"), whole(text).alias("_t"))
    df = df.select("doc_id", "_doc", "_t", words(t).alias("w"), F.filter(lines(t), lambda x: x.rlike(WORD)).alias("_lines"))
    df = df.select(
        "doc_id", "_doc", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(t, WS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    df = repeat_words(df).drop("w")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_of(host: str) -> Column:
    """A null host is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def document_hash(key: str, text: str, host: str) -> Column:
    """A document is told by its key, text and host."""
    return F.xxhash64(F.col(key), F.xxhash64(whole(text)), F.xxhash64(host_of(host)))


def held_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """A row for each line with a word: hashes of host, line, text and document, key, place and words."""
    df = docs.select(F.col(key).alias("_key"), F.xxhash64(host_of(host)).alias("_host"), document_hash(key, text, host).alias("_doc"), whole(text).alias("_t"))
    df = df.select("_key", "_host", "_doc", F.xxhash64("_t").alias("_text"), F.posexplode(normal_lines(F.col("_t"))).alias("_i", "_l"))
    return df.where("_l <> ''").select("_key", "_host", "_doc", "_text", F.xxhash64("_l").alias("_line"), "_i", (blanks(F.col("_l")) + 1).alias("_w"))


def removed_lines(docs: DataFrame, max_docs: int = MAX_DOCS, **columns: str) -> DataFrame:
    """For each document that loses lines: their places and the words lost.

    Occurrences are counted first, by an aggregation that combines within tasks, so that a host with a third of all
    rows, or a line in all of them, is a row a task; what is not above the limit drops out there. Documents are then
    counted for the lines that are left, spread by document. Each table that hands results back is written before it
    is joined, so that AQE can split the rows of a hot line."""
    pair = ["_host", "_line"]
    held = stage(held_lines(docs, **columns), "held-lines")
    often = stage(held.groupBy(*pair).agg(F.count("*").alias("_n")).where(F.col("_n") > max_docs).select(*pair), "often")
    held = stage(held.join(often, pair, "left_semi"), "often-held")
    counts = held.groupBy(*pair, "_key", "_text", "_doc").agg(F.lit(1).alias("_one")).groupBy(*pair)
    over = counts.agg(F.count("*").alias("_n"), F.min(F.struct("_key", "_text", "_doc")).alias("_first")).where(F.col("_n") > max_docs)
    over = stage(over.select(*pair, F.col("_first._doc").alias("_keeps")), "over")
    # Rows of one document can repeat: each place counts once.
    lost = held.join(over, pair).where(F.col("_doc") != F.col("_keeps")).select("_doc", "_i", "_w").distinct()
    return lost.groupBy("_doc").agg(F.sum("_w").alias("lost_words"), F.collect_list("_i").alias("lost_places"))


def kept_by(n_words: Column, lost_words: Column) -> Column:
    left = n_words - F.coalesce(lost_words, F.lit(0))
    return (left >= MIN_LEFT) & (left >= MIN_LEFT_SHARE * n_words)


def verdicts(docs: DataFrame, max_docs: int = MAX_DOCS, **columns: str) -> DataFrame:
    """One row per document: the base counts, the words that frequent lines take, and whether it is kept."""
    base = base_rules(docs, **columns)
    lost = removed_lines(docs, max_docs, **columns).select("_doc", "lost_words")
    return base.join(lost, "_doc", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & kept_by(F.col("n_words"), F.col("lost_words"))).alias("kept"), F.coalesce("lost_words", F.lit(0)).cast("long").alias("n_frequent_line_words"),
    )


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """The documents that are kept, with their columns; frequent lines are taken out of their texts."""
    names = docs.columns
    named = {"key": key, "text": text, "host": host}
    # Written before it is filtered: a filter pushed into the counts would repeat their expressions.
    base = stage(base_rules(docs, **named).select("_doc", "n_words", "base_failed"), "base-rules")
    base = base.where(~F.col("base_failed")).select("_doc", "n_words").distinct()
    lost = removed_lines(docs, max_docs, **named)
    good = base.join(lost, "_doc", "left").where(kept_by(F.col("n_words"), F.col("lost_words"))).select("_doc", "lost_places")
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), document_hash(key, text, host).alias("_doc")).join(good, "_doc")
    own = F.col("_row")[text]
    new = F.when(F.col("lost_places").isNull(), own).otherwise(F.array_join(without_places(lines(own), F.col("lost_places")), "\n"))
    return rows.select(*[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in names])


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules over all documents."""
    return verdicts(documents(spark, sf_dir))


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g3 AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g3) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
l0 AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS l FROM d),
l AS (SELECT *, {sql_normal_line("l")} AS norm, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw
      FROM l0 WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l GROUP BY doc_id),
held AS (SELECT host, norm, doc_id, sum(nw) AS nw FROM l GROUP BY ALL),
freq AS (SELECT host, norm, count(*) AS n, min(doc_id) AS k FROM held GROUP BY host, norm),
lost AS (SELECT h.doc_id, sum(h.nw) AS nw FROM held h JOIN freq f USING (host, norm)
         WHERE f.n > {MAX_DOCS} AND h.doc_id <> f.k GROUP BY h.doc_id),
base AS (SELECT d.doc_id, len(w.w) AS n_words, length(translate(d.t, {SQL_WS}, '')) AS word_chars,
                length(d.t) - length(translate(d.t, '{SYMBOLS}', '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
                coalesce(covered.n, 0) AS n_repeat_words
         FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
j AS (SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(lost.nw, 0)::BIGINT AS f
      FROM base LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words - f < {MIN_LEFT} OR n_words - f < {MIN_LEFT_SHARE} * n_words) AS kept,
       f AS n_frequent_line_words
FROM j
"""
