"""Merkle fingerprints of documents, with DataFrame operations only.

The tree: root, sections, paragraphs, runs of words. Paragraphs are lines. A section ends at an empty line, or at a
line whose hash is divisible by `SECTION`, so that an edit moves no section boundary but its own. A paragraph's node
is the hash of its text, a section's the hash of its paragraphs' nodes, the root the SHA-256 of the sections' nodes.
The fingerprint is a string of all levels: equal roots mean equal texts, sections and paragraphs that differ locate an
edit, and the runs' 32-bit codes tell how alike two texts are, down to parts of one paragraph. Likeness walks both
trees from the root: what equal sections hold is shared, and only sections that differ are opened, then only their
paragraphs that differ. At m distinct runs an unrelated text's code is met by chance in m of 2**32 cases, so that
likeness holds for texts of many megabytes too.

Cases: a null text is empty; an empty text has one empty paragraph, and two empty texts are fully alike; rows equal in
key and text are one document, rows equal in key alone are told apart by the text's hash; a document alone is its own
next one; null keys come first; an empty table gives an empty result; texts of any length are taken whole; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, stage, whole

#: Paragraphs in a section on average, words in a run, and the characters of a paragraph whose runs are single words.
SECTION, RUN, SHORT = 8, 4, 120
#: A run: words, or parts of 64 characters of longer words, of one line. In a short paragraph: single words.
_WORD = r"[^\x20\x09-\x0D]{1,64}"
_RUN = rf"[^\x20\x09-\x0D]{{1,64}}(?:[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D]{{1,64}}){{0,{RUN - 1}}}"


def _hex8(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")


def _runs_of(p: Column) -> Column:
    return F.regexp_extract_all(p, F.when(F.length(p) < SHORT, _WORD).otherwise(_RUN), F.lit(0))


def fingerprint(text: Column) -> Column:
    """root|section:paragraph=runs,paragraph=runs/section:... as a string."""

    def paragraph(p: Column) -> Column:
        codes = F.transform(_runs_of(p), lambda r: _hex8(F.xxhash64(r)))
        ends = (p == "") | (F.pmod(F.xxhash64(p), F.lit(SECTION)) == 0)
        return F.concat(_hex8(F.xxhash64(p, F.lit(1))), _hex8(F.xxhash64(p, F.lit(2))), F.lit("="), F.array_join(codes, ""), F.when(ends, "/").otherwise(","))

    joined = F.array_join(F.transform(F.split(text, "\n"), paragraph), "")
    sections = F.filter(F.split(joined, "/"), lambda s: s != "")
    nodes = F.transform(sections, lambda s: F.concat(_hex8(F.xxhash64(F.regexp_replace(s, "=[0-9a-f]*", ""))), F.lit(":"), F.rtrim(s, F.lit(","))))
    body = F.array_join(nodes, "/")
    return F.concat(F.substring(F.sha2(F.regexp_replace(body, "=[0-9a-f]*", "").cast("binary"), 256), 1, 32), F.lit("|"), body)


def root(print_: Column) -> Column:
    return F.substring_index(print_, "|", 1)


def paragraphs(print_: Column) -> Column:
    """The paragraphs' nodes in order."""
    return F.regexp_extract_all(print_, F.lit("([0-9a-f]{16})="), F.lit(1))


def edits(a: Column, b: Column) -> Column:
    """Places of the paragraphs of `a` that `b` has not, by their nodes; none when the roots are equal."""
    own = F.transform(paragraphs(a), lambda p, i: F.when(~F.array_contains(paragraphs(b), p), i))
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(F.filter(own, lambda i: i.isNotNull()))


def _sections_runs(nodes: Column) -> Column:
    """How many runs some sections hold: what is left of their length without nodes and signs."""
    paragraphs = lambda s: F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))) + 1
    return F.aggregate(nodes, F.lit(0), lambda n, s: n + ((F.length(s) - 8 - 18 * paragraphs(s)) / 8).cast("int"))


def _paragraphs_runs(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(0), lambda n, p: n + ((F.length(p) - 17) / 8).cast("int"))


def _opened(sections: Column) -> Column:
    """The distinct paragraphs of some sections."""
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.split(F.substr(s, F.lit(10)), ","))))


def _codes(paragraphs: Column) -> Column:
    """The distinct codes of some paragraphs."""
    return F.array_distinct(F.regexp_extract_all(F.array_join(F.transform(paragraphs, lambda p: F.substr(p, F.lit(18))), ""), F.lit(".{8}"), F.lit(0)))


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds how alike two columns of fingerprints are, from 0 to 1: twice the runs that they share over the runs of both.

    Sections are sets, so are the paragraphs of sections that differ, and the runs of paragraphs that differ; two texts
    without runs are alike. Each level is a column of its own, so that it is worked out once."""
    sections = lambda x: F.array_distinct(F.split(F.substring_index(F.col(x), "|", -1), "/"))
    levels = [
        {"_x": sections(a), "_y": sections(b)},
        {"_same": F.array_intersect("_x", "_y"), "_x": F.array_except("_x", "_y"), "_y": F.array_except("_y", "_x")},
        {"_same": _sections_runs(F.col("_same")), "_x": _opened(F.col("_x")), "_y": _opened(F.col("_y"))},
        {"_also": F.array_intersect("_x", "_y"), "_x": F.array_except("_x", "_y"), "_y": F.array_except("_y", "_x")},
        {"_same": F.col("_same") + _paragraphs_runs(F.col("_also")), "_x": _codes(F.col("_x")), "_y": _codes(F.col("_y"))},
    ]
    out = df
    for level in levels:
        out = out.withColumns(level)
    total = 2 * F.col("_same") + F.size("_x") + F.size("_y")
    near = F.when(total == 0, F.lit(1.0)).otherwise(2 * (F.col("_same") + F.size(F.array_intersect("_x", "_y"))) / total)
    return out.withColumn(name, near).drop("_x", "_y", "_same", "_also")


def next_documents(keys: DataFrame) -> DataFrame:
    """(k, h, n, nk, nh): to each (k, h, n) the key and hash that follow in order, to the last the first.

    Only keys are sorted: ranges are numbered, followers found within them, and one row for each range joins the
    ranges' ends."""
    part = stage(keys.repartitionByRange("k", "h").withColumn("part", F.spark_partition_id()), "keys")
    own = F.struct("k", "h")
    inner = part.withColumn("next", F.lead(own).over(Window.partitionBy("part").orderBy("k", "h")))
    firsts = part.groupBy("part").agg(F.min(own).alias("first"))
    order = Window.orderBy("part")
    ends = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    rows = inner.join(ends, "part").withColumn("next", F.coalesce("next", "after"))
    return rows.select("k", "h", "n", F.col("next.k").alias("nk"), F.col("next.h").alias("nh"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, text, n, edited, next_key, next_fingerprint): each document, its text with the last quarter replaced from the
    next document, and that one's key and fingerprint. Of the next text only the replacing characters and the fingerprint
    move; documents in both roles have the same columns, so that texts are shuffled once and read twice."""
    base = docs.select(F.col(key).alias("k"), F.xxhash64(whole(text)).alias("h"), whole(text).alias("text"))
    keys = base.select("k", "h", F.length("text").cast("long").alias("n")).groupBy("k", "h").agg(F.min("n").alias("n"))
    order = stage(next_documents(keys), "next")
    gives = order.select(F.col("nk").alias("k"), F.col("nh").alias("h"), F.col("k").alias("pk"), F.col("h").alias("ph"), F.floor(F.col("n") / 4).cast("int").alias("q"), "n")
    # One set of keys, 128 bits of hash, for all joins and the folding of repeated rows: each side is shuffled once.
    two = lambda k, h: [F.xxhash64(k, h).alias("_p"), F.xxhash64(h, k, F.lit(1)).alias("_q")]
    gives = gives.select(*two("k", "h"), *[F.col(c) for c in ("pk", "ph", "n", "q")])
    own = base.select(*two("k", "h"), "k", "text")
    giver = own.join(gives, ["_p", "_q"])
    giver = giver.select(*two("pk", "ph"), "n", "q", F.col("k").alias("next_key"), F.substring(F.col("text"), F.lit(1), F.col("q")).alias("given"), fingerprint(F.col("text")).alias("next_fingerprint")).dropDuplicates(["_p", "_q"])
    rows = own.join(giver, ["_p", "_q"])
    return rows.select("k", "text", "n", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n") - F.col("q")).cast("int")), "given").alias("edited"), "next_key", "next_fingerprint")


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    rows = with_next(documents(spark, sf_dir))
    rows = rows.select(
        F.col("k").alias("doc_id"), F.col("next_key").alias("next_id"), F.col("n").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint",
    )
    rows = with_likeness(with_likeness(rows, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id")
