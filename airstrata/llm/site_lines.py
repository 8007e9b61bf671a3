"""Line dedup by the spread over sites: lines that many distinct sites hold are boilerplate.

HyperLogLog sketches of the sites, one for each line hash, merge by aggregation. A line whose estimate is near the
threshold, within the sketch's error, gets an exact distinct count. Lines of one site alone drop out before they are
sketched. A boilerplate line stays in the first document that holds it (smallest key, then text hash) and goes from
all others, copies of the first one too.

Cases: a null text has no lines; a null site is a site of its own; lines of fewer than `min_words` words (1: all with
a word) are never boilerplate; rows equal in key and text are one document and get equal results; rows equal in key
alone are told apart by the text's hash; null keys come first; an empty table gives an empty result; texts of any
length are taken whole; other columns of the input are ignored or, in `deduped`, kept, whatever their names: an added
one whose name is taken gets underscores behind it. Lines and sites are told apart by 64 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, blanks, documents, free_name, lines, normal_lines, sql_normal_line, stage, whole, without_places
from .line_rules import host_of

#: A line on this many sites or more is boilerplate.
MIN_SITES = 10
#: Lines of fewer words are left alone.
MIN_WORDS = 1
#: log2 of the sketch's registers, and the band around the threshold in standard errors (1.04 / sqrt(registers)).
LG_K, SIGMAS = 12, 4


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each line that can be boilerplate: line hash, site hash, key, text hash, place."""
    df = docs.select(F.col(key).alias("_key"), F.xxhash64(host_of(site)).alias("_site"), whole(text).alias("_t"))
    df = df.select("_key", "_site", F.xxhash64("_t").alias("_text"), F.posexplode(normal_lines(F.col("_t"))).alias("_i", "_l"))
    df = df.where((F.col("_l") != "") & (blanks(F.col("_l")) + 1 >= min_words))
    return df.select("_key", "_site", "_text", F.xxhash64("_l").alias("_line"), "_i")


def on_several_sites(held: DataFrame) -> DataFrame:
    """The rows of lines that more than one site holds: most lines of a corpus need no sketch."""
    several = held.groupBy("_line").agg((F.min("_site") != F.max("_site")).alias("_several")).where("_several").select("_line")
    # Written first, so that AQE can split the rows of a hot line in the join.
    return stage(held.join(stage(several, "several-sites"), "_line", "left_semi"), "site-lines")


def spread(held: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Line hashes on `min_sites` sites or more, with the first holder.

    The first aggregation holds a sketch of a few bytes for most lines; map-side merging keeps a line that is
    everywhere to one row for each task. Only lines within the error band are counted exactly, by (line, site)."""
    error = SIGMAS * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    sketched = held.groupBy("_line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", lg_k)).alias("_sites"), F.min(F.struct("_key", "_text")).alias("_first"))
    wide = sketched.where(F.col("_sites") >= low)
    near = wide.where(F.col("_sites") <= high)
    exact = held.join(near.select("_line"), "_line", "left_semi").groupBy("_line", "_site").agg(F.lit(1)).groupBy("_line").agg(F.count("*").alias("_exact"))
    sites = F.coalesce("_exact", "_sites")
    return wide.join(exact, "_line", "left").where(sites >= min_sites).select("_line", sites.alias("n_sites"), "_first")


def removed(docs: DataFrame, min_sites: int = MIN_SITES, **columns: str) -> DataFrame:
    """For each document (_gk, _gt: key and text hash) that loses lines, their places."""
    held = stage(line_table(docs, **columns), "lines")
    if min_sites > 1:
        held = on_several_sites(held)
    over = stage(spread(held, min_sites), "wide-lines")
    lost = held.join(over, "_line").where(~F.struct("_key", "_text").eqNullSafe(F.col("_first")))
    lost = lost.select("_key", "_text", "_i").distinct()  # rows of one document can repeat
    return lost.groupBy(F.col("_key").alias("_gk"), F.col("_text").alias("_gt")).agg(F.collect_list("_i").alias("_lost"))


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, drop_used_up: bool = False) -> DataFrame:
    """The documents with all their columns, `text` without boilerplate, and n_removed_lines. With `drop_used_up`,
    documents go that lose all their words."""
    names = docs.columns
    gone = removed(docs, min_sites, key=key, text=text, site=site, min_words=min_words)
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col(key).alias("_k"), F.xxhash64(whole(text)).alias("_t"))
    rows = rows.join(gone, F.col("_k").eqNullSafe(F.col("_gk")) & (F.col("_t") == F.col("_gt")), "left")
    own = F.col("_row")[text]
    new = F.when(F.col("_lost").isNull(), own).otherwise(F.array_join(without_places(lines(own), F.col("_lost")), "\n"))
    if drop_used_up:
        rows = rows.where(F.col("_lost").isNull() | new.rlike(WORD))
    n_removed = F.when(F.col("_lost").isNull(), 0).otherwise(F.size("_lost"))
    return rows.select(*[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in names], n_removed.cast("long").alias(free_name(names, "n_removed_lines")))


def op6_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document loses, and a digest of the text that is left."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return deduped(docs).select(
        "doc_id", F.size(lines(whole())).cast("long").alias("n_lines_kept"), "n_removed_lines", F.sha2(whole().cast("binary"), 256).alias("kept_sha256")
    )


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS site, coalesce(text, '') AS t FROM documents),
l0 AS (SELECT doc_id, site, t, string_split(t, chr(10)) AS a FROM d),
l1 AS (SELECT doc_id, site, t, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS l FROM l0),
l AS (SELECT *, {sql_normal_line("l")} AS norm, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS} AS counts FROM l1),
wide AS (SELECT norm, min(doc_id) AS k FROM l WHERE counts GROUP BY norm HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (SELECT l.doc_id, l.i, l.l, coalesce(l.counts AND l.doc_id <> wide.k, false) AS gone FROM l LEFT JOIN wide ON wide.norm = l.norm)
SELECT doc_id, CASE WHEN count(*) FILTER (NOT gone) = 0 THEN 1 ELSE count(*) FILTER (NOT gone) END AS n_lines_kept,
       count(*) FILTER (gone) AS n_removed_lines,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
