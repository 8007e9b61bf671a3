"""The corpus pipeline: quality rules, line dedup, near duplicates, repeated passages, packing.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns pieces of packed
sequences. What a stage removes from a text is gone for all later ones, and `n_chars` follows the text. A passage of
about fifty words or more stays in the first document that holds it and is cut from all others.

Cases: nulls, empty tables, repeated rows and further columns are handled as the operators say; a document that loses
all its words to line dedup or to repeated passages holds nothing more to train on and goes; one that has none before
is left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airstrata.llm import jaccard, line_rules, packing, repeats, site_lines
from airstrata.llm.common import documents, stage

#: Tokenizer ids cannot be had in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their frequent lines."""
    return counted(line_rules.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, without boilerplate lines of many sites."""
    return counted(site_lines.deduped(docs, drop_used_up=True).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that links of similar shingles connect."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, without the passages that an earlier one, or they themselves before, hold too."""
    return counted(repeats.deduped(docs, length=repeats.PASSAGE, chunk=repeats.PASSAGE_CHUNK, keep_first=True, drop_used_up=True))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids, along the curve."""
    return packing.pack(docs, frugal=True)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for name, make in STAGES[:-1]:
        docs = stage(make(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
