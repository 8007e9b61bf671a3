"""What the corpus operators share: text handling and staging tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: White space of all word rules: blank and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Write a table into the shared folder and read it back; delete those that nothing reads any more.
stage, discard = session.staged, session.discard


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{session.shared_dir(spark)}/airstrata/{name}-{uuid.uuid4().hex}"


def whole(text: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order, as an array of strings."""
    inner = F.btrim(text, F.lit(WS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WS_RUN))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def normal_line(line: Column) -> Column:
    """A line as it is compared: trimmed, A-Z in lower case, runs of white space as one blank, runs of digits as 0."""
    low = F.translate(F.btrim(line, F.lit(WS)), UPPER, LOWER)
    return F.regexp_replace(F.regexp_replace(low, WS_RUN, " "), "[0-9]+", "0")


#: Runs of white space within a line that are not one blank already.
_UNEVEN = r"\x20[\x20\x09\x0B-\x0D]+|[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*"


def normal_lines(text: Column) -> Column:
    """The lines of a text as `normal_line` has them; the work is done on the text as a whole, which is faster."""
    low = F.translate(text, UPPER, LOWER)
    even = F.regexp_replace(F.regexp_replace(low, _UNEVEN, " "), "[0-9]+", "0")
    return F.transform(F.split(even, "\n"), lambda x: F.btrim(x, F.lit(" ")))


def without_places(items: Column, gone: Column) -> Column:
    """The items of an array whose places are not in `gone`, an array of distinct places; in time linear in both."""
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array_except(places, gone), lambda i: F.get(items, i))


def free_name(columns: list[str], name: str) -> str:
    """The name of a column that an operator adds: with underscores behind it while the input has one of that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def blanks(line: Column) -> Column:
    """Blanks in a normal line; it has a word more, unless it is empty."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))


#: The same in DuckDB SQL, for the checks.
SQL_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_normal_line(line: str) -> str:
    return (
        f"regexp_replace(regexp_replace(translate(trim({line}, {SQL_WS}), '{UPPER}', '{LOWER}'), "
        f"'[\\x20\\x09-\\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')"
    )
