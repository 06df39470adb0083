"""What the operators share: table access, batches, small column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redlake.sources.tables import written  # noqa: F401

#: Space, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hinted(df: DataFrame, most: int) -> DataFrame:
    """df (written) for a join: broadcast if it has at most `most` rows, else merged."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, as texts may be long."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, chars: str) -> Column:
    """text less the named characters. Plain byte searches; a pattern costs several times more."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def spaced(text: Column) -> Column:
    """text with each white-space character a space, and none at the ends; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    one = F.replace(text, F.lit("\n"), F.lit(" "))
    every = one
    for c in "\t\x0b\x0c\r":
        every = F.replace(every, F.lit(c), F.lit(" "))
    return F.btrim(F.when(text.rlike(r"[\x09\x0B-\x0D]"), every).otherwise(one))


def spaced_words(line: Column) -> Column:
    """The words of what spaced() gives."""
    return (
        F.when(line == "", F.array().cast("array<string>"))
        .when(F.contains(line, F.lit("  ")), F.filter(F.split(line, " "), lambda w: w != ""))
        .otherwise(F.split(line, " "))
    )


def split_words(text: Column) -> Column:
    """Maximal runs of characters other than white space; null and blank texts have none."""
    return bind(spaced(text), spaced_words)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
