"""Parts that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word, in the notation that Java, RE2 and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def hex_bits(digest: Column, digits: int) -> Column:
    """The first hexadecimal digits of a digest as a non-negative long; DuckDB reads the same number from '0x' || digits."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")
