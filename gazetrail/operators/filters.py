"""Row filters.  All are plain expressions, so comparisons reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetrail.functions import text
from gazetrail.functions.numeric import to_num
from gazetrail.schema import TIMES


def ci_equal(df: DataFrame, **wanted: str) -> DataFrame:
    """Rows whose columns equal the values whatever their case."""
    for c, v in wanted.items():
        df = df.filter(F.lower(F.col(c).cast("string")) == v.lower())
    return df


def rt_bounds(df: DataFrame, filters: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """Reading times as numbers, within min_rt (50 unless given) and max_<column>, or missing."""
    filters = filters or {}
    low = filters.get("min_rt", 50)
    if low is None:
        raise ValueError("min_rt must be a number: a null would keep only rows without a time")
    for c in TIMES if columns is None else columns:
        df = df.withColumn(c, to_num(F.col(c)))
        inside = F.col(c) >= float(low)
        if (top := filters.get(f"max_{c}")) is not None:
            inside = inside & (F.col(c) <= float(top))
        df = df.filter(F.coalesce(inside, F.lit(True)))  # the filter moves below the number: each mention is one more reading of the cell
    return df


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only `columns`, only rows that have them all."""
    return df.select(*columns).dropna("any")


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all of `columns`."""
    return df.dropna("any", subset=list(columns))


def with_alnum(df: DataFrame, column: str = "word") -> DataFrame:
    return df.filter(text.has_alnum(F.col(column)))


def real_word(word: Column, clean: Column) -> Column:
    return (F.length(clean) > 0) & ~text.punctuation_only(word)


def real_words(df: DataFrame, word: str = "word", clean: str = "word_clean") -> DataFrame:
    """Rows whose clean word is not empty and whose word is not signs alone."""
    return df.filter(real_word(F.col(word), F.col(clean)))


def matches_ci(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column contains a match whatever its case; a null does not."""
    return df.filter(F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False)))


def all_positive(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.filter(F.col(c) > 0)
    return df


def in_values(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose column is among those of `keys`; a null is found by a null."""
    return df.join(keys.select(F.col(column).alias("_k")).distinct(), F.col(column).eqNullSafe(F.col("_k")), "left_semi")
