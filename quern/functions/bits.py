"""Bit vectors as rows (word, value) of 64-bit words, and the operations on them as Columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_of(position: Column) -> Column:
    return F.floor(position / 64)


def mask_of(position: str) -> Column:
    """The one bit of a position in its word. position: a column's name."""
    return F.expr(f"shiftleft(1L, cast(pmod({position}, 64) as int))")


def packed(df: DataFrame, position: str, group: list[str] | None = None) -> DataFrame:
    """group, word, value from rows of set positions."""
    return df.groupBy(*(group or []), word_of(F.col(position)).alias("word")).agg(F.bit_or(mask_of(position)).alias("value"))


def positions(words: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The set positions of packed words."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("value"), i) == 1)
    return words.select(*(group or []), "word", F.explode(bits).alias("_i")).select(*(group or []), (F.col("word") * 64 + F.col("_i")).alias("position"))


def count(words: DataFrame, group: list[str] | None = None) -> DataFrame:
    return words.groupBy(*(group or [])).agg(F.sum(F.bit_count("value")).cast("long").alias("ones"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bitwise or of two vectors, by all columns but value."""
    keys = [c for c in a.columns if c != "value"]
    return a.unionByName(b).groupBy(*keys).agg(F.bit_or("value").alias("value"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bitwise and; words without ones are left out."""
    keys = [c for c in a.columns if c != "value"]
    other = b.withColumnRenamed("value", "_other")
    return a.join(other, keys).withColumn("value", F.col("value").bitwiseAND(F.col("_other"))).drop("_other").filter("value != 0")
