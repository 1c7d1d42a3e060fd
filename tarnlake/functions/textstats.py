"""Byte and number statistics of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_ascii(text: Column) -> Column:
    return ~text.rlike("[^\\x00-\\x7F]")


def byte_counts(df: DataFrame, text: str) -> DataFrame:
    """(byte as two hex digits, n) over all values; counted in the row's task first."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.col(text), "UTF-8")), F.lit("([0-9A-F]{2})"), F.lit(1))
    return df.select(F.explode(pairs).alias("byte")).groupBy("byte").agg(F.count("*").alias("n"))


def byte_entropy(df: DataFrame, text: str) -> DataFrame:
    """One row: Shannon entropy of the bytes in bits, null without bytes."""
    counts = byte_counts(df, text)  # at most 256 rows
    total = counts.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return counts.join(F.broadcast(total)).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"))
