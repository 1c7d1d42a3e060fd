"""Suffix order, Burrows-Wheeler characters, ranks and overlapping counts of texts, one text a group.

Search does not need these (it scans distinct tokens); they give the answers of a compressed text index for texts short enough to sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffix_array(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rank, start): suffixes of each text in byte order, starts from 0. A group is one text."""
    starts = df.where(F.length(text) > 0).select(F.col(key), F.col(text).alias("t"), F.explode(F.sequence(F.lit(1), F.length(text))).alias("i"))
    suffix = starts.select(key, (F.col("i") - 1).alias("start"), F.expr("substring(t, i)").alias("s"), F.when(F.col("i") > 1, F.expr("substring(t, i - 1, 1)")).otherwise("").alias("before"))
    return suffix.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("s")) - 1).drop("s")


def bwt_chars(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rank, ch): the character before each suffix, in suffix order; "" before the whole text."""
    return suffix_array(df, key, text).select(key, "rank", F.col("before").alias("ch"))


def characters(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key), F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("pos", "ch"))


def c_array(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ch, n_less): characters of the text that are less than ch."""
    counts = characters(df, key, text).groupBy(key, "ch").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(key, "ch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_less"))


def char_rank(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, ch, rank): how often the character occurs before pos."""
    w = Window.partitionBy(key, "ch").orderBy("pos")
    return characters(df, key, text).withColumn("rank", F.row_number().over(w) - 1)


def fm_count(text: Column, pattern: str) -> Column:
    """Overlapping occurrences of a literal."""
    return F.regexp_count(text, F.lit(f"(?={re.escape(pattern)})"))
