"""Tokens, the inverted index from tokens to row groups, and its compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.charclass import type_mask
from .ordered import running_total

DELIMITERS = "[: \t]+"
#: A type with no more distinct tokens than this is kept in the outlier table.
OUTLIER_TOKENS = 1000
#: A token in more than this share of all row groups goes to the dictionary, without postings.
DICTIONARY_SHARE = 0.5
#: Row groups a segment of a posting list covers.
SEGMENT = 4096
#: Characters of a gram, characters of the shortest piece that can be looked up, and what stands before and after a token (no token holds it).
GRAM, LEAST, FRAME = 6, 3, "\n"


def tokenize(log: Column) -> Column:
    return F.filter(F.split(log, DELIMITERS), lambda x: x != "")


def inverted_index(lines: DataFrame, log: str = "log", rg: str = "rg", segment: int = SEGMENT) -> DataFrame:
    """(type, token, segment, row_groups): distinct ascending row groups of every token, in segments of ``segment`` row groups.

    Tokens are made distinct per (token, row group), map-side first, so a token in a third of all lines is spread; no list is longer than a segment.
    """
    pairs = lines.select(F.col(rg).cast("long").alias("rg"), F.explode(tokenize(F.col(log))).alias("token")).distinct()
    index = pairs.groupBy("token", F.expr(f"rg div {segment}").alias("segment")).agg(F.array_sort(F.collect_list("rg")).alias("row_groups"))
    return index.select(type_mask(F.col("token")).alias("type"), "token", "segment", "row_groups")


def gram_index(lines: DataFrame, keys: list[str], log: str = "log", rg: str = "rg", share: float = DICTIONARY_SHARE) -> DataFrame:
    """(keys.., gram, row_groups): the row groups of each beginning of GRAM characters of every suffix of every token, for substring lookup.

    A token stands between two FRAME characters, so a gram tells whether it begins or ends one; suffixes shorter than LEAST are left out. A gram in more than
    ``share`` of the row groups of its keys has no list: it rules out nothing. A list is as long as its split has row groups, whatever the number of splits.
    Null lines have no tokens.
    """
    pairs = lines.select(*keys, F.col(rg).alias("rg"), F.explode(tokenize(F.col(log))).alias("token")).distinct()
    framed = F.concat(F.lit(FRAME), F.col("token"), F.lit(FRAME))
    # One pass over a token of any length: at each place, the characters that follow.
    suffixes = F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{LEAST},{GRAM}}}))"), F.lit(1))
    grams = pairs.select(*keys, "rg", F.explode(suffixes).alias("gram")).distinct()
    total = lines.groupBy(*keys).agg(F.count_distinct(rg).alias("__n"))  # one row a split
    lists = grams.groupBy(*keys, "gram").agg(F.count("*").alias("__c"), F.array_sort(F.collect_list("rg")).alias("row_groups"))
    listed = lists.join(total, keys).withColumn("row_groups", F.when(F.col("__c") <= share * F.col("__n"), F.col("row_groups")))
    return listed.select(*keys, "gram", "row_groups")


def type_cardinality(index: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct tokens of each type; a token has one row a segment."""
    return index.select(*(keys or []), "type", "token").distinct().groupBy(*(keys or []), "type").agg(F.count("*").alias("n_tokens"))


def split_outliers(index: DataFrame, limit: int = OUTLIER_TOKENS, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of types with more than ``limit`` tokens, rows of the rest). A type table has at most 63 rows for each key."""
    small = type_cardinality(index, keys).where(F.col("n_tokens") <= limit)
    on = [*(keys or []), "type"]
    return index.join(small, on, "left_anti"), index.join(small, on, "left_semi")


def compact_postings(parts: DataFrame) -> DataFrame:
    """Union of the lists of each (type, token) over all groups, distinct and ascending; null lists add nothing."""
    pairs = parts.select("type", "token", F.explode_outer(F.array_distinct("row_groups")).alias("rg")).groupBy("type", "token", "rg").agg(F.lit(1).alias("one"))
    return pairs.groupBy("type", "token").agg(F.array_sort(F.collect_list("rg")).alias("row_groups"))


def split_dictionary(index: DataFrame, n_row_groups: int, share: float = DICTIONARY_SHARE) -> tuple[DataFrame, DataFrame]:
    """(rows to keep with postings, dictionary tokens): a token in more than ``share`` of all row groups, over its segments, is kept without lists."""
    sizes = index.groupBy("type", "token").agg(F.sum(F.size("row_groups")).alias("__n"))
    common = sizes.where(F.col("__n") > share * n_row_groups).select("type", "token")
    return index.join(common, ["type", "token"], "left_anti"), common


def merge_sorted(parts: list[DataFrame], order: list[str], rank: str = "rank") -> DataFrame:
    """All rows of sorted inputs with their place in one order, from 0; duplicates are kept. One range sort, no task holds more than its range."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    placed = running_total(whole.withColumn("__one", F.lit(1).cast("long")), [], order, "__one", "__upto")
    return placed.withColumn(rank, F.col("__upto") - 1).drop("__one", "__upto", "__pid")


def _per_token(index: DataFrame) -> DataFrame:
    """(type, token, n): row groups of a token over all its segments."""
    return index.groupBy("type", "token").agg(F.sum(F.size("row_groups")).cast("long").alias("n"))


def token_blocks(index: DataFrame, size: int) -> DataFrame:
    """(type, token, token_block): rank of the token within its type, in byte order, divided by ``size``."""
    once = index.select("type", "token").distinct().withColumn("__one", F.lit(1).cast("long"))
    ranked = running_total(once, ["type"], ["token"], "__one", "__rank")
    return ranked.select("type", "token", F.expr(f"(__rank - 1) div {size}").alias("token_block"))


def csr_offsets(index: DataFrame) -> DataFrame:
    """(type, token, begin, end): where each token's list would lie in one array of all lists of its type."""
    total = running_total(_per_token(index), ["type"], ["token"], "n", "end")
    return total.select("type", "token", (F.col("end") - F.col("n")).alias("begin"), "end")


def posting_stats(index: DataFrame) -> DataFrame:
    """Per type: tokens, posting entries, longest list, single-entry lists and bytes of the tokens."""
    n = F.col("n")
    return _per_token(index).groupBy("type").agg(
        F.count("*").alias("n_tokens"), F.sum(n).alias("n_postings"), F.max(n).alias("longest"), F.sum(F.when(n == 1, 1).otherwise(0)).alias("n_single"), F.sum(F.octet_length("token").cast("long")).alias("token_bytes")
    )
