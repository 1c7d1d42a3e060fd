"""From a query to the row groups that can hold an answer. Sound: a row group is left out only if it provably holds none.

``candidate_row_groups`` looks pieces up in lists of whole tokens; ``gram_candidates`` finds the grams of the pieces in a table sorted by gram, by
ranges that file statistics can use, for any number of splits in one job.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.charclass import mask_of, supersets
from ..functions.regexlit import required_literals
from ..operators.tokens import FRAME, GRAM, LEAST, split_dictionary, split_outliers


@dataclass(frozen=True)
class Piece:
    """Part of a query between delimiters; an open side may go on inside a token."""

    text: str
    left_open: bool
    right_open: bool

    def matches(self, token: Column) -> Column:
        if self.left_open and self.right_open:
            return token.contains(self.text)
        if self.left_open:
            return token.endswith(self.text)
        return token.startswith(self.text) if self.right_open else token == self.text


def pieces(query: str) -> list[Piece]:
    """The token pieces of a literal. None for a query of delimiters only: it prunes nothing."""
    found = list(re.finditer(r"[^: \t]+", query))
    return [Piece(m[0], m.start() == 0, m.end() == len(query)) for m in found]


@dataclass
class Index:
    """postings and outliers have (type, token, row_groups), dictionary has (type, token)."""

    postings: DataFrame
    outliers: DataFrame
    dictionary: DataFrame

    @staticmethod
    def of(index: DataFrame, n_row_groups: int, outlier_limit: int = 1000) -> Index:
        kept, dictionary = split_dictionary(index, n_row_groups)
        postings, outliers = split_outliers(kept, outlier_limit)
        return Index(postings, outliers, dictionary)

    def lists(self) -> DataFrame:
        return self.postings.unionByName(self.outliers)


def lookup(lists: DataFrame, wanted: list[Piece]) -> DataFrame:
    """(piece, type, token, row_groups) of matching tokens; the type list prunes partitions of a stored index."""
    types = sorted(set(t for p in wanted for t in supersets(mask_of(p.text))))
    hit = F.array_compact(F.array(*[F.when(p.matches(F.col("token")), F.lit(i)) for i, p in enumerate(wanted)]))
    any_hit = reduce(lambda a, b: a | b, [p.matches(F.col("token")) for p in wanted])
    return lists.where(F.col("type").isin(types) & any_hit).select(F.explode(hit).alias("piece"), "type", "token", "row_groups")


def pruning_pieces(index: Index, wanted: list[Piece]) -> list[Piece]:
    """Pieces that no dictionary token matches: only these can rule out a row group. Returns to the driver at most one number a piece."""
    common = lookup(index.dictionary.withColumn("row_groups", F.array().cast("array<bigint>")), wanted).select("piece").distinct().collect()
    seen = {r["piece"] for r in common}
    return [p for i, p in enumerate(wanted) if i not in seen]


def candidate_row_groups(index: Index, literals: list[str]) -> DataFrame | None:
    """Row groups that can hold all literals, or None if the index rules out nothing."""
    wanted = [p for q in literals for p in pieces(q)]
    useful = pruning_pieces(index, list(dict.fromkeys(wanted))) if wanted else []
    if not useful:
        return None
    hits = lookup(index.lists(), useful).select("piece", F.explode("row_groups").alias("rg")).distinct()
    return hits.groupBy("rg").agg(F.count("*").alias("n")).where(F.col("n") == len(useful)).select("rg")


def gram_keys(literals: list[str]) -> list[str]:
    """The grams that every line with all literals holds; one shorter than GRAM stands for all grams that begin with it."""
    keys = []
    for p in (p for q in literals for p in pieces(q)):
        framed = ("" if p.left_open else FRAME) + p.text + ("" if p.right_open else FRAME)
        if len(framed) >= LEAST:
            keys += [framed[i : i + GRAM] for i in range(max(1, len(framed) - GRAM + 1))]
    return list(dict.fromkeys(keys))


def gram_candidates(grams: DataFrame, keys: list[str]) -> DataFrame:
    """(split, useful, rgs): row groups of a split that hold all keys which rule out anything there, and how many these are.

    With ``useful`` 0 every row group stays. A split without any of the keys has no row: it holds no answer. A row's list is as long as its split has row groups.
    """
    gram = F.col("gram")
    tests = [gram.startswith(k) if len(k) < GRAM else gram == k for k in keys]
    hit = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))
    found = grams.where(_either(tests)).select("split", "row_groups", F.explode(hit).alias("k"))
    per = found.select("split", "k", F.explode_outer("row_groups").alias("rg")).groupBy("split", "rg").agg(F.collect_set("k").alias("ks"))
    common = F.flatten(F.collect_list(F.when(F.col("rg").isNull(), F.col("ks"))))
    split = per.groupBy("split").agg(common.alias("common"), F.collect_list(F.when(F.col("rg").isNotNull(), F.struct("rg", "ks"))).alias("held"))
    useful = F.lit(len(keys)) - F.size("common")
    inside = F.filter("held", lambda x: F.size(F.array_except(x["ks"], F.col("common"))) == useful)
    return split.select("split", useful.alias("useful"), F.array_sort(F.transform(inside, lambda x: x["rg"])).alias("rgs"))


def _either(tests: list[Column]) -> Column:
    """Their disjunction as a balanced tree, which is pushed down whatever their number."""
    if len(tests) == 1:
        return tests[0]
    half = len(tests) // 2
    return _either(tests[:half]) | _either(tests[half:])


def merged_ranges(values: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Sorted ranges (both ends inclusive) that cover the given ones, at most ``most``: the smallest gaps are closed."""
    out: list[list[int]] = []
    for a, b in sorted(values):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    if len(out) > most:
        gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1], reverse=True)[: most - 1]
        keep = sorted([0, *gaps, len(out)])
        out = [[out[i][0], out[j - 1][1]] for i, j in zip(keep, keep[1:])]
    return [(a, b) for a, b in out]


def literals_of(query: str, mode: str) -> list[str]:
    if mode == "literal":
        return [query]
    if mode == "regex":
        return required_literals(query)
    raise ValueError(f"unknown mode {mode!r}")


def plan_code(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query, code): 0 if a dictionary token holds it (every row group may match), 1 if the outlier tokens alone give k row groups, else 2 (search all tokens too).

    ``queries`` is (query), a small table; all of them are tried against each token in one pass.
    """
    q = F.broadcast(queries.select("query").distinct())
    common = index.dictionary.join(q, F.col("token").contains(F.col("query"))).select("query").distinct().withColumn("common", F.lit(True))
    hits = index.outliers.join(q, F.col("token").contains(F.col("query"))).select("query", F.explode("row_groups").alias("rg")).distinct()
    counts = hits.groupBy("query").agg(F.count("*").alias("n"))
    found = q.join(common, "query", "left").join(counts, "query", "left")
    return found.select("query", F.when(F.col("common"), 0).when(F.coalesce("n", F.lit(0)) >= k, 1).otherwise(2).cast("long").alias("code"))
