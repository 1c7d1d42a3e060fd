"""Search over numbered lines: brute force, pruned by row groups, limits; search of a stored index over all its splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.planner import _either, gram_candidates, gram_keys, literals_of, merged_ranges
from ..sources import store

#: The candidate row groups become at most this many ranges of a filter, so the plan does not grow with them.
RANGES = 128


def predicate(log: Column, query: str, mode: str = "literal") -> Column:
    return log.contains(query) if mode == "literal" else log.rlike(query)


def bruteforce(lines: DataFrame, query: str, mode: str = "literal", log: str = "log") -> DataFrame:
    return lines.where(predicate(F.col(log), query, mode))


def restrict(lines: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """Lines of the candidate row groups; None leaves all."""
    return lines if candidates is None else lines.join(candidates, "rg", "left_semi")


@dataclass
class Pruning:
    """What the index leaves of one split: its row groups, all of them, or none."""

    split: int
    row_groups: int
    kept: list[int] | None

    @property
    def n_kept(self) -> int:
        return self.row_groups if self.kept is None else len(self.kept)

    def ranges(self) -> list[tuple[int, int]]:
        first = self.split << store.GID_BITS
        return [(first, first + (1 << store.GID_BITS) - 1)] if self.kept is None else [(first + rg, first + rg) for rg in self.kept]


def prune(spark: SparkSession, index_path: str, splits: dict[int, dict], query: str, mode: str = "literal") -> list[Pruning]:
    """One job over the gram tables of all ``splits`` (commits by number); what comes to the driver is at most one number a row group."""
    keys = gram_keys(literals_of(query, mode))
    if not keys:
        return [Pruning(n, c["row_groups"], None) for n, c in splits.items()]
    grams = store.read_table(spark, index_path, "grams").where(F.col("split").isin(list(splits)))
    found = {r["split"]: r for r in gram_candidates(grams, keys).collect()}
    out = []
    for n, c in splits.items():
        if c["grams"] == 0 and c["lines"]:
            raise FileNotFoundError(f"split {n} of {index_path} has lines but no index")
        kept = [] if n not in found else None if found[n]["useful"] == 0 else found[n]["rgs"]
        out.append(Pruning(n, c["row_groups"], kept))
    return out


def lines_of(spark: SparkSession, index_path: str, pruned: list[Pruning]) -> DataFrame:
    """The lines of the row groups that are left, in one plan for all splits; row groups in gaps that were closed are read too."""
    left = [p for p in pruned if p.n_kept]
    lines = store.read_table(spark, index_path, "lines")
    if not left:
        return lines.where(F.lit(False))
    ranges = merged_ranges([r for p in left for r in p.ranges()], RANGES)
    lines = lines.where(F.col("split").isin([p.split for p in left]))
    if all(p.kept is None for p in left):
        return lines
    return lines.where(_either([(F.col("gid") >= a) & (F.col("gid") <= b) if a < b else F.col("gid") == a for a, b in ranges]))


def search_index(spark: SparkSession, index_path: str, query: str, mode: str = "literal", splits: dict[int, dict] | None = None) -> DataFrame:
    """Exactly the lines of ``bruteforce`` over all committed splits, from the row groups the index leaves."""
    splits = store.commits(spark, index_path) if splits is None else splits
    return bruteforce(lines_of(spark, index_path, prune(spark, index_path, splits, query, mode)), query, mode)


def soft_limit(found: DataFrame, split: str, limit: int) -> DataFrame:
    """Rows of the newest splits, whole, until their number exceeds ``limit``; never truncates a split."""
    per = found.groupBy(split).agg(F.count("*").alias("n"))  # one row a split
    before = Window.orderBy(F.desc(split)).rowsBetween(Window.unboundedPreceding, -1)
    keep = per.withColumn("prior", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("prior") <= limit).select(split)
    return found.join(keep, split, "left_semi")


def topk(found: DataFrame, order: list[Column], k: int) -> DataFrame:
    return found.orderBy(*order).limit(k)


def distinct_lines(found: DataFrame, log: str = "log") -> DataFrame:
    return found.select(log).distinct()
