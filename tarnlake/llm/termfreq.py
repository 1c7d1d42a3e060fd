"""Occurrences and records of every distinct term, by range-partitioned sort of (term, record) pairs and run-length scanning.

Pairs are range-partitioned by (term, record), so a frequent term spreads over as many partitions as its share of the rows and a record is never split.
Scanning a sorted partition needs memory for one batch. Only the first and last term of a partition can go on elsewhere; these edges alone are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

COUNTS = ("occurrences", "n_records", "n_groups")
SCHEMA = "term string, occurrences long, n_records long, n_groups long, edge boolean"
ARROW = pa.schema([("term", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("edge", pa.bool_())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of (term, kind, record, place) in order; kind 0 are occurrences, kind 1 memberships in groups."""
    held, before, first = None, None, True  # the term being counted, the last row seen, no term written yet

    def out(terms: pa.Array, counts: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([terms, *[pa.array(counts[:, i]) for i in range(3)], pa.array(edges)], schema=ARROW)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term = batch.column(0)
        rest = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3)])
        new_term, new_rec, new_place = (np.ones(n, bool) for _ in range(3))
        if n > 1:
            new_term[1:] = pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new_rec[1:] = new_term[1:] | (rest[:2, 1:] != rest[:2, :-1]).any(axis=0)
            new_place[1:] = new_rec[1:] | (rest[2, 1:] != rest[2, :-1])
        if before is not None:
            new_term[0] = term[0].as_py() != before[0]
            new_rec[0] = new_term[0] or tuple(rest[:2, 0]) != before[1][:2]
            new_place[0] = new_rec[0] or rest[2, 0] != before[1][2]
        occurs = rest[0] == 0
        ones = np.stack([new_place & occurs, new_rec & occurs, new_rec & ~occurs], axis=1).astype(np.int64)
        starts = np.flatnonzero(new_term)
        begins = starts if len(starts) and starts[0] == 0 else np.concatenate([[0], starts])
        sums = np.add.reduceat(ones, begins, axis=0)
        if not new_term[0]:
            held[1] += sums[0]
            sums, begins = sums[1:], begins[1:]
        before = (term[n - 1].as_py(), tuple(rest[:, -1]))
        if len(begins):
            names, counts, edges = [], [], []
            if held is not None:
                names.append(pa.array([held[0]], pa.string()))
                counts.append(held[1][None, :])
                edges.append(np.array([first]))
                first = False
            body = begins[:-1]
            names.append(term.take(pa.array(body)).cast(pa.string()))
            counts.append(sums[:-1])
            mid = np.zeros(len(body), bool)
            if first and len(body):
                mid[0], first = True, False
            edges.append(mid)
            held = [term[int(begins[-1])].as_py(), sums[-1].copy()]
            yield out(pa.concat_arrays(names), np.concatenate(counts), np.concatenate(edges))
    if held is not None:
        yield out(pa.array([held[0]], pa.string()), held[1][None, :], np.array([True]))


def term_frequencies(occurrences: DataFrame, memberships: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """(term, occurrences, n_records, n_groups) of every distinct non-null term.

    ``occurrences`` is (term string, record long, place long): each distinct triple is one occurrence, each distinct (term, record) one record.
    ``memberships`` is (term, list of group ids): each distinct (term, group) counts once. Rows with a null term are left out; null records or
    places count as one value of their own (-2^62), null group ids are left out. The empty string is a term. An empty table gives no rows.
    """
    none = F.lit(-(2**62))
    pairs = occurrences.toDF("term", "record", "place").where("term is not null")
    pairs = pairs.select("term", F.lit(0).alias("kind"), F.coalesce(F.col("record").cast("long"), none).alias("record"), F.coalesce(F.col("place").cast("long"), none).alias("place"))
    if memberships is not None:
        lists = memberships.toDF("term", "groups").where("term is not null").select("term", F.explode(F.array_distinct("groups")).alias("record"))
        lists = lists.where("record is not null").select("term", F.lit(1).alias("kind"), F.col("record").cast("long").alias("record"), F.lit(0).cast("long").alias("place"))
        pairs = pairs.unionByName(lists)
    n = partitions or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pairs.repartitionByRange(n, "term", "kind", "record").sortWithinPartitions("term", "kind", "record", "place")
    scanned = cut(placed.mapInArrow(_scan, SCHEMA))
    whole = scanned.where(~F.col("edge")).select("term", *COUNTS)
    edges = scanned.where("edge").groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS])  # two rows a partition
    return whole.unionByName(edges)


def marked(frequencies: DataFrame, n_groups: int, rare: int = 2, common: float = 0.5) -> DataFrame:
    """Add ``mark``: rare (at most ``rare`` occurrences), common (in more than ``common`` of ``n_groups`` groups), else null; common wins where both hold."""
    mark = F.when(F.col("n_groups") > common * n_groups, "common").when(F.col("occurrences") <= rare, "rare")
    return frequencies.withColumn("mark", mark)


def count_groups(memberships: DataFrame, lists: str) -> int:
    """Distinct non-null group ids over all lists."""
    return memberships.select(F.explode(F.array_distinct(lists)).alias("g")).where("g is not null").distinct().count()
