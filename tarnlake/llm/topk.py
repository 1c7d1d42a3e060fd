"""The most frequent values of a column in bounded memory: space-saving summaries in a tree, then one exact pass over the candidates.

A summary holds at most ``capacity`` counters (value, count, error) and ``floor``: no value without a counter occurs more often than that, and a
counter's true number lies between count - error and count. A value that comes in anew takes over ``floor`` as count and error, as the least counter's
in the space-saving algorithm; of more than ``capacity`` counters the least go, and the floor is the least that stays. Summaries merge by the same rule, a value
that one of them lacks having its floor there. The capacity never changes. If the bounds leave open whether values outside the counters belong to
the k, their exact numbers are counted by a distributed aggregation and only those that reach the k-th are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY = "value string, n long, error long, floor long, part int"
ARROW = pa.schema([("value", pa.string()), ("n", pa.int64()), ("error", pa.int64()), ("floor", pa.int64()), ("part", pa.int32())])


class Summary:
    """A space-saving summary that takes counted values; memory is 2 * capacity counters."""

    def __init__(self, capacity: int):
        self.capacity, self.floor = capacity, 0
        self.counts: dict[str, int] = {}
        self.errors: dict[str, int] = {}
        self.waiting: dict[str, int] = {}

    def add(self, values: list, numbers: list) -> None:
        waiting = self.waiting
        for v, n in zip(values, numbers):
            if v is not None:
                waiting[v] = waiting.get(v, 0) + n
        if len(waiting) > self.capacity:
            self.fold()

    def fold(self) -> None:
        counts, errors, floor = self.counts, self.errors, self.floor
        for v, n in self.waiting.items():
            if v in counts:
                counts[v] += n
            else:
                counts[v] = n + floor
                if floor:
                    errors[v] = floor
        self.waiting = {}
        if len(counts) > self.capacity:
            values = list(counts)
            numbers = np.fromiter(counts.values(), np.int64, len(counts))
            keep = np.argpartition(numbers, len(numbers) - self.capacity)[len(numbers) - self.capacity :]
            self.floor = int(numbers[keep].min())
            self.counts = {values[i]: int(numbers[i]) for i in keep.tolist()}
            self.errors = {v: e for v, e in errors.items() if v in self.counts}

    def frame(self, part: int) -> pd.DataFrame:
        """The counters; a row with a null value carries the floor even if no counter is left."""
        self.fold()
        errors = [self.errors.get(v, 0) for v in self.counts]
        frame = pd.DataFrame({"value": [*self.counts, None], "n": [*self.counts.values(), 0], "error": [*errors, 0], "floor": self.floor, "part": part})
        return frame.astype({"n": "int64", "error": "int64", "floor": "int64", "part": "int32"})


def summaries(df: DataFrame, column: str, capacity: int) -> DataFrame:
    """One summary a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = Summary(capacity)
        for batch in batches:
            tally = pc.value_counts(batch.column(0))
            held.add(tally.field("values").to_pylist(), tally.field("counts").to_pylist())
        yield pa.RecordBatch.from_pandas(held.frame(TaskContext.get().partitionId()), schema=ARROW, preserve_index=False)

    return df.select(F.col(column).cast("string").alias("value")).mapInArrow(run, SUMMARY)


def merge(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One summary from several of a group: a value has the floor of each summary that lacks it, in count and error."""
    ends = frame[frame["value"].isna()]
    floor = int(ends["floor"].sum())
    rows = frame.dropna(subset=["value"])
    rows = rows.assign(n=rows["n"] - rows["floor"], error=rows["error"] - rows["floor"]).groupby("value", sort=False)[["n", "error"]].sum() + floor
    if len(rows) > capacity:
        rows = rows.nlargest(capacity, "n")
        floor = int(rows["n"].min())
    part = int(frame["part"].iloc[0])
    out = pd.DataFrame({"value": [*rows.index, None], "n": [*rows["n"], 0], "error": [*rows["error"], 0], "floor": floor, "part": part})
    return out.astype({"n": "int64", "error": "int64", "floor": "int64", "part": "int32"})


def merge_tree(parts: DataFrame, n_parts: int, capacity: int, fan: int = 16) -> DataFrame:
    """Merge summaries ``fan`` at a time until one is left; a task holds at most fan * (capacity + 1) rows."""
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("part").applyInPandas(lambda frame: merge(frame, capacity), SUMMARY)
        n_parts = -(-n_parts // fan)
        if n_parts <= 1:
            return parts


def top_values(df: DataFrame, column: str, k: int, capacity: int = 8192) -> DataFrame:
    """The k values, neither null nor empty, with most rows: (value, n, least_n, most_n); equal counts go to the lesser value in byte order.

    n is exact; least_n and most_n are the bounds of the summary, null for a value without counter. The driver sees at most capacity + k rows, whatever the column holds: where
    the k-th place is tied or flat beyond the floor of the summary, all values are counted exactly in a spilling aggregation and the k best taken. Fewer than k values give fewer rows.
    """
    if capacity < k:
        raise ValueError("fewer counters than values wanted")
    spark = df.sparkSession
    values = df.select(F.col(column).cast("string").alias("value")).where("value <> ''")
    summary = merge_tree(summaries(values, "value", capacity), max(1, values.rdd.getNumPartitions()), capacity).collect()  # at most capacity + 1 rows
    floor = max((r["floor"] for r in summary), default=0)
    held = [(r["value"], r["n"] - r["error"], r["n"]) for r in summary if r["value"] is not None]
    sure = sorted((least for _, least, _ in held), reverse=True)[:k]
    needed = sure[-1] if len(sure) == k else 0
    candidates = spark.createDataFrame([h for h in held if h[2] >= needed], "value string, least_n long, most_n long")
    exact = values.join(F.broadcast(candidates.select("value")), "value").groupBy("value").agg(F.count("*").alias("n"))  # at most capacity rows
    best = exact.orderBy(F.desc("n"), "value").limit(k).collect()
    if floor and (len(best) < k or best[-1]["n"] <= floor):
        reach = best[-1]["n"] if len(best) == k else 1
        others = values.join(F.broadcast(candidates.select("value")), "value", "left_anti").groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= reach)
        best = sorted([*best, *others.orderBy(F.desc("n"), "value").limit(k).collect()], key=lambda r: (-r["n"], r["value"].encode()))[:k]
    rows = spark.createDataFrame([(r["value"], r["n"]) for r in best], "value string, n long")
    return rows.join(F.broadcast(candidates), "value", "left").select("value", "n", "least_n", "most_n")
