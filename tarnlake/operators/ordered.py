"""Order-dependent operators over range-sorted rows, which never put a whole key into one task.

Rows are range-partitioned by (group, order) and sorted, so a group of any size spreads over as many partitions as its share of the rows. Each
partition is scanned once, in Arrow batches; only its first group can have begun in an earlier partition, so one row a partition is chained
and added back. The scanned rows are checkpointed: range boundaries are sampled, and a partition number must mean the same rows each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegerType, LongType, StructField, StructType

from ..session import cut


def changed(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row differs from the row before it in any of the columns; nulls are equal. The first row is never told to differ."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(n, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def sorted_ranges(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``keys``, nulls first; without ``partitions`` their number follows the size of the data."""
    placed = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return placed.sortWithinPartitions(*keys)


class _Groups:
    """Where groups begin, batch after batch of one sorted partition."""

    def __init__(self, names: list[str]):
        self.names, self.last, self.seen = names, None, 0

    def next(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row begins a group, row is of the partition's first group)."""
        cols = [batch.column(batch.schema.get_field_index(g)) for g in self.names]
        starts = changed(cols) if cols else np.zeros(batch.num_rows, bool)
        head = tuple(c[0].as_py() for c in cols)
        starts[0] = self.seen == 0 or head != self.last
        number = self.seen + np.cumsum(starts)
        self.last, self.seen = tuple(c[batch.num_rows - 1].as_py() for c in cols), int(number[-1])
        return starts, number == 1


def _scan(df: DataFrame, group: list[str], order: list[str], partitions: int | None, kind: DataType, make: Callable) -> DataFrame:
    """Add __out and __tail (of ``kind``), __open (of the partition's first group), __pid and __row. ``make`` gives a function of (batch, starts) -> (out, tail)."""
    extra = [StructField("__out", kind), StructField("__tail", kind), StructField("__open", BooleanType()), StructField("__pid", IntegerType()), StructField("__row", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, groups, step, done = TaskContext.get().partitionId(), _Groups(group), make(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, first = groups.next(batch)
            out, tail = step(batch, starts)
            marks = [pa.array(first), pa.array(np.full(batch.num_rows, pid, np.int32)), pa.array(np.arange(done, done + batch.num_rows))]
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, out, tail, *marks], [*batch.schema.names, *[f.name for f in extra]])

    return cut(sorted_ranges(df, [*group, *order], partitions).mapInArrow(run, StructType([*df.schema.fields, *extra])))


def _chained(scanned: DataFrame, group: list[str], kind: DataType, add: Callable) -> DataFrame:
    """Add __carry: what earlier partitions hold of the first group of a row's partition. One row a partition comes to the driver and goes back as a broadcast."""
    key = F.struct(F.lit(0).alias("__z"), *group)
    ends = scanned.groupBy("__pid").agg(F.min_by(key, "__row").alias("first"), F.max_by(key, "__row").alias("last"), F.max_by("__tail", "__row").alias("tail"))
    carries, at, held = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r["__pid"]):
        if r["first"] == at and held is not None:
            carries.append((r["__pid"], held))
        held = add(held, r["tail"]) if r["last"] == at else r["tail"]
        at = r["last"]
    schema = StructType([StructField("__cp", IntegerType()), StructField("__carry", kind)])
    carry = scanned.sparkSession.createDataFrame(carries, schema)
    return scanned.join(F.broadcast(carry), scanned["__pid"] == carry["__cp"], "left").drop("__cp")


def carry_forward(df: DataFrame, group: list[str], order: list[str], value: str, out: str, strict: bool = False, partitions: int | None = None) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of the group at or before (``strict``: before) this row in ``order``.

    Rows equal in ``order`` come in any order unless it is unique. Null keys form their own group, nulls of ``order`` come first. An empty input gives an empty output.
    """
    kind = df.schema[value].dataType

    def make():
        held = None

        def step(batch: pa.RecordBatch, starts: np.ndarray):
            nonlocal held
            v, n = batch.column(batch.schema.get_field_index(value)), batch.num_rows
            valid = v.is_valid().to_numpy(zero_copy_only=False)
            source = pa.concat_arrays([held if held is not None else pa.nulls(1, v.type), v, pa.nulls(1, v.type)])
            mark = np.maximum.accumulate(np.where(valid | starts, np.arange(n), -1))
            at = np.where(mark < 0, 0, np.where(valid[mark], mark + 1, n + 1))
            fill = source.take(pa.array(at))
            before = source.take(pa.array(np.where(starts, n + 1, np.concatenate([[0], at[:-1]])))) if strict else fill
            held = fill.slice(n - 1, 1)
            return before, fill

        return step

    scanned = _chained(_scan(df, group, order, partitions, kind, make), group, kind, lambda a, b: a if b is None else b)
    filled = F.coalesce("__out", F.when(F.col("__open"), F.col("__carry")))
    return scanned.withColumn(out, filled).drop("__out", "__tail", "__open", "__pid", "__row", "__carry")


def running_total(df: DataFrame, group: list[str], order: list[str], amount: str, out: str, partitions: int | None = None) -> DataFrame:
    """Add ``out``: the inclusive running sum of the whole number ``amount`` (null: 0) within ``group`` along ``order``.

    Rows equal in ``order`` come in any order unless ``order`` is unique.
    """

    def make():
        held = 0

        def step(batch: pa.RecordBatch, starts: np.ndarray):
            nonlocal held
            v = pc.fill_null(batch.column(batch.schema.get_field_index(amount)).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(v)
            mark = np.maximum.accumulate(np.where(starts, np.arange(len(v)), -1))
            local = total + np.where(mark < 0, held, v[mark] - total[mark])
            held = int(local[-1])
            return pa.array(local), pa.array(local)

        return step

    scanned = _chained(_scan(df, group, order, partitions, LongType(), make), group, LongType(), lambda a, b: (a or 0) + b)
    total = F.col("__out") + F.coalesce(F.when(F.col("__open"), F.col("__carry")), F.lit(0))
    return scanned.withColumn(out, total).drop("__out", "__tail", "__open", "__pid", "__row", "__carry")
