"""Runs of identical or near-identical consecutive events, by associative run summaries.

Events are range-sorted by (sequence, position, id), so a long sequence spreads over as many chunks as its share of the rows. Each chunk is scanned once and encodes its
runs as (first event, last event, count, earliest and latest time). Only the first and last run of a chunk can go on in its neighbours; summaries of neighbouring chunks combine
associatively, the last run of the left one and the first of the right one becoming one if the events that touch are the same. One summary a chunk is merged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.ordered import sorted_ranges
from ..session import cut

ENDS = re.compile(r"[.,;!]+(?=\s|$)", re.ASCII)
DIGITS = re.compile(r"\S*[0-9]\S*", re.ASCII)
BLANKS = re.compile(r"\s+", re.ASCII)


def normal_message(message: str | None) -> str | None:
    """The message without regard to case, amount of blank space, . , ; ! at word ends; all words that hold a digit 0-9 are one word. Null stays null."""
    if message is None:
        return None
    return BLANKS.sub(" ", DIGITS.sub("#", ENDS.sub("", message.lower()))).strip(" ")


class Event:
    """An event as far as it is compared; the message is worked out only where the ids do not settle it."""

    __slots__ = ("eid", "text", "_normal", "_done")

    def __init__(self, eid: int | None, text: str | None):
        self.eid, self.text, self._normal, self._done = eid, text, None, False

    def same(self, other: Event, message: Callable[[str], str | None]) -> bool:
        """Event ids equal and not negative, or messages equal; nulls equal nothing."""
        if self.eid is not None and self.eid == other.eid and self.eid >= 0:
            return True
        if self.text is None or other.text is None:
            return False
        if self.text == other.text:
            return self.message(message) is not None
        mine = self.message(message)
        return mine is not None and mine == other.message(message)

    def message(self, of: Callable[[str], str | None]) -> str | None:
        if not self._done:
            self._normal, self._done = of(self.text), True
        return self._normal


def join(left: list, right: list, same: Callable[[tuple, tuple], bool]) -> list:
    """Two neighbouring stretches as lists of at most their first run, closed runs and their last run; a run is (key, first_id, n, t0, t1, first, last)."""
    if not left or not right:
        return left or right
    a, b = left[-1], right[0]
    if not same(a, b):
        return left + right
    low = min((t for t in (a[3], b[3]) if t is not None), default=None)
    high = max((t for t in (a[4], b[4]) if t is not None), default=None)
    return [*left[:-1], (a[0], a[1], a[2] + b[2], low, high, a[5], b[6]), *right[1:]]


def event_runs(events: DataFrame, key: str, pos: str, event_id: str, eid: str, text: str, ts: str, message: Callable[[str], str | None] = normal_message, partitions: int | None = None) -> DataFrame:
    """Every maximal run of same events in a key's order: (key, first_id, n_events, t0, t1); single events are runs of one. t0 and t1 are microseconds.

    ``message`` turns a text into what is compared. Rows equal in key, position and id count once; rows without an id are left out. Order is ``pos`` (nulls first), then event_id.
    A null key is a sequence of its own. t0 and t1 are the earliest and latest non-null time, null if there is none. A task holds one batch and one run, whatever the length of a sequence.
    """
    rows = events.where(F.col(event_id).isNotNull()).select(
        F.col(key).alias("key"), F.col(pos).cast("long").alias("pos"), F.col(event_id).alias("id"), F.col(eid).cast("long").alias("eid"), F.col(text).alias("text"), F.unix_micros(ts).alias("t")
    )
    kinds = [rows.schema["key"].dataType, rows.schema["id"].dataType]
    run_fields = [StructField("key", kinds[0]), StructField("first_id", kinds[1]), *[StructField(c, LongType()) for c in ("n_events", "t0", "t1")]]
    edge = "struct<pid:int,place:int,first_eid:bigint,first_text:string,last_eid:bigint,last_text:string>"
    schema = StructType([*run_fields, StructField("edge", _type(edge))])
    arrow = pa.struct([("pid", pa.int32()), ("place", pa.int32()), ("first_eid", pa.int64()), ("first_text", pa.string()), ("last_eid", pa.int64()), ("last_text", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, types = TaskContext.get().partitionId(), None
        place, run, before = 0, None, None  # runs closed so far; the open run; the last row

        def out(runs: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*runs)) if runs else [[]] * 6
            kinds = [*types, pa.int64(), pa.int64(), pa.int64(), arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [f.name for f in schema])

        def close(run: list, last: bool) -> tuple:
            ends = None
            if place == 0 or last:
                ends = {"pid": pid, "place": place, "first_eid": run[5].eid, "first_text": run[5].text, "last_eid": run[6].eid, "last_text": run[6].text}
            return (*run[:5], ends)

        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(2).type]
            done = []
            for k, p, i, e, x, t in zip(*[c.to_pylist() for c in batch.columns]):
                if before == (k, p, i):
                    continue
                event = Event(e, x)
                if run is not None and run[0] == k and run[6].same(event, message):
                    run[2] += 1
                    run[6] = event
                    if t is not None:
                        run[3] = t if run[3] is None or t < run[3] else run[3]
                        run[4] = t if run[4] is None or t > run[4] else run[4]
                else:
                    if run is not None:
                        done.append(close(run, False))
                        place += 1
                    run = [k, i, 1, t, t, event, event]
                before = (k, p, i)
            if done:
                yield out(done)
        if run is not None:
            yield out([close(run, True)])

    scanned = cut(sorted_ranges(rows, ["key", "pos", "id"], partitions).mapInArrow(scan, schema))
    ends = sorted(scanned.where("edge is not null").collect(), key=lambda r: (r["edge"]["pid"], r["edge"]["place"]))  # at most two runs a chunk
    event = lambda e, side: Event(e[f"{side}_eid"], e[f"{side}_text"])
    chunks: dict[int, list] = {}
    for r in ends:
        chunks.setdefault(r["edge"]["pid"], []).append((r["key"], r["first_id"], r["n_events"], r["t0"], r["t1"], event(r["edge"], "first"), event(r["edge"], "last")))
    closed, held = [], []
    for runs in chunks.values():
        held = join(held, runs, lambda a, b: a[0] == b[0] and a[6].same(b[5], message))
        closed += held[:-1]
        held = held[-1:]
    merged = [r[:5] for r in [*closed, *held]]
    names = ["key", "first_id", "n_events", "t0", "t1"]
    whole = reduce(DataFrame.unionByName, [scanned.where("edge is null").select(*names), scanned.sparkSession.createDataFrame(merged, StructType(run_fields))])
    return whole.withColumnRenamed("key", key)


def _type(text: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(text)
