"""Processing only new or changed records: change log, per-partition offsets, write-ahead plans, idempotent sink.

Records of a source arrive in a log; a record's offset is its place of arrival, so a record that is late by its own time still has a later
offset and is never passed over. ``ChangeFeed`` works the log off in batches. A batch begins with a plan, written before anything else, that names for each
partition of the log the offsets it covers: everything after the last committed batch. A batch that fails is replayed by its own plan, and its
output replaces what the failed attempt left; the commit, written last, makes it count. What a batch hands to the next one (the versions the sink holds, records
that wait for a run) is written and committed with it.

``changed_files`` is the work of one batch over runs of an index: which run processes which version of a file. ``RunFeed`` runs it through a feed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .ordered import carry_forward

#: Place of arrival of a row of a Parquet table: when its file was written, the file, the row in it.
ARRIVAL = ("arrived_at", "arrived_in", "arrived_row")
LOG = "index_name string, last_file string, obs_id long, offset_us long, version string"
HELD = "index_name string, last_file string, end_us long, run_id long, version string"


def with_arrival(table: DataFrame) -> DataFrame:
    """Rows of Parquet files with the columns of ARRIVAL, which grow with arrival and tell all rows apart."""
    return table.select("*", F.unix_micros("_metadata.file_modification_time").alias(ARRIVAL[0]), F.col("_metadata.file_path").alias(ARRIVAL[1]), F.col("_metadata.row_index").alias(ARRIVAL[2]))


def sum_kinds(observations: DataFrame) -> DataFrame:
    """(index_name, has_sum): whether any observation of the index has a content_sum; one row an index."""
    return observations.groupBy("index_name").agg(F.max(F.col("content_sum").isNotNull()).alias("has_sum"))


def change_log(observations: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Observations as log records (index_name, last_file, obs_id, offset_us, version); ``kinds`` as ``sum_kinds`` gives them, where more is known than these observations tell.

    The version is content_sum. An index in which no observation has one is versioned by (last_file_time, size_bytes).
    Observations that carry no version, no time or no id are not records of a change and are left out. offset_us is seen_at.
    """
    kinds = (kinds if kinds is not None else sum_kinds(observations)).select(F.col("index_name").alias("__i"), F.col("has_sum").alias("__has_sum"))
    obs = observations.where(F.col("obs_id").isNotNull() & F.col("seen_at").isNotNull())
    obs = obs.join(kinds, obs["index_name"].eqNullSafe(kinds["__i"]))
    pair = F.when(
        F.col("last_file_time").isNotNull() | F.col("size_bytes").isNotNull(),
        F.concat_ws("/", F.coalesce(F.unix_micros("last_file_time").cast("string"), F.lit("-")), F.coalesce(F.col("size_bytes").cast("string"), F.lit("-"))),
    )
    version = F.when(F.col("__has_sum"), F.col("content_sum")).otherwise(pair)
    return obs.select("index_name", "last_file", "obs_id", F.unix_micros("seen_at").alias("offset_us"), version.alias("version")).where("version is not null")


def committed_batches(runs: DataFrame, ok: str = "ok") -> DataFrame:
    """The runs that count: (index_name, run_id, end_us), with status ``ok`` and a start time.

    A run covers what was seen after the previous run of its index that counts, up to end_us. Runs of any other
    status (null included) processed nothing; the next run takes what they should have.
    """
    good = (F.col("run_status") == ok) & F.col("started_at").isNotNull() & F.col("run_id").isNotNull()
    return runs.where(good).select("index_name", "run_id", F.unix_micros("started_at").alias("end_us"))


def place(log: DataFrame, batches: DataFrame) -> DataFrame:
    """Log records with ``into``, the first run (end_us, run_id) of their index at or after them, null if there is none yet.

    Time runs backwards in the sort, so the value carried forward is the next run; at equal times the run comes first, of equal runs the least run_id.
    Records and runs may repeat.
    """
    none = F.lit(None)
    records = log.select("index_name", "last_file", "obs_id", "offset_us", "version", (-F.col("offset_us")).alias("back"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"), none.cast("struct<end_us:bigint,run_id:bigint>").alias("run"))
    ends = batches.select("index_name", none.cast("string").alias("last_file"), none.cast("long").alias("obs_id"), none.cast("long").alias("offset_us"), none.cast("string").alias("version"), (-F.col("end_us")).alias("back"), F.lit(0).alias("kind"), (-F.col("run_id")).alias("tie"), F.struct("end_us", "run_id").alias("run"))
    placed = carry_forward(records.unionByName(ends), ["index_name"], ["back", "kind", "tie"], "run", "into")
    return placed.where("kind = 1").select("index_name", "last_file", "obs_id", "offset_us", "version", "into")


def against_sink(placed: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """One row for each (file, run) with records: the latest (offset_us, obs_id, version) and sink_version, the version processed before it (null: none).

    ``held`` are the versions the sink has from earlier batches.
    """
    latest = placed.where("into is not null").groupBy("index_name", "last_file", F.col("into.end_us").alias("end_us"), F.col("into.run_id").alias("run_id"))
    rows = latest.agg(F.max(F.struct("offset_us", "obs_id", "version")).alias("r")).select("index_name", "last_file", "end_us", "run_id", "r.obs_id", "r.version", F.lit(True).alias("fresh"))
    if held is not None:
        rows = rows.unionByName(held.select("index_name", "last_file", "end_us", "run_id", F.lit(None).cast("long").alias("obs_id"), "version", F.lit(False).alias("fresh")))
    return carry_forward(rows, ["index_name", "last_file"], ["end_us", "run_id", "fresh"], "version", "sink_version", strict=True)


def changed_files(observations: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, obs_id, index_name, last_file, version) each run that counts has to process, over the whole of both tables in one batch.

    Every record falls to the first run at or after it (records after the last run wait); per file and run the latest record holds; it is a case if its version
    is not the one the sink has from the run before. Empty tables give no rows; null index or file names form their own group; ties in
    time fall to the greater obs_id; repeated rows count once.
    """
    return _cases(against_sink(place(change_log(observations), committed_batches(runs))))


def _cases(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("fresh") & ~F.col("version").eqNullSafe(F.col("sink_version"))).select("run_id", "obs_id", "index_name", "last_file", "version")


def _parts(offset) -> list:
    """An offset as it stands in a plan; plans of a single offset column may hold the bare value."""
    return offset if isinstance(offset, list) else [offset]


Process = Callable[[DataFrame, dict[str, DataFrame]], dict[str, DataFrame]]


class ChangeFeed:
    """Exactly-once processing of a growing table of records with a key, a version and an offset.

    State lives under ``state_dir`` through Spark's file system layer: ``plans/<n>`` (write-ahead: start and end offset per
    partition), ``commits/<n>`` (marker) and ``batches/<n>/<table>``. ``run`` first replays a plan that has no commit, with the
    same offsets; what the failed attempt wrote is replaced, so nothing is written twice. The table ``sink`` adds up over batches; the others are state, and only those
    of the last committed batch count. Partition of a record: hash of its key modulo ``partitions``, fixed at the first plan.

    ``offset`` is one column or several, compared in turn; it must grow with arrival (see ``with_arrival``) and tell the records of a key apart, or ``run`` refuses the
    batch; ``unique`` says that it does, and saves the check. ``order`` tells which record of a key is the latest within a batch (by default the offset).
    Records with a null in an offset are left out. The sink holds a (key, offset) once: a record at or below the offset it holds for its key is dropped.
    """

    def __init__(self, spark: SparkSession, state_dir: str, key: str | Sequence[str], version: str, offset: str | Sequence[str], partitions: int = 8, order: Sequence[str] | None = None, unique: bool = False):
        self.spark, self.dir, self.version, self.partitions, self.unique = spark, state_dir.rstrip("/"), version, partitions, unique
        self.key = [key] if isinstance(key, str) else list(key)
        self.offset = [offset] if isinstance(offset, str) else list(offset)
        self.order = list(order) if order else self.offset
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.dir).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")

    def _numbers(self, kind: str) -> list[int]:
        path = self._path(kind)
        if not self._fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(path) if s.getPath().getName().isdigit())

    def _write(self, name: str, content: dict) -> None:
        """Write beside and rename: a plan or a commit is there whole or not at all. A rename that fails is an error."""
        temp = self._path(f"{name}.tmp")
        stream = self._fs.create(temp, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if not self._fs.rename(temp, self._path(name)):
            raise OSError(f"cannot write {self.dir}/{name}")

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def plan(self, source: DataFrame) -> tuple[int, dict]:
        """The plan to run next: an uncommitted one as it was written, else a new one up to the present end of the log."""
        plans, done = self._numbers("plans"), set(self._numbers("commits"))
        if plans and plans[-1] not in done:
            return plans[-1], self._read(f"plans/{plans[-1]}")
        start = {p: _parts(o) for p, o in self._read(f"plans/{plans[-1]}")["end"].items()} if plans else {}
        ends = source.where(self._placed()).groupBy(self._partition().alias("p")).agg(F.max(F.struct(*self.offset)).alias("o")).collect()  # one row a partition
        end = start | {str(r["p"]): max(list(r["o"]), start.get(str(r["p"]), list(r["o"]))) for r in ends}
        n = (plans[-1] if plans else 0) + 1
        content = {"start": start, "end": end}
        self._write(f"plans/{n}", content)
        return n, content

    def _placed(self):
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.offset])

    def _bounds(self, source: DataFrame, offsets: dict):
        """The offset of a plan for each row's partition; null where it has none."""
        kinds = [source.schema[c].dataType for c in self.offset]
        bound = lambda o: F.struct(*[F.lit(x).cast(t).alias(c) for x, t, c in zip(_parts(o), kinds, self.offset)])
        return F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p), bound(o))])[self._partition()]

    def _partition(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.partitions)).cast("string")

    def sink(self) -> DataFrame | None:
        """What all committed batches gave, with their number in ``batch``."""
        done = self._numbers("commits")
        parts = [self.spark.read.parquet(f"{self.dir}/batches/{n}/sink").withColumn("batch", F.lit(n)) for n in done]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def state(self) -> dict[str, DataFrame]:
        """The state tables of the last committed batch."""
        done = self._numbers("commits")
        if not done:
            return {}
        folder = self._path(f"batches/{done[-1]}")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return {t: self.spark.read.parquet(f"{self.dir}/batches/{done[-1]}/{t}") for t in names if t != "sink"}

    def run(self, source: DataFrame, process: Process | Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Process one batch; returns its number. ``process`` takes the records of the sink (all columns of the source) and gives what is written for them."""
        return self.run_batch(source, lambda batch, state: self._newest(batch, state, process))

    def run_batch(self, source: DataFrame, process: Process) -> int:
        """One batch in which ``process`` turns its records and the state into the tables to write, ``sink`` and state."""
        n, plan = self.plan(source)
        at = F.struct(*self.offset)
        inside = self._placed() & (at <= self._bounds(source, plan["end"])) if plan["end"] else F.lit(False)
        if plan["start"]:
            low = self._bounds(source, plan["start"])
            inside = inside & (low.isNull() | (at > low))
        tables = process(source.where(inside), self.state())
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.dir}/batches/{n}/{name}")
        self._write(f"commits/{n}", {"batch": n})
        return n

    def _newest(self, batch: DataFrame, state: dict[str, DataFrame], process) -> dict[str, DataFrame]:
        """The latest record of each key, if its version is not the one the sink holds; the state is one row a key, whatever the number of batches."""
        batch = batch.where(F.col(self.version).isNotNull())
        if not self.unique and batch.groupBy(*self.key, *self.offset).agg((F.min(self.version) < F.max(self.version)).alias("tied")).where("tied").limit(1).count():
            raise ValueError("two versions of a key have the same offset")
        rest = [c for c in batch.columns if c not in self.key]
        held = state.get("held")
        same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"__{k}"]) for k in self.key])
        if held is not None:
            known = held.select(*[F.col(k).alias(f"__{k}") for k in self.key], F.col("version").alias("__v"), F.struct(*self.offset).alias("__o"))
            batch = batch.join(known, same(batch, known), "left").where(F.col("__o").isNull() | (F.struct(*self.offset) > F.col("__o")))
        else:
            batch = batch.withColumn("__v", F.lit(None).cast("string"))
        latest = batch.groupBy(*self.key).agg(F.max_by(F.struct(*rest, "__v"), F.struct(*self.order)).alias("__r"), F.max(F.struct(*self.offset)).alias("__o"))
        latest = cut(latest.select(*self.key, "__r.*", "__o"))
        fresh = latest.where(~F.col(self.version).cast("string").eqNullSafe(F.col("__v"))).drop("__v", "__o")
        now = latest.select(*self.key, F.col(self.version).cast("string").alias("version"), "__o.*")
        if held is not None:
            gone = now.select(*[F.col(k).alias(f"__{k}") for k in self.key])
            now = now.unionByName(held.join(gone, same(held, gone), "left_anti"))
        return {"sink": process(fresh) if process else fresh, "held": now}


class RunFeed:
    """The files each run of an index must process, batch by batch through a ``ChangeFeed`` over the observations by arrival.

    A batch takes the observations that arrived since the last one and those that wait for a run. State: ``held``, the version each file was last processed in, and ``waiting``.
    A record that arrives after a batch that its time belongs to falls to the next run that counts, as it would have for the run itself.
    """

    def __init__(self, spark: SparkSession, state_dir: str, partitions: int = 8):
        self.feed = ChangeFeed(spark, state_dir, ["index_name", "last_file"], "content_sum", ARRIVAL, partitions, unique=True)

    def advance(self, observations: DataFrame, runs: DataFrame) -> int:
        """Process what arrived up to now; ``observations`` have the columns of ``with_arrival``."""

        def process(batch: DataFrame, state: dict[str, DataFrame]) -> dict[str, DataFrame]:
            kinds, held = sum_kinds(batch), state.get("held")
            if held is not None:
                kinds = cut(kinds.unionByName(state["kinds"]).groupBy("index_name").agg(F.max("has_sum").alias("has_sum")))
            log, batches = change_log(batch, kinds), committed_batches(runs)
            if held is not None:
                log = log.unionByName(state["waiting"])
                done = state["upto"].select(F.col("index_name").alias("__i"), F.struct("end_us", "run_id").alias("__u"))
                left = batches.join(done, batches["index_name"].eqNullSafe(done["__i"]), "left")
                batches = left.where(F.col("__u").isNull() | (F.struct("end_us", "run_id") > F.col("__u"))).select("index_name", "run_id", "end_us")
            placed = place(log, batches)
            compared = against_sink(placed, held)
            now = compared.groupBy("index_name", "last_file").agg(F.max(F.struct("end_us", "run_id", "version")).alias("r")).select("index_name", "last_file", "r.*")
            waiting = placed.where("into is null").drop("into").select(*[f.split()[0] for f in LOG.split(", ")])
            upto = committed_batches(runs).groupBy("index_name").agg(F.max(F.struct("end_us", "run_id")).alias("r")).select("index_name", "r.*")
            return {"sink": _cases(compared), "held": now, "waiting": waiting, "upto": upto, "kinds": kinds}

        return self.feed.run_batch(observations, process)

    def processed(self) -> DataFrame:
        """(run_id, obs_id, index_name, last_file, version, batch) over all batches."""
        found = self.feed.sink()
        return found if found is not None else self.feed.spark.createDataFrame([], "run_id long, obs_id long, index_name string, last_file string, version string, batch int")
