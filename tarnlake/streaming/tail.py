"""Tail mode: index files as they are finished, with Structured Streaming, each exactly once.

``settle`` moves every file but the one written last into an inbox, by rename, so the stream never sees a file that still grows.
``start_tail`` reads the inbox as a stream. A micro-batch is kept under its number, so a replayed batch overwrites itself; once what is kept
reaches the index interval it becomes a split, whose commit names the last batch in it. A batch that a commit covers is never indexed again, whenever it is
replayed. What a commit covers is dropped afterwards, files of the inbox only once the stream has gone on to a later batch. When the splits
that are no compaction reach the compaction interval, they are merged into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.strptime import java_pattern
from ..operators.ordered import running_total
from ..sources import lines as L
from ..sources import store

#: Digits of the modification time that ``settle`` puts before a name, so that a name used again is a new file.
STAMP = 13


def settle(spark: SparkSession, directory: str, inbox: str) -> list[str]:
    """Move all files but the most recently modified one (the last by name among equals); returns what was moved."""
    files = store.list_files(spark, directory)
    if not files:
        return []
    active = max(files, key=lambda f: (f[2], f[0]))[0]
    fs, target = store._fs(spark, inbox)
    fs.mkdirs(target)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    moved = []
    for path, _, modified in files:
        if path != active and fs.rename(path_of(path), path_of(target, f"{modified:0{STAMP}d}-{store.name_of(path)}")):
            moved.append(path)
    return moved


def _batches(spark: SparkSession, pending: str) -> list[int]:
    fs, where = store._fs(spark, pending)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch="))


def _read(spark: SparkSession, pending: str, batches: list[int]) -> DataFrame:
    return spark.read.option("basePath", pending).parquet(*[f"{pending}/batch={n}" for n in batches])


def indexed_upto(spark: SparkSession, index_path: str) -> int:
    """The last micro-batch that a commit covers, -1 if there is none; commits of replaced splits count too."""
    fs, where = store._fs(spark, f"{index_path}/_commits")
    if not fs.exists(where):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return max((store.read_marker(spark, f"{index_path}/_commits/{n}").get("batch", -1) for n in names if n.isdigit()), default=-1)


def _next_split(spark: SparkSession, index_path: str) -> int:
    fs, where = store._fs(spark, f"{index_path}/_commits")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return max((int(n) for n in names if n.isdigit()), default=-1) + 1


def _index_pending(spark: SparkSession, index_path: str, batches: list[int], prefix_bytes: int, prefix_format: str | None, row_group: int) -> None:
    """One split from the batches kept: counts of file blocks are summed, the text is moved once, when it is written."""
    lines = _read(spark, f"{index_path}/_pending", batches)
    keys = ["batch", "name", "block_start"]
    blocks = lines.groupBy(*keys).agg(F.count("*").alias("n"), F.min("seq").alias("__first"))
    before = running_total(blocks, [], keys, "n", "__upto").select(*[F.col(k).alias(f"__{k}") for k in keys], (F.col("__upto") - F.col("n") - F.col("__first")).alias("__shift"))
    on = [lines[k] == before[f"__{k}"] for k in keys]
    target = _next_split(spark, index_path)
    numbered = lines.join(before, on).withColumn("line_no", F.col("seq") + F.col("__shift")).withColumn("split", F.lit(target))
    numbered = numbered.select("split", F.substring("name", STAMP + 2, 1 << 30).alias("file"), "line_no", F.expr(f"line_no div {row_group}").alias("rg"), "log")
    if prefix_bytes and prefix_format:
        numbered = L.stamp_lines(numbered, prefix_bytes, java_pattern(prefix_format))
    else:
        numbered = numbered.withColumn("epoch", F.lit(None).cast("long"))
    size = lines.agg(F.sum(F.octet_length("log") + 1)).first()[0]
    store.write_split(numbered, index_path, row_group, splits=[target], batch=batches[-1], bytes=int(size))


def _compact(spark: SparkSession, index_path: str, interval: int, row_group: int) -> None:
    """Merge the splits of batches (those whose commit has a size) once they hold ``interval`` bytes."""
    fresh = {n: c["bytes"] for n, c in store.commits(spark, index_path).items() if "bytes" in c}
    if len(fresh) > 1 and sum(fresh.values()) >= interval:
        store.compact_splits(spark, index_path, list(fresh), index_path, _next_split(spark, index_path), row_group)


def _sweep(spark: SparkSession, index_path: str, inbox: str, number: int) -> None:
    """Drop batches that a commit covers, with their files of the inbox; the stream has committed every batch before ``number``."""
    pending, upto = f"{index_path}/_pending", indexed_upto(spark, index_path)
    covered = [n for n in _batches(spark, pending) if n <= upto and n < number]
    if not covered:
        return
    for row in _read(spark, pending, covered).select("name").distinct().toLocalIterator():
        store.remove(spark, f"{inbox}/{row['name']}")
    for n in covered:
        store.remove(spark, f"{pending}/batch={n}")


def take_batch(batch: DataFrame, number: int, inbox: str, index_path: str, index_bytes: int, compaction_bytes: int, prefix_bytes: int, prefix_format: str | None, row_group: int) -> None:
    """Keep one micro-batch, index what is kept once it is enough, compact, sweep. Running it again for a number changes nothing."""
    spark, pending = batch.sparkSession, f"{index_path}/_pending"
    upto = indexed_upto(spark, index_path)
    if number > upto:
        # blank lines are gone before lines are numbered, so the numbers of a file block follow on each other
        rows = batch.where("log <> ''").withColumn("seq", F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{pending}/batch={number}")
        batches = [n for n in _batches(spark, pending) if n > upto]
        held = _read(spark, pending, batches).agg(F.sum(F.octet_length("log") + 1)).first()[0] or 0
        if held >= index_bytes:
            _index_pending(spark, index_path, batches, prefix_bytes, prefix_format, row_group)
    _compact(spark, index_path, compaction_bytes, row_group)
    _sweep(spark, index_path, inbox, number)


def start_tail(
    spark: SparkSession,
    inbox: str,
    index_path: str,
    index_bytes: int,
    prefix_bytes: int = 0,
    prefix_format: str | None = None,
    interval: str = "10 seconds",
    row_group: int = L.ROW_GROUP,
    once: bool = False,
    compaction_bytes: int = 20_480 << 20,
) -> StreamingQuery:
    """Start the stream; ``once`` handles what is there and stops."""
    stream = spark.readStream.option("lineSep", "\n").text(inbox).select(L.plain_name().alias("name"), F.col("_metadata.file_block_start").alias("block_start"), F.col("value").alias("log"))

    def keep(batch: DataFrame, number: int) -> None:
        take_batch(batch, number, inbox, index_path, index_bytes, compaction_bytes, prefix_bytes, prefix_format, row_group)

    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{index_path}/_stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
