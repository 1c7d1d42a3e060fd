"""Lines: reading, numbering, row groups, and the units they are cut into (chunks, groups, splits)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.strptime import EPOCH_SECONDS
from ..operators.ordered import carry_forward, running_total

ROW_GROUP = 100_000
ROW_GROUPS_A_FILE = 10
CHUNK_BYTES = 64 << 20


def escape_glob(path: str) -> str:
    """A path as a pattern that matches this path alone."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def plain_name() -> Column:
    """The name of the file a row is read from as it stands in the directory; Spark gives it encoded as part of a URI, where a plus sign is itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, block_start, seq, log) of every non-empty line of text files; names starting with _ or . are skipped, a carriage return stays.

    ``name`` is the plain file name, whatever characters it holds. (file, block_start, seq) is the order of lines; seq grows by one a line within one read of a file block.
    """
    paths = [escape_glob(p) for p in ([path] if isinstance(path, str) else path)]
    raw = spark.read.option("lineSep", "\n").text(paths).where("value <> ''")
    return raw.select(
        F.col("_metadata.file_path").alias("file"), plain_name().alias("name"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("log"),
    )


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, log, idx, n): the non-empty lines of each text with their place in it (pos), their rank among the non-empty (idx) and how many these are (n)."""
    split = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("log")))
    kept = df.select(F.col(key), F.filter(split, lambda x: x["log"] != "").alias("__l"))
    return kept.select(key, F.size("__l").cast("long").alias("n"), F.posexplode("__l").alias("idx", "__x")).select(key, "__x.pos", "__x.log", "idx", "n")


def number_lines(df: DataFrame, key: str, text: str, row_group: int = ROW_GROUP) -> DataFrame:
    """(key, pos, log, line_no, rg): lines of all texts, numbered from 0 in order of (key, pos).

    Only line counts are range-sorted; each text's offset is the prefix sum of the counts before it. ``key`` must be unique and is never null.
    """
    count = F.size(F.filter(F.split(text, "\n", -1), lambda x: x != "")).cast("long")
    counts = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), count.alias("c"))
    offsets = running_total(counts, [], [key], "c", "upto").select(F.col(key).alias("__k"), (F.col("upto") - F.col("c")).alias("__before"))
    lines = text_lines(df, key, text)
    numbered = lines.join(offsets, lines[key] == offsets["__k"])
    line_no = F.col("__before") + F.col("idx")
    return numbered.select(key, "pos", "log", line_no.alias("line_no"), F.expr(f"(__before + idx) div {row_group}").alias("rg"))


def number_file_lines(lines: DataFrame, files: DataFrame, row_group: int = ROW_GROUP) -> DataFrame:
    """Lines of ``read_lines`` as (split, file, line_no, rg, log), numbered from 0 within each split in order of file name, block and sequence.

    ``files`` is (name, split), one row a file. Only the counts of file blocks are sorted and summed; the text itself stays where it is read.
    A line of a file that is not in ``files`` is an error, never a loss.
    """
    blocks = lines.groupBy("name", "block_start").agg(F.count("*").alias("n"), F.min("seq").alias("__first"))
    known = files.select(F.col("name").alias("__n"), F.col("split").cast("int").alias("split"))
    missing = F.raise_error(F.concat(F.lit("no split is planned for the file "), F.col("name"))).cast("int")
    blocks = blocks.join(known, blocks["name"] == known["__n"], "left").withColumn("split", F.coalesce("split", missing)).drop("__n")
    upto = running_total(blocks, ["split"], ["name", "block_start"], "n", "__upto")
    before = upto.select("split", F.col("name").alias("__n"), F.col("block_start").alias("__b"), (F.col("__upto") - F.col("n") - F.col("__first")).alias("__shift"))
    numbered = lines.join(before, (lines["name"] == before["__n"]) & (lines["block_start"] == before["__b"]))
    numbered = numbered.select("split", F.col("name").alias("file"), (F.col("seq") + F.col("__shift")).alias("line_no"), "log")
    return numbered.select("split", "file", "line_no", F.expr(f"line_no div {row_group}").alias("rg"), "log")


def stamp_lines(numbered: DataFrame, prefix: int, pattern: str) -> DataFrame:
    """Add ``epoch`` from the first characters of each line; an invalid time takes the last valid one before it in its file, else 0.

    Only one row a file and row group is chained; the lines are range-partitioned by row group, as they are written, and scanned where they lie.
    """
    raw = numbered.withColumn("__raw", extract_epoch(F.col("log"), prefix, pattern))
    last = raw.groupBy("split", "file", "rg").agg(F.max_by("__raw", F.when(F.col("__raw").isNotNull(), F.col("line_no"))).alias("__last"))
    carry = carry_forward(last, ["split", "file"], ["rg"], "__last", "__held", strict=True)
    carry = carry.select(*[F.col(c).alias(f"__r_{c}") for c in ("split", "file", "rg")], "__held")
    on = (raw["split"] == carry["__r_split"]) & (raw["file"] == carry["__r_file"]) & (raw["rg"] == carry["__r_rg"])
    placed = raw.join(carry, on, "left").repartitionByRange("split", "rg")
    w = Window.partitionBy("split", "rg", "file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epoch = F.coalesce(F.last("__raw", ignorenulls=True).over(w), "__held", F.lit(0))
    return placed.select("split", "file", "line_no", "rg", epoch.alias("epoch"), "log")


def cut_units(sizes: list[tuple[str, int]], limit: int) -> list[tuple[str, int, int]]:
    """(name, size, unit) of a listing in its order: a unit closes once what it holds reaches ``limit``, and the sum starts anew.

    A control step over a listing of files or groups on the driver: where a unit ends depends on where every unit before it ended.
    """
    out, unit, held = [], 0, 0
    for name, size in sizes:
        out.append((name, size, unit))
        held += size
        if held >= limit:
            unit, held = unit + 1, 0
    return out


def assign_chunks(sized: DataFrame, group: list[str], order: list[str], size: str, limit: int, out: str = "chunk") -> DataFrame:
    """Add ``out``: the chunk of each row of a group (a file or an ingest group) in order; a chunk closes once it holds ``limit``, and the sum starts anew.

    Where a chunk ends depends on where the one before it ended, so a group is scanned in one stream; pass sizes without the text. Memory is one batch.
    """
    schema = StructType([*sized.schema.fields, StructField(out, LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, chunk, held = None, 0, 0
        for batch in batches:
            keys = list(zip(*[batch.column(batch.schema.get_field_index(g)).to_pylist() for g in group]))
            found = []
            for key, n in zip(keys, batch.column(batch.schema.get_field_index(size)).to_pylist()):
                if key != before:
                    before, chunk, held = key, 0, 0
                elif held >= limit:
                    chunk, held = chunk + 1, 0
                held += n or 0
                found.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, out])

    return sized.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(scan, schema)


def extract_epoch(log: Column, prefix: int, pattern: str) -> Column:
    """Epoch seconds of the first ``prefix`` characters under a datetime pattern in UTC (or EPOCH_SECONDS); null if they do not parse or lie outside 2000 to 2049."""
    text = F.substring(log, 1, prefix)
    if pattern == EPOCH_SECONDS:
        seconds = F.regexp_extract(text, r"^\s*(\d{1,18})", 1).try_cast("long")
    else:
        seconds = F.unix_seconds(F.try_to_timestamp(text, F.lit(pattern)))
    return F.when((seconds >= 946_684_800) & (seconds < 2_524_608_000), seconds)


def backfill(df: DataFrame, file: str, pos: str, epoch: str, out: str = "epoch") -> DataFrame:
    """An invalid time takes the last valid one before it in its file, else 0."""
    return carry_forward(df, [file], [pos], epoch, out).withColumn(out, F.coalesce(out, F.lit(0)))
