"""The stored index: lines and n-gram lists as Parquet, partitioned by split.

    <index>/lines/split=N/..   gid, file, line_no, rg, epoch, log: sorted by row group, row groups of a fixed number of lines
    <index>/grams/split=N/..   gram, row_groups: sorted by gram; null lists stand for grams in most row groups
    <index>/_commits/N         row counts and row groups of split N, and the splits it replaces

A split exists once its commit is there. It is written last, beside its place, and renamed into it, so readers see a split whole or not at all; what a
failed writer left is removed before its split is written again. A committed split is never written again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens
from . import lines as L

TABLES = ("lines", "grams")
SCHEMAS = {"lines": "gid long, file string, line_no long, rg long, epoch long, log string, split int", "grams": "gram string, row_groups array<int>, split int"}
CODECS = ("zstd", "snappy", "lz4", "gzip", "none")
#: A line's row group over all splits is split * 2^GID_BITS + rg.
GID_BITS = 32


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    if fs.exists(where) and not fs.delete(where, True):
        raise OSError(f"cannot remove {path}")


def list_files(spark: SparkSession, directory: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of the plain files of a directory by name; names starting with _ or . are left out."""
    fs, where = _fs(spark, directory)
    found = [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where) if s.isFile() and s.getPath().getName()[0] not in "_."]
    return sorted(found, key=lambda x: name_of(x[0]))


def name_of(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def plan_files(files: list[tuple[str, int, int]], index_bytes: int, compaction_bytes: int) -> list[tuple[str, int, int]]:
    """(path, group, split): a group closes once it holds ``index_bytes``, a split once its groups hold ``compaction_bytes``, only at a group's end."""
    grouped = L.cut_units([(path, size) for path, size, *_ in files], index_bytes)
    held: dict[int, int] = {}
    for _, size, group in grouped:
        held[group] = held.get(group, 0) + size
    split = {int(g): s for g, _, s in L.cut_units([(str(g), n) for g, n in held.items()], compaction_bytes)}
    return [(path, group, split[group]) for path, _, group in grouped]


def write_marker(spark: SparkSession, path: str, content: dict) -> None:
    """A small file that is there whole or not at all; an existing one is an error."""
    fs, target = _fs(spark, path)
    temp = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_tmp-{target.getName()}")
    stream = fs.create(temp, True)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    if fs.exists(target) or not fs.rename(temp, target):
        raise FileExistsError(f"{path} exists or cannot be written")


def read_marker(spark: SparkSession, path: str) -> dict:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commits(spark: SparkSession, index_path: str) -> dict[int, dict]:
    """Commit of every split that counts, newest split first; a split replaced by a committed one does not."""
    fs, where = _fs(spark, f"{index_path}/_commits")
    if not fs.exists(where):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    found = {int(n): read_marker(spark, f"{index_path}/_commits/{n}") for n in names if n.isdigit()}
    replaced = {r for c in found.values() for r in c.get("replaces", [])}
    return {n: found[n] for n in sorted(found, reverse=True) if n not in replaced}


def splits_of(spark: SparkSession, index_path: str) -> list[int]:
    """Committed splits of an index, newest first."""
    return list(commits(spark, index_path))


def read_table(spark: SparkSession, index_path: str, name: str) -> DataFrame:
    """A table of the index over all splits that were ever written: filter by split."""
    if not exists(spark, f"{index_path}/{name}"):
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(f"{index_path}/{name}")


def committed(spark: SparkSession, index_path: str, name: str) -> DataFrame:
    return read_table(spark, index_path, name).where(F.col("split").isin(splits_of(spark, index_path)))


def gid() -> Column:
    return F.shiftleft(F.col("split").cast("long"), GID_BITS) + F.col("rg")


def ingest_group(spark: SparkSession, files: list[tuple[str, int, int]], prefix_bytes: int = 0, prefix_pattern: str | None = None, row_group: int = L.ROW_GROUP) -> DataFrame:
    """Numbered lines (split, file, line_no, rg, epoch, log) of the planned files (of one directory); line numbers run on within a split."""
    plan = spark.createDataFrame([(name_of(p), s) for p, _, s in files], "name string, split int")
    numbered = L.number_file_lines(L.read_lines(spark, [p for p, _, _ in files]), plan, row_group)
    if prefix_bytes and prefix_pattern:
        return L.stamp_lines(numbered, prefix_bytes, prefix_pattern)
    return numbered.select("split", "file", "line_no", "rg", F.lit(None).cast("long").alias("epoch"), "log")


def _begin(spark: SparkSession, index_path: str, splits: list[int]) -> None:
    """Refuse splits that are committed and remove what a failed writer left of the others."""
    done = [n for n in splits if exists(spark, f"{index_path}/_commits/{n}")]
    if done:
        raise FileExistsError(f"splits {done} of {index_path} exist")
    for n in splits:
        for t in TABLES:
            remove(spark, f"{index_path}/{t}/split={n}")


def _write_lines(lines: DataFrame, index_path: str, row_group: int, codec: str) -> None:
    rows = lines.withColumn("gid", gid()).select("split", "gid", "file", "line_no", "rg", "epoch", "log")
    (
        rows.repartitionByRange("split", "rg").sortWithinPartitions("split", "rg", "line_no").write.mode("append").option("compression", codec)
        .option("parquet.block.row.count.limit", row_group).option("maxRecordsPerFile", row_group * L.ROW_GROUPS_A_FILE).partitionBy("split").parquet(f"{index_path}/lines")
    )


def _write_grams(grams: DataFrame, index_path: str, codec: str) -> None:
    rows = grams.select("split", "gram", F.col("row_groups").cast("array<int>").alias("row_groups")).repartitionByRange("split", "gram").sortWithinPartitions("split", "gram")
    # Sorted grams share their beginnings: delta encoding keeps only what differs.
    (
        rows.write.mode("append").option("compression", codec).option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#gram", "false")
        .option("parquet.block.size", 16 << 20).partitionBy("split").parquet(f"{index_path}/grams")
    )


def _commit(spark: SparkSession, index_path: str, splits: list[int], note: dict) -> None:
    def sizes(name: str, n_rgs) -> dict:
        per = read_table(spark, index_path, name).where(F.col("split").isin(splits)).groupBy("split").agg(F.count("*").alias("n"), n_rgs.alias("g"))
        return {r["split"]: (r["n"], r["g"]) for r in per.collect()}  # one row a split

    lines, grams = sizes("lines", F.count_distinct("rg")), sizes("grams", F.lit(0))
    for n in splits:
        write_marker(spark, f"{index_path}/_commits/{n}", {"lines": lines.get(n, (0, 0))[0], "row_groups": lines.get(n, (0, 0))[1], "grams": grams.get(n, (0, 0))[0], **note})


def write_split(numbered: DataFrame, index_path: str, row_group: int = L.ROW_GROUP, codec: str = "zstd", splits: list[int] | None = None, **note) -> None:
    """Write and commit one or more splits of lines (split, file, line_no, rg, epoch, log).

    The text is moved once, to its row groups; the index is built from the lines as written. ``splits`` names the splits where they are known; those without a line are committed as empty.
    """
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}")
    spark = numbered.sparkSession
    splits = splits if splits is not None else sorted(r[0] for r in numbered.select("split").distinct().collect())  # one row a split
    _begin(spark, index_path, splits)
    _write_lines(numbered, index_path, row_group, codec)
    written = read_table(spark, index_path, "lines").where(F.col("split").isin(splits))
    _write_grams(tokens.gram_index(written, ["split"]), index_path, codec)
    _commit(spark, index_path, splits, note)


def compact_splits(spark: SparkSession, index_path: str, splits: list[int], into: str, target: int, row_group: int = L.ROW_GROUP, codec: str = "zstd") -> None:
    """Rewrite several splits as split ``target`` of the same or another index: row groups and lines are numbered on, gram lists are shifted and merged.

    Row groups stay as they are, so no text is tokenised again. A gram without list in one of the splits has none in the target: it rules out less, never too much.
    In the same index the target replaces the splits in the moment it is committed; their files are removed afterwards.
    """
    known = commits(spark, index_path)
    order = sorted(splits)
    lost = [n for n in order if n not in known]
    if lost:
        raise FileNotFoundError(f"no splits {lost} in {index_path}")
    shift, line_shift, rgs, n_lines = {}, {}, 0, 0
    per = read_table(spark, index_path, "lines").where(F.col("split").isin(order)).groupBy("split")
    ends = {r["split"]: r for r in per.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("rg", "line_no")]).collect()}  # one row a split
    for n in order:
        e = ends.get(n)
        if e is None:
            shift[n] = line_shift[n] = 0
            continue
        shift[n], line_shift[n] = rgs - e["min_rg"], n_lines - e["min_line_no"]
        rgs, n_lines = rgs + e["max_rg"] - e["min_rg"] + 1, n_lines + e["max_line_no"] - e["min_line_no"] + 1
    by = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("split")].cast("long")
    _begin(spark, into, [target])
    lines = read_table(spark, index_path, "lines").where(F.col("split").isin(order))
    lines = lines.withColumn("rg", F.col("rg") + by(shift)).withColumn("line_no", F.col("line_no") + by(line_shift)).withColumn("split", F.lit(target))
    _write_lines(lines, into, row_group, codec)
    grams = read_table(spark, index_path, "grams").where(F.col("split").isin(order)).withColumn("at", by(shift).cast("int"))
    moved = F.transform("row_groups", lambda x: x + F.col("at"))
    merged = grams.groupBy("gram").agg(F.max(F.col("row_groups").isNull()).alias("common"), F.flatten(F.array_sort(F.collect_list(moved))).alias("all"))
    merged = merged.select(F.lit(target).alias("split"), "gram", F.when(~F.col("common"), F.col("all")).alias("row_groups"))
    _write_grams(merged, into, codec)
    same = into.rstrip("/") == index_path.rstrip("/")
    _commit(spark, into, [target], {"replaces": order} if same else {})
    if same:
        for n in order:
            for t in TABLES:
                remove(spark, f"{index_path}/{t}/split={n}")
