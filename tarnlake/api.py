"""The public calls: index a directory of logs, search an index, compact splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.strptime import java_pattern
from .operators import search as S
from .session import cut
from .sources import lines as L
from .sources import store

MB = 1 << 20
RESULT = "split int, file string, line_no long, rg long, epoch long, log string"
COLUMNS = [f.split()[0] for f in RESULT.split(", ")]
#: Splits that are written and committed together.
SPLITS_A_JOB = 64
#: The next wave of splits that a search reads is this many times the last.
WAVE = 4


def index_logs(
    spark: SparkSession,
    directory: str,
    index_name: str,
    index_interval: int = 1024,
    compaction_interval: int = 20_480,
    prefix_bytes: int = 0,
    prefix_format: str | None = None,
    row_group: int = L.ROW_GROUP,
    codec: str = "zstd",
    overwrite: bool = False,
    resume: bool = False,
    splits_a_job: int = SPLITS_A_JOB,
) -> int:
    """Index all files of a directory; intervals are in MB. Returns the number of splits.

    An existing index is refused unless ``overwrite`` or ``resume``; the latter writes only the splits that a broken run did not commit, if the directory is still as it
    was. Splits are written and committed ``splits_a_job`` at a time.
    """
    if store.exists(spark, index_name) and not resume:
        if not overwrite:
            raise FileExistsError(f"{index_name} exists")
        store.remove(spark, index_name)
    planned = store.plan_files(store.list_files(spark, directory), index_interval * MB, compaction_interval * MB)
    if not planned:
        return 0
    n = planned[-1][2] + 1
    done = set(store.splits_of(spark, index_name))
    todo = [s for s in range(n) if s not in done]
    pattern = java_pattern(prefix_format) if prefix_format else None
    for i in range(0, len(todo), splits_a_job):
        part = todo[i : i + splits_a_job]
        numbered = store.ingest_group(spark, [f for f in planned if f[2] in set(part)], prefix_bytes, pattern, row_group)
        store.write_split(numbered, index_name, row_group, codec, splits=part)
    return n


def search(spark: SparkSession, index_path: str, query: str, limit: int, mode: str = "literal", distinct: bool = False) -> DataFrame:
    """At most ``limit`` lines that hold the query, newest split first, then by line number.

    Splits are read in waves, each WAVE times as many as the last, until there are enough lines; a wave is one job over the index and one over the lines of all its splits.
    With ``distinct`` a line counts once over all splits read and comes from the newest split that holds it.
    The index only leaves out row groups that hold none. An index without answer, or none at all, gives an empty frame.
    """
    known = store.commits(spark, index_path)
    order, held, size = list(known), None, 1
    while order:
        wave, order = order[:size], order[size:]
        size *= WAVE
        found = S.search_index(spark, index_path, query, mode, {n: known[n] for n in wave}).select(*COLUMNS)
        if distinct:
            newest = F.min_by(F.struct(*[c for c in COLUMNS if c != "log"]), F.struct(-F.col("split"), "line_no"))
            found = found.groupBy("log").agg(newest.alias("r")).select("r.*", "log").select(*COLUMNS)
            if held is not None:
                found = found.join(held.select("log"), "log", "left_anti").select(*COLUMNS)
        whole = found if held is None else held.unionByName(found)
        whole = whole.orderBy(F.desc("split"), "line_no").limit(limit)
        if not order:
            return whole
        held = cut(whole)  # at most ``limit`` lines, so no newer split is read again
        if held.count() >= limit:
            return held.orderBy(F.desc("split"), "line_no")
    return spark.createDataFrame([], RESULT)


def explain_search(spark: SparkSession, index_path: str, query: str, mode: str = "literal") -> list[tuple[int, int, int]]:
    """(split, row groups, row groups that are candidates): how far the index narrows a query."""
    return [(p.split, p.row_groups, p.n_kept) for p in S.prune(spark, index_path, store.commits(spark, index_path), query, mode)]


def compact_split(spark: SparkSession, index_path: str, splits: list[int], into: str, target: int = 0, row_group: int = L.ROW_GROUP) -> None:
    store.compact_splits(spark, index_path, splits, into, target, row_group)
