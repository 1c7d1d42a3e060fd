"""Session helpers: table access, reliable checkpoints, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup side is broadcast only if its measured size is at most this.
BROADCAST_BYTES = 8 << 20
#: Input of one part where rows are dealt out.
SPREAD_BYTES = 32 << 20


def build_session(app: str = "tarnlake", master: str | None = None, partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE with skew splitting)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; where that is unset a local session makes one and a cluster is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix=f"tarnlake-{os.getpid()}-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application under the checkpoint folder, for tables that are written once and read again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deal out rows before costly work on each, if they are read in fewer splits than there are cores: into one part a core, and no part larger than SPREAD_BYTES of input.

    Spark cuts files into as many splits as there are cores, but never inside a Parquet row group; only an input of few row groups is coarser than that. Any other stays where it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // SPREAD_BYTES)))


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values as they lie in memory: 16 a value, and the length of what is written as text."""
    size = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], salt_from, salts: int = 16, how: str = "left") -> DataFrame:
    """Join ``small`` (one row per key) to ``big`` so that a key holding a third of ``big`` is no one task's work.

    Keys match null-safely. ``small`` is evaluated once to measure it: cut it first if it is dear. At BROADCAST_BYTES or less it is broadcast. Beyond that both sides
    are shuffled, ``small`` once for each of ``salts`` and each row of ``big`` to the salt of ``salt_from``, which should tell rows of one key apart.
    """
    right = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    if measured_bytes(right) <= BROADCAST_BYTES:
        return big.join(F.broadcast(right), _same(big, right, keys), how).drop(*[f"__{k}" for k in keys])
    right = right.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn("__salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    on = (left["__salt"] == right["__rsalt"]) & _same(left, right, keys)
    return left.join(right, on, how).drop("__salt", "__rsalt", *[f"__{k}" for k in keys])


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys])
