"""Exact per-key results where a handful of keys hold most rows.

Quantiles of a key are found by distributed selection: counts per (key, cell of values) are mergeable and summed map-side; the cell
that holds a wanted rank is split again until the rank resolves to one value. No task sees more of a key than its cell counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, cut, measured_bytes

#: Cells a value range is cut into at each refinement, as a power of two.
FAN_BITS = 10
#: Ways in which a cell's counts are spread when a refinement joins them with the wanted cells.
SALTS = 16


def keyed_quantiles(df: DataFrame, key: str, value: str, probs: list[float], fan_bits: int = FAN_BITS, least_share: float = 0.0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per key (null is a key): ``key``, n_rows, n_values and quantiles, an array of longs in the order of ``probs``.

    Quantile p is the least value v such that at least p * n_values of the key's non-null values are <= v (p=0: the least value). A key without
    values has n_values 0 and null quantiles. An empty table gives no rows. Only keys below ``least_share`` of all rows are left out, and cost no refinement.

    A refinement counts the rows of the wanted cells where they are read, if the list of these cells is small enough to be broadcast; else it counts all sub-cells map-side and
    joins the counts. No row is shuffled as such, so a value that a hot key repeats is one count a task.
    """
    base = df.select(F.col(key).alias("k"), F.col(value).cast("long").alias("v"))
    low, high = base.agg(F.min("v"), F.max("v")).first()
    low, high = (low, high) if low is not None else (0, 0)
    shift = max(0, (high - low).bit_length() - fan_bits)
    offset = F.col("v") - F.lit(low)
    cells = base.groupBy("k", F.shiftright(offset, shift).alias("cell")).agg(F.count("*").alias("n"), F.count("v").alias("nv"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # At most 2^fan_bits + 1 cells a key, whatever its number of rows.
    whole = Window.partitionBy("k")
    upto = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("n_rows", F.sum("n").over(whole)).withColumn("n_values", F.sum("nv").over(whole)).withColumn("cum", F.sum("nv").over(upto))
    ranks = F.array(*[F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n_values"))).cast("long") for p in probs])
    wanted = F.filter(
        F.transform(ranks, lambda r, i: F.struct(i.alias("i"), (r - (F.col("cum") - F.col("nv"))).alias("r"), F.col("cell").alias("cell"), F.col("nv").alias("n"), F.col("lo").alias("lo"), F.col("hi").alias("hi"))),
        lambda s: (s["r"] >= 1) & (s["r"] <= F.col("nv")),
    )
    keys = cells.withColumn("w", wanted).groupBy("k").agg(F.first("n_rows").alias("n_rows"), F.first("n_values").alias("n_values"), F.flatten(F.collect_list(F.when(F.size("w") > 0, F.col("w")))).alias("w"))
    keys = cut(keys)
    if least_share:
        total = keys.agg(F.sum("n_rows")).first()[0] or 0
        keys = keys.where(F.col("n_rows") >= least_share * total)
    done, open_ = None, _unresolved(keys.select("k", F.explode("w").alias("s")).select("k", "s.*"))
    while shift > 0:
        todo = cut(open_)
        if todo.isEmpty():
            break
        nxt = max(0, shift - fan_bits)
        targets = todo.select(F.col("k").alias("tk"), F.col("cell").alias("tc")).distinct()
        rows = base.where("v is not null").select("k", "v", F.shiftright(offset, shift).alias("cell"), F.shiftright(offset, nxt).alias("sub"))
        small = measured_bytes(targets) <= broadcast_bytes
        if small:
            rows = rows.join(F.broadcast(targets), rows["k"].eqNullSafe(targets["tk"]) & (rows["cell"] == targets["tc"]), "left_semi")
        fine = rows.groupBy("k", "cell", "sub").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        if not small:
            fine = fine.withColumn("salt", F.pmod(F.col("sub"), F.lit(SALTS)).cast("int"))
            spread = targets.withColumn("tsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            fine = fine.join(spread, fine["k"].eqNullSafe(spread["tk"]) & (fine["cell"] == spread["tc"]) & (fine["salt"] == spread["tsalt"]), "left_semi").drop("salt")
        cum = Window.partitionBy("k", "cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        fine = fine.withColumn("cum", F.sum("n").over(cum))
        t = todo.select(F.col("k").alias("tk"), F.col("cell").alias("tc"), "i", F.col("r").alias("tr"))
        hit = fine.join(t, fine["k"].eqNullSafe(t["tk"]) & (fine["cell"] == t["tc"]) & (t["tr"] <= fine["cum"]) & (t["tr"] > fine["cum"] - fine["n"]))
        hit = cut(hit.select("k", "i", (F.col("tr") - (F.col("cum") - F.col("n"))).alias("r"), F.col("sub").alias("cell"), "n", "lo", "hi"))
        found = hit.where(_resolved()).select("k", "i", _value().alias("q"))
        done = found if done is None else done.unionByName(found)
        open_, shift = _unresolved(hit), nxt
    first = F.transform("w", lambda s: F.struct(s["i"].alias("i"), F.when(_resolved(s), _value(s)).alias("q")))
    if done is not None:
        late = done.groupBy(F.col("k").alias("lk")).agg(F.collect_list(F.struct("i", "q")).alias("late"))  # at most one entry a probability
        keys = keys.join(late, keys["k"].eqNullSafe(late["lk"]), "left")
        first = F.concat(F.filter(first, lambda s: s["q"].isNotNull()), F.coalesce("late", F.expr("cast(array() as array<struct<i:int,q:bigint>>)")))
    quantiles = F.transform(F.array_sort(first), lambda s: s["q"])
    return keys.select(F.col("k").alias(key), "n_rows", "n_values", F.when(F.col("n_values") > 0, quantiles).alias("quantiles"))


def _resolved(s=None):
    c = (lambda n: s[n]) if s is not None else F.col
    return (c("lo") == c("hi")) | (c("r") == 1) | (c("r") == c("n"))


def _value(s=None):
    c = (lambda n: s[n]) if s is not None else F.col
    return F.when(c("r") == c("n"), c("hi")).otherwise(c("lo"))


def _unresolved(df: DataFrame) -> DataFrame:
    return df.where(~_resolved()).select("k", "i", "r", "cell")


def distinct_members(df: DataFrame, key: str, lists: str) -> DataFrame:
    """(key, n_members): distinct elements of all of a key's array values; null lists and null elements add none.

    Elements are made distinct inside each row, then per (key, element), which spreads a hot key over all tasks.
    """
    pairs = df.select(F.col(key), F.explode_outer(F.array_distinct(F.col(lists))).alias("m")).groupBy(key, "m").agg(F.lit(1).alias("one"))
    return pairs.groupBy(key).agg(F.count("m").alias("n_members"))


def heavy_keys(df: DataFrame, key: str, value: str, share: float = 0.02, probs: list[float] | None = None) -> DataFrame:
    """Keys, neither null nor empty, that hold at least ``share`` of all rows, with the exact results of ``keyed_quantiles``; null and empty keys count in all rows."""
    per = keyed_quantiles(df, key, value, probs or [0.5], least_share=share)
    return per.where(F.col(key).isNotNull() & (F.col(key) != ""))


def token_profile(token_stream: DataFrame, postings: DataFrame, probs: list[float] | None = None) -> DataFrame:
    """Per token (null and empty ones too): n_rows of the stream, n_rgs distinct row groups of its lists, quantiles of rg over its rows.

    A token on one side only has 0 on the other. Repeated rows count in n_rows and change nothing in n_rgs.
    """
    stream = keyed_quantiles(token_stream, "token", "rg", probs or [0.25, 0.5, 0.75])
    lists = distinct_members(postings, "token", "inverted_index").withColumnRenamed("token", "__t")
    both = stream.join(lists, stream["token"].eqNullSafe(lists["__t"]), "full")
    return both.select(F.coalesce("token", "__t").alias("token"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_members", F.lit(0)).alias("n_rgs"), "quantiles")
