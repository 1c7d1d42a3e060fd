"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums of tokens, cuts at exact budgets."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_total
from ..session import cut, spread

VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens): tokens of the whole text; a null text has none. The source is trimmed and in lower case; rows without source or id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            n = [len(encode(x)) if x else 0 for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    name = F.lower(F.trim(F.col(source)))
    rows = documents.where(F.col(doc_id).isNotNull() & (name != "")).select(F.col(doc_id).cast("long").alias("doc_id"), name.alias("source"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, source string, n_tokens long")


def plan_mixes(targets: list[dict], totals: dict[str, int], total_tokens: int | None = None) -> list[dict]:
    """Budgets: [{mix_name, source, target_share, want_share, cap, budget, epochs, rest}].

    Weights of a mix are scaled to sum 1 (target_share); negative, null and zero weights take no part. Sources without tokens cannot contribute: the others keep
    their proportions (want_share). The mix is as large as its scarcest source allows, floor(max_repeats) * its tokens at its share, or ``total_tokens`` if that is less.
    A source listed twice in a mix has the sum of its weights and the least of its caps. A null cap is 1.
    """
    mixes: dict[str, dict[str, dict]] = {}
    for t in targets:
        name, source, w = t["mix_name"], (t["source"] or "").strip().lower(), t["target_weight"] or 0.0
        r = t["max_repeats"] if t["max_repeats"] is not None else 1.0
        if not source:
            continue
        entry = mixes.setdefault(name, {}).setdefault(source, {"w": 0.0, "cap": math.inf})
        entry["w"] += max(0.0, w)
        entry["cap"] = min(entry["cap"], math.floor(r))
    out = []
    for name, sources in mixes.items():
        whole = sum(e["w"] for e in sources.values())
        able = {s: e for s, e in sources.items() if e["w"] > 0 and totals.get(s, 0) > 0 and e["cap"] >= 1}
        weight = sum(e["w"] for e in able.values())
        size = min((totals[s] * e["cap"] * weight / e["w"] for s, e in able.items()), default=0.0)
        if total_tokens is not None:
            size = min(size, total_tokens)
        for s, e in sources.items():
            share = e["w"] / weight if s in able else 0.0
            tokens = totals.get(s, 0)
            budget = min(int(size * share), tokens * e["cap"] if s in able else 0)
            epochs = budget // tokens if tokens else 0
            out.append({"mix_name": name, "source": s, "target_share": e["w"] / whole if whole else 0.0, "want_share": share, "cap": int(e["cap"]), "budget": budget, "epochs": epochs, "rest": budget - epochs * tokens})
    return out


PLAN = "mix_name string, source string, target_share double, want_share double, cap int, budget long, epochs long, rest long"


def draw(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, seed: int = 17, total_tokens: int | None = None, **columns) -> tuple[DataFrame, DataFrame]:
    """The records of every mix, (mix_name, doc_id, source, n_tokens, copies), and the plan it was cut by.

    ``targets`` is a control table of a few rows, read on the driver; so are the token totals of the sources it names. Within a source documents stand in the order of a hash of their
    id; those whose middle token lies before the budget's rest get one copy more than the full epochs. Every source misses its budget by at most half a document.
    """
    counted = token_counts(documents, tokenizer or vocabulary_path(), **columns)
    counted = cut(counted.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")))  # the range sort reads its input twice
    summed = running_total(counted, ["source"], ["key", "doc_id"], "n_tokens", "upto").select("doc_id", "source", "n_tokens", "upto")
    wanted = [r.asDict() for r in targets.select("mix_name", "source", "target_weight", "max_repeats").collect()]
    names = sorted({(w["source"] or "").strip().lower() for w in wanted})
    totals = {r["source"]: r["t"] for r in summed.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    plan = documents.sparkSession.createDataFrame([tuple(p.values()) for p in plan_mixes(wanted, totals, total_tokens)], PLAN)
    drawn = summed.join(F.broadcast(plan), "source")  # the plan has one row a mix and source
    extra = (F.col("rest") > 0) & (2 * F.col("upto") - F.col("n_tokens") <= 2 * F.col("rest"))
    drawn = drawn.withColumn("copies", F.col("epochs") + F.when(extra, 1).otherwise(0)).where("copies > 0")
    return drawn.select("mix_name", "doc_id", "source", "n_tokens", "copies"), plan


def shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source: target and actual share of all tokens, tokens, documents and the most copies of one."""
    got = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
    full = plan.join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return full.select("mix_name", "source", "target_share", "want_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("n_docs"), zero("most_copies"), F.col("cap").alias("max_copies"))


def audit(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """(mix_name, source, meets_budget, keeps_cap, no_repeats): whether a source's tokens miss its budget by at most half its largest document, no document is drawn more often than its cap
    allows, and each stands once in the mix; a source without budget must have nothing. All of them hold for every mix ``draw`` gives."""
    got = drawn.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("n_tokens").alias("largest"), F.max("copies").alias("most"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")
    )
    full = plan.join(got, ["mix_name", "source"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    miss = 2 * F.abs(zero("tokens") - F.col("budget"))
    return full.select("mix_name", "source", (miss <= F.greatest(zero("largest"), F.lit(1))).alias("meets_budget"), (zero("most") <= F.greatest(F.col("cap"), F.lit(0))).alias("keeps_cap"), (zero("n") == zero("ids")).alias("no_repeats"))
