"""Per-document text statistics, their exact ranks per language, and outlier scores from tail probabilities.

Statistics are computed over whole texts. Ranks come from one range sort of the distinct (language, statistic, value) triples with their counts:
partitions are scanned on their own and shifted by the counts of all partitions before. A rank gives the empirical probability of a value at least or at most
as extreme; the sum of their logarithms over the statistics is the outlier score. A document is a candidate for a kind if its tail for that kind is at most TAIL, in
its language or in the whole collection; of the candidates the exact share of characters decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_total
from ..session import cut, salted_lookup, spread
from . import blocks

STATS = ("n_words", "mean_word_length", "symbol_ratio", "end_punct_share", "common_word_share", "list_share", "table_share", "junk_share")
KINDS = ("list", "table", "junk")
#: A candidate's share of a kind is at least the median of its language or of the collection, so only where more than half of both have as much of a kind is one passed over.
TAIL = 0.5
#: The language under which the whole collection is ranked.
ALL = "*"
#: Shares and ratios are kept to this many decimals, so that equal values meet in one rank.
DIGITS = 4

RUN = re.compile(r"\S+", re.ASCII)
SYMBOL = re.compile(r"[^\w\s]")
ENDS = (".", "!", "?", "…", "。", "！", "？", '."', '!"', '?"', ".)")


def stats_of(text: str | None) -> tuple:
    """The statistics of STATS. An empty or null text has 0 in all of them.

    Words are stretches without ASCII blanks; a common word is a function word of any of the four languages; symbols are characters that
    are neither letters, digits, underscores nor blanks; lines are those that hold more than blanks; shares of kinds are of all characters.
    """
    if not text:
        return (0, *[0.0] * (len(STATS) - 1))
    runs = RUN.findall(text)
    n_words, filled = len(runs), sum(map(len, runs))
    words = blocks.WORDS.findall(text.lower())
    lines = [x for x in map(str.rstrip, text.split("\n")) if x]
    kinds = blocks.kinds_of(text)
    size = len(text)
    return (
        n_words,
        round(filled / n_words, DIGITS) if n_words else 0.0,
        round(len(SYMBOL.findall(text)) / size, DIGITS),
        round(sum(x.endswith(ENDS) for x in lines) / len(lines), DIGITS) if lines else 0.0,
        round(blocks.function_words(words) / len(words), DIGITS) if words else 0.0,
        *[kinds[k] / size for k in KINDS],
    )


def document_stats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, *STATS): one row for each row with an id. The language is trimmed and in lower case, "" if null."""
    schema = "doc_id long, lang string, n_words double, " + ", ".join(f"{s} double" for s in STATS[1:])
    arrow = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *[(s, pa.float64()) for s in STATS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [stats_of(x) for x in batch.column(2).to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * len(STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.float64()) for c in cols]], schema=arrow)

    rows = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long"), F.coalesce(F.lower(F.trim(F.col(lang))), F.lit("")), F.col(text))
    return spread(rows).mapInArrow(run, schema)


def tail_ranks(values: DataFrame) -> DataFrame:
    """(lang, stat, value, below, upto, total) for each distinct value: rows of the language with a lesser value, with one at most as great, and all."""
    counts = values.groupBy("lang", "stat", "value").agg(F.count("*").alias("n"))
    ranked = running_total(counts, ["lang", "stat"], ["value"], "n", "upto").select("lang", "stat", "value", (F.col("upto") - F.col("n")).alias("below"), "upto")
    totals = counts.groupBy("lang", "stat").agg(F.sum("n").alias("total"))  # one row a language and statistic
    return salted_lookup(ranked, totals, ["lang", "stat"], F.col("value"))


def outlier_scores(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, *STATS, score, tail_list, tail_table, tail_junk, all_list, all_table, all_junk), one row a document id.

    score is the sum over all statistics of -ln(min(1, 2 * the smaller tail)); a tail counts the document itself and its ties, so it is never 0. tail_k is the share of documents of
    the language, all_k that of all documents, with at least this share of kind k. Null and empty texts have zero statistics and are ranked like others; a null language is the language "".
    """
    base = cut(document_stats(documents, doc_id, text, lang))
    # Ranks of the shares of kinds are taken on rounded values, the shares themselves stay exact.
    entry = lambda lang, i, c: F.struct(lang.alias("lang"), F.lit(i).cast("tinyint").alias("stat"), F.col(c).alias("exact"))
    shares = [(i, c) for i, c in enumerate(STATS) if c.endswith("_share") and c[: -len("_share")] in KINDS]
    entries = [entry(F.col("lang"), i, c) for i, c in enumerate(STATS)] + [entry(F.lit(ALL), i, c) for i, c in shares]
    long = base.select("doc_id", F.col("lang").alias("own"), F.explode(F.array(*entries)).alias("s")).select("doc_id", "own", "s.*")
    long = long.withColumn("value", F.round("exact", DIGITS))
    ranks = tail_ranks(long.select("lang", "stat", "value"))
    placed = salted_lookup(long, ranks, ["lang", "stat", "value"], F.col("doc_id"))
    left, right = F.col("upto") / F.col("total"), (F.col("total") - F.col("below")) / F.col("total")
    own = ~(F.col("lang").eqNullSafe(F.lit(ALL)) & (F.col("own") != ALL))
    placed = placed.withColumn("right", right).withColumn("part", F.when(own, -F.log(F.least(F.lit(1.0), 2 * F.least(left, right)))))
    stat = lambda i, c, of: F.max(F.when((F.col("stat") == i) & of, F.col(c)))
    return placed.groupBy("doc_id", F.col("own").alias("lang")).agg(
        *[stat(i, "exact", own).alias(s) for i, s in enumerate(STATS)],
        F.sum("part").alias("score"),
        *[stat(STATS.index(f"{k}_share"), "right", own).alias(f"tail_{k}") for k in KINDS],
        *[stat(STATS.index(f"{k}_share"), "right", F.col("lang") == ALL).alias(f"all_{k}") for k in KINDS],
    )


def word_ranks(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, n_words, below, upto, total): the number of words of each document and its exact rank in its language: documents with less, with at most as many, and all."""
    base = cut(document_stats(documents, doc_id, text, lang).select("doc_id", "lang", F.col("n_words").alias("value"), F.lit(0).cast("tinyint").alias("stat")))
    ranks = tail_ranks(base.select("lang", "stat", "value"))
    return salted_lookup(base, ranks, ["lang", "stat", "value"], F.col("doc_id")).select("doc_id", "lang", F.col("value").cast("long").alias("n_words"), "below", "upto", "total")


def odd_documents(scored: DataFrame, more_than: float = 0.5, tail: float = TAIL) -> DataFrame:
    """(doc_id, kind): documents that are outliers of their language or of the collection by the share of a kind, and more than ``more_than`` of whose characters lie in it."""
    of = lambda k: F.when((F.least(f"tail_{k}", f"all_{k}") <= tail) & (F.col(f"{k}_share") > more_than), F.lit(k))
    return scored.select("doc_id", F.explode(F.array_compact(F.array(*[of(k) for k in KINDS]))).alias("kind"))
