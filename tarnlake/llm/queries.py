"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logparse
from ..session import table
from . import leakage, mixing, quality, runs, termfreq, topk
from .oracles import ORACLES  # noqa: F401


def _chunk_runs(spark: SparkSession, sf: str) -> DataFrame:
    chunk = table(spark, sf, "chunk_lines")
    parser = logparse.Parser(logparse.layouts_of((chunk, "column_0")))

    def message(line: str) -> str | None:
        found = parser.parse(line)
        return runs.normal_message(found[3] if found else logparse.clean(line))

    return runs.event_runs(chunk, "chunk_id", "line_pos", "line_id", "chunk_eids", "column_0", "ts", message)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.coalesce(F.floor((F.col("t1") - F.col("t0")) / 1000), F.lit(0)).cast("long")
    return _chunk_runs(spark, sf).where("n_events >= 2").select("chunk_id", F.col("first_id").alias("first_line_id"), "n_events", ms.alias("duration_ms"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_values(table(spark, sf, "token_stream"), "token", 40).select(F.col("value").alias("token"))


def p4_top_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_values(table(spark, sf, "token_stream"), "token", 40).select(F.col("value").alias("token"), "n")


def _frequencies(spark: SparkSession, sf: str) -> DataFrame:
    stream, postings = table(spark, sf, "token_stream"), table(spark, sf, "postings")
    return termfreq.term_frequencies(stream.select("token", "line_id", "tok_pos"), postings.select("token", "inverted_index"))


def p6_term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return _frequencies(spark, sf).select(F.col("term").alias("token"), "occurrences", F.col("n_records").alias("n_lines"), F.col("n_groups").alias("n_rgs"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    n = termfreq.count_groups(table(spark, sf, "postings"), "inverted_index")
    return termfreq.marked(_frequencies(spark, sf), n).where("mark is not null and term <> ''").select(F.col("term").alias("token"), "mark")


def _passages(spark: SparkSession, sf: str, **options) -> DataFrame:
    return leakage.passages(table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "text", "item_id", "question", **options)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _passages(spark, sf).select("doc_id", "item_id").distinct()


def p8_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Also passages with substituted words: at least 12 equal of 18 consecutive words."""
    return _passages(spark, sf, min_matched=leakage.MIN_WORDS)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.draw(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*mixing.draw(table(spark, sf, "documents"), table(spark, sf, "mix_targets")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.odd_documents(quality.outlier_scores(table(spark, sf, "documents")))


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.outlier_scores(table(spark, sf, "documents"))


def p10_word_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return quality.word_ranks(table(spark, sf, "documents"))


def p9_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each source of each mix meets its budget within half a document, keeps its cap and has the share that was reported."""
    drawn, plan = mixing.draw(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    return mixing.audit(drawn, plan)


QUERIES = {
    f.__name__: f
    for f in (p2_found, p4_found, p4_top_tokens, p6_found, p6_term_frequencies, p8_found, p8_overlaps, p9_mix, p9_shares, p9_budgets, p10_found, p10_statistics, p10_word_ranks)
}
