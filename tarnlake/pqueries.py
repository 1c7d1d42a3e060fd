"""Queries of the general data-processing problems, with SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes, instants, logparse, skew
from .session import shared_folder, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """One batch of a new feed over all that has arrived: plan, process, commit, then what the sink holds."""
    feed = changes.RunFeed(spark, shared_folder(spark, f"feed-{uuid.uuid4().hex}"))
    feed.advance(changes.with_arrival(table(spark, sf, "tail_files")), table(spark, sf, "index_runs"))
    return feed.processed().select("run_id", "obs_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return skew.heavy_keys(table(spark, sf, "token_stream"), "token", "rg").select("token")


def p3_token_profile(spark: SparkSession, sf: str) -> DataFrame:
    per = skew.token_profile(table(spark, sf, "token_stream"), table(spark, sf, "postings"))
    q = [F.get("quantiles", F.lit(i)).alias(f"rg_q{p}") for i, p in enumerate((25, 50, 75))]
    return per.select("token", "n_rows", "n_rgs", *q)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    log, chunk = table(spark, sf, "log_lines"), table(spark, sf, "chunk_lines")
    layouts = logparse.layouts_of((log, "log_vector"), (chunk, "column_0"))
    return logparse.log_entries(log, layouts).unionByName(logparse.single_lines(chunk, layouts))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    found = instants.normalise_instants(table(spark, sf, "line_stamps"), table(spark, sf, "source_files"))
    return found.where("utc_us is not null").select("stamp_id", "utc_us")


def p7_interpretations(spark: SparkSession, sf: str) -> DataFrame:
    """How the values of each source were read: counts by interpretation and ambiguity."""
    found = instants.normalise_instants(table(spark, sf, "line_stamps"), table(spark, sf, "source_files"))
    return found.groupBy("file_id", "interpretation", "likely_as", "ambiguous").agg(F.count("*").alias("n_stamps"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_token_profile, p5_found, p7_found, p7_interpretations)}

ORACLES = {
    "p1_found": """
        with k as (select index_name, bool_or(content_sum is not null) has_sum from tail_files group by 1),
        o as (select distinct t.obs_id, t.index_name, t.last_file, t.seen_at,
                case when has_sum then content_sum else concat_ws('/', epoch_us(last_file_time), size_bytes) end version
              from tail_files t join k on t.index_name is not distinct from k.index_name),
        r as (select distinct run_id, index_name, started_at from index_runs where run_status = 'ok' and started_at is not null),
        j as (select r.run_id, r.index_name, r.started_at, o.last_file, arg_max(o.obs_id, (o.seen_at, o.obs_id)) obs_id, arg_max(o.version, (o.seen_at, o.obs_id)) version
              from r join o on r.index_name is not distinct from o.index_name and o.seen_at <= r.started_at where o.version is not null group by all),
        p as (select *, lag(version) over (partition by index_name, last_file order by started_at, run_id) prev from j)
        select run_id, obs_id from p where prev is null or prev <> version""",
    "p3_found": """
        select token from token_stream where token <> '' group by token
        having count(*) >= 0.02 * (select count(*) from token_stream)""",
    "p3_token_profile": """
        with s as (select token, count(*) n_rows, quantile_disc(rg, [0.25, 0.5, 0.75]) q from token_stream group by 1),
        e as (select token, unnest(inverted_index) m from postings),
        p as (select token, count(distinct m) n from e group by 1),
        u as (select token from token_stream union select token from postings)
        select u.token, coalesce(s.n_rows, 0) n_rows, coalesce(p.n, 0) n_rgs, q[1] rg_q25, q[2] rg_q50, q[3] rg_q75
        from u left join s on u.token is not distinct from s.token left join p on u.token is not distinct from p.token""",
}
