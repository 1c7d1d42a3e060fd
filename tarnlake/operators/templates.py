"""Event templates of lines by masking variables, their variables, and both indexes to row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.charclass import type_mask

WILD = "<*>"


def masked(log: Column) -> Column:
    """The line with every blank-separated word that holds a digit replaced by <*>."""
    return F.array_join(F.transform(F.split(log, " "), lambda w: F.when(w.rlike("[0-9]"), WILD).otherwise(w)), " ")


def mine_templates(lines: DataFrame, log: str, min_support: int = 1) -> DataFrame:
    """(template_id, template, n_lines): masked texts with at least ``min_support`` lines; the id is a hash of the text, the same in every run."""
    counts = lines.where(F.col(log).isNotNull()).groupBy(masked(F.col(log)).alias("template")).agg(F.count("*").alias("n_lines"))
    return counts.where(F.col("n_lines") >= min_support).select(F.xxhash64("template").alias("template_id"), "template", "n_lines")


def assign_templates(lines: DataFrame, log: str, templates: DataFrame) -> DataFrame:
    """Lines with their template, null where none fits. Repeated lines of one template stay on their side of the join: AQE splits hot templates."""
    t = templates.select(F.col("template").alias("__t"), "template_id")
    tagged = lines.withColumn("template", masked(F.col(log)))
    return tagged.join(t, tagged["template"] == t["__t"], "left").withColumn("template", F.col("__t")).drop("__t")


def extract_variables(lines: DataFrame, log: str, keys: list[str]) -> DataFrame:
    """(keys.., var, value, type): the words of a line that hold a digit, numbered from 0."""
    words = F.filter(F.split(log, " "), lambda w: w.rlike("[0-9]"))
    return lines.select(*keys, F.posexplode(words).alias("var", "value")).withColumn("type", type_mask(F.col("value")))


def variable_index(variables: DataFrame, rg: str = "rg") -> DataFrame:
    """(type, token, row_groups) of the variables."""
    pairs = variables.where("type > 0").select("type", F.col("value").alias("token"), F.col(rg).alias("rg")).distinct()
    return pairs.groupBy("type", "token").agg(F.array_sort(F.collect_list("rg")).alias("row_groups"))


def template_postings(assigned: DataFrame, rg: str = "rg") -> DataFrame:
    """(template, row_groups) of the templates that have lines; templates without any do not appear."""
    pairs = assigned.where("template is not null").select("template", F.col(rg).alias("rg")).distinct()
    return pairs.groupBy("template").agg(F.array_sort(F.collect_list("rg")).alias("row_groups"))


def outlier_lines(assigned: DataFrame) -> DataFrame:
    """Lines without template."""
    return assigned.where("template is null")
