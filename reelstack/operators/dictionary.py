"""Normalisation by dictionary: distinct values are normalised once and joined back, so Python sees each value once and keys can be exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelstack.functions import text as tx
from reelstack.operators.tables import BROADCAST_ROWS, cut, small


def dictionary(values: DataFrame, column: str, match: str | None = None, comparison: str | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Each distinct value of a column once, materialised, with its match value (NFKC without white space and format characters) and its comparison text (also case-folded).

    ``aliases`` (form, canonical): comparison texts that stand for another one; a form of several canonical ones takes the least. A null stays null.
    """
    # what repeats is dropped in each task before it is shuffled
    once = tx.normalised(values.select(column).distinct(), column, match, comparison)
    if aliases is not None:
        one = aliases.groupBy("form").agg(F.min("canonical").alias("_canonical"))
        once = once.join(small(one), once[comparison] == one["form"], "left").withColumn(comparison, F.coalesce("_canonical", comparison)).drop("form", "_canonical")
    return cut(once)


def spelt(rows: DataFrame, column: str, match: str | None = None, comparison: str | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Add the match value and/or comparison text of a column by way of its dictionary. Rows are read twice; a frequent value is a row of the broadcast side, or split by adaptive execution."""
    known = dictionary(rows, column, match, comparison, aliases)
    known = known.withColumnRenamed(column, "_value").where("_value is not null")
    n = known.count()
    side = F.broadcast(known) if n <= BROADCAST_ROWS else known
    return rows.join(side, F.col(column) == F.col("_value"), "left").drop("_value")


def normalised_words(rows: DataFrame, keys: list[str], words: str, aliases: DataFrame, stop: list[str], name: str = "normalised") -> DataFrame:
    """(keys, name): sorted distinct words of each row, case-folded, aliases resolved, stop words gone. Rows are told apart by ``keys``; one without words has an empty array."""
    each = rows.select(*keys, F.explode(words).alias("_word"))
    formed = spelt(each, "_word", comparison="_form", aliases=aliases).where(~F.col("_form").isin(stop))
    held = formed.groupBy(*keys).agg(F.array_sort(F.collect_set("_form")).alias(name))
    return rows.select(*keys).distinct().join(held, keys, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def with_synonyms(queries: DataFrame, groups: DataFrame, terms: str = "terms", by: str = "query_id") -> DataFrame:
    """Queries with the other words of their words' synonym groups (group_id, word) behind their terms, each once: for word search only, never for keys.

    A word may be in several groups. Equi-joins on words and groups; added words come in the order of groups and words.
    """
    asked = queries.select(by, F.explode(F.array_distinct(terms)).alias("word"))
    met = asked.join(small(groups), "word").select(by, "group_id").distinct()
    more = met.join(small(groups.withColumnRenamed("word", "_added")), "group_id").groupBy(by).agg(F.array_sort(F.collect_set(F.struct("group_id", "_added"))).alias("_more"))
    added = F.transform(F.coalesce("_more", F.array().cast("array<struct<group_id:string,_added:string>>")), lambda x: x["_added"])
    return queries.join(more.withColumn("_more", F.transform("_more", lambda x: F.struct(x["group_id"].cast("string").alias("group_id"), x["_added"]))), by, "left").withColumn(terms, F.array_union(F.col(terms), added)).drop("_more")
