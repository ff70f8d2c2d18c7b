"""Correction rules: flips, re-keying, batch application to query resolutions, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flip(active: DataFrame, retired: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Active rules without the retired ones and with the added ones, each once."""
    return active.join(retired.select(keys).distinct(), keys, "left_anti").unionByName(added).dropDuplicates(keys)


def with_synonyms(normalised: Column, synonyms: Column) -> Column:
    """A normalised query with the synonyms of its words (a map of word to words) behind it, for word search only."""
    return F.array_union(normalised, F.flatten(F.transform(normalised, lambda w: F.coalesce(synonyms[w], F.array().cast("array<string>")))))


def rekeyed(rules: DataFrame, stored: str, verified: Column, recomputed: Column, usable: Column) -> DataFrame:
    """Add ``new_key`` and ``status`` of stored rules whose key is computed anew.

    A stored key must first be what the old rules of normalisation give (``verified``): else it is a ``mismatch`` and keeps its key. Then
    ``skipped`` if unusable, else ``changed`` or ``unchanged``.
    """
    right = verified.eqNullSafe(F.col(stored))
    status = F.when(~right, "mismatch").when(~usable, "skipped").when(recomputed.eqNullSafe(F.col(stored)), "unchanged").otherwise("changed")
    return rules.withColumn("new_key", F.when(right & usable, recomputed)).withColumn("status", status)


#: What a rule may ask of a slot's values, as a predicate of (values, argument).
CONDITIONS = {
    "has_value": lambda values, arg: F.array_contains(values, arg),
    "is_empty": lambda values, arg: F.size(values) == 0,
    "is_not_empty": lambda values, arg: F.size(values) > 0,
    "equals": lambda values, arg: F.array_sort(values) == F.array(arg),
    "has_type": lambda values, arg: F.exists(values, lambda v: F.split_part(v, F.lit(":"), F.lit(1)) == arg),
}


def applied_rules(slots: DataFrame, rules: DataFrame) -> DataFrame:
    """Slots of query resolutions after correction rules, all in one pass of joins.

    ``slots``: query_id, slot, values array<string>, protected; ``rules``: rule_id, query_key (as the slots'), slot, condition, cond_arg,
    operation (set, unset, add, remove), arg, priority. A rule applies if its condition holds on the slot as it
    came; typed values are written ``type:value``. Rules on one slot that cannot both hold are a conflict group: those that set or unset it, and
    those that add or remove the same value. The operation of the rule of highest priority (then lowest id) wins, rules of the group with another
    operation or value are conflicts. Slots that the user filled in are protected. Returns the slots with
    ``applied`` and ``conflicts`` (sorted rule ids).
    """
    joined = slots.join(rules.withColumnRenamed("query_key", "query_id"), ["query_id", "slot"])
    holds = F.lit(False)
    for name, test in CONDITIONS.items():
        holds = holds | ((F.col("condition") == name) & test(F.col("values"), F.col("cond_arg")))
    fired = joined.where(holds & ~F.col("protected")).withColumn("exclusive", F.col("operation").isin("set", "unset"))
    fired = fired.withColumn("claim", F.when(F.col("exclusive"), F.lit("")).otherwise(F.concat(F.lit("v"), "arg")))
    turn = Window.partitionBy("query_id", "slot", "claim").orderBy(F.desc("priority"), "rule_id")
    wins = F.struct("operation", "arg")
    fired = fired.withColumn("loses", wins != F.first(wins).over(turn))
    pick = lambda op: F.array_sort(F.array_compact(F.collect_set(F.when((F.col("operation") == op) & ~F.col("loses"), F.col("arg")))))
    ids = lambda cond: F.array_sort(F.array_compact(F.collect_set(F.when(cond, F.col("rule_id")))))
    per = fired.groupBy("query_id", "slot").agg(
        F.max(F.when(~F.col("loses") & F.col("exclusive"), F.struct("operation", "arg"))).alias("own"),
        pick("add").alias("added"),
        pick("remove").alias("removed"),
        ids(~F.col("loses")).alias("applied"),
        ids(F.col("loses")).alias("conflicts"),
    )
    out = slots.join(per, ["query_id", "slot"], "left")
    none = F.array().cast("array<string>")
    base = F.when(F.col("own.operation") == "set", F.array("own.arg")).when(F.col("own.operation") == "unset", none).otherwise(F.col("values"))
    after = F.array_except(F.array_union(base, F.coalesce("added", none)), F.coalesce("removed", none))
    empty = F.array().cast("array<bigint>")
    return out.select("query_id", "slot", F.array_sort(after).alias("values"), F.coalesce("applied", empty).alias("applied"), F.coalesce("conflicts", empty).alias("conflicts"))


def anchored(text: Column, value: Column, start: Column) -> dict[str, Column]:
    """Where a claimed value really stands in a text: ``kept`` at its claimed place, ``moved`` to the match nearest to it (the first of two), or ``demoted`` if it is nowhere."""
    from reelstack.functions.text import occurrences

    there = F.substring(text, start + 1, F.length(value)) == value
    nearest = F.array_min(F.transform(occurrences(text, value), lambda s: F.struct(F.abs(s - start).alias("away"), s.alias("at"))))["at"]
    status = F.when(there, "kept").when(nearest.isNotNull(), "moved").otherwise("demoted")
    return {"status": status, "start": F.when(there, start).otherwise(nearest)}


def date_anchored(text: Column, start: Column, end_exclusive: Column, field: Column, filmed: list[str]) -> dict[str, Column]:
    """Whether a claimed date text denotes its window: ``kept``, else ``demoted``; a filmed date whose text does not say so becomes a broadcast date."""
    from reelstack.functions.text import period_end, period_start

    day = F.regexp_extract(text, r"\d{4}(?:-\d{2}){0,2}", 0)
    right = F.coalesce((period_start(day) == start) & (period_end(day) == end_exclusive), F.lit(False))
    said = F.exists(F.array(*map(F.lit, filmed)), lambda w: F.contains(F.lower(text), w))
    return {"status": F.when(right, "kept").otherwise("demoted"), "field": F.when((field == "filmed") & ~said, "broadcast").otherwise(field)}
