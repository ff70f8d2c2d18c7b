"""Preference formatting with DataFrame functions only.

A pair is two conversations, chosen and rejected, as arrays of (role, text). Their
longest common turn prefix is rendered once as the prompt; what follows is
rendered for either side as a completion, in segments that say whether a loss is taken on them: only what
assistants say counts, role headers and other roles' turns are masked.

Conversations are gathered by id (one conversation is one row, as in the result);
nothing else is grouped, so very common turns or openings cost nothing extra.

Defined results: turns are ordered by (turn, role, text), nulls first; a null role
renders as ``unknown``, a null text as an empty one, and both compare as equal to
themselves; rows that repeat are turns that repeat; a marker inside a text is
broken by a backslash; pairs of equal conversations have empty completions and are not ``usable``, and
so are pairs of which a completion holds no assistant turn. Turns of a null id are left out; a null side is an empty one; turns that tie in all
three order columns are alike. An empty table gives no pairs; other columns are not read. A conversation is one row, so it has to fit a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"
END = "<|end|>\n"


def conversations_as_rows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns array<struct<role,text>>), one row per conversation; turns of a null id are left out."""
    one = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    grouped = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return grouped.select("id", F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))).alias("turns"))


def swapped_reply_pairs(turns: DataFrame, **columns) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation up to its last reply, against the same with the last reply of its neighbour.

    The neighbour of conversation ``c`` is ``c xor 1``, of text ids as of numbers; where it is missing, has no reply, or the id is no number, the
    conversation's own previous reply is taken; conversations without any other reply make no pair.
    """
    rows = conversations_as_rows(turns, **columns)
    replies = F.filter("turns", lambda t: t["role"] == "assistant")
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)))
    rows = rows.withColumns({"last": last, "reply": F.try_element_at(replies, F.lit(-1))["text"], "previous": F.try_element_at(replies, F.lit(-2))["text"]}).where("last is not null")
    kind = rows.schema["id"].dataType
    other = rows.select(F.col("id").try_cast("long").bitwiseXOR(F.lit(1)).cast(kind).alias("id"), F.col("reply").alias("foreign"))
    paired = rows.join(other, "id", "left").withColumn("worse", F.coalesce("foreign", "previous")).where("worse is not null")
    head = F.slice("turns", F.lit(1), F.col("last") - 1)
    reply = lambda text: F.array(F.struct(F.lit("assistant").alias("role"), F.col(text).alias("text")))
    return paired.select(F.col("id").alias("pair_id"), F.concat(head, reply("reply")).alias("chosen"), F.concat(head, reply("worse")).alias("rejected"))


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit("<\\|"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(turn["role"]), F.lit(CLOSE + "\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _safe(t["text"]), F.lit(END))), "")


def _segments(turns: Column) -> Column:
    """array<struct<text, loss>>: header and body of each turn; a loss on an assistant's body only."""
    two = F.transform(
        turns,
        lambda t: F.array(
            F.struct(_header(t).alias("text"), F.lit(False).alias("loss")),
            F.struct(F.concat(_safe(t["text"]), F.lit(END)).alias("text"), (t["role"] == "assistant").alias("loss")),
        ),
    )
    return F.flatten(two)


def format_preferences(pairs: DataFrame, id_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """One row per pair: id, ``n_common`` turns, ``prompt``, ``chosen`` and ``rejected`` as arrays of (text, loss), ``usable``."""
    side = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")), lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = pairs.select(F.col(id_col), side(chosen_col).alias("c"), side(rejected_col).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    differ = F.array_position(F.transform(F.slice("c", F.lit(1), shorter), lambda t, i: t != F.get("r", i)), True)
    rows = rows.withColumn("n_common", F.when(differ > 0, differ - 1).otherwise(shorter).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    rows = rows.select(id_col, "n_common", _rendered(F.slice("c", F.lit(1), F.col("n_common"))).alias("prompt"), _segments(rest("c")).alias("chosen"), _segments(rest("r")).alias("rejected"))
    speaks = lambda c: F.exists(c, lambda s: s["loss"])
    return rows.withColumn("usable", speaks("chosen") & speaks("rejected"))


def digest(formatted: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Flat columns of formatted pairs: texts joined, and the loss spans of each completion as ``first-last`` code points."""

    def spans(side: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("found"))

        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + F.length(x["text"])
            return F.struct(end.alias("at"), F.when(x["loss"], F.concat(acc["found"], F.array(F.concat_ws("-", acc["at"], end)))).otherwise(acc["found"]).alias("found"))

        return F.array_join(F.aggregate(side, start, step, lambda acc: acc["found"]), ",")

    joined = lambda side: F.array_join(F.transform(side, lambda s: s["text"]), "")
    return formatted.select(
        id_col,
        "n_common",
        "prompt",
        joined("chosen").alias("chosen_text"),
        spans("chosen").alias("chosen_loss"),
        joined("rejected").alias("rejected_text"),
        spans("rejected").alias("rejected_loss"),
        "usable",
    )
