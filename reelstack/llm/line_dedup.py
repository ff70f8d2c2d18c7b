"""Dropping lines that many documents share.

1. Explode: every text is split at ``\\n``; a line's key is the line without white space at both ends, A-Z in lower case.
   Keys shorter than ``min_chars`` code points never count. Of a key only a hash of 128 bits goes on.
2. Count distinct documents per hash, pre-aggregated in each task, so that a line of a third of all documents is a row
   a task. With a threshold of two, the least and the greatest id tell as much as a count.
3. Lines whose hash reaches the threshold are dropped in all documents but the one of the smallest id. Both sides of that
   join are shuffled tables of numbers, which adaptive execution splits where a hash is hot.
4. Reassemble: the positions that a text loses are joined with the texts, which move once; the other lines are joined in order.

Defined results: a null or empty text is one empty line; rows that repeat an id are one document, each of which loses its own lines; rows
without an id are one document together, behind all others; a line that one document repeats is found in one document; an empty
table gives no rows. A text's lines are handled as one array, so a very long text costs its length. Only ids and texts are read, so
further columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelstack.llm.shared import cut

MIN_CHARS = 10
MIN_DOCS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, version, at, h1, h2): each line's place and hash; ``version`` tells apart the texts of rows that repeat an id."""
    each = docs.select("id", F.xxhash64("text").alias("version"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    keyed = each.select("id", "version", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("id", "version", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def shared_hashes(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, keeper): hashes found in at least ``min_docs`` documents, and the smallest id that has them."""
    some = F.max(F.col("id").isNull())
    if min_docs == 2:
        found = lines.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.max("id").alias("last"), some.alias("nameless"))
        return found.where("keeper <> last or nameless and keeper is not null").select("h1", "h2", "keeper")
    found = lines.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.count_distinct("id").alias("n"), some.alias("nameless"))
    return found.where(F.col("n") + F.col("nameless").cast("int") >= min_docs).select("h1", "h2", "keeper")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text, n_lines, n_dropped): every row's text without the lines that at least ``min_docs`` documents share; the smallest id keeps them."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = cut(hashed_lines(rows, min_chars))
    # materialised, so that the join's both sides are plain shuffles and a hot hash can be split
    shared = cut(shared_hashes(lines, min_docs))
    lost = lines.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("id", "version").agg(F.collect_set("at").alias("lost")).withColumnRenamed("id", "_id")
    texts = rows.withColumn("_version", F.xxhash64("text"))
    both = texts.join(lost, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_version") == F.col("version")), "left")
    parts = both.select("id", _lines(F.col("text")).alias("lines"), F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    text = F.when(F.size("lost") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return parts.select(F.col("id").alias(id_col), text.alias(text_col), F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"))
