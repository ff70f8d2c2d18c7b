"""Subtitle files (SRT, WebVTT) as rows of cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIMING = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})"


def milliseconds(stamp: Column) -> Column:
    """``[hh:]mm:ss,mmm`` as ms."""
    part = lambda n: F.coalesce(F.regexp_extract(stamp, r"^(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})$", n).try_cast("long"), F.lit(0))
    fraction = F.rpad(F.regexp_extract(stamp, r"[.,](\d{1,3})$", 1), 3, "0").try_cast("long")
    return part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + F.coalesce(fraction, F.lit(0))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the subtitle files under a path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def cue_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, rejects) of subtitle files of any kind (path, content), told apart by their content: JSON lists of cues, else SRT or WebVTT."""
    is_json = F.ltrim("content").startswith("[")
    text, text_bad = parse_cues(files.where(~F.coalesce(is_json, F.lit(False))))
    listed, listed_bad = parse_json_cues(files.where(is_json))
    return text.unionByName(listed), text_bad.unionByName(listed_bad)


def parse_json_cues(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``parse_cues``, of JSON lists of objects with ``start`` and ``end`` in ms and ``text``."""
    read = files.withColumn("cues", F.from_json("content", "array<struct<start:long,end:long,text:string>>"))
    each = read.select("path", F.explode("cues").alias("c")).select("path", "c.*")
    whole = F.coalesce(F.col("start") < F.col("end"), F.lit(False)) & F.col("text").isNotNull()
    wrong = each.where(~whole).select("path", F.lit("bad_interval").alias("reason")).distinct()
    none = read.where(F.coalesce(F.size("cues") <= 0, F.lit(True))).select("path", F.lit("no_cue").alias("reason"))
    order = Window.partitionBy("path").orderBy("start", "end", "text")
    good = each.join(wrong, "path", "left_anti").withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''")
    return good.withColumn("cue_no", F.row_number().over(order) - 1).select("path", "start", "end", "text", "cue_no"), wrong.unionByName(none)


def parse_cues(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, rejects) of files (path, content): cues (path, cue_no, start, end, text) by time, rejects (path, reason).

    A file without any cue, or with a cue that ends before it starts, is rejected whole.
    """
    plain = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "^\\x{FEFF}", "")
    blocks = files.select("path", F.explode_outer(F.split(plain, r"\n[ \t]*\n+")).alias("block"))
    timed = blocks.withColumns({"from": F.regexp_extract("block", TIMING, 1), "to": F.regexp_extract("block", TIMING, 2)})
    body = F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", ""), r"\s*\n\s*", " "))
    cues = timed.where(F.col("from") != "").select("path", milliseconds(F.col("from")).alias("start"), milliseconds(F.col("to")).alias("end"), text.alias("text"))
    wrong = cues.where("start >= end").select("path", F.lit("bad_interval").alias("reason")).distinct()
    none = files.select("path").distinct().join(cues.select("path").distinct(), "path", "left_anti").select("path", F.lit("no_cue").alias("reason"))
    order = Window.partitionBy("path").orderBy("start", "end", "text")
    good = cues.join(wrong, "path", "left_anti").where("text <> ''").withColumn("cue_no", F.row_number().over(order) - 1)
    return good.select("path", "start", "end", "text", "cue_no"), wrong.unionByName(none)
