"""Sinks: search logs, patches and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstack.functions.text import tokens


def append_log(rows: DataFrame, path: str, day_col: str = "created_at") -> None:
    """Append rows to a Parquet log, partitioned by day."""
    rows.withColumn("day", F.to_date(day_col)).write.mode("append").partitionBy("day").parquet(path)


def write_searches(searches: DataFrame, results: DataFrame, path: str, batch: str) -> None:
    """Searches (search_id, created_at, ...) and their ranked results (search_id, scene_id, rank, ...) of one batch, under ``path``.

    Results belong to a search of the batch: others are left out. Both are partitioned by batch, and a rerun replaces its batch, so nothing is doubled.
    """
    own = results.join(searches.select("search_id").distinct(), "search_id", "left_semi")
    for name, rows in (("searches", searches), ("results", own)):
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")


def write_patch(rows: DataFrame, path: str, batch_rows: int = 5000) -> None:
    """Changed rows as CSV files of at most ``batch_rows`` rows."""
    rows.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", batch_rows).csv(path)


def retokenize(spark: SparkSession, source: str, out: str, batch_rows: int = 5000) -> None:
    """Rows of exported CSV files (id, text, tokens) whose tokens differ from today's, as a patch (id, tokens) in CSV files. A second run on its own result changes nothing."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("id long, text string, tokens string").csv(source)
    new = F.array_join(tokens("text"), " ")
    write_patch(rows.select("id", F.coalesce("tokens", F.lit("")).alias("old"), F.coalesce(new, F.lit("")).alias("tokens")).where("old <> tokens").select("id", "tokens"), out, batch_rows)


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    rows.write.mode("overwrite").json(path)
