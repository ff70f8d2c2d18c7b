"""The archive's roles as projections of the given tables, and readers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstack.functions.text import tokens
from reelstack.operators.tables import cut, small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scenes: ten a clip, ten seconds each, first line as caption, the rest as transcript."""
    at = F.instr("text", "\n")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("scene_id"),
        F.floor(F.col("doc_id") / 10).alias("clip_id"),
        F.when(F.floor(F.col("doc_id") / 10) % 5 == 0, F.col("doc_id") % 2 + 1).otherwise(1).alias("run_id"),
        (F.col("doc_id") % 10 * 10000).alias("start_ms"),
        (F.col("doc_id") % 10 * 10000 + 10000).alias("end_ms"),
        F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("caption"),
        F.when(at > 0, F.substring("text", at + 1, F.length("text"))).otherwise("").alias("transcript"),
        F.when(F.col("doc_id") % 4 == 0, "b_roll").when(F.col("doc_id") % 4 == 1, "anchor").otherwise("field").alias("shot_type"),
        "lang",
        "source",
    )


def clips(scene: DataFrame) -> DataFrame:
    """Clips of the scenes: every 17th is deleted, every fifth is in its second run."""
    return scene.select("clip_id").distinct().select(
        "clip_id",
        F.when(F.col("clip_id") % 17 == 0, F.timestamp_seconds(F.lit(0))).alias("deleted_at"),
        F.when(F.col("clip_id") % 5 == 0, 2).otherwise(1).cast("long").alias("active_run_id"),
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries: all their distinct words."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.array_distinct(tokens("text")).alias("terms"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, scene_id): scenes that hold the query's passage.

    A passage may begin or end inside a word of the document, but its inner words are whole words there: the longest of them
    is the equi-join key, the passage itself the residual. Passages of less than three words are a stated set that is held against all documents.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")).withColumn("words", tokens("passage"))
    inner = F.slice("words", F.lit(2), F.greatest(F.size("words") - 2, F.lit(0)))
    longest = F.try_element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(1))["w"]
    keyed = items.where("size(words) > 2").select("item_id", longest.alias("key"), "passage")
    keys = small(keyed.select("key").distinct())
    held = docs.select("doc_id", F.explode(F.array_distinct(tokens("text"))).alias("key")).join(keys, "key", "left_semi")
    hit = held.join(keyed, "key").select("doc_id", "item_id", "passage").join(docs, "doc_id").where(F.contains("text", "passage"))
    short = cut(items.where("size(words) <= 2 and passage <> ''").select("item_id", "passage"))
    found = hit.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("scene_id"))
    if short.count():
        found = found.unionByName(docs.join(F.broadcast(short), F.contains("text", "passage")).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("scene_id")))
    return found


def load_index(spark: SparkSession, path: str, schema: str, wanted: DataFrame | None = None, category: str | None = None, id_col: str = "id") -> DataFrame:
    """Rows of a JSON-lines index with an id: those among ``wanted`` ids, those of a category, or all."""
    rows = spark.read.schema(schema).json(path).where(F.col(id_col).isNotNull())
    if wanted is not None:
        rows = rows.join(small(wanted.select(id_col).distinct()), id_col, "left_semi")
    return rows if category is None else rows.where(F.col("category") == category)


def read_strict(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, rejects with their line and reason) of JSON-lines files under a strict schema."""
    from reelstack.operators.archive import parsed_records

    return parsed_records(spark.read.text(path).select("value", F.col("value").alias("line")), "value", schema, required)
