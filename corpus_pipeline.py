"""The corpus pipeline: five filtering and mixing stages over ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelstack.llm.decontaminate import drop_contaminated
from reelstack.llm.mixing import mixture
from reelstack.llm.near_dup import drop_near_duplicates
from reelstack.llm.quality_rules import keep_quality
from reelstack.llm.shared import cut
from reelstack.llm.toxicity import drop_toxic, train


#: Rows of an Arrow batch: texts are long, and a Python worker holds a batch and what it makes of it.
BATCH_ROWS = 2000


def _lean(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's, unless the session names a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep, columns as they are. Documents without words go, null texts too; rows that repeat an id are each judged; an empty table stays empty."""
    _lean(spark)
    return keep_quality(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled ones among them does not call toxic. Texts without words are scored by the prior; without labels of both kinds every document stays."""
    _lean(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies. Documents without words are in no group and stay; rows that repeat an id stay or go together."""
    _lean(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null texts hold none; an empty benchmark keeps all."""
    _lean(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), edited=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: one row per copy taken, dealt to shards and shuffled there."""
    return mixture(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Suffix-array repetition, the toxicity model and similarity components are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each stage's rows being materialised for those that read them several times.

    The result is the mixture: a row for each copy that mixing takes, dealt to shards and shuffled there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
