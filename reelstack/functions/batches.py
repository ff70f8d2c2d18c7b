"""Bounded Arrow batches between Spark and Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Spark's setting and its default.
BATCH_SETTING, SPARK_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
#: Bytes of a batch: a Python worker holds a batch and several times its size of what it makes of it.
BATCH_BYTES = 2 << 20


def lean(df: DataFrame) -> DataFrame:
    """The table, with the Arrow batches of its session bounded to ``BATCH_BYTES``, unless the session names a size of its own.

    A batch is filled up to this size however large its partition is, so that a worker's memory does not grow with the table.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING).rstrip("b") == str(SPARK_BYTES):
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df
