"""Stored tables that change: Parquet partitioned by a column, of which a change rewrites only the partitions it touches.

A change has a batch id. Its result is made in full before anything is replaced, then the touched partitions are exchanged and the batch is noted beside the table (``<path>_batches``). A batch that is
noted already does nothing; one that was broken off before it was noted can be run again, because every change here applied twice is the change applied once. Other partitions keep their files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstack.operators.curation import soft_deleted
from reelstack.operators.tables import cut, small


def create(rows: DataFrame, path: str, partition: str) -> None:
    """A new table at ``path``; an error if there is one."""
    rows.write.partitionBy(partition).parquet(path)
    _note(rows.sparkSession, path, "created")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _note(spark: SparkSession, path: str, batch: str) -> None:
    spark.createDataFrame([(batch,)], "batch string").write.mode("append").parquet(f"{path}_batches")


def batches(spark: SparkSession, path: str) -> DataFrame:
    """The batches that the table has taken."""
    return spark.read.parquet(f"{path}_batches").distinct()


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls being equal; the right side's are called ``_`` and their name."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_{k}"])
    return on


def _renamed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()


def _replaced(spark: SparkSession, path: str, touched: DataFrame, partition: str, change) -> int:
    """Apply ``change`` to the rows of the ``touched`` partitions (a column ``partition``) and exchange these; the number of partitions.

    A partition that the change empties is exchanged for nothing, so its files are dropped by the table's next rewrite only: changes here empty none.
    """
    values = [r[0] for r in touched.select(partition).distinct().collect()]  # names of folders: the catalogue's size, not the table's
    if not values:
        return 0
    wanted = F.col(partition).isin([v for v in values if v is not None])
    if None in values:
        wanted = wanted | F.col(partition).isNull()
    # made and kept elsewhere before the folders it was read from are replaced
    made = cut(change(read(spark, path).where(wanted)))
    made.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return len(values)


def merge_rows(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], partition: str, batch: str, replace: bool = True) -> int:
    """Rows put into the table by ``keys``, one of each key: new keys are added, stored ones replaced, or kept if ``replace`` is false. The number of partitions rewritten.

    ``partition`` must be one of the keys or depend on them, so that a key never moves. Of several incoming rows of a key the greatest counts, column by column in the table's order.
    """
    if not batches(spark, path).where(F.col("batch") == batch).isEmpty():
        return 0
    names = read(spark, path).columns
    rest = [c for c in names if c not in keys]
    one = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]) if rest else rows.select(*keys).distinct()
    one = cut(one.select(*names))

    if not replace:
        # new keys only, and so only partitions that get one
        there = _renamed(read(spark, path), keys)
        one = cut(one.join(there, _same(one, there, keys), "left_anti"))
    known = _renamed(one, keys)
    n = _replaced(spark, path, one, partition, lambda stored: stored.join(known, _same(stored, known, keys), "left_anti").unionByName(one))
    _note(spark, path, batch)
    return n


def delete_softly(spark: SparkSession, path: str, ids: DataFrame, key: str, partition: str, now: Column, batch: str) -> int:
    """``deleted_at`` set in stored rows of the given ids, where it is not set yet. The number of partitions rewritten: those that hold such rows, found by ``key`` and partition alone."""
    if not batches(spark, path).where(F.col("batch") == batch).isEmpty():
        return 0
    wanted = ids.select(key).distinct()
    held = read(spark, path).where("deleted_at is null").select(key, partition).join(small(wanted), key, "left_semi")
    n = _replaced(spark, path, held, partition, lambda stored: soft_deleted(stored, wanted, key, now).select(stored.columns))
    _note(spark, path, batch)
    return n
