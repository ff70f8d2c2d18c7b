"""Materialised intermediate tables and checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows (of some tens of bytes) that a broadcast may hold.
BROADCAST_ROWS = 500_000


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a table that is read several times, in the folder that ``spark.checkpoint.dir`` names.

    Without that setting a temporary folder serves in local mode; on a cluster it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="reelstack-"))
    return df.checkpoint()


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast if its counted rows are few; else leave the join to a shuffle. A side that is not counted yet is materialised for it."""
    if rows is None:
        df = cut(df)
        rows = df.count()
    return F.broadcast(df) if rows <= most else df
