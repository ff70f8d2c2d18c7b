"""What several operators share on the Spark side: cut lineage, and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one long id each that a broadcast may hold (16 MB); above it a shuffle join is used.
BROADCAST_IDS = 2_000_000

#: Parts over which the links of one node are spread where the table of minima is too large for a broadcast.
SALTS = 16

#: Links that one task of a components step takes.
LINKS_A_TASK = 500_000


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder the cluster names in ``spark.checkpoint.dir``, so that a lost executor costs no recomputation.

    Where that setting is absent and executors are threads of the driver (local mode), a temporary folder is set; on a
    cluster, whose executors could not read it, a missing setting is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="reelstack-"))
    return df.checkpoint()


def small(df: DataFrame, rows: int, most: int = BROADCAST_IDS) -> DataFrame:
    """Mark a side for broadcast if its counted rows are few; else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= most else df


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so, however spelt."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _with_least(links: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Links (a, b) with the minimum ``m`` of their ``a``; there are at most twice as many minima as links."""
    if 2 * n <= BROADCAST_IDS // 2:
        return links.join(F.broadcast(least), "a")
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(spread, ["a", "salt"]).drop("salt")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge table (a, b): the least node each one reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Minima are
    pre-aggregated before each shuffle and joined back by broadcast, or to ``SALTS`` parts of each node's links, so a node with very many
    neighbours is no single task's work, and edges never leave the executors. Nodes without an
    edge to another node are absent. Empty input gives no rows.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = links.count()
    while n:
        # few links take few tasks: a step's shuffles then write few files
        tasks = n // LINKS_A_TASK + 4
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(_with_least(both.where("b > a"), least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct().coalesce(tasks))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = _with_least(large, least, n)
        after = star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = cut(after.coalesce(tasks))
        size = after.count()
        done = size == n and after.join(links, ["a", "b"], "left_semi").count() == n
        links, n = after, size
        if done:
            break
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.union(labels.select(F.col("component").alias("node"), "component").distinct())
