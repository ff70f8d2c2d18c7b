"""Keeping the archive's tables: latest rows, roll-ups, upserts, publication, leases, quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key; ``order`` descends and ends on an id."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def zero_filled_counts(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Rows per known value of a column, 0 where there is none."""
    values = rows.sparkSession.createDataFrame([(k,) for k in known], f"{column} string")
    return values.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").na.fill(0, ["n"])


def evidence_rollup(evidence: DataFrame, key: str) -> DataFrame:
    """Per key: distinct sources in order, the standing status (rejected before verified before unverified) and the greatest confidence."""
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    return evidence.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.when(has("rejected"), "rejected").when(has("verified"), "verified").otherwise("unverified").alias("status"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("n"),
    )


def insert_if_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows, each key once, whose key is not stored; nulls are equal."""
    new = incoming.dropDuplicates(keys)
    there = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        one = new[k].eqNullSafe(there[f"_{k}"])
        same = one if same is None else same & one
    return new.join(there, same, "left_anti")


def deduplication_outcome(rows: DataFrame, content: str, owner: str, *order: Column) -> DataFrame:
    """Add ``outcome``: the first row of a content is ``created``, others ``duplicate_own`` or ``duplicate_other`` by the first one's owner."""
    w = Window.partitionBy(content).orderBy(*order)
    first = F.first(owner).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("outcome", F.when(F.row_number().over(w) == 1, "created").when(F.col(owner).eqNullSafe(first), "duplicate_own").otherwise("duplicate_other"))


def soft_deleted(rows: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """Rows with ``deleted_at`` set for the given ids; one that is set already stays."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn("deleted_at", F.when(F.col("_hit"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).drop("_hit")


def expired_leases(rows: DataFrame, expires: str, now: Column, grace_s: int = 15) -> DataFrame:
    return rows.where(now > F.col(expires) + F.make_interval(secs=F.lit(grace_s)))


def first_texts(observed: DataFrame, scene: str, text: str, *order: str) -> DataFrame:
    """Distinct texts of each scene in order of first appearance."""
    first = observed.groupBy(scene, text).agg(F.min(F.struct(*order)).alias("at"))
    return first.groupBy(scene).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", text))), lambda x: x[text]).alias("texts"))


def keyset_page(rows: DataFrame, after: tuple, order: list[str], size: int) -> DataFrame:
    """The next rows after a position, by several columns."""
    place = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, after, strict=True)])
    return rows.where(F.struct(*order) > place).orderBy(*order).limit(size)


# ---- checks


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; null keys are none."""
    there = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(there, key, "left_anti")


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n) of named tables of faulty rows."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def pairwise_health(vectors: DataFrame, id_col: str, vector: str, rounds: int = 8) -> DataFrame:
    """Mean cosine over all pairs of unit vectors, exactly, and uniformity ``ln E exp(-2 d^2)`` over ``rounds`` sampled pairs a vector.

    All pairs' cosines add up to the squared length of the vectors' sum, less one for each vector, halved: one aggregation. For the
    sample each round puts the vectors into bins by a hash, in which neighbours by the hash are a pair.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("x"))
    sums = rows.select("id", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    whole = sums.agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    exact = whole.select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"), F.lit(1).alias("one"))
    key = F.md5(F.concat_ws(":", "round", "id").cast("binary"))
    dealt = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("key", key)
    before = F.lag("x").over(Window.partitionBy("round", F.substring("key", 1, 2)).orderBy("key"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    sampled = dealt.withColumn("y", before).where("y is not null").select(dot.alias("c"))
    sampled = sampled.agg(F.count("*").alias("sampled_pairs"), F.round(F.ln(F.avg(F.exp(-2 * (2 - 2 * F.col("c"))))), 6).alias("uniformity")).withColumn("one", F.lit(1))
    return exact.join(sampled, "one").drop("one")


def stratified(rows: DataFrame, group: str, most: int, seed: int = 0) -> DataFrame:
    """Round-robin sample over groups: first rows of all groups, then second ones, and so on, in hashed order."""
    placed = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id").cast("binary")), "id")))
    return placed.orderBy("turn", group).limit(most)
