"""Offline scorers of search, slots, entities and observations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_hit(gold: DataFrame, ranked: DataFrame, doc_col: str = "scene_id") -> DataFrame:
    """(query_id, hit_rank): best rank of any gold document of each gold query; null if none was returned."""
    found = gold.join(ranked.select("query_id", doc_col, "rank"), ["query_id", doc_col], "left")
    return found.groupBy("query_id").agg(F.min("rank").alias("hit_rank"))


def single_answer_metrics(queries: DataFrame, hits: DataFrame, ranked: DataFrame, k: int, *group: str) -> DataFrame:
    """Recall and nDCG at ``k`` of queries with one answer, over all queries and over those that got any result."""
    answered = ranked.select("query_id").distinct().withColumn("answered", F.lit(True))
    rows = queries.join(hits, "query_id", "left").join(answered, "query_id", "left")
    hit = F.coalesce(F.col("hit_rank") <= k, F.lit(False))
    gain = F.when(hit, 1 / F.log2(F.col("hit_rank") + 1)).otherwise(0.0)
    responded = F.coalesce("answered", F.lit(False))
    return rows.groupBy(*group).agg(
        F.count("*").alias("n_queries"),
        F.count_if(responded).alias("n_responded"),
        F.count_if(hit).alias("hits"),
        F.round(F.avg(hit.cast("double")), 6).alias("recall"),
        F.round(F.avg(gain), 6).alias("ndcg"),
        F.round(F.avg(F.when(responded, hit.cast("double"))), 6).alias("recall_responded"),
        F.round(F.avg(F.when(responded, gain)), 6).alias("ndcg_responded"),
    )


def multi_answer_metrics(relevant: DataFrame, ranked: DataFrame, k: int, doc_col: str) -> DataFrame:
    """Per query: recall, precision, nDCG and reciprocal rank at ``k`` with many relevant documents (query_id, id)."""
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return rank_metrics(total, ranked.where(F.col("rank") <= k).join(relevant, ["query_id", doc_col]), k)


def label_metrics(queries: DataFrame, documents: DataFrame, ranked: DataFrame, k: int, doc_col: str) -> DataFrame:
    """The same where a document is relevant to a query of its ``label``, the query's own row (of the same id) excepted: labels are counted, only ranked rows are joined."""
    sizes = documents.groupBy("label").agg(F.count("*").alias("n"))
    own = documents.select(F.col(doc_col).alias("query_id"), F.col("label").alias("own"))
    total = queries.join(sizes, "label").join(own, "query_id", "left")
    total = total.select("query_id", (F.col("n") - F.coalesce((F.col("own") == F.col("label")).cast("int"), F.lit(0))).alias("n_relevant")).where("n_relevant > 0")
    few = ranked.where(F.col("rank") <= k).join(queries.select("query_id", "label"), "query_id")
    return rank_metrics(total, few.join(documents.select(doc_col, "label"), [doc_col, "label"]), k)


def rank_metrics(total: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Recall, precision, nDCG and reciprocal rank from (query_id, n_relevant) and the ranks of relevant rows among the first ``k``."""
    seen = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return total.join(seen, "query_id", "left").select(
        "query_id",
        "n_relevant",
        F.round(zero(F.col("n") / F.col("n_relevant")), 6).alias("recall"),
        F.round(zero(F.col("n") / k), 6).alias("precision"),
        F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"),
        F.round(zero(1 / F.col("first")), 6).alias("mrr"),
    )


#: Cumulative probabilities of 0 to 7 draws of one row in a resample as large as the table (Poisson of mean 1); more are as rare as 1e-6.
DRAWS = tuple(sum(1 / math.factorial(i) for i in range(k + 1)) / math.e for k in range(8))


#: Rows whose draws are made at once.
DRAWN_ROWS = 256


def drawn(x: np.ndarray, y: np.ndarray, resamples: int) -> np.ndarray:
    """How often each row is drawn in each resample, from two 32-bit hashes of its id: ``x + b * y``, scrambled by public multipliers, read as a Poisson quantile."""
    low = np.uint64(0xFFFFFFFF)
    t = (x[:, None] + np.arange(resamples, dtype=np.uint64)[None] * y[:, None]) & low
    for shift, times in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        t = ((t ^ (t >> np.uint64(shift))) * np.uint64(times)) & low
    t ^= t >> np.uint64(15)
    return np.searchsorted(np.array(DRAWS), t / float(1 << 32), side="right")


def paired_bootstrap(pairs: DataFrame, id_col: str, left: str, right: str, resamples: int = 10_000) -> DataFrame:
    """Mean difference ``right - left`` with its 2.5 and 97.5 percentiles over resamples, and wins, ties and losses.

    In each resample a row is drawn as often as a hash of resample and id says, by the Poisson distribution that draws from a large table tend to:
    rows need no numbers and reruns agree. A task adds its rows to one vector of sums with a place for each resample, and only these vectors are shuffled.
    """
    rows = pairs.select(F.col(id_col).alias("id"), (F.col(right) - F.col(left)).alias("d"))
    digest = F.md5(F.col("id").cast("string").cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            x, y, d = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "d"))
            for at in range(0, len(d), DRAWN_ROWS):
                cut_ = slice(at, at + DRAWN_ROWS)
                times = drawn(x[cut_].astype(np.uint64), y[cut_].astype(np.uint64), resamples)
                weight += times.sum(0)
                total += d[cut_] @ times
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(weight), pa.array(total)], names=["b", "w", "wd"])

    sums = rows.where("id is not null and d is not null").select(part(1).alias("x"), part(9).alias("y"), "d").mapInArrow(add, "b long, w double, wd double")
    means = sums.groupBy("b").agg((F.sum("wd") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    spread = means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))
    whole = rows.agg(
        F.count("*").alias("n"),
        F.round(F.avg("d"), 6).alias("mean_diff"),
        F.count_if(F.col("d") > 0).alias("wins"),
        F.count_if(F.col("d") == 0).alias("ties"),
        F.count_if(F.col("d") < 0).alias("losses"),
    )
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(whole).join(one(spread), "one").drop("one")


def set_scores(gold: Column, found: Column, optional: Column) -> dict[str, Column]:
    """Per-row counts and precision, recall, F1 of slot sets: optional slots are allowed and not asked for; a side that is empty counts as right."""
    allowed = F.size(F.array_intersect(found, F.array_union(gold, optional)))
    hit = F.size(F.array_intersect(gold, found))
    p = F.when(F.size(found) > 0, allowed / F.size(found)).otherwise(1.0)
    r = F.when(F.size(gold) > 0, hit / F.size(gold)).otherwise(1.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": f, "allowed": allowed, "hit": hit, "n_found": F.size(found), "n_gold": F.size(gold)}


def slot_flags(intent: Column, gold_intent: Column, gold: Column, found: Column, optional: Column, forbidden: list[str], explicit: Column, text_words: Column) -> dict[str, Column]:
    """Per-row verdicts: ``frame`` (intent and all slots right), ``leak`` (a slot holds a forbidden phrase), ``hallucination`` (a slot given as explicit is not in the text)."""
    frame = (intent == gold_intent) & (F.size(F.array_except(gold, found)) == 0) & (F.size(F.array_except(found, F.array_union(gold, optional))) == 0)
    leak = F.exists(found, lambda v: F.exists(F.array(*map(F.lit, forbidden)), lambda w: F.contains(v, w)))
    return {"frame": frame, "leak": leak, "hallucination": F.size(F.array_except(explicit, text_words)) > 0}


def span_exact_rate(spans: Column, corrected: Column) -> Column:
    """Share of spans that needed no correction, over all rows; null without spans."""
    return F.round((F.sum(spans) - F.sum(corrected)) / F.nullif(F.sum(spans), F.lit(0)), 6)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Share rounded to six digits, null for an empty denominator."""
    return F.round(numerator / F.nullif(denominator, F.lit(0)), 6)


def index_percentile(df: DataFrame, value: str, share: float, *group: str, ceil: bool = False) -> DataFrame:
    """Percentile by index: the row at ``int(n * share)``, or at ``ceil(n * share) - 1``, of the sorted values."""
    w = Window.partitionBy(*group)
    n = F.count("*").over(w)
    at = F.least((F.ceil(n * share) - 1) if ceil else F.floor(n * share), n - 1)
    placed = df.withColumns({"_i": F.row_number().over(w.orderBy(value)) - 1, "_at": at})
    return placed.where("_i = _at").select(*group, F.col(value).alias(f"{value}_p{int(share * 100)}"))


def overlap_band(query: Column, caption: Column) -> Column:
    """Band of a failed query by the share of its character bigrams that its answer's caption has."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    share = F.size(F.array_intersect(grams(query), grams(caption))) / F.size(grams(query))
    return F.when(F.length(caption) == 0, "empty").when(share == 0, "none").when(share < 0.25, "low").otherwise("high")


def entity_scores(gold: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counts and shares of found entities (clip_id, scene_id, type, key) against gold ones.

    ``strict`` ones are gold in their scene, ``attributable`` ones in their clip, ``outside`` ones nowhere in it; recall is over all gold
    entities and over those of scenes that were answered at all.
    """
    keys = ["clip_id", "scene_id", "type", "key"]
    marked = found.join(gold.select(keys).distinct().withColumn("hit", F.lit(True)), keys, "left")
    marked = marked.join(gold.select("clip_id", "type", "key").distinct().withColumn("near", F.lit(True)), ["clip_id", "type", "key"], "left")
    asked = gold.join(found.select(keys).distinct().withColumn("hit", F.lit(True)), keys, "left")
    asked = asked.join(found.select("clip_id", "scene_id").distinct().withColumn("answered", F.lit(True)), ["clip_id", "scene_id"], "left")
    left = marked.agg(F.count("*").alias("found"), F.count_if("hit").alias("strict"), F.count_if("near").alias("attributable"), F.count_if(F.col("near").isNull()).alias("outside")).withColumn("one", F.lit(1))
    right = asked.agg(F.count("*").alias("gold"), F.count_if("hit").alias("recalled"), F.count_if("answered").alias("answered")).withColumn("one", F.lit(1))
    shares = {"strict_precision": ("strict", "found"), "attributable_precision": ("attributable", "found"), "recall": ("recalled", "gold"), "answered_recall": ("recalled", "answered")}
    return left.join(right, "one").drop("one").withColumns({k: ratio(F.col(a), F.col(b)) for k, (a, b) in shares.items()})
