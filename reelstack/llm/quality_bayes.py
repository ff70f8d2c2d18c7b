"""Quality by hierarchical empirical Bayes: document evidence with site posteriors.

A logistic classifier on shape features of a text gives its evidence, a log-likelihood
ratio free of the base rate. Labels are counted by host and by path of a host in
grouped aggregations; the good share of a host is shrunk towards the
global share, that of a path towards its host's, each with a prior strength fitted to the spread
of the groups by moments. A document's posterior log-odds are its path's log-odds
plus its evidence.

The classifier is fitted on at most ``max_labelled`` labelled documents (least hash first);
site counts cover all labels given. Counts are pre-aggregated before they are
shuffled, so a hot host costs its keys' rows only, and the site table is joined by key with skew
handling, broadcast only if it is small.

Defined results: a null text counts as an empty one; a null host or path is a site of its own;
sites without labels have their parent's posterior; without labels of both kinds the evidence is 0. Several labels of one
document count as the greatest; rows that repeat an id are judged each, a null id is kept and teaches nothing; ties of the sample's hash
are broken by the id. Empty tables give no rows; other columns are not read. A text is measured in one piece, in memory of some 40 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelstack.llm.shared import cut
from reelstack.llm.tokens import per_row, slices, words
from reelstack.llm.toxicity import learnable

MAX_LABELLED = 20_000
#: A document is kept unless its probability of being good is below this.
THRESHOLD = 0.3
#: Sites (rows of the table of host and path) that may be broadcast.
BROADCAST_SITES = 200_000
FEATURES = ("log_words", "word_length", "symbols", "capitals", "digits", "pipes", "exclamations", "distinct", "repeats", "short_lines", "log_lines", "long_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@^~_=+{}[]\\")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, features): shape of each text, every column bounded."""
    w = words(buf, off)
    n = np.maximum(w.count, 1).astype(float)
    chars = np.maximum(np.diff(off), 1).astype(float)
    share = lambda mask: per_row(mask, off)
    size = w.end - w.start
    order = np.lexsort((w.hash, w.row))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.row[order][1:] != w.row[order][:-1])
    distinct = np.bincount(w.row[order][new], minlength=len(off) - 1)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    lines = share(buf == 10) + 1.0
    return np.stack(
        [
            np.log1p(w.count) / 10,
            np.minimum(per_row(size, w.first) / n / 20, 2),
            np.minimum(share(_SYMBOL[buf]) / n, 4) / 4,
            share(_UPPER[buf]) / chars,
            share(_DIGIT[buf]) / chars,
            np.minimum(share(buf == 124) / n, 1),
            np.minimum(share(buf == 33) / n, 2) / 2,
            distinct / n,
            per_row(same, w.first) / n,
            np.minimum(lines / n, 1),
            np.log1p(lines) / 8,
            per_row(size > 25, w.first) / n,
        ],
        axis=1,
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of features, squares and a constant, by Newton's method."""
    z = expand(x)
    b = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b)) / 10, z.T @ (p - y) + ridge * b / 10)
        b -= step
        if np.abs(step).max() < 1e-7:
            break
    return b


def expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x * x, np.ones((len(x), 1))], axis=1)


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _strength(groups: DataFrame, centre: Column) -> float:
    """Prior pseudo-count of groups (n, good) around ``centre``, by the method of moments; 1 to 10,000."""
    row = groups.where("n > 0").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - centre, 2)).alias("spread"),
        F.avg(centre * (1 - centre)).alias("within"),
    ).first()
    if not row["k"] or not row["within"]:
        return 10.0
    between = max((row["spread"] - row["k"] * row["within"]) / max(row["n"] - row["k"], 1), 1e-9)
    return float(min(max(row["within"] / between - 1, 1.0), 10_000.0))


def site_posteriors(labelled: DataFrame) -> tuple[DataFrame, float]:
    """((host, path, posterior), global share) from labelled rows (host, path, label); null keys are kept."""
    path = cut(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("long")).alias("good")))
    host = path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = host.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    share = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)
    by_host = _strength(host, F.lit(share))
    host = host.select(F.col("host").alias("h"), ((F.col("good") + by_host * share) / (F.col("n") + by_host)).alias("host_posterior"))
    path = cut(path.join(host, F.col("host").eqNullSafe(F.col("h"))).drop("h"))
    by_path = _strength(path, F.col("host_posterior"))
    posterior = (F.col("good") + by_path * F.col("host_posterior")) / (F.col("n") + by_path)
    return path.select("host", "path", "host_posterior", posterior.alias("posterior")), share


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    path: Column | None = None,
    label_col: str = "quality",
    keep=lambda i: F.lit(True),
    max_labelled: int = MAX_LABELLED,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: id, ``evidence`` (log-likelihood ratio), ``site_prior`` (posterior share of its path), ``score`` and ``kept``.

    ``host`` and ``path`` are expressions over ``docs`` (by default its ``source``, and ``lang`` under it).
    Labels are learned from where ``keep`` holds for the id.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    known = cut(learnable(labels, docs, id_col, label_col, keep))
    drawn = known.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(max_labelled)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, buf, off in slices(batch.column(0)):
                flat = pa.array(features(buf, off).reshape(-1))
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(FEATURES), flat)
                yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(at, n)], names=["x", "label"])

    # one text of each id, so that rows that repeat an id cannot exceed the bound
    one = slim.join(F.broadcast(drawn), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sample = one.select("text", "label").mapInArrow(measure, "x array<double>, label int").toArrow()
    y = (sample.column("label").to_numpy() > 0).astype(float)
    x = np.array(sample.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    both = 0 < y.sum() < len(y)
    weights = fit_logistic(x, y) if both else np.zeros(2 * len(FEATURES) + 1)
    base = np.log(y.mean() / (1 - y.mean())) if both else 0.0

    labelled = slim.select("id", "host", "path").join(known, "id")
    sites, share = site_posteriors(labelled)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, buf, off in slices(batch.column(1)):
                e = expand(features(buf, off)) @ weights - base
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(2).slice(at, n), batch.column(3).slice(at, n), pa.array(e)], names=["id", "host", "path", "evidence"])

    kind = slim.schema["id"].dataType.simpleString()
    scored = slim.mapInArrow(evidence, f"id {kind}, host string, path string, evidence double")
    site = sites.select(F.col("host").alias("h"), F.col("path").alias("p"), "host_posterior", "posterior")
    hosts = cut(site.groupBy("h").agg(F.max("host_posterior").alias("host_posterior")))
    n_sites, n_hosts = site.count(), hosts.count()
    side = lambda df, n: F.broadcast(df) if n <= BROADCAST_SITES else df
    joined = scored.join(side(site.drop("host_posterior"), n_sites), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left").drop("h", "p")
    joined = joined.join(side(hosts, n_hosts), F.col("host").eqNullSafe(F.col("h")), "left")
    prior = F.coalesce("posterior", "host_posterior", F.lit(share))
    score = 1 / (1 + F.exp(-(logit(prior) + F.col("evidence"))))
    return joined.select(F.col("id").alias(id_col), "evidence", prior.alias("site_prior"), score.alias("score"), (score >= threshold).alias("kept"))
