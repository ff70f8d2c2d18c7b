"""Python workers' batches are bounded by their bytes, and long lines are compared only where bounds leave a choice open."""

import difflib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelstack.functions import batches
from reelstack.functions import text as tx
from reelstack.operators import observations as ob
from reelstack.operators import retrieval as rt
from reelstack.operators import topk


@pytest.fixture
def spark_batches(spark):
    """Spark's own size of batches, as a session has it that nothing ran in."""
    before = spark.conf.get(batches.BATCH_SETTING)
    spark.conf.unset(batches.BATCH_SETTING)
    yield spark
    spark.conf.set(batches.BATCH_SETTING, before.rstrip("b"))


def largest_batch(df):
    """Bytes of the largest batch that a Python worker gets of a table."""

    def run(batches):
        yield pa.RecordBatch.from_pydict({"n": pa.array([max((b.nbytes for b in batches), default=0)], pa.int64())})

    return df.mapInArrow(run, "n long").agg(F.max("n")).first()[0]


def texts(spark, n=200, size=100_000):
    return spark.range(n).coalesce(1).select("id", F.concat(F.lit("é"), F.repeat(F.lit("x"), size)).alias("text"))


def test_normalisation_gets_bounded_batches(spark_batches):
    df = texts(spark_batches)
    assert largest_batch(df) > 4 * batches.BATCH_BYTES
    out = tx.normalised(df, "text", "m", "k")
    assert out.where("m = text and k = text").count() == 200
    assert largest_batch(df) < 2 * batches.BATCH_BYTES


def test_merging_normalises_each_text_once(spark, monkeypatch):
    """Texts beyond ASCII pass through Python once, in one worker a task; groups are those written out plainly, rows without scene or text in none."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(values: pd.Series) -> pd.Series:
        seen.add(len(values))
        return values.str.lower()

    monkeypatch.setattr(tx, "_casefold", counted)
    rng = random.Random(3)
    words = ["é a", "É  A", "éa", "ö", "Ö ", "plain", "PLAIN", None]
    rows = [(rng.choice([0, 1, 2, None]), rng.choice([0, 1, 2, 3, None]), i, rng.choice(words), rng.randint(0, 3) / 4) for i in range(60)]
    df = spark.createDataFrame(rows, "scene_id long, frame long, obs_id long, raw_text string, confidence double")
    got = ob.merged(df).collect()
    held = [r for r in rows if r[0] is not None and r[3] is not None]
    assert seen.value == sum(not r[3].isascii() for r in held)
    groups = {}
    for r in held:
        groups.setdefault((r[0], "".join(r[3].lower().split())), []).append(r)
    want = []
    for (scene, text), of in groups.items():
        apart = len({r[1] for r in of}) < len(of)
        for part in [[r] for r in of] if apart else [of]:
            best = max(part, key=lambda r: (r[4], r[1] is not None, -(r[1] or 0), r[2]))
            frames = [r[1] for r in part if r[1] is not None]
            want.append((scene, text, len(part), best[2], min(frames, default=None), max(frames, default=None), best[4]))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r["size"] for r in got} > {1}


def test_sessions_own_batches_stay(spark_batches):
    spark_batches.conf.set(batches.BATCH_SETTING, "1000000")
    batches.lean(texts(spark_batches))
    assert spark_batches.conf.get(batches.BATCH_SETTING) == "1000000"


def test_nearest_observation_is_brute_force(spark):
    """Cases of random short texts, without a text, with ties, and without observations, against every ratio."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab é") for _ in range(rng.randint(0, 7)))
    seen = [(f, 100 * f + k, None if k == 3 else word()) for f in range(60) for k in range(rng.randint(0, 5))]
    asked = [(f, f, None if f % 9 == 4 else (e := word()), None if f % 9 == 4 else e + " |") for f in range(60)]
    cases = spark.createDataFrame(asked, "g int, case_id long, expected string, reported string")
    got = {r["case_id"]: r for r in ob.nearest_observation(cases, spark.createDataFrame(seen, "g int, obs_id long, raw_text string"), ["g"]).collect()}
    assert len(got) == 60

    def ratio(a, b):
        one = lambda x, y: difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
        return 0.0 if a is None or b is None else min(one(a, b), one(b, a))

    judged = ob.nearest_observation(cases, spark.createDataFrame(seen, "g int, obs_id long, raw_text string"), ["g"])
    states = dict(judged.select("case_id", ob.case_status(F.col("expected"), F.col("reported"), F.col("best"), like=F.col("like"))).collect())
    for f, _, expected, reported in asked:
        every = sorted(((ratio(expected, t), -i, t) for g, i, t in seen if g == f), key=lambda r: r[:2])
        like, _, best = every[-1] if every else (0.0, 0, None)
        assert (got[f]["like"], got[f]["best"]) == (like, best), (f, expected, every)
        now, before = ratio(expected, best), ratio(reported, best)
        want = "absent" if now < 0.34 else "fixed" if now >= 1 - 1e-9 else "reproduced" if before >= 1 - 1e-9 else "changed"
        assert states[f] == want


def test_long_lines_are_not_compared_where_bounds_decide(monkeypatch):
    """Twenty thousand characters beside the line itself with a mark: no matching-block ratio of the two long lines is needed."""
    monkeypatch.setattr(ob.difflib, "SequenceMatcher", None)
    line, other = "ab cd " * 3000, "xy zw " * 3000
    assert ob._nearest(line, [{"id": 1, "text": other}, {"id": 2, "text": "~ " + line}])[1] == "~ " + line


def test_retrieval_gets_bounded_batches(spark_batches):
    """Long texts' tokens reach the counting of asked terms in bounded batches, and scores stay those of joins."""
    body = F.concat_ws(" ", F.lit("rain"), F.repeat(F.lit("storm wind "), 9000), F.concat(F.lit("n"), F.col("id") % 7))
    docs = spark_batches.range(100).coalesce(1).select(F.col("id").alias("doc_id"), body.alias("body"))
    read = docs.withColumn("parts", F.array(tx.tokens("body")))
    assert largest_batch(read.select("doc_id", "parts")) > 4 * batches.BATCH_BYTES
    queries = spark_batches.createDataFrame([(1, ["rain", "n3"]), (2, ["wind", "n5", "none"])], "query_id long, terms array<string>")
    found = topk.best(queries, docs, "doc_id", F.array(tx.tokens("body")), 5, weights=(1.0,))
    assert largest_batch(read.select("doc_id", "parts")) < 2 * batches.BATCH_BYTES
    order = F.desc("raw_score"), F.col("doc_id")
    got = rt.top_k(found.select("query_id", "doc_id", F.round("score", 9).alias("raw_score")), 5, *order)
    want = rt.top_k(rt.bm25(queries, docs, "doc_id", {"body": tx.tokens("body")}, {}), 5, *order).select(*got.columns)
    plain = lambda df: sorted((r["query_id"], r["doc_id"], round(r["raw_score"], 6), r["rank"]) for r in df.collect())
    assert plain(got) == plain(want) and len(plain(got)) == 10


def test_wide_confusion_is_that_of_long_groups(spark):
    """One row for each observation tells the same groups, confusion and kept originals as a row for each threshold, at every threshold."""
    rng = random.Random(8)
    words = ["storm warning", "storm warming", "Storm  Warning", "flood 12", "flood 13", "harbour", "harbours"]
    rows = [(s, f, 1000 * s + 10 * f + k, rng.choice(words), rng.randint(0, 9) / 10) for s in range(6) for f in range(8) for k in range(2)]
    seen = spark.createDataFrame(rows, "scene_id long, frame int, obs_id long, raw_text string, confidence double")
    wide = ob.merged_wide(seen)
    assert wide.count() == len(rows)
    one = {r["obs_id"]: r["group_ids"] for r in wide.collect()}
    for r in ob.merged_at(seen).collect():
        assert one[r["obs_id"]][ob.THRESHOLDS.index(r["threshold"])] == r["group_id"]
    pairs = [(a, b, a % 3 != 0) for a, b in zip(sorted(one), sorted(one)[1:])]
    long = ob.threshold_confusion(spark.createDataFrame(pairs, "left_id long, right_id long, same boolean"), ob.merged_at(seen))
    ends = spark.createDataFrame([(one[a], one[b], s) for a, b, s in pairs], "left_groups array<long>, right_groups array<long>, same boolean")
    assert sorted(long.collect()) == sorted(ob.wide_confusion(ends).collect())
    assert sorted(ob.originals_kept(seen, ob.merged_at(seen)).collect()) == sorted(ob.wide_kept(seen, wide).select("threshold", "n_groups", "originals_kept").collect())
    lost = ob.wide_kept(seen, wide.where("obs_id <> 1010"))
    assert not any(r["originals_kept"] for r in lost.collect())


def test_shapes_by_one_expression():
    """What is no letter or digit of a text, for every character of the basic plane."""
    for start in range(0, 0x11000, 0x100):
        text = "".join(map(chr, range(start, start + 0x100)))
        assert ob._shape(text)[1] == "".join(c for c in text if not c.isalnum())


def test_dense_search_holds_the_best_of_each_query_only(spark, monkeypatch):
    """Steps of three vectors give the distances of all pairs, and no step multiplies more."""
    monkeypatch.setattr(rt, "CELL_VECTORS", 3)
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (50, 4)) + 0.5
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, vector array<double>")
    asked = rows.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {(q, i): n + 1 for q in range(0, 50, 5) for n, i in enumerate(sorted((i for i in range(50) if i != q), key=lambda i: (np.round(1 - unit[q] @ unit[i], 9), i))[:6])}
    got = {(r["query_id"], r["vec_id"]): r["rank"] for r in rt.dense_top_k(asked, rows, 6).collect()}
    assert got == want
