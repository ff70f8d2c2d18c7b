"""Operators on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from reelstack.functions import text as tx
from reelstack.operators import curation, evaluate, intervals, observations, prepare, ranking, retrieval, rules, tags
from reelstack.sources import sinks, subtitles
from reelstack.streaming import event_time


def pick(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_match_value_normalises_unicode(spark):
    rows = spark.createDataFrame([("Ａ Ｂ​",), ("a b",), (None,)], "v string").select(tx.match_value("v").alias("m"), tx.comparison_text("v").alias("c")).collect()
    assert [r["m"] for r in rows] == ["AB", "ab", None]
    assert [r["c"] for r in rows][1:] == ["ab", None]


def test_excluded_segment_blocks_nothing(spark):
    seg = spark.createDataFrame([(1, 1, "uploaded", 0, 10), (1, 2, "embedded", 5, 20), (1, 3, "asr", 12, 18), (1, 4, "asr", 9, 12)], "clip_id long, segment_id long, source string, start long, end long")
    got = intervals.select_by_priority(seg, ["uploaded", "embedded", "asr"])
    assert pick(got, "segment_id", "selected", "conflicts") == [(1, True, ""), (2, False, "1"), (3, True, ""), (4, False, "1")]


def test_overlap_across_slots_counts_once(spark):
    a = spark.createDataFrame([(1, 0, 200_000)], "clip_id long, start long, end long")
    b = spark.createDataFrame([(1, 7, 50_000, 190_000), (1, 8, 200_000, 210_000)], "clip_id long, segment_id long, r_start long, r_end long")
    assert pick(intervals.overlaps(a, b), "segment_id", "overlap_ms") == [(7, 140_000)]


def test_gaps_of_an_uncovered_clip(spark):
    r = spark.createDataFrame([(1, 10, 20), (1, 15, 30)], "clip_id long, start long, end long")
    bounds = spark.createDataFrame([(1, 0, 40), (2, 0, 5)], "clip_id long, lo long, hi long")
    assert pick(intervals.gaps(r, bounds), "clip_id", "start", "end") == [(1, 0, 10), (1, 30, 40), (2, 0, 5)]


def test_withdrawn_verdict_is_none(spark):
    rows = [(1, "t", True, "reviewer", "verified", 1, 1), (1, "t", True, "reviewer", "withdrawn", 2, 2), (1, "t", False, "model", "verified", 1, 3), (2, "t", True, "reviewer", "rejected", 1, 4), (2, "t", False, "user_input", "verified", 1, 5)]
    j = spark.createDataFrame(rows, "scene_id long, tag string, scene_scoped boolean, source string, status string, created_at long, evidence_id long")
    assert pick(tags.effective_tags(j), "scene_id", "verification", "scope", "source") == [(1, "unverified", "clip", "model")]


def test_common_weight_factor_changes_nothing(spark):
    c = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, scene_id long, rank int")
    d = spark.createDataFrame([(1, 6, 1)], "query_id long, scene_id long, rank int")
    run = lambda w: pick(ranking.fuse({"a": c, "b": d}, {"a": w, "b": w}), "scene_id", "base_score")
    assert run(1.0) == run(0.5) and run(1.0)[1][1] < 1


def test_soft_score_survives_huge_weights(spark):
    big = 1.7e308
    row = spark.range(1).select(ranking.soft_score({"x": (F.lit(1.0), F.lit(True), big), "y": (F.lit(0.0), F.lit(True), big), "z": (F.lit(1.0), F.lit(False), 1.0)}).alias("s")).first()
    assert row["s"] == pytest.approx(0.5)


def test_page_reports_exclusions_it_met(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 7)], "query_id long, scene_id long, rank int")
    out = spark.createDataFrame([(1, 2), (1, 6)], "query_id long, scene_id long")
    assert pick(ranking.page(ranked, out, 1, 3), "scene_id", "state", "has_more") == [(1, "shown", True), (2, "excluded", True), (3, "shown", True), (4, "shown", True)]


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a d"), (4, "")], "id long, t string")
    q = spark.createDataFrame([(1, ["a", "c"])], "query_id long, terms array<string>")
    best = retrieval.bm25(q, docs, "id", {"t": tx.tokens("t")}, {}).orderBy(F.desc("raw_score")).first()
    assert best["id"] == 2


def test_dense_blocks_agree(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i % 5)]) for i in range(30)], "vec_id long, vector array<double>")
    q = v.where("vec_id < 6").withColumnRenamed("vec_id", "query_id")
    assert pick(retrieval.dense_top_k(q, v, 3), "query_id", "vec_id", "rank") == pick(retrieval.dense_top_k(q, v, 3, block=2), "query_id", "vec_id", "rank")


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([([("aaaa",), ("bbbbbbbb",), ("cc",)],)], "items array<struct<text:string>>")
    assert df.select(prepare.within_budget(F.col("items"), 8).alias("k")).first()["k"] == ["aaaa", "cc"]


def test_greedy_matching_is_one_to_one(spark):
    s = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.2)], "frame long, label_id long, obs_id long, score double")
    assert pick(observations.matched_labels(s, ["frame"]), "label_id", "obs_id") == [(1, 1)]


def test_ambiguous_text_stays_apart(spark):
    o = spark.createDataFrame([(1, 1, 1, "x y", 0.5), (1, 1, 2, "X Y", 0.6), (1, 2, 3, "z", 0.1), (1, 3, 4, "Z", 0.9)], "scene_id long, frame long, obs_id long, raw_text string, confidence double")
    assert pick(observations.merged(o), "representative", "size") == [(1, 1), (2, 1), (4, 2)]


def test_rule_conflicts_and_protection(spark):
    slots = spark.createDataFrame([(1, "s", ["a"], False), (2, "s", ["a"], True)], "query_id long, slot string, values array<string>, protected boolean")
    rule = "rule_id long, query_key long, slot string, condition string, cond_arg string, operation string, arg string, priority int"
    rows = [(i, q, "s", "has_value", "a", op, arg, p) for q in (1, 2) for i, op, arg, p in ((1, "set", "b", 1), (2, "set", "c", 2), (3, "add", "d", 0))]
    got = rules.applied_rules(slots, spark.createDataFrame(rows, rule))
    assert pick(got, "query_id", "values", "applied", "conflicts") == [(1, ["c", "d"], [2, 3], [1]), (2, ["a"], [], [])]


def test_insert_if_absent_takes_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None)], "clip_id long, scene_id long")
    b = spark.createDataFrame([(1, None), (1, 2), (1, 2)], "clip_id long, scene_id long")
    assert pick(curation.insert_if_absent(a, b, ["clip_id", "scene_id"]), "clip_id", "scene_id") == [(1, 2)]


def test_metrics_keep_unanswered_queries(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    gold = spark.createDataFrame([(1, 10), (2, 20)], "query_id long, scene_id long")
    ranked = spark.createDataFrame([(1, 10, 1), (2, 5, 1)], "query_id long, scene_id long, rank int")
    row = evaluate.single_answer_metrics(q, evaluate.first_hit(gold, ranked), ranked, 10).first()
    assert (row["n_queries"], row["n_responded"], row["recall"], row["recall_responded"]) == (3, 2, 0.333333, 0.5)


def test_bad_subtitles_are_rejected(spark):
    files = spark.createDataFrame([("a", "1\n00:00:01,5 --> 00:00:02,000\n<i>x</i>\ny"), ("b", "hello"), ("c", "00:02.000 --> 00:01.000\nz")], "path string, content string")
    cues, bad = subtitles.parse_cues(files)
    assert pick(cues, "path", "start", "end", "text") == [("a", 1500, 2000, "x y")]
    assert pick(bad, "path", "reason") == [("b", "no_cue"), ("c", "bad_interval")]


def test_sinks_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id long, created_at string")
    sinks.append_log(rows, f"{tmp_path}/log")
    sinks.append_log(rows, f"{tmp_path}/log")
    sinks.write_patch(rows, f"{tmp_path}/patch", 1)
    sinks.write_report(rows, f"{tmp_path}/report")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    assert spark.read.option("header", True).csv(f"{tmp_path}/patch").count() == 2 and spark.read.json(f"{tmp_path}/report").count() == 2


def test_stream_expires_as_the_batch_does(spark, tmp_path):
    beats = spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 01:00:00"), ("z", "2024-01-01 05:00:00")], "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    beats.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = event_time.expired_stream(spark.readStream.schema(beats.schema).parquet(f"{tmp_path}/in"), 600)
    query = stream.writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = event_time.expired_batch(beats, 600, until="2024-01-01 05:00:00")
    assert pick(spark.table("expired"), "key", F.col("last_beat").cast("string")) == pick(batch, "key", F.col("last_beat").cast("string"))
