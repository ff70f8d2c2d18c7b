"""Records, sinks, streams and scalar functions on hand-written rows and against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reelstack.functions import text as tx
from reelstack.operators import archive, evaluate, observations, ranking, records, retrieval, rules, tags
from reelstack.sources import sinks, subtitles, views
from reelstack.streaming import event_time


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ascii_rows_and_others_are_normalised_alike(spark):
    df = spark.createDataFrame([(1, "Ａ Ｂ​"), (2, "a B"), (3, None), (4, "Straße")], "i long, v string")
    got = tx.normalised(df, "v", "m", "c")
    assert rows_of(got, "i", "m", "c") == [(1, "AB", "ab​"), (2, "aB", "ab"), (3, None, None), (4, "Straße", "strasse")]


def test_spans_count_code_points_and_units(spark):
    df = spark.createDataFrame([("a😀b😀", "😀", 2)], "t string, v string, at long")
    row = df.select(tx.occurrences("t", "v").alias("o"), tx.utf16_index("t", F.col("at")).alias("u"), tx.code_point_index("t", F.lit(3)).alias("p"), tx.occurrences("t", F.lit("")).alias("e")).first()
    assert (row["o"], row["u"], row["p"], row["e"]) == ([1, 3], 3, 2, [])
    odd = spark.createDataFrame([("a.b\\E.a.b", ".b\\E")], "t string, v string").select(tx.occurrences("t", "v").alias("o")).first()
    assert odd["o"] == [1]


def test_anchor_moves_to_the_nearest_match(spark):
    df = spark.createDataFrame([("ab xx ab xx ab", "ab", 7), ("ab xx ab", "ab", 3), ("ab", "zz", 0), ("ab ab", "ab", 3)], "t string, v string, c int")
    found = rules.anchored(F.col("t"), F.col("v"), F.col("c"))
    got = [tuple(r) for r in df.select(found["status"], found["start"].cast("long")).collect()]
    assert got == [("moved", 6), ("moved", 0), ("demoted", None), ("kept", 3)]


def test_phrases_are_admitted_by_covered_runs(spark):
    rng = random.Random(1)
    words = ["aa", "bb", "cc"]
    phrases = [(q, p, [[rng.choice(words) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 2))]) for q in range(4) for p in range(3)]
    values = sorted({(s, "".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for s in range(6) for _ in range(4)})

    def covers(run, held):
        return not run or any("".join(run[:n]) in held and covers(run[n:], held) for n in range(1, min(3, len(run)) + 1))

    want = {}
    for q, _, runs in phrases:
        for s in range(6):
            held = {v for t, v in values if t == s}
            if all(covers(r, held) for r in runs):
                want[q, s] = want.get((q, s), 0) + 1
    got = tags.admitted_phrases(spark.createDataFrame(phrases, "query_id long, phrase_no int, runs array<array<string>>"), spark.createDataFrame(values, "scene_id long, value string"))
    assert {(r["query_id"], r["scene_id"]): r["n"] for r in got.collect()} == want


def test_noun_runs_and_joins(spark):
    df = spark.createDataFrame([(["the", "big", "dog", "of", "town"],), ([],)], "w array<string>")
    got = [r["r"] for r in df.select(tags.noun_runs(F.col("w"), lambda w: ~w.isin("the", "of")).alias("r")).collect()]
    assert got == [[["big", "dog"], ["town"]], []]
    assert df.select(tags.run_joins(tags.noun_runs(F.col("w"), lambda w: ~w.isin("the", "of"))).alias("j")).first()["j"] == ["big", "dog", "bigdog", "town"]


def test_dates_score_but_do_not_admit(spark):
    asked = spark.createDataFrame([(1, "event", "event", "E 1", None), (1, "event", "event", "e1", None), (1, "broadcast_date", "broadcast_date", "2024-01-01", "2024-01-31")], "query_id long, axis string, tag_type string, value string, upper string")
    conditions = tags.query_conditions(asked)
    held = spark.createDataFrame([(7, "event", "E1"), (8, "broadcast_date", "2024-01-05"), (7, "broadcast_date", "2024-01-09")], "scene_id long, tag_type string, value string")
    scored = tags.structured_scores(conditions, tags.condition_matches(conditions, held), {"event": 2.0, "broadcast_date": 1.0})
    assert rows_of(scored, "scene_id", F.round("structured", 4), "admits") == [(7, 1.0, True), (8, 0.3333, False)]
    lexical = spark.createDataFrame([(1, 9, 1), (1, 8, 2)], "query_id long, scene_id long, rank int")
    assert [r[0] for r in rows_of(ranking.fuse({"lexical": lexical}, {"lexical": 1.0}, scored.where("scene_id = 8")), "scene_id")] == [8, 9]
    assert [r[0] for r in rows_of(ranking.fuse({"lexical": lexical}, {"lexical": 1.0}, scored), "scene_id")] == [7, 8, 9]


def test_exclusion_needs_all_four_keys(spark):
    schema = "query_id long, fingerprint string, normalized_query string, version string, filters string"
    searches = spark.createDataFrame([(1, "f", "q", "v1", "{}"), (2, "f", "q", "v1", None)], schema)
    rule = spark.createDataFrame([("f", "q", "v1", "{}", 5, True), ("f", "q", "v0", "{}", 6, True), ("f", "q", "v1", None, 7, True), ("f", "q", "v1", "{}", 8, False)], "fingerprint string, normalized_query string, version string, filters string, scene_id long, active boolean")
    assert rows_of(ranking.active_exclusions(searches, rule), "query_id", "scene_id") == [(1, 5), (2, 7)]


def test_unusable_vectors_match_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [1.0, 0.1])], "vec_id long, vector array<double>")
    q = v.where("vec_id <= 3").select(F.col("vec_id").alias("query_id"), "vector")
    assert rows_of(retrieval.dense_top_k(q, v, 5), "query_id", "vec_id", "rank") == [(1, 6, 1)]
    near = retrieval.dense_top_k(q, v, 5, max_distance=1e-6)
    cover = q.select("query_id").withColumn("usable", F.lit(2))
    assert rows_of(retrieval.hits_with_coverage(cover, near), "query_id", "usable", "vec_id") == [(1, 2, None), (2, 2, None), (3, 2, None)]


def test_nearest_by_partial_selection(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)] + [1.0]) for i in range(80)]
    v = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    q = v.where("vec_id % 9 = 0").withColumnRenamed("vec_id", "query_id")

    def distance(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return round(1 - dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5), 9)

    want = sorted((a, b, n + 1) for a, x in rows if a % 9 == 0 for n, (_, b) in enumerate(sorted((distance(x, y), b) for b, y in rows if b != a)[:7]))
    assert rows_of(retrieval.dense_top_k(q, v, 7, block=4), "query_id", "vec_id", "rank") == want


def test_gold_finds_passages_that_begin_inside_words(spark, tmp_path):
    docs = [(1, "xthe long winding roady"), (2, "the long winding road"), (3, "the long road"), (4, "ab"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, "the long winding road"), (8, "b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows_of(views.gold(spark, str(tmp_path)), "query_id", "scene_id") == [(8, 4), (9, 1), (9, 2)]


def test_rules_are_retired_and_requests_taken_once(spark):
    cols = "rule_id long, report_id long, request_key string, replaces long, scene_id long"
    active = spark.createDataFrame([(1, 1, "a", None, 5), (2, 1, None, None, 6), (3, 2, "a", None, 7)], cols)
    new = spark.createDataFrame([(10, 1, "a", 2, 1), (11, 1, "b", 2, 2), (12, 1, "b", 3, 3), (13, 2, None, 3, 4), (14, 2, None, None, 4)], cols)
    assert [r[0] for r in rows_of(archive.revised_rules(active, new), "rule_id")] == [1, 11, 13, 14]


def test_bulk_update_touches_what_it_names(spark):
    rows = spark.createDataFrame([(1, 7, "u"), (2, 8, "u"), (3, None, "u")], "id long, k long, status string")
    got = archive.updated(rows, spark.createDataFrame([(7,), (7,)], "k long"), "k", F.col("status") == "u", status=F.lit("v"))
    assert rows_of(got, "id", "k", "status") == [(1, 7, "v"), (2, 8, "u"), (3, None, "u")]


def test_partition_faults_are_counted(spark):
    rows = [(1, 10, 1, 1, 0.9), (2, 10, 1, 1, 0.5), (3, 11, 2, 3, 0.1), (3, 12, 2, 3, 0.1), (4, 11, 3, 3, 0.8)]
    got = observations.partition_faults(spark.createDataFrame(rows, "obs_id long, group_id long, frame long, representative long, confidence double"))
    assert rows_of(got, "fault", "n") == [("frame_twice", 1), ("in_many_groups", 1), ("weak_representative", 1)]


def test_case_states(spark):
    df = spark.createDataFrame([("abcd", "abcx", "abcd"), ("abcd", "abcx", "abcx"), ("abcd", "abcx", "abyd"), ("abcd", "abcx", "zz"), ("abcd", "abcx", None)], "e string, r string, b string")
    got = [r[0] for r in df.select(observations.case_status(F.col("e"), F.col("r"), F.col("b"))).collect()]
    assert got == ["fixed", "reproduced", "changed", "absent", "absent"]


def test_bootstrap_of_a_constant_difference(spark):
    rows = spark.createDataFrame([(i, 1.0, 1.5) for i in range(20)], "id long, a double, b double")
    row = evaluate.paired_bootstrap(rows, "id", "a", "b", 200).first()
    assert (row["low"], row["high"], row["wins"], row["mean_diff"]) == (0.5, 0.5, 20, 0.5)
    mixed = spark.createDataFrame([(i, 0.0, float(i % 2)) for i in range(200)], "id long, a double, b double")
    row = evaluate.paired_bootstrap(mixed, "id", "a", "b", 500).first()
    assert row["low"] == pytest.approx(0.43, abs=0.03) and row["high"] == pytest.approx(0.57, abs=0.03)


def test_runs_without_stages_are_legacy(spark):
    done = {"s1": {"status": "done", "attempts": 1, "started": "2024-01-01 00:00:00", "finished": "2024-01-01 00:01:00"}, "s2": {"status": "failed", "error": "boom"}}
    runs = spark.createDataFrame([(1, json.dumps(done)), (2, None), (3, "[1]"), (4, "{}")], "run long, states string")
    got = records.availability(records.stage_states(runs, "run", "states"), "run", ["s1", "s2"], {"s1": "caption", "s2": "dialogue"})
    assert rows_of(got, "run", "availability", "failed", "missing_channels", "seconds", "reason") == [(1, "partial", "s2", "dialogue", 60, "boom"), *[(i, "legacy", "", "caption,dialogue", None, None) for i in (2, 3, 4)]]


def test_logged_searches_are_replaced_by_a_rerun(spark, tmp_path):
    searches = spark.createDataFrame([(1, "q"), (2, "r")], "search_id long, query string")
    results = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (9, 7, 1)], "search_id long, scene_id long, rank int")
    for batch in ("a", "b", "a"):
        sinks.write_searches(searches, results, f"{tmp_path}/log", batch)
    back = spark.read.parquet(f"{tmp_path}/log/results")
    assert rows_of(back, "batch", "search_id", "rank") == [("a", 1, 1), ("a", 1, 2), ("b", 1, 1), ("b", 1, 2)]
    assert spark.read.parquet(f"{tmp_path}/log/searches").count() == 4


def test_retokenized_patch_of_a_csv_export(spark, tmp_path):
    spark.createDataFrame([(1, 'A "b",\nc', "a b c"), (2, "D e", "d"), (3, None, None)], "id long, text string, tokens string").write.option("header", True).option("escape", '"').csv(f"{tmp_path}/in")
    sinks.retokenize(spark, f"{tmp_path}/in", f"{tmp_path}/out", 1)
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/out").collect()] == [("2", "d e")]


def test_json_subtitles_and_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    (tmp_path / "s" / "b.json").write_text('[{"start": 5, "end": 9, "text": " two\\n lines "}, {"start": 1, "end": 2, "text": "one"}]')
    (tmp_path / "s" / "c.json").write_text('[{"start": 5, "end": 5, "text": "x"}]')
    (tmp_path / "s" / "d.json").write_text("[")
    cues, bad = subtitles.cue_rows(subtitles.read_files(spark, f"{tmp_path}/s"))
    name = F.element_at(F.split("path", "/"), -1)
    assert rows_of(cues, name, "cue_no", "start", "text") == [("a.srt", 0, 1000, "hi"), ("b.json", 0, 1, "one"), ("b.json", 1, 5, "two lines")]
    assert rows_of(bad, name, "reason") == [("c.json", "bad_interval"), ("d.json", "no_cue")]


def test_index_and_strict_readers(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"id": 1, "category": "a", "text": "x"}\n{"id": 2, "category": "b", "text": "y"}\n{"category": "a"}\n{"id": "z", "text": "q"}\n')
    schema, path = "id bigint, category string, text string", f"{tmp_path}/i.jsonl"
    assert rows_of(views.load_index(spark, path, schema, category="a"), "id") == [(1,)]
    assert rows_of(views.load_index(spark, path, schema, wanted=spark.createDataFrame([(2,), (7,)], "id long")), "id") == [(2,)]
    good, bad = views.read_strict(spark, path, schema, ["id", "text"])
    assert rows_of(good, "id", "text") == [(1, "x"), (2, "y")]
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed", "missing:id,text"]


def test_histogram_stream_agrees_with_its_batch_twin(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", p, float(h + m)) for h in range(3) for m in range(0, 60, 20) for p in ("a", "b")]
    reqs = spark.createDataFrame(rows, "ts string, path string, duration double").withColumn("ts", F.col("ts").cast("timestamp"))
    late = spark.createDataFrame([("2024-01-02 00:00:00", "z", 0.0)], "ts string, path string, duration double").withColumn("ts", F.col("ts").cast("timestamp"))
    reqs.union(late).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = event_time.latency_histogram(spark.readStream.schema(reqs.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("latency").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    # the last row moves the watermark past all other windows
    assert rows_of(spark.table("latency"), "hour", "path", "n", "mean", "most") == rows_of(event_time.latency_histogram(reqs, None), "hour", "path", "n", "mean", "most")
