"""Operators that were reworked for size, against plain Python."""

import difflib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelstack.functions.text import tokens
from reelstack.operators import dictionary, evaluate, intervals, observations, prepare, ranking, retrieval, tags, topk


def words(rng, n):
    return [rng.choice(["the", "a", "of", "red", "old", "sea", "ship", "bird", "town", "Ünal", "42"]) if rng.random() < 0.8 else f"w{rng.randrange(30)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(words(rng, rng.randrange(12))), "\n".join(" ".join(words(rng, rng.randrange(9))) for _ in range(rng.randrange(5)))) for i in range(150)] + [(900, None, "red sea"), (901, "", "")]
    queries = [(q, list(dict.fromkeys(w.lower() for w in words(rng, 6)))) for q in range(12)] + [(50, ["absent"]), (51, ["red"])]
    return spark.createDataFrame(docs, "scene_id long, caption string, transcript string"), spark.createDataFrame(queries, "query_id long, terms array<string>")


def test_best_scores_equal_all_scores(spark, corpus, monkeypatch):
    docs, queries = corpus
    fields = {"caption": tokens("caption"), "transcript": tokens("transcript")}
    want = defaultdict(dict)
    for r in retrieval.bm25(queries, docs, "scene_id", fields, {}).collect():
        want[r["query_id"]][r["scene_id"]] = r["raw_score"]
    monkeypatch.setattr(topk, "SLICE_ROWS", 2)  # thresholds from slices, and terms left out by their bounds
    monkeypatch.setattr(topk, "BLOCK_DOCS", 16)
    monkeypatch.setattr(topk, "BLOCK_CELLS", 64)
    for k in (1, 7, 400):
        found = topk.best(queries, docs, "scene_id", F.array(*fields.values()), k)
        got = retrieval.top_k(found.select("query_id", "scene_id", F.round("score", 9).alias("s")), k, F.desc("s"), F.col("scene_id")).collect()
        order = {q: sorted(s, key=lambda d: (-s[d], d))[:k] for q, s in want.items()}
        assert {(r["query_id"], r["scene_id"], r["rank"]) for r in got} == {(q, d, n) for q, ds in order.items() for n, d in enumerate(ds, 1)}
        assert all(abs(r["s"] - want[r["query_id"]][r["scene_id"]]) < 1e-8 for r in got)
    assert topk.best(queries.where("false"), docs, "scene_id", F.array(*fields.values()), 3).count() == 0
    assert topk.best(queries, docs.where("false"), "scene_id", F.array(*fields.values()), 3).count() == 0
    monkeypatch.setattr(topk.asked, "__defaults__", (3,))
    assert topk.best(queries, docs, "scene_id", F.array(*fields.values()), 3) is None


def test_best_parts_equal_joins(spark, corpus, monkeypatch):
    from reelstack.plans import search

    docs, queries = corpus
    docs = docs.na.fill("")
    lines = F.split(F.concat_ws("\n", "caption", "transcript"), "\n")
    rows = lambda df: {(r["query_id"], r["scene_id"]): (r["matched"], round(r["raw_score"], 7), round(r["rank_score"], 7)) for r in df.collect()}
    want = rows(search.by_joins(queries, docs, lines))
    monkeypatch.setattr(topk, "SLICE_ROWS", 2)
    for k in (5, 400):
        got = rows(search.by_parts(topk.best(queries, docs, "scene_id", F.transform(lines, tokens), k, with_parts=True), queries))
        assert got.items() <= want.items()
        for q in {q for q, _ in want}:
            best = sorted(((-v[2], -v[1], d) for (p, d), v in want.items() if p == q))[:k]
            assert all((q, d) in got for _, _, d in best)


def test_best_phrases_equal_all_phrases(spark, corpus, monkeypatch):
    docs, queries = corpus
    asked = queries.select("query_id", F.transform(F.sequence(F.lit(1), F.greatest(F.size("terms") - 1, F.lit(1))), lambda i: F.slice("terms", i, 2)).alias("phrases"))
    fields = {"caption": tokens("caption"), "transcript": tokens("transcript")}
    want = {(r["query_id"], r["scene_id"]): (r["phrase_score"], r["n_phrases"]) for r in retrieval.phrase_scores(asked, docs, "scene_id", fields).collect()}
    monkeypatch.setattr(topk, "SLICE_ROWS", 2)
    monkeypatch.setattr(topk, "BLOCK_DOCS", 16)
    monkeypatch.setattr(topk, "BLOCK_CELLS", 64)
    for k in (3, 400):
        got = {(r["query_id"], r["scene_id"]): (r["score"] * 0.3, r["n_phrases"]) for r in topk.best_phrases(asked, docs, "scene_id", F.array(*fields.values()), k).collect()}
        assert all(abs(s - want[key][0]) < 1e-8 and n == want[key][1] for key, (s, n) in got.items())
        for q in {q for q, _ in want}:
            order = sorted((-s, d) for (p, d), (s, _) in want.items() if p == q)
            assert all((q, d) in got for _, d in order[:k])


def test_pages_by_heads_equal_pages_of_all(spark):
    rng = random.Random(5)
    rows = [(q, s, rng.randrange(5) / 10, rng.randrange(4) / 4) for q in range(4) for s in range(60)]
    out = [(q, s) for q, s, *_ in rows if q == 0 and s < 58 or rng.random() < 0.3] + [(9, 9)]
    df = spark.createDataFrame(rows, "query_id long, scene_id long, base_score double, soft_score double")
    gone = spark.createDataFrame(out, "query_id long, scene_id long")
    for number in (1, 2, 7):
        want = set()
        for q in range(4):
            order = sorted((r for r in rows if r[0] == q), key=lambda r: (-math.floor(r[2] / 0.1), -r[3], r[1]))
            total, valid = sum((q, r[1]) not in out for r in order), 0
            for n, r in enumerate(order, 1):
                hit = (q, r[1]) in out
                valid += not hit
                if (not hit and 10 * (number - 1) < valid <= 10 * number) or (hit and 10 * (number - 1) <= valid < 10 * number):
                    want.add((q, r[1], n, "excluded" if hit else "shown", total > 10 * number))
        got = ranking.page(df, gone, number, 10, order=ranking.final_key(0.1))
        assert {tuple(r) for r in got.collect()} == want
    treat = lambda x: x.where("scene_id % 7 <> 0")
    deep = ranking.deep_enough(df, treat, 40, ranking.final_order(0.1), depth=45)
    assert {r[0] for r in deep.groupBy("query_id").count().where("count >= 40").collect()} == {0, 1, 2, 3}


def test_no_day_has_no_season(spark):
    from reelstack.plans.ranking import SEASONS, _pick

    df = spark.createDataFrame([(None,), (0,), (7,)], "n int")
    assert [r[0] for r in df.select(_pick(SEASONS, F.col("n"))).collect()] == [None, "winter", "autumn"]
    assert [r[0] for r in df.select(F.coalesce(_pick(SEASONS, F.col("n")) == "autumn", F.lit(False))).collect()] == [False, False, True]


def test_overlaps_of_mixed_lengths(spark):
    rng = random.Random(1)
    some = lambda n: [(rng.randrange(3), i, s := rng.randrange(0, 90_000_000), s + rng.choice([0, 1, 500, 1000, 1001, 60_000, 86_400_000])) for i in range(n)]
    left, right = some(60), some(60)
    got = intervals.overlaps(spark.createDataFrame(left, "clip_id long, a long, start long, end long"), spark.createDataFrame(right, "clip_id long, b long, r_start long, r_end long"))
    want = {(x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in left for y in right if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3])}
    rows = [(r["a"], r["b"], r["overlap_ms"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_thinning_follows_the_fold(spark):
    rng = random.Random(2)
    points = [(c, rng.randrange(-50, 3000)) for c in range(6) for _ in range(rng.randrange(120))] + [(0, None), (77, 5)]
    spans = [(c, rng.choice([0, 1, 700, 2500])) for c in range(6)] + [(8, 100)]
    got = intervals.thinned_starts(spark.createDataFrame(points, "clip_id long, at long"), spark.createDataFrame(spans, "clip_id long, duration long"), 90)
    want = set()
    for c, d in spans:
        kept = [0]
        for b in sorted({b for k, b in points if k == c and b is not None and 0 < b < d}):
            if b - kept[-1] >= 90:
                kept.append(b)
        want |= {(c, b) for b in (kept[:-1] if len(kept) > 1 and d - kept[-1] < 90 else kept)}
    rows = [tuple(r) for r in got.select("clip_id", "at").collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("fps", [25.0, 29.97, 30.0])
def test_frames_lie_inside_their_range(spark, fps):
    spans = [(s, s + n) for s in range(0, 1000, 11) for n in (1, 10, 34, 500)]
    got = spark.createDataFrame(spans, "a long, b long").select("a", "b", *[c.alias(n) for n, c in zip("fl", intervals.frame_range(F.col("a"), F.col("b"), fps), strict=True)]).collect()
    for r in got:
        inside = [f for f in range(60) if r["a"] <= round(f * 1000 / fps) < r["b"]]
        assert (r["f"], r["l"]) == ((inside[0], inside[-1]) if inside else (None, None))


def test_differing_frames():
    blank = np.array([False, True, False, False, False])
    x = np.array([0.0, 255.0, 1.0, 60.0, 61.0])
    d = np.abs(x[:, None] - x[None])
    assert list(prepare.differing(d, blank, 27.0, 5, 2)) == [2, 3]
    assert list(prepare.differing(d * 0, blank, 27.0, 5, 2)) == [0, 2]  # filled up with the earliest that is not blank
    assert list(prepare.differing(d, ~np.zeros(5, bool), 27.0, 5, 2)) == [1, 2]  # all blank: the middle, then the farthest
    assert list(prepare.differing(np.full((5, 5), np.nan), blank, 27.0, 5, 2)) == [0, 1, 2, 3, 4]
    y = np.array([0.0, 100.0, 200.0, 300.0, 400.0])
    assert list(prepare.differing(np.abs(y[:, None] - y[None]), np.zeros(5, bool), 27.0, 3, 2)) == [0, 2, 4]
    assert list(prepare.differing(d[:1, :1], blank[1:2], 27.0, 5, 2)) == [0]


def test_similar_lines_and_their_bounds():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcde fg") for _ in range(rng.randrange(1, 40))) for _ in range(25)]
    texts = list(dict.fromkeys(base + [t[:k] + "x" + t[k + 1 :] for t in base for k in (0, len(t) // 2)] + ["", "é", "abc 1", "abc 2", "abc 1!"]))
    got = observations._ratios(texts, 0.8)
    for a, b in itertools.combinations(texts, 2):
        ratio = observations.block_ratio(a, b)
        near = bool(a and b) and ratio >= 0.8 and observations._shape(a) == observations._shape(b)
        assert (b in got[a]) == near == (a in got[b])
        blocks = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert blocks <= observations.longest_subsequence(a, b) <= min(len(a), len(b))


def test_replay_of_merging_is_equal(spark):
    rng = random.Random(6)
    rows = [(s, f, s * 1000 + f * 10 + k, "".join(rng.choice("ab ") for _ in range(6)) + "line", rng.random()) for s in range(3) for f in range(6) for k in range(2)]
    seen = spark.createDataFrame(rows, "scene_id long, frame long, obs_id long, raw_text string, confidence double")
    once = {tuple(r) for r in observations.merged_at(seen).collect()}
    assert once == {tuple(r) for r in observations.merged_at(seen.repartition(3, "obs_id").orderBy(F.desc("obs_id"))).collect()}
    kept = observations.originals_kept(seen, observations.merged_at(seen)).collect()
    assert len(kept) == 5 and all(r["originals_kept"] for r in kept)
    lost = observations.originals_kept(seen, observations.merged_at(seen).where("obs_id <> 1010")).collect()
    assert not any(r["originals_kept"] for r in lost)


def test_false_merges_are_a_share_of_merges(spark):
    pairs = spark.createDataFrame([(1, 2, True), (1, 3, False), (4, 5, False), (4, 6, True)], "left_id long, right_id long, same boolean")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)], "obs_id long, group_id long")
    r = observations.pair_confusion(pairs, groups).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["false_merge_rate"], r["miss_rate"]) == (1, 1, 1, 1, 0.5, 0.5)


def test_conditions_by_dictionary(spark):
    asked = [(1, "event", "event", "Ｅ 1", None, False), (1, "event", "event", "E1", None, False), (1, "event", "event", "e1", None, False), (2, "event", "event", "E1", None, True), (2, "date", "date", "2024-01-01", "2024-01-31", False), (3, "event", "event", " ", None, False)]
    conditions = tags.query_conditions(spark.createDataFrame(asked, "query_id long, axis string, tag_type string, value string, upper string, caseless boolean"))
    assert {(r["query_id"], r["kind"], r["value"]) for r in conditions.collect()} == {(1, "exact", "E1"), (1, "exact", "e1"), (2, "caseless", "e1"), (2, "range", "2024-01-01")}
    held = spark.createDataFrame([(7, "event", "E​1"), (8, "event", "e 1"), (9, "date", "2024-01-31"), (9, "date", "2024-02-01"), (9, "event", None)], "scene_id long, tag_type string, value string")
    met = {(r["query_id"], r["condition_id"].split("|")[2], r["scene_id"]) for r in tags.condition_matches(conditions, held).collect()}
    assert met == {(1, "E1", 7), (1, "e1", 8), (2, "e1", 7), (2, "e1", 8), (2, "2024-01-01", 9)}


def test_words_and_synonyms_by_dictionary(spark):
    rows = spark.createDataFrame([(1, ["Straße", "the", "STRASSE", "ﬁn"]), (2, []), (3, None)], "id long, words array<string>")
    aliases = spark.createDataFrame([("fin", "end")], "form string, canonical string")
    got = {r["id"]: r["normalised"] for r in dictionary.normalised_words(rows, ["id"], "words", aliases, ["the"]).collect()}
    assert got == {1: ["end", "strasse"], 2: [], 3: []}
    queries = spark.createDataFrame([(1, ["red", "car"]), (2, ["blue"])], "query_id long, terms array<string>")
    groups = spark.createDataFrame([("g1", "red"), ("g1", "crimson"), ("g2", "car"), ("g2", "auto"), ("g2", "red")], "group_id string, word string")
    assert {r["query_id"]: r["terms"] for r in dictionary.with_synonyms(queries, groups).collect()} == {1: ["red", "car", "crimson", "auto"], 2: ["blue"]}


def test_bootstrap_by_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random()) for i in range(300)] + [(None, 0.1, 0.2)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    r = evaluate.paired_bootstrap(df, "id", "a", "b", 400).first()
    assert r == evaluate.paired_bootstrap(df.repartition(5), "id", "a", "b", 400).first()
    d = np.array([b - a for i, a, b in rows if i is not None])
    spread = d.std() / math.sqrt(len(d))
    assert r["n"] == 301 and abs(r["low"] - (d.mean() - 1.96 * spread)) < 0.5 * spread and abs(r["high"] - (d.mean() + 1.96 * spread)) < 0.5 * spread
    times = evaluate.drawn(np.arange(2000, dtype=np.uint64) * 2654435761 % 2**32, np.arange(2000, dtype=np.uint64) * 40503 % 2**32, 50)
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.05


def test_relevance_by_label_counts(spark):
    docs = spark.createDataFrame([(i, i % 3) for i in range(30)], "vec_id long, label long")
    queries = docs.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "label")
    ranked = spark.createDataFrame([(q, d, n) for q in (0, 10, 20) for n, d in enumerate(((q + 1) % 30, (q + 3) % 30, (q + 6) % 30), 1)], "query_id long, vec_id long, rank int")
    pairs = queries.join(docs, "label").where("vec_id <> query_id").select("query_id", "vec_id")
    want = Counter(map(tuple, evaluate.multi_answer_metrics(pairs, ranked, 3, "vec_id").collect()))
    assert Counter(map(tuple, evaluate.label_metrics(queries, docs, ranked, 3, "vec_id").collect())) == want
