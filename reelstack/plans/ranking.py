"""Registered queries: eligibility, tags, fusion, soft order, guard, paging, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelstack.functions import text as tx
from reelstack.operators import dictionary as dic
from reelstack.operators import ranking as rk
from reelstack.operators import retrieval as rt
from reelstack.operators import rules as rl
from reelstack.operators import tags as tg
from reelstack.operators.tables import cut, small
from reelstack.plans import search, sql
from reelstack.sources import views

WEIGHTS = {"lexical": 1.0, "dense": 1.0}


def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each wanted scene id with whether it may be shown, and if not, why; a deleted clip outweighs a retired run."""
    scene = views.scenes(spark, sf_dir)
    wanted = views.table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("scene_id")).distinct()
    live = scene.select("scene_id", "clip_id", "run_id").join(views.clips(scene), "clip_id")
    found = wanted.join(live, "scene_id", "left")
    reason = F.when(F.col("clip_id").isNull(), "not_found").when(F.col("deleted_at").isNotNull(), "deleted").when(F.col("run_id") != F.col("active_run_id"), "inactive_run").otherwise("eligible")
    return found.select("scene_id", reason.alias("state"))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence on tags of scenes and clips."""
    e = views.table(spark, sf_dir, "events")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    scoped = F.col("event_id") % 2 == 0
    source = pick(5, "model", "reviewer", "user_input", "asr", "ocr")
    # a reviewer's judgement of its own statuses, the others verified or not
    status = F.when(source == "reviewer", pick(3, "verified", "rejected", "withdrawn")).otherwise(pick(3, "verified", "unverified", "verified"))
    return e.where("user_id is not null").select(
        F.when(scoped, F.col("user_id")).alias("scene_id"),
        F.floor(F.col("user_id") / 10).alias("clip_id"),
        F.col("event_type").alias("tag"),
        source.alias("source"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("evidence_id"),
    )


def held_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.effective_tags(tg.inherited(judgements(spark, sf_dir), views.scenes(spark, sf_dir)))


def effective_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_tags(spark, sf_dir)


EVENTS = ["click", "view", "purchase", "signup", "search"]
LANGS = ["en", "de", "fr", "es"]
SHOTS = ["b_roll", "anchor", "field"]
AXES = {"event": 2.0, "person": 2.0, "organization": 1.0, "location": 1.0, "facility": 1.0, "scene_type": 0.5, "broadcast_date": 1.0, "filmed_date": 1.0}


def _pick(values: list[str], ident):
    """The value that a number stands for; null for null."""
    return F.get(F.array(*map(F.lit, values)), (ident % len(values)).cast("int"))


def wide_letters(value):
    """The value in full-width small letters, another writing of the same."""
    small_letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(value, small_letters, "".join(chr(ord(c) + 0xFEE0) for c in small_letters))


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each query asks for on the eight axes; some values are given twice in different writing, some are of types that no scene has, and organisations may differ in case."""
    q = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    i, text = F.col("query_id"), lambda c: c.cast("string")
    place = F.concat(F.lit("src"), text(i % 20), F.lit("-"), text(i % 50))
    last = tx.last_day_text(F.add_months(F.to_date(month(i)), 1))
    struct = lambda axis, value, upper, caseless: F.struct(F.lit(axis).alias("axis"), F.lit(axis).alias("tag_type"), value.alias("value"), upper.alias("upper"), F.lit(caseless).alias("caseless"))
    plain = lambda axis, value, when=F.lit(True), caseless=False: F.when(when, struct(axis, value, F.lit(None).cast("string"), caseless))
    dates = lambda axis, when: F.when(when, struct(axis, month(i), last, False))
    rows = F.array(
        plain("event", _pick(EVENTS, i)),
        plain("event", wide_letters(_pick(EVENTS, i))),
        plain("event", F.concat(F.lit(" "), _pick(EVENTS, i + 1))),
        plain("person", F.concat(F.lit("user"), text(i)), i % 5 == 0),
        plain("organization", F.concat(_pick(LANGS, i), F.lit("-"), text(i % 20)), i % 2 == 0, True),
        plain("location", place, i % 3 == 0),
        plain("location", wide_letters(place), i % 3 == 0),
        plain("facility", place, i % 3 == 0),
        plain("scene_type", F.concat(_pick(SHOTS, i), F.lit("-"), text(i % 40)), i % 4 == 0),
        plain("scene_type", F.lit(" "), i % 4 == 1),
        dates("broadcast_date", F.lit(True)),
        dates("filmed_date", i % 2 == 1),
    )
    return q.select("query_id", F.explode(F.array_compact(rows)).alias("c")).select("query_id", "c.*")


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.query_conditions(resolutions(spark, sf_dir))


def month(ident) -> object:
    """First day, as text, of the month that a number stands for."""
    return F.date_format(F.add_months(F.to_date(F.lit("1995-01-01")), (ident % 12).cast("int")), "yyyy-MM-dd")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as broadcast and filmed dates of scenes; every third is not trusted."""
    field = F.when(F.col("o_orderkey") % 2 == 0, "broadcast").otherwise("filmed")
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("long").alias("scene_id"), field.alias("field"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"), (F.col("o_orderkey") % 3 != 0).alias("trusted")
    )


def all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, tag_type, value) of the scenes' tags of all types."""
    events = held_tags(spark, sf_dir).select("scene_id", F.lit("event").alias("tag_type"), F.col("tag").alias("value"))
    s, part = views.scenes(spark, sf_dir), lambda n, c: (F.col(c) % n).cast("string")
    own = F.array(
        F.struct(F.lit("organization").alias("tag_type"), F.concat_ws("-", F.upper("lang"), part(20, "clip_id")).alias("value")),
        F.struct(F.lit("location").alias("tag_type"), F.concat_ws("-", "source", part(50, "clip_id")).alias("value")),
        F.struct(F.lit("scene_type").alias("tag_type"), F.concat_ws("-", "shot_type", part(40, "scene_id")).alias("value")),
    )
    made = s.select("scene_id", F.explode(own).alias("t")).select("scene_id", "t.*")
    dates = dated(spark, sf_dir).select("scene_id", F.concat("field", F.lit("_date")).alias("tag_type"), "value").distinct()
    return events.unionByName(made).unionByName(dates)


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = conditions(spark, sf_dir)
    live = search.eligible_scenes(spark, sf_dir).select("scene_id")
    scored = tg.structured_scores(asked, tg.condition_matches(asked, all_tags(spark, sf_dir)), AXES)
    return scored.join(live, "scene_id", "left_semi")


def structured_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured(spark, sf_dir).select("query_id", "scene_id", F.round("structured", 6).alias("structured"), "admits")


NOUN = 4
STOP = ["the", "de"]


def query_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, runs): runs of neighbouring words of four letters or more stand for noun runs."""
    q = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.tokens("text").alias("words"))
    return q.select("query_id", "words", tg.noun_runs(F.col("words"), lambda w: F.length(w) >= NOUN).alias("runs"))


def keyword_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonus of scenes whose caption words are keyword conditions of a query: joins of its noun runs, then its other words."""
    q = query_runs(spark, sf_dir).select("query_id", tg.keyword_conditions(F.col("runs"), F.array_distinct("words"), STOP).alias("wanted"))
    asked = q.select("query_id", F.size("wanted").alias("requested"), F.explode("wanted").alias("word"))
    words = search.eligible_scenes(spark, sf_dir).select("scene_id", F.explode(F.array_distinct(tx.tokens("caption"))).alias("word"))
    found = words.join(small(asked), "word").groupBy("query_id", "scene_id", "requested").agg(F.count("*").alias("matched"))
    return found.select("query_id", "scene_id", "matched", F.round(tg.keyword_bonus(F.col("matched"), F.col("requested")), 6).alias("bonus"))


def phrase_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes whose caption words, as keyword tags, cover every noun run of a phrase; a passage's noun runs of up to three words, two at a time, are its phrases (segmentation, rows only)."""
    short = query_runs(spark, sf_dir).select("query_id", F.filter("runs", lambda r: F.size(r) <= 3).alias("runs"))
    pairs = short.select("query_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("runs") - 1, F.lit(1))), lambda i: F.slice("runs", i, 2))).alias("phrase_no", "runs"))
    caption = search.eligible_scenes(spark, sf_dir).select("scene_id", tx.tokens("caption").alias("w"))
    values = caption.select("scene_id", F.explode(F.array_distinct(F.concat("w", tx.ngram_join(F.col("w"), 2)))).alias("value"))
    return tg.admitted_phrases(pairs, values)


def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.to_date(month(F.col("item_id")))
    return views.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("broadcast").alias("field"), start.alias("start"), F.add_months(start, 36).alias("end_exclusive"), (F.col("item_id") % 4 != 3).alias("stated")
    )


def date_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.date_guard(search.lexical(spark, sf_dir), date_windows(spark, sf_dir), dated(spark, sf_dir))


def dense_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector neighbours among the scenes that may be shown, for the queries that have a vector."""
    queries, vec = search.vectors(spark, sf_dir)
    live = search.eligible_scenes(spark, sf_dir).select(F.col("scene_id").alias("vec_id"))
    near = rt.dense_top_k(queries, vec.join(live, "vec_id", "left_semi"), 200, max_distance=search.MAX_DISTANCE)
    return near.select((F.col("query_id") / 20).cast("long").alias("query_id"), F.col("vec_id").alias("scene_id"), "rank")


def fused(spark: SparkSession, sf_dir: str, lexical: DataFrame | None = None) -> DataFrame:
    """Both channels' pools of 200 and what tags admit, with the structured score of all of them."""
    lexical = search.lexical(spark, sf_dir) if lexical is None else lexical
    return rk.fuse({"lexical": lexical, "dense": dense_channel(spark, sf_dir)}, WEIGHTS, structured(spark, sf_dir))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rt.top_k(fused(spark, sf_dir), 200, F.desc("base_score"), F.col("scene_id"))
    return ranked.select("query_id", "scene_id", "lexical_rank", "dense_rank", F.round("base_score", 6).alias("base_score"), "rank")


SEASONS = ["winter", "spring", "summer", "autumn"]
WEATHER = ["rain", "sun", "snow"]


def soft_ordered(spark: SparkSession, sf_dir: str, lexical: DataFrame | None = None) -> DataFrame:
    """(query_id, scene_id, base_score, soft_score) of all candidates, materialised: recency for every second query, b-roll always, season and weather where asked for."""
    day = dated(spark, sf_dir).groupBy("scene_id").agg(F.max("value").alias("day"))
    shot = views.scenes(spark, sf_dir).select("scene_id", "shot_type")
    rows = fused(spark, sf_dir, lexical).select("query_id", "scene_id", "base_score").join(day, "scene_id", "left").join(shot, "scene_id", "left")
    rows = rk.with_span(cut(rows.withColumn("day", F.to_date("day"))), F.col("day"))
    one = lambda hit: F.when(hit, 1.0).otherwise(0.0)
    q, season = F.col("query_id"), _pick(SEASONS, F.floor(F.month("day") % 12 / 3))
    signals = {
        "recency": (rk.recency(F.col("day"), F.col("first_day"), F.col("last_day")), q % 2 == 0, 1.0),
        "b_roll": (one(F.col("shot_type") == "b_roll"), F.lit(True), 0.5),
        "season": (one(season == _pick(SEASONS, q)), q % 3 == 1, 0.3),
        "weather": (one(_pick(WEATHER, F.col("scene_id")) == _pick(WEATHER, q)), q % 5 == 2, 0.2),
    }
    return cut(rows.select("query_id", "scene_id", "base_score", F.round(rk.soft_score(signals), 9).alias("soft_score")))


EPSILON = 0.01


def soft_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = rk.head(soft_ordered(spark, sf_dir), 200, rk.final_order(EPSILON))
    return first.select("query_id", "scene_id", F.round("soft_score", 6).alias("soft_score"), "rank")


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query with the four keys by which rules are found: fingerprint, normalised query, version, canonical filters."""
    q = views.search_queries(spark, sf_dir).select("query_id", F.array_join(F.array_sort("terms"), " ").alias("normalized_query"))
    filters = F.to_json(tx.canonical_filters(F.create_map(F.lit("month"), F.array(month(F.col("query_id")), F.lit(" ")), F.lit("none"), F.array(F.lit("")))))
    q = q.withColumns({"filters": filters, "version": F.lit("v1")})
    return q.withColumn("fingerprint", tx.fingerprint("normalized_query", "filters"))


def exclusion_rules(spark: SparkSession, sf_dir: str, lexical: DataFrame) -> DataFrame:
    """Rules that reviewers made: scenes by number, and shown ones; rules of every fifth query are of an old version, every eleventh scene's are retired."""
    by_number = views.scenes(spark, sf_dir).where("scene_id % 7 = 0").select("scene_id", (F.col("scene_id") % 50).alias("query_id"))
    shown = lexical.where("rank <= 5 and scene_id % 3 = 0").select("scene_id", "query_id")
    made = by_number.unionByName(shown).join(searches(spark, sf_dir), "query_id")
    version = F.when(F.col("query_id") % 5 == 0, "v0").otherwise(F.col("version"))
    return made.select("fingerprint", "normalized_query", version.alias("version"), "filters", "scene_id", (F.col("scene_id") % 11 != 0).alias("active"))


def exclusions(spark: SparkSession, sf_dir: str, lexical: DataFrame | None = None) -> DataFrame:
    """(query_id, scene_id) that rules leave out."""
    lexical = search.lexical(spark, sf_dir) if lexical is None else lexical
    return rk.active_exclusions(searches(spark, sf_dir), exclusion_rules(spark, sf_dir, lexical))


def page_with_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = cut(search.lexical(spark, sf_dir))
    return rk.page(soft_ordered(spark, sf_dir, lexical), exclusions(spark, sf_dir, lexical), 1, 10, order=rk.final_key(EPSILON))


def judged_dates(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return rk.date_guard(rows, date_windows(spark, sf_dir), dated(spark, sf_dir))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: two pools of 200, tags, fusion, soft order, date guard, exclusions by four keys, first page."""
    lexical = cut(search.lexical(spark, sf_dir))
    out = cut(exclusions(spark, sf_dir, lexical))
    treat = lambda rows: rk.marked(rk.without_conflicts(rows, judged_dates(spark, sf_dir, rows)), out)
    kept = rk.deep_enough(soft_ordered(spark, sf_dir, lexical), treat, 11, rk.final_order(EPSILON))
    return rk.page(kept, None, 1, 10, order=rk.final_key(EPSILON))


def replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of each query under the current rules, and with the candidate rules (exclusions and guard), side by side."""
    lexical = cut(search.lexical(spark, sf_dir))
    ordered = soft_ordered(spark, sf_dir, lexical)
    out = cut(exclusions(spark, sf_dir, lexical))
    treat = lambda rows: rk.without_conflicts(rows, judged_dates(spark, sf_dir, rows)).join(out, ["query_id", "scene_id"], "left_anti")
    first = lambda rows: rk.head(rows, 10, rk.final_order(EPSILON)).select("query_id", "scene_id", "rank")
    control = cut(first(ordered))
    guarded = judged_dates(spark, sf_dir, control).where("judgement = 'conflict'")
    treated = rk.deep_enough(ordered, treat, 10, rk.final_order(EPSILON))
    return rk.ranked_diff(control, first(treated), excluded=out, guarded=guarded).where("change <> 'same'")


def shortage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each query's candidates, and why it is less than a page."""
    lexical = cut(search.lexical(spark, sf_dir))
    judged = cut(rk.date_guard(lexical, date_windows(spark, sf_dir), dated(spark, sf_dir)))
    guard = judged.where("judgement = 'conflict'").groupBy("query_id").agg(F.count("*").alias("guarded"))
    left = rk.without_conflicts(lexical, judged)
    out = left.join(exclusions(spark, sf_dir, lexical), ["query_id", "scene_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("excluded"))
    per = lexical.groupBy("query_id").agg(F.count("*").alias("candidates")).join(out, "query_id", "left").join(guard, "query_id", "left").na.fill(0, ["excluded", "guarded"])
    returned = F.greatest(F.col("candidates") - F.col("excluded") - F.col("guarded"), F.lit(0))
    return per.select("query_id", "candidates", "excluded", "guarded", rk.shortage_reasons(returned, F.col("candidates"), F.col("excluded"), F.col("guarded")).alias("reasons"))


def scene_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top scenes with their clip and their lines in order."""
    lines = search.observations(spark, sf_dir).groupBy("scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " / ").alias("lines"))
    top = search.lexical(spark, sf_dir, 10).select("query_id", "scene_id", "rank")
    return top.join(views.scenes(spark, sf_dir).select("scene_id", "clip_id", "start_ms", "end_ms", "shot_type"), "scene_id").join(lines, "scene_id", "left")


def explain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the top scenes came up: query terms by field with their origin, what stands in where none is held, and the date that counts."""
    top = search.lexical(spark, sf_dir, 10).select("query_id", "scene_id", "rank")
    asked = views.search_queries(spark, sf_dir).select("query_id", "terms", F.col("terms").alias("own"))
    wide = dic.with_synonyms(asked, cut(search.synonym_groups(spark, sf_dir))).select("query_id", F.col("own").alias("terms"), F.array_except("terms", "own").alias("added"))
    rows = top.join(views.scenes(spark, sf_dir).select("scene_id", "caption", "transcript", F.array("source", "lang", "shot_type").alias("tags")), "scene_id").join(small(wide), "query_id")
    days = dated(spark, sf_dir).groupBy("scene_id").agg(F.max(F.struct("trusted", "value", "field")).alias("d"))
    rows = rows.join(days.select("scene_id", F.col("d.value").alias("day"), F.col("d.trusted").alias("day_trusted")), "scene_id", "left").na.fill(False, ["day_trusted"])
    why = rk.explanation(F.col("terms"), {"caption": F.col("caption"), "transcript": F.col("transcript")}, F.col("tags"), F.col("added"))
    return rows.select("query_id", "scene_id", "rank", *[c.alias(n) for n, c in why.items()], "day", "day_trusted")


def state_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One string per query of the rules and evidence that its results rest on."""
    sig = lambda c: F.array_join(F.array_sort(F.collect_set(F.lpad(F.col(c).cast("string"), 12, "0"))), ",")
    lexical = cut(search.lexical(spark, sf_dir))
    rules = exclusions(spark, sf_dir, lexical).groupBy("query_id").agg(sig("scene_id").alias("rules"))
    ranks = lexical.where("rank <= 10").groupBy("query_id").agg(sig("scene_id").alias("results"))
    both = rules.join(ranks, "query_id", "full_outer")
    return both.select("query_id", F.sha2(F.concat_ws("|", F.coalesce("rules", F.lit("")), F.coalesce("results", F.lit(""))).cast("binary"), 256).alias("signature"))


def rule_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active rules after a correction replaced those of every third query."""
    active = cut(exclusions(spark, sf_dir))
    new = active.where("query_id % 3 = 0").select("query_id", (F.col("scene_id") + 1).alias("scene_id"))
    return rl.flip(active, active.where("query_id % 3 = 0"), new, ["query_id", "scene_id"])


QUERIES = {
    f.__name__: f
    for f in (eligibility, effective_tags, structured_score, keyword_bonus, phrase_admission, date_guard, hybrid_search, rrf_fusion, soft_rank, page_with_exclusions, replay_diff, shortage, scene_cards, explain_rows, state_signature, rule_flip)
}

_TYPES = "['click', 'view', 'purchase', 'signup', 'search']"
_MONTH = "strftime(DATE '1995-01-01' + to_months(CAST({} % 12 AS INTEGER)), '%Y-%m-%d')"
_JUDGED = """jud AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN user_id END AS scene_id, user_id // 10 AS clip_id, event_type AS tag, ['model', 'reviewer', 'user_input', 'asr', 'ocr'][event_id % 5 + 1] AS source,
         CASE WHEN event_id % 5 = 1 THEN ['verified', 'rejected', 'withdrawn'][event_id % 3 + 1] ELSE ['verified', 'unverified', 'verified'][event_id % 3 + 1] END AS status, ts, event_id
  FROM events WHERE user_id IS NOT NULL),
inh AS (
  SELECT s.scene_id, tag, j.source, status, ts, event_id, j.scene_id IS NOT NULL AS scoped FROM jud j JOIN scene s ON s.clip_id = j.clip_id AND (j.scene_id IS NULL OR j.scene_id = s.scene_id)),
per AS (
  SELECT scene_id, tag, arg_max(status, (ts, event_id)) FILTER (source = 'reviewer' AND scoped) AS s, arg_max(status, (ts, event_id)) FILTER (source = 'reviewer' AND NOT scoped) AS c,
         arg_max({'v': source IN ('user_input', 'original_metadata', 'closed_caption', 'ocr') AND status = 'verified', 's': scoped, 'f': source},
                 (source IN ('user_input', 'original_metadata', 'closed_caption', 'ocr') AND status = 'verified', scoped, ts, event_id)) FILTER (source <> 'reviewer') AS g
  FROM inh GROUP BY ALL),
dec AS (SELECT *, nullif(s, 'withdrawn') AS sv, coalesce(nullif(s, 'withdrawn'), nullif(c, 'withdrawn')) AS d FROM per),
held AS (
  SELECT scene_id, tag, CASE WHEN d IS NOT NULL THEN 'reviewer_verified' WHEN g.v THEN 'verified' ELSE 'unverified' END AS verification,
         CASE WHEN CASE WHEN d IS NOT NULL THEN sv IS NOT NULL ELSE g.s END THEN 'scene' ELSE 'clip' END AS scope, CASE WHEN d IS NOT NULL THEN 'reviewer' ELSE g.f END AS source
  FROM dec WHERE d = 'verified' OR (d IS NULL AND g IS NOT NULL))"""
_DATED = "dated AS (SELECT o_custkey AS scene_id, CASE WHEN o_orderkey % 2 = 0 THEN 'broadcast' ELSE 'filmed' END AS field, strftime(o_orderdate, '%Y-%m-%d') AS value, o_orderkey % 3 <> 0 AS trusted FROM orders)"
_LAST = f"strftime(CAST({_MONTH.format('item_id')} AS DATE) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d')"
_PLACE = "'src' || item_id % 20 || '-' || item_id % 50"
_STRUCT = f"""want AS (
  SELECT item_id, 'event' AS axis, {_TYPES}[item_id % 5 + 1] AS v, 2.0 AS w FROM benchmark
  UNION ALL SELECT item_id, 'event', {_TYPES}[(item_id + 1) % 5 + 1], 2.0 FROM benchmark
  UNION ALL SELECT item_id, 'person', 'user' || item_id, 2.0 FROM benchmark WHERE item_id % 5 = 0
  UNION ALL SELECT item_id, 'organization', ['en', 'de', 'fr', 'es'][item_id % 4 + 1] || '-' || item_id % 20, 1.0 FROM benchmark WHERE item_id % 2 = 0
  UNION ALL SELECT item_id, 'location', {_PLACE}, 1.0 FROM benchmark WHERE item_id % 3 = 0
  UNION ALL SELECT item_id, 'facility', {_PLACE}, 1.0 FROM benchmark WHERE item_id % 3 = 0
  UNION ALL SELECT item_id, 'scene_type', ['b_roll', 'anchor', 'field'][item_id % 3 + 1] || '-' || item_id % 40, 0.5 FROM benchmark WHERE item_id % 4 = 0),
cond AS (
  SELECT item_id AS query_id, axis, v AS lo, v AS hi, w FROM want
  UNION ALL SELECT item_id, 'broadcast_date', {_MONTH.format('item_id')}, {_LAST}, 1.0 FROM benchmark
  UNION ALL SELECT item_id, 'filmed_date', {_MONTH.format('item_id')}, {_LAST}, 1.0 FROM benchmark WHERE item_id % 2 = 1),
alltag AS (
  SELECT scene_id, 'event' AS axis, lower(tag) AS value FROM held UNION ALL SELECT scene_id, 'organization', lang || '-' || clip_id % 20 FROM scene
  UNION ALL SELECT scene_id, 'location', source || '-' || clip_id % 50 FROM scene UNION ALL SELECT scene_id, 'scene_type', shot_type || '-' || scene_id % 40 FROM scene
  UNION ALL SELECT DISTINCT scene_id, field || '_date', value FROM dated),
hit AS (SELECT query_id, axis, scene_id, count(DISTINCT lo || '|' || hi) AS n FROM cond JOIN alltag USING (axis) WHERE value BETWEEN lo AND hi AND (axis LIKE '%date' OR value = lo) GROUP BY ALL),
req AS (SELECT query_id, axis, count(*) AS r, any_value(w) AS w, sum(any_value(w)) OVER (PARTITION BY query_id) AS total FROM cond GROUP BY query_id, axis),
struct AS (
  SELECT query_id, scene_id, round(sum(n / r * w / total), 9) AS structured, bool_or(axis NOT LIKE '%date') AS admits
  FROM hit JOIN req USING (query_id, axis) WHERE scene_id IN (SELECT scene_id FROM eligible) GROUP BY ALL)"""
_TAGS = f"{_JUDGED}, {_DATED}, {_STRUCT}"
_FUSED = f"""{sql.LEXICAL}, {_TAGS}, vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dense AS (
  SELECT q.vec_id // 20 AS query_id, d.vec_id AS scene_id, {sql.COSINE} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {sql.COSINE}, d.vec_id) AS rank
  FROM vec q JOIN vec d ON d.vec_id <> q.vec_id JOIN eligible e ON e.scene_id = d.vec_id WHERE q.vec_id % 20 = 0),
chan AS (
  SELECT query_id, scene_id, rank AS lr, NULL AS dr, 0.0 AS structured, true AS admits FROM lexical
  UNION ALL SELECT query_id, scene_id, NULL, rank, 0.0, true FROM dense WHERE rank <= 200 AND distance <= 0.75
  UNION ALL SELECT query_id, scene_id, NULL, NULL, structured, admits FROM struct),
fused AS (
  SELECT query_id, scene_id, min(lr) AS lexical_rank, min(dr) AS dense_rank,
         round((coalesce(1 / (60 + min(lr)), 0) + coalesce(1 / (60 + min(dr)), 0)) / (2.0 / 61) + max(structured), 9) AS base_score FROM chan GROUP BY query_id, scene_id HAVING bool_or(admits))"""
_SOFT = f"""{_FUSED},
day AS (SELECT scene_id, max(value) AS day FROM dated GROUP BY 1),
sig AS (
  SELECT f.*, CASE WHEN shot_type = 'b_roll' THEN 1 ELSE 0 END AS b, coalesce(date_diff('day', min(CAST(day AS DATE)) OVER w, CAST(day AS DATE)) / nullif(date_diff('day', min(CAST(day AS DATE)) OVER w, max(CAST(day AS DATE)) OVER w), 0), 0) AS r,
         CASE WHEN (month(CAST(day AS DATE)) % 12) // 3 = query_id % 4 THEN 1 ELSE 0 END AS s, CASE WHEN scene_id % 3 = query_id % 3 THEN 1 ELSE 0 END AS h
  FROM fused f LEFT JOIN day USING (scene_id) LEFT JOIN scene USING (scene_id) WINDOW w AS (PARTITION BY query_id)),
wt AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 1.0 ELSE 0 END AS wr, CASE WHEN query_id % 3 = 1 THEN 0.3 ELSE 0 END AS ws, CASE WHEN query_id % 5 = 2 THEN 0.2 ELSE 0 END AS wh FROM sig),
soft AS (SELECT *, round((wr * r + 0.5 * b + ws * s + wh * h) / (wr + 0.5 + ws + wh), 9) AS soft_score FROM wt),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(base_score / 0.01) DESC, soft_score DESC, scene_id) AS rank FROM soft)"""
# the four keys differ between any two queries, and rules of every fifth query have another version
_EXCL = """excl AS (
  SELECT DISTINCT query_id, scene_id FROM (
    SELECT item_id AS query_id, scene_id FROM benchmark JOIN scene ON scene_id % 50 = item_id WHERE scene_id % 7 = 0
    UNION ALL SELECT query_id, scene_id FROM lexical WHERE rank <= 5 AND scene_id % 3 = 0)
  WHERE query_id % 5 <> 0 AND scene_id % 11 <> 0)"""
_WIN = f"win AS (SELECT item_id AS query_id, {_MONTH.format('item_id')} AS lo, strftime(CAST({_MONTH.format('item_id')} AS DATE) + INTERVAL 36 MONTH, '%Y-%m-%d') AS hi FROM benchmark WHERE item_id % 4 <> 3)"


def _guard(rows: str) -> str:
    return f"""{_WIN},
guard AS (
  SELECT l.query_id, l.scene_id, 'broadcast' AS field, CASE WHEN bool_or(coalesce(value >= lo AND value < hi, false)) THEN 'match' WHEN count(value) > 0 THEN 'conflict' ELSE 'unknown' END AS judgement
  FROM {rows} l JOIN win USING (query_id) LEFT JOIN dated d ON d.scene_id = l.scene_id AND d.trusted AND d.field = 'broadcast' GROUP BY ALL)"""


_CLEAR = f"""{_guard('final')},
clear AS (
  SELECT query_id, scene_id, base_score, soft_score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM final
  WHERE (query_id, scene_id) NOT IN (SELECT (query_id, scene_id) FROM guard WHERE judgement = 'conflict'))"""


def _page(rows: str) -> str:
    return f"""m AS (SELECT query_id, scene_id, rank, (query_id, scene_id) IN (SELECT (query_id, scene_id) FROM excl) AS gone FROM {rows}),
v AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY rank) AS valid, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY query_id) AS total FROM m)
SELECT query_id, scene_id, rank, CASE WHEN gone THEN 'excluded' ELSE 'shown' END AS state, total > 10 AS has_more FROM v WHERE NOT gone AND valid BETWEEN 1 AND 10 OR gone AND valid < 10"""


_HELD = "array_to_string(list_sort(list_filter(terms, lambda el: list_contains({0}, el))), ' ')"

ORACLE_SQL = {
    "eligibility": f"""WITH {sql.SCENE}, {sql.CLIP}
SELECT w.scene_id, CASE WHEN s.clip_id IS NULL THEN 'not_found' WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN run_id <> active_run_id THEN 'inactive_run' ELSE 'eligible' END AS state
FROM (SELECT DISTINCT doc_id * 2 AS scene_id FROM labels) w LEFT JOIN scene s ON s.scene_id = w.scene_id LEFT JOIN clip c ON c.clip_id = s.clip_id""",
    "effective_tags": f"WITH {sql.SCENE}, {_JUDGED} SELECT * FROM held",
    "structured_score": f"WITH {sql.ELIGIBLE}, {_TAGS} SELECT query_id, scene_id, round(structured, 6) AS structured, admits FROM struct",
    "keyword_bonus": f"""WITH {sql.ELIGIBLE},
t AS (SELECT item_id AS query_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT item_id, {sql.tok('text')} AS w FROM benchmark)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY query_id ORDER BY i) AS run FROM t WHERE length(word) >= 4),
j AS (
  SELECT query_id, run, i, 1 AS n, word AS w FROM g UNION ALL SELECT a.query_id, a.run, a.i, 2, a.word || b.word FROM g a JOIN g b ON b.query_id = a.query_id AND b.i = a.i + 1
  UNION ALL SELECT a.query_id, a.run, a.i, 3, a.word || b.word || c.word FROM g a JOIN g b ON b.query_id = a.query_id AND b.i = a.i + 1 JOIN g c ON c.query_id = a.query_id AND c.i = a.i + 2),
o AS (SELECT query_id, w, min(row(0, run, n, i)) AS pos FROM j WHERE w NOT IN ('the', 'de') GROUP BY ALL UNION ALL SELECT query_id, word, min(row(1, 0, 0, i)) FROM t WHERE word NOT IN ('the', 'de') GROUP BY ALL),
k AS (SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS n FROM o GROUP BY query_id, w QUALIFY n <= 12),
s AS (SELECT DISTINCT scene_id, unnest({sql.tok('caption')}) AS w FROM eligible)
SELECT query_id, scene_id, count(*) AS matched, round(0.2 * count(*) / any_value(requested), 6) AS bonus FROM s JOIN k USING (w) JOIN (SELECT query_id, count(*) AS requested FROM k GROUP BY 1) USING (query_id) GROUP BY query_id, scene_id""",
    "date_guard": f"WITH {sql.LEXICAL}, {_DATED}, {_guard('lexical')} SELECT * FROM guard",
    "hybrid_search": f"WITH {_SOFT}, {_EXCL}, {_CLEAR}, {_page('clear')}",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, scene_id, lexical_rank, dense_rank, round(base_score, 6) AS base_score, row_number() OVER (PARTITION BY query_id ORDER BY fused.base_score DESC, scene_id) AS rank FROM fused QUALIFY rank <= 200",
    "soft_rank": f"WITH {_SOFT} SELECT query_id, scene_id, round(soft_score, 6) AS soft_score, rank FROM final WHERE rank <= 200",
    "page_with_exclusions": f"WITH {_SOFT}, {_EXCL}, {_page('final')}",
    "replay_diff": f"""WITH {_SOFT}, {_EXCL}, {_CLEAR},
a AS (SELECT query_id, scene_id, rank AS before FROM final WHERE rank <= 10),
b AS (
  SELECT query_id, scene_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS after FROM clear
  WHERE (query_id, scene_id) NOT IN (SELECT (query_id, scene_id) FROM excl) QUALIFY after <= 10)
SELECT query_id, scene_id, before, after, CASE WHEN before IS NULL THEN 'entered' WHEN after IS NULL THEN 'dropped' ELSE 'moved' END AS change,
       CASE WHEN after IS NULL THEN CASE WHEN (query_id, scene_id) IN (SELECT (query_id, scene_id) FROM excl) THEN 'exclusion' WHEN (query_id, scene_id) IN (SELECT (query_id, scene_id) FROM guard WHERE judgement = 'conflict') THEN 'guard' ELSE 'score' END END AS cause
FROM a FULL JOIN b USING (query_id, scene_id) WHERE before IS DISTINCT FROM after""",
    "shortage": f"""WITH {sql.LEXICAL}, {_DATED}, {_guard('lexical')}, {_EXCL}, bad AS (SELECT query_id, scene_id FROM guard WHERE judgement = 'conflict'),
p AS (
  SELECT query_id, count(*) AS candidates, count(*) FILTER ((query_id, scene_id) IN (SELECT (query_id, scene_id) FROM excl) AND (query_id, scene_id) NOT IN (SELECT (query_id, scene_id) FROM bad)) AS excluded,
         count(*) FILTER ((query_id, scene_id) IN (SELECT (query_id, scene_id) FROM bad)) AS guarded
  FROM lexical l GROUP BY 1)
SELECT *, CASE WHEN greatest(candidates - excluded - guarded, 0) >= 10 THEN '' ELSE
  concat_ws(',', CASE WHEN candidates < 10 THEN 'few_candidates' END, CASE WHEN excluded > 0 THEN 'excluded' END, CASE WHEN guarded > 0 THEN 'date_conflict' END) END AS reasons FROM p""",
    "scene_cards": f"""WITH {sql.LEXICAL},
o AS (
  SELECT scene_id, string_agg(line, ' / ' ORDER BY i) AS lines FROM (
    SELECT scene_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT scene_id, string_split(caption || chr(10) || transcript, chr(10)) AS l FROM eligible))
  WHERE trim(line) <> '' GROUP BY 1)
SELECT query_id, scene_id, rank, clip_id, start_ms, end_ms, shot_type, lines FROM lexical JOIN scene USING (scene_id) LEFT JOIN o USING (scene_id) WHERE rank <= 10""",
    "explain_rows": f"""WITH {sql.LEXICAL}, {_DATED}, {sql.SYNONYMS},
h AS (
  SELECT query_id, l.scene_id, rank, {_HELD.format(sql.tok('caption'))} AS in_caption, {_HELD.format(sql.tok('transcript'))} AS in_transcript, {_HELD.format('[source, lang, shot_type]')} AS in_tags, caption, transcript,
         array_to_string(list_concat(list_transform(list_sort(list_filter(terms, lambda el: list_contains(w, el))), lambda el: el || ':query'),
           list_transform(list_sort(list_filter(all_terms, lambda el: list_contains(w, el) AND NOT list_contains(terms, el))), lambda el: el || ':expansion')), ' ') AS keywords
  FROM (SELECT *, list_concat(list_concat({sql.tok('caption')}, {sql.tok('transcript')}), [source, lang, shot_type]) AS w FROM lexical JOIN scene USING (scene_id) WHERE rank <= 10) l
  JOIN (SELECT q.query_id, q.terms, wide.terms AS all_terms FROM query q JOIN wide USING (query_id)) USING (query_id))
SELECT query_id, h.scene_id, rank, in_caption, in_transcript, in_tags, keywords, CASE WHEN in_caption <> '' THEN 'caption' WHEN in_transcript <> '' THEN 'transcript' WHEN in_tags <> '' THEN 'tags' ELSE 'none' END AS evidence,
       CASE WHEN in_caption <> '' OR in_transcript <> '' OR in_tags <> '' THEN NULL WHEN trim(caption, ' ') <> '' THEN caption WHEN trim(transcript, ' ') <> '' THEN transcript END AS stand_in,
       (SELECT value FROM dated x WHERE x.scene_id = h.scene_id ORDER BY trusted DESC, value DESC, field DESC LIMIT 1) AS day, coalesce((SELECT trusted FROM dated x WHERE x.scene_id = h.scene_id ORDER BY trusted DESC, value DESC, field DESC LIMIT 1), false) AS day_trusted FROM h""",
    "state_signature": f"""WITH {sql.LEXICAL}, {_EXCL},
r AS (SELECT query_id, string_agg(DISTINCT lpad(CAST(scene_id AS VARCHAR), 12, '0'), ',' ORDER BY lpad(CAST(scene_id AS VARCHAR), 12, '0')) AS rules FROM excl GROUP BY 1),
k AS (SELECT query_id, string_agg(DISTINCT lpad(CAST(scene_id AS VARCHAR), 12, '0'), ',' ORDER BY lpad(CAST(scene_id AS VARCHAR), 12, '0')) AS results FROM lexical WHERE rank <= 10 GROUP BY 1)
SELECT query_id, sha256(coalesce(rules, '') || '|' || coalesce(results, '')) AS signature FROM r FULL JOIN k USING (query_id)""",
    "rule_flip": f"""WITH {sql.LEXICAL}, {_EXCL}
SELECT DISTINCT query_id, scene_id FROM excl WHERE query_id % 3 <> 0 UNION SELECT query_id, scene_id + 1 FROM excl WHERE query_id % 3 = 0""",
}
