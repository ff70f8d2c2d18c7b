"""Registered queries: readiness, extraction inputs, bulk updates, rule revisions, gold sets, record faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstack.functions import text as tx
from reelstack.operators import archive as ar
from reelstack.operators import evaluate as ev
from reelstack.operators import intervals as iv
from reelstack.operators import observations as ob
from reelstack.operators import retrieval as rt
from reelstack.operators.tables import cut
from reelstack.plans import preparation, ranking, search, sql
from reelstack.sources import views


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return views.table(spark, sf_dir, name)


def filtered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one status whatever their priority: the second parameter is null."""
    return ar.optional_filter(_t(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=None).select("o_orderkey", "o_orderstatus")


def owned_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches that one owner may see of their own."""
    o = _t(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("search_id"), (F.col("o_custkey") % 5).alias("owner"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("running").alias("status"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") - 1).alias("original_id"), (F.col("o_orderkey") % 3).alias("page"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate")).alias("hidden_at"),
    )
    return ar.visible_history(rows, F.lit(2)).select("search_id")


def scene_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media key and range of labelled scenes, as far as they may be shown."""
    s = views.scenes(spark, sf_dir)
    scene = s.select("scene_id", "clip_id", "run_id", "start_ms", "end_ms").join(views.clips(s), "clip_id")
    return ar.media_of(scene, _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("scene_id")).distinct())


def dense_with_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours nearer than 0.4 beside how many vectors could be searched; queries without any keep their coverage."""
    queries, vec = search.vectors(spark, sf_dir)
    size = queries.select(F.max(F.size("vector"))).first()[0] or 0
    near = rt.dense_top_k(queries, vec, 200, max_distance=0.4).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))
    covered = rt.vector_coverage(vec.withColumn("every", F.lit(1)), "every", size).select("every", "eligible", "usable")
    per_query = queries.select("query_id", F.lit(1).alias("every")).join(F.broadcast(covered), "every").drop("every")
    return rt.hits_with_coverage(per_query, near)


def truncated_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by the first 16 dimensions, normalised again."""
    queries, vec = search.vectors(spark, sf_dir)
    short = lambda df: df.withColumn("vector", rt.truncated(F.col("vector"), 16))
    return rt.dense_top_k(short(queries), short(vec), 10).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def index_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir).select("clip_id", "scene_id", tx.tokens("caption").alias("caption_tokens"), F.col("transcript").alias("dialogue"))
    read = ob.built(preparation.line_input(spark, sf_dir)).where("confidence >= 0.9 and size(tokens) > 0").select(F.floor(F.col("obs_id") / 100000).alias("scene_id"))
    return ar.index_readiness(s, read, _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene_id")))


def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ar.first_frames(preparation.frames(spark, sf_dir).select("scene_id", F.col("frame_no").alias("keyframe_id"), "ts_ms"))


def entity_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged screen texts, linked segments and tags of scenes as labelled texts."""
    observed = ob.built(preparation.line_input(spark, sf_dir))
    groups = ob.merged(observed).select("scene_id", F.col("representative").alias("ref")).join(observed.select(F.col("obs_id").alias("ref"), F.col("raw_text").alias("text")), "ref").select("scene_id", "ref", "text")
    chosen = iv.select_by_priority(preparation.segments(spark, sf_dir), preparation.TIERS).where("selected").select("segment_id", "text")
    links = preparation.scene_mapping(spark, sf_dir).join(chosen, "segment_id").select((F.col("clip_id") * 100 + F.col("scene_no")).alias("scene_id"), F.col("segment_id").alias("ref"), "text", "overlap_ms")
    tags = ranking.held_tags(spark, sf_dir).select("scene_id", F.conv(F.hex(F.substring("tag", 1, 4)), 16, 10).cast("long").alias("ref"), F.col("tag").alias("text"))
    return ar.entity_inputs(groups, links, tags).select("scene_id", "label", F.md5(F.col("text").cast("binary")).alias("digest"))


def verified_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' evidence on date tags becomes verified; other evidence stays."""
    j = ranking.judgements(spark, sf_dir).withColumn("tagging_id", F.col("evidence_id") % 1000).select("evidence_id", "tagging_id", "source", "status")
    dates = F.col("tagging_id") % 4 == 0
    keys = j.where(dates).select("tagging_id")
    return ar.updated(j, keys, "tagging_id", (F.col("source") == "user_input") & (F.col("status") == "unverified"), status=F.lit("verified")).select("evidence_id", "status")


def revised_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rules: odd ones are active, even ones candidates that may repeat a request and replace a rule."""
    li = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rule_id"), F.col("l_orderkey").alias("report_id"), "l_linenumber", F.col("l_partkey").alias("scene_id"))
    request = F.when(F.col("l_linenumber") % 6 != 0, F.concat(F.lit("k"), F.col("scene_id") % 3))
    rows = li.withColumns({"request_key": request, "replaces": F.when(F.col("l_linenumber") == 2, F.col("rule_id") - 1)})
    cols = ["rule_id", "report_id", "request_key", "replaces", "scene_id"]
    return ar.revised_rules(rows.where("l_linenumber % 2 = 1").select(cols), rows.where("l_linenumber % 2 = 0").select(cols)).select("rule_id", "request_key", "replaces")


def snapshot_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recorded searches, some of which lack a part."""
    o = _t(spark, sf_dir, "orders")
    part = lambda i: F.when(F.col("o_orderkey") % (11 + i) != 0, F.lit("x"))
    rows = o.select(F.col("o_orderkey").alias("search_id"), F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "failed").otherwise("finished").alias("status"), *[part(i).alias(c) for i, c in enumerate(ar.SNAPSHOT)])
    return ar.snapshot_faults(rows)


def frame_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with fewer chosen frames than two, or than they have."""
    f = preparation.frames(spark, sf_dir)
    scenes = f.groupBy("scene_id").agg(F.lit(0).alias("first_frame"), (F.count("*") - 1).alias("last_frame"))
    return ar.frame_floor_faults(scenes, f.where("frame_no % 40 = 0").select("scene_id", "frame_no"), 4)


def embedding_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes that are embedded, skipped, both or neither."""
    s = views.scenes(spark, sf_dir).select("scene_id", "caption")
    return ar.embedding_split_faults(s, _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene_id")), s.where("length(caption) < 60").select("scene_id"))


def count_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored summaries of clips against what is counted; every third was stored with one more caption."""
    counted = cut(index_readiness(spark, sf_dir))
    stored = counted.withColumn("caption_scenes", F.col("caption_scenes") + F.when(F.col("clip_id") % 3 == 0, 1).otherwise(0))
    return ar.count_faults(stored, counted, "clip_id", "scenes", ["caption_scenes", "dialogue_scenes"])


def gold_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold labels on orders' date texts, some spoilt."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    value = F.date_format("day", "yyyy-MM")
    text = F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.concat(F.lit("news of "), value))
    start = F.trunc("day", "month")
    rows = o.select(
        F.col("o_orderkey").alias("gold_id"), text.alias("text"), F.when(F.col("o_orderkey") % 13 == 0, "thing").otherwise("date").alias("kind"), value.alias("value"),
        F.when(F.col("o_orderkey") % 7 == 0, 7).otherwise(8).alias("start"), start.alias("window_start"), F.add_months(start, F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1)).alias("window_end"),
    )
    return ar.gold_faults(rows, ["date", "person"])


def gold_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated, one-category and broad corpora for the passages that documents hold."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return ar.gold_sets(docs, views.gold(spark, sf_dir).select(F.col("scene_id").alias("doc_id")), F.col("source") == "src1", 500)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised caption words as recognised spans."""
    s = views.scenes(spark, sf_dir).select("scene_id", "source", F.col("caption").alias("text"), F.posexplode(F.split("caption", " ")).alias("n", "word"))
    s = s.where(F.col("word").rlike("^[A-Z][a-z]+$")).withColumn("start", F.instr("text", F.col("word")) - 1)
    label = F.element_at(F.array(F.lit("PER"), F.lit("LOC"), F.lit("MISC")), (F.col("n") % 3 + 1).cast("int"))
    return s.select("scene_id", "source", "n", "text", "start", (F.col("start") + F.length("word")).alias("end"), label.alias("label"), ((F.col("scene_id") + F.col("n")) % 50 / 50).alias("confidence"))


def typed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ar.typed_spans(_spans(spark, sf_dir), {"PER": "person", "LOC": "place"}, 0.2).select("scene_id", "n", "type", "value")


def candidate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well candidates of each method (source) rest on their texts."""
    s = ar.typed_spans(_spans(spark, sf_dir), {"PER": "person", "LOC": "place", "MISC": "other"}, 0.0)
    rows = s.select(
        "source", "value", F.when(F.col("type") != "other", F.col("type")).alias("type"), F.when((F.col("scene_id") + F.col("n")) % 5 != 0, F.col("start")).alias("start"), F.col("scene_id").alias("text_id"),
        F.when(F.col("n") % 4 != 0, F.col("scene_id") + F.when(F.col("n") % 7 == 0, 1).otherwise(0)).alias("claimed_id"), (F.col("scene_id") % 3 == 0).alias("unverified"),
    )
    return ar.candidate_quality(rows, "source")


def strict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON texts read under a strict schema: what was rejected, and why."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("tier"), F.col("text").alias("query")).alias("s"))
    body = F.to_json("s")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("{"), body)).when(F.col("doc_id") % 11 == 0, F.replace(body, F.lit('"id":'), F.lit('"id":"x"#'))).otherwise(body)
    good, bad = ar.parsed_records(d.select("doc_id", text.alias("body")), "body", "id bigint, tier string, query string", ["id", "tier", "query"])
    return good.select("doc_id", F.lit("accepted").alias("outcome")).unionByName(bad.select("doc_id", F.col("reason").alias("outcome")))


def retrieval_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of vector search by level (label) of the query, and pooled."""
    per = search.retrieval_metrics(spark, sf_dir).join(search.vectors(spark, sf_dir)[0].select("query_id", (F.col("query_label") % 3).alias("level")), "query_id")
    return ar.graded_metrics(per, "level", "recall", "precision", "ndcg", "mrr")


def search_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each query passes (its answer among the first ten), fails or got no answer."""
    ranked = search.lexical(spark, sf_dir, 10)
    hits = ev.first_hit(views.gold(spark, sf_dir), ranked)
    rows = views.search_queries(spark, sf_dir).select("query_id").join(hits, "query_id", "left").join(ranked.select("query_id").distinct().withColumn("answered", F.lit(True)), "query_id", "left")
    return rows.select("query_id", F.when(F.col("answered").isNull(), "unanswered").when(F.col("hit_rank") <= 10, "pass").otherwise("fail").alias("split"))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by tag, by source and by confidence band."""
    j = ranking.judgements(spark, sf_dir).withColumn("band", tx.confidence_band(F.col("evidence_id") % 100 / 100))
    return ar.verdict_counts(j, "status", "tag", "source", "band")


def range_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range, interval and pairing rules of lines, scenes and evidence."""
    li = ar.range_faults(_t(spark, sf_dir, "lineitem"), {"discount_range": F.col("l_discount").between(0, 0.09), "tax_range": F.col("l_tax").between(0, 0.07), "flag_pairing": (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F"), "quantity_positive": F.col("l_quantity") > 1})
    s = ar.range_faults(views.scenes(spark, sf_dir), {"scene_interval": F.col("start_ms") < F.col("end_ms"), "scene_source": F.col("source") != "src0"})
    j = ar.range_faults(ranking.judgements(spark, sf_dir), {"review_shape": (F.col("source") == "reviewer") | ~F.col("status").isin("rejected", "withdrawn"), "verified_source": (F.col("status") != "verified") | (F.col("source") != "asr")})
    return li.unionByName(s).unionByName(j)


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of every relation of the given tables."""
    from reelstack.operators import curation as cu

    relations = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"), ("embeddings", "vec_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey")]
    return cu.violations({f"{a}.{k}": cu.orphans(_t(spark, sf_dir, a), k, _t(spark, sf_dir, b), p) for a, k, b, p in relations})


def link_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of scenes to segments, some of which were taken from segments that lost."""
    judged = cut(iv.select_by_priority(preparation.segments(spark, sf_dir), preparation.TIERS))
    links = judged.select(F.col("clip_id").alias("scene_id"), "segment_id", (F.col("end") - F.col("start") + F.when(F.col("segment_id") % 9 == 0, 1).otherwise(0)).alias("overlap_ms"))
    return ar.link_faults(links, judged)


QUERIES = {
    f.__name__: f
    for f in (
        filtered_orders, owned_history, scene_media, dense_with_coverage, truncated_topk, index_readiness, first_frames, entity_inputs, verified_dates, revised_rules, snapshot_faults, frame_floor, embedding_split,
        count_faults, gold_faults, gold_sets, typed_spans, candidate_quality, strict_records, retrieval_levels, search_split, verdict_counts, range_faults, foreign_keys, link_faults,
    )
}

_READY = f"""{preparation._OCR}, seen AS (SELECT DISTINCT obs_id // 100000 AS scene_id FROM obs WHERE round(confidence, 4) >= 0.9 AND len({sql.tok('raw_text')}) > 0),
ready AS (
  SELECT clip_id, count(*) AS scenes, count(*) FILTER (len({sql.tok('caption')}) > 0) AS caption_scenes, count(*) FILTER (trim(transcript, ' ') <> '') AS dialogue_scenes, count(*) FILTER (scene_id IN (SELECT scene_id FROM seen)) AS ocr_scenes,
         count(*) FILTER (scene_id IN (SELECT vec_id FROM embeddings)) AS embedded_scenes FROM scene GROUP BY 1)"""
_SPAN = """v AS (SELECT scene_id, source, caption AS text, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS n FROM (SELECT *, string_split(caption, ' ') AS l FROM scene)),
span AS (SELECT *, instr(text, word) - 1 AS s, ['person', 'place', 'other'][n % 3 + 1] AS type, ((scene_id + n) % 50) / 50 AS confidence FROM v WHERE regexp_full_match(word, '[A-Z][a-z]+'))"""
_RULES = """rule AS (
  SELECT l_orderkey * 10 + l_linenumber AS rule_id, l_orderkey AS report_id, l_linenumber AS n, CASE WHEN l_linenumber % 6 <> 0 THEN 'k' || l_partkey % 3 END AS request_key, CASE WHEN l_linenumber = 2 THEN l_orderkey * 10 + 1 END AS replaces FROM lineitem),
act AS (SELECT * FROM rule WHERE n % 2 = 1),
cand AS (SELECT * FROM rule WHERE n % 2 = 0 QUALIFY request_key IS NULL OR row_number() OVER (PARTITION BY report_id, request_key ORDER BY rule_id) = 1),
new AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.report_id = c.report_id AND a.request_key = c.request_key))"""
_FKS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"), ("embeddings", "vec_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey")]
_SNAP = ", ".join(f"CASE WHEN o_orderkey % {11 + i} = 0 THEN '{c}' END" for i, c in enumerate(ar.SNAPSHOT))

ORACLE_SQL = {
    "filtered_orders": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "owned_history": "SELECT o_orderkey AS search_id FROM orders WHERE o_custkey % 5 = 2 AND o_orderstatus = 'F' AND o_orderkey % 4 <> 0 AND o_orderkey % 3 = 1 AND (o_orderkey % 7 <> 0 OR o_orderdate IS NULL)",
    "scene_media": f"WITH {sql.ELIGIBLE} SELECT scene_id, 'clips/' || clip_id || '/' || run_id AS media_key, start_ms, end_ms FROM eligible WHERE scene_id IN (SELECT doc_id FROM labels)",
    "dense_with_coverage": f"""WITH {sql.DENSE}, n AS (SELECT count(*) AS n FROM embeddings)
SELECT q.vec_id AS query_id, n AS eligible, n AS usable, d.vec_id, round(distance, 6) AS distance FROM embeddings q CROSS JOIN n LEFT JOIN (SELECT * FROM dense WHERE rank <= 200 AND distance <= 0.4) d ON d.query_id = q.vec_id WHERE q.vec_id % 20 = 0""",
    "truncated_topk": "WITH " + sql.DENSE.replace("CAST(embedding AS DOUBLE[])", "CAST(embedding AS DOUBLE[])[1:16]") + " SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM dense WHERE rank <= 10",
    "index_readiness": f"WITH {sql.SCENE}, {_READY} SELECT * FROM ready",
    "first_frames": "SELECT user_id AS scene_id, arg_min(epoch_us(ts) // 1000, event_id) AS ts_ms, min(event_id) AS keyframe_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1",
    "verified_dates": f"WITH {sql.SCENE}, {ranking._JUDGED} SELECT event_id AS evidence_id, CASE WHEN source = 'user_input' AND status = 'unverified' AND event_id % 1000 % 4 = 0 THEN 'verified' ELSE status END AS status FROM jud",
    "revised_rules": f"WITH {_RULES} SELECT rule_id, request_key, replaces FROM act WHERE rule_id NOT IN (SELECT replaces FROM new WHERE replaces IS NOT NULL) UNION ALL SELECT rule_id, request_key, replaces FROM new",
    "snapshot_faults": f"SELECT * FROM (SELECT o_orderkey AS search_id, concat_ws(',', {_SNAP}) AS missing FROM orders WHERE o_orderstatus = 'F') WHERE missing <> ''",
    "frame_floor": """WITH f AS (SELECT user_id AS scene_id, event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT scene_id, least(4, count(*)) AS expected, count(DISTINCT event_id) FILTER (event_id % 40 = 0) AS chosen FROM f GROUP BY 1 HAVING count(DISTINCT event_id) FILTER (event_id % 40 = 0) < least(4, count(*))""",
    "embedding_split": f"""WITH {sql.SCENE}, e AS (SELECT DISTINCT vec_id AS id FROM embeddings), k AS (SELECT scene_id AS id FROM scene WHERE length(caption) < 60)
SELECT 'in_both' AS fault, (SELECT count(*) FROM e SEMI JOIN k USING (id)) AS n UNION ALL SELECT 'in_neither', (SELECT count(*) FROM scene WHERE scene_id NOT IN (SELECT id FROM e UNION SELECT id FROM k)) UNION ALL SELECT 'unknown_scene', (SELECT count(*) FROM e WHERE id NOT IN (SELECT scene_id FROM scene))""",
    "count_faults": f"""WITH {sql.SCENE}, {_READY}
SELECT clip_id, 'caption_scenes_exceeds' AS fault FROM ready WHERE clip_id % 3 = 0 AND caption_scenes + 1 > scenes UNION ALL SELECT clip_id, 'caption_scenes_differs' FROM ready WHERE clip_id % 3 = 0""",
    "gold_faults": """WITH o AS (SELECT *, o_orderkey AS k FROM orders)
SELECT k AS gold_id, 'blank_text' AS fault FROM o WHERE k % 11 = 0 UNION ALL SELECT k, 'unknown_kind' FROM o WHERE k % 13 = 0 UNION ALL SELECT k, 'span_not_in_text' FROM o WHERE k % 11 = 0 OR k % 7 = 0 UNION ALL SELECT k, 'window_differs' FROM o WHERE k % 5 = 0 AND k % 13 <> 0""",
    "gold_sets": f"""WITH {sql.GOLD}, d AS (SELECT doc_id, source, doc_id IN (SELECT scene_id FROM gold) AS relevant FROM documents WHERE trim(text, ' ') <> '')
SELECT 'curated' AS kind, doc_id, relevant FROM d WHERE relevant UNION ALL SELECT 'hard', doc_id, relevant FROM d WHERE source = 'src1' UNION ALL SELECT * FROM (SELECT 'broad', doc_id, relevant FROM d ORDER BY md5('0:' || doc_id), doc_id LIMIT 500)""",
    "typed_spans": f"WITH {sql.SCENE}, {_SPAN} SELECT scene_id, n, type, word AS value FROM span WHERE type <> 'other' AND confidence >= 0.2",
    "candidate_quality": f"""WITH {sql.SCENE}, {_SPAN}, c AS (SELECT source, word AS value, nullif(type, 'other') AS type, (scene_id + n) % 5 <> 0 AS g, CASE WHEN n % 4 <> 0 THEN n % 7 <> 0 END AS ok, scene_id % 3 = 0 AS u FROM span)
SELECT source, count(*) AS candidates, count(DISTINCT (value, type)) AS unique_values, round(count(*) FILTER (g) / count(*), 6) AS grounded, round(count(type) / count(*), 6) AS typed, round(count(*) FILTER (ok) / nullif(count(ok), 0), 6) AS source_correct,
       round(count(*) FILTER (u) / count(*), 6) AS on_unverified FROM c GROUP BY 1""",
    "strict_records": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 11 = 0 THEN 'malformed' WHEN doc_id % 7 = 0 OR source IS NULL THEN 'missing:tier' ELSE 'accepted' END AS outcome FROM documents",
    "retrieval_levels": f"""WITH r AS ({search.ORACLE_SQL['retrieval_metrics']}), l AS (SELECT r.*, label % 3 AS level FROM r JOIN embeddings ON vec_id = query_id)
SELECT level, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM l GROUP BY GROUPING SETS ((level), ())""",
    "search_split": f"""WITH {sql.LEXICAL}, {sql.GOLD}, {search._HIT}
SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM lexical) THEN 'unanswered' WHEN hit_rank <= 10 THEN 'pass' ELSE 'fail' END AS split FROM query LEFT JOIN hit USING (query_id)""",
    "verdict_counts": f"""WITH {sql.SCENE}, {ranking._JUDGED}, b AS (SELECT *, CASE WHEN event_id % 100 < 50 THEN 'low' WHEN event_id % 100 < 80 THEN 'mid' ELSE 'high' END AS band FROM jud)
SELECT 'tag' AS dimension, tag AS value, status, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 'source', source, status, count(*) FROM b GROUP BY ALL UNION ALL SELECT 'band', band, status, count(*) FROM b GROUP BY ALL""",
    "range_faults": f"""WITH {sql.SCENE}, {ranking._JUDGED}
SELECT 'discount_range' AS rule, (SELECT count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.09::DOUBLE) AS n UNION ALL SELECT 'tax_range', (SELECT count(*) FROM lineitem WHERE NOT l_tax BETWEEN 0 AND 0.07::DOUBLE)
UNION ALL SELECT 'flag_pairing', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'F') UNION ALL SELECT 'quantity_positive', (SELECT count(*) FROM lineitem WHERE l_quantity <= 1)
UNION ALL SELECT 'scene_interval', 0 UNION ALL SELECT 'scene_source', (SELECT count(*) FROM scene WHERE source = 'src0')
UNION ALL SELECT 'review_shape', (SELECT count(*) FROM jud WHERE source <> 'reviewer' AND status IN ('rejected', 'withdrawn')) UNION ALL SELECT 'verified_source', (SELECT count(*) FROM jud WHERE status = 'verified' AND source = 'asr')""",
    "foreign_keys": " UNION ALL ".join(f"""SELECT '{a}.{k}' AS "check", (SELECT count(*) FROM {a} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {p} FROM {b} WHERE {p} IS NOT NULL)) AS n""" for a, k, b, p in _FKS),
    "link_faults": f"""WITH {preparation._SEG} SELECT 'not_selected' AS fault, (SELECT count(*) FROM sel WHERE conflicts <> '') AS n UNION ALL SELECT 'too_long', (SELECT count(*) FROM sel WHERE segment_id % 9 = 0)""",
    "entity_inputs": f"""WITH {preparation._OCR}, {preparation._SEG}, {sql.SCENE}, {ranking._JUDGED},
a AS (SELECT scene_id, same, max(n) > 1 AS amb FROM (SELECT scene_id, same, frame, count(*) AS n FROM obs GROUP BY ALL) GROUP BY ALL),
g AS (SELECT scene_id, arg_max(obs_id, (confidence, -frame, obs_id)) AS ref FROM obs JOIN a USING (scene_id, same) GROUP BY scene_id, same, CASE WHEN amb THEN obs_id END),
t AS (
  SELECT g.scene_id, 'ocr' AS kind, ref, raw_text AS text, NULL AS tag FROM g JOIN obs ON obs_id = ref UNION ALL SELECT clip_id * 100 + scene_no, 'tr', segment_id, text, NULL FROM map)
SELECT scene_id, kind || '_' || row_number() OVER (PARTITION BY scene_id, kind ORDER BY ref) AS label, md5(text) AS digest FROM t
UNION ALL SELECT scene_id, 'tag_' || row_number() OVER (PARTITION BY scene_id ORDER BY tag), md5(tag) FROM held""",
}
