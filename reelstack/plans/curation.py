"""Registered queries: reports, curation, evaluation, quality checks, event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstack.functions import text as tx
from reelstack.operators import curation as cu
from reelstack.operators import evaluate as ev
from reelstack.operators import intervals as iv
from reelstack.operators import retrieval as rt
from reelstack.operators.tables import cut
from reelstack.plans import ranking, search, sql
from reelstack.sources import views
from reelstack.streaming import event_time as et


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return views.table(spark, sf_dir, name)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("clip_id"), F.col("o_orderkey").cast("long").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.latest(runs(spark, sf_dir), ["clip_id"], F.desc("created_at"), F.desc("run_id")).select("clip_id", "run_id", "status")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.zero_filled_counts(runs(spark, sf_dir), "status", ["O", "F", "P", "X"])


def run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clip: scenes, and how many have a caption, a transcript, a tag and a vector."""
    s = views.scenes(spark, sf_dir)
    tagged = ranking.held_tags(spark, sf_dir).select("scene_id").distinct().withColumn("tagged", F.lit(True))
    vectors = _t(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("scene_id"), F.lit(True).alias("embedded")).dropDuplicates(["scene_id"])
    return s.join(tagged, "scene_id", "left").join(vectors, "scene_id", "left").groupBy("clip_id").agg(
        F.count("*").alias("scenes"), F.count_if(F.trim("caption") != "").alias("captioned"), F.count_if(F.trim("transcript") != "").alias("transcribed"), F.count_if("tagged").alias("tagged"), F.count_if("embedded").alias("embedded")
    )


def publication_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of which every scene is long enough and any has a text, spoken or observed elsewhere, with their text source."""
    s = views.scenes(spark, sf_dir).withColumn("ok", F.length("caption") >= 2)
    observed = s.select("scene_id", "clip_id").join(_t(spark, sf_dir, "labels").select(F.col("doc_id").alias("scene_id")), "scene_id", "left_semi").select("clip_id").distinct()
    per = s.groupBy("clip_id").agg(F.bool_and("ok").alias("frames_ok"), F.bool_or(F.trim("transcript") != "").alias("has_text"), F.bool_or(F.col("source") == "src1").alias("provided"))
    per = per.join(observed.withColumn("observed", F.lit(True)), "clip_id", "left").na.fill(False, ["observed"])
    return per.select("clip_id", (F.col("frames_ok") & (F.col("has_text") | F.col("observed"))).alias("ready"), "observed", F.when(F.col("provided"), "provided").when(F.col("has_text"), "asr").otherwise("none").alias("text_source"))


def inquiry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports joined down to their region, the reviewer being optional."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    r = _t(spark, sf_dir, "region").select("r_regionkey", "r_name")
    s = _t(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select("s_suppkey", "s_name")
    chain = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return chain.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name", "s_name")


def evidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = ranking.judgements(spark, sf_dir).withColumn("tagging", F.concat_ws("-", "clip_id", F.coalesce("scene_id", F.lit(-1)), "tag")).withColumn("confidence", F.col("evidence_id") % 100 / 100)
    return cu.evidence_rollup(j, "tagging")


def first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.first_texts(search.observations(spark, sf_dir), "scene_id", "line", "line_no").select("scene_id", F.size("texts").alias("n"), F.array_join("texts", "|").alias("texts"))


def dedupe_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return cu.deduplication_outcome(d, "content_hash", "source", F.col("doc_id")).select("doc_id", "outcome")


def upsert_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taggings of odd events that are not among those of even ones; clip-wide taggings have no scene."""
    j = ranking.judgements(spark, sf_dir)
    keys = ["clip_id", "scene_id", "tag"]
    return cu.insert_if_absent(j.where("evidence_id % 4 < 2").select(keys), j.where("evidence_id % 4 >= 2").select(keys), keys)


def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.clips(views.scenes(spark, sf_dir))
    return cu.soft_deleted(c, c.where("clip_id % 3 = 0").select("clip_id"), "clip_id", F.timestamp_seconds(F.lit(86400))).select("clip_id", F.unix_timestamp("deleted_at").alias("deleted_s"))


def lease_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").where("ts is not null").withColumn("expires", F.col("ts") + F.make_interval(mins=F.lit(5)))
    return cu.expired_leases(e, "expires", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("event_id")


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether transcripts add to captions: reciprocal rank with both fields against the caption alone."""
    gold = cut(views.gold(spark, sf_dir))

    def reciprocal(name: str, *of: str) -> DataFrame:
        ranked = search.lexical(spark, sf_dir, 50, of)
        return ev.first_hit(gold, ranked).select("query_id", F.coalesce(1 / F.col("hit_rank"), F.lit(0.0)).alias(name))

    both = reciprocal("a", "caption").join(reciprocal("b", "caption", "transcript"), "query_id")
    return ev.paired_bootstrap(both, "query_id", "a", "b")


def slot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots (words) found for scenes against their gold slots by language: means, pooled shares, and the verdicts that are no sets."""
    s = views.scenes(spark, sf_dir).select("scene_id", "lang", F.array_distinct(tx.tokens("caption")).alias("w"))
    gold, optional = F.filter("w", lambda x, i: i % 3 != 2), F.filter("w", lambda x, i: i % 3 == 2)
    # what was found: every fifth word was missed, and scenes of every fourth number get a phrase of the query
    found = F.concat(F.filter("w", lambda x, i: i % 5 != 4), F.when(F.col("scene_id") % 4 == 1, F.array(F.lit("show me"))).otherwise(F.array().cast("array<string>")))
    rows = s.select("scene_id", "lang", "w", gold.alias("gold"), optional.alias("optional"), found.alias("found"))
    score = ev.set_scores(F.col("gold"), F.col("found"), F.col("optional"))
    intent, wanted = F.col("scene_id") % 3, F.when(F.col("scene_id") % 7 == 0, 0).otherwise(F.col("scene_id") % 3)
    flag = ev.slot_flags(intent, wanted, F.col("gold"), F.col("found"), F.col("optional"), ["show", "find"], F.filter("found", lambda x: F.length(x) > 4), F.col("w"))
    rows = rows.select("scene_id", "lang", *[c.alias(n) for n, c in (score | flag).items()])
    mean = [F.round(F.avg(m), 6).alias(m) for m in ("precision", "recall", "f1")]
    pooled = [ev.ratio(F.sum("allowed"), F.sum("n_found")).alias("micro_precision"), ev.ratio(F.sum("hit"), F.sum("n_gold")).alias("micro_recall")]
    quiet = ev.ratio(F.count_if(~F.col("leak") & (F.col("scene_id") % 4 == 1)), F.count_if(F.col("scene_id") % 4 == 1)).alias("suppression")
    spans = ev.span_exact_rate(F.col("n_found"), F.when(F.col("scene_id") % 6 == 0, F.least("n_found", F.lit(1))).otherwise(0)).alias("span_exact")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), *mean, *pooled, *[F.count_if(f).alias(f) for f in flag], quiet, spans)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by kind: attempts, valid ones, mean, and percentiles by three rules."""
    e = _t(spark, sf_dir, "events").where("value is not null").select("event_type", "value")
    base = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("attempted"), F.count("value").alias("valid"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.stddev_samp("value"), 6).alias("stdev"))
    return base.join(ev.index_percentile(e, "value", 0.95, "event_type"), "event_type").join(ev.index_percentile(e, "value", 0.9, "event_type", ceil=True), "event_type")


def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents by quality and toxicity and over all, in one pass of grouping sets."""
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    per = rows.cube("lang", "quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.round(F.avg("n"), 6).alias("mean_chars"), F.grouping_id().alias("level"))
    return per.where("level in (0, 1, 3)").select("lang", "quality", F.col("n"), "toxic", "mean_chars", F.col("level").cast("int").alias("level"))


def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities found against gold ones (capitalised caption words, typed by length): strict by scene, attributable in the clip, and recall over all and over answered scenes."""
    s = views.scenes(spark, sf_dir).select("clip_id", "scene_id", F.explode(F.array_distinct(F.split("caption", " "))).alias("value")).where(F.col("value").rlike("^[A-Z][a-z]+$"))
    kind, key = F.when(F.length("value") % 2 == 0, "person").otherwise("place"), F.lower("value")
    gold = s.select("clip_id", "scene_id", kind.alias("type"), key.alias("key")).distinct()
    # every third scene was not answered, one in five answers is of the next scene, and words of four letters got the wrong type
    wrong = F.when(F.length("value") == 4, "place").otherwise(kind)
    found = s.where("scene_id % 3 <> 0").select("clip_id", (F.col("scene_id") + F.when(F.col("scene_id") % 5 == 0, 1).otherwise(0)).alias("scene_id"), wrong.alias("type"), key.alias("key")).distinct()
    return ev.entity_scores(gold, found)


def embedding_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of all pairs and uniformity of a hashed sample of pairs."""
    _, vec = search.vectors(spark, sf_dir)
    return cu.pairwise_health(vec.select("vec_id", rt.unit(F.col("vector")).alias("u")), "vec_id", "u")


def gold_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").where(F.trim("text") != "").select(F.col("doc_id").alias("id"), "source")
    return cu.stratified(rows, "source", 60).select("id", "source", "turn")


def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, orders, li, cust = (_t(spark, sf_dir, n) for n in ("documents", "orders", "lineitem", "customer"))
    return cu.violations(
        {
            "document_id_repeated": cu.repeated_keys(docs, "doc_id"),
            "document_content_repeated": cu.repeated_keys(docs, "text"),
            "order_without_customer": cu.orphans(orders, "o_custkey", cust, "c_custkey"),
            "item_without_order": cu.orphans(li, "l_orderkey", orders, "o_orderkey"),
            "item_quantity_range": li.where("not l_quantity between 1 and 45"),
            "event_value_range": _t(spark, sf_dir, "events").where("value < 0 or value > 90"),
            "label_without_document": cu.orphans(_t(spark, sf_dir, "labels"), "doc_id", docs, "doc_id"),
            "text_damaged": docs.where(tx.damaged("text")),
            "text_invisible": docs.where(F.col("text").rlike("[​⁠﻿]")),
            "item_number_gap": li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"), F.count("*").alias("c")).where("m <> c"),
        }
    )


def scene_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips whose scenes do not tile them."""
    s = views.scenes(spark, sf_dir).where("scene_id % 13 <> 5").select("clip_id", (F.col("scene_id") % 10).alias("scene_no"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return iv.tiling_faults(s, s.select("clip_id").distinct().withColumn("duration", F.lit(100000)))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").where("ts is not null").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"), F.col("value").alias("duration"))


def latency_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by hour and path: count, mean, greatest, and percentiles from mergeable buckets."""
    return et.latency_summary(et.latency_buckets(requests(spark, sf_dir), None), "hour", "path")


def heartbeat_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = _t(spark, sf_dir, "events").where("ts is not null and user_id is not null").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).distinct()
    return et.expired_batch(beats, 6 * 3600).select("key", F.date_format("last_beat", "yyyy-MM-dd HH:mm:ss").alias("last_beat"), F.date_format("expired_at", "yyyy-MM-dd HH:mm:ss").alias("expired_at"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_run, status_counts, run_coverage, publication_ready, inquiry_list, evidence_rollup, first_texts, dedupe_content, upsert_tags, soft_delete, lease_expired, paired_bootstrap, slot_scores,
        run_summary, candidate_summary, entity_scores, embedding_health, gold_sample, dq_report, scene_tiling, latency_hist, heartbeat_timeout,
    )
}

_JUD = f"WITH {sql.SCENE}, {ranking._JUDGED}"
_MRR = f"""a AS (SELECT g.query_id, coalesce(1 / min(rank), 0) AS x FROM gold g LEFT JOIN (SELECT query_id, scene_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, scene_id) AS rank FROM (SELECT query_id, scene_id, round(sum(score), 9) AS s FROM hits WHERE field = 'caption' GROUP BY ALL) QUALIFY rank <= 50) USING (query_id, scene_id) GROUP BY 1),
b AS (SELECT g.query_id, coalesce(1 / min(rank), 0) AS y FROM gold g LEFT JOIN (SELECT query_id, scene_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, scene_id) AS rank FROM (SELECT query_id, scene_id, round(sum(score), 9) AS s FROM hits GROUP BY ALL) QUALIFY rank <= 50) USING (query_id, scene_id) GROUP BY 1),
d AS (SELECT query_id, y - x AS d FROM a JOIN b USING (query_id)),
h AS (SELECT d, CAST(('0x' || substr(md5(CAST(query_id AS VARCHAR)), 1, 8)) AS BIGINT) AS x, CAST(('0x' || substr(md5(CAST(query_id AS VARCHAR)), 9, 8)) AS BIGINT) AS y FROM d),
t0 AS (SELECT b, d, (x + b * y) & 4294967295 AS t FROM h, range(10000) r(b)),
t1 AS (SELECT b, d, (xor(t, t >> 15) * 739982445) & 4294967295 AS t FROM t0),
t2 AS (SELECT b, d, (xor(t, t >> 12) * 695872825) & 4294967295 AS t FROM t1),
u AS (SELECT b, d, xor(t, t >> 15) / 4294967296.0::DOUBLE AS u FROM t2),
r AS (SELECT b, d, len(list_filter({list(ev.DRAWS)}, lambda c: u >= c)) AS w FROM u),
m AS (SELECT b, sum(w * d) / sum(w) AS m FROM r GROUP BY 1 HAVING sum(w) > 0)"""

ORACLE_SQL = {
    "latest_run": "SELECT o_custkey AS clip_id, o_orderkey AS run_id, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "status_counts": "SELECT v.s AS status, count(o_orderkey) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = v.s GROUP BY 1",
    "run_coverage": f"""{_JUD}, t AS (SELECT DISTINCT scene_id FROM held), e AS (SELECT DISTINCT vec_id AS scene_id FROM embeddings)
SELECT clip_id, count(*) AS scenes, count(*) FILTER (trim(caption, ' ') <> '') AS captioned, count(*) FILTER (trim(transcript, ' ') <> '') AS transcribed, count(t.scene_id) AS tagged, count(e.scene_id) AS embedded
FROM scene s LEFT JOIN t ON t.scene_id = s.scene_id LEFT JOIN e ON e.scene_id = s.scene_id GROUP BY 1""",
    "publication_ready": f"""WITH {sql.SCENE}, p AS (SELECT clip_id, bool_and(length(caption) >= 2) AS f, bool_or(trim(transcript, ' ') <> '') AS h, bool_or(source = 'src1') AS v, bool_or(scene_id IN (SELECT doc_id FROM labels)) AS o FROM scene GROUP BY 1)
SELECT clip_id, f AND (h OR o) AS ready, o AS observed, CASE WHEN v THEN 'provided' WHEN h THEN 'asr' ELSE 'none' END AS text_source FROM p""",
    "inquiry_list": """SELECT l_orderkey, l_linenumber, c_name, n_name, r_name, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 3 <> 0""",
    "evidence_rollup": f"""{_JUD}
SELECT clip_id || '-' || coalesce(scene_id, -1) || '-' || tag AS tagging, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
       CASE WHEN bool_or(status = 'rejected') THEN 'rejected' WHEN bool_or(status = 'verified') THEN 'verified' ELSE 'unverified' END AS status, max((event_id % 100) / 100) AS confidence, count(*) AS n
FROM jud GROUP BY 1""",
    "first_texts": f"""WITH {sql.ELIGIBLE},
o AS (SELECT scene_id, line AS t, i FROM (SELECT scene_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT scene_id, string_split(caption || chr(10) || transcript, chr(10)) AS l FROM eligible)) WHERE trim(line, ' ') <> ''),
f AS (SELECT scene_id, t, min(i) AS i FROM o GROUP BY ALL)
SELECT scene_id, count(*) AS n, string_agg(t, '|' ORDER BY i) AS texts FROM f GROUP BY 1""",
    "dedupe_content": """SELECT doc_id, CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN source IS NOT DISTINCT FROM first_value(source) OVER w THEN 'duplicate_own' ELSE 'duplicate_other' END AS outcome
FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id)""",
    "upsert_tags": f"{_JUD} SELECT DISTINCT clip_id, scene_id, tag FROM jud WHERE event_id % 4 >= 2 EXCEPT SELECT clip_id, scene_id, tag FROM jud WHERE event_id % 4 < 2",
    "soft_delete": f"WITH {sql.SCENE}, {sql.CLIP} SELECT clip_id, CAST(epoch(CASE WHEN clip_id % 3 = 0 THEN coalesce(deleted_at, TIMESTAMP '1970-01-02') ELSE deleted_at END) AS BIGINT) AS deleted_s FROM clip",
    "lease_expired": "SELECT event_id FROM events WHERE TIMESTAMP '2024-01-10' > ts + INTERVAL 5 MINUTE + INTERVAL 15 SECOND",
    "paired_bootstrap": f"""WITH {sql.LEXICAL}, {sql.GOLD}, {_MRR}
SELECT (SELECT count(*) FROM d) AS n, (SELECT round(avg(d), 6) FROM d) AS mean_diff, (SELECT count(*) FROM d WHERE d > 0) AS wins, (SELECT count(*) FROM d WHERE d = 0) AS ties, (SELECT count(*) FROM d WHERE d < 0) AS losses,
       round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
    "slot_scores": f"""WITH {sql.SCENE}, w0 AS (SELECT scene_id, lang, {sql.tok('caption')} AS w FROM scene), w AS (SELECT scene_id, lang, {sql.first_distinct('w')} AS w FROM w0),
s AS (SELECT scene_id, lang, w, list_filter(w, lambda x, i: i % 3 <> 0) AS g, list_filter(w, lambda x, i: i % 3 = 0) AS o, list_concat(list_filter(w, lambda x, i: i % 5 <> 0), CASE WHEN scene_id % 4 = 1 THEN ['show me'] ELSE [] END) AS f FROM w),
c AS (
  SELECT *, len(list_filter(f, lambda x: list_contains(g, x) OR list_contains(o, x))) AS allowed, len(list_filter(g, lambda x: list_contains(f, x))) AS hit, len(f) AS nf, len(g) AS ng,
         len(list_filter(f, lambda x: contains(x, 'show') OR contains(x, 'find'))) > 0 AS leak, len(list_filter(f, lambda x: length(x) > 4 AND NOT list_contains(w, x))) > 0 AS hallu FROM s),
p AS (SELECT *, CASE WHEN nf > 0 THEN allowed / nf ELSE 1.0 END AS p, CASE WHEN ng > 0 THEN hit / ng ELSE 1.0 END AS r, (scene_id % 3 = CASE WHEN scene_id % 7 = 0 THEN 0 ELSE scene_id % 3 END) AND hit = ng AND allowed = nf AS frame FROM c)
SELECT lang, count(*) AS n, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, round(sum(allowed) / nullif(sum(nf), 0), 6) AS micro_precision, round(sum(hit) / nullif(sum(ng), 0), 6) AS micro_recall,
       count(*) FILTER (frame) AS frame, count(*) FILTER (leak) AS leak, count(*) FILTER (hallu) AS hallucination, round(count(*) FILTER (NOT leak AND scene_id % 4 = 1) / nullif(count(*) FILTER (scene_id % 4 = 1), 0), 6) AS suppression,
       round((sum(nf) - sum(CASE WHEN scene_id % 6 = 0 THEN least(nf, 1) ELSE 0 END)) / nullif(sum(nf), 0), 6) AS span_exact FROM p GROUP BY 1""",
    "run_summary": """WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT e.event_type, count(*) AS attempted, count(e.value) AS valid, round(avg(e.value), 6) AS mean, round(median(e.value), 6) AS median, round(stddev_samp(e.value), 6) AS stdev,
       (SELECT max(value) FROM v WHERE v.event_type = e.event_type AND i = least(floor(n * 0.95), n - 1)) AS value_p95, (SELECT max(value) FROM v WHERE v.event_type = e.event_type AND i = least(ceil(n * 0.9) - 1, n - 1)) AS value_p90
FROM events e GROUP BY 1""",
    "candidate_summary": """SELECT lang, quality, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS toxic, round(avg(length(text)), 6) AS mean_chars, CAST(grouping(lang, quality) AS INTEGER) AS level
FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (lang), ())""",
    "entity_scores": f"""WITH {sql.SCENE}, v AS (SELECT DISTINCT clip_id, scene_id, unnest(string_split(caption, ' ')) AS value FROM scene), s AS (SELECT * FROM v WHERE regexp_full_match(value, '[A-Z][a-z]+')),
g AS (SELECT DISTINCT clip_id, scene_id, CASE WHEN length(value) % 2 = 0 THEN 'person' ELSE 'place' END AS type, lower(value) AS key FROM s),
f AS (SELECT DISTINCT clip_id, scene_id + CASE WHEN scene_id % 5 = 0 THEN 1 ELSE 0 END AS scene_id, CASE WHEN length(value) <> 4 AND length(value) % 2 = 0 THEN 'person' ELSE 'place' END AS type, lower(value) AS key FROM s WHERE scene_id % 3 <> 0),
j AS (SELECT f.*, (clip_id, scene_id, type, key) IN (SELECT (clip_id, scene_id, type, key) FROM g) AS hit, (clip_id, type, key) IN (SELECT (clip_id, type, key) FROM g) AS near FROM f),
k AS (SELECT g.*, (clip_id, scene_id, type, key) IN (SELECT (clip_id, scene_id, type, key) FROM f) AS hit, (clip_id, scene_id) IN (SELECT (clip_id, scene_id) FROM f) AS answered FROM g)
SELECT *, round(strict / found, 6) AS strict_precision, round(attributable / found, 6) AS attributable_precision, round(recalled / gold, 6) AS recall, round(recalled / nullif(answered, 0), 6) AS answered_recall FROM
  (SELECT count(*) AS found, count(*) FILTER (hit) AS strict, count(*) FILTER (near) AS attributable, count(*) FILTER (NOT near) AS outside FROM j), (SELECT count(*) AS gold, count(*) FILTER (hit) AS recalled, count(*) FILTER (answered) AS answered FROM k)""",
    "embedding_health": """WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: e / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS x FROM embeddings),
t AS (SELECT count(*) AS n FROM v), c AS (SELECT sum(s * s) AS q FROM (SELECT i, sum(x[i]) AS s FROM v, range(1, 5000) r(i) WHERE i <= len(x) GROUP BY 1)),
k AS (SELECT x, r, md5(r || ':' || vec_id) AS k FROM v, range(8) t(r)),
p AS (SELECT list_dot_product(x, y) AS c FROM (SELECT x, lag(x) OVER (PARTITION BY r, substr(k, 1, 2) ORDER BY k) AS y FROM k) WHERE y IS NOT NULL)
SELECT CAST(n * (n - 1) // 2 AS BIGINT) AS pairs, round((q - n) / (n * (n - 1)), 6) AS mean_cosine, (SELECT count(*) FROM p) AS sampled_pairs, (SELECT round(ln(avg(exp(-2 * (2 - 2 * c)))), 6) FROM p) AS uniformity FROM t, c""",
    "gold_sample": """SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS turn FROM documents WHERE trim(text, ' ') <> '' ORDER BY turn, source LIMIT 60""",
    "dq_report": """SELECT * FROM (
SELECT 'document_id_repeated' AS "check", (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL
SELECT 'document_content_repeated', (SELECT count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)) UNION ALL
SELECT 'order_without_customer', (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL) UNION ALL
SELECT 'item_without_order', (SELECT count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey IS NOT NULL) UNION ALL
SELECT 'item_quantity_range', (SELECT count(*) FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 45) UNION ALL
SELECT 'event_value_range', (SELECT count(*) FROM events WHERE value < 0 OR value > 90) UNION ALL
SELECT 'label_without_document', (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) UNION ALL
SELECT 'text_damaged', (SELECT count(*) FROM documents WHERE contains(text, chr(65533))) UNION ALL
SELECT 'text_invisible', (SELECT count(*) FROM documents WHERE contains(text, chr(8203)) OR contains(text, chr(8288)) OR contains(text, chr(65279))) UNION ALL
SELECT 'item_number_gap', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_linenumber) <> count(*))))""",
    "scene_tiling": f"""WITH {sql.SCENE}, s AS (SELECT clip_id, scene_id, start_ms AS s, end_ms AS e, lag(end_ms) OVER w AS p, row_number() OVER w AS n FROM scene WHERE scene_id % 13 <> 5 WINDOW w AS (PARTITION BY clip_id ORDER BY start_ms)),
f AS (SELECT clip_id, CASE WHEN n = 1 AND s <> 0 THEN 'late_start' WHEN s > p THEN 'gap' WHEN s < p THEN 'overlap' END AS fault FROM s UNION ALL SELECT clip_id, CASE WHEN max(e) <> 100000 THEN 'wrong_end' END FROM s GROUP BY 1)
SELECT clip_id, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY ALL""",
    "latency_hist": f"""WITH l AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type AS path, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most, list_sort(list(value) FILTER (value IS NOT NULL)) AS v FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)
SELECT hour, path, n, mean, most, round(list_filter({list(et.BOUNDS)}, lambda b: b >= v[CAST(ceil(len(v) * 0.5) AS INT)])[1], 6) AS p50, round(list_filter({list(et.BOUNDS)}, lambda b: b >= v[CAST(ceil(len(v) * 0.95) AS INT)])[1], 6) AS p95 FROM l""",
    "heartbeat_timeout": """WITH b AS (SELECT DISTINCT user_id, ts FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL), l AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM b)
SELECT CAST(user_id AS VARCHAR) AS key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_beat, strftime(ts + INTERVAL 6 HOUR + INTERVAL 15 SECOND, '%Y-%m-%d %H:%M:%S') AS expired_at FROM l WHERE nx > ts + INTERVAL 6 HOUR + INTERVAL 15 SECOND""",
}
