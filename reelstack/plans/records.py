"""Registered queries: run and search records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstack.operators import curation as cu
from reelstack.operators import intervals as iv
from reelstack.operators import records as rc
from reelstack.operators.tables import cut
from reelstack.plans import preparation, ranking, search, sql
from reelstack.sources import views


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return views.table(spark, sf_dir, name)


def stage_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as stages of a run, written as JSON and read back; every 13th run recorded none."""
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "F", "done").otherwise("waiting")
    stamp = lambda c: F.date_format(F.max(c), "yyyy-MM-dd HH:mm:ss")
    stages = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat(F.lit("s"), "l_linenumber").alias("k")).agg(F.max(status).alias("status"), F.count("*").cast("int").alias("attempts"), stamp(F.to_timestamp("l_shipdate")).alias("started"), stamp(F.to_timestamp("l_shipdate") + F.make_interval(mins=F.col("l_linenumber"))).alias("finished"))
    entry = F.struct("k", F.struct("status", "attempts", F.concat(F.lit("broke "), "k").alias("error"), "started", "finished").alias("v"))
    runs = stages.groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("states"))
    runs = runs.withColumn("states", F.when(F.col("l_orderkey") % 13 != 0, F.col("states")))
    return rc.availability(rc.stage_states(runs, "l_orderkey", "states"), "l_orderkey", ["s1", "s2", "s3"], {"s1": "caption", "s2": "dialogue"})


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_orderdate")
    return rc.offset_page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 20, 10).select("o_orderkey", "o_custkey", "total")


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return cu.keyset_page(rows, (50, 100), ["o_custkey", "o_orderkey"], 25)


def explicit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date windows of queries, those of every third being replaced by the user's filter."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    found = ranking.date_windows(spark, sf_dir).select("query_id", "field", text("start"), text("end_exclusive"))
    own = found.where("query_id % 3 = 0").select("query_id", "field", F.lit("1996-01-01").alias("start"), F.lit("1997-01-01").alias("end_exclusive"))
    return rc.overridden(found, own, ["query_id", "field"])


def frames_in_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir).select("scene_id", "clip_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    points = _t(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").alias("clip_id"), "event_id", (F.col("event_id") * 37 % 100000).alias("at_ms"))
    return rc.inside_ranges(points, s, "clip_id", "at_ms", 10_000).select("event_id", "scene_id", "at_ms")


def exclusion_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions by query, and how many still point at a scene that may be shown."""
    rules = ranking.exclusions(spark, sf_dir).distinct()
    live = search.eligible_scenes(spark, sf_dir).select("scene_id", F.lit(True).alias("live"))
    return rules.join(live, "scene_id", "left").groupBy("query_id").agg(F.count("*").alias("rules"), F.count_if("live").alias("valid"))


def pending_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence on scenes and tags that no reviewer has confirmed."""
    j = ranking.judgements(spark, sf_dir).where("scene_id is not null")
    judged = j.where("source = 'reviewer' and status = 'verified'").select("scene_id", "tag").distinct()
    return j.where("source <> 'reviewer'").join(judged, ["scene_id", "tag"], "left_anti").groupBy("scene_id", "tag").agg(F.count("*").alias("n"))


def sibling_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a reported result's own search, by order."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    reported = li.where("l_linenumber = 1 and l_partkey % 4 = 0").select("l_orderkey")
    return reported.distinct().join(li.where("l_linenumber > 1"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


def publish_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.element_at(F.array(F.lit("provided"), F.lit("asr"), F.lit("none")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    runs = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), source.alias("transcript_source"))
    active = runs.groupBy("clip_id").agg(F.min("run_id").alias("run_id"), F.min_by("transcript_source", "run_id").alias("transcript_source"))
    return rc.activated(active, runs.where("status = 'F'"))


def pending_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rules of their order's report."""
    li = _t(spark, sf_dir, "lineitem")
    return rc.pending_rules(li.select(F.col("l_orderkey").alias("report_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rule_id"), (F.col("l_linestatus") == "O").alias("active"), (F.col("l_returnflag") == "R").alias("rejected")))


def typed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and texts at paths of a JSON text, null where they are of another type; every fifth number is written as a text that is none."""
    e = _t(spark, sf_dir, "events").where("value is not null")
    number = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.floor("value").cast("string"))
    text = F.to_json(F.struct(F.struct(number.alias("n"), F.col("event_type").alias("t")).alias("a")))
    return e.select("event_id", rc.typed_path(text, "$.a.n", r"^-?\d+$", "bigint").alias("n"), rc.typed_path(text, "$.a.t", "^[a-z]+$", "string").alias("t"), rc.typed_path(text, "$.a.x", ".*", "string").alias("x"))


def record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of search results and selections; results of orders stand for recorded ranks."""
    judged = cut(iv.select_by_priority(preparation.segments(spark, sf_dir), preparation.TIERS))
    li = _t(spark, sf_dir, "lineitem")
    return cu.violations(
        {
            "recorded_ranks": rc.rank_faults(li.where("l_partkey % 50 <> 0"), "l_orderkey", "l_linenumber"),
            "selection": rc.selection_faults(judged),
            "unfounded_exclusion": rc.unfounded_exclusions(judged.where("segment_id % 7 <> 0 or not selected"), preparation.TIERS),
            "scene_without_end": views.scenes(spark, sf_dir).where("end_ms <= start_ms"),
            "run_without_clip": cu.orphans(_t(spark, sf_dir, "orders"), "o_custkey", _t(spark, sf_dir, "customer").where("c_custkey % 10 <> 0"), "c_custkey"),
        }
    )


def effective_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective rank of the embeddings (singular values, rows only)."""
    return rc.effective_rank(search.vectors(spark, sf_dir)[1], "vector")


QUERIES = {f.__name__: f for f in (stage_availability, history_page, keyset_page, explicit_windows, frames_in_scenes, exclusion_validity, pending_candidates, sibling_results, publish_runs, pending_rules, typed_paths, record_faults, effective_rank)}

ORACLE_SQL = {
    "stage_availability": """WITH s AS (
  SELECT l_orderkey, CASE WHEN l_orderkey % 13 <> 0 THEN 's' || l_linenumber END AS st, max(CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'done' ELSE 'waiting' END) AS x, 60 * max(l_linenumber) AS sec
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
p AS (
  SELECT l_orderkey, coalesce(string_agg(DISTINCT CASE WHEN x = 'failed' AND st IS NOT NULL THEN st END, ',' ORDER BY CASE WHEN x = 'failed' AND st IS NOT NULL THEN st END), '') AS failed,
         array_to_string(list_filter(['s1', 's2', 's3'], lambda k: NOT coalesce(list_contains(list(st), k), false)), ',') AS missing,
         concat_ws(',', CASE WHEN NOT coalesce(bool_or(st = 's1' AND x = 'done'), false) THEN 'caption' END, CASE WHEN NOT coalesce(bool_or(st = 's2' AND x = 'done'), false) THEN 'dialogue' END) AS missing_channels,
         count(*) FILTER (x = 'done' AND st IS NOT NULL) AS done, count(st) AS n, CAST(sum(sec) FILTER (st IS NOT NULL) AS BIGINT) AS seconds, 'broke ' || min(st) FILTER (x = 'failed') AS reason FROM s GROUP BY 1)
SELECT * EXCLUDE (n), CASE WHEN n = 0 THEN 'legacy' WHEN failed = '' AND missing = '' THEN 'available' WHEN done > 0 THEN 'partial' ELSE 'unavailable' END AS availability FROM p""",
    "history_page": "SELECT o_orderkey, o_custkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10 OFFSET 20",
    "keyset_page": "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (50, 100) ORDER BY 1, 2 LIMIT 25",
    "explicit_windows": f"""SELECT item_id AS query_id, 'broadcast' AS field, CASE WHEN item_id % 3 = 0 THEN '1996-01-01' ELSE {ranking._MONTH.format('item_id')} END AS "start",
       CASE WHEN item_id % 3 = 0 THEN '1997-01-01' ELSE strftime(CAST({ranking._MONTH.format('item_id')} AS DATE) + INTERVAL 36 MONTH, '%Y-%m-%d') END AS end_exclusive FROM benchmark""",
    "frames_in_scenes": f"WITH {sql.SCENE} SELECT event_id, scene_id, event_id * 37 % 100000 AS at_ms FROM events JOIN scene ON clip_id = user_id AND event_id * 37 % 100000 >= start_ms AND event_id * 37 % 100000 < end_ms",
    "exclusion_validity": f"""WITH {sql.LEXICAL}, {ranking._EXCL}
SELECT query_id, count(*) AS rules, count(*) FILTER (scene_id IN (SELECT scene_id FROM eligible)) AS valid FROM (SELECT DISTINCT * FROM excl) GROUP BY 1""",
    "pending_candidates": f"WITH {sql.SCENE}, {ranking._JUDGED} SELECT scene_id, tag, count(*) AS n FROM jud WHERE scene_id IS NOT NULL AND source <> 'reviewer' AND (scene_id, tag) NOT IN (SELECT (scene_id, tag) FROM jud WHERE scene_id IS NOT NULL AND source = 'reviewer' AND status = 'verified') GROUP BY ALL",
    "sibling_results": """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber > 1 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 4 = 0)""",
    "publish_runs": """WITH a AS (SELECT o_custkey AS clip_id, min(o_orderkey) AS a, max(o_orderkey) FILTER (o_orderstatus = 'F') AS r FROM orders GROUP BY 1), x AS (SELECT clip_id, CASE WHEN r > a THEN r ELSE a END AS run_id, coalesce(r > a, false) AS changed FROM a)
SELECT clip_id, run_id, ['provided', 'asr', 'none'][run_id % 3 + 1] AS transcript_source, changed FROM x""",
    "pending_rules": "SELECT l_orderkey AS report_id, count(*) AS pending, max(l_orderkey * 10 + l_linenumber) AS newest FROM lineitem WHERE l_linestatus <> 'O' AND l_returnflag <> 'R' GROUP BY 1",
    "typed_paths": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS BIGINT) END AS n, CASE WHEN regexp_full_match(event_type, '[a-z]+') THEN event_type END AS t, CAST(NULL AS VARCHAR) AS x FROM events WHERE value IS NOT NULL",
    "record_faults": f"""WITH {preparation._SEG},
bad AS (SELECT segment_id FROM sel d WHERE conflicts <> '' AND NOT EXISTS (
  SELECT 1 FROM sel u WHERE u.clip_id = d.clip_id AND u.conflicts = '' AND u.segment_id % 7 <> 0 AND greatest(u.s, d.s) < least(u.e, d.e) AND (u.source = 'uploaded' AND d.source <> 'uploaded' OR u.source = 'embedded' AND d.source = 'asr')))
SELECT 'unfounded_exclusion' AS "check", (SELECT count(*) FROM bad) AS n UNION ALL SELECT 'recorded_ranks' AS "check", (SELECT count(DISTINCT l_orderkey) FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_partkey % 50 <> 0) WHERE n <> l_linenumber) AS n
UNION ALL SELECT 'selection', 0 UNION ALL SELECT 'scene_without_end', 0
UNION ALL SELECT 'run_without_clip', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0))""",
}
