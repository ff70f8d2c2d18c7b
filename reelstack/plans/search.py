"""Registered queries: lexical and dense retrieval and their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstack.functions.text import tokens
from reelstack.operators import dictionary as dic
from reelstack.operators import evaluate as ev
from reelstack.operators import retrieval as rt
from reelstack.operators import topk
from reelstack.operators.tables import cut
from reelstack.plans import sql
from reelstack.sources import views

GENERIC = ["the", "de", "and"]
PHRASE_WEIGHT = 0.3
#: Neighbours farther away than this are none.
MAX_DISTANCE = 0.75


def fields() -> dict:
    return {"caption": tokens("caption"), "transcript": tokens("transcript")}


def eligible_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene = views.scenes(spark, sf_dir)
    return rt.eligible(scene, views.clips(scene))


def lexical(spark: SparkSession, sf_dir: str, k: int = 200, of: tuple[str, ...] = ("caption", "transcript"), queries: DataFrame | None = None) -> DataFrame:
    """Top scenes of each query by BM25 over some fields."""
    queries = views.search_queries(spark, sf_dir) if queries is None else queries
    scene = eligible_scenes(spark, sf_dir)
    read = {f: fields()[f] for f in of}
    found = topk.best(queries, scene, "scene_id", F.array(*read.values()), k, weights=(1.0,) * len(read))
    if found is None:
        raw = rt.bm25(queries, scene, "scene_id", read, {})
    else:
        raw = found.select("query_id", "scene_id", F.round("score", 9).alias("raw_score"))
    return rt.top_k(raw, k, F.desc("raw_score"), F.col("scene_id"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir).select("query_id", "scene_id", F.round("raw_score", 6).alias("raw_score"), "rank")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of eligible scenes as observations."""
    scene = eligible_scenes(spark, sf_dir)
    lines = scene.select("scene_id", F.posexplode(F.split(F.concat_ws("\n", "caption", "transcript"), "\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "").withColumn("obs_id", F.concat_ws("-", "scene_id", "line_no"))


def bm25_fields_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of fields and of the best line with the bonus for covered terms, all from one pass over the lines."""
    queries, scene = views.search_queries(spark, sf_dir), eligible_scenes(spark, sf_dir)
    lines = F.split(F.concat_ws("\n", "caption", "transcript"), "\n")
    found = topk.best(queries, scene, "scene_id", F.transform(lines, tokens), 200, with_parts=True)
    ranked = by_joins(queries, scene, lines) if found is None else by_parts(found, queries)
    top = rt.top_k(ranked, 200, F.desc("rank_score"), F.desc("raw_score"), F.col("scene_id"))
    return top.select("query_id", "scene_id", "matched", F.round("raw_score", 6).alias("raw_score"), F.round("rank_score", 6).alias("rank_score"), "rank")


def synonym_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, word): words of the queries that agree in their first four letters and have at least six stand for synonyms; groups of two to five."""
    words = views.search_queries(spark, sf_dir).select(F.explode("terms").alias("word")).where("length(word) >= 6").distinct()
    group = words.groupBy(F.substring("word", 1, 4).alias("group_id")).agg(F.collect_set("word").alias("words"))
    return group.where("size(words) between 2 and 5").select("group_id", F.explode("words").alias("word"))


def synonym_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top scenes of each query by BM25 with the synonyms of its words among its terms."""
    queries = dic.with_synonyms(views.search_queries(spark, sf_dir), cut(synonym_groups(spark, sf_dir)))
    top = lexical(spark, sf_dir, queries=queries)
    sizes = queries.select("query_id", F.size("terms").alias("n_terms"))
    return top.join(sizes, "query_id").select("query_id", "scene_id", "n_terms", F.round("raw_score", 6).alias("raw_score"), "rank")


def by_parts(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Rank scores of the few scenes that can be among a query's best."""
    raw = F.round(F.round("score", 9) + F.col("part_score"), 9)
    total = queries.select("query_id", F.size(F.array_distinct("terms")).alias("total"))
    bonus = F.when(F.col("total") > 1, topk.COVERAGE * F.col("matched") / F.col("total")).otherwise(0.0)
    scored = found.withColumn("raw_score", raw).join(total, "query_id")
    return scored.withColumn("rank_score", F.round(F.col("raw_score") / F.round("top", 9) + bonus, 9))


def by_joins(queries: DataFrame, scene: DataFrame, lines: Column) -> DataFrame:
    """The same of all scenes, by joins of postings: for more queries than tasks should be sent."""
    post = rt.line_postings(scene, "scene_id", lines, queries.select(F.explode("terms").alias("term")))
    by_field = rt.fields_of_lines(post, "scene_id", F.when(F.col("line_no") == 0, "caption").otherwise("transcript"))
    hits = cut(rt.bm25_of(by_field, queries, "scene_id"))
    seen = cut(rt.bm25_of(post.withColumn("field", F.lit("line")), queries, "scene_id", "line_no"))
    raw = hits.groupBy("query_id", "scene_id").agg(F.round(F.sum("score"), 9).alias("raw_score"))
    per_obs = seen.groupBy("query_id", "scene_id", "line_no").agg(F.sum("score").alias("raw_score"))
    merged = rt.merged_channels(raw, per_obs, "scene_id", 1.0)
    every = hits.select("query_id", "scene_id", "term").unionByName(seen.select("query_id", "scene_id", "term"))
    return rt.rank_lexical(merged, rt.coverage(every, queries, "scene_id"), "scene_id")


def phrase_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = views.search_queries(spark, sf_dir).withColumn("words", tokens("text"))
    kept = rt.drop_generic(F.col("terms"), GENERIC)
    words = F.col("words")
    # neighbouring word pairs of the passage are its phrases; a phrase of query terms only adds nothing
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.slice(words, i, 2))
    phrases = F.filter(rt.clean_phrases(pairs), lambda p: (F.size(F.array_except(p, kept)) > 0) & ~F.forall(p, lambda t: t.isin(GENERIC)))
    asked = queries.select("query_id", phrases.alias("phrases"))
    scene = eligible_scenes(spark, sf_dir)
    found = topk.best_phrases(asked, scene, "scene_id", F.array(*fields().values()), 200)
    if found is None:
        found = rt.phrase_scores(asked, scene, "scene_id", fields())
    else:
        found = found.withColumn("phrase_score", F.round(PHRASE_WEIGHT * F.col("score"), 9))
    return rt.top_k(found, 200, F.desc("phrase_score"), F.col("scene_id")).select("query_id", "scene_id", "n_phrases", F.round("phrase_score", 5).alias("phrase_score"), "rank")


def token_document_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most widespread caption tokens, from which generic tokens are chosen."""
    scene = eligible_scenes(spark, sf_dir).select("scene_id", F.explode(F.array_distinct(tokens("caption"))).alias("token"))
    n = eligible_scenes(spark, sf_dir).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    df = scene.groupBy("token").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "token").limit(50).withColumn("one", F.lit(1))
    return df.join(F.broadcast(n), "one").select("token", "df", F.round(F.col("df") / F.col("n"), 6).alias("share"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vec = views.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return vec.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), "vector"), vec


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, vec = vectors(spark, sf_dir)
    return rt.dense_top_k(queries, vec, 200, max_distance=MAX_DISTANCE).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vec = vectors(spark, sf_dir)
    # rows stand for missing and broken vectors by their id
    broken = F.when(F.col("vec_id") % 11 == 0, F.lit(None)).when(F.col("vec_id") % 13 == 0, F.slice("vector", 1, 3)).when(F.col("vec_id") % 7 == 0, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector"))
    size = vec.select(F.size("vector")).first()[0]
    return rt.vector_coverage(vec.withColumn("vector", broken), "label", size)


def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and nDCG at 10 of BM25, by passage length."""
    tier = F.when(F.size(tokens("text")) >= 40, "core").otherwise("hard")
    ranked = lexical(spark, sf_dir, 10)
    queries = views.search_queries(spark, sf_dir).select("query_id", tier.alias("tier"))
    return ev.single_answer_metrics(queries, ev.first_hit(views.gold(spark, sf_dir), ranked), ranked, 10, "tier")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, vec = vectors(spark, sf_dir)
    asked = queries.select("query_id", F.col("query_label").alias("label"))
    return ev.label_metrics(asked, vec.select("vec_id", "label"), rt.dense_top_k(queries, vec, 10), 10, "vec_id")


def failure_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate by how many character bigrams a query shares with its answer's caption."""
    hits = ev.first_hit(views.gold(spark, sf_dir), lexical(spark, sf_dir, 10))
    answers = views.gold(spark, sf_dir).groupBy("query_id").agg(F.min("scene_id").alias("scene_id"))
    joined = answers.join(views.scenes(spark, sf_dir).select("scene_id", "caption"), "scene_id").join(views.search_queries(spark, sf_dir).select("query_id", "text"), "query_id").join(hits, "query_id", "left")
    band = ev.overlap_band(F.col("text"), F.col("caption")).alias("band")
    return joined.groupBy(band).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit_rank").isNotNull().cast("double")), 6).alias("hit_rate"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_fields_coverage, synonym_search, phrase_expansion, token_document_share, dense_topk, vector_coverage, search_metrics, retrieval_metrics, failure_bands)}

_METRIC = """
  count(*) AS n_queries, count(*) FILTER (answered) AS n_responded, count(*) FILTER (coalesce(hit_rank <= 10, false)) AS hits,
  round(avg(CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall, round(avg(CASE WHEN hit_rank <= 10 THEN 1 / log2(hit_rank + 1) ELSE 0 END), 6) AS ndcg,
  round(avg(CASE WHEN answered THEN CASE WHEN hit_rank <= 10 THEN 1.0 ELSE 0 END END), 6) AS recall_responded,
  round(avg(CASE WHEN answered THEN CASE WHEN hit_rank <= 10 THEN 1 / log2(hit_rank + 1) ELSE 0 END END), 6) AS ndcg_responded"""
_HIT = "hit AS (SELECT g.query_id, min(rank) AS hit_rank FROM gold g LEFT JOIN (SELECT * FROM lexical WHERE rank <= 10) l USING (query_id, scene_id) GROUP BY 1)"

ORACLE_SQL = {
    "bm25_topk": f"WITH {sql.LEXICAL} SELECT query_id, scene_id, round(raw_score, 6) AS raw_score, rank FROM lexical",
    "bm25_fields_coverage": f"""WITH {sql.LEXICAL},
obs AS (
  SELECT scene_id, scene_id || '-' || (i - 1) AS obs_id, line FROM (
    SELECT scene_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT scene_id, string_split(caption || chr(10) || transcript, chr(10)) AS l FROM eligible))
  WHERE trim(line) <> ''),
{sql.bm25({'line': sql.tok('line')}, 'obs', 'obs_id', prefix='o_')},
seen AS (SELECT *, CAST(split_part(obs_id, '-', 1) AS BIGINT) AS scene_id FROM o_hits),
best AS (SELECT query_id, scene_id, max(s) AS observed FROM (SELECT query_id, scene_id, obs_id, sum(score) AS s FROM seen GROUP BY ALL) GROUP BY ALL),
merged AS (SELECT query_id, scene_id, round(coalesce(raw_score, 0) + coalesce(observed, 0), 9) AS raw_score FROM raw FULL JOIN best USING (query_id, scene_id)),
cov AS (SELECT query_id, scene_id, count(DISTINCT term) AS matched FROM (SELECT query_id, scene_id, term FROM hits UNION ALL SELECT query_id, scene_id, term FROM seen) GROUP BY ALL),
r AS (
  SELECT m.query_id, m.scene_id, matched, raw_score,
         round(raw_score / max(raw_score) OVER (PARTITION BY m.query_id) + coalesce(CASE WHEN len(terms) > 1 THEN 0.1 * matched / len(terms) ELSE 0 END, 0), 9) AS rank_score
  FROM merged m LEFT JOIN cov USING (query_id, scene_id) JOIN query q ON q.query_id = m.query_id)
SELECT query_id, scene_id, matched, round(raw_score, 6) AS raw_score, round(rank_score, 6) AS rank_score,
       row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, raw_score DESC, scene_id) AS rank
FROM r QUALIFY rank <= 200""",
    "synonym_search": f"""WITH {sql.ELIGIBLE}, {sql.QUERY},
{sql.SYNONYMS},
{sql.bm25({'caption': sql.tok('caption'), 'transcript': sql.tok('transcript')}, 'eligible', 'scene_id', query='wide')},
raw AS (SELECT query_id, scene_id, round(sum(score), 9) AS raw_score FROM hits GROUP BY ALL)
SELECT query_id, scene_id, len(terms) AS n_terms, round(raw_score, 6) AS raw_score, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, scene_id) AS rank
FROM raw JOIN wide USING (query_id) QUALIFY rank <= 200""",
    "phrase_expansion": f"""WITH {sql.ELIGIBLE}, {sql.QUERY},
w AS (SELECT query_id, terms, {sql.tok('text')} AS w, CASE WHEN len(list_filter(terms, lambda t: t NOT IN ('the', 'de', 'and'))) = 0 THEN terms ELSE list_filter(terms, lambda t: t NOT IN ('the', 'de', 'and')) END AS kept FROM query),
p0 AS (SELECT query_id, kept, unnest(range(1, greatest(len(w), 2))) AS i, w FROM w),
p1 AS (SELECT query_id, i, w[i:i+1] AS p, kept FROM p0),
p2 AS (SELECT query_id, p, min(i) AS i, any_value(kept) AS kept FROM p1 GROUP BY query_id, p),
p3 AS (
  SELECT query_id, p, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM p2
  WHERE len(list_filter(p, lambda t: NOT list_contains(kept, t))) > 0 AND len(list_filter(p, lambda t: t NOT IN ('the', 'de', 'and'))) > 0),
phrase AS (SELECT query_id AS q, query_id || ':' || (n - 1) AS query_id, list_distinct(p) AS terms FROM p3),
{sql.bm25({'caption': sql.tok('caption'), 'transcript': sql.tok('transcript')}, 'eligible', 'scene_id', query='phrase')},
f AS (SELECT query_id, scene_id, field, count(*) AS m, sum(score) AS score FROM hits GROUP BY ALL),
s AS (
  SELECT q AS query_id, scene_id, round(0.3 * sum(score), 9) AS phrase_score, count(DISTINCT f.query_id) AS n_phrases
  FROM f JOIN phrase p ON p.query_id = f.query_id AND m = len(terms) GROUP BY ALL)
SELECT query_id, scene_id, n_phrases, round(phrase_score, 5) AS phrase_score, row_number() OVER (PARTITION BY query_id ORDER BY phrase_score DESC, scene_id) AS rank
FROM s QUALIFY rank <= 200""",
    "token_document_share": f"""WITH {sql.ELIGIBLE}
SELECT token, count(*) AS df, round(count(*) / (SELECT count(*) FROM eligible), 6) AS share
FROM (SELECT DISTINCT scene_id, unnest({sql.tok('caption')}) AS token FROM eligible) GROUP BY 1 ORDER BY df DESC, token LIMIT 50""",
    "dense_topk": f"WITH {sql.DENSE} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM dense WHERE rank <= 200 AND distance <= 0.75",
    "vector_coverage": """WITH v AS (
  SELECT label, CASE WHEN vec_id % 11 = 0 THEN 'missing' WHEN vec_id % 13 = 0 THEN 'dimension' WHEN vec_id % 7 = 0 THEN 'zero' END AS r FROM embeddings)
SELECT label, count(*) AS eligible, count(*) FILTER (r = 'missing') AS missing, count(*) FILTER (r <> 'missing') AS unusable, count(*) FILTER (r IS NULL) AS usable,
       count(*) FILTER (r = 'dimension') AS bad_dimension, 0 AS bad_not_finite, count(*) FILTER (r = 'zero') AS bad_zero FROM v GROUP BY 1""",
    "search_metrics": f"""WITH {sql.LEXICAL}, {sql.GOLD}, {_HIT}
SELECT CASE WHEN len({sql.tok('text')}) >= 40 THEN 'core' ELSE 'hard' END AS tier, {_METRIC}
FROM query q LEFT JOIN hit USING (query_id) LEFT JOIN (SELECT DISTINCT query_id, true AS answered FROM lexical) USING (query_id) GROUP BY 1""",
    "retrieval_metrics": f"""WITH {sql.DENSE},
t AS (SELECT query_id, count(*) FILTER (label = query_label) AS n_relevant, count(*) FILTER (label = query_label AND rank <= 10) AS n,
        sum(CASE WHEN label = query_label AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) FILTER (label = query_label AND rank <= 10) AS first FROM dense GROUP BY 1)
SELECT query_id, n_relevant, round(n / n_relevant, 6) AS recall, round(n / 10, 6) AS precision,
       round(dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr
FROM t WHERE n_relevant > 0""",
    "failure_bands": f"""WITH {sql.LEXICAL}, {sql.GOLD}, {_HIT},
a AS (SELECT query_id, min(scene_id) AS scene_id FROM gold GROUP BY 1),
g AS (
  SELECT query_id, caption, hit_rank, list_distinct(list_transform(range(1, greatest(length(text), 2)), lambda i: substr(text, i, 2))) AS x,
         list_distinct(list_transform(range(1, greatest(length(caption), 2)), lambda i: substr(caption, i, 2))) AS y
  FROM a JOIN scene USING (scene_id) JOIN query USING (query_id) LEFT JOIN hit USING (query_id))
SELECT CASE WHEN length(caption) = 0 THEN 'empty' WHEN len(list_intersect(x, y)) = 0 THEN 'none' WHEN len(list_intersect(x, y)) / len(x) < 0.25 THEN 'low' ELSE 'high' END AS band,
       count(*) AS n, round(avg(CASE WHEN hit_rank IS NULL THEN 0.0 ELSE 1 END), 6) AS hit_rate
FROM g GROUP BY 1""",
}
