"""Common table expressions of the SQL twins: the same role views in DuckDB SQL."""

SCENE = """scene AS (
  SELECT doc_id AS scene_id, doc_id // 10 AS clip_id, CASE WHEN (doc_id // 10) % 5 = 0 THEN doc_id % 2 + 1 ELSE 1 END AS run_id,
         doc_id % 10 * 10000 AS start_ms, doc_id % 10 * 10000 + 10000 AS end_ms,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS caption,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS transcript,
         CASE doc_id % 4 WHEN 0 THEN 'b_roll' WHEN 1 THEN 'anchor' ELSE 'field' END AS shot_type, lang, source
  FROM documents)"""
CLIP = """clip AS (
  SELECT DISTINCT clip_id, CASE WHEN clip_id % 17 = 0 THEN TIMESTAMP '1970-01-01' END AS deleted_at, CASE WHEN clip_id % 5 = 0 THEN 2 ELSE 1 END AS active_run_id
  FROM scene)"""
ELIGIBLE = f"""{SCENE}, {CLIP},
eligible AS (SELECT s.* FROM scene s JOIN clip c ON s.clip_id = c.clip_id AND s.run_id = c.active_run_id AND c.deleted_at IS NULL)"""


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


def first_distinct(x: str) -> str:
    return f"list_filter({x}, lambda el, i: list_position({x}, el) = i)"


QUERY = f"""query AS (
  SELECT item_id AS query_id, text, {first_distinct('w')} AS terms
  FROM (SELECT item_id, text, {tok('text')} AS w FROM benchmark))"""
GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS scene_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def bm25(fields: dict[str, str], source: str, ident: str, query: str = "query", prefix: str = "") -> str:
    """CTEs ``{prefix}hits`` (query_id, id, field, term, score) of BM25 over the token expressions ``fields`` of ``source``."""
    long = " UNION ALL ".join(f"SELECT {ident}, '{f}' AS field, {t} AS toks FROM {source}" for f, t in fields.items())
    return f"""{prefix}long AS (SELECT * FROM ({long}) WHERE len(toks) > 0),
{prefix}stat AS (SELECT field, count(*) AS n_docs, avg(len(toks)) AS avg_len FROM {prefix}long GROUP BY 1),
{prefix}asked AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(terms) AS term FROM {query})),
{prefix}post AS (
  SELECT field, {ident}, term, n, count(*) AS tf FROM (SELECT field, {ident}, len(toks) AS n, unnest(toks) AS term FROM {prefix}long)
  WHERE term IN (SELECT term FROM {prefix}asked) GROUP BY ALL),
{prefix}df AS (SELECT field, term, count(*) AS df FROM {prefix}post GROUP BY ALL),
{prefix}hits AS (
  SELECT a.query_id, {ident}, p.field, p.term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len)) AS score
  FROM {prefix}post p JOIN {prefix}df USING (field, term) JOIN {prefix}stat USING (field) JOIN {prefix}asked a USING (term))"""


LEXICAL = f"""{ELIGIBLE}, {QUERY}, {bm25({'caption': tok('caption'), 'transcript': tok('transcript')}, 'eligible', 'scene_id')},
raw AS (SELECT query_id, scene_id, round(sum(score), 9) AS raw_score FROM hits GROUP BY ALL),
lexical AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, scene_id) AS rank FROM raw
  QUALIFY rank <= 200)"""
SYNONYMS = """word AS (SELECT DISTINCT w AS word FROM (SELECT unnest(terms) AS w FROM query) WHERE length(w) >= 6),
grp AS (SELECT substr(word, 1, 4) AS g, list(word) AS words FROM word GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5),
wide AS (
  SELECT query_id, list_distinct(list_concat(any_value(terms), coalesce(flatten(list(words) FILTER (words IS NOT NULL)), []))) AS terms
  FROM query LEFT JOIN grp ON len(list_intersect(words, terms)) > 0 GROUP BY query_id)"""
COSINE = "round(1 - list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))), 9)"
DENSE = f"""vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dense AS (
  SELECT q.vec_id AS query_id, d.vec_id, q.label AS query_label, d.label, {COSINE} AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE}, d.vec_id) AS rank
  FROM vec q JOIN vec d ON d.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)"""
