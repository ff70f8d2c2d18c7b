"""The registered queries of the operators in this subpackage, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstack.llm import langid
from reelstack.llm.decontaminate import decontaminate
from reelstack.llm.filter_audit import audit_filters
from reelstack.llm.html_extract import extract_text
from reelstack.llm.line_dedup import dedup_lines
from reelstack.llm.lm_score import score_texts
from reelstack.llm.merkle import document_manifest
from reelstack.llm.mixing import mix_sources, mixture
from reelstack.llm.near_dup import near_duplicates
from reelstack.llm.preference import digest, format_preferences, swapped_reply_pairs
from reelstack.llm.quality_bayes import classify_quality
from reelstack.llm.quality_rules import quality_rules
from reelstack.llm.toxicity import toxicity, train


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(column, n: int):
    return F.crc32(column.cast("string")) % n


def _held_out(n: int, fold: int):
    """Whether a row's id falls in the fold that is not learned from; a row without an id does not."""
    return F.coalesce(_remainder(F.col("doc_id"), n) == fold, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = train(docs, _read(spark, sf_dir, "labels"), keep=lambda i: _remainder(i, 3) != 1)
    return toxicity(docs, model).select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted", "n_words", "difference")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(_read(spark, sf_dir, "documents"), keep=lambda i: _remainder(i, 10) != 0)
    return scored.withColumn("held_out", _held_out(10, 0))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = classify_quality(docs, _read(spark, sf_dir, "labels"), keep=lambda i: _remainder(i, 3) != 1)
    return out.withColumn("held_out", _held_out(3, 1))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op7_mix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: whole documents, one row per copy taken."""
    return mixture(_read(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), edited=True)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs, keep=lambda i: _remainder(i, 4) != 2)
    return langid.detect_language(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages"))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(format_preferences(swapped_reply_pairs(_read(spark, sf_dir, "conversations"))))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(_read(spark, sf_dir, "documents"), _remainder(F.col("doc_id"), 7) == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_score": op2_lm_score,
    "op3_quality_rules": op3_quality_rules,
    "op10_preferences": op10_preferences,
    "op9_language": op9_language,
    "op8_decontaminate": op8_decontaminate,
    "op4_quality": op4_quality,
    "op6_html_text": op6_html_text,
    "op7_mix_sources": op7_mix_sources,
    "op7_mix_shards": op7_mix_shards,
    "op5_near_duplicates": op5_near_duplicates,
    "op11_line_dedup": op11_line_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
}

#: White space of a text, as SQL spells it.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"



ORACLE_SQL: dict[str, str] = {
    "op10_preferences": """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, i, text, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM t WHERE role = 'assistant'),
p AS (
  SELECT l.conv_id, l.i AS last, l.text AS reply, coalesce(o.text, b.text) AS worse
  FROM a l LEFT JOIN a o ON o.conv_id = xor(l.conv_id, 1) AND o.back = 1 LEFT JOIN a b ON b.conv_id = l.conv_id AND b.back = 2
  WHERE l.back = 1 AND coalesce(o.text, b.text) IS NOT NULL),
h AS (
  SELECT p.conv_id, coalesce(string_agg('<|' || replace(t.role, '<|', '<\\|') || '|>' || chr(10) || replace(t.text, '<|', '<\\|') || '<|end|>' || chr(10), '' ORDER BY t.i), '') AS head
  FROM p LEFT JOIN t ON t.conv_id = p.conv_id AND t.i < p.last GROUP BY 1),
r AS (
  SELECT p.*, head, '<|assistant|>' || chr(10) AS top,
         replace(reply, '<|', '<\\|') || '<|end|>' || chr(10) AS good, replace(worse, '<|', '<\\|') || '<|end|>' || chr(10) AS bad, reply = worse AS same
  FROM p JOIN h USING (conv_id))
SELECT conv_id AS pair_id, CAST(CASE WHEN same THEN last ELSE last - 1 END AS INTEGER) AS n_common,
       CASE WHEN same THEN head || top || good ELSE head END AS prompt,
       CASE WHEN same THEN '' ELSE top || good END AS chosen_text,
       CASE WHEN same THEN '' ELSE length(top) || '-' || length(top || good) END AS chosen_loss,
       CASE WHEN same THEN '' ELSE top || bad END AS rejected_text,
       CASE WHEN same THEN '' ELSE length(top) || '-' || length(top || bad) END AS rejected_loss,
       NOT same AS usable
FROM r
""",
    "op11_line_dedup": f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM rows, unnest(range(1, len(lines) + 1)) AS u(i)),
shared AS (SELECT key, min(doc_id) AS keeper FROM line WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INT) >= 2),
told AS (SELECT l.*, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS lost FROM line l LEFT JOIN shared USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM told GROUP BY r""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
         sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))}) AS changed FROM documents),
crc_table AS (
  WITH RECURSIVE c(n, k, v) AS (SELECT range, 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM c WHERE k < 8)
  SELECT list(v ORDER BY n) AS t FROM c WHERE k = 8),
crc AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(4294967295 AS BIGINT) AS v FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, i + 1, xor(t[1 + xor(v & 255, CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS INT), 1)) AS BIGINT))], v // 256) FROM crc, crc_table WHERE i < length(CAST(doc_id AS VARCHAR))),
bad AS (SELECT doc_id FROM crc WHERE i = length(CAST(doc_id AS VARCHAR)) AND (4294967295 - v) % 7 = 0),
leaf AS (
  SELECT doc_id, lang, leaf, CASE WHEN doc_id IN (FROM bad) THEN changed ELSE leaf END AS claimed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
node AS (
  SELECT 0 AS level, lang, pos, leaf AS h, n FROM leaf
  UNION ALL
  SELECT level + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM node WHERE n > 1 GROUP BY level, lang, pos // 2, n),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM node WHERE n = 1),
up AS (
  SELECT 0 AS level, place AS pos, subroot AS h, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY level, pos // 2, n),
walk AS (
  SELECT doc_id, leaf, lang, 0 AS level, pos, n, '' AS proof, claimed AS folded, row_number() OVER () AS r FROM leaf
  UNION ALL
  SELECT w.doc_id, w.leaf, w.lang, w.level + 1, w.pos // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''),
         sha256(CASE WHEN w.pos % 2 = 0 THEN w.folded || coalesce(s.h, '') ELSE s.h || w.folded END), w.r
  FROM walk w LEFT JOIN node s ON s.level = w.level AND s.lang IS NOT DISTINCT FROM w.lang AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
top AS (
  SELECT doc_id, leaf, subroot, 0 AS level, place AS pos, s.n, proof, folded, r FROM walk w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.pos // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''),
         sha256(CASE WHEN w.pos % 2 = 0 THEN w.folded || coalesce(s.h, '') ELSE s.h || w.folded END), w.r
  FROM top w LEFT JOIN up s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM top, (SELECT h FROM up WHERE n = 1) WHERE n = 1""",
    "op13_filter_audit": """
WITH label AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         CAST(len(words) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) AS INT)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > least, false) AS INT) AS mask
  FROM w LEFT JOIN label l ON l.doc_id = w.doc_id),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, unnest(range(1, 6)) AS u(step)),
r AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, own,
         sum(CASE WHEN mask & (CAST(before AS INT) | own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INT) > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INT) = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INT) = 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM cell, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}
