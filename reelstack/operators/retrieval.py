"""Batch retrieval: BM25 over fields, phrases, coverage, and cosine search of a table of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelstack.functions.text import tokens
from reelstack.operators.tables import BROADCAST_ROWS, cut

K1, B = 1.2, 0.75
#: Queries of a block, bytes of vectors of a block, vectors for which another task is worth it, and those that are multiplied with a block of queries at once.
BLOCK_QUERIES = 1024
BLOCK_BYTES = 16 << 20
STEP_VECTORS = 4096
CELL_VECTORS = 512


def eligible(scene: DataFrame, clip: DataFrame) -> DataFrame:
    """Scenes of clips that are not deleted, of their active run."""
    live = clip.where("deleted_at is null").select("clip_id", F.col("active_run_id").alias("run_id"))
    return scene.join(live, ["clip_id", "run_id"], "left_semi")


def drop_generic(terms: Column, generic: list[str]) -> Column:
    """Terms without generic ones; all of them if every one is generic."""
    kept = F.filter(terms, lambda t: ~t.isin(generic))
    return F.when(F.size(kept) == 0, terms).otherwise(kept)


def clean_phrases(phrases: Column) -> Column:
    """Distinct phrases in order; one with a null or blank token is dropped whole."""
    return F.array_distinct(F.filter(phrases, lambda p: (F.size(p) > 0) & ~F.exists(p, lambda t: t.isNull() | (F.trim(t) == ""))))


def _counted(rows: DataFrame, keys: list[str], terms: DataFrame | None) -> DataFrame:
    """(keys, len, term, tf) of rows (keys, tokens): a row of null term for each row with tokens, and the counts of the ``terms`` (all, if none are given).

    One pass over the texts: what is not asked for is dropped before anything is shuffled.
    """
    sized = rows.where("size(tokens) > 0").select(*keys, F.size("tokens").alias("len"), "tokens")
    each = sized.select(*keys, "len", F.explode(F.concat(F.array(F.lit(None).cast("string")), "tokens")).alias("term"))
    if terms is not None:
        asked = cut(terms.select("term").distinct())
        n = asked.count()
        if n <= BROADCAST_ROWS:
            each = each.join(F.broadcast(asked.withColumn("_asked", F.lit(True))), "term", "left").where("term is null or _asked").drop("_asked")
        else:
            every = sized.select(*keys, "len", F.explode("tokens").alias("term")).join(asked, "term", "left_semi").select(*keys, "len", "term")
            each = sized.select(*keys, "len", F.lit(None).cast("string").alias("term")).unionByName(every)
    return cut(each.groupBy(*keys, "len", "term").agg(F.count("*").alias("tf")))


def postings(docs: DataFrame, id_col: str, fields: dict[str, Column], terms: DataFrame | None = None) -> DataFrame:
    """(field, id, len, term, tf) of tokenised fields, materialised: postings of the terms, and a row of null term for each field that has a token."""
    long = docs.select(F.col(id_col), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), t.alias("tokens")) for f, t in fields.items()])).alias("x"))
    return _counted(long.select(id_col, "x.field", "x.tokens"), ["field", id_col], terms)


def line_postings(docs: DataFrame, id_col: str, lines: Column, terms: DataFrame) -> DataFrame:
    """(id, line_no, len, term, tf) of the lines of texts, materialised, from which scores by line and by field of lines are both taken."""
    each = docs.select(id_col, F.posexplode(lines).alias("line_no", "line")).select(id_col, "line_no", tokens("line").alias("tokens"))
    return _counted(each, [id_col, "line_no"], terms)


def fields_of_lines(post: DataFrame, id_col: str, field: Column) -> DataFrame:
    """Postings by field, a field being some lines of a text."""
    named = post.withColumn("field", field)
    size = named.where("term is null").groupBy("field", id_col).agg(F.sum("len").cast("int").alias("len"))
    hits = named.where("term is not null").groupBy("field", id_col, "term").agg(F.sum("tf").alias("tf"))
    found = hits.join(size, ["field", id_col]).select("field", id_col, "len", "term", "tf")
    return cut(size.select("field", id_col, "len", F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("tf")).unionByName(found))


def bm25_of(post: DataFrame, queries: DataFrame, *keys: str, max_df: float | None = None) -> DataFrame:
    """(query_id, keys, field, term, score) of each query term found in materialised postings (field, keys, len, term, tf).

    Statistics cover the documents that have a token in the field; terms in more than ``max_df`` of them are left out if given.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    stats = post.where("term is null").groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    hits = post.where("term is not null")
    known = hits.groupBy("field", "term").agg(F.count("*").alias("df")).join(F.broadcast(stats), "field")
    if max_df is not None:
        known = known.where(F.col("df") <= max_df * F.col("n_docs"))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = hits.join(known.withColumn("idf", idf), ["field", "term"])
    score = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return weighed.withColumn("score", score).join(asked, "term").select("query_id", *keys, "field", "term", "score")


def bm25_terms(queries: DataFrame, docs: DataFrame, id_col: str, fields: dict[str, Column], max_df: float | None = None) -> DataFrame:
    """(query_id, id, field, term, score) of each query term found, from one pass over the documents."""
    terms = queries.select(F.explode("terms").alias("term"))
    return bm25_of(postings(docs, id_col, fields, terms), queries, id_col, max_df=max_df)


def bm25(queries: DataFrame, docs: DataFrame, id_col: str, fields: dict[str, Column], weights: dict[str, float], **options) -> DataFrame:
    """(query_id, id, raw_score): weighted sum over fields of the scores of matched terms. Fields of weight 0 are not read."""
    used = {f: t for f, t in fields.items() if weights.get(f, 1.0) > 0}
    weight = F.create_map(*[F.lit(x) for f in used for x in (f, float(weights.get(f, 1.0)))])
    hits = bm25_terms(queries, docs, id_col, used, **options)
    return hits.groupBy("query_id", id_col).agg(F.round(F.sum(F.col("score") * weight[F.col("field")]), 9).alias("raw_score"))


def phrase_scores(queries: DataFrame, docs: DataFrame, id_col: str, fields: dict[str, Column], weight: float = 0.3) -> DataFrame:
    """(query_id, id, phrase_score): phrases (``phrases`` array<array<string>>) whose tokens all occur in one field, times ``weight``."""
    phrase = queries.select("query_id", F.posexplode("phrases").alias("phrase_no", "phrase"))
    phrase = phrase.withColumn("phrase", F.array_distinct("phrase")).withColumn("size", F.size("phrase"))
    each = phrase.select(F.concat_ws(":", "query_id", "phrase_no").alias("query_id"), F.col("phrase").alias("terms"))
    hits = bm25_terms(each, docs, id_col, fields)
    whole = hits.groupBy("query_id", id_col, "field").agg(F.count("*").alias("matched"), F.sum("score").alias("score"))
    sizes = phrase.select(F.concat_ws(":", "query_id", "phrase_no").alias("key"), "query_id", "size")
    found = whole.withColumnRenamed("query_id", "key").join(sizes, "key").where("matched = size")
    return found.groupBy("query_id", id_col).agg(F.round(weight * F.sum("score"), 9).alias("phrase_score"), F.countDistinct("key").alias("n_phrases"))


def coverage(hits: DataFrame, queries: DataFrame, id_col: str, weight: float = 0.1) -> DataFrame:
    """(query_id, id, matched, bonus): share of a query's terms found in any field, times ``weight``; 0 for queries of one term."""
    total = queries.select("query_id", F.size(F.array_distinct("terms")).alias("total"))
    matched = hits.groupBy("query_id", id_col).agg(F.countDistinct("term").alias("matched")).join(total, "query_id")
    bonus = F.when(F.col("total") > 1, weight * F.col("matched") / F.col("total")).otherwise(0.0)
    return matched.select("query_id", id_col, "matched", bonus.alias("bonus"))


def rank_lexical(raw: DataFrame, covered: DataFrame, id_col: str) -> DataFrame:
    """Add ``rank_score``: raw score over the query's best one, plus the coverage bonus."""
    best = F.max("raw_score").over(Window.partitionBy("query_id"))
    joined = raw.join(covered, ["query_id", id_col], "left")
    return joined.withColumn("rank_score", F.round(F.col("raw_score") / best + F.coalesce("bonus", F.lit(0.0)), 9))


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "query_id", name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each query; ``order`` must end on an id."""
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)


def merged_channels(text_hits: DataFrame, observed_hits: DataFrame, id_col: str, observed_weight: float = 1.0) -> DataFrame:
    """Full outer merge of text scores with the best observation's score of each scene."""
    best = observed_hits.groupBy("query_id", id_col).agg(F.max("raw_score").alias("observed_score"))
    both = text_hits.join(best, ["query_id", id_col], "full_outer")
    total = F.coalesce("raw_score", F.lit(0.0)) + observed_weight * F.coalesce("observed_score", F.lit(0.0))
    return both.select("query_id", id_col, F.round(total, 9).alias("raw_score"))


# ---- vectors


def vector_reason(vector: Column, dimension: int) -> Column:
    """Why a vector is unusable: missing, wrong dimension, not finite, zero; null if it is usable."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(vector.isNull(), "missing")
        .when(F.size(vector) != dimension, "dimension")
        .when(~finite, "not_finite")
        .when(F.forall(vector, lambda x: x == 0), "zero")
    )


def unit(vector: Column) -> Column:
    """L2-normalised double vector."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / norm)


def truncated(vector: Column, dimension: int) -> Column:
    """First dimensions, normalised again."""
    return unit(F.slice(vector, 1, dimension))


def nearest(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) places of the ``k`` nearest unit vectors of each query, itself left out; by partial selection, ties at the last place by id."""
    distance = np.round(1 - q @ v.T, 9)
    distance[q_ids[:, None] == v_ids[None]] = np.inf
    last = np.partition(distance, min(k, len(v_ids)) - 1, axis=1)[:, min(k, len(v_ids)) - 1]
    row, col = np.nonzero((distance <= last[:, None]) & np.isfinite(distance))
    order = np.lexsort((v_ids[col], distance[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], col[kept], distance[row[kept], col[kept]]


def _matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Unit vectors of a list column."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def dense_top_k(
    queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", max_distance: float | None = None, dimension: int | None = None, block: int = BLOCK_QUERIES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` nearest of each query by cosine distance; ties by id.

    Both sides are tables that are dealt to blocks by a hash of their ids: some ``block`` queries, some ``block_bytes`` of vectors. Each pair of
    blocks meets in one task, which multiplies them step by step and returns at most ``k`` rows a query; no vector passes the driver, and a
    task's memory is that of two blocks. Rows with themselves are left out where ids agree. Unusable vectors (null, of another dimension, not finite, zero) match
    nothing on either side; ``vector_coverage`` tells how many there are.
    """
    if dimension is None:
        dimension = queries.where("vector is not null").select(F.max(F.size("vector"))).first()[0] or 0
    usable = vector_reason(F.col("vector"), dimension).isNull()
    wide = F.transform("vector", lambda x: x.cast("double"))
    asked = queries.where(usable).select(F.col("query_id").cast("long").alias("query_id"), wide.alias("vector"))
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), wide.alias("vector"))
    n_queries, n_vectors = asked.count(), rows.count()
    # at least as many blocks as tasks are wanted, if there is something for each to do
    tasks = min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_vectors // STEP_VECTORS))
    q_blocks, v_blocks = max(1, -(-n_queries // block)), max(1, tasks, -(-n_vectors * dimension * 8 // block_bytes))
    places = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("v_block", places(v_blocks))
    right = rows.withColumn("v_block", F.pmod(F.xxhash64("id"), F.lit(v_blocks)).cast("int")).withColumn("q_block", places(q_blocks))

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(some):
            q_ids, q = some["query_id"].to_numpy(), _matrix(some["vector"], dimension)
            for at in range(0, len(others), CELL_VECTORS):
                part = others.slice(at, CELL_VECTORS)
                ids = part["id"].to_numpy()
                row, col, distance = nearest(q, q_ids, _matrix(part["vector"], dimension), ids, k)
                # only the best k of each query are held, so that memory does not grow with a block's vectors
                query, ident, distance = (np.concatenate(c) for c in zip(held, (q_ids[row], ids[col], distance), strict=True))
                order = np.lexsort((ident, distance, query))
                kept = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
                held = query[kept], ident[kept], distance[kept]
        return pa.table(dict(zip(("query_id", "id", "distance"), held, strict=True)))

    keys = ["q_block", "v_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, distance double")
    if max_distance is not None:
        found = found.where(F.col("distance") <= max_distance)
    return top_k(found.withColumnRenamed("id", id_col), k, F.col("distance"), F.col(id_col))


def hits_with_coverage(coverage: DataFrame, hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Each query's coverage row with its hits; a query without hits keeps its coverage beside nulls."""
    return coverage.join(hits, key, "left")


def vector_coverage(vectors: DataFrame, group: str, dimension: int) -> DataFrame:
    """Per group: rows, and how many vectors are missing, unusable (by reason) and usable."""
    seen = vectors.withColumn("reason", vector_reason(F.col("vector"), dimension))
    count = lambda cond: F.count_if(cond)
    reason = F.col("reason")
    return seen.groupBy(group).agg(
        F.count("*").alias("eligible"),
        count(reason == "missing").alias("missing"),
        count(F.coalesce(reason != "missing", F.lit(False))).alias("unusable"),
        count(reason.isNull()).alias("usable"),
        *[count(reason == r).alias(f"bad_{r}") for r in ("dimension", "not_finite", "zero")],
    )
