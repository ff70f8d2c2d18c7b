"""Exact best k documents of each query by BM25, without a row for each query, document and term.

Queries are a stated set: their terms, while counted to be few, travel to the tasks. Then texts are tokenised once, no posting is shuffled, and
what leaves a task is at most k rows (and ties) of each query:

1. ``counted``: each document's asked terms, by part (a field or a line), as arrays in the document's row.
2. ``statistics``: document frequencies, lengths and greatest term frequencies, summed in each task before they are shuffled.
3. ``thresholds``: the k-th best score of each query over a hashed slice of the documents, which no better k-th score of all can undercut.
4. ``best``: a query's terms are taken from the rarest on; as soon as the upper bounds of the remaining ones cannot reach the threshold alone, they are
   looked up only for documents that have a chance with them. Each task keeps the best k of a query, and the few rows that are left are ranked.

Scores are equal to those of ``retrieval.bm25`` up to the order of sums; they are rounded in the end, and no row within ``SLACK`` of a threshold is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelstack.functions.batches import lean
from reelstack.operators.retrieval import K1, B
from reelstack.operators.tables import BROADCAST_ROWS, cut

#: Documents whose scores are held at once, and cells of a block's score matrix: a frequent term is a posting for each document and query of a block.
BLOCK_DOCS = 256
BLOCK_CELLS = 1 << 18
#: Difference of scores that rounding may hide.
SLACK = 1e-8
#: Documents of the slice that gives thresholds, for each wanted row.
SLICE_ROWS = 20
COVERAGE = 0.1


@dataclass(frozen=True)
class Queries:
    """Terms by code, and a compressed table of the queries of each term; ``size`` is a query's number of terms."""

    ids: np.ndarray
    size: np.ndarray
    terms: list[str]
    start: np.ndarray
    query: np.ndarray

    def few(self, lo: int, hi: int) -> Queries:
        """The queries from ``lo`` to ``hi``."""
        held = (self.query >= lo) & (self.query < hi)
        start = np.concatenate([[0], np.cumsum(held)])[self.start]
        return replace(self, ids=self.ids[lo:hi], size=self.size[lo:hi], start=start, query=self.query[held] - lo)


@dataclass(frozen=True)
class Statistics:
    """By field (and last, by part): number with a token, mean length; by field and code: inverse document frequency, greatest score."""

    n: np.ndarray
    mean: np.ndarray
    idf: np.ndarray
    bound: np.ndarray


def asked(queries: DataFrame, most: int = BROADCAST_ROWS) -> Queries | None:
    """The queries' distinct terms, or None where there are more than tasks should be sent."""
    each = cut(queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")))
    if each.count() > most:
        return None
    got = each.collect()
    ids = sorted({r["query_id"] for r in got})
    terms = sorted({r["term"] for r in got})
    q_at, t_at = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
    pairs = np.array(sorted((t_at[r["term"]], q_at[r["query_id"]]) for r in got), np.int64).reshape(-1, 2)
    start = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    return Queries(np.array(ids, np.int64), np.bincount(pairs[:, 1], minlength=len(ids)), terms, start, pairs[:, 1])


def counted(docs: DataFrame, id_col: str, parts: Column, terms: list[str]) -> DataFrame:
    """(id, lens, part, code, tf), materialised: lengths of all parts, and the asked terms of each. ``parts``: array<array<string>>."""
    words = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("parts")
            per_doc = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            inner = column.flatten()
            lens = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.fill_null(pc.index_in(inner.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            held = code >= 0
            key, tf = np.unique(np.repeat(np.arange(len(lens)), lens)[held] * len(words) + code[held], return_counts=True)
            at, code = key // max(len(words), 1), key % max(len(words), 1)
            doc, first = np.repeat(np.arange(len(per_doc)), per_doc), np.cumsum(per_doc) - per_doc
            found = np.bincount(doc[at], minlength=len(per_doc))
            lists = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), lists(per_doc, lens), lists(found, at - first[doc[at]]), lists(found, code), lists(found, tf)], names=["id", "lens", "part", "code", "tf"])

    rows = lean(docs.select(F.col(id_col).cast("long").alias("id"), parts.alias("parts")))
    return cut(rows.mapInArrow(run, "id long, lens array<int>, part array<int>, code array<int>, tf array<int>"))


@dataclass
class _Block:
    """Some documents' postings: by part, and summed by field (the first part is field 0, all others are the last field)."""

    id: np.ndarray
    part_doc: np.ndarray
    part_len: np.ndarray
    at: np.ndarray
    code: np.ndarray
    tf: np.ndarray
    field_len: np.ndarray
    f_at: np.ndarray
    f_code: np.ndarray
    f_tf: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], n_terms: int, n_fields: int, docs: int = BLOCK_DOCS) -> Iterator[_Block]:
    for whole in batches:
        for begin in range(0, len(whole), docs):
            b = whole.slice(begin, docs)
            flat = {c: b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lens", "part", "code", "tf")}
            per_doc, found = (b.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lens", "code"))
            part_doc, first = np.repeat(np.arange(len(b)), per_doc), np.cumsum(per_doc) - per_doc
            doc = np.repeat(np.arange(len(b)), found)
            number = np.arange(len(part_doc)) - first[part_doc]
            field_len = np.bincount(part_doc * n_fields + np.minimum(number, n_fields - 1), weights=flat["lens"], minlength=len(b) * n_fields)
            key = (doc * n_fields + np.minimum(flat["part"], n_fields - 1)) * n_terms + flat["code"]
            some, place = np.unique(key, return_inverse=True)
            yield _Block(b.column("id").to_numpy(), part_doc, flat["lens"], first[doc] + flat["part"], flat["code"], flat["tf"], field_len, some // n_terms, some % n_terms, np.bincount(place, weights=flat["tf"], minlength=len(some)))


def statistics(rows: DataFrame, n_terms: int, n_fields: int) -> Statistics:
    """Statistics of fields and parts over all documents; one row for each field and code comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(n_fields + 1, np.int64), np.zeros(n_fields + 1, np.int64)
        df, most = np.zeros((n_fields + 1, n_terms), np.int64), np.zeros((n_fields + 1, n_terms), np.int64)
        for b in _blocks(batches, n_terms, n_fields):
            for f in range(n_fields + 1):
                if f < n_fields:
                    length, at = b.field_len[f::n_fields], b.f_at % n_fields == f
                    code, tf = b.f_code[at], b.f_tf[at].astype(np.int64)
                else:
                    length, code, tf = b.part_len, b.code, b.tf
                n[f] += np.count_nonzero(length)
                total[f] += int(length.sum())
                df[f] += np.bincount(code, minlength=n_terms)
                np.maximum.at(most[f], code, tf)
        field, code = np.nonzero(df)
        every = np.arange(n_fields + 1)
        columns = (np.concatenate([every, field]), np.concatenate([np.full(n_fields + 1, -1), code]), np.concatenate([n, df[field, code]]), np.concatenate([total, most[field, code]]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["field", "code", "n", "x"])

    sums = rows.mapInArrow(run, "field long, code long, n long, x long").groupBy("field", "code").agg(F.sum("n").alias("n"), F.sum("x").alias("total"), F.max("x").alias("most"))
    got = np.array([tuple(r) for r in sums.collect()], np.int64).reshape(-1, 5)
    n, mean = np.zeros(n_fields + 1), np.ones(n_fields + 1)
    df, most = np.zeros((n_fields + 1, n_terms)), np.zeros((n_fields + 1, n_terms))
    for field, code, count, total, top in got:
        if code < 0:
            n[field], mean[field] = count, total / count if count else 1.0
        else:
            df[field, code], most[field, code] = count, top
    idf = np.log(1 + (n[:, None] - df + 0.5) / (df + 0.5))
    return Statistics(n, mean, idf, idf * (K1 + 1) * most / (most + K1 * (1 - B) + (most == 0)))


def _score(s: Statistics, field, code: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return s.idf[field, code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / s.mean[field]))


def _spread(q: Queries, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posting, query, entry) for each query that asks for a posting's term; ``entry`` is the place in ``q.query``."""
    many = q.start[code + 1] - q.start[code]
    posting = np.repeat(np.arange(len(code)), many)
    entry = np.arange(len(posting)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(q.start[code], many)
    return posting, q.query[entry], entry


def _frequent(q: Queries, bound: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether an entry is one of its query's frequent terms, the sum of their bounds by query): the largest set of terms, taken from the lowest bounds on, that cannot reach the threshold."""
    code = np.repeat(np.arange(len(q.start) - 1), np.diff(q.start))
    order = np.lexsort((bound[code], q.query))
    total = np.cumsum(bound[code][order])
    first = np.searchsorted(q.query[order], q.query[order])
    upto = total - (total - bound[code][order])[first]
    late = np.zeros(len(code), bool)
    late[order] = upto < least[q.query[order]]
    return late, np.bincount(q.query[late], weights=bound[code[late]], minlength=len(q.ids))


def _scores(b: _Block, q: Queries, s: Statistics, weights: np.ndarray, least: np.ndarray | None) -> np.ndarray:
    """Sums over fields, documents by queries. Where a document has no chance to reach ``least``, the sum may lack frequent terms."""
    n_fields, shape = len(weights), (len(b.id), len(q.ids))
    field = b.f_at % n_fields
    value = _score(s, field, b.f_code, b.f_tf, b.field_len[b.f_at]) * weights[field]
    doc = b.f_at // n_fields
    posting, query, entry = _spread(q, b.f_code)
    if least is None:
        return np.bincount(doc[posting] * shape[1] + query, weights=value[posting], minlength=shape[0] * shape[1]).reshape(shape)
    late, rest = _frequent(q, (s.bound[:n_fields] * weights[:, None]).sum(0), least)
    early = ~late[entry]
    out = np.bincount((doc[posting] * shape[1] + query)[early], weights=value[posting[early]], minlength=shape[0] * shape[1])
    chance = out + np.tile(rest, shape[0]) >= np.tile(least, shape[0])
    posting, query = posting[~early], query[~early]
    cell = doc[posting] * shape[1] + query
    held = chance[cell]
    out += np.bincount(cell[held], weights=value[posting[held]], minlength=len(out))
    return out.reshape(shape)


def _best_part(b: _Block, q: Queries, s: Statistics) -> np.ndarray:
    """The greatest sum of a part, documents by queries."""
    posting, query, _ = _spread(q, b.code)
    value = _score(s, -1, b.code, b.tf, b.part_len[b.at])
    out = np.zeros((len(b.id), len(q.ids)))
    if len(posting):
        sums = np.bincount(b.at[posting] * len(q.ids) + query, weights=value[posting], minlength=len(b.part_len) * len(q.ids)).reshape(-1, len(q.ids))
        docs, first = np.unique(b.part_doc, return_index=True)
        out[docs] = np.maximum.reduceat(sums, first, axis=0)
    return out


def _matched(b: _Block, q: Queries) -> np.ndarray:
    """Number of a query's terms that a document holds."""
    n = len(q.start) - 1
    some = np.unique((b.f_at // (len(b.field_len) // max(len(b.id), 1))) * n + b.f_code)
    posting, query, _ = _spread(q, some % n)
    return np.bincount((some // n)[posting] * len(q.ids) + query, minlength=len(b.id) * len(q.ids)).reshape(len(b.id), -1)


Judge = Callable[[_Block, int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _by_terms(rows: DataFrame, q: Queries, s: Statistics, weights: np.ndarray, least: np.ndarray | None, tops: np.ndarray | None, with_parts: bool) -> Judge:
    """(ordering, score, part score, matched terms), documents by the queries from ``lo`` to ``hi``.

    With parts, the order is by (score + best part's score) / ``tops`` and the share of matched terms; without ``tops`` by the former alone.
    """
    sent = rows.sparkSession.sparkContext.broadcast((q, s, least, tops))

    def judge(b: _Block, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q, s, least, tops = sent.value
        part = q if (lo, hi) == (0, len(q.ids)) else q.few(lo, hi)
        if not with_parts:
            score = _scores(b, part, s, weights, None if least is None else least[lo:hi] - SLACK)
            return score, score, np.zeros_like(score), np.zeros(score.shape, np.int64)
        score, top, matched = _scores(b, part, s, weights, None), _best_part(b, part, s), _matched(b, part)
        order = score + top
        if tops is not None:
            order = order / np.maximum(tops[lo:hi], 1e-300) + np.where(part.size > 1, COVERAGE * matched / part.size, 0.0)
        return np.where(score + top > 0, order, 0.0), score, top, matched

    return judge


def _by_phrases(rows: DataFrame, phrases: Queries, owner: np.ndarray, s: Statistics, n_fields: int) -> Judge:
    """(ordering, score, nothing, phrases found): the sums of phrases all of whose terms one field holds. ``phrases`` has a row for each phrase, ``owner`` the query's place of each."""
    sent = rows.sparkSession.sparkContext.broadcast((phrases, owner, s))

    def judge(b: _Block, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        phrases, owner, s = sent.value
        value = _score(s, b.f_at % n_fields, b.f_code, b.f_tf, b.field_len[b.f_at])
        posting, phrase, _ = _spread(phrases, b.f_code)
        mine = (owner[phrase] >= lo) & (owner[phrase] < hi)
        posting, phrase = posting[mine], phrase[mine]
        some, place, many = np.unique(b.f_at[posting] * len(owner) + phrase, return_inverse=True, return_counts=True)
        total = np.bincount(place, weights=value[posting], minlength=len(some))
        whole = many == phrases.size[some % len(owner)]
        doc, phrase, total = some[whole] // len(owner) // n_fields, some[whole] % len(owner), total[whole]
        shape, cell = (len(b.id), hi - lo), doc * (hi - lo) + owner[phrase] - lo
        score = np.bincount(cell, weights=total, minlength=shape[0] * shape[1]).reshape(shape)
        once = np.unique(doc * len(owner) + phrase)
        found = np.bincount(once // len(owner) * (hi - lo) + owner[once % len(owner)] - lo, minlength=shape[0] * shape[1]).reshape(shape)
        return score, score, np.zeros_like(score), found

    return judge


def _kept(rows: DataFrame, ids: np.ndarray, n_terms: int, n_fields: int, k: int, least: np.ndarray | None, tops: np.ndarray | None, judge: Judge, with_parts: bool = False) -> DataFrame:
    """(query_id, id, ordering, score, part_score, top, matched): each task's best k of each query that reach ``least``, ties and what is within ``SLACK`` included."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, least, tops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least, tops = sent.value
        floor = np.full(len(asked), SLACK / 2) if least is None else np.maximum(least - SLACK, SLACK / 2)
        kept: list[np.ndarray] = []
        names: list[np.ndarray] = []

        def squeezed() -> np.ndarray:
            """Only the best k of each query, and a higher floor for those that have k."""
            rows = np.concatenate(kept) if kept else np.zeros((0, 6))
            rows = rows[np.lexsort((-rows[:, 2], rows[:, 0]))]
            query = rows[:, 0].astype(np.int64)
            first = np.searchsorted(query, np.arange(len(floor)))
            many = np.bincount(query, minlength=len(floor))
            full = np.flatnonzero(many >= k)
            floor[full] = np.maximum(floor[full], rows[first[full] + k - 1, 2] - SLACK)
            return rows[rows[:, 2] >= floor[query]]

        size = 0
        for b in _blocks(batches, n_terms, n_fields):
            step = max(1, BLOCK_CELLS // max(len(b.id), len(b.part_len) if with_parts else 1))
            for lo in range(0, len(asked), step):
                hi = min(lo + step, len(asked))
                order, score, top, matched = judge(b, lo, hi)
                doc, query = np.nonzero(order >= floor[lo:hi])
                at = doc, query
                kept.append(np.column_stack([query + lo, np.arange(size, size + len(doc)), order[at], score[at], top[at], matched[at]]).astype(np.float64))
                names.append(b.id[doc])
                size += len(doc)
            if sum(map(len, kept)) > 4 * k * len(asked):
                kept[:] = [squeezed()]
                few = np.concatenate(names)[kept[0][:, 1].astype(np.int64)]
                kept[0][:, 1], names[:], size = np.arange(len(few)), [few], len(few)
        rows = squeezed()
        docs = np.concatenate(names) if names else np.zeros(0, np.int64)
        query = rows[:, 0].astype(np.int64)
        top = np.zeros(len(rows)) if tops is None else tops[query]
        columns = [asked[query], docs[rows[:, 1].astype(np.int64)], rows[:, 2], rows[:, 3], rows[:, 4], top, rows[:, 5].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "ordering", "score", "part_score", "top", "matched"])

    return rows.mapInArrow(run, "query_id long, id long, ordering double, score double, part_score double, top double, matched long")


def _kth(found: DataFrame, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each query, or 0: a number for each query comes to the driver."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ordering")))
    out = np.zeros(len(ids))
    for r in found.select("query_id", "ordering", turn.alias("n")).where(F.col("n") == k).collect():
        out[np.searchsorted(ids, r["query_id"])] = r["ordering"]
    return out


def _slice(rows: DataFrame, s: Statistics, k: int) -> DataFrame | None:
    """A hashed slice of the documents that holds ``SLICE_ROWS`` documents for each wanted row, if that is less than all."""
    slices = int(s.n[:-1].max() // (SLICE_ROWS * k))
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == 0) if slices > 1 else None


def best(queries: DataFrame, docs: DataFrame, id_col: str, parts: Column, k: int, weights: tuple[float, ...] = (1.0, 1.0), with_parts: bool = False) -> DataFrame | None:
    """(query_id, id, score, part_score, top, matched) of a few documents of each query, among them the best ``k``; None if the queries are too many for this way.

    ``parts`` (array<array<string>>): the tokens of a document; the first part is the first field, all others are the last one. Without parts the order is by
    score, with them by (score + best part's score), over the query's greatest (``top``), plus the bonus for covered terms.
    """
    q = asked(queries)
    if q is None:
        return None
    rows = counted(docs, id_col, parts, q.terms)
    s = statistics(rows, len(q.terms), len(weights))
    kept = lambda some, k, least, tops: _kept(some, q.ids, len(q.terms), len(weights), k, least, tops, _by_terms(rows, q, s, np.array(weights), least, tops, with_parts), with_parts)
    tops = None
    if with_parts:
        tops = _kth(kept(rows, 1, None, None).groupBy("query_id").agg(F.max("ordering").alias("ordering")), q.ids, 1)
    some = _slice(rows, s, k)
    least = None if some is None else _kth(kept(some, k, None, tops), q.ids, k)
    return kept(rows, k, least, tops).withColumnRenamed("id", id_col).drop("ordering")


def best_phrases(queries: DataFrame, docs: DataFrame, id_col: str, parts: Column, k: int, n_fields: int = 2) -> DataFrame | None:
    """(query_id, id, score, n_phrases) of a few documents of each query, among them the best ``k`` by the summed scores of ``phrases`` (array<array<string>>) that one field holds whole.

    Each phrase of a query counts once a field; None if there are too many.
    """
    each = cut(queries.select("query_id", F.posexplode(F.transform("phrases", F.array_distinct)).alias("no", "terms")).where("size(terms) > 0"))
    if each.count() > BROADCAST_ROWS:
        return None
    listed = sorted((r["query_id"], r["no"], r["terms"]) for r in each.collect())
    ids = np.array(sorted({r[0] for r in listed}), np.int64)
    owner = np.searchsorted(ids, np.array([r[0] for r in listed], np.int64))
    terms = sorted({t for r in listed for t in r[2]})
    code = {t: i for i, t in enumerate(terms)}
    pairs = np.array(sorted((code[t], n) for n, r in enumerate(listed) for t in r[2]), np.int64).reshape(-1, 2)
    phrases = Queries(np.arange(len(listed)), np.array([len(r[2]) for r in listed], np.int64), terms, np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1])
    rows = counted(docs, id_col, parts, terms)
    s = statistics(rows, len(terms), n_fields)
    kept = lambda some, least: _kept(some, ids, len(terms), n_fields, k, least, None, _by_phrases(rows, phrases, owner, s, n_fields))
    some = _slice(rows, s, k)
    least = None if some is None else _kth(kept(some, None), ids, k)
    return kept(rows, least).select("query_id", F.col("id").alias(id_col), "score", F.col("matched").alias("n_phrases"))
