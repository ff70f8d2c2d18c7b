"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

The sketch (Dahlgaard, Knudsen and Thorup 2017) throws every element of a set
into one of ``t`` bins, round after round: a coordinate keeps the least value of
the first round that reached its bin, and from round ``t`` on round ``t + i``
throws all elements into bin ``i``, so every coordinate fills after ``2 t``
rounds at most and the share of agreeing coordinates is concentrated around the
Jaccard similarity as for independent permutations.

Shape of the job: equal sets collapse to one representative first. Band keys of
representatives are aggregated to buckets; in each, the member that shares buckets
with most others is the hub, members are verified against it on whole shingle sets,
and verified links are joined to components. Members of one hub that are then
still in different components can only be similar if they share enough shingles that the
hub lacks; they are paired by those, which are rare, and counted before a pair is
verified; where many members share one, they are dealt to several tasks. A group of copies therefore costs links in proportion to its
size, while no pair that may be linked stays untested. With 40 bands of 5 coordinates a pair at similarity
0.8 shares no bucket with probability 1.3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelstack.llm.shared import components, cut, small
from reelstack.llm.tokens import LOWER, coefficients, mix64, slices, windows, words

WIDTH = 5
PERCENT = 80
BANDS = 40
ROWS = 5
#: Members of one hub and shingle that a task compares with the others; more are dealt to several tasks.
PART = 256
#: Bytes of text sketched at once: rounds have a fixed cost, so larger than other passes.
SKETCH_BYTES = 1 << 22


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash), distinct and sorted. A text of fewer words than ``width`` has its whole sequence as one shingle."""
    w = words(LOWER[buf], off)
    h, at = windows(w.hash, w.row, width)
    row = w.row[at]
    count = w.count
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        coef = coefficients(width)
        for k in range(width - 1):
            has = count[short] > k
            whole[has] += w.hash[w.first[short[has]] + k] * coef[k]
        h = np.concatenate([h, mix64(whole + count[short].astype(np.uint64))])
        row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def sketch(row: np.ndarray, elem: np.ndarray, n: int, t: int) -> np.ndarray:
    """The (n, t) sketch of ``n`` sets given as sorted (row, element); rows of empty sets stay at the largest value."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, empty)
    missing = np.zeros(n, np.int64)
    missing[np.unique(row)] = t
    shift = np.uint64(32)
    for i in range(2 * t):
        live = missing[row] > 0
        row, elem = row[live], elem[live]
        if not len(row):
            break
        h = mix64(elem + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> shift) * np.uint64(t) >> shift).astype(np.int64) if i < t else np.full(len(row), i - t)
        cell = row * t + bins
        open_ = out[cell] == empty
        cell, h = cell[open_], h[open_]
        # the value holds the round in its top bits: values of different rounds never agree
        h = (h & np.uint64(0x00FFFFFFFFFFFFFF)) | (np.uint64(i % 255) << np.uint64(56))
        np.minimum.at(out, cell, h)
        filled = np.unique(cell)
        missing -= np.bincount(filled // t, minlength=n)
    return out.reshape(n, t)


def band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) keys; each band's number is part of its keys."""
    n = len(sk)
    coef = coefficients(rows)
    keys = np.zeros((n, bands), np.uint64)
    cube = sk.reshape(n, bands, rows)
    for k in range(rows):
        keys += cube[:, :, k] * coef[k]
    return mix64(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, k1, k2, bands): k1 and k2 identify the set; null, like bands, for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, buf, off in slices(batch.column(1), SKETCH_BYTES):
                row, elem = shingle_sets(buf, off, width)
                size = np.bincount(row, minlength=n)
                keys = band_keys(sketch(row, elem, n, bands * rows), bands, rows)
                k1, k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(k1, row, mix64(elem))
                np.add.at(k2, row, mix64(elem ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                none = size == 0
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, pa.array(keys.reshape(-1).view(np.int64)), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(size, pa.int64()), pa.array(k1.view(np.int64), mask=none), pa.array(k2.view(np.int64), mask=none), lists],
                    names=["id", "n_shingles", "k1", "k2", "bands"],
                )

    return docs.mapInArrow(run, "id long, n_shingles long, k1 long, k2 long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            left, right = batch.column(2), batch.column(3)
            for at, n, buf, off in slices(left):
                row, elem = shingle_sets(buf, off, width)
                size = np.bincount(row, minlength=n)
                for at2, n2, buf2, off2 in slices(right.slice(at, n)):
                    row2, elem2 = shingle_sets(buf2, off2, width)
                    row2 = row2 + at2
                    size2 = np.bincount(row2, minlength=n)[at2 : at2 + n2]
                    mine = (row >= at2) & (row < at2 + n2)
                    r, e = np.concatenate([row[mine], row2]), np.concatenate([elem[mine], elem2])
                    order = np.lexsort((e, r))
                    r, e = r[order], e[order]
                    both = np.bincount(r[1:][(r[1:] == r[:-1]) & (e[1:] == e[:-1])], minlength=n)[at2 : at2 + n2]
                    union = size[at2 : at2 + n2] + size2 - both
                    good.append((union > 0) & (100 * both >= percent * union))
            if good:
                yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(good)))

    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    rows = rows.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _outside(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (hub, rep, n) with ``inside``, how many shingles the member has in common with its hub, and ``outside``, its other shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(3), batch.column(4)
            for at, n, buf, off in slices(left):
                row, elem = shingle_sets(buf, off, width)
                for at2, n2, buf2, off2 in slices(right.slice(at, n)):
                    hub_row, hub_elem = shingle_sets(buf2, off2, width)
                    mine = (row >= at2) & (row < at2 + n2)
                    r = np.concatenate([row[mine] - at2, hub_row])
                    e = np.concatenate([elem[mine], hub_elem])
                    own = np.arange(len(r)) < mine.sum()
                    order = np.lexsort((~own, e, r))
                    r, e, own = r[order], e[order], own[order]
                    twin = np.zeros(len(r), bool)
                    twin[:-1] = (r[1:] == r[:-1]) & (e[1:] == e[:-1])
                    out = own & ~twin
                    inside = np.bincount(r[own & twin], minlength=n2)
                    bounds = np.concatenate([[0], np.cumsum(np.bincount(r[out], minlength=n2))]).astype(np.int32)
                    keys = [batch.column(k).slice(at + at2, n2) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(inside), pa.ListArray.from_arrays(bounds, pa.array(e[out].view(np.int64)))], names=["hub", "rep", "n", "inside", "outside"])

    rows = pairs.join(texts.select(F.col("id").alias("rep"), F.col("text").alias("t")), "rep").join(texts.select(F.col("id").alias("hub"), F.col("text").alias("th")), "hub")
    return rows.select("hub", "rep", "n", "t", "th").mapInArrow(run, "hub long, rep long, n long, inside long, outside array<long>")


def _pairs(members: DataFrame, *keys: str) -> DataFrame:
    """Self-join of members (keys, m, ...) on their keys, the second one's columns with a 2; a group of ``m`` members is dealt to parts of ``PART`` members against all others."""
    parts = F.ceil(F.col("m") / PART).cast("int")
    left = members.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).drop("m")
    right = members.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("m")
    others = [c for c in right.columns if c not in (*keys, "part")]
    return left.join(right.select(*keys, "part", *[F.col(c).alias(f"{c}2") for c in others]), [*keys, "part"])


def _across(duo: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one hub in different components that can reach the similarity.

    |A and B| >= p / (1 + p) * (|A| + |B|), of which at most min(inside) lie inside the hub: the pair shares as many shingles
    outside of it as are lacking, and is found by them; pairs that lack none are compared as they are.
    """
    need = lambda have, n, m: (100 + percent) * have >= percent * (n + m)
    same_size = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    each = duo.select("hub", "rep", "n", "component", "inside", F.explode("outside").alias("shingle"))
    met = each.groupBy("hub", "shingle").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("hub", "shingle", "m")
    each = each.join(met, ["hub", "shingle"])
    reach = each.groupBy("hub", "rep").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("inside").alias("inside"))
    able = reach.where(need(F.col("inside") + F.col("k"), F.col("n"), F.col("n") * (percent / 100))).select("hub", "rep")
    each = cut(each.join(able, ["hub", "rep"], "left_semi"))
    found = _pairs(each, "hub", "shingle").where((F.col("component") < F.col("component2")) & same_size)
    found = found.groupBy("hub", "rep", "rep2").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("n2").alias("n2"), F.least(F.first("inside"), F.first("inside2")).alias("inside"))
    found = found.where(need(F.col("inside") + F.col("k"), F.col("n"), F.col("n2"))).select("rep", "rep2")
    # members that lie in the hub so far that they may share enough there with the hub's smallest such member
    whole = duo.where(need(F.col("inside"), F.col("n"), F.col("n") * (percent / 100))).select("hub", "rep", "n", "component", "inside")
    hubs = whole.groupBy("hub").agg(F.min("n").alias("least"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("hub", "least")
    whole = whole.join(hubs, "hub").where(need(F.col("inside"), F.col("n"), F.greatest(F.col("least"), F.col("n") * (percent / 100)))).drop("least")
    whole = cut(whole.join(whole.groupBy("hub").agg(F.count("*").alias("m")), "hub"))
    direct = _pairs(whole, "hub").where((F.col("component") < F.col("component2")) & same_size & need(F.least("inside", "inside2"), F.col("n"), F.col("n2"))).select("rep", "rep2")
    return found.union(direct).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (least id reachable over links), ``kept`` (is that id), ``n_links`` (verified links of its set's representative).

    Two texts are linked if ``100 * |A and B| >= percent * |A or B|`` on the sets of their distinct
    ``width``-word shingles, A-Z lower-cased. Null texts and texts without words have an empty set and
    are linked with nothing. The id is a key: rows that repeat an id are classified each by its own text.
    A null id is classified, but represents no class unless nothing else does; its component is null and it is kept. Ids that are
    no whole numbers are ordered as they sort. Rows of equal id and equal text are kept or dropped alike. An empty table gives
    no rows; other columns are not read. A text's shingles are worked out in one piece, in memory of some 50 times its bytes.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _by_number(docs, id_col, text_col, width=width, percent=percent, bands=bands, rows=rows)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = cut(_sketched(slim, width, bands, rows))
    classes = cut(
        marked.where("k1 is not null and id is not null")
        .groupBy("k1", "k2")
        .agg(F.min("id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    )
    buckets = classes.select("rep", "n", F.explode("bands").alias("band"))
    crowded = buckets.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    shared = cut(buckets.join(crowded, "band"))

    # a member that shares buckets with most others is the hub of its buckets: the text that others were copied from
    weight = shared.groupBy("rep").agg(F.sum("m").alias("w"))
    weighed = cut(shared.join(weight, "rep"))
    hubs = weighed.groupBy("band").agg(F.max(F.struct("w", (-F.col("rep")).alias("rep"))).alias("hub")).select("band", (-F.col("hub.rep")).alias("hub"))
    starred = weighed.join(hubs, "band").where("rep <> hub")
    asked = cut(starred.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct())
    wanted = cut(shared.select(F.col("rep").alias("id")).distinct())
    texts = slim.join(small(wanted, wanted.count()), "id", "left_semi")
    links = cut(_verified(asked, texts, width, percent))
    label = components(spark, links)

    # what is left: members of one bucket in different components
    named = label.withColumnRenamed("node", "rep")
    at = weighed.select("band", "rep", "n").join(hubs, "band").join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = at.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    left = at.join(mixed.select("band"), "band", "left_semi")
    duo = cut(left.where("rep <> hub").select("hub", "rep", "n").distinct())
    open_ids = cut(duo.select(F.col("rep").alias("id")).union(duo.select("hub")).distinct())
    open_texts = slim.join(small(open_ids, open_ids.count()), "id", "left_semi")
    apart = cut(_outside(duo, open_texts, width)).join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    fresh = _across(apart, percent).join(asked, ["a", "b"], "left_anti")
    found = cut(_verified(fresh, open_texts, width, percent))
    if found.count():
        links = cut(links.union(found))
        label = components(spark, links)
    ends = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
    named = classes.select("k1", "k2", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    named = named.select("k1", "k2", F.coalesce("component", "rep").alias("component_id"), "n_links")
    joined = marked.select("id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return joined.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _by_number(docs: DataFrame, id_col: str, text_col: str, **settings) -> DataFrame:
    """``near_duplicates`` of ids that are no whole numbers: they are numbered in their order, so that the least id stays the least."""
    ids = cut(docs.select(F.col(id_col).alias("name")).where("name is not null").distinct().orderBy("name").withColumn("at", F.monotonically_increasing_id()))
    named = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(ids, "name", "left").select(F.col("at").alias("id"), "text")
    out = near_duplicates(named, "id", "text", **settings)
    out = out.join(ids.select(F.col("at").alias("id"), F.col("name").alias("own")), "id", "left").join(ids.select(F.col("at").alias("component_id"), F.col("name").alias("component")), "component_id", "left")
    return out.select(F.col("own").alias(id_col), "n_shingles", F.col("component").alias("component_id"), "kept", "n_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs``, unchanged, but one document of each near-duplicate class: the one with the least id."""
    gone = cut(near_duplicates(docs, id_col, **settings).where("not kept").select(id_col).distinct())
    return docs.join(small(gone, gone.count()), id_col, "left_anti").select(docs.columns)
