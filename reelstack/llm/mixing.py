"""Mixing sources to target weights with DataFrame functions only.

1. Sizes and weights: words per document, words per source, and targets by
   water-filling: weighted shares of all words, none above ``max_copies`` times
   its source's size, the excess reshared until nothing is above.
2. Blocks: each source's documents fall into ``blocks`` hashed blocks, which
   are laid out in a permuted order, once per copy. A source's quota is a number of
   these block copies: whole passes over the source and the first blocks of one more. The one block in which
   the target lies is split by its documents' hash order.
3. Splitting tree: at each node of a binary tree a half of the node's block quotas is drawn
   without replacement for the left child, so a child's source counts are
   a multivariate-hypergeometric draw, and all quotas stay exact. A leaf is an output shard with a count per source.
4. Dealing: a source's permuted block copies go to the leaves as disjoint runs of the drawn lengths. What a
   document gives is what was dealt of its block: copies that fall into no leaf's run are not taken.
5. Inside a shard, rows are shuffled by a hash of document and copy.

No step orders all rows of a source, a node or the table of sources in one task: draws, splits of blocks
and numbers of sources come from histograms of hashes, of which one bin is then looked at row by row. Only block and source
tables (sources times ``blocks``) are joined with the documents, by broadcast while they are counted to be
small; a hot source is spread over its blocks, and no text is shuffled.

Defined results: a null text has size 0; a null source is a source of its own that
comes last; sizes of 0 give targets of 0; rows that repeat an id are each counted
and taken alike, null ids too; ties of hashes are taken together; an empty table gives no rows; equal settings and
rows give equal results. Columns of the input stay as they are: an added column whose name the input has is called ``mix_`` and that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelstack.llm.shared import cut, small

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BLOCKS = 1024
#: The splitting tree's depth: 2 ** DEPTH output shards.
DEPTH = 3
SEED = 20
#: Rows of a table of sources, and of one of blocks, that may be broadcast (some 50 bytes each, leaves' runs included some 200).
BROADCAST_SOURCES = 50_000
BROADCAST_BLOCKS = 200_000


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _numbered(rows: DataFrame, order: Column) -> DataFrame:
    """Add ``place``, the number of each row from 0 in a global order: ranges are sorted apart and counted, only the counts are summed up."""
    ranged = cut(rows.orderBy(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row a partition: as many as a sort has tasks
    return ranged.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Add ``weight`` and ``target`` to a table (source, source_size) of one row per source.

    Water-filling by rounds: a source whose share is above its cap is held at it, and what is left is shared anew. A round is one
    aggregation to two numbers, and caps sources for good, so there are as many rounds as times the excess makes others full.
    """
    placed = _numbered(sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    capped = cut(placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_copies)).drop("place"))
    ratio = F.col("cap") / F.col("weight")
    level, full = -1.0, None
    while True:
        held = F.coalesce(ratio <= level, F.lit(False))
        got = capped.agg(F.sum("source_size").alias("all"), F.sum(F.when(held, F.col("cap"))).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("open"), F.count_if(held).alias("n")).first()
        if not got["open"] or got["n"] == full:
            break
        full, level = got["n"], ((got["all"] or 0) - (got["held"] or 0.0)) / got["open"]
    return capped.withColumn("target", F.least("cap", F.col("weight") * F.lit(float(level)))).select("source", "source_size", "weight", "target")


def drawn_bounds(items: DataFrame, group: list[str], order: str, amount: str, quota: str) -> DataFrame:
    """(group, ``bound``): the greatest hash ``order`` up to which a group's items, the last one by its half, are within its quota; no row where not even the first is.

    ``items`` has the group's ``quota`` in each row and an ``amount`` of its own. Amounts are summed by the hash's top 12 bits; only the
    bin in which the quota ends is looked at item by item, so a group of any size is no single task's work.
    """
    binned = items.withColumn("_bin", F.shiftright(order, 52).cast("int"))
    bins = binned.groupBy(*group, "_bin").agg(F.sum(amount).alias("_sum"), F.max(order).alias("_last"), F.first(quota).alias("_quota"))
    upto = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    summed = bins.withColumn("_upto", upto)
    whole = summed.where("_upto <= _quota").groupBy(*group).agg(F.max("_last").alias("bound"))
    last = summed.where("_upto > _quota").groupBy(*group).agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("_sum")).alias("_before"))).alias("_x"))
    last = last.select(*group, "_x._bin", "_x._before")
    run = Window.partitionBy(*group).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    inside = binned.join(last, [*group, "_bin"]).withColumn("_here", F.col("_before") + F.sum(amount).over(run)).where(F.col("_here") - F.col(amount) / 2 <= F.col(quota))
    return whole.unionByName(inside.groupBy(*group).agg(F.max(order).alias("bound"))).groupBy(*group).agg(F.max("bound").alias("bound"))


def split_tree(quotas: DataFrame, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """(key, shard, n): how many of a source's quota (key, m) each leaf gets.

    Each level draws a half of a node's block copies, rounded down, for the left child: those with the least hashes,
    so the counts by source are multivariate hypergeometric.
    """
    nodes = quotas.where("m > 0").select("key", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("j"), F.lit(0).alias("shard"))
    for level in range(depth):
        nodes = cut(nodes.withColumn("h", F.xxhash64("key", "j", F.lit(seed + level))))
        half = nodes.groupBy("shard").agg(F.floor(F.count("*") / 2).alias("half"))
        # at most 2 ** level nodes
        drawn = drawn_bounds(nodes.withColumn("one", F.lit(1)).join(F.broadcast(half), "shard"), ["shard"], "h", "one", "half")
        right = F.coalesce(F.col("h") > F.col("bound"), F.lit(True)).cast("int")
        nodes = nodes.join(F.broadcast(drawn), "shard", "left").select("key", "j", (F.col("shard") * 2 + right).alias("shard"))
    return nodes.groupBy("key", "shard").agg(F.count("*").alias("n"))


def _block_table(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    blocks: int = BLOCKS,
    depth: int = DEPTH,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """What was dealt of each block of each source, and the documents' (id, source, size, key, order, block)."""
    thin = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    thin = cut(_placed(thin, "id", blocks, seed))

    block = cut(thin.groupBy("key", "block").agg(F.first("source").alias("source"), F.sum("size").alias("words")))
    source = source_targets(block.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), weights, max_copies)
    sizes = block.groupBy("key").agg(F.count("*").alias("n_blocks"))
    source = source.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source").join(sizes, "key")
    passes = F.coalesce(F.least(F.lit(max_copies), F.floor(F.col("target") / F.nullif("source_size", F.lit(0)) + 1e-9)), F.lit(0)).cast("int")
    source = cut(source.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))))
    permuted = Window.partitionBy("key").orderBy(F.xxhash64("key", "block", F.lit(seed)), "block")
    upto = F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, 0))
    laid = block.join(small(source, source.count(), BROADCAST_SOURCES), "key").withColumns({"place": F.row_number().over(permuted), "upto": upto})
    # room: what the last, partial pass takes of this block
    laid = cut(laid.withColumn("room", F.col("rest") - (F.col("upto") - F.col("words"))).drop("source"))

    # the documents up to which a split block is taken: those that are nearest to the room
    split = laid.where("room > 0 and room < words").select("key", "block", "room")
    bound = drawn_bounds(thin.where("size > 0").join(small(split, split.count(), BROADCAST_SOURCES), ["key", "block"]), ["key", "block"], "order", "size", "room")
    laid = laid.join(bound, ["key", "block"], "left")
    last = (F.col("rest") > 0) & (F.col("room") > 0)

    quota = laid.groupBy("key").agg((F.first("passes") * F.first("n_blocks") + F.count_if(last)).alias("m"))
    leaves = split_tree(quota, depth, seed)
    ahead = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    # a leaf's run of the source's block copies: at most 2 ** depth entries a source
    runs = leaves.withColumn("hi", F.sum("n").over(ahead)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("hi", "n", "shard"))).alias("runs"))
    rank = lambda copy: (copy - 1) * F.col("n_blocks") + F.col("place")
    leaf = lambda r: F.filter("runs", lambda x: (r > x["hi"] - x["n"]) & (r <= x["hi"]))
    dealt = F.transform(F.filter(F.sequence(F.lit(1), F.lit(max_copies + 1)), lambda c: F.size(leaf(rank(c))) > 0), lambda c: leaf(rank(c))[0]["shard"])
    table = laid.join(small(runs, source.count(), BROADCAST_SOURCES), "key", "left").withColumn("dealt", F.coalesce(dealt, F.array().cast("array<int>")))
    return cut(table.select("key", "block", "source_size", "target", (last & (F.col("room") < F.col("words"))).alias("split"), "bound", "dealt")), thin


def _placed(docs: DataFrame, id_col: str, blocks: int, seed: int) -> DataFrame:
    placed = docs.withColumns({"key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "order": F.xxhash64(F.col(id_col), F.lit(seed))})
    return placed.withColumn("block", F.pmod("order", F.lit(blocks)).cast("int"))


def _dealt(placed: DataFrame, table: DataFrame, kept: list) -> DataFrame:
    """The columns ``kept`` of placed documents with what was dealt of their block; the last copy of a split block is for documents up to its bound only."""
    out = placed.join(small(table, table.count(), BROADCAST_BLOCKS), ["key", "block"])
    without = F.col("split") & ~F.coalesce(F.col("order") <= F.col("bound"), F.lit(False))
    shards = F.when(without, F.slice("dealt", F.lit(1), F.greatest(F.size("dealt") - 1, F.lit(0)))).otherwise(F.col("dealt"))
    out = out.withColumn("_shards", shards)
    return out.select(*kept, "size", "source_size", "target", F.size("_shards").alias("copies"), (F.col("size") * F.size("_shards")).cast("long").alias("taken"), F.col("_shards").alias("shards"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """One row per row of ``docs``: its id, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` (size times copies) and ``shards``, the output shard of each copy."""
    table, thin = _block_table(docs, id_col=id_col, **settings)
    return _dealt(thin, table, [F.col("id").alias(id_col), "source"])


def added_name(name: str, columns: list[str]) -> str:
    """The name of an added column: ``mix_`` is put before it if the input has such a column, however spelt."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"mix_{name}"
    return name


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS, seed: int = SEED, **settings) -> DataFrame:
    """The rows of ``docs``, all their columns, with those of ``mix_sources``; texts are read once more, and never shuffled while the block table is small."""
    table, _ = _block_table(docs, id_col, text_col, source_col, blocks=blocks, seed=seed, **settings)
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    made = _dealt(_placed(row, "id", blocks, seed), table, ["row"])
    added = [c for c in made.columns if c != "row"]
    return made.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[F.col(c).alias(added_name(c, docs.columns)) for c in added])


def shuffled_shards(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The mixture itself: each document once per copy, with ``shard`` and ``copy``, rows of a shard in shuffled order.

    Rows are dealt to partitions by ranges of (shard, hash), so that a shard of any size is many tasks' work.
    """
    copies = mix.select(id_col, F.posexplode("shards").alias("copy", "shard")).withColumn("at", F.xxhash64(id_col, "copy", F.lit(seed)))
    return docs.join(copies, id_col).repartitionByRange("shard", "at").sortWithinPartitions("shard", "at").drop("at")


def dealt_copies(mixed: DataFrame, id_col: str = "doc_id", seed: int = SEED, shards: str = "shards") -> DataFrame:
    """The mixture from ``mixed_documents``: one row per copy taken, with ``copy`` and ``shard``, none where ``copies`` is 0.

    Nothing is joined: rows with a null or repeated id are dealt by what they hold themselves. Order as in ``shuffled_shards``.
    ``shards`` names the column of the mixture if the input had one of that name.
    """
    copy, shard, at = (added_name(c, mixed.columns) for c in ("copy", "shard", "at"))
    rows = mixed.select("*", F.posexplode(shards).alias(copy, shard))
    return rows.withColumn(at, F.xxhash64(id_col, copy, F.lit(seed))).repartitionByRange(shard, at).sortWithinPartitions(shard, at).drop(at)


def mixture(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED, **settings) -> DataFrame:
    """The rows of the mix: each document of ``docs`` once per copy taken, dealt to shards and shuffled there."""
    return dealt_copies(mixed_documents(docs, id_col, seed=seed, **settings), id_col, seed, added_name("shards", docs.columns))
