"""What each of five filters removes, alone and behind the others, in every order.

1. Each text fails some of five filters, told as a mask of bits: ``A`` few words, ``B`` few distinct words, ``C`` many capitals,
   ``D`` a symbol, ``E`` the text of a smaller id. The first four are functions of the text, in the JVM.
2. ``E`` needs all copies of a text together. One aggregation over all rows weighs the texts' prefixes of 8, 32, 128, ... code points; a text's key is
   its shortest prefix that is not heavy, or the whole text. So prefixes adapt: they are short where texts differ early.
3. Each task puts its texts into a compressed radix trie, whose edges are runs of bytes and whose terminals hold the minimum id and how many rows of each
   kind (part, labels) the text has. A trie that has grown to ``TRIE_BYTES`` is emptied, one row a terminal: copies of a text leave a task as one
   row, however many they are, with counts instead of lists.
4. These rows are range-partitioned by key, and sorted by it inside a partition, so that a trie holds the texts of one key, or of several light ones. Traversing
   it, every row of a terminal is a duplicate but those of the minimum id. A heavy whole text is first merged in ``SALTS`` partitions, then by itself.
5. Reduce: there are at most 128 counts by (part, mask, labels) a part. All 120 orders follow from them, without another look at a document.

Defined results: a null text is empty; a null source belongs to part ''; a row without an id never fails ``E`` and makes no other fail it; rows that repeat an id
are each counted, and do not make each other fail ``E``; several label rows of an id count if any is 1, one without an id labels nothing; texts are compared whole, whatever their length;
an empty table gives no rows. Only the id, text and source are read, so further columns, whatever their names, play no part.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import permutations
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelstack.llm.shared import cut, small

FILTERS = "ABCDE"
MIN_WORDS = 50
#: Lengths (code points) of the prefixes that are weighed.
PREFIXES = tuple(8 * 4**k for k in range(12))
#: A prefix is heavy above this many bytes of texts and above this share of all bytes, so there are at most 100,000 of a length.
HEAVY_BYTES = 8 << 20
HEAVY_SHARE = 1e-5
#: Bytes of texts that a trie takes before a task empties it.
TRIE_BYTES = 32 << 20
#: Bytes of texts for a range; keys that are sampled for its bounds, which only balance the ranges; their greatest number, and length in bytes.
RANGE_BYTES = 64 << 20
SAMPLE_RANGE, SAMPLE, BOUND_BYTES = 50, 1_000_000, 64
#: Partitions in which the copies of a heavy whole text are merged before they meet.
SALTS = 64

Kind = tuple[str, int, int]


@dataclass
class Terminal:
    """The rows of one text: their mask, the minimum id, and rows by kind, those of the minimum id also apart."""

    mask: int
    least: Any
    first: Counter[Kind] = field(default_factory=Counter)
    kinds: Counter[Kind] = field(default_factory=Counter)

    def add(self, least: Any, first: Counter[Kind], kinds: Counter[Kind]) -> None:
        if least < self.least:
            self.least, self.first = least, Counter()
        if least == self.least:
            self.first.update(first)
        self.kinds.update(kinds)

    def counts(self) -> Iterator[tuple[Kind, int, int]]:
        """(kind, mask with ``E`` decided, rows)."""
        for kind, n in self.kinds.items():
            kept = self.first[kind]
            if kept:
                yield kind, self.mask, kept
            if n > kept:
                yield kind, self.mask | 1 << 4, n - kept


class Node:
    __slots__ = ("children", "edge", "terminal")

    def __init__(self, edge: bytes, terminal: Terminal | None = None) -> None:
        self.edge, self.terminal, self.children = edge, terminal, {}


class Trie:
    """Compressed radix trie of whole texts."""

    def __init__(self) -> None:
        self.root, self.size = Node(b""), 0

    def terminal(self, text: bytes, mask: int, least: Any) -> Terminal:
        """The text's terminal, made if it is new."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.size += len(text) - at + 200
            elif not text.startswith(child.edge, at):
                child = node.children[text[at]] = self._split(child, _common(child.edge, text, at))
            node, at = child, at + len(child.edge)
        if node.terminal is None:
            node.terminal = Terminal(mask, least)
        return node.terminal

    @staticmethod
    def _split(child: Node, n: int) -> Node:
        upper = Node(child.edge[:n])
        child.edge = child.edge[n:]
        upper.children[child.edge[0]] = child
        return upper

    def terminals(self) -> Iterator[tuple[bytes, Terminal]]:
        todo = [(self.root, b"")]
        while todo:
            node, before = todo.pop()
            text = before + node.edge
            if node.terminal is not None:
                yield text, node.terminal
            todo.extend((child, text) for child in node.children.values())


def _common(edge: bytes, text: bytes, at: int) -> int:
    """Length of the longest prefix of ``edge`` that stands in ``text`` at ``at``; by halving, with comparisons of whole slices."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if edge[low:mid] == text[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def mask_of(docs: DataFrame) -> DataFrame:
    """Add ``mask``: bits 0 to 3 for the filters A to D that ``text`` (not null) fails."""
    words = docs.withColumn("_words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n, text = F.size("_words"), F.col("text")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < MIN_WORDS, 100 * F.size(F.array_distinct("_words")) < 65 * n, 100 * capitals > 5 * F.char_length(text), text.rlike("[#$%&*|]"))
    bits = F.lit(0)
    for k, failed in enumerate(fails):
        bits = bits + F.when(failed, 1 << k).otherwise(0)
    return words.withColumn("mask", bits).drop("_words")


def heavy_prefixes(rows: DataFrame, least: int = HEAVY_BYTES) -> tuple[DataFrame, int, int]:
    """(chars, hash) of prefixes that more bytes of texts share than ``least`` and their share of all allow, whole texts under 0 chars; all bytes; all rows."""
    chars = F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n < F.char_length("text"))
    each = rows.select("text", F.octet_length("text").alias("bytes"), F.explode(F.concat(F.array(F.lit(-1), F.lit(0)), chars)).alias("chars"))
    part = F.when(F.col("chars") < 0, "").when(F.col("chars") == 0, F.col("text")).otherwise(F.substring(F.col("text"), F.lit(1), F.col("chars")))
    weighed = each.select("chars", F.xxhash64(part).alias("hash"), "bytes").groupBy("chars", "hash").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    heavy = cut(weighed.where((F.col("bytes") > least) | (F.col("chars") < 0)))
    every = heavy.where("chars < 0").first()
    total, n = (every["bytes"], every["n"]) if every else (0, 0)
    return heavy.where((F.col("chars") >= 0) & (F.col("bytes") > max(least, int(total * HEAVY_SHARE)))).select("chars", "hash"), total, n


def keyed(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Add ``key``, the shortest prefix that is not heavy or the whole text, and ``whole``, whether the whole text is heavy."""
    lengths = {r["chars"] for r in heavy.select("chars").distinct().collect()}  # as many as PREFIXES, and one
    out, key = rows, F.col("text")
    for n in sorted(lengths):
        held = heavy.where(F.col("chars") == n).select(F.col("hash").alias("_hash"), F.lit(True).alias(f"_heavy{n}"))
        part = F.xxhash64("text") if n == 0 else F.xxhash64(F.substring("text", 1, n))
        out = out.withColumn("_part", part).join(F.broadcast(held), F.col("_part") == F.col("_hash"), "left").drop("_part", "_hash")
    for n in reversed(PREFIXES):
        short = F.substring("text", 1, n)  # the whole text if that is no longer
        key = F.when(F.col(f"_heavy{n}"), key).otherwise(short) if n in lengths else short
    whole = F.coalesce("_heavy0", F.lit(False)) & (key == F.col("text")) if 0 in lengths else F.lit(False)
    return out.withColumn("key", key).withColumn("whole", whole).drop(*[f"_heavy{n}" for n in lengths])


def _bounds(rows: DataFrame, n: int, n_ranges: int) -> list[bytes]:
    """Bounds of ranges with about equal bytes, from a sample of the keys; equal keys lie in one range whatever the bounds are."""
    wanted = min(SAMPLE, SAMPLE_RANGE * n_ranges)
    some = rows.select(F.substring(F.col("key").cast("binary"), 1, BOUND_BYTES).alias("key"), F.octet_length("text").alias("bytes"))
    found = sorted((bytes(r["key"]), r["bytes"]) for r in some.sample(min(1.0, wanted / max(n, 1)), 7).collect())
    share, at, bounds = sum(b for _, b in found) / n_ranges, 0, []
    for key, size in found:
        at += size
        if at >= share * (len(bounds) + 1) and (not bounds or key > bounds[-1]):
            bounds.append(key)
    return bounds


def _binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _pairs(counter: Counter[Kind]) -> list[dict]:
    return [{"part": k[0], "good": k[1], "bad": k[2], "n": n} for k, n in counter.items()]


def _counter(pairs: list[dict]) -> Counter[Kind]:
    return Counter({(p["part"], p["good"], p["bad"]): p["n"] for p in pairs})


def _leaves(trie: Trie, bounds: list[bytes], n_ranges: int, salt: int, keys: dict[bytes, tuple[bytes, bool]]) -> list[dict]:
    """A row for each terminal, with the partition it goes to."""
    rows = []
    for text, terminal in trie.terminals():
        key, whole = keys[text]
        place = (bisect_right(bounds, key[:BOUND_BYTES]) + (salt % SALTS if whole else 0)) % n_ranges
        rows.append({"place": place, "key": key, "whole": whole, "text": text, "mask": terminal.mask, "least": terminal.least, "first": _pairs(terminal.first), "kinds": _pairs(terminal.kinds)})
    return rows


def _in_batches(rows: Iterable[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    for at in range(0, len(rows), most):
        yield pa.RecordBatch.from_pylist(rows[at : at + most], schema=schema)


def _local(bounds: list[bytes], n_ranges: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId()
        trie, keys = Trie(), {}
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("id", "part", "good", "bad", "mask", "whole")]
            for text, key, i, part, good, bad, mask, whole in zip(_binary(b.column("text")), _binary(b.column("key")), *columns, strict=True):
                kind = Counter({(part, good, bad): 1})
                trie.terminal(text, mask, i).add(i, kind, kind)
                keys[text] = (key, whole)
                if trie.size >= TRIE_BYTES:
                    yield from _in_batches(_leaves(trie, bounds, n_ranges, salt, keys), schema)
                    trie, keys = Trie(), {}
        yield from _in_batches(_leaves(trie, bounds, n_ranges, salt, keys), schema)

    return run


def _meet(schema: pa.Schema, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge the terminals of a partition, sorted by key; yield counts, and the terminals of heavy whole texts unless this is the last meeting."""

    def empty(trie: Trie, whole: set[bytes]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[Kind, int]] = Counter()
        rows = []
        for text, terminal in trie.terminals():
            if text in whole:
                rows.append({"text": text, "tmask": terminal.mask, "least": terminal.least, "first": _pairs(terminal.first), "kinds": _pairs(terminal.kinds)})
            else:
                for kind, mask, n in terminal.counts():
                    counts[kind, mask] += n
        rows += [{"part": k[0], "good": k[1], "bad": k[2], "mask": mask, "n": n} for (k, mask), n in counts.items()]
        yield from _in_batches(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, whole, before = Trie(), set(), None
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("mask", "least", "first", "kinds", "whole")]
            for text, key, mask, least, first, kinds, heavy in zip(_binary(b.column("text")), _binary(b.column("key")), *columns, strict=True):
                if key != before and trie.size >= TRIE_BYTES:
                    yield from empty(trie, whole)
                    trie, whole = Trie(), set()
                before = key
                if heavy and not last:
                    whole.add(text)
                trie.terminal(text, mask, least).add(least, _counter(first), _counter(kinds))
        yield from empty(trie, whole)

    return run


def fail_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", heavy_bytes: int = HEAVY_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(part, mask, good, bad, n): rows by part, failed filters and labels."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    known = cut(known.withColumnRenamed(id_col, "_id"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.where("id is not null")
    heavy, total, n = heavy_prefixes(named, heavy_bytes)
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    bounds = _bounds(keyed(named, heavy), n, n_ranges)
    rows = rows.join(small(known, known.count()), F.col("id") == F.col("_id"), "left").drop("_id")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "bad")})

    id_type = docs.schema[id_col].dataType
    kinds = T.ArrayType(T.StructType([T.StructField("part", T.StringType()), T.StructField("good", T.IntegerType()), T.StructField("bad", T.IntegerType()), T.StructField("n", T.LongType())]))
    terminal = [T.StructField("least", id_type), T.StructField("first", kinds), T.StructField("kinds", kinds)]
    leaf = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("whole", T.BooleanType()), T.StructField("text", T.BinaryType()), T.StructField("mask", T.IntegerType()), *terminal])
    met = T.StructType([*[T.StructField(c, t) for c, t in (("part", T.StringType()), ("mask", T.IntegerType()), ("good", T.IntegerType()), ("bad", T.IntegerType()), ("n", T.LongType()), ("text", T.BinaryType()), ("tmask", T.IntegerType()))], *terminal])

    # the tries' rows, dealt to the ranges of their keys
    local = mask_of(keyed(rows.where("id is not null"), heavy)).select("id", "part", "good", "bad", "mask", "whole", "text", "key").mapInArrow(_local(bounds, n_ranges, _arrow(leaf)), leaf)
    dealt = local.repartitionById(n_ranges, F.col("place")).sortWithinPartitions("key")
    found = cut(dealt.mapInArrow(_meet(_arrow(met), False), met))
    # what is left of heavy whole texts: at most SALTS rows of each
    rest = found.where("text is not null").select("text", F.col("text").alias("key"), F.col("tmask").alias("mask"), *[f.name for f in terminal], F.lit(True).alias("whole"))
    rest = rest.repartition("text").sortWithinPartitions("key").mapInArrow(_meet(_arrow(met), True), met)
    names = ["part", "mask", "good", "bad", "n"]
    nameless = mask_of(rows.where("id is null")).select(*names[:4], F.lit(1).cast("long").alias("n"))
    every = found.where("text is null").select(*names).unionByName(rest.select(*names)).unionByName(nameless)
    return every.groupBy(*names[:4]).agg(F.sum("n").alias("n"))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def audit(counts: DataFrame) -> DataFrame:
    """Counts by part, order and step, from counts by (part, mask, labels): all orders of the filters over at most 32 masks a part."""
    by_mask = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("bad"))
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.instr(letters, f) > 0, 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))

    order, step = F.col("filter_order"), F.col("step")
    steps = steps.withColumn("own", bits(F.substring(order, step, F.lit(1)))).withColumn("before", bits(F.substring(order, F.lit(1), step - 1)))

    def total(of: str, counted: Callable[[Column], Column], times: Callable[[Column], Column] = lambda _: F.lit(1)) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + F.when(counted(c["mask"]), c[of] * times(c["mask"])).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails = lambda m, of: m.bitwiseAND(of) != 0
    here = lambda m: fails(m, own) & ~fails(m, before)
    # a row that fails k filters is removed by each of them in 120 / k orders
    in_orders = F.array(*[F.lit(120 // k) for k in range(1, len(FILTERS) + 1)])
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m, own.bitwiseOR(before))).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m, own) & fails(m, before)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("bad", here).alias("toxic_lost"),
        total("n", lambda m: fails(m, own), lambda m: F.get(in_orders, F.bit_count(m) - 1)).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(fail_counts(docs, labels, id_col))
