"""Merkle manifest of a dataset: a digest and a proof for each row, by a butterfly exchange.

1. Leaves: a row's digest covers the row's fields. Only ids and digests go on. They are range-partitioned by (tree, id) and sorted there;
   a count per partition and tree gives every leaf its place in its tree (``numbered``).
2. Blocks: ``fanout ** k`` neighbouring leaves of a tree, at most ``BLOCK``, are one row, an aligned part of the tree with one subtree root.
3. Butterfly exchange: in round r, groups of ``fanout`` blocks whose numbers differ in digit r alone swap the roots of the
   subtrees they lie in. Each block hashes the common ancestor for itself, as all blocks below it do, and keeps what it was sent as the proof of that level. After as many rounds as the
   tree has levels above the blocks, each block holds the root and its whole upper proof; nothing is passed down. Where the last subtree has fewer blocks than its neighbours, each of its blocks answers several.
4. The roots of the trees are the leaves of one tree above them, climbed the same way.
5. Each block then hashes its own leaves once more and lists each leaf's proof: its siblings inside the block, the block's
   upper proof, and its tree's. A digest that is folded with a proof is compared with the root.

Siblings are listed in order, with the place of the node among them, so that a proof can be folded without the tree.

Defined results: a null field is ``-``; rows without an id come first in their tree; rows that repeat an id are leaves each, in the order of their digests, rows that repeat wholly are
leaves each; a null tree is a tree of its own and comes first, trees are ordered by their UTF-8 bytes; a lone leaf is its own root; an empty table gives no rows. A text of any length is hashed whole and never
shuffled. Only the named columns are read, so further columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelstack.llm.shared import cut

FANOUT = 2
#: Most leaves of a block: one row of some hundred bytes a leaf.
BLOCK = 4096
#: Rows of digests (some 200 bytes) that may be broadcast.
BROADCAST_BLOCKS = 200_000
#: A level of a proof: the node's place among its siblings, and the siblings in order, itself left out.
LEVEL = "struct<place:int,siblings:array<string>>"
_IN_PARTITION = (1 << 33) - 1


def field(value: Column) -> Column:
    """``-`` if null, else the value's UTF-8 length, ``:``, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields in order."""
    return F.sha2(F.concat(*map(field, fields)), 256)


def join_digest(digests: Column) -> Column:
    """Lowercase hex SHA-256 of an array of hex digests in order."""
    return F.sha2(F.array_join(digests, ""), 256)


def numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """Add ``at``, each row's place from 0 in its ``tree``, ascending by ``order`` (nulls first); rows that agree in all of it are interchangeable."""
    # what is equal in all columns may still be split between partitions
    spread = cut(leaves.withColumn("_tie", F.monotonically_increasing_id()))
    ranged = spread.repartitionByRange("tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie")
    ranged = cut(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(_IN_PARTITION)))
    runs = ranged.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col("tree").alias("_tree"), "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_start"))
    starts = starts.withColumnRenamed("_part", "_run")
    same = (F.col("_part") == F.col("_run")) & F.col("tree").eqNullSafe(F.col("_tree"))
    return ranged.join(starts, same).withColumn("at", F.col("_at") + F.col("_start")).drop("_part", "_at", "_n", "_from", "_tree", "_run", "_start")


def block_size(fanout: int, most: int = BLOCK) -> int:
    """The greatest power of ``fanout`` that is at most ``most``."""
    size = 1
    while size * fanout <= most:
        size *= fanout
    return size


def levels_of(leaves: list[str], fanout: int) -> list[list[str]]:
    """All levels of a tree from its leaves on: runs of ``fanout`` nodes become their hash, the last run as well if it is shorter, until one is left."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([hashlib.sha256("".join(last[i : i + fanout]).encode()).hexdigest() for i in range(0, len(last), fanout)])
    return levels


def _top(leaves: list[str], fanout: int, depth: int) -> list[list[str]]:
    """Levels of a block: a block of a larger tree is hashed up to its full depth, even where it has fewer leaves than others."""
    levels = levels_of(leaves, fanout)
    while len(levels) <= depth:
        levels.append([hashlib.sha256(levels[-1][0].encode()).hexdigest()])
    return levels


def blocks_of(leaves: DataFrame, fanout: int, size: int) -> DataFrame:
    """(tree, block, n_blocks, leaves, root) from numbered leaves (tree, at, leaf, and what ``leaves`` is to carry)."""
    carried = [c for c in leaves.columns if c not in ("tree", "at")]
    rows = leaves.groupBy("tree", F.floor(F.col("at") / size).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", *carried))).alias("leaves"))
    counts = leaves.groupBy("tree").agg((F.floor(F.max("at") / size) + 1).cast("long").alias("n_blocks")).withColumnRenamed("tree", "_tree")
    rows = rows.join(counts, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    depth = _depth(fanout, size)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            roots = [_top(list(digests), fanout, depth if n > 1 else 0)[-1][0] for digests, n in zip(p["digests"], p["n_blocks"], strict=True)]
            yield pd.DataFrame({"tree": p["tree"], "block": p["block"], "n_blocks": p["n_blocks"], "leaves": p["leaves"], "root": roots})

    tree, leaf = rows.schema["tree"].dataType.simpleString(), rows.schema["leaves"].dataType.simpleString()
    with_digests = rows.withColumn("digests", F.transform("leaves", lambda x: x["leaf"]))
    return with_digests.mapInPandas(run, f"tree {tree}, block long, n_blocks long, leaves {leaf}, root string")


def _depth(fanout: int, size: int) -> int:
    depth = 0
    while fanout**depth < size:
        depth += 1
    return depth


def butterfly(roots: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, root, proof) from subtree roots (tree, block, n_blocks, root): the tree's root, and the levels above the block.

    Round r deals with subtrees of ``fanout ** r`` blocks. A block asks for the root of each of the other subtrees in its group, and asks the block there
    that stands where it stands itself, or another one if that subtree, the tree's last, is shorter.
    """
    state = cut(roots.withColumn("proof", F.array().cast(f"array<{LEVEL}>")))
    most = state.agg(F.max("n_blocks")).first()[0] or 0
    span = 1
    while span < most:
        climbing = state.where(F.col("n_blocks") > span)
        own = F.floor(F.col("block") / span)
        first = F.floor(own / fanout) * fanout
        others = F.filter(F.sequence(first, first + fanout - 1), lambda n: (n != own) & (n * span < F.col("n_blocks")))
        asked = climbing.select("tree", "block", F.explode(others).alias("node"), "n_blocks")
        length = F.least(F.lit(span), F.col("n_blocks") - F.col("node") * span)
        asked = asked.select("tree", "block", "node", (F.col("node") * span + F.pmod(F.col("block"), F.lit(span)) % length).alias("partner"))
        held = climbing.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), F.col("root").alias("sibling"))
        told = asked.join(held, asked["tree"].eqNullSafe(held["_tree"]) & (asked["partner"] == held["_block"]))
        told = told.groupBy("tree", "block").agg(F.array_sort(F.collect_list(F.struct("node", "sibling"))).alias("told")).withColumnsRenamed({"tree": "_tree", "block": "_block"})
        met = climbing.join(told, climbing["tree"].eqNullSafe(told["_tree"]) & (climbing["block"] == told["_block"]), "left").drop("_tree", "_block")
        told = F.coalesce("told", F.array().cast("array<struct<node:bigint,sibling:string>>"))
        place = (own % fanout).cast("int")
        siblings = F.transform(told, lambda t: t["sibling"])
        level = F.struct(place.alias("place"), siblings.alias("siblings"))
        family = F.concat(F.slice(siblings, F.lit(1), place), F.array("root"), F.slice(siblings, place + 1, F.lit(fanout)))
        met = met.select("tree", "block", "n_blocks", join_digest(family).alias("root"), F.concat("proof", F.array(level)).alias("proof"))
        state = cut(met.unionByName(state.where(F.col("n_blocks") <= span)))
        span *= fanout
    return state


def climb(leaves: DataFrame, fanout: int = FANOUT, most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks with their leaves, the exchange's end state) of numbered leaves."""
    blocks = cut(blocks_of(leaves, fanout, block_size(fanout, most)))
    return blocks, butterfly(blocks.select("tree", "block", "n_blocks", "root"), fanout)


def fold(leaf: str, proof: list[tuple[int, list[str]]]) -> str:
    """The root that a digest and its proof give."""
    for place, siblings in proof:
        leaf = hashlib.sha256("".join([*siblings[:place], leaf, *siblings[place:]]).encode()).hexdigest()
    return leaf


def manifest(rows: DataFrame, fanout: int = FANOUT, most: int = BLOCK) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (tree, id, leaf, claimed).

    ``claimed`` is the digest that is to be verified: it is folded with the proof of ``leaf``. Trees must be strings.
    """
    blocks, ends = climb(numbered(rows, "id", "leaf", "claimed"), fanout, most)
    subroots = cut(ends.where("block = 0").select("tree", F.col("root").alias("leaf")))
    forest = numbered(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "leaf"), "name")
    upper_blocks, upper_ends = climb(forest, fanout, most)
    upper = _with_proofs(upper_blocks, upper_ends, fanout, most, ["name"])
    upper = upper.select(F.col("name").alias("_tree"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("above"))
    # one row a block, and one a tree: some hundred bytes for thousands of rows
    tops = ends.select(F.col("tree").alias("_tree2"), F.col("block").alias("_block"), "proof")
    both = blocks.drop("root").join(tops, F.col("tree").eqNullSafe(F.col("_tree2")) & (F.col("block") == F.col("_block"))).drop("_tree2", "_block")
    both = both.join(upper, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    both = both.select("n_blocks", "leaves", F.concat("proof", "above").alias("above"), "subroot", "root")
    depth, kind = _depth(fanout, block_size(fanout, most)), rows.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for n, leaves, above, subroot, root in p.itertuples(index=False):
                above = [(int(x["place"]), list(x["siblings"])) for x in above]
                out = []
                for leaf, inner in zip(leaves, _inner([x["leaf"] for x in leaves], fanout, depth if n > 1 else 0), strict=True):
                    proof = inner + above
                    told = hashlib.sha256("".join(s for _, level in proof for s in level).encode()).hexdigest()
                    folded = fold(leaf["claimed"], proof)
                    out.append((leaf["id"], leaf["leaf"], subroot, root, told, folded, folded == root))
                yield pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return both.mapInPandas(run, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _inner(leaves: list[str], fanout: int, depth: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Each leaf's proof inside its block."""
    levels = _top(leaves, fanout, depth)
    for i in range(len(leaves)):
        proof, node = [], i
        for level in levels[:-1]:
            first = node - node % fanout
            run = level[first : first + fanout]
            proof.append((node - first, run[: node - first] + run[node - first + 1 :]))
            node //= fanout
        yield proof


def _with_proofs(blocks: DataFrame, ends: DataFrame, fanout: int, most: int, carried: list[str]) -> DataFrame:
    """(carried columns, leaf, root, proof) of each leaf."""
    depth = _depth(fanout, block_size(fanout, most))
    tops = ends.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), F.col("root").alias("_root"), "proof")
    both = blocks.join(tops, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))).select("n_blocks", "leaves", F.col("_root").alias("root"), "proof")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for n, leaves, root, above in p.itertuples(index=False):
                above = [(int(x["place"]), list(x["siblings"])) for x in above]
                inner = _inner([x["leaf"] for x in leaves], fanout, depth if n > 1 else 0)
                yield pd.DataFrame([(*[x[c] for c in carried], x["leaf"], root, [{"place": a, "siblings": b} for a, b in proof + above]) for x, proof in zip(leaves, inner, strict=True)], columns=[*carried, "leaf", "root", "proof"])

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema["leaves"].dataType.elementType.fields}
    return both.mapInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in carried], "leaf string, root string", f"proof array<{LEVEL}>"]))


def document_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Manifest of documents: a tree per lang, ascending by doc_id. Where ``tampered`` holds, what is verified has 1 added to n_chars."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = digest(*fields)
    claimed = leaf if tampered is None else F.when(tampered & F.col("n_chars").isNotNull(), digest(*fields[:3], F.col("n_chars") + 1, fields[4])).otherwise(leaf)
    rows = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), leaf.alias("leaf"), claimed.alias("claimed"))
    return manifest(rows).withColumnRenamed("id", "doc_id")
