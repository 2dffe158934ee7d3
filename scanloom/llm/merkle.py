"""A Merkle manifest of a table: a tree per group of rows, and one over the groups' roots.

Nodes of a level are cut into superblocks of ``fanout ** LEVELS`` consecutive ones.  Going
up, each superblock is reduced to its top, and the tops are the next level's nodes, until a
tree has one.  Going down, a superblock's nodes are cogrouped with the siblings that their
proofs need from outside it: one task reduces the block again, joins its own siblings to the
outer ones and, at the leaves, folds each leaf up to the root.  No task sees more than a
superblock, and positions come from counts of range partitions, so that one group may hold
any share of the rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.lineage import cut

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels of a superblock: 3 ** 7 is 2,187 nodes.
LEVELS = 7
#: Rows of a range partition in which positions are counted.
RANGE_ROWS = 200_000

NODE = "tree string, pos long, n long, hash string"
OUTER = "tree string, pos long, proof string, places string, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of the values one after the other: ``-`` for null, else byte count, ``:``, value."""
    parts = []
    for value in columns.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def places(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """nodes with ``pos`` from 0 in their tree, by order, and the tree's count ``n``."""
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), nodes.count() // RANGE_ROWS + 1)
    ranged = cut(nodes.repartitionByRange(parts, tree, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    over = Window.partitionBy("_tree")
    counts = ranged.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_of")).agg(F.count("*").alias("_m"))
    counts = counts.withColumn("_before", F.sum("_m").over(over.orderBy("_of")) - F.col("_m")).withColumn("n", F.sum("_m").over(over))
    rows = ranged.join(cut(counts, "range-counts"), (F.col(tree) == F.col("_tree")) & (F.col("_part") == F.col("_of")))
    place = F.row_number().over(Window.partitionBy(tree, "_part").orderBy(*order))
    return rows.withColumn("pos", F.col("_before") + place - 1).drop("_part", "_tree", "_of", "_m", "_before")


def reduced(nodes: list[str], fanout: int, steps: int) -> list[list[str]]:
    """The nodes and the levels above them, ``steps`` of them, or until one is left if 0."""
    out = [nodes]
    while len(out) <= steps if steps else len(out[-1]) > 1:
        below = out[-1]
        out.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def siblings(levels: list[list[str]], at: int, fanout: int) -> tuple[str, str]:
    """Proof of a node within its block: the digests of its runs' others, and per level one
    letter for each of the run's nodes, ``x`` at its own place, ``o`` at the others'."""
    proof, shape = [], []
    for level in levels[:-1]:
        low = at // fanout * fanout
        run = level[low : low + fanout]
        proof += run[: at - low] + run[at - low + 1 :]
        shape.append("".join("x" if low + j == at else "o" for j in range(len(run))))
        at //= fanout
    return "".join(proof), " ".join(shape)


def fold(leaf: str, proof: str, shape: str) -> str:
    """The root that a leaf and its proof lead to."""
    at = 0
    for run in shape.split():
        parts = []
        for letter in run:
            parts.append(leaf if letter == "x" else proof[at : at + 64])
            at += 64 * (letter == "o")
        leaf = digest("".join(parts))
    return leaf


def _block(width: int) -> Column:
    return F.floor(F.col("pos") / width).cast("long")


def _climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The given nodes, their superblocks' tops, those tops' tops and so on, up to one a tree."""
    width, out = fanout**levels, [nodes]

    def top(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        tree, pos, n = block["tree"].iloc[0], block["pos"].iloc[0], block["n"].iloc[0]
        last = reduced(block["hash"].tolist(), fanout, levels if n > width else 0)[-1][0]
        return pd.DataFrame({"tree": [tree], "pos": [pos // width], "n": [-(-n // width)], "hash": [last]})

    left = nodes.agg(F.max("n")).first()[0] or 0
    while left > 1:
        below = out[-1].select("tree", "pos", "n", "hash")
        out.append(cut(below.groupBy("tree", _block(width).alias("_block")).applyInPandas(top, NODE), "tree-tops"))
        left = -(-left // width)
    return out


def _descend(nodes: DataFrame, outer: DataFrame, fanout: int, levels: int, finish: str | None = None) -> DataFrame:
    """The outer siblings of each node, from those of its superblock; with ``finish`` the
    nodes are leaves, and that schema's columns come out."""
    width = fanout**levels

    def join(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        up = above.iloc[0]
        hashes = block["hash"].tolist()
        tree = reduced(hashes, fanout, levels if block["n"].iloc[0] > width else 0)
        first, out = int(block["pos"].iloc[0]), []
        for pos in block["pos"]:
            proof, shape = siblings(tree, int(pos) - first, fanout)
            out.append((proof + up["proof"], f"{shape} {up['places']}".strip()))
        found = block.assign(proof=[x[0] for x in out], places=[x[1] for x in out], root=up["root"], subroot=up["subroot"])
        if not finish:
            return found[[c.split()[0] for c in OUTER.split(", ")]]
        told = found["told"].where(found["told"].notna(), found["hash"])
        folded = [fold(leaf, proof, shape) for leaf, proof, shape in zip(told, found["proof"], found["places"], strict=True)]
        found = found.assign(leaf=found["hash"], folded_root=folded, verified=[x == up["root"] for x in folded])
        return found[[c.split()[0] for c in finish.split(", ")]]

    left = nodes.groupBy("tree", _block(width).alias("_block"))
    return left.cogroup(outer.groupBy("tree", F.col("pos").alias("_block"))).applyInPandas(join, finish or OUTER)


def manifest(rows: DataFrame, group: str = "source", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS, altered: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Per row: ``order``, leaf, subroot (of its group), root, proof, places, folded_root, verified.

    A leaf hashes ``columns``; within a group leaves ascend by ``order`` (long, null first), then by
    themselves; groups ascend as UTF-8 bytes, null first.  Every run of ``fanout`` nodes becomes
    their hash, the last run even if it has one, until one is left.  proof holds the digests
    of the siblings from leaf to root, 64 letters each, places their runs.  folded_root is what
    the leaf of the row with ``altered`` columns (null: as they are) and the proof lead to.

    Repeated rows are leaves of their own.  Extra columns are not read.  An empty table gives no rows.
    """
    own = {c: F.col(c) for c in columns}
    told = F.lit(None).cast("string") if altered is None else leaf_hash(own | {c: F.coalesce(v, F.col(c)) for c, v in altered.items()})
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    leaves = cut(rows.select(tree.alias("tree"), F.col(order).cast("long").alias("_order"), F.col(order).cast("long").cast("string").alias("_id"), leaf_hash(own).alias("hash"), told.alias("told")), "leaves")
    placed = cut(places(leaves, "tree", ["_order", "hash", "told"]), "placed-leaves")
    within = _climb(placed, fanout, levels)

    tops = within[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    tops = cut(places(tops, "tree", ["name"]), "subroots")
    above = _climb(tops, fanout, levels)
    outer = above[-1].select("tree", "pos", F.lit("").alias("proof"), F.lit("").alias("places"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    for nodes in reversed(above[:-1]):
        outer = cut(_descend(nodes.select("tree", "pos", "n", "hash"), outer, fanout, levels), "outer")
    found = outer.select("pos", "proof", "places", "root")
    outer = cut(tops.select("pos", "name", "hash").join(found, "pos").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof", "places", F.col("hash").alias("subroot"), "root"), "outer")
    for nodes in reversed(within[1:-1]):
        outer = cut(_descend(nodes, outer, fanout, levels), "outer")
    # As text, since pandas has no whole numbers beside nulls.
    finish = "_id string, leaf string, subroot string, root string, proof string, places string, folded_root string, verified boolean"
    proved = _descend(placed.select("tree", "pos", "n", "_id", "hash", "told"), outer, fanout, levels, finish)
    return proved.select(F.col("_id").cast("long").alias(order), *proved.columns[1:])
