"""Lowest common ancestors and tree distances without an ancestor closure.

The closure of a node table has as many rows as all depths together.  Here a
node keeps its ancestors at distances 1, 2, 4, ... alone, so the index of n
nodes of depth d has at most n * log2(d) rows, built in log2(d) joins.  Both
nodes of a pair (all nodes of a set) are lifted to one depth and then jump
upwards together, the longest jump first, while their ancestors still
differ: log2(d) joins by node, whatever the shape of the tree.

The steps go through tables in the shared checkpoint folder, so a lost
executor repeats a few joins and no plan grows with the depth.  Node tables have one row per node; a parent without a row
of its own is a root.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


class AncestorIndex(NamedTuple):
    """``levels[k]``: ``(node_id, anc_id)`` with the ancestor 2**k steps up;
    ``depths``: ``(node_id, depth)`` of every node, 0 at a root."""

    levels: list
    depths: DataFrame


def ancestor_index(nodes: DataFrame) -> AncestorIndex:
    """Index of a node table ``(node_id, parent_id)``.

    A cycle raises ``ValueError`` after the logarithm of its length in
    rounds, each of at most one row per node: beside the ancestor at 2**k, a
    row carries the least of the 2**k ancestors up to it, and the least node
    of a cycle is the least of its own ancestors.
    """
    links = materialize(nodes.select("node_id", F.col("parent_id").alias("anc_id"), F.col("parent_id").alias("least"))
                        .filter(F.col("node_id").isNotNull() & F.col("anc_id").isNotNull()))
    roots = (nodes.select("node_id").unionByName(links.select(F.col("anc_id").alias("node_id"))).distinct()
             .filter(F.col("node_id").isNotNull())
             .join(links.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(0)))
    known, levels, step = [materialize(roots)], [], 1
    while True:
        left, cycle = links.agg(F.count(F.lit(1)), F.max(F.col("least") == F.col("node_id"))).first()
        if cycle:
            raise ValueError("the parent links form a cycle")
        if not left:
            return AncestorIndex(levels, reduce(DataFrame.unionByName, known))
        levels.append(links.select("node_id", "anc_id"))
        farther = links.select(F.col("node_id").alias("anc_id"), F.col("anc_id").alias("far"), F.col("least").alias("more"))
        both = materialize(links.join(farther, "anc_id", "left"))
        # no ancestor twice as far up: the ancestor here has its depth from an earlier round
        depths = reduce(DataFrame.unionByName, known)
        ended = both.filter(F.col("far").isNull()).select("node_id", "anc_id")
        known.append(materialize(ended.join(depths.select(F.col("node_id").alias("anc_id"), "depth"), "anc_id")
                                 .select("node_id", (F.col("depth") + F.lit(step)).alias("depth"))))
        links = both.filter(F.col("far").isNotNull()).select(
            "node_id", F.col("far").alias("anc_id"), F.least("least", "more").alias("least"))
        step *= 2


def _jumped(rows: DataFrame, level: DataFrame, col: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the level's ancestor of ``col`` (null beyond the root)."""
    return rows.join(level.select(F.col("node_id").alias(col), F.col("anc_id").alias(out)), col, "left")


def _depth_of(rows: DataFrame, index: AncestorIndex, col: str, out: str) -> DataFrame:
    return rows.join(index.depths.select(F.col("node_id").alias(col), F.col("depth").alias(out)), col, "left")


def _cut(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` written to the shared folder after every fourth level."""
    return rows if k % 4 else materialize(rows)


def _has_bit(number, k: int):
    return number.bitwiseAND(F.lit(1 << k)) != 0


def pair_ancestors(pairs: DataFrame, index: AncestorIndex) -> DataFrame:
    """G2 + G4: ``(a, b, lca, tree_dist)`` for every row of ``pairs``, repeated
    ones included; null and -1 for nodes of two trees, null nodes and nodes
    that the index does not know."""
    rows = pairs.select("a", "b", F.col("a").alias("at_a"), F.col("b").alias("at_b"))
    rows = _depth_of(_depth_of(rows, index, "at_a", "da"), index, "at_b", "db")
    rows = rows.withColumn("up", F.when(F.col("da").isNotNull() & F.col("db").isNotNull(), F.least("da", "db")))
    for k in reversed(range(len(index.levels))):                         # to one depth
        for col, depth in (("at_a", "da"), ("at_b", "db")):
            rows = _jumped(rows, index.levels[k], col, "to").withColumn(
                col, F.when(_has_bit(F.col(depth) - F.col("up"), k), F.col("to")).otherwise(F.col(col))).drop("to")
        rows = _cut(rows, k)
    for k in reversed(range(len(index.levels))):                         # upwards while they differ
        rows = _jumped(_jumped(rows, index.levels[k], "at_a", "to_a"), index.levels[k], "at_b", "to_b")
        moves = (F.col("at_a") != F.col("at_b")) & (F.col("to_a") != F.col("to_b"))
        rows = _cut(rows.select(
            "a", "b", "da", "db", F.when(moves, F.col("to_a")).otherwise(F.col("at_a")).alias("at_a"),
            F.when(moves, F.col("to_b")).otherwise(F.col("at_b")).alias("at_b"),
            F.when(moves, F.col("up") - F.lit(1 << k)).otherwise(F.col("up")).alias("up")), k)
    same = (F.col("at_a") == F.col("at_b")) & F.col("up").isNotNull()
    below = F.col("to_a") == F.col("to_b")
    parent = index.levels[0] if index.levels else index.depths.limit(0).select("node_id", F.col("node_id").alias("anc_id"))
    rows = _jumped(_jumped(rows, parent, "at_a", "to_a"), parent, "at_b", "to_b")
    at = F.when(same, F.col("up")).when(below, F.col("up") - 1)
    return rows.select("a", "b", F.when(same, F.col("at_a")).when(below, F.col("to_a")).alias("lca"),
                       F.coalesce(F.col("da") + F.col("db") - 2 * at, F.lit(-1)).alias("tree_dist"))


def set_ancestors(members: DataFrame, index: AncestorIndex, set_col: str = "set_id") -> DataFrame:
    """``(set, lca)`` for the sets of ``(set, node_id)`` rows, repeated ones
    counted once; null for nodes of several trees, and for a set with a null
    or unknown node.  Rows with a null set belong to none and are left out.
    Members that meet go on as one row."""
    rows = members.select(set_col, "node_id").filter(F.col(set_col).isNotNull()).distinct()
    rows = materialize(_depth_of(rows, index, "node_id", "depth"))
    sets = rows.groupBy(set_col).agg(
        F.min("depth").alias("up"), F.max(F.col("depth").isNull()).alias("unknown"))
    rows = materialize(rows.join(sets.filter(~F.col("unknown")).drop("unknown"), set_col)
                       .select(set_col, "node_id", (F.col("depth") - F.col("up")).alias("lift")))
    for k in reversed(range(len(index.levels))):
        rows = _cut(_jumped(rows, index.levels[k], "node_id", "to").select(
            set_col, F.when(_has_bit(F.col("lift"), k), F.col("to")).otherwise(F.col("node_id")).alias("node_id"), "lift"), k)
    rows, met = rows.select(set_col, "node_id").distinct(), []
    for k in reversed(range(len(index.levels))):
        rows = materialize(_jumped(rows, index.levels[k], "node_id", "to"))
        state = materialize(rows.groupBy(set_col).agg(
            F.min("node_id").alias("lca"), (F.min("node_id") != F.max("node_id")).alias("differ"), (F.min("to") != F.max("to")).alias("moves")))
        met.append(state.filter(~F.col("differ")).select(set_col, "lca"))
        rows = rows.join(state.filter("differ").select(set_col, "moves"), set_col).select(
            set_col, F.when(F.col("moves"), F.col("to")).otherwise(F.col("node_id")).alias("node_id")).distinct()
    # what is one node now, or has one parent
    rows = materialize(_jumped(rows, index.levels[0], "node_id", "to") if index.levels else rows.withColumn("to", F.col("node_id")))
    last = rows.groupBy(set_col).agg(F.min("node_id").alias("lca"), F.max("node_id").alias("other"), F.min("to").alias("to"), F.max("to").alias("to_other"))
    met.append(last.select(set_col, F.when(F.col("lca") == F.col("other"), F.col("lca"))
                           .when(F.col("to") == F.col("to_other"), F.col("to")).alias("lca")).filter(F.col("lca").isNotNull()))
    found = reduce(DataFrame.unionByName, met)
    return sets.select(set_col).join(found, set_col, "left")
