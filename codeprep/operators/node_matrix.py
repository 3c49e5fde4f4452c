"""Distance matrices of documents whose tokens point into a node table.

A document's token nodes, in depth-first order, and the depth at which each
meets the one before it are the compressed tree of these nodes: it has one
entry a token however large the tree is, and for two places a < b of that
order::

    dist(a, b) = depth_a + depth_b - 2 * min(meet_{a+1}, ..., meet_b)

Any depth-first order will do.  In the depths by such an order, two nodes meet
one step above the least depth behind the first and up to the second.  A
document's tree is one row of arrays, as its text was; the matrix leaves the
task as one row a token, so no value grows with the square of the tokens.

A token has distance -1 to all, itself included, if its node is null or not in
the document's table; so have two nodes of different roots.  A parent without a
row of its own is a root, as in ``ancestry``.  A node with two different
parents or a cycle raises ``ValueError``.  Rows with a null document or a null
node are left out of the node table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..session import ship_package

#: Above all depths.
FAR = np.iinfo(np.int32).max
#: Distances that are made at a time.
BLOCK = 1 << 20


def depths_and_entries(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depth of each node, and its place in a depth-first order, from the
    places of the parents (-1: none)."""
    n = len(up)
    depth, jump = (up >= 0).astype(np.int64), up.copy()
    for _ in range(n.bit_length() + 1):
        more = np.flatnonzero(jump >= 0)
        if not len(more):
            break
        depth[more], jump[more] = depth[more] + depth[jump[more]], jump[jump[more]]
    else:
        raise ValueError("the parent links form a cycle")
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)
    size = np.ones(n, np.int64)
    for level in levels[:0:-1]:
        np.add.at(size, up[level], size[level])
    siblings = np.argsort(up, kind="stable")
    before = np.cumsum(size[siblings]) - size[siblings]
    first = np.r_[True, np.diff(up[siblings]) != 0]
    entry = np.empty(n, np.int64)
    entry[siblings] = before - before[first][np.cumsum(first) - 1]
    for level in levels[1:]:
        entry[level] += entry[up[level]] + 1
    return depth, entry


def numbered(nodes: pa.Array, parents: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three columns by numbers of their values, by first use (-1: null)."""
    codes = pa.concat_arrays([nodes, parents, tokens]).dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    return codes[:len(nodes)], codes[len(nodes):2 * len(nodes)], codes[2 * len(nodes):]


def compressed_tree(own: np.ndarray, above: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rank, depth, meet)``: each token's place in the order (-1: no node),
    and by place the depth and the depth of meeting the place before (-1: no
    common root; 0 for the first); from the numbers of nodes, of their parents
    and of the tokens' nodes."""
    known = 1 + max(own.max(initial=-1), above.max(initial=-1))  # by first use the tokens' unknown nodes come last
    up = np.full(known, -1)
    up[own] = np.maximum(up[own], above)
    if (up[own] != above).any():
        raise ValueError("a node has two parents")
    rank = np.full(len(wanted), -1)
    found = np.flatnonzero((wanted >= 0) & (wanted < known))
    if not len(found):
        return rank, np.zeros(0, np.int32), np.zeros(0, np.int32)
    depth, entry = depths_and_entries(up)
    at = wanted[found]
    order = np.argsort(entry[at], kind="stable")
    rank[found[order]] = np.arange(len(order))
    places, by_entry = entry[at][order], np.empty(known + 1, np.int64)
    by_entry[entry], by_entry[known] = depth, FAR
    mine = by_entry[places]
    # the least depth behind each place and up to the next; no entry between equal places
    ends = np.stack([places[:-1] + 1, places[1:] + 1], 1).ravel()
    least = np.minimum.reduceat(by_entry, ends)[::2] if len(ends) else ends
    meet = np.where(places[1:] == places[:-1], mine[:-1], least - 1)
    return rank, mine.astype(np.int32), np.r_[0, meet].astype(np.int32)


def distance_rows(rank: np.ndarray, depth: np.ndarray, meet: np.ndarray, first: int, last: int) -> np.ndarray:
    """Rows ``first`` to ``last`` of the matrix, by the tokens' own order."""
    out = np.full((last - first, len(rank)), -1, np.int32)
    rows, cols = np.flatnonzero(rank[first:last] >= 0), np.flatnonzero(rank >= 0)
    if len(rows):
        at, place = rank[first:last][rows][:, None], np.arange(len(depth))
        behind = np.minimum.accumulate(np.where(place > at, meet, FAR), 1)
        ahead = np.minimum.accumulate(np.where(place < at, np.r_[meet[1:], FAR], FAR)[:, ::-1], 1)[:, ::-1]
        least = np.where(place == at, depth, np.minimum(behind, ahead)).astype(np.int64)
        found = np.where(least < 0, -1, depth[at] + depth - 2 * least)
        out[np.ix_(rows, cols)] = found[:, rank[cols]]
    return out


def document_trees(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(doc_id, nodes, parents, tokens)``: one row for each document of
    ``tokens (doc_id, pos, node_id)``, its token nodes by ``pos``, and its part
    of the node table ``(doc_id, node_id, parent_id)``."""
    table = (nodes.filter("doc_id is not null and node_id is not null").groupBy("doc_id")
             .agg(F.collect_list(F.struct("node_id", "parent_id")).alias("t")))
    rows = (tokens.filter("doc_id is not null").groupBy("doc_id")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("tokens")))
    return rows.join(table, "doc_id", "left").select("doc_id", F.col("t.node_id").alias("nodes"), F.col("t.parent_id").alias("parents"), "tokens")


def distance_matrix(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(doc_id, i, dist)``: one row a token with its distances to all
    tokens of the document, in the order of ``pos``; the matrix is symmetric
    with a zero diagonal but for -1 (see above)."""
    trees = document_trees(nodes, tokens)
    schema = Ty.StructType([trees.schema["doc_id"], Ty.StructField("i", Ty.IntegerType()), Ty.StructField("dist", Ty.ArrayType(Ty.IntegerType()))])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                cells = [batch.column(c)[k].values for c in (1, 2, 3)]
                none = cells[2].slice(0, 0)  # a document without node table has null for it
                tree = compressed_tree(*numbered(*(none if x is None else x for x in cells)))
                n = len(tree[0])
                step = max(1, BLOCK // max(n, 1))
                for first in range(0, n, step):
                    made = distance_rows(*tree, first, min(n, first + step))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([batch.column(0)[k].as_py()] * len(made), batch.schema.field(0).type),
                        pa.array(np.arange(first, first + len(made), dtype=np.int32)),
                        pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * n, made.ravel())], ["doc_id", "i", "dist"])

    ship_package(trees.sparkSession)
    return trees.mapInArrow(run, schema)
