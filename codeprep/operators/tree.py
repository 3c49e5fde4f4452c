"""Tree distances.

G1–G4 work on any parent-pointer node table ``(node_id, parent_id)``: the
ancestor closure is built by self-joins (path doubling, each round
written to the shared folder), LCA and distance are joins and aggregates on it.

G6 uses a bracket tree over the token sequence: every bracket pair opens a
block node whose children are the tokens inside (the brackets included);
other tokens hang under the innermost open block.  With ``h_k`` the nesting
level after token ``k`` and ``d_t`` the depth of leaf ``t``::

    dist(i, j) = d_i + d_j - 2 * min(h_i, ..., h_{j-1})      (i < j)

(the minimum level between two tokens is the depth of their lowest common
block).  The triangle of one row is computed in Arrow batches with a
running minimum per ``i`` – O(n^2) per row, which is the output size – and
is kept as one ``array<int>`` per row, never as pair rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import constants as K
from ..session import materialize, ship_package

# ---------------------------------------------------------------------------
# G1–G4 on node tables
# ---------------------------------------------------------------------------


def ancestor_closure(nodes: DataFrame) -> DataFrame:
    """G1: ``(node_id, anc_id, dist)`` for every node and each of its ancestors,
    the node itself included with ``dist = 0``.

    Path doubling: after round k the closure holds all distances below 2**k
    and ``jump`` the ancestors at 2**k exactly, so the number of rounds is the
    logarithm of the depth, which has no limit.  A cycle raises as soon as
    one of its nodes is its own ancestor, in the logarithm of its length.
    """
    closure = materialize(nodes.select("node_id", F.col("node_id").alias("anc_id"), F.lit(0).alias("dist")))
    jump = materialize(nodes.select("node_id", F.col("parent_id").alias("anc_id")).filter(F.col("parent_id").isNotNull()))
    step = 1
    while not jump.isEmpty():
        up = jump.select("node_id", F.col("anc_id").alias("via"))
        farther = up.join(closure.select(F.col("node_id").alias("via"), "anc_id", "dist"), "via") \
            .select("node_id", "anc_id", (F.col("dist") + F.lit(step)).alias("dist"))
        jump = materialize(up.join(jump.select(F.col("node_id").alias("via"), "anc_id"), "via").select("node_id", "anc_id"))
        closure = materialize(closure.unionByName(farther))
        if not closure.where("dist > 0 and node_id = anc_id").isEmpty():
            raise ValueError("the parent links form a cycle")
        step *= 2
    return closure


def node_depths(closure: DataFrame) -> DataFrame:
    """Depth of every node = distance to its root."""
    return closure.groupBy("node_id").agg(F.max("dist").alias("depth"))


def pair_lca(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """G2 + G4: for pairs ``(a, b)``: ``lca`` and tree distance; -1 / null if none."""
    ca = closure.select(F.col("node_id").alias("a"), "anc_id", F.col("dist").alias("da"))
    cb = closure.select(F.col("node_id").alias("b"), "anc_id", F.col("dist").alias("db"))
    common = pairs.select("a", "b").join(ca, "a").join(cb, ["b", "anc_id"])
    best = (common.groupBy("a", "b")
            .agg(F.min_by(F.struct((F.col("da") + F.col("db")).alias("d"), F.col("anc_id")),
                         F.col("da") + F.col("db")).alias("m")))
    return (pairs.select("a", "b").join(best, ["a", "b"], "left")
            .select("a", "b", F.col("m.anc_id").alias("lca"),
                    F.coalesce(F.col("m.d"), F.lit(-1)).alias("tree_dist")))


def set_lca(members: DataFrame, closure: DataFrame, set_col: str = "set_id") -> DataFrame:
    """Lowest common ancestor of each set of nodes (null if none).

    Common ancestors are those reached from every distinct member; they lie on
    one path, and the lowest is the one nearest to the members.
    """
    m = members.select(set_col, "node_id").distinct()
    size = m.groupBy(set_col).agg(F.count(F.lit(1)).alias("_n"))
    cnt = (m.join(closure, "node_id").groupBy(set_col, "anc_id")
           .agg(F.count(F.lit(1)).alias("_c"), F.min("dist").alias("_near"))
           .join(size, set_col).filter(F.col("_c") == F.col("_n")))
    best = cnt.groupBy(set_col).agg(F.min_by("anc_id", "_near").alias("lca"))
    return size.select(set_col).join(best, set_col, "left")


# ---------------------------------------------------------------------------
# G6–G8 on token arrays
# ---------------------------------------------------------------------------

def _levels(tokens: list) -> tuple[np.ndarray, np.ndarray]:
    tok = np.asarray(tokens, dtype=object)
    opens = np.isin(tok, K.OPEN_BRACKETS)
    closes = np.isin(tok, K.CLOSE_BRACKETS)
    step = opens.astype(np.int64) - closes.astype(np.int64)
    after = np.cumsum(step)                    # h_k: level after token k
    before = after - step                      # level before token k
    block = np.where(opens, before + 1, before)  # depth of the block holding the leaf
    return after, block + 1                    # (h, leaf depth d)


#: Longest row that gets a triangle (documented parameter of G6): 20,000 tokens
#: are 2e8 values, 0.8 GB.  Longer rows get null and are for the rejects (F4
#: comes first in the preparation stage, with its own limit); any distance of
#: theirs can be looked up by ``with_range_minima`` and ``token_distance``.
TRIANGLE_MAX_TOKENS = 20_000


def triangle_of(tokens) -> np.ndarray:
    """Upper triangle (row-major, no diagonal) of bracket-tree distances."""
    n = len(tokens)
    if n < 2:
        return np.zeros(0, dtype=np.int32)
    h, d = _levels(list(tokens))
    out = np.empty(n * (n - 1) // 2, dtype=np.int32)
    at = 0
    for i in range(n - 1):
        run_min = np.minimum.accumulate(h[i:n - 1])          # min(h_i..h_{j-1}) for j = i+1..n-1
        out[at:at + n - 1 - i] = d[i] + d[i + 1:] - 2 * run_min
        at += n - 1 - i
    return out


#: Bytes of triangles that one Arrow batch holds before it is sent on.
TRIANGLE_BATCH_BYTES = 64 * 1024 * 1024


def with_triangles(df: DataFrame, tokens_col: str | tuple = "tokens", out_col: str | tuple = "dist",
                   max_tokens: int = TRIANGLE_MAX_TOKENS) -> DataFrame:
    """``df`` with ``out_col``, an ``array<int>`` of length n(n-1)/2 per row
    (null tokens: empty; rows over ``max_tokens``: null).  Several token columns
    get their triangles in one pass.

    The output grows with n^2, so it leaves the task in Arrow batches bounded
    by bytes, whatever the number of rows.
    """
    tokens_cols, out_cols = ((c,) if isinstance(c, str) else tuple(c) for c in (tokens_col, out_col))
    at = [df.columns.index(c) for c in tokens_cols]
    schema = Ty.StructType([*df.schema.fields, *[Ty.StructField(c, Ty.ArrayType(Ty.IntegerType())) for c in out_cols]])

    def batch_of(rows, made):
        return pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(m, pa.list_(pa.int32())) for m in made]], [*rows.schema.names, *out_cols])

    def run(batches):
        for batch in batches:
            start, size, made = 0, 0, [[] for _ in at]
            for i in range(batch.num_rows):
                for k, triangles in zip(at, made):
                    tokens = batch.column(k)[i].as_py() or []
                    triangles.append(triangle_of(tokens) if len(tokens) <= max_tokens else None)
                    size += 2 * len(tokens) ** 2
                if size >= TRIANGLE_BATCH_BYTES:
                    yield batch_of(batch.slice(start, i + 1 - start), made)
                    start, size, made = i + 1, 0, [[] for _ in at]
            if made[0]:
                yield batch_of(batch.slice(start), made)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def with_range_minima(df: DataFrame, tokens_col: str = "tokens", depth_col: str = "depth", minima_col: str = "minima") -> DataFrame:
    """``df`` with what any distance of G6 can be looked up from in constant
    time: each token's depth, and the sparse table of the nesting levels (row
    k: the least level of each 2**k levels in a row).

    n log n numbers a row in place of n**2, so rows of any length have their
    distances; null tokens give empty arrays."""
    at = df.columns.index(tokens_col)
    schema = Ty.StructType([*df.schema.fields, Ty.StructField(depth_col, Ty.ArrayType(Ty.IntegerType())),
                            Ty.StructField(minima_col, Ty.ArrayType(Ty.ArrayType(Ty.IntegerType())))])

    def of(tokens):
        if not tokens:
            return [], []
        h, d = _levels(tokens)
        rows, width = [h.astype(np.int32)], 1
        while 2 * width <= len(h):
            rows.append(np.minimum(rows[-1][:-width], rows[-1][width:]))
            width *= 2
        return d.astype(np.int32), rows

    def run(batches):
        for batch in batches:
            start, size, made = 0, 0, []
            for i, tokens in enumerate(batch.column(at)):
                made.append(of(tokens.as_py()))
                size += 4 * len(made[-1][0]) * (1 + len(made[-1][1]))
                if size >= TRIANGLE_BATCH_BYTES or i + 1 == batch.num_rows:
                    rows = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array([d for d, _ in made], pa.list_(pa.int32())), pa.array([m for _, m in made], pa.list_(pa.list_(pa.int32())))],
                        [*rows.schema.names, depth_col, minima_col])
                    start, size, made = i + 1, 0, []

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def token_distance(depth: Column, minima: Column, i: Column, j: Column) -> Column:
    """G6 for one pair of tokens, from ``with_range_minima``: two overlapping
    ranges of a power of two cover the levels between the tokens."""
    lo, hi = F.least(i, j), F.greatest(i, j)
    k = F.length(F.bin((hi - lo).cast("long"))) - 1
    row = F.element_at(minima, k + 1)
    least = F.least(F.element_at(row, lo + 1), F.element_at(row, (hi - F.pow(F.lit(2), k) + 1).cast("int")))
    return F.when(i == j, F.lit(0)).otherwise(F.element_at(depth, lo + 1) + F.element_at(depth, hi + 1) - 2 * least)


def distance_lookup(depth: Column, minima: Column, i: Column, j: Column, offset: int = K.MAX_DIST_OFFSET) -> Column:
    """G7 without a triangle: sign and offset as ``triangle_lookup``; ``(i, i)`` gives 0 (Q9)."""
    sign = F.when(i > j, -1).otherwise(1)
    return F.when(i == j, F.lit(0)).otherwise(sign * token_distance(depth, minima, i, j) + F.lit(offset))


def triangle_index(i: Column, j: Column, n: Column) -> Column:
    """0-based position of (i, j), i < j, in the row-major triangle."""
    return F.floor(i * (2 * n - i - 1) / 2).cast("long") + (j - i - 1)


def triangle_lookup(dist: Column, i: Column, j: Column, offset: int = K.MAX_DIST_OFFSET) -> Column:
    """``sign * triu[idx] + offset``; ``(i, i)`` gives 0 (Q9), ``i > j`` negates."""
    n = tokens_from_triangle(F.size(dist))
    lo, hi = F.least(i, j), F.greatest(i, j)
    sign = F.when(i > j, -1).otherwise(1)
    val = F.element_at(dist, (triangle_index(lo, hi, n) + 1).cast("int"))
    return F.when(i == j, F.lit(0)).otherwise(sign * val + F.lit(offset))


def tokens_from_triangle(m: Column) -> Column:
    """N from a triangle length m = n(n-1)/2."""
    return F.floor((F.lit(1) + F.sqrt(F.lit(1) + F.lit(8) * m.cast("double"))) / 2).cast("int")


def pair_rows(dist_col: str, n_col: str, id_col: str, df: DataFrame) -> DataFrame:
    """Exploded ``(id, i, j, dist)`` – for tests and small n only."""
    idx = F.flatten(F.transform(F.sequence(F.lit(0), F.col(n_col) - 2),
                                lambda i: F.transform(F.sequence(i + 1, F.col(n_col) - 1),
                                                      lambda j: F.struct(i.alias("i"), j.alias("j")))))
    z = F.arrays_zip(idx.alias("ij"), F.col(dist_col).alias("d"))
    return (df.filter(F.col(n_col) >= 2).select(id_col, F.inline(z))
            .select(id_col, "ij.i", "ij.j", F.col("d").alias("dist")))


def full_matrix_rows(df: DataFrame, id_col: str, tokens_col: str, dist_col: str) -> DataFrame:
    """The full symmetric matrix as ``(id, i, j, dist)`` rows – the upper
    triangle, its mirror and a zero diagonal.  Quadratic in n: for tests and
    short rows only (training keeps the triangle array)."""
    n = F.size(tokens_col)
    upper = pair_rows(dist_col, "_n", id_col, df.withColumn("_n", n))
    mirror = upper.select(id_col, F.col("j").alias("i"), F.col("i").alias("j"), "dist")
    diag = df.select(id_col, F.posexplode(tokens_col).alias("i", "_t")).select(
        id_col, "i", F.col("i").alias("j"), F.lit(0).alias("dist"))
    return upper.unionByName(mirror).unionByName(diag)
