import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeprep.functions import constants as K
from codeprep.operators import encode as EN
from codeprep.operators import tree as TR


def explicit_tree_distances(tokens):
    """Build the bracket tree node by node and measure distances by walking parents."""
    parent, depth = {0: None}, {0: 0}
    leaf_node, stack, nxt = [], [0], 1
    for t in tokens:
        if t in K.OPEN_BRACKETS:
            blk = nxt; nxt += 1
            parent[blk], depth[blk] = stack[-1], depth[stack[-1]] + 1
            stack.append(blk)
            holder = blk
        elif t in K.CLOSE_BRACKETS:
            holder = stack[-1]
            if len(stack) > 1:
                stack.pop()
            else:                    # unbalanced close: a new virtual root above
                pass
        else:
            holder = stack[-1]
        leaf = nxt; nxt += 1
        parent[leaf], depth[leaf] = holder, depth[holder] + 1
        leaf_node.append(leaf)

    def anc(x):
        out = []
        while x is not None:
            out.append(x); x = parent[x]
        return out
    res = []
    n = len(tokens)
    for i in range(n):
        ai = anc(leaf_node[i])
        for j in range(i + 1, n):
            aj = set(anc(leaf_node[j]))
            lca = next(a for a in ai if a in aj)
            res.append(depth[leaf_node[i]] + depth[leaf_node[j]] - 2 * depth[lca])
    return res


def test_triangle_equals_explicit_tree():
    random.seed(5)
    for _ in range(300):
        n = random.randint(0, 40)
        toks, level = [], 0
        for _ in range(n):     # balanced-prefix sequences (no close below the root)
            t = random.choice(["(", "{", "[", ")", "a", "b", ";"])
            if t in K.CLOSE_BRACKETS and level == 0:
                t = "a"
            level += (t in K.OPEN_BRACKETS) - (t in K.CLOSE_BRACKETS)
            toks.append(t)
        assert list(TR.triangle_of(toks)) == explicit_tree_distances(toks)


def test_triangle_udf_and_lookup(spark):
    df = spark.createDataFrame([(1, ["(", "a", ")", "(", "b", ")"]), (2, ["x"])], "doc_id long, tokens array<string>")
    out = TR.with_triangles(df).select("doc_id", "dist").orderBy("doc_id").collect()
    assert out[1]["dist"] == []
    d = out[0]["dist"]
    assert len(d) == 15 and d[TR_index(6, 1, 4)] == 4
    r = spark.createDataFrame([(d,)], "dist array<int>").select(
        TR.triangle_lookup(F.col("dist"), F.lit(1), F.lit(4)).alias("a"),
        TR.triangle_lookup(F.col("dist"), F.lit(4), F.lit(1)).alias("b"),
        TR.triangle_lookup(F.col("dist"), F.lit(2), F.lit(2)).alias("c"),
        TR.tokens_from_triangle(F.size("dist")).alias("n")).collect()[0]
    assert (r["a"], r["b"], r["c"], r["n"]) == (1004, 996, 0, 6)


def TR_index(n, i, j):
    return i * (2 * n - i - 1) // 2 + (j - i - 1)


def test_lookup_without_triangle(spark):
    """Every pair of random rows, and a row of 500,000 tokens against the levels between."""
    rng = random.Random(8)
    rows = [(i, [rng.choice("(){}[]xy") for _ in range(rng.randint(1, 24))]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, tokens array<string>")
    pairs = F.expr("explode(flatten(transform(sequence(0, size(tokens) - 1), a -> transform(sequence(0, size(tokens) - 1), b -> struct(a as i, b as j)))))")
    both = TR.with_triangles(TR.with_range_minima(df)).select("*", pairs.alias("p"))
    i, j = F.col("p.i"), F.col("p.j")
    got = both.select(TR.distance_lookup(F.col("depth"), F.col("minima"), i, j).alias("a"), F.when(i == j, 0).otherwise(TR.triangle_lookup(F.col("dist"), i, j)).alias("b"))
    assert got.where("a is null or a <> b").isEmpty() and got.count() == sum(len(t) ** 2 for _, t in rows)

    n = 500_000
    tokens = rng.choices(["(", ")", "x"], weights=[2, 2, 3], k=n)
    long = TR.with_range_minima(spark.createDataFrame([(1, " ".join(tokens))], "doc_id int, t string").select("doc_id", F.split("t", " ").alias("tokens")))
    at = [(0, n - 1), (7, 8), (123_456, 345_678), (499_999, 3), (250_000, 250_063)]
    got = long.select(*[TR.distance_lookup(F.col("depth"), F.col("minima"), F.lit(a), F.lit(b)).alias(f"v{k}") for k, (a, b) in enumerate(at)]).first()
    h, d = TR._levels(tokens)
    for v, (a, b) in zip(got, at):
        lo, hi = min(a, b), max(a, b)
        assert v == (1 if a < b else -1) * int(d[lo] + d[hi] - 2 * h[lo:hi].min()) + 1000
    assert TR.with_range_minima(spark.createDataFrame([(1, None), (2, [])], "doc_id int, tokens array<string>")).selectExpr("size(depth)", "size(minima)").collect() == [(0, 0), (0, 0)]


def test_cycles_raise(spark):
    for links in ([(1, 2), (2, 1)], [(1, 1)], [(i, i % 7 + 1) for i in range(1, 8)] + [(i, i - 1) for i in range(8, 60)]):
        with pytest.raises(ValueError):
            TR.ancestor_closure(spark.createDataFrame(links, "node_id int, parent_id int"))


def test_closure_lca(spark):
    nodes = spark.createDataFrame([("root", None), ("a", "root"), ("b", "root"), ("a1", "a"), ("a2", "a"),
                                   ("x", None)], "node_id string, parent_id string")
    clo = TR.ancestor_closure(nodes)
    pairs = spark.createDataFrame([("a1", "a2"), ("a1", "b"), ("a1", "x")], "a string, b string")
    got = {(r["a"], r["b"]): (r["lca"], r["tree_dist"]) for r in TR.pair_lca(pairs, clo).collect()}
    assert got == {("a1", "a2"): ("a", 2), ("a1", "b"): ("root", 3), ("a1", "x"): (None, -1)}
    sets = spark.createDataFrame([(1, "a1"), (1, "a2"), (2, "a1"), (2, "b"), (3, "a1"), (3, "x")],
                                 "set_id int, node_id string")
    lca = {r["set_id"]: r["lca"] for r in TR.set_lca(sets, clo).collect()}
    assert lca == {1: "a", 2: "root", 3: None}


def test_framing_masks_shift_and_splits(spark):
    df = spark.createDataFrame([([7, 8],), ([5, 6, 7, 8, 9],)], "ids array<long>")
    r = df.select(EN.frame_and_pad(F.col("ids"), 4).alias("e")).collect()
    assert r[0]["e"] == [2, 7, 8, 0, 0, 3]
    assert r[1]["e"] == [2, 5, 6, 7, 8, 9, 3]          # no truncation, no padding
    e = df.select(EN.frame_and_pad(F.col("ids"), 4).alias("e"))
    s = e.select(EN.shift_right(F.col("e")).alias("d"), EN.pad_mask(F.col("e")).alias("m")).collect()[0]
    assert s["d"] == [2, 2, 7, 8, 0, 0] and s["m"] == [1, 1, 1, 0, 0, 1]
    assert EN.split_bounds(100) == (89, 95)              # double arithmetic, as the reference
    b = spark.createDataFrame([(0,), (1,), (4,)], "n int").select(EN.baseline_distances(F.col("n")).alias("b")).collect()
    assert [x["b"] for x in b] == [[], [], [1, 2, 3, 1, 2, 1]]
    assert np.array_equal(TR.triangle_of([]), np.zeros(0))


def test_samples_hold_real_distances(spark):
    """The four distance vectors of every pair against the DuckDB statement, over the whole table."""
    import __spark_entry__ as E
    from conftest import SF001
    from oracle import compare, duck
    name = "encode_pair_distances"
    info = compare(spark, duck(SF001), name, E.queries()[name], E.oracle_sql()[name], SF001)
    assert info["match"] and info["spark_rows"] > 0, info
    assert all(r.c_encoder_dist_n > 0 and r.cpp_decoder_dist_n > 0 for r in E.queries()[name](spark, SF001).collect())


def test_pairs_are_made_before_ids_and_triangles(spark):
    """No exchange carries a triangle, and rows without a partner get none."""
    from codeprep.plans import queries as Q
    from conftest import SF001
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for q in (Q.encode_pair_distances, Q.encode_pairs):
            plan = q(spark, SF001)._jdf.queryExecution().executedPlan().toString()
            assert 0 < plan.rindex("MapInArrow") < plan.index("Exchange")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    df = spark.createDataFrame([(["(", "a", ")"], None), (["x"], ["a", "b"])], "a array<string>, b array<string>")
    got = TR.with_triangles(df, ("a", "b"), ("da", "db")).select("da", "db").collect()
    assert [tuple(r) for r in got] == [([2, 2, 2], []), ([], [2])]
