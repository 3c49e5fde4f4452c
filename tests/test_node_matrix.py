import random

import numpy as np
import pyarrow as pa
import pytest

from codeprep.operators import node_matrix as M

NODES, TOKENS = "doc_id bigint, node_id string, parent_id string", "doc_id bigint, pos int, node_id string"


def path(node, parents):
    out = [node]
    while parents.get(out[-1]) is not None:
        out.append(parents[out[-1]])
    return out


def walked(parents, tokens):
    """The matrix by walking up from both nodes of each pair."""
    known = set(parents) | {p for p in parents.values() if p is not None}

    def dist(a, b):
        if a not in known or b not in known:
            return -1
        pa, pb = path(a, parents), path(b, parents)
        return next((i + pb.index(x) for i, x in enumerate(pa) if x in pb), -1)
    return [[dist(a, b) for b in tokens] for a in tokens]


def forest(rng, n):
    names = [f"n{i}" for i in rng.sample(range(10 * n + 10), n)]
    return {x: rng.choice(names[:i]) if i and rng.random() < 0.93 else rng.choice([None, None, "outside"]) for i, x in enumerate(names)}


def table(spark, docs):
    """docs: (doc_id, parents, tokens), rows in random order."""
    nodes = [(d, x, p) for d, parents, _ in docs for x, p in parents.items()]
    tokens = [(d, i, t) for d, _, ts in docs for i, t in enumerate(ts)]
    random.Random(3).shuffle(nodes)
    random.Random(4).shuffle(tokens)
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(tokens, TOKENS)


def matrices(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.i)):
        assert r.i == len(out.setdefault(r.doc_id, []))
        out[r.doc_id].append(list(r.dist))
    return out


def test_matrix_is_that_of_walking_up(spark):
    """Random forests; tokens share nodes, sit on inner nodes, have none or an
    unknown one; documents use the same node names."""
    rng, docs = random.Random(11), []
    for d in range(40):
        parents = forest(rng, rng.randrange(1, 30))
        docs.append((d, parents, [rng.choice([*parents, *parents, None, "outside", "unknown"]) for _ in range(rng.randrange(1, 25))]))
    docs.append((99, {}, ["a", None, "a"]))  # no node table
    got = matrices(M.distance_matrix(*table(spark, docs)))
    assert got == {d: walked(p, t) for d, p, t in docs}


def test_numeric_nodes_with_null_parents(spark):
    nodes = spark.createDataFrame([(1, 5, None), (1, 6, 5), (1, 7, 5), (1, None, 5), (None, 5, 5)], "doc_id bigint, node_id bigint, parent_id bigint")
    tokens = spark.createDataFrame([(1, 0, 6), (1, 1, None), (1, 2, 7), (1, 3, 6), (None, 0, 6)], "doc_id bigint, pos int, node_id bigint")
    assert matrices(M.distance_matrix(nodes, tokens)) == {1: [[0, -1, 2, 0], [-1] * 4, [2, -1, 0, 2], [0, -1, 2, 0]]}


def test_numbers_beyond_a_double(spark):
    big = 2**53
    nodes = spark.createDataFrame([(1, big, None), (1, big + 1, big), (1, big + 2, big + 1)], "doc_id bigint, node_id bigint, parent_id bigint")
    tokens = spark.createDataFrame([(1, 0, big), (1, 1, big + 1), (1, 2, big + 2), (1, 3, None)], "doc_id bigint, pos int, node_id bigint")
    assert matrices(M.distance_matrix(nodes, tokens)) == {1: [[0, 1, 2, -1], [1, 0, 1, -1], [2, 1, 0, -1], [-1] * 4]}


def test_deep_chain_and_wide_tree_in_blocks(spark, monkeypatch):
    up = np.r_[-1, np.arange(20_000)]
    depth, entry = M.depths_and_entries(up)
    assert (depth == np.arange(20_001)).all() and (entry == depth).all()
    star = {f"c{i}": "r" for i in range(3000)}
    chain = {f"c{i}": f"c{i - 1}" if i else None for i in range(3000)}
    rng = random.Random(5)
    for parents, far in ((star, lambda a, b: 2 * (a != b)), (chain, lambda a, b: abs(a - b))):
        at = [rng.randrange(3000) for _ in range(2000)]
        tree = M.compressed_tree(*M.numbered(pa.array(list(parents)), pa.array(list(parents.values())), pa.array([f"c{i}" for i in at])))
        rows = np.concatenate([M.distance_rows(*tree, k, min(2000, k + 700)) for k in range(0, 2000, 700)])
        assert all(rows[i, j] == far(at[i], at[j]) for i, j in ((rng.randrange(2000), rng.randrange(2000)) for _ in range(5000)))
        assert (rows == rows.T).all() and not rows.diagonal().any()


@pytest.mark.parametrize("rows, says", [([("a", "b"), ("b", "a")], "cycle"), ([("a", "a")], "cycle"), ([("a", "b"), ("a", "c")], "two parents"),
                                        ([("a", "b"), ("a", None)], "two parents"), ([("a", None), ("a", "b")], "two parents")])
def test_what_is_no_tree_raises(rows, says):
    nodes, parents = (pa.array(x, pa.string()) for x in zip(*rows))
    with pytest.raises(ValueError, match=says):
        M.compressed_tree(*M.numbered(nodes, parents, pa.array(["a", "b"])))


def test_repeated_rows_and_empty_tables(spark):
    nodes, tokens = table(spark, [(1, {"a": None, "b": "a"}, ["b", "a"])])
    assert matrices(M.distance_matrix(nodes.unionByName(nodes), tokens)) == {1: [[0, 1], [1, 0]]}
    assert M.distance_matrix(nodes.limit(0), tokens).count() == 2
    assert M.distance_matrix(nodes, tokens.limit(0)).count() == 0
