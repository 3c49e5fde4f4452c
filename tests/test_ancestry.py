"""Lowest common ancestors by jumps: against walking up, on random forests, a deep chain, a wide tree and cycles."""

import random

import pytest

from codeprep.operators import ancestry as AN
from codeprep.operators import tree as TR


def path(parent, node):
    out = []
    while node is not None:
        out.append(node)
        node = parent.get(node)
    return out


def slow_lca(parent, nodes):
    if any(n not in parent for n in nodes):
        return None
    paths = [path(parent, n) for n in nodes]
    for n in paths[0]:
        if all(n in p for p in paths):
            return n
    return None


def node_table(spark, parent):
    return spark.createDataFrame([(n, p) for n, p in parent.items()], "node_id long, parent_id long")


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_sets_of_random_forests(spark, seed):
    r = random.Random(seed)
    names = r.sample(range(1000), 120)
    parent = {n: (None if i < 2 else names[r.randrange(max(0, i - 6), i)]) for i, n in enumerate(names)}
    index = AN.ancestor_index(node_table(spark, parent))
    assert {x["node_id"]: x["depth"] for x in index.depths.collect()} == {n: len(path(parent, n)) - 1 for n in names}
    pairs = [(r.choice(names), r.choice(names)) for _ in range(300)] + [(names[3], names[3]), (names[0], 5000), (None, names[1])]
    pairs += pairs[:5]                                                   # repeated rows stay
    want = sorted(map(repr, ((a, b, l, -1 if l is None else path(parent, a).index(l) + path(parent, b).index(l))
                             for a, b in pairs for l in [slow_lca(parent, [a, b])])))
    got = AN.pair_ancestors(spark.createDataFrame(pairs, "a long, b long"), index)
    assert sorted(repr(tuple(x)) for x in got.collect()) == want
    sets = {i: [r.choice(names) for _ in range(r.randint(1, 5))] for i in range(80)} | {80: [names[4], 7777], 81: [None]}
    rows = [(i, n) for i, ms in sets.items() for n in ms] * 2 + [(None, names[7])]   # a row without a set
    got = AN.set_ancestors(spark.createDataFrame(rows, "set_id long, node_id long"), index)
    assert {x["set_id"]: x["lca"] for x in got.collect()} == {i: slow_lca(parent, ms) for i, ms in sets.items()}
    assert got.count() == len(sets)


def test_a_deep_chain_and_a_wide_tree(spark):
    n = 15_000
    chain = spark.range(n).selectExpr("id as node_id", "case when id > 0 then id - 1 end as parent_id")
    index = AN.ancestor_index(chain)
    assert len(index.levels) == 14 and sum(x.count() for x in index.levels) < 14 * n
    pairs = spark.createDataFrame([(n - 1, 0), (7, 12_345), (5, 5)], "a long, b long")
    assert {tuple(x) for x in AN.pair_ancestors(pairs, index).collect()} == {(n - 1, 0, 0, n - 1), (7, 12_345, 7, 12_338), (5, 5, 5, 0)}
    wide = spark.range(20_000).selectExpr("id as node_id", "case when id > 0 then 0 end as parent_id")
    index = AN.ancestor_index(wide)
    assert len(index.levels) == 1 and index.depths.filter("depth = 1").count() == 19_999
    pairs = spark.range(1, 20_000).selectExpr("id as a", "20000 - id as b")
    assert AN.pair_ancestors(pairs, index).filter("a <> b and (lca <> 0 or tree_dist <> 2)").isEmpty()


def test_cycles_raise_and_empty_tables_do_not(spark):
    for links in ([(1, 2), (2, 1)], [(1, 1)], [(i, i % 7 + 1) for i in range(1, 8)] + [(i, i - 1) for i in range(8, 60)]):
        with pytest.raises(ValueError):
            AN.ancestor_index(spark.createDataFrame(links, "node_id long, parent_id long"))
    index = AN.ancestor_index(spark.createDataFrame([], "node_id long, parent_id long"))
    assert AN.pair_ancestors(spark.createDataFrame([(1, 2)], "a long, b long"), index).collect() == [(1, 2, None, -1)]
    assert AN.set_ancestors(spark.createDataFrame([(1, 2)], "set_id long, node_id long"), index).collect() == [(1, None)]
    orphan = AN.ancestor_index(spark.createDataFrame([(1, 9), (2, 9)], "node_id long, parent_id long"))   # 9 has no row
    assert AN.pair_ancestors(spark.createDataFrame([(1, 2)], "a long, b long"), orphan).collect() == [(1, 2, 9, 2)]


def test_same_as_the_closure(spark):
    parent = {i: (i - 1) // 3 if i else None for i in range(200)}
    nodes = node_table(spark, parent)
    pairs = spark.createDataFrame([(i, (i * 37) % 200) for i in range(200)], "a long, b long")
    by_jumps = AN.pair_ancestors(pairs, AN.ancestor_index(nodes)).collect()
    assert sorted(map(tuple, by_jumps)) == sorted(map(tuple, TR.pair_lca(pairs, TR.ancestor_closure(nodes)).collect()))
