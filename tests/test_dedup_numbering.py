import random

from pyspark.sql import functions as F

from codeprep.operators import dedup as D
from codeprep.operators.numbering import consecutive_index
from codeprep.plans import fixtures as X
from conftest import SF001, SF01


def sequential_dedup(rows):
    seen_c, seen_p, kept = set(), set(), []
    for r, c, p in sorted(rows):
        if (c is None or c not in seen_c) and (p is None or p not in seen_p):
            kept.append(r)
            if c is not None:
                seen_c.add(c)
            if p is not None:
                seen_p.add(p)
    return kept


def test_pair_dedup_matches_sequential(spark):
    rows = X.pair_keys(spark, SF01).select(F.col("doc_id").alias("rank"), "c_key", "cpp_key")
    local = [tuple(r) for r in rows.collect()]
    got = sorted(r["rank"] for r in D.greedy_pair_dedup(rows).collect())
    assert got == sequential_dedup(local)


def test_pair_dedup_random_and_hot_key(spark):
    random.seed(3)
    for trial in range(3):
        rows = []
        for i in range(300):
            kind = random.choice(["pair", "c", "cpp"])
            c = random.randint(0, 12) if kind != "cpp" else None
            p = random.randint(0, 12) if kind != "c" else None
            if i % 3 == 0:            # a hot key shared by a third of the rows
                c = 0 if c is not None else None
            rows.append((i, c, p))
        df = spark.createDataFrame(rows, "rank long, c_key long, cpp_key long")
        got = sorted(r["rank"] for r in D.greedy_pair_dedup(df).collect())
        assert got == sequential_dedup(rows)


def test_first_per_key_and_multiplicity(spark):
    df = spark.createDataFrame([(5, "a"), (1, "a"), (3, "b"), (2, "a")], "id long, k string")
    assert sorted(tuple(r) for r in D.first_per_key(df, "k", "id").collect()) == [(1, "a"), (3, "b")]
    assert sorted(tuple(r) for r in D.multiplicity(df, "k").collect()) == [(1, 1), (3, 1)]


def test_consecutive_index_matches_row_number(spark):
    df = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    got = consecutive_index(df, [F.col("l_orderkey"), F.col("l_linenumber")], out_col="i", num_partitions=5)
    rows = sorted((r["l_orderkey"], r["l_linenumber"], r["i"]) for r in got.collect())
    assert [r[2] for r in rows] == list(range(len(rows)))


def test_seeded_sample_is_deterministic(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id")
    a = sorted(r[0] for r in D.seeded_sample(df, 10, "doc_id", seed=1).collect())
    b = sorted(r[0] for r in D.seeded_sample(df.repartition(3), 10, "doc_id", seed=1).collect())
    assert a == b and len(set(a)) == 10


def test_consecutive_index_per_group(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    got = consecutive_index(df, [F.col("doc_id")], out_col="i", group_cols=["lang"], num_partitions=7)
    by_lang = {}
    for r in sorted(got.collect(), key=lambda r: (r["lang"], r["doc_id"])):
        by_lang.setdefault(r["lang"], []).append(r["i"])
    assert all(v == list(range(len(v))) for v in by_lang.values()) and len(by_lang) == 4


def test_long_key_chain_finishes(spark):
    """Rows that share alternate keys: one row a round is kept, whatever their number."""
    rows = [(i, f"c{(i + 1) // 2}", f"p{i // 2}") for i in range(30)] + [(100 + i, None, f"q{i % 3}") for i in range(50)] + [(200, None, None)]
    df = spark.createDataFrame(rows, "rank long, c_key string, cpp_key string")
    kept, seen_c, seen_p = [], set(), set()
    for r, c, p in sorted(rows):
        if c not in seen_c and p not in seen_p:
            kept.append(r)
            seen_c |= {c} - {None}
            seen_p |= {p} - {None}
    assert sorted(x["rank"] for x in D.greedy_pair_dedup(df).collect()) == kept


def test_closure_of_a_deep_chain_and_a_cycle(spark):
    from codeprep.operators import tree as TR
    n = 300
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "node_id long, parent_id long")
    clo = TR.ancestor_closure(chain)
    assert clo.count() == n * (n + 1) // 2 and clo.where("node_id - anc_id <> dist").count() == 0
    ring = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "node_id long, parent_id long")
    try:
        TR.ancestor_closure(ring)
        raise AssertionError("a cycle must raise")
    except ValueError:
        pass


def test_first_rows_is_exact_for_any_n(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}", (i * 37) % 101) for i in range(101)], "id long, g string, v long")
    got = sorted(r["v"] for r in D.first_rows(df, 60, ["v"], "id").collect())
    assert got == list(range(60))
    per = D.row_cap(df, 5, ["g"], ["v"], "id").groupBy("g").count().collect()
    assert {r["count"] for r in per} == {5}
