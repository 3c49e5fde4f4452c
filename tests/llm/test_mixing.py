"""Operator 13 against a walk through the documents in whole numbers."""

import re
from collections import Counter
from fractions import Fraction
from hashlib import md5

import pytest

from codeprep.llm import mixing, queries
from tests.llm import cases

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares_of(sizes, weights=(5, 2, 1), percent=150, most=2):
    """Targets by taking out one full source after another."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left = {}, set(names)
    while left:
        words = Fraction(percent * sum(sizes.values()), 100) - sum(target.values())
        unit = words / sum(weight[s] for s in left)
        full = [s for s in left if weight[s] * unit > most * sizes[s]]
        if not full:
            return target | {s: weight[s] * unit for s in left}
        for s in full:
            target[s] = Fraction(most * sizes[s])
            left.remove(s)
    return target


def plan_of(rows, seed=0, **options):
    """(doc_id, size, copies) of each row, by adding up expected copies in order of size."""
    size = {}
    for d, t, s in rows:
        size.setdefault(s, []).append((len(WORD.findall(t or "")), d if d is not None else -1))
    sums = {s: sum(n for n, _ in v) for s, v in size.items()}
    target = shares_of(sums, **options)
    out = []
    for s, docs in size.items():
        step = int(target[s] / sums[s] * 2 ** 24) if sums[s] else 0
        tag = "t" if s is None else "s" + s
        at = int(md5(f"{seed}:{tag}".encode()).hexdigest()[:6], 16)
        for n, d in sorted(docs):
            out.append((d, n, (at + step) // 2 ** 24 - at // 2 ** 24))
            at += step
    return out, sums, target


def test_mixing(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, sums, target = plan_of(rows)
    source = {d: s for d, _, s in rows}
    got = queries.op13_mixing(spark, SF).collect()
    assert Counter((r.doc_id, r.size, r.copies) for r in got) == Counter(want)
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r.source_size, r.taken) == (sums[s], r.copies * r.size) and r.taken <= 2 * r.size
        assert r.target == pytest.approx(float(target[s]), rel=1e-12)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in target)
    again = queries.op13_mixing(spark, SF).collect()
    assert Counter(again) == Counter(got)


def test_mixing_edges(spark):
    df = cases.table(spark)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    got = mixing.plan(df).collect()
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.size, r.copies) for r in got) == Counter(plan_of(rows)[0])
    assert all(r.target <= 2 * r.source_size for r in got)
    assert mixing.plan(cases.empty(spark)).count() == 0
    assert mixing.plan(df.select("doc_id", "source").selectExpr("*", "cast(null as string) text")).agg({"taken": "sum"}).first()[0] == 0


def test_hot_source_and_partitions(spark):
    """One source with most rows, equal sizes, repeated ids: the same copies whatever the partitions."""
    rows = [(i % 400, "w " * (1 + i % 3), "hot" if i % 5 else f"cold{i % 15}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = Counter(plan_of(rows)[0])
    for parts in (1, 7):
        assert Counter((r.doc_id, r.size, r.copies) for r in mixing.plan(df.repartition(parts)).collect()) == want
    with pytest.raises(ValueError):
        mixing.plan(df, percent=300)


def test_mixed_rows(spark):
    df = cases.table(spark)
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert out.count() == mixing.plan(df).agg({"copies": "sum"}).first()[0]
    assert mixing.mix(df, weights=(1,), percent=200).count() == 2 * df.count() - 2 * sum(
        1 for r in plan_of([(r.doc_id, r.text, r.source) for r in df.collect()], weights=(1,), percent=200)[0] if not r[2])
