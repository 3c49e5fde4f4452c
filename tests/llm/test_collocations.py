"""Operator 11 against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np

from codeprep.llm import collocations, queries
from tests.llm import cases

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_of(rows, least, percent=100, top=2000):
    f, n = {}, Counter()
    for t, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + m])] += 1
    out = []
    for lang, own in f.items():
        c = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        gone = {q for p, a in c.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= percent * own[q := p[i:i + m]]}
        ranked = []
        for p, a in c.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def test_collocations_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, queries.op11_collocations(spark, SF).collect()))
    assert got == phrases_of([(r.text, r.lang) for r in df.collect()], 100)


def test_small_chunks_and_parts(spark):
    """Many chunks, many limits between parts, ties at the end of the list."""
    rng = random.Random(1)
    names = [f"w{i}" for i in range(25)] + ["the"] * 20
    rows = [(i, " ".join(rng.choice(names) + rng.choice(["", "", "", ".", "\t", "\n"]) for _ in range(rng.randint(0, 80))), rng.choice(["en", "de", None])) for i in range(400)]
    rows += [(900 + i, "one Passage that EVERY document holds, and again one passage that", "en") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    want = phrases_of([r[1:] for r in rows], 12, top=60)
    for part_rows, chunk_words in ((50, 1000), (10 ** 6, 10 ** 6)):
        got = collocations.collocations(df, least=12, top=60, chunk_words=chunk_words, part_rows=part_rows)
        assert sorted(map(tuple, got.collect())) == want


def test_collocation_edges(spark):
    df = cases.table(spark)
    got = sorted(map(tuple, collocations.collocations(df, least=2).collect()))
    assert got == phrases_of([(r.text, r.lang) for r in df.collect()], 2)
    got = sorted(map(tuple, collocations.collocations(df, least=3, percent=60).collect()))
    assert got == phrases_of([(r.text, r.lang) for r in df.collect()], 3, percent=60)
    assert collocations.collocations(cases.empty(spark)).count() == 0
    assert collocations.collocations(df.where("text is null"), least=1).count() == 0


def test_slabs_keep_the_text(monkeypatch):
    monkeypatch.setattr(collocations, "SLAB", 7)
    for t in ("", "ab cd", "ab cd. " * 9, "x" * 50 + " y", "É ü " * 12 + "\n\n a,b"):
        whole = b"".join(collocations.slabs(t))
        assert whole == t.encode().translate(collocations._BYTES) + b"\n"


def test_quicksort_counts():
    rng = np.random.default_rng(5)
    for _ in range(20):
        rows, counts = collocations.suffix_rows(rng.integers(0, 6, rng.integers(2, 400)), 4)
        got = {(tuple(rows[:d, p].tolist()), int(f)) for ps, fs, d in collocations.quicksort_counts(rows, counts, 3) for p, f in zip(ps, fs)}
        f = Counter()
        for row, n in zip(rows.T.tolist(), counts.tolist()):
            for d in range(2, 5):
                if row[d - 1]:
                    f[tuple(row[:d])] += n
        assert got == {(p, n) for p, n in f.items() if n >= 3}


def test_exact_scores(spark):
    """Products past 64 bits; ties of the floor go to the first cut."""
    phrases = spark.createDataFrame([([1, 2, 3], 10 ** 12), ([1, 2], 3 * 10 ** 12), ([2, 3], 10 ** 12 + 1)], "p array<bigint>, a bigint")
    words = spark.createDataFrame([(i, "en", f"w{i}", 4 * 10 ** 12) for i in (1, 2, 3)], "id bigint, lang string, word string, f bigint")
    sizes = spark.createDataFrame([("en", 10 ** 15 + 7)], "lang string, n bigint")
    got = {tuple(r.p): (r.l, r.r, r.score) for r in collocations.scored(phrases, words, sizes, 100).collect()}
    n, a, w = 10 ** 15 + 7, 10 ** 12, 4 * 10 ** 12
    assert got[1, 2, 3] == (3 * a, w, 1000 * a * n // (3 * a * w))
    assert got[1, 2] == (w, w, 1000 * 3 * a * n // (w * w))
