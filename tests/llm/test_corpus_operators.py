"""Operators 4, 5, 7 and 9 and the pipeline against brute force."""

import math
import re
from hashlib import sha256

import corpus_pipeline
from codeprep.llm import licenses, minhash, quality, queries, repeats, simhash
from codeprep.llm.components import components
from codeprep.llm.secrets import redact, spans
from tests.llm import cases
from tests.llm.test_text_operators import base_counts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def groups_of(sets, percent=85):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in sets}


def test_near_duplicates(spark):
    rows = cases.texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    sets = sets_of(rows)
    want = groups_of(sets)
    for r in queries.op4_minhash(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicate_edges(spark):
    df = cases.table(spark)
    got = cases.by_id(minhash.near_duplicates(df))
    assert sum(map(len, got.values())) == df.count()
    sets = sets_of(cases.texts_of(df))
    want = groups_of(sets)
    for d, own in got.items():
        if d is not None:
            assert all((r.n_shingles, r.component_id) == (len(sets[d]), want[d]) for r in own)
    assert {(r.component_id, r.kept) for r in got[None]} == {(1, False), (None, True)}
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0


def test_buckets_of_several_components_lose_no_link(spark):
    """Families around one text: no member is like the smallest, but some are like each other."""
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for k in range(1, 7):
        far = base[:]
        far[10 * k:10 * k + 4] = [f"x{k}{j}" for j in range(4)]  # about 0.84 from the base
        rows.append((10 * k, " ".join(far)))
        rows.append((10 * k + 1, " ".join(far[:99] + [f"y{k}"])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = sets_of(rows)
    want = groups_of(sets)
    assert len(set(want.values())) > 3
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == want


def test_links_between_080_and_085(spark):
    """The pipeline's stage groups at 0.80, the query's contract at 0.85."""
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    far = base[:]
    far[50] = far[51] = far[52] = far[53] = far[54] = far[55] = "x"  # 10 shingles differ: 90 of 110
    rows = [(1, " ".join(base)), (2, " ".join(far))]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sets = sets_of(rows)
    assert 80 <= 100 * len(sets[1] & sets[2]) / len(sets[1] | sets[2]) < 85
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {1, 2}
    assert [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, SF).collect()] == [1]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 102), (102, 101), (7, 7)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(links, "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}


def repeats_of(rows, length=50):
    texts = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            least[w] = min(d, least.get(w, d))
    out = {}
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i:i + length]] < d:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_repeats(spark):
    want = repeats_of(cases.texts_of(spark.read.parquet(f"{SF}/documents.parquet")))
    got = queries.op9_repeats(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        n, gone, runs, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, runs, sha256(kept).hexdigest())


def test_repeat_edges(spark):
    df = cases.table(spark)
    extra = [(200, "a" * 400), (201, "b" * 30 + "a" * 120), (202, "é" * 60), (203, "x" + "é" * 40), (204, ("ab" * 40) + "é" * 30), (205, "ab" * 26)]
    df = df.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    want = repeats_of(cases.texts_of(df))
    got = repeats.remove_repeats(df).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            assert (r.n_removed, r.n_spans) == (0, 0)
        else:
            n, gone, runs, kept = want[r.doc_id]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept) == (n, gone, runs, kept.decode(errors="ignore"))
    assert repeats.remove_repeats(cases.empty(spark), carry=("lang", "n_chars")).count() == 0


def test_edit_report(spark):
    rows = dict(cases.texts_of(spark.read.parquet(f"{SF}/documents.parquet")))
    got = queries.op7_simhash(spark, SF).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    ids = sorted(rows, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    like = lambda a, b: round(max(0.0, math.cos(math.pi * (a ^ b).bit_count() / 64)), 6)
    assert len(got) == len(rows)
    for r in got:
        t = rows[r.doc_id] or ""
        third = len(t) // 3
        edited = t[:len(t) - third] + (rows[after[r.doc_id]] or "")[:third]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha256(edited.encode()).hexdigest())
        assert r.near_edited == like(prints[r.doc_id], int(r.edited_fingerprint, 16))
        assert r.near_next == like(prints[r.doc_id], prints[after[r.doc_id]])
        if r.doc_id % 20 == 0 and t.split():
            assert r.n_within == sum((prints[r.doc_id] ^ p).bit_count() <= 3 for p in prints.values()) - 1


def test_fingerprint_votes(spark):
    """Against votes counted one by one, on the same term hashes."""
    df = spark.createDataFrame([(1, "one two  two\tthree"), (2, ""), (3, "x"), (4, None)], "id bigint, text string")
    got = {r.id: (r.votes, r.fingerprint) for r in simhash.fingerprints(df, ["id"]).collect()}
    h = lambda e: spark.sql(f"select xxhash64({e}) h").first().h
    words = [h(f"'{w}'") for w in ("one", "two", "two", "three")]
    terms = [(w, 1) for w in words] + [(h(f"{a}L, {b}L"), 2) for a, b in zip(words, words[1:])]
    bits = [sum(w if t >> i & 1 else -w for t, w in terms) > 0 for i in range(64)]
    value = sum(1 << i for i, b in enumerate(bits) if b)
    assert got[1] == (10, value - (1 << 64) if value >> 63 else value)
    assert got[2] == got[4] == (0, 0)
    assert got[3] == (1, h("'x'"))


def test_tables_find_all_within_the_radius(spark):
    import random
    rng = random.Random(2)
    values = []
    for _ in range(60):
        v = rng.getrandbits(64)
        for flips in (0, 1, 2, 3, 3, 4, 5):
            x = v
            for i in rng.sample(range(64), flips):
                x ^= 1 << i
            values.append(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    got = {r.fingerprint: r.n for r in simhash.count_within(df, df).collect()}
    for v, s in zip(values, signed):
        assert got[s] == sum((v ^ w).bit_count() <= 3 for w in values)


def test_simhash_edges(spark):
    df = cases.table(spark)
    got = cases.by_id(simhash.edit_report(df))
    assert set(got) == {r[0] for r in cases.rows() if r[0] is not None}
    assert all(len(v) == 1 for v in got.values())
    assert got[1][0].fingerprint == got[2][0].fingerprint and got[4][0].fingerprint == "0" * 16
    assert simhash.edit_report(cases.empty(spark)).count() == 0


def licences_of(text):
    text = re.sub(r"[^\w\n]+|_+", " ", (text or "").lower())
    segments = {*text.split("\n"), *(p.replace("\n", " ") for p in re.split(r"\n ?\n[ \n]*", text)), text.replace("\n", " ")}
    found = []
    for s in segments:
        b = licenses.bigrams(s)
        for name, template in licenses.TEMPLATES:
            m = licenses.bigrams(template)
            dice = round(2 * len(b & m) / (len(b) + len(m)), 6)
            if dice >= licenses.THRESHOLD:
                found.append((-dice, name))
    return (min(found)[1], -min(found)[0]) if found else (None, 0.0), ",".join(sorted({n for _, n in found}))


def test_licences(spark):
    rows = dict(cases.texts_of(spark.read.parquet(f"{SF}/documents.parquet")))
    rows |= {10_001: licenses._MIT, 10_002: "Copyright 2020 X\n\n" + licenses._MIT.replace("persons", "people"), 10_003: "the licence",
             10_004: "intro\nReleased under the terms of the MIT License.\nend", 10_005: None, 10_006: ""}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert ((r.licence, r.dice), r.licences) == licences_of(rows[r.doc_id])
    assert {r.doc_id: r.licence for r in got}[10_002] == "MIT"
    assert licenses.scan(cases.empty(spark)).count() == 0
    assert licenses.scan(cases.table(spark)).where("doc_id = 11 and licence = 'Apache-2.0'").count() == 1


def test_licences_inside_other_text(spark):
    """Notices of several paragraphs in a long document, and after other words of their line."""
    fill = lambda k: cases.prose(900 + k, 300)
    long = {k: next(t for n, t in licenses.TEMPLATES if n == k and len(t) > 200) for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0")}
    want = {i: name for i, name in enumerate(long)} | {20: "MIT", 21: None}
    rows = [(i, f"{fill(i)}\n\n{long[name]}\n\n{fill(50 + i)}") for i, name in list(want.items())[:5]]
    rows += [(20, "This small tool is licensed under the MIT License."), (21, fill(3)),
             (22, f"Licensed under the Apache License, Version 2.0.\n{fill(7)}\n\n{long['MIT']}\n\n{fill(8)}"),
             (23, f"This work is licensed under the GNU Lesser General Public License, version 3.\n{fill(9)}")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {d: got[d].licence for d in want} == want
    assert all(got[d].dice == 1.0 for d, name in want.items() if name)
    assert got[22].licences == "Apache-2.0,MIT"
    # no part of a line that matches is held against further templates
    assert got[23].licences == licences_of(rows[-1][1])[1]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    held = lambda df: {r.doc_id: r for r in df.collect()}
    before = held(docs)
    first = stages["quality_rules"](spark, docs, SF)
    assert first.columns == corpus_pipeline.COLUMNS
    for d in held(first):
        n, _, _, _, again = base_counts(before[d].text)
        assert n >= 50 and 100 * again <= 50 * n
    second = stages["minhash_near_dedup"](spark, first, SF)
    want = groups_of(sets_of(cases.texts_of(first)), 80)
    assert set(held(second)) == set(want.values())
    third = stages["suffix_array_dedup"](spark, second, SF)
    kept = {d: v[3].decode(errors="ignore") for d, v in repeats_of(cases.texts_of(second)).items()}
    assert {d: (r.text, r.n_chars) for d, r in held(third).items()} == {d: (t, len(t)) for d, t in kept.items()}
    fourth = stages["secret_scans"](spark, third, SF)
    assert {d: r.text for d, r in held(fourth).items()} == {d: redact(t, spans(t)[1]) for d, t in kept.items()}
    last = stages["packing"](spark, fourth, SF).collect()
    assert {r.doc_id for r in last} == set(kept)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) \
        == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in last)


def test_pipeline_edges(spark):
    for df in (cases.table(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            if name == "quality_rules":
                labels = spark.read.parquet(f"{SF}/labels.parquet")
                labelled = spark.read.parquet(f"{SF}/documents.parquet")
                kept = quality.judge(df, quality.learn(labelled, labels), corpus_pipeline.COLUMNS).where("kept").collect()
                assert all(len(WORD.findall(r.text)) >= 50 for r in kept) and {r.doc_id for r in kept} <= {r[0] for r in cases.rows()}
                assert stage(spark, df, SF).columns == corpus_pipeline.COLUMNS
                continue
            out = stage(spark, df, SF)
            assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
            rows = out.collect()
            ids = {r[0] for r in df.select("doc_id").collect()}
            single = {*groups_of(sets_of(cases.texts_of(df)), 80).values()} | ids & {None}
            assert {r.doc_id for r in rows} == (single if name == "minhash_near_dedup" else ids)


def test_repeats_agree_with_their_statement(spark):
    """Names, types and rows of op9 and of its DuckDB statement, on a whole small table."""
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    sql = con.sql(queries.ORACLE["op9_repeats"])
    got = queries.op9_repeats(spark, "/root/testdata/sf0.001").select(*sql.columns)
    assert [f.dataType.simpleString() for f in got.schema.fields] == [{"VARCHAR": "string"}.get(str(t), str(t).lower()) for t in sql.types]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(sql.fetchall()) and any(r[sql.columns.index("n_removed")] for r in rows)
