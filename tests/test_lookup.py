"""Look-ups inside the row: the same rows as by a join, on nulls, empty and long lists, repeated tokens and rows."""

import random

from pyspark.sql import functions as F

from codeprep.operators import encode as EN
from codeprep.operators import lookup as L
from codeprep.operators import vocab as V

WORDS = [f"w{i}" for i in range(30)] + ["", "[UNK]", "é", "var0"]


def documents(spark):
    r = random.Random(5)
    rows = [(i, [r.choice(WORDS + ["w0"] * 30 + [None]) for _ in range(r.randint(0, 12))], ["var0", None, "w29"] if i % 3 else None) for i in range(200)]
    rows += [(1000, None, None), (1001, [], []), (1002, ["w0", "w29", "zz"] * 20_000, ["zz"])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>, aliases array<string>").withColumn("extra", F.lit(1))


def both_ways(call, table):
    small, large = L.dictionary(table), L.dictionary(table, max_rows=1)
    assert small.small and not large.small

    def rows(d):
        df = call(d)
        return df.columns, sorted(map(repr, df.collect()))
    assert rows(small) == rows(large)
    return call(small)


def test_unknown_tokens_both_ways(spark, monkeypatch):
    monkeypatch.setattr(L, "STEP", 50)                       # many slices, and rows over one
    docs, vocab = documents(spark), spark.createDataFrame([(f"w{i}",) for i in range(20)] + [(None,)], "token string")
    for alias_col in (None, "aliases"):
        got = both_ways(lambda d: V.replace_unknown(docs, d, alias_col=alias_col), vocab)
        assert got.columns == ["doc_id", "aliases", "extra", "tokens", "n_unk", "n_tokens"]
        known = {f"w{i}" for i in range(20)}
        given = {r["doc_id"]: r for r in docs.collect()}
        for r in got.collect():
            own = set(given[r["doc_id"]]["aliases"] or ()) - {None} if alias_col else set()
            want = [t if t in known | own else "[UNK]" for t in given[r["doc_id"]]["tokens"] or []]
            kept = [t is not None and t in known | own for t in given[r["doc_id"]]["tokens"] or []]
            assert r["tokens"] == want and r["n_unk"] == kept.count(False) and r["n_tokens"] == len(want)
    assert V.replace_unknown(docs.limit(0), vocab).collect() == []


def test_encoding_and_decoding_both_ways(spark, monkeypatch):
    monkeypatch.setattr(L, "STEP", 50)
    docs = documents(spark).drop("aliases")
    ids = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("[SOS]", 2), ("[EOS]", 3)] + [(f"w{i}", 4 + i) for i in range(20)], "token string, id long")
    enc = both_ways(lambda d: EN.encode_tokens(docs, d, tokens_col="tokens"), ids)
    assert enc.schema["ids"].dataType.simpleString() == "array<bigint>"
    framed = enc.select("doc_id", F.concat(F.array(F.lit(2)), "ids", F.array(F.lit(None).cast("long"), F.lit(3), F.lit(99))).alias("ids"))
    dec = both_ways(lambda d: EN.decode_ids(framed, d), ids)
    known = {f"w{i}" for i in range(20)}
    want = {r["doc_id"]: [t if t in known else "[UNK]" for t in r["tokens"] or []] + [None, None] for r in docs.collect()}
    assert {r["doc_id"]: r["decoded"] for r in dec.collect()} == want


def test_no_exchange_within_the_bounds(spark):
    docs, vocab = documents(spark), spark.createDataFrame([("w1",)], "token string")
    plan = V.replace_unknown(docs, L.dictionary(vocab))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan


def test_rows_of_one_id_stay_apart(spark):
    docs = spark.createDataFrame([(1, ["a"]), (1, ["b", "a"]), (None, ["b"])], "doc_id long, tokens array<string>")
    got = V.replace_unknown(docs, spark.createDataFrame([("a",)], "token string")).select("tokens", "n_unk").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, [type(got[0])(tokens=t, n_unk=n) for t, n in ((["a"], 0), (["[UNK]", "a"], 1), (["[UNK]"], 1))]))
