import random
import time

import pytest
from pyspark.sql import functions as F

from codeprep.functions import text as T
from codeprep.operators import tokens as TK
from codeprep.plans import queries as Q
from conftest import SF001
from fixtures import golden as G


def lex(spark, program):
    df = spark.createDataFrame([(1, program)], "doc_id long, code string")
    df = df.select("doc_id", T.lex_input_raw("code").alias("code"))
    return TK.obfuscate(df).collect()[0]


def test_golden_c(spark):
    r = lex(spark, G.C_PROGRAM)
    assert r["transformed_tokens"] == G.C_TOKENS
    assert r["var_dict"] == G.C_VARS
    assert r["func_dict"] == G.C_FUNCS
    assert r["lit_dict"] == G.C_LITS
    assert r["struct_dict"] == G.C_STRUCTS
    assert r["class_dict"] == {}


def test_golden_cpp(spark):
    r = lex(spark, G.CPP_PROGRAM)
    assert r["transformed_tokens"] == G.CPP_TOKENS
    assert r["class_dict"] == G.CPP_CLASSES
    assert r["func_dict"] == G.CPP_FUNCS


def test_restore_round_trip(spark):
    df = spark.createDataFrame([(1, G.C_PROGRAM), (2, G.CPP_PROGRAM)], "doc_id long, code string")
    df = df.select("doc_id", T.lex_input_raw("code").alias("code"))
    lexed = TK.obfuscate(df, keep_cols=["code"])
    out = TK.restore_names(lexed).select("restored_tokens", T.tokenize("code").alias("orig")).collect()
    for r in out:
        assert r["restored_tokens"] == r["orig"]


def test_directive_and_literal_merge(spark):
    df = spark.createDataFrame([(1, '# include <a.h>\n#define X 1\nint s = "a b\\"c";')],
                               "doc_id long, code string")
    toks = df.select(TK.merge_directives(T.tokenize("code")).alias("t")).collect()[0]["t"]
    assert toks[:2] == ["#include", "<"] and "#define" in toks
    tk = df.select("doc_id", T.tokenize("code").alias("tokens"))
    pieces = TK.literal_pieces(tk)
    assert pieces.count() > tk.select(F.size("tokens")).collect()[0][0]
    merged = TK.merge_literal_pieces(pieces).orderBy("pos").select("token").collect()
    assert [m[0] for m in merged] == tk.collect()[0]["tokens"]


def test_renaming_in_the_row_equals_the_joins(spark, monkeypatch):
    """Random token rows, with repeats of one name in several classes, line ends and nulls."""
    rng = random.Random(3)
    words = ["class", "struct", "int", "printf", "main", "(", ")", "a", "b", "c", "a\n", '"x\ny"', "1", ".5", "'c'", ";", None, "NULL", "é"]
    rows = [(i, "k%d" % (i % 3), [rng.choice(words) for _ in range(rng.randint(0, 30))]) for i in range(300)] + [(300, "k", None), (None, "k", ["a"])]
    df = spark.createDataFrame(rows, "doc_id long, kept string, t array<string>")

    def got():
        return {r["doc_id"]: r for r in TK.obfuscate(df, tokens_col="t", keep_cols=["kept"]).collect()}
    whole = got()
    monkeypatch.setattr(TK, "IN_ROW_TOKENS", 0)
    assert got() == whole and set(whole) == {i for i, _, t in rows if i is not None and t}
    monkeypatch.setattr(TK, "IN_ROW_TOKENS", 12)
    assert got() == whole                                      # both ways in one job
    assert any(not set(r["var_dict"]).isdisjoint(r["struct_dict"]) for r in whole.values())


def test_entities_are_never_broadcast(spark):
    """A small scan gives many entities: they stay out of the driver's memory."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for q in (Q.obfuscate_c, Q.obfuscate_cpp, Q.restore_names):
            plan = q(spark, SF001)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_obfuscate_cpp_broadcasts_nothing_when_run(spark, monkeypatch):
    """Adaptive planning sees real sizes and may plan a broadcast late: both ways are run, then their final plans read."""
    rows = []
    for longest in (TK.IN_ROW_TOKENS, 0):
        monkeypatch.setattr(TK, "IN_ROW_TOKENS", longest)
        df = Q.obfuscate_cpp(spark, SF001)
        rows.append(sorted(map(str, df.collect())))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
    assert rows[0] == rows[1] and len(rows[0]) == spark.read.parquet(f"{SF001}/part.parquet").count()


def test_names_are_restored_inside_the_row(spark):
    rows = [(1, ["var0", "lit0", ";", None, "var9"], {"a": "var0"}, {"1": "lit0"}), (2, ["var0"], {"b": "var0"}, {}), (3, ["var0"], {}, {}),
            (4, [], {"c": "var0"}, {})]
    df = spark.createDataFrame(rows, "doc_id long, transformed_tokens array<string>, var_dict map<string,string>, lit_dict map<string,string>")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    df = df.select("*", *[none.alias(c) for c in ("func_dict", "struct_dict", "class_dict")])
    out = TK.restore_names(df)
    assert {r["doc_id"]: r["restored_tokens"] for r in out.collect()} == {1: ["a", "1", ";", None, "var9"], 2: ["b"], 3: ["var0"], 4: []}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    twice = df.withColumn("func_dict", F.col("var_dict"))
    with pytest.raises(Exception, match="stands for two names"):
        TK.restore_names(twice).collect()


def test_tokens_of_a_row_are_made_once(spark):
    """Lambdas over a computed token array do not compute it again for each element."""
    code = "int x ; # define X 1\n" * 4000
    df = spark.createDataFrame([(1, code)], "doc_id long, code string").repartition(1)
    start = time.time()
    r = df.select(F.size(TK.merge_directives(T.tokenize("code"))).alias("n"), F.size(TK.neighbours(T.tokenize("code"))).alias("m")).first()
    assert (r["n"], r["m"]) == (4000 * 6, 4000 * 7) and time.time() - start < 60     # minutes before


def test_literal_pieces_across_batches(spark):
    """Islands cut by batch ends, neighbouring literals, and shuffled pieces, against the tokens."""
    rng = random.Random(4)
    words = ['"a\\"b\\\\c"', "'x'", '""', "x", "(", None]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(0, 25))]) for i in range(60)] + [(60, ['"' + "\\n" * 500 + '"', "y"]), (None, ["'z'", "'z'"])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    expected = sorted(((i, p, t or "") for i, toks in rows for p, t in enumerate(toks)), key=repr)
    pieces = TK.literal_pieces(df)
    for size in ("10000", "7", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            ordered = TK.merge_literal_pieces(pieces, ordered=True)
            assert sorted(map(tuple, ordered.collect()), key=repr) == expected
            assert "Exchange" not in str(ordered._jdf.queryExecution().executedPlan()).split("MapInArrow")[-1].split("Generate")[0]
            mixed = TK.merge_literal_pieces(pieces.orderBy(F.rand(5)))
            assert sorted(map(tuple, mixed.collect()), key=repr) == expected
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = Q.literal_merge(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2              # the lexer and the pieces, once each
