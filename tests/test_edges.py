"""Edge cases named in the survey's test plan."""

from pyspark.sql import functions as F

from codeprep.functions import text as T
from codeprep.operators import encode as EN
from codeprep.operators import tokens as TK
from codeprep.operators import tree as TR
from codeprep.operators import vocab as V
from codeprep.plans import pipeline as P


def test_empty_single_token_and_comment_only(spark):
    lines = spark.createDataFrame([(1, "c", ""), (2, "c", "x"), (3, "c", "// only a comment"),
                                   (4, "c", "/* a */ /* b */"), (5, "c", "int y;")], "doc_id long, lang string, code string")
    p = P.prepare_stage(lines, min_doc_freq=1, max_unk_ratio=1.0)
    reasons = {r["doc_id"]: r["reason"] for r in p.rejects.collect()}
    assert reasons == {1: "blank", 3: "empty_after_preprocess", 4: "empty_after_preprocess"}
    t = {r["doc_id"]: (r["transformed_tokens"], r["dist"]) for r in p.training.collect()}
    assert t[2] == (["var0"], []) and t[5][0] == ["int", "var0", ";"] and len(t[5][1]) == 3


def test_line_comment_inside_string_survives(spark):
    df = spark.createDataFrame([('char *u = "http://x"; // tail\nint /* c */ z;',)], "code string")
    r = df.select(T.resolve_comments("code").alias("r"), T.strip_comments_simple("code").alias("s")).first()
    assert '"http://x"' in r["r"] and "tail" not in r["r"] and "int   z;" in r["r"]
    assert '"http:' in r["s"] and "x\"" not in r["s"]      # the simple rule cuts inside strings


def test_unbalanced_brackets_keep_formula():
    toks = [")", "a", "(", "(", "b", ")"]
    d = TR.triangle_of(toks)
    assert len(d) == 15 and (d >= 0).all()
    h, dd = TR._levels(toks)
    assert list(h) == [-1, -1, 0, 1, 1, 0]


def test_tokens_spelled_like_missing_values(spark):
    df = spark.createDataFrame([(1, ["NULL", "nan", "None", "NA", "x"]), (2, ["NULL"])], "doc_id long, tokens array<string>")
    v = {r["token"]: (r["num_rows"], r["count"]) for r in V.vocabulary(df).collect()}
    assert v["NULL"] == (2, 2) and v["nan"] == (1, 1) and v["None"] == (1, 1) and v["NA"] == (1, 1)


def test_baseline_for_short_rows_and_padding_longer_than_max(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "n int")
    assert [r[0] for r in df.select(EN.baseline_distances(F.col("n"))).collect()] == [[], [], [1]]
    ids = spark.createDataFrame([([4, 5, 6],)], "ids array<long>")
    assert ids.select(EN.frame_and_pad(F.col("ids"), 2)).first()[0] == [2, 4, 5, 6, 3]
    assert ids.select(EN.frame_and_pad(F.col("ids"), 5, eos_before_pad=True)).first()[0] == [2, 4, 5, 6, 3, 0, 0]


def test_anonymous_struct_and_repeated_declaration(spark):
    code = "struct { int a; } s; struct P { int b; }; struct P q; P r;"
    df = spark.createDataFrame([(1, code)], "doc_id long, code string")
    r = TK.obfuscate(df).first()
    toks = r["transformed_tokens"]
    assert toks[:2] == ["struct", "{"]                      # Q3: only names become entities
    assert r["struct_dict"] == {"P": "struct0"}             # Q2: stable id on repeat
    assert toks.count("struct0") == 3


def test_continuation_lines_and_adjacent_literals(spark):
    from codeprep.functions import text as T
    code = '#define SWAP(a,b) \\\n do { int t=a; \\\n a=b; } while(0)\nint x; g("b","c"); /* c */ y = "//no";\n'
    df = spark.createDataFrame([(code,)], "code string").select(T.resolve_comments("code").alias("c"))
    assert df.first()["c"] == 'int x; g("b","c");   y = "//no";'


def test_python_literals_with_escapes(spark):
    from codeprep.sources import literals as L
    values = [["a\x0bb"], ["it's", 'say "x"'], ["\\x41", "\\"], [], ["é\n"], ["a\'\"b"]]
    df = spark.createDataFrame([(i, repr(v)) for i, v in enumerate(values)] + [(99, "no list")], "doc_id long, t string")
    got = {r["doc_id"]: r["v"] for r in df.select("doc_id", L.parse_list_literal("t").alias("v")).collect()}
    assert [got[i] for i in range(len(values))] == values and got[99] is None
    assert [r["doc_id"] for r in L.unparsed(df, "t", L.parse_list_literal("t")).collect()] == [99]


def test_rows_over_the_triangle_limit_do_not_fail(spark):
    from codeprep.operators import tree as TR
    df = spark.createDataFrame([(1, ["(", "a", ")"]), (2, ["x"] * 50), (3, None)], "doc_id long, tokens array<string>")
    got = {r["doc_id"]: r["dist"] for r in TR.with_triangles(df, max_tokens=10).collect()}
    assert len(got[1]) == 3 and got[2] is None and got[3] == []
