import os
import tempfile

from pyspark.sql import functions as F

from codeprep import sinks as K
from codeprep.functions import text as T
from codeprep.operators import tokens as TK
from codeprep.operators import vocab as V
from codeprep.plans import fixtures as X
from codeprep.sources import files as FS
from codeprep.sources import json_lines as J
from codeprep.sources import literals as L
from conftest import SF001


def scratch():
    return tempfile.mkdtemp(prefix="codeprep-test-")


def test_source_folder_scan(spark):
    d = scratch()
    for name, body in [("a.c", "int a;\r\nint b;\r\n"), ("b.cpp", "class X {};\n"), ("c.txt", "no")]:
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(body)
    with open(os.path.join(d, "bad.c"), "wb") as f:
        f.write(b"int \xff\xfe x;\n")
    os.mkdir(os.path.join(d, "sub"))
    with open(os.path.join(d, "sub", "deep.c"), "w") as f:
        f.write("int deep;")
    rows = {os.path.basename(r["path"]): r["code"] for r in FS.read_source_folder(spark, d).collect()}
    assert set(rows) == {"a.c", "b.cpp", "bad.c"}
    assert rows["a.c"] == "int a;\nint b;\n" and rows["bad.c"] == "int  x;\n"


def test_line_file_numbering_and_language(spark):
    d = scratch()
    path = os.path.join(d, "unpaired_cpp.txt")
    with open(path, "w") as f:
        f.write("int a;\\nint b;\n\nclass C {};\n")
    rows = sorted((r["doc_id"], r["lang"], r["code"]) for r in FS.read_line_file(spark, path).collect())
    assert rows == [(1, "cpp", "int a;\\nint b;"), (2, "cpp", ""), (3, "cpp", "class C {};")]


def test_json_lines_malformed_and_kinds(spark):
    lines = spark.createDataFrame([('{"C": "x", "C++": "y"}',), ('{"C": null}',), ("[1, 2]",), ("{bad",),
                                   ("   ",), ('{"Java": "z"}',)], "value string")
    p = J.parse_lines(lines)
    from codeprep.operators.filters import language_kind
    got = sorted((r["malformed"], r["kind"]) for r in p.select(
        "malformed", F.when(~F.col("malformed"), language_kind(F.col("record"))).alias("kind")).collect())
    assert got == sorted([(False, "pair"), (False, "c"), (True, None), (True, None), (False, "none")])


def test_literal_parse_and_escape_loss(spark):
    df = spark.createDataFrame([("['int', 'x', '=']", "{'x': 'var0'}", "a\\b\nc")], "l string, m string, code string")
    r = df.select(L.parse_list_literal("l").alias("l"), L.parse_dict_literal("m").alias("m"),
                  T.ascii_clean(T.escape_code("code")).alias("round")).collect()[0]
    assert r["l"] == ["int", "x", "="] and r["m"] == {"x": "var0"}
    assert r["round"] != "a\\b\nc"     # un-escape does not undo escape (doubled backslash stays)


def test_sinks_round_trip(spark):
    d = scratch()
    code = X.code_c(spark, SF001)
    K.write_line_file(code, os.path.join(d, "lines"), append=False, order_col="doc_id")
    back = spark.read.text(os.path.join(d, "lines"))
    assert back.count() == code.count()
    assert back.filter(F.col("value").contains("\n")).count() == 0
    lexed = TK.obfuscate(code.select("doc_id", T.lex_input_raw("code").alias("code")))
    K.write_lex_rows(lexed, os.path.join(d, "lex"))
    K.write_lex_csv(lexed, os.path.join(d, "lexcsv"))
    assert spark.read.parquet(os.path.join(d, "lex")).count() == lexed.count()
    csv = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(os.path.join(d, "lexcsv"))
    first = csv.orderBy(F.col("line_number").cast("long")).select(L.parse_list_literal("transformed_tokens")).first()[0]
    assert first == lexed.orderBy("doc_id").first()["transformed_tokens"]
    ids = V.token_ids(V.vocabulary(lexed.withColumnRenamed("transformed_tokens", "tokens")))
    K.write_vocab_file(ids, os.path.join(d, "vocab"))
    vocab = FS.read_vocab_file(spark, os.path.join(d, "vocab") + "/part-*")
    assert vocab.count() == ids.count() - 4
    order = [r["token"] for r in vocab.orderBy("line_no").collect()]
    assert order == sorted(order)
    train = lexed.withColumn("dist", F.array().cast("array<int>")).select("doc_id", "transformed_tokens", "dist")
    K.write_training_parquet(train, os.path.join(d, "train"))
    from codeprep.operators.checks import TRAINING_COLUMNS, missing_columns
    from codeprep.sources.tables import read_training_parquet
    assert missing_columns(read_training_parquet(spark, os.path.join(d, "train")), TRAINING_COLUMNS) == []


def test_streaming_lex(spark):
    from codeprep.streaming.ingest import start_lex_stream
    src, out, ck = scratch(), scratch(), scratch()
    with open(os.path.join(src, "unpaired_c.txt"), "w") as f:
        f.write("int x = 1;\\nint f(int y) { return x + y; }\n// only a comment\n"
                "int x = 1;\\nint f(int y) { return x + y; }\n")
    q = start_lex_stream(spark, src, os.path.join(out, "lex"), ck, trigger_once=True)
    q.awaitTermination(120)
    rows = spark.read.parquet(os.path.join(out, "lex")).collect()
    assert len(rows) == 1 and rows[0]["transformed_tokens"][:4] == ["int", "var0", "=", "lit0"]


def test_partition_count_invariance(spark):
    code = X.code_cpp(spark, SF001).select("doc_id", T.lex_input_raw("code").alias("code"))
    a = sorted((r[0], tuple(r[1])) for r in TK.obfuscate(code.coalesce(1)).select("doc_id", "transformed_tokens").collect())
    b = sorted((r[0], tuple(r[1])) for r in TK.obfuscate(code.repartition(7)).select("doc_id", "transformed_tokens").collect())
    assert a == b


def test_per_source_table_rejects_and_suffix(spark):
    from codeprep.operators.filters import source_suffix, split_by
    d = scratch()
    df = spark.createDataFrame([("folder", 0, "a.c"), ("folder", 1, "b.cpp"), ("table", 0, "c.txt")],
                               "source string, idx long, name string")
    K.write_per_source(df, os.path.join(d, "by_source"))
    back = spark.read.parquet(os.path.join(d, "by_source"))
    assert sorted((r["source"], r["idx"]) for r in back.collect()) == [("folder", 0), ("folder", 1), ("table", 0)]
    kept, rejects = split_by(df.withColumnRenamed("idx", "doc_id"), source_suffix("name"), "collect", "suffix")
    assert kept.count() == 2
    K.write_rejects(rejects, os.path.join(d, "rejects"))
    K.write_rejects(rejects, os.path.join(d, "rejects"))        # a rerun replaces
    r = spark.read.parquet(os.path.join(d, "rejects")).collect()
    assert len(r) == 1 and {x["reason"] for x in r} == {"suffix"}


def test_line_numbers_across_many_splits(spark):
    d = scratch()
    path = os.path.join(d, "unpaired_c.txt")
    with open(path, "w") as f:
        for i in range(1, 20001):
            f.write(f"int v{i} = {i};\n" if i % 97 else "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = FS.read_line_file(spark, path)
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 20000
    for r in rows:
        assert r["code"] == ("" if r["doc_id"] % 97 == 0 else f"int v{r['doc_id']} = {r['doc_id']};")
