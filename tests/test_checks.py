import os
import tempfile

from pyspark.sql import functions as F

from codeprep import sinks as K
from codeprep.functions import text as T
from codeprep.operators import checks as C
from codeprep.operators import tokens as TK
from codeprep.operators import tree as TR
from codeprep.plans import fixtures as X
from codeprep.sources.literals import parse_list_literal
from codeprep.sources.tables import read_csv_rows
from conftest import SF001


def test_full_matrix_is_symmetric(spark):
    df = spark.createDataFrame([(1, ["(", "a", ")", "b"])], "doc_id long, tokens array<string>")
    df = TR.with_triangles(df)
    m = {(r["i"], r["j"]): r["dist"] for r in TR.full_matrix_rows(df, "doc_id", "tokens", "dist").collect()}
    assert len(m) == 16
    assert all(m[(i, j)] == m[(j, i)] for i in range(4) for j in range(4))
    assert all(m[(i, i)] == 0 for i in range(4))


def test_lex_schema_and_observed_counters(spark):
    code = X.code_c(spark, SF001).select("doc_id", T.lex_input_raw("code").alias("code"))
    lexed = TK.obfuscate(code)
    assert C.missing_columns(lexed, {f.name: f.dataType for f in C.LEX_SCHEMA.fields}) == []
    observed = C.counters(lexed, "lex", rows=F.count(F.lit(1)), tokens=F.sum(F.size("transformed_tokens")))
    observed.write.format("noop").mode("overwrite").save()
    n = code.count()
    assert C.balance(code, lexed, lexed.limit(0)).first()["balanced"]
    assert n == lexed.count()


def test_csv_scan_of_lex_export(spark):
    d = tempfile.mkdtemp(prefix="codeprep-test-")
    code = X.code_cpp(spark, SF001).select("doc_id", T.lex_input_raw("code").alias("code"))
    lexed = TK.obfuscate(code)
    K.write_lex_csv(lexed, os.path.join(d, "csv"))
    back = read_csv_rows(spark, os.path.join(d, "csv"), columns=["line_number", "transformed_tokens"])
    got = {int(r[0]): r[1] for r in back.select("line_number", parse_list_literal("transformed_tokens")).collect()}
    want = {r[0]: r[1] for r in lexed.select("doc_id", "transformed_tokens").collect()}
    assert got == want
    assert C.triangle_mismatches(lexed.withColumn("dist", F.array().cast("array<int>"))
                                 .filter(F.size("transformed_tokens") > 1)).count() == lexed.filter(
        F.size("transformed_tokens") > 1).count()
