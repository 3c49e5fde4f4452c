from pyspark.sql import functions as F

from codeprep.functions import text as T
from codeprep.operators.checks import triangle_mismatches
from codeprep.plans import fixtures as X
from codeprep.plans import pipeline as P
from conftest import SF001


def test_collect_stage(spark):
    lines = spark.createDataFrame([
        (1, '{"C": "int a;\\nint b;", "C++": "int a;"}'), (2, '{"C": "int a;\\nint b;"}'),
        (3, '{"C++": "int c;"}'), (4, "{broken"), (5, '{"C": "x", "C++": "int a;"}'), (6, '{"Go": "y"}')],
        "line_no long, value string")
    c = P.collect_stage(lines)
    assert [r["rank"] for r in c.paired.collect()] == [1]
    assert c.unpaired_c.count() == 0            # its C text was kept by the pair on line 1
    assert [r["rank"] for r in c.unpaired_cpp.collect()] == [3]
    assert c.paired.first()["c_code"] == "int a;\\nint b;"
    assert {r["outcome"]: r["n"] for r in c.counters.collect()}["malformed"] == 1


def test_prepare_and_sample(spark):
    def lines(df):
        return df.select("doc_id", "lang", T.escape_newlines("code").alias("code"))
    src = lines(X.code_c(spark, SF001)).unionByName(lines(X.code_cpp(spark, SF001).withColumn("doc_id", F.col("doc_id") + 100000)))
    p = P.prepare_stage(src, min_doc_freq=5)
    t = p.training
    assert t.count() > 0 and triangle_mismatches(t).count() == 0
    assert p.ids.filter(F.col("id") < 4).count() == 4
    n_in = src.count()
    assert t.count() + p.rejects.count() == n_in
    c = t.filter(F.col("lang") == "c")
    cpp = t.filter(F.col("lang") == "cpp")
    s = P.sample_stage(c, cpp, p.ids, max_len=64)
    assert s.count() == min(c.count(), cpp.count())
    r = s.orderBy("position").first()
    assert r["c_encoder_ids"][0] == 2 and r["c_encoder_ids"][-1] == 3 and len(r["c_encoder_ids"]) == 66
    assert r["c_decoder_ids"][:2] == [2, 2] and r["c_encoder_dist"] == r["c_decoder_dist"]
    import tempfile
    from codeprep.sinks import write_samples
    out = tempfile.mkdtemp(prefix="codeprep-test-") + "/samples"
    write_samples(s, out)
    back = spark.read.parquet(out)
    assert back.count() == s.count() and {r[0] for r in back.select("split").distinct().collect()} <= {"train", "val", "test"}


def test_collect_stage_from_files(spark):
    import os
    import tempfile
    from codeprep.sources.json_lines import read_json_lines
    d = tempfile.mkdtemp(prefix="codeprep-test-")
    a, b = os.path.join(d, "train.json"), os.path.join(d, "test.json")
    with open(a, "w") as f:
        f.write('{"C": "int a;", "C++": "int b;"}\n\n{not json\n')
    with open(b, "w") as f:
        f.write('{"C": "int a;"}\n{"C++": "int c;"}\n{"C": "int z;", "C++": "int b;"}\n')
    lines = read_json_lines(spark, [a, b])
    assert [r["line_no"] for r in lines.orderBy("line_no").collect()] == [1, 3, 4, 5, 6]
    c = P.collect_stage(lines.select("line_no", "value"))
    assert [r["rank"] for r in c.paired.collect()] == [1]
    assert c.unpaired_c.count() == 0                       # "int a;" already kept by line 1
    assert [r["rank"] for r in c.unpaired_cpp.collect()] == [5]
    assert {r["outcome"]: r["n"] for r in c.counters.collect()} == {"pair": 2, "c": 1, "cpp": 1, "malformed": 1}
