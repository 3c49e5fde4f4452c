import json
import os
import tempfile

from codeprep import cli
from codeprep.plans import fixtures as X
from conftest import SF001


def test_collect_prepare_sample_chain(spark):
    d = tempfile.mkdtemp(prefix="codeprep-cli-")
    # JSON lines built from the C and C++ fixtures: pairs, singles and one broken line
    c = [r["code"] for r in X.code_c(spark, SF001).orderBy("doc_id").limit(60).collect()]
    cpp = [r["code"] for r in X.code_cpp(spark, SF001).orderBy("doc_id").limit(60).collect()]
    path = os.path.join(d, "records.json")
    with open(path, "w") as f:
        for i in range(60):
            rec = {"C": c[i], "C++": cpp[i]} if i % 3 == 0 else ({"C": c[i]} if i % 3 == 1 else {"C++": cpp[i]})
            f.write(json.dumps(rec) + "\n")
        f.write("{broken\n")
    counters = cli.main(["collect", "--json", path, "--out", os.path.join(d, "collected")])
    assert counters["malformed"] == 1 and counters["pair"] == 20
    res = cli.main(["prepare", "--lines", os.path.join(d, "collected", "unpaired_c"),
                    os.path.join(d, "collected", "unpaired_cpp"), "--out", os.path.join(d, "prepared"),
                    "--min-doc-freq", "2"])
    assert isinstance(res["rejects"], dict)
    out = cli.main(["sample", "--c", os.path.join(d, "prepared", "c_training"),
                    "--cpp", os.path.join(d, "prepared", "cpp_training"),
                    "--ids", os.path.join(d, "prepared", "ids"), "--out", os.path.join(d, "samples"),
                    "--max-len", "64"])
    assert out["samples"] > 0
    vocab = spark.read.text(os.path.join(d, "prepared", "vocab"))
    assert vocab.count() == spark.read.parquet(os.path.join(d, "prepared", "ids")).count() - 4


def test_collect_folder_and_table_twice(spark):
    d = tempfile.mkdtemp(prefix="codeprep-cli-")
    src = os.path.join(d, "src")
    os.makedirs(src)
    for name, text in (("a.c", "int x; // one\n"), ("b.c", "int x; /* two */\n"), ("c.cpp", "int y;\nint z;\n"), ("d.txt", "no")):
        with open(os.path.join(src, name), "w") as f:
            f.write(text)
    for _ in range(2):
        assert cli.main(["collect-folder", "--folder", src, "--out", os.path.join(d, "folder")]) == {"unique": 2}
        assert cli.main(["collect-folder", "--folder", src, "--out", os.path.join(d, "one"), "--sample", "1"]) == {"unique": 1}
        res = cli.main(["collect-table", "--table", f"{SF001}/benchmark.parquet", "--id", "item_id", "--out", os.path.join(d, "table")])
    back = spark.read.parquet(os.path.join(d, "table"))
    assert back.count() == res["solutions"] and back.where("code like '#include <iostream>%'").count() == res["solutions"]


def test_reject_reasons_and_row_cap(spark):
    from codeprep.plans import pipeline as P
    from codeprep.plans import queries as Q
    p = P.prepare_stage(Q.code_lines(spark, SF001), min_doc_freq=1, with_distances=False, row_cap=7)
    assert {r["reason"] for r in p.rejects.collect()} >= {"blank", "empty_after_preprocess", "too_long"}
    assert {r["lang"]: r["count"] for r in p.training.groupBy("lang").count().collect()} == {"c": 7, "cpp": 7}
