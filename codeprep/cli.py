"""Command line jobs (``spark-submit -m codeprep ...`` or ``python -m codeprep``).

The reference runs its stages as scripts over folders.  The same stages as
Spark jobs:

    collect  JSON-lines files -> paired / unpaired escaped line files + counters
    collect-folder  .c / .cpp files -> one line file of distinct, comment-free snippets
    collect-table   parquet table of solutions -> records with standard headers, by source
    prepare  escaped line files -> lex rows, vocabulary, ids, training parquet, rejects
    sample   training parquet of two languages + ids -> samples partitioned by split

Every output is one atomic Spark write; intermediate tables go to the
shared checkpoint folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sinks as K
from .functions import constants as C
from .plans import pipeline as P
from .session import ensure_checkpoint_dir, get_session
from .sources.files import read_line_file, read_source_folder
from .sources.json_lines import read_json_lines


def _spark() -> SparkSession:
    spark = get_session()
    ensure_checkpoint_dir(spark)
    return spark


def run_collect(spark: SparkSession, inputs: list[str], out: str) -> dict:
    c = P.collect_stage(read_json_lines(spark, inputs).select("line_no", "value"))
    order = "rank"
    K.write_line_file(c.paired.withColumnRenamed("c_code", "code"), os.path.join(out, "paired_c"),
                      append=False, order_col=order)
    K.write_line_file(c.paired.withColumnRenamed("cpp_code", "code"), os.path.join(out, "paired_cpp"),
                      append=False, order_col=order)
    K.write_line_file(c.unpaired_c, os.path.join(out, "unpaired_c"), append=False, order_col=order)
    K.write_line_file(c.unpaired_cpp, os.path.join(out, "unpaired_cpp"), append=False, order_col=order)
    return {r["outcome"]: r["n"] for r in c.counters.collect()}      # a handful of counters


def run_collect_folder(spark: SparkSession, folder: str, out: str, n: int | None = None, seed: int = 0) -> dict:
    rows = P.collect_folder_stage(read_source_folder(spark, folder), n, seed)
    K.write_line_file(rows, out, append=False, order_col="path", escaped=True)
    return {"unique": spark.read.text(out).count()}


def run_collect_table(spark: SparkSession, table: str, out: str, id_col: str, text_col: str = "text") -> dict:
    K.write_per_source(P.collect_table_stage(spark.read.parquet(table), id_col, text_col), out)
    return {"solutions": spark.read.parquet(out).count()}


def run_prepare(spark: SparkSession, inputs: list[str], out: str, max_tokens: int = C.MAX_TOKENS,
                min_doc_freq: int = C.MIN_DOC_FREQ, max_unk_ratio: float = C.MAX_UNK_RATIO) -> dict:
    """``inputs`` are escaped line files; the language comes from the path
    (``_cpp`` -> cpp).  Ids stay distinct across files: (file index, line)."""
    lines = None
    for i, path in enumerate(inputs):
        df = read_line_file(spark, path).withColumn("doc_id", F.col("doc_id") + F.lit(i) * (1 << 40))
        lines = df if lines is None else lines.unionByName(df)
    p = P.prepare_stage(lines, max_tokens, min_doc_freq, max_unk_ratio)
    K.write_lex_rows(p.lexed, os.path.join(out, "lex"))
    K.write_vocab_file(p.ids, os.path.join(out, "vocab"))
    p.ids.write.mode("overwrite").parquet(os.path.join(out, "ids"))
    for lang in ("c", "cpp"):
        rows = p.training.filter(F.col("lang") == lang).select("doc_id", "transformed_tokens", "dist")
        K.write_training_parquet(rows, os.path.join(out, f"{lang}_training"))
    K.write_rejects(p.rejects, os.path.join(out, "rejects"))
    counts = spark.read.parquet(os.path.join(out, "rejects")).groupBy("reason").count()
    return {"rejects": {r["reason"]: r["count"] for r in counts.collect()}}     # one row per reason


def run_sample(spark: SparkSession, c_path: str, cpp_path: str, ids_path: str, out: str,
               max_len: int = C.MAX_SEQ_LEN, use_tree_distance: bool = True) -> dict:
    c = spark.read.parquet(c_path)
    cpp = spark.read.parquet(cpp_path)
    ids = spark.read.parquet(ids_path)
    s = P.sample_stage(c, cpp, ids, max_len, use_tree_distance)
    K.write_samples(s, out)
    return {"samples": spark.read.parquet(out).count()}


def main(argv: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="codeprep")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("collect")
    a.add_argument("--json", nargs="+", required=True)
    a.add_argument("--out", required=True)
    f = sub.add_parser("collect-folder")
    f.add_argument("--folder", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--sample", type=int)
    f.add_argument("--seed", type=int, default=0)
    t = sub.add_parser("collect-table")
    t.add_argument("--table", required=True)
    t.add_argument("--id", required=True)
    t.add_argument("--text", default="text")
    t.add_argument("--out", required=True)
    b = sub.add_parser("prepare")
    b.add_argument("--lines", nargs="+", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--max-tokens", type=int, default=C.MAX_TOKENS)
    b.add_argument("--min-doc-freq", type=int, default=C.MIN_DOC_FREQ)
    b.add_argument("--max-unk-ratio", type=float, default=C.MAX_UNK_RATIO)
    s = sub.add_parser("sample")
    s.add_argument("--c", required=True)
    s.add_argument("--cpp", required=True)
    s.add_argument("--ids", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--max-len", type=int, default=C.MAX_SEQ_LEN)
    s.add_argument("--baseline-distances", action="store_true")
    args = ap.parse_args(argv)
    spark = _spark()
    if args.cmd == "collect":
        res = run_collect(spark, args.json, args.out)
    elif args.cmd == "collect-folder":
        res = run_collect_folder(spark, args.folder, args.out, args.sample, args.seed)
    elif args.cmd == "collect-table":
        res = run_collect_table(spark, args.table, args.out, args.id, args.text)
    elif args.cmd == "prepare":
        res = run_prepare(spark, args.lines, args.out, args.max_tokens, args.min_doc_freq, args.max_unk_ratio)
    else:
        res = run_sample(spark, args.c, args.cpp, args.ids, args.out, args.max_len, not args.baseline_distances)
    print(json.dumps(res, default=str))
    return res
