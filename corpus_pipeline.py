"""The preparation of a training corpus: five stages over ``documents``.

Each stage works on all that the one before kept, is written as Parquet to
the shared folder and read again.  All but the last return the columns of
``documents``.  Rows without id cannot be named in a group of copies or an
order, so the near-duplicate and repeat stages pass them on as they are; rows
of one id are one document, of which the longest text stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeprep.llm import minhash, packing, quality, repeats, secrets
from codeprep.llm.common import documents, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(rows: DataFrame, text: str) -> DataFrame:
    """The columns of ``documents`` with a new text and its length."""
    return rows.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model, COLUMNS).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.  Groups at five
    words and a similarity of 0.8; 14 groups of hashes miss a pair just there
    about as seldom (9e-5) as the operator's 10 miss one at its own 0.85."""
    kept = minhash.near_duplicates(docs, percent=80, groups=14).where("kept and doc_id is not null").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "text", "lang", "source")
    named = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").withColumn("at", F.row_number().over(one)).where("at = 1")
    return named.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller document has go from the text."""
    return _with_text(repeats.remove_repeats(docs, carry=("lang", "source")), "kept")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark."""
    return _with_text(secrets.scan(docs, ["doc_id", "lang", "source"]), "redacted")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts' tokens in sequences of 1024."""
    return packing.piece_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]

#: The first stage's verdict is a fitted model's, which SQL can't express; see tests/llm for the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
