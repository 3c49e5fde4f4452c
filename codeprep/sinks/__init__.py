"""Writers (K1–K8).  Every sink is one Spark write: the job commit is atomic,
so a failed or retried task never leaves a half-appended file behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.tokens import MAP_COLS


def write_line_file(df: DataFrame, path: str, code_col: str = "code", append: bool = True,
                    order_col: str | None = None, escaped: bool = False) -> None:
    """K1 / K2: one escaped snippet per line (P1, unless it is ``escaped``
    already); ``append`` or overwrite.

    With ``order_col`` the output is range-partitioned and sorted, so the
    part files concatenate in that order.
    """
    out = df
    if order_col:
        out = out.orderBy(order_col)
    out.select((F.col(code_col) if escaped else T.escape_newlines(code_col)).alias("value")).write \
        .mode("append" if append else "overwrite").text(path)


def write_per_source(df: DataFrame, path: str, source_col: str = "source") -> None:
    """K3: instead of one small file per record: a table partitioned by source,
    each record keeping ``(source, idx, name)``."""
    df.write.mode("overwrite").partitionBy(source_col).parquet(path)


def write_lex_rows(df: DataFrame, path: str) -> None:
    """K4 / K5: lex rows with native arrays and maps, one atomic parquet write."""
    df.write.mode("overwrite").parquet(path)


def write_lex_csv(df: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """K4 export: CSV with header; arrays and maps as JSON text."""
    cols = [F.col(id_col).alias("line_number"), F.to_json("transformed_tokens").alias("transformed_tokens")]
    cols += [F.to_json(c).alias(c) for c in MAP_COLS if c in df.columns]
    df.select(*cols).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_vocab_file(ids: DataFrame, path: str) -> None:
    """K6: one token per line in id order (special tokens excluded, as they are
    implied).  Range partitioning keeps the order across part files, so no
    single task writes the whole vocabulary; read the parts in name order."""
    ids.filter(F.col("id") >= 4).orderBy("id").select(F.col("token").alias("value")) \
        .write.mode("overwrite").text(path)


def write_training_parquet(df: DataFrame, path: str, block_bytes: int = 32 * 1024 * 1024) -> None:
    """K7: zstd parquet; row-group size is set in bytes (``parquet.block.size``)."""
    df.write.mode("overwrite").option("compression", "zstd") \
        .option("parquet.block.size", str(block_bytes)).parquet(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """K8: ``(doc_id, stage, reason)`` of one run; a rerun replaces them, as it
    does the run's other outputs."""
    rejects.write.mode("overwrite").parquet(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """E3 bulk form: training samples partitioned by ``split`` (train / val /
    test), zstd parquet; readers prune to one split by directory."""
    samples.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)
