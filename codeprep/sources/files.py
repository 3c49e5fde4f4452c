"""Source folders and line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.numbering import consecutive_index


def read_source_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, code)`` for every ``.c`` / ``.cpp`` file directly in a
    folder (not recursive).  Undecodable bytes become U+FFFD and are
    removed; ``\\r\\n`` and lone ``\\r`` become ``\\n``, as text-mode reads do."""
    df = (spark.read.text(folder, wholetext=True, pathGlobFilter="*.{c,cpp}", recursiveFileLookup=False)
          .select(F.input_file_name().alias("path"), F.col("value").alias("code")))
    code = F.replace(F.regexp_replace("code", "\\r\\n?", "\n"), F.lit("�"), F.lit(""))
    return df.withColumn("code", code)


def language_of_path(path_col: str = "path"):
    """``cpp`` when the path contains ``_cpp`` (any case), else ``c``."""
    return F.when(F.lower(F.col(path_col)).contains("_cpp"), F.lit("cpp")).otherwise(F.lit("c"))


def read_numbered_lines(spark: SparkSession, paths, id_col: str = "line_no") -> DataFrame:
    """Lines of one or more text files with a global 1-based number in input
    order (files in path order, then line order): ``(id_col, file, value)``.

    Spark's text reader splits a file into ordered byte ranges, so (file
    rank, split start, position in split) is a total order; numbering is the
    distributed consecutive index.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = [spark.read.text(p).withColumn("_file_rank", F.lit(i)) for i, p in enumerate(paths)]
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    raw = (raw.withColumn("file", F.input_file_name())
           .withColumn("_start", F.input_file_block_start())
           .withColumn("_mid", F.monotonically_increasing_id()))
    order = [F.col("_file_rank"), F.col("file"), F.col("_start"), F.col("_mid")]
    numbered = consecutive_index(raw, order, out_col=id_col, start=1)
    return numbered.select(id_col, "file", "value")


def read_line_file(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One snippet per line, id = 1-based line number; blank lines keep
    their number (they are dropped later, leaving gaps), ``lang`` from path (S5)."""
    lines = read_numbered_lines(spark, path, id_col)
    return lines.select(id_col, language_of_path("file").alias("lang"), F.col("value").alias("code"))


def read_vocab_file(spark: SparkSession, path: str) -> DataFrame:
    """One token per line; stripped, blank and repeated lines skipped
    (first occurrence wins); ``line_no`` keeps the file order."""
    lines = read_line_file(spark, path, id_col="line_no").select("line_no", T.strip_ws("code").alias("token"))
    lines = lines.filter(F.col("token") != "")
    return lines.groupBy("token").agg(F.min("line_no").alias("line_no"))
