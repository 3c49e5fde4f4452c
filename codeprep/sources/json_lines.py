"""JSON-lines scan of multi-language records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

RECORD_TYPE = "map<string,string>"


def parse_record(line: Column) -> Column:
    """A JSON object with string values -> ``map<string,string>``; null if the
    line is not a JSON object (malformed text, arrays, scalars)."""
    parsed = F.from_json(line, RECORD_TYPE)
    return F.when(F.json_object_keys(line).isNotNull(), parsed)


def parse_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Strip lines, skip blanks, parse; adds ``record`` and ``malformed``."""
    v = T.strip_ws(value_col)
    return (lines.withColumn("_line", v).filter(F.col("_line") != "")
            .withColumn("record", parse_record(F.col("_line")))
            .withColumn("malformed", F.col("record").isNull())
            .drop("_line"))


def read_json_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Read several JSON-lines files in the given order; every line keeps
    ``line_no`` (global input order, the order the greedy pair dedup walks)
    and ``file``; blank lines are skipped, malformed ones flagged."""
    from .files import read_numbered_lines
    return parse_lines(read_numbered_lines(spark, paths, "line_no"))
