"""Table sources: parquet tables (S3, S10), CSV."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; selecting columns here lets the reader prune (ReadSchema)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_text_table(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """S3: a hosted table with a ``text`` column; only that column is read."""
    return spark.read.parquet(path).select(text_col)


def read_training_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The two training columns of a training parquet file."""
    return spark.read.parquet(path).select("transformed_tokens", "dist")


def read_csv_rows(spark: SparkSession, path: str, columns: list[str] | None = None,
                  schema: str | None = None) -> DataFrame:
    """CSV with header and quoted multi-line fields; partitions replace chunks."""
    reader = (spark.read.option("header", "true").option("multiLine", "true")
              .option("escape", '"'))
    reader = reader.schema(schema) if schema else reader
    df = reader.csv(path)
    return df.select(*columns) if columns else df
