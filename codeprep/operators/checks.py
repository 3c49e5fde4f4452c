"""Quality checks of the data contract (V1–V3) and run counters (K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

LEX_SCHEMA = Ty.StructType([
    Ty.StructField("doc_id", Ty.LongType()),
    Ty.StructField("transformed_tokens", Ty.ArrayType(Ty.StringType())),
    Ty.StructField("var_dict", Ty.MapType(Ty.StringType(), Ty.StringType())),
    Ty.StructField("func_dict", Ty.MapType(Ty.StringType(), Ty.StringType())),
    Ty.StructField("lit_dict", Ty.MapType(Ty.StringType(), Ty.StringType())),
    Ty.StructField("struct_dict", Ty.MapType(Ty.StringType(), Ty.StringType())),
    Ty.StructField("class_dict", Ty.MapType(Ty.StringType(), Ty.StringType())),
])

TRAINING_COLUMNS = {"transformed_tokens": Ty.ArrayType(Ty.StringType()),
                    "dist": Ty.ArrayType(Ty.IntegerType())}


def triangle_mismatches(df: DataFrame, tokens_col: str = "transformed_tokens", dist_col: str = "dist") -> DataFrame:
    """V1: rows whose distance triangle does not have n(n-1)/2 entries (must be empty)."""
    n = F.size(tokens_col).cast("long")
    return df.filter(F.size(dist_col).cast("long") != n * (n - 1) / 2)


def missing_columns(df: DataFrame, required: dict) -> list[str]:
    """V2: required columns absent or of another type (schema only, no job)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    return [c for c, t in required.items() if fields.get(c) != t]


def balance(input_df: DataFrame, kept: DataFrame, rejects: DataFrame) -> DataFrame:
    """V3: one row ``(n_input, n_kept, n_rejected, balanced)``.

    The three sides are tagged and unioned, then summed in one aggregate
    (no join of any kind)."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    u = (input_df.select(one.alias("i"), zero.alias("k"), zero.alias("r"))
         .unionByName(kept.select(zero.alias("i"), one.alias("k"), zero.alias("r")))
         .unionByName(rejects.select(zero.alias("i"), zero.alias("k"), one.alias("r"))))
    return (u.agg(F.sum("i").alias("n_input"), F.sum("k").alias("n_kept"), F.sum("r").alias("n_rejected"))
            .withColumn("balanced", F.col("n_input") == F.col("n_kept") + F.col("n_rejected")))


def counters(df: DataFrame, name: str, **exprs) -> DataFrame:
    """K9: attach named run counters (``observe``) computed while the job runs."""
    return df.observe(name, *[e.alias(k) for k, e in exprs.items()])
