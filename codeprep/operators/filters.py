"""Row filters (F1–F3, F7–F11).  Each returns DataFrames; rejects are kept
as a second output where the reference logs them (K8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .joins import checked_broadcast


def keep_where(df: DataFrame, cond: Column) -> DataFrame:
    """Filter on a value computed by an expensive projection (tokens, lex input).

    A plain ``filter`` is pushed by Catalyst beneath the projection that
    computes its input, with the expression substituted – the regex work
    then runs twice per row (and possibly before an exchange).  Written as a
    generator that emits the row once or not at all, the predicate reads the
    projection's output; the row's columns pass through unchanged, so the
    child's partitioning is kept.
    """
    gate = F.filter(F.array(F.lit(True)), lambda _: F.coalesce(cond, F.lit(False)))
    return df.select("*", F.explode(gate).alias("_keep")).drop("_keep")


def non_blank(col) -> Column:
    """F1 / F2 predicate: text is not empty after Python-style strip."""
    return F.coalesce(T.strip_ws(col) != "", F.lit(False))


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """drop blank snippets."""
    return df.filter(non_blank(col))


def split_by(df: DataFrame, predicate: Column, stage: str, reason: str,
             id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Generic keep / reject split; rejects are ``(id, stage, reason)`` (K8)."""
    kept = df.filter(predicate)
    rejects = df.filter(~predicate).select(id_col, F.lit(stage).alias("stage"), F.lit(reason).alias("reason"))
    return kept, rejects


def language_kind(m: Column, c_key: str = "C", cpp_key: str = "C++") -> Column:
    """``pair`` | ``c`` | ``cpp`` | ``none`` from key presence (a null
    value still counts as present)."""
    has_c, has_cpp = F.map_contains_key(m, c_key), F.map_contains_key(m, cpp_key)
    return (F.when(has_c & has_cpp, F.lit("pair")).when(has_c, F.lit("c"))
            .when(has_cpp, F.lit("cpp")).otherwise(F.lit("none")))


def source_suffix(path_col) -> Column:
    """file name ends in ``.c`` or ``.cpp``."""
    return F.col(path_col).rlike("\\.(c|cpp)$") if isinstance(path_col, str) else path_col.rlike("\\.(c|cpp)$")


def exclude_ids(df: DataFrame, excluded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """F8: drop listed documents (left anti join; the list is broadcast after a size check)."""
    ex = checked_broadcast(excluded.select(id_col).distinct())
    return df.join(ex, id_col, "left_anti")


def verdict_split(df: DataFrame, verdicts: DataFrame, id_col: str = "doc_id",
                  ok_col: str = "ok") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(compiled, failed, no_verdict)`` from a verdict table ``(id, ok)``.

    The verdict table is as large as the corpus, so it is a shuffle join,
    not a broadcast.
    """
    v = verdicts.select(id_col, F.col(ok_col).alias("_ok"))
    j = df.join(v, id_col, "left")
    ok = j.filter(F.col("_ok") == 1).drop("_ok")
    bad = j.filter(F.col("_ok") == 0).drop("_ok")
    none = j.filter(F.col("_ok").isNull()).drop("_ok")
    return ok, bad, none


def with_verdict(df: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", ok_col: str = "ok") -> DataFrame:
    """F9 in one pass: one left join adds ``verdict`` = compiled | failed |
    no_verdict (``verdict_split`` gives the three sets as frames)."""
    v = verdicts.select(id_col, F.col(ok_col).alias("_ok"))
    return df.join(v, id_col, "left").withColumn("verdict", verdict_label(F.col("_ok"))).drop("_ok")


def verdict_label(ok_col: Column) -> Column:
    return F.when(ok_col == 1, F.lit("compiled")).when(ok_col == 0, F.lit("failed")).otherwise(F.lit("no_verdict"))


def standard_headers_only(code_col: str) -> Column:
    """every included header is a standard C / C++ header."""
    headers = T.include_headers(code_col)
    return F.size(F.array_except(headers, F.array(*[F.lit(h) for h in K.STD_HEADERS]))) == 0


def object_oriented(tokens_col: str, class_map_col: str | None = None) -> Column:
    """the snippet uses an object-oriented keyword (or declares a class)."""
    words = F.array(*[F.lit(w) for w in K.OOP_WORDS])
    pred = F.arrays_overlap(F.col(tokens_col), words)
    if class_map_col:
        pred = pred | (F.size(class_map_col) > 0)
    return F.coalesce(pred, F.lit(False))
