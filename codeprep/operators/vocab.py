"""Vocabulary, length statistics, [UNK] replacement and id assignment.

A1–A8, F4–F6, C1–C3.  Token columns are ``array<string>``; documents are
keyed by an id column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import constants as K
from ..session import materialize, partition_by_key
from .filters import keep_where
from .lookup import Dictionary, dictionary, list_of, map_lists, places_in
from .numbering import consecutive_index


def length_filter(docs: DataFrame, tokens_col: str = "tokens", max_tokens: int = K.MAX_TOKENS) -> DataFrame:
    """keep rows with at most ``max_tokens`` tokens (array size, before any
    explode; the tokenizer is evaluated once, see ``filters.keep_where``)."""
    return keep_where(docs, F.size(tokens_col) <= max_tokens)


def over_length(docs: DataFrame, tokens_col: str = "tokens", max_tokens: int = K.MAX_TOKENS) -> DataFrame:
    """F4 complement: the discarded rows."""
    return keep_where(docs, F.size(tokens_col) > max_tokens)


def vocabulary(docs: DataFrame, tokens_col: str = "tokens", group_cols: list | None = None) -> DataFrame:
    """A1: ``token, num_rows, count`` – rows containing the token, total
    occurrences; with ``group_cols`` one vocabulary a group (a language), in the same pass.

    One exploded stream carries ``(tok, 1, 0)`` per occurrence and
    ``(tok, 0, 1)`` per distinct token of a row, so a single partial+final
    aggregation gives both numbers: one shuffle, hot tokens absorbed
    map-side, no ``count(DISTINCT)`` expansion.
    """
    toks = F.col(tokens_col)
    stream = F.concat(
        F.transform(toks, lambda t: F.struct(t.alias("token"), F.lit(1).alias("c"), F.lit(0).alias("r"))),
        F.transform(F.array_distinct(toks), lambda t: F.struct(t.alias("token"), F.lit(0).alias("c"), F.lit(1).alias("r"))),
    )
    groups = list(group_cols or [])
    return (docs.select(*groups, F.inline(stream))
            .groupBy(*groups, "token")
            .agg(F.sum("r").cast("long").alias("num_rows"), F.sum("c").cast("long").alias("count")))


def order_vocabulary(vocab: DataFrame) -> DataFrame:
    """A5: by document frequency, descending; ties by token."""
    return vocab.orderBy(F.col("num_rows").desc(), F.col("token"))


def length_stats(docs: DataFrame, tokens_col: str = "tokens", max_tokens: int = K.MAX_TOKENS,
                 group_cols: list | None = None) -> DataFrame:
    """A2–A4: min / max / mean length of kept rows, discarded count, over-long share.

    ``avg_ref`` divides the kept tokens by *all* rows, as the reference's
    log does (Q4); ``avg_kept`` divides by the kept rows.
    """
    n = F.size(tokens_col)
    kept = n <= max_tokens
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(kept, 1)).alias("n_kept"),
        F.count(F.when(~kept, 1)).alias("n_discarded"),
        F.min(F.when(kept, n)).alias("min_len"),
        F.max(F.when(kept, n)).alias("max_len"),
        F.sum(F.when(kept, n)).cast("long").alias("sum_len"),
    ]
    g = docs.groupBy(*(group_cols or [])).agg(*aggs)
    return (g.withColumn("avg_ref", F.try_divide(F.col("sum_len").cast("double"), F.col("n_rows")))
             .withColumn("avg_kept", F.try_divide(F.col("sum_len").cast("double"), F.col("n_kept")))
             .withColumn("over_share", F.try_divide(F.col("n_discarded").cast("double"), F.col("n_rows"))))


def merge_vocabularies(*vocabs: DataFrame) -> DataFrame:
    """Concatenate per-language vocabularies, sum both counts per token."""
    u = vocabs[0]
    for v in vocabs[1:]:
        u = u.unionByName(v)
    return u.groupBy("token").agg(F.sum("num_rows").cast("long").alias("num_rows"),
                                  F.sum("count").cast("long").alias("count"))


def alias_prefix_match(col="token") -> F.Column:
    """Q17: prefix test without digits, so ``class``, ``struct``, ``variable`` match too."""
    return F.col(col).rlike("^(" + "|".join(K.ALIAS_PREFIXES) + ")")


def filter_vocabulary(vocab: DataFrame, min_doc_freq: int = K.MIN_DOC_FREQ) -> DataFrame:
    """keep tokens seen in at least ``min_doc_freq`` rows, or obfuscated names."""
    return vocab.filter((F.col("num_rows") >= min_doc_freq) | alias_prefix_match("token"))


def token_ids(final_vocab: DataFrame, spark=None) -> DataFrame:
    """``[PAD] [UNK] [SOS] [EOS]`` = 0..3, then tokens in code-point order from 4.

    Numbering uses the range-partitioned helper, not a single-task window.
    """
    spark = spark or final_vocab.sparkSession
    toks = (final_vocab.select("token").filter(F.col("token") != "")
            .filter(~F.col("token").isin(K.SPECIAL_TOKENS)).distinct())
    numbered = consecutive_index(toks, [F.col("token")], out_col="id", start=len(K.SPECIAL_TOKENS))
    specials = spark.createDataFrame([(t, i) for i, t in enumerate(K.SPECIAL_TOKENS)], "token string, id long")
    # the id table is read by every encode / decode: write it once
    return materialize(specials.unionByName(numbered.select("token", F.col("id").cast("long").alias("id"))))


def replace_unknown(docs: DataFrame, vocab: DataFrame | Dictionary, id_col: str = "doc_id",
                    tokens_col: str = "tokens", alias_col: str | None = None,
                    out_col: str = "tokens", partitioned: bool = False) -> DataFrame:
    """C1 + A7: tokens outside the vocabulary (and not an alias of their own
    row) become ``[UNK]``; adds ``n_tokens`` and ``n_unk``.

    A vocabulary within the bounds of the size check is looked up inside the
    row, without an exchange; a larger one by ``_replace_exploded``, which
    takes ``id_col`` and ``partitioned=True`` for ``docs`` already
    hash-partitioned by id.
    """
    v = vocab if isinstance(vocab, Dictionary) else dictionary(vocab.select("token").distinct())
    if not v.small:
        return _replace_exploded(docs, v.table, id_col, tokens_col, alias_col, out_col, partitioned)
    words = v.arrays("token")

    def made(rows, tokens, sizes):
        known = pc.is_valid(places_in(tokens, words.value[0])).to_numpy(zero_copy_only=False).copy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        if alias_col:
            aliases, ends = rows.column(rows.schema.names.index(alias_col)), np.cumsum(sizes)
            for r in np.unique(row[~known]):
                own, first = set(aliases[int(r)].as_py() or ()) - {None}, int(ends[r] - sizes[r])
                for at in first + np.flatnonzero(~known[first:ends[r]]):
                    known[at] = tokens[int(at)].as_py() in own
        out = pc.if_else(pa.array(known), tokens, pa.scalar(K.UNK_TOKEN, tokens.type))
        return [list_of(sizes, out), pa.array(np.bincount(row[~known], minlength=len(sizes)), pa.int64())]

    fields = [Ty.StructField(out_col, Ty.ArrayType(Ty.StringType())), Ty.StructField("n_unk", Ty.LongType())]
    return map_lists(docs, tokens_col, fields, made, drop=(tokens_col, out_col)) \
        .withColumn("n_tokens", F.size(out_col).cast("long"))


def _replace_exploded(docs: DataFrame, vocab: DataFrame, id_col: str, tokens_col: str, alias_col: str | None,
                      out_col: str, partitioned: bool) -> DataFrame:
    """``replace_unknown`` for a vocabulary of any size: documents are
    hash-partitioned by id once, the exploded tokens joined, and collected
    again in order."""
    v = vocab.select(F.col("token").alias("_vtok")).distinct().withColumn("_known", F.lit(True))
    keep = [c for c in docs.columns if c not in (tokens_col, out_col)]
    base = docs if partitioned else partition_by_key(docs, id_col)
    rows = base.select(id_col, F.posexplode(tokens_col).alias("_pos", "_tok"),
                       *([F.col(alias_col).alias("_aliases")] if alias_col else []))
    joined = rows.join(v, rows["_tok"] == v["_vtok"], "left")
    known = F.col("_known").isNotNull()
    if alias_col:
        known = known | F.coalesce(F.array_contains("_aliases", F.col("_tok")), F.lit(False))
    out_tok = F.when(known, F.col("_tok")).otherwise(F.lit(K.UNK_TOKEN))
    per_doc = (joined.groupBy(id_col)
               .agg(F.array_sort(F.collect_list(F.struct(F.col("_pos"), out_tok.alias("t")))).alias("_s"),
                    F.count(F.when(~known, 1)).alias("n_unk")))
    per_doc = per_doc.select(id_col, F.transform("_s", lambda x: x["t"]).alias(out_col), "n_unk")
    return (base.select(*keep).join(per_doc, id_col, "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), F.array().cast("array<string>")))
            .withColumn("n_unk", F.coalesce(F.col("n_unk"), F.lit(0)).cast("long"))
            .withColumn("n_tokens", F.size(out_col).cast("long")))


def unknown_ratio_filter(docs: DataFrame, max_ratio: float = K.MAX_UNK_RATIO) -> tuple[DataFrame, DataFrame]:
    """keep rows with ``n_unk / n_tokens <= max_ratio`` (strict ``>`` drops).

    Returns ``(kept, rejects)``; empty rows (a division by zero in the
    reference) are rejected with reason ``empty``.
    """
    ratio = F.try_divide(F.col("n_unk").cast("double"), F.col("n_tokens"))
    ok = (F.col("n_tokens") > 0) & (ratio <= F.lit(max_ratio))
    kept = docs.filter(ok)
    rejects = docs.filter(~ok).withColumn(
        "reason", F.when(F.col("n_tokens") == 0, F.lit("empty")).otherwise(F.lit("unk_ratio")))
    return kept, rejects
