"""The three end-to-end stages, composed from the operators.

E1 collect:  JSON lines -> language kinds -> escape -> greedy pair dedup
E2 prepare:  line rows -> lex input -> obfuscation -> length filter ->
             vocabulary -> [UNK] filter -> tree distances -> training rows
E3 sample:   training rows of both languages -> ids -> position pairs ->
             split -> 12 vectors per sample

Tables used more than once (the token table, the vocabulary) are
materialised once to the shared checkpoint folder; everything else stays one
lineage for Catalyst to optimise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import dedup as D
from ..operators import encode as EN
from ..operators import filters as FL
from ..operators import tokens as TK
from ..operators import tree as TR
from ..operators import vocab as V
from ..operators.lookup import dictionary
from ..session import materialize, partition_by_key
from ..sources import json_lines as J


@dataclass
class Collected:
    paired: DataFrame      # (rank, c_code, cpp_code)
    unpaired_c: DataFrame  # (rank, code)
    unpaired_cpp: DataFrame
    counters: DataFrame    # (outcome, n)


def collect_stage(lines: DataFrame, order_col: str = "line_no") -> Collected:
    """E1 on ``lines(order_col, value)``: parse, classify, escape (P1), D1."""
    p = J.parse_lines(lines)
    m = F.col("record")
    # a key present with a null value still counts (its text is the word None)
    c_code = F.when(F.map_contains_key(m, "C"), F.coalesce(m["C"], F.lit("None")))
    p_code = F.when(F.map_contains_key(m, "C++"), F.coalesce(m["C++"], F.lit("None")))
    rec = (p.filter(~F.col("malformed"))
           .select(F.col(order_col).alias("rank"), T.escape_newlines(c_code).alias("c_code"),
                   T.escape_newlines(p_code).alias("cpp_code"))
           .filter(F.col("c_code").isNotNull() | F.col("cpp_code").isNotNull()))
    keyed = materialize(rec.withColumn("c_key", T.sha256_hex("c_code")).withColumn("cpp_key", T.sha256_hex("cpp_code")))
    kept = D.greedy_pair_dedup(keyed.select("rank", "c_key", "cpp_key"), "rank", "c_key", "cpp_key")
    rows = keyed.join(kept.select("rank"), "rank", "left_semi")
    outcome = F.when(F.col("malformed"), F.lit("malformed")).otherwise(FL.language_kind(m))
    return Collected(
        paired=rows.filter(F.col("c_code").isNotNull() & F.col("cpp_code").isNotNull()).select("rank", "c_code", "cpp_code"),
        unpaired_c=rows.filter(F.col("cpp_code").isNull()).select("rank", F.col("c_code").alias("code")),
        unpaired_cpp=rows.filter(F.col("c_code").isNull()).select("rank", F.col("cpp_code").alias("code")),
        counters=p.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


def collect_folder_stage(files: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """Folder collection on ``(path, code)``: a seeded sample of ``n`` files (D4),
    simple comment stripping (P3), escaping (P2), and the first file, in path
    order, of each text hash (P13, D2): ``(path, code)``, ready for K1."""
    if n is not None:
        files = D.seeded_sample(files, n, "path", seed)
    rows = files.select("path", T.escape_code(T.strip_comments_simple("code")).alias("code"))
    return D.first_per_key(rows.withColumn("sha", T.sha256_hex("code")), "sha", "path").select("path", "code")


def collect_table_stage(solutions: DataFrame, id_col: str, text_col: str = "text", source: str = "table") -> DataFrame:
    """Hosted-table collection: standard headers injected (P7), one record a
    solution for K3: ``(source, idx, name, code)``."""
    return solutions.select(F.lit(source).alias("source"), F.col(id_col).alias("idx"),
                            F.concat(F.lit("solution_"), F.col(id_col).cast("string"), F.lit(".cpp")).alias("name"),
                            T.inject_headers(text_col).alias("code"))


@dataclass
class Prepared:
    training: DataFrame    # (doc_id, lang, transformed_tokens, dist)
    lexed: DataFrame       # lex rows with the five maps (rows within the length limit)
    vocabulary: DataFrame  # (token, num_rows, count) merged over languages
    ids: DataFrame         # (token, id)
    rejects: DataFrame     # (doc_id, stage, reason)


def prepare_stage(lines: DataFrame, max_tokens: int = K.MAX_TOKENS, min_doc_freq: int = K.MIN_DOC_FREQ,
                  max_unk_ratio: float = K.MAX_UNK_RATIO, with_distances: bool = True,
                  row_cap: int | None = None) -> Prepared:
    """E2 on escaped line rows ``(doc_id, lang, code)``."""
    blank = lines.filter(~FL.non_blank("code")).select("doc_id", F.lit("lex").alias("stage"), F.lit("blank").alias("reason"))
    # one exchange: raw lines by id; everything per document after it is partition-local
    spread = partition_by_key(FL.keep_where(lines, FL.non_blank("code")), "doc_id")
    pre = spread.select("doc_id", "lang", T.lex_input("code").alias("code"))
    empty = FL.keep_where(pre, F.col("code") == "").select(
        "doc_id", F.lit("lex").alias("stage"), F.lit("empty_after_preprocess").alias("reason"))
    raw = pre.select("doc_id", "lang", T.tokenize("code").alias("raw_tokens"))
    raw = materialize(FL.keep_where(raw, F.size("raw_tokens") > 0))
    # F4 before the costly stages: renaming keeps the token count, so rows over
    # the limit are rejected here and never exploded
    too_long = V.over_length(raw, "raw_tokens", max_tokens).select(
        "doc_id", F.lit("analysis").alias("stage"), F.lit("too_long").alias("reason"))
    lexed = materialize(TK.obfuscate(V.length_filter(raw, "raw_tokens", max_tokens), keep_cols=["lang"],
                                     tokens_col="raw_tokens", repartition=False, max_tokens=max_tokens))
    kept = lexed.withColumnRenamed("transformed_tokens", "tokens")
    if row_cap is not None:                     # D9: the first rows of every language
        kept = D.row_cap(kept, row_cap, ["lang"], ["doc_id"], "doc_id")
    vocab = materialize(V.vocabulary(kept))     # all languages at once: both counts are sums (A6)
    final = V.filter_vocabulary(vocab, min_doc_freq)
    # the cleaning stage's output feeds both the kept rows and the rejects: write it once
    # (the final vocabulary holds every alias by its prefix, so rows need not carry their own)
    cleaned = materialize(V.replace_unknown(kept.select("doc_id", "lang", "tokens"), final))
    ok, unk_rejects = V.unknown_ratio_filter(cleaned, max_unk_ratio)
    training = ok.select("doc_id", "lang", F.col("tokens").alias("transformed_tokens"))
    if with_distances:
        training = TR.with_triangles(training, "transformed_tokens")
    rejects = (blank.unionByName(empty).unionByName(too_long)
               .unionByName(unk_rejects.select("doc_id", F.lit("clean").alias("stage"), "reason")))
    return Prepared(training=training, lexed=lexed, vocabulary=vocab, ids=V.token_ids(final), rejects=rejects)


def sample_stage(c_rows: DataFrame, cpp_rows: DataFrame, ids: DataFrame, max_len: int = K.MAX_SEQ_LEN,
                 use_tree_distance: bool = True) -> DataFrame:
    """Encode both languages, pair by position, split, build the 12 vectors."""
    ids = dictionary(ids)                       # one size check for both languages

    def enc(df):
        e = EN.encode_tokens(df.select("doc_id", "transformed_tokens", "dist"), ids)
        return e.select("doc_id", "ids", "dist")
    paired = EN.paired_rows(enc(c_rows), enc(cpp_rows))
    return EN.training_samples(paired, max_len, use_tree_distance, keep_cols=["c_doc_id", "cpp_doc_id"])
