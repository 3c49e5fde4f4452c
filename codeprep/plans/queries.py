"""Registered queries: one Spark callable and (where SQL can say it) one
DuckDB oracle statement per operator group of the inventory.

Every query reads the driver tables (or data Spark derives from them) in
full; nothing is capped except where the limit is the feature (top-k,
sampling).  Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import patterns as R
from ..functions import text as T
from ..operators import ancestry as AN
from ..operators import checks as CH
from ..operators import dedup as D
from ..operators import encode as EN
from ..operators import filters as FL
from ..operators import node_matrix as NM
from ..operators import tokens as TK
from ..operators import tree as TR
from ..operators import uses as U
from ..operators import vocab as V
from ..operators.lookup import dictionary
from ..session import materialize, partition_by_key, spread_if_narrow
from ..sources import json_lines as J
from ..sources.tables import read_table
from . import fixtures as X
from . import pipeline as PL
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Shared inputs
# ---------------------------------------------------------------------------

def prose_tokens(spark: SparkSession, sf_dir: str, by_doc: bool = False) -> DataFrame:
    """documents -> (doc_id, lang, tokens): strip, P4, T1.

    ``by_doc=True`` hash-partitions the raw text by doc_id before the regex
    work, for pipelines whose later steps regroup per document (replace,
    encode, decode reuse it instead of shuffling token arrays).  Otherwise
    the text is only spread when the scan is narrower than the cluster.
    """
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "text"])
    docs = partition_by_key(docs, "doc_id") if by_doc else spread_if_narrow(docs, "doc_id")
    return docs.select("doc_id", "lang", T.tokenize(T.ascii_clean(T.strip_ws("text"))).alias("tokens"))


SQL_PROSE_TOKENS = f"""
  SELECT doc_id, lang, {S.tokenize(S.prose('text'))} AS tokens FROM documents
"""


# ---------------------------------------------------------------------------
# Step 1: minimum slice (flagship) – P4, T1, F4, A1, A5
# ---------------------------------------------------------------------------

@register("token_vocabulary", f"""
WITH d AS ({SQL_PROSE_TOKENS}),
k AS (SELECT doc_id, tokens FROM d WHERE len(tokens) <= {K.MAX_TOKENS}),
o AS (SELECT doc_id, unnest(tokens) AS token FROM k)
SELECT token, count(DISTINCT doc_id) AS num_rows, count(*) AS "count"
FROM o GROUP BY token
""")
def token_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.length_filter(prose_tokens(spark, sf_dir))
    return V.order_vocabulary(V.vocabulary(docs))


# ---------------------------------------------------------------------------
# Step 2: text functions and filters on the code fixtures
# ---------------------------------------------------------------------------


def code_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.code_c(spark, sf_dir).unionByName(X.code_cpp(spark, sf_dir))


SQL_CODE_UNION = f"({X.SQL_CODE_C} UNION ALL {X.SQL_CODE_CPP})"


@register("text_normalise", f"""
SELECT lang, doc_id,
  {S.escape_newlines('code')} AS escaped_lines,
  {S.escape_code('code')} AS escaped_full,
  {S.strip_comments_simple('code')} AS no_comments,
  {S.ascii_clean(S.escape_code('code'))} AS ascii_unescaped,
  sha256({S.escape_code(S.strip_comments_simple('code'))}) AS sha
FROM {SQL_CODE_UNION}
""")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P3, P4, P13 (the collection chain: strip comments, escape, hash)."""
    c = F.col("code")
    return code_union(spark, sf_dir).select(
        "lang", "doc_id",
        T.escape_newlines(c).alias("escaped_lines"),
        T.escape_code(c).alias("escaped_full"),
        T.strip_comments_simple(c).alias("no_comments"),
        T.ascii_clean(T.escape_code(c)).alias("ascii_unescaped"),
        T.sha256_hex(T.escape_code(T.strip_comments_simple(c))).alias("sha"))


@register("document_ascii", f"""
SELECT doc_id, length({S.prose('text')}) AS n_ascii_chars, sha256({S.prose('text')}) AS sha
FROM documents
""")
def document_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 on the documents table (strip, drop non-ASCII, un-escape)."""
    t = T.ascii_clean(T.strip_ws("text"))
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select(
        "doc_id", F.length(t).cast("long").alias("n_ascii_chars"), T.sha256_hex(t).alias("sha"))


@register("include_split", f"""
SELECT lang, doc_id, {S.include_lines('code')} AS includes,
  {S.code_without_includes('code')} AS body,
  {S.include_lines('code')} || chr(10) || chr(10) || {S.code_without_includes('code')} AS rejoined,
  len(list_filter({S.include_headers('code')}, lambda h: NOT list_contains({S.list_lit(K.STD_HEADERS)}, h))) = 0
    AS std_only
FROM {SQL_CODE_UNION}
""")
def include_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, P6, F10."""
    c = F.col("code")
    inc, body = T.include_lines(c), T.code_without_includes(c)
    return code_union(spark, sf_dir).select(
        "lang", "doc_id", inc.alias("includes"), body.alias("body"),
        T.join_includes(inc, body).alias("rejoined"),
        FL.standard_headers_only("code").alias("std_only"))


@register("header_inject", f"""
SELECT doc_id, {S.lit(K.COMMON_HEADERS)} || chr(10) || chr(10) ||
  replace(code, {S.lit(K.ALL_IN_ONE_HEADER)}, '') AS injected
FROM ({X.SQL_CODE_CPP})
""")
def header_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 on the C++ fixture."""
    return X.code_cpp(spark, sf_dir).select("doc_id", T.inject_headers("code").alias("injected"))


@register("clean_stage2", f"""
SELECT lang, doc_id, {S.clean_stage2(S.escape_newlines('code'))} AS cleaned
FROM {SQL_CODE_UNION}
""")
def clean_stage2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 then P8 (the second-stage clean works on escaped lines)."""
    return code_union(spark, sf_dir).select(
        "lang", "doc_id", T.clean_stage2(T.escape_newlines("code")).alias("cleaned"))


@register("comment_resolve", f"""
SELECT lang, doc_id, {S.lex_input_raw('code')} AS resolved,
  {S.lex_input_raw(S.ascii_clean(S.strip_ws(S.escape_newlines('code'))))} AS resolved_from_line
FROM {SQL_CODE_UNION}
""")
def comment_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 on raw files and P15 (strip, P4, P5, P9) on their escaped line form."""
    return code_union(spark, sf_dir).select(
        "lang", "doc_id", T.lex_input_raw("code").alias("resolved"),
        T.lex_input(T.escape_newlines("code")).alias("resolved_from_line"))


@register("url_path_rules", f"""
SELECT page_id,
  replace(replace(url, 'github.com', 'raw.githubusercontent.com'), 'blob/', '') AS raw_url,
  regexp_replace(replace(regexp_replace('./' || regexp_replace(url, '^[a-z]+://', '') || '.cpp', '^\\./', ''),
                         '/', '_'), '\\.cpp$', '') AS flat_name
FROM pages
""")
def url_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, P12 on the page URLs (both are plain string rules)."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    path = F.concat(F.lit("./"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit(".cpp"))
    return pages.select("page_id", T.raw_url("url").alias("raw_url"), T.flatten_path(path).alias("flat_name"))


# ---------------------------------------------------------------------------
# Step 3: statistics, rejects, checks
# ---------------------------------------------------------------------------

@register("length_stats", f"""
WITH d AS ({SQL_PROSE_TOKENS}), n AS (SELECT lang, len(tokens) AS n FROM d)
SELECT lang, count(*) AS n_rows,
  count(*) FILTER (WHERE n <= {K.MAX_TOKENS}) AS n_kept,
  count(*) FILTER (WHERE n > {K.MAX_TOKENS}) AS n_discarded,
  CAST(min(n) FILTER (WHERE n <= {K.MAX_TOKENS}) AS BIGINT) AS min_len,
  CAST(max(n) FILTER (WHERE n <= {K.MAX_TOKENS}) AS BIGINT) AS max_len,
  CAST(sum(n) FILTER (WHERE n <= {K.MAX_TOKENS}) AS BIGINT) AS sum_len,
  CAST(sum(n) FILTER (WHERE n <= {K.MAX_TOKENS}) AS DOUBLE) / count(*) AS avg_ref,
  CAST(sum(n) FILTER (WHERE n <= {K.MAX_TOKENS}) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE n <= {K.MAX_TOKENS}), 0) AS avg_kept,
  CAST(count(*) FILTER (WHERE n > {K.MAX_TOKENS}) AS DOUBLE) / count(*) AS over_share
FROM n GROUP BY lang
""")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3 (discarded count), A4 per language."""
    s = V.length_stats(prose_tokens(spark, sf_dir), group_cols=["lang"])
    return s.withColumn("min_len", F.col("min_len").cast("long")).withColumn("max_len", F.col("max_len").cast("long"))


@register("discarded_rows", f"""
WITH d AS ({SQL_PROSE_TOKENS})
SELECT doc_id, 'analysis' AS stage, 'too_long' AS reason, CAST(len(tokens) AS BIGINT) AS n_tokens
FROM d WHERE len(tokens) > {K.MAX_TOKENS}
""")
def discarded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 list / K8: rejected rows of the analysis stage, keyed by id (Q5)."""
    d = V.over_length(prose_tokens(spark, sf_dir))
    return d.select("doc_id", F.lit("analysis").alias("stage"), F.lit("too_long").alias("reason"),
                    F.size("tokens").cast("long").alias("n_tokens"))


@register("analysis_balance", f"""
WITH d AS ({SQL_PROSE_TOKENS})
SELECT count(*) AS n_input, count(*) FILTER (WHERE len(tokens) <= {K.MAX_TOKENS}) AS n_kept,
  count(*) FILTER (WHERE len(tokens) > {K.MAX_TOKENS}) AS n_rejected, true AS balanced
FROM d
""")
def analysis_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: rejects + kept = input for the analysis stage."""
    d = prose_tokens(spark, sf_dir)
    return CH.balance(d, V.length_filter(d), V.over_length(d))


# ---------------------------------------------------------------------------
# Step 6: dedup, sampling, search, verdicts
# ---------------------------------------------------------------------------

@register("exact_dedup", f"""
SELECT doc_id, lang, source, sha, escaped_length FROM (
  SELECT doc_id, lang, source, sha256(escaped) AS sha, length(escaped) AS escaped_length,
    row_number() OVER (PARTITION BY sha256(escaped) ORDER BY doc_id) AS rn
  FROM (SELECT doc_id, lang, source, {S.escape_code(S.strip_comments_simple('text'))} AS escaped FROM documents))
WHERE rn = 1
""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document, as a row, per hash of its text
    without comments and escaped."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "text"]).withColumn(
        "escaped", T.escape_code(T.strip_comments_simple("text")))
    rows = d.select("doc_id", "lang", "source", T.sha256_hex("escaped").alias("sha"),
                    F.length("escaped").cast("long").alias("escaped_length"))
    return D.first_per_key(rows, "sha", "doc_id")


@register("duplicate_multiplicity", """
WITH k AS (SELECT sha256(text) AS sha, count(*) AS copies FROM documents GROUP BY 1)
SELECT copies, count(*) AS n_keys FROM k GROUP BY copies
""")
def duplicate_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: how many texts occur once, twice, ... times."""
    d = read_table(spark, sf_dir, "documents", ["text"]).select(T.sha256_hex("text").alias("sha"))
    return D.multiplicity(d, "sha")


@register("seeded_sample", """
SELECT doc_id FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100
""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents without replacement, seed 7 (the limit is the feature)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    return D.seeded_sample(d, 100, "doc_id", seed=7)


@register("verdict_split", """
SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'compiled' WHEN l.quality = 0 THEN 'failed'
  ELSE 'no_verdict' END AS verdict
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def verdict_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compiled / failed / no verdict, with ``labels.quality`` as the verdict."""
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality"]).withColumnRenamed("quality", "ok")
    return FL.with_verdict(d, lab).select("doc_id", "verdict")


@register("exclusion_filter", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def exclusion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: drop listed documents (the list: documents labelled toxic)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    ex = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]).filter(F.col("toxic") == 1)
    return FL.exclude_ids(d, ex)


def _sql_contains(seq: list) -> str:
    return f"contains(joined, chr(1) || {' || chr(1) || '.join(S.lit(t) for t in seq)} || chr(1))"


def sql_hits() -> str:
    rows = " UNION ALL ".join(f"SELECT {S.lit(q)} AS keyword, doc_id FROM joined WHERE {_sql_contains(seq)}" for q, seq in K.SEARCH_PANEL.items())
    return f"""
  SELECT keyword, doc_id, row_number() OVER (PARTITION BY keyword ORDER BY doc_id DESC) AS hit_rank
  FROM (WITH joined AS (SELECT doc_id, chr(1) || array_to_string({S.tokenize('code')}, chr(1)) || chr(1) AS joined
                        FROM ({X.SQL_CODE_CPP})) {rows})
"""


SQL_HITS = sql_hits()


@register("keyword_search", f"""
SELECT keyword, doc_id, hit_rank FROM ({SQL_HITS}) WHERE hit_rank <= {K.KEYWORD_HITS}
""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query of the panel the 1000 newest snippets (recency = doc_id)
    that contain its tokens in a row, over the whole C++ corpus."""
    docs = spread_if_narrow(X.code_cpp(spark, sf_dir), "doc_id").select("doc_id", T.tokenize("code").alias("tokens"))
    hits = D.panel_hits(docs, K.SEARCH_PANEL, "doc_id", "tokens", "doc_id", K.KEYWORD_HITS)
    return hits.select("keyword", "doc_id", F.col("hit_rank").cast("long").alias("hit_rank"))


@register("accepted_files", f"""
SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS file_idx,
  'file_' || CAST(row_number() OVER (ORDER BY doc_id DESC) - 1 AS VARCHAR) AS file_name
FROM (SELECT DISTINCT doc_id FROM ({SQL_HITS}) WHERE hit_rank <= {K.KEYWORD_HITS})
ORDER BY doc_id DESC LIMIT {K.FILE_CAP}
""")
def accepted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 + D7: distinct hit documents, newest first, capped, numbered file_0..."""
    hits = materialize(keyword_search(spark, sf_dir).select("doc_id").distinct())    # numbering reads them several times
    capped = D.capped(hits, K.FILE_CAP, [F.col("doc_id").desc()], "doc_id")
    out = D.number_files(capped, [F.col("doc_id").desc()])
    return out.select("doc_id", F.col("file_idx").cast("long").alias("file_idx"), "file_name")


@register("corpus_union", """
WITH u AS (
  SELECT 0 AS src_idx, 'documents' AS source, doc_id AS orig_id, text FROM documents
  UNION ALL SELECT 1, 'conversations', conv_id * 1000 + turn, text FROM conversations
  UNION ALL SELECT 2, 'benchmark', item_id, text FROM benchmark)
SELECT row_number() OVER (ORDER BY src_idx, orig_id) - 1 AS doc_id, source, orig_id, sha256(text) AS sha
FROM u
""")
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corpus from three tables with a fresh consecutive id."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"]).withColumnRenamed("item_id", "doc_id")
    u = D.union_sources([("documents", docs), ("conversations", conv), ("benchmark", bench)])
    return u.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                    F.col("orig_id").cast("long").alias("orig_id"), T.sha256_hex("text").alias("sha"))


SQL_SEQUENTIAL_DEDUP = f"""
WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id, c_key, cpp_key
                     FROM ({X.SQL_PAIR_KEYS})),
walk(rn, seen_c, seen_p, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[])
  UNION ALL
  SELECT r.rn,
    CASE WHEN ok AND r.c_key IS NOT NULL THEN list_append(w.seen_c, r.c_key) ELSE w.seen_c END,
    CASE WHEN ok AND r.cpp_key IS NOT NULL THEN list_append(w.seen_p, r.cpp_key) ELSE w.seen_p END,
    CASE WHEN ok THEN list_append(w.kept, r.doc_id) ELSE w.kept END
  FROM walk w JOIN r ON r.rn = w.rn + 1,
  LATERAL (SELECT (r.c_key IS NULL OR NOT list_contains(w.seen_c, r.c_key))
              AND (r.cpp_key IS NULL OR NOT list_contains(w.seen_p, r.cpp_key)) AS ok)),
kept AS (SELECT unnest(kept) AS doc_id FROM walk WHERE rn = (SELECT max(rn) FROM r))
SELECT k.doc_id, CASE WHEN p.c_key IS NOT NULL AND p.cpp_key IS NOT NULL THEN 'pair'
                      WHEN p.c_key IS NOT NULL THEN 'c' ELSE 'cpp' END AS kind
FROM kept k JOIN ({X.SQL_PAIR_KEYS}) p ON k.doc_id = p.doc_id
"""


@register("pair_dedup", SQL_SEQUENTIAL_DEDUP)
def pair_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy two-key dedup in input order, computed in parallel rounds.
    The oracle is the sequential rule itself: a recursive walk over the rows
    in order carrying the two seen-key lists."""
    rows = X.pair_keys(spark, sf_dir)
    kept = D.greedy_pair_dedup(rows.withColumnRenamed("doc_id", "rank"), "rank", "c_key", "cpp_key")
    return kept.select(F.col("rank").alias("doc_id"), D.pair_kind(F.col("c_key"), F.col("cpp_key")).alias("kind"))


@register("pair_counts", f"""
SELECT kind, count(*) AS n_unique FROM ({SQL_SEQUENTIAL_DEDUP}) GROUP BY kind
""")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique pairs / singles after D1."""
    return pair_dedup(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n_unique"))


# ---------------------------------------------------------------------------
# Step 2 (sources): JSON lines with language keys
# ---------------------------------------------------------------------------

def json_lines_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per document; the key set depends on the language, and
    the lines of one source get a stray leading character (malformed, whole
    text kept)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "text"])
    t = F.col("text")
    rec = (F.when(F.col("lang") == "en", F.create_map(F.lit("C"), t))
           .when(F.col("lang") == "fr", F.create_map(F.lit("C++"), t))
           .when(F.col("lang") == "de", F.create_map(F.lit("C"), t, F.lit("C++"), t))
           .otherwise(F.create_map(F.lit("Java"), t)))
    line = F.to_json(rec)
    line = F.when(F.col("source") == "src3", F.concat(F.lit("x"), line)).otherwise(line)
    return d.select("doc_id", line.alias("value"))


SQL_JSON_LINES = """
  SELECT doc_id, CASE WHEN source = 'src3' THEN 'x' || j ELSE j END AS value
  FROM (SELECT doc_id, source, CAST(CASE lang WHEN 'en' THEN json_object('C', text)
                     WHEN 'fr' THEN json_object('C++', text)
                     WHEN 'de' THEN json_object('C', text, 'C++', text)
                     ELSE json_object('Java', text) END AS VARCHAR) AS j FROM documents)
"""

SQL_JSON_PARSED = f"""
  SELECT doc_id, value, CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' ELSE false END AS ok FROM ({SQL_JSON_LINES})
"""


@register("json_records", f"""
WITH p AS ({SQL_JSON_PARSED}),
k AS (SELECT doc_id, ok,
        CASE WHEN ok THEN json_exists(value, '$."C"') ELSE false END AS has_c,
        CASE WHEN ok THEN json_exists(value, '$."C++"') ELSE false END AS has_cpp,
        CASE WHEN ok THEN json_extract_string(value, '$."C"') END AS c_code,
        CASE WHEN ok THEN json_extract_string(value, '$."C++"') END AS cpp_code
      FROM p)
SELECT doc_id, NOT ok AS malformed,
  CASE WHEN NOT ok THEN NULL WHEN has_c AND has_cpp THEN 'pair' WHEN has_c THEN 'c'
       WHEN has_cpp THEN 'cpp' ELSE 'none' END AS kind,
  sha256({S.escape_newlines('c_code')}) AS c_sha, sha256({S.escape_newlines('cpp_code')}) AS cpp_sha
FROM k
""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + F3 + P1: parse JSON lines, classify by language keys, escape code."""
    p = J.parse_lines(json_lines_from_documents(spark, sf_dir))
    m = F.col("record")
    return p.select("doc_id", "malformed",
                    F.when(~F.col("malformed"), FL.language_kind(m)).alias("kind"),
                    T.sha256_hex(T.escape_newlines(m["C"])).alias("c_sha"),
                    T.sha256_hex(T.escape_newlines(m["C++"])).alias("cpp_sha"))


@register("json_run_counters", f"""
WITH r AS (SELECT CASE WHEN NOT ok THEN 'malformed'
    WHEN json_exists(value, '$."C"') AND json_exists(value, '$."C++"') THEN 'pair'
    WHEN json_exists(value, '$."C"') THEN 'c' WHEN json_exists(value, '$."C++"') THEN 'cpp'
    ELSE 'none' END AS outcome FROM ({SQL_JSON_PARSED}))
SELECT outcome, count(*) AS n FROM r GROUP BY outcome
""")
def json_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: processed / malformed / per-kind counters of the JSON scan."""
    p = J.parse_lines(json_lines_from_documents(spark, sf_dir))
    outcome = F.when(F.col("malformed"), F.lit("malformed")).otherwise(FL.language_kind(F.col("record")))
    return p.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Step 4: tokenization and obfuscation on the code fixtures
# ---------------------------------------------------------------------------


def sql_obfuscate(src: str, prepared: bool = False, final_select: bool = True) -> str:
    """DuckDB form of T1–T11 over ``src(doc_id, code)`` (raw source files, or
    already prepared lex input with ``prepared=True``).  With
    ``final_select=False`` only the CTE list is returned (ending in ``res``)."""
    ident = S.lit(R.IDENT_FULL_RE)
    code = "code" if prepared else S.lex_input_raw("code")
    ctes = f"""
src AS ({src}),
tk AS (SELECT doc_id, {S.tokenize(code)} AS toks FROM src),
occ0 AS (SELECT doc_id, generate_subscripts(toks, 1) AS i, unnest(toks) AS tok, toks FROM tk),
occ AS (SELECT doc_id, i - 1 AS pos, tok,
          CASE WHEN i > 1 THEN toks[i - 1] END AS prev,
          CASE WHEN i < len(toks) THEN toks[i + 1] END AS nxt FROM occ0),
cls AS (SELECT *, CASE
          WHEN tok IN {S.in_list(K.KEYWORDS)} THEN 'keep'
          WHEN tok IN {S.in_list(K.SPECIAL_NAMES)} THEN 'keep'
          WHEN prev IN ('class', 'struct') AND regexp_matches(tok, {ident}) THEN prev
          WHEN tok IN {S.in_list(K.TYPE_WORDS)} THEN 'keep'
          WHEN tok IN {S.in_list(K.STD_FUNCTIONS)} THEN 'keep'
          WHEN regexp_matches(tok, {S.lit(R.LITERAL_START_RE)}) THEN 'lit'
          WHEN regexp_matches(tok, {ident}) THEN 'name'
          ELSE 'keep' END AS kind FROM occ),
ent0 AS (SELECT doc_id, tok,
          min(pos) FILTER (WHERE kind = 'lit') AS f_lit,
          min(pos) FILTER (WHERE kind = 'name') AS f_plain,
          min(pos) FILTER (WHERE kind = 'name' AND nxt = '(') AS f_plain_call,
          min(pos) FILTER (WHERE kind = 'struct') AS f_struct,
          min(pos) FILTER (WHERE kind = 'class') AS f_class
        FROM cls WHERE kind <> 'keep' GROUP BY doc_id, tok),
ent1 AS (SELECT *, CASE WHEN f_plain IS NOT NULL
          AND NOT (coalesce(f_struct < f_plain, false) OR coalesce(f_class < f_plain, false))
          THEN CASE WHEN f_plain = f_plain_call THEN 'func' ELSE 'var' END END AS vf_cls FROM ent0),
ent AS (SELECT *,
  CASE WHEN f_lit IS NOT NULL THEN 'lit' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f_lit NULLS LAST, tok) - 1 AS VARCHAR) END AS a_lit,
  CASE WHEN f_struct IS NOT NULL THEN 'struct' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f_struct NULLS LAST, tok) - 1 AS VARCHAR) END AS a_struct,
  CASE WHEN f_class IS NOT NULL THEN 'class' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f_class NULLS LAST, tok) - 1 AS VARCHAR) END AS a_class,
  CASE WHEN vf_cls IS NOT NULL THEN vf_cls || CAST(row_number() OVER (PARTITION BY doc_id, vf_cls ORDER BY f_plain NULLS LAST, tok) - 1 AS VARCHAR) END AS a_vf
  FROM ent1),
res AS (SELECT c.doc_id, c.pos, c.tok, CASE
          WHEN c.kind = 'lit' THEN e.a_lit WHEN c.kind = 'struct' THEN e.a_struct
          WHEN c.kind = 'class' THEN e.a_class
          WHEN c.kind = 'name' THEN CASE WHEN e.a_vf IS NOT NULL THEN e.a_vf
                                          WHEN e.f_struct < c.pos THEN e.a_struct ELSE e.a_class END
        END AS alias
        FROM cls c LEFT JOIN ent e ON c.doc_id = e.doc_id AND c.tok = e.tok)"""
    if not final_select:
        return ctes
    return "WITH " + ctes + f""",
toks_out AS (SELECT doc_id, string_agg({S.strip_token('coalesce(alias, tok)')}, ' ' ORDER BY pos) AS tokens_text,
                    count(*) AS n_tokens FROM res GROUP BY doc_id),
maps AS (SELECT doc_id,
  string_agg(tok || '=' || a_vf, ',' ORDER BY f_plain) FILTER (WHERE vf_cls = 'var') AS var_map,
  string_agg(tok || '=' || a_vf, ',' ORDER BY f_plain) FILTER (WHERE vf_cls = 'func') AS func_map,
  string_agg(tok || '=' || a_lit, ',' ORDER BY f_lit) FILTER (WHERE a_lit IS NOT NULL) AS lit_map,
  string_agg(tok || '=' || a_struct, ',' ORDER BY f_struct) FILTER (WHERE a_struct IS NOT NULL) AS struct_map,
  string_agg(tok || '=' || a_class, ',' ORDER BY f_class) FILTER (WHERE a_class IS NOT NULL) AS class_map
  FROM ent GROUP BY doc_id)
SELECT t.doc_id, t.tokens_text, t.n_tokens, coalesce(m.var_map, '') AS var_map,
  coalesce(m.func_map, '') AS func_map, coalesce(m.lit_map, '') AS lit_map,
  coalesce(m.struct_map, '') AS struct_map, coalesce(m.class_map, '') AS class_map
FROM toks_out t LEFT JOIN maps m ON t.doc_id = m.doc_id
"""


def _map_text(c: str) -> Column:
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def obfuscated_view(lexed: DataFrame) -> DataFrame:
    return lexed.select("doc_id", F.array_join("transformed_tokens", " ").alias("tokens_text"),
                        F.size("transformed_tokens").cast("long").alias("n_tokens"),
                        *[_map_text(m).alias(m.replace("_dict", "_map")) for m in TK.MAP_COLS])


def lexed_code(df: DataFrame) -> DataFrame:
    """P5 + P9, then T1–T11; the text is spread before the lexer's regexes."""
    df = spread_if_narrow(df, "doc_id")
    return TK.obfuscate(df.select("doc_id", T.lex_input_raw("code").alias("code")))


@register("obfuscate_c", sql_obfuscate(X.SQL_CODE_C))
def obfuscate_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1–T11 on the C fixture (struct names, functions, literals)."""
    return obfuscated_view(lexed_code(X.code_c(spark, sf_dir)))


@register("obfuscate_cpp", sql_obfuscate(X.SQL_CODE_CPP))
def obfuscate_cpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1–T11 on the C++ fixture (classes, methods, std names)."""
    return obfuscated_view(lexed_code(X.code_cpp(spark, sf_dir)))


def sql_uses() -> str:
    """DuckDB form of ``uses.obfuscate_uses`` over the programs of varied scopes."""
    ident = S.lit(R.IDENT_FULL_RE)

    def last_at(cond):
        return f"coalesce(max(CASE WHEN {cond} THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)"

    firsts = ", ".join(f"min(CASE WHEN kind = '{c}' THEN pos END) OVER t AS f_{c}" for c in U.NAME_CLASSES)
    numbers = ", ".join(f"count(CASE WHEN names = '{c}' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS n_{c}" for c in U.NAME_CLASSES)
    number = " ".join(f"WHEN '{c}' THEN max(CASE WHEN names = '{c}' THEN n_{c} END) OVER t - 1" for c in U.NAME_CLASSES)
    maps = ", ".join(f"coalesce(string_agg(CASE WHEN names = '{c}' THEN tok || '=' || alias END, ',' ORDER BY pos), '') AS {c}_map" for c in U.NAME_CLASSES)
    return f"""
WITH tk AS (SELECT doc_id, {S.tokenize(S.lex_input_raw('code'))} AS toks FROM ({X.SQL_CODE_SCOPES})),
occ AS (SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS tok FROM tk),
seen AS (SELECT *, coalesce(lag(tok) OVER w, '') AS prev, coalesce(lag(tok, 2) OVER w, '') AS prev2, coalesce(lead(tok) OVER w, '') AS nxt,
  sum(CASE tok WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS depth,
  {last_at("tok IN (';', '{', '}')")} AS brk, {last_at("tok IN " + S.in_list(U.OUTER_WORDS))} AS outr, {last_at("tok = '('")} AS opn,
  {last_at("tok = ')'")} AS cls, {last_at("tok IN " + S.in_list(U.EXPRESSION_STARTS))} AS expr
  FROM occ WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
opened AS (SELECT *, CASE WHEN tok = '{{' THEN CASE WHEN (outr > brk AND opn <= brk AND expr <= brk) OR prev2 = 'extern' THEN 0 ELSE 1 END END AS opens FROM seen),
placed AS (SELECT *, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id, depth ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS infn FROM opened),
told AS (SELECT *, expr <= brk AND (NOT infn OR opn <= brk) AS quiet FROM placed),
decl AS (SELECT *, nxt <> '::' AND (prev IN {S.in_list(U.TYPE_ENDS)} OR (regexp_matches(prev, {ident}) AND prev NOT IN {S.in_list(U.NOT_TYPES)})
  OR (prev IN ('*', '&', '>') AND (prev2 IN {S.in_list(U.TYPE_ENDS)} OR quiet))) AS declared FROM told),
kinds AS (SELECT doc_id, pos, tok, nxt, CASE
  WHEN tok IN {S.in_list(K.KEYWORDS + K.SPECIAL_NAMES)} THEN 'keep'
  WHEN prev IN ('class', 'struct') AND regexp_matches(tok, {ident}) THEN prev
  WHEN tok IN {S.in_list(K.TYPE_WORDS + K.STD_FUNCTIONS)} THEN 'keep'
  WHEN regexp_matches(tok, {S.lit(R.LITERAL_START_RE)}) THEN 'lit'
  WHEN NOT regexp_matches(tok, {ident}) THEN 'keep'
  WHEN prev IN ('.', '->') THEN 'var'
  WHEN NOT infn AND nxt = '(' AND (declared OR (prev = '::' AND quiet AND prev2 <> tok)) THEN 'func'
  WHEN declared THEN 'var'
  WHEN prev IN (':', ',') AND nxt IN ('(', '{{') AND NOT infn AND cls > brk THEN 'init'
  ELSE 'ref' END AS kind FROM decl),
firsts AS (SELECT *, {firsts}, min(CASE WHEN kind IN ('ref', 'init') THEN pos END) OVER t AS f_ref,
  min(CASE WHEN kind = 'ref' AND nxt = '(' THEN pos END) OVER t AS f_call FROM kinds WINDOW t AS (PARTITION BY doc_id, tok)),
early AS (SELECT *, f_ref IS NOT NULL AND coalesce(f_ref < least(f_var, f_func, f_struct, f_class), true) AS unnamed,
  coalesce(f_ref = f_call, false) AS call FROM firsts),
based AS (SELECT * EXCLUDE (f_var, f_func), least(f_var, CASE WHEN unnamed AND NOT call THEN f_ref END) AS f_var,
  least(f_func, CASE WHEN unnamed AND call THEN f_ref END) AS f_func FROM early),
used AS (SELECT *, CASE WHEN kind IN ('ref', 'init') THEN CASE WHEN f_var <= pos THEN 'var' WHEN f_func <= pos THEN 'func'
  WHEN f_struct < pos THEN 'struct' WHEN f_class < pos THEN 'class' END WHEN kind <> 'keep' THEN kind END AS use_class FROM based),
named AS (SELECT *, CASE WHEN pos = CASE use_class WHEN 'var' THEN f_var WHEN 'func' THEN f_func WHEN 'lit' THEN f_lit
  WHEN 'struct' THEN f_struct WHEN 'class' THEN f_class END THEN use_class END AS names FROM used),
counted AS (SELECT *, {numbers} FROM named),
res AS (SELECT *, use_class || CAST(CASE use_class {number} END AS VARCHAR) AS alias FROM counted WINDOW t AS (PARTITION BY doc_id, tok))
SELECT doc_id, string_agg({S.strip_token('coalesce(alias, tok)')}, ' ' ORDER BY pos) AS tokens_text, count(*) AS n_tokens, {maps}
FROM res GROUP BY doc_id
"""


@register("name_uses", sql_uses())
def name_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7, T8 with a class for each use, on programs of varied scopes."""
    src = X.code_scopes(spark, sf_dir).select("doc_id", T.lex_input_raw("code").alias("code"))
    return obfuscated_view(U.obfuscate_uses(src))


_DIRS = S.in_list(K.DIRECTIVE_WORDS)


@register("token_merges", f"""
WITH t AS (SELECT lang, doc_id, {S.tokenize('code')} AS toks FROM {SQL_CODE_UNION})
SELECT lang, doc_id,
  array_to_string(list_filter(list_transform(toks, lambda x, i:
     CASE WHEN x = '#' AND toks[i + 1] IN {_DIRS} THEN '#' || toks[i + 1]
          WHEN i > 1 AND toks[i - 1] = '#' AND x IN {_DIRS} THEN NULL ELSE x END),
     lambda y: y IS NOT NULL), ' ') AS merged_text,
  CAST(len(list_filter(toks, lambda y: {S.strip_ws('y')} <> '')) AS BIGINT) AS n_leaf
FROM t
""")
def token_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14 (``#`` + directive word), T16 (non-blank leaves), P14 (join)."""
    code = spread_if_narrow(code_union(spark, sf_dir), "doc_id")
    toks = code.select("lang", "doc_id", T.tokenize("code").alias("tokens"))
    return toks.select("lang", "doc_id", T.join_tokens(TK.merge_directives(F.col("tokens"))).alias("merged_text"),
                       F.size(TK.leaf_tokens(F.col("tokens"))).cast("long").alias("n_leaf"))


@register("literal_merge", f"""
SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos, unnest(toks) AS token
FROM (SELECT doc_id, {S.tokenize(S.lex_input_raw('code'))} AS toks FROM ({X.SQL_CODE_C}))
""")
def literal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal pieces (quote, content, escapes, quote) merged back into
    one token per literal; equals the lexer's own tokens."""
    merged = TK.merge_literal_pieces(TK.literal_pieces(code_c_tokens(spark, sf_dir)), ordered=True)
    return merged.select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


@register("restore_names", f"""
SELECT doc_id, len({S.tokenize(S.lex_input_raw('code'))}) AS n_tokens, true AS round_trip
FROM ({X.SQL_CODE_CPP})
""")
def restore_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases mapped back to names reproduce the lexer's tokens."""
    src = spread_if_narrow(X.code_cpp(spark, sf_dir), "doc_id").select("doc_id", T.lex_input_raw("code").alias("code"))
    lexed = TK.obfuscate(src, keep_cols=["code"])
    r = TK.restore_names(lexed, partitioned=True)
    r = r.select("doc_id", "restored_tokens", T.tokenize("code").alias("orig"))
    return r.select("doc_id", F.size("orig").cast("long").alias("n_tokens"),
                    (F.col("restored_tokens") == F.col("orig")).alias("round_trip"))


@register("oop_filter", f"""
SELECT lang, doc_id, list_has_any({S.tokenize(S.lex_input_raw('code'))}, {S.list_lit(K.OOP_WORDS)}) AS is_oop
FROM {SQL_CODE_UNION}
""")
def oop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object-oriented content flag."""
    t = code_union(spark, sf_dir).select("lang", "doc_id", T.tokenize(T.lex_input_raw("code")).alias("tokens"))
    return t.select("lang", "doc_id", FL.object_oriented("tokens").alias("is_oop"))


# ---------------------------------------------------------------------------
# Step 5 and 7: vocabulary, [UNK], ids, encoding, splits
# ---------------------------------------------------------------------------


SQL_KEPT = f"SELECT doc_id, lang, tokens FROM ({SQL_PROSE_TOKENS}) WHERE len(tokens) <= {K.MAX_TOKENS}"


def sql_vocab(where: str = "") -> str:
    return f"""SELECT token, count(DISTINCT doc_id) AS num_rows, count(*) AS "count"
      FROM (SELECT doc_id, unnest(tokens) AS token FROM ({SQL_KEPT}) {where}) GROUP BY token"""


SQL_FINAL_VOCAB = f"""
  SELECT token FROM ({sql_vocab()})
  WHERE num_rows >= {K.MIN_DOC_FREQ} OR regexp_matches(token, '^({'|'.join(K.ALIAS_PREFIXES)})')
"""
SQL_IDS = f"""
  SELECT token, CAST(row_number() OVER (ORDER BY token) + 3 AS BIGINT) AS id
  FROM ({SQL_FINAL_VOCAB}) WHERE token <> '' AND token NOT IN {S.in_list(K.SPECIAL_TOKENS)}
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{t}', CAST({i} AS BIGINT))" for i, t in enumerate(K.SPECIAL_TOKENS))})
    AS s(token, id)
"""


def kept_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenized documents of at most 1000 tokens, materialised once (they feed
    the vocabulary and the per-document steps)."""
    return materialize(V.length_filter(prose_tokens(spark, sf_dir, by_doc=True)))


def final_vocab(spark: SparkSession, sf_dir: str, kept: DataFrame | None = None) -> DataFrame:
    k = kept if kept is not None else kept_docs(spark, sf_dir)
    return V.filter_vocabulary(V.vocabulary(k))


@register("vocab_merged", f"""
SELECT token, CAST(sum(num_rows) AS BIGINT) AS num_rows, CAST(sum("count") AS BIGINT) AS "count" FROM (
  {" UNION ALL ".join(sql_vocab(f"WHERE lang = '{x}'") for x in ("de", "en", "es", "fr"))}) GROUP BY token
""")
def vocab_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-language vocabularies (one pass over all languages) summed."""
    return V.merge_vocabularies(V.vocabulary(kept_docs(spark, sf_dir), group_cols=["lang"]))


@register("token_ids", SQL_IDS)
def token_ids(spark: SparkSession, sf_dir: str, kept: DataFrame | None = None) -> DataFrame:
    """F5 + C3: frequency-thresholded vocabulary with ids after the 4 specials."""
    return V.token_ids(final_vocab(spark, sf_dir, kept))


@register("unk_filter", f"""
WITH o AS (SELECT doc_id, unnest(tokens) AS token FROM ({SQL_KEPT})),
fv AS ({SQL_FINAL_VOCAB}),
c AS (SELECT o.doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE fv.token IS NULL) AS n_unk
      FROM o LEFT JOIN fv ON o.token = fv.token GROUP BY o.doc_id)
SELECT doc_id, n_tokens, n_unk,
  n_tokens > 0 AND CAST(n_unk AS DOUBLE) / n_tokens <= {K.MAX_UNK_RATIO} AS kept
FROM c
""")
def unk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[UNK] replacement, counts and the ratio filter."""
    k = kept_docs(spark, sf_dir)
    r = V.replace_unknown(k.select("doc_id", "tokens"), final_vocab(spark, sf_dir, k))
    kept, rejects = V.unknown_ratio_filter(r)
    return (kept.select("doc_id", "n_tokens", "n_unk", F.lit(True).alias("kept"))
            .unionByName(rejects.select("doc_id", "n_tokens", "n_unk", F.lit(False).alias("kept"))))


@register("decode_round_trip", f"""
WITH o AS (SELECT doc_id, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM ({SQL_KEPT})),
ids AS ({SQL_IDS})
SELECT o.doc_id, string_agg(CASE WHEN ids.id IS NULL THEN '[UNK]' ELSE o.token END, ' ' ORDER BY o.pos) AS decoded_text
FROM o LEFT JOIN ids ON o.token = ids.token GROUP BY o.doc_id
""")
def decode_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 then C13: encode to ids and decode back ([UNK] for unknown tokens)."""
    k = kept_docs(spark, sf_dir)
    ids = token_ids(spark, sf_dir, k)
    ids = dictionary(ids)                                     # one size check for both ways
    enc = EN.encode_tokens(k.select("doc_id", "tokens"), ids, tokens_col="tokens")
    dec = EN.decode_ids(enc.select("doc_id", "ids"), ids)
    return dec.select("doc_id", F.array_join("decoded", " ").alias("decoded_text"))


def _pair_sql() -> str:
    enc_list = "list_concat([2], {x}, list_transform(range(greatest({m} - len({x}), 0)), lambda z: 0), [3])"
    c_enc = enc_list.format(x="cids", m=K.MAX_SEQ_LEN)
    p_enc = enc_list.format(x="pids", m=K.MAX_SEQ_LEN)
    return f"""
WITH o AS (SELECT doc_id, lang, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM ({SQL_KEPT})),
ids AS ({SQL_IDS}),
enc AS (SELECT o.doc_id, o.lang, list(coalesce(ids.id, 1) ORDER BY o.pos) AS ids
        FROM o LEFT JOIN ids ON o.token = ids.token GROUP BY o.doc_id, o.lang),
c AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, ids FROM enc WHERE lang = 'en'),
p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, ids FROM enc WHERE lang = 'fr'),
pairs AS (SELECT c.position, c.doc_id AS c_doc_id, p.doc_id AS cpp_doc_id, c.ids AS cids, p.ids AS pids
          FROM c JOIN p ON c.position = p.position),
e AS (SELECT position, c_doc_id, cpp_doc_id, {c_enc} AS ce, {p_enc} AS pe,
        CAST(floor((CAST(1 AS DOUBLE) - CAST({K.VAL_RATIO} AS DOUBLE) - CAST({K.TEST_RATIO} AS DOUBLE))
                   * (SELECT count(*) FROM pairs)) AS BIGINT) AS vs,
        CAST(floor((CAST(1 AS DOUBLE) - CAST({K.TEST_RATIO} AS DOUBLE)) * (SELECT count(*) FROM pairs)) AS BIGINT) AS ts
      FROM pairs)
SELECT CAST(position AS BIGINT) AS position,
  CASE WHEN position < vs THEN 'train' WHEN position < ts THEN 'val' ELSE 'test' END AS split,
  c_doc_id, cpp_doc_id,
  array_to_string(ce, ',') AS c_enc, array_to_string(pe, ',') AS cpp_enc,
  array_to_string(list_concat([2], ce[1:len(ce) - 1]), ',') AS c_dec,
  array_to_string(list_concat([2], pe[1:len(pe) - 1]), ',') AS cpp_dec,
  CAST(len(list_filter(ce, lambda z: z <> 0)) AS BIGINT) AS c_mask_sum,
  CAST(len(list_filter(list_concat([2], ce[1:len(ce) - 1]), lambda z: z <> 0)) AS BIGINT) AS c_dec_mask_sum,
  CAST(len(list_filter(pe, lambda z: z <> 0)) AS BIGINT) AS cpp_mask_sum,
  CAST(len(list_filter(list_concat([2], pe[1:len(pe) - 1]), lambda z: z <> 0)) AS BIGINT) AS cpp_dec_mask_sum
FROM e
"""


@register("encode_pairs", _pair_sql())
def encode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4–C11: encode both languages (en as source, fr as target), pair row k
    with row k, split by position, frame/pad, shift, masks."""
    k = kept_docs(spark, sf_dir)
    ids = dictionary(token_ids(spark, sf_dir, k))            # one size check for both languages
    en, fr = (k.filter(F.col("lang") == lang).select("doc_id", "tokens") for lang in ("en", "fr"))
    paired = EN.encoded_pairs(en, fr, ids)
    s = EN.training_samples(paired.withColumn("c_dist", F.array()).withColumn("cpp_dist", F.array()),
                            keep_cols=["c_doc_id", "cpp_doc_id"])

    def txt(c):
        return F.array_join(F.col(c), ",")

    def total(c):
        return F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select(F.col("position").cast("long").alias("position"), "split",
                    "c_doc_id", "cpp_doc_id",
                    txt("c_encoder_ids").alias("c_enc"), txt("cpp_encoder_ids").alias("cpp_enc"),
                    txt("c_decoder_ids").alias("c_dec"), txt("cpp_decoder_ids").alias("cpp_dec"),
                    total("c_encoder_mask").alias("c_mask_sum"), total("c_decoder_mask").alias("c_dec_mask_sum"),
                    total("cpp_encoder_mask").alias("cpp_mask_sum"),
                    total("cpp_decoder_mask").alias("cpp_dec_mask_sum"))


# ---------------------------------------------------------------------------
# Step 8: tree distance
# ---------------------------------------------------------------------------


SQL_CLOSURE = f"""
  nodes AS ({X.SQL_TREE_NODES}),
  clo(node_id, anc_id, dist) AS (
    SELECT node_id, node_id, 0 FROM nodes
    UNION ALL
    SELECT c.node_id, n.parent_id, c.dist + 1 FROM clo c JOIN nodes n ON c.anc_id = n.node_id
    WHERE n.parent_id IS NOT NULL)
"""

SQL_SUPPLIER_NATION_PAIRS = """
  SELECT DISTINCT 's' || CAST(l.l_suppkey AS VARCHAR) AS a, 'n' || CAST(c.c_nationkey AS VARCHAR) AS b
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
"""


@register("tree_lca", f"""
WITH RECURSIVE {SQL_CLOSURE},
pairs AS ({SQL_SUPPLIER_NATION_PAIRS}),
common AS (SELECT p.a, p.b, ca.anc_id, ca.dist + cb.dist AS d FROM pairs p
           JOIN clo ca ON ca.node_id = p.a JOIN clo cb ON cb.node_id = p.b AND cb.anc_id = ca.anc_id),
best AS (SELECT a, b, arg_min(anc_id, d) AS lca, min(d) AS tree_dist FROM common GROUP BY a, b)
SELECT p.a, p.b, best.lca, coalesce(best.tree_dist, -1) AS tree_dist
FROM pairs p LEFT JOIN best ON p.a = best.a AND p.b = best.b
""")
def tree_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestor index of root/region/nation/supplier, then the LCA and
    distance of every (supplier, customer nation) pair that trades."""
    index = AN.ancestor_index(X.tree_nodes(spark, sf_dir))
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    pairs = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
             .select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"),
                     F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("b")).distinct())
    return AN.pair_ancestors(pairs, index).withColumn("tree_dist", F.col("tree_dist").cast("int"))


@register("tree_ancestors", f"WITH RECURSIVE {SQL_CLOSURE} SELECT node_id, anc_id, dist FROM clo")
def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: every node of root/region/nation/supplier with each of its ancestors."""
    return TR.ancestor_closure(X.tree_nodes(spark, sf_dir))


@register("order_supplier_lca", f"""
WITH RECURSIVE {SQL_CLOSURE},
m AS (SELECT DISTINCT l_orderkey AS set_id, 's' || CAST(l_suppkey AS VARCHAR) AS node_id FROM lineitem),
sz AS (SELECT set_id, count(*) AS n FROM m GROUP BY set_id),
dep AS (SELECT node_id AS anc_id, max(dist) AS depth FROM clo GROUP BY node_id),
cnt AS (SELECT m.set_id, clo.anc_id, count(*) AS c FROM m JOIN clo ON m.node_id = clo.node_id
        GROUP BY m.set_id, clo.anc_id),
ok AS (SELECT cnt.set_id, cnt.anc_id, dep.depth FROM cnt JOIN sz ON cnt.set_id = sz.set_id AND cnt.c = sz.n
       JOIN dep ON cnt.anc_id = dep.anc_id)
SELECT sz.set_id, (SELECT arg_max(anc_id, depth) FROM ok WHERE ok.set_id = sz.set_id) AS lca FROM sz
""")
def order_supplier_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest common ancestor of the suppliers of each order."""
    index = AN.ancestor_index(X.tree_nodes(spark, sf_dir))
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey"])
    members = li.select(F.col("l_orderkey").alias("set_id"),
                        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node_id"))
    return AN.set_ancestors(members, index)


def code_c_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays of the C fixture, spread first if the scan is narrow (the
    distance UDF after it is the CPU-heavy part)."""
    code = spread_if_narrow(X.code_c(spark, sf_dir), "doc_id")
    return code.select("doc_id", T.tokenize(T.lex_input_raw("code")).alias("tokens"))


SQL_CODE_C_TOKENS = f"SELECT doc_id, {S.tokenize(S.lex_input_raw('code'))} AS toks FROM ({X.SQL_CODE_C})"

def sql_triangle(tokens_cte: str) -> str:
    """CTEs computing the bracket-tree triangle in SQL from ``tk(doc_id, toks)``:
    levels by a running window sum, the running minimum per start token by
    a second window, distances by joining the leaf depths back."""
    return f"""
  tk AS ({tokens_cte}),
  t AS (SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS tok FROM tk),
  s AS (SELECT doc_id, pos, CASE WHEN tok IN {S.in_list(K.OPEN_BRACKETS)} THEN 1
                               WHEN tok IN {S.in_list(K.CLOSE_BRACKETS)} THEN -1 ELSE 0 END AS step FROM t),
  l AS (SELECT doc_id, pos, step,
          sum(step) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h FROM s),
  dd AS (SELECT doc_id, pos, h, h - step + CASE WHEN step = 1 THEN 1 ELSE 0 END + 1 AS d FROM l),
  pr AS (SELECT a.doc_id, a.pos AS i, b.pos AS k, b.h AS hk FROM dd a JOIN dd b
         ON a.doc_id = b.doc_id AND b.pos >= a.pos),
  rm AS (SELECT doc_id, i, k, min(hk) OVER (PARTITION BY doc_id, i ORDER BY k ROWS UNBOUNDED PRECEDING) AS m
         FROM pr),
  tri AS (SELECT rm.doc_id, rm.i, rm.k + 1 AS j, di.d + dj.d - 2 * rm.m AS dist FROM rm
          JOIN dd di ON di.doc_id = rm.doc_id AND di.pos = rm.i
          JOIN dd dj ON dj.doc_id = rm.doc_id AND dj.pos = rm.k + 1)
"""


SQL_TRIANGLE = sql_triangle(SQL_CODE_C_TOKENS)


def _pair_distances_sql() -> str:
    vectors = [f"{pre}_{part}_dist" for pre in ("c", "cpp") for part in ("encoder", "decoder")]
    cols = ", ".join(f"CAST(coalesce({v[:v.index('_')]}d.n, 0) AS INTEGER) AS {v}_n, "
                     f"sha256(coalesce({v[:v.index('_')]}d.s, '')) AS {v}_sha" for v in vectors)
    return f"""
WITH {sql_triangle(f"SELECT doc_id, tokens AS toks FROM ({SQL_KEPT}) WHERE lang IN ('en', 'fr')")},
agg AS (SELECT doc_id, count(*) AS n, string_agg(CAST(dist AS VARCHAR), ',' ORDER BY i, j) AS s FROM tri GROUP BY doc_id),
c AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id FROM ({SQL_KEPT}) WHERE lang = 'en'),
p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id FROM ({SQL_KEPT}) WHERE lang = 'fr')
SELECT CAST(c.position AS BIGINT) AS position, c.doc_id AS c_doc_id, p.doc_id AS cpp_doc_id, {cols}
FROM c JOIN p ON c.position = p.position LEFT JOIN agg cd ON cd.doc_id = c.doc_id LEFT JOIN agg cppd ON cppd.doc_id = p.doc_id
"""


@register("encode_pair_distances", _pair_distances_sql())
def encode_pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11 with G6: length and digest of the four distance vectors of each
    sample of ``encode_pairs``; the triangles are made behind the pairing, so
    none is moved or made for a row without a partner."""
    k = kept_docs(spark, sf_dir)
    ids = dictionary(token_ids(spark, sf_dir, k))            # one size check for both languages
    en, fr = (k.filter(F.col("lang") == lang).select("doc_id", "tokens") for lang in ("en", "fr"))
    paired = TR.with_triangles(EN.encoded_pairs(en, fr, ids), ("c_tokens", "cpp_tokens"), ("c_dist", "cpp_dist"))
    s = EN.training_samples(paired, keep_cols=["c_doc_id", "cpp_doc_id"])
    vectors = [f"{pre}_{part}_dist" for pre in ("c", "cpp") for part in ("encoder", "decoder")]

    def text(v):                   # the JSON of whole numbers in its brackets: comma-joined without a string a number
        return F.btrim(F.to_json(v), F.lit("[]"))
    return s.select(F.col("position").cast("long").alias("position"), "c_doc_id", "cpp_doc_id",
                    *[x for v in vectors for x in (F.size(v).alias(f"{v}_n"), F.sha2(text(v), 256).alias(f"{v}_sha"))])


@register("tree_distance_triangle", f"""
WITH {SQL_TRIANGLE},
agg AS (SELECT doc_id, count(*) AS n_dist, string_agg(CAST(dist AS VARCHAR), ',' ORDER BY i, j) AS dist_text
        FROM tri GROUP BY doc_id)
SELECT tk.doc_id, CAST(len(tk.toks) AS INTEGER) AS n_tokens, CAST(coalesce(agg.n_dist, 0) AS INTEGER) AS n_dist,
  coalesce(agg.dist_text, '') AS dist_text,
  CAST(floor((1 + sqrt(1 + 8 * coalesce(agg.n_dist, 0))) / 2) AS INTEGER) AS n_from_triangle,
  coalesce(agg.n_dist, 0) = len(tk.toks) * (len(tk.toks) - 1) / 2 AS triangle_ok
FROM tk LEFT JOIN agg ON tk.doc_id = agg.doc_id
""")
def tree_distance_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6 (bracket-tree distances, upper triangle), G8 and V1 on the C fixture."""
    t = code_c_tokens(spark, sf_dir)
    d = TR.with_triangles(t)
    n = F.size("tokens")
    return d.select("doc_id", n.alias("n_tokens"), F.size("dist").alias("n_dist"),
                    F.array_join("dist", ",").alias("dist_text"),
                    TR.tokens_from_triangle(F.size("dist")).alias("n_from_triangle"),
                    (F.size("dist").cast("long") == n.cast("long") * (n.cast("long") - 1) / 2).alias("triangle_ok"))


@register("triangle_lookup", f"""
WITH {SQL_TRIANGLE},
n AS (SELECT doc_id, len(toks) AS n FROM tk)
SELECT n.doc_id,
  CAST((SELECT dist FROM tri WHERE tri.doc_id = n.doc_id AND i = 0 AND j = n.n - 1) + 1000 AS INTEGER) AS v_first_last,
  CAST(-(SELECT dist FROM tri WHERE tri.doc_id = n.doc_id AND i = 0 AND j = n.n - 1) + 1000 AS INTEGER) AS v_last_first,
  0 AS v_diag,
  CAST((SELECT dist FROM tri WHERE tri.doc_id = n.doc_id AND i = 1 AND j = 4) + 1000 AS INTEGER) AS v_1_4
FROM n
""")
def triangle_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random access to the distances with sign and offset; (i, i) -> 0.
    By range minima, so no row needs its triangle."""
    t = TR.with_range_minima(code_c_tokens(spark, sf_dir))
    n = F.size("tokens")
    look = lambda i, j: TR.distance_lookup(F.col("depth"), F.col("minima"), i, j)
    return t.select("doc_id", look(F.lit(0), n - 1).alias("v_first_last"),
                    look(n - 1, F.lit(0)).alias("v_last_first"), look(F.lit(3), F.lit(3)).alias("v_diag"),
                    look(F.lit(1), F.lit(4)).alias("v_1_4"))


@register("baseline_distances", f"""
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens,
  array_to_string(flatten(list_transform(range(0, len(toks) - 1),
      lambda i: list_transform(range(i + 1, len(toks)), lambda j: j - i))), ',') AS dist_text
FROM ({SQL_CODE_C_TOKENS})
""")
def baseline_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative positions ``j - i`` in triangle order (the baseline)."""
    t = code_c_tokens(spark, sf_dir)
    n = F.size("tokens")
    return t.select("doc_id", n.alias("n_tokens"), F.array_join(EN.baseline_distances(n), ",").alias("dist_text"))


# ---------------------------------------------------------------------------
# Step 9: the preparation pipeline end to end
# ---------------------------------------------------------------------------


SQL_CODE_LINES = f"""
  SELECT doc_id * 2 AS doc_id, 'c' AS lang, CASE WHEN doc_id % 40 = 1 THEN '  ' WHEN doc_id % 40 = 2 THEN '// a comment alone'
    WHEN doc_id % 200 = 3 THEN 'int main() {{ int x = 0;' || repeat(' x = x + 1;', 200) || ' }}'
    ELSE {S.escape_newlines('code')} END AS code FROM ({X.SQL_CODE_C})
  UNION ALL
  SELECT doc_id * 2 + 1 AS doc_id, 'cpp' AS lang, {S.escape_newlines('code')} AS code FROM ({X.SQL_CODE_CPP})
"""


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both code fixtures as escaped line rows (doc ids made distinct); some C
    rows are blank, comments alone, or over the token limit."""
    k = F.col("doc_id")
    varied = (F.when(k % 40 == 1, F.lit("  ")).when(k % 40 == 2, F.lit("// a comment alone"))
              .when(k % 200 == 3, F.concat(F.lit("int main() { int x = 0;"), F.repeat(F.lit(" x = x + 1;"), 200), F.lit(" }")))
              .otherwise(T.escape_newlines("code")))
    c = X.code_c(spark, sf_dir).select((k * 2).alias("doc_id"), "lang", varied.alias("code"))
    p = X.code_cpp(spark, sf_dir).select((F.col("doc_id") * 2 + 1).alias("doc_id"), "lang",
                                         T.escape_newlines("code").alias("code"))
    return c.unionByName(p)


def _sql_prepare() -> str:
    ob = sql_obfuscate(f"""SELECT doc_id, {S.lex_input('code')} AS code FROM lines
                          WHERE {S.strip_ws('code')} <> '' AND {S.lex_input('code')} <> ''""",
                       prepared=True, final_select=False)
    prefix = "|".join(K.ALIAS_PREFIXES)
    return f"""
WITH lines AS ({SQL_CODE_LINES}),
{ob},
doc AS (SELECT doc_id, count(*) AS n FROM res GROUP BY doc_id),
kept AS (SELECT r.* FROM res r JOIN doc ON r.doc_id = doc.doc_id WHERE doc.n <= {K.MAX_TOKENS}),
ko AS (SELECT doc_id, pos, coalesce(alias, tok) AS t, alias IS NOT NULL AS is_alias FROM kept),
voc AS (SELECT t AS token, count(DISTINCT doc_id) AS num_rows FROM ko GROUP BY t),
fv AS (SELECT token FROM voc WHERE num_rows >= {K.MIN_DOC_FREQ} OR regexp_matches(token, '^({prefix})')),
marked AS (SELECT ko.doc_id, ko.pos, CASE WHEN fv.token IS NOT NULL OR ko.is_alias THEN {S.strip_token('ko.t')}
                  ELSE '[UNK]' END AS t2, fv.token IS NULL AND NOT ko.is_alias AS unk
           FROM ko LEFT JOIN fv ON ko.t = fv.token),
agg AS (SELECT doc_id, string_agg(t2, ' ' ORDER BY pos) AS tokens_text, count(*) AS n,
          count(*) FILTER (WHERE unk) AS n_unk FROM marked GROUP BY doc_id)
SELECT doc_id, CASE WHEN CAST(n_unk AS DOUBLE) / n > {K.MAX_UNK_RATIO} THEN 'unk_ratio' ELSE 'kept' END AS outcome,
  CASE WHEN CAST(n_unk AS DOUBLE) / n > {K.MAX_UNK_RATIO} THEN NULL ELSE tokens_text END AS tokens_text,
  CASE WHEN CAST(n_unk AS DOUBLE) / n > {K.MAX_UNK_RATIO} THEN NULL ELSE CAST(n * (n - 1) / 2 AS INTEGER) END AS n_dist
FROM agg
UNION ALL SELECT doc_id, 'too_long', NULL, NULL FROM doc WHERE n > {K.MAX_TOKENS}
UNION ALL SELECT doc_id, 'blank', NULL, NULL FROM lines WHERE {S.strip_ws('code')} = ''
UNION ALL SELECT doc_id, 'empty_after_preprocess', NULL, NULL FROM lines
  WHERE {S.strip_ws('code')} <> '' AND {S.lex_input('code')} = ''
"""


@register("prepare_code", _sql_prepare())
def prepare_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 end to end on both code fixtures as escaped line files: lex input,
    obfuscation, length filter, merged vocabulary, [UNK] filter, distances."""
    p = PL.prepare_stage(code_lines(spark, sf_dir))
    kept = p.training.select("doc_id", F.lit("kept").alias("outcome"),
                             F.array_join("transformed_tokens", " ").alias("tokens_text"),
                             F.size("dist").alias("n_dist"))
    rej = p.rejects.select("doc_id", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("tokens_text"),
                           F.lit(None).cast("int").alias("n_dist"))
    return kept.unionByName(rej)


@register("row_cap_per_language", f"""
SELECT lang, doc_id FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
WHERE rn <= {K.ROW_CAP}
""")
def row_cap_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50,000 rows of every language, as a distributed cut."""
    d = read_table(spark, sf_dir, "documents", ["lang", "doc_id"])
    return D.row_cap(d, K.ROW_CAP, ["lang"], ["doc_id"], "doc_id").select("lang", "doc_id")


@register("analysis_summary", f"""
WITH d AS ({SQL_PROSE_TOKENS}),
v AS (SELECT count(DISTINCT t) AS vocab_size FROM (SELECT unnest(tokens) AS t FROM d WHERE len(tokens) <= {K.MAX_TOKENS}))
SELECT (SELECT vocab_size FROM v) AS vocab_size,
  (SELECT count(*) FROM d WHERE len(tokens) > {K.MAX_TOKENS}) AS n_discarded
""")
def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: vocabulary size and number of discarded rows (one row, two aggregates
    unioned and summed: no join)."""
    d = prose_tokens(spark, sf_dir)
    vocab = V.vocabulary(V.length_filter(d))
    a = vocab.select(F.lit(1).cast("long").alias("vocab_size"), F.lit(0).cast("long").alias("n_discarded"))
    b = V.over_length(d).select(F.lit(0).cast("long").alias("vocab_size"), F.lit(1).cast("long").alias("n_discarded"))
    return a.unionByName(b).agg(F.coalesce(F.sum("vocab_size"), F.lit(0)).cast("long").alias("vocab_size"),
                                F.coalesce(F.sum("n_discarded"), F.lit(0)).cast("long").alias("n_discarded"))


# --- fixed values: HTML elements without a closing tag (leaves of the tag tree) ---
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
TAG_RE = "<[^>]*>"
VOID_RE = "^<(" + "|".join(VOID_TAGS) + ")[ >/]|^<!|/>$"


def page_tag_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> (doc_id, tokens): every tag becomes ``(`` (open), ``)`` (close)
    or ``x`` (void element, comment, doctype), so the tag tree is the bracket tree."""
    pages = spread_if_narrow(read_table(spark, sf_dir, "pages", ["page_id", "html"]), "page_id")
    tags = F.regexp_extract_all(F.col("html"), F.lit(TAG_RE), 0)
    kinds = F.transform(tags, lambda t: F.when(t.startswith("</"), F.lit(")"))
                        .when(t.rlike(VOID_RE), F.lit("x")).otherwise(F.lit("(")))
    return pages.select(F.col("page_id").alias("doc_id"), kinds.alias("tokens"))


SQL_PAGE_TAGS = f"""
  SELECT page_id AS doc_id, list_transform(regexp_extract_all(html, {S.lit(TAG_RE)}, 0),
    lambda t: CASE WHEN starts_with(t, '</') THEN ')' WHEN regexp_matches(t, {S.lit(VOID_RE)}) THEN 'x'
                   ELSE '(' END) AS toks
  FROM pages
"""


@register("page_tag_distances", f"""
WITH {sql_triangle(SQL_PAGE_TAGS)},
agg AS (SELECT doc_id, count(*) AS n_dist, CAST(sum(dist) AS BIGINT) AS dist_sum, max(dist) AS dist_max,
          md5(string_agg(CAST(dist AS VARCHAR), ',' ORDER BY i, j)) AS dist_md5 FROM tri GROUP BY doc_id)
SELECT tk.doc_id AS page_id, CAST(len(tk.toks) AS INTEGER) AS n_tags, CAST(coalesce(agg.n_dist, 0) AS INTEGER) AS n_dist,
  agg.dist_sum, CAST(agg.dist_max AS INTEGER) AS dist_max, coalesce(agg.dist_md5, md5('')) AS dist_md5
FROM tk LEFT JOIN agg ON tk.doc_id = agg.doc_id
""")
def page_tag_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6 on real pages: distances between the tags of every page in its tag tree
    (open / close tags as brackets; unbalanced tags are allowed)."""
    t = page_tag_brackets(spark, sf_dir)
    d = TR.with_triangles(t)
    total = F.aggregate(F.col("dist"), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(F.col("doc_id").alias("page_id"), F.size("tokens").alias("n_tags"),
                    F.size("dist").alias("n_dist"),
                    F.when(F.size("dist") > 0, total).alias("dist_sum"),
                    F.array_max("dist").alias("dist_max"),
                    F.md5(F.array_join("dist", ",")).alias("dist_md5"))


def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> (page_id, pos, opens, node, parent): one row a tag.  ``level`` is
    the number of open elements before the tag; the innermost of them is the
    last tag that opened this level.  It is the parent of an element and the
    node of a closing tag; comments and doctypes have no node."""
    pages = partition_by_key(read_table(spark, sf_dir, "pages", ["page_id", "html"]), "page_id")
    tags = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.col("html"), F.lit(TAG_RE), 0)).alias("pos", "tag"))
    closes, leaf = F.col("tag").startswith("</"), F.col("tag").rlike(VOID_RE)
    step = F.when(closes, -1).when(leaf, 0).otherwise(1)
    rows = tags.select("page_id", "pos", closes.alias("closes"), F.col("tag").startswith("<!").alias("none"), step.alias("step"))
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("level", F.sum("step").over(before) - F.col("step"))
    # each tag looks its level up; an opening tag stands for the next level too
    both = rows.select("page_id", "pos", "closes", "none", F.explode(F.when(F.col("step") == 1, F.array(F.col("level"), F.col("level") + 1))
                                                                     .otherwise(F.array("level"))).alias("at"), "level")
    here = F.col("at") == F.col("level")
    last = Window.partitionBy("page_id", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("open", F.last(F.when(~here, F.col("pos")), ignorenulls=True).over(last)).filter(here)
    return found.select("page_id", "pos", (~F.col("closes") & ~F.col("none")).alias("element"),
                        F.when(F.col("closes"), F.col("open")).when(~F.col("none"), F.col("pos")).alias("node"), F.col("open").alias("parent"))


@register("page_tag_matrix", f"""
WITH RECURSIVE t AS (
  SELECT page_id, CAST(generate_subscripts(tags, 1) - 1 AS INTEGER) AS pos, unnest(tags) AS tag
  FROM (SELECT page_id, regexp_extract_all(html, {S.lit(TAG_RE)}, 0) AS tags FROM pages)),
s AS (SELECT page_id, pos, starts_with(tag, '</') AS closes, starts_with(tag, '<!') AS none,
        CASE WHEN starts_with(tag, '</') THEN -1 WHEN regexp_matches(tag, {S.lit(VOID_RE)}) THEN 0 ELSE 1 END AS step FROM t),
l AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY pos) - step AS level FROM s),
o AS (SELECT a.page_id, a.pos, any_value(a.closes) AS closes, any_value(a.none) AS none, max(b.pos) AS open FROM l a
      LEFT JOIN l b ON b.page_id = a.page_id AND b.pos < a.pos AND b.step = 1 AND b.level + 1 = a.level GROUP BY a.page_id, a.pos),
tok AS (SELECT page_id, pos, CASE WHEN closes THEN open WHEN NOT none THEN pos END AS node FROM o),
nodes AS (SELECT page_id, pos AS node, open AS parent FROM o WHERE NOT closes AND NOT none),
clo(page_id, node, anc, dist) AS (
  SELECT page_id, node, node, 0 FROM nodes
  UNION ALL
  SELECT c.page_id, c.node, n.parent, c.dist + 1 FROM clo c JOIN nodes n ON n.page_id = c.page_id AND n.node = c.anc WHERE n.parent IS NOT NULL),
d AS (SELECT a.page_id, a.node AS a, b.node AS b, min(a.dist + b.dist) AS dist FROM clo a JOIN clo b ON a.page_id = b.page_id AND a.anc = b.anc GROUP BY ALL),
m AS (SELECT x.page_id, x.pos AS i, y.pos AS j, x.node, coalesce(d.dist, -1) AS dist FROM tok x JOIN tok y ON x.page_id = y.page_id
      LEFT JOIN d ON d.page_id = x.page_id AND d.a = x.node AND d.b = y.node)
SELECT page_id, i, CAST(count(*) AS INTEGER) AS n_tags, CAST(count(*) FILTER (dist < 0) AS INTEGER) AS n_none, max(dist) AS dist_max,
  CAST(sum(dist) AS BIGINT) AS dist_sum, md5(string_agg(CAST(dist AS VARCHAR), ',' ORDER BY j)) AS dist_md5 FROM m GROUP BY page_id, i
""")
def page_tag_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 on real pages: each tag's distances to all tags of its page in the
    page's element tree, a node table; -1 for comments, doctypes and closing
    tags without an open element."""
    tags = materialize(page_tags(spark, sf_dir))
    nodes = tags.filter("element").select(F.col("page_id").alias("doc_id"), F.col("pos").alias("node_id"), F.col("parent").alias("parent_id"))
    tokens = tags.select(F.col("page_id").alias("doc_id"), "pos", F.col("node").alias("node_id"))
    total = F.aggregate("dist", F.lit(0).cast("long"), lambda a, x: a + x)
    return NM.distance_matrix(nodes, tokens).select(
        F.col("doc_id").alias("page_id"), "i", F.size("dist").alias("n_tags"), (F.size("dist") - F.size(F.array_remove("dist", -1))).alias("n_none"),
        F.array_max("dist").alias("dist_max"), total.alias("dist_sum"), F.md5(F.array_join("dist", ",").cast("binary")).alias("dist_md5"))


@register("event_props", """
SELECT event_id,
  NOT (CASE WHEN json_valid(props) THEN json_type(props) = 'OBJECT' ELSE false END) AS malformed,
  CAST(json_array_length(json_keys(props)) AS INTEGER) AS n_keys,
  json_extract_string(props, '$.k') AS k_text
FROM events
""")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 on plain JSON objects of another table: parse ``events.props`` as a
    string map (a number keeps its JSON text, e.g. ``5``)."""
    e = read_table(spark, sf_dir, "events", ["event_id", "props"])
    rec = J.parse_record(F.col("props"))
    return e.select("event_id", rec.isNull().alias("malformed"), F.size(F.map_keys(rec)).alias("n_keys"),
                    rec["k"].alias("k_text"))
