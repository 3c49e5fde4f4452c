"""Deduplication, pairing, sampling and search.

Hot-key rule: one text may be copied into a third of all rows.  Every
operator here therefore reduces a key group with a partial (map-side)
aggregate before anything is shuffled, and never sorts a whole key group
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .numbering import consecutive_index


# ---------------------------------------------------------------------------
# Hash dedup and multiplicity
# ---------------------------------------------------------------------------

def first_per_key(df: DataFrame, key_col: str, order_col: str) -> DataFrame:
    """Keep the earliest row (by ``order_col``) of every key.

    ``min_by`` over the whole row is a partial aggregate: each map task keeps
    one row per key, so a key copied a billion times costs one row per task
    in the shuffle.
    """
    cols = df.columns
    return (df.groupBy(key_col)
            .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("_r"))
            .select("_r.*"))


def multiplicity(df: DataFrame, key_col: str) -> DataFrame:
    """D3: ``copies, n_keys`` – how many keys occur exactly ``copies`` times."""
    per_key = df.groupBy(key_col).agg(F.count(F.lit(1)).alias("copies"))
    return per_key.groupBy("copies").agg(F.count(F.lit(1)).alias("n_keys"))


# ---------------------------------------------------------------------------
# Greedy two-key dedup in input order
# ---------------------------------------------------------------------------

def _split(rows: DataFrame, c: str, p: str) -> list[tuple[DataFrame, list[str]]]:
    """Rows by the keys they have: a join on a key never sees a null."""
    has_c, has_p = F.col(c).isNotNull(), F.col(p).isNotNull()
    return [(rows.filter(has_c & has_p), [c, p]), (rows.filter(has_c & ~has_p), [c]), (rows.filter(has_p & ~has_c), [p])]


def greedy_pair_dedup(rows: DataFrame, order_col: str = "rank", c_key: str = "c_key",
                      cpp_key: str = "cpp_key") -> DataFrame:
    """The rows the sequential rule keeps, computed in parallel rounds.

    Sequential rule: walk rows in ``order_col`` order; a row is kept if none
    of its non-null keys was kept before; a kept row marks its keys (C keys
    and C++ keys are separate sets, shared by pairs and singles; a rejected
    row marks nothing).

    Parallel form: a row that is the earliest undecided row on each of its
    keys must be kept (every earlier row sharing a key is decided and was
    rejected), and every other undecided row sharing a key with a kept row
    must be rejected.  Each round keeps and rejects those rows; the globally
    earliest undecided row is always kept, so the rounds end whatever their
    number (a long chain of rows with alternate keys takes one round a row
    kept).  Exact repeats of a key pair are reduced first: only the earliest
    can win.  Rows with one key only take part in that key's joins alone, so
    the many single rows never meet in the partition of a null key.  Each
    round is written to the shared folder.
    Returns ``(order_col, c_key, cpp_key)`` of the kept rows; rows without any
    key are kept, as nothing can exclude them.
    """
    r, c, p = order_col, c_key, cpp_key
    undecided = materialize(rows.select(r, c, p).filter(F.col(c).isNotNull() | F.col(p).isNotNull())
                            .groupBy(c, p).agg(F.min(r).alias(r)).select(r, c, p))  # exact repeats: earliest only
    out = rows.select(r, c, p).filter(F.col(c).isNull() & F.col(p).isNull())
    while not undecided.isEmpty():
        least = {k: undecided.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(r).alias(f"_min_{k}")) for k in (c, p)}
        won = None
        for part, keys in _split(undecided, c, p):
            for k in keys:
                part = part.join(least[k], k).filter(F.col(f"_min_{k}") == F.col(r))
            part = part.select(r, c, p)
            won = part if won is None else won.unionByName(part)
        won = materialize(won)
        rest = None
        for part, keys in _split(undecided, c, p):
            for k in keys:
                part = part.join(won.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti")
            part = part.select(r, c, p)
            rest = part if rest is None else rest.unionByName(part)
        undecided = materialize(rest)
        out = out.unionByName(won)
    return out


def pair_kind(c_key: Column, cpp_key: Column) -> Column:
    return (F.when(c_key.isNotNull() & cpp_key.isNotNull(), F.lit("pair"))
            .when(c_key.isNotNull(), F.lit("c")).when(cpp_key.isNotNull(), F.lit("cpp")))


# ---------------------------------------------------------------------------
# Sampling and caps
# ---------------------------------------------------------------------------

def seeded_sample(df: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """``min(n, total)`` rows without replacement, deterministic for a seed:
    the first ``n`` in the order of a hash of (seed, id)."""
    key = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))
    return first_rows(df.withColumn("_k", key), n, ["_k", id_col], id_col).drop("_k")


def first_rows(df: DataFrame, n: int, order_cols: list, id_col: str, group_cols: list | None = None) -> DataFrame:
    """The first ``n`` rows in a given order, of each group if given.

    A distributed cut for any ``n`` (the real caps are 50,000 to 120,000): the
    order columns and the id alone are range-partitioned and numbered, and the
    rows follow by their id.  No task sees more than its range, unlike a limit
    after a sort or a window over a whole group.  ``id_col`` must be unique.
    """
    groups = list(group_cols or [])
    names = [c for c in dict.fromkeys([*groups, *[c for c in order_cols if isinstance(c, str)], id_col])]
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    numbered = consecutive_index(df.select(*names), order, out_col="_at", group_cols=groups)
    return df.join(numbered.filter(F.col("_at") < n).select(id_col), id_col, "left_semi")


def capped(df: DataFrame, n: int, order_cols: list, id_col: str) -> DataFrame:
    """The first ``n`` rows in a given order."""
    return first_rows(df, n, order_cols, id_col)


def row_cap(df: DataFrame, n: int, group_cols: list, order_cols: list, id_col: str) -> DataFrame:
    """The first ``n`` rows of every group."""
    return first_rows(df, n, order_cols, id_col, group_cols)


# ---------------------------------------------------------------------------
# Keyword search panel and numbering of accepted files
# ---------------------------------------------------------------------------

def panel_hits(docs: DataFrame, panel: dict[str, list[str]], id_col: str, tokens_col: str, recency_col: str,
               per_keyword: int) -> DataFrame:
    """Per query of the panel, the ``per_keyword`` most recent documents
    that contain its tokens in a row.

    ``panel`` is a fixed list (query -> token sequence), so its sequences are
    literals and one scan of each document's joined tokens answers all of
    them.  The ``row_number() <= k`` filter is planned with a partial group
    limit before the shuffle (k up to Spark's window group limit), so even a
    query found in a third of all documents moves at most ``k`` rows per task.
    """
    sep = "\x01"
    joined = F.concat(F.lit(sep), F.array_join(tokens_col, sep), F.lit(sep))
    found = [F.when(F.col("_joined").contains(sep + sep.join(seq) + sep), F.lit(q)) for q, seq in panel.items()]
    hits = (docs.select(id_col, recency_col, joined.alias("_joined"))
            .select(id_col, recency_col, F.explode(F.array_compact(F.array(*found))).alias("keyword")))
    w = Window.partitionBy("keyword").orderBy(F.col(recency_col).desc(), F.col(id_col).desc())
    return (hits.withColumn("hit_rank", F.row_number().over(w))
            .filter(F.col("hit_rank") <= per_keyword))


def number_files(df: DataFrame, order_cols: list, prefix: str = "file_") -> DataFrame:
    """``file_0, file_1, ...`` in the given order (distributed numbering)."""
    out = consecutive_index(df, order_cols, out_col="file_idx")
    return out.withColumn("file_name", F.concat(F.lit(prefix), F.col("file_idx").cast("string")))


# ---------------------------------------------------------------------------
# Corpus union
# ---------------------------------------------------------------------------

def union_sources(parts: list[tuple[str, DataFrame]], id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One corpus with a ``source`` column and a fresh consecutive id
    in (source order, original id) order."""
    u = None
    for i, (name, df) in enumerate(parts):
        d = df.select(F.lit(i).alias("_src_idx"), F.lit(name).alias("source"),
                      F.col(id_col).alias("orig_id"), F.col(text_col).alias("text"))
        u = d if u is None else u.unionByName(d)
    out = consecutive_index(u, [F.col("_src_idx"), F.col("orig_id")], out_col=id_col)
    return out.drop("_src_idx")
