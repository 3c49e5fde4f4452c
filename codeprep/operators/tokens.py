"""Tokenization and obfuscation of code.

The reference walks a compiler syntax tree per token.  Here the same outputs
come from a regex lexer and a rule cascade.  Documents of at most
``IN_ROW_TOKENS`` tokens are renamed inside the row (``renaming``): their
tokens are neither exploded nor joined, sorted or collected again.  A longer
document takes the set-based way, whose steps can spill:

1. documents are hash-partitioned by id **once** (the raw text is the
   cheapest thing to move), then tokenized and exploded;
2. every occurrence is classified from its own spelling and its neighbours
   (``prev`` / ``next`` read from the array, so no window is needed);
3. one row per (document, spelling) – the entity table – records the first
   position of each use;  names are numbered per class in order of first
   appearance with ``row_number`` windows;
4. occurrences are joined back to their entity and re-collected in order.

Every grouping, window and join after step 1 is keyed on the id plus
something, so the hash partitioning of step 1 satisfies them all and the
plan has one exchange of text, none of tokens.  The join is a merge join by
hint: the planner takes the entities, computed from a small scan of
compressed columns, for a small table, and would send all of them to the
driver to broadcast them.

Rule cascade per occurrence (first match wins):
keyword | special name | identifier after ``class``/``struct`` | type word |
standard function | literal | identifier | other (punctuation).
An identifier's alias is decided by its first plain use: followed by ``(``
-> ``funcN``, else ``varN``; but if a ``class``/``struct`` declaration of
the same spelling came earlier, the name resolves to that alias (lookup
order var, func, struct, lit, class).  Ids are stable per spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import constants as K
from ..functions import patterns as R
from ..functions import text as T
from ..session import partition_by_key
from . import renaming as RN
from .filters import keep_where
from .lookup import map_batches, map_lists

MAP_COLS = ["var_dict", "func_dict", "lit_dict", "struct_dict", "class_dict"]
ALIAS_CLASSES = RN.ALIAS_CLASSES

#: Longest document that is renamed inside the row, in one Arrow batch.
IN_ROW_TOKENS = 1 << 14


# ---------------------------------------------------------------------------
# Token arrays and token rows
# ---------------------------------------------------------------------------

def tokenize(docs: DataFrame, code_col: str = "code", out_col: str = "tokens") -> DataFrame:
    """Add the token array of ``code_col``."""
    return docs.withColumn(out_col, T.tokenize(code_col))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: inside a lambda a computed
    column would be evaluated again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def neighbours(tokens: Column) -> Column:
    """Array of ``struct(tok, prev, next)`` – look-behind / look-ahead without a window."""
    return _once(tokens, lambda toks: F.transform(toks, lambda t, i: F.struct(
        t.alias("tok"), F.get(toks, i - 1).alias("prev"), F.get(toks, i + 1).alias("next"))))


def token_rows(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Exploded form ``(id, pos, tok, prev, next)``, pos 0-based."""
    return (docs.select(id_col, F.posexplode(neighbours(F.col(tokens_col))).alias("pos", "_o"))
            .select(id_col, "pos", "_o.tok", "_o.prev", "_o.next"))


def leaf_tokens(tokens: Column) -> Column:
    """Non-blank tokens in order (positions renumber implicitly)."""
    return F.filter(tokens, lambda t: T.strip_ws(t) != "")


# ---------------------------------------------------------------------------
# obfuscation
# ---------------------------------------------------------------------------

def occurrence_kind(tok: Column, prev: Column) -> Column:
    """T2–T8 rule cascade; returns keep | class | struct | lit | name."""
    is_ident = tok.rlike(R.IDENT_FULL_RE)
    return (F.when(tok.isin(K.KEYWORDS), F.lit("keep"))
            .when(tok.isin(K.SPECIAL_NAMES), F.lit("keep"))
            .when(prev.isin("class", "struct") & is_ident, prev)
            .when(tok.isin(K.TYPE_WORDS), F.lit("keep"))
            .when(tok.isin(K.STD_FUNCTIONS), F.lit("keep"))
            .when(tok.rlike(R.LITERAL_START_RE), F.lit("lit"))
            .when(is_ident, F.lit("name"))
            .otherwise(F.lit("keep")))


def _first(cond: Column) -> Column:
    return F.min(F.when(cond, F.col("pos")))


_CLASS_CODES = {"lit": 0, "var": 1, "func": 2, "struct": 3, "class": 4}


def entity_table(occ: DataFrame, id_col: str) -> DataFrame:
    """One row per (id, spelling) with first uses and the five aliases.

    Numbering: every (entity, class) with a first use becomes one row, a
    single ``row_number`` window partitioned by (id, class) numbers them in
    order of first use (one sort for all classes), and an aggregate per
    (id, spelling) pivots the numbers back.  Classes travel as small
    integers so every aggregate is a hash aggregate (string buffers would
    force a sort-based one); alias strings are built at the end.  All steps
    are keyed by the id, so none adds an exchange.
    """
    k = F.col("kind")
    ent = (occ.filter(k != "keep")
           .groupBy(id_col, "tok")
           .agg(_first(k == "lit").alias("f_lit"),
                _first(k == "name").alias("f_plain"),
                _first((k == "name") & (F.col("next") == "(")).alias("f_plain_call"),
                _first(k == "struct").alias("f_struct"),
                _first(k == "class").alias("f_class")))
    declared_first = (F.coalesce(F.col("f_struct") < F.col("f_plain"), F.lit(False))
                      | F.coalesce(F.col("f_class") < F.col("f_plain"), F.lit(False)))
    vf_code = F.when(F.col("f_plain").isNotNull() & ~declared_first,
                     F.when(F.col("f_plain") == F.col("f_plain_call"), F.lit(_CLASS_CODES["func"]))
                     .otherwise(F.lit(_CLASS_CODES["var"])))
    ent = ent.withColumn("vf_code", vf_code)
    carried = ["f_lit", "f_plain", "f_struct", "f_class", "vf_code"]
    uses = F.array(*[F.struct(code.alias("cls"), F.col(first).alias("first")) for code, first in [
        (F.lit(_CLASS_CODES["lit"]), "f_lit"), (F.col("vf_code"), "f_plain"),
        (F.lit(_CLASS_CODES["struct"]), "f_struct"), (F.lit(_CLASS_CODES["class"]), "f_class")]])
    rows = (ent.select(id_col, "tok", *carried, F.inline(uses))
            .filter(F.col("cls").isNotNull() & F.col("first").isNotNull()))
    w = Window.partitionBy(id_col, "cls").orderBy("first", "tok")
    rows = rows.withColumn("n", F.row_number().over(w) - 1)
    c = F.col("cls")

    def num(*codes):
        return F.max(F.when(c.isin(*codes), F.col("n")))
    out = (rows.groupBy(id_col, "tok")
           .agg(*[F.max(x).alias(x) for x in carried],
                num(_CLASS_CODES["lit"]).alias("n_lit"), num(_CLASS_CODES["struct"]).alias("n_struct"),
                num(_CLASS_CODES["class"]).alias("n_class"),
                num(_CLASS_CODES["var"], _CLASS_CODES["func"]).alias("n_vf")))
    vf_cls = F.when(F.col("vf_code") == _CLASS_CODES["func"], F.lit("func")) \
        .when(F.col("vf_code") == _CLASS_CODES["var"], F.lit("var"))

    def alias(prefix, n):
        return F.concat(prefix, F.col(n).cast("string"))
    return (out.withColumn("vf_cls", vf_cls)
            .withColumn("a_lit", alias(F.lit("lit"), "n_lit"))
            .withColumn("a_struct", alias(F.lit("struct"), "n_struct"))
            .withColumn("a_class", alias(F.lit("class"), "n_class"))
            .withColumn("a_vf", alias(F.col("vf_cls"), "n_vf")))


def occurrence_alias() -> Column:
    """Alias of one occurrence from its kind and its entity row."""
    k, pos = F.col("kind"), F.col("pos")
    resolved = (F.when(F.col("a_vf").isNotNull(), F.col("a_vf"))
                .when(F.col("f_struct") < pos, F.col("a_struct"))
                .otherwise(F.col("a_class")))
    return (F.when(k == "lit", F.col("a_lit"))
            .when(k == "struct", F.col("a_struct"))
            .when(k == "class", F.col("a_class"))
            .when(k == "name", resolved))


def _map_entries(cond: Column, first_col: str, alias_col: str) -> Column:
    """Entries (first use, name, alias) emitted at the occurrence that is the
    first use of that alias; sorted by first use they give insertion order."""
    entries = F.collect_list(F.when(cond & (F.col("pos") == F.col(first_col)),
                                    F.struct(F.col(first_col).alias("f"), F.col("tok").alias("k"),
                                             F.col(alias_col).alias("v"))))
    return F.map_from_entries(F.transform(F.array_sort(entries), lambda e: F.struct(e["k"], e["v"])))


def obfuscate(docs: DataFrame, id_col: str = "doc_id", code_col: str = "code",
              keep_cols: list[str] | None = None, repartition: bool = True,
              tokens_col: str | None = None, max_tokens: int | None = None) -> DataFrame:
    """``(id, *keep_cols, transformed_tokens, var_dict ... class_dict)``.

    Rows whose code has no token are dropped (F2 does the same upstream).
    ``tokens_col`` takes an existing token array instead of ``code_col``;
    ``max_tokens`` states that no row has more tokens (pipelines apply the
    length filter before this step; the token count does not change under
    renaming), which saves the pass that looks for documents too long for the
    way inside the row.
    """
    keep_cols = keep_cols or []
    # rows are keyed by id; stating it here keeps all branches of the plan
    # identical up to the one exchange, so it is reused
    docs = docs.filter(F.col(id_col).isNotNull())
    base = docs.select(id_col, *keep_cols, F.col(tokens_col or code_col).alias("_in"))
    if repartition:
        base = partition_by_key(base, id_col)    # the only exchange: raw text (or given tokens) by id

    def tokenized(df: DataFrame) -> DataFrame:
        return df.select(id_col, *keep_cols, (F.col("_in") if tokens_col else T.tokenize("_in")).alias("_toks"))
    n = F.size("_toks")
    out = _obfuscate_in_row(keep_where(tokenized(base), (n > 0) & (n <= IN_ROW_TOKENS)))
    if max_tokens is not None and max_tokens <= IN_ROW_TOKENS:
        return out
    # a text has at least as many characters as tokens: only long texts are tokenized here
    size = F.size("_in") if tokens_col else F.length("_in")
    long = keep_where(tokenized(keep_where(base, size > IN_ROW_TOKENS)), n > IN_ROW_TOKENS)
    return out.unionByName(_obfuscate_exploded(long, id_col, keep_cols))


def _obfuscate_in_row(base: DataFrame) -> DataFrame:
    """``obfuscate`` on ``(id, *keep_cols, _toks)``, the row staying whole."""
    text = Ty.StringType()
    fields = [Ty.StructField("transformed_tokens", Ty.ArrayType(text)), *[Ty.StructField(m, Ty.MapType(text, text)) for m in MAP_COLS]]
    return map_lists(base, "_toks", fields, RN.renamed, drop=("_toks",))


def _obfuscate_exploded(base: DataFrame, id_col: str, keep_cols: list[str]) -> DataFrame:
    """``obfuscate`` on ``(id, *keep_cols, _toks)`` hash-partitioned by id, for
    documents of any length.  One aggregation per document builds both the
    rewritten token array and the five maps (map entries are emitted at each
    alias's first use), so the entity table is computed once."""
    occ = (token_rows(base.select(id_col, "_toks"), id_col, "_toks")
           .withColumn("kind", occurrence_kind(F.col("tok"), F.col("prev"))))
    ent = entity_table(occ, id_col).select(id_col, "tok", "f_lit", "f_plain", "f_struct", "f_class",
                                           "vf_cls", "a_lit", "a_struct", "a_class", "a_vf")
    joined = occ.join(ent.hint("merge"), [id_col, "tok"], "left")
    out_tok = T.strip_token(F.coalesce(occurrence_alias(), F.col("tok")))
    k = F.col("kind")
    per_doc = (joined.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos"), out_tok.alias("t")))).alias("_s"),
        _map_entries((k == "name") & (F.col("vf_cls") == "var"), "f_plain", "a_vf").alias("var_dict"),
        _map_entries((k == "name") & (F.col("vf_cls") == "func"), "f_plain", "a_vf").alias("func_dict"),
        _map_entries(k == "lit", "f_lit", "a_lit").alias("lit_dict"),
        _map_entries(k == "struct", "f_struct", "a_struct").alias("struct_dict"),
        _map_entries(k == "class", "f_class", "a_class").alias("class_dict"))
        .select(id_col, F.transform("_s", lambda x: x["t"]).alias("transformed_tokens"), *MAP_COLS))
    if keep_cols:
        per_doc = base.select(id_col, *keep_cols).hint("merge").join(per_doc, id_col)
    return per_doc.select(id_col, *keep_cols, "transformed_tokens", *MAP_COLS)


def alias_values(*map_cols: str) -> Column:
    """All aliases of a row (the values of its five maps)."""
    cols = map_cols or MAP_COLS
    return F.flatten(F.array(*[F.map_values(F.col(c)) for c in cols]))


# ---------------------------------------------------------------------------
# Restore names
# ---------------------------------------------------------------------------

def restore_names(lexed: DataFrame, id_col: str = "doc_id", tokens_col: str = "transformed_tokens",
                  out_col: str = "restored_tokens", partitioned: bool = False) -> DataFrame:
    """Replace aliases by the original spellings, order kept.

    The inverse maps are looked up inside the row: nothing is moved, so rows
    need no partitioning (``id_col`` and ``partitioned`` are kept for callers).
    An alias that stands for two names of its row is an error.
    """
    names = F.flatten(F.array(*[F.map_keys(F.col(c)) for c in MAP_COLS]))
    rows = lexed.select("*", alias_values().alias("_alias"), names.alias("_name"))
    return map_lists(rows, tokens_col, [Ty.StructField(out_col, Ty.ArrayType(Ty.StringType()))], RN.restored,
                     drop=("_alias", "_name", out_col))


# ---------------------------------------------------------------------------
# merges
# ---------------------------------------------------------------------------

def merge_directives(tokens: Column) -> Column:
    """``#`` followed by a directive word becomes one token ``#word``."""
    words = K.DIRECTIVE_WORDS

    def merged(toks: Column) -> Column:
        out = F.transform(toks, lambda t, i: (
            F.when((t == "#") & F.get(toks, i + 1).isin(words), F.concat(F.lit("#"), F.get(toks, i + 1)))
            .when((F.get(toks, i - 1) == "#") & t.isin(words), F.lit(None))
            .otherwise(t)))
        return F.filter(out, lambda x: x.isNotNull())
    return _once(tokens, merged)


LITERAL_PIECE_RE = "\\\\[\\s\\S]|[\"']|[^\"'\\\\]+"


def literal_pieces(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Piece rows as a grammar lexer emits them: a literal token arrives as
    quote, content, escapes, quote, each with the literal as ``parent``;
    other tokens are single pieces without parent.

    Columns ``(id, pos, sub, piece, parent)``; order is (pos, sub), and a row's
    pieces follow each other in this order in their partition.  The generator
    takes a computed array: on a plain column Spark infers filters, pushes them
    beneath the lexer and its exchange, and the lexer runs again for each.
    """
    same = F.filter(tokens_col, lambda _: F.lit(True))
    rows = docs.select(id_col, F.posexplode(same).alias("pos", "_tok"))
    is_lit = F.col("_tok").rlike("^[\"']")
    parts = F.when(is_lit, F.regexp_extract_all(F.col("_tok"), F.lit(LITERAL_PIECE_RE), 0)) \
        .otherwise(F.array(F.col("_tok")))
    return (rows.select(id_col, "pos", F.posexplode(parts).alias("sub", "piece"),
                        F.when(is_lit, F.col("pos")).alias("parent")))


def merge_literal_pieces(pieces: DataFrame, id_col: str = "doc_id", ordered: bool = False) -> DataFrame:
    """Consecutive pieces with the same literal parent become one token.

    Gaps and islands: an island starts at a piece without parent or whose
    parent differs from the previous piece's; islands are concatenated in
    order.  Output ``(id, pos, token)`` with pos renumbered from 0.

    One pass over the pieces in order, in Arrow batches; only the last island
    of a batch is carried to the next.  The pieces are partitioned by id and
    sorted first, unless ``ordered`` states that each id's pieces follow each
    other in order within a partition, as those of ``literal_pieces`` do for
    unique ids.
    """
    if not ordered:
        pieces = partition_by_key(pieces, id_col).sortWithinPartitions(id_col, "pos", "sub")
    pieces = pieces.select(id_col, F.col("piece"), F.col("parent").cast("long").alias("parent"))
    schema = Ty.StructType([pieces.schema[id_col], Ty.StructField("pos", Ty.LongType()), Ty.StructField("token", Ty.StringType())])
    return map_batches(pieces, schema, RN.merged_pieces)
