"""A class for each use of a name.

``tokens.obfuscate`` gives a name one alias, by its first use.  Here every
occurrence is classified on its own, so a name that is declared as a method
and used as a member has an alias in both classes:

- after ``.`` or ``->``, and declared with no ``(`` behind it or inside a
  function: a variable;
- declared with ``(`` behind it, at file, namespace or class level, or defined
  there as ``Class::name(``: a function;
- after ``class`` or ``struct``: that class;
- any other use refers to what its document has named so far, in the order
  variable, function, struct, class; the first use of a name that nothing has
  named yet names a function where ``(`` follows, else a variable.

A name is declared when a type stands before it: a type word, another name,
or ``*``, ``&``, ``>`` behind a type word or in a statement that has no
expression so far; not before ``::``, where it qualifies another.  Only the first declarator of ``int a, b`` is seen so; the
others are uses.  Whether a place lies inside a function is read off the
scope tree: the brackets ``{`` are intervals, a token's enclosing one is the
last ``{`` that opened the token's depth, and it opens a function or block
unless its header is that of a class, struct, union, enum, namespace or
``extern "C"``.

All steps are windows within a document, so the text is moved once (by id),
tokenized once and joined with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import patterns as R
from ..functions import text as T
from ..session import partition_by_key
from .tokens import MAP_COLS, token_rows

#: Words that end a type, so that a name behind them is declared.
TYPE_ENDS = [*K.TYPE_WORDS, "void", "bool", "long", "short", "signed", "unsigned", "auto", "const", "wchar_t"]
#: Words whose bracket opens no function.
OUTER_WORDS = ["class", "struct", "union", "enum", "namespace"]
#: Tokens that start an expression in a statement.
EXPRESSION_STARTS = ["=", "return", "<<", ">>", "case", "throw"]
NOT_TYPES = [*K.KEYWORDS, *K.SPECIAL_NAMES, *K.STD_FUNCTIONS]
NAME_CLASSES = ["var", "func", "lit", "struct", "class"]


def scoped_rows(rows: DataFrame, id_col: str) -> DataFrame:
    """Token rows ``(id, pos, tok, prev, next)`` with ``prev2`` (two tokens
    back), ``in_function`` (the enclosing bracket opens a function or block),
    ``quiet`` (no expression in the statement so far) and ``after_list`` (a
    parameter list was closed in the statement)."""
    order = Window.partitionBy(id_col).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def last_at(cond: Column) -> Column:
        return F.coalesce(F.max(F.when(cond, F.col("pos"))).over(before), F.lit(-1))

    tok = F.col("tok")
    rows = rows.select(
        "*", F.lag("tok", 2).over(order).alias("prev2"),
        F.sum(F.when(tok == "{", 1).when(tok == "}", -1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"),
        last_at(tok.isin(";", "{", "}")).alias("_break"), last_at(tok.isin(OUTER_WORDS)).alias("_outer"),
        last_at(tok == "(").alias("_open"), last_at(tok == ")").alias("_close"), last_at(tok.isin(EXPRESSION_STARTS)).alias("_expr"))
    outer = ((F.col("_outer") > F.col("_break")) & (F.col("_open") <= F.col("_break")) & (F.col("_expr") <= F.col("_break"))) \
        | F.coalesce(F.col("prev2") == "extern", F.lit(False))
    rows = rows.withColumn("_opens", F.when(tok == "{", F.when(outer, 0).otherwise(1)))
    enclosing = Window.partitionBy(id_col, "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("in_function", F.coalesce(F.last("_opens", ignorenulls=True).over(enclosing), F.lit(0)) == 1)
    quiet = (F.col("_expr") <= F.col("_break")) & (~F.col("in_function") | (F.col("_open") <= F.col("_break")))
    return rows.select(*[c for c in rows.columns if not c.startswith("_")],
                       quiet.alias("quiet"), (F.col("_close") > F.col("_break")).alias("after_list"))


def use_kind() -> Column:
    """Kind of one occurrence: keep, lit, struct, class, func, var, ref, or
    init (a member named in a constructor's initialiser list)."""
    tok, prev, prev2, nxt = (F.coalesce(F.col(c), F.lit("")) for c in ("tok", "prev", "prev2", "next"))
    is_name = tok.rlike(R.IDENT_FULL_RE)
    outside = ~F.col("in_function")
    declared = (nxt != "::") & (prev.isin(TYPE_ENDS) | (prev.rlike(R.IDENT_FULL_RE) & ~prev.isin(NOT_TYPES))
                                | (prev.isin("*", "&", ">") & (prev2.isin(TYPE_ENDS) | F.col("quiet"))))
    method = (prev == "::") & (nxt == "(") & outside & F.col("quiet") & (prev2 != tok)
    return (F.when(tok.isin(K.KEYWORDS) | tok.isin(K.SPECIAL_NAMES), F.lit("keep"))
            .when(prev.isin("class", "struct") & is_name, prev)
            .when(tok.isin(K.TYPE_WORDS) | tok.isin(K.STD_FUNCTIONS), F.lit("keep"))
            .when(tok.rlike(R.LITERAL_START_RE), F.lit("lit"))
            .when(~is_name, F.lit("keep"))
            .when(prev.isin(".", "->"), F.lit("var"))
            .when(method | (declared & (nxt == "(") & outside), F.lit("func"))
            .when(declared, F.lit("var"))
            .when(prev.isin(":", ",") & nxt.isin("(", "{") & outside & F.col("after_list"), F.lit("init"))
            .otherwise(F.lit("ref")))


def named_uses(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """``(id, pos, tok, kind, use_class, alias, names)``, a row a token.

    ``use_class`` is the class that the occurrence resolves to and ``names``
    the class that it is the first use of (null elsewhere), ``alias`` class
    and number; all are null for kept tokens.  Numbers count first uses in a
    document.  ``docs`` is partitioned by id."""
    rows = scoped_rows(token_rows(docs, id_col, tokens_col), id_col).withColumn("kind", use_kind())
    kind, pos = F.col("kind"), F.col("pos")
    same = Window.partitionBy(id_col, "tok")

    def first(cond: Column) -> Column:
        return F.min(F.when(cond, pos)).over(same)

    rows = rows.select(
        id_col, "pos", "tok", "kind", *[first(kind == c).alias(f"_{c}") for c in NAME_CLASSES],
        first(kind.isin("ref", "init")).alias("_ref"), first((kind == "ref") & (F.col("next") == "(")).alias("_call"))
    named = F.least("_var", "_func", "_struct", "_class")
    unnamed = F.col("_ref").isNotNull() & (named.isNull() | (F.col("_ref") < named))     # T8
    call = F.coalesce(F.col("_call") == F.col("_ref"), F.lit(False))
    rows = rows.select(
        id_col, "pos", "tok", "kind", "_lit", "_struct", "_class",
        F.least("_var", F.when(unnamed & ~call, F.col("_ref"))).alias("_var"),
        F.least("_func", F.when(unnamed & call, F.col("_ref"))).alias("_func"))
    resolved = F.when(F.col("_var") <= pos, "var").when(F.col("_func") <= pos, "func") \
        .when(F.col("_struct") < pos, "struct").when(F.col("_class") < pos, "class")
    use = F.when(kind.isin("ref", "init"), resolved).when(kind != "keep", kind)
    rows = rows.withColumn("use_class", use)
    first_use = F.array(*[F.col(f"_{c}") for c in NAME_CLASSES])
    names = F.when(F.col("use_class") == F.element_at(F.array(*map(F.lit, NAME_CLASSES)), F.array_position(first_use, pos).cast("int")), F.col("use_class"))
    rows = rows.withColumn("names", F.when(F.array_contains(first_use, pos), names))
    running = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for c in NAME_CLASSES:
        rows = rows.withColumn(f"_n_{c}", F.count(F.when(F.col("names") == c, 1)).over(running))
    number = F.coalesce(*[F.when(F.col("use_class") == c, F.max(F.when(F.col("names") == c, F.col(f"_n_{c}"))).over(same) - 1)
                          for c in NAME_CLASSES])
    return rows.select(id_col, "pos", "tok", "kind", "use_class",
                       F.concat("use_class", number.cast("string")).alias("alias"), "names")


def obfuscate_uses(docs: DataFrame, id_col: str = "doc_id", code_col: str = "code", tokens_col: str | None = None) -> DataFrame:
    """T2–T11 with a class for each use: ``(id, transformed_tokens, var_dict ...
    class_dict)``.  A name may stand in several maps, each alias in one.  Rows
    without id or without tokens are dropped; repeated ids are an error of the
    caller (one row is one document)."""
    base = docs.filter(F.col(id_col).isNotNull())
    base = base.select(id_col, F.col(tokens_col or code_col).alias("_in"))
    base = partition_by_key(base, id_col).select(id_col, (F.col("_in") if tokens_col else T.tokenize("_in")).alias("tokens"))
    uses = named_uses(base, id_col)
    out = T.strip_token(F.coalesce("alias", "tok"))

    def entries(c: str) -> Column:
        made = F.collect_list(F.when(F.col("names") == c, F.struct("pos", "tok", "alias")))
        return F.map_from_entries(F.transform(F.array_sort(made), lambda e: F.struct(e["tok"], e["alias"])))

    return (uses.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", out.alias("t")))).alias("_s"),
                                     *[entries(c).alias(f"{c}_dict") for c in NAME_CLASSES])
            .select(id_col, F.transform("_s", lambda x: x["t"]).alias("transformed_tokens"), *MAP_COLS))
