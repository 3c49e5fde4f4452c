"""Python literal text (list / dict ``repr``) to typed values, for importing
files written by the reference (own files keep native arrays and maps)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPTS = {"allowSingleQuotes": "true"}


def _as_json(col) -> Column:
    """The escapes that a ``repr`` has and JSON lacks: ``\\xNN`` and ``\\'``.
    An escaped backslash before them is an ordinary character."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\x([0-9A-Fa-f]{2})", r"$1\\u00$2")
    return F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\'", r"$1\\u0027")


def parse_list_literal(col, element_type: str = "string") -> Column:
    """The list, or null where the text is none (for the rejects, see ``unparsed``)."""
    return F.from_json(_as_json(col), f"array<{element_type}>", _OPTS)


def parse_dict_literal(col) -> Column:
    return F.from_json(_as_json(col), "map<string,string>", _OPTS)


def unparsed(df, text_col: str, parsed: Column, id_col: str = "doc_id"):
    """K8 rows of the texts that are no literal."""
    return df.filter(F.col(text_col).isNotNull() & parsed.isNull()).select(
        id_col, F.lit("import").alias("stage"), F.lit("unparsed").alias("reason"))
