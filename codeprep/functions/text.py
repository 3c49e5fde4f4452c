"""Scalar text functions (P1–P15) as JVM-side column expressions.

Each function maps Column -> Column, so it stays inside whole-stage codegen
and composes into one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import patterns as R


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit(s: str) -> Column:
    return F.lit(s)


def strip_ws(col) -> Column:
    """Python ``str.strip()`` for ASCII text (Spark ``trim`` removes blanks only)."""
    return F.btrim(_c(col), _lit(R.WS_CHARS))


def escape_newlines(col) -> Column:
    """Newline -> the two characters backslash, n."""
    return F.replace(_c(col), _lit("\n"), _lit("\\n"))


def escape_code(col) -> Column:
    """Backslash, newline, tab escaped, in this order."""
    c = F.replace(_c(col), _lit("\\"), _lit("\\\\"))
    c = F.replace(c, _lit("\n"), _lit("\\n"))
    return F.replace(c, _lit("\t"), _lit("\\t"))


def strip_comments_simple(col) -> Column:
    """Line comments first (also inside strings), then block comments."""
    c = F.regexp_replace(_c(col), R.LINE_COMMENT_RE, "")
    return F.regexp_replace(c, R.BLOCK_COMMENT_RE, "")


def ascii_clean(col) -> Column:
    """Drop non-ASCII characters, un-escape ``\\n`` and ``\\t``."""
    c = F.regexp_replace(_c(col), R.NON_ASCII_RE, "")
    c = F.replace(c, _lit("\\n"), _lit("\n"))
    return F.replace(c, _lit("\\t"), _lit("\t"))


def include_lines(col) -> Column:
    """P5 (first half): the include lines of a snippet, joined and stripped."""
    return strip_ws(F.array_join(F.regexp_extract_all(_c(col), _lit(R.INCLUDE_LINE_RE), 0), "\n"))


def code_without_includes(col) -> Column:
    """P5 (second half): the snippet without include lines, stripped."""
    return strip_ws(F.regexp_replace(_c(col), R.INCLUDE_LINE_RE, ""))


def include_headers(col) -> Column:
    """Header names of the include lines (``stdio.h``, ``vector``)."""
    return F.transform(F.regexp_extract_all(_c(col), _lit(R.INCLUDE_LINE_RE), 0),
                       lambda line: F.regexp_extract(line, R.INCLUDE_NAME_RE, 1))


def join_includes(includes, code) -> Column:
    """Includes, a blank line, code."""
    return F.concat(_c(includes), _lit("\n\n"), _c(code))


def inject_headers(col) -> Column:
    """Drop the all-in-one header, prepend the fixed header block."""
    return F.concat(_lit(K.COMMON_HEADERS), _lit("\n\n"),
                    F.replace(_c(col), _lit(K.ALL_IN_ONE_HEADER), _lit("")))


def drop_blank_lines(col) -> Column:
    """``"\\n".join(l for l in s.splitlines() if l.strip())``."""
    lines = F.split(_c(col), R.SPLITLINES_RE)
    return F.array_join(F.filter(lines, lambda x: strip_ws(x) != ""), "\n")


def clean_stage2(col) -> Column:
    """Un-escape, cut includes anywhere, block then line comments, blank lines."""
    c = F.replace(_c(col), _lit("\\n"), _lit("\n"))
    c = F.regexp_replace(c, R.INCLUDE_ANY_RE, "")
    c = F.regexp_replace(c, R.BLOCK_COMMENT_RE, "")
    c = F.regexp_replace(c, R.LINE_COMMENT_RE, "")
    return drop_blank_lines(c)


def resolve_comments(col) -> Column:
    """String-aware comment removal plus removal of directive lines.

    Stands in for the compiler preprocessor (``-E -P``): comments become a
    blank (as the preprocessor does), string literals are kept as they are, the
    remaining ``#`` lines are dropped with their continuation lines.  Macros are not expanded.
    """
    c = F.regexp_replace(_c(col), R.comment_resolve_pattern(True), f"$1{R.MARK}$2")
    c = F.regexp_replace(c, f"{R.MARK}(?:{R.comment_re(True)})", " ")
    c = F.regexp_replace(F.replace(c, _lit(R.MARK), _lit("")), R.DIRECTIVE_LINE_RE, "")
    return strip_ws(c)


def strip_token(col) -> Column:
    """P10: remove CR and LF inside a token."""
    return F.translate(_c(col), "\r\n", "")


def raw_url(col) -> Column:
    """Repository page URL -> raw file URL (two literal replaces)."""
    c = F.replace(_c(col), _lit("github.com"), _lit("raw.githubusercontent.com"))
    return F.replace(c, _lit("blob/"), _lit(""))


def flatten_path(col) -> Column:
    """``./a/b.cpp`` -> ``a_b``."""
    c = F.regexp_replace(_c(col), "^\\./", "")
    c = F.translate(c, "/", "_")
    return F.regexp_replace(c, "\\.cpp$", "")


def sha256_hex(col) -> Column:
    """SHA-256 of the UTF-8 text, lowercase hex."""
    return F.sha2(_c(col), 256)


def join_tokens(col) -> Column:
    """Token array -> blank-joined text."""
    return F.array_join(_c(col), " ")


def lex_input(col) -> Column:
    """Text of an escaped line file handed to the tokenizer: strip, P4, P5 (code part), P9."""
    return resolve_comments(code_without_includes(ascii_clean(strip_ws(col))))


def lex_input_raw(col) -> Column:
    """P5 (code part) and P9 for a raw source file (no escapes to undo)."""
    return resolve_comments(code_without_includes(col))


def tokenize(col) -> Column:
    """The token array of a text (strings, numbers, names, operators)."""
    return F.regexp_extract_all(_c(col), _lit(R.TOKEN_RE), 0)
