"""Regular expressions, written once per dialect.

Spark runs Java regexes, the DuckDB oracle runs RE2.  Rules kept by every
pattern here:

* no bare ``.`` for "rest of line": Java's ``.`` also stops at ``\\r``,
  ``\\x85``, ``\\u2028``; ``[^\\n]`` behaves like Python's ``.`` everywhere;
* line anchors use ``(?md)`` in Java (``d`` = only ``\\n`` ends a line);
* white space is spelled out (``[ \\t\\n\\x0B\\f\\r]``) because RE2's ``\\s``
  lacks ``\\x0B``;
* string literals use possessive quantifiers in Java: the usual
  ``"(?:\\\\.|[^"\\\\])*"`` recurses once per character and overflows the
  stack on literals of a few hundred thousand characters.  RE2 has no
  possessive form and needs none (no backtracking), so the oracle variant
  drops the ``+``; both match the same strings.
"""

from __future__ import annotations

WS = "[ \\t\\n\\x0B\\f\\r]"
WS_CHARS = " \t\n\r\f\x0b"          # Python str.strip() for ASCII text


def _possessive(java: bool) -> str:
    return "+" if java else ""


def string_literal(java: bool = True) -> str:
    """Double- or single-quoted literal on one line, backslash escapes allowed."""
    p = _possessive(java)
    return (f'"[^"\\\\\\n]*{p}(?:\\\\[\\s\\S][^"\\\\\\n]*{p})*{p}"'
            f"|'[^'\\\\\\n]*{p}(?:\\\\[\\s\\S][^'\\\\\\n]*{p})*{p}'")


def number_literal(java: bool = True) -> str:
    """C preprocessing number: ``1``, ``0x1F``, ``1e-5``, ``.5f``, ``1'000`` not."""
    p = _possessive(java)
    return f"\\.?[0-9](?:[eEpP][+-]|[0-9A-Za-z_.])*{p}"


def identifier(java: bool = True) -> str:
    return f"[A-Za-z_][A-Za-z0-9_]*{_possessive(java)}"


PUNCTUATORS = ("<<=|>>=|\\.\\.\\.|->|::|\\+\\+|--|<<|>>|<=|>=|==|!=|&&|\\|\\||"
               "\\+=|-=|\\*=|/=|%=|&=|\\|=|\\^=|##")
SINGLE_CHAR = "[^ \\t\\n\\x0B\\f\\r]"


def token_pattern(java: bool = True) -> str:
    """One match per token, alternatives tried in this order."""
    return "|".join([string_literal(java), number_literal(java), identifier(java),
                     PUNCTUATORS, SINGLE_CHAR])


TOKEN_RE = token_pattern(True)
TOKEN_RE_SQL = token_pattern(False)

IDENT_FULL_RE = "^[A-Za-z_][A-Za-z0-9_]*$"
# the same for Arrow (RE2): Java's ``$`` also stands before a last line end
IDENT_FULL_RE2 = "^[A-Za-z_][A-Za-z0-9_]*(?:\\r\\n|[\\n\\r\\x{85}\\x{2028}\\x{2029}])?$"
LITERAL_START_RE = "^[\"'0-9]|^\\.[0-9]"

# P5: include lines (Python MULTILINE semantics; leading blank lines are
# swallowed by the first \s*, as in the reference).
INCLUDE_LINE_RE = "(?md)^[ \\t\\n\\x0B\\f\\r]*#[ \\t\\n\\x0B\\f\\r]*include[ \\t\\n\\x0B\\f\\r]+[<\"][^\\n]+[>\"][^\\n]*$"
INCLUDE_LINE_RE_SQL = "(?m)^[ \\t\\n\\x0B\\f\\r]*#[ \\t\\n\\x0B\\f\\r]*include[ \\t\\n\\x0B\\f\\r]+[<\"][^\\n]+[>\"][^\\n]*$"
# header name inside an include line
INCLUDE_NAME_RE = "include[ \\t\\n\\x0B\\f\\r]*[<\"]([^>\"]*)[>\"]"

# Include directive anywhere, with or without a blank before the name
INCLUDE_ANY_RE = "#[ \\t\\n\\x0B\\f\\r]*include[ \\t\\n\\x0B\\f\\r]*(<[^>]*>|\"[^\"]*\")"
BLOCK_COMMENT_RE = "(?s)/\\*.*?\\*/"
LINE_COMMENT_RE = "//[^\\n]*"
# Python str.splitlines() boundaries (ASCII part plus the Unicode ones)
SPLITLINES_RE = "\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
SPLITLINES_RE_SQL = "\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"


def comment_re(java: bool = True) -> str:
    return f"//[^\\n]*{_possessive(java)}|/\\*[\\s\\S]*?\\*/"


def comment_resolve_pattern(java: bool = True) -> str:
    """A string literal (group 1) or a comment (group 2)."""
    return f"({string_literal(java)})|({comment_re(java)})"


# stands before a comment (and behind a literal) between the two passes of P9
MARK = "\ue000"
# a directive goes with its continuation lines (a backslash at the line's end)
DIRECTIVE_LINE_RE = "(?md)^[ \\t]*#(?:\\\\\\r?\\n|[^\\n])*+$"
DIRECTIVE_LINE_RE_SQL = "(?m)^[ \\t]*#[^\\n]*$"
NON_ASCII_RE = "[^\\x00-\\x7F]"
