"""DuckDB spellings of the column functions, for the oracle statements.

Each helper returns an SQL expression string that computes the same value
as the Spark function of the same name in ``codeprep.functions.text``.
"""

from __future__ import annotations

from ..functions import patterns as R

WS_SQL = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def ascii_clean(x: str) -> str:
    c = f"regexp_replace({x}, {lit(R.NON_ASCII_RE)}, '', 'g')"
    c = f"replace({c}, '\\n', chr(10))"
    return f"replace({c}, '\\t', chr(9))"


def tokenize(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(R.TOKEN_RE_SQL)}, 0)"


def prose(x: str) -> str:
    return ascii_clean(strip_ws(x))


def escape_newlines(x: str) -> str:
    return f"replace({x}, chr(10), '\\n')"


def escape_code(x: str) -> str:
    c = f"replace({x}, '\\', '\\\\')"
    c = f"replace({c}, chr(10), '\\n')"
    return f"replace({c}, chr(9), '\\t')"


def strip_comments_simple(x: str) -> str:
    c = f"regexp_replace({x}, {lit(R.LINE_COMMENT_RE)}, '', 'g')"
    return f"regexp_replace({c}, {lit(R.BLOCK_COMMENT_RE)}, '', 'g')"


def include_lines(x: str) -> str:
    return strip_ws(f"array_to_string(regexp_extract_all({x}, {lit(R.INCLUDE_LINE_RE_SQL)}, 0), chr(10))")


def code_without_includes(x: str) -> str:
    return strip_ws(f"regexp_replace({x}, {lit(R.INCLUDE_LINE_RE_SQL)}, '', 'g')")


def include_headers(x: str) -> str:
    return (f"list_transform(regexp_extract_all({x}, {lit(R.INCLUDE_LINE_RE_SQL)}, 0), "
            f"lambda h: regexp_extract(h, {lit(R.INCLUDE_NAME_RE)}, 1))")


def drop_blank_lines(x: str) -> str:
    return (f"array_to_string(list_filter(regexp_split_to_array({x}, {lit(R.SPLITLINES_RE_SQL)}), "
            f"lambda l: {strip_ws('l')} <> ''), chr(10))")


def clean_stage2(x: str) -> str:
    c = f"replace({x}, '\\n', chr(10))"
    c = f"regexp_replace({c}, {lit(R.INCLUDE_ANY_RE)}, '', 'g')"
    c = f"regexp_replace({c}, {lit(R.BLOCK_COMMENT_RE)}, '', 'g')"
    c = f"regexp_replace({c}, {lit(R.LINE_COMMENT_RE)}, '', 'g')"
    return drop_blank_lines(c)


def resolve_comments(x: str) -> str:
    c = f"regexp_replace({x}, {lit(R.comment_resolve_pattern(False))}, '\\1' || chr(1) || '\\2', 'g')"
    c = f"replace(regexp_replace({c}, chr(1) || {lit('(?:' + R.comment_re(False) + ')')}, ' ', 'g'), chr(1), '')"
    # continuation lines: joined by a mark, cut as one line, and the marks of other lines put back
    c = f"replace(replace({c}, chr(92) || chr(13) || chr(10), chr(2)), chr(92) || chr(10), chr(3))"
    c = f"regexp_replace({c}, {lit(R.DIRECTIVE_LINE_RE_SQL)}, '', 'g')"
    c = f"replace(replace({c}, chr(2), chr(92) || chr(13) || chr(10)), chr(3), chr(92) || chr(10))"
    return strip_ws(c)


def lex_input_raw(x: str) -> str:
    return resolve_comments(code_without_includes(x))


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def list_lit(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def strip_token(x: str) -> str:
    return f"replace(replace({x}, chr(13), ''), chr(10), '')"


def lex_input(x: str) -> str:
    return resolve_comments(code_without_includes(ascii_clean(strip_ws(x))))
