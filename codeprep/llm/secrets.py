"""Operator 10: secret scans by assignment-aware lexing.

Base patterns give ``assign``, ``access`` and ``hex`` spans.  The method adds
``literal`` spans: source and configuration syntax is lexed into bindings of a
name (``a.b_c``, ``x["key"]``, ``--flag``) to a literal by ``=``, ``:``,
``:=`` or ``=>``; names bound to literals, to other names and to sums of both
are constants that later bindings take over.  A literal is scored by the words
of the name it ends up in and by its own length, alphabets and entropy;
placeholders and names of things (paths, words) score low.  A secret put
together from several literals has one span for each of them, wherever it is
written; what lies between them is no part of it.

Null text: as the empty text.  Very long texts are lexed in one pass, and only
if they hold an operator at all.  Repeated rows and ids each give a row; of
spans that touch a base one the base one stays, and equal spans of several
names are one.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from codeprep.llm.common import map_texts

#: The base patterns, in the order of the kinds.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words of names that point to a secret, and how strongly.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
             "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.6, "auth": 0.6, "bearer": 0.8, "key": 0.5,
             "access": 0.4, "signing": 0.5, "encryption": 0.5, "salt": 0.5, "client": 0.1, "api": 0.3}
#: Words that make a name or a literal harmless.
HARMLESS = {"public", "example", "sample", "placeholder", "changeme", "dummy", "test", "none", "null", "true", "false", "todo",
            "your", "xxx", "name", "path", "file", "url", "id", "type", "length", "size", "count", "field"}
THRESHOLD = 1.0
#: Characters of a sum of constants; a longer one (a name added to itself again and again) has no value.
SUM_LENGTH = 1 << 16
#: A name, an operator, or a literal; anything else separates bindings.
LEX = re.compile(r"""
    (?P<string>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`)
  | (?P<name>(?:--)?[A-Za-z_][A-Za-z0-9_]*+(?:[.-][A-Za-z_][A-Za-z0-9_]*+)*+)
  | (?P<bare>[A-Za-z0-9+/_.~^-]++)
  | (?P<op>:=|=>|={1,3}|:|!=|[<>]=?)
  | (?P<plus>\+)
  | (?P<open>[\[({])|(?P<close>[\])}])
  | (?P<comment>\#[^\n]*|//[^\n]*)
  | (?P<end>[\n;,])
""", re.X)
BINDS = {"=", ":", ":=", "=>"}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    return sorted(found)


def name_words(name: str) -> list[str]:
    """Words of a name: split at signs, digits and changes of case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]


def name_score(name: str) -> float:
    words = name_words(name)
    if not words or HARMLESS.intersection(words):
        return 0.0
    joined = "".join(words)
    return min(1.5, sum(SENSITIVE.get(w, 0.0) for w in words) + (0.6 if "apikey" in joined and "apikey" not in words else 0.0))


def literal_score(value: str) -> float:
    """0 to 1: how much a value looks like generated or chosen to be hard to guess."""
    n = len(value)
    if n < 6 or " " in value or HARMLESS.intersection(re.findall(r"[a-z]+", value.lower())) or re.fullmatch(r"[<${%].*|(.)\1*", value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    alphabets = sum(bool(re.search(a, value)) for a in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.12 * entropy + 0.15 * (alphabets - 1) + 0.01 * min(n, 40))


def bindings(text: str):
    """(name, value, the places of its literals) of each binding.  A constant
    brings its own literals' places along, so a sum has one place a part."""
    known: dict[str, tuple[str, tuple[tuple[int, int], ...]]] = {}
    target, parts, bound, depth_key = "", [], False, ""

    def close():
        nonlocal target, parts, bound
        if bound and target and parts and all(parts):
            if len(parts) == 1 or sum(len(value) for value, _ in parts) <= SUM_LENGTH:
                known[target] = ("".join(value for value, _ in parts), tuple(dict.fromkeys(at for _, places in parts for at in places)))
                yield target, *known[target]
            else:
                known.pop(target, None)
        target, parts, bound = "", [], False

    for m in LEX.finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind in ("end", "comment"):
            yield from close()
        elif kind == "op":
            if token in BINDS and target and not bound:
                bound = True
            elif token in BINDS and bound and len(parts) == 1 and parts[0] and token != ":":
                pass  # a = b = "c": the literal goes to the first name
            else:
                yield from close()
        elif kind == "open":
            if token == "{":
                yield from close()
        elif kind == "string":
            if bound:
                parts.append((token[1:-1], ((m.start() + 1, m.end() - 1),)))
            else:
                target = token[1:-1]  # a quoted key, or a subscript
        elif kind == "name":
            if not bound:
                target = token
            elif token in known:
                parts.append(known[token])
            else:
                after = text[m.end():m.end() + 1]
                # an unquoted value of a configuration line, unless something goes on behind it
                parts.append((token, ((m.start(), m.end()),)) if after in ("", "\n", "\r", ";", ",", " ") and any(c.isdigit() for c in token) else None)
        elif kind == "bare" and bound:
            if not parts:
                parts.append((token, ((m.start(), m.end()),)))
    yield from close()


def literal_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of sensitive literals that no base span touches."""
    if "=" not in text and ":" not in text:
        return []
    spans: set[tuple[int, int, int]] = set()
    for name, value, places in bindings(text):
        n = name_score(name)
        if n >= 0.5 and n + literal_score(value) >= THRESHOLD + 0.4 and literal_score(value) >= 0.4:
            spans |= {(start, 3, end) for start, end in places if start < end}
    out, i, reach = [], 0, -1
    taken = sorted(taken)
    for s in sorted(spans):
        while i < len(taken) and taken[i][0] < s[2]:
            reach = max(reach, taken[i][2])
            i += 1
        if reach <= s[0]:
            out.append(s)
    return out


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, sorted(base + literal_spans(text, base))


def as_string(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redact(text: str, found: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of spans replaced by one mark."""
    out, at = [], 0
    for s, _, e in found:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """key, the count of each base kind and of literals, the base spans' digest,
    all spans, and the text with the spans redacted."""
    def make():
        def run(texts):
            got = [spans(t) for t in texts]
            count = lambda k: np.array([sum(x[1] == k for x in a) for _, a in got], np.int64)
            return {"n_assign": count(0), "n_access": count(1), "n_hex": count(2), "n_literal": count(3),
                    "base_sha256": [sha256(as_string(b).encode()).hexdigest() for b, _ in got],
                    "spans": [as_string(a) for _, a in got], "redacted": [redact(t, a) for t, (_, a) in zip(texts, got)]}
        return run

    return map_texts(df, key, text, make, "n_assign bigint, n_access bigint, n_hex bigint, n_literal bigint, base_sha256 string, spans string, redacted string")
