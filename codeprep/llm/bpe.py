"""Operator 3: byte-level BPE encoding and decoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can
never be joined by a merge: between the two there is certainly a cut.  Each
text is cut by the tokenizer's own pattern, every piece is cut again at the
forced boundaries, the fragments are encoded independently (each distinct
fragment once, as its merges depend on nothing outside it), and their ids are
concatenated.

Null text: as the empty text, no token.  Texts of any length: the pieces are
bounded by the pattern and the forced cuts; a fragment of n bytes takes
O(n log n) steps.  Repeated rows give repeated results, an empty table an
empty one; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256
from struct import pack

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame

from codeprep.llm.common import map_texts

#: The pattern by which the vocabulary's pre-tokenizer cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
#: Strings kept with their ids in each cache of a worker (twice as many at most), and the longest that is kept.
CACHE_STRINGS, CACHE_LENGTH = 100_000, 48
#: Pieces up to this length are cut by a plain scan.
SHORT = 40


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 stands for itself, the rest for code points from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


@lru_cache(1)
def _patterns() -> tuple[regex.Pattern, regex.Pattern, regex.Pattern | None]:
    """The plain pattern; the pattern without the letters and digits that are
    newer than the Unicode tables of the tokenizer; what tells where the two differ."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    plain = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}"))
    if not new:
        return plain, plain, None
    spans: list[list[int]] = []
    for o in map(ord, new):
        if spans and spans[-1][1] == o - 1:
            spans[-1][1] = o
        else:
            spans.append([o, o])
    rare = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"
    old_l, old_n = rf"(?:(?!{rare})\p{{L}})", rf"(?:(?!{rare})\p{{N}})"
    other = rf" ?(?:{rare}|[^\s\p{{L}}\p{{N}}])+"
    exact = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{old_l}+| ?{old_n}+|{other}|\s+(?!\S)|\s+")
    return plain, exact, regex.compile(rare)


class _Spaces(Exception):
    """A chunk of white space alone: only the whole run of spaces tells its pieces."""


class _Known(dict):
    """Ids, as little-endian 32-bit bytes, of strings that are encoded on
    their own; ``encode`` gives those not yet there.  Two generations bound
    the memory: when the young one is full it becomes the old one, and what
    is met again moves back."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode, self.old = encode, {}

    def __missing__(self, string: str) -> bytes:
        ids = self.old.get(string)
        if ids is None:
            ids = self.encode(string)
        if len(string) <= CACHE_LENGTH:
            if len(self) >= CACHE_STRINGS:
                self.old = dict(self)
                self.clear()
            self[string] = ids
        return ids


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary (a tokenizer's JSON text)."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = d["model"]["vocab"]
        as_bytes = {t: bytes(back[c] for c in t) for t in vocab}
        specials = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.table = [b""] * (1 + max([*vocab.values(), *specials.values()]))
        for t, i in vocab.items():
            self.table[i] = as_bytes[t]
        for t, i in specials.items():
            self.table[i] = t.encode()
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in specials.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.byte_id = [vocab[c] for c in byte_alphabet()]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(d["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.glued = np.zeros((256, 256), bool)  # pairs of bytes inside a token
        for t in as_bytes.values():
            for pair in zip(t, t[1:]):
                self.glued[pair] = True
        self.open = set(zip(*map(np.ndarray.tolist, np.nonzero(~self.glued))))
        # where ids follow the order of the merges, a library can merge a fragment by them
        by_rank = all(as_bytes_id == i + 256 for i, (_, as_bytes_id) in enumerate(self.merge.values())) and sorted(self.byte_id) == [*range(256)]
        self.whole = None
        if by_rank:
            self.whole = tiktoken.Encoding("bytes", pat_str=PATTERN.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}"),
                                           mergeable_ranks={t: vocab[k] for k, t in as_bytes.items()}, special_tokens={})
            self.encode_fragment = self.whole._encode_single_piece
        self.pieces, self.chunks = _Known(self.encode_piece), _Known(self.encode_chunk)

    def fragments(self, piece: bytes) -> list[bytes]:
        """``piece`` cut at each forced boundary."""
        if len(piece) <= SHORT:
            if self.open.isdisjoint(zip(piece, piece[1:])):
                return [piece]
            at = [0, *(i for i, pair in enumerate(zip(piece, piece[1:]), 1) if pair in self.open)]
        else:
            b = np.frombuffer(piece, np.uint8)
            at = [0, *(np.flatnonzero(~self.glued[b[:-1], b[1:]]) + 1).tolist()]
        return [piece[x:y] for x, y in zip(at, [*at[1:], len(piece)])] if len(at) > 1 else [piece]

    def encode_piece(self, piece: str) -> bytes:
        ids: list[int] = []
        for fragment in self.fragments(piece.encode()):
            ids += self.encode_fragment(fragment)
        return pack(f"<{len(ids)}I", *ids)

    def encode_pieces(self, text: str) -> bytes:
        """Ids of a text without special tokens: pieces, fragments, merges."""
        plain, exact, rare = _patterns()
        pattern = exact if rare is not None and not text.isascii() and rare.search(text) else plain
        return b"".join(map(self.pieces.__getitem__, pattern.findall(text)))

    def encode_chunk(self, chunk: str) -> bytes:
        if chunk.isspace():
            raise _Spaces
        return self.encode_pieces(chunk)

    def encode_fragment(self, fragment: bytes) -> list[int]:
        """Merge the pair of least rank, leftmost first, until no pair can be merged."""
        ids = [self.byte_id[b] for b in fragment]
        n, merge = len(ids), self.merge
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*merge[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merge]
        heapq.heapify(heap)
        while heap:
            _, new, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue  # one of the two is gone
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (p := (new, ids[k])) in merge:
                    heapq.heappush(heap, (*merge[p], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h], new)) in merge:
                heapq.heappush(heap, (*merge[p], h, p))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if self.split is None:
            return self._encode(text)
        return b"".join(self.special.get(part) or self._encode(part) for part in self.split.split(text))

    def ids(self, text: str) -> list[int]:
        """The same ids by the library's own pattern and merges, for callers
        that need ids and not this method; texts with characters newer than
        its Unicode tables, and other vocabularies, go through ``encode``."""
        rare = _patterns()[2]
        if self.whole is None or rare is not None and not text.isascii() and rare.search(text) or self.split and self.split.search(text):
            return np.frombuffer(self.encode(text), "<u4").tolist()
        return self.whole.encode_ordinary(text)

    def _encode(self, text: str) -> bytes:
        """A space after anything but white space always begins a piece, so the
        chunks between spaces are independent; a run of several spaces is not,
        and such a text goes through the pattern as a whole."""
        first, *rest = text.split(" ")
        try:
            ids = b"".join(map(self.chunks.__getitem__, [" " + c for c in rest]))
            return self.encode_pieces(first) + ids if first else ids
        except _Spaces:
            return self.encode_pieces(text)

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(spec: str) -> Codec:
    """One codec a Python worker, whatever the number of tasks."""
    return Codec(spec)


def read_spec(path: str) -> str:
    """The tokenizer's file, read by the driver and sent to the executors (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (binary, little-endian 32-bit) and the text decoded from them."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def make():
        c = codec(spec.value)

        def run(texts):
            ids = [c.encode(t) for t in texts]
            return {"n_tokens": np.array([len(i) // 4 for i in ids], np.int64), "ids": ids, "decoded": [c.decode(i) for i in ids]}
        return run

    return map_texts(df, [key], text, make, "n_tokens bigint, ids binary, decoded string")


def digests(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, and the SHA-256 of the ids and of the text decoded from
    them, both taken in the task so that the ids need not leave it."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def make():
        c = codec(spec.value)

        def run(texts):
            ids = [c.encode(t) for t in texts]
            return {"n_tokens": np.array([len(i) // 4 for i in ids], np.int64),
                    "ids_sha256": [sha256(i).hexdigest() for i in ids],
                    "decoded_sha256": [sha256(c.decode(i).encode()).hexdigest() for i in ids]}
        return run

    return map_texts(df, [key], text, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
