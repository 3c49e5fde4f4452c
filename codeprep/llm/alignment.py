"""Operator 12: alignment of two tokenizers by diagonal run skipping.

Each text, a space before it, is encoded by a byte-level BPE vocabulary (A)
and a SentencePiece model (B).  The byte offsets at which the tokens end make
two increasing arrays, and where both have an end a group closes.  Along one
index shift the arrays are compared by exponential probing: a stretch of
one-to-one groups is taken in steps that double, and halve again at its end.
Where the ends differ, both arrays go on token by token to their next common
end; the group found so gives the new shift.

Tokens are linked where their byte ranges overlap.  Bounded chunks of
documents keep their links as codes of the chunk's distinct id pairs.  The
pairs' counts over all chunks, and each B id's highest (one row an id of B's
vocabulary), go back to the chunks that hold the pair, and each document's
links are weighed there: one pass over the texts, none over all pairs of a
document's tokens.

Null and empty texts, and texts whose joined bytes of A or B are not those of
the space and the text (as with characters that B rewrites), have no tokens:
zeros, and '' as groups.  Strings of special tokens are plain text.  Very long
texts are aligned whole.  Repeated rows and ids each give a row and count each
time; ties of a B id's highest count are all best.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeprep.llm import bpe
from codeprep.llm.common import map_rows, sliced, steps, written
from codeprep.session import ship_package

#: Links of a chunk (about: a chunk closes behind the document that passes it).
CHUNK_LINKS = 2_000_000
#: The character that stands for a space in B's pieces; entries of the first probe along a diagonal.
MARK, PROBE = "\u2581", 4
EMPTY = np.zeros(0, np.int64)


def digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of the numbers below ``size`` as bytes of one word
    each, zeros behind them, and the place of the first zero in bits."""
    names = [str(i).encode() for i in range(size)]
    return np.array([int.from_bytes(t, "little") for t in names], np.uint64), np.array([8 * len(t) for t in names], np.uint64)


class Pair:
    """The two encoders and the bytes of their tokens."""

    def __init__(self, spec: str, model: bytes):
        self.a = bpe.codec(spec)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.length_a, self.length_b = (np.array([len(t) for t in table]) for table in (self.a.table, self.bytes_b))
        self.digits = digits(max(len(self.a.table), len(names)))
        # letters and digits newer than the Unicode tables of A's library, and the bytes below all that begin one
        rare = bpe._patterns()[2]
        self.new = frozenset(rare.findall("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))) if rare else ())
        self.old_bytes = bytes(range(min((c.encode()[0] for c in self.new), default=256)))

    def ids_a(self, text: str, as_bytes: bytes) -> np.ndarray:
        """A's ids of a text in which special tokens' strings are plain text."""
        if self.a.whole is None or as_bytes.translate(None, self.old_bytes) and not self.new.isdisjoint(text):
            return np.frombuffer(self.a._encode(text), "<u4")
        return self.a.whole.encode_to_numpy(text, disallowed_special=())

    def encode(self, texts: list[str]):
        """A's and B's ids of each text behind a space, or None where it has
        no tokens.  A is byte-level: its tokens' bytes are always the text's."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            whole = (" " + text).encode()
            if text and b"".join(map(self.bytes_b.__getitem__, b)) == whole:
                yield self.ids_a(" " + text, whole).astype(np.int64), np.fromiter(b, np.int64, len(b))
            else:
                yield None


@lru_cache(2)
def pair(spec: str, model: bytes) -> Pair:
    """One pair of encoders a Python worker."""
    return Pair(spec, model)


def diagonal_runs(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """The groups of two increasing arrays with a common last value: the
    stretches (i, j, n) of n one-to-one groups, and the irregular groups
    (i, x, j, y) in which A's tokens i to x meet B's j to y (inclusive)."""
    runs, groups = [], []
    i = j = 0
    end = len(a)
    while i < end:
        if a[i] == b[j]:
            s, shift, step = i + 1, j - i, PROBE
            while True:  # as long as the next entries agree, look twice as far
                part = a[s:s + step]
                if part != b[s + shift:s + shift + step]:
                    break
                s += len(part)
                if len(part) < step:  # both are at their end
                    step = 0
                    break
                step *= 2
            while step > 1:  # the first that differs is among the next step entries
                step >>= 1
                if a[s:s + step] == b[s + shift:s + shift + step]:
                    s += step
            runs.append((i, j, s - i))
            i, j = s, s + shift
        else:
            x, y = i, j
            u, v = a[x], b[y]
            while u != v:
                if u < v:
                    x += 1
                    u = a[x]
                else:
                    y += 1
                    v = b[y]
            groups.append((i, x, j, y))
            i, j = x + 1, y + 1
    return runs, groups


def links_of(a: list[int], b: list[int], runs, groups) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of overlapping tokens: along the stretches, and within each irregular group."""
    first = np.array(runs, np.int64).reshape(-1, 3)
    n = first[:, 2]
    along = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at_a, at_b = [], []
    for i, x, j, y in groups:
        while True:
            at_a.append(i)
            at_b.append(j)
            if a[i] < b[j]:
                i += 1
            elif i < x:
                j += 1
            elif j < y:
                j += 1
            else:
                break
    return (np.concatenate([np.repeat(first[:, 0], n) + along, np.array(at_a, np.int64)]),
            np.concatenate([np.repeat(first[:, 1], n) + along, np.array(at_b, np.int64)]))


def spelt(p: Pair, a: np.ndarray, b: np.ndarray, runs, groups) -> bytes:
    """The groups in order, as decimal ids: all tokens take the places of the
    text a1,a2|b1;a3|b2 at once, each with the sign that follows it."""
    irregular = np.array(groups, np.int64).reshape(-1, 4)
    first = np.array(runs, np.int64).reshape(-1, 3)
    n = first[:, 2]
    along = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)  # the last token of its group
    last_a[np.repeat(first[:, 0], n) + along] = True
    last_a[irregular[:, 1]] = True
    last_b[np.repeat(first[:, 1], n) + along] = True
    last_b[irregular[:, 3]] = True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    through_a, through_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # tokens up to each group's end
    place_a = np.arange(len(a)) + np.append(0, through_b)[group_a]
    place_b = np.arange(len(b)) + through_a[group_b]
    out = np.empty(len(a) + len(b), np.uint64)
    number, behind = p.digits
    for ids, place, last, sign in ((a, place_a, last_a, "|"), (b, place_b, last_b, ";")):
        out[place] = number[ids] | np.where(last, np.uint64(ord(sign)), np.uint64(ord(","))) << behind[ids]
    return out.astype("<u8").tobytes().translate(None, b"\0")[:-1]


def aligned(p: Pair, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    """Groups, the links' id pairs (A's id times B's vocabulary plus B's id) and the groups as text."""
    ends_a, ends_b = np.cumsum(p.length_a[a]).tolist(), np.cumsum(p.length_b[b]).tolist()
    runs, groups = diagonal_runs(ends_a, ends_b)
    at_a, at_b = links_of(ends_a, ends_b, runs, groups)
    return sum(n for _, _, n in runs) + len(groups), a[at_a] * len(p.bytes_b) + b[at_b], spelt(p, a, b, runs, groups)


def packed(codes: np.ndarray) -> bytes:
    """32-bit codes, byte by byte of all, compressed."""
    return zstandard.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def link_chunks(df: DataFrame, spec_path: str, model_path: str, key: str, text: str, chunk_links: int = CHUNK_LINKS) -> tuple[DataFrame, int]:
    """One row a chunk: its documents' keys, counts and groups, the links as
    codes, and the id pairs that the codes stand for (the most frequent first)
    with their counts; and the size of B's vocabulary."""
    spark = df.sparkSession
    ship_package(spark)
    with open(model_path, "rb") as f:
        files = spark.sparkContext.broadcast((bpe.read_spec(spec_path), f.read()))
    kind = df.schema[key].dataType
    key_type = to_arrow_type(kind)
    fields = (f"chunk bigint, keys array<{kind.simpleString()}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
              "groups array<string>, codes binary, pairs array<bigint>, counts array<bigint>")
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches):
        p = pair(*files.value)
        chunk, docs, links, size = TaskContext.get().partitionId() << 33, [], [], 0

        def close():
            nonlocal chunk, docs, links, size
            chunk += 1
            pairs, codes, counts = np.unique(np.concatenate([*links, EMPTY]), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            keys, *numbers, groups = zip(*docs)
            lists = [pa.array([list(n)], pa.list_(pa.int64())) for n in numbers]
            out = [pa.array([chunk], pa.int64()), pa.array([list(keys)], pa.list_(key_type)), *lists, pa.array([list(groups)], pa.list_(pa.string())),
                   pa.array([packed(place[codes])], pa.binary()), pa.array([pairs[order].tolist()], pa.list_(pa.int64())), pa.array([counts[order].tolist()], pa.list_(pa.int64()))]
            docs, links, size = [], [], 0
            return pa.RecordBatch.from_arrays(out, names)

        for batch in sliced(batches):
            texts, keys = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            for start, end in steps(texts):
                for k, ids in zip(keys[start:end], p.encode(texts[start:end])):
                    if ids is None:
                        docs.append((k, 0, 0, 0, 0, ""))
                        continue
                    groups, pairs, as_ids = aligned(p, *ids)
                    docs.append((k, len(ids[0]), len(ids[1]), groups, len(pairs), sha256(as_ids).hexdigest()))
                    links.append(pairs)
                    size += len(pairs)
                    if size >= chunk_links:
                        yield close()
        if docs:
            yield close()

    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return written(src.mapInArrow(run, fields), "alignment-chunks"), pair(*files.value).b.get_piece_size()


def pair_counts(chunks: DataFrame, b_size: int) -> DataFrame:
    """pair, n (its links in all documents) and best (whether no pair of its B id has more)."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("e")).select("e.*")
    total = written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")), "alignment-pairs")
    high = total.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("high"))
    # one row an id of B's vocabulary at most
    return total.join(F.broadcast(high), F.col("pair") % b_size == F.col("b")).select("pair", "n", (F.col("n") == F.col("high")).alias("best"))


def align(df: DataFrame, spec_path: str, model_path: str, key: str = "doc_id", text: str = "text", chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    chunks, b_size = link_chunks(df, spec_path, model_path, key, text, chunk_links)
    here = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    found = here.join(pair_counts(chunks, b_size), "pair").groupBy("chunk").agg(
        *[F.collect_list(c).alias(c) for c in ("place", "n", "best")])  # all of the same rows, in one order
    rows = chunks.select("chunk", "keys", "n_a", "n_b", "n_groups", "n_links", "groups", "codes").join(found, "chunk", "left").drop("chunk")

    def make():
        def run(keys, n_a, n_b, n_groups, n_links, groups, codes, place, n, best):
            value, high = np.zeros((2, len(place or ()) + 1), np.int64)
            if place:
                value[place], high[place] = n, best
            codes = unpacked(codes)
            ends = np.cumsum([0, *n_links])
            sums = [np.concatenate([[0], np.cumsum(table[codes])])[ends] for table in (high, value)]
            return list(zip(keys, n_a, n_b, n_groups, n_links, *(np.diff(s).tolist() for s in sums), groups))
        return run

    kind = df.schema[key].dataType.simpleString()
    out = map_rows(rows, make, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string", 4096)
    return out.withColumnRenamed("key", key)


def best_matches(df: DataFrame, spec_path: str, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table that the links give: for each id of B the ids of A that it is linked with most often."""
    chunks, b_size = link_chunks(df, spec_path, model_path, key, text)
    return pair_counts(chunks, b_size).where("best").select((F.col("pair") % b_size).cast("int").alias("b_id"), F.floor(F.col("pair") / b_size).cast("int").alias("a_id"), "n")
