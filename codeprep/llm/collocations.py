"""Operator 11: phrase collocations by multikey three-way quicksort.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces
and those into words.  Every word begins a suffix of its piece, read up to
``LONGEST`` words.  A phrase's frequency is the number of suffixes that begin
with it.

1. Tasks number the words of bounded chunks of text and keep each chunk as
   codes and a list of distinct words (``word_chunks``).  Word totals of all
   chunks give the vocabulary of words frequent enough (``vocabulary``); the
   others end a piece, as no frequent phrase holds one.
2. Each chunk's suffixes become rows of word numbers, equal ones one row with
   a count, in sorted order (``suffix_runs``).  An even sample of the runs,
   some rows a part, gives limits that cut the sorted order into parts of
   bounded size: suffixes are routed by their leading words, however frequent
   one word or pair is (``suffix_parts``).
3. Each part is sorted by three-way quicksort on one word at a time.  The
   suffixes equal to the pivot have one more word in common: their number is
   that phrase's frequency.  A partition below the least frequency is
   abandoned (``quicksort_counts``).  Only a phrase that begins a limit between
   parts can lie in several parts; those parts' counts are added up.

Scores, the removal of phrases within longer ones and the ranks are joins and
windows over the frequent phrases, in decimal arithmetic of 38 digits.

Null text: no words.  Null language: ``und``.  Empty texts and pieces give no
words; very long texts are read in slabs, as a whole.  Repeated rows and ids
count each time; ties go by the stated order, the last of which is the phrase
itself.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeprep.llm.common import map_rows, sliced, written
from codeprep.operators.numbering import consecutive_index
from codeprep.session import partition_by_key

LONGEST, LEAST, PERCENT, TOP = 5, 100, 100, 2000
#: Word codes gathered in a task before a chunk is closed, bytes of a long text read at once.
CHUNK_WORDS, SLAB = 3_000_000, 1 << 20
#: Rows of one part at most (about), and rows of the sample for each part.
PART_ROWS, PART_SAMPLE = 1_000_000, 32

#: Bytes as the contract reads them: capitals lowered, the tab a space, what ends a piece a line feed.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
BREAK = 1


class _Codes(dict):
    """Numbers of a chunk's distinct words; 0 is no word, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": BREAK})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def slabs(text: str) -> Iterator[bytes]:
    """The text's bytes, translated, in slabs that end at a piece's end or a space."""
    b = text.encode().translate(_BYTES)
    at = 0
    while len(b) - at > 2 * SLAB:
        end = b.find(b"\n", at + SLAB, at + 2 * SLAB)
        if end < 0:
            end = b.find(b" ", at + SLAB)
        if end < 0:
            break
        yield b[at:end + 1]
        at = end + 1
    yield b[at:] + b"\n"


def word_chunks(df: DataFrame, lang: str = "lang", text: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row a chunk of one language: chunk, lang, n_words, codes (packed by
    ``planes``), and its distinct words with their counts, the most frequent
    first, which has code 2."""
    fields = "chunk bigint, lang string, n_words bigint, codes binary, words array<string>, counts array<int>"

    def run(batches):
        held: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
        chunk = TaskContext.get().partitionId() << 33

        def close(name):
            nonlocal chunk
            book, parts = held.pop(name)
            codes = np.concatenate(parts)
            codes = codes[codes > 0]
            counts = np.bincount(codes, minlength=len(book))[2:]
            order = np.argsort(-counts, kind="stable")  # frequent words have small codes
            place = np.append([0, BREAK], np.empty(len(order), np.int64))
            place[order + 2] = np.arange(2, len(place))
            counts, spelt = counts[order], list(book)[2:]
            chunk += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([name]), pa.array([int(counts.sum())], pa.int64()), pa.array([planes(place[codes])], pa.binary()),
                 pa.array([[spelt[i] for i in order.tolist()]], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int32()))],
                ["chunk", "lang", "n_words", "codes", "words", "counts"])

        size = 0
        for batch in sliced(batches):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for slab in slabs(t or ""):
                    book, parts = held.setdefault(name, (_Codes(), []))
                    tokens = slab.replace(b"\n", b" \n ").split(b" ")
                    parts.append(np.fromiter(map(book.__getitem__, tokens), np.int32, len(tokens)))
                    size += len(tokens)
                    if size >= chunk_words and slab.endswith(b"\n"):
                        largest = max(held, key=lambda k: sum(map(len, held[k][1])))
                        size -= sum(map(len, held[largest][1]))
                        yield close(largest)
        for name in list(held):
            yield close(name)

    src = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return written(src.mapInArrow(run, fields), "collocation-chunks")


def vocabulary(chunks: DataFrame, least: int) -> DataFrame:
    """id (from 1), lang, word and f of the words that occur ``least`` times or more."""
    each = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", "w.*")
    f = each.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    # small numbers for frequent words: their columns compress best
    return consecutive_index(f, [F.desc("f"), F.col("lang"), F.col("word")], "id", start=1).select("id", "lang", "word", "f")


def numbered_chunks(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """chunk, codes, and for each frequent word of the chunk its place there and its id."""
    here = chunks.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
    # every distinct word of a chunk is looked up, a row out for a row in; rare words have no id and no place in the lists
    looked = here.join(words.select("lang", "word", "id").hint("merge"), ["lang", "word"], "left")
    known = looked.groupBy("chunk").agg(
        F.collect_list(F.when(F.col("id").isNotNull(), F.col("place"))).alias("places"),
        F.collect_list("id").alias("ids"))  # both of the same rows, in one order; nulls are left out
    return chunks.select("chunk", "codes").join(known.hint("merge"), "chunk")


def suffix_rows(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of at least two words (columns: words, 0 after the
    end) in sorted order, and how often each occurs.  In ``ids`` 0 ends a piece."""
    at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    cols = [padded[at], padded[at + 1]]
    for i in range(2, longest):
        cols.append(np.where(cols[-1] != 0, padded[at + i], 0))
    order = np.lexsort(cols[::-1])
    rows = np.stack([c[order] for c in cols]) if len(at) else np.zeros((longest, 0), ids.dtype)
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    first = np.flatnonzero(new)
    return rows[:, first], np.diff(np.append(first, len(at)))


def planes(values: np.ndarray) -> bytes:
    """Whole numbers of 0 and more, all their lowest bytes first, compressed."""
    width = 4 if not values.size or values.max() < 1 << 32 else 8
    return bytes([width]) + zstandard.compress(values.astype(f"<u{width}").reshape(-1).view(np.uint8).reshape(-1, width).T.tobytes(), 3)


def from_planes(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").reshape(-1).astype(np.int64)


def packed(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted rows, column by column (the first as differences), and their counts."""
    return planes(np.concatenate([np.diff(rows[0], prepend=0)[None], rows[1:], counts[None] - 1]))


def unpacked(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = from_planes(blob).reshape(width + 1, -1)
    np.cumsum(rows[0], out=rows[0])
    return rows[:-1], rows[-1] + 1


def suffix_runs(numbered: DataFrame, longest: int, every: int) -> DataFrame:
    """One row a chunk: its sorted distinct suffixes, and each ``every``-th of them."""
    def make():
        def run(chunk, codes, places, ids):
            codes = from_planes(codes)
            book = np.zeros(max(int(codes.max(initial=0)), max(places, default=0) + 2) + 1, np.int64)
            book[np.array(places, np.int64) + 2] = ids
            rows, counts = suffix_rows(book[codes], longest)
            at = np.arange(chunk * 0x9E3779B1 % every, rows.shape[1], every)
            return [(chunk, rows.shape[1], packed(rows, counts), rows[:, at].T.tolist())]
        return run

    return written(map_rows(numbered.select("chunk", "codes", "places", "ids"), make,
                            "chunk bigint, n_rows bigint, run binary, sample array<array<bigint>>"), "collocation-runs")


def cut_points(rows: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each limit the number of sorted rows before it (columns: rows, limits)."""
    lo, hi = np.zeros(limits.shape[1], np.int64), np.full(limits.shape[1], rows.shape[1])
    for column, limit in zip(rows, limits):
        for i in range(len(limit)):  # within the rows equal so far
            part = column[lo[i]:hi[i]]
            lo[i], hi[i] = lo[i] + np.searchsorted(part, limit[i], "left"), lo[i] + np.searchsorted(part, limit[i], "right")
    return lo


def suffix_parts(runs: DataFrame, longest: int, part_rows: int) -> tuple[DataFrame, np.ndarray]:
    """part and run: the runs cut at limits between parts; and the limits.
    The driver sees some ``PART_SAMPLE`` sampled rows a part, as a sort does."""
    total = runs.agg(F.sum("n_rows")).first()[0] or 0
    sample = sorted(tuple(r[0]) for r in runs.select(F.explode("sample")).collect())
    parts = max(1, -(-total // part_rows))
    limits = sorted({sample[len(sample) * i // parts] for i in range(1, parts)} if sample else set())
    limits = np.array(limits, np.int64).reshape(len(limits), longest).T

    def make():
        def run(blob):
            rows, counts = unpacked(blob, longest)
            at = [0, *cut_points(rows, limits).tolist(), rows.shape[1]]
            return [(p, packed(rows[:, a:b], counts[a:b])) for p, (a, b) in enumerate(zip(at, at[1:])) if a < b]
        return run

    return map_rows(runs.select("run"), make, "part int, run binary"), limits


def quicksort_counts(rows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Multikey three-way quicksort of pointers to the columns of ``rows``.

    All partitions of the pointers take a step at once: by one word at the
    partition's depth, pointers go to the less, equal or greater side of a
    pivot from the middle.  The equal side is the phrase of one word more: its
    summed counts are the frequency, and it goes on at the next depth.  Sides
    with a sum below ``least``, and phrases at full depth or at a piece's end,
    leave the sort.  Yields (first pointer of each, frequencies, depth) for
    phrases of two words or more."""
    width, n = rows.shape
    flat = rows.reshape(-1)
    pointers = np.arange(n)
    starts, depths = np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)
    while len(starts):
        sizes = np.diff(np.append(starts, len(pointers)))
        owner = np.repeat(np.arange(len(starts)), sizes)
        word = flat[depths[owner] * n + pointers]
        pivot = np.sort(np.stack([word[starts], word[starts + sizes // 2], word[starts + sizes - 1]]), 0)[1]
        side = owner * 3 + 1 + np.sign(word - pivot[owner])  # 3 sides for each partition
        weight = np.bincount(side, counts[pointers], 3 * len(starts)).astype(np.int64)
        deeper = np.repeat(depths, 3)
        equal = np.arange(len(weight)) % 3 == 1
        deeper[equal] += 1
        real = ~equal | (np.repeat(pivot, 3) != 0)  # 0: the piece ends here
        alive = (weight >= least) & real
        order = np.argsort(side, kind="stable")
        order = order[alive[side[order]]]
        kept = np.bincount(side[order], minlength=len(weight))
        first = np.cumsum(kept) - kept
        pointers = pointers[order]
        for depth in range(2, width + 1):
            found = alive & equal & (deeper == depth)
            if found.any():
                yield pointers[first[found]], weight[found], depth
        on = alive & (deeper < width)
        stays = np.repeat(on, kept)
        pointers, depths = pointers[stays], deeper[on]
        starts = np.cumsum(kept[on]) - kept[on]


def phrase_counts(parts: DataFrame, limits: np.ndarray, longest: int, least: int) -> DataFrame:
    """p (array of word ids, two or more) and a: the frequent phrases."""
    kind = pa.list_(pa.int64())

    def count(key, table):
        part = key[0].as_py()
        runs = [unpacked(b, longest) for b in table.column("run").to_pylist()]
        rows = np.ascontiguousarray(np.concatenate([r for r, _ in runs], 1))
        counts = np.concatenate([c for _, c in runs])
        phrases, sums = [], []
        for pointers, f, depth in quicksort_counts(rows, counts, least):
            phrases += rows[:depth, pointers].T.tolist()
            sums += f.tolist()
        # what begins a limit of this part may go on in the next one: its sum counts even if it is small
        edges = {tuple(limits[:d, i].tolist()) for i in (part - 1, part) if 0 <= i < limits.shape[1] for d in range(2, longest + 1)}
        for edge in sorted(e for e in edges if e[-1]):
            f = int(counts[(rows[:len(edge)] == np.array(edge)[:, None]).all(0)].sum())
            if 0 < f < least:
                phrases.append(list(edge))
                sums.append(f)
        return pa.table({"p": pa.array(phrases, kind), "a": pa.array(sums, pa.int64())})

    counted = partition_by_key(parts, "part").groupBy("part").applyInArrow(count, "p array<bigint>, a bigint")
    return counted.groupBy("p").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """lang, p, a, l, r, n, score of the phrases that lie in no longer one of about their frequency.

    A longer phrase's parts of one word less are at least as frequent as it, so
    it is enough to look one word further."""
    size = F.size("p")
    inner = phrases.where(size > 2).select(F.explode(F.array(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"))).alias("p"), F.col("a").alias("longer"))
    within = inner.groupBy("p").agg(F.max("longer").alias("longer")).where(F.col("longer").isNotNull())
    free = phrases.join(within, "p", "left").where("longer is null or 100 * cast(longer as decimal(20,0)) < cast(a as decimal(20,0)) * %d" % percent)
    every = phrases.select("p", "a").unionByName(words.select(F.array("id").alias("p"), F.col("f").alias("a")))
    cuts = free.select("p", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "p", "a", "k", F.expr("slice(p, 1, k)").alias("left"), F.expr("slice(p, k + 1, size(p) - k)").alias("right"))
    cuts = (cuts.join(every.select(F.col("p").alias("left"), F.col("a").alias("l")), "left")
            .join(every.select(F.col("p").alias("right"), F.col("a").alias("r")), "right")
            .join(words.select(F.col("id").alias("head"), "lang"), F.col("head") == F.col("p")[0]).join(sizes, "lang"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    cuts = cuts.withColumn("up", (wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")).withColumn("down", wide["l"] * wide["r"])
    cuts = cuts.withColumn("score", F.expr("up div down"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "p", "a", "n").agg(best).select("lang", "p", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT,
                 top: int = TOP, chunk_words: int = CHUNK_WORDS, part_rows: int = PART_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases."""
    spark = df.sparkSession
    chunks = word_chunks(df, lang, text, chunk_words)
    sizes = written(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")).where("n > 0"), "collocation-sizes")
    words = written(vocabulary(chunks, least), "collocation-vocabulary")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # small tables give each core some parts too
    part_rows = min(part_rows, max(1000, total // (4 * spark.sparkContext.defaultParallelism)))
    runs = suffix_runs(numbered_chunks(chunks, words), longest, max(1, part_rows // PART_SAMPLE))
    parts, limits = suffix_parts(runs, longest, part_rows)
    phrases = written(phrase_counts(parts, limits, longest, least), "collocation-phrases")
    found = written(scored(phrases, words, sizes, percent), "collocation-scores")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = found.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top).drop("rank")  # ties at the end are still all there
    spelt = (near.select("*", F.posexplode("p").alias("i", "id")).join(words.select("id", "word"), "id")
             .groupBy("lang", "p", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda s: s["word"]), " ").alias("phrase")))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return spelt.withColumn("rank", F.row_number().over(last).cast("bigint")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
