"""Operator 8: packing by concatenate and cut.

All documents' ids, each document closed by one separator, make one long
line that is cut into windows of ``size``.  First pass: each task encodes its
documents, notes each document's start within the task and writes the ids to
the shared folder.  The tasks' totals (one row a task) give the tasks' global
offsets by prefix sums.  Second pass: each document's global start is its
task's offset plus its own start, so its pieces follow without any shuffle; a
document that crosses a window's limit gives one boundary record a window.

Only the last window can be short of ``size``.  Null text: as the empty text,
which is the separator alone.  Texts longer than a window give many pieces; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeprep.llm.bpe import codec, read_spec
from codeprep.llm.common import map_texts, written

SIZE, SEPARATOR = 1024, 0
#: Pieces of one Arrow batch (4 KB each at most at the default size).
BATCH_PIECES = 4096


def token_table(df: DataFrame, tokenizer_path: str, separator: int = SEPARATOR, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """First pass: key, task, start in the task, n_tokens and the ids, written once."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def make():
        c, task, total = codec(spec.value), TaskContext.get().partitionId(), 0
        kind = "<u2" if len(c.table) <= 1 << 16 and separator < 1 << 16 else "<u4"

        def run(texts):
            nonlocal total
            ids = [np.array([*c.ids(t), separator], kind).tobytes() for t in texts]
            n = np.array([len(i) // int(kind[-1]) for i in ids], np.int64)
            starts = total + np.cumsum(n) - n
            total += int(n.sum())
            return {"task": np.full(len(n), task, np.int32), "start": starts, "n_tokens": n, "ids": ids}
        return run

    return written(map_texts(df, [key], text, make, "task int, start bigint, n_tokens bigint, ids binary"), "packing")


def task_offsets(tokens: DataFrame) -> DataFrame:
    """task, base: the tokens of all tasks before.  The window runs over one row a task."""
    totals = tokens.groupBy("task").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def pack(df: DataFrame, tokenizer_path: str, size: int = SIZE, separator: int = SEPARATOR, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row a piece: key, start and length in the document's ids, the ids
    (binary, little-endian 32-bit), doc_tokens, sequence_id and offset there."""
    tokens = token_table(df, tokenizer_path, separator, key, text)
    # one row a task of the first pass: as bounded as Spark's own list of tasks
    placed = tokens.join(F.broadcast(task_offsets(tokens)), "task").select(
        F.col(key).alias("k"), (F.col("base") + F.col("start")).alias("at"), "n_tokens", "ids")
    fields = "start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    names = ["k", *(f.split(" ")[0] for f in fields.split(", "))]

    def cut(batches):
        for batch in batches:
            keys, rows = [], []
            kinds = batch.schema.field(0).type
            for k, at, n, ids in zip(*(batch.column(j).to_pylist() for j in range(4))):
                ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                cuts = [0, *range(size - at % size, n, size), n]
                for a, b in zip(cuts, cuts[1:]):
                    part = ids[a:b].tobytes()
                    keys.append(k)
                    rows.append((a, b - a, part, zlib.crc32(part), n, (at + a) // size, (at + a) % size))
                if len(rows) >= BATCH_PIECES:
                    yield as_batch(keys, rows, kinds)
                    keys, rows = [], []
            if rows:
                yield as_batch(keys, rows, kinds)

    def as_batch(keys, rows, kind):
        cols = [pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int64()) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *cols], names)

    kind = dict(placed.dtypes)["k"]
    return placed.mapInArrow(cut, f"k {kind}, {fields}").withColumnRenamed("k", key)


def piece_digests(df: DataFrame, tokenizer_path: str, size: int = SIZE, separator: int = SEPARATOR) -> DataFrame:
    return pack(df, tokenizer_path, size, separator).drop("ids")
