"""What the operators share: the input table, tables written to the shared
folder, and numpy views of a batch of texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from codeprep.session import ensure_checkpoint_dir, ship_package

#: Characters of text that one numpy step works on at most (a single longer
#: text is one step of its own).
STEP_CHARS = 500_000
#: Multiplier of the polynomial hashes (odd, so it has an inverse mod 2**64).
P = np.uint64(0x9E3779B97F4A7C15)
P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: lineage
    is cut and a lost executor costs no recomputation of earlier stages."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, so that few texts are Python strings at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def steps(texts: list[str], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` that hold about ``limit`` characters each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def map_texts(df: DataFrame, key: str | list[str], text: str, make: Callable[[], Callable[[list[str]], dict]],
              fields: str) -> DataFrame:
    """``key`` columns and what ``make()(texts)`` returns for each row's whole
    text, in Arrow batches.  ``make`` is called once a task; the function that
    it returns gets a bounded list of texts (None becomes "") and returns one
    list or array for each field."""
    key = [key] if isinstance(key, str) else key
    names = [f"k{i}" for i in range(len(key))]
    src = df.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col(text).alias("text"))
    out_schema = ", ".join(f"{n} {t.simpleString()}" for n, t in ((f.name, f.dataType) for f in src.schema[:-1]))
    ship_package(df.sparkSession)
    made = StructType.fromDDL(fields)
    field_names, kinds = made.names, [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            for a, b in steps(texts):
                got = fn(texts[a:b])
                cols = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(got[f], t) for f, t in zip(field_names, kinds)], names + field_names)

    out = src.mapInArrow(run, f"{out_schema}, {fields}")
    return out.select(*[F.col(n).alias(k) for k, n in zip(key, names)], *field_names)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], fields: str, out_rows: int = 64) -> DataFrame:
    """What ``make()(*values)`` returns for each row, a list of rows of
    ``fields``, for tables whose rows are blobs.  ``make`` is called once a
    task; rows are taken and given in small batches, as each may be large."""
    ship_package(df.sparkSession)
    made = StructType.fromDDL(fields)
    names, kinds = made.names, [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in sliced(batches, 1):
            rows = fn(*(c[0].as_py() for c in batch.columns))
            for i in range(0, len(rows), out_rows):
                cols = zip(*rows[i:i + out_rows])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return df.mapInArrow(run, fields)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points in one array, and the n + 1 limits of the texts in it."""
    limits = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=limits[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), limits


def seg_sum(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]; each depends on its own values alone."""
    if not len(values):
        return np.zeros(len(starts), values.dtype)
    padded = np.append(values, values.dtype.type(0))
    at = np.empty(2 * len(starts), np.int64)
    # an empty segment may begin behind the last value (n-grams of a text with fewer words)
    at[0::2], at[1::2] = np.minimum(starts, len(values)), np.minimum(np.maximum(starts, ends), len(values))
    out = np.add.reduceat(padded, at)[0::2]
    out[ends <= starts] = 0
    return out


def seg_min(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Minima of non-empty consecutive segments values[start:end]."""
    at = np.empty(2 * len(starts), np.int64)
    at[0::2], at[1::2] = starts, ends
    return np.minimum.reduceat(np.append(values, values.dtype.type(0)), at)[0::2]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = (n + (1 << 18) - 1) >> 18 << 18  # some more, so that it seldom grows
        for i, base in enumerate((P, P_INV)):
            steps_ = np.full(size, base, np.uint64)
            steps_[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps_)
    return _POWERS[0][:n], _POWERS[1][:n]


def words(cp: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` (none crosses a
    text's limit), and the text that each word lies in."""
    if not len(cp):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = (cp != 32) & ((cp - np.uint32(9)) > np.uint32(4))
    first, last = inside.copy(), inside.copy()
    edge = np.zeros(len(cp) + 1, bool)
    edge[limits] = True
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(limits, starts, "right") - 1


def word_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word cp[start:end], whatever its place."""
    up, down = _powers(len(cp) + 1)
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(mix(cp.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours in ``hashes``."""
    m = max(0, len(hashes) - n + 1)
    out = hashes[:m].copy()
    for i in range(1, n):
        out = out * P + hashes[i:i + m]
    return mix(out)
