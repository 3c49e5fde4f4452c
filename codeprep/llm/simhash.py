"""Operator 7: document fingerprints by SimHash, in DataFrame operations alone.

Terms are words (weight 1) and pairs of neighbouring words (weight 2).  Each
term's 64-bit hash votes with its weight, for or against each bit; a bit is
set if the votes for it are more than half of all.  Two bits are counted in
the halves of one 64-bit sum, so 32 sums give the 64 counts; a half holds
2**32 votes, more than the longest string has.

Search: a fingerprint is cut into ``BLOCKS`` blocks.  If two fingerprints
differ in at most ``RADIUS`` bits, some BLOCKS - RADIUS blocks of them are
equal; each choice of blocks, moved to the front, is a table, so all pairs
within the radius meet in a table, on a key of about 32 bits.  A pair counts
in the first table in which it meets.

Null text: as the empty text, without a term, whose fingerprint is zero.
Rows of one id are one document, that of the longest text (of several, the
least); rows without id have no place in the order and are left out.  Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprep.llm.common import written

RADIUS, BLOCKS = 3, 6
HALVES = (1 << 32) | 1  # the lowest bit of each half


def _sums(word: Column, pair: Column) -> list[Column]:
    def votes(h: Column, i: int) -> Column:
        return F.shiftrightunsigned(h, i).bitwiseAND(F.lit(HALVES))

    return [F.sum(votes(word, i) + F.coalesce(2 * votes(pair, i), F.lit(0))).alias(f"v{i}") for i in range(32)]


def _bits() -> Column:
    """The fingerprint from the sums and the number of votes."""
    out = F.lit(0).cast("bigint")
    for i in range(32):
        low, high = F.col(f"v{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"v{i}"), 32)
        for place, ones in ((i, low), (i + 32, high)):
            bit = 1 << place if place < 63 else -(1 << 63)
            out = out.bitwiseOR(F.when(2 * ones > F.col("total"), F.lit(bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, the votes (0: no word) and the 64-bit ``fingerprint`` of each
    row.  Keys must tell the rows apart; a partitioning by some of them is kept."""
    hashes = F.transform(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    rows = texts.select(*keys, hashes.alias("h"))
    pairs = F.transform("h", lambda x, i: F.struct(x.alias("word"), F.when(i + 1 < F.size("h"), F.xxhash64(x, F.get("h", i + 1))).alias("pair")))
    terms = rows.select(*keys, F.inline_outer(pairs))
    total = (F.count("word") + 2 * F.count("pair")).alias("total")
    return terms.groupBy(*keys).agg(total, *_sums(F.col("word"), F.col("pair"))).select(*keys, F.col("total").alias("votes"), _bits().alias("fingerprint"))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b))


def likeness(a: str, b: str) -> Column:
    """The cosine that the distance stands for, 0 at right angles and beyond."""
    return F.round(F.greatest(F.lit(0.0), F.cos(distance(a, b) * F.lit(3.141592653589793 / 64))), 6)


def _block(c: Column, i: int) -> Column:
    lo, hi = 64 * i // BLOCKS, 64 * (i + 1) // BLOCKS
    return F.shiftrightunsigned(c, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


TABLES = list(combinations(range(BLOCKS), BLOCKS - RADIUS))


def _tables(c: Column) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[_block(c, i) for i in blocks]).alias("key")) for t, blocks in enumerate(TABLES)])


def _first_table(x: Column) -> Column:
    """The first table in which two fingerprints with this difference meet."""
    first = F.lit(None).cast("int")
    for t, blocks in reversed(list(enumerate(TABLES))):
        same = F.lit(True)
        for i in blocks:
            same = same & (_block(x, i) == 0)
        first = F.when(same, F.lit(t)).otherwise(first)
    return first


def count_within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint, n: how many rows of ``prints`` have a fingerprint within
    the radius, for each fingerprint of ``queries``.  Equal fingerprints are
    one row, so a group of copies is one entry of each table."""
    if radius > RADIUS:
        raise ValueError(f"the tables find distances up to {RADIUS}")
    known = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).select(F.col("fingerprint").alias("f"), "n", F.inline(_tables(F.col("fingerprint"))))
    asked = queries.select("fingerprint").distinct().select(F.col("fingerprint").alias("q"), F.inline(_tables(F.col("fingerprint"))))
    x = F.col("f").bitwiseXOR(F.col("q"))
    k, a = known.alias("k"), asked.alias("a")
    met = k.join(a, (F.col("k.key") == F.col("a.key")) & (F.col("k.t") == F.col("a.t")) & (F.bit_count(x) <= radius) & (_first_table(x) == F.col("k.t")))
    return met.groupBy(F.col("q").alias("fingerprint")).agg(F.sum("n").alias("n"))


def with_next(ids: DataFrame, key: str) -> DataFrame:
    """``ids`` with ``next``: the key that follows in descending order, the
    first after the last.  Ranges of keys are ordered each on its own; only
    their first keys (one row a range) are ordered as a whole."""
    ranged = written(ids.repartitionByRange(F.desc(key)).withColumn("part", F.spark_partition_id()), "simhash")
    order = Window.orderBy(F.desc("first"))
    ends = ranged.groupBy("part").agg(F.max(key).alias("first"))
    after = ends.select("part", F.coalesce(F.lead("first").over(order), F.max("first").over(Window.partitionBy())).alias("after"))
    within = ranged.withColumn("lead", F.lead(key).over(Window.partitionBy("part").orderBy(F.desc(key))))
    return within.join(F.broadcast(after), "part").select(*ids.columns, F.coalesce("lead", "after").alias("next"))


def edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, next, n_chars, text and edited text: its last third gives way to as
    much of the next document's beginning.  Texts are dealt out by id once;
    of the next documents only the beginnings that are needed travel.  The table
    of ids grows with the documents, so it is never broadcast."""
    rows = df.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text")).where("id is not null")
    one = rows.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.length("text")), "text"))).where("at = 1").drop("at")
    ids = with_next(rows.groupBy("id").agg(F.max(F.length("text")).alias("n")), "id")
    links = written(ids, "simhash")
    wanted = links.select(F.col("next").alias("id"), F.col("id").alias("for"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    heads = one.join(wanted.hint("merge"), "id").select(F.col("for").alias("id"), F.expr("substring(text, 1, need)").alias("head"))
    return one.join(links.hint("merge"), "id").join(heads.hint("merge"), "id").select(
        "id", "next", F.col("n").cast("bigint").alias("n_chars"), "text",
        F.concat(F.expr("substring(text, 1, n - cast(floor(n / 3) as int))"), "head").alias("edited"))


def edit_report(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = 20) -> DataFrame:
    """Fingerprints of each document and of its edited text, their likeness,
    that to the next document, and, for ids divisible by ``every``, how many
    other documents lie within the radius (n_within)."""
    names = ["id", "next", "n_chars", "edited_sha256", "e"]
    both = edited(df, key, text).select("id", "next", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.inline(F.array(
        F.struct(F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("t")))))
    prints = written(fingerprints(both, names, "t"), "simhash")
    own = prints.where("e = 0")
    other = prints.where("e = 1").select("id", F.col("fingerprint").alias("edited_fingerprint"))
    after = own.select(F.col("id").alias("next"), F.col("fingerprint").alias("next_fingerprint"))
    worded = own.where("votes > 0")
    near = count_within(worded, worded.where(F.col("id") % every == 0))
    found = own.join(other, "id").join(after, "next").join(near, "fingerprint", "left")
    as_hex = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return found.select(F.col("id").alias(key), "n_chars", "edited_sha256", as_hex("fingerprint").alias("fingerprint"),
                        as_hex("edited_fingerprint").alias("edited_fingerprint"), likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                        likeness("fingerprint", "next_fingerprint").alias("near_next"),
                        F.when((F.col("id") % every == 0) & (F.col("votes") > 0), F.col("n") - 1).alias("n_within"))
