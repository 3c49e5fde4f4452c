"""Operator 13: mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) take the weights in turn and share
``percent`` of all words; a source's target stops at ``most`` times its size
and what is over is shared anew by weight until no target is above.  The
shares are a ratio of whole numbers, found by rounds of one small aggregate
over the table of sources (each round caps at least one more source).

Within a source every document expects target / size copies.  Documents lie
in order of size, so a prefix sum of the expected copies, one random offset
added, crosses whole numbers evenly over all sizes: a document is emitted once
for each whole number crossed, and the words taken differ from the target by
about one document at most.  Prefix sums are a distributed numbering (range
partitions, a row count for each partition and source, running sums), so a
source that holds a third of all rows is spread over the partitions.  Expected
copies and offset are whole multiples of 2**-24 and all sums are exact: reruns
agree, whatever the partitions.

Null or empty text: size 0, no copy counts for any words.  Null source: a
source of its own, the last.  Null and repeated ids: each row is a document.
Ties in size go by id; rows that tie in both differ in nothing that the result
shows but which of them a copy falls to.  Very long texts are counted whole; a
source of one document takes it a whole number of times.  An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprep.llm.common import written
from codeprep.operators.joins import checked_broadcast
from codeprep.operators.numbering import consecutive_index

WEIGHTS, PERCENT, MOST, SEED = (5, 2, 1), 150, 2, 0
#: Expected copies and offsets are whole multiples of 2 ** -BITS.
BITS = 24


def shares(sources: DataFrame, percent: int, most: int) -> tuple[int, int]:
    """The share of one unit of weight in hundredths of a word, as numerator
    and denominator, from columns ``size`` and ``weight``."""
    def state(capped):
        own = sources.agg(F.sum("size").alias("total"), F.sum(F.when(capped, F.col("size"))).alias("gone"),
                          F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        return percent * (own.total or 0) - 100 * most * (own.gone or 0), own.open or 0

    num, den = state(F.lit(False))
    while den:
        new = state(above(num, den, most))
        if new == (num, den):
            break
        num, den = new
    return num, max(den, 1)


def above(num: int, den: int, most: int):
    """Whether a source's share is above its limit, in whole numbers of any size."""
    return F.col("weight").cast("decimal(10,0)") * F.lit(Decimal(num)) > F.col("size").cast("decimal(18,0)") * F.lit(Decimal(100 * most * den))


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int, seed: int) -> DataFrame:
    """One row a source: tag, source_size, target, step (expected copies of a
    document) and first (the random offset) from columns tag and size."""
    if 100 * most < percent:
        raise ValueError("the sources cannot give that many words")
    by_source = sizes.groupBy("tag").agg(F.sum("size").alias("size"))
    # tags sort as the sources do, by code point, the null source's last
    at = consecutive_index(by_source, [F.col("tag")], "at")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    sources = written(at.select("tag", "size", weight.cast("bigint").alias("weight")), "mixing-sources")
    num, den = shares(sources, percent, most)
    full = above(num, den, most)
    target = F.when(full, (F.col("size") * most).cast("double")).otherwise((F.col("weight") * num).cast("double") / F.lit(100 * den).cast("double"))
    one = 1 << BITS
    step = F.when(F.col("size") == 0, 0).when(full, most * one).otherwise(
        F.least(F.lit(most * one), F.floor(F.col("target") / F.col("size") * one)))
    first = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "tag")), 1, BITS // 4), 16, 10).cast("bigint")
    return sources.withColumn("target", target).select("tag", F.col("size").alias("source_size"), "target",
                                                       step.cast("bigint").alias("step"), first.alias("first"))


def plan(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: int = SEED,
         key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target, copies and taken (copies x size) of each row."""
    tag = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t"))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    sizes = written(df.select(F.col(key).alias("k"), tag.alias("tag"), size.alias("size")), "mixing-sizes")
    to = checked_broadcast(targets(sizes, weights, percent, most, seed))
    rows = sizes.withColumn("row", F.monotonically_increasing_id()).join(to, "tag")
    placed = consecutive_index(rows, [F.col("size"), F.col("k"), F.col("row")], "at", group_cols=["tag"])

    def crossed(at):
        return F.shiftright(F.col("first") + at * F.col("step"), BITS)

    copies = crossed(F.col("at") + 1) - crossed(F.col("at"))
    return placed.select(F.col("k").alias(key), "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))


def mix(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mixed table itself: every column of ``df``, each row as often as it is taken."""
    names = df.columns
    rows = written(df.select(F.monotonically_increasing_id().alias("mix_row"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("mix_values")), "mixing-rows")
    own = {n: options.pop(n, n) for n in ("text", "source")}
    flat = rows.select("mix_row", *[F.col(f"mix_values.`{c}`").alias(n) for n, c in own.items()])
    copies = plan(flat, key="mix_row", **options).where("copies > 0").select("mix_row", "copies")
    return rows.join(copies, "mix_row").select(F.explode(F.array_repeat("mix_values", F.col("copies").cast("int"))).alias("v")).select("v.*")
