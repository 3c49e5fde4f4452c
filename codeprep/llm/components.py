"""Connected components of links, as joins and minima on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprep.llm.common import written


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """id, component (the smallest id that can be reached) for each id of ``links``.

    Rounds of large and small stars: each id's larger neighbours, then its
    smaller ones, move to the least id it knows.  The number of rounds grows
    with the logarithm of the longest chain; each round is written to the
    shared folder, and only a count and a sum come to the driver.  An id with
    very many links is a hot join key that adaptive execution splits; its
    minimum is taken with partial sums.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u <> v").distinct(), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return roots.union(edges.select("v", "v").distinct())
