"""Operator 4: near-duplicate documents by MinHash with tensored banding.

Two small collections of minhash groups, A and B, are computed for each
distinct set of shingles.  Every pair (A_i, B_j) is the key of one of
|A| x |B| tables, so 2 x GROUPS x WIDTH minhashes serve GROUPS**2 tables of
2 x WIDTH minhashes.  With WIDTH = 3 and GROUPS = 10, two sets of Jaccard
similarity 0.85 share no key with probability 1.5e-4, of 0.9 with 4e-6.

Whole result without all pairs of a bucket:

1. Equal sets form one class, named by its smallest document id; only
   classes are compared.
2. In each bucket every class is held against the bucket's smallest class
   (one row for each member), on the full sets; components follow.
3. Where a bucket still holds several components, its most central class (the
   fewest shingles that no other class has) is held against the classes of
   other components.
4. What is still apart is joined exactly by prefix filtering: of each set,
   ordered from its rarest shingle on, the first n - ceil(0.85 n) + 1 must
   share one with any set similar enough, and exact bounds of the overlap must
   hold.  Passages shared by many are frequent, hence last, and give
   no candidates.  Pairs of one component are not looked at again.

Nulls and texts without a word have an empty set and are linked with nothing.
Texts with fewer words than a shingle have their whole sequence as one.  A
document id that several rows carry is one document with several texts.  A
row without id joins the group of an equal text and is kept only if there is
none.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeprep.llm.common import chained, codepoints, map_texts, mix, seg_min, word_hashes, words, written
from codeprep.llm.components import components

SHINGLE, PERCENT, GROUPS, WIDTH = 5, 85, 10, 3
LANES = 8  # 64-bit numbers of a set's parities


def shingle_sets(texts: list[str], n: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles of n words as sorted 64-bit hashes; A-Z count as a-z."""
    cp, limits = codepoints(texts)
    cp = np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)
    starts, ends, of = words(cp, limits)
    hashes = word_hashes(cp, starts, ends)
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    grams = chained(hashes, n)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            sets.append(np.unique(grams[a:b - n + 1]))
        else:  # none, or the whole sequence
            sets.append(chained(hashes[a:b], b - a) + np.uint64(b - a) if b > a else hashes[:0])
    return sets


def group_hashes(sets: list[np.ndarray], groups: int = GROUPS, width: int = WIDTH, seed: int = 1) -> np.ndarray:
    """For each non-empty set its 2 x groups hashes of ``width`` minhashes each."""
    values = np.concatenate(sets)
    ends = np.cumsum([len(s) for s in sets])
    starts = ends - [len(s) for s in sets]
    salts = mix(np.arange(1, 2 * 2 * groups * width + 1, dtype=np.uint64) + np.uint64(seed << 32))
    out = np.empty((len(sets), 2 * groups), np.uint64)
    for g in range(2 * groups):
        key = np.full(len(sets), g + 1, np.uint64)
        for k in range(g * width, (g + 1) * width):
            low = seg_min((((values ^ salts[2 * k]) * (salts[2 * k + 1] | np.uint64(1))) >> np.uint64(32)).astype(np.uint32), starts, ends)
            key = mix(key * np.uint64(0x100000001B3) + low)
        out[:, g] = key
    return out


def _signatures(df: DataFrame, n: int, groups: int, width: int, key: str, text: str) -> DataFrame:
    def make():
        def run(texts):
            sets = shingle_sets(texts, n)
            full = [i for i, s in enumerate(sets) if len(s)]
            hashes = np.zeros((len(sets), 2 * groups), np.int64)
            if full:
                hashes[full] = group_hashes([sets[i] for i in full], groups, width).view(np.int64)
            return {"n_shingles": np.array([len(s) for s in sets], np.int64),
                    "s1": np.array([s.sum(dtype=np.uint64) for s in sets]).view(np.int64),
                    "s2": np.array([mix(s).sum(dtype=np.uint64) for s in sets]).view(np.int64),
                    "a": [h[:groups] for h in hashes], "b": [h[groups:] for h in hashes]}
        return run

    return map_texts(df, [key], text, make, "n_shingles bigint, s1 bigint, s2 bigint, a array<bigint>, b array<bigint>")


def _sets(df: DataFrame, ids: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """id and shingles (array of hashes) of the documents in ``ids``, from their whole texts."""
    chosen = df.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")

    def make():
        return lambda texts: {"shingles": [s.view(np.int64) for s in shingle_sets(texts, n)]}

    return map_texts(chosen, ["id"], "text", make, "shingles array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    sized = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("su")), "u") \
        .join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv")), "v")
    both, nu, nv = F.size(F.array_intersect("su", "sv")).cast("bigint"), F.size("su").cast("bigint"), F.size("sv").cast("bigint")
    near = sized.where((100 * F.least(nu, nv) >= percent * F.greatest(nu, nv)) & (100 * both >= percent * (nu + nv - both)))
    return near.select("u", "v").distinct()


def near_duplicates(df: DataFrame, percent: int = PERCENT, n: int = SHINGLE, groups: int = GROUPS, width: int = WIDTH,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest id that links reach) and kept
    (the id is its component's), one row for each row of ``df``."""
    signed = written(_signatures(df, n, groups, width, key, text), "minhash").withColumnRenamed(key, "id")
    classes = signed.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("id").alias("rep"))
    member = written(signed.join(classes, ["n_shingles", "s1", "s2"], "left").select(
        "id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("rep")).alias("rep"),
        *[F.when(F.col("id") == F.col("rep"), F.col(c)).alias(c) for c in ("a", "b")]), "minhash")

    one = member.where("id = rep and n_shingles > 0").select("rep", F.explode("a").alias("x"), "b")
    keys = one.select("rep", F.explode(F.transform("b", lambda y: F.xxhash64(F.col("x"), y))).alias("key"))
    heads = keys.groupBy("key").agg(F.min("rep").alias("u"), F.max("rep").alias("last")).where("u <> last").select("key", "u")
    shared = written(keys.join(heads, "key"), "minhash")  # the buckets of several classes
    pairs = written(shared.where("u <> rep").select("u", F.col("rep").alias("v")).distinct(), "minhash")
    ids = shared.select(F.col("rep").alias("id")).distinct()
    sets = written(_sets(df, ids, n, key, text), "minhash")
    links = written(_confirmed(pairs, sets, percent), "minhash")
    comp = written(components(links, "u", "v"), "minhash")

    opened = _open(shared, comp, sets)
    central = written(_central_pairs(*opened[:2]).join(pairs, ["u", "v"], "left_anti"), "minhash")
    more = written(_confirmed(central, sets, percent), "minhash")
    if not more.isEmpty():
        links = written(links.union(more), "minhash")
        comp = written(components(links, "u", "v"), "minhash")
    known = pairs.union(central)
    rest = _rest(*opened[1:], comp, percent).join(known, ["u", "v"], "left_anti")
    more = written(_confirmed(rest, sets, percent), "minhash")
    if not more.isEmpty():
        comp = written(components(links.union(more), "u", "v"), "minhash")

    found = member.select("id", "n_shingles", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return found.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def _named(ids: DataFrame, comp: DataFrame) -> DataFrame:
    """``ids`` with each id's component (itself where it has no link)."""
    return ids.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _open(shared: DataFrame, comp: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the buckets that hold several components: (key, id, component);
    (id, n, m, s, df), the classes' shingles that two of these classes or more
    have (n is the size of the set, m of its part that others have too); and
    (id, bits), the parity of each set's shingles in 64 * LANES places."""
    named = _named(shared.select("key", F.col("rep").alias("id")), comp)
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    named = written(named.join(mixed, "key", "left_semi"), "minhash")
    items = sets.join(named.select("id").distinct(), "id").select("id", F.size("shingles").cast("bigint").alias("n"), F.explode("shingles").alias("s"))
    often = items.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    common = items.join(often, "s").withColumn("m", F.count("*").over(Window.partitionBy("id", "n")))
    place = F.expr("shiftleft(1L, cast(pmod(s, 64) as int))")
    lane = F.pmod(F.shiftright("s", 6), F.lit(LANES))
    parity = items.groupBy("id").agg(*[F.bit_xor(F.when(lane == i, place).otherwise(F.lit(0).cast("bigint"))).alias(f"p{i}") for i in range(LANES)])
    return named, written(common, "minhash"), written(parity, "minhash")


def _central_pairs(named: DataFrame, common: DataFrame) -> DataFrame:
    """In each open bucket, the class with the fewest shingles of its own
    against the classes of other components (u < v)."""
    own = common.select("id", (F.col("n") - F.col("m")).alias("own")).distinct()
    rows = named.join(own, "id")
    heads = rows.groupBy("key").agg(F.min(F.struct("own", "id", "component")).alias("h")) \
        .select("key", F.col("h.id").alias("head"), F.col("h.component").alias("of"))
    met = rows.join(heads, "key").where("component <> of")
    return met.select(F.least("id", "head").alias("u"), F.greatest("id", "head").alias("v")).distinct()


def _rest(common: DataFrame, parity: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs (u < v) of different components that may still be similar enough:
    they share a shingle of their prefixes, and the overlap that the two sizes
    ask for is left by what each shares with any other class, by the places
    of the shingle in the two orders, and by the places where the parities
    differ (two sets differ in as many shingles at least).  Each bound is exact: no similar pair is lost."""
    shared = F.col("n") * percent <= 100 * F.col("m")
    order = Window.partitionBy("id", "n").orderBy("df", "s")
    ranked = common.where(shared).withColumn("at", F.col("n") - F.col("m") + F.row_number().over(order))
    head = _named(ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("id", "n", "m", "s", "at"), comp)
    apart = head.groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("s")
    head = written(head.join(apart, "s", "left_semi").join(parity, "id"), "minhash")
    lanes = [f"p{i}" for i in range(LANES)]
    other = head.select("s", *[F.col(c).alias(c + "2") for c in ("id", "component", "n", "m", "at", *lanes)])
    differ = " + ".join(f"bit_count({p} ^ {p}2)" for p in lanes)
    need = f"{percent} * (n + n2)"  # 100 + percent times the least overlap
    met = head.join(other, "s").where(
        f"id < id2 and component <> component2 and 100 * least(n, n2) >= {percent} * greatest(n, n2) "
        f"and {100 + percent} * least(m, m2) >= {need} and {100 + percent} * (1 + least(n - at, n2 - at2)) >= {need} "
        f"and {100 + percent} * (n + n2 - ({differ})) >= 2 * {need}")
    return met.select(F.col("id").alias("u"), F.col("id2").alias("v")).distinct()
