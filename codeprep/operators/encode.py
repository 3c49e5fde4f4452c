"""Encoding to ids, framing, masks, position pairing and splits.

Array-shaped steps (pad, mask, shift, baseline distances) are higher-order
functions on the row: no shuffle, no Python.  Look-ups against the id table
are made inside the row (``lookup``), or by a join where that table is large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import constants as K
from ..session import materialize, partition_by_key
from .lookup import Dictionary, dictionary, list_of, map_lists, places_in
from .numbering import consecutive_index


def map_tokens(docs: DataFrame, table: DataFrame | Dictionary, id_col: str, tokens_col: str, key_col: str,
               value_col: str, out_col: str, default=None, drop_values: list | None = None,
               value_type: str = "string", partitioned: bool = False) -> DataFrame:
    """Replace every element of an array column through a lookup table of unique keys.

    Elements without a match become ``default`` (null if that is None);
    elements whose mapped value is in ``drop_values`` are dropped.  A table
    within the bounds of the size check (``lookup.dictionary`` does it once
    for several calls) is looked up inside the row, a larger one is joined.
    """
    d = dictionary(table)
    if not d.small:
        return _map_exploded(docs, d.table, id_col, tokens_col, key_col, value_col, out_col, default,
                             drop_values, value_type, partitioned)
    pairs = d.arrays(key_col, value_col)

    def made(_, elements, sizes):
        keys, values = pairs.value
        out = pc.take(values, places_in(elements, keys))
        if default is not None:
            out = pc.fill_null(out, pa.scalar(default, out.type))
        if drop_values:
            stays = pc.invert(pc.is_in(out, value_set=pa.array(drop_values, out.type)))
            row = np.repeat(np.arange(len(sizes)), sizes)[stays.to_numpy(zero_copy_only=False)]
            out, sizes = out.filter(stays), np.bincount(row, minlength=len(sizes))
        return [list_of(sizes, out)]

    element = d.table.schema[value_col].dataType
    return map_lists(docs, tokens_col, [Ty.StructField(out_col, Ty.ArrayType(element))], made, drop=(out_col,))


def _map_exploded(docs: DataFrame, table: DataFrame, id_col: str, tokens_col: str, key_col: str, value_col: str,
                  out_col: str, default, drop_values: list | None, value_type: str, partitioned: bool) -> DataFrame:
    """``map_tokens`` for a table of any size, on exploded elements."""
    t = table.select(F.col(key_col).alias("_k"), F.col(value_col).alias("_v"))
    base = docs if partitioned else partition_by_key(docs, id_col)
    rows = base.select(id_col, F.posexplode(tokens_col).alias("_pos", "_e"))
    j = rows.join(t, rows["_e"] == t["_k"], "left")
    val = F.coalesce(F.col("_v"), F.lit(default).cast(value_type)) if default is not None else F.col("_v")
    if drop_values:
        j = j.filter(~F.coalesce(val.isin(drop_values), F.lit(False)))
    per = (j.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("_pos"), val.alias("_x")))).alias("_s"))
           .select(id_col, F.transform("_s", lambda s: s["_x"]).alias(out_col)))
    keep = [c for c in base.columns if c != out_col]
    empty = F.array().cast(f"array<{value_type}>")
    return (base.select(*keep).join(per, id_col, "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), empty)))


def encode_tokens(docs: DataFrame, ids: DataFrame | Dictionary, id_col: str = "doc_id",
                  tokens_col: str = "transformed_tokens", out_col: str = "ids",
                  partitioned: bool = False) -> DataFrame:
    """C4: tokens -> ids, unknown -> ``[UNK]`` (1)."""
    return map_tokens(docs, ids, id_col, tokens_col, "token", "id", out_col, default=K.UNK_ID,
                      value_type="long", partitioned=partitioned)


def decode_ids(docs: DataFrame, ids: DataFrame | Dictionary, id_col: str = "doc_id", ids_col: str = "ids",
               out_col: str = "decoded", partitioned: bool = False) -> DataFrame:
    """Ids -> tokens; ``[PAD] [SOS] [EOS]`` dropped."""
    return map_tokens(docs, ids, id_col, ids_col, "id", "token", out_col, partitioned=partitioned,
                      drop_values=[K.SPECIAL_TOKENS[K.PAD_ID], K.SPECIAL_TOKENS[K.SOS_ID],
                                   K.SPECIAL_TOKENS[K.EOS_ID]])


def frame_and_pad(ids: Column, max_len: int = K.MAX_SEQ_LEN, eos_before_pad: bool = False) -> Column:
    """``[SOS] ids [PAD]*(max-n) [EOS]`` (EOS after padding, no truncation,
    as the reference does); ``eos_before_pad`` puts EOS right after the ids."""
    sos, eos = F.array(F.lit(K.SOS_ID).cast("long")), F.array(F.lit(K.EOS_ID).cast("long"))
    pad = F.array_repeat(F.lit(K.PAD_ID).cast("long"), F.greatest(F.lit(max_len) - F.size(ids), F.lit(0)))
    return F.concat(sos, ids, eos, pad) if eos_before_pad else F.concat(sos, ids, pad, eos)


def pad_mask(ids: Column) -> Column:
    """1 where the id is not ``[PAD]``."""
    return F.transform(ids, lambda x: F.when(x != K.PAD_ID, 1).otherwise(0))


def shift_right(ids: Column) -> Column:
    """Prepend ``[SOS]``, drop the last element."""
    return F.concat(F.array(F.lit(K.SOS_ID).cast("long")),
                    F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))))


def baseline_distances(n: Column) -> Column:
    """``j - i`` for all ``i < j`` in row-major triangle order; ``[]`` for n < 2."""
    tri = F.flatten(F.transform(F.sequence(F.lit(0), n - 2),
                                lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: j - i)))
    return F.when(n >= 2, tri).otherwise(F.array().cast("array<int>"))


def position_pair(left: DataFrame, right: DataFrame, order_col: str = "doc_id",
                  prefixes: tuple[str, str] = ("c_", "cpp_")) -> DataFrame:
    """Row k of one language with row k of the other (inner join on a
    consecutive position), so the result has ``min(n_left, n_right)`` rows.

    Both sides are numbered in one distributed pass (position restarts per
    side), then split and joined on the position."""
    both = (left.withColumn("_side", F.lit(0))
            .unionByName(right.withColumn("_side", F.lit(1))))
    numbered = consecutive_index(both, [F.col(order_col)], out_col="position", group_cols=["_side"])

    def side(i, pre):
        return numbered.filter(F.col("_side") == i).select(
            "position", *[F.col(c).alias(pre + c) for c in left.columns])
    return side(0, prefixes[0]).join(side(1, prefixes[1]), "position")


def paired_rows(left: DataFrame, right: DataFrame, order_col: str = "doc_id", prefixes: tuple[str, str] = ("c_", "cpp_"),
                val_ratio: float = K.VAL_RATIO, test_ratio: float = K.TEST_RATIO) -> DataFrame:
    """C8–C10 for rows with heavy columns (token ids, distance triangles): the
    order keys alone are numbered, paired and split; the columns follow by
    key afterwards and pass one exchange each.  ``order_col`` must be unique."""
    keys = materialize(position_pair(left.select(order_col), right.select(order_col), order_col, prefixes))
    split = assign_split(keys, keys.count(), val_ratio, test_ratio)
    for side, pre in zip((left, right), prefixes):
        split = split.join(side.select(*[F.col(c).alias(pre + c) for c in side.columns]), pre + order_col)
    return split


def encoded_pairs(left: DataFrame, right: DataFrame, ids: DataFrame | Dictionary, order_col: str = "doc_id",
                  tokens_col: str = "tokens", prefixes: tuple[str, str] = ("c_", "cpp_")) -> DataFrame:
    """Token rows paired and split by position, then encoded.

    Pairing comes first: it reads the order keys alone, and a step that Spark
    cannot see into (encoding, triangles) would be run for all rows, and again
    for each pass over the keys.  The pairs are spread by position in an
    explicit number of parts, as the work behind them is CPU-bound.
    """
    paired = partition_by_key(paired_rows(left, right, order_col, prefixes), "position")
    for pre in prefixes:
        paired = encode_tokens(paired, ids, pre + order_col, pre + tokens_col, pre + "ids")
    return paired


def split_bounds(n: int, val_ratio: float = K.VAL_RATIO, test_ratio: float = K.TEST_RATIO) -> tuple[int, int]:
    """Bounds with the same double arithmetic as the reference."""
    return int((1 - val_ratio - test_ratio) * n), int((1 - test_ratio) * n)


def assign_split(paired: DataFrame, n: int, val_ratio: float = K.VAL_RATIO,
                 test_ratio: float = K.TEST_RATIO, position_col: str = "position") -> DataFrame:
    """Contiguous ``train`` / ``val`` / ``test`` by position."""
    val_start, test_start = split_bounds(n, val_ratio, test_ratio)
    pos = F.col(position_col)
    return paired.withColumn("split", F.when(pos < val_start, F.lit("train"))
                             .when(pos < test_start, F.lit("val")).otherwise(F.lit("test")))


def training_samples(paired: DataFrame, max_len: int = K.MAX_SEQ_LEN, use_tree_distance: bool = True,
                     prefixes: tuple[str, str] = ("c_", "cpp_"), keep_cols: list[str] | None = None) -> DataFrame:
    """C11: the 12 vectors of a training sample per paired row.

    Needs ``{prefix}ids`` and ``{prefix}dist`` (or token counts via
    ``{prefix}ids`` for the baseline distances) for both languages.
    """
    cols = [F.col("position")] + ([F.col("split")] if "split" in paired.columns else [])
    cols += [F.col(c) for c in (keep_cols or [])]
    for pre in prefixes:
        enc = frame_and_pad(F.col(pre + "ids"), max_len)
        dist = F.col(pre + "dist") if use_tree_distance else baseline_distances(F.size(pre + "ids"))
        dec = shift_right(enc)
        cols += [enc.alias(pre + "encoder_ids"), dist.alias(pre + "encoder_dist"),
                 pad_mask(enc).alias(pre + "encoder_mask"), dec.alias(pre + "decoder_ids"),
                 dist.alias(pre + "decoder_dist"), pad_mask(dec).alias(pre + "decoder_mask")]
    return paired.select(*cols)


def training_columns(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Keep only what training reads."""
    return df.select(id_col, "transformed_tokens", "dist")
