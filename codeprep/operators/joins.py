"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Bytes (characters of text columns, 8 for any other value) and rows up to
#: which a data-derived lookup table is broadcast.
BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS = 64 * 1024 * 1024, 2_000_000


def checked_copy(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """``df`` written once to the shared folder (a distributed write; no
    ``limit`` funnel through one task), and whether that copy has at most
    ``max_rows`` rows and ``max_bytes`` bytes."""
    cp = materialize(df)
    width = sum((F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") if f.dataType.typeName() in ("string", "binary") else F.lit(8)
                 for f in cp.schema), F.lit(16))
    rows, size = cp.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return cp, rows <= max_rows and size <= max_bytes


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it is within the bounds; above them its written
    copy is returned for a shuffle join."""
    cp, small = checked_copy(df, max_rows, max_bytes)
    return F.broadcast(cp) if small else cp


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a table whose size is bounded by construction (a ``limit``,
    a fixed list); no run-time check needed."""
    return F.broadcast(df)
