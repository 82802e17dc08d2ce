"""Broadcast only what is measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a table may hold to be sent to every executor: bytes as JSON, which is more than Spark's own rows take.
BROADCAST_BYTES = 64 << 20


def json_bytes(df: DataFrame) -> int:
    """Size of all rows as JSON: one pass, one number."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, most_bytes: int | None = None) -> bool:
    """Whether ``df`` may be broadcast.  It is evaluated once for this, so give what is checkpointed or cheap."""
    return json_bytes(df) <= (BROADCAST_BYTES if most_bytes is None else most_bytes)
