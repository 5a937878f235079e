"""Joins against tables whose size is looked at first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a table is sent to every executor; a larger one is joined by shuffle.
SENT_BYTES = 32 << 20


def sent_if_small(df: DataFrame, lists: str, limit: int = SENT_BYTES) -> DataFrame:
    """`df`, which should be written down already, marked for broadcast where its rows and their `lists` fit the limit."""
    rows, items = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return F.broadcast(df) if 64 * rows + 8 * items <= limit else df
