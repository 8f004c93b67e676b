"""When a side of a join is small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dimension is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows; counting stops one row beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
