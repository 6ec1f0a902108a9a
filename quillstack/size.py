"""Broadcasting behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def listed(ids: DataFrame, most: int = BROADCAST_ROWS) -> str:
    """The values of a request (one column) for a message; beyond ``most`` of them, that there are more."""
    rows = [str(r[0]) for r in ids.limit(most + 1).collect()]
    return ", ".join(rows[:most]) + (" and more" if len(rows) > most else "")
