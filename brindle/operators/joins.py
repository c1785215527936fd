"""Equi-joins with a checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most rows that a side may have to be sent to every executor.
BROADCAST_ROWS = 50_000


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is usually small.

    The size is looked at first: ``right`` is broadcast only up to ``bound`` rows.  Beyond that
    it is an ordinary shuffled join, where adaptive execution splits hot keys.
    """
    if right.limit(bound + 1).count() <= bound:
        right = F.broadcast(right)
    return left.join(right, on, how)
