"""Repeatable pseudo-random numbers from keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, stream: int) -> Column:
    """Number in [0, 1) fixed by a text key; streams 0 to 4 share one digest.

    A retried task gives the same value, which ``rand()`` does not promise.
    """
    digits = F.substring(F.sha2(key, 256), 12 * stream + 1, 12)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 48))
