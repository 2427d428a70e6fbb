"""Money scaling and ratio columns.

Ratios divide doubles built from exact integer sums, so a result never depends
on the order in which partitions were added up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def units(cents: Column | str) -> Column:
    """Whole cents as an amount in currency units."""
    column = F.col(cents) if isinstance(cents, str) else cents
    return column.cast("double") / F.lit(100.0)


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole * scale, 0 when the whole is not positive."""
    share = part.cast("double") / F.when(whole > 0, whole.cast("double"))
    return F.coalesce(share * F.lit(float(scale)), F.lit(0.0))


def rounded(value: Column, places: int = 0) -> Column:
    """Round half up to ``places`` decimals."""
    power = float(10**places)
    return F.floor(value * F.lit(power) + F.lit(0.5)).cast("double") / F.lit(power)


def percent(part: Column, whole: Column, places: int = 0) -> Column:
    return rounded(ratio(part, whole, 100.0), places)
