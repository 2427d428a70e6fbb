"""Plan shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(frame: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns that are computed once, whatever later steps do with them.

    The optimizer merges neighbouring projections and moves filters below them,
    copying the definition of a column into every place that uses it. For a
    column made of hundreds of patterns that multiplies both the plan and the
    work. A one-row generator between the projections keeps them apart; it moves
    no data. The columns are computed in the projection below it, which compiles
    what a generator would interpret row by row.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = frame.columns if keep is None else keep
    return frame.select(*kept, row.alias("held_row")).select(*kept, F.inline(F.array("held_row")))


def once(frame: DataFrame, *keys: str) -> DataFrame:
    """A table that several branches of a plan read but that is computed once.

    The optimizer fits a copy of the plan to each branch, with its filters and columns, and then all copies run.
    Behind one generator the copies stay equal, and equal shuffles are made once. With ``keys`` the rows are dealt
    by them here; without, the shuffle of an aggregate below is the one that is shared.
    """
    row = F.struct(*[F.col(f"`{name}`").alias(name) for name in frame.columns])
    kept = frame.select(F.inline(F.array(row)))
    return kept.repartition(*[F.col(key) for key in keys]) if keys else kept


def outer_split(left: DataFrame, right: DataFrame, key: str, present: DataFrame | None = None) -> DataFrame:
    """Left join as an inner join and the rows without a match; a hot key on either side can be split at run time.

    Of a left join only the left side can be. Both sides are dealt by the key once, for both joins, unless
    ``present`` is given: a table that has the keys of the right side, where both sides are dealt by the key already.
    """
    if present is None:
        left, right = once(left, key), once(right, key)
        present = right
    missing = left.join(present.select(key).distinct(), key, "left_anti")
    return left.join(right, key).unionByName(missing, allowMissingColumns=True)


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Partition by keys into as many parts as the session shuffles into.

    Documents are small and costly to read. Adaptive execution sizes partitions
    by bytes and would give thousands of documents to one task; a stated number
    is left as it is.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(parts, *keys)
