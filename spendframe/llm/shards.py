"""Shards of nearly equal bytes that never part equal texts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spendframe.llm import common

SHARDS = 40
UNIT_BITS = 16
ROW_OVERHEAD = 16
SLICES = 100_000
RESULTS = ("size", "text_crc32", "shard", "slot")


def fits(prefix: list[int], shards: int, capacity: int) -> bool:
    """Whether greedy filling puts all groups into that many shards; prefix: running sums from 0."""
    start = 0
    for _ in range(shards):
        start = bisect_right(prefix, prefix[start] + capacity) - 1
        if start == len(prefix) - 1:
            return True
    return start == len(prefix) - 1


def smallest_capacity(prefix: list[int], sizes: list[int], shards: int) -> int:
    """Binary search between the mean (or the largest group) and the total."""
    low, high = max([-(-prefix[-1] // shards), *sizes]), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(prefix, shards, middle) else (middle + 1, high)
    return low


def fair_share(sizes: list[int], shards: int) -> float:
    """The mean of the shards that hold no group larger than it."""
    rest, left, mean = sum(sizes), shards, 0.0
    for size in sorted(sizes, reverse=True):
        mean = rest / left
        if size <= mean or left == 1:
            break
        rest, left = rest - size, left - 1
    return rest / left if left else mean


def cuts(sizes: list[int], shards: int) -> list[int]:
    """Ends (exclusive) of each shard over ordered group sizes.

    No shard is larger than the smallest feasible capacity. Within it, each cut is the one nearest to the
    fair share that leaves the rest feasible, so the last shards are not left short by greedy filling.
    """
    prefix = [0, *accumulate(sizes)]
    capacity, share, total = smallest_capacity(prefix, sizes, shards), fair_share(sizes, shards), len(sizes)
    earliest, point = [total] * (shards + 1), total
    for s in range(shards - 1, -1, -1):
        point = bisect_left(prefix, prefix[point] - capacity)
        earliest[s] = point
    ends, start = [], 0
    for s in range(shards):
        latest = bisect_right(prefix, prefix[start] + capacity) - 1
        near = bisect_left(prefix, prefix[start] + share)
        if near > start + 1 and (near > total or prefix[start] + share - prefix[near - 1] <= prefix[near] - prefix[start] - share):
            near -= 1
        end = min(latest, max(earliest[s + 1], near)) if s < shards - 1 else total
        ends.append(end)
        start = end
    return ends


def assign(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    shards: int = SHARDS,
    unit_bits: int = UNIT_BITS,
) -> DataFrame:
    """Every row with its shard of ``shards`` and its gapless slot in it; shard sizes in bytes are near equal.

    Equal texts are one atomic group. Groups are ordered by the hash of their text, and all groups with the
    same first ``unit_bits`` bits of it are cut together, so the ordered list of sizes that the driver
    searches has at most 2 ** unit_bits entries at any size of the input. The smallest feasible capacity is
    found by binary search with a greedy check, the cuts are made within it. Slots come from row numbers in
    slices of each unit plus the counts of the slices before; a unit with very many rows (a group of copies)
    has many slices, at most about ``SLICES`` in all units together.

    size is the UTF-8 bytes of the text plus 16 (null: 16), text_crc32 that of its bytes (null: 0, as for an
    empty text, but null and empty texts are one group). Rows alike in everything get slots in any order.
    Null keys are allowed. An empty table gives an empty table; with fewer groups than shards, some shards
    are empty. Returns the columns of ``docs`` and size, text_crc32, shard, slot; input columns of these
    names are replaced.
    """
    names, spark = list(docs.columns), docs.sparkSession
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    carried = [name for name in names if name not in RESULTS]
    rows = docs.select(
        common.packed(docs, carried).alias("_row"),
        docs[key].alias("_key"),
        (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("_hash"),
    ).withColumn("_unit", F.shiftrightunsigned("_hash", 64 - unit_bits).cast("int"))

    units = rows.groupBy("_unit").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("_unit")
    sizes, counts = [int(x) for x in units["bytes"]], [int(x) for x in units["n"]]
    slice_rows = max(500, sum(counts) // SLICES)
    plan, at = [], 0
    for shard, end in enumerate(cuts(sizes, shards) if sizes else []):
        base = 0
        for i in range(at, end):
            plan.append((int(units["_unit"].iloc[i]), shard, base, -(-counts[i] // slice_rows)))
            base += counts[i]
        at = end
    schema = T.StructType([T.StructField("_unit", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("_base", T.LongType()), T.StructField("_slices", T.IntegerType())])
    # One row per unit, 2 ** unit_bits at most: small enough to be sent to every executor.
    placed = rows.join(F.broadcast(spark.createDataFrame(plan, schema)), "_unit").withColumn(
        "_slice", F.pmod(F.xxhash64("_key", F.lit("slice")), F.col("_slices").cast("long")).cast("int")
    )
    before = Window.partitionBy("_unit").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_unit", "_slice").agg(F.count(F.lit(1)).alias("_n")).select("_unit", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_unit", "_slice").orderBy("_hash", "_key")
    return (
        placed.withColumn("_at", F.row_number().over(inside))
        .join(offsets, ["_unit", "_slice"])
        .select(
            *common.unpacked("_row", carried),
            "size",
            "text_crc32",
            "shard",
            (F.col("_base") + F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"),
        )
    )
