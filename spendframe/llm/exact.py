"""Exact duplicates by recursive splitting on successive bytes, most significant first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import common

FIRST_WIDTH = 32
WIDENING = 8
RESULTS = ("keep_id", "group_size", "kept")


def normalised(text: Column) -> Column:
    """The text whose bytes decide: no white space at all."""
    return F.regexp_replace(text, common.WHITE_RUN, "")


def mark(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    carry: list[str] | None = None,
    first_width: int = FIRST_WIDTH,
    widening: int = WIDENING,
) -> DataFrame:
    """Every row with the row of its group of equal texts that stays.

    Rows start as one group. Each round reads the next bytes of the normalised texts that are still in a
    group of several, and splits the groups by them. A group ends when it is a single row or when its texts
    end, so equality is decided by the bytes themselves and no digest is taken. The bytes read per round
    widen, so that the rounds grow with the logarithm of the longest text. Groups of copies are counted
    before the shuffle; the only joins are of rows with one entry per group, which can be split when skewed.

    Of equal texts the one with the most code points stays, then the smallest key, then one of the rows that
    are alike in both. Null texts are empty texts and form a group; a null key comes after all others. An
    empty table gives an empty table.

    Returns the columns in ``carry`` (all by default) and keep_id, group_size, kept; input columns of these
    three names are replaced. The text is moved on only while its group is open unless it is carried.
    """
    carry = list(docs.columns) if carry is None else list(carry)
    whole = text in carry
    body = F.coalesce(F.col("_row").getField(text).cast("string"), F.lit("")) if whole else F.col("_text")
    rows = docs.select(
        common.packed(docs, carry).alias("_row"),
        docs[key].alias("_key"),
        *([] if whole else [F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text")]),
    )
    rows = rows.withColumn("_points", F.length(body)).withColumn("_group", F.lit(0).cast("long"))

    closed, offset, width, level = [], 0, first_width, 0
    while True:
        chunk = F.substring(normalised(body).cast("binary"), offset + 1, width)
        keyed = rows.withColumn("_chunk", chunk)
        groups = common.stored(
            keyed.groupBy("_group", "_chunk")
            .agg(F.count(F.lit(1)).alias("_size"))
            .filter("_size > 1")
            .select("_group", "_chunk", F.monotonically_increasing_id().alias("_next"), (F.length("_chunk") < width).alias("_ended"))
        )
        split = (
            # Merged at every size: a skewed side can be split, and the plan for small tables is that for large ones.
            keyed.join(groups.hint("merge"), ["_group", "_chunk"], "left")
            .drop("_group", "_chunk")
            .withColumnRenamed("_next", "_group")
            .withColumn("_ended", F.coalesce("_ended", F.lit(True)))
        )
        if level == 0:
            split = split.withColumn("_id", F.monotonically_increasing_id())
        if not whole:
            split = split.withColumn("_text", F.when(~F.col("_ended"), F.col("_text")))
        split = common.stored(split)
        closed.append(split.filter("_ended").select("_row", "_key", "_points", "_id", "_group", F.lit(level).alias("_level")))
        rows = split.filter("NOT _ended").drop("_ended")
        if rows.isEmpty():
            break
        offset, width, level = offset + width, width * widening, level + 1

    ended = reduce(DataFrame.unionByName, closed)
    single = ended.filter("_group IS NULL").select("_row", F.col("_key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    members = ended.filter("_group IS NOT NULL")
    order = F.struct((-F.col("_points")).alias("p"), F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_id").alias("i"))
    first = members.groupBy("_level", "_group").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("group_size"))
    copies = members.join(first, ["_level", "_group"]).select(
        "_row", F.col("_first.k").alias("keep_id"), "group_size", (F.col("_first.i") == F.col("_id")).alias("kept")
    )
    return single.unionByName(copies).select(*common.unpacked("_row", carry, set(RESULTS)), *RESULTS)


def distinct(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``mark`` keeps, with their columns as they are."""
    names = list(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    chosen = mark(plain, f"c{names.index(text)}", f"c{names.index(key)}").filter("kept")
    return chosen.select(*plain.columns).toDF(*names)
