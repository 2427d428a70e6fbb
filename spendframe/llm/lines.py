"""Drop lines that many documents share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import common

MIN_CHARS = 1
MIN_DOCUMENTS = 10
RESULTS = ("n_lines", "n_dropped", "kept_text")


def line_key(line: Column) -> Column:
    """What makes two lines the same: the line without outer white space, in lower case."""
    return F.translate(F.btrim(line, F.lit(common.WHITE_CHARS)), common.UPPER, common.LOWER)


def key_hash(key: Column) -> Column:
    """128 bits from two runs of a 64-bit hash over different inputs."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """What ``build`` makes of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def drop_common(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """Every row with its text less the lines whose key is found in ``min_documents`` rows or more.

    Lines are exploded as hashes of their keys, once per row and key, counted per hash with partial sums,
    and the places of lines whose hash is over the threshold go back to their rows. A row then drops the lines at
    these places and joins the others in their order, so lines of text are never shuffled, only whole rows once. A
    line in very many rows is a skewed key of a join with one row on the other side, which can be split. The work on
    a row grows with its number of lines, times its logarithm where they are sorted.

    Each row counts as one document, also where rows repeat. A null or empty text is one empty line; lines
    whose key has fewer than ``min_chars`` code points always stay. Null keys are allowed. An empty table
    gives an empty table. Returns the columns of ``docs`` and n_lines, n_dropped, kept_text; input columns
    of these names are replaced.
    """
    names = list(docs.columns)
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    # Rows are matched by content: rows alike in key and text share their list of dropped lines, rightly so.
    rows = docs.select(common.packed(docs).alias("_row"), body.alias("_body"), F.xxhash64(docs[key], body).alias("_id"))
    rows = rows.withColumn("_body", F.col("_row").getField(text).cast("string")).withColumn("_body", F.coalesce("_body", F.lit("")))

    def hash_of(line: Column) -> Column:
        return bound(line_key(line), lambda key_: F.when(F.length(key_) >= min_chars, key_hash(key_)))

    body_lines = F.split(body, "\n", -1)
    own_id = F.xxhash64(docs[key], body).alias("_id")
    # Once per row and key: sorted, so that equal ones lie side by side.
    sorted_hashes = F.sort_array(F.array_compact(F.transform(body_lines, hash_of)))
    distinct = bound(sorted_hashes, lambda found: F.filter(found, lambda h, i: (i == 0) | (h != F.get(found, i - 1))))
    counted = docs.select(F.explode(distinct).alias("_h")).select("_h.a", "_h.b")
    frequent = counted.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_documents).select("a", "b")
    placed = docs.select(own_id, F.posexplode(F.transform(body_lines, hash_of)).alias("_at", "_h")).filter(F.col("_h").isNotNull())
    drops = (
        placed.select("_id", "_at", "_h.a", "_h.b")
        .join(common.stored(frequent), ["a", "b"], "left_semi")
        .groupBy("_id")
        .agg(F.collect_set("_at").alias("_drops"))
    )
    lines = F.split("_body", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("_drops", F.array().cast("array<int>")))
    kept = bound(lines, lambda found: bound(places, lambda stay: F.transform(stay, lambda at: F.get(found, at))))
    return (
        rows.join(drops, "_id", "left")
        .select("_row", F.size(lines).cast("long").alias("n_lines"), kept.alias("_kept"))
        .select(
            *common.unpacked("_row", names, set(RESULTS)),
            "n_lines",
            (F.col("n_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
            F.array_join("_kept", "\n").alias("kept_text"),
        )
    )
