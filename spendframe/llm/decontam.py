"""Benchmark items inside documents: containment search with sketches sized by the item, then exact counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import common

WIDTH = 5
# Share of an item's shingles that a document must hold, as a fraction of whole numbers.
SHARE = (4, 5)
SEPARATORS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case. Separators at either end leave an empty piece, which is no word."""
    return F.filter(F.split(F.lower(text), SEPARATORS, -1), lambda word: word != "")


def shingle_rows(frame: DataFrame, columns: list[str], text: Column, width: int = WIDTH) -> DataFrame:
    """One row for each run of ``width`` words: the given columns and w1 to wN."""
    listed = frame.select(*columns, words(text).alias("_words"))
    runs = [F.slice("_words", k, F.greatest(F.size("_words"), F.lit(1))) for k in range(1, width + 1)]
    names = [f"w{k}" for k in range(1, width + 1)]
    zipped = listed.filter(F.size("_words") >= width).select(*columns, F.inline(F.arrays_zip(*runs)).alias(*names))
    return zipped.filter(F.col(names[-1]).isNotNull())


def run_hash(width: int = WIDTH) -> Column:
    return F.xxhash64(*[f"w{k}" for k in range(1, width + 1)])


def run_text(width: int = WIDTH) -> Column:
    return F.concat_ws(" ", *[f"w{k}" for k in range(1, width + 1)])


def needed(count: Column, share: tuple[int, int] = SHARE) -> Column:
    """How many of an item's shingles a document must hold at least."""
    return F.ceil(count * share[0] / F.lit(share[1]).cast("decimal(10,0)")).cast("long")


def contained(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    width: int = WIDTH,
    share: tuple[int, int] = SHARE,
) -> DataFrame:
    """Pairs of a row of ``docs`` and an item of which the row holds at least ``share`` of the distinct shingles.

    Items are partitioned by their number n of shingles. A row that holds a share of them lacks at most
    n - needed(n), so one of the n - needed(n) + 1 shingles with the smallest hashes is surely in it: that is
    the MinHash sketch of the item's partition, and looking up sketches misses no pair. Candidates are then
    verified by counting their common shingles as text, over whole documents. Sketches are stored first, so
    the planner sends them to all executors only where their measured size allows, and shuffles otherwise.

    An item of fewer than ``width`` words is one run, and a row holds it where it holds that run of words; lengths
    that occur are looked for one by one (shared and n_shingles are 1). Null and empty texts, rows of fewer words than
    an item and items without words have no pairs.
    Rows alike in key and text count as one document, items of the same key as one item. Null keys are
    allowed in ``docs``. Returns _id (of row key and text), the key, item_key, shared, n_shingles, sorted by none.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[key].alias("_key"), body.alias("_body"), F.xxhash64(docs[key], body).alias("_id"))
    listed = items.select(items[item_key].alias("_item"), F.coalesce(items[item_text].cast("string"), F.lit("")).alias("_body"))
    runs = shingle_rows(listed, ["_item"], F.col("_body"), width).select("_item", run_hash(width).alias("_h"), run_text(width).alias("_s")).distinct()
    sized = runs.groupBy("_item").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_set("_h")).alias("_hashes"))
    sketches = common.stored(
        sized.select("_item", F.explode(F.slice("_hashes", 1, (F.col("_n") - needed(F.col("_n"), share) + 1).cast("int"))).alias("_h"))
    )
    entries = common.stored(runs.join(sized.select("_item", "_n"), "_item").select("_item", "_s", "_n"))

    candidates = common.stored(
        shingle_rows(rows, ["_id"], F.col("_body"), width).select("_id", run_hash(width).alias("_h")).join(sketches, "_h").select("_id", "_item").distinct()
    )
    suspects = rows.join(candidates.select("_id").distinct(), "_id", "left_semi")
    found = shingle_rows(suspects, ["_id", "_key"], F.col("_body"), width).select("_id", "_key", run_text(width).alias("_s"))
    pairs = (
        found.join(entries, "_s")
        .join(candidates, ["_id", "_item"], "left_semi")
        .groupBy("_id", "_key", "_item", "_n")
        .agg(F.count_distinct("_s").alias("shared"))
        .filter(F.col("shared") >= needed(F.col("_n"), share))
    )
    found_pairs = pairs.select("_id", F.col("_key").alias(key), F.col("_item").alias(item_key), "shared", F.col("_n").alias("n_shingles"))
    short = listed.select("_item", words(F.col("_body")).alias("_words")).filter(F.size("_words").between(1, width - 1))
    short = common.stored(short.select("_item", F.size("_words").alias("_size"), F.array_join("_words", " ").alias("_s")).distinct())
    # At most width - 1 lengths.
    for row in short.select("_size").distinct().collect():
        runs_of = shingle_rows(rows, ["_id", "_key"], F.col("_body"), row["_size"]).select("_id", "_key", run_text(row["_size"]).alias("_s"))
        held = runs_of.join(short.filter(F.col("_size") == row["_size"]), "_s").select("_id", "_key", "_item").distinct()
        one = F.lit(1).cast("long")
        found_pairs = found_pairs.unionByName(held.select("_id", F.col("_key").alias(key), F.col("_item").alias(item_key), one.alias("shared"), one.alias("n_shingles")))
    return found_pairs


def clean(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns as they are."""
    names = list(docs.columns)
    found = common.stored(contained(docs, items, text, key, **options).select("_id").distinct())
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(common.packed(docs).alias("_row"), F.xxhash64(docs[key], body).alias("_id"))
    return rows.join(found, "_id", "left_anti").select(*common.unpacked("_row", names))
