"""Hard negatives by a vertical scan: dimensions are read column by column until bounds have settled the windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import common

SCALE = 256
# Components saturate here, so that sums over some thousand dimensions stay within 64 bits.
LARGEST = 1 << 25
BLOCK_ROWS = 4096
CHUNK_ANCHORS = 256
# Dimensions read between two looks at the bounds.
STEP = 8
POSITIVES, NEGATIVES = 5, 5
# A negative's score times 100 is at least this times the positive's, and at most 100 times it.
SHARE = 80
VERTICAL = "_block int, rows array<long>, keys array<long>, labels array<long>, columns array<array<int>>, low array<int>, high array<int>"


def usable(vectors: DataFrame, key: str, label: str, vector: str, anchors: Column) -> DataFrame:
    """Rows that take part, with a number each and whole components: _row, _key, _label, _v, _anchor."""
    rows = vectors.select(
        vectors[key].cast("long").alias("_key"),
        vectors[label].cast("long").alias("_label"),
        vectors[vector].cast("array<double>").alias("_x"),
        F.coalesce(anchors, F.lit(False)).alias("_anchor"),
    ).filter("_key IS NOT NULL AND _label IS NOT NULL AND _x IS NOT NULL")
    finite = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("_x", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return rows.filter(finite).select(F.monotonically_increasing_id().alias("_row"), "_key", "_label", whole.alias("_v"), "_anchor")


def vertical(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The vectors as columns: one row per block, with the values of each dimension and their least and greatest."""
    blocks = max(1, -(-rows.count() // block_rows))

    def of_block(table: pa.Table) -> pa.Table:
        vectors = [np.asarray(v, dtype=np.int32) for v in table["_v"].to_pylist()]
        matrix = np.zeros((max(map(len, vectors)), len(vectors)), dtype=np.int32)
        for at, values in enumerate(vectors):
            matrix[: len(values), at] = values
        ends = [matrix.min(axis=1).tolist(), matrix.max(axis=1).tolist()]
        held = [table["_block"][0].as_py(), *[table[name].to_pylist() for name in ("_row", "_key", "_label")], list(matrix), *ends]
        kinds = [pa.int32(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.list_(pa.int32())), *[pa.list_(pa.int32())] * 2]
        names = ["_block", "rows", "keys", "labels", "columns", "low", "high"]
        return pa.table({name: pa.array([value], kind) for name, value, kind in zip(names, held, kinds, strict=True)})

    dealt = rows.select(F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_block"), "_row", "_key", "_label", "_v")
    return dealt.groupBy("_block").applyInArrow(of_block, VERTICAL)


class Block:
    """One block of columns as arrays."""

    def __init__(self, row: dict):
        self.rows, self.keys, self.labels = (row[name].values.to_numpy(zero_copy_only=False) for name in ("rows", "keys", "labels"))
        lists = row["columns"].values
        self.columns = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].reshape(len(lists), len(self.rows)).astype(np.int64)
        self.low, self.high = (row[name].values.to_numpy(zero_copy_only=False).astype(np.int64) for name in ("low", "high"))

    def descend(self, vector: np.ndarray, bitmap: np.ndarray, settle: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the candidates that stay to the end, and their whole inner products.

        Dimensions come in the order of the anchor's magnitudes. After some of them each candidate's score lies
        between its sum so far plus the least, and plus the greatest, that the others can add in this block;
        ``settle`` gets both bounds and says which candidates stay.
        """
        wide = np.zeros(len(self.columns), dtype=np.int64)
        wide[: min(len(vector), len(wide))] = vector[: len(wide)]
        order = np.argsort(-np.abs(wide), kind="stable")
        ends = np.stack([wide * self.low, wide * self.high])[:, order]
        least, most = (np.append(np.cumsum(side[::-1])[::-1], 0) for side in (ends.min(axis=0), ends.max(axis=0)))
        places = np.flatnonzero(bitmap)
        sums = np.zeros(len(places), dtype=np.int64)
        for first in range(0, len(order), STEP):
            read = order[first : first + STEP]
            picked = self.columns[read] if len(places) == bitmap.size else self.columns[np.ix_(read, places)]
            sums = sums + wide[read] @ picked
            rest = min(first + STEP, len(order))
            stay = settle(sums + least[rest], sums + most[rest])
            if not stay.all():
                places, sums = places[stay], sums[stay]
            if not len(places):
                break
        return places, sums

    def best(self, places: np.ndarray, sums: np.ndarray, count: int) -> list[tuple[int, int, int]]:
        """The first rows by score, then key: row, key, score."""
        first = np.lexsort((self.rows[places], self.keys[places], -sums))[:count]
        return [(int(self.rows[p]), int(self.keys[p]), int(s)) for p, s in zip(places[first], sums[first], strict=True)]


def kth(values: np.ndarray, count: int) -> int | None:
    """The count-th largest value, if there are so many."""
    return int(np.partition(values, len(values) - count)[len(values) - count]) if len(values) >= count else None


def nearest(block: Block, anchor: dict, floors: dict[int, list[int]], count: int) -> list[tuple[int, int, int, int]]:
    """The block's first rows of the anchor's label; ``floors`` keeps the best scores that this task has seen for it."""
    seen = floors.setdefault(anchor["_row"], [])

    def settle(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        ends = [floor for floor in (kth(low, count), seen[-1] if len(seen) == count else None) if floor is not None]
        return high >= max(ends) if ends else np.ones(len(low), dtype=bool)

    found = block.best(*block.descend(np.array(anchor["_v"]), (block.labels == anchor["_label"]) & (block.rows != anchor["_row"]), settle), count)
    floors[anchor["_row"]] = sorted(seen + [score for *_, score in found], reverse=True)[:count]
    return [(0, *row) for row in found]


def in_windows(block: Block, anchor: dict, floors: dict[int, list[int]], count: int, share: int) -> list[tuple[int, int, int, int]]:
    """For each of the anchor's positive scores, the block's first rows of other labels within its window."""
    windows = [(at, -(-share * top // 100), top) for at, top in enumerate(anchor["_tops"]) if share * top <= 100 * top]
    seen = {at: floors.setdefault((anchor["_row"], at), []) for at, _, _ in windows}

    def settle(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), dtype=bool)
        for at, least, top in windows:
            inside = kth(low[(low >= least) & (high <= top)], count)
            ends = [least, *([] if inside is None else [inside]), *(seen[at][-1:] if len(seen[at]) == count else [])]
            stay |= (high >= max(ends)) & (low <= top)
        return stay

    found = []
    places, sums = block.descend(np.array(anchor["_v"]), block.labels != anchor["_label"], settle) if windows else (np.array([], dtype=int),) * 2
    for at, least, top in windows:
        inside = (sums >= least) & (sums <= top)
        rows = block.best(places[inside], sums[inside], count)
        floors[(anchor["_row"], at)] = sorted(seen[at] + [score for *_, score in rows], reverse=True)[:count]
        found += [(at, *row) for row in rows]
    return found


def met(columns: DataFrame, anchors: DataFrame, chunks: int, find: Callable) -> DataFrame:
    """What ``find`` gives for each anchor in each block: _anchor, _at, _found, _key, _score.

    Anchors, the stated query set, meet the blocks in chunks: a task holds one block and one chunk at a time.
    """
    spark = columns.sparkSession
    chunked = anchors.groupBy("_chunk").agg(F.collect_list(F.struct(*[name for name in anchors.columns if name != "_chunk"])).alias("anchors"))
    spread = columns.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(3 * spark.sparkContext.defaultParallelism, "_chunk", "_block")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                block, out = Block(row), []
                for anchor in row["anchors"].as_py():
                    out += [(anchor["_row"], *found) for found in find(block, anchor, floors)]
                kinds = [("_anchor", pa.int64()), ("_at", pa.int32()), ("_found", pa.int64()), ("_key", pa.int64()), ("_score", pa.int64())]
                yield pa.RecordBatch.from_pydict({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate(kinds)})

    return spread.join(chunked, "_chunk").mapInArrow(of_batches, "_anchor long, _at int, _found long, _key long, _score long")


def first(found: DataFrame, count: int) -> DataFrame:
    """The first rows of each anchor and window over all blocks, numbered from 1 as _rank."""
    rank = F.expr("row_number() OVER (PARTITION BY _anchor, _at ORDER BY _score DESC, _key, _found)")
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= count)


def mine(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    share: int = SHARE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each anchor and each of its first rows of the same label, the first rows of other labels that come close.

    Components are floor(256 x), scores whole inner products; higher scores come first, then smaller keys. A negative
    qualifies where share * positive <= 100 * negative <= 100 * positive. Two vertical scans are made over all
    blocks, one for the positives and one for the windows they open; each gives at most a few rows for an anchor and
    block, and bounds drop rows only where their score can no longer matter. Ties are never dropped before the end.

    Rows with a null key, label or vector, or a component that is null or not finite take no part. Vectors of
    different lengths count as filled with zeros. Each row counts for itself, also where rows repeat: it can be a
    positive or negative of its twin, and a repeated anchor gives its rows twice. Components saturate at 2^25. An
    empty table gives an empty table; extra columns are ignored. A vector that very many rows share moves once per
    row and block, and only its smallest keys leave a block. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    rows = common.stored(usable(vectors, key, label, vector, anchors))
    columns = common.stored(vertical(rows, block_rows))
    asked = rows.filter("_anchor").drop("_anchor")
    chunks = max(1, -(-asked.count() // CHUNK_ANCHORS))
    asked = common.stored(asked.withColumn("_chunk", F.pmod(F.xxhash64(F.lit("chunk"), "_row"), F.lit(chunks)).cast("int")))

    near = first(met(columns, asked, chunks, lambda block, anchor, floors: nearest(block, anchor, floors, positives)), positives)
    pairs = common.stored(near.select(F.col("_anchor").alias("_row"), (F.col("_rank") - 1).alias("_at"), F.col("_key").alias("positive_id"), F.col("_score").alias("positive_score")))
    tops = pairs.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "positive_score"))), lambda p: p["positive_score"]).alias("_tops"))
    opened = common.stored(asked.join(tops, "_row"))
    inside = first(met(columns, opened, chunks, lambda block, anchor, floors: in_windows(block, anchor, floors, negatives, share)), negatives)
    found = inside.select(F.col("_anchor").alias("_row"), "_at", F.col("_rank").cast("int").alias("rank"), F.col("_key").alias("negative_id"), F.col("_score").alias("negative_score"))
    return (
        found.join(pairs, ["_row", "_at"])
        .join(asked.select("_row", F.col("_key").alias("anchor_id")), "_row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
