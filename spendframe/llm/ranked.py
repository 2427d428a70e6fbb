"""Ranked lexical search: an index of posting lists and of term pairs in blocks, read by MaxScore with pair bounds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import common

BEST = 50
BLOCK_DOCS = 8192
CHUNK_ITEMS = 512
# What no term holds (ASCII but for digits and letters), and the whole numbers of the score.
OTHER_ASCII = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
WEIGHT, IMPACT, GROWTH, LENGTH, EVEN = 1000, 1_000_000_000, 1000, 20, 50
# Above ASCII letters a byte belongs to a term as it stands, so terms can be cut from the bytes of UTF-8.
SPACED = bytes.maketrans(OTHER_ASCII + common.UPPER.encode(), b" " * len(OTHER_ASCII) + common.LOWER.encode())
# The row that stands for a document as a whole.
WHOLE = ""
LAST = np.iinfo(np.int64).max


def counted(rows: DataFrame) -> DataFrame:
    """Rows (_row, _key, _body: binary) as one row per distinct term: _row, _key, _n (terms with repeats), _term, _tf.

    Each document has a row for the empty term too, so that it counts where it has no asked term.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, body in enumerate(batch.column(2)):
                words = body.as_py().translate(SPACED).split()
                terms = Counter(words)
                terms[b""] = 0
                size = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[at].as_py()] * size, pa.int64()),
                        pa.array([batch.column(1)[at].as_py()] * size, pa.int64()),
                        pa.array(np.full(size, len(words), dtype=np.int64)),
                        pa.array(list(terms), pa.binary()).cast(pa.string()),
                        pa.array(list(terms.values()), pa.int64()),
                    ],
                    ["_row", "_key", "_n", "_term", "_tf"],
                )

    return rows.mapInArrow(of_batches, "_row long, _key long, _n long, _term string, _tf long")


def item_terms(items: DataFrame, text: str, key: str) -> DataFrame:
    """The distinct terms of each item row: _item, _name, _term."""
    rows = items.select(F.monotonically_increasing_id().alias("_row"), items[key].cast("long").alias("_key"), F.coalesce(items[text].cast("string"), F.lit("")).cast("binary").alias("_body"))
    return counted(rows).filter(F.col("_term") != WHOLE).select(F.col("_row").alias("_item"), F.col("_key").alias("_name"), "_term")


def impact(documents: int, terms: int) -> Column:
    """What a term adds to a document's score."""
    norm = F.lit(100 - EVEN) + F.expr(f"({EVEN}L * _n * {documents}L) div {terms}L")
    return F.col("_w") * F.call_function("div", F.lit(IMPACT).cast("long") * F.col("_tf"), GROWTH * F.col("_tf") + LENGTH * norm)


def listed(postings: DataFrame, best: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Posting lists (_block, _term, hits, top, peak): hits by document number, the greatest impact, the best impacts."""
    blocks = max(1, -(-postings.select("_row").distinct().count() // block_docs))
    dealt = postings.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int"))
    lists = dealt.groupBy("_block", "_term").agg(F.sort_array(F.collect_list(F.struct("_row", "_key", "_impact"))).alias("_hits"))
    impacts = F.transform("_hits", lambda hit: hit["_impact"])
    return lists.select(
        "_block",
        "_term",
        F.transform("_hits", lambda hit: hit["_row"]).alias("rows"),
        F.transform("_hits", lambda hit: F.coalesce(hit["_key"], F.lit(int(LAST)))).alias("keys"),
        impacts.alias("impacts"),
        F.array_max(impacts).alias("top"),
        F.slice(F.sort_array(impacts, asc=False), 1, best).alias("peak"),
    )


def arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    return [part.values.to_numpy(zero_copy_only=False) for chunk in column.chunks for part in chunk]


def paired(lists: DataFrame, pairs: DataFrame, best: int) -> DataFrame:
    """Intersections of the asked pairs of posting lists in each block: _block, a, b, rows, top, peak.

    ``top`` is the greatest joint impact of a document that has both terms, ``peak`` the best joint impacts;
    pairs that meet in no document of a block have a row with top 0.
    """
    ends = [lists.select(F.col("_block").alias("_block"), F.col("_term").alias(name)) for name in ("a", "b")]
    asked = ends[0].join(pairs, "a").join(ends[1], ["_block", "b"])

    def of_block(table: pa.Table, wanted: pa.Table) -> pa.Table:
        at = {term: i for i, term in enumerate(table["_term"].to_pylist())}
        numbers, impacts = arrays(table["rows"]) if at else [], arrays(table["impacts"]) if at else []
        every = np.unique(np.concatenate(numbers)) if numbers else np.array([], dtype=np.int64)
        places = [np.searchsorted(every, rows) for rows in numbers]
        first, out = np.zeros(len(every), dtype=np.int64), []
        followers: dict[str, list[str]] = {}
        for a, b in zip(wanted["a"].to_pylist(), wanted["b"].to_pylist(), strict=True):
            followers.setdefault(a, []).append(b)
        for a, others in followers.items():
            first[places[at[a]]] = impacts[at[a]]
            seen = np.zeros(len(every), dtype=bool)
            seen[places[at[a]]] = True
            for b in others:
                both = seen[places[at[b]]]
                joint = first[places[at[b]][both]] + impacts[at[b]][both]
                out.append((a, b, len(joint), int(joint.max(initial=0)), np.sort(joint)[::-1][:best]))
            first[places[at[a]]] = 0
        block = wanted["_block"].slice(0, 1).to_pylist() * len(out)
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        names = ["a", "b", "rows", "top", "peak"]
        return pa.table({"_block": pa.array(block, pa.int32())} | {name: pa.array([row[i] for row in out], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))})

    return lists.select("_block", "_term", "rows", "impacts").groupBy("_block").cogroup(asked.groupBy("_block")).applyInArrow(of_block, "_block int, a string, b string, rows int, top long, peak array<long>")


def floor_of(peaks: DataFrame, keys: list[str], best: int) -> DataFrame:
    """The best-th greatest impact over all blocks, where there are so many: a score that so many documents reach."""
    rank = F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY _impact DESC)")
    each = peaks.select(*keys, F.explode("peak").alias("_impact")).withColumn("_rank", rank).filter(F.col("_rank") <= best)
    return each.filter(F.col("_rank") == best).select(*keys, F.col("_impact").alias("_floor"))


class Lists:
    """The posting lists and pair bounds of one block."""

    def __init__(self, lists: pa.Table, pairs: dict[tuple[str, str], int]):
        self.at = {term: i for i, term in enumerate(lists["_term"].to_pylist())}
        numbers, keys = arrays(lists["rows"]), arrays(lists["keys"])
        self.impacts, self.tops, self.pairs = arrays(lists["impacts"]), lists["top"].to_pylist(), pairs
        self.rows, first = np.unique(np.concatenate(numbers), return_index=True)
        self.keys = np.concatenate(keys)[first]
        self.places = [np.searchsorted(self.rows, x) for x in numbers]

    def bound(self, terms: list[str]) -> int:
        """No document without other asked terms scores more.

        Each list alone adds its greatest impact. Two paired lists add their greatest joint impact, or one of
        them alone; pairs that share no term are joined, the ones that save most first.
        """
        alone = {term: self.tops[self.at[term]] for term in terms}
        saved = []
        for (a, b), joint in ((pair, self.pairs[pair]) for pair in zip(terms, terms[1:]) if pair in self.pairs):
            saved.append((alone[a] + alone[b] - max(joint, alone[a], alone[b]), a, b))
        total, free = sum(alone.values()), set(terms)
        for less, a, b in sorted(saved, reverse=True):
            if less > 0 and a in free and b in free:
                total -= less
                free -= {a, b}
        return total

    def search(self, asked: list[str], floor: int, best: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the block's best documents for terms in their paired order.

        Terms are taken off the query, the weakest first, as long as a document with the taken terms alone stays
        below the floor: these are not read for candidates. Documents of the other lists are candidates; they are
        looked up in the lists taken off, strongest first, while their score so far and the bound of what is left
        reach the floor. A bound equal to the floor stays, as the key may decide.
        """
        terms = [term for term in asked if term in self.at]
        weakest = sorted(terms, key=lambda term: self.tops[self.at[term]])
        bounds = [0]  # of the 0, 1, 2 ... weakest
        for count in range(1, len(weakest) + 1):
            bounds.append(self.bound([term for term in terms if term in set(weakest[:count])]))
            if bounds[-1] >= max(floor, 1):
                break
        else:
            return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
        off = len(bounds) - 2
        sums = np.zeros(len(self.rows), dtype=np.int64)
        for term in weakest[off:]:
            sums[self.places[self.at[term]]] += self.impacts[self.at[term]]
        found = np.flatnonzero(sums)
        sums = sums[found]
        for left in range(off, -1, -1):
            if len(sums) >= best:
                floor = max(floor, int(np.partition(sums, len(sums) - best)[len(sums) - best]))
            stay = sums + bounds[left] >= floor
            found, sums = found[stay], sums[stay]
            if left and len(found):
                at = self.at[weakest[left - 1]]
                where = np.minimum(np.searchsorted(self.places[at], found), len(self.places[at]) - 1)
                sums = sums + np.where(self.places[at][where] == found, self.impacts[at][where], 0)
        first = np.lexsort((self.rows[found], self.keys[found], -sums))[:best]
        return found[first], sums[first]


def searched(lists: DataFrame, pairs: DataFrame, items: DataFrame, chunks: int, best: int) -> DataFrame:
    """The best documents of each block for each item: _item, _row, _key, _score.

    ``items`` has _chunk, _item, _terms in paired order and _floor; a task holds one block's lists for one chunk.
    """
    terms = items.select("_chunk", F.explode("_terms").alias("_term")).distinct()
    left = lists.select("_block", "_term", "rows", "keys", "impacts", "top").join(terms, "_term")
    blocks = lists.select(F.col("_block").alias("_block")).distinct()
    # One row per block and item: the stated query set against all blocks.
    asked = blocks.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(items, "_chunk")
    shape = ["_block", "_chunk", "_item", "_terms", "_floor", "a", "b", "top"]
    both = asked.withColumns({"a": F.lit(None).cast("string"), "b": F.lit(None).cast("string"), "top": F.lit(None).cast("long")}).select(*shape)
    used = items.select("_chunk", F.explode(adjacent(F.col("_terms"))).alias("_pair")).select("_chunk", "_pair.a", "_pair.b").distinct()
    bounds = pairs.select("_block", "a", "b", "top").join(used, ["a", "b"])
    both = both.unionByName(bounds.withColumns({"_item": F.lit(None).cast("long"), "_terms": F.lit(None).cast("array<string>"), "_floor": F.lit(None).cast("long")}).select(*shape))

    def of_block(table: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and wanted.num_rows:
            rows = wanted.to_pylist()
            block = Lists(table, {(row["a"], row["b"]): row["top"] for row in rows if row["a"] is not None})
            for row in rows:
                if row["a"] is None:
                    found, sums = block.search(row["_terms"], row["_floor"], best)
                    out += [(row["_item"], int(block.rows[p]), int(block.keys[p]), int(s)) for p, s in zip(found, sums, strict=True) if s > 0]
        return pa.table({name: pa.array([row[i] for row in out], pa.int64()) for i, name in enumerate(("_item", "_row", "_key", "_score"))})

    return left.groupBy("_block", "_chunk").cogroup(both.groupBy("_block", "_chunk")).applyInArrow(of_block, "_item long, _row long, _key long, _score long")


def adjacent(terms: Column) -> Column:
    """Pairs of neighbours in an array of terms."""
    return F.transform(F.slice(terms, 1, F.greatest(F.size(terms) - 1, F.lit(0))), lambda term, at: F.struct(term.alias("a"), F.get(terms, at + 1).alias("b")))


def rank(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    best: int = BEST,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """The documents with the highest scores for each item: item_id, rank, doc_id, score (columns named as the keys).

    Terms are runs of digits, letters and all characters above ASCII, with A to Z in lower case. Documents are dealt
    to blocks; a block has a posting list per asked term, with its greatest impact, and for neighbouring terms of
    an item (by weight) the joint impacts of their intersection. The best-th greatest impact of a term or pair
    over all blocks is a floor that so many documents reach. In each block MaxScore leaves out the lists whose
    bound, tightened by the pairs, stays below the floor. All results that may matter leave the block, so scores and
    ranks are exact. Only terms of the items are indexed.

    Each row of ``docs`` and ``items`` counts for itself, also where rows repeat. Null and empty texts have no terms,
    are not counted as documents and never found; items without terms have no rows. Equal scores go by ascending
    key, null keys last, ranks are unique. Empty tables give an empty table. Very long texts are read whole. Extra
    columns are ignored.
    """
    words = common.stored(item_terms(items, item_text, item_key))
    # Stored first, so that the planner knows its size and sends it to the terms of the documents where it is small.
    vocabulary = common.stored(words.select("_term").unionByName(words.sparkSession.createDataFrame([(WHOLE,)], "_term string")).distinct())
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), docs[key].cast("long").alias("_key"), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("_body"))
    held = common.stored(counted(rows).join(vocabulary, "_term"))
    postings = held.filter(F.col("_term") != WHOLE)
    size = held.filter((F.col("_term") == WHOLE) & (F.col("_n") > 0)).agg(F.count(F.lit(1)).alias("documents"), F.sum("_n").alias("terms")).first()
    documents, terms = size["documents"], max(size["terms"] or 0, 1)

    weight = F.floor(WEIGHT * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("_df") + 1))).cast("long")
    weights = common.stored(postings.groupBy("_term").agg(F.count(F.lit(1)).alias("_df")).select("_term", weight.alias("_w")))
    scored = postings.join(weights, "_term").withColumn("_impact", impact(documents, terms)).filter("_impact > 0")
    lists = common.stored(listed(scored, best, block_docs))

    # Neighbours by weight: rare terms beside rare ones, which seldom meet and so save most.
    order = F.transform(F.sort_array(F.collect_list(F.struct("_w", "_term")), asc=False), lambda t: t["_term"])
    asked = common.stored(words.join(weights, "_term").groupBy("_item", "_name").agg(order.alias("_terms")))
    pairs = asked.select(F.explode(adjacent(F.col("_terms"))).alias("_pair")).select("_pair.a", "_pair.b").distinct()
    joint = common.stored(paired(lists, pairs, best))

    floors = floor_of(lists, ["_term"], best).join(asked.select("_item", F.explode("_terms").alias("_term")), "_term").select("_item", "_floor")
    neighbours = asked.select("_item", F.explode(adjacent(F.col("_terms"))).alias("_pair")).select("_item", "_pair.a", "_pair.b")
    floors = floors.unionByName(floor_of(joint, ["a", "b"], best).join(neighbours, ["a", "b"]).select("_item", "_floor"))
    chunks = max(1, -(-asked.count() // CHUNK_ITEMS))
    queries = common.stored(
        asked.join(floors.groupBy("_item").agg(F.max("_floor").alias("_floor")), "_item", "left").select(
            F.pmod(F.xxhash64(F.lit("chunk"), "_item"), F.lit(chunks)).cast("int").alias("_chunk"), "_item", "_terms", F.coalesce("_floor", F.lit(0)).cast("long").alias("_floor")
        )
    )
    found = searched(lists, joint, queries, chunks, best)
    place = F.expr("row_number() OVER (PARTITION BY _item ORDER BY _score DESC, _key, _row)")
    top = found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= best)
    return top.join(asked.select("_item", "_name"), "_item").select(
        F.col("_name").alias(item_key), "rank", F.when(F.col("_key") < int(LAST), F.col("_key")).alias(key), F.col("_score").alias("score")
    )
