"""Near duplicates by SimHash, found with a self-join of the binary trie of all fingerprints."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import common
from spendframe.llm.components import components

MAX_BITS = 4
NODE_ROWS = 16_384
STEP = 4
HASH_SEED = 42
# The search for looser copies: several fingerprints of two-word runs, then runs of five words compared.
SEARCH_WIDTH = 2
SEARCH_BITS = 5
SEARCH_PRINTS = 8
RUN_WIDTH = 5
SHARE = (4, 5)
MARKS = 8
# Leaders of a class, then of a cell, grow by these factors from round to round.
CLASS_ROUNDS = 2
MORE_LEADERS = (4, 16)
RESULTS = ("fingerprint", "component_id")


def run_hashes(text: bytes, width: int, seed: int = HASH_SEED) -> list[int]:
    """A hash of each run of ``width`` words, repeats included; of the whole text where it has fewer words."""
    words = text.lower().split()
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(line, seed)]
    ends = list(accumulate(len(word) + 1 for word in words))
    starts = [0, *ends]
    return [digest(line[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def fingerprint(text: bytes, width: int, seed: int = HASH_SEED) -> int:
    """64 bits, each set where it is set in over half of the hashes of the text's shingles."""
    hashes = run_hashes(text, width, seed)
    if not hashes:
        return 0
    values = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 65_536):
        ones += np.unpackbits(values[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, width: int, seed: int = HASH_SEED) -> Column:
    """The fingerprint of each text as a long; null texts are empty."""

    @F.arrow_udf("long")
    def of_batch(texts: pa.Array) -> pa.Array:
        values = [fingerprint(body, width, seed) for body in texts.to_pylist()]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return of_batch(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


# The constants of the finalizer of the SplitMix64 generator.
MIX_STEP, MIX_FIRST, MIX_SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Other hashes of the same runs, one set for each number."""
    x = hashes ^ np.uint64(number * int(MIX_STEP) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * MIX_FIRST
    x = (x ^ (x >> np.uint64(27))) * MIX_SECOND
    return x ^ (x >> np.uint64(31))


def majority(blocks: list[np.ndarray], count: int, number: int) -> int:
    """64 bits, each set where it is set in over half of the mixed hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for block in blocks:
        bits = np.unpackbits(mixed(block, number).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def several_prints(text: Column, width: int, prints: int) -> Column:
    """Independent fingerprints of each text; its runs are hashed once and the hashes mixed anew for each."""

    @F.arrow_udf("array<long>")
    def of_batch(texts: pa.Array) -> pa.Array:
        rows = []
        for body in texts:
            hashes = np.array(run_hashes(body.as_py(), width), dtype="<u8")
            blocks = [hashes[at : at + 65_536] for at in range(0, len(hashes), 65_536)]
            rows.append(np.array([majority(blocks, len(hashes), k) if blocks else 0 for k in range(prints)], dtype=np.uint64).view(np.int64))
        return pa.array(rows, pa.list_(pa.int64()))

    return of_batch(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def marks_of(values: np.ndarray) -> np.ndarray:
    """Bits that say whether an odd number of the values fall to them: of two sets no more differ than values do."""
    odd = np.bincount((values & np.uint64(64 * MARKS - 1)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def run_sets(text: Column, width: int) -> Column:
    """The distinct hashes of each text's runs of words, and the marks of this set; null texts are empty."""

    @F.arrow_udf("struct<runs: array<long>, marks: array<long>>")
    def of_batch(texts: pa.Array) -> pa.Array:
        values = [np.unique(np.array(run_hashes(body.as_py(), width), dtype=np.uint64)) for body in texts]
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array([v.view(np.int64) for v in values], kind), pa.array([marks_of(v) for v in values], kind)], ["runs", "marks"])

    return of_batch(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def hex_text(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


class Trie:
    """The binary trie of sorted distinct values below a depth; nodes are ranges of the values."""

    def __init__(self, values: np.ndarray, depth: int):
        self.values, self.depth = values, depth
        split = np.zeros(len(values), dtype=np.int8)
        if len(values) > 1:
            apart = values[1:] ^ values[:-1]
            for shift in (32, 16, 8, 4, 2, 1):  # position of the first bit that differs
                high = (apart >> np.uint64(64 - shift)) == 0
                split[1:] += np.where(high, shift, 0).astype(np.int8)
                apart = np.where(high, apart << np.uint64(shift), apart)
        self.split = split
        self.levels: dict[int, tuple] = {}

    def starts(self, depth: int) -> np.ndarray:
        found = np.flatnonzero(self.split < depth)
        return found if len(found) and found[0] == 0 else np.concatenate([[0], found])

    def level(self, depth: int) -> tuple:
        """Starts and ends of the nodes at a depth, and their children for bit 0 and bit 1 (-1: none)."""
        if depth not in self.levels:
            starts = self.starts(depth)
            ends = np.append(starts[1:], len(self.values))
            if depth == 64:
                self.levels[depth] = (starts, ends, None, None)
            else:
                below = self.starts(depth + 1)
                first = np.searchsorted(below, starts)
                after = np.append(first[1:], len(below))
                bit = (self.values[starts] >> np.uint64(63 - depth)) & np.uint64(1) == 1
                zero = np.where(bit, -1, first)
                one = np.where(bit, first, np.where(after - first == 2, first + 1, -1))
                self.levels[depth] = (starts, ends, zero, one)
        return self.levels[depth]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; a label is the smallest position of its set."""
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if not (low < high).any():
            return
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def linked(values: np.ndarray, depth: int, budget: int, half: int, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all values within ``budget`` differing bits, at most ``half`` of them in the upper 32.

    ``values`` are sorted and distinct and fall into one or two nodes at ``depth``: one is joined with itself,
    two with each other. Node pairs descend together, bit by bit; a pair goes when its differing bits exceed
    the budget, or when both nodes lie whole in one set already. Links are returned as a forest, so their
    number is below that of the values even where all of them are close.
    """
    trie, label = Trie(values, depth), np.arange(len(values))
    starts = trie.level(depth)[0]
    apart = int(np.bitwise_count((values[starts[0]] ^ values[starts[-1]]) >> np.uint64(64 - depth))) if depth else 0
    stack = [(depth, np.array([0]), np.array([len(starts) - 1]), np.array([apart], dtype=np.int8))]
    changes = np.arange(len(values))
    while stack:
        at, left, right, bits = stack.pop()
        if len(left) > block:
            stack.append((at, left[block:], right[block:], bits[block:]))
            left, right, bits = left[:block], right[:block], bits[:block]
        starts, ends, zero, one = trie.level(at)
        a, b, a_end, b_end = starts[left], starts[right], ends[left], ends[right]
        whole = (changes[a_end - 1] == changes[a]) & (changes[b_end - 1] == changes[b]) & (label[a] == label[b])
        work = (a_end - a) * (b_end - b)
        small = ~whole & ((work <= 16) | (at == 64))
        if small.any():
            size, width = work[small], (b_end - b)[small]
            pair = np.repeat(np.arange(len(size)), size)
            step = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            i, j = a[small][pair] + step // width[pair], b[small][pair] + step % width[pair]
            x = values[i] ^ values[j]
            close = (np.bitwise_count(x) <= budget) & (np.bitwise_count(x >> np.uint64(32)) <= half) & (label[i] != label[j])
            if close.any():
                merge(label, i[close], j[close])
                changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        rest = ~whole & ~small
        if not rest.any():
            continue
        left, right, bits = left[rest], right[rest], bits[rest]
        limit = half if at + 1 <= 32 else budget
        same, across = [], bits + 1 <= limit
        pairs = [(zero[left], zero[right], bits), (one[left], one[right], bits)]
        other = across & (left != right)
        pairs += [(zero[left[across]], one[right[across]], bits[across] + 1), (one[left[other]], zero[right[other]], bits[other] + 1)]
        for p, q, d in pairs:
            there = (p >= 0) & (q >= 0)
            same.append((p[there], q[there], d[there]))
        stack.append((at + 1, *(np.concatenate([s[k] for s in same]) for k in range(3))))
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def prefix(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, 64 - depth) if depth else F.lit(0).cast("long")


def trie_join(values: DataFrame, max_bits: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that connect all values (distinct longs in column v) within ``max_bits`` differing bits."""
    return tries_join(values.select(F.lit(0).alias("t"), "v"), max_bits, node_rows).select("a", "b")


def tries_join(values: DataFrame, max_bits: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (t, a, b) that connect the values of each trie (t: int, v: long, distinct) within ``max_bits`` bits.

    Of the upper and the lower 32 bits, one half has at most half of the differing bits; the caller gives the
    values in both orders of the halves, and this join takes the pairs whose upper half has few.

    The upper part of the tries is traversed as tables: pairs of nodes with too many values are replaced by the
    pairs of their children, four bits at a time, and pruned by their differing bits. Pairs of small nodes are
    then traversed inside tasks. A task so holds two nodes of ``node_rows`` values at most, of any distribution.
    """
    half, depth = max_bits // 2, 0
    pairs = values.groupBy("t").agg(F.count(F.lit(1)).alias("na")).select("t", F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"), "na", F.col("na").alias("nb"))
    ready = []
    while True:
        pairs = common.stored(pairs)
        large = F.greatest("na", "nb") > node_rows
        ready.append((depth, pairs.filter(~large).select("t", "pa", "pb")))
        open_pairs = pairs.filter(large)
        if depth == 64 or open_pairs.isEmpty():
            break
        nodes = common.stored(values.groupBy("t", prefix(F.col("v"), depth + STEP).alias("p")).agg(F.count(F.lit(1)).alias("n")))
        above = F.shiftrightunsigned("p", STEP) if depth else F.lit(0).cast("long")
        a = nodes.select("t", above.alias("pa"), F.col("p").alias("ca"), F.col("n").alias("ca_n"))
        b = nodes.select("t", above.alias("pb"), F.col("p").alias("cb"), F.col("n").alias("cb_n"))
        depth += STEP
        limit = half if depth <= 32 else max_bits
        pairs = (
            open_pairs.join(a, ["t", "pa"])
            .join(b, ["t", "pb"])
            .filter((F.col("pa") != F.col("pb")) | (F.col("ca") <= F.col("cb")))
            .filter(F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= limit)
            .select("t", F.col("ca").alias("pa"), F.col("cb").alias("pb"), F.col("ca_n").alias("na"), F.col("cb_n").alias("nb"))
        )

    def sides(level: int, done: DataFrame) -> DataFrame:
        ends = done.select("t", "pa", "pb", F.explode(F.array_distinct(F.array("pa", "pb"))).alias("p"))
        keyed = values.select("t", "v", prefix(F.col("v"), level).alias("p"))
        return keyed.join(ends, ["t", "p"]).select(F.lit(level).alias("depth"), "t", "pa", "pb", "v")

    def traverse(group: pa.Table) -> pa.Table:
        own = np.sort(group.column("v").to_numpy().view(np.uint64))
        a, b = linked(own, group.column("depth")[0].as_py(), max_bits, half)
        return pa.table({"t": pa.array(np.full(len(a), group.column("t")[0].as_py(), dtype=np.int32)), "a": a.view(np.int64), "b": b.view(np.int64)})

    grouped = reduce(DataFrame.unionByName, [sides(level, done) for level, done in ready if not done.isEmpty()] or [sides(0, ready[0][1])])
    return grouped.groupBy("depth", "t", "pa", "pb").applyInArrow(traverse, "t int, a long, b long")


def turned(value: Column) -> Column:
    """The value with its halves exchanged."""
    return F.shiftleft(value, 32).bitwiseOR(F.shiftrightunsigned(value, 32))


def classes(prints: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Fingerprints with their class, from rows (_key, _print): _print, _root, _least (smallest key of the class)."""
    least = common.stored(prints.groupBy("_print").agg(F.min("_key").alias("_own")))
    values = least.select(F.col("_print").alias("v"))
    straight = trie_join(values, max_bits, node_rows)
    crossed = trie_join(values.select(turned(F.col("v")).alias("v")), max_bits, node_rows).select(turned(F.col("a")).alias("a"), turned(F.col("b")).alias("b"))
    roots = components(common.stored(straight.unionByName(crossed)))
    joined = common.stored(least.join(roots.withColumnRenamed("node", "_print"), "_print").select("_print", F.col("root").alias("_root"), "_own"))
    lowest = joined.groupBy("_root").agg(F.min("_own").alias("_least"))
    several = joined.join(lowest, "_root").select("_print", "_root", "_least")
    return common.stored(
        least.join(several, "_print", "left").select("_print", F.coalesce("_root", "_print").alias("_root"), F.coalesce("_least", "_own").alias("_least"))
    )


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, max_bits: int = MAX_BITS, carry: list[str] | None = None) -> DataFrame:
    """Every row with its fingerprint and the smallest key of the rows it is linked to, over any number of links.

    Texts are lower-cased from A to Z and cut into runs of ``width`` words, repeats included; shorter texts are
    one run, texts without words have fingerprint zero and are linked like any other. Equal fingerprints are
    joined as one value, so copies cost nothing in the search. Null texts are empty; null keys count only where
    all keys of a class are null. Empty table: empty table. Returns ``carry`` (all columns by default),
    fingerprint and component_id; input columns of these two names are replaced.
    """
    carry = list(docs.columns) if carry is None else list(carry)
    rows = docs.select(common.packed(docs, carry).alias("_row"), docs[key].alias("_key"), fingerprints(docs[text], width).alias("_print"))
    if text not in carry:
        rows = common.stored(rows)
        found = classes(rows.select("_key", "_print"), max_bits)
    else:
        found = classes(common.stored(rows.select("_key", "_print")), max_bits)
    return rows.join(found, "_print").select(*common.unpacked("_row", carry, set(RESULTS)), hex_text(F.col("_print")).alias("fingerprint"), F.col("_least").alias("component_id"))


def distinct(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each class of ``groups``, with its columns as they are.

    The row with the smallest key stays, then the smallest fingerprint, then the smallest hash of the text;
    of rows alike in all of these any one.
    """
    names = list(docs.columns)
    rows = docs.select(
        common.packed(docs).alias("_row"),
        docs[key].alias("_key"),
        F.xxhash64(docs[text]).alias("_text_hash"),
        fingerprints(docs[text], width).alias("_print"),
    )
    light = common.stored(rows.select("_key", "_text_hash", "_print"))
    found = classes(light, max_bits)
    order = F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_print").alias("p"), F.col("_text_hash").alias("t"), F.col("_n").alias("count"))
    first = common.stored(
        light.groupBy("_key", "_text_hash", "_print")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(found, "_print")
        .groupBy("_root")
        .agg(F.min(order).alias("_first"))
        .select(F.col("_first.k").alias("_k"), F.col("_first.p").alias("_print"), F.col("_first.t").alias("_t"), F.col("_first.count").alias("_n"))
    )
    chosen = rows.join(first, "_print").filter(F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_text_hash") == F.col("_t")))
    if not first.filter("_n > 1").isEmpty():  # rows alike in all that orders them
        chosen = chosen.dropDuplicates(["_print", "_k", "_t"])
    return chosen.select(*common.unpacked("_row", names))


def suspected(light: DataFrame, max_bits: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """Rows (_id, _class) that share a class with another, from rows (_id, _prints: fingerprints, one of each kind).

    The tries of all kinds, in both orders of the halves, are joined together, which links values of one kind. Rows
    with linked values of any kind are one class, so a row is in one class at most and stays one row here.
    """
    each = light.select("_id", F.posexplode("_prints").alias("_kind", "_print"))
    distinct_prints = common.stored(each.select("_kind", "_print").distinct())
    straight = distinct_prints.select((F.col("_kind") * 2).alias("t"), F.col("_print").alias("v"))
    crossed = distinct_prints.select((F.col("_kind") * 2 + 1).alias("t"), turned(F.col("_print")).alias("v"))
    links = common.stored(tries_join(common.stored(straight.unionByName(crossed)), max_bits, node_rows))

    def node(name: str) -> Column:
        value = F.when(F.col("t") % 2 == 0, F.col(name)).otherwise(turned(F.col(name)))
        return F.xxhash64((F.col("t") / 2).cast("int"), value)

    roots = components(links.select(node("a").alias("a"), node("b").alias("b")))
    nodes = each.select("_id", F.xxhash64("_kind", "_print").alias("node"))
    placed = common.stored(nodes.join(roots, "node", "left").select("_id", F.coalesce("root", "node").alias("_root")))
    shared = placed.groupBy("_root").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")).filter("_low <> _high").select("_root", F.lit(True).alias("_shared"))
    held = placed.join(shared, "_root", "left").groupBy("_id").agg(F.array_sort(F.collect_set(F.when(F.col("_shared"), F.col("_root")))).alias("_roots"))
    held = common.stored(held.filter(F.size("_roots") > 0))
    # Rows with the same values of all kinds give the same links, so a large class of copies gives few.
    joint = held.filter(F.size("_roots") > 1).select("_roots").distinct()
    joint = components(joint.select(F.col("_roots")[0].alias("a"), F.explode("_roots").alias("b")))
    return held.select("_id", F.col("_roots")[0].alias("node")).join(joint, "node", "left").select("_id", F.coalesce("root", "node").alias("_class"))


def cells(members: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Members (_cell, _id, _size, _marks, _group) of smaller cells for members of classes, without losing a pair of groups.

    Sets of runs with a Jaccard similarity of ``share`` have at least that part of each of them in common. So, in any
    order of the runs of a class, they have a common run among the first ones of both, as many as the other part of
    the set and one more. Runs that one group alone holds come first and join nothing, then rare ones.
    """
    runs = F.when(F.size("_runs") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.col("_runs"))
    each = members.select("_id", "_cell", "_group").join(sets.select("_id", runs.alias("_runs")), "_id")
    each = common.stored(each.select("_id", "_cell", "_group", F.explode("_runs").alias("_run")))
    common_runs = each.groupBy("_cell", "_run").agg(F.count(F.lit(1)).alias("_rows"), F.min("_group").alias("_low"), F.max("_group").alias("_high"))
    common_runs = common_runs.filter("_low <> _high").select("_cell", "_run", "_rows")
    held = each.join(common_runs, ["_cell", "_run"]).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_rows", "_run"))).alias("_held"))
    size = F.greatest("_size", F.lit(1))
    first = size - F.ceil(size * share[0] / share[1]).cast("int") + 1 - (size - F.size("_held"))
    held = members.join(held, "_id").withColumn("_first", first).filter("_first > 0")
    held = held.select("_id", "_cell", "_size", "_marks", "_group", F.explode(F.slice("_held", 1, "_first")).alias("_at"))
    return held.withColumn("_cell", F.xxhash64("_cell", "_at._run")).drop("_at")


def distinct_verified(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    width: int = SEARCH_WIDTH,
    max_bits: int = SEARCH_BITS,
    run: int = RUN_WIDTH,
    share: tuple[int, int] = SHARE,
    prints: int = SEARCH_PRINTS,
) -> DataFrame:
    """One row of each group of rows of ``docs`` that are linked, over any number of links, by runs that are alike.

    The trie finds classes of fingerprints over ``width`` words: fewer words make steadier fingerprints, as a changed
    word changes fewer runs. The budget stays small, so that chance neighbours do not join classes, and the search
    makes up for it by ``prints`` independent fingerprints; rows that meet by any of them are one class. A few rows
    lead each class, and those of other groups are compared with them: rows are linked where the sets of their runs
    of ``run`` words have a Jaccard similarity of ``share`` or more, and linked rows are one group. So a class of many
    copies costs about one comparison for each. Classes that have several groups after these rounds are dealt into
    ``cells`` by runs that sets so similar must have in common, and four times as many leaders follow in each round,
    until a cell is one group or all its rows have led. So different rows of a class meet only where they share such a
    run, and all pairs of a class that can be alike and are not linked have been compared.
    No row goes on the word of fingerprints alone. Of a group the row of the smallest key stays, null keys last.

    Rows alike in key and text count as one, and any one of them stays. Texts without words are alike; null texts
    are empty. An empty table gives an empty table. Columns stay as they are.
    """
    names, body = list(docs.columns), F.coalesce(docs[text].cast("string"), F.lit(""))
    own_id = F.xxhash64(docs[key], body).alias("_id")
    found_prints = docs.select(own_id, docs[key].alias("_key"), several_prints(docs[text], width, prints).alias("_prints"))
    light = common.stored(found_prints.groupBy("_id").agg(F.any_value("_prints").alias("_prints"), F.min("_key").alias("_key"), F.count(F.lit(1)).alias("_n")))
    ranks = light.select("_id", F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_id").alias("i")).alias("_rank"))
    suspects = common.stored(suspected(light.select("_id", "_prints"), max_bits))
    sets = docs.select(own_id, body.alias("_body")).join(suspects, "_id").dropDuplicates(["_id"])
    sets = common.stored(sets.select("_id", "_class", run_sets(F.col("_body"), run).alias("_set")).select("_id", "_class", "_set.*").withColumnsRenamed({"runs": "_runs", "marks": "_marks"}))
    lead_sets = sets.select(F.col("_id").alias("_with"), F.col("_runs").alias("_lead_runs"))
    shared = F.size(F.array_intersect("_runs", "_lead_runs"))
    alike = shared * share[1] >= (F.size("_runs") + F.size("_lead_runs") - shared) * share[0]

    def counted(found: DataFrame) -> DataFrame:
        """Members of cells that hold several groups, with the number of members."""
        sizes = found.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_group").alias("_low"), F.max("_group").alias("_high"))
        return common.stored(found.join(sizes.filter("_low <> _high").select("_cell", "_n"), "_cell"))

    # Every row leads its cell once, by its turn; a pair meets where the earlier one leads, if it is not linked yet
    # and the sizes of the sets allow it.
    members = counted(sets.select(F.col("_class").alias("_cell"), "_id", F.size("_runs").alias("_size"), "_marks", F.col("_id").alias("_group")))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("turn"), F.col("_id")), 11).cast("double") / F.lit(float(1 << 53))
    turn = F.floor(place * F.col("_n")).cast("long")
    # Sets that are alike differ in so small a part of their runs, and in no more marks.
    apart = reduce(Column.__add__, [F.bit_count(F.col("_marks")[i].bitwiseXOR(F.col("_lead_marks")[i])) for i in range(MARKS)])
    marked = apart * (share[0] + share[1]) <= (F.col("_size") + F.col("_lead_size")) * (share[1] - share[0])
    links, roots, tested, whole = None, None, None, True
    level, done, more = 0, 0, MORE_LEADERS[0]
    while links is None or not members.isEmpty():
        leads = members.filter((turn >= done) & (turn < more**level)).select("_cell", turn.alias("_turn"), F.col("_id").alias("_with"), *(F.col(f"_{name}").alias(f"_lead_{name}") for name in ("group", "size", "marks")))
        later = (turn > F.col("_turn")) | ((turn == F.col("_turn")) & (F.col("_id") > F.col("_with")))
        sized = F.least("_size", "_lead_size") * share[1] >= F.greatest("_size", "_lead_size") * share[0]
        meet = members.join(leads, "_cell").filter(later & sized & marked & (F.col("_group") != F.col("_lead_group")))
        pairs = meet.select("_id", "_with", F.least("_id", "_with").alias("_p"), F.greatest("_id", "_with").alias("_q")).dropDuplicates(["_p", "_q"])
        if tested is not None:
            pairs = pairs.join(tested, ["_p", "_q"], "left_anti")
        pairs = common.stored(pairs)
        tested = pairs.select("_p", "_q") if tested is None else tested.unionByName(pairs.select("_p", "_q"))
        fresh = common.stored(pairs.join(sets.select("_id", "_runs"), "_id").join(lead_sets, "_with").filter(alike).select(F.col("_id").alias("a"), F.col("_with").alias("b")))
        done, level = more**level, level + 1
        members = members.filter(F.col("_n") > done).drop("_n")
        if links is None or not fresh.isEmpty():
            # What is linked already is one link for each row.
            links = fresh if links is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(fresh)
            roots = components(links)
            linked_to = roots.select(F.col("node").alias("_id"), F.col("root").alias("_now"))
            members = members.join(linked_to, "_id", "left").withColumn("_group", F.coalesce("_now", "_id")).drop("_now")
        members = counted(members)
        if whole and level == CLASS_ROUNDS and not members.isEmpty():
            members, whole = counted(cells(members.drop("_n"), sets, share)), False
            level, done, more = 0, 0, MORE_LEADERS[1]

    linked_rows = common.stored(roots.withColumnRenamed("node", "_id").join(ranks, "_id"))
    first = linked_rows.groupBy("root").agg(F.min("_rank").alias("_first"))
    gone = linked_rows.join(first, "root").filter(F.col("_id") != F.col("_first.i")).select("_id")
    rows = docs.select(common.packed(docs).alias("_row"), own_id)
    kept = rows.join(common.stored(gone), "_id", "left_anti")
    if not light.filter("_n > 1").isEmpty():
        kept = kept.dropDuplicates(["_id"])
    return kept.select(*common.unpacked("_row", names))
