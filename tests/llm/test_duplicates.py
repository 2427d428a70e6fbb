"""Exact, near and line duplicates and shards against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendframe.llm import components, exact, lines, queries, shards, simhash

SMALL = "/root/testdata/sf0.001"
WHITE = re.compile(r"[\x20\x09-\x0D]+")
RESULT_NAMES = {"keep_id", "group_size", "kept"}


def smallest_roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_exact_groups(docs_of, odd_rows):
    shared = "same start " * 40
    rows = odd_rows + [(100 + i, shared + str(i % 3)) for i in range(9)] + [(200, "x" * 32), (201, "x" * 33), (202, "x " * 32)]
    found = exact.mark(docs_of(rows)).collect()
    assert len(found) == len(rows)
    groups = defaultdict(list)
    for key, text in rows:
        groups[WHITE.sub("", text or "")].append((-len(text or ""), key is None, key))
    for row in found:
        members = groups[WHITE.sub("", row.text or "")]
        assert row.group_size == len(members)
        assert row.keep_id == min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
    kept = Counter(WHITE.sub("", row.text or "") for row in found if row.kept)
    assert set(kept) == set(groups) and set(kept.values()) == {1}


def test_exact_distinct_keeps_columns(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = exact.distinct(docs)
    assert kept.dtypes == docs.dtypes
    assert kept.count() == len({WHITE.sub("", text or "") for _, text in odd_rows})
    assert {row.kept for row in kept.collect()} == {"k"}


def test_empty_tables(docs_of):
    empty = docs_of([])
    assert exact.mark(empty).count() == 0 and exact.distinct(empty).count() == 0
    assert simhash.groups(empty).count() == 0 and simhash.distinct(empty).count() == simhash.distinct_verified(empty).count() == 0
    assert lines.drop_common(empty).count() == 0
    assert shards.assign(empty).count() == 0


def brute_print(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(run.encode(), seed=42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs_of, odd_rows):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(400)]
    rows = list(odd_rows)
    for i in range(40):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(400)] = rng.choice(words)
        rows.append((1000 + i, " ".join(copy)))
    found = simhash.groups(docs_of(rows), width=4).collect()
    prints = [brute_print(text, 4) for _, text in rows]
    by_text = {text: f"{p:016x}" for (_, text), p in zip(rows, prints, strict=True)}
    assert all(row.fingerprint == by_text[row.text] for row in found) and len(found) == len(rows)
    links = [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 4]
    roots = smallest_roots(set(prints), links)
    least = {}
    for (key, _), p in zip(rows, prints, strict=True):
        if key is not None:
            least[roots[p]] = min(key, least.get(roots[p], key))
    assert all(row.component_id == least[roots[int(row.fingerprint, 16)]] for row in found)


def test_simhash_distinct_keeps_one_row_of_each_class(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = simhash.distinct(docs, width=5)
    classes = {row.component_id for row in simhash.groups(docs, width=5).collect()}
    assert kept.dtypes == docs.dtypes and kept.count() == len(classes)


def run_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_simhash_distinct_verified(docs_of, odd_rows):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(2000)]
    rows = list(odd_rows)
    for i in range(25):
        base = [rng.choice(words) for _ in range(300)]
        rows.append((1000 + 10 * i, " ".join(base)))
        for k, changes in enumerate((1, 2, 3, 12, 12, 90), start=1):
            copy = list(base)
            for at in rng.sample(range(300), changes):
                copy[at] = "x" + rng.choice(words)
            rows.append((1000 + 10 * i + k, " ".join(copy)))
    docs = docs_of(rows)
    kept = simhash.distinct_verified(docs)
    assert kept.dtypes == docs.dtypes
    texts = {(row.doc_id, row.text) for row in kept.collect()}
    assert kept.count() == len(texts)
    sets = {row: run_set(row[1]) for row in set(rows)}
    # No row goes without a row of an earlier key that it is alike to; rows with very close texts do go.
    for row in set(rows) - texts:
        assert any(alike(sets[row], other) for at, other in sets.items() if at != row and at[0] is not None)
    assert all((1000 + 10 * i, k) not in {(d - d % 10, d % 10) for d, _ in texts if d and d >= 1000} for i in range(25) for k in (1, 2))
    assert all(any(d == 1000 + 10 * i + k for d, _ in texts) for i in range(25) for k in (0, 6))
    # No row is held against a row that went already, so only rows that stay differ from each other.
    odd = [row for row in texts if row[0] is None or row[0] < 1000]
    assert len(odd) == 4 and not any(alike(sets[a], sets[b]) for a in odd for b in odd if a != b)


def search_prints(text, prints):
    hashes = np.array(simhash.run_hashes(text.encode(), simhash.SEARCH_WIDTH), dtype="<u8")
    return [simhash.majority([hashes], len(hashes), k) for k in range(prints)]


def close(a, b, prints=simhash.SEARCH_PRINTS):
    """Whether any of the search's fingerprints of two texts are within its budget."""
    return any((x ^ y).bit_count() <= simhash.SEARCH_BITS for x, y in zip(search_prints(a, prints), search_prints(b, prints), strict=True))


def test_simhash_distinct_verified_keeps_one_row_of_a_chain(docs_of):
    rng = random.Random(5)
    rows, chains = [], 30
    for i in range(chains):
        text = [f"c{i}w{rng.randrange(10**6)}" for _ in range(300)]
        for step in range(3):  # the first and the last differ by more than the limit
            rows.append((10 * i + step, " ".join(text)))
            for at in range(40 * step, 40 * step + 36, 6):
                text[at] = f"x{rng.randrange(10**6)}"
    sets = {k: run_set(text) for k, text in rows}
    assert all(alike(sets[10 * i], sets[10 * i + 1]) and alike(sets[10 * i + 1], sets[10 * i + 2]) for i in range(chains))
    assert not any(alike(sets[10 * i], sets[10 * i + 2]) for i in range(chains))
    near = {i for i in range(chains) if all(close(rows[3 * i + step][1], rows[3 * i + step + 1][1]) for step in range(2))}
    kept = {row.doc_id for row in simhash.distinct_verified(docs_of(rows)).collect()}
    assert len(near) >= 0.9 * chains and all(kept & {10 * i, 10 * i + 1, 10 * i + 2} == {10 * i} for i in near)


def test_simhash_distinct_verified_finds_copies_that_one_fingerprint_misses(docs_of):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        changed = list(text)
        for at in (20, 70):
            changed[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(changed))]
    sets = {k: run_set(text) for k, text in rows}
    assert all(alike(sets[2 * i], sets[2 * i + 1]) for i in range(300))
    near = {i for i in range(300) if close(rows[2 * i][1], rows[2 * i + 1][1])}
    assert len(near) >= 0.98 * 300 and sum(close(rows[2 * i][1], rows[2 * i + 1][1], 1) for i in near) < 0.8 * 300
    kept = {row.doc_id for row in simhash.distinct_verified(docs_of(rows)).collect()}
    assert all(2 * i + 1 not in kept for i in near) and all(2 * i in kept for i in range(300))


def test_a_suspected_row_is_in_one_class(spark):
    rng = random.Random(4)
    prints = [[rng.getrandbits(62) for _ in range(8)] for _ in range(40)]
    for i in range(0, 40, 2):  # the next row is close by half of the kinds, the one after that by the other half
        prints[i + 1][:4] = [p ^ 3 for p in prints[i][:4]]
        if i + 2 < 20:
            prints[i + 2][4:] = [p ^ 5 for p in prints[i + 1][4:]]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "_id long, _prints array<long>")
    found = [(r["_id"], r["_class"]) for r in simhash.suspected(rows, simhash.SEARCH_BITS).collect()]
    assert sorted(i for i, _ in found) == list(range(40))
    classes = defaultdict(set)
    for i, own in found:
        classes[own].add(i)
    assert sorted(map(sorted, classes.values())) == [list(range(20))] + [[i, i + 1] for i in range(20, 40, 2)]


def test_cells_keep_alike_pairs_together_and_others_apart(spark):
    rng = random.Random(6)
    shared, sets = list(range(1, 101)), []
    for i in range(120):  # half of each set is shared by the whole class
        own = shared + [1000 * (i + 1) + k for k in range(100)]
        sets += [own, own[:] if i % 3 else [v if rng.random() < 0.95 else v + 10**6 for v in own]]
    sets += [[], []]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(sets)], "_id long, _runs array<long>")
    members = frame.select(F.lit(7).cast("long").alias("_cell"), "_id", F.size("_runs").alias("_size"), F.array(F.lit(0).cast("long")).alias("_marks"), F.col("_id").alias("_group"))
    homes = defaultdict(set)
    for row in simhash.cells(members, frame, simhash.SHARE).collect():
        homes[row["_cell"]].add(row["_id"])
    met = {(a, b) for home in homes.values() for a in home for b in home if a < b}
    wanted = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if alike(set(sets[a]), set(sets[b]))}
    assert wanted and wanted <= met and len(met) < 2 * len(wanted)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 3000), st.integers(0, 300), st.integers(0, 300))
def test_sets_differ_in_as_many_marks_at_most(seed, both, left, right):
    values = np.unique(np.random.default_rng(seed).integers(0, 2**63, both + left + right, dtype=np.uint64))
    a, b = values[: both + left], np.concatenate([values[:both], values[both + left :]])
    marks = np.bitwise_count((simhash.marks_of(a) ^ simhash.marks_of(b)).view(np.uint64)).sum()
    assert len(simhash.marks_of(a)) == simhash.MARKS and marks <= len(np.setxor1d(a, b))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 300), st.integers(1, 12))
def test_trie_finds_all_close_pairs(seed, size, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    values = base[rng.integers(0, 4, size)]
    for _ in range(flips):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64))
    values = np.unique(values)
    turned = np.sort((values << np.uint64(32)) | (values >> np.uint64(32)))
    links = list(zip(*simhash.linked(values, 0, 4, 2), strict=True))
    a, b = simhash.linked(turned, 0, 4, 2)
    back = lambda x: (x << np.uint64(32)) | (x >> np.uint64(32))
    links += list(zip(back(a), back(b), strict=True))
    wanted = [(x, y) for x in values for y in values if x < y and int(x ^ y).bit_count() <= 4]
    assert smallest_roots(values, links) == smallest_roots(values, wanted)


def test_trie_join_splits_large_nodes(spark):
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(-(2**63), 2**63, 60, dtype=np.int64))
    near = values[:20] ^ (np.int64(1) << rng.integers(0, 60, 20)) ^ (np.int64(1) << rng.integers(0, 30, 20))
    crowd = values[0] ^ rng.integers(0, 64, 40)
    every = np.unique(np.concatenate([values, near, crowd]))
    frame = spark.createDataFrame([(int(v),) for v in every], "_print long").withColumn("_key", F.col("_print"))
    found = {r["_print"]: r["_least"] for r in simhash.classes(frame, 4, node_rows=8).collect()}
    links = [(int(a), int(b)) for a in every for b in every if a < b and (int(a) ^ int(b)) & (2**64 - 1) and ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() <= 4]
    assert found == smallest_roots([int(v) for v in every], links)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == smallest_roots(set(range(61)) | set(range(100, 130)), links)


def test_common_lines(docs_of, odd_rows):
    rows = odd_rows + [(100 + i, f"Own {i}\n  SHARED line \x0b\n\nshared LINE") for i in range(12)]
    rows += [(200 + i, "nearly common\n" + str(i)) for i in range(9)]
    found = lines.drop_common(docs_of(rows), min_documents=10).collect()
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, text in rows for k in {key(line) for line in (text or "").split("\n")} if k)
    wanted = Counter()
    for doc, text in rows:
        own = (text or "").split("\n")
        left = [line for line in own if seen[key(line)] < 10]
        wanted[doc, len(own), len(own) - len(left), "\n".join(left)] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found) == wanted


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 12))
def test_cuts_are_minimax(sizes, count):
    ends = shards.cuts(sizes, count)
    loads = [sum(sizes[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    best = [0] + [10**9] * len(sizes)
    for _ in range(count):
        best = [0] + [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(1, len(sizes) + 1)]
    assert len(ends) == count and ends[-1] == len(sizes) and sorted(ends) == ends
    assert max(loads) == best[-1]


def test_shards(docs_of, odd_rows):
    rows = odd_rows + [(1000 + i, f"text {i} " * (1 + i % 7)) for i in range(800)] + [(5000 + i, "hot copy") for i in range(700)]
    found = shards.assign(docs_of(rows), shards=5).collect()
    assert len(found) == len(rows)
    slots, homes = defaultdict(list), defaultdict(set)
    for row in found:
        slots[row.shard].append(row.slot)
        homes[row.text or ""].add(row.shard)
        assert row["size"] == len((row.text or "").encode()) + 16
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert all(len(own) == 1 for own in homes.values())


@pytest.mark.parametrize("name", ["op1_simhash", "op7_sharding"])
def test_queries_give_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = queries.QUERIES[name](spark, SMALL)
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in docs.collect()} and found.count() == docs.count()


def test_shard_query_is_even(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    found = queries.op7_sharding(spark, SMALL).toPandas()
    loads = found.groupby("shard")["size"].sum()
    largest = docs.assign(bytes=[len(t.encode()) + 16 for t in docs["text"]]).groupby("text")["bytes"].sum().max()
    assert set(found["shard"]) <= set(range(40)) and loads.max() <= found["size"].sum() / 40 + largest


def test_digest_of_exact_query(spark):
    row = next(r for r in queries.op10_exact_dedup(spark, SMALL).collect() if r.doc_id == 0)
    text = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id = 0").first().text
    assert row.text_sha256 == hashlib.sha256(WHITE.sub("", text).encode()).hexdigest()
