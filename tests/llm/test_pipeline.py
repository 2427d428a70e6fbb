"""The pipeline as a whole against brute force, on odd rows and on none."""

import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T

import corpus_pipeline
from spendframe.llm import common

WHITE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\W_]+")
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("ids", T.StringType()),
        T.StructField("_row", T.StringType()),
    ]
)
LABELS = "doc_id long, quality int, toxic int"


def words(count, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(count)]


def rows_and_items():
    rows = [(1, "Alpha beta gamma"), (2, "alpha beta gamma"), (3, "Alpha  beta\ngamma"), (3, "Alpha beta gamma"), (4, None), (5, ""), (6, " \n"), (None, "Alpha beta gamma"), (None, None)]
    for i in range(12):
        base = words(200, i)
        near, far = list(base), list(base)
        near[100] = "changed"
        for at in range(0, 200, 5):
            far[at] = f"x{at}"
        rows += [(100 + 10 * i, " ".join(base)), (101 + 10 * i, " ".join(near)), (102 + 10 * i, " ".join(far)), (103 + 10 * i, " " + " ".join(base))]
    item = " ".join(words(30, 99))
    rows += [(500, " ".join(words(50, 50)) + " " + item.upper() + "! " + " ".join(words(50, 51))), (501, " ".join(words(20_000, 52)))]
    return rows, [(1, item), (2, None), (3, "")]


def written(spark, folder, rows, items, labels=()):
    spark.createDataFrame([(k, t, "s", "i", "r") for k, t in rows], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def runs(text):
    found = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", found)
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def alike(a, b):
    return (not a and not b) or len(a & b) >= 0.8 * len(a | b)


def brute(rows, items):
    last = lambda k: (k is None, k or 0)
    groups = {}
    for k, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((k, t))
    kept = [min(group, key=lambda r: (-len(r[1] or ""), last(r[0]))) for group in groups.values()]
    root, sets = list(range(len(kept))), [runs(t) for _, t in kept]

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(kept)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    classes = {}
    for i, row in enumerate(kept):
        classes.setdefault(find(i), []).append(row)
    kept = [min(group, key=lambda r: last(r[0])) for group in classes.values()]
    wanted = [WORD.findall((t or "").lower()) for _, t in items]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in wanted if len(w) >= 5]

    def leaks(text):
        w = WORD.findall((text or "").lower())
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return any(len(own & g) * 5 >= len(g) * 4 for g in grams)

    return [row for row in kept if not leaks(row[1])]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = rows_and_items()
    folder = written(spark, tmp_path, rows, items)
    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(corpus_pipeline.MODEL)))
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "score", "_row", "ids", "starts", "ends"]
    got = sorted(((r.doc_id, r.ids) for r in found.collect()), key=str)
    assert got == sorted(((k, [*model.encode(t or ""), model.eos_id()]) for k, t in brute(rows, items)), key=str)


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [])).count() == 0


def test_stages_remove_what_the_stage_before_has_stored(spark, tmp_path):
    rows, items = rows_and_items()
    folder = written(spark, tmp_path, rows, items)
    docs, seen = common.table(spark, folder, "documents"), []
    for name, build in corpus_pipeline.STAGES:
        docs = common.stored(build(spark, docs, folder))
        paths = list(corpus_pipeline.LAST[spark.sparkContext.applicationId].paths)
        assert not set(paths) & set(seen)
        seen += paths
    # All but the last stage's tables are gone; the results of the stages are not theirs.
    for path in set(seen) - set(paths):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            spark.read.parquet(path)
    assert docs.count() > 0
