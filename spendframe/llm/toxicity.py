"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import common

BUCKET_BITS = 20
LABELLED_ROWS = 20_000
CACHED_TOKENS = 100_000
PENDING_TOKENS = 500_000
THRESHOLD = 0.3
SIGNIFICANT = 0.05
DRIFT = 0.5
PRIOR = 0.3
CONFIDENCE = 1.0
EULER = 0.5772156649
WORD = re.compile(r"\w+")
RESULTS = ("score", "predicted", "passages")
PASSAGES = "array<struct<start: int, end: int, score: double, expected: double>>"


class Buckets(dict):
    """Token to bucket of its hash; a cache of bounded size."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED_TOKENS:
            self.clear()
        value = self[token] = zlib.crc32(token.encode("utf-8", "replace")) & ((1 << BUCKET_BITS) - 1)
        return value


def token_buckets(text: str | None, cache: Buckets) -> np.ndarray:
    return np.array([cache[token] for token in WORD.findall(text.lower())] if text else [], dtype=np.int64)


class Counts:
    """Tokens of each bucket by kind of text, and the texts that hold them.

    Tokens wait in short lists and are then added where they occur, so that memory is bounded by the buckets and not
    by the length of a batch of texts.
    """

    def __init__(self):
        self.sums: dict[int, np.ndarray] = {}
        self.waiting: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        self.pending = 0

    def add(self, kind: int, found: np.ndarray) -> None:
        every, once = self.waiting.setdefault(kind, ([], []))
        every.append(found.astype(np.int32))
        once.append(np.unique(every[-1]))
        self.pending += len(found)
        if self.pending >= PENDING_TOKENS:
            self.settle()

    def settle(self) -> None:
        for kind, lists in self.waiting.items():
            counts = self.sums.setdefault(kind, np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64))
            for row, parts in zip(counts, lists, strict=True):
                at, n = np.unique(np.concatenate(parts), return_counts=True)
                row[at] += n
        self.waiting, self.pending = {}, 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for kind, (tokens, texts) in self.sums.items():
            at = np.flatnonzero(tokens)
            yield pa.RecordBatch.from_pydict(
                {"kind": pa.array(np.full(len(at), kind, dtype=np.int32)), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(tokens[at]), "m": pa.array(texts[at])}
            )


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one pass over the runs of positive scores."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    breaks = np.flatnonzero(np.diff(positive) > 1)
    first = positive[np.concatenate([[0], breaks + 1])]
    last = positive[np.concatenate([breaks, [len(positive) - 1]])] + 1
    held: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at end, nearest earlier one with a lower sum before
    for start, end in zip(first.tolist(), last.tolist(), strict=True):
        low, high = total[start], total[end]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                held.append((start, end, low, high, j))
                break
            start, low = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, float(high - low)) for a, b, low, high, _ in held]


@dataclass
class Scorer:
    """Token scores and their extreme-value parameters."""

    scores: np.ndarray
    decay: float
    scale: float = 1.0

    def passages(self, buckets: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Segments with the number of such segments expected by chance in a clean text of this length."""
        length = max(1, len(buckets))
        return [(a, b, s, self.scale * length * float(np.exp(-self.decay * s))) for a, b, s in segments(self.scores[buckets])]

    def evidence(self, found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """The best segment's log of one over its expectation, and the sum of it over all significant segments."""
        logs = [-np.log(max(expected, 1e-30)) for *_, expected in found]
        limit = -np.log(SIGNIFICANT)
        return max([0.0, *logs]), float(np.log1p(sum(x for x in logs if x >= limit)))


def fitted_scores(toxic: np.ndarray, other: np.ndarray, background: np.ndarray, chance: np.ndarray) -> Scorer:
    """Log-odds of each bucket under a Dirichlet prior in proportion to the whole corpus.

    Counts are of documents that hold a token, so that a text that repeats itself has one voice; ``chance``
    has the tokens of clean text. The prior weighs ``PRIOR`` of the toxic class. What counts is the lower bound of a log-odds at
    ``CONFIDENCE`` standard errors, so that rare tokens decide nothing; a constant drift below zero makes
    clean text lose score as it goes on. The decay solves sum p exp(decay * score) = 1 over clean text.
    """
    weight = PRIOR * float(toxic.sum() + 1)
    prior = weight * (background + 1e-3) / float((background + 1e-3).sum())
    a, b = toxic + prior, other + prior
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    error = np.sqrt(1 / a + 1 / b)
    sure = np.sign(odds) * np.maximum(0, np.abs(odds) - CONFIDENCE * error)
    scores = np.clip(sure, -2, 8) - DRIFT
    chance = (chance + 1e-3) / (chance + 1e-3).sum()
    low, high = 0.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if float((chance * np.exp(middle * scores)).sum()) > 1 else (middle, high)
    return Scorer(scores.astype(np.float32), max(low, 0.05))


@dataclass
class Model:
    scorer: Scorer
    weights: np.ndarray  # of one, best evidence, summed evidence

    def score(self, found: list[tuple[int, int, float, float]]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights @ np.array([1.0, *self.scorer.evidence(found)]), -30, 30))))


# Without any labelled row no text is toxic.
UNTAUGHT = np.array([-30.0, 0.0, 0.0])


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    weights = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        pull = features.T @ (labels - p) - ridge * weights
        curve = (features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(features.shape[1])
        weights = weights + np.linalg.solve(curve, pull)
    return weights


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", labelled_rows: int = LABELLED_ROWS) -> Model:
    """Learn from at most ``labelled_rows`` rows of ``labels`` (taken by the hash of their key) and all texts.

    One pass over all rows of ``docs`` counts tokens in a fixed number of hash buckets, of the corpus and of
    each class and half of the labelled rows; counts are summed in tasks first, and what reaches the driver
    is bounded by the buckets. Each half is then scored by what the other half gives, which sets the scale of
    the extreme-value law and the logistic calibration. Null labels are not used; of several labels of one key
    the largest counts; rows without a label count for the prior only. With no labels, every score is that
    of a coin weighted by the ridge, 0.5 or less.
    """
    sample = (
        labels.select(labels[key].alias("_key"), labels[label].cast("int").alias("_label"))
        .filter("_key IS NOT NULL AND _label IS NOT NULL")
        .groupBy("_key")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(labelled_rows)
        .withColumn("_half", F.pmod(F.xxhash64(F.lit("half"), "_key"), F.lit(2)).cast("int"))
    )
    # At most labelled_rows rows of a key and two small numbers.
    marked = docs.select(docs[text].cast("string").alias("_text"), docs[key].alias("_key")).join(F.broadcast(sample), "_key", "left").select("_text", "_label", "_half")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sums = Buckets(), Counts()
        for batch in batches:
            for body, mark, half in zip(*batch.columns, strict=True):
                found = token_buckets(body.as_py(), cache)
                sums.add(0, found)
                if mark.is_valid:
                    sums.add(1 + 2 * half.as_py() + (1 if mark.as_py() else 0), found)
        yield from sums.rows()

    rows = marked.mapInArrow(count, "kind int, bucket int, n long, m long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
    tokens, counts = np.zeros((5, 1 << BUCKET_BITS)), np.zeros((5, 1 << BUCKET_BITS))
    at = rows["kind"].to_numpy(), rows["bucket"].to_numpy()
    tokens[at], counts[at] = rows["n"].to_numpy(), rows["m"].to_numpy()
    halves = [fitted_scores(counts[2 + 2 * h], counts[1 + 2 * h], counts[0], tokens[1 + 2 * h]) for h in (0, 1)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Buckets()
        for batch in batches:
            out = []
            for body, mark, half in ([value.as_py() for value in row] for row in zip(*batch.columns, strict=True)):
                found = token_buckets(body, cache)
                scorer = halves[1 - half]
                best = max([0.0, *(s for *_, s in segments(scorer.scores[found]))])
                every = [(s, max(1, len(found))) for *_, s in segments(scorer.scores[found])]
                out.append((mark, half, best, max(1, len(found)), [s for s, _ in every]))
            yield pa.RecordBatch.from_pydict(
                {name: pa.array([row[i] for row in out], kind) for i, (name, kind) in enumerate((("label", pa.int32()), ("half", pa.int32()), ("best", pa.float64()), ("length", pa.int64()), ("sums", pa.list_(pa.float64()))))}
            )

    # One row for each labelled row, labelled_rows at most.
    seen = marked.filter("_label IS NOT NULL").mapInArrow(weigh, "label int, half int, best double, length long, sums array<double>").toArrow().to_pylist()
    for half, scorer in enumerate(halves):
        law = [scorer.decay * row["best"] - np.log(row["length"]) for row in seen if row["half"] == 1 - half and not row["label"] and row["best"] > 0]
        scorer.scale = float(np.exp(np.clip(np.mean(law) - EULER if law else 0.0, -20, 5)))
    scorer = fitted_scores(counts[2] + counts[4], counts[1] + counts[3], counts[0], tokens[1] + tokens[3])
    scorer.scale = float(np.sqrt(halves[0].scale * halves[1].scale))
    features = [
        [1.0, *halves[1 - row["half"]].evidence([(0, 0, s, halves[1 - row["half"]].scale * row["length"] * float(np.exp(-halves[1 - row["half"]].decay * s))) for s in row["sums"]])] for row in seen
    ]
    weights = logistic(np.array(features), np.array([float(bool(row["label"])) for row in seen])) if seen else UNTAUGHT
    return Model(scorer, weights)


def scored(text: Column, model: Model) -> Column:
    """A struct of the score and the significant passages, as offsets in code points."""

    @F.arrow_udf(f"struct<score: double, passages: {PASSAGES}>")
    def of_batch(texts: pa.Array) -> pa.Array:
        cache, scores, passages = Buckets(), [], []
        for body in (text.as_py() for text in texts):
            found = model.scorer.passages(token_buckets(body, cache))
            scores.append(model.score(found))
            kept = [row for row in found if row[3] <= SIGNIFICANT]
            if kept:
                lowered = [m.span() for m in WORD.finditer(body.lower())]
                kept = [{"start": lowered[a][0], "end": lowered[b - 1][1], "score": s, "expected": e} for a, b, s, e in kept]
            passages.append(kept)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(passages, kind)], ["score", "passages"])

    return of_batch(F.coalesce(text.cast("string"), F.lit("")))


def judged(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row with score, predicted (1 from ``threshold`` on) and its toxic passages.

    Only the text decides. Null texts are empty; an empty text gets the score of no evidence. Rows with equal
    texts get equal scores. An empty table gives an empty table. Input columns of the three names are replaced.
    """
    names = list(docs.columns)
    rows = docs.select(common.packed(docs).alias("_row"), scored(docs[text], model).alias("_found"))
    return rows.select(
        *common.unpacked("_row", names, set(RESULTS)),
        F.col("_found.score").alias("score"),
        (F.col("_found.score") >= threshold).cast("int").alias("predicted"),
        F.col("_found.passages").alias("passages"),
    )


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns as they are."""
    names = list(docs.columns)
    rows = docs.select(common.packed(docs).alias("_row"), scored(docs[text], model).alias("_found"))
    return rows.filter(F.col("_found.score") < threshold).select(*common.unpacked("_row", names))


def held_out(key: Column) -> Column:
    """Rows that no fit may see."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2
