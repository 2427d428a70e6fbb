"""Secrets in whole texts: a trigram index names the candidates of each rule, and the rule is run on them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import common, trigrams

# Texts to a block of the index: the length of a posting list at most, on average.
BLOCK_TEXTS = 2048
SPAN = "array<struct<start: int, kind: int, end: int>>"
RESULTS = ("spans",)


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those with a shorter ``group`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# Kinds, patterns and least lengths.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Kinds beyond the base, all with a bounded part before they can fail, so that no text takes more than linear time.
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("login", r"://[A-Za-z0-9._%+-]{1,64}:[^\x00-\x20\x22\x27/:@]{1,64}@"),
)
RULES = BASE + FURTHER


def matches(text: Column, asked: Column, rules: Sequence[Rule]) -> Column:
    """Spans of the rules whose bit is set in ``asked``, in code points."""

    @F.arrow_udf(SPAN)
    def of_batch(texts: pa.Array, masks: pa.Array) -> pa.Array:
        compiled = [(1 << at, at, rule, rule.compiled()) for at, rule in enumerate(rules)]
        rows = []
        for body, mask in zip(texts, masks.to_pylist(), strict=True):
            body = body.as_py()
            rows.append(
                [
                    {"start": found.start(), "kind": at, "end": found.end()}
                    for bit, at, rule, pattern in compiled
                    if mask & bit
                    for found in pattern.finditer(body)
                    if found.end(rule.group) - found.start(rule.group) >= rule.least
                ]
            )
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])))

    return of_batch(text, asked)


def posted(rows: DataFrame, grams: Sequence[str], block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """The inverted index of rows (_id, _body) over the asked trigrams: _block, _gram, _ids (in order, each once).

    Ids are dealt to blocks by their hash, so that a posting list stays short however many texts there are.
    """
    blocks = max(1, -(-rows.count() // block_texts))
    # The text is put in lower case once and bound to a variable, not once for each trigram.
    asked = F.array(*map(F.lit, grams))
    present = F.transform(F.array(F.lower("_body")), lambda low: F.filter(asked, lambda gram: F.contains(low, gram)))[0]
    held = rows.select(F.pmod(F.xxhash64(F.lit("block"), "_id"), F.lit(blocks)).cast("int").alias("_block"), "_id", F.explode(present).alias("_gram"))
    return held.groupBy("_block", "_gram").agg(F.sort_array(F.collect_set("_id")).alias("_ids"))


def candidates(index: DataFrame, queries: dict[int, list[list[str]]]) -> DataFrame:
    """Ids whose trigrams satisfy a query, with the bits of those queries: _id, _mask.

    ``queries`` has the clauses of each rule. Posting lists are intersected for a clause and united over the clauses.
    """
    asked = [(rule, at, gram, len(grams)) for rule, sets in queries.items() for at, grams in enumerate(sets) for gram in grams]
    table = index.sparkSession.createDataFrame(asked, "_rule int, _clause int, _gram string, _size int")
    lists = index.join(table, "_gram").groupBy("_block", "_rule", "_clause", "_size").agg(F.collect_list("_ids").alias("_lists"))
    whole = lists.filter(F.size("_lists") == F.col("_size"))
    common_ids = F.aggregate(F.slice("_lists", 2, F.size("_lists")), F.col("_lists")[0], F.array_intersect)
    met = whole.select("_rule", F.explode(common_ids).alias("_id"))
    return met.groupBy("_id").agg(F.bit_or(F.expr("shiftleft(1L, _rule)")).alias("_mask"))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id", block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """Every row with ``spans``: kind, start and end of each secret, in code points, end exclusive, by start and rule.

    Each rule's pattern gives a Boolean query over trigrams. The index holds, per block of texts, the ids that
    have a trigram; posting lists are intersected and united as the query says, and only candidates are read with
    the rule. Rules that need no trigram are run on every text. Trigrams are compared in lower case, which adds
    candidates and loses none. Patterns are ASCII: in either case only A to Z and a to z are alike.

    Null and empty texts have no spans (an empty list). Rows alike in key and text share their candidates and each
    keeps its row. Null keys are allowed. An empty table gives an empty table. What moves between tasks are
    trigrams, ids and spans; texts are joined to the candidates' ids, and sent to them only where those are too
    many for the planner to broadcast. Returns the columns of ``docs`` and spans; an input column of that name is replaced.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules in one scan")
    names = list(docs.columns)
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    key_id = F.xxhash64(docs[key], body)
    rows = docs.select(key_id.alias("_id"), body.alias("_body"))
    queries = {at: trigrams.clauses(rule.pattern) for at, rule in enumerate(rules)}
    scanned = F.lit(sum(1 << at for at, sets in queries.items() if not sets)).cast("long")
    every = docs.select(common.packed(docs).alias("_row"), key_id.alias("_id"), matches(body, scanned, rules).alias("_all"))
    indexed = {at: sets for at, sets in queries.items() if sets}
    if indexed:
        grams = sorted({gram for sets in indexed.values() for grams in sets for gram in grams})
        asked = common.stored(candidates(common.stored(posted(rows, grams, block_texts)), indexed))
        verified = rows.join(asked, "_id").select("_id", matches(F.col("_body"), F.col("_mask"), rules).alias("_spans"))
        verified = verified.filter(F.size("_spans") > 0).groupBy("_id").agg(F.any_value("_spans").alias("_spans"))
        every = every.join(verified, "_id", "left").withColumn("_all", F.concat("_all", F.coalesce("_spans", F.array().cast(SPAN))))
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    spans = F.transform(F.array_sort("_all"), lambda span: F.struct(kinds[span["kind"]].alias("kind"), span["start"].alias("start"), span["end"].alias("end")))
    return every.select(*common.unpacked("_row", names, set(RESULTS)), spans.alias("spans"))


def listed(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """kind:start:end of each span, joined by commas."""
    kept = spans if kinds is None else F.filter(spans, lambda span: span["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda span: F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda span: span["kind"] == kind)).cast("long")
