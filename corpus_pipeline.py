"""A corpus made ready for training, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.llm import common, decontam, exact, pieces, simhash, toxicity

MODEL = "piece_bpe_32k.model"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# By application: the intermediate tables of the stage that ran last.
LAST: dict[str, common.Tables] = {}


def stage(build: Stage) -> Stage:
    """A stage that removes what the stage before has stored on its way.

    A stage begins when the result of the one before is written, and reads that result alone, so the tables that led
    to it are not read again. In one session one pipeline runs at a time.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        LAST.pop(app, common.Tables()).remove(spark)
        with common.Tables() as tables:
            kept = build(spark, docs, sf_dir)
        LAST[app] = tables
        return kept

    run_stage.__doc__ = build.__doc__
    return run_stage


@stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from all documents and from labels not held out."""
    labels = common.table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.distinct(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents whose five-word runs have a similarity of 0.8 or more, found by their fingerprints."""
    return simhash.distinct_verified(docs)


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The subword ids of each document, and where each piece begins in the text's bytes and ends, in place of the text."""
    return pieces.encode(docs, pieces.read_model(public_tokenizers.path(MODEL))).drop("text")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

# A trained model decides in the first stage and a subword model in the last, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one written and read again before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for position, (_, build) in enumerate(STAGES):
        docs = build(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
