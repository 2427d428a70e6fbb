"""Token totals by source, language and tokenizer version, kept up to date by signed changes."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "tokenizer"]
TOTALS = ["n_documents", "n_tokens", "n_bytes"]
BATCH_SCHEMA = "source string, lang string, tokenizer string, n_documents long, n_tokens long, n_bytes long"


@lru_cache(maxsize=4)
def tokenizer(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def counted(text: Column, ranks: bytes, pattern: str) -> Column:
    """Tokens of each text; a null text has none. The ranks are sent along, executors need no file."""

    @F.arrow_udf("long")
    def of_batch(texts: pa.Array) -> pa.Array:
        own = tokenizer(ranks, pattern)
        return pa.array([len(own.encode_ordinary(body)) for body in texts.to_pylist()], pa.int64())

    return of_batch(F.coalesce(text.cast("string"), F.lit("")))


def measured(docs: DataFrame, name: str, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Rows (doc_id, source, lang, tokenizer, tokens, bytes) of a table of documents."""
    return docs.select(
        "doc_id",
        "source",
        "lang",
        F.lit(name).alias("tokenizer"),
        counted(docs[text], ranks, pattern).alias("tokens"),
        F.octet_length(F.coalesce(docs[text].cast("string"), F.lit(""))).cast("long").alias("bytes"),
    )


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Measured rows as changes: +1 for what comes, -1 for what goes. A revision is both, of the old and the new row."""
    return rows.select(*GROUP, F.lit(sign).cast("long").alias("n_documents"), (sign * F.col("tokens")).alias("n_tokens"), (sign * F.col("bytes")).alias("n_bytes"))


class Rollup:
    """Totals as the sum of committed batches of changes, in a folder that all executors share.

    A batch is summed per group before it is written, and written as one folder named by its id. Committing an
    id again replaces that folder, so a batch that failed half way, or is sent twice, counts once; batches
    commute. Null sources, languages and counts are allowed: null is a group of its own, a null count is 0.
    Groups whose documents have all gone are left out of the totals.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commit(self, batch: str, changes: DataFrame) -> None:
        sums = changes.groupBy(*GROUP).agg(*[F.sum(F.coalesce(name, F.lit(0))).alias(name) for name in TOTALS])
        sums.write.mode("overwrite").parquet(f"{self.folder}/{batch}")

    def totals(self) -> DataFrame:
        try:
            batches = self.spark.read.schema(BATCH_SCHEMA).option("recursiveFileLookup", "true").parquet(self.folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            batches = self.spark.createDataFrame([], BATCH_SCHEMA)
        return batches.groupBy(*GROUP).agg(*[F.sum(name).alias(name) for name in TOTALS]).filter("n_documents <> 0")
