"""Incremental ingest of text files and live job progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendframe import schemas
from spendframe.functions.numbers import percent
from spendframe.plans import pipeline
from spendframe.sources.files import as_documents


def checkpoint_folder(spark: SparkSession, name: str, given: str | None = None) -> str:
    """Folder for the state of a query, below the shared folder the session names."""
    if given is not None:
        return given
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a shared folder, or pass a checkpoint folder")
    return f"{shared.rstrip('/')}/{name}"


def arriving_texts(spark: SparkSession, path: str, pattern: str = "*.txt", files_per_batch: int = 10000) -> DataFrame:
    reader = spark.readStream.option("maxFilesPerTrigger", str(files_per_batch))
    return as_documents(reader.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True))


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str | None = None,
    names: list[str] | None = None,
    files_per_batch: int = 10000,
) -> StreamingQuery:
    """Extract the texts that have arrived since the last run and append them to a table.

    The pipeline holds no state, so the stream reads, extracts and writes without
    a shuffle. Each file is taken once, whatever is restarted; ``files_per_batch`` bounds a batch, not the run.
    """
    invoices = pipeline.extracted(arriving_texts(spark, source, files_per_batch=files_per_batch), names=names)
    return (
        invoices.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint_folder(spark, "ingest", checkpoint))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


BATCH = "batch_id"


def replace_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows of one batch into its own folder of a table, in place of what an earlier try wrote there.

    Only the folder of this batch is replaced, and by the committer's last step, so a try that fails in between leaves
    the table as it was.
    """
    marked = rows.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def split_results(invoices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Invoices that were read, and failures: texts that gave neither order number, total nor items."""
    failed = F.col("order_number").isNull() & F.col("total").isNull() & (F.size("items") == 0)
    failures = invoices.where(failed).select("doc_id", "filename", "modified_at", F.lit("no invoice data found").alias("error"), "text_length")
    return invoices.where(~failed), failures


def ingest_split(
    spark: SparkSession,
    source: str,
    invoices_path: str,
    failures_path: str,
    checkpoint: str | None = None,
    names: list[str] | None = None,
    files_per_batch: int = 10000,
) -> StreamingQuery:
    """Ingest to two tables, each file counted once in one of them, whatever is restarted.

    A batch goes to both tables under its id. After a failure between the two writes Spark gives out the same batch
    again, and both writes replace what that id has written before. Ids go on counting only while the checkpoint folder
    lives; tables and checkpoint belong together.
    """
    texts = arriving_texts(spark, source, files_per_batch=files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        read, failures = split_results(pipeline.extracted(batch, names=names))
        replace_batch(read, invoices_path, batch_id)
        replace_batch(failures, failures_path, batch_id)

    return (
        texts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_folder(spark, "ingest-split", checkpoint))
        .trigger(availableNow=True)
        .start()
    )


def arriving_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.PROGRESS_EVENT).json(path)


def unique_results(results: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Results with repeats of a file dropped; the watermark bounds what is remembered."""
    return results.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "filename"])


def counted(results: DataFrame) -> DataFrame:
    """Results per job. Works on a stream and on a batch."""
    counts = results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )
    return counts.withColumn("success_rate", percent(F.col("successful"), F.col("processed")))


def windowed(unique: DataFrame, period: str = "1 day") -> DataFrame:
    """Results per job and period of event time. Works on a stream and on a batch."""
    counts = unique.groupBy(F.window("ts", period).alias("period"), "job_id").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )
    rate = percent(F.col("successful"), F.col("processed"))
    return counts.select(F.col("period.start").alias("period_start"), "job_id", "processed", "successful", "failed", rate.alias("success_rate"))


def windowed_progress(results: DataFrame, delay: str = "1 hour", period: str = "1 day") -> DataFrame:
    """Progress per job and period over a result stream, final once the watermark has passed the period.

    In append mode each count comes out once, when no more results of its period are accepted, and its state goes.
    What is remembered are the jobs of the open periods and the file names of the last ``delay``. Later results of a
    period that is over are dropped by the watermark.
    """
    return windowed(unique_results(results, delay), period)


def progress(results: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Live progress per job over a result stream; the state is one row per job and the recent file names.

    Jobs are remembered for ever here; ``windowed_progress`` forgets them with their period.
    """
    return counted(unique_results(results, delay))
