"""Job and batch operators: totals, progress, estimates, admission and listings.

Per-job figures are built in two aggregation levels where a second key is
involved (job and currency, then job), so one hot job never lands whole in a
single task. Anything that depends on the present takes an ``as_of`` argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.numbers import percent, units

AMOUNTS = ["total", "subtotal", "shipping", "tax", "discount"]

# Upload limits and their messages.
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_BATCH_BYTES = 500 * 1024 * 1024
MAX_BATCH_FILES = 50
ALLOWED_MIME = "application/pdf"
ALLOWED_EXTENSION = "pdf"
DEFAULT_FILE_MS = 30000
ETA_BUFFER = 1.2
DEFAULT_ERROR = "Processing failed"


def _amount_sums(condition: Column | None = None) -> list[Column]:
    sums = []
    for name in AMOUNTS:
        value = F.col(f"{name}_cents")
        picked = value if condition is None else F.when(condition, value)
        sums.append(F.coalesce(F.sum(picked), F.lit(0)).alias(f"{name}_cents"))
    return sums


def job_amounts(results: DataFrame) -> DataFrame:
    """Counts, summed amounts and main currency per job.

    ``results`` are per-invoice rows with ``job_id``, ``success``, ``currency``
    and the amounts in cents. Failed rows count but add no amount. The main
    currency is the most frequent one; equal counts are decided by name.
    """
    success = F.col("success")
    per_currency = results.groupBy("job_id", F.when(success, F.col("currency")).alias("currency")).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(success).alias("successful"),
        F.count_if(~success).alias("failed"),
        *_amount_sums(success),
    )
    ranked = F.when(
        F.col("currency").isNotNull(), F.struct((-F.col("successful")).alias("rank"), F.col("currency").alias("name"))
    )
    return (
        per_currency.groupBy("job_id")
        .agg(
            F.sum("files").alias("file_count"),
            F.sum("successful").alias("successful_invoices"),
            F.sum("failed").alias("failed_invoices"),
            *_amount_sums(),
            F.min(ranked).alias("main"),
        )
        .withColumn("currency", F.col("main.name"))
        .drop("main")
    )


def _millis(moment: Column) -> Column:
    return F.unix_millis(moment.cast("timestamp"))


def success_rate(places: int = 1) -> Column:
    return percent(F.col("successful_invoices"), F.col("successful_invoices") + F.col("failed_invoices"), places)


def amounts_in_units() -> list[Column]:
    return [units(f"{name}_cents").alias(name) for name in AMOUNTS]


def job_totals(jobs: DataFrame, results: DataFrame) -> DataFrame:
    return (
        jobs.select("job_id", "created", "completed")
        .join(job_amounts(results), "job_id")
        .select(
            "job_id",
            "created",
            "completed",
            F.col("successful_invoices").alias("invoice_count"),
            "successful_invoices",
            "failed_invoices",
            success_rate().alias("success_rate"),
            *amounts_in_units(),
            "currency",
        )
    )


def job_currency(results: DataFrame) -> DataFrame:
    return job_amounts(results).select("job_id", "currency")


def batch_grand_total(results: DataFrame) -> DataFrame:
    """One row over all jobs. Amounts of different currencies are added as they stand."""
    per_job = job_amounts(results)
    return per_job.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.sum("successful_invoices").alias("total_invoices"),
        F.sum("successful_invoices").alias("successful_invoices"),
        F.sum("failed_invoices").alias("failed_invoices"),
        *_amount_sums(),
    ).select("total_jobs", "total_invoices", "successful_invoices", "failed_invoices", *amounts_in_units())


def batch_by_currency(results: DataFrame) -> DataFrame:
    """Totals of the jobs with the same main currency; a mixed job goes wholly to its main one."""
    return (
        job_amounts(results)
        .where(F.col("currency").isNotNull())
        .groupBy("currency")
        .agg(F.sum("successful_invoices").alias("invoice_count"), *_amount_sums())
        .select("currency", "invoice_count", *amounts_in_units())
    )


def batch_totals_rows(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """One row per job and a closing row over all of them."""
    per_job = job_totals(jobs, results).select(
        "job_id",
        F.date_format("created", "yyyy-MM-dd").alias("created"),
        F.date_format("completed", "yyyy-MM-dd").alias("completed"),
        "invoice_count",
        "successful_invoices",
        "failed_invoices",
        *AMOUNTS,
        "currency",
        "success_rate",
    )
    closing = batch_grand_total(results).select(
        F.lit("BATCH_TOTAL").alias("job_id"),
        F.lit("").alias("created"),
        F.lit("").alias("completed"),
        F.col("total_invoices").alias("invoice_count"),
        "successful_invoices",
        "failed_invoices",
        *AMOUNTS,
        F.lit("MULTI").alias("currency"),
        success_rate().alias("success_rate"),
    )
    return per_job.unionByName(closing)


def failed_results(results: DataFrame) -> DataFrame:
    return results.where(~F.col("success")).select(
        "filename", F.coalesce("error", F.lit(DEFAULT_ERROR)).alias("error"), "processed_at"
    )


def upload_admission(files: DataFrame) -> DataFrame:
    """First reason to turn a file away, null when it is admitted.

    Batch figures come from one aggregate per batch joined back, not from a
    window, so a batch of any size stays spread over its tasks.
    """
    batches = files.groupBy("batch").agg(F.sum("size").alias("batch_bytes"), F.count(F.lit(1)).alias("batch_files"))
    extension = F.lower(F.element_at(F.split("filename", r"\."), -1))
    reason = (
        F.when(F.col("batch_bytes") > MAX_BATCH_BYTES, "Total batch size exceeds maximum limit of 500MB")
        .when(F.col("batch_files") > MAX_BATCH_FILES, "Maximum 50 files allowed per batch")
        .when(F.col("size") > MAX_FILE_BYTES, "File size exceeds maximum limit of 50MB")
        .when(F.col("mime_type") != ALLOWED_MIME, "Only PDF files are allowed")
        .when(extension != ALLOWED_EXTENSION, "File must have a .pdf extension")
    )
    return files.join(batches, "batch").select(
        "batch", "filename", "size", reason.isNull().alias("admitted"), reason.alias("reason")
    )


def job_progress(files: DataFrame, results: DataFrame) -> DataFrame:
    """Files, outcomes, percentage done and success rate per job."""
    total = files.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    done = results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        total.join(done, "job_id", "left")
        .na.fill(0, ["processed", "successful", "failed"])
        .select(
            "job_id",
            "total",
            F.coalesce("processed", zero).alias("processed"),
            F.coalesce("successful", zero).alias("successful"),
            F.coalesce("failed", zero).alias("failed"),
            percent(F.col("processed"), F.col("total")).alias("percentage"),
            percent(F.col("successful"), F.col("total")).alias("success_rate"),
        )
    )


def job_files_status(jobs: DataFrame, files: DataFrame, results: DataFrame) -> DataFrame:
    """State of every file; files without a result follow the state of their job."""
    outcome = results.select("job_id", "filename", "success", "error", "processed_at")
    waiting = F.when(F.col("job_status") == "processing", "processing").otherwise("pending")
    state = F.when(F.col("success"), "completed").when(~F.col("success"), "failed").otherwise(waiting)
    return (
        files.join(jobs.select("job_id", F.col("status").alias("job_status")), "job_id")
        .join(outcome, ["job_id", "filename"], "left")
        .select(
            "job_id",
            "filename",
            state.alias("status"),
            F.when(F.col("success"), 100).otherwise(0).alias("progress"),
            F.when(~F.col("success"), F.col("error")).alias("error"),
            F.when(F.col("success").isNotNull() | (F.col("job_status") == "processing"), F.col("uploaded_at")).alias("started_at"),
            F.col("processed_at").alias("completed_at"),
        )
    )


def requested_jobs(jobs: DataFrame, requested: DataFrame) -> DataFrame:
    """Completed jobs among the requested ids; repeated ids count once."""
    return jobs.where(F.col("status") == "completed").join(requested.select("job_id"), "job_id", "left_semi")


def skipped_jobs(jobs: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ids that are unknown or not finished."""
    finished = jobs.where(F.col("status") == "completed").select("job_id")
    return requested.select("job_id").distinct().join(finished, "job_id", "left_anti")


def jobs_newest(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created"), "job_id")


def job_preview(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """A short text per job: its first order number, else the number of successes."""
    ok = F.col("success")
    first = F.min(F.when(ok, F.struct("processed_at", "order_number")))
    facts = results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.count_if(ok).alias("success_count"), first.alias("first")
    )
    count = F.col("success_count")
    plural = F.when(count != 1, "s").otherwise("")
    preview = (
        F.when(count == 0, "")
        .when(F.col("first.order_number").isNotNull(), F.concat(F.lit("Order "), F.col("first.order_number")))
        .otherwise(F.concat(count.cast("string"), F.lit(" successful result"), plural))
    )
    return jobs.join(facts, "job_id").select("job_id", "status", "created", "file_count", "success_count", preview.alias("preview"))


def job_stats(jobs: DataFrame, progress: DataFrame) -> DataFrame:
    """Averages over completed jobs, with the fastest and the slowest one."""
    length = _millis(F.col("completed")) - _millis(F.col("created"))
    done = (
        jobs.where((F.col("status") == "completed") & F.col("created").isNotNull() & F.col("completed").isNotNull())
        .join(progress.select("job_id", "total"), "job_id")
        .withColumn("ms", length)
    )
    facts = done.agg(
        F.count(F.lit(1)).alias("jobs"),
        F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("files"),
        F.min(F.struct("ms", "job_id")).alias("fast"),
        F.min(F.struct((-F.col("ms")).alias("ms"), "job_id")).alias("slow"),
    )
    span = F.col("ms").cast("double")
    return facts.select(
        F.when(F.col("files") > 0, span / F.col("files").cast("double")).otherwise(0.0).alias("avg_ms_per_file"),
        F.col("files").alias("total_files"),
        F.when(F.col("jobs") > 0, span / F.col("jobs").cast("double")).otherwise(0.0).alias("avg_job_ms"),
        F.col("fast.job_id").alias("fastest_job"),
        F.col("slow.job_id").alias("slowest_job"),
    )


def jobs_by_period(jobs: DataFrame, as_of: str) -> DataFrame:
    """Number of jobs by age on the day ``as_of``; empty periods have no row."""
    today = F.lit(as_of).cast("date")
    started = F.col("created").cast("date")
    period = (
        F.when(started == today, "Today")
        .when(started == F.date_sub(today, 1), "Yesterday")
        .when(started >= F.date_sub(today, 7), "This Week")
        .when(started >= F.trunc(today, "month"), "This Month")
        .otherwise("Older")
    )
    return jobs.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("job_count"))


def job_eta(files: DataFrame, as_of: str) -> DataFrame:
    """Expected remaining milliseconds per job, null when nothing is left to do.

    Pending files cost the mean of the finished ones, running files what their
    progress leaves open, in whole milliseconds, plus a fixed margin. Without
    any finished file each active one costs a default.
    """
    running, pending = F.col("status") == "processing", F.col("status") == "pending"
    timed = (F.col("status") == "completed") & F.col("started_at").isNotNull() & F.col("completed_at").isNotNull()
    spent = _millis(F.col("completed_at")) - _millis(F.col("started_at"))
    elapsed = _millis(F.lit(as_of)) - _millis(F.col("started_at"))
    done = F.col("progress").cast("double") / 100.0
    floor = F.greatest(done, F.lit(0.01))
    left = F.floor(F.greatest(F.lit(0.0), elapsed.cast("double") / floor - elapsed.cast("double")) + 0.5).cast("bigint")
    unstarted = running & F.col("started_at").isNull()
    facts = files.groupBy("job_id").agg(
        F.count_if(running).alias("running_files"),
        F.count_if(pending).alias("pending_files"),
        F.count_if(timed).alias("timed"),
        F.count_if(timed & (spent > 0)).alias("positive"),
        F.coalesce(F.sum(F.when(timed & (spent > 0), spent)), F.lit(0)).alias("spent_ms"),
        F.coalesce(F.sum(F.when(running, left)), F.lit(0)).alias("left_ms"),
        F.coalesce(F.sum(F.when(unstarted, done / floor - done)), F.lit(0.0)).alias("left_share"),
    )
    active = F.col("running_files") + F.col("pending_files")
    mean = F.col("spent_ms").cast("double") / F.when(F.col("positive") > 0, F.col("positive").cast("double"))
    open_ms = F.col("left_ms").cast("double") + F.col("left_share") * mean + F.col("pending_files").cast("double") * mean
    estimate = (
        F.when(active == 0, F.lit(None).cast("bigint"))
        .when(F.col("timed") == 0, active * DEFAULT_FILE_MS)
        .otherwise(F.floor(open_ms * ETA_BUFFER + 0.5).cast("bigint"))
    )
    return facts.select("job_id", "running_files", "pending_files", estimate.alias("remaining_ms"))


def batch_outcomes(outcomes: DataFrame) -> DataFrame:
    """Documents per outcome (successful, recovered, failed) and error level."""
    return outcomes.groupBy("outcome", "level").agg(F.count(F.lit(1)).alias("file_count"))


def search(rows: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows with the term anywhere in one of the columns, ignoring case."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.lower(F.col(name)).contains(term.lower()), F.lit(False))
    return rows.where(hit)


def sorted_rows(rows: DataFrame, by: str, ascending: bool = True, then: list[str] | None = None) -> DataFrame:
    """Sort on any column; missing values come first ascending and last descending.

    Equal values are ordered by ``then`` (all other columns by default), so the order is fixed and a column
    with few values does not put most rows in one range.
    """
    column = F.col(by)
    ties = [name for name in rows.columns if name != by] if then is None else then
    return rows.orderBy(column.asc_nulls_first() if ascending else column.desc_nulls_last(), *ties)


def result_for(results: DataFrame, filename: str) -> DataFrame:
    return results.where(F.col("filename") == filename)
