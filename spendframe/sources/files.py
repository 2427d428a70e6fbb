"""File sources and sinks. Readers declare their schema; writers write with many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe import schemas
from spendframe.operators.export import BATCH_CSV_TITLES, ITEM_CSV_TITLES
from spendframe.rules.spending import DEFAULT_VENDOR


def as_documents(texts: DataFrame) -> DataFrame:
    """Whole-text rows with file facts as documents."""
    path = F.col("_metadata.file_path")
    return texts.select(
        path.alias("doc_id"),
        F.element_at(F.split(path, "/"), -1).alias("filename"),
        F.col("value").alias("text"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.length("value").alias("text_length"),
    )


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One document per text file below a directory."""
    return as_documents(spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True))


def read_invoices(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Invoices from JSON files: a single invoice, an array, or an object with an ``invoices`` array.

    Files of the last two kinds are read as a whole; large collections should be
    stored one record per line and read with ``lines``.
    """
    reader = spark.read.schema(schemas.INVOICE_FILE).option("multiLine", str(not lines).lower())
    rows = reader.json(path)
    fields = [f.name for f in schemas.INVOICE.fields]
    own = F.array(F.struct(*fields))
    invoices = rows.select(F.inline(F.coalesce("invoices", own)))
    return invoices.withColumns(
        {"vendor": F.coalesce("vendor", F.lit(DEFAULT_VENDOR)), "items": F.coalesce("items", F.array().cast(schemas.INVOICE["items"].dataType))}
    )


def mode_of(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_json(frame: DataFrame, path: str, overwrite: bool = False) -> None:
    frame.write.mode(mode_of(overwrite)).json(path)


def write_csv(frame: DataFrame, path: str, overwrite: bool = False, titles: dict[str, str] | None = None) -> None:
    """CSV with quoted values where needed; ``titles`` renames and orders the columns."""
    shown = frame if titles is None else frame.select(*[F.col(name).alias(title) for name, title in titles.items()])
    shown.write.mode(mode_of(overwrite)).option("header", "true").option("escape", '"').csv(path)


def write_item_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    write_csv(rows, path, overwrite, ITEM_CSV_TITLES)


def write_batch_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    write_csv(rows, path, overwrite, BATCH_CSV_TITLES)


def write_sections(sections: DataFrame, path: str, overwrite: bool = False) -> None:
    """One folder per report section."""
    sections.write.mode(mode_of(overwrite)).partitionBy("section").option("header", "true").option("escape", '"').csv(path)


def write_export(records: DataFrame, path: str, overwrite: bool = False) -> None:
    """Nested JSON export: summary, result and error records in a folder each."""
    records.write.mode(mode_of(overwrite)).partitionBy("kind").json(path)


def write_invoices(invoices: DataFrame, path: str, overwrite: bool = False) -> None:
    """Extracted invoices by year and month, so that reports on a period read only its folders."""
    dated = invoices.withColumns({"year": F.year("order_date"), "month": F.month("order_date")})
    dated.write.mode(mode_of(overwrite)).partitionBy("year", "month").parquet(path)
