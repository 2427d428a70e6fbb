"""Field-by-field comparison of extraction results between jobs or runs.

``compare_first`` sets the first invoice of each requested job side by side.
``compare_groups`` matches invoices by order number across runs and scales with
the data: one shuffle on (order number, field), partial aggregates before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Compared fields with the names shown, confidence levels and tolerance.
FIELDS = {
    "order_number": "orderNumber",
    "order_date": "orderDate",
    "customer_name": "customerInfo.name",
    "currency": "currency",
    "total": "totals.total",
}
SURE_FIELDS = ["total", "orderNumber"]
SURE, USUAL, ABSENT = 0.9, 0.7, 0.0
TOLERANCE = 0.01
THRESHOLD = 0.5
LOW_CONFIDENCE = 0.5


def field_confidence(field: Column, value: Column) -> Column:
    sure = F.lit(False)
    for word in SURE_FIELDS:
        sure = sure | field.contains(word)
    return F.when(F.coalesce(value, F.lit("")) == "", ABSENT).when(sure, SURE).otherwise(USUAL)


def first_invoices(results: DataFrame, job_ids: list[str]) -> DataFrame:
    """First invoice of each requested job by time, then order number. Column ``group_id`` is the job."""
    columns = [c for c in results.columns if c not in ("job_id", "processed_at", "order_number")]
    order = F.struct("processed_at", "order_number", *columns)
    return (
        results.where(F.col("job_id").isin(job_ids))
        .groupBy(F.col("job_id").alias("group_id"))
        .agg(F.min(order).alias("row"))
        .select("group_id", "row.*")
    )


def resolved(path: str, schema: T.StructType) -> tuple[Column, T.DataType]:
    """Column and type of a dotted path over structs, arrays (by place) and maps (by key); a null text if it leads nowhere.

    A column whose own name has the dots comes first. Places beyond an array's end and absent keys give null.
    """
    if path in schema.names:
        return F.col(f"`{path}`"), schema[path].dataType
    head, *rest = path.split(".")
    column, kind = (F.col(f"`{head}`"), schema[head].dataType) if head in schema.names else (None, None)
    for name in rest:
        if isinstance(kind, T.StructType) and name in kind.names:
            column, kind = column.getField(name), kind[name].dataType
        elif isinstance(kind, T.ArrayType) and name.isdigit():
            column, kind = F.get(column, F.lit(int(name))), kind.elementType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(name).cast(kind.keyType)), kind.valueType
        else:
            column = None
        if column is None:
            break
    return (F.lit(None).cast("string"), T.StringType()) if column is None else (column, kind)


def shown_text(column: Column, kind: T.DataType) -> Column:
    """A value as text; structs, arrays and maps as JSON."""
    nested = isinstance(kind, T.StructType | T.ArrayType | T.MapType)
    return F.to_json(column) if nested else column.cast("string")


def field_values(rows: DataFrame, fields: dict[str, str], keep: list[str] = ["group_id"]) -> DataFrame:
    """Long form: one row per row and field with text, number (if numeric) and confidence.

    ``fields`` maps columns or dotted paths to the names shown. The row is turned once, by one ``stack``.
    """
    cells = []
    for path, shown in fields.items():
        column, kind = resolved(path, rows.schema)
        numeric = isinstance(kind, T.NumericType)
        cells += [F.lit(shown), shown_text(column, kind), (column if numeric else F.lit(None)).cast("double")]
    long = rows.select(*keep, F.stack(F.lit(len(fields)), *cells).alias("field", "value", "number"))
    return long.withColumn("confidence", field_confidence(F.col("field"), F.col("value")))


def judged(values: DataFrame, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Difference flag and mean confidence per key.

    Numbers differ from the tolerance upwards, texts when they differ in more
    than case. Lowest and highest value decide, so any number of rows per key
    is combined map-side.
    """
    counted = F.col("confidence") >= threshold
    number, word = F.when(counted, F.col("number")), F.when(counted & F.col("number").isNull(), F.lower("value"))
    spread = F.max(number) - F.min(number)
    points = F.sum(F.round(F.col("confidence") * 10).cast("bigint"))
    differs = F.coalesce(spread >= TOLERANCE, F.lit(False)) | F.coalesce(F.max(word) != F.min(word), F.lit(False))
    return values.groupBy(*keys).agg(
        differs.alias("has_differences"),
        (points.cast("double") / 10.0 / F.count(F.lit(1)).cast("double")).alias("confidence"),
        F.count(F.lit(1)).alias("value_count"),
    )


def compare_first(results: DataFrame, job_ids: list[str], fields: dict[str, str] = FIELDS) -> DataFrame:
    """Compare the first invoices of the requested jobs; jobs without any are counted as missing."""
    rows = judged(field_values(first_invoices(results, job_ids), fields), ["field"])
    return rows.withColumn("missing_jobs", F.lit(len(job_ids)) - F.col("value_count"))


def missing_jobs(results: DataFrame, spark: SparkSession, job_ids: list[str]) -> DataFrame:
    asked = spark.createDataFrame([(j,) for j in job_ids], "job_id string")
    return asked.join(results, "job_id", "left_anti")


def compare_groups(results: DataFrame, fields: dict[str, str] = FIELDS) -> DataFrame:
    """Compare runs (``run_id``) of the same orders, matched by order number."""
    values = field_values(results, {c: f for c, f in fields.items() if c != "order_number"}, ["order_number", "run_id"])
    per_order = judged(values, ["order_number", "field"])
    return per_order.groupBy("field").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if("has_differences").alias("orders_with_differences"),
        F.count_if(F.col("value_count") < 2).alias("orders_in_one_run"),
    )


def issues(compared: DataFrame) -> DataFrame:
    """Issues of a comparison: differing values and jobs without data."""
    shown = F.col("field")
    severity = F.when(F.col("confidence") < LOW_CONFIDENCE, "high").otherwise("medium")
    row = "struct<type:string,severity:string,message:string>"

    def entry(kind: str, level: Column, message: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), level.alias("severity"), message.alias("message")).cast(row)

    difference = F.when(
        F.col("has_differences"),
        entry("difference", severity, F.concat(F.lit("Values differ across invoices for field: "), shown)),
    )
    missing = F.when(
        F.col("missing_jobs") > 0,
        entry("missing", F.lit("medium"), F.concat(F.lit("Missing data for field: "), shown, F.lit(" in some invoices"))),
    )
    return compared.select("field", F.explode(F.array_compact(F.array(difference, missing))).alias("issue")).select(
        "field", "issue.*"
    )


def summary(compared: DataFrame) -> DataFrame:
    found = F.when(F.col("has_differences"), 1).otherwise(0) + F.when(F.col("missing_jobs") > 0, 1).otherwise(0)
    return compared.agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.count_if("has_differences").alias("fields_with_differences"),
        F.sum(found.cast("bigint")).alias("total_issues"),
        F.round(F.avg("confidence"), 6).alias("average_confidence"),
    )


def search(compared: DataFrame, found: DataFrame, term: str) -> DataFrame:
    """Fields whose name or issue text contains the term."""
    word = term.lower()
    hits = found.where(F.lower("message").contains(word)).select("field")
    return compared.where(F.lower("field").contains(word)).unionByName(
        compared.where(~F.lower("field").contains(word)).join(hits, "field", "left_semi")
    )


def ordered(compared: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    """Sort by field, confidence or differences; differing fields come first when ascending."""
    key = {"field": F.col("field"), "confidence": F.col("confidence"), "differences": ~F.col("has_differences")}[by]
    return compared.orderBy(key.asc() if ascending else key.desc(), "field")


def pivot(results: DataFrame, job_ids: list[str], fields: dict[str, str] = FIELDS) -> DataFrame:
    """One row per field, a value and a confidence column per job."""
    values = field_values(first_invoices(results, job_ids), fields)
    wide = (
        values.groupBy("field")
        .pivot("group_id", job_ids)
        .agg(F.first("value").alias("value"), F.first("confidence").alias("confidence"))
    )
    flags = compare_first(results, job_ids, fields).select("field", "has_differences")
    return flags.join(wide, "field")
