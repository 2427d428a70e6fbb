"""Invoices, items, jobs and uploads derived from the star-schema tables.

Amounts are whole cents (BIGINT), so sums do not depend on partitioning.
Broadcasts are left to the planner, which decides from table statistics and,
under adaptive execution, from measured sizes; nothing here forces one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.functions.money import european_amount, two_decimals

# Currency of each sales region.
REGION_CURRENCY = {
    "AMERICA": "USD",
    "EUROPE": "EUR",
    "AFRICA": "GBP",
    "ASIA": "JPY",
    "MIDDLE EAST": "CHF",
}

# Product shown for the last word of a part name.
PRODUCT_NAMES = {
    "widget": "Kindle Paperwhite",
    "ring": "Echo Dot",
    "bolt": "Coffee Beans",
    "plate": "Kitchen Plate",
    "anvil": "Garden Anvil",
    "rod": "Fishing Rod",
    "gear": "Hiking Gear",
    "gizmo": "Puzzle Gizmo",
}

# The columns that order the items of one order.
ITEM_ORDER = ["line_number", "part_key", "supplier_key", "total_cents", "ship_date"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(key: Column, values: dict[str, str]) -> Column:
    """Constant map lookup that stays inside generated code."""
    chain = None
    for source, target in values.items():
        hit = key == F.lit(source)
        chain = F.when(hit, F.lit(target)) if chain is None else chain.when(hit, F.lit(target))
    return chain


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def order_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined to customer, nation and region: one row per order."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    order_key, cust_key = F.col("o_orderkey"), F.col("o_custkey")
    number = F.concat(
        F.lpad((order_key % 1000).cast("string"), 3, "0"),
        F.lit("-"),
        F.lpad(order_key.cast("string"), 7, "0"),
        F.lit("-"),
        F.lpad(cust_key.cast("string"), 7, "0"),
    )
    day = F.col("o_orderdate").cast("date")
    return (
        orders.join(customer, cust_key == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            order_key.alias("order_id"),
            cust_key.alias("customer_key"),
            F.col("c_name").alias("customer_name"),
            number.alias("order_number"),
            day.alias("order_date"),
            F.col("o_orderdate").alias("processed_at"),
            F.col("c_mktsegment").alias("vendor"),
            F.col("r_name").alias("region"),
            lookup(F.col("r_name"), REGION_CURRENCY).alias("currency"),
            cents(F.col("o_totalprice")).alias("stated_cents"),
            F.concat(F.lit("job_"), F.year(day).cast("string"), F.lit("_"), (cust_key % 10).cast("string")).alias("job_id"),
            F.concat(number, F.lit(".txt")).alias("filename"),
            (F.col("o_orderstatus") != "F").alias("success"),
            F.when(F.col("o_orderstatus") == "F", F.lit("Processing failed")).alias("error"),
        )
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its amounts. Item sums combine map-side before the shuffle."""
    line = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    sums = line.groupBy(F.col("l_orderkey")).agg(
        F.sum(cents(price)).alias("subtotal_sum"),
        F.sum(cents(price * F.col("l_tax"))).alias("tax_sum"),
        F.sum(cents(price * F.col("l_discount"))).alias("discount_sum"),
        F.count(F.lit(1)).alias("item_count"),
    )
    zero = F.lit(0).cast("bigint")
    joined = order_owners(spark, sf_dir).join(sums, F.col("order_id") == F.col("l_orderkey"), "left")
    amounts = joined.withColumns(
        {
            "subtotal_cents": F.coalesce("subtotal_sum", zero),
            "tax_cents": F.coalesce("tax_sum", zero),
            "discount_cents": F.coalesce("discount_sum", zero),
            "shipping_cents": (F.col("order_id") % 7) * 100,
            "item_count": F.coalesce("item_count", zero),
        }
    )
    consistent = F.col("subtotal_cents") + F.col("tax_cents") + F.col("shipping_cents")
    return amounts.withColumn(
        "total_cents", F.when(F.col("order_id") % 2 == 0, consistent).otherwise(F.col("stated_cents"))
    ).drop("l_orderkey", "subtotal_sum", "tax_sum", "discount_sum", "stated_cents")


def items(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One row per order line with the product description.

    With ``dealt`` lines meet their products in a shuffle whatever the size of the products looks like. Where only their
    keys are read, a size estimated from columns and compressed files is a small part of what the driver would hold.
    """
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    if dealt:
        part = part.hint("merge")
    last_word = F.element_at(F.split("p_name", " "), -1)
    total = cents(F.col("l_extendedprice"))
    quantity = F.col("l_quantity").cast("int")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supplier_key"),
        F.col("l_shipdate").alias("ship_date"),
        F.concat(F.lit("B"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("asin"),
        F.concat(lookup(last_word, PRODUCT_NAMES), F.lit(" "), F.col("p_type")).alias("description"),
        quantity.alias("quantity"),
        total.alias("total_cents"),
        F.round(total.cast("double") / quantity).cast("bigint").alias("unit_cents"),
    )


def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_owners(spark, sf_dir).select("job_id", "filename", "success", "error", "processed_at")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per job; the last digit of the customer key decides whether it has finished."""
    return (
        order_owners(spark, sf_dir)
        .groupBy("job_id")
        .agg(
            F.min("order_date").alias("created"),
            F.max("order_date").alias("completed"),
            F.max(F.when(F.col("customer_key") % 10 < 8, "completed").otherwise("processing")).alias("status"),
        )
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded files; every 17th has the wrong extension."""
    doc_id = F.col("doc_id")
    extension = F.when(doc_id % 17 == 0, ".doc").otherwise(".pdf")
    return table(spark, sf_dir, "documents").select(
        F.concat(doc_id.cast("string"), extension).alias("filename"),
        F.lit("application/pdf").alias("mime_type"),
        (F.col("n_chars") * 4096).alias("size"),
        F.col("source").alias("batch"),
    )


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file state changes: one job per user, one file per event."""
    states = {
        "view": "uploading",
        "click": "processing",
        "purchase": "completed",
        "error": "failed",
        "signup": "cancelled",
    }
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").cast("string").alias("filename"),
        F.col("ts"),
        lookup(F.col("event_type"), states).alias("state"),
    )


def noisy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with encoding damage put into every fifth one."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, F.replace(text, F.lit("é"), F.lit("Ã©"))).otherwise(text).alias("text"),
    )


def flawed_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices as extracted text with faults at fixed order keys, input of the quality rules."""
    key = F.col("order_id")

    def every(n: int) -> Column:
        return key % n == 0

    plain = {n: F.concat(F.lit("$"), two_decimals(F.col(f"{n}_cents"))) for n in ("shipping", "tax", "discount", "total")}
    subtotal = F.col("subtotal_cents") + F.when(every(19), 5000).otherwise(0)
    year = (F.year("order_date") + key % 35).cast("string")
    day = F.concat(year, F.date_format("order_date", "-MM-dd"))
    return invoices(spark, sf_dir).select(
        "order_id",
        F.when(every(43), "unreadable").when(~every(29), F.col("order_number")).alias("order_number"),
        F.when(every(37), "undefined").when(~every(31), day).alias("order_date"),
        F.col("vendor"),
        F.when(~every(47), F.when(every(53), "SEK").otherwise("USD")).alias("currency"),
        F.concat(F.lit("$"), two_decimals(subtotal)).alias("subtotal"),
        F.when(every(17), two_decimals(F.col("shipping_cents"))).otherwise(plain["shipping"]).alias("shipping"),
        F.when(every(13), european_amount(F.col("tax_cents"))).otherwise(plain["tax"]).alias("tax"),
        F.when(F.col("discount_cents") > 0, plain["discount"]).alias("discount"),
        F.when(~every(41), plain["total"]).alias("total"),
    )


def priced_items(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Items with their price as text; some products are priced in another currency or lack a description."""
    other = F.col("part_key") % 23 == 0
    price = F.when(other, european_amount(F.col("total_cents"))).otherwise(
        F.concat(F.lit("$"), two_decimals(F.col("total_cents")))
    )
    described = F.when(F.col("part_key") % 101 != 0, F.col("description"))
    return items(spark, sf_dir, dealt).withColumns({"price": price, "description": described})


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error messages and contexts at fixed order keys, input of the error classes."""
    key = F.col("o_orderkey")
    messages = [
        "File not found: a.pdf", "PDF parsing failed", "Field extraction failed", "Schema validation problem",
        "Out of luck", "Permission denied",
    ]
    contexts = ["batch-processing", "pdf-parsing", "field-extraction-total", "post-validation"]
    return table(spark, sf_dir, "orders").select(
        key.alias("order_id"),
        F.element_at(F.array(*[F.lit(m) for m in messages]), (key % 6 + 1).cast("int")).alias("error"),
        F.element_at(F.array(*[F.lit(c) for c in contexts]), (key % 4 + 1).cast("int")).alias("context"),
    )
