"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

ITEM = T.StructType(
    [
        T.StructField("asin", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unitPrice", T.DoubleType()),
        T.StructField("totalPrice", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("price", T.StringType()),
    ]
)

INVOICE = T.StructType(
    [
        T.StructField("orderNumber", T.StringType()),
        T.StructField("orderDate", T.StringType()),
        T.StructField("items", T.ArrayType(ITEM)),
        *[T.StructField(name, T.StringType()) for name in ("subtotal", "shipping", "tax", "discount", "total")],
        T.StructField("vendor", T.StringType()),
        T.StructField("currency", T.StringType()),
    ]
)

# A file holds one invoice, an array of invoices, or an object with an invoices array.
INVOICE_FILE = T.StructType([*INVOICE.fields, T.StructField("invoices", T.ArrayType(INVOICE))])

PROGRESS_EVENT = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("success", T.BooleanType()),
    ]
)
