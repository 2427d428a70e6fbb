"""spendframe: invoice text and order records to trusted spending data, as Spark DataFrame operators."""

__version__ = "0.1.0"
