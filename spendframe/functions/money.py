"""Money text to numbers.

Two readings exist side by side and differ on purpose. ``tolerant_amount`` takes
whatever digits it finds and falls back to 0; reports and quality rules use it.
``strict_amount`` accepts known shapes only and gives null otherwise; the typed
export uses it. A single comma group shows the gap: in yen text 15,980 is 15980
for the first and 15.98 for the second.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency marks recognised in front of or behind an amount.
SYMBOL_PATTERN = r"[$€£¥]|CHF|Fr"
STRIPPED_MARKS = r"[$€£¥Fr]|CHF|EUR|USD|GBP|JPY"

# Accepted shapes of a written amount.
MONEY_SHAPES = [
    r"\$[\d,]*\d+\.\d{2}",
    r"€[\d.]*\d+,\d{2}",
    r"[\d.]*\d+,\d{2}\s*€",
    r"[\d,]*\d+\.\d{2}\s*€",
    r"£[\d,]*\d+\.\d{2}",
    r"¥[\d,]*\d+",
    r"CHF\s[\d,]*\d+(\.\d{2})?",
    r"Fr\.?\s[\d,]*\d+(\.\d{2})?",
    r"USD\s[\d,]*\d+(\.\d{2})?",
    r"EUR\s[\d,]*\d+([,.]\d{2})?",
    r"GBP\s[\d,]*\d+(\.\d{2})?",
]


def leading_number(text: Column) -> Column:
    """The number a text starts with, null if there is none."""
    return F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def _without(text: Column, mark: str) -> Column:
    return F.replace(text, F.lit(mark), F.lit(""))


def _first_comma_to_dot(text: Column) -> Column:
    return F.regexp_replace(text, r"^([^,]*),", "$1.")


def tolerant_amount(text: Column, signed: bool = False) -> Column:
    """Number in a money text, 0 when there is none.

    The later of comma and dot is the decimal mark; a lone comma is decimal only
    with one or two digits behind it. The sign is dropped unless ``signed``.
    """
    kept = F.regexp_replace(text, r"[^\d.,\-]", "")
    has_comma, has_dot = text.contains(","), text.contains(".")
    # Texts without a comma, the common case, skip the tests below.
    plain = (
        F.when(~has_comma, kept)
        .when(has_dot & kept.rlike(r",[^.,]*$"), _first_comma_to_dot(_without(kept, ".")))
        .when(~has_dot & kept.rlike(r"^[^,]*,\d{1,2}$"), _first_comma_to_dot(kept))
        .otherwise(_without(kept, ","))
    )
    number = F.regexp_extract(plain, r"^[^\d.]*(\d+\.?\d*|\.\d+)", 1).try_cast("double")
    value = F.coalesce(number, F.lit(0.0))
    if signed:
        value = F.when(plain.rlike(r"^-"), -value).otherwise(value)
    return value


def strict_amount(text: Column) -> Column:
    """Number in a money text of a known shape, else null."""
    bare = F.trim(F.regexp_replace(text, STRIPPED_MARKS, ""))
    # A text without a comma is a plain number whichever shape it has.
    number = (
        F.when(~text.contains(","), bare)
        .when(bare.rlike(r"^\d{1,3}(?:\.\d{3})*,\d{2}$"), _first_comma_to_dot(_without(bare, ".")))
        .when(bare.rlike(r"^\d{1,3}(?:,\d{3})*\.\d{2}$"), _without(bare, ","))
        .when(bare.rlike(r"^\d+,\d+$"), F.replace(bare, F.lit(","), F.lit(".")))
        .otherwise(bare)
    )
    return leading_number(number)


def to_cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def tolerant_cents(text: Column) -> Column:
    return to_cents(tolerant_amount(text))


def currency_symbol(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, SYMBOL_PATTERN, 0), F.lit(""))


def is_money_text(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("^(?:" + "|".join(MONEY_SHAPES) + ")$"), F.lit(False))


def two_decimals(cents: Column) -> Column:
    """Cents as text with two decimals and no grouping."""
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(20,2)").cast("string")


def grouped_decimals(cents: Column) -> Column:
    """Cents as text with comma thousands and two decimals."""
    return F.regexp_replace(two_decimals(cents), r"\B(?=(\d{3})+\.)", ",")


def european_amount(cents: Column) -> Column:
    """Cents as ``1234,50 €``."""
    return F.concat(F.replace(two_decimals(cents), F.lit("."), F.lit(",")), F.lit(" €"))


def money_text(cents: Column, currency: Column) -> Column:
    """Cents written the way each currency is usually written."""
    plain = two_decimals(cents)
    return (
        F.when(currency == "EUR", european_amount(cents))
        .when(currency == "GBP", F.concat(F.lit("£"), plain))
        .when(currency == "JPY", F.concat(F.lit("¥"), cents.cast("string")))
        .when(currency == "CHF", F.concat(F.lit("CHF "), plain))
        .otherwise(F.concat(F.lit("$"), plain))
    )
