"""Spending reports over an invoices table and an items table.

Invoices carry ``order_date`` and ``total_cents``; items carry ``description``
and ``total_cents``. Each section is its own DataFrame. Sections that look at
all groups together (shares, month-over-month growth) do so on the already
aggregated rows: at most one per calendar month or category.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendframe.functions.numbers import rounded, units
from spendframe.functions.plans import once
from spendframe.operators.export import amounts_as_units, first_row_layout
from spendframe.rules.spending import (
    BASE_CURRENCY,
    CATEGORY_KEYWORDS,
    DEFAULT_VENDOR,
    EXCHANGE_RATES,
    GROWTH_BAND,
    MONTH_NAMES,
    OTHER_CATEGORY,
)


def exchange_factor(display: str, rates: Mapping[str, float] = EXCHANGE_RATES, source: str = BASE_CURRENCY) -> float:
    return 1.0 if display == source else rates[display] / rates[source]


def converted_cents(cents: Column, currency: Column, display: str, rates: Mapping[str, float]) -> Column:
    """Convert each amount from its own currency, rounded to whole cents of the display currency."""
    chain = None
    for code, rate in rates.items():
        factor = F.lit(float(rates[display])) / F.lit(float(rate))
        hit = currency == code
        chain = F.when(hit, factor) if chain is None else chain.when(hit, factor)
    return F.floor(cents.cast("double") * chain + F.lit(0.5)).cast("bigint")


def category_of(description: Column, keywords: Mapping[str, list[str]] = CATEGORY_KEYWORDS) -> Column:
    """First category with a keyword in the description."""
    lowered = F.lower(description)
    chain = F.when(description.isNull(), F.lit(OTHER_CATEGORY))
    for category, words in keywords.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        chain = chain.when(hit, F.lit(category))
    return chain.otherwise(F.lit(OTHER_CATEGORY))


def total_spent(invoices: DataFrame) -> DataFrame:
    return invoices.agg(
        F.count("total_cents").alias("invoice_count"),
        units(F.coalesce(F.sum("total_cents"), F.lit(0))).alias("total_spent"),
    )


def summary(invoices: DataFrame, display: str = BASE_CURRENCY, rates: Mapping[str, float] = EXCHANGE_RATES) -> DataFrame:
    """Invoice count, converted total, average order value and date range."""
    factor = F.lit(exchange_factor(display, rates))
    sums = invoices.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.coalesce(F.sum("total_cents"), F.lit(0)).alias("sum_cents"),
        F.min("order_date").alias("date_start"),
        F.max("order_date").alias("date_end"),
    )
    spent = units("sum_cents") * factor
    return sums.select(
        "total_invoices",
        spent.alias("total_spent"),
        F.lit(BASE_CURRENCY).alias("original_currency"),
        F.lit(display).alias("display_currency"),
        "date_start",
        "date_end",
        (spent / F.greatest(F.col("total_invoices"), F.lit(1)).cast("double")).alias("average_order_value"),
    )


def top_vendors(invoices: DataFrame, k: int = 5) -> DataFrame:
    """The k vendors with most invoices; equal counts are ordered by name."""
    return (
        invoices.groupBy(F.coalesce("vendor", F.lit(DEFAULT_VENDOR)).alias("vendor"))
        .agg(F.count(F.lit(1)).alias("invoice_count"))
        .orderBy(F.desc("invoice_count"), F.asc("vendor"))
        .limit(k)
    )


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in MONTH_NAMES]), month)


def monthly_spending(
    invoices: DataFrame,
    display: str = BASE_CURRENCY,
    rates: Mapping[str, float] = EXCHANGE_RATES,
    by_currency: bool = False,
) -> DataFrame:
    """Spending per calendar month. Undated invoices are left out.

    Amounts are taken as base currency unless ``by_currency`` asks to convert
    each invoice from its own currency.
    """
    dated = invoices.where(F.col("order_date").isNotNull())
    keys = [F.year("order_date").alias("year"), F.month("order_date").alias("month")]
    if by_currency:
        per_currency = dated.groupBy(*keys, "currency").agg(
            F.sum("total_cents").alias("sum_cents"), F.count(F.lit(1)).alias("n")
        )
        sums = per_currency.groupBy("year", "month").agg(
            F.sum(converted_cents(F.col("sum_cents"), F.col("currency"), display, rates)).alias("sum_cents"),
            F.sum("n").alias("invoice_count"),
        )
        spent = units("sum_cents")
    else:
        sums = dated.groupBy(*keys).agg(
            F.coalesce(F.sum("total_cents"), F.lit(0)).alias("sum_cents"), F.count(F.lit(1)).alias("invoice_count")
        )
        spent = units("sum_cents") * F.lit(exchange_factor(display, rates))
    return months_of(sums, spent).orderBy("year", "month")


def months_of(sums: DataFrame, spent: Column) -> DataFrame:
    return sums.select("year", "month", month_name(F.col("month")).alias("month_name"), spent.alias("total_spent"), "invoice_count")


def category_analysis(
    items: DataFrame,
    display: str = BASE_CURRENCY,
    rates: Mapping[str, float] = EXCHANGE_RATES,
    keywords: Mapping[str, list[str]] = CATEGORY_KEYWORDS,
) -> DataFrame:
    """Spending, item count, average price and share of the total per category."""
    factor = F.lit(exchange_factor(display, rates))
    grouped = items.groupBy(category_of(F.col("description"), keywords).alias("category")).agg(
        F.coalesce(F.sum("total_cents"), F.lit(0)).alias("sum_cents"), F.count(F.lit(1)).alias("item_count")
    )
    grand = F.sum("sum_cents").over(Window.partitionBy())
    spent = units("sum_cents") * factor
    share = F.when(grand > 0, F.col("sum_cents").cast("double") / grand.cast("double") * 100.0).otherwise(0.0)
    return grouped.select(
        "category",
        spent.alias("total_spent"),
        "item_count",
        (spent / F.col("item_count").cast("double")).alias("average_price"),
        share.alias("percentage"),
    ).orderBy(F.desc("total_spent"), "category")


def top_categories(items: DataFrame, k: int = 10) -> DataFrame:
    return category_analysis(items).select("category", "total_spent", "item_count").limit(k)


def monthly_growth(invoices: DataFrame, display: str = BASE_CURRENCY, rates: Mapping[str, float] = EXCHANGE_RATES) -> DataFrame:
    """Month-over-month change in percent, months in calendar order."""
    months = monthly_spending(invoices, display, rates)
    by_month = Window.orderBy("year", "month")
    previous = F.lag("total_spent").over(by_month)
    change = (F.col("total_spent") - F.col("previous")) / F.col("previous") * 100.0
    return (
        months.withColumn("previous", previous)
        .where(F.col("previous").isNotNull())
        .select(
            "year",
            "month",
            F.when(F.col("previous") > 0, change).otherwise(0.0).alias("growth"),
            F.col("total_spent").alias("current"),
            "previous",
        )
        .orderBy("year", "month")
    )


def spending_trend(invoices: DataFrame, display: str = BASE_CURRENCY, rates: Mapping[str, float] = EXCHANGE_RATES) -> DataFrame:
    """One row: trend label, average growth and average monthly spend."""
    return trend_of(monthly_spending(invoices, display, rates))


def trend_of(months: DataFrame) -> DataFrame:
    by_month = Window.orderBy("year", "month")
    steps = months.withColumn("previous", F.lag("total_spent").over(by_month))
    growth = F.when(F.col("previous") > 0, (F.col("total_spent") - F.col("previous")) / F.col("previous") * 100.0).otherwise(
        F.when(F.col("previous").isNotNull(), 0.0)
    )
    facts = steps.agg(
        F.count(F.lit(1)).alias("total_months"),
        rounded(F.avg(growth), 4).alias("average_growth"),
        rounded(F.avg("total_spent"), 2).alias("average_monthly_spend"),
    )
    enough = F.col("total_months") >= 2
    label = (
        F.when(~enough, "insufficient_data")
        .when(F.col("average_growth") > GROWTH_BAND, "increasing")
        .when(F.col("average_growth") < -GROWTH_BAND, "decreasing")
        .otherwise("stable")
    )
    return facts.select(
        label.alias("trend"),
        F.when(enough, F.col("average_growth")).alias("average_growth"),
        F.when(enough, F.col("average_monthly_spend")).otherwise(0.0).alias("average_monthly_spend"),
        "total_months",
    )


def currency_breakdown(invoices: DataFrame) -> DataFrame:
    """Total, count and average order per currency; unknown currency counts as the base currency."""
    return (
        invoices.groupBy(F.coalesce("currency", F.lit(BASE_CURRENCY)).alias("currency"))
        .agg(F.coalesce(F.sum("total_cents"), F.lit(0)).alias("sum_cents"), F.count(F.lit(1)).alias("invoice_count"))
        .transform(currencies_of)
        .orderBy(F.desc("total_spent"), "currency")
    )


def currencies_of(sums: DataFrame) -> DataFrame:
    average = units("sum_cents") / F.col("invoice_count").cast("double")
    return sums.select("currency", units("sum_cents").alias("total_spent"), "invoice_count", average.alias("average_order"))


def financial_overview(invoices: DataFrame) -> DataFrame:
    """Total, average and count over the invoices that have a total."""
    priced = invoices.where(F.col("total_cents").isNotNull()).agg(
        F.coalesce(F.sum("total_cents"), F.lit(0)).alias("sum_cents"), F.count(F.lit(1)).alias("invoice_count")
    )
    return priced.select(
        units("sum_cents").alias("total_value"),
        (units("sum_cents") / F.col("invoice_count").cast("double")).alias("average_value"),
        "invoice_count",
    )


def largest_invoices(invoices: DataFrame, k: int = 20) -> DataFrame:
    return (
        invoices.where(F.col("total_cents").isNotNull())
        .orderBy(F.desc("total_cents"), "order_number")
        .limit(k)
        .select("order_number", "order_date", "vendor", units("total_cents").alias("total"))
    )


FIELD_FLAGS = ["order_number", "order_date", "items", "subtotal", "tax", "shipping", "total"]


def performance_report(runs: DataFrame) -> DataFrame:
    """Success counts, timing and field success rates over processed invoices.

    ``runs`` has ``error``, ``processing_ms``, ``extraction_score`` and one
    ``has_<field>`` flag per extracted field.
    """
    ok = F.col("error").isNull()
    n_ok = F.count_if(ok)
    time = F.when(ok, F.col("processing_ms"))

    def mean(total: Column) -> Column:
        return F.when(n_ok > 0, total.cast("double") / n_ok.cast("double")).otherwise(0.0)

    rates = [mean(F.count_if(ok & F.col(f"has_{f}"))).alias(f"{f}_rate") for f in FIELD_FLAGS]
    hits = sum((F.count_if(ok & F.col(f"has_{f}")) for f in FIELD_FLAGS[1:]), F.count_if(ok & F.col(f"has_{FIELD_FLAGS[0]}")))
    return runs.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        n_ok.alias("successful_invoices"),
        F.count_if(~ok).alias("failed_invoices"),
        (n_ok.cast("double") / F.count(F.lit(1)).cast("double")).alias("success_rate"),
        F.coalesce(F.sum(time), F.lit(0)).alias("total_ms"),
        mean(F.sum(time)).alias("average_ms"),
        F.coalesce(F.min(time), F.lit(0)).alias("min_ms"),
        F.coalesce(F.max(time), F.lit(0)).alias("max_ms"),
        (mean(hits) / F.lit(float(len(FIELD_FLAGS)))).alias("average_extraction"),
        *rates,
    )


def performance_by_language(runs: DataFrame) -> DataFrame:
    """Documents and mean detection confidence per language, successes only."""
    return (
        runs.where(F.col("error").isNull() & F.col("language").isNotNull())
        .groupBy("language")
        .agg(
            F.count(F.lit(1)).alias("document_count"),
            F.sum(F.round(F.col("confidence") * 100).cast("bigint")).alias("confidence_points"),
        )
        .select(
            "language",
            "document_count",
            (F.col("confidence_points").cast("double") / 100.0 / F.col("document_count").cast("double")).alias("average_confidence"),
        )
    )


def performance_errors(runs: DataFrame) -> DataFrame:
    """Messages of the failed runs with their counts."""
    return (
        runs.where(F.col("error").isNotNull())
        .groupBy(F.coalesce(F.col("error"), F.lit("Unknown error")).alias("error"))
        .agg(F.count(F.lit(1)).alias("invoice_count"))
    )


# Grouping ids of the sets below: a bit is set for each column that a set leaves out.
WHOLE, BY_VENDOR, BY_CURRENCY, BY_MONTH = 0b1111, 0b0111, 0b1011, 0b1100


def grouped_figures(invoices: DataFrame, months: bool = True) -> DataFrame:
    """Count, sum and date range of all invoices, per vendor, per currency and per month, from one scan.

    ``grouping`` says which set a row belongs to. All columns leave through one generator, so that sections built
    on these rows have the same plan below them and the scan and its shuffle are made once.
    """
    sets = [[], ["vendor"], ["currency"], *([["year", "month"]] if months else [])]
    keyed = invoices.select(
        F.coalesce("vendor", F.lit(DEFAULT_VENDOR)).alias("vendor"),
        F.coalesce("currency", F.lit(BASE_CURRENCY)).alias("currency"),
        F.year("order_date").alias("year"),
        F.month("order_date").alias("month"),
        "order_date",
        "total_cents",
    )
    figures = keyed.groupingSets(sets, "vendor", "currency", "year", "month").agg(
        F.grouping_id().cast("int").alias("grouping"),
        F.count(F.lit(1)).alias("invoice_count"),
        F.coalesce(F.sum("total_cents"), F.lit(0)).alias("sum_cents"),
        F.min("order_date").alias("date_start"),
        F.max("order_date").alias("date_end"),
    )
    return once(figures)


def report_sections(
    invoices: DataFrame,
    items: DataFrame,
    order: list[str],
    display: str = BASE_CURRENCY,
    rates: Mapping[str, float] = EXCHANGE_RATES,
    monthly: bool = True,
    categories: bool = True,
    trends: bool = True,
    details: bool = True,
) -> DataFrame:
    """The sections of a report as rows of one table, keyed by ``section``; switches leave sections out.

    Invoice figures come from one grouping-sets aggregate over one scan, category figures from one scan of the items.
    With details, invoices and items are dealt by order for their join, and branches whose shuffles are equal share
    them. A section that is switched off takes its grouping set and its scan with it. ``order`` are the columns that
    order the items of one invoice.
    """
    if details:
        invoices, items = once(invoices, "order_id"), once(items, "order_id")
    figures = grouped_figures(invoices, monthly or trends)
    factor = F.lit(exchange_factor(display, rates))
    top = figures.where(F.col("grouping") == BY_VENDOR).orderBy(F.desc("invoice_count"), F.asc("vendor")).limit(5)
    vendors = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("invoice_count")).alias("n"), "vendor"))).alias("v")).select(
        F.array_join(F.transform("v", lambda x: F.concat(x["vendor"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")"))), "; ").alias("top_vendors")
    )
    # One row also where there is no invoice.
    total = figures.where(F.col("grouping") == WHOLE).agg(
        F.coalesce(F.sum("invoice_count"), F.lit(0)).alias("invoice_count"),
        F.coalesce(F.sum("sum_cents"), F.lit(0)).alias("sum_cents"),
        F.min("date_start").alias("date_start"),
        F.max("date_end").alias("date_end"),
    )
    spent = units("sum_cents") * factor
    sections = [
        total.crossJoin(vendors).select(
            F.lit("SUMMARY").alias("section"),
            "invoice_count",
            spent.alias("total_spent"),
            F.lit(display).alias("currency"),
            (spent / F.greatest(F.col("invoice_count"), F.lit(1)).cast("double")).alias("average"),
            "date_start",
            "date_end",
            "top_vendors",
        )
    ]
    months = months_of(figures.where((F.col("grouping") == BY_MONTH) & F.col("year").isNotNull()), spent)
    if monthly:
        sections.append(months.select(F.lit("MONTHLY_SPENDING").alias("section"), "*"))
    if categories:
        shares = category_analysis(items, display, rates)
        shown = ["category", "total_spent", "item_count", F.col("average_price").alias("average"), "percentage"]
        sections.append(shares.select(F.lit("CATEGORY_ANALYSIS").alias("section"), *shown))
    if trends:
        sections.append(trend_of(months).select(F.lit("TRENDS").alias("section"), "*"))
    breakdown = currencies_of(figures.where(F.col("grouping") == BY_CURRENCY))
    sections.append(breakdown.select(F.lit("CURRENCY_BREAKDOWN").alias("section"), "currency", "total_spent", "invoice_count", F.col("average_order").alias("average")))
    if details:
        rows = first_row_layout(amounts_as_units(invoices), items, order, dealt=True)
        sections.append(rows.select(F.lit("INVOICE_DETAILS").alias("section"), "*"))
    merged = sections[0]
    for part in sections[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged
