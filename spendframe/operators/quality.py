"""Data-quality rules over invoices and items, with scores and explainable issues.

Invoices carry money as text (``subtotal``, ``shipping``, ``tax``, ``discount``,
``total``), ``order_number``, ``order_date`` as text and optionally ``raw_text``.
Items carry ``asin``, ``description``, ``quantity``, ``unit_cents``,
``total_cents`` and ``price`` (text). Both are keyed by ``order_id``.

All rules that need one invoice and its item sums are evaluated side by side in
one pass, so the invoices are read once however many rules there are. Item
figures are partial sums first; nothing gathers the items of an invoice.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.money import currency_symbol, is_money_text, strict_amount, tolerant_cents, two_decimals
from spendframe.functions.numbers import rounded
from spendframe.rules import quality as rules

# Currency marks in the order of their bits.
CURRENCY_MARKS = ["$", "€", "£", "¥", "CHF", "Fr"]
HEADER_MONEY = ["subtotal", "shipping", "tax", "total"]
# Item figures of an invoice, all whole numbers.
FACTS = ["items", "price_sum", "value_sum", "very_high_prices", "high_prices", "described_items", "priced_items", "symbol_bits"]
ISSUE = "struct<level:string,type:string,severity:string,message:string,fields:array<string>>"


class Issue(NamedTuple):
    """A rule: when it applies, at which level, and the row it gives (null where it does not apply)."""

    condition: Column
    level: str
    row: Column


def issue(condition: Column, level: str, kind: str, severity: Column | str, message: Column, fields: list[str]) -> Issue:
    rank = F.lit(severity) if isinstance(severity, str) else severity
    row = F.struct(
        F.lit(level).alias("level"),
        F.lit(kind).alias("type"),
        rank.alias("severity"),
        message.alias("message"),
        F.array(*[F.lit(name) for name in fields]).alias("fields"),
    ).cast(ISSUE)
    return Issue(condition, level, F.when(condition, row))


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def with_cents(invoices: DataFrame) -> DataFrame:
    """Add the header amounts in cents; a missing amount counts as 0."""
    return invoices.withColumns(
        {f"{name}_cents": F.coalesce(tolerant_cents(F.col(name)), F.lit(0)) for name in [*HEADER_MONEY, "discount"]}
    )


def item_price(unit: Column | None = None, total: Column | None = None) -> Column:
    """Unit price of an item, else its line total."""
    unit, total = (F.col(name) if value is None else value for name, value in (("unit_cents", unit), ("total_cents", total)))
    return F.coalesce(F.nullif(unit, F.lit(0)), F.nullif(total, F.lit(0)), F.lit(0))


def mark_bit(price: Column) -> Column:
    """The currency mark of a price text as a bit, null without one."""
    symbol, bit = currency_symbol(price), None
    for place, mark in enumerate(CURRENCY_MARKS):
        bit = F.when(symbol == mark, 1 << place) if bit is None else bit.when(symbol == mark, 1 << place)
    return bit


def item_facts(items: DataFrame) -> DataFrame:
    """Sums and counts per invoice.

    Everything is a number, currency marks being bits of one, so the aggregate
    stays a hash aggregate with map-side combining.
    """
    price = item_price()
    described = F.coalesce(F.trim("description") != "", F.lit(False))
    quantity = F.coalesce(F.nullif(F.col("quantity"), F.lit(0)), F.lit(1))
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum("total_cents"), F.lit(0)).alias("price_sum"),
        F.sum(price * quantity).alias("value_sum"),
        F.count_if(price > rules.VERY_HIGH_PRICE_CENTS).alias("very_high_prices"),
        F.count_if((price > rules.HIGH_PRICE_CENTS) & (price <= rules.VERY_HIGH_PRICE_CENTS)).alias("high_prices"),
        F.count_if(described).alias("described_items"),
        F.count_if(described & (price > 0)).alias("priced_items"),
        F.coalesce(F.bit_or(mark_bit(F.col("price"))), F.lit(0)).alias("symbol_bits"),
    )


def repeated_asins(items: DataFrame) -> DataFrame:
    """Products listed in one invoice at more than one price.

    Prices are reduced to distinct values before the product level, so a product
    repeated any number of times costs one row per distinct price.
    """
    prices = (
        items.where(F.coalesce(F.col("asin"), F.lit("")) != "")
        .groupBy("order_id", "asin", item_price().alias("price_cents"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return (
        prices.groupBy("order_id", "asin")
        .agg(
            F.count(F.lit(1)).alias("distinct_prices"),
            F.sum("copies").alias("item_count"),
            F.min("price_cents").alias("lowest_cents"),
            F.max("price_cents").alias("highest_cents"),
        )
        .where(F.col("distinct_prices") > 1)
    )


def repeated_prices(items: DataFrame, position: str = "line_number") -> DataFrame:
    """The prices of each product that one invoice lists at more than one: one row per item, with its price.

    ``distinct_prices`` is the number of prices of the product and ``copies`` the number of items at this one. Items
    meet the products that need them in a join; those of a product are never gathered.
    """
    price = item_price()
    wanted = repeated_asins(items).select("order_id", "asin", "distinct_prices")
    listed_items = items.where(F.coalesce(F.col("asin"), F.lit("")) != "").select(
        "order_id", "asin", price.alias("price_cents"), F.col(position).alias("position"), "description"
    )
    found = listed_items.join(wanted, ["order_id", "asin"])
    copies = found.groupBy("order_id", "asin", "price_cents").agg(F.count(F.lit(1)).alias("copies"))
    return found.join(copies, ["order_id", "asin", "price_cents"]).select(
        "order_id", "asin", "price_cents", "position", "description", "distinct_prices", "copies"
    )


def asin_issue(found: Column) -> Column:
    """Issue row of a product with its number of prices and their range."""
    message = text(
        "Multiple items with same ASIN ", found["asin"], " have ", found["distinct_prices"].cast("string"),
        " different prices: €", two_decimals(found["lowest_cents"]), " to €", two_decimals(found["highest_cents"]),
    )
    return issue(F.lit(True), "error", "duplicate_item_different_prices", "critical", message, ["items"]).row


def asin_issues(items: DataFrame) -> DataFrame:
    row = asin_issue(F.struct("asin", "distinct_prices", "lowest_cents", "highest_cents"))
    return repeated_asins(items).select("order_id", row.alias("issue")).select("order_id", "issue.*")


def price_issue(price: Column) -> Column:
    """Issue row of an item price, null for one that is not high."""
    amount = text("Item price €", two_decimals(price), " is ")
    very_high = issue(
        price > rules.VERY_HIGH_PRICE_CENTS, "error", "price_sanity_check_failed", "critical",
        text(amount, "unrealistically high for a consumer product"), ["items"],
    )
    high = issue(
        price > rules.HIGH_PRICE_CENTS, "warning", "high_price_warning", "medium",
        text(amount, "unusually high for a consumer product"), ["items"],
    )
    return F.coalesce(very_high.row, high.row)


def price_issues(items: DataFrame) -> DataFrame:
    price = item_price()
    return (
        items.where(price > rules.HIGH_PRICE_CENTS)
        .select("order_id", price_issue(price).alias("issue"))
        .select("order_id", "issue.*")
    )


def repeats_subtotal(text_: Column) -> Column:
    """Whether a text prints a subtotal label more than once, as orders of several shipments do."""
    repeated = [text_.rlike(f"(?s){label}.*{label}") for label in rules.SUBTOTAL_LABELS]
    return F.coalesce(reduce(lambda a, b: a | b, repeated), F.lit(False))


def is_complex() -> Column:
    """Several subtotal labels in the text, or a subtotal far above the total."""
    return F.col("several_subtotals") | (F.col("subtotal_cents") > F.col("total_cents") * 2)


def total_rule() -> list[Issue]:
    total, calculated = F.col("total_cents"), F.col("subtotal_cents") + F.col("shipping_cents") + F.col("tax_cents")
    exact = total.cast("double")
    base = F.greatest(exact * rules.TOTAL_TOLERANCE_SHARE, F.lit(float(rules.TOTAL_TOLERANCE_CENTS)))
    complex_order = is_complex()
    tolerance = F.when(
        complex_order, F.greatest(base * rules.COMPLEX_FACTOR, exact * rules.COMPLEX_SHARE)
    ).otherwise(base)
    gap = F.abs(calculated - total)
    tenths = F.floor(gap.cast("double") / exact * 1000.0 + 0.5).cast("bigint")
    percent = F.regexp_replace(F.lpad(tenths.cast("string"), F.greatest(F.length(tenths.cast("string")), F.lit(2)), F.lit("0")), r"(\d)$", ".$1")
    message = text(
        F.when(complex_order, "Complex order: ").otherwise(""),
        "Calculated total (", two_decimals(calculated), ") differs from extracted total (", two_decimals(total),
        ") by ", two_decimals(gap), " (", percent, "%)",
        F.when(complex_order, " (multi-shipment order may have complex pricing)").otherwise(""),
    )
    severity = F.when(complex_order, "low").otherwise("medium")
    wrong = (total > 0) & (gap.cast("double") > tolerance)
    return [issue(wrong, "warning", "mathematical_inconsistency", severity, message, HEADER_MONEY)]


def item_sum_rule() -> list[Issue]:
    gap = F.abs(F.col("price_sum") - F.col("subtotal_cents"))
    message = text(
        "Sum of item prices (", two_decimals(F.col("price_sum")), ") doesn't match subtotal (",
        two_decimals(F.col("subtotal_cents")), ")",
    )
    wrong = (F.col("items") > 0) & (F.col("subtotal_cents") > 0) & (gap > rules.MINOR_TOLERANCE_CENTS)
    return [issue(wrong, "warning", "item_subtotal_mismatch", "low", message, ["items", "subtotal"])]


def item_value_rule() -> list[Issue]:
    subtotal, value = F.col("subtotal_cents"), F.col("value_sum")
    gap = F.abs(value - subtotal)
    checked = (F.col("items") > 0) & (subtotal > 0)
    critical = gap.cast("double") > subtotal.cast("double") * rules.CRITICAL_SHARE
    shown = [two_decimals(value), two_decimals(subtotal), two_decimals(gap)]
    large = text(
        "Item totals (€", shown[0], ") don't match invoice subtotal (€", shown[1], "). Difference: €", shown[2]
    )
    small = text("Minor discrepancy between item totals (€", shown[0], ") and subtotal (€", shown[1], "): €", shown[2])
    fields = ["items", "subtotal"]
    return [
        issue(
            checked & (gap > rules.ITEM_TOLERANCE_CENTS), "error", "item_subtotal_mismatch",
            F.when(critical, "critical").otherwise("high"), large, fields,
        ),
        issue(
            checked & (gap > rules.MINOR_TOLERANCE_CENTS) & (gap <= rules.ITEM_TOLERANCE_CENTS), "warning",
            "item_subtotal_minor_discrepancy", "low", small, fields,
        ),
    ]


def date_rule(as_of: str) -> list[Issue]:
    shown = F.col("order_date")
    missing = F.coalesce(shown, F.lit("")) == ""
    placeholder = shown.contains("undefined") | shown.contains("null")
    year = F.regexp_extract(shown, r"(\d{4})", 1).try_cast("int")
    last_year = F.year(F.date_add(F.lit(as_of).cast("date"), 1)) + 1
    readable = ~missing & ~placeholder
    return [
        issue(missing, "warning", "missing_date", "medium", F.lit("Order date is missing"), ["orderDate"]),
        issue(
            ~missing & placeholder, "error", "invalid_date_format", "high",
            F.lit("Date contains invalid placeholder values"), ["orderDate"],
        ),
        issue(
            readable & (year > last_year), "warning", "future_date", "low",
            text("Order date appears to be in the future: ", shown), ["orderDate"],
        ),
        issue(
            readable & (year < rules.OLDEST_YEAR), "warning", "very_old_date", "low",
            text("Order date appears to be very old: ", shown), ["orderDate"],
        ),
    ]


def currency_rule() -> list[Issue]:
    header = F.array_distinct(F.array_compact(F.array(*[currency_symbol(F.col(name)) for name in HEADER_MONEY])))
    marks = [F.when(F.col("symbol_bits").bitwiseAND(1 << i) > 0, mark) for i, mark in enumerate(CURRENCY_MARKS)]
    item_symbols = F.array_compact(F.array(*marks))
    mixed = F.size(F.array_union(header, item_symbols)) > 1
    found = [
        issue(
            mixed & (F.size(header) > 1), "warning", "inconsistent_invoice_currencies", "medium",
            text("Inconsistent currencies in invoice fields: ", F.array_join(header, ", ")), HEADER_MONEY,
        ),
        issue(
            mixed & (F.size(header) == 1) & (F.size(item_symbols) > 1), "warning", "multiple_currencies", "low",
            F.lit("Items have different currencies but invoice totals are consistent"), ["items"],
        ),
    ]
    for name in HEADER_MONEY:
        shown = F.col(name)
        wrong = (F.coalesce(shown, F.lit("")) != "") & ~is_money_text(shown)
        message = text(f"Invalid currency format in {name}: ", shown)
        found.append(issue(wrong, "warning", "invalid_currency_format", "medium", message, [name]))
    return found


def completeness_rule() -> list[Issue]:
    found = []
    for column, name in (("order_number", "orderNumber"), ("total", "total")):
        missing = F.coalesce(F.col(column), F.lit("")) == ""
        message = F.lit(f"Critical field '{name}' is missing")
        found.append(issue(missing, "error", "missing_critical_field", "high", message, [name]))
    total = F.col("total_cents")
    found += [
        issue(
            (F.col("items") == 0) & (F.col("subtotal_cents") > 0), "warning", "no_items_found", "medium",
            F.lit("No items were extracted from the invoice despite having a subtotal"), ["items"],
        ),
        issue(
            total > rules.HIGH_TOTAL_CENTS, "warning", "high_total_amount", "low",
            text("Total amount is unusually high: ", two_decimals(total)), ["total"],
        ),
        issue(
            (total > 0) & (total < rules.LOW_TOTAL_CENTS), "warning", "low_total_amount", "low",
            text("Total amount is unusually low: ", two_decimals(total)), ["total"],
        ),
    ]
    return found


def with_facts(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Invoices with their amounts in cents and their item facts."""
    several = repeats_subtotal(F.col("raw_text")) if "raw_text" in invoices.columns else F.lit(False)
    facts = with_cents(invoices.withColumn("several_subtotals", several)).join(item_facts(items), "order_id", "left")
    return facts.na.fill(0, FACTS)


def judged(invoices: DataFrame, items: DataFrame, found: list[Issue]) -> DataFrame:
    """Invoices with the issues of the given rules in ``found``."""
    return with_facts(invoices, items).withColumn("found", F.array_compact(F.array(*[i.row for i in found])))


def listed(frame: DataFrame) -> DataFrame:
    return frame.select("order_id", F.explode("found").alias("issue")).select("order_id", "issue.*")


def header_rules(as_of: str) -> list[Issue]:
    return [
        *total_rule(), *item_sum_rule(), *item_value_rule(), *date_rule(as_of), *currency_rule(), *completeness_rule(),
    ]


def issues(invoices: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """All issues, one row each."""
    return (
        listed(judged(invoices, items, header_rules(as_of)))
        .unionByName(asin_issues(items))
        .unionByName(price_issues(items))
    )


def score(invoices: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Score, validity and summary text for every invoice. Rules are only counted, no issue row is built."""
    repeated = repeated_asins(items).groupBy("order_id").agg(F.count(F.lit(1)).alias("repeated"))
    return scored(with_facts(invoices, items).join(repeated, "order_id", "left"), ["order_id"], as_of)


def scored(facts: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """The keys with errors, warnings, score, is_valid and summary, from invoices with their facts and ``repeated``."""
    found = header_rules(as_of)

    def level(name: str) -> Column:
        hits = [F.coalesce(i.condition, F.lit(False)).cast("bigint") for i in found if i.level == name]
        return reduce(lambda a, b: a + b, hits)

    errors = level("error") + F.col("very_high_prices") + F.coalesce("repeated", F.lit(0))
    warnings = level("warning") + F.col("high_prices")
    counted = facts.select(*keys, errors.alias("errors"), warnings.alias("warnings"))
    count = F.col("errors") + F.col("warnings")

    def plural(number: Column, noun: str) -> Column:
        return text(number.cast("string"), f" {noun}", F.when(number > 1, "s").otherwise(""))

    parts = F.concat_ws(
        ", ",
        F.when(F.col("errors") > 0, plural(F.col("errors"), "error")),
        F.when(F.col("warnings") > 0, plural(F.col("warnings"), "warning")),
    )
    penalty = F.col("errors") * rules.ERROR_PENALTY + F.col("warnings") * rules.WARNING_PENALTY
    return counted.select(
        *keys,
        "errors",
        "warnings",
        F.greatest(F.lit(0), F.lit(100) - penalty).cast("bigint").alias("score"),
        (F.col("errors") == 0).alias("is_valid"),
        F.when(count == 0, "All validations passed")
        .otherwise(text(plural(count, "validation issue"), " found: ", parts))
        .alias("summary"),
    )


def present(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)) != "", F.lit(False))


def parser_score(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Second scoring: fixed penalties for missing or malformed fields, not bounded below."""
    facts = invoices.join(item_facts(items), "order_id", "left").na.fill(0, ["items", "described_items"])
    return parser_scored(facts, ["order_id"])


def parser_scored(facts: DataFrame, keys: list[str]) -> DataFrame:
    p = rules.PARSER_PENALTIES
    number = F.col("order_number")
    facts = facts.withColumns({f"{name}_amount": strict_amount(F.col(name)) for name in HEADER_MONEY})
    amounts = {name: F.col(f"{name}_amount") for name in HEADER_MONEY}
    malformed = reduce(
        lambda a, b: a + b, [F.when(present(n) & v.isNull(), 1).otherwise(0) for n, v in amounts.items()]
    )
    undescribed = F.col("items") - F.col("described_items")
    low = F.coalesce(amounts["total"] < amounts["subtotal"] * 0.8, F.lit(False))

    def flag(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    bad_number = flag(present("order_number") & ~number.rlike(rules.ORDER_NUMBER_PATTERN))
    no_number, no_date = flag(~present("order_number")), flag(~present("order_date"))
    no_items, no_total = flag(F.col("items") == 0), flag(~present("total"))
    total_low = flag(low)
    errors = bad_number + undescribed + malformed
    warnings = no_number + no_date + no_items + no_total + total_low
    penalty = (
        bad_number * p["number_format"] + no_number * p["number_missing"] + no_date * p["date_missing"]
        + no_items * p["no_items"] + undescribed * p["item_description"] + malformed * p["amount_format"]
        + no_total * p["total_missing"] + total_low * p["total_low"]
    )
    judged_ = facts.select(
        *keys,
        (F.lit(100) - penalty).cast("bigint").alias("score"),
        errors.cast("bigint").alias("errors"),
        warnings.cast("bigint").alias("warnings"),
    )
    listed_warnings = text(F.col("warnings").cast("string"), " warning(s)")
    summary = (
        F.when(F.col("errors") > 0, text(F.col("errors").cast("string"), " error(s), ", listed_warnings))
        .when(F.col("warnings") > 0, listed_warnings)
        .otherwise("Valid invoice data")
    )
    return judged_.select("*", (F.col("errors") == 0).alias("is_valid"), summary.alias("summary"))


def ladder(value: Column, steps: list[tuple[int, str]]) -> Column:
    chain = F.when(value >= steps[0][0], steps[0][1])
    for bound, name in steps[1:-1]:
        chain = chain.when(value >= bound, name)
    return chain.otherwise(steps[-1][1])


def checklist_a(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Share of the nine fields found, with recommendations.

    Optional columns: ``field_errors`` (map of field to number of errors) lowers
    a found field by 20 points each; ``field_confidence`` (map of field to 0..1)
    grades a field that was not found.
    """
    facts = invoices.join(item_facts(items).select("order_id", "items"), "order_id", "left").na.fill(0, ["items"])
    return checked_a(facts, ["order_id"])


def checked_a(facts: DataFrame, keys: list[str]) -> DataFrame:
    has_errors, has_confidence = "field_errors" in facts.columns, "field_confidence" in facts.columns
    points, missing = [], []
    for name, (critical, _) in rules.CHECKLIST_A.items():
        there = F.col("items") > 0 if name == "items" else F.col(name).isNotNull()
        full = F.lit(100.0)
        if has_errors:
            full = F.greatest(F.lit(0.0), full - F.coalesce(F.col("field_errors")[name], F.lit(0)) * 20.0)
        partial = F.coalesce(F.col("field_confidence")[name] * 100.0, F.lit(0.0)) if has_confidence else F.lit(0.0)
        points.append(F.when(there, full).otherwise(partial))
        if critical:
            missing.append(F.when(~there & (partial <= 0), 1).otherwise(0))
    error_count = (
        F.aggregate(F.map_values(F.coalesce("field_errors", F.create_map().cast("map<string,int>"))), F.lit(0), lambda a, b: a + b)
        if has_errors
        else F.lit(0)
    )
    graded_ = facts.select(
        *keys,
        rounded(reduce(lambda a, b: a + b, points) / F.lit(float(len(points)))).cast("bigint").alias("score"),
        reduce(lambda a, b: a + b, missing).cast("bigint").alias("critical_missing"),
        error_count.cast("bigint").alias("error_count"),
    )
    advice = F.array_compact(
        F.array(
            F.when(F.col("critical_missing") > 0, "manual_entry"),
            F.when(F.col("score") < 60, "reupload"),
            F.when(F.col("error_count") > 0, "review_data"),
        )
    )
    return graded_.select(
        *keys,
        "score",
        ladder(F.col("score"), rules.STATUS_A).alias("status"),
        "critical_missing",
        F.lit(len(rules.CHECKLIST_A)).cast("bigint").alias("total_fields"),
        F.array_join(advice, ", ").alias("actions"),
    )


def assessed_money(name: str) -> Column:
    value = F.col(f"{name}_amount")
    return (
        F.when(F.coalesce(F.col(name), F.lit("")) == "", graded("missing", 0))
        .when(value.isNull(), graded("invalid", 10))
        .when(value < 0, graded("invalid", 20))
        .when(value > 1000000, graded("extracted", 60))
        .otherwise(graded("extracted", 95))
    )


def graded(status: str, confidence: int | Column) -> Column:
    level = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(F.lit(status).alias("status"), level.cast("int").alias("confidence"))


def field_assessments(as_of: str) -> dict[str, Column]:
    number, shown, currency = F.col("order_number"), F.col("order_date"), F.col("currency")
    day = F.try_to_date(shown)
    plausible = (F.year(day) >= 2020) & (day <= F.date_add(F.lit(as_of).cast("date"), 1))
    share = rounded(F.col("described_items").cast("double") / F.col("items").cast("double") * 100.0)
    return {
        "orderNumber": F.when(~present("order_number"), graded("missing", 0))
        .when(number.rlike(rules.ORDER_NUMBER_PATTERN), graded("extracted", 100))
        .otherwise(graded("invalid", 30)),
        "orderDate": F.when(~present("order_date"), graded("missing", 0))
        .when(day.isNull(), graded("invalid", 10))
        .when(plausible, graded("extracted", 95))
        .otherwise(graded("extracted", 60)),
        "items": F.when(F.col("items") == 0, graded("missing", 0))
        .when(F.col("described_items") > 0, graded("extracted", share))
        .otherwise(graded("invalid", 10)),
        **{name: assessed_money(name) for name in ("subtotal", "shipping", "tax", "discount", "total")},
        "currency": F.when(~present("currency"), graded("missing", 0))
        .when(F.upper(currency).isin(rules.KNOWN_CURRENCIES), graded("extracted", 100))
        .otherwise(graded("extracted", 70)),
    }


def checklist_b(invoices: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Weighted field assessment with status and recommendations."""
    facts = invoices.join(item_facts(items), "order_id", "left").na.fill(0, ["items", "described_items"])
    return checked_b(facts, ["order_id"], as_of)


def checked_b(facts: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    money = ("subtotal", "shipping", "tax", "discount", "total")
    facts = facts.withColumns({f"{name}_amount": strict_amount(F.col(name)) for name in money})
    assessed = field_assessments(as_of)
    ordered = list(rules.CHECKLIST_B)
    fields = facts.select(*keys, F.struct(*[assessed[name].alias(name) for name in ordered]).alias("assessed"))

    def status(name: str) -> Column:
        return F.col("assessed")[name]["status"]

    def confidence(name: str) -> Column:
        return F.col("assessed")[name]["confidence"]

    left = F.lit(100.0)
    for name, (critical, _) in rules.CHECKLIST_B.items():
        weight, cost = (1.0, 10.0) if critical else (0.5, 5.0)
        left = left - (F.lit(1.0) - confidence(name).cast("double") / 100.0 * weight) * cost
    critical = [name for name, (is_critical, _) in rules.CHECKLIST_B.items() if is_critical]
    financial = [name for name, (_, category) in rules.CHECKLIST_B.items() if category == "financial"]

    def total_of(flags: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.when(flag, 1).otherwise(0) for flag in flags]).cast("bigint")

    manual = F.concat_ws(", ", *[F.when((status(n) == "missing") | (confidence(n) < 50), n) for n in critical])
    unsure = F.concat_ws(", ", *[F.when((confidence(n) < 80) & (status(n) == "extracted"), n) for n in financial])
    graded_ = fields.withColumns(
        {
            "score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), rounded(left))).cast("bigint"),
            "critical_missing": total_of([status(n) == "missing" for n in critical]),
            "extracted_fields": total_of([status(n) != "missing" for n in ordered]),
            "manual": manual,
            "unsure": unsure,
        }
    ).withColumn("status", ladder(F.col("score"), rules.STATUS_B))
    advice = F.concat_ws(
        " | ",
        F.when(F.col("manual") != "", text("Manual data entry required for critical fields: ", F.col("manual"))),
        F.when(F.col("unsure") != "", text("Verify financial calculations for: ", F.col("unsure"))),
        F.when(F.col("status") == "critical", "This invoice has significant parsing issues. Consider manual processing.")
        .when(F.col("status") == "poor", "This invoice has parsing quality issues. Review extracted data carefully."),
        F.when(status("orderDate") == "missing", "Order date is missing. Check invoice header or footer for date information."),
        F.when(status("total") == "missing", "Total amount is missing. Sum of subtotal, tax, and shipping may be needed."),
        F.when(
            (confidence("items") < 70) & (status("items") == "extracted"),
            "Item descriptions may be incomplete. Verify item details manually.",
        ),
    )
    return graded_.select(*keys, "score", "status", "critical_missing", "extracted_fields", advice.alias("recommendations"))


RECOVERED_FIELDS = ["order_number", "order_date", "subtotal", "shipping", "tax", "total"]


def recovery(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """How much of a failed extraction is usable, by both measures in use."""
    facts = invoices.join(item_facts(items).select("order_id", "items"), "order_id", "left").na.fill(0, ["items"])
    there = {name: present(name) for name in RECOVERED_FIELDS} | {"items": F.col("items") > 0}
    found = reduce(lambda a, b: a + b, [F.when(flag, 1).otherwise(0) for flag in there.values()])
    share = found.cast("double") / F.lit(float(len(there)))
    with_vendor = (found + 1).cast("double") / F.lit(float(len(there) + 1))
    return facts.select(
        "order_id",
        found.cast("bigint").alias("found_fields"),
        share.alias("overall_confidence"),
        (there["order_number"] & there["order_date"] & (share > 0.3)).alias("usable"),
        (with_vendor >= 0.4).alias("usable_by_share"),
    )


def error_class() -> Column:
    """Class of an error from ``error`` and ``context``; the first rule that applies wins."""
    message, context = F.lower(F.coalesce("error", F.lit(""))), F.coalesce("context", F.lit(""))
    chain = None
    for words, context_words, exact, level, kind, recoverable, suggestion in rules.ERROR_CLASSES:
        hits = [message.contains(w) for w in words] + [context.contains(w) for w in context_words]
        if exact is not None:
            hits.append(context == exact)
        verdict = F.struct(
            F.lit(level).alias("level"),
            F.lit(kind).alias("type"),
            F.lit(recoverable).alias("recoverable"),
            F.lit(suggestion).alias("suggestion"),
        )
        if not hits:
            return chain.otherwise(verdict)
        condition = reduce(lambda a, b: a | b, hits)
        chain = F.when(condition, verdict) if chain is None else chain.when(condition, verdict)
    return chain


def classified_errors(errors: DataFrame) -> DataFrame:
    return errors.withColumn("class", error_class()).select("*", "class.*").drop("class")


def recovery_actions(errors: DataFrame) -> DataFrame:
    """Suggested actions in order, for classified errors with ``usable`` and ``overall_confidence``."""

    def entry(action: str, description: str, priority: str) -> Column:
        return F.struct(
            F.lit(action).alias("action"), F.lit(description).alias("description"), F.lit(priority).alias("priority")
        )

    def listed_for(rows: list[tuple]) -> Column:
        return F.array(*[F.when(F.col("usable") if needs else F.lit(True), entry(a, d, p)) for a, d, p, needs in rows])

    steps = F.when(F.lit(False), F.array(F.lit(None).cast("struct<action:string,description:string,priority:string>")))
    for kind, rows in rules.RECOVERY_ACTIONS.items():
        if kind != "other":
            steps = steps.when(F.col("type") == kind, listed_for(rows))
    steps = steps.otherwise(listed_for(rules.RECOVERY_ACTIONS["other"]))
    first = None
    for bound, *words in rules.CONFIDENCE_ACTIONS:
        hit = F.col("overall_confidence") > bound
        first = F.when(hit, entry(*words)) if first is None else first.when(hit, entry(*words))
    actions = F.array_compact(F.concat(F.array(first), steps))
    return errors.select("*", F.posexplode(actions).alias("position", "step")).select(
        *errors.columns, (F.col("position") + 1).alias("position"), "step.*"
    )


def first_actions(actions: DataFrame, k: int = 2) -> DataFrame:
    return actions.where(F.col("position") <= k)


def extraction_metrics(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Seven field flags per invoice, their share, and item detail counts."""
    facts = invoices.join(item_facts(items), "order_id", "left").na.fill(0, ["items", "described_items", "priced_items"])
    return measured(facts, ["order_id"])


def measured(facts: DataFrame, keys: list[str]) -> DataFrame:
    flags = {name: present(name) for name in ("order_number", "order_date", "subtotal", "tax", "shipping", "total")}
    flags["items"] = F.col("items") > 0
    found = reduce(lambda a, b: a + b, [F.when(flag, 1).otherwise(0) for flag in flags.values()])
    return facts.select(
        *keys,
        *[flag.alias(f"has_{name}") for name, flag in flags.items()],
        (found.cast("double") / F.lit(float(len(flags)))).alias("overall"),
        F.col("items").alias("total_items"),
        F.col("priced_items").alias("items_with_prices"),
        F.col("described_items").alias("items_with_descriptions"),
    )


def schema_rejects(rows: DataFrame) -> DataFrame:
    """Reasons why rows do not fit the invoice schema, null reason for those that do."""
    number = F.col("order_number")
    reasons = F.concat_ws(
        "; ",
        F.when(number.isNotNull() & ~number.rlike(rules.ORDER_NUMBER_PATTERN), "orderNumber pattern"),
        F.when(F.col("quantity").isNotNull() & (F.coalesce(F.col("quantity").try_cast("int"), F.lit(0)) < 1), "quantity integer >= 1"),
        F.when(F.col("unit_price").isNotNull() & (F.coalesce(F.col("unit_price").try_cast("double"), F.lit(-1.0)) < 0), "unitPrice number >= 0"),
        F.when(F.col("description").isNull(), "description required"),
        F.when(F.col("vat_rate").isNotNull() & ~F.coalesce(F.col("vat_rate").try_cast("double"), F.lit(-1.0)).between(0, 100), "vatRate 0..100"),
        F.when(F.col("severity").isNotNull() & ~F.col("severity").isin("low", "medium", "high", "critical"), "severity enum"),
    )
    return rows.select("*", F.nullif(reasons, F.lit("")).alias("reason"))
