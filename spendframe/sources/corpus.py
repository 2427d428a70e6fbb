"""Invoice texts rendered from the star-schema tables, for round-trip checks of extraction.

One document per order, in a layout per region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.functions.dates import MONTHS
from spendframe.functions.money import european_amount, grouped_decimals, two_decimals
from spendframe.functions.plans import spread
from spendframe.operators.reports import month_name
from spendframe.sources import star

# Rule set of each region's layout.
REGION_RULE_SET = {
    "AMERICA": "us",
    "EUROPE": "eu_consumer",
    "AFRICA": "uk",
    "ASIA": "japanese",
    "MIDDLE EAST": "swiss",
}

TAX_PERCENT = 19


def dotted_amount(cents: Column) -> Column:
    """Cents as ``1.234,50 €``."""
    return F.regexp_replace(european_amount(cents), r"(\d)(?=(\d{3})+,)", "$1.")


def yen(cents: Column) -> Column:
    return F.concat(F.lit("¥"), F.regexp_replace(cents.cast("string"), r"\B(?=(\d{3})+$)", ","))


def dollars(cents: Column) -> Column:
    return F.concat(F.lit("$"), two_decimals(cents))


def pounds(cents: Column) -> Column:
    return F.concat(F.lit("£"), grouped_decimals(cents))


def francs(cents: Column) -> Column:
    return F.concat(F.lit("CHF "), two_decimals(cents))


def per_region(options: dict[str, Column]) -> Column:
    chain = None
    for region, value in options.items():
        hit = F.col("region") == region
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def net_of(unit: Column) -> Column:
    """Price without tax of a price with tax."""
    return F.floor(unit.cast("double") * 100.0 / F.lit(100.0 + TAX_PERCENT) + 0.5).cast("bigint")


def item_text() -> Column:
    """Lines of one item in the layout of its region."""
    unit, count, words = F.col("unit_cents"), F.col("quantity").cast("string"), F.col("description")
    net = european_amount(net_of(unit))

    def gross(cents: Column) -> Column:
        """Every other order has dots between thousands."""
        return F.when(F.col("order_id") % 2 == 0, dotted_amount(cents)).otherwise(european_amount(cents))

    return per_region(
        {
            "AMERICA": F.concat(count, F.lit(" of: "), words, F.lit("\n"), dollars(unit)),
            "EUROPE": F.concat(
                words, F.lit("\nASIN: "), F.col("asin"), F.lit("\n"), net, F.lit(f"\n{TAX_PERCENT}%\n"),
                gross(unit), gross(unit * F.col("quantity")),
            ),
            "AFRICA": F.concat(count, F.lit(" x "), words, F.lit(" "), pounds(unit)),
            "ASIA": F.concat(count, F.lit(" × "), words, F.lit(" "), yen(unit)),
            "MIDDLE EAST": F.concat(count, F.lit(" x "), words, F.lit(" "), francs(unit)),
        }
    )


def invoice_text(item_lines: Column) -> Column:
    """Whole document around the item lines."""
    number, day = F.col("order_number"), F.col("printed_date")
    year, month, date = F.year(day).cast("string"), F.month(day), F.dayofmonth(day).cast("string")
    english = F.concat(month_name(month), F.lit(" "), date, F.lit(", "), year)
    dotted = F.concat(date, F.lit("."), month.cast("string"), F.lit("."), year)
    slashed = F.concat(date, F.lit("/"), month.cast("string"), F.lit("/"), year)
    subtotal, shipping, tax, total = (F.col(f"{n}_cents") for n in ("subtotal", "shipping", "tax", "total"))
    # Some orders are sent in two parts, and the page of the second repeats the label.
    second = F.concat(F.lit("Second shipment\nItem(s) Subtotal: "), dollars(subtotal), F.lit("\n"))
    second_part = F.when(F.col("order_id") % 6 == 1, second).otherwise("")

    def page(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    items = F.when(item_lines != "", F.concat(item_lines, F.lit("\n"))).otherwise("")
    return per_region(
        {
            "AMERICA": page(
                "Amazon.com Order Confirmation\nOrder #", number, "\nOrder Placed: ", english, "\nItems Ordered\n", items,
                "Item(s) Subtotal: ", dollars(subtotal), "\nShipping: ", dollars(shipping), "\nSales Tax: ", dollars(tax),
                "\nGrand Total: ", dollars(total), "\n", second_part,
            ),
            "EUROPE": page(
                "amazon.de\nBestellnummer ", number, "\nBestelldatum ", dotted, "\n", items,
                "Versandkosten ", european_amount(shipping), "\nGesamtpreis ", european_amount(F.col("gross_sum") + shipping), "\n",
            ),
            "AFRICA": page(
                "Order Number: ", number, "\nOrder Date: ", slashed, "\n", items, "Subtotal: ", pounds(subtotal),
                "\nPostage: ", pounds(shipping), "\nVAT: ", pounds(tax), "\nGrand Total: ", pounds(total), "\n",
            ),
            "ASIA": page(
                "注文番号: ", number, "\n注文日: ", year, "年", month.cast("string"), "月", date, "日\n", items,
                "小計: ", yen(subtotal), "\n配送料: ", yen(shipping), "\n消費税: ", yen(tax), "\n合計: ", yen(total), "\n",
            ),
            "MIDDLE EAST": page(
                "Bestellnummer: ", number, "\nDatum: ", dotted, "\n", items, "Zwischensumme: ", francs(subtotal),
                "\nVersand: ", francs(shipping), "\nMwSt: ", francs(tax), "\nGesamtbetrag: ", francs(total), "\n",
            ),
        }
    )


def listed_lines(line: Column) -> Column:
    """The lines of an order with what orders them, in one flat struct: a struct within it is compared far more slowly."""
    return F.collect_list(F.struct(*star.ITEM_ORDER, line.alias("text")))


def texts_in_order(lines: Column) -> Column:
    return F.transform(F.sort_array(lines), lambda row: row["text"])


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``doc_id``, ``order_id``, ``region``, ``layout`` and ``text``."""
    invoices = star.invoices(spark, sf_dir).withColumn("printed_date", F.col("order_date"))
    lines = star.items(spark, sf_dir).join(star.order_owners(spark, sf_dir).select("order_id", "region"), "order_id")
    documents = lines.groupBy("order_id").agg(
        listed_lines(item_text()).alias("lines"),
        F.sum(F.col("unit_cents") * F.col("quantity")).alias("gross_sum"),
    )
    joined = spread(invoices.join(documents, "order_id", "left").na.fill(0, ["gross_sum"]), "order_id")
    empty = F.array().cast("array<string>")
    in_order = F.coalesce(texts_in_order(F.col("lines")), empty)
    return joined.select(
        F.col("order_id").cast("string").alias("doc_id"),
        "order_id",
        "region",
        star.lookup(F.col("region"), REGION_RULE_SET).alias("layout"),
        invoice_text(F.array_join(in_order, "\n")).alias("text"),
    )


def scanned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """European consumer documents of all orders; in every third one the scan has lost the space behind the quantity.

    Another third shows no tax rate. Columns are price without tax, rate, price with tax and total.
    """
    invoices = star.invoices(spark, sf_dir)
    unit, quantity, turn = F.col("unit_cents"), F.col("quantity"), F.col("order_id") % 3
    total = unit * quantity
    merged = F.when(turn == 0, quantity.cast("string")).otherwise("")
    rate = F.when(turn == 1, "").otherwise(f"{TAX_PERCENT}%\n")
    lines = F.concat(
        F.col("description"), F.lit("\nASIN: "), F.col("asin"), F.lit("\n"), merged, european_amount(net_of(unit)), F.lit("\n"),
        rate, european_amount(unit), european_amount(total),
    )
    documents = star.items(spark, sf_dir).groupBy("order_id").agg(
        F.array_join(texts_in_order(listed_lines(lines)), "\n").alias("lines"),
        F.sum(total).alias("goods"),
    )
    joined = spread(invoices.join(documents, "order_id"), "order_id")
    page = F.concat(
        F.lit("amazon.de\nBestellnummer "), F.col("order_number"), F.lit("\n"), F.col("lines"), F.lit("\nVersandkosten "),
        european_amount(F.col("shipping_cents")), F.lit("\nGesamtpreis "), european_amount(F.col("goods") + F.col("shipping_cents")), F.lit("\n"),
    )
    return joined.select("order_id", F.col("order_id").cast("string").alias("doc_id"), page.alias("text"))


def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order in a form that no market uses: no order number, amounts with codes or strange labels.

    Orders take turns: counted items with the price below and pound codes, counted items with pounds in front, items
    with a bar and euros under labels of three languages, and counted items with dollar codes.
    """
    invoices = star.invoices(spark, sf_dir)
    turn, unit, words = F.col("order_id") % 4, F.col("unit_cents"), F.col("description")
    count = F.col("quantity").cast("string")
    line = (
        F.when(turn == 1, F.concat(count, F.lit(" x "), words, F.lit(" £"), two_decimals(unit)))
        .when(turn == 2, F.concat(words, F.lit(" | "), european_amount(unit)))
        .otherwise(F.concat(count, F.lit(" of: "), words, F.lit("\nCondition: New\n"), two_decimals(unit)))
    )
    listed = star.items(spark, sf_dir).groupBy("order_id").agg(
        F.array_join(texts_in_order(listed_lines(line)), "\n").alias("lines")
    )
    joined = spread(invoices.join(listed, "order_id", "left"), "order_id")

    def amount(name: str, style: str) -> Column:
        cents = F.col(f"{name}_cents")
        return european_amount(cents) if style == "€" else F.concat(F.lit(style), two_decimals(cents))

    def page(heading: str, labels: list[str], style: str, closing: str = "") -> Column:
        parts = [F.lit(heading + "\n"), F.coalesce("lines", F.lit("")), F.lit("\n" + closing)]
        for label, name in zip(labels, ("subtotal", "shipping", "tax", "total"), strict=True):
            parts += [F.lit(label + ": "), amount(name, style), F.lit("\n")]
        return F.concat(*parts)

    english = ["Subtotal", "Shipping", "Tax", "Grand Total"]
    text = (
        F.when(turn == 0, page("Items Ordered", english, "GBP "))
        .when(turn == 1, page("Items Ordered", english, "£"))
        .when(turn == 2, page("Order Confirmation", ["Teilsumme", "Frais de port", "Mehrwertsteuer", "Gesamt"], "€", "Zahlung erhalten\n"))
        .otherwise(page("Items Ordered", english, "USD "))
    )
    return joined.select("order_id", F.col("order_id").cast("string").alias("doc_id"), text.alias("text"))


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per order as a parser would store it, with faults at fixed keys and some texts cut short."""
    invoices, order = star.invoices(spark, sf_dir), F.col("order_id")
    part, quantity = F.col("part_key"), F.col("quantity").cast("string")

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), text, F.lit('"'))

    count = (
        F.when(part % 29 == 0, "2.5")
        .when((part % 5 == 0) & (part % 2 == 0), '"0"')
        .when(part % 5 == 0, '"many"')
        .when(part % 3 == 0, quoted(quantity))
        .otherwise(quantity)
    )
    described = F.when(part % 101 == 0, "null").otherwise(quoted(F.col("description")))
    unit = F.when(part % 7 == 0, "-1").otherwise(two_decimals(F.col("unit_cents")))
    line = F.concat(
        F.lit("{"), member("description", described), F.lit(","), member("quantity", count), F.lit(","), member("unitPrice", unit), F.lit(","),
        member("asin", quoted(F.col("asin"))), F.lit(',"note":"left out"}'),
    )
    listed = star.items(spark, sf_dir).groupBy("order_id").agg(
        F.array_join(texts_in_order(listed_lines(line)), ",").alias("lines")
    )
    number = F.when(order % 11 == 0, '"bad"').when(order % 37 == 0, "null").otherwise(quoted(F.col("order_number")))
    subtotal = F.when(order % 13 == 0, two_decimals(F.col("subtotal_cents"))).otherwise(quoted(dollars(F.col("subtotal_cents"))))
    vendor = F.when(order % 7 == 3, "").otherwise(F.concat(F.lit(","), member("vendor", quoted(F.col("vendor")))))
    items = F.when(F.col("lines").isNull(), "").otherwise(F.concat(F.lit(',"items":['), F.col("lines"), F.lit("]")))
    language = F.when(order % 19 == 0, "").otherwise('"language":"EN",')
    confidence = F.when(order % 17 == 0, "1.5").otherwise("0.9")
    detected = F.concat(F.lit(',"languageDetection":{'), language, member("confidence", confidence), F.lit(',"evidence":"words","supported":true}'))
    text = F.concat(F.lit("{"), member("orderNumber", number), F.lit(","), member("subtotal", subtotal), vendor, items, detected, F.lit(',"_rawText":"x"}'))
    cut = F.when(order % 23 == 0, F.substring(text, 1, 30)).otherwise(text)
    joined = spread(invoices.join(listed, "order_id", "left"), "order_id")
    return joined.select("order_id", cut.alias("json"))


def listed_texts(spark: SparkSession, sf_dir: str, line: Column, head: Column) -> DataFrame:
    """One text per order that has items: a head and the lines of its items in order."""
    lines = star.items(spark, sf_dir).groupBy("order_id").agg(
        F.array_join(texts_in_order(listed_lines(line)), "\n").alias("lines")
    )
    joined = spread(star.invoices(spark, sf_dir).join(lines, "order_id"), "order_id")
    return joined.select("order_id", F.col("order_id").cast("string").alias("doc_id"), F.concat(head, F.lit("\n"), "lines").alias("text"))


# Put behind descriptions that are told from other lines by their length.
LONG_TAIL = " mit Zubehoer und Tragetasche"


def business_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """European business documents; the orders take turns over the five layouts of their tables."""
    unit, count, words = F.col("unit_cents"), F.col("quantity").cast("string"), F.concat("description", F.lit(LONG_TAIL))
    turn, code = F.col("order_id") % 5, F.concat(F.lit("ASIN: "), F.col("asin"))

    def shown(cents: Column) -> Column:
        """Every other order has dots between thousands."""
        return F.when(F.col("order_id") % 2 == 0, dotted_amount(cents)).otherwise(european_amount(cents))

    price, total = shown(unit), shown(unit * F.col("quantity"))

    def row(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    line = (
        F.when(turn == 0, row(words, "\n", code, "\n", count, european_amount(unit), "\n0%\n(1)\n", price, total))
        .when(turn == 1, row("| ", words, " | ", count, " | ", price, " | 0% | ", price, " | ", total, " |\n", code))
        .when(turn == 2, row(words, " ", count, " ", price, " 0% (1) ", price, " ", total, "\n", code))
        .when(turn == 3, row(words, "\n", code, "\n", price, "\n", price, total))
        .otherwise(row(words, "\n", code, "\nx (", count, ")\n", price, " ", total))
    )
    head = F.concat(F.lit("amazon.de\nFirma Muster GmbH\nBestellnummer\n"), "order_number")
    return listed_texts(spark, sf_dir, line, head)


def language_item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German and English item lines in the six forms their rule sets know, with the rule set of each text."""
    unit, count, words = F.col("unit_cents"), F.col("quantity").cast("string"), F.col("description")
    turn, code, price = F.col("order_id") % 6, F.concat(F.lit("\nASIN: "), F.col("asin"), F.lit("\n")), european_amount(unit)
    line = (
        F.when(turn == 0, F.concat(words, code, price, F.lit("0%"), price, price))
        .when(turn == 1, F.concat(count, F.lit(" x "), words, F.lit(" "), price))
        .when(turn == 2, F.concat(words, F.lit(" | "), price))
        .when(turn == 3, F.concat(words, code, count, F.lit(" x "), dollars(unit)))
        .when(turn == 4, F.concat(count, F.lit(" of: "), words, F.lit("\nSold by: somebody\n"), dollars(unit)))
        .otherwise(F.concat(count, F.lit(" x "), words, F.lit(" "), dollars(unit)))
    )
    texts = listed_texts(spark, sf_dir, line, F.concat(F.lit("No. "), "order_number"))
    return texts.select("order_id", "doc_id", F.when(turn < 3, "german").otherwise("english").alias("rule_set"), F.col("text").alias("clean_text"))


# Header layout of each language rule set: labels of number, date,
# subtotal, shipping, tax, discount (empty where the market has none) and total,
# how dates and amounts are written.
LANGUAGE_LAYOUTS = {
    "german": ("Bestellnummer: ", "Bestelldatum: ", "Zwischensumme: ", "Versand: ", "MwSt: ", "Rabatt: ", "Gesamtbetrag: ", "de", "euro"),
    "french": ("Numéro de commande: ", "Date de commande: ", "Sous-total: ", "Livraison: ", "TVA: ", "Remise: ", "Total TTC: ", "fr", "euro"),
    "spanish": ("Número de pedido: ", "Fecha del pedido: ", "Subtotal: ", "Envío: ", "IVA 21% ", "Descuento: ", "Total: ", "es", "euro"),
    "italian": ("Numero d'ordine: ", "Data dell'ordine: ", "Subtotale: ", "Spedizione: ", "IVA: ", "Sconto: ", "Totale: ", "it", "euro_front"),
    "english": ("Order Number: ", "Order Date: ", "Subtotal: ", "Shipping: ", "Tax: ", "Discount: ", "Grand Total: ", "en", "dollar"),
    "australian": ("Order Number: ", "Order Placed: ", "Subtotal: ", "Postage: ", "GST: ", "", "Grand Total: ", "en", "grouped"),
    "canadian_french": ("Commande ", "Date de commande: ", "Sous-total: ", "Livraison: ", "TPS: ", "", "Total: ", "fr", "comma"),
    "eu_business": ("Bestellnummer ", "Bestelldatum ", "Zwischensumme ", "Versand ", "MwSt ", "Rabatt ", "Gesamtbetrag ", "dotted", "euro"),
}


def language_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header text per order, the rule sets taking turns over the order keys."""
    invoices = star.invoices(spark, sf_dir)
    day = F.col("order_date")
    year, month, number = F.year(day).cast("string"), F.month(day), F.dayofmonth(day).cast("string")

    def date_in(style: str) -> Column:
        if style == "dotted":
            return F.concat(number, F.lit("."), month.cast("string"), F.lit("."), year)
        name = F.element_at(F.array(*[F.lit(m) for m in MONTHS[style]]), month)
        if style == "en":
            return F.concat(F.initcap(name), F.lit(" "), number, F.lit(", "), year)
        return F.concat(number, F.lit(". " if style == "de" else " "), name, F.lit(" "), year)

    def amount_in(style: str, cents: Column) -> Column:
        plain = two_decimals(cents)
        comma = F.replace(plain, F.lit("."), F.lit(","))
        return {
            "euro": european_amount(cents),
            "euro_front": F.concat(F.lit("€ "), comma),
            "dollar": F.concat(F.lit("$"), plain),
            "grouped": F.concat(F.lit("$"), grouped_decimals(cents)),
            "comma": F.concat(F.lit("$ "), comma),
        }[style]

    turn, text, layout = F.col("order_id") % len(LANGUAGE_LAYOUTS), None, None
    for place, (name, (order, date, *labels, date_style, style)) in enumerate(LANGUAGE_LAYOUTS.items()):
        lines = [F.lit(order), F.col("order_number"), F.lit("\n" + date), date_in(date_style)]
        for label, field in zip(labels, ("subtotal", "shipping", "tax", "discount", "total")):
            if label:
                lines += [F.lit("\n" + label), amount_in(style, F.col(f"{field}_cents"))]
        page = F.concat(*lines)
        text = F.when(turn == place, page) if text is None else text.when(turn == place, page)
        layout = F.when(turn == place, name) if layout is None else layout.when(turn == place, name)
    return invoices.select(F.col("order_id").alias("doc_id"), layout.alias("rule_set"), text.alias("clean_text"))
