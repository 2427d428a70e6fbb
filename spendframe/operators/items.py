"""Line items of a document, as an array built inside its row.

A document is one row, so looking a few lines ahead or back is done on its own
array of lines. Exploding the lines and ranking them in a window would shuffle
the whole corpus and put every line of a long document through one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.arrays import after, before, first, found, integer, last, let
from spendframe.functions.money import tolerant_amount, to_cents
from spendframe.functions.plans import held
from spendframe.rules.fields import RuleSet

# ``amounts``, ``vat_percent`` and ``repair`` are what a European price block shows, and why a price is not taken as shown.
ITEM = (
    "struct<asin:string,description:string,quantity:int,unit_cents:bigint,total_cents:bigint,price:string,"
    "amounts:array<bigint>,vat_percent:int,repair:string>"
)
ITEMS = f"array<{ITEM}>"
ITEM_FIELDS = ["asin", "description", "quantity", "unit_cents", "total_cents", "price"]

# Distances in lines.
PRICE_LOOKAHEAD = 4
DESCRIPTION_LOOKBACK = 10
BULK_LOOKAHEAD = 9
BLOCK_LINES = 6
SHORTEST_DESCRIPTION = 10

# Patterns of item lines.
ASIN_LINE = r"(?i)ASIN:\s*([A-Z0-9]+)"
ASIN_CODE = r"ASIN:\s*([A-Z0-9]{10})"
FULL_EURO_PRICE = r"([\d.,]+)\s*€(\d+)%([\d.,]+)\s*€([\d.,]+)\s*€"
# Amounts with or without dots between thousands; never the tail of a longer number.
EURO_DIGITS = r"(\d{1,3}(?:\.\d{3})+,\d{2}|\d+,\d{2})"
EURO_AMOUNT = rf"(?<!\d)(?<!\d\.){EURO_DIGITS}\s*€"
US_ITEM = r"(\d+)\s+of:\s*([^$]+?)\s*\$(\d+\.?\d*)"

# Corruption limits of scanned European prices, in cents, for lines whose arithmetic does not hold.
MERGED_PRICE_CENTS = 200_000
REALISTIC_PRICE_CENTS = 100_000
SUSPICIOUS_RATIO = 3
SUBTOTAL_RATIO = 2

# Words of table headers, and the largest quantity that is taken from prices (a parameter of the readers).
HEADER_WORDS = r"(?iu)\b(Bestellung|Artikel|Produkt|Summe|Total|Gesamt|Commande|Article|Produit|Somme|Facture)\b"
COLUMN_WORDS = r"(?iu)(Bestellung|Artikel|Produkt|Summe|Total|Menge|Stückpreis)"
COLUMN_START = r"(?iu)^(Description|Qté|Prix|Unitaire|Taux|TVA|Total|TTC|HT)"
MAX_QUANTITY = 100
QUANTITY_TOLERANCE_CENTS = 10


def item(
    description: Column,
    quantity: Column,
    unit: Column,
    total: Column,
    price: Column | None = None,
    asin: Column | None = None,
    amounts: Column | None = None,
    vat_percent: Column | None = None,
    repair: Column | None = None,
) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (none if asin is None else asin).alias("asin"),
        description.alias("description"),
        quantity.cast("int").alias("quantity"),
        unit.cast("bigint").alias("unit_cents"),
        total.cast("bigint").alias("total_cents"),
        (none if price is None else price).alias("price"),
        (F.lit(None).cast("array<bigint>") if amounts is None else amounts).alias("amounts"),
        (F.lit(None).cast("int") if vat_percent is None else vat_percent).alias("vat_percent"),
        (none if repair is None else repair).alias("repair"),
    ).cast(ITEM)


def trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda line: F.trim(line))


def amount_cents(text: Column) -> Column:
    """Cents of a money text; the text is found once, not for each test of its form."""
    return let(text, lambda shown: to_cents(tolerant_amount(shown)))


def comma_cents(text: Column) -> Column:
    """Cents of an amount like 12,34 or 1.012,34."""
    return integer(F.translate(text, ",.", ""), "bigint")


# --- "N of: description $price" anywhere in the text -------------------------------------------------------------


def us_items(text: Column) -> Column:
    def groups(number: int) -> Column:
        return F.regexp_extract_all(text, F.lit(US_ITEM), F.lit(number))

    rows = F.arrays_zip(groups(1).alias("n"), groups(2).alias("d"), groups(3).alias("p"))

    def build(row: Column) -> Column:
        quantity, unit = row["n"].try_cast("int"), to_cents(row["p"].try_cast("double"))
        return item(F.trim(row["d"]), quantity, unit, unit * quantity, F.concat(F.lit("$"), row["p"]))

    return F.transform(rows, build)


# --- one item per line -------------------------------------------------------------------------------------------


def is_summary(description: Column, rule_set: RuleSet) -> Column:
    hit = F.lit(False)
    for words in rule_set.summary_words:
        hit = hit | description.rlike(f"(?iu){words}")
    return hit


def counted_line(line: Column, rule_set: RuleSet) -> Column:
    """Item of a line like ``2 x description price`` or ``description price``."""
    marks = "|".join(rule_set.item_counts)
    counted = rf"(?iu)^(\d+)\s*(?:{marks})\s+(.+?)\s+{rule_set.item_amount}"
    plain = rf"(?iu)^(.+?)\s+{rule_set.item_amount}"

    def tidy(value: Column) -> Column:
        return F.trim(F.regexp_replace(value, r"\s+", " "))

    def priced(value: Column) -> Column:
        if rule_set.currency != "CAD":
            return value
        return F.concat(F.lit("$"), F.regexp_replace(value, r"[$\s]", ""))

    def build(pattern: str, at: int, quantity: Column) -> Column:
        def described(words: Column) -> Column:
            return F.when(words.isNotNull() & ~is_summary(words, rule_set), let(priced(found(line, pattern, at + 1)), lambda price: costed(words, price)))

        def costed(words: Column, price: Column) -> Column:
            seen = F.struct(amount_cents(price).alias("unit"), quantity.alias("quantity"))
            return let(seen, lambda s: item(words, s["quantity"], s["unit"], F.coalesce(s["unit"] * s["quantity"], s["unit"]), price))

        return let(tidy(found(line, pattern, at)), described)

    return F.coalesce(
        build(counted, 2, integer(F.regexp_extract(line, counted, 1))), build(plain, 1, F.lit(None).cast("int"))
    )


def line_items(text: Column, rule_set: RuleSet) -> Column:
    priced = F.filter(trimmed_lines(text), lambda line: line.rlike(f"(?iu){rule_set.item_amount}"))
    return F.array_compact(F.transform(priced, lambda line: counted_line(line, rule_set)))


# --- product code line, price below, description above ----------------------------------------------------------


def code_price(line: Column, rule_set: RuleSet) -> Column:
    """Price text a line offers to the product code above it."""
    if rule_set.currency == "USD":
        bulk = r"(\d+)\s*x\s*[$]([\d,.]+)"
        total = integer(F.regexp_extract(line, bulk, 1), "bigint") * amount_cents(found(line, bulk, 2))
        from_bulk = F.concat(F.lit("$"), (total.cast("double") / 100).cast("decimal(18,2)").cast("string"))
        plain = F.concat(F.lit("$"), found(line, r"[$]([\d,.]+)"))
        return F.when(line.contains("$"), F.coalesce(from_bulk, F.when(~line.contains("x"), plain)))
    full = found(line, FULL_EURO_PRICE, 3)
    plain = F.when(~line.contains("%"), found(line, r"([\d.,]+)\s*€"))
    return F.when(line.contains("€"), F.concat(F.coalesce(full, plain), F.lit(" €")))


def direct_item(line: Column, rule_set: RuleSet) -> Column:
    """Item of a line that has description and price itself."""
    if rule_set.item_counts:
        return counted_line(line, rule_set)
    amount = rule_set.item_amount
    between = r"\s*-\s*" if rule_set.language == "es" else r"\s+"
    counted = rf"(?iu)(\d+)\s*x\s+(.+?){between}{amount}"
    piped, plain = rf"(?iu)(.+?)\s*\|\s*{amount}", rf"(?iu)(.+?)\s+{amount}"

    def priced(value: Column) -> Column:
        return F.concat(F.lit("$"), value) if rule_set.currency == "USD" else F.concat(value, F.lit(" €"))

    def build(description: Column, quantity: Column, value: Column) -> Column:
        def costed(words: Column, price: Column) -> Column:
            return let(amount_cents(price), lambda cents: item(words, quantity, cents, cents, price))

        def described(words: Column) -> Column:
            return F.when(words.isNotNull(), let(priced(value), lambda price: costed(words, price)))

        return let(description, described)

    count = F.regexp_extract(line, counted, 1)
    options = [
        build(
            F.concat(F.nullif(count, F.lit("")), F.lit(" x "), F.trim(found(line, counted, 2))),
            integer(count),
            found(line, counted, 3),
        ),
        build(F.trim(found(line, piped, 1)), F.lit(None).cast("int"), found(line, piped, 2)),
    ]
    if rule_set.summary_words:
        least = SHORTEST_DESCRIPTION if rule_set.language == "en" else 3
        usable = let(
            F.trim(found(line, plain, 1)), lambda words: F.when(~is_summary(words, rule_set) & (F.length(words) > least), words)
        )
        options.append(build(usable, F.lit(None).cast("int"), found(line, plain, 2)))
    return F.when(line.rlike(f"(?iu){amount}"), F.coalesce(*options))


def code_items(text: Column, rule_set: RuleSet) -> Column:
    """Items of product code lines and of lines that carry their own price.

    A line between a product code and its price belongs to that item and is not
    read again.
    """
    english = rule_set.currency == "USD"
    none = F.lit(None).cast("string")

    def facts(line: Column) -> Column:
        return F.struct(
            line.alias("line"),
            found(line, ASIN_LINE).alias("asin"),
            code_price(line, rule_set).alias("price"),
            (integer(F.regexp_extract(line, r"(?i)(\d+)\s+of:\s*(.+)", 1)) if english else F.lit(None).cast("int")).alias("bulk"),
            (found(line, r"(?i)\d+\s+of:\s*(.+)") if english else none).alias("bulk_words"),
            (found(line, r"\$([0-9,]+\.[0-9]{2})") if english else none).alias("bulk_price"),
        )

    def ahead(rows: Column, index: Column, count: int, name: str) -> Column:
        numbered = F.transform(after(rows, index, count), lambda row, k: F.struct((k + 1).alias("distance"), row[name].alias("value")))
        return first(F.filter(numbered, lambda hit: hit["value"].isNotNull()))

    def price_of(rows: Column, row: Column, index: Column) -> Column:
        coded = F.when(row["asin"].isNotNull(), ahead(rows, index, PRICE_LOOKAHEAD, "price"))
        if not english:
            return coded
        bulk = F.when(row["asin"].isNull() & row["bulk"].isNotNull(), ahead(rows, index, BULK_LOOKAHEAD, "bulk_price"))
        return F.coalesce(coded, bulk)

    def description_above(rows: Column, index: Column) -> Column:
        def usable(row: Column) -> Column:
            return (F.length(row["line"]) > SHORTEST_DESCRIPTION) & ~row["line"].contains("ASIN:")

        above = F.filter(before(rows, index, DESCRIPTION_LOOKBACK), usable)
        return F.coalesce(let(above, lambda kept: last(kept)["line"]), F.lit(rule_set.default_description))

    def with_price(rows: Column) -> Column:
        return F.transform(rows, lambda row, i: F.struct(row.alias("row"), price_of(rows, row, i).alias("hit")))

    def taken(entries: Column, index: Column) -> Column:
        """Whether an item started above reaches down to this line."""
        above = before(entries, index, BULK_LOOKAHEAD)
        count = F.least(index, F.lit(BULK_LOOKAHEAD))
        reach = F.transform(above, lambda entry, k: entry["hit"]["distance"] >= count - k)
        return F.exists(reach, lambda hit: F.coalesce(hit, F.lit(False)))

    def build(rows: Column, entries: Column) -> Column:
        def one(entry: Column, index: Column) -> Column:
            return F.when(~taken(entries, index), let(amount_cents(entry["hit"]["value"]), lambda cents: found_at(entry, index, cents)))

        def found_at(entry: Column, index: Column, cents: Column) -> Column:
            row, hit = entry["row"], entry["hit"]
            coded = item(description_above(rows, index), F.lit(1), cents, cents, hit["value"], row["asin"])
            own = direct_item(row["line"], rule_set)
            if english:
                total = cents * row["bulk"]
                words = F.concat(row["bulk"].cast("string"), F.lit(" x "), F.trim(row["bulk_words"]))
                bulk = item(words, row["bulk"], cents, total, F.concat(F.lit("$"), (total.cast("double") / 100).cast("decimal(18,2)").cast("string")))
                own = F.when(row["bulk"].isNotNull(), F.when(hit.isNotNull(), bulk)).otherwise(own)
            return F.when(row["asin"].isNotNull(), F.when(hit.isNotNull(), coded)).otherwise(own)

        return F.array_compact(F.transform(entries, one))

    lines = F.transform(trimmed_lines(text), facts)
    return let(lines, lambda rows: let(with_price(rows), lambda entries: build(rows, entries)))


# --- European consumer blocks -----------------------------------------------------------------------------------


def times(total: Column, unit: Column, most: int) -> Column:
    """How often a unit price goes into a total, null unless it is a whole number up to ``most``."""
    count = F.when((unit > 0) & (total % F.nullif(unit, F.lit(0)) == 0), (total / F.nullif(unit, F.lit(0))).cast("int"))
    return F.when(count.between(1, most), count)


def agrees(net: Column, unit: Column, vat_percent: Column) -> Column:
    """Whether a price without tax and one with tax belong together, to the cent; without a rate, whether they can."""
    exact = F.abs(net * (vat_percent + 100) - unit * 100) <= 100
    return F.coalesce(exact, (net <= unit) & (net * 2 >= unit))


def chosen_prices(line_amounts: Column, amounts: Column, vat_percent: Column, most: int) -> Column:
    """Quantity, unit and total price from the amounts of the price line and of the lines below it.

    The columns are price without tax, price with tax and total. Where the first two agree and the third is a
    multiple of the second, all are taken as they stand, however large, and amounts further on are not theirs (a
    line of shipping costs may follow at once). Otherwise digits have been merged or
    columns are missing: the column including tax is the second amount, and amounts too large to be real, or a
    first amount far above the second, are passed over and the item is marked.
    """

    def chosen(quantity: Column, unit: Column, total: Column, repair: Column | None = None) -> Column:
        why = F.lit(None).cast("string") if repair is None else repair
        return F.struct(quantity.cast("int").alias("quantity"), unit.alias("unit"), total.alias("total"), why.alias("repair"))

    one, size = F.lit(1), F.size(line_amounts)
    every = F.when(size == 1, amounts).otherwise(line_amounts)
    net, second, final = first(every), F.get(every, F.lit(1)), last(every)
    third = F.get(every, F.lit(2))
    count = times(third, second, most)
    whole = count.isNotNull() & agrees(net, second, vat_percent)
    suspicious = (F.array_max(every) > MERGED_PRICE_CENTS) | (net > second * SUSPICIOUS_RATIO)
    mark = F.when(suspicious, "merged")
    real = first(F.filter(line_amounts, lambda amount: amount <= REALISTIC_PRICE_CENTS))
    repaired = F.coalesce(real, F.array_min(line_amounts))
    below = F.when(final > second * SUBTOTAL_RATIO, second).otherwise(final)
    return (
        F.when(whole, chosen(count, second, third))
        .when((size > 1) & suspicious, chosen(one, repaired, repaired, mark))
        .when((size == 1) & (F.size(amounts) >= 3), chosen(one, second, below, mark))
        .when((size == 1) & (F.size(amounts) == 2), chosen(one, second, second, mark))
        .when(size == 1, chosen(one, net, net))
        .when(size >= 3, chosen(one, second, final))
        .when(size == 2, chosen(one, second, second))
    )


def consumer_items(text: Column, rule_set: RuleSet, most: int = MAX_QUANTITY) -> Column:
    """Items of product codes with a price block; ``most`` is the largest quantity taken from prices."""

    def facts(line: Column) -> Column:
        priced = F.when(line.contains("ASIN:"), F.regexp_extract(line, r"(ASIN:.*)$", 1)).otherwise(line)
        amounts = F.transform(F.regexp_extract_all(priced, F.lit(EURO_AMOUNT), F.lit(1)), comma_cents)
        usable = ~line.rlike(r"^\d+\s*%?$") & (F.length(line) >= 3)
        none = F.array().cast("array<bigint>")
        return F.struct(
            line.alias("line"),
            found(line, ASIN_CODE).alias("asin"),
            F.when(line.contains("€") & usable, amounts).otherwise(none).alias("amounts"),
            F.when(line.contains("%"), integer(F.regexp_extract(line, r"(?<!\d)(\d{1,2})\s*%", 1))).alias("vat"),
        )

    def description(rows: Column, row: Column, index: Column) -> Column:
        same_line = F.trim(F.regexp_extract(row["line"], r"^(.*?)ASIN:", 1))
        above = F.filter(
            before(rows, index, DESCRIPTION_LOOKBACK),
            lambda other: (F.length(other["line"]) > SHORTEST_DESCRIPTION) & ~other["line"].contains("ASIN:"),
        )
        return F.when(F.length(same_line) > SHORTEST_DESCRIPTION, same_line).otherwise(
            F.coalesce(let(above, lambda kept: last(kept)["line"]), F.lit(""))
        )

    def prices(rows: Column, index: Column) -> Column:
        """Amounts of the first priced line of the block, then of the two lines below it, and what they say."""

        def choose(block: Column) -> Column:
            position = F.array_position(F.transform(block, lambda row: F.size(row["amounts"]) > 0), True).cast("int")

            def shown(three: Column) -> Column:
                rates = F.filter(F.transform(three, lambda row: row["vat"]), lambda rate: rate.isNotNull())
                return F.struct(
                    first(three)["amounts"].alias("line"),
                    F.flatten(F.transform(three, lambda row: row["amounts"])).alias("amounts"),
                    first(rates).alias("vat"),
                )

            def read_(seen: Column) -> Column:
                return F.struct(seen.alias("seen"), chosen_prices(seen["line"], seen["amounts"], seen["vat"], most).alias("chosen"))

            def at(start: Column) -> Column:
                return let(let(F.slice(block, start, F.lit(3)), shown), read_)

            return let(position, lambda start: F.when(start > 0, at(F.greatest(start, F.lit(1)))))

        return let(F.slice(rows, index + 1, F.lit(BLOCK_LINES)), choose)

    def build(rows: Column) -> Column:
        def one(row: Column, index: Column) -> Column:
            def finish(found_: Column) -> Column:
                pair, seen = found_["chosen"], found_["seen"]
                full = item(
                    description(rows, row, index), pair["quantity"], pair["unit"], pair["total"], None, row["asin"],
                    F.slice(seen["amounts"], 1, 3), seen["vat"], pair["repair"],
                )
                return F.when((pair["unit"] > 0) & (pair["total"] > 0), full)

            return F.when(row["asin"].isNotNull(), let(prices(rows, index), finish))

        return F.array_compact(F.transform(rows, one))

    return let(F.transform(trimmed_lines(text), facts), build)


# --- European business tables -----------------------------------------------------------------------------------

# Price layouts behind a product code (first group quantity, then
# unit and total price) and table rows in front of it.
STACKED_COLUMNS = rf"^ASIN:[^\n]*\n\s*(\d{{1,4}}),\d{{2}}\s*€\s*\n\s*\d+\s*%\s*\n\s*\((\d+)\)\s*\n\s*{EURO_DIGITS}\s*€\s*{EURO_DIGITS}\s*€"
BARE_PRICES = rf"^ASIN:[^\n]*\n\s*{EURO_DIGITS}\s*€\s*\n\s*{EURO_DIGITS}\s*€\s*{EURO_DIGITS}\s*€"
COUNTED_PRICES = rf"^ASIN:[\s\S]*?\((\d+)\)[\s\S]*?{EURO_DIGITS}\s*€\s*{EURO_DIGITS}\s*€"
PIPED_ROW = rf"\|\s*([^|]+?)\s*\|\s*(\d{{1,3}})\s*\|\s*{EURO_DIGITS}\s*€[^|]*\|\s*[^|]*\|\s*[^|]*\|\s*{EURO_DIGITS}\s*€\s*\|\s*$"
FLAT_ROW = rf"([^\n\r]{{20,400}}?)\s+(\d{{1,3}})\s+{EURO_DIGITS}\s*€\s+\d+%?\s*\(\d+\)\s+{EURO_DIGITS}\s*€\s+{EURO_DIGITS}\s*€"


def corrected_quantity(quantity: Column, unit: Column, total: Column, most: int = MAX_QUANTITY) -> Column:
    """Quantity that total and unit price imply, where they imply a whole number up to ``most``; others stay as read."""
    implied = F.floor(total.cast("double") / F.when(unit > 0, unit.cast("double")) + 0.5).cast("int")
    fits = implied.between(1, most) & (F.abs(implied * unit - total) < QUANTITY_TOLERANCE_CENTS)
    return F.when(fits, implied).otherwise(quantity)


def is_header_text(description: Column) -> Column:
    return (
        (F.length(description) < SHORTEST_DESCRIPTION)
        | description.rlike(r"^\d+\s*[:.]?\s*$")
        | description.rlike(HEADER_WORDS)
    )


def business_items(text: Column, rule_set: RuleSet, longest: int | None = None) -> Column:
    """Items of product code segments: the text from one code to the next, and the text in front of it.

    ``longest`` cuts descriptions that are joined from several lines to that many characters; by default they stay whole.
    """

    def last_line(segment: Column) -> Column:
        lines = F.filter(
            trimmed_lines(segment),
            lambda line: (F.length(line) > 20) & ~line.contains("ASIN:") & ~line.rlike(r"^\d+\s*[:.]?\s*$") & ~line.rlike(COLUMN_WORDS),
        )
        return F.coalesce(let(lines, last), F.lit("Product"))

    def last_lines(segment: Column) -> Column:
        """Up to three of the last eight lines that read like a description, joined."""
        eight = let(F.filter(trimmed_lines(segment), lambda line: line != ""), lambda tail: F.slice(tail, F.greatest(F.size(tail) - 7, F.lit(1)), F.lit(8)))
        usable = F.filter(
            eight,
            lambda line: (F.length(line) > 20)
            & ~line.rlike(COLUMN_START)
            & ~line.rlike(r"^[\d\s€%,()]+$")
            & ~line.contains("ASIN:")
            & ~line.contains("€"),
        )
        three = let(usable, lambda kept: F.slice(kept, F.greatest(F.size(kept) - 2, F.lit(1)), F.lit(3)))
        joined = let(F.array_join(three, " "), lambda words: F.coalesce(F.nullif(words, F.lit("")), F.lit("Product")))
        return joined if longest is None else F.substring(joined, 1, longest)

    def one(asin: Column, ahead: Column, segment: Column) -> Column:
        def entry(description: Column, quantity: Column, unit: Column, total: Column) -> Column:
            seen = F.struct(quantity.alias("quantity"), unit.alias("unit"), total.alias("total"))
            return let(seen, lambda s: item(description, corrected_quantity(s["quantity"], s["unit"], s["total"]), s["unit"], s["total"], None, asin))

        def counts(source: Column, pattern: str, group: int) -> Column:
            return integer(F.regexp_extract(source, pattern, group))

        def cents(source: Column, pattern: str, group: int) -> Column:
            return comma_cents(F.regexp_extract(source, pattern, group))

        stacked = entry(
            last_line(ahead), counts(segment, STACKED_COLUMNS, 1), cents(segment, STACKED_COLUMNS, 3), cents(segment, STACKED_COLUMNS, 4)
        )
        piped = item(
            F.trim(F.regexp_extract(ahead, PIPED_ROW, 1)), counts(ahead, PIPED_ROW, 2),
            cents(ahead, PIPED_ROW, 3), cents(ahead, PIPED_ROW, 4), None, asin,
        )
        flat_words = F.trim(F.regexp_extract(ahead, FLAT_ROW, 1))
        flat = entry(flat_words, counts(ahead, FLAT_ROW, 2), cents(ahead, FLAT_ROW, 3), cents(ahead, FLAT_ROW, 5))
        bare_words = last_line(ahead)
        bare = entry(bare_words, F.lit(1), cents(segment, BARE_PRICES, 1), cents(segment, BARE_PRICES, 3))

        def agreeing(s: Column) -> Column:
            agrees = F.abs(s["quantity"] * s["unit"] - s["total"]) < QUANTITY_TOLERANCE_CENTS
            return F.when(agrees, item(last_lines(ahead), s["quantity"], s["unit"], s["total"], None, asin))

        def corrected(s: Column) -> Column:
            quantity = corrected_quantity(s["quantity"], s["unit"], s["total"])
            return let(F.struct(quantity.alias("quantity"), s["unit"].alias("unit"), s["total"].alias("total")), agreeing)

        seen = F.struct(
            counts(segment, COUNTED_PRICES, 1).alias("quantity"), cents(segment, COUNTED_PRICES, 2).alias("unit"), cents(segment, COUNTED_PRICES, 3).alias("total")
        )
        counted = let(seen, corrected)
        return (
            F.when(segment.rlike(STACKED_COLUMNS), stacked)
            .when(ahead.rlike(PIPED_ROW), piped)
            .when(ahead.rlike(FLAT_ROW) & ~is_header_text(flat_words), flat)
            .when(segment.rlike(BARE_PRICES) & ~is_header_text(bare_words), bare)
            .when(segment.rlike(COUNTED_PRICES), counted)
        )

    def build(segments: Column) -> Column:
        def at(segment: Column, index: Column) -> Column:
            ahead = F.coalesce(F.get(segments, index - 1), F.lit(""))
            asin = found(segment, "^" + ASIN_CODE)
            known = F.struct(asin.alias("asin"), ahead.alias("ahead"))
            return let(known, lambda k: F.when(k["asin"].isNotNull(), one(k["asin"], k["ahead"], segment)))

        return F.array_compact(F.transform(segments, at))

    return let(F.split(text, "(?=ASIN:)"), build)


# --- sectioned lists of unknown layout --------------------------------------------------------------------------

# Headings that open the item section and marks that close it.
SECTION_STARTS = ["Items Ordered", "Artikel", "Articles", "Commande", "Order Confirmation", "Descripción", "Productos", "Pedido"]
SECTION_STOPS = (
    r"^(?!.*(?:\(|Item\(s\))).*Subtotal|^(?!.*\().*(?:Zwischensumme|Sous-total|Payment|Zahlung|Envío)"
    r"|\b(?:Grand|Order|Final) Total\b"
)
SKIPPED_BELOW = r"^(?:Sold by:|Business Price|Condition:)|^$|Shipping Speed:"
STOPPED_BELOW = r"^\d+\s+of:|Item\(s\) Subtotal:|Total before tax:"
ANY_PRICE = r"([$€£¥]\s*\d+(?:[.,]\d{2})?|\d+(?:[.,]\d{2})?\s*[$€£¥])"


ASIN_PRICES = r"[\d.,]+\s*€\s*\d+%\s*[\d.,]+\s*€\s*([\d.,]+)\s*€"


def section_items(text: Column) -> Column:
    """Items of texts without a rule set: between the first heading and the section end, and of product codes.

    The section is open behind the first heading and never opens again; nothing is read behind its end. A product
    code with its prices on the next line counts inside and in front of the section.
    """

    def mark(line: Column) -> Column:
        opens = F.lit(False)
        for words in SECTION_STARTS:
            opens = opens | line.contains(words)
        return F.struct(
            line.alias("line"),
            opens.alias("opens"),
            line.rlike(SECTION_STOPS).alias("stops"),
            found(line, ASIN_LINE).alias("asin"),
            F.when(line.contains("€"), found(line, ASIN_PRICES)).alias("coded_price"),
        )

    def gated(rows: Column) -> Column:
        """Rows with whether they lie inside the section; those behind its end are left out."""
        start = F.array_position(F.transform(rows, lambda row: row["opens"]), True).cast("int")

        def cut(opened: Column) -> Column:
            # Places count from 1; without a heading nothing is inside and nothing ends.
            stops = F.transform(rows, lambda row, i: row["stops"] & ~row["opens"] & (opened > 0) & (i + 1 > opened))
            end = F.array_position(stops, True).cast("int")
            kept = let(end, lambda stop: F.when(stop > 0, F.slice(rows, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(rows))
            return F.transform(kept, lambda row, i: F.struct(*[row[name].alias(name) for name in ("line", "opens", "asin", "coded_price")], ((opened > 0) & (i + 1 > opened)).alias("inside")))

        return let(start, cut)

    def coded(rows: Column, row: Column, index: Column) -> Column:
        above = F.filter(before(rows, index, DESCRIPTION_LOOKBACK), lambda other: (F.length(other["line"]) > SHORTEST_DESCRIPTION) & other["asin"].isNull())
        words = F.coalesce(let(above, lambda kept: last(kept)["line"]), F.lit("Product"))

        def priced(price: Column) -> Column:
            full = let(amount_cents(price), lambda cents: item(words, F.lit(None).cast("int"), cents, cents, price, row["asin"]))
            return F.when(price.isNotNull(), full)

        return let(F.concat(F.get(rows, index + 1)["coded_price"], F.lit(" €")), priced)

    def price_below(rows: Column, index: Column) -> Column:
        below = F.filter(after(rows, index, 10), lambda row: ~row["line"].rlike(SKIPPED_BELOW))
        marked = F.transform(
            below,
            lambda row: F.struct(
                row["line"].rlike(STOPPED_BELOW).alias("stop"), found(row["line"], r"^\$?(\d+\.\d{2})$").alias("price")
            ),
        )
        hit = first(F.filter(marked, lambda m: m["stop"] | m["price"].isNotNull()))
        return let(hit, lambda h: F.when(~h["stop"], h["price"]))

    def build(rows: Column) -> Column:
        def one(row: Column, index: Column) -> Column:
            line = row["line"]
            counted = rf"(?i)^(\d+)\s*x\s+(.+?)\s+{ANY_PRICE}"
            piped = r"(?i)(.+?)\s*\|\s*([\d,.]+)\s*€"
            of_words = F.trim(F.regexp_extract(line, r"^(\d+)\s+of:\s+(.+)$", 2))

            def listed(number: Column) -> Column:
                def bulk(price: Column) -> Column:
                    seen = F.struct(number.try_cast("int").alias("quantity"), amount_cents(price).alias("unit"))
                    full = let(seen, lambda s: item(F.concat(number, F.lit(" x "), of_words), s["quantity"], s["unit"], s["unit"] * s["quantity"], F.concat(F.lit("$"), price)))
                    return F.when(price.isNotNull(), full)

                return F.when(integer(number).isNotNull(), let(price_below(rows, index), bulk))

            def own(price: Column) -> Column:
                count = F.regexp_extract(line, counted, 1)
                words = F.concat(count, F.lit(" x "), F.trim(F.regexp_extract(line, counted, 2)))
                return let(amount_cents(price), lambda cents: item(words, count.try_cast("int"), cents, cents, price))

            def pipe(price: Column) -> Column:
                words = F.trim(F.regexp_extract(line, piped, 1))
                return let(amount_cents(price), lambda cents: item(words, F.lit(None).cast("int"), cents, cents, price))

            own_line = F.when(
                row["inside"] & ~row["opens"],
                F.coalesce(
                    let(F.regexp_extract(line, r"^(\d+)\s+of:\s+(.+)$", 1), listed),
                    F.when(line.rlike(counted), let(F.trim(F.regexp_extract(line, counted, 3)), own)),
                    F.when(line.contains("|") & line.rlike(piped), let(F.concat(F.regexp_extract(line, piped, 2), F.lit(" €")), pipe)),
                ),
            )
            return F.when(row["asin"].isNotNull(), coded(rows, row, index)).otherwise(own_line)

        return F.array_compact(F.transform(rows, one))

    return let(let(F.transform(trimmed_lines(text), mark), gated), build)


# --- repair by arithmetic ---------------------------------------------------------------------------------------


def split_quantity(item_: Column, most: int = MAX_QUANTITY) -> Column:
    """The item with roles that satisfy quantity x unit = total, where its amounts as read do not.

    A scan that loses the space between quantity and price prints 3 and 176,46 as 3176,46. The price without tax
    follows from the one with tax, so the digits in front of it are the quantity, if that many units make the total.
    Without such digits a total that is a multiple of the unit price gives the quantity.
    """
    amounts = item_["amounts"]
    shown, unit, total = first(amounts), F.get(amounts, F.lit(1)), F.get(amounts, F.lit(2))
    net = F.floor(unit * 100 / (F.coalesce(item_["vat_percent"], F.lit(0)) + 100) + F.lit(0.5)).cast("bigint")
    # A price has two digits behind the comma and at least one in front.
    power = F.pow(F.lit(10.0), F.greatest(F.length(net.cast("string")), F.lit(3))).cast("bigint")
    front = F.when((shown > net) & ((shown - net) % power == 0), ((shown - net) / power).cast("int"))

    def with_roles(quantity: Column, why: str) -> Column:
        return item(item_["description"], quantity, unit, total, item_["price"], item_["asin"], amounts, item_["vat_percent"], F.lit(why))

    split = F.when(front.between(1, most) & (unit * front == total), with_roles(front, "quantity split"))
    implied = F.when(times(total, unit, most) > 1, with_roles(times(total, unit, most), "quantity implied"))
    read_right = item_["quantity"] * item_["unit_cents"] == item_["total_cents"]
    doubted = item_["repair"].isNotNull() | ~F.coalesce(read_right, F.lit(False))
    return F.when(doubted & (F.size(amounts) >= 3), F.coalesce(split, implied, item_)).otherwise(item_)


def repaired(invoices: DataFrame, keys: list[str], most: int = MAX_QUANTITY) -> DataFrame:
    """Items of extracted invoices (``items``, ``total_cents``, ``shipping_cents``, ``subtotal_cents``) after the repair.

    Items as read are kept where quantity x unit = total holds for each and their sum is the subtotal or the total less
    shipping; else repaired items are taken. ``balance`` says which (``read``, ``repaired``), or ``open`` where repaired
    items do not add up either. The amounts as printed stay in ``amounts``. Items without doubt are not changed.
    """

    def sum_of(items: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda total, one: total + F.coalesce(one["total_cents"], F.lit(0)))

    tried = held(invoices, {"fixed_items": F.transform("items", lambda one: split_quantity(one, most))})
    goods = F.col("total_cents") - F.coalesce("shipping_cents", F.lit(0))
    summed = held(tried, {"read_sum": sum_of(F.col("items")), "fixed_sum": sum_of(F.col("fixed_items"))})

    def fits(name: str) -> Column:
        written = F.when(F.coalesce("subtotal_source", F.lit("")) == "text", F.col("subtotal_cents"))
        return F.coalesce(F.col(name) == goods, F.lit(False)) | F.coalesce(F.col(name) == written, F.lit(False))

    whole = F.forall("items", lambda one: F.coalesce(one["quantity"] * one["unit_cents"] == one["total_cents"], F.lit(False)))
    balance = F.when(whole & fits("read_sum"), "read").when(fits("fixed_sum"), "repaired").otherwise("open")
    judged = held(summed, {"balance": balance})
    chosen = judged.withColumn("items", F.when(F.col("balance") == "read", F.col("items")).otherwise(F.col("fixed_items")))
    return exploded(chosen, [*keys, "balance"], [*ITEM_FIELDS, "amounts", "repair"])


def read(text: Column, rule_set: RuleSet) -> Column:
    """Array of items a rule set reads from a text."""
    if rule_set.item_reader == "us":
        return us_items(text)
    if rule_set.item_reader == "asin":
        return code_items(text, rule_set)
    if rule_set.item_reader == "eu_consumer":
        return consumer_items(text, rule_set)
    if rule_set.item_reader == "eu_business":
        return business_items(text, rule_set)
    if rule_set.item_reader == "section":
        return section_items(text)
    return line_items(text, rule_set)


def exploded(invoices: DataFrame, keys: list[str], fields: list[str] = ITEM_FIELDS) -> DataFrame:
    """Items table of extracted invoices, with the position inside the document.

    ``inline_outer`` puts out plain columns. Taking fields of an exploded struct would
    let the optimizer push each field into the item expression and repeat it.
    """

    def flat(item_: Column, index: Column) -> Column:
        return F.struct(index.alias("position"), *[item_[name].alias(name) for name in fields])

    return invoices.select(*keys, F.inline_outer(F.transform("items", flat))).where(F.col("position").isNotNull())


def fingerprints(invoices: DataFrame, keys: list[str]) -> DataFrame:
    """Items with the number of equal items in their document; no item is dropped.

    The items of a document are sorted by content inside its row and the runs of
    equal ones counted, so there is no shuffle and no pairwise comparison.
    """

    def text_of(item_: Column) -> Column:
        return F.concat_ws("|", *[F.coalesce(item_[name].cast("string"), F.lit("")) for name in ITEM_FIELDS[:-1]])

    def flat(item_: Column, counts: Column) -> Column:
        return F.struct(*[item_[name].alias(name) for name in ITEM_FIELDS], F.element_at(counts, text_of(item_)).alias("copies"))

    def counted(items: Column) -> Column:
        return let(F.array_sort(F.transform(items, lambda i: text_of(i))), run_starts)

    def run_starts(marks: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(marks)),
            lambda i: (i == 1) | (F.element_at(marks, i) != F.element_at(marks, F.greatest(i - 1, F.lit(1)))),
        )
        return let(F.struct(marks.alias("marks"), starts.alias("starts")), runs)

    def runs(found_runs: Column) -> Column:
        marks, starts = found_runs["marks"], found_runs["starts"]
        lengths = F.transform(
            starts, lambda start, i: F.coalesce(F.get(starts, i + 1), F.size(marks) + 1) - start
        )
        return F.map_from_arrays(F.transform(starts, lambda start: F.element_at(marks, start)), lengths)

    def marked(items: Column) -> Column:
        return let(counted(items), lambda copies: F.transform(items, lambda i: flat(i, copies)))

    rows = F.when(F.size("items") > 0, let(F.col("items"), marked))
    return invoices.select(*keys, F.inline_outer(rows)).where(F.col("copies").isNotNull())
