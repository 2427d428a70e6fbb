"""Texts in the layouts of different markets, with the fields they must give."""

import datetime

from pyspark.sql import functions as F

from spendframe.operators import classify, cleaning, extract, items
from spendframe.plans import pipeline
from spendframe.rules import cleaning as cleaning_rules

CONSUMER = """Rechnung
Versandungsland: Deutschland

Bestellnummer: 123-4567890-1234567
Bestelldatum: 15.12.2023

Echo Dot (5th Gen, Charcoal)
ASIN: B08N5WRWNW
155,32 €
20%
66,38 €66,38 €

Versandkosten 5,06 €

Gesamtbetrag 71,44 €
Zahlungsart: Visa
Lieferadresse
Mason Wood
19 Bourne Rd
28045 Madrid
Spanien

USt. 20% 11,90 €"""

GLUED = """Rechnung
ASIN: B08N5WRWNW129,99 € 20% 155,99 € 155,99 €
ASIN: B06XJ4G828155,32 € 20% 186,38 € 186,38 €
Versandkosten4,22 € 5,06 € 5,06 €
Gesamtbetrag341,44 €"""

MERGED = """Rechnung
Gesamtpreis891,66 €
Bestelldatum08 Oktober 2025
Bestellnummer302-1725553-0374723
www.amazon.de
Zahnbuerste mit Reiseladeetui, schwarz
ASIN: B0F3D9YC75
1176,46 €
0%
176,46 €176,46 €
Zahnbuerste mit Reiseladeetui, schwarz
ASIN: B0F3D9YC75
3176,46 €
0%
176,46 €529,38 €
Versandkosten9,36 €9,36 €9,36 €"""

BUSINESS = """Rechnung an Firma Muster GmbH
Bestellnummer 305-1234567-7654321
Bestelldatum 24.08.2025
Kabel fuer Ladegeraet, zwei Meter, schwarz
ASIN: B000000001
537,37 €
0%
(1)
37,37 €186,85 €
Zwischensumme 186,85 €
Gesamtbetrag 186,85 €"""

GERMAN = """Bestellnummer: 111-2222222-3333333
Bestelldatum: 5. März 2024
Philips Sonicare Prestige
ASIN: B0F3D9YC75
1165,27 €0%165,27 €165,27 €
2 x Kaffeebohnen 12,50 €
Teekanne aus Glas | 20,00 €
Zwischensumme: 197,77 €
Versand: 4,00 €
MwSt (19%) 30,00 €
Rabatt: 5,00 €
Gesamtbetrag: 226,77 €"""

ENGLISH = """Order Number: 111-2222222-3333333
Order Date: March 5, 2024
Stainless steel garden shears
ASIN: B0F3D9YC75
3 x $10.00
2 of: Coffee Beans
Sold by: somebody
$4.25
Grand Total: $38.50"""

SECTIONED = """Order Confirmation
2 of: Blue mug
Sold by: X
$4.50
1 x Red plate $10.00
Subtotal: $19.00
3 x Not an item $1.00"""


def read(spark, text, rule_set):
    frame = spark.createDataFrame([("d", rule_set, text)], "doc_id string, rule_set string, clean_text string")
    return extract.extracted(frame, [rule_set]).first()


def test_consumer_block(spark):
    row = read(spark, CONSUMER, "eu_consumer")
    assert row.order_number == "123-4567890-1234567"
    assert row.order_date == datetime.date(2023, 12, 15)
    assert (row.shipping, row.total, row.subtotal, row.subtotal_source) == ("5,06 €", "71,44 €", "66,38 €", "items")
    (item,) = row["items"]
    assert (item.asin, item.description, item.quantity) == ("B08N5WRWNW", "Echo Dot (5th Gen, Charcoal)", 1)
    assert (item.unit_cents, item.total_cents) == (6638, 6638)


def test_consumer_details(spark):
    frame = spark.createDataFrame([("d", CONSUMER)], "doc_id string, clean_text string")
    row = extract.consumer_details(frame).first()
    assert row.payment_method == "Visa"
    assert row.vat_rate == 20.0
    address = row.shipping_address
    assert (address.name, address.street, address.city, address.postal_code, address.country) == (
        "Mason Wood", "19 Bourne Rd", "Madrid", "28045", "Spanien",
    )
    assert row.billing_address is None


def test_amounts_glued_to_the_code(spark):
    row = read(spark, GLUED, "eu_consumer")
    assert [i.unit_cents for i in row["items"]] == [15599, 18638]


def test_merged_digits_are_repaired(spark):
    row = read(spark, MERGED, "eu_consumer")
    assert [(i.unit_cents, i.total_cents) for i in row["items"]] == [(17646, 17646), (17646, 17646)]
    assert row.order_number == "302-1725553-0374723"
    assert row.order_date == datetime.date(2025, 10, 8)
    assert row.total == "891,66 €"


def test_business_columns_correct_the_quantity(spark):
    row = read(spark, BUSINESS, "eu_business")
    (item,) = row["items"]
    assert (item.quantity, item.unit_cents, item.total_cents) == (5, 3737, 18685)
    assert item.description == "Kabel fuer Ladegeraet, zwei Meter, schwarz"
    assert (row.subtotal, row.total, row.order_date) == ("186,85 €", "186,85 €", datetime.date(2025, 8, 24))


def test_german_rules(spark):
    row = read(spark, GERMAN, "german")
    assert (row.order_number, row.order_date) == ("111-2222222-3333333", datetime.date(2024, 3, 5))
    assert (row.subtotal, row.shipping, row.tax, row.discount, row.total) == ("197,77 €", "4,00 €", "30,00 €", "5,00 €", "226,77 €")
    assert [(i.description, i.price) for i in row["items"]] == [
        ("Philips Sonicare Prestige", "165,27 €"), ("2 x Kaffeebohnen", "12,50 €"), ("Teekanne aus Glas", "20,00 €"),
        ("Rabatt:", "5,00 €"),
    ]


def test_english_bulk_lines(spark):
    row = read(spark, ENGLISH, "english")
    assert [(i.description, i.price) for i in row["items"]] == [
        ("Stainless steel garden shears", "$30.00"), ("2 x Coffee Beans", "$8.50"),
    ]
    assert (row.total, row.subtotal, row.subtotal_source) == ("$38.50", "$38.50", "items")


def test_total_is_not_read_from_subtotal(spark):
    for rule_set, mark in (("us", "$"), ("uk", "£"), ("australian", "$")):
        row = read(spark, f"Subtotal: {mark}30.00\nGrand Total: {mark}38.00", rule_set)
        assert (row.subtotal, row.total) == (f"{mark}30.00", f"{mark}38.00")


def test_other_markets(spark):
    french = read(spark, "Numéro de commande: 123-1234567-1234567\nDate de commande: 15 décembre 2023\nSous-total: 30,00 €\nLivraison: 5,00 €\nTVA: 3,00 €\nTotal TTC: 38,00 €", "french")
    assert (french.order_date, french.subtotal, french.shipping, french.tax, french.total) == (datetime.date(2023, 12, 15), "30,00 €", "5,00 €", "3,00 €", "38,00 €")
    spanish = read(spark, "Número de pedido: 123-1234567-1234567\nFecha del pedido: 30 noviembre 2025\nSubtotal: 30,00 €\nEnvío: 6,01 €\nIVA 21% 5,00 €\nTotal: 41,01 €", "spanish")
    assert (spanish.order_date, spanish.shipping, spanish.tax, spanish.total) == (datetime.date(2025, 11, 30), "6,01 €", "5,00 €", "41,01 €")
    italian = read(spark, "Numero d'ordine: 123-1234567-1234567\nData ordine 29.11.2025\nSubtotale: € 30,00\nSpedizione: € 5,00\nIVA: € 3,00\nTotale: € 38,00", "italian")
    assert (italian.order_date, italian.subtotal, italian.total) == (datetime.date(2025, 11, 29), "€ 30,00", "€ 38,00")
    canadian = read(spark, "Commande 123-1234567-1234567\n2 x Tasse bleue $10,00\nSous-total: $ 20,00\nTPS: 1,00\nTotal: $21,00", "canadian_french")
    assert (canadian.subtotal, canadian.tax, canadian.total) == ("$20,00", "$1,00", "$21,00")
    assert [i.description for i in canadian["items"]] == ["Tasse bleue"]


def test_sectioned_items(spark):
    frame = spark.createDataFrame([(SECTIONED,)], "t string")
    rows = frame.select(items.section_items(F.col("t")).alias("i")).first().i
    assert [(i.description, i.quantity, i.total_cents) for i in rows] == [("2 x Blue mug", 2, 900), ("1 x Red plate", 1, 1000)]


def test_confidences(spark):
    frame = spark.createDataFrame([("d", "eu_consumer", CONSUMER)], "doc_id string, rule_set string, clean_text string")
    row = extract.field_confidences(extract.extracted(frame, ["eu_consumer"])).first()
    assert row.confidence_scores["order_number"] == 70
    assert row.confidence_scores["subtotal"] == 50
    assert row.overall_confidence == 70


def test_us_noise(spark):
    text = "Page 1 of 2\nbutter-\n fly\n(seller profile) ----- [ ] [ X ]\nConditions of Use | Privacy Notice 1996"
    frame = spark.createDataFrame([(text,)], "t string")
    cleaned = frame.select(cleaning.format_clean(F.col("t"), F.lit("amazon.com"))).first()[0]
    assert cleaned == "butterfly"


def test_eu_noise(spark):
    text = "Seite 1 von 2\nZahn-\nbürste 37,37€\n(1) Steuerfreie innergemeinschaftliche Lieferung\nEnde [ ___ ]"
    frame = spark.createDataFrame([(text,)], "t string")
    cleaned = frame.select(cleaning.format_clean(F.col("t"), F.lit("amazon.eu"))).first()[0]
    assert cleaned == "Zahnbürste 37,37 €\n\nEnde"


def test_damaged_characters(spark):
    text = "Ã© Ã¨ Ã¼ â‚¬ ÃŸ"
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(cleaning.repair_encoding(F.col("t"))).first()[0] == "é è ü € ß"
    assert cleaning_rules.damaged("é") == "Ã©"


def test_classes_and_routes(spark):
    texts = [
        ("us", "Amazon.com Order #1 Sold by: X $5"), ("consumer", CONSUMER + "\namazon.de"), ("business", BUSINESS),
        ("jp", "注文番号 注文日 小計 合計 消費税"), ("none", "hello world"),
    ]
    frame = spark.createDataFrame(texts, "doc_id string, text string")
    rows = {r.doc_id: r for r in pipeline.prepared(frame).collect()}
    assert {k: r.rule_set for k, r in rows.items()} == {
        "us": "us", "consumer": "eu_consumer", "business": "eu_business", "jp": "japanese", "none": "english",
    }
    assert rows["none"].action == "reject" and rows["us"].action == "accept"
    assert rows["none"].language == "UNKNOWN"


def test_later_language_wins_a_tie(spark):
    frame = spark.createDataFrame([("Total 5 IVA",), ("IVA",), ("",)], "t string")
    assert [r[0] for r in frame.select(classify.eu_language("t")).collect()] == ["es", "it", "en"]
