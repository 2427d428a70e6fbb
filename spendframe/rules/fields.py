"""Field rules of the thirteen rule sets.

A rule is a label followed by an amount or a date. Each rule set names its
labels per field and the shapes its amounts are written in; the patterns are
built from those by ``amount_patterns`` and ``date_patterns``. Labels come in
order of precedence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

GAP = r"[:\s]*"
# Labels that also occur inside longer words must not start there.
WORD_START = r"(?<![A-Za-z-])"

ORDER_NUMBER = r"\d{3}-\d{7}-\d{7}"
LONE_ORDER_NUMBER = rf"(?<![-\d])({ORDER_NUMBER})(?![-\d])"


@dataclass(frozen=True)
class Shape:
    """Patterns of a written amount with one group, and the text put around the group."""

    patterns: list[str]
    prefix: str = ""
    suffix: str = ""


# Written amounts.
DOLLAR_PLAIN = Shape([r"\$?([\d,]+\.?\d*)"], prefix="$")
DOLLAR_EITHER = Shape([r"[$]([\d,.]+)", r"([\d,.]+)\s*[$]"], prefix="$")
DOLLAR_OFF = Shape([r"-?\$?(\d+\.?\d*)"], prefix="-$")
DOLLAR_GROUPED = Shape([r"([$]\s*\d{1,3}(?:,\d{3})*\.\d{2})"])
DOLLAR_LOOSE = Shape([r"[$\s]*(\d+[,.]\d{2})"], prefix="$")
POUND_GROUPED = Shape([r"([£]\s*\d{1,3}(?:,\d{3})*\.\d{2})"])
YEN_GROUPED = Shape([r"([¥£$]\s*\d{1,3}(?:,\d{3})*)"])
FRANC = Shape([r"CHF\s*(\d+[,.]\d{2})"], prefix="CHF ")
EURO_EITHER = Shape([r"(\d+(?:[.,]\d{1,2})?\s*€)", r"(€\d+(?:[.,]\d{1,2})?)"])
EURO_EITHER_FULL = Shape([r"(\d+(?:[.,]\d{2})?\s*€)", r"(€\d+(?:[.,]\d{2})?)"])
EURO_BEHIND = Shape([r"(\d+(?:[.,]\d{1,2})?)\s*€"], suffix=" €")
EURO_TAX = Shape([r"(\d+(?:[.,]\d{1,2})?)\s*€", r"\(?\d+(?:[.,]\d{1,2})?%\)?\s*(\d+(?:[.,]\d{1,2})?)\s*€"], suffix=" €")
EURO_FRONT = Shape([r"([€£$]\s*\d+[,.]\d{2})"])
EURO_LOOSE = Shape([r"€?([\d.]+,\d{2})"], suffix=" €")
EURO_LOOSE_PLAIN = Shape([r"€?(\d+,\d{2})"], suffix=" €")
EURO_GROUPED = Shape([r"([\d.]+,\d{2})\s*€"], suffix=" €")
EURO_SIGNED = Shape([r"(-?\d+,\d{2})\s*€"], suffix=" €")

# An amount with a mark or code on either side, for texts of no known market.
MARKED = Shape([r"((?:USD|EUR|GBP|JPY|CHF|Fr\.?|[$€£¥])\s*\d+(?:[.,]\d+)*)", r"(\d+(?:[.,]\d+)*\s*(?:CHF|Fr\b|[$€£¥]))"])

# Written dates with one group.
NAMED_MONTH_FIRST = r"([A-Za-z]+\s+\d{1,2},?\s+\d{4})"
NAMED_DAY_FIRST = r"(\d{1,2}(?:er|\.)?\s*[\p{L}]+\s+\d{4})"
SLASHED = r"(\d{1,2}/\d{1,2}/\d{4})"
DOTTED = r"(\d{1,2}\.\d{1,2}\.\d{4})"
DASHED = r"(\d{1,2}-\d{1,2}-\d{4})"
NUMERIC = r"(\d{1,2}[./-]\d{1,2}[./-]\d{4})"
YEAR_FIRST = r"(\d{4}(?:年|[./-])\d{1,2}(?:月|[./-])\d{1,2}日?)"

# Dates looked for anywhere in the text when no label leads to one.
GENERIC_DATES = [
    r"\b(\d{1,2}[/.-]\d{1,2}[/.-]\d{4})\b",
    r"(?iu)\b(\p{L}+\s+\d{1,2},?\s+\d{4})\b",
    r"(?iu)\b(\d{1,2}\s+\p{L}+\s+\d{4})\b",
    r"\b(\d{4}-\d{2}-\d{2})\b",
]


@dataclass(frozen=True)
class RuleSet:
    name: str
    language: str
    currency: str
    order_labels: list[str]
    date_labels: list[str]
    date_shapes: list[str]
    labels: dict[str, list[str]]
    shapes: dict[str, Shape]
    patterns: dict[str, list[str]] = field(default_factory=dict)
    any_date: bool = True
    order_shape: str = ORDER_NUMBER
    item_reader: str = "lines"
    summary_words: list[str] = field(default_factory=list)
    item_amount: str = ""
    item_counts: list[str] = field(default_factory=list)
    default_description: str = ""
    subtotal_order: tuple[str, ...] = ("text", "items")


def same_shape(shape: Shape, **other: Shape) -> dict[str, Shape]:
    return {name: other.get(name, shape) for name in ("subtotal", "shipping", "tax", "discount", "total")}


# The rule sets, labels in order of precedence.
ENGLISH_DATES = ["Order\\s+Placed", "Order\\s+Date", "Date"]

US = RuleSet(
    "us", "en", "USD",
    order_labels=[r"Order\s*Number[:\s]*", r"Order\s*#\s*", r"Order[:\s]*"],
    date_labels=ENGLISH_DATES,
    date_shapes=[NAMED_MONTH_FIRST, SLASHED],
    any_date=False,
    labels={
        "subtotal": ["Subtotal", "Sub-Total"],
        "shipping": [r"Shipping\s*&?\s*Handling", "Shipping", "Delivery"],
        "tax": [r"Estimated\s+Tax", r"Sales\s+Tax", "VAT", "Tax"],
        "discount": ["Discount", "Promotion"],
        "total": [r"Grand\s+Total", r"Order\s+Total", r"Amount\s+Due", "Total"],
    },
    shapes=same_shape(DOLLAR_PLAIN, discount=DOLLAR_OFF),
    item_reader="us",
)

ENGLISH = RuleSet(
    "english", "en", "USD",
    order_labels=US.order_labels,
    date_labels=ENGLISH_DATES,
    date_shapes=[NAMED_MONTH_FIRST, SLASHED, DOTTED, DASHED],
    labels={
        "subtotal": ["Subtotal", "Sub-total"],
        "shipping": ["Shipping", "Delivery"],
        "tax": ["Tax", "VAT", "GST"],
        "discount": ["Discount", "Promotion", "Savings", "Coupon", "Credit"],
        "total": [r"Grand\s+Total", "Total", r"Order\s+Total"],
    },
    shapes=same_shape(DOLLAR_EITHER),
    item_reader="asin",
    item_amount=r"[$]([\d,.]+)",
    summary_words=[
        "subtotal|shipping|tax|total|order total", "visa|mastercard|amex|ending in|card",
        "business price|condition|sold by", "shipping address|shipping speed", "^.{0,20}$",
    ],
    default_description="Amazon Product",
)

GERMAN = RuleSet(
    "german", "de", "EUR",
    order_labels=["Bestellnummer[:\\s]*", r"Bestell-Nr\.?[:\s]*", "Auftragsnummer[:\\s]*", "Bestellung[:\\s]*"],
    date_labels=["Bestelldatum", "Rechnungsdatum"],
    date_shapes=[NAMED_DAY_FIRST, DOTTED, SLASHED, DASHED],
    labels={
        "subtotal": ["Zwischensumme", "Teilsumme", "Summe", "Nettobetrag"],
        "shipping": ["Versand", "Versandkosten", "Versand und Verpackung", "Porto"],
        "tax": ["MwSt", "Mehrwertsteuer", "Umsatzsteuer"],
        "discount": ["Rabatt", "Nachlass", "Ermäßigung", "Skonto", "Discount"],
        "total": ["Gesamtbetrag", "Gesamtpreis", "Gesamtsumme", "Total", "Endbetrag", "Bruttobetrag"],
    },
    shapes=same_shape(EURO_EITHER, tax=EURO_TAX, total=EURO_EITHER_FULL),
    patterns={"total": [r"(?<!MwSt:\s{0,9})(?<!\d%\s{0,9})(?<!IVA\s{1,9})(\d{3,}(?:[.,]\d{2})?\s*€)(?![\d%])"]},
    item_reader="asin",
    item_amount=r"([\d,.]+)\s*€",
    summary_words=["subtotal|zwischensumme|versand|mwst|gesamt|total|versandkosten"],
    default_description="Amazon Produkt",
)

FRENCH = RuleSet(
    "french", "fr", "EUR",
    order_labels=[r"Numéro\s+de\s+commande[:\s]*", r"N°\s*de\s+commande[:\s]*", "Commande[:\\s]*", "Référence[:\\s]*"],
    date_labels=[r"Date\s+de\s+commande", r"Commande\s+passée\s+le", r"Commande\s+du", "Le"],
    date_shapes=[DOTTED, SLASHED, NAMED_DAY_FIRST, DASHED],
    labels={
        "subtotal": ["Sous-total", r"Total\s+HT"],
        "shipping": ["Livraison", r"Frais\s+de\s+port", "Port"],
        "tax": ["TVA", r"T\.V\.A\."],
        "discount": ["Remise", "Réduction", "Escompte", "Rabais", "Discount"],
        "total": [r"Total\s+TTC", r"(?<!Sous[-\s])Total", r"Montant\s+total"],
    },
    shapes=same_shape(EURO_EITHER, tax=EURO_TAX, total=EURO_EITHER_FULL),
    patterns={"total": [r"(?<!TVA:\s{0,9})(?<!\d%\s{0,9})(?<!\w{1,20}:\s{0,9})(\d{3,}(?:[.,]\d{2})?\s*€)(?![\d%])"]},
    item_reader="asin",
    item_amount=r"([\d,.]+)\s*€",
    summary_words=["sous-total|livraison|tva|total|frais de port"],
    default_description="Produit Amazon",
)

SPANISH = RuleSet(
    "spanish", "es", "EUR",
    order_labels=["Número de pedido[:\\s]*", "Pedido\\s*", r"Nº\s+de\s+pedido[:\s]*"],
    date_labels=[r"Fecha\s+del?\s+pedido", r"Pedido\s+del", "Fecha"],
    date_shapes=[NAMED_DAY_FIRST, SLASHED, DOTTED, DASHED],
    labels={
        "subtotal": ["Subtotal", "Base imponible", "Importe"],
        "shipping": ["Envío", "Gastos de envío", "Portes"],
        "tax": [r"IVA\s*\d+(?:[.,]\d{1,2})?%", "IVA", "Impuestos"],
        "discount": ["Descuento", "Descuentos", "Rebaja", "Reducción", "Discount"],
        "total": ["Total", "Importe total", "Total a pagar"],
    },
    shapes=same_shape(EURO_EITHER, tax=EURO_TAX, total=EURO_EITHER_FULL),
    patterns={"total": [r"(?<!ASIN:\s{0,9})(?<!\d%\s{0,9})(\d{3,}(?:[.,]\d{2})?\s*€)(?![\d%])"]},
    item_reader="asin",
    item_amount=r"([\d.,]+)\s*€",
    default_description="Producto Amazon",
)

ITALIAN = RuleSet(
    "italian", "it", "EUR",
    order_labels=["Numero d'ordine[:\\s]*", "Ordine\\s*", r"N\.\s*d'ordine[:\s]*"],
    date_labels=[r"Data\s+ordine", r"Ordine\s+effettuato\s+il", r"Data\s+dell'ordine", r"Ordine\s+del", "Data"],
    date_shapes=[DOTTED, SLASHED, NAMED_DAY_FIRST, DASHED],
    labels={
        "subtotal": ["Subtotale", r"Totale\s+parziale", r"Importo\s+parziale", r"Totale\s+merce"],
        "shipping": ["Spedizione", "Consegna", r"Costi\s+di\s+spedizione", r"Spese\s+di\s+spedizione"],
        "tax": ["IVA", r"Imposta\s+sul\s+valore\s+aggiunto", "Tassa", "Imposta"],
        "discount": ["Sconto", "Ribasso", "Riduzione", "Detrazione", "Abbuono", "Remise", "Discount"],
        "total": ["Totale", r"Importo\s+totale", r"Totale\s+da\s+pagare", r"Totale\s+ordine", r"Grand\s+Total"],
    },
    shapes=same_shape(EURO_FRONT),
    item_reader="asin",
    item_amount=r"([€£$]\s*\d+[,.]\d{2})",
    item_counts=["x", "×", "di"],
    summary_words=[
        "totale|total|subtotale|subtotal|iva|tassa|spedizione|consegna|costi di spedizione|spese di spedizione"
        "|imposta|pagare|ordine|merce|parziale",
    ],
    default_description="Prodotto Amazon",
)

JAPANESE = RuleSet(
    "japanese", "ja", "JPY",
    order_labels=["注文番号[:\\s]*", "注文\\s*", "オーダー番号[:\\s]*"],
    date_labels=["注文日", "注文日時", "注文された日", "日付"],
    date_shapes=[YEAR_FIRST],
    labels={
        "subtotal": ["小計", "商品小計", "合計金額"],
        "shipping": ["配送料", "送料", "運送料", "手数料"],
        "tax": ["消費税", "税金", "税額"],
        "total": ["合計", "総額", "お支払い金額", "お支払額", "総計"],
    },
    shapes=same_shape(YEN_GROUPED),
    item_amount=YEN_GROUPED.patterns[0],
    item_counts=["×", "個"],
    summary_words=["合計|総額|小計|商品小計|配送料|送料|運送料|消費税|税金|税額|手数料|お支払い|総計"],
)

CANADIAN_FRENCH = RuleSet(
    "canadian_french", "fr", "CAD",
    order_labels=["Numéro de commande[:\\s]*", "Commande\\s*", r"N°\s+de\s+commande[:\s]*"],
    date_labels=[r"Date\s+de\s+commande", r"Commande\s+passée\s+le", "Le"],
    date_shapes=[NAMED_DAY_FIRST, SLASHED, DOTTED, DASHED],
    labels={
        "subtotal": ["Sous-total", r"Total\s+partiel", r"Sous-total\s+des\s+articles"],
        "shipping": ["Livraison", r"Frais\s+de\s+port", "Expédition", r"Frais\s+d'expédition"],
        "tax": ["TPS", "TVP", "TVH", "PST", "Taxe", "Impôt"],
        "total": ["Total", r"Montant\s+total", r"Total\s+TTC", r"À\s+payer", r"Grand\s+total"],
    },
    shapes=same_shape(DOLLAR_LOOSE),
    item_amount=r"([$\s]*\d+[,.]\d{2})",
    item_counts=["x", "×"],
    summary_words=[
        "total|sous-total|total partiel|livraison|frais de port|expédition|frais d'expédition|tps|tvp|tvh|pst|taxe"
        "|impôt|à payer|montant total|ttc",
    ],
)

AUSTRALIAN = RuleSet(
    "australian", "en", "AUD",
    order_labels=[r"Order\s+Number[:\s]*", "Order\\s*"],
    date_labels=ENGLISH_DATES,
    date_shapes=[NAMED_MONTH_FIRST, SLASHED, DOTTED, DASHED],
    labels={
        "subtotal": ["Subtotal", "Sub-total"],
        "shipping": ["Shipping", "Delivery", "Postage"],
        "tax": ["GST", "Tax", r"GST\s+Included"],
        "total": [r"Grand\s+Total", r"Order\s+Total", r"Amount\s+Due", "Total"],
    },
    shapes=same_shape(DOLLAR_GROUPED),
    item_amount=DOLLAR_GROUPED.patterns[0],
    item_counts=["x", "×"],
    summary_words=["total|subtotal|sub-total|shipping|delivery|postage|gst|tax|grand total|order total|amount due"],
)

UK = replace(
    AUSTRALIAN,
    name="uk",
    language="en-gb",
    currency="GBP",
    order_labels=[r"Order\s+Number[:\s]*", r"Order\s+No[:\s]*", "Order\\s*"],
    labels={**AUSTRALIAN.labels, "tax": ["VAT", "Tax", r"VAT\s+Included"]},
    shapes=same_shape(POUND_GROUPED),
    item_amount=POUND_GROUPED.patterns[0],
    summary_words=["total|subtotal|sub-total|shipping|delivery|postage|vat|tax|grand total|order total|amount due"],
)

SWISS = RuleSet(
    "swiss", "de", "CHF",
    order_labels=["Bestellnummer[:\\s]*", "Bestell-Nr[:\\s]*", "Bestellung\\s*"],
    date_labels=["Bestelldatum", "Datum"],
    date_shapes=[NAMED_DAY_FIRST, DOTTED, SLASHED, DASHED],
    labels={
        "subtotal": ["Zwischensumme", "Subtotal", "Zwischentotal"],
        "shipping": ["Versand", "Lieferung", "Porto"],
        "tax": ["MWST", "Mehrwertsteuer", "TVA", "Steuer"],
        "total": ["Gesamtbetrag", "Total", "Gesamt", "Betrag"],
    },
    shapes=same_shape(FRANC),
    item_amount=r"(CHF\s*\d+[,.]\d{2})",
    item_counts=["x", "×"],
    summary_words=["gesamtbetrag|total|gesamt|zwischensumme|subtotal|versand|lieferung|porto|mwst|mehrwertsteuer|tva|steuer|betrag"],
)

EU_CONSUMER = RuleSet(
    "eu_consumer", "vote", "EUR",
    order_labels=["Bestellnummer[:\\s]*", r"Order\s*Number[:\s]*", r"Order\s*#\s*"],
    date_labels=["Bestelldatum", r"Order\s+Date", "Datum", "Rechnungsdatum"],
    date_shapes=[r"(\d+\s+\p{L}+\s+\d+)", NUMERIC],
    any_date=False,
    labels={
        "subtotal": ["Zwischensumme", "Subtotal", "Nettobetrag"],
        "shipping": ["Versandkosten", "Versand", "Shipping", "Delivery"],
        "tax": ["MwSt", "VAT", "Steuer", "USt"],
        "discount": ["Rabatt", "Discount"],
        "total": ["Gesamtpreis", "Zahlbetrag", "Gesamtbetrag", "Total", "Gesamt"],
    },
    shapes=same_shape(EURO_LOOSE, shipping=EURO_LOOSE_PLAIN, discount=EURO_SIGNED),
    patterns={
        "subtotal": [
            r"USt\. Gesamt([\d.]+,\d{2})\s*€", r"Gesamt([\d.]+,\d{2})\s*€", r"Gesamtpreis([\d.]+,\d{2})\s*€",
            r"Total\s+HT[:\s]*([\d.]+,\d{2})\s*€",
        ],
        "tax_first": [r"USt\. Gesamt[\d.]+,\d{2} €([\d.]+,\d{2})", r"\d+%[\d.]+,\d{2} €([\d.]+,\d{2})"],
        "tax": [r"\d+%([\d.]+,\d{2})\s*€"],
    },
    item_reader="eu_consumer",
    subtotal_order=("items", "text", "difference"),
)

EU_BUSINESS = RuleSet(
    "eu_business", "vote", "EUR",
    order_labels=[
        "Bestellnummer[:\\s]*", r"Bestell-Nr\.?[:\s]*", "Auftragsnummer[:\\s]*", r"Número\s+de\s+pedido[:\s]*",
        r"Nº\s+de\s+pedido[:\s]*", r"Numéro\s+de\s+commande[:\s]*", r"Nº\s+de\s+commande[:\s]*",
        r"Numero\s+d'ordine[:\s]*", r"Order\s*Number[:\s]*", r"Order\s*#[:\s]*",
    ],
    date_labels=[
        "Bestelldatum", "Rechnungsdatum", "Datum", r"Fecha\s+de\s+pedido", r"Fecha\s+de\s+compra",
        r"Date\s+de\s+commande", "Date\\s+d'achat", "Data\\s+dell'ordine", r"Data\s+di\s+acquisto", r"Order\s+Date",
        r"Purchase\s+Date",
    ],
    date_shapes=[r"(\d+\s+\p{L}+\s+\d+)", NUMERIC],
    labels={
        "subtotal": [
            "Zwischensumme", "Teilsumme", "Nettobetrag", r"USt\. Gesamt", "Subtotal", r"Base\s+imponible", "Sous-total",
            r"Total\s+HT", "Subtotale", r"Totale\s+imponibile", r"Net\s+amount",
        ],
        "shipping": [
            "Versand", "Versandkosten", "Porto", "Envío", r"Gastos\s+de\s+envío", "Livraison", r"Frais\s+de\s+port",
            "Spedizione", r"Costi\s+di\s+spedizione", "Shipping", "Delivery",
        ],
        "tax": [
            "MwSt", "Mehrwertsteuer", "Umsatzsteuer", r"USt\. Gesamt[\d.]+,\d{2}\s*€", "IVA",
            r"Impuesto\s+sobre\s+el\s+valor\s+añadido", "TVA", r"Taxe\s+sur\s+la\s+valeur\s+ajoutée",
            r"Imposta\s+sul\s+valore\s+aggiunto", "VAT", "Tax",
        ],
        "discount": [
            "Rabatt", "Nachlass", "Ermäßigung", "Descuento", "Rebaja", "Remise", "Réduction", "Sconto", "Riduzione",
            "Discount", "Reduction",
        ],
        "total": [
            "Gesamtbetrag", "Gesamtpreis", "Gesamtsumme", "Bruttobetrag", "Endbetrag", "Total", r"Importe\s+total",
            r"Montant\s+total", r"Total\s+TTC", "Totale", r"Importo\s+totale", r"Grand\s+total",
        ],
    },
    shapes=same_shape(EURO_GROUPED, shipping=Shape([r"(\d+,\d{2})\s*€"], suffix=" €"), discount=EURO_SIGNED),
    item_reader="eu_business",
    subtotal_order=("text", "items", "difference"),
)

RULE_SETS = {
    rule_set.name: rule_set
    for rule_set in (
        US, EU_BUSINESS, EU_CONSUMER, SPANISH, GERMAN, ENGLISH, FRENCH, ITALIAN, JAPANESE, CANADIAN_FRENCH, AUSTRALIAN,
        SWISS, UK,
    )
}

# Signs of a currency in an amount.
CURRENCY_SIGNS = {"EUR": "€|EUR", "USD": r"\$|USD", "GBP": "£|GBP", "JPY": "¥|JPY", "CHF": "CHF|Fr"}

# Labels of all markets, for texts from which the rule set of their market reads nothing. The
# currency is that of the amounts (empty here).
GENERIC = RuleSet(
    "generic", "en", "",
    order_labels=[],
    date_labels=["Order\\s+Placed", "Bestelldatum", "Rechnungsdatum", "Date\\s+de\\s+commande", "Commande\\s+du", "Fecha\\s+del?\\s+pedido", "Order\\s+Date"],
    date_shapes=[NAMED_MONTH_FIRST, NAMED_DAY_FIRST, DOTTED],
    labels={
        "subtotal": ["Subtotale?", "Base imponible", "Zwischensumme", "Teilsumme", "Sous-total", "Total HT"],
        "shipping": ["Gastos de envío", "Envío", "Shipping", "Delivery", "Versandkosten", "Versand", "Livraison", "Frais de port", "Port"],
        "tax": ["Impuestos", "IVA", "Tax", "VAT", "GST", "MwSt", "Mehrwertsteuer", "TVA", r"T\.V\.A\."],
        "total": ["Grand Total", "Total pendiente", "Gesamtpreis", "Gesamtbetrag", "Gesamt", "Totale fattura", "Totale", "Total TTC", "Total"],
    },
    shapes=same_shape(MARKED),
    item_reader="section",
)

# Labels that must start a word because they also end longer labels.
GUARDED_LABELS = {"Total", "Totale", "Summe", "Gesamt", "Betrag", "Le", "Port", "Tax", "Data", "Date"}

# Further fields of European consumer invoices.
VAT_RATES = [
    r"(?i)(\d+(?:[.,]\d+)?)%\s*(?:MwSt|VAT|USt|TVA|IVA)",
    r"(?i)(?:MwSt|VAT|USt|TVA|IVA)\s*(\d+(?:[.,]\d+)?)%",
    r"(\d+(?:[.,]\d+)?)%[\d.]+,\d{2}\s*€[\d.]+,\d{2}",
    r"(\d+(?:[.,]\d+)?)%\s*[\d.]+,\d{2}\s*€",
]
SHIPPING_ADDRESS = [
    r"(?i)Lieferadresse:?\s*([\s\S]*?)(?=\n\s*\n|Versand|Rechnung|Bestellung|$)",
    r"(?iu)Adresse\s+de\s+livraison:?\s*([\s\S]*?)(?=\n\s*\n|Expédition|Facturation|Commande|$)",
    r"(?i)Shipping\s+Address:?\s*([\s\S]*?)(?=\n\s*\n|Shipping|Billing|Order|$)",
]
BILLING_ADDRESS = [
    r"(?i)Rechnungsadresse:?\s*([\s\S]*?)(?=\n\s*\n|Liefer|Versand|Bestellung|$)",
    r"(?iu)Adresse\s+de\s+facturation:?\s*([\s\S]*?)(?=\n\s*\n|Livraison|Expédition|Commande|$)",
    r"(?i)Billing\s+Address:?\s*([\s\S]*?)(?=\n\s*\n|Shipping|Order|$)",
]
PAYMENT_METHODS = [
    r"(?i)Zahlungsart[:\s]*([^\n\r]+)",
    r"(?i)Payment\s+Method[:\s]*([^\n\r]+)",
    r"(?i)Mode\s+de\s+paiement[:\s]*([^\n\r]+)",
    r"(?i)Zahlung[:\s]*([^\n\r]+)",
]


def guarded(label: str) -> str:
    return WORD_START + label if label in GUARDED_LABELS else label


def plain_word(label: str) -> str:
    """Longest lower-case ASCII word that every match of a label holds; empty if there is none."""
    if "|" in label:
        return ""
    pieces = re.split(r"\\.|\[[^\]]*\]|\(.*\)|.[?*]|.?\{[^}]*\}|[^A-Za-z0-9]", label)
    return max(pieces, key=len).lower()


def leading_word(pattern: str) -> str:
    """Such a word of the part of a pattern in front of its first group, which must not be one of several choices."""
    body = pattern.removeprefix("(?iu)").removeprefix("(?i)").removeprefix(WORD_START)
    flat, inner = re.sub(r"\\.|\[[^\]]*\]", "", body), ""
    while flat != inner:
        flat, inner = re.sub(r"\([^()]*\)", "", flat), flat
    return "" if "|" in flat else plain_word(body.split("(")[0])


def folded_pattern(pattern: str) -> str:
    """A case-insensitive pattern of a label and a group as one for folded texts; empty where it would not show the same.

    That is where the group may hold letters or the label is no plain text. The text of a label that must not follow
    a letter comes first and is looked behind then: an engine skips to plain text, but tries a look behind at each place.
    """
    body = pattern.removeprefix("(?iu)")
    guard = body.startswith(WORD_START)
    label, _, rest = body.removeprefix(WORD_START).partition("(")
    if body == pattern or re.search(r"\\(?![sd]|\W)", label) or re.search(r"[^\W\d_]", re.sub(r"\\[sd]", "", rest)):
        return ""
    label = re.sub(r"\\.|[^\\]", lambda sign: sign.group() if len(sign.group()) > 1 else sign.group().lower(), label)
    plain = re.match(r"\w*", label).group()
    if not plain or (guard and re.match(r"[*+?{]", label[len(plain) :])):
        return ""
    behind = f"(?<![a-z-]{plain})" if guard else ""
    return f"{plain}{behind}{label[len(plain) :]}({rest}"


def amount_patterns(rule_set: RuleSet, name: str) -> list[str]:
    """Patterns of one amount field in order of precedence."""
    shape = rule_set.shapes[name]
    built = list(rule_set.patterns.get(f"{name}_first", []))
    built += [guarded(label) + GAP + amount for label in rule_set.labels.get(name, []) for amount in shape.patterns]
    return ["(?iu)" + pattern for pattern in [*built, *rule_set.patterns.get(name, [])]]


def date_patterns(rule_set: RuleSet) -> list[str]:
    return ["(?iu)" + guarded(label) + GAP + shape for shape in rule_set.date_shapes for label in rule_set.date_labels]


def order_patterns(rule_set: RuleSet) -> list[str]:
    labelled = [f"(?iu){label}({rule_set.order_shape})" for label in rule_set.order_labels]
    return [*labelled, LONE_ORDER_NUMBER]


def register(rule_set: RuleSet) -> None:
    """Add or replace a rule set; routed documents that name it are read by it."""
    RULE_SETS[rule_set.name] = rule_set
