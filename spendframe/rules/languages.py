"""Language signs of invoice texts, matched against the upper-cased text."""

from __future__ import annotations

from dataclasses import dataclass, field

# Points in hundredths, cap and least score.
STRONG_POINTS = 15
MEDIUM_POINTS = 8
DATE_POINTS = 10
MONEY_POINTS = 5
CAP_POINTS = 100
LEAST_POINTS = 30
UNKNOWN = "UNKNOWN"

EURO_AMOUNT = r"\d+[,.]\d{2}\s*€"
DOT_DATE = r"\b\d{1,2}\.\d{1,2}\.\d{4}\b"
SLASH_DATE = r"\b\d{1,2}/\d{1,2}/\d{4}\b"
DOT_SLASH_DATE = r"\b\d{1,2}[./]\d{1,2}[./]\d{4}\b"


@dataclass(frozen=True)
class Language:
    """Words and phrases with their points. A money pattern gives 15 points once,
    or 5 per hit up to ``money_limit`` when that is set."""

    code: str
    strong: list[str]
    medium: list[str]
    money: list[str]
    dates: str
    money_limit: int | None = None
    open_ended: list[str] = field(default_factory=list)


# The ten languages in order of precedence. Phrases stand for whole
# words with any space between; ``open_ended`` signs need no word end behind them.
LANGUAGES = [
    Language(
        "ES",
        ["ESPAÑA", "IMPORTE TOTAL", "PEDIDO REALIZADO", "FECHA DEL PEDIDO", "NÚMERO DE PEDIDO", "SUBTOTAL", "TOTAL", "ENVÍO", "PRODUCTOS", "DESCRIPCIÓN"],
        ["EL PEDIDO", "SU PEDIDO", "HA SIDO", "GRACIAS POR", "SU COMPRA"],
        [EURO_AMOUNT, r"\d{1,3}(?:\.\d{3})*,\d{2}\s*€"],
        DOT_SLASH_DATE,
        money_limit=20,
        open_ended=[r"ASIN:", r"IVA\s+\d"],
    ),
    Language(
        "DE",
        ["BESTELLNUMMER", "BESTELLDATUM", "ARTIKEL", "ZWISCHENSUMME", "VERSAND", "MWST", "GESAMTBETRAG", "RECHNUNGSADRESSE", "LIEFERADRESSE", "ZAHLUNGSART", r"AMAZON\.DE"],
        ["IHR AUFTRAG", "VIELE GRÜSSE", r"AMAZON EU S\.À R\.L", "STEUERNR", "UST-IDNR"],
        [EURO_AMOUNT],
        DOT_DATE,
    ),
    Language(
        "EN",
        ["ORDER PLACED", "ORDER NUMBER", "ORDER CONFIRMATION", "ITEMS ORDERED", "SHIPPING", "SUBTOTAL", "TAX", "GRAND TOTAL", "PAYMENT METHOD", "BILLING ADDRESS", "SHIPPING ADDRESS"],
        ["THANK YOU", "FOR YOUR ORDER", r"AMAZON\.COM", r"AMAZON\.CA", r"AMAZON\.CO\.UK"],
        [r"[$£]\s*\d{1,3}(?:[,.]\d{3})*[,.]?\d*"],
        r"\b(?:JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)\s+\d{1,2},?\s+\d{4}\b",
        money_limit=15,
    ),
    Language(
        "FR",
        ["NUMÉRO DE COMMANDE", "DATE DE COMMANDE", "ARTICLES", "SOUS-TOTAL", "LIVRAISON", "TVA", "TOTAL TTC", "MODE DE PAIEMENT", "ADRESSE DE FACTURATION", "ADRESSE DE LIVRAISON", r"AMAZON\.FR"],
        ["VOTRE COMMANDE", "MERCI POUR", "VOTRE ACHAT", "NOUS VOUS", "TÉLÉPHONE"],
        [EURO_AMOUNT],
        DOT_SLASH_DATE,
    ),
    Language(
        "IT",
        ["NUMERO D'ORDINE", "DATA DELL'ORDINE", "ARTICOLI", "SUBTOTALE", "SPEDIZIONE", "IVA", "TOTALE", r"AMAZON\.IT"],
        ["IL TUO ORDINE", "GRAZIE PER", "IL TUO ACQUISTO", "TELEFONO"],
        [EURO_AMOUNT],
        DOT_SLASH_DATE,
    ),
    Language(
        "JP",
        ["注文番号", "注文日", "商品", "小計", "配送料", "消費税", "合計", r"AMAZON\.CO\.JP"],
        ["お届け先", "お支払い方法", "円", r"年\d{1,2}月\d{1,2}日"],
        [r"\d+[,.]\d{2}\s*¥|¥\s*\d+[,.]\d{2}"],
        r"\d{4}年\d{1,2}月\d{1,2}日",
    ),
    Language(
        "CA",
        ["NUMÉRO DE COMMANDE", "COMMANDE PASSÉE", "ARTICLES", "SOUS-TOTAL", "LIVRAISON", "TPS", "TVH", "À PAYER", r"AMAZON\.CA"],
        ["VOTRE COMMANDE", "ADRESSE DE LIVRAISON", "MODE DE PAIEMENT", "CANADA", "QUÉBEC"],
        [r"\$\s*\d{1,3}(?:[,.]\d{3})*[,.]\d{2}"],
        SLASH_DATE,
    ),
    Language(
        "AU",
        ["ORDER PLACED", "ORDER NUMBER", "ITEMS ORDERED", "SHIPPING", "SUBTOTAL", "GST", "GRAND TOTAL", "PAYMENT METHOD", r"AMAZON\.COM\.AU"],
        ["DELIVERY", "AUSTRALIA", "THANK YOU", "FOR YOUR ORDER"],
        [r"\$\s*\d{1,3}(?:[,.]\d{3})*[,.]\d{2}"],
        SLASH_DATE,
    ),
    Language(
        "CH",
        ["BESTELLNUMMER", "BESTELLDATUM", "ARTIKEL", "ZWISCHENSUMME", "VERSAND", "MWST", "GESAMTBETRAG", "ZAHLUNGSART", r"AMAZON\.DE", "SCHWEIZ"],
        ["IHR AUFTRAG", "VIELE GRÜSSE", "CHF", "STEUERNR"],
        [r"\bCHF\s*\d+[,.]\d{2}"],
        DOT_DATE,
    ),
    Language(
        "GB",
        ["ORDER PLACED", "ORDER NUMBER", "ORDER CONFIRMATION", "ITEMS ORDERED", "SHIPPING", "SUBTOTAL", "VAT", "GRAND TOTAL", "PAYMENT METHOD", r"AMAZON\.CO\.UK"],
        ["DELIVERY", "POSTAGE", "UNITED KINGDOM", "THANK YOU", "FOR YOUR ORDER"],
        [r"£\s*\d{1,3}(?:[,.]\d{3})*[,.]\d{2}"],
        SLASH_DATE,
    ),
]
