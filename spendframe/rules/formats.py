"""Marketplace vocabulary: format tokens, business and consumer signs, routes."""

from __future__ import annotations

# Format names.
US = "amazon.com"
EU = "amazon.eu"
BUSINESS = "business"
CONSUMER = "consumer"

# Points and the tokens that earn them once each, ignoring case.
US_TOKENS = [
    (40, ["amazon.com", "Order #", "Order Placed:", "Shipped to:", "Sold by:", "Shipped by:"]),
    (20, ["$", "USD"]),
    (15, ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]),
]
EU_TOKENS = [
    (40, ["amazon.de", "amazon.fr", "amazon.it", "amazon.es", "amazon.co.uk", "amazon.nl", "amazon.se", "amazon.pl", "ASIN:"]),
    (20, ["€", "EUR", "£", "GBP", "CHF"]),
    (15, ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"]),
    (15, ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]),
    (15, ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]),
    # marzo, agosto and novembre are months of two languages and count once.
    (15, ["gennaio", "febbraio", "aprile", "maggio", "giugno", "luglio", "settembre", "ottobre", "dicembre"]),
    (25, ["Rechnung", "Commande", "Ordine", "Pedido", "Bestellung", "Facture", "Fattura", "Factura"]),
]

# Confidence by winning score, (at least, alone, with a strong rival).
CONFIDENCE_STEPS = [(100, 100, 100), (80, 80, 60), (60, 60, 55), (40, 40, 40), (25, 25, 25)]
WEAKEST_CONFIDENCE = 15
LEAST_SCORE = 25
QUALITY_STEPS = [(25, "VERY LOW", "reject"), (40, "LOW", "review"), (70, "MEDIUM", "review")]
BEST_QUALITY = ("HIGH", "accept")

# Signs of business and consumer invoices, one point each.
BUSINESS_SIGNS = [
    r"(?i)amazon\s+business", "Geschäftsadresse", "Auftraggeber", r"Rechnung\s+an", "Firma", "USt-IdNr", "Steuernummer",
    r"(?i)\bGmbH\b", r"\bAG\b", r"(?i)\bUG\b", r"(?i)\be\.V\.\b", r"(?i)\bKGaA\b", "Dirección comercial",
    "NIF sujeto de IVA", "Adresse (professionnelle|commerciale)", "Numéro de TVA", r"TVA\s+[A-Z]{2}\d", r"Facture\s+à",
    "Entreprise", "Société", r"S\.A\.R\.L", r"S\.A\.S", r"IVA\s+ES", r"TVA\s+FR", r"IVA\s+IT", "Partita IVA",
    r"P\.?I\.?\s+\d", "(?iu)società", "(?i)azienda",
]
POLISH_SIGN = r"SP\.\s*Z\s*O\.O\.|ODDZIAŁ\s+W\s+POLSCE"
POLISH_EXCEPTION = r"(?iu)Amazon EU S\.à r\.l\.,.*SP\. Z O\.O\. ODDZIAŁ W POLSCE"
CONSUMER_SIGNS = [
    r"(?i)amazon\.de\b", r"(?i)amazon\.fr\b", r"(?i)amazon\.co\.uk\b", "Rechnungsadresse(?!.*Geschäftsadresse)",
    "Steuerfreie Ausfuhrlieferung", "Privatkunde", "Endverbraucher", "Lieferanschrift", "Zahlungsmethode",
]
# By sign, a text without which it has no match; lower-case for signs that ignore the case of ASCII letters.
SIGN_TEXTS = {
    r"(?i)amazon\s+business": "business", "Geschäftsadresse": "Geschäftsadresse", "Auftraggeber": "Auftraggeber", r"Rechnung\s+an": "Rechnung",
    "Firma": "Firma", "USt-IdNr": "USt-IdNr", "Steuernummer": "Steuernummer", r"(?i)\bGmbH\b": "gmbh", r"\bAG\b": "AG", r"(?i)\bUG\b": "ug",
    r"(?i)\be\.V\.\b": "e.v.", r"(?i)\bKGaA\b": "kgaa", "Dirección comercial": "Dirección comercial", "NIF sujeto de IVA": "NIF sujeto de IVA",
    "Adresse (professionnelle|commerciale)": "Adresse ", "Numéro de TVA": "Numéro de TVA", r"TVA\s+[A-Z]{2}\d": "TVA", r"Facture\s+à": "Facture",
    "Entreprise": "Entreprise", "Société": "Société", r"S\.A\.R\.L": "S.A.R.L", r"S\.A\.S": "S.A.S", r"IVA\s+ES": "IVA", r"TVA\s+FR": "TVA",
    r"IVA\s+IT": "IVA", "Partita IVA": "Partita IVA", r"P\.?I\.?\s+\d": "P", "(?i)azienda": "azienda",
    r"(?i)amazon\.de\b": "amazon.de", r"(?i)amazon\.fr\b": "amazon.fr", r"(?i)amazon\.co\.uk\b": "amazon.co.uk",
    "Rechnungsadresse(?!.*Geschäftsadresse)": "Rechnungsadresse", "Steuerfreie Ausfuhrlieferung": "Steuerfreie Ausfuhrlieferung",
    "Privatkunde": "Privatkunde", "Endverbraucher": "Endverbraucher", "Lieferanschrift": "Lieferanschrift", "Zahlungsmethode": "Zahlungsmethode",
}
GERMAN_BUSINESS = r"(?iu)Geschäftsadresse|USt-IdNr|Steuernummer|Rechnung\s+an|Firma"
GERMAN_CONSUMER = "(?i)Privatkunde|Endverbraucher"
GERMAN_BOOST = 2
TABLE_BEFORE_ASIN = r"(?s)\|\s*\d+\s*\|.*?ASIN:"
ADDRESS_BLOCK = r"(?i)Rechnung\s+an[\s\S]*?\n.*?\n.*?\n"

# Rule set of each language; anything else is read as English.
LANGUAGE_ROUTES = {
    "ES": "spanish", "DE": "german", "EN": "english", "FR": "french", "IT": "italian", "JP": "japanese",
    "CA": "canadian_french", "AU": "australian", "CH": "swiss", "GB": "uk",
}
DEFAULT_ROUTE = "english"

# Signs of the language of a European invoice; the later language wins a tie.
EU_LANGUAGE_SIGNS = {
    "de": [r"amazon\.de", r"Bestelldatum", r"Gesamtbetrag", r"MwSt", r"Versandkosten"],
    "fr": [r"amazon\.fr", r"Date\s+de\s+commande", r"Total\s+TTC", r"TVA", r"Frais\s+de\s+port"],
    "es": [r"amazon\.es", r"Fecha\s+de\s+pedido", r"Total", r"IVA", r"Gastos\s+de\s+envío"],
    "it": [r"amazon\.it", r"Data\s+dell'ordine", r"Totale", r"IVA", r"Costi\s+di\s+spedizione"],
    "en": [r"amazon\.co\.uk", r"Order\s+Date", r"Total", r"VAT", r"Delivery"],
}
