"""Noise patterns of invoice texts."""

from __future__ import annotations

# Characters whose UTF-8 bytes are often read as single-byte text.
# The damaged form of each follows from that rule.
REPAIRED_CHARACTERS = "éèêëàáâäãåçíîïóôöõúûüñßťňřšž€‚„…†‡‰‹›™•–—‘’“"
# Capitals of the same letters; a few have no damaged form in single-byte text and stay.
REPAIRED_CHARACTERS += "ÉÈÊËÀÁÂÄÃÅÇÍÎÏÓÔÖÕÚÛÜÑŤŇŘŠŽ"
LEAD_CHARACTERS = "ÃâÅ"
LONE_LEAD = ("Ã", "à")


def damaged(character: str) -> str:
    return character.encode("utf-8").decode("cp1252")


def repair_pairs() -> list[tuple[str, str]]:
    """Damaged and correct text, longest damaged text first; undecodable ones are left out."""
    pairs = []
    for character in REPAIRED_CHARACTERS:
        try:
            pairs.append((damaged(character), character))
        except UnicodeDecodeError:
            continue
    pairs.sort(key=lambda pair: -len(pair[0]))
    return [*pairs, LONE_LEAD]


# Fixed values: (pattern, replacement) per format, in the order of application.
US_NOISE = [
    (r"(?i)Page\s+\d+\s+of\s+\d+", ""),
    (r"(?m)Conditions of Use \| Privacy Notice.*$", ""),
    (r"-\s*\n\s*", ""),
    (r"(?i)\(seller profile\)", ""),
    (r"-----+", ""),
    (r"\[\s*\]", ""),
    (r"(?i)\[\s*X\s*\]", ""),
]
EU_NOISE = [
    (r"(?i)Seite\s+\d+\s*von\s+\d+", ""),
    (r"(?iu)Página\s+\d+\s+de\s+\d+", ""),
    (r"(?i)Page\s+\d+\s+sur\s+\d+", ""),
    (r"(?i)Pagina\s+\d+\s+di\s+\d+", ""),
    (r"(?s)Amazon EU S\.à r\.l\. - 38 avenue.*?(?=\n\n|\n[A-Z]|$)", ""),
    (r"(?s)Sitz der Gesellschaft:.*?Stammkapital:.*?EUR", ""),
    (r"eingetragen im Luxemburgischen.*?(?=\n)", ""),
    (r"(\w+)-\s*\n\s*(\w+)", "$1$2"),
    (r"\(\d+\)\s*Steuerfreie innergemeinschaftliche.*?(?=\n|$)", ""),
    (r"(\d+,\d{2})€", "$1 €"),
    (r"\[\s*\]", ""),
    (r"(?i)\[\s*X\s*\]", ""),
    (r"\[\s*_{3,}\s*\]", ""),
]
GENERIC_NOISE = [
    (r"(?i)Page\s+\d+\s+(of|von|de|sur|di)\s+\d+", ""),
    (r"-\s*\n\s*", ""),
    (r"\[\s*\]", ""),
    (r"(?i)\[\s*X\s*\]", ""),
]

# By noise pattern, a sign without which it has no match; a plain text or a shorter pattern. Others stand for
# themselves.
PLAIN_SIGNS = [
    "Conditions of Use", "-----", "[", "Amazon EU S.", "Sitz der Gesellschaft:", "eingetragen im Luxemburgischen",
    "Steuerfreie innergemeinschaftliche",
]
JOINED_LINES = r"-\s*\n"
EUROPEAN_PAGE = r"(?iu)(?:Seite|P[aá]gina|Page)\s+\d"
NOISE_SIGNS = {
    r"(?m)Conditions of Use \| Privacy Notice.*$": "Conditions of Use",
    r"-\s*\n\s*": JOINED_LINES,
    r"-----+": "-----",
    r"\[\s*\]": "[",
    r"(?i)\[\s*X\s*\]": "[",
    r"\[\s*_{3,}\s*\]": "[",
    r"(?i)Seite\s+\d+\s*von\s+\d+": EUROPEAN_PAGE,
    r"(?iu)Página\s+\d+\s+de\s+\d+": EUROPEAN_PAGE,
    r"(?i)Page\s+\d+\s+sur\s+\d+": EUROPEAN_PAGE,
    r"(?i)Pagina\s+\d+\s+di\s+\d+": EUROPEAN_PAGE,
    r"(?s)Amazon EU S\.à r\.l\. - 38 avenue.*?(?=\n\n|\n[A-Z]|$)": "Amazon EU S.",
    r"(?s)Sitz der Gesellschaft:.*?Stammkapital:.*?EUR": "Sitz der Gesellschaft:",
    r"eingetragen im Luxemburgischen.*?(?=\n)": "eingetragen im Luxemburgischen",
    r"(\w+)-\s*\n\s*(\w+)": JOINED_LINES,
    r"\(\d+\)\s*Steuerfreie innergemeinschaftliche.*?(?=\n|$)": "Steuerfreie innergemeinschaftliche",
    r"(\d+,\d{2})€": r"\d,\d{2}€",
}

# Signs of a generated report; two of them make a document one.
REPORT_SIGNS = [
    "invoice processing report",
    "processing results",
    "export date",
    "summary.*successful.*failed",
    "validation status",
    "parsing quality",
    "generated by",
    "confidential.*internal use",
    "invoice-results-job_",
]
REPORT_SIGN_COUNT = 2
