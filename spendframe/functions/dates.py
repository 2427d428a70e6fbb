"""Written dates in several languages to DATE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, January to December.
MONTHS = {
    "en": ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"],
    "de": ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"],
    "fr": ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"],
    "es": ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"],
    "it": ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"],
}

# Language names and their codes.
LANGUAGE_CODES = {
    "English": "en", "French": "fr", "German": "de", "Spanish": "es", "Italian": "it", "Japanese": "ja", "Dutch": "nl",
    "Swedish": "sv", "Portuguese": "pt", "Chinese": "zh", "Russian": "ru", "Arabic": "ar", "Hindi": "hi", "Korean": "ko",
}

MONTH_NUMBERS = {name: number for names in MONTHS.values() for number, name in enumerate(names, 1)}
DAY_FIRST_LANGUAGES = ["de", "fr", "es", "it", "en-gb"]

NAME_FIRST = r"^(\p{L}+)\s+(\d{1,2}),?\s+(\d{4})$"
DAY_NAME = r"^(\d{1,2})(?:er|\.)?\s*(\p{L}+)\s+(\d{4})$"
NUMERIC = r"^(\d{1,2})([/.-])(\d{1,2})[/.-](\d{4})$"
YEAR_FIRST = r"^(\d{4})(?:[/.-]|年)(\d{1,2})(?:[/.-]|月)(\d{1,2})日?$"


def constant_map(values: dict) -> Column:
    """Map literal, parsed in one step."""
    return F.expr("map(" + ", ".join(f"{key!r}, {value!r}" for key, value in values.items()) + ")")


def month_number(name: Column) -> Column:
    return F.element_at(constant_map(MONTH_NUMBERS), F.lower(name))


def language_code(name: Column) -> Column:
    return F.coalesce(F.element_at(constant_map(LANGUAGE_CODES), name), F.lit("en"))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month.cast("string"), day), "yyyy-M-d")


def written_date(text: Column, language: Column | str = "en") -> Column:
    """DATE of a written date, null if it is none.

    Month names of all languages are known. Two numbers before the year are day
    first, except with slashes in English, which are month first if that is a date (not in British English).
    """
    shown = F.trim(text)
    code = F.lit(language) if isinstance(language, str) else F.lower(language)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(shown, pattern, group)

    first, second, year = part(NUMERIC, 1), part(NUMERIC, 3), part(NUMERIC, 4)
    day_first = _date(year, second, first)
    month_first = F.coalesce(_date(year, first, second), day_first)
    numeric = F.when((part(NUMERIC, 2) == "/") & ~code.isin(DAY_FIRST_LANGUAGES), month_first).otherwise(day_first)
    return (
        F.when(shown.rlike(NUMERIC), numeric)
        .when(shown.rlike(NAME_FIRST), _date(part(NAME_FIRST, 3), month_number(part(NAME_FIRST, 1)), part(NAME_FIRST, 2)))
        .when(shown.rlike(DAY_NAME), _date(part(DAY_NAME, 3), month_number(part(DAY_NAME, 2)), part(DAY_NAME, 1)))
        .when(shown.rlike(YEAR_FIRST), _date(part(YEAR_FIRST, 1), part(YEAR_FIRST, 2), part(YEAR_FIRST, 3)))
    )


def report_date(text: Column) -> Column:
    """DATE of an invoice date in a report: numbers are day first."""
    return written_date(text, "de")


def plausible(day: Column, first_year: int = 2000, last_year: int = 2099) -> Column:
    """A real date in a range of years, for dates that no label marks as the date of the order."""
    return F.coalesce(F.year(day).between(first_year, last_year), F.lit(False))
