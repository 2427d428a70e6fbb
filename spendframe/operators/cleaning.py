"""Text repair and noise removal over a corpus. One projection each, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.arrays import let
from spendframe.rules import cleaning as rules
from spendframe.rules.formats import EU, US


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda value, pair: F.regexp_replace(value, *pair), pairs, text)


def where(text: Column, sign: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """The changed text where it has a sign, else the text as it is.

    A replacement writes the whole text anew even where nothing matches; looking for a sign does not.
    """
    return let(text, lambda value: F.when(sign(value), change(value)).otherwise(value))


def having(*signs: str) -> Callable[[Column], Column]:
    """Whether a text has one of the signs."""
    return lambda value: reduce(lambda a, b: a | b, [value.contains(sign) for sign in signs])


def repair_encoding(text: Column) -> Column:
    """Undo UTF-8 read as single-byte text. Texts without a lead character pass untouched."""

    def fixed(damaged: Column) -> Column:
        return reduce(lambda value, pair: F.replace(value, F.lit(pair[0]), F.lit(pair[1])), rules.repair_pairs(), damaged)

    return where(text, having(*rules.LEAD_CHARACTERS), fixed)


def light_spaces(text: Column) -> Column:
    return fewer_lines(single_spaces(F.translate(text, "\t", " ")), 3)


def single_spaces(text: Column) -> Column:
    return where(text, having("  "), lambda value: F.regexp_replace(value, " {2,}", " "))


def fewer_lines(text: Column, most: int) -> Column:
    """No more than ``most`` line ends in a row."""
    return where(text, having("\n" * (most + 1)), lambda value: F.regexp_replace(value, f"\n{{{most + 1},}}", "\n" * most))


def light_clean(text: Column) -> Column:
    """First cleaning, before classification."""
    return light_spaces(repair_encoding(text))


EDGE = "[ \u00a0\u3000\ufeff]+"


def has_edge(text: Column) -> Column:
    """Whether a line of the text may begin or end with a space; the rare spaces count wherever they are."""
    return having("\n ", " \n", *EDGE[2:-2])(text) | text.startswith(" ") | text.endswith(" ")


def final_clean(text: Column) -> Column:
    """Collapse spaces and blank lines, trim every line and the whole."""
    spaced = where(text, having("\t", "\f", "\x0b", "\r"), lambda value: F.regexp_replace(value, r"[\t\f\x0B\r]+", " "))
    lines = where(fewer_lines(single_spaces(spaced), 2), has_edge, lambda value: F.regexp_replace(value, f"(?md)^{EDGE}|{EDGE}$", ""))
    return F.regexp_replace(lines, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")


def noise_free(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """All replacements in their order; neighbours that share a sign are tried only where the text has it."""
    for sign, group in groupby(pairs, lambda pair: rules.NOISE_SIGNS.get(pair[0], pair[0])):
        same = list(group)
        shown = having(sign) if sign in rules.PLAIN_SIGNS else lambda value, sign=sign: value.rlike(sign)
        text = where(text, shown, lambda value, same=same: replaced(value, same))
    return text


def without_noise(text: Column, format_name: Column) -> Column:
    """Noise removal of the format a document was classified as."""

    def cleaned(value: Column) -> Column:
        return (
            F.when(format_name == US, noise_free(value, rules.US_NOISE))
            .when(format_name == EU, noise_free(value, rules.EU_NOISE))
            .otherwise(noise_free(value, rules.GENERIC_NOISE))
        )

    return let(text, cleaned)


def format_clean(text: Column, format_name: Column) -> Column:
    """Second cleaning, after classification."""
    return final_clean(without_noise(repair_encoding(text), format_name))


def report_signs(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [text.rlike(f"(?i){sign}").cast("int") for sign in rules.REPORT_SIGNS])


def split_reports(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Invoices, and the generated reports found among them."""
    flagged = documents.withColumn("report_signs", F.coalesce(report_signs(F.col("text")), F.lit(0)))
    is_report = F.col("report_signs") >= rules.REPORT_SIGN_COUNT
    return flagged.where(~is_report).drop("report_signs"), flagged.where(is_report)
