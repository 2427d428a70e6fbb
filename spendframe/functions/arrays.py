"""Helpers for array expressions evaluated inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` any number of times.

    Inside a lambda an outer expression would be evaluated again per element.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def integer(digits: Column, kind: str = "int") -> Column:
    """Number of an extracted run of digits, null for the empty text of a pattern without a match.

    Casting the empty text would raise and catch an exception for every text that does not match.
    """
    return let(digits, lambda shown: F.nullif(shown, F.lit("")).try_cast(kind))


def before(array: Column, index: Column, count: int) -> Column:
    """Up to ``count`` elements in front of the zero-based index."""
    start = F.greatest(index - count, F.lit(0))
    return F.slice(array, start + 1, index - start)


def after(array: Column, index: Column, count: int) -> Column:
    """Up to ``count`` elements behind the zero-based index."""
    return F.slice(array, index + 2, F.lit(count))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def folded(text: Column) -> Column:
    """A text in which lower-case ASCII words are found as case-insensitive Unicode patterns find them.

    For such patterns the dotted and the dotless i and the long s are an i and an s; lower-casing leaves or splits them.
    """
    plain = text
    for sign, letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        plain = F.replace(plain, F.lit(sign), F.lit(letter))
    return F.lower(plain)


def first_found(column: str, patterns: list[str], group: int = 1, words: list[str] | None = None, folded_column: str = "", folded_patterns: list[str] | None = None) -> Column:
    """Group of the first pattern that matches anywhere; later patterns are not tried.

    ``words`` holds for each pattern a lower-case ASCII word without which it has no match (empty: none is known).
    Where ``folded_column`` lacks it (see ``folded``), the pattern is not tried. ``folded_patterns`` holds for each
    pattern one that finds the same in that column and need not look at the case of letters (empty: none is known).

    The tries are written as one SQL expression: a rule set has some hundred
    patterns, and building each from single Column calls would cost more time on
    the driver than planning them.
    """
    searched = zip(patterns, folded_patterns or [""] * len(patterns), strict=True)
    tries = [f"nullif(regexp_extract({folded_column if lower else column}, {quoted(lower or pattern)}, {group}), '')" for pattern, lower in searched]
    if words is not None:
        tries = [f"if(contains({folded_column}, {quoted(word)}), {one}, null)" if word else one for word, one in zip(words, tries, strict=True)]
    return F.expr(f"coalesce({', '.join([*tries, 'cast(null as string)'])}, null)")


def quoted(text: str) -> str:
    """Text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
