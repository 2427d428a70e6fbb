"""Marketplace classification, language detection and routing.

Rule tables are compiled into one sum of flags per class, so a document is read
once and never multiplied by the rules. Each pattern is guarded by a plain
substring test on its longest literal, which most documents fail.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.arrays import quoted
from spendframe.functions.plans import held
from spendframe.operators.cleaning import light_clean
from spendframe.rules import formats, languages


def added(terms: list[str]) -> Column:
    """Sum of SQL terms, parsed in one step."""
    return F.expr(" + ".join(terms))


def hit(column: str, pattern: str, points: int = 1) -> str:
    """SQL term worth ``points`` when the column matches the pattern."""
    return f"cast({column} rlike {quoted(pattern)} as int) * {points}"


def token_score(column: str, tokens: list[tuple[int, list[str]]]) -> Column:
    """Sum of points of the tokens contained in a lower-cased text."""
    return added(
        [f"cast(contains({column}, {quoted(w.lower())}) as int) * {points}" for points, words in tokens for w in words]
    )


def format_scores(column: str) -> tuple[Column, Column]:
    return token_score(column, formats.US_TOKENS), token_score(column, formats.EU_TOKENS)


def format_of(us: Column, eu: Column) -> Column:
    """Winning format, null below the least score; the European one wins a tie."""
    weak = (us < formats.LEAST_SCORE) & (eu < formats.LEAST_SCORE)
    return F.when(~weak, F.when(eu >= us, formats.EU).otherwise(formats.US))


def confidence_of(us: Column, eu: Column) -> Column:
    winner, loser = F.greatest(us, eu), F.least(us, eu)
    contested = loser >= formats.LEAST_SCORE
    chain = F.when(winner < formats.LEAST_SCORE, 0)
    for bound, alone, rivalled in formats.CONFIDENCE_STEPS:
        chain = chain.when(winner >= bound, F.when(contested, rivalled).otherwise(alone))
    return chain.otherwise(formats.WEAKEST_CONFIDENCE)


def quality_of(confidence: Column) -> tuple[Column, Column]:
    """Quality level and action of a confidence."""
    level = action = None
    for bound, name, step in formats.QUALITY_STEPS:
        low = confidence < bound
        level = F.when(low, name) if level is None else level.when(low, name)
        action = F.when(low, step) if action is None else action.when(low, step)
    return level.otherwise(formats.BEST_QUALITY[0]), action.otherwise(formats.BEST_QUALITY[1])


def sign_hit(column: str, lowered: str, sign: str) -> str:
    """SQL term of a business or consumer sign, looked for only where the text has what every match of it holds."""
    known = formats.SIGN_TEXTS.get(sign)
    if known is None:
        return hit(column, sign)
    where = lowered if sign.startswith("(?i)") else column
    return f"cast(contains({where}, {quoted(known)}) and {column} rlike {quoted(sign)} as int)"


def subtype_of(column: str, lowered: str) -> Column:
    """Business or consumer form of a European invoice, from its text and the lower-cased text."""
    polish = (
        f"cast({column} rlike {quoted(formats.POLISH_SIGN)} and not {column} rlike {quoted(formats.POLISH_EXCEPTION)} as int)"
    )
    business = added(
        [sign_hit(column, lowered, sign) for sign in formats.BUSINESS_SIGNS]
        + [polish, hit(column, formats.GERMAN_BUSINESS, formats.GERMAN_BOOST)]
    )
    consumer = added(
        [sign_hit(column, lowered, sign) for sign in formats.CONSUMER_SIGNS]
        + [hit(column, formats.GERMAN_CONSUMER, formats.GERMAN_BOOST)]
    )
    shaped = F.col(column).rlike(formats.TABLE_BEFORE_ASIN) | F.col(column).rlike(formats.ADDRESS_BLOCK)
    return (
        F.when(business > consumer, formats.BUSINESS)
        .when(consumer > business, formats.CONSUMER)
        .otherwise(F.when(shaped, formats.BUSINESS).otherwise(formats.CONSUMER))
    )


def classified(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add scores, format, confidence, quality level, action and subtype.

    The scores are a step of their own, so every later column reads two numbers
    instead of repeating the token tests. The subtype is computed for European
    documents only.
    """
    cleaned = held(documents, {"light_text": light_clean(F.col(text))})
    lowered = held(cleaned, {"lowered": F.lower("light_text")})
    us, eu = format_scores("lowered")
    scored = held(lowered, {"us_score": us, "eu_score": eu})
    us, eu = F.col("us_score"), F.col("eu_score")
    named = scored.withColumns({"format": format_of(us, eu), "format_confidence": confidence_of(us, eu)})
    level, action = quality_of(F.col("format_confidence"))
    return named.withColumns(
        {
            "quality_level": level,
            "action": action,
            "subtype": F.when(F.col("format") == formats.EU, subtype_of("light_text", "lowered")),
        }
    ).drop("lowered")


def word_start(pattern: str) -> str:
    """The pattern where a word begins.

    Plain text that it begins with comes first and the edge of the word is looked for behind it: an engine skips to plain
    text, but tries an edge at each place.
    """
    plain = re.match(r"(?:\\[^\w\s]|[^\\\[\](){}.*+?^$|])*", pattern).group()
    if re.match(r"[*+?{]", pattern[len(plain) :]):
        plain = re.sub(r"\\?.\Z", "", plain)
    return rf"(?U){plain}(?<=\b{plain}){pattern[len(plain) :]}" if plain else rf"(?U)\b{pattern}"


def phrase_pattern(phrase: str) -> str:
    return word_start(phrase.replace(" ", r"\s+")) + r"\b"


def literal_of(phrase: str) -> str:
    """Longest piece of a phrase or pattern that is plain text."""
    pieces = re.split(r"\\d\{1,2\}|\\s\+|\\d| ", phrase)
    return max((piece.replace("\\", "") for piece in pieces), key=len)


def phrase_sign(column: str, phrase: str, pattern: str) -> str:
    """SQL flag of a phrase, guarded by a plain substring test that most texts fail."""
    return f"cast(contains({column}, {quoted(literal_of(phrase))}) and {column} rlike {quoted(pattern)} as int)"


def money_guard(column: str, pattern: str) -> str:
    """Plain test for the marks without which an amount pattern has no match."""
    marks = [mark for mark in ("€", "$", "£", "¥", "CHF") if mark in pattern.replace(r"\$", "$")]
    return "(" + " or ".join(f"contains({column}, {quoted(mark)})" for mark in marks) + ")"


def language_signs(column: str, language: languages.Language) -> list[tuple[str, int | None]]:
    """SQL of each sign of a language with its points; no points where the sign counts hits that are limited together."""
    signs = [(phrase_sign(column, p, phrase_pattern(p)), languages.STRONG_POINTS) for p in language.strong]
    signs += [(phrase_sign(column, p, word_start(p)), languages.STRONG_POINTS) for p in language.open_ended]
    signs += [(phrase_sign(column, p, phrase_pattern(p)), languages.MEDIUM_POINTS) for p in language.medium]
    if language.money_limit is None:
        either = "|".join(language.money)
        signs.append((f"cast({money_guard(column, either)} and {column} rlike {quoted(either)} as int)", languages.STRONG_POINTS))
    else:
        signs += [(f"if({money_guard(column, p)}, regexp_count({column}, {quoted(p)}), 0)", None) for p in language.money]
    signs.append((f"cast({column} rlike {quoted(language.dates)} as int)", languages.DATE_POINTS))
    return signs


def language_points(signs: list[tuple[str, int | None]], names: dict[str, str], limit: int | None) -> Column:
    """Points of one language in hundredths, capped, from the columns of its signs."""
    terms = [f"{names[sign]} * {points}" for sign, points in signs if points is not None]
    counts = [names[sign] for sign, points in signs if points is None]
    if counts:
        terms.append(f"least(({' + '.join(counts)}) * {languages.MONEY_POINTS}, {limit})")
    return F.least(added(terms), F.lit(languages.CAP_POINTS))


def detected_language(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``language`` and ``language_confidence``; the earlier language wins a tie.

    Languages share many of their signs. Every different sign is looked for once in a text, and the languages add up
    points from the answers.
    """
    upper = held(documents, {"upper_text": F.upper(F.coalesce(F.col(text), F.lit("")))})
    signs = {language.code: language_signs("upper_text", language) for language in languages.LANGUAGES}
    names = {sign: f"sign_{i}" for i, sign in enumerate(dict.fromkeys(sign for found in signs.values() for sign, _ in found))}
    seen = held(upper, {name: F.expr(sign) for sign, name in names.items()}, documents.columns)
    points = {f"points_{language.code}": language_points(signs[language.code], names, language.money_limit) for language in languages.LANGUAGES}
    pointed = held(seen, points, documents.columns)
    entries = [
        F.struct(F.col(name).alias("points"), F.lit(-rank).alias("rank"), F.lit(language.code).alias("code"))
        for rank, (name, language) in enumerate(zip(points, languages.LANGUAGES))
    ]
    best = held(pointed, {"best": F.array_max(F.array(*entries))}, documents.columns)
    known = F.col("best.points") >= languages.LEAST_POINTS
    return best.withColumns(
        {
            "language": F.when(known, F.col("best.code")).otherwise(languages.UNKNOWN),
            "language_confidence": F.col("best.points").cast("double") / 100.0,
            "language_evidence": F.when(F.col("best.points") == 0, "No language patterns detected")
            .when(~known, "Low confidence detection")
            .otherwise("Language patterns detected"),
            "language_supported": known,
        }
    ).drop("best")


def eu_language(column: str) -> Column:
    """Language of a European invoice by votes; the later language wins a tie, English if none votes."""
    entries = [
        F.struct(
            added([hit(column, f"(?iu){sign}") for sign in signs]).alias("votes"),
            F.lit(rank).alias("rank"),
            F.lit(code).alias("code"),
        )
        for rank, (code, signs) in enumerate(formats.EU_LANGUAGE_SIGNS.items())
    ]
    best = F.array_max(F.array(*entries))
    return F.when(best["votes"] > 0, best["code"]).otherwise("en")


def route_of() -> Column:
    """Rule set from ``format``, ``subtype`` and ``language``."""
    by_language = None
    for code, name in formats.LANGUAGE_ROUTES.items():
        hit = F.col("language") == code
        by_language = F.when(hit, name) if by_language is None else by_language.when(hit, name)
    by_language = by_language.otherwise(formats.DEFAULT_ROUTE)
    eu = F.when(F.col("subtype") == formats.BUSINESS, "eu_business").otherwise("eu_consumer")
    return (
        F.when(F.col("format") == formats.US, "us")
        .when(F.col("format") == formats.EU, eu)
        .otherwise(by_language)
    )
