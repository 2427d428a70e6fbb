"""Boolean trigram queries of regular expressions."""

from __future__ import annotations

import re
from re import _constants as codes
from re import _parser as parser

# A class of more characters, or more states than this, is taken as a gap: the query gets weaker, never wrong.
CLASS_CHARS = 8
STATES = 256
# Copies of a repeated part that are followed letter by letter.
COPIES = 4

GAP = ""
State = tuple[frozenset[str], str]


def spelled(states: set[State], letters: str) -> set[State]:
    """The states after one more character, which is any of ``letters``."""
    after = set()
    for grams, tail in states:
        for letter in letters.lower():
            run = tail + letter
            after.add((grams | {run} if len(run) == 3 else grams, run[-2:]))
    return held(after)


def held(states: set[State]) -> set[State]:
    if len(states) <= STATES:
        return states
    return {(frozenset.intersection(*[grams for grams, _ in states]), GAP)}


def gap(states: set[State]) -> set[State]:
    return {(grams, GAP) for grams, _ in states}


def class_letters(members: list) -> str | None:
    """The characters of a class, if they are few, ASCII, and named one by one or as ranges."""
    letters = ""
    for kind, value in members:
        if kind is codes.LITERAL:
            letters += chr(value)
        elif kind is codes.RANGE and value[1] - value[0] < CLASS_CHARS:
            letters += "".join(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return letters if 0 < len(letters) <= CLASS_CHARS and letters.isascii() else None


def walked(states: set[State], part: list) -> set[State]:
    for kind, value in part:
        if kind in (codes.LITERAL, codes.IN):
            letters = class_letters(value if kind is codes.IN else [(kind, value)])
            states = gap(states) if letters is None else spelled(states, letters)
        elif kind is codes.SUBPATTERN:
            states = walked(states, value[3])
        elif kind is codes.BRANCH:
            states = held(set().union(*[walked(states, branch) for branch in value[1]]))
        elif kind in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
            least, most, repeated = value
            for _ in range(min(least, COPIES)):
                states = walked(states, repeated)
            if (least, most) == (0, 1):
                states = held(states | walked(states, repeated))
            elif most != least or least > COPIES:
                states = gap(states)
        elif kind in (codes.AT, codes.ASSERT, codes.ASSERT_NOT):
            continue  # no character is consumed
        else:
            states = gap(states)
    return states


def clauses(pattern: str) -> list[list[str]]:
    """Sets of lower-case trigrams of which every match, put in lower case, holds at least one set as a whole.

    An empty list says that the pattern has no trigram that it always needs, so all texts have to be read.
    """
    found = {grams for grams, _ in walked({(frozenset(), GAP)}, list(parser.parse(pattern, re.ASCII)))}
    least = [grams for grams in found if not any(other < grams for other in found)]
    return [] if frozenset() in least else sorted(sorted(grams) for grams in least)
