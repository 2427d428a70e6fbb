"""Main text of web pages, from the container that the pages of a host agree on."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import common

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SKIPPED = frozenset("head nav header footer aside form menu dialog button select option svg math canvas template object audio video".split()) | RAW
CONTAINERS = frozenset("html body main article section div td center blockquote".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption pre address figure figcaption details summary hgroup fieldset hr".split())
LISTS = frozenset("ul ol dl table".split())
# What the start of a block ends if it is still open.
IMPLIED_BY_ALL = frozenset({"p"})
IMPLIED = {name: frozenset(ends.split()) | {"p"} for name, ends in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}.items()}
# Words in classes, ids and roles that name what is no part of an article.
NAMED_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside rail widget widgets footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login comment comments commentlist respond reply replies disqus discussion share sharing social related recommended "
    "recommendations pagination pager search searchform toolbar skip hidden complementary contentinfo".split()
)
# Parts of names that say something about what is beside an element, as in has-sidebar.
ABOUT_OTHERS = frozenset("has with no without".split())
TAG_NAME = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
RAW_NAME = re.compile(rf"<({'|'.join(sorted(RAW))})(?![\w:-])", re.I)
RAW_END = {name: re.compile(rf"</{name}(?![\w:-])", re.I) for name in RAW}
ENDS_VALUE_OR_TAG = re.compile("[>\"']")
TELLING = re.compile(r"class|id|role|hidden", re.I)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PARTS = re.compile(r"[a-z]+|[0-9]+")
DIGITS = re.compile(r"\d+")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)"
VOTE = "struct<path: string, weight: double>"
RESULTS = ("text", "n_chars")


@dataclass
class Node:
    """A container; its path is a number, as the texts of deep paths would grow with the square of the depth."""

    path: int
    parent: int
    good: int = 0
    bad: int = 0


@dataclass
class Page:
    """Containers in page order, their distinct paths, and the blocks of text that lie in them.

    A path is the path above it and one step, with its depth and the length of its text.
    """

    nodes: list[Node] = field(default_factory=lambda: [Node(0, -1)])
    blocks: list[tuple[int, str]] = field(default_factory=list)
    paths: list[tuple[int, str, int, int]] = field(default_factory=lambda: [(-1, "", 0, 0)])
    numbers: dict[tuple[int, str], int] = field(default_factory=dict)

    def below(self, path: int, step: str) -> int:
        found = self.numbers.setdefault((path, step), len(self.paths))
        if found == len(self.paths):
            _, _, depth, size = self.paths[path]
            self.paths.append((path, step, depth + 1, size + 1 + len(step)))
        return found

    def text_of_path(self, path: int) -> str:
        steps = []
        while path > 0:
            path, step, *_ = self.paths[path]
            steps.append("/" + step)
        return "".join(reversed(steps))

    def number_of_path(self, text: str) -> int | None:
        same = (number for number, (*_, size) in enumerate(self.paths) if size == len(text))
        return next((number for number in same if self.text_of_path(number) == text), None)


@lru_cache(maxsize=20_000)
def is_noise(name: str, attributes: str) -> bool:
    if name in SKIPPED:
        return True
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = "".join(values).lower(), key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id", "role") and name not in ("html", "body"):
            for parts in map(NAME_PARTS.findall, value.split()):
                if NAMED_NOISE.intersection(parts) and not ABOUT_OTHERS.intersection(parts):
                    return True
    return False


@lru_cache(maxsize=20_000)
def step_of(name: str, attributes: str) -> str:
    """Tag and classes, with every run of digits as one 0."""
    classes = next(("".join(values) for key, *values in ATTRIBUTE.findall(attributes) if key.lower() == "class"), "")
    return name + "".join("." + DIGITS.sub("0", c) for c in sorted(classes.lower().split()))


class Scanner:
    """The tags of a page, each found in one pass over it however its quotes and angles are broken.

    Comments, declarations and elements whose content is raw are passed over whole. A quote that never ends is part of
    no value: the tag then ends at the next angle. What lies behind the last angle of the page is no tag.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.last_quote = {quote: html.rfind(quote) for quote in "\"'"}
        # Where a tag ends that is outside of quotes at a place; -1 where it does not.
        self.ends: dict[int, int] = {}

    def end_of(self, place: int) -> int:
        passed, end = [], None
        while end is None:
            if place in self.ends:
                end = self.ends[place]
                break
            passed.append(place)
            found = ENDS_VALUE_OR_TAG.search(self.html, place)
            if found is None:
                end = -1
            elif found[0] == ">":
                end = found.end()
            elif found.start() >= self.last_quote[found[0]]:
                end = -1
            else:
                place = self.html.find(found[0], found.end()) + 1
        for place in passed:
            self.ends[place] = end
        return end

    def until(self, mark: str, place: int) -> int:
        """Behind the next mark, or the end of the page."""
        found = self.html.find(mark, place)
        return len(self.html) if found < 0 else found + len(mark)

    def tags(self) -> Iterator[tuple[int, int, str, str, str]]:
        """Start, end, slash of an end tag, name (empty for what is no tag) and attributes."""
        html, at = self.html, 0
        while True:
            start = html.find("<", at)
            if start < 0:
                return
            at, sign = start + 1, html[start + 1 : start + 2]
            if sign in ("!", "?"):
                at = self.until("-->", start + 4) if html.startswith("<!--", start) else self.until(">", start)
                yield start, at, "", "", ""
                continue
            named = TAG_NAME.match(html, start) if start < self.last else None
            if named is None:
                continue
            raw = RAW_NAME.match(html, start)
            if raw is not None:
                closing = RAW_END[raw[1].lower()].search(html, self.until(">", raw.end()))
                at = len(html) if closing is None else self.until(">", closing.end())
                yield start, at, "", "", ""
                continue
            end = self.end_of(named.end())
            at = end if end > 0 else html.find(">", named.end()) + 1
            yield start, at, named[1], named[2], html[named.end() : at - 1]


def read(html: str) -> Page:
    """Containers and text blocks of a page, however broken its markup is.

    An element that is no content hides its text, which counts against the containers around it. Blocks end
    where block elements begin or end; text outside of any container belongs to the page.
    """
    page = Page()
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, container, hidden, link
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    at = linked = 0

    def flush() -> None:
        nonlocal linked
        if not parts:
            return
        text = "".join(parts)
        text = " ".join((unescape(text) if "&" in text else text).split())
        if text:
            _, container, hidden, _ = stack[-1]
            node = page.nodes[container]
            if hidden:
                node.bad += len(text)
            else:
                page.blocks.append((container, text))
                node.good += max(0, len(text) - 2 * linked)
                node.bad += linked
        parts.clear()
        linked = 0

    for start, end, close, name, rest in Scanner(html).tags():
        if start > at:
            parts.append(html[at:start])
            if stack[-1][3]:
                linked += start - at
        at = end
        if not name:
            continue
        name = name.lower()
        if close:
            if open_names[name]:
                if name in BLOCKS or name in SKIPPED:
                    flush()
                while True:
                    ended = stack.pop()[0]
                    open_names[ended] -= 1
                    if ended == name:
                        break
            continue
        if name == "br":
            parts.append(" ")
            continue
        noise = name in SKIPPED or bool(rest and TELLING.search(rest) and is_noise(name, rest))
        block = name in BLOCKS
        if block or noise:
            flush()
        if block:
            implied = IMPLIED.get(name, IMPLIED_BY_ALL)
            for depth in range(len(stack) - 1, 0, -1) if any(open_names[ends] for ends in implied) else ():
                above = stack[depth][0]
                if above in implied:
                    for entry in stack[depth:]:
                        open_names[entry[0]] -= 1
                    del stack[depth:]
                    break
                if above in CONTAINERS or above in LISTS:
                    break
        if name in VOID or rest.endswith("/") and not block:
            continue
        _, container, hidden, link = stack[-1]
        hidden = hidden or noise
        if not hidden and name in CONTAINERS:
            page.nodes.append(Node(page.below(page.nodes[container].path, step_of(name, rest)), container))
            container = len(page.nodes) - 1
        stack.append((name, container, hidden, link or name == "a"))
        open_names[name] += 1
    parts.append(html[at:])
    flush()
    return page


def best(page: Page) -> tuple[int, float]:
    """The path whose containers hold the most text, less what in them is links or no content."""
    good, bad = [n.good for n in page.nodes], [n.bad for n in page.nodes]
    for i in range(len(page.nodes) - 1, 0, -1):
        good[page.nodes[i].parent] += good[i]
        bad[page.nodes[i].parent] += bad[i]
    scores: dict[int, list[float]] = {}
    for i, node in enumerate(page.nodes):
        held = scores.setdefault(node.path, [0.0, 0.0])
        held[0] += good[i] - bad[i]
        held[1] += good[i]
    if not page.blocks:
        return 0, 0.0
    # Of equal scores the deepest path wins, as its containers hold nothing else, then the last by name.
    most = max((scores[path][0], page.paths[path][2]) for path in scores)
    path = max((path for path in scores if (scores[path][0], page.paths[path][2]) == most), key=page.text_of_path)
    return path, max(scores[path][1], 0.0)


def vote_of(page: Page) -> tuple[str, float]:
    path, weight = best(page)
    return page.text_of_path(path), weight


def text_of(page: Page, path: str | None) -> str:
    """All blocks in containers of the path, or in those of the page's own best path where it has none."""
    for wanted in (path, None):
        chosen = best(page)[0] if wanted is None else page.number_of_path(wanted)
        if chosen is None:
            continue
        inside = [False] * len(page.nodes)
        for i, node in enumerate(page.nodes):
            inside[i] = node.path == chosen or (node.parent >= 0 and inside[node.parent])
        lines = [text for container, text in page.blocks if inside[container]]
        if lines:
            return "\n".join(lines)
    return ""


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def votes(html: Column) -> Column:
    @F.arrow_udf(VOTE)
    def of_batch(pages: pa.Array) -> pa.Array:
        found = [vote_of(read(page)) for page in pages.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([w for _, w in found], pa.float64())], ["path", "weight"])

    return of_batch(F.coalesce(html.cast("string"), F.lit("")))


def texts(html: Column, path: Column) -> Column:
    @F.arrow_udf("string")
    def of_batch(pages: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([text_of(read(page), own) for page, own in zip(pages.to_pylist(), paths.to_pylist(), strict=True)], pa.string())

    return of_batch(F.coalesce(html.cast("string"), F.lit("")), path)


def host_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The winning path of each host: every page gives its best path one vote, ties go to more text, then by name."""
    cast = pages.select(host_of(pages[url]).alias("_host"), votes(pages[html]).alias("_vote"))
    counted = cast.filter("_vote.weight > 0").groupBy("_host", F.col("_vote.path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum("_vote.weight").alias("w"))
    return counted.groupBy("_host").agg(F.max_by("path", F.struct("n", "w", "path")).alias("_path"))


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Every page with its main text and the text's length in code points.

    Pages are read twice: first each scores its containers and votes for a path of tags and classes, counted
    per host with partial sums; then each is read by the path that won on its host, or by its own best path
    where it has no such container. One row per host and path is all that is grouped, and the paths are stored
    before they are joined, so the planner knows their size; a host with very many pages is a skewed key with
    one row on the other side.

    Null and empty pages, and pages without text, have an empty text. Pages without a host share one. Repeated
    rows are all kept; an empty table gives an empty table. Input columns named text or n_chars are replaced.
    """
    names = list(pages.columns)
    chosen = common.stored(host_paths(pages, html, url))
    rows = pages.select(common.packed(pages).alias("_row"), pages[html].cast("string").alias("_html"), host_of(pages[url]).alias("_host"))
    read_again = rows.join(chosen, "_host", "left").select("_row", texts(F.col("_html"), F.col("_path")).alias("_text"))
    return read_again.select(*common.unpacked("_row", names, set(RESULTS)), F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
