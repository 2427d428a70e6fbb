"""Very long and broken inputs take time in proportion to their length; results stay whole."""

import time

import pytest
from pyspark.sql import functions as F

from spendframe.llm import decontam, lines, pages

SECONDS = 60


@pytest.fixture
def clock():
    start = time.monotonic()
    yield
    assert time.monotonic() - start < SECONDS


def test_words_between_a_million_separators(docs_of, spark, clock):
    item = "one two three four five six"
    rows = [(1, "a" + "-" * 1_000_000 + "b"), (2, " " * 1_000_000 + item + "\n" * 1_000_000), (3, "." * 1_000_000)]
    items = spark.createDataFrame([(7, item, "x")], "item_id long, text string, shared string")
    assert [(r.doc_id, r.item_id, r.shared) for r in decontam.contained(docs_of(rows), items).collect()] == [(2, 7, 2)]


def test_short_and_repeated_items(docs_of, spark):
    rows = [(1, "The quick, brown FOX jumps"), (2, "quick brown"), (3, "brown quick"), (4, None), (None, "quick brown"), (5, "one two three four five"), (5, "one two three four five")]
    items = spark.createDataFrame(
        [(1, "Quick brown"), (1, "Quick brown"), (2, "fox"), (3, ""), (4, None), (5, "absent words"), (6, "one two three four five"), (None, "brown")], "item_id long, text string"
    )
    found = {(r.doc_id, r.item_id, r.shared, r.n_shingles) for r in decontam.contained(docs_of(rows), items).collect()}
    assert found == {(1, 1, 1, 1), (2, 1, 1, 1), (None, 1, 1, 1), (1, 2, 1, 1), (5, 6, 1, 1), (1, None, 1, 1), (2, None, 1, 1), (3, None, 1, 1), (None, None, 1, 1)}
    kept = decontam.clean(docs_of(rows), items)
    assert {r.doc_id for r in kept.collect()} == {4} and kept.columns == docs_of(rows).columns


def test_words_are_those_of_the_pattern(spark):
    texts = ["--a--b--", "", "  ", "Ä1 ö_x", "x"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(decontam.words(F.col("t"))).collect()] == [["a", "b"], [], [], ["ä1", "ö", "x"], ["x"]]


def test_a_hundred_thousand_different_lines(docs_of, clock):
    shared = "shared line"
    long = "\n".join(f"line {i}" if i % 10_000 else shared for i in range(100_000))
    rows = [(1, long), (2, long + "\nend")] + [(10 + i, f"own {i}\n{shared}") for i in range(8)]
    found = {r.doc_id: r for r in lines.drop_common(docs_of(rows), min_documents=10).select("doc_id", "n_lines", "n_dropped", F.md5("kept_text").alias("md5"), F.length("kept_text").alias("size")).collect()}
    assert (found[1].n_lines, found[1].n_dropped) == (100_000, 10) and (found[2].n_lines, found[2].n_dropped) == (100_001, 10)
    assert found[1].size == len(long) - 10 * (len(shared) + 1) and (found[10].n_lines, found[10].n_dropped, found[10].size) == (2, 1, 5)


@pytest.mark.parametrize(
    "html",
    ['<a x="' * 170_000, '<a x="' * 170_000 + ">", "<a " * 330_000, "<span>" * 100_000 + "</b>" * 100_000, "<span>" * 80_000 + "<div></div>" * 50_000,
     "<script " * 120_000, "<script>" + "</script" * 120_000, "<!--" * 250_000, "<p><b>" * 160_000, "<" * 1_000_000, "<a '\"" * 200_000, "<div>" * 200_000],
    ids=["quotes", "quotes-closed", "open-tags", "unmatched", "blocks-in-spans", "raw-open", "raw-close", "comments", "implied", "angles", "mixed-quotes", "deep"],
)
def test_a_megabyte_of_broken_markup(html):
    start = time.monotonic()
    pages.text_of(pages.read("<p>before</p>" + html), None)
    assert time.monotonic() - start < 20


def test_tags_are_read_as_written():
    def tags(html):
        return [found[2:] for found in pages.Scanner(html).tags() if found[3]]

    assert tags('<a href="x>y" class=\'b>\'>t</a>') == [("", "a", " href=\"x>y\" class='b>'"), ("/", "a", "")]
    assert tags('<a href="x>y') == [("", "a", ' href="x')]  # a quote that never ends is part of no value
    assert tags("<!-- <p> --><p><script>if (a<b) '<p>'</script><br/>") == [("", "p", ""), ("", "br", "/")]
    assert tags("a < b <1> <p") == []
