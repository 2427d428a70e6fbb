"""A text is looked through once for each thing that is read from it, and only for labels whose words it has."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spendframe.functions.arrays import first_found, folded, integer
from spendframe.functions.plans import held
from spendframe.operators import classify, cleaning, extract, items
from spendframe.rules import cleaning as noise
from spendframe.rules import fields as rules

EVERY = {**rules.RULE_SETS, "generic": rules.GENERIC}


def searches(column):
    """How many pattern searches an expression holds; inside lambdas each of them is made."""
    return len(re.findall(r"(?i)regexp_extract|rlike|regexp_replace", str(column)))


@pytest.mark.parametrize("name", ["german", "english", "uk", "japanese", "swiss", "generic"])
def test_an_item_reader_holds_each_search_few_times(spark, name):
    assert searches(items.read(F.col("clean_text"), EVERY[name])) <= 80


def test_the_currency_does_not_search_for_the_amounts_again(spark):
    known = replace(rules.GENERIC, currency="EUR")
    more = searches(extract.header("clean_text", rules.GENERIC)) - searches(extract.header("clean_text", known))
    assert more <= 2 * len(rules.CURRENCY_SIGNS)


def test_the_word_of_a_label_is_part_of_every_match():
    assert rules.leading_word(r"(?iu)Subtotale?[:\s]*(x)") == "subtotal"
    assert rules.leading_word(r"(?iu)Tax(\d+)|Due(\d+)") == ""
    assert rules.leading_word(r"(?iu)Tax[:\s]*((?:USD|EUR)\d+)") == "tax"
    assert rules.leading_word(r"ab?c{0,2}de(f)") == "de"
    assert rules.leading_word(r"(?iu)合計[:\s]*(\d+)") == ""


ODD_CASES = ["SUBTOTAL: $5", "\u017fubtotal: $5", "Sh\u0130pping $7 sh\u0131pping: $9", "\u00df Tax $3", "T\u0130p Tax: $2 TAX $4", "none", "\u212areditkarte"]


def test_labels_are_found_in_any_case_as_the_patterns_alone_find_them(spark):
    texts = spark.createDataFrame([(text,) for text in ODD_CASES], "clean_text string")
    frame = held(texts, {"folded_text": folded(F.col("clean_text"))})
    for name in ("us", "english", "eu_consumer", "generic"):
        fields = [rules.amount_patterns(EVERY[name], field) for field in extract.MONEY]
        guarded = F.struct(*[extract.labelled("clean_text", patterns) for patterns in fields])
        alone = F.struct(*[first_found("clean_text", patterns) for patterns in fields])
        rows = frame.select(F.to_json(guarded).alias("guarded"), F.to_json(alone).alias("alone")).collect()
        assert [re.findall(r":(.*?)[,}]", row.guarded) for row in rows] == [re.findall(r":(.*?)[,}]", row.alone) for row in rows]


def test_digits_that_are_missing_are_no_number(spark):
    frame = spark.createDataFrame([("",), ("12",), ("99999999999",), (None,)], "shown string")
    assert [row[0] for row in frame.select(integer(F.col("shown"))).collect()] == [None, 12, None, None]


def test_a_replacement_is_tried_only_where_the_text_has_its_sign(spark):
    odd = ["", "a  b", "x\n\n\n\n\ny", " a \n b　", "﻿a\t\tb\r\n", "Seite 1 von 2 PÁGINA 3 de 4", "well- \n known [ ] [x] [____]", "1,50€", "-----", "pAgE 1 OF 2 (Seller Profile)"]
    texts = spark.createDataFrame([(text,) for text in [*odd, None]], "text string")
    for pairs in (noise.US_NOISE, noise.EU_NOISE, noise.GENERIC_NOISE):
        rows = texts.select(cleaning.noise_free(F.col("text"), pairs).alias("a"), cleaning.replaced(F.col("text"), pairs).alias("b")).collect()
        assert [row.a for row in rows] == [row.b for row in rows]
    assert set(noise.NOISE_SIGNS) <= {pattern for pair in (noise.US_NOISE, noise.EU_NOISE, noise.GENERIC_NOISE) for pattern, _ in pair}


def test_folded_patterns_find_what_the_patterns_find(spark):
    assert rules.folded_pattern(r"(?iu)Grand\s+Total[:\s]*\$?([\d,]+)") == r"grand\s+total[:\s]*\$?([\d,]+)"
    assert rules.folded_pattern(r"(?iu)Order[:\s]*([A-Za-z]+ \d)") == ""
    odd = [*ODD_CASES, "Subtotal: 5,00 € Total: 6,00 €", "x-Total 7,00 € TOTAL 8,00 €", "Bestell-Nr. 123-1234567-1234567", "GESAMT\n9,00 €"]
    frame = held(spark.createDataFrame([(text,) for text in odd], "clean_text string"), {"folded_text": folded(F.col("clean_text"))})
    for rule_set in EVERY.values():
        patterns = [p for field in extract.MONEY for p in rules.amount_patterns(rule_set, field)] + rules.order_patterns(rule_set)
        known = [(p, rules.folded_pattern(p)) for p in patterns if rules.folded_pattern(p)]
        both = [[F.regexp_extract(column, p, 1) for p in side] for column, side in zip(("clean_text", "folded_text"), zip(*known or [("x()", "x()")]))]
        for row in frame.select(F.array(*both[0]).alias("a"), F.array(*both[1]).alias("b")).collect():
            assert row.a == row.b


def test_words_begin_where_an_edge_of_a_word_is(spark):
    texts = ["TOTAL 5", "SUBTOTAL 5", "ÉTOTAL", "-TOTAL", "IVA 21", "OLIVA 2", "2020年1月2日", "x TAX", "AMAZON.DE", "XAMAZON.DE"]
    frame = spark.createDataFrame([(text,) for text in texts], "t string")
    for pattern in ("TOTAL", r"IVA\s+\d", r"年\d{1,2}月", "TAX", r"AMAZON\.DE", "TOTALE?"):
        for row in frame.select(F.col("t").rlike(classify.word_start(pattern)).alias("a"), F.col("t").rlike(rf"(?U)\b{pattern}").alias("b")).collect():
            assert row.a == row.b


def test_held_columns_are_compiled_and_not_interpreted_by_the_generator(spark):
    plan = held(spark.range(1).withColumn("t", F.lit("a")), {"x": F.transform(F.split("t", ""), F.upper)})._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Generate" in line and "transform" not in line]
    assert not [line for line in plan.splitlines() if "Generate" in line and "transform" in line]
