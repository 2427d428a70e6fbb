"""From texts to scores: assessment in the row, price repair, fallback reading, schema stage, sections, streams."""

import datetime
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spendframe.operators import assess, compare, extract, items, quality, reports, schema
from spendframe.plans import catalog, pipeline
from spendframe.rules import fields
from spendframe.sources import corpus, star
from spendframe.streaming import jobs as stream

SMALL = "/root/testdata/sf0.001"
AS_OF = "2024-06-30"


def read(spark, text, rule_set, **options):
    frame = spark.createDataFrame([("d", rule_set, text)], "doc_id string, rule_set string, clean_text string")
    return extract.extracted(frame, [rule_set], **options)


def block(*lines, head="", tail=""):
    return head + "Zahnbuerste mit Reiseladeetui, schwarz\nASIN: B0F3D9YC75\n" + "\n".join(lines) + "\n" + tail


# --- assessment -----------------------------------------------------------------------------------------------------


def test_row_assessment_equals_the_tables(spark):
    """Folds over the items of a row give what joins of invoices and items give."""
    read_ = catalog.assessable_corpus(spark, SMALL).where("order_id % 5 = 0").cache()
    lines = items.exploded(read_, ["order_id"])
    header = read_.select("order_id", *assess.HEADER, F.col("order_date").cast("string").alias("order_date"), F.when(F.col("several_subtotals"), "Sous-total Sous-total").alias("raw_text"))

    def rows(frame, *names):
        return sorted(map(tuple, frame.select(*names).collect()))

    scored = assess.assessed(read_, AS_OF, ["order_id"])
    names = ["order_id", "errors", "warnings", "score", "is_valid", "summary"]
    assert rows(scored, *names) == rows(quality.score(header, lines, AS_OF), *names)
    other = quality.parser_score(header, lines).select("order_id", F.col("score").alias("parser_score"), F.col("summary").alias("parser_summary"))
    assert rows(scored, "order_id", "parser_score", "parser_summary") == rows(other, "order_id", "parser_score", "parser_summary")
    metrics = quality.extraction_metrics(header, lines)
    assert rows(scored, *metrics.columns) == rows(metrics, *metrics.columns)
    issue = ["order_id", "level", "type", "severity", "message"]
    assert rows(assess.issues(read_, AS_OF, ["order_id"]), *issue) == rows(quality.issues(header, lines, AS_OF), *issue)
    read_.unpersist()


def test_assessment_makes_no_shuffle(spark):
    documents = spark.createDataFrame([("d", "x")], "doc_id string, text string")
    plan = pipeline.assessed(documents, AS_OF, names=["us"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_repeated_subtotals_and_prices(spark):
    text = (
        "Amazon.com Order #123-4567890-1234567\nOrder Placed: May 3, 2020\nItem(s) Subtotal: $10.00\nGrand Total: $99.00\n"
        "Item(s) Subtotal: $10.00\n1 of: Mug\n$4.00\n1 of: Jug\n$1,500.00"
    )
    documents = spark.createDataFrame([("once", text.replace("Item(s) Subtotal", "Sum", 1)), ("twice", text)], "doc_id string, text string")
    found = {}
    for row in assess.issues(pipeline.assessable(documents, names=["us"]), AS_OF).collect():
        found.setdefault(row.doc_id, {})[row.type] = row.severity
    assert found["twice"]["mathematical_inconsistency"] == "low" and found["once"]["mathematical_inconsistency"] == "medium"

    line = "struct<asin:string,description:string,quantity:int,unit_cents:bigint,total_cents:bigint,price:string>"
    rows = [("A", "x", 1, 500, 500, None), ("B", "y", 1, 700, 700, None), ("A", "x", 1, 500, 500, None), ("A", "x", 1, 900, 900, None), (None, "z", 1, 1, 1, None), ("", "z", 1, 2, 2, None)]
    frame = spark.createDataFrame([(rows,), ([],)], f"lines array<{line}>").select(assess.repeated_products(F.col("lines")).alias("p"))
    assert [[tuple(p) for p in row.p] for row in frame.collect()] == [[("A", 2, 500, 900)], []]


def test_empty_and_null_documents(spark):
    documents = spark.createDataFrame([("null", None), ("empty", ""), ("long", "word " * 50_000)], "doc_id string, text string")
    rows = {row.doc_id: row for row in pipeline.assessed(documents, AS_OF, names=["english"]).collect()}
    assert set(rows) <= {"null", "empty", "long"} and {"empty", "long"} <= set(rows)
    assert rows["empty"].total_items == 0 and not rows["empty"].is_valid and rows["empty"].overall == 0.0


# --- prices ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        (("756,30 €", "19%", "900,00 €2.700,00 €"), (3, 90000, 270000, None)),
        (("50.420,17 €", "19%", "60.000,00 €60.000,00 €"), (1, 6000000, 6000000, None)),
        (("1.260,50 €", "19%", "1.500,00 €4.500,00 €"), (3, 150000, 450000, None)),
        (("1176,46 €", "0%", "176,46 €176,46 €"), (1, 17646, 17646, "merged")),
        (("3176,46 €", "0%", "176,46 €529,38 €"), (1, 17646, 17646, "merged")),
        (("155,32 €", "20%", "66,38 €66,38 €"), (1, 6638, 6638, None)),
        (("129,99 € 20% 155,99 € 155,99 €",), (1, 15599, 15599, None)),
        (("10,00 €",), (1, 1000, 1000, None)),
    ],
)
def test_price_roles(spark, lines, expected):
    (found,) = read(spark, block(*lines), "eu_consumer").first()["items"]
    assert (found.quantity, found.unit_cents, found.total_cents, found.repair) == expected


def test_quantity_is_split_from_the_price(spark):
    """The scanned invoice: 1, 1 and 3 pieces of 176.46 and 9.36 of shipping make 891.66."""
    pieces = [("1176,46 €", "0%", "176,46 €176,46 €"), ("1176,46 €", "0%", "176,46 €176,46 €"), ("3176,46 €", "0%", "176,46 €529,38 €")]
    text = "Gesamtpreis891,66 €\nBestellnummer302-1725553-0374723\n" + "".join(block(*p) for p in pieces) + "Versandkosten9,36 €9,36 €9,36 €"
    rows = items.repaired(read(spark, text, "eu_consumer"), ["doc_id"]).orderBy("position").collect()
    assert [(r.quantity, r.unit_cents, r.total_cents) for r in rows] == [(1, 17646, 17646), (1, 17646, 17646), (3, 17646, 52938)]
    assert {r.balance for r in rows} == {"repaired"} and rows[2].repair == "quantity split"
    assert rows[2].amounts == [317646, 17646, 52938]
    open_ = items.repaired(read(spark, text.replace("891,66", "900,00"), "eu_consumer"), ["doc_id"]).collect()
    assert {r.balance for r in open_} == {"open"}


# --- fallback, markets, details --------------------------------------------------------------------------------------


def test_fallback_reads_only_what_gave_nothing(spark):
    plain = "Items Ordered\n2 of: Blue mug\nCondition: New\n4.50\nSubtotal: GBP 9.00\nTax: GBP 1.00\nGrand Total: GBP 10.00"
    row = read(spark, plain, "english", fallback=True).first()
    assert (row.reader, row.total_cents, row.tax_cents, row.currency) == ("generic", 1000, 100, "GBP")
    assert [(i.description, i.quantity, i.total_cents) for i in row["items"]] == [("2 x Blue mug", 2, 900)]
    known = read(spark, "Grand Total: $10.00\nTeilsumme: GBP 3.00", "english", fallback=True).first()
    assert (known.reader, known.subtotal_cents, known.total_cents) == ("english", None, 1000)


def test_section_gate(spark):
    text = "3 x Too early $1.00\nGarden chair made of wood\nASIN: B0F3D9YC75\n129,99 €20%155,99 €155,99 €\nArtikel\n2 x Tea pot $3.00\nCups | 4,00 €\nZahlung Visa\n5 x Too late $9.00\nASIN: B000000001\n1,00 €20%1,20 €1,20 €"
    frame = spark.createDataFrame([(text,), ("",), ("no heading\n1 x A $1.00",)], "t string")
    got = [[(i.asin, i.description, i.total_cents) for i in row.i] for row in frame.select(items.section_items(F.col("t")).alias("i")).collect()]
    assert got == [[("B0F3D9YC75", "Garden chair made of wood", 15599), (None, "2 x Tea pot", 300), (None, "Cups", 400)], [], []]


def test_british_dates_are_day_first(spark):
    text = "Order Number: 111-2222222-3333333\nOrder Date: 03/05/1995\nGrand Total: £38.00"
    assert read(spark, text, "uk").first().order_date == datetime.date(1995, 5, 3)


def test_details_of_consumer_invoices(spark):
    text = "amazon.de\nBestellnummer: 123-4567890-1234567\nZahlungsart: Visa\nGesamtbetrag 71,44 €\nUSt. 20% 11,90 €"
    documents = spark.createDataFrame([("d", text)], "doc_id string, text string")
    row = pipeline.extracted(documents, names=["eu_consumer"]).first()
    assert row.details.payment_method == "Visa" and row.details.vat_rate == 20.0
    assert row.confidence_scores["order_number"] == 70


def test_a_market_can_be_added(spark):
    fields.register(replace(fields.RULE_SETS["english"], name="irish", currency="EUR", shapes=fields.same_shape(fields.EURO_FRONT)))
    try:
        row = read(spark, "Grand Total: €38.00\nShipping: €2.00", "irish").first()
        assert (row.total, row.shipping, row.currency) == ("€38.00", "€2.00", "EUR")
    finally:
        del fields.RULE_SETS["irish"]


def test_best_rule_set_breaks_ties_by_place(spark):
    frame = spark.createDataFrame([("a", "Grand Total: $5.00"), ("b", "Gesamtbetrag: CHF 5.00"), ("c", None)], "doc_id string, clean_text string")
    best = {row.doc_id: (row.rule_set, row.points) for row in pipeline.best_rule_set(frame, ["us", "english", "swiss"]).collect()}
    assert best == {"a": ("us", 1), "b": ("swiss", 1), "c": ("us", 0)}


# --- schema ---------------------------------------------------------------------------------------------------------


def staged(spark, *values):
    frame = spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "k int, json string")
    return schema.staged(frame, schema.INVOICE).cache()


def test_schema_converts_fills_and_strips(spark):
    (row,) = schema.typed(staged(spark, {"orderNumber": None, "items": [{"description": "Mug", "quantity": "2", "unitPrice": 1}], "other": 1}), ["k"]).collect()
    assert row.vendor == "Amazon" and row.orderNumber is None and row.total is None
    assert (row["items"][0].quantity, row["items"][0].unitPrice, row["items"][0].totalPrice) == (2, 1.0, None)
    assert "other" not in row.asDict()
    assert schema.typed(staged(spark, {}), ["k"]).first()["items"] == []


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ({"orderNumber": "1"}, {("orderNumber", "pattern")}),
        ({"total": 5}, {("total", "type")}),
        ({"vendor": None}, {("vendor", "null")}),
        ({"items": {"description": "x"}}, {("items", "type")}),
        ({"items": [{"quantity": 0}, {"description": "x", "quantity": 1.5}]}, {("items.0.description", "required"), ("items.0.quantity", "min"), ("items.1.quantity", "integer")}),
        ({"languageDetection": {"language": "EN", "confidence": 2, "evidence": "e", "supported": "maybe"}}, {("languageDetection.confidence", "max"), ("languageDetection.supported", "type")}),
        ({"validation": {"warnings": [{"type": "t", "severity": "bad", "message": "m"}]}}, {("validation.warnings.0.severity", "enum")}),
        ({"pdfMetadata": {"extractedAt": "yesterday", "pages": 0}}, {("pdfMetadata.extractedAt", "type"), ("pdfMetadata.pages", "min")}),
        ("{broken", {("", "json")}),
        ("", {("", "json")}),
        (None, {("", "json")}),
        ([1], {("", "type")}),
    ],
)
def test_schema_faults(spark, value, expected):
    stage = staged(spark, value)
    assert {(r.path, r.rule) for r in schema.faults(stage, ["k"]).collect()} == expected
    assert schema.typed(stage, ["k"]).count() == 0


def test_schema_sinks_are_complete(spark, tmp_path):
    stage = schema.staged(corpus.json_texts(spark, SMALL), schema.INVOICE)
    schema.write(stage, str(tmp_path / "stage"))
    good, bad = (spark.read.parquet(str(tmp_path / "stage" / f"outcome={name}")) for name in (schema.TYPED, schema.REJECTED))
    assert good.count() > 0 and bad.count() > 0
    assert good.select("order_id").unionByName(bad.select("order_id")).distinct().count() == star.invoices(spark, SMALL).count()
    assert bad.where(F.size("faults") == 0).isEmpty() and bad.where(F.col("json").isNull()).isEmpty()


# --- report sections ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("switch", ["monthly", "categories", "trends", "details"])
def test_section_switches(spark, switch):
    names = {"monthly": "MONTHLY_SPENDING", "categories": "CATEGORY_ANALYSIS", "trends": "TRENDS", "details": "INVOICE_DETAILS"}
    report = reports.report_sections(star.invoices(spark, SMALL), star.items(spark, SMALL), star.ITEM_ORDER, **{switch: False})
    got = {row.section for row in report.select("section").distinct().collect()}
    assert got == {"SUMMARY", "CURRENCY_BREAKDOWN", *names.values()} - {names[switch]}


@pytest.mark.parametrize(("details", "scans"), [(False, 2), (True, 4)])
def test_sections_share_scans(spark, details, scans):
    """Two scans of the order lines for all figures; the details join both tables and read each once more."""
    report = reports.report_sections(star.invoices(spark, SMALL), star.items(spark, SMALL), star.ITEM_ORDER, details=details)
    report.collect()
    final = report._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert 1 <= final.count("lineitem.parquet") <= scans


def test_sections_of_no_invoice(spark):
    none, lines = star.invoices(spark, SMALL).where("false"), star.items(spark, SMALL).where("false")
    rows = {row.section: row for row in reports.report_sections(none, lines, star.ITEM_ORDER).collect()}
    assert set(rows) == {"SUMMARY", "TRENDS"} and rows["SUMMARY"].invoice_count == 0 and rows["TRENDS"].trend == "insufficient_data"


# --- comparison -----------------------------------------------------------------------------------------------------


def test_dotted_paths(spark):
    row = "a struct<b: struct<c: int>>, l array<struct<p: double>>, m map<string, string>, `x.y` string"
    frame = spark.createDataFrame([(((1,),), [(2.5,)], {"k": "v"}, "dot")], row)
    paths = ["a.b.c", "l.0.p", "l.3.p", "m.k", "m.none", "x.y", "a.none.c", "nowhere", "a.b", "l.p"]
    got = {r.field: (r.value, r.number) for r in compare.field_values(frame, {p: p for p in paths}, []).collect()}
    assert got == {
        "a.b.c": ("1", 1.0), "l.0.p": ("2.5", 2.5), "l.3.p": (None, None), "m.k": ("v", None), "m.none": (None, None), "x.y": ("dot", None),
        "a.none.c": (None, None), "nowhere": (None, None), "a.b": ('{"c":1}', None), "l.p": (None, None),
    }


# --- streams --------------------------------------------------------------------------------------------------------


def events(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps({"job_id": j, "filename": f, "ts": t, "success": s}) for j, f, t, s in rows))


def test_windowed_progress_forgets(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    results = stream.windowed_progress(stream.arriving_results(spark, str(folder)), "1 hour", "1 day")

    def run():
        query = results.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        query = query.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return [p for p in query.recentProgress]

    events(folder, "1.json", [("j", "a", "2024-01-01T01:00:00Z", True), ("j", "a", "2024-01-01T01:10:00Z", True), ("j", "b", "2024-01-01T02:00:00Z", False)])
    run()
    events(folder, "2.json", [("k", "c", "2024-01-05T00:00:00Z", True)])
    run()
    events(folder, "3.json", [("z", "d", "2024-02-01T00:00:00Z", True), ("j", "late", "2024-01-01T03:00:00Z", True)])
    progress = run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("job_id", "processed", "successful", "failed").collect())
    assert got == [("j", 2, 1, 1), ("k", 1, 1, 0)]
    # Only the newest job and file are remembered.
    assert all(operator["numRowsTotal"] <= 1 for operator in progress[-1]["stateOperators"])


def test_ingest_to_two_tables_survives_a_repeated_batch(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    text = "Amazon.com Order Confirmation\nOrder #123-4567890-123456{}\nOrder Placed: May 3, 2020\n2 of: Mug\n$5.00\nGrand Total: $11.00\n"
    for i in range(3):
        (source / f"{i}.txt").write_text(text.format(i))
    (source / "bad.txt").write_text("nothing here")
    paths = [str(tmp_path / name) for name in ("invoices", "failures", "state")]
    write, calls = stream.replace_batch, []

    def failing(rows, path, batch_id):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost between the tables")
        write(rows, path, batch_id)

    monkeypatch.setattr(stream, "replace_batch", failing)
    with pytest.raises(Exception, match="lost between"):
        stream.ingest_split(spark, str(source), *paths, names=["us"]).awaitTermination()
    assert spark.read.parquet(paths[0]).count() == 3
    (source / "4.txt").write_text(text.format(7))
    stream.ingest_split(spark, str(source), *paths, names=["us"]).awaitTermination()
    assert sorted(r.filename for r in spark.read.parquet(paths[0]).collect()) == ["0.txt", "1.txt", "2.txt", "4.txt"]
    assert [r.filename for r in spark.read.parquet(paths[1]).collect()] == ["bad.txt"]
