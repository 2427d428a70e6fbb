from pyspark.sql import functions as F

from spendframe.operators import compare, export, jobs, quality, reports
from spendframe.plans import catalog
from spendframe.sources import star

SMALL = "/root/testdata/sf0.001"
AMOUNTS = "total_cents bigint, subtotal_cents bigint, shipping_cents bigint, tax_cents bigint, discount_cents bigint"


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def batch(spark):
    data = [
        ("job_1", True, "USD", 20000, 18000, 1000, 1000, 0), ("job_1", True, "USD", 10000, 9000, 500, 500, 0),
        ("job_2", True, "EUR", 5000, 4500, 200, 300, 0), ("job_2", False, "EUR", 99999, 0, 0, 0, 0),
    ]
    return spark.createDataFrame(data, f"job_id string, success boolean, currency string, {AMOUNTS}")


def test_worked_batch_totals(spark):
    total = jobs.batch_grand_total(batch(spark)).first()
    assert (total.total, total.subtotal, total.shipping, total.tax, total.discount) == (350.0, 315.0, 17.0, 18.0, 0.0)
    assert (total.total_jobs, total.total_invoices, total.failed_invoices) == (2, 3, 1)
    assert rows(jobs.batch_by_currency(batch(spark)), "currency", "invoice_count", "total") == [("EUR", 1, 50.0), ("USD", 2, 300.0)]


def test_main_currency_ties_go_by_name(spark):
    data = [("j", True, c, 1, 1, 0, 0, 0) for c in ("USD", "EUR")]
    frame = spark.createDataFrame(data, f"job_id string, success boolean, currency string, {AMOUNTS}")
    assert jobs.job_currency(frame).first().currency == "EUR"


def test_admission_takes_the_first_reason(spark):
    mb = 1024 * 1024
    data = [("a.pdf", "application/pdf", 60 * mb, "b1"), ("a.PDF", "application/pdf", mb, "b1"), ("a.txt", "application/pdf", mb, "b1"), ("x.pdf", "text/plain", mb, "b1")]
    data += [(f"{i}.pdf", "application/pdf", 1, "b2") for i in range(51)]
    frame = spark.createDataFrame(data, "filename string, mime_type string, size bigint, batch string")
    found = {(r.batch, r.filename): r.reason for r in jobs.upload_admission(frame).collect()}
    assert found["b1", "a.pdf"].startswith("File size") and found["b1", "a.PDF"] is None
    assert found["b1", "x.pdf"] == "Only PDF files are allowed" and found["b1", "a.txt"] == "File must have a .pdf extension"
    assert found["b2", "0.pdf"] == "Maximum 50 files allowed per batch"


def test_sorting_puts_missing_values_first_or_last(spark):
    frame = spark.createDataFrame([("b",), (None,), ("a",)], "v string")
    assert [r.v for r in jobs.sorted_rows(frame, "v").collect()] == [None, "a", "b"]
    assert [r.v for r in jobs.sorted_rows(frame, "v", ascending=False).collect()] == ["b", "a", None]


def test_typed_results(spark):
    item = "struct<asin:string,description:string,quantity:string,unit_price:string,total_price:string,total:string>"
    data = "struct<order_number:string,order_date:string,customer_name:string,subtotal:string,shipping:string,tax:string,discount:string,total:string,currency:string,is_valid:boolean,errors:array<string>,warnings:array<string>,items:array<" + item + ">>"
    full = ("1", "2024-01-01", "Ann", "$30.00", "5,00 €", None, None, "words", "USD", True, ["e"], ["w"], [("B", "Mug", "2", "$1.50", "$3.00", None)])
    raw = [("j", "a.txt", True, full), ("j", "b.txt", True, None), ("j", "c.txt", False, full)]
    got = {r.filename: r for r in export.typed_results(spark.createDataFrame(raw, f"job_id string, filename string, success boolean, data {data}")).collect()}
    assert set(got) == {"a.txt", "b.txt"}
    assert (got["a.txt"].subtotal, got["a.txt"].shipping, got["a.txt"].total) == (30.0, 5.0, None)
    assert got["a.txt"]["items"][0].total == 3.0 and got["a.txt"].validation_errors == ["e", "w"]
    assert got["b.txt"].validation_status == "warning" and got["b.txt"]["items"] == []
    flat = export.nested_item_rows(export.typed_results(spark.createDataFrame(raw, f"job_id string, filename string, success boolean, data {data}")))
    assert rows(flat, "filename", "item_description", "item_quantity") == [("a.txt", "Mug", 2), ("b.txt", None, None)]


def invoice(spark, **changes):
    base = {"order_id": 1, "order_number": "123-4567890-1234567", "order_date": "2023-12-15", "vendor": "Amazon", "currency": "USD",
            "subtotal": "$30.00", "shipping": "$5.00", "tax": "$3.00", "discount": None, "total": "$38.00", "raw_text": None}
    row = {**base, **changes}
    schema = "order_id int, " + ", ".join(f"{k} string" for k in row if k != "order_id")
    return spark.createDataFrame([tuple(row.values())], schema)


def item_rows(spark, *prices, asin=None):
    data = [(1, asin, "Test item", 1, p, p, f"${p / 100:.2f}") for p in prices]
    return spark.createDataFrame(data, "order_id int, asin string, description string, quantity int, unit_cents bigint, total_cents bigint, price string")


def kinds(spark, inv, items):
    return sorted(r.type for r in quality.issues(inv, items, "2024-06-30").collect())


def test_sound_invoice_has_no_issue(spark):
    assert kinds(spark, invoice(spark), item_rows(spark, 1000, 2000)) == []
    row = quality.score(invoice(spark), item_rows(spark, 1000, 2000), "2024-06-30").first()
    assert (row.score, row.is_valid, row.summary) == (100, True, "All validations passed")


def test_wrong_total_and_complex_order(spark):
    assert kinds(spark, invoice(spark, total="$50.00"), item_rows(spark, 3000)) == ["mathematical_inconsistency"]
    text = "Zwischensumme 1\nZwischensumme 2"
    (row,) = quality.issues(invoice(spark, total="$50.00", raw_text=text), item_rows(spark, 3000), "2024-06-30").collect()
    assert row.severity == "low" and row.message.startswith("Complex order: ")


def test_repeated_product_at_two_prices(spark):
    found = quality.issues(invoice(spark, subtotal="$30.00"), item_rows(spark, 1000, 2000, asin="B1"), "2024-06-30").collect()
    assert [r.type for r in found] == ["duplicate_item_different_prices"]
    row = quality.score(invoice(spark), item_rows(spark, 1000, 2000, asin="B1"), "2024-06-30").first()
    assert (row.score, row.is_valid, row.summary) == (80, False, "1 validation issue found: 1 error")


def test_item_mismatch_grades(spark):
    def graded(price):
        found = quality.issues(invoice(spark), item_rows(spark, price), "2024-06-30").collect()
        return sorted((r.level, r.severity) for r in found if r.type.startswith("item_subtotal"))

    assert graded(3005) == []
    assert graded(3050) == [("warning", "low"), ("warning", "low")]
    assert ("error", "high") in graded(3200) and ("error", "critical") in graded(6000)


def test_missing_fields(spark):
    got = kinds(spark, invoice(spark, order_number=None, order_date=None, total=None), item_rows(spark, 3000))
    assert got == ["missing_critical_field", "missing_critical_field", "missing_date"]


def test_partitioning_does_not_change_results(spark):
    inv = star.invoices(spark, SMALL)
    for build in (reports.monthly_spending, reports.currency_breakdown, jobs.batch_by_currency):
        assert rows(build(inv), "*") == rows(build(inv.repartition(7, "vendor")), "*")


def test_job_totals_add_up(spark):
    inv, owners = star.invoices(spark, SMALL), star.jobs(spark, SMALL)
    per_job = jobs.job_totals(owners, inv).agg(F.sum("invoice_count"), F.round(F.sum("total"), 2)).first()
    grand = jobs.batch_grand_total(inv).first()
    assert per_job[0] == grand.total_invoices and per_job[1] == round(grand.total, 2)


def test_scores_stay_in_range(spark):
    scored = quality.score(star.flawed_invoices(spark, SMALL), star.priced_items(spark, SMALL), "2024-06-30")
    low, high, n = scored.agg(F.min("score"), F.max("score"), F.count("*")).first()
    assert 0 <= low <= high <= 100 and n == star.table(spark, SMALL, "orders").count()


def test_hot_order_keeps_every_item_once(spark):
    """One order holds a third of all rows, with many equal ones."""
    hot = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("order_id"), (F.col("id") % 5).alias("line_number"),
        F.lit("Mug").alias("description"), (F.col("id") % 7).alias("total_cents"),
    )
    inv = hot.select("order_id").distinct().select("order_id", F.col("order_id").cast("string").alias("order_number"))
    laid = export.first_row_layout(inv, hot, ["line_number", "total_cents"], ["order_number"])
    assert laid.count() == 20000
    assert laid.where(F.col("order_number").isNotNull()).count() == inv.count()


def test_comparison(spark):
    data = [("a", 1, "N1", "2024", "Ann", "USD", 10.0), ("b", 1, "N1", "2024", "ANN", "USD", 10.005), ("c", 1, "N2", "2024", None, "USD", 12.0)]
    frame = spark.createDataFrame(data, "job_id string, processed_at int, order_number string, order_date string, customer_name string, currency string, total double")
    near = {r.field: r.has_differences for r in compare.compare_first(frame, ["a", "b"]).collect()}
    assert not any(near.values())
    far = compare.compare_first(frame, ["a", "c", "d"])
    got = {r.field: r.has_differences for r in far.collect()}
    assert got["totals.total"] and got["orderNumber"] and not got["currency"]
    found = compare.issues(far)
    assert found.where("type = 'missing'").count() == 5
    assert [r.field for r in compare.search(far, found, "totals").collect()] == ["totals.total"]
    assert compare.ordered(far, "differences").first().has_differences
    assert [r.job_id for r in compare.missing_jobs(frame, spark, ["a", "d"]).collect()] == ["d"]


def test_recovery_actions_in_order(spark):
    frame = spark.createDataFrame([("pdf parsing failed", "x", True, 0.9), ("file not found", "x", False, 0.1)], "error string, context string, usable boolean, overall_confidence double")
    got = quality.recovery_actions(quality.classified_errors(frame))
    first = [r.action for r in got.where("type = 'pdf_parsing_error'").orderBy("position").collect()]
    assert first == ["high_confidence_data", "resave_pdf", "check_corruption", "use_partial_data"]
    assert quality.first_actions(got).count() == 4


def test_short_history_has_no_trend(spark):
    frame = spark.createDataFrame([("2024-01-05", 100)], "d string, total_cents bigint").select(F.to_date("d").alias("order_date"), "total_cents")
    assert reports.spending_trend(frame).first().trend == "insufficient_data"


def test_the_score_never_brings_the_keys_of_all_products_to_the_driver(spark):
    plan = catalog.all_queries()["dq_score"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line and "p_partkey" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)
