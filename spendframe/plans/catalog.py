"""Registered queries: each builds its result from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.functions import dates, money
from spendframe.operators import assess, classify, cleaning, compare, export, extract, items, jobs, quality, reports, schema
from spendframe.plans import pipeline
from spendframe.rules.fields import RULE_SETS
from spendframe.sources import corpus, star
from spendframe.streaming import jobs as stream_jobs

AS_OF = "2001-08-15"
QUALITY_AS_OF = "2024-06-30"
ETA_AS_OF = "2024-02-01 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]


def on_invoices(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(star.invoices(spark, sf_dir))


def on_items(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(star.items(spark, sf_dir))


def report_queries() -> dict[str, Query]:
    return {
        "rep_total": on_invoices(reports.total_spent),
        "rep_summary": on_invoices(lambda inv: reports.summary(inv, "EUR")),
        "rep_top_vendors": on_invoices(reports.top_vendors),
        "rep_monthly": on_invoices(reports.monthly_spending),
        "rep_monthly_fx": on_invoices(lambda inv: reports.monthly_spending(inv, "EUR", by_currency=True)),
        "rep_category": on_items(reports.category_analysis),
        "rep_top_categories": on_items(lambda items: reports.top_categories(items, 3)),
        "rep_mom_growth": on_invoices(reports.monthly_growth),
        "rep_trend": on_invoices(reports.spending_trend),
        "rep_currency": on_invoices(reports.currency_breakdown),
        "fin_overview": on_invoices(reports.financial_overview),
        "rep_largest": on_invoices(reports.largest_invoices),
        "report_sections": report_sections,
    }


def item_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.first_row_layout(
        export.amounts_as_units(star.invoices(spark, sf_dir)), star.items(spark, sf_dir), star.ITEM_ORDER
    )


def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_sections(star.invoices(spark, sf_dir), star.items(spark, sf_dir), star.ITEM_ORDER)


def written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices as raw job results: every field a text, as extraction delivers them."""
    invoices = star.invoices(spark, sf_dir)
    texts = {n: money.money_text(F.col(f"{n}_cents"), F.col("currency")) for n in export.MONEY_FIELDS}
    item = "array<struct<asin:string,description:string,quantity:string,unit_price:string,total_price:string,total:string>>"
    data = F.struct(
        "order_number",
        F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
        "customer_name",
        *[text.alias(name) for name, text in texts.items()],
        "currency",
        (F.col("order_id") % 2 == 0).alias("is_valid"),
        F.when(F.col("order_id") % 2 == 1, F.array(F.lit("total mismatch"))).alias("errors"),
        F.when(F.col("item_count") == 0, F.array(F.lit("no items"))).alias("warnings"),
        F.lit(None).cast(item).alias("items"),
    )
    extracted = F.when(F.col("order_id") % 11 != 0, data)
    return invoices.select("job_id", "filename", "success", "error", "processed_at", extracted.alias("data"))


def item_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item-grain CSV rows in all their columns, from raw results whose items are texts too."""
    invoices = star.invoices(spark, sf_dir).select("order_id", "filename", "currency")
    lines = star.items(spark, sf_dir).join(invoices, "order_id")
    written = F.struct(
        "asin",
        "description",
        F.col("quantity").cast("string").alias("quantity"),
        money.money_text(F.col("unit_cents"), F.col("currency")).alias("unit_price"),
        F.lit(None).cast("string").alias("total_price"),
        money.money_text(F.col("total_cents"), F.col("currency")).alias("total"),
    )
    listed = lines.groupBy("filename").agg(F.collect_list(written).alias("lines"))
    results = written_results(spark, sf_dir).join(listed, "filename", "left")
    filled = F.when(F.col("data").isNotNull(), F.col("data").withField("items", F.col("lines")))
    return export.nested_item_rows(export.typed_results(results.withColumn("data", filled)))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.typed_results(written_results(spark, sf_dir))
    return rows.select(
        "filename",
        "order_number",
        "order_date",
        "customer_name",
        F.size("items").alias("item_count"),
        *export.MONEY_FIELDS,
        "currency",
        "validation_status",
        F.array_join("validation_errors", "; ").alias("validation_errors"),
    )


def export_typed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = star.items(spark, sf_dir).select(
        "order_id",
        "line_number",
        F.struct(
            "asin",
            "description",
            F.col("quantity").cast("string").alias("quantity"),
            F.concat(F.lit("$"), money.two_decimals(F.col("unit_cents"))).alias("unit_price"),
            money.european_amount(F.col("total_cents")).alias("total_price"),
            F.lit(None).cast("string").alias("total"),
        ).alias("item"),
    )
    return raw.select("order_id", "line_number", export.typed_item(F.col("item")).alias("item")).select(
        "order_id", "line_number", "item.asin", "item.description", "item.quantity", "item.unit_price", "item.total"
    )


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.order_owners(spark, sf_dir).select("job_id", "filename", F.col("processed_at").alias("uploaded_at"))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results so far: all of a finished job, every second file of a running one."""
    there = (F.col("customer_key") % 10 < 8) | (F.col("order_id") % 2 == 0)
    return star.order_owners(spark, sf_dir).where(there).select("job_id", "filename", "success", "error", "processed_at")


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job ids asked for by customers, with repeats and with years that have no job."""
    key = F.col("c_custkey")
    return star.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("job_"), (F.lit(1995) + key % 9).cast("string"), F.lit("_"), (key % 10).cast("string")).alias("job_id")
    )


def timed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events as files with start, end and percentage."""
    events = star.progress_events(spark, sf_dir)
    key = F.col("filename").cast("bigint")
    status = F.when(F.col("state") == "uploading", "pending").otherwise(F.col("state"))
    return events.select(
        "job_id",
        status.alias("status"),
        ((key * 7) % 101).cast("int").alias("progress"),
        F.col("ts").alias("started_at"),
        F.when(F.col("state") == "completed", F.col("ts") + F.make_dt_interval(secs=key % 100 + 1)).alias("completed_at"),
    )


def job_queries() -> dict[str, Query]:
    both = lambda build: lambda s, d: build(star.jobs(s, d), star.invoices(s, d))
    return {
        "export_rows": export_rows,
        "export_item_csv": item_csv,
        "export_typed_items": export_typed_items,
        "export_item_rows": lambda s, d: export.joined_item_rows(star.invoices(s, d), star.items(s, d)),
        "invoice_csv_rows": item_layout,
        "batch_totals_rows": both(jobs.batch_totals_rows),
        "failed_results": lambda s, d: jobs.failed_results(star.job_results(s, d)),
        "upload_admission": lambda s, d: jobs.upload_admission(star.uploads(s, d)),
        "job_totals": both(jobs.job_totals),
        "job_currency": on_invoices(jobs.job_currency),
        "batch_grand_total": on_invoices(jobs.batch_grand_total),
        "batch_by_currency": on_invoices(jobs.batch_by_currency),
        "job_progress": lambda s, d: jobs.job_progress(file_rows(s, d), result_rows(s, d)),
        "job_files_status": lambda s, d: jobs.job_files_status(star.jobs(s, d), file_rows(s, d), result_rows(s, d)),
        "batch_semi": lambda s, d: jobs.requested_jobs(star.jobs(s, d), requested(s, d)),
        "batch_skipped": lambda s, d: jobs.skipped_jobs(star.jobs(s, d), requested(s, d)),
        "jobs_newest": lambda s, d: jobs.jobs_newest(star.jobs(s, d)),
        "job_preview": lambda s, d: jobs.job_preview(star.jobs(s, d), star.order_owners(s, d)),
        "job_stats": lambda s, d: jobs.job_stats(star.jobs(s, d), jobs.job_progress(file_rows(s, d), result_rows(s, d))),
        "jobs_by_period": lambda s, d: jobs.jobs_by_period(star.jobs(s, d), AS_OF),
        "job_eta": lambda s, d: jobs.job_eta(timed_files(s, d), ETA_AS_OF),
        "search_invoices": lambda s, d: jobs.search(
            star.order_owners(s, d).select("filename", "order_number", "customer_name"),
            "R#00000001",
            ["filename", "order_number", "customer_name"],
        ),
        "sorted_results": lambda s, d: jobs.sorted_rows(
            star.job_results(s, d).select("filename", "error", "success"), "error", ascending=False
        ),
    }


def flat(issues: DataFrame) -> DataFrame:
    return issues.withColumn("fields", F.array_join("fields", ","))


def rule(*builders: Callable[[], list]) -> Query:
    """Issues of some header rules alone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = [column for build in builders for column in build()]
        invoices, items = star.flawed_invoices(spark, sf_dir), star.priced_items(spark, sf_dir)
        return flat(quality.listed(quality.judged(invoices, items, columns)))

    return run


def quality_pair(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda s, d: build(star.flawed_invoices(s, d), star.priced_items(s, d))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified_errors(star.failures(spark, sf_dir))


def recovery_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = quality.recovery(star.flawed_invoices(spark, sf_dir), star.priced_items(spark, sf_dir))
    errors = classified(spark, sf_dir).join(partial.select("order_id", "usable", "overall_confidence"), "order_id")
    actions = quality.recovery_actions(errors.select("order_id", "type", "usable", "overall_confidence"))
    return actions.select("order_id", "type", "position", "action", "priority")


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a processed file: failed, or else fully extracted or recovered by the extraction share."""
    partial = quality.recovery(star.flawed_invoices(spark, sf_dir), star.priced_items(spark, sf_dir))
    errors = classified(spark, sf_dir).select("order_id", "level")
    failed = star.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_orderstatus") == "F").alias("failed")
    )
    outcome = F.when(F.col("failed"), "failed").when(F.col("found_fields") < 7, "recovered").otherwise("successful")
    rows = partial.join(errors, "order_id").join(failed, "order_id").withColumn("outcome", outcome)
    return jobs.batch_outcomes(rows.withColumn("level", F.when(F.col("failed"), F.col("level"))))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed invoices with timing, error and the extraction flags."""
    metrics = quality.extraction_metrics(star.flawed_invoices(spark, sf_dir), star.priced_items(spark, sf_dir))
    owners = star.order_owners(spark, sf_dir).select(
        "order_id",
        "error",
        (F.lit(35) + F.col("order_id") % 33).alias("processing_ms"),
        F.col("region").alias("language"),
        ((F.col("order_id") % 71 + 30).cast("double") / 100.0).alias("confidence"),
    )
    return owners.join(metrics, "order_id")


def schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item-grain text rows with faults at fixed keys."""
    key = F.col("order_id") + F.col("part_key")
    lines = star.priced_items(spark, sf_dir).select(
        "order_id",
        "line_number",
        "part_key",
        F.when(key % 5 != 0, F.col("quantity").cast("string")).otherwise(F.when(key % 2 == 0, "0").otherwise("many")).alias("quantity"),
        F.when(key % 7 != 0, F.col("unit_cents").cast("string")).otherwise("-1").alias("unit_price"),
        "description",
        F.when(key % 11 == 0, "120").otherwise("19").alias("vat_rate"),
        F.when(key % 13 == 0, "severe").otherwise("critical").alias("severity"),
    )
    numbers = star.flawed_invoices(spark, sf_dir).select("order_id", "order_number")
    return quality.schema_rejects(lines.join(numbers, "order_id"))


def staged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.staged(corpus.json_texts(spark, sf_dir), schema.INVOICE)


def typed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows of the JSON texts that fit the schema, with figures of their items."""
    rows = schema.typed(staged_json(spark, sf_dir), ["order_id"])
    return rows.select(
        "order_id",
        "orderNumber",
        "subtotal",
        "vendor",
        F.size("items").cast("bigint").alias("item_count"),
        F.aggregate("items", F.lit(0).cast("bigint"), lambda total, i: total + F.coalesce(i["quantity"], F.lit(0))).alias("quantity"),
        F.aggregate("items", F.lit(0).cast("bigint"), lambda total, i: total + F.round(i["unitPrice"] * 100).cast("bigint")).alias("unit_cents"),
        F.col("languageDetection.confidence").alias("confidence"),
    )


def json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.faults(staged_json(spark, sf_dir), ["order_id"])


def quality_queries() -> dict[str, Query]:
    return {
        "dq_math": rule(quality.total_rule),
        "dq_items_sum": rule(quality.item_sum_rule),
        "dq_item_subtotal": rule(quality.item_value_rule),
        "dq_dup_asin": on_items(lambda items: flat(quality.asin_issues(items))),
        "dq_dup_asin_prices": on_items(quality.repeated_prices),
        "dq_price": on_items(lambda items: flat(quality.price_issues(items))),
        "dq_date": rule(lambda: quality.date_rule(QUALITY_AS_OF)),
        "dq_currency": rule(quality.currency_rule),
        "dq_complete": rule(quality.completeness_rule),
        # The score reads nothing of the products but their keys.
        "dq_score": lambda s, d: quality.score(star.flawed_invoices(s, d), star.priced_items(s, d, dealt=True), QUALITY_AS_OF),
        "dq_parser_score": quality_pair(quality.parser_score),
        "checklist_a": quality_pair(quality.checklist_a),
        "checklist_b": quality_pair(lambda inv, items: quality.checklist_b(inv, items, QUALITY_AS_OF)),
        "recovery_usable": quality_pair(quality.recovery),
        "error_classes": classified,
        "recovery_actions": recovery_actions,
        "extraction_metrics": quality_pair(quality.extraction_metrics),
        "schema_rejects": schema_rows,
        "schema_typed": typed_json,
        "schema_faults": json_faults,
        "batch_outcomes": batch_outcomes,
        "perf_report": lambda s, d: reports.performance_report(runs(s, d)),
        "perf_by_language": lambda s, d: reports.performance_by_language(runs(s, d)),
        "perf_errors": lambda s, d: reports.performance_errors(runs(s, d)),
    }


COMPARED_JOBS = ["job_1996_1", "job_1997_2", "job_1998_3", "job_1994_0"]


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.invoices(spark, sf_dir).select(
        "job_id", "processed_at", "order_number", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
        "customer_name", "currency", (F.col("total_cents").cast("double") / 100.0).alias("total"),
    )


def compare_queries() -> dict[str, Query]:
    fields = compare.FIELDS
    first = lambda s, d: compare.compare_first(compared(s, d), COMPARED_JOBS, fields)
    return {
        "compare_values": lambda s, d: compare.field_values(compare.first_invoices(compared(s, d), COMPARED_JOBS), fields),
        "compare_fields": first,
        "compare_issues": lambda s, d: compare.issues(first(s, d)),
        "compare_summary": lambda s, d: compare.summary(first(s, d)),
        "compare_pivot": lambda s, d: compare.pivot(compared(s, d), COMPARED_JOBS, fields),
        "compare_all_jobs": lambda s, d: compare.compare_groups(twice(s, d), fields),
        "compare_nested": lambda s, d: compare.compare_groups(nested_twice(s, d), NESTED_PATHS),
        "compare_search": lambda s, d: compare.search(first(s, d), compare.issues(first(s, d)), "total").select("field", "has_differences", "value_count"),
        "compare_missing_jobs": lambda s, d: compare.missing_jobs(compared(s, d), s, [*COMPARED_JOBS, "job_1890_0", "job_1891_1"]),
    }


# Dotted paths over structs, an array and a map, one of which leads nowhere.
NESTED_PATHS = {
    path: path for path in ("seller.name", "totals.total", "items.0.price", "items.0.description", "items.2.price", "tags.channel", "tags.absent", "totals.absent")
}


def nested_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same orders with nested fields; the second reads prices, totals and tags differently."""
    order, line = F.col("order_id"), F.struct(*star.ITEM_ORDER)
    listed = star.items(spark, sf_dir).groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct(line.alias("key"), "description", "unit_cents"))).alias("lines"))
    rows = star.invoices(spark, sf_dir).join(listed, "order_id", "left")

    def run(name: str, second: bool) -> DataFrame:
        extra = F.when(order % 7 == 0, 100).otherwise(0) if second else F.lit(0)
        prices = F.transform("lines", lambda x, i: F.struct(x["description"].alias("description"), ((x["unit_cents"] + F.when(i == 0, extra).otherwise(0)).cast("double") / 100.0).alias("price")))
        seller = F.when(order % 3 == 0, F.upper("customer_name")).when(order % 11 != 0, F.col("customer_name")) if second else F.col("customer_name")
        total = F.col("total_cents") + (F.when(order % 5 == 0, 100).otherwise(0) if second else F.lit(0))
        channel = F.when(order % 13 == 0, "phone").otherwise("web") if second else F.lit("web")
        return rows.select(
            "order_number",
            F.lit(name).alias("run_id"),
            F.struct(seller.alias("name")).alias("seller"),
            F.struct((total.cast("double") / 100.0).alias("total")).alias("totals"),
            prices.alias("items"),
            F.create_map(F.lit("channel"), channel).alias("tags"),
        )

    return run("run_1", False).unionByName(run("run_2", True))


def twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same orders; the second reads some totals and names differently."""
    rows = compared(spark, sf_dir)
    share = F.substring("order_number", 1, 3).cast("int")
    second = rows.withColumns(
        {
            "total": F.when(share % 7 == 0, F.col("total") + 0.005).when(share % 5 == 0, F.col("total") + 1).otherwise(F.col("total")),
            "customer_name": F.when(share % 3 == 0, F.upper("customer_name")).when(share % 11 != 0, F.col("customer_name")),
        }
    )
    return rows.withColumn("run_id", F.lit("run_1")).unionByName(second.withColumn("run_id", F.lit("run_2")))


def over_texts(column: Callable[[Column], Column]) -> Query:
    """A text function over all documents."""
    return lambda s, d: star.noisy_texts(s, d).select("doc_id", column(F.col("text")).alias("text"))


def spaced(text: Column) -> Column:
    """Put tabs, wide gaps and blank lines into a text."""
    gaps = F.regexp_replace(text, r"\. ", ".  \t ")
    return F.regexp_replace(gaps, "\n", " \n\n\n\n\n  ")


def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item amounts written in seven ways."""
    cents, form = F.col("total_cents"), F.col("line_number") % 7
    shown = (
        F.when(form == 0, F.concat(F.lit("$"), money.two_decimals(cents)))
        .when(form == 1, money.european_amount(cents))
        .when(form == 2, F.concat(F.lit("£"), money.grouped_decimals(cents)))
        .when(form == 3, F.concat(F.lit("€"), F.translate(money.grouped_decimals(cents), ",.", ".,")))
        .when(form == 4, F.concat(F.lit("CHF "), money.two_decimals(cents)))
        .when(form == 5, F.concat(F.lit("-$"), money.two_decimals(cents)))
        .otherwise("invalid")
    )
    text = F.col("shown")
    return (
        star.items(spark, sf_dir)
        .select("order_id", "line_number", shown.alias("shown"))
        .select(
            "order_id",
            "line_number",
            money.tolerant_cents(text).alias("tolerant_cents"),
            money.to_cents(money.tolerant_amount(text, signed=True)).alias("signed_cents"),
            money.to_cents(money.strict_amount(text)).alias("strict_cents"),
            money.currency_symbol(text).alias("symbol"),
            money.is_money_text(text).alias("well_formed"),
        )
    )


DATE_LANGUAGES = ["en", "de", "fr", "es", "it"]


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written with month names of five languages and in numbers, and one impossible date."""
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    number, year = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    month = F.month(day)

    def name(language: str) -> Column:
        return F.element_at(F.array(*[F.lit(m) for m in dates.MONTHS[language]]), month)

    named = F.concat(name("en"), F.lit(" "), number, F.lit(", "), year)
    chain = F.when(key % 8 == 0, named)
    for rest, language in enumerate(["de", "fr", "es", "it"], 1):
        mark = "." if language == "de" else ""
        chain = chain.when(key % 8 == rest, F.concat(number, F.lit(f"{mark} "), F.upper(name(language)), F.lit(" "), year))
    chain = (
        chain.when(key % 8 == 5, F.concat(number, F.lit("."), month.cast("string"), F.lit("."), year))
        .when(key % 8 == 6, F.concat(year, F.lit("年"), month.cast("string"), F.lit("月"), number, F.lit("日")))
        .otherwise(F.concat(F.lit("31.2."), year))
    )
    return star.table(spark, sf_dir, "orders").select(
        key.alias("order_id"), dates.written_date(chain, "en").alias("day"), dates.report_date(chain).alias("report_day")
    )


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some of them with the words of a generated report, after the report filter."""
    key, text = F.col("doc_id"), F.col("text")
    marked = F.concat(
        F.when(key % 9 == 0, "Invoice Processing Report\nExport Date 2024\n").otherwise(""),
        F.when(key % 7 == 0, "Validation status: ok\n").otherwise(""),
        text,
    )
    kept, _ = cleaning.split_reports(star.table(spark, sf_dir, "documents").select("doc_id", marked.alias("text")))
    return kept.select("doc_id", F.length("text").alias("length"))


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry invoice words of different markets at fixed keys."""
    key = F.col("doc_id")
    words = [
        "", "Amazon.com\nOrder Placed: May 3, 2020\n$5", "amazon.de Rechnung 12,00 € MwSt Bestelldatum 1.2.2020",
        "Commande du 3 mars 2020\nTVA 20%\nTotal TTC 12,00 €", "CHF 12.00 Bestellnummer Zwischensumme Versand MwSt Gesamtbetrag",
        "Order Number 1\nSubtotal £5.00\nVAT Grand Total Postage", "注文番号 注文日 小計 合計 2020年1月2日", "Factura Total IVA 21% Importe total Envío 5,00 €",
    ]
    head = F.element_at(F.array(*[F.lit(w) for w in words]), (key % len(words) + 1).cast("int"))
    return star.noisy_texts(spark, sf_dir).select("doc_id", F.concat(head, F.lit("\n"), "text").alias("text"))


def format_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "us_score", "eu_score", "format", "format_confidence", "quality_level", "action"]
    return classify.classified(marked_texts(spark, sf_dir)).select(*columns)


def subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """European documents with business and consumer words at fixed keys."""
    key = F.col("doc_id")
    words = ["amazon.de\n", "amazon.de Firma GmbH USt-IdNr\n", "Rechnung ASIN: X Privatkunde\n", "Rechnung ASIN: | 2 | ASIN:\n"]
    head = F.element_at(F.array(*[F.lit(w) for w in words]), (key % len(words) + 1).cast("int"))
    texts = star.noisy_texts(spark, sf_dir).select("doc_id", F.concat(head, "text").alias("text"))
    return classify.classified(texts).select("doc_id", "format", "subtype")


def languages_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.detected_language(marked_texts(spark, sf_dir))
    return found.select("doc_id", "language", "language_confidence", "language_supported")


def language_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_texts(spark, sf_dir).select("doc_id", classify.eu_language("text").alias("language"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = pipeline.prepared(corpus.rendered(spark, sf_dir))
    return routed.select("order_id", "format", "subtype", "rule_set")


def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered documents read by the rule set that routing gives them."""
    prepared = pipeline.prepared(corpus.rendered(spark, sf_dir))
    return extract.extracted(prepared, list(corpus.REGION_RULE_SET.values()))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, as its document reads."""
    money_columns = [f"{n}_cents" for n in ("subtotal", "shipping", "tax", "total")]
    return read_corpus(spark, sf_dir).select(
        "order_id", "order_number", "order_date", *money_columns, "currency", F.size("items").cast("bigint").alias("item_count")
    )


def language_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the language rule sets and of European business invoices."""
    read = extract.extracted(corpus.language_texts(spark, sf_dir), list(corpus.LANGUAGE_LAYOUTS))
    money_columns = [f"{n}_cents" for n in ("subtotal", "shipping", "tax", "discount", "total")]
    return read.select("doc_id", "rule_set", "order_number", "order_date", *money_columns)


def extracted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = items.exploded(read_corpus(spark, sf_dir), ["order_id"])
    return read.select("order_id", "asin", "description", "quantity", "unit_cents", "total_cents")


def repeated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = items.fingerprints(read_corpus(spark, sf_dir), ["order_id"])
    return read.select("order_id", "asin", "description", "unit_cents", "copies")


def extracted_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-row layout of the extracted invoices of all markets."""
    return export.nested_first_row_layout(read_corpus(spark, sf_dir))


def assessable_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.assessable(corpus.rendered(spark, sf_dir), names=list(corpus.REGION_RULE_SET.values()))


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.assessed(assessable_corpus(spark, sf_dir), QUALITY_AS_OF, ["order_id"])


def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(assess.issues(assessable_corpus(spark, sf_dir), QUALITY_AS_OF, ["order_id"]))


def document_checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.checklists(assessable_corpus(spark, sf_dir), QUALITY_AS_OF, ["order_id"])


def repaired_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of scanned documents after the repair, with the amounts as printed."""
    read = extract.extracted(pipeline.prepared(corpus.scanned_texts(spark, sf_dir)), ["eu_consumer"])
    fixed = items.repaired(read, ["order_id"])
    printed = F.array_join(F.transform("amounts", lambda cents: cents.cast("string")), ",").alias("printed")
    return fixed.select("order_id", "position", "asin", "description", "quantity", "unit_cents", "total_cents", "balance", "repair", printed)


def business_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of business documents in all layouts, through cleaning and routing."""
    read = extract.extracted(pipeline.prepared(corpus.business_texts(spark, sf_dir)), ["eu_business"])
    return items.exploded(read, ["order_id", "rule_set"]).select("order_id", "rule_set", "position", "asin", "description", "quantity", "unit_cents", "total_cents")


def language_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of German and English texts in the forms their rule sets know."""
    read = items.exploded(extract.extracted(corpus.language_item_texts(spark, sf_dir), ["german", "english"]), ["order_id", "rule_set"])
    return read.select("order_id", "rule_set", "position", "asin", "description", "quantity", "unit_cents", "total_cents", "price")


def read_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of no known layout, through routing and the fallback."""
    return pipeline.extracted(corpus.plain_texts(spark, sf_dir))


def generic_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    money_columns = [f"{n}_cents" for n in ("subtotal", "shipping", "tax", "total")]
    return read_plain(spark, sf_dir).select("order_id", "reader", *money_columns, "currency", F.size("items").cast("bigint").alias("item_count"))


def generic_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items.exploded(read_plain(spark, sf_dir), ["order_id"])
    return found.select("order_id", "position", "description", "quantity", "unit_cents", "total_cents", "price")


def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.prepared(corpus.rendered(spark, sf_dir)).select("order_id", "format", "clean_text")


def bakeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rule sets over all rendered documents."""
    documents = pipeline.prepared(corpus.rendered(spark, sf_dir)).select("doc_id", "clean_text")
    return pipeline.bakeoff_summary(pipeline.bakeoff(documents, list(RULE_SETS)))


def best_rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule set that reads most of each rendered document, over all thirteen."""
    documents = pipeline.prepared(corpus.rendered(spark, sf_dir)).select("doc_id", "clean_text")
    best = pipeline.best_rule_set(documents, list(RULE_SETS))
    return best.select(F.col("doc_id").cast("bigint").alias("order_id"), "rule_set", "points", "order_number", "total_cents", "item_count")


def windowed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress per job and day of event time, the batch form of the stream whose state expires."""
    events = star.progress_events(spark, sf_dir).where(F.col("state").isin("completed", "failed"))
    results = events.withColumn("success", F.col("state") == "completed")
    return stream_jobs.windowed(results)


def progress_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished and failed progress events counted per job, the batch form of the live progress."""
    events = star.progress_events(spark, sf_dir).where(F.col("state").isin("completed", "failed"))
    return stream_jobs.counted(events.withColumn("success", F.col("state") == "completed"))


def text_queries() -> dict[str, Query]:
    return {
        "stream_progress": progress_batch,
        "stream_windowed": windowed_progress,
        "ruleset_best": best_rule_sets,
        "clean_mojibake": over_texts(cleaning.repair_encoding),
        "clean_light": over_texts(lambda text: cleaning.light_clean(spaced(text))),
        "clean_final": over_texts(lambda text: cleaning.final_clean(spaced(cleaning.repair_encoding(text)))),
        "clean_corpus": clean_corpus,
        "filter_report_docs": report_documents,
        "parse_money": money_texts,
        "parse_dates": date_texts,
        "classify_scores": lambda s, d: format_classes(s, d).select("doc_id", "us_score", "eu_score"),
        "classify_format": format_classes,
        "classify_subtype": subtypes,
        "detect_language": languages_found,
        "eu_language_vote": language_votes,
        "route_documents": routes,
        "extract_headers": headers,
        "extract_languages": language_headers,
        "extract_items": extracted_items,
        "item_fingerprints": repeated_items,
        "extract_csv": extracted_csv,
        "assess_documents": document_scores,
        "document_issues": document_issues,
        "document_checklists": document_checklists,
        "repair_prices": repaired_prices,
        "extract_business_items": business_items,
        "extract_language_items": language_items,
        "extract_generic": generic_headers,
        "extract_generic_items": generic_items,
        "ruleset_bakeoff": bakeoff,
    }


def all_queries() -> dict[str, Query]:
    return {**report_queries(), **job_queries(), **quality_queries(), **compare_queries(), **text_queries()}
