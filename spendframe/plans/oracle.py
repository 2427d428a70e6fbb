"""The registered queries again as SQL over the same tables, for result checks."""

from __future__ import annotations

from spendframe.operators.compare import FIELDS
from spendframe.plans.catalog import AS_OF, COMPARED_JOBS, ETA_AS_OF, QUALITY_AS_OF
from spendframe.rules import formats, languages
from spendframe.rules import quality as rules
from spendframe.rules.spending import CATEGORY_KEYWORDS, EXCHANGE_RATES
from spendframe.sources.corpus import LANGUAGE_LAYOUTS
from spendframe.sources.star import PRODUCT_NAMES, REGION_CURRENCY


def case(key: str, values: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {key} {arms} END"


OWNERS = f"""owners AS (
 SELECT o_orderkey AS order_id, o_custkey AS customer_key, c_name AS customer_name,
  lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || '-' ||
   lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS order_number,
  CAST(o_orderdate AS DATE) AS order_date, o_orderdate AS processed_at, c_mktsegment AS vendor, r_name AS region,
  {case("r_name", REGION_CURRENCY)} AS currency,
  CAST(round(o_totalprice * 100) AS BIGINT) AS stated_cents,
  'job_' || CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(o_custkey % 10 AS VARCHAR) AS job_id,
  order_number || '.txt' AS filename, o_orderstatus <> 'F' AS success,
  CASE WHEN o_orderstatus = 'F' THEN 'Processing failed' END AS error
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey)"""

INVOICES = (
    OWNERS
    + """, sums AS (
 SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS s,
  sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)) AS t,
  sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS d, count(*) AS n
 FROM lineitem GROUP BY l_orderkey),
invoices AS (
 SELECT owners.*, CAST(coalesce(s, 0) AS BIGINT) AS subtotal_cents, CAST(coalesce(t, 0) AS BIGINT) AS tax_cents,
  CAST(coalesce(d, 0) AS BIGINT) AS discount_cents, CAST((order_id % 7) * 100 AS BIGINT) AS shipping_cents,
  CAST(coalesce(n, 0) AS BIGINT) AS item_count,
  CASE WHEN order_id % 2 = 0 THEN CAST(coalesce(s, 0) + coalesce(t, 0) + (order_id % 7) * 100 AS BIGINT)
   ELSE stated_cents END AS total_cents
 FROM owners LEFT JOIN sums ON order_id = l_orderkey)"""
)

ITEMS = f"""items AS (
 SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS part_key, l_suppkey AS supplier_key,
  l_shipdate AS ship_date, 'B' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS asin,
  {case("split_part(p_name, ' ', -1)", PRODUCT_NAMES)} || ' ' || p_type AS description,
  CAST(l_quantity AS INTEGER) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS total_cents,
  CAST(round(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / l_quantity) AS BIGINT) AS unit_cents
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

JOBS = """jobs AS (
 SELECT job_id, min(order_date) AS created, max(order_date) AS completed,
  max(CASE WHEN customer_key % 10 < 8 THEN 'completed' ELSE 'processing' END) AS status
 FROM owners GROUP BY job_id)"""


def with_(*parts: str, body: str) -> str:
    return "WITH " + ", ".join(parts) + "\n" + body


def dollars(cents: str) -> str:
    return f"CAST({cents} AS DOUBLE) / 100"


def category_case() -> str:
    arms = []
    for name, words in CATEGORY_KEYWORDS.items():
        hits = " OR ".join(f"contains(lower(description), '{w}')" for w in words)
        arms.append(f"WHEN {hits} THEN '{name}'")
    return "CASE WHEN description IS NULL THEN 'Other' " + " ".join(arms) + " ELSE 'Other' END"


EUR = EXCHANGE_RATES["EUR"]
RATES = "(VALUES " + ", ".join(f"('{c}', CAST({r} AS DOUBLE))" for c, r in EXCHANGE_RATES.items()) + ") AS rates(code, rate)"
# In the SQL a decimal literal is exact, so doubles are written as casts.
EUR_SQL = f"CAST({EUR} AS DOUBLE)"

MONTHS = """months AS (
 SELECT year(order_date) AS y, month(order_date) AS m, CAST(sum(total_cents) AS BIGINT) AS c, count(*) AS n
 FROM invoices GROUP BY ALL)"""
MONTH_COLUMNS = "CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, monthname(make_date(y, m, 1)) AS month_name"

TREND = f"""steps AS (SELECT {dollars("c")} AS v, lag({dollars("c")}) OVER (ORDER BY y, m) AS p FROM months),
trend_facts AS (SELECT count(*) AS total_months,
  floor(avg(CASE WHEN p > 0 THEN (v - p) / p * 100 WHEN p IS NOT NULL THEN 0 END) * 10000 + 0.5) / 10000 AS g,
  floor(avg(v) * 100 + 0.5) / 100 AS a FROM steps)"""
TREND_COLUMNS = """CASE WHEN total_months < 2 THEN 'insufficient_data' WHEN g > 5 THEN 'increasing'
 WHEN g < -5 THEN 'decreasing' ELSE 'stable' END AS trend, CASE WHEN total_months >= 2 THEN g END AS average_growth,
 CASE WHEN total_months >= 2 THEN a ELSE 0 END AS average_monthly_spend, total_months"""

CATEGORIES = f"""categories AS (
 SELECT {category_case()} AS category, CAST(sum(total_cents) AS BIGINT) AS c, count(*) AS n FROM items GROUP BY 1),
category_report AS (
 SELECT category, {dollars("c")} AS total_spent, n AS item_count, {dollars("c")} / CAST(n AS DOUBLE) AS average_price,
  CAST(c AS DOUBLE) / CAST(sum(c) OVER () AS DOUBLE) * 100 AS percentage FROM categories)"""

CURRENCIES = f"""currencies AS (
 SELECT currency, {dollars("sum(total_cents)")} AS total_spent, count(*) AS invoice_count,
  {dollars("sum(total_cents)")} / CAST(count(*) AS DOUBLE) AS average_order FROM invoices GROUP BY currency)"""

VENDORS = """vendors AS (
 SELECT vendor, count(*) AS invoice_count FROM invoices GROUP BY vendor
 ORDER BY invoice_count DESC, vendor LIMIT 5)"""

LAYOUT = f"""numbered AS (
 SELECT *, row_number() OVER (PARTITION BY order_id
  ORDER BY line_number, part_key, supplier_key, total_cents, ship_date) AS position FROM items),
layout AS (
 SELECT CASE WHEN coalesce(position, 1) = 1 THEN order_number END AS order_number,
  CASE WHEN coalesce(position, 1) = 1 THEN order_date END AS order_date,
  CASE WHEN coalesce(position, 1) = 1 THEN {dollars("subtotal_cents")} END AS subtotal,
  CASE WHEN coalesce(position, 1) = 1 THEN {dollars("shipping_cents")} END AS shipping,
  CASE WHEN coalesce(position, 1) = 1 THEN {dollars("tax_cents")} END AS tax,
  CASE WHEN coalesce(position, 1) = 1 THEN {dollars("invoices.total_cents")} END AS total,
  CASE WHEN coalesce(position, 1) = 1 THEN vendor END AS vendor,
  description AS item_description, {dollars("numbered.total_cents")} AS item_price
 FROM invoices LEFT JOIN numbered USING (order_id))"""


def report_sql() -> dict[str, str]:
    growth = with_(
        INVOICES,
        MONTHS,
        body=f"""SELECT year, month, CASE WHEN previous > 0 THEN (current - previous) / previous * 100 ELSE 0 END AS growth,
 current, previous FROM (SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, {dollars("c")} AS current,
  lag({dollars("c")}) OVER (ORDER BY y, m) AS previous FROM months) WHERE previous IS NOT NULL""",
    )
    return {
        "rep_total": with_(
            INVOICES,
            body=f"SELECT count(total_cents) AS invoice_count, {dollars('sum(total_cents)')} AS total_spent FROM invoices",
        ),
        "rep_summary": with_(
            INVOICES,
            body=f"""SELECT count(*) AS total_invoices, {dollars("sum(total_cents)")} * {EUR_SQL} AS total_spent,
 'USD' AS original_currency, 'EUR' AS display_currency, min(order_date) AS date_start, max(order_date) AS date_end,
 {dollars("sum(total_cents)")} * {EUR_SQL} / CAST(count(*) AS DOUBLE) AS average_order_value FROM invoices""",
        ),
        "rep_top_vendors": with_(INVOICES, VENDORS, body="SELECT * FROM vendors"),
        "rep_monthly": with_(
            INVOICES,
            MONTHS,
            body=f"SELECT {MONTH_COLUMNS}, {dollars('c')} AS total_spent, n AS invoice_count FROM months",
        ),
        "rep_monthly_fx": with_(
            INVOICES,
            f"""per_currency AS (SELECT year(order_date) AS y, month(order_date) AS m, currency,
  CAST(sum(total_cents) AS DOUBLE) AS c, count(*) AS k FROM invoices GROUP BY ALL),
 months AS (SELECT y, m, sum(CAST(floor(c * ({EUR_SQL} / rate) + 0.5) AS BIGINT)) AS c, CAST(sum(k) AS BIGINT) AS n
  FROM per_currency JOIN {RATES} ON code = currency GROUP BY y, m)""",
            body=f"SELECT {MONTH_COLUMNS}, {dollars('c')} AS total_spent, n AS invoice_count FROM months",
        ),
        "rep_category": with_(ITEMS, CATEGORIES, body="SELECT * FROM category_report"),
        "rep_top_categories": with_(
            ITEMS,
            CATEGORIES,
            body="SELECT category, total_spent, item_count FROM category_report ORDER BY total_spent DESC, category LIMIT 3",
        ),
        "rep_mom_growth": growth,
        "rep_trend": with_(
            INVOICES,
            MONTHS,
            TREND,
            body=f"SELECT {TREND_COLUMNS} FROM trend_facts",
        ),
        "rep_currency": with_(INVOICES, CURRENCIES, body="SELECT * FROM currencies"),
        "fin_overview": with_(
            INVOICES,
            body=f"""SELECT {dollars("sum(total_cents)")} AS total_value,
 {dollars("sum(total_cents)")} / CAST(count(*) AS DOUBLE) AS average_value, count(*) AS invoice_count
 FROM invoices WHERE total_cents IS NOT NULL""",
        ),
        "rep_largest": with_(
            INVOICES,
            body=f"""SELECT order_number, order_date, vendor, {dollars("total_cents")} AS total FROM invoices
 ORDER BY total_cents DESC, order_number LIMIT 20""",
        ),
        "report_sections": with_(
            INVOICES,
            ITEMS,
            MONTHS,
            TREND,
            CATEGORIES,
            CURRENCIES,
            VENDORS,
            LAYOUT,
            body=f"""SELECT 'SUMMARY' AS section, count(*) AS invoice_count, {dollars("sum(total_cents)")} AS total_spent,
  'USD' AS currency, {dollars("sum(total_cents)")} / CAST(count(*) AS DOUBLE) AS average,
  min(order_date) AS date_start, max(order_date) AS date_end,
  (SELECT string_agg(vendor || ' (' || invoice_count || ')', '; ' ORDER BY invoice_count DESC, vendor) FROM vendors) AS top_vendors
 FROM invoices
 UNION ALL BY NAME SELECT 'MONTHLY_SPENDING' AS section, {MONTH_COLUMNS}, {dollars("c")} AS total_spent, n AS invoice_count FROM months
 UNION ALL BY NAME SELECT 'CATEGORY_ANALYSIS' AS section, category, total_spent, item_count, average_price AS average, percentage
 FROM category_report
 UNION ALL BY NAME SELECT 'TRENDS' AS section, {TREND_COLUMNS} FROM trend_facts
 UNION ALL BY NAME SELECT 'CURRENCY_BREAKDOWN' AS section, currency, total_spent, invoice_count, average_order AS average FROM currencies
 UNION ALL BY NAME SELECT 'INVOICE_DETAILS' AS section, layout.* FROM layout""",
        ),
    }


AMOUNTS = ["total", "subtotal", "shipping", "tax", "discount"]
JOB_AMOUNTS = """job_amounts AS (
 SELECT job_id, CAST(count_if(success) AS BIGINT) AS ok, CAST(count_if(NOT success) AS BIGINT) AS bad,
  """ + ", ".join(f"coalesce(sum({n}_cents) FILTER (success), 0) AS {n}_c" for n in AMOUNTS) + """
 FROM invoices GROUP BY job_id),
ranked AS (SELECT job_id, currency, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, currency) AS place
 FROM invoices WHERE success GROUP BY job_id, currency),
job_sums AS (SELECT job_amounts.*, currency FROM job_amounts
 LEFT JOIN (SELECT job_id, currency FROM ranked WHERE place = 1) USING (job_id))"""
IN_UNITS = ", ".join(f"{dollars(n + '_c')} AS {n}" for n in AMOUNTS)
SUM_UNITS = ", ".join(f"{dollars(f'sum({n}_c)')} AS {n}" for n in AMOUNTS)


def rate(part: str, whole: str, places: int = 0) -> str:
    power = f"CAST({10**places} AS DOUBLE)"
    share = f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100 ELSE 0 END"
    return f"floor({share} * {power} + 0.5) / {power}"


JOB_ROWS = f"""job_rows AS (
 SELECT job_id, created, completed, ok AS invoice_count, ok AS successful_invoices, bad AS failed_invoices,
  {rate("ok", "(ok + bad)", 1)} AS success_rate, {IN_UNITS}, currency FROM jobs JOIN job_sums USING (job_id))"""

FILES = "files AS (SELECT job_id, filename, processed_at AS uploaded_at FROM owners)"
RESULTS = """results AS (SELECT job_id, filename, success, error, processed_at FROM owners
 WHERE customer_key % 10 < 8 OR order_id % 2 = 0)"""
REQUESTED = "requested AS (SELECT 'job_' || CAST(1995 + c_custkey % 9 AS VARCHAR) || '_' || CAST(c_custkey % 10 AS VARCHAR) AS job_id FROM customer)"
PROGRESS = f"""progress AS (
 SELECT job_id, total, coalesce(processed, 0) AS processed, coalesce(successful, 0) AS successful,
  coalesce(failed, 0) AS failed, {rate("coalesce(processed, 0)", "total")} AS percentage,
  {rate("coalesce(successful, 0)", "total")} AS success_rate
 FROM (SELECT job_id, count(*) AS total FROM files GROUP BY job_id) LEFT JOIN (
  SELECT job_id, count(*) AS processed, CAST(count_if(success) AS BIGINT) AS successful,
   CAST(count_if(NOT success) AS BIGINT) AS failed FROM results GROUP BY job_id) USING (job_id))"""


def job_sql() -> dict[str, str]:
    amounts = {
        n: f"CASE WHEN has THEN CASE WHEN currency = 'JPY' THEN CAST({n}_cents AS DOUBLE) ELSE {dollars(n + '_cents')} END END AS {n}"
        for n in ["subtotal", "shipping", "tax", "discount", "total"]
    }
    money, shown_money = ", ".join(amounts.values()), ", ".join(text for n, text in amounts.items() if n != "discount")
    return {
        "export_rows": with_(
            INVOICES,
            body=f"""SELECT filename, CASE WHEN has THEN order_number END AS order_number,
 CASE WHEN has THEN strftime(order_date, '%Y-%m-%d') END AS order_date,
 CASE WHEN has THEN customer_name END AS customer_name, CAST(0 AS INTEGER) AS item_count, {money},
 CASE WHEN has THEN currency END AS currency,
 CASE WHEN NOT has THEN 'warning' WHEN order_id % 2 = 0 THEN 'valid' ELSE 'invalid' END AS validation_status,
 CASE WHEN NOT has THEN 'No data extracted from invoice' ELSE concat_ws('; ',
  CASE WHEN order_id % 2 = 1 THEN 'total mismatch' END, CASE WHEN item_count = 0 THEN 'no items' END) END AS validation_errors
 FROM (SELECT *, order_id % 11 <> 0 AS has FROM invoices) WHERE success""",
        ),
        "export_item_csv": with_(
            INVOICES,
            ITEMS,
            f"""flat AS (SELECT invoices.*, invoices.order_id % 11 <> 0 AS has, description, quantity, unit_cents, items.total_cents AS line_cents
  FROM invoices LEFT JOIN items ON items.order_id = invoices.order_id AND invoices.order_id % 11 <> 0 WHERE success)""",
            body=f"""SELECT filename, CASE WHEN has THEN order_number END AS order_number, CASE WHEN has THEN strftime(order_date, '%Y-%m-%d') END AS order_date,
 CASE WHEN has THEN customer_name END AS customer_name, CAST(NULL AS VARCHAR) AS customer_email, description AS item_description, quantity AS item_quantity,
 CASE WHEN currency = 'JPY' THEN CAST(unit_cents AS DOUBLE) ELSE {dollars("unit_cents")} END AS item_unit_price,
 CASE WHEN currency = 'JPY' THEN CAST(line_cents AS DOUBLE) ELSE {dollars("line_cents")} END AS item_total,
 {shown_money},
 CASE WHEN has THEN currency ELSE 'USD' END AS currency, CASE WHEN has AND order_id % 2 = 0 THEN 'valid' ELSE 'warning' END AS validation_status,
 CASE WHEN NOT has THEN 'No data extracted from invoice' ELSE concat_ws('; ',
  CASE WHEN order_id % 2 = 1 THEN 'total mismatch' END, CASE WHEN item_count = 0 THEN 'no items' END) END AS validation_errors,
 CAST(NULL AS TIMESTAMP) AS processed_at FROM flat""",
        ),
        "export_typed_items": with_(
            ITEMS,
            body=f"""SELECT order_id, line_number, asin, description, quantity, {dollars("unit_cents")} AS unit_price,
 {dollars("total_cents")} AS total FROM items""",
        ),
        "export_item_rows": with_(
            INVOICES,
            ITEMS,
            body=f"""SELECT filename, order_number, order_date, customer_name, description AS item_description,
 quantity AS item_quantity, {dollars("unit_cents")} AS item_unit_price, {dollars("items.total_cents")} AS item_total,
 {dollars("subtotal_cents")} AS subtotal, {dollars("shipping_cents")} AS shipping, {dollars("tax_cents")} AS tax,
 {dollars("invoices.total_cents")} AS total, currency FROM invoices LEFT JOIN items USING (order_id) WHERE success""",
        ),
        "invoice_csv_rows": with_(INVOICES, ITEMS, LAYOUT, body="SELECT * FROM layout"),
        "batch_totals_rows": with_(
            INVOICES,
            JOBS,
            JOB_AMOUNTS,
            JOB_ROWS,
            body=f"""SELECT job_id, strftime(created, '%Y-%m-%d') AS created, strftime(completed, '%Y-%m-%d') AS completed,
  invoice_count, successful_invoices, failed_invoices, total, subtotal, shipping, tax, discount, currency, success_rate FROM job_rows
 UNION ALL BY NAME SELECT 'BATCH_TOTAL' AS job_id, '' AS created, '' AS completed, CAST(sum(ok) AS BIGINT) AS invoice_count,
  CAST(sum(ok) AS BIGINT) AS successful_invoices, CAST(sum(bad) AS BIGINT) AS failed_invoices, {SUM_UNITS}, 'MULTI' AS currency,
  {rate("sum(ok)", "(sum(ok) + sum(bad))", 1)} AS success_rate FROM job_sums""",
        ),
        "failed_results": with_(
            OWNERS, body="SELECT filename, coalesce(error, 'Processing failed') AS error, processed_at FROM owners WHERE NOT success"
        ),
        "upload_admission": """WITH files AS (
 SELECT CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 17 = 0 THEN '.doc' ELSE '.pdf' END AS filename,
  n_chars * 4096 AS size, source AS batch FROM documents),
 judged AS (SELECT *, CASE WHEN sum(size) OVER (PARTITION BY batch) > 500 * 1024 * 1024 THEN 'Total batch size exceeds maximum limit of 500MB'
  WHEN count(*) OVER (PARTITION BY batch) > 50 THEN 'Maximum 50 files allowed per batch'
  WHEN size > 50 * 1024 * 1024 THEN 'File size exceeds maximum limit of 50MB'
  WHEN filename LIKE '%.doc' THEN 'File must have a .pdf extension' END AS reason FROM files)
 SELECT batch, filename, size, reason IS NULL AS admitted, reason FROM judged""",
        "job_totals": with_(INVOICES, JOBS, JOB_AMOUNTS, JOB_ROWS, body="SELECT * FROM job_rows"),
        "job_currency": with_(INVOICES, JOB_AMOUNTS, body="SELECT job_id, currency FROM job_sums"),
        "batch_grand_total": with_(
            INVOICES,
            JOB_AMOUNTS,
            body=f"""SELECT count(*) AS total_jobs, CAST(sum(ok) AS BIGINT) AS total_invoices,
 CAST(sum(ok) AS BIGINT) AS successful_invoices, CAST(sum(bad) AS BIGINT) AS failed_invoices, {SUM_UNITS} FROM job_sums""",
        ),
        "batch_by_currency": with_(
            INVOICES,
            JOB_AMOUNTS,
            body=f"""SELECT currency, CAST(sum(ok) AS BIGINT) AS invoice_count, {SUM_UNITS} FROM job_sums
 WHERE currency IS NOT NULL GROUP BY currency""",
        ),
        "job_progress": with_(OWNERS, FILES, RESULTS, PROGRESS, body="SELECT * FROM progress"),
        "job_files_status": with_(
            OWNERS,
            JOBS,
            FILES,
            RESULTS,
            body="""SELECT job_id, filename, CASE WHEN success THEN 'completed' WHEN NOT success THEN 'failed'
  WHEN status = 'processing' THEN 'processing' ELSE 'pending' END AS status,
  CAST(CASE WHEN success THEN 100 ELSE 0 END AS INTEGER) AS progress,
  CASE WHEN NOT success THEN error END AS error,
  CASE WHEN success IS NOT NULL OR status = 'processing' THEN uploaded_at END AS started_at, processed_at AS completed_at
 FROM files JOIN jobs USING (job_id) LEFT JOIN results USING (job_id, filename)""",
        ),
        "batch_semi": with_(
            OWNERS,
            JOBS,
            REQUESTED,
            body="SELECT * FROM jobs WHERE status = 'completed' AND job_id IN (SELECT job_id FROM requested)",
        ),
        "batch_skipped": with_(
            OWNERS,
            JOBS,
            REQUESTED,
            body="SELECT DISTINCT job_id FROM requested WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'completed')",
        ),
        "jobs_newest": with_(OWNERS, JOBS, body="SELECT * FROM jobs ORDER BY created DESC, job_id"),
        "job_preview": with_(
            OWNERS,
            JOBS,
            """firsts AS (SELECT job_id, order_number, row_number() OVER (PARTITION BY job_id ORDER BY processed_at, order_number) AS place
  FROM owners WHERE success),
 counts AS (SELECT job_id, count(*) AS file_count, CAST(count_if(success) AS BIGINT) AS success_count FROM owners GROUP BY job_id)""",
            body="""SELECT job_id, status, created, file_count, success_count,
 CASE WHEN success_count = 0 THEN '' ELSE 'Order ' || order_number END AS preview
 FROM jobs JOIN counts USING (job_id) LEFT JOIN (SELECT * FROM firsts WHERE place = 1) USING (job_id)""",
        ),
        "job_stats": with_(
            OWNERS,
            JOBS,
            FILES,
            RESULTS,
            PROGRESS,
            """done AS (SELECT job_id, total, epoch_ms(CAST(completed AS TIMESTAMP)) - epoch_ms(CAST(created AS TIMESTAMP)) AS ms
  FROM jobs JOIN progress USING (job_id) WHERE status = 'completed')""",
            body="""SELECT CAST(sum(ms) AS DOUBLE) / CAST(sum(total) AS DOUBLE) AS avg_ms_per_file, CAST(sum(total) AS BIGINT) AS total_files,
 CAST(sum(ms) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_job_ms,
 (SELECT job_id FROM done ORDER BY ms, job_id LIMIT 1) AS fastest_job,
 (SELECT job_id FROM done ORDER BY ms DESC, job_id LIMIT 1) AS slowest_job FROM done""",
        ),
        "jobs_by_period": with_(
            OWNERS,
            JOBS,
            body=f"""SELECT CASE WHEN created = DATE '{AS_OF}' THEN 'Today' WHEN created = DATE '{AS_OF}' - 1 THEN 'Yesterday'
  WHEN created >= DATE '{AS_OF}' - 7 THEN 'This Week' WHEN created >= date_trunc('month', DATE '{AS_OF}') THEN 'This Month'
  ELSE 'Older' END AS period, count(*) AS job_count FROM jobs GROUP BY 1""",
        ),
        "job_eta": f"""WITH files AS (
 SELECT user_id AS job_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing'
   WHEN 'purchase' THEN 'completed' ELSE event_type END AS status,
  CAST((event_id * 7) % 101 AS DOUBLE) / 100 AS p, (epoch_us(ts) // 1000) AS started,
  CASE WHEN event_type = 'purchase' THEN (epoch_us(ts) // 1000) + (event_id % 100 + 1) * 1000 END AS ended FROM events),
 shares AS (SELECT *, CAST(epoch_ms(TIMESTAMP '{ETA_AS_OF}') - started AS DOUBLE) AS e FROM files),
 facts AS (SELECT job_id, CAST(count_if(status = 'processing') AS BIGINT) AS running_files,
  CAST(count_if(status = 'pending') AS BIGINT) AS pending_files, count_if(ended IS NOT NULL) AS timed,
  sum(ended - started) FILTER (ended > started) AS spent, count(*) FILTER (ended > started) AS positive,
  coalesce(sum(CAST(floor(greatest(0, e / greatest(p, CAST(0.01 AS DOUBLE)) - e) + 0.5) AS BIGINT)) FILTER (status = 'processing'), 0) AS open_ms
  FROM shares GROUP BY job_id)
 SELECT job_id, running_files, pending_files, CAST(CASE WHEN running_files + pending_files = 0 THEN NULL
  WHEN timed = 0 THEN (running_files + pending_files) * 30000
  ELSE floor((CAST(open_ms AS DOUBLE) + CAST(pending_files AS DOUBLE) * (CAST(spent AS DOUBLE) / CAST(positive AS DOUBLE)))
   * CAST(1.2 AS DOUBLE) + 0.5) END AS BIGINT) AS remaining_ms FROM facts""",
        "search_invoices": with_(
            OWNERS,
            body="""SELECT filename, order_number, customer_name FROM owners WHERE contains(lower(filename), 'r#00000001')
 OR contains(lower(order_number), 'r#00000001') OR contains(lower(customer_name), 'r#00000001')""",
        ),
        "sorted_results": with_(OWNERS, body="SELECT filename, error, success FROM owners ORDER BY error DESC NULLS LAST"),
    }


def fixed(cents: str) -> str:
    """Cents as text with two decimals."""
    return (
        f"(CASE WHEN {cents} < 0 THEN '-' ELSE '' END || CAST(abs({cents}) // 100 AS VARCHAR) || '.' || "
        f"lpad(CAST(abs({cents}) % 100 AS VARCHAR), 2, '0'))"
    )


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


FLAWED = f"""flawed AS (
 SELECT order_id, CASE WHEN order_id % 43 = 0 THEN 'unreadable' WHEN order_id % 29 <> 0 THEN order_number END AS order_number,
  CASE WHEN order_id % 37 = 0 THEN 'undefined' WHEN order_id % 31 <> 0
   THEN CAST(year(order_date) + order_id % 35 AS VARCHAR) || strftime(order_date, '-%m-%d') END AS order_date,
  vendor, CASE WHEN order_id % 47 <> 0 THEN CASE WHEN order_id % 53 = 0 THEN 'SEK' ELSE 'USD' END END AS currency,
  CAST(subtotal_cents + CASE WHEN order_id % 19 = 0 THEN 5000 ELSE 0 END AS BIGINT) AS sub, shipping_cents AS ship,
  tax_cents AS tax, discount_cents AS disc, total_cents AS tot_all,
  CASE WHEN order_id % 41 = 0 THEN 0 ELSE total_cents END AS tot, order_id % 41 <> 0 AS has_total FROM invoices),
priced AS (SELECT * REPLACE (CASE WHEN part_key % 101 <> 0 THEN description END AS description),
  CASE WHEN part_key % 23 = 0 THEN '€' ELSE '$' END AS symbol FROM items),
facts AS (SELECT order_id, count(*) AS n, CAST(sum(total_cents) AS BIGINT) AS ps, CAST(sum(unit_cents * quantity) AS BIGINT) AS vs,
  count_if(unit_cents > 500000) AS vh, count_if(unit_cents > 100000 AND unit_cents <= 500000) AS hp,
  CAST(count_if(description IS NOT NULL) AS BIGINT) AS described, count(DISTINCT symbol) AS symbols, max(symbol) AS one
  FROM priced GROUP BY order_id),
base AS (SELECT flawed.*, coalesce(n, 0) AS n, coalesce(ps, 0) AS ps, coalesce(vs, 0) AS vs, coalesce(vh, 0) AS vh, coalesce(hp, 0) AS hp,
  coalesce(described, 0) AS described, coalesce(symbols, 0) AS symbols, one, false AS several FROM flawed LEFT JOIN facts USING (order_id))"""

MATH = f"""math AS (
 SELECT order_id, 'warning' AS level, 'mathematical_inconsistency' AS type, CASE WHEN big THEN 'low' ELSE 'medium' END AS severity,
  CASE WHEN big THEN 'Complex order: ' ELSE '' END || 'Calculated total (' || {fixed("calc")} || ') differs from extracted total (' ||
  {fixed("tot")} || ') by ' || {fixed("gap")} || ' (' || CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR) || '%)' ||
  CASE WHEN big THEN ' (multi-shipment order may have complex pricing)' ELSE '' END AS message, 'subtotal,shipping,tax,total' AS fields
 FROM (SELECT *, CAST(floor(CAST(gap AS DOUBLE) / t * 1000 + 0.5) AS BIGINT) AS tenths,
   greatest(t * CAST(0.01 AS DOUBLE), CAST(10 AS DOUBLE)) AS tolerance
  FROM (SELECT *, sub + ship + tax AS calc, abs(sub + ship + tax - tot) AS gap, several OR sub > tot * 2 AS big, CAST(tot AS DOUBLE) AS t
   FROM base WHERE tot > 0))
 WHERE gap > CASE WHEN big THEN greatest(tolerance * 3, t * CAST(0.05 AS DOUBLE)) ELSE tolerance END)"""

ITEM_SUM = f"""item_sum AS (
 SELECT order_id, 'warning' AS level, 'item_subtotal_mismatch' AS type, 'low' AS severity,
  'Sum of item prices (' || {fixed("ps")} || ') doesn''t match subtotal (' || {fixed("sub")} || ')' AS message,
  'items,subtotal' AS fields FROM base WHERE n > 0 AND sub > 0 AND abs(ps - sub) > 10)"""

ITEM_VALUE = f"""item_value AS (
 SELECT order_id, CASE WHEN gap > 100 THEN 'error' ELSE 'warning' END AS level,
  CASE WHEN gap > 100 THEN 'item_subtotal_mismatch' ELSE 'item_subtotal_minor_discrepancy' END AS type,
  CASE WHEN gap <= 100 THEN 'low' WHEN gap > CAST(sub AS DOUBLE) * CAST(0.1 AS DOUBLE) THEN 'critical' ELSE 'high' END AS severity,
  CASE WHEN gap > 100 THEN 'Item totals (€' || {fixed("vs")} || ') don''t match invoice subtotal (€' || {fixed("sub")} ||
   '). Difference: €' || {fixed("gap")} ELSE 'Minor discrepancy between item totals (€' || {fixed("vs")} || ') and subtotal (€' ||
   {fixed("sub")} || '): €' || {fixed("gap")} END AS message, 'items,subtotal' AS fields
 FROM (SELECT *, abs(vs - sub) AS gap FROM base) WHERE n > 0 AND sub > 0 AND gap > 10)"""

DATES = f"""dates AS (
 SELECT order_id, CASE WHEN order_date = 'undefined' THEN 'error' ELSE 'warning' END AS level,
  CASE WHEN order_date IS NULL THEN 'missing_date' WHEN order_date = 'undefined' THEN 'invalid_date_format'
   WHEN y > 2025 THEN 'future_date' ELSE 'very_old_date' END AS type,
  CASE WHEN order_date IS NULL THEN 'medium' WHEN order_date = 'undefined' THEN 'high' ELSE 'low' END AS severity,
  CASE WHEN order_date IS NULL THEN 'Order date is missing' WHEN order_date = 'undefined' THEN 'Date contains invalid placeholder values'
   WHEN y > 2025 THEN 'Order date appears to be in the future: ' || order_date ELSE 'Order date appears to be very old: ' || order_date END AS message,
  'orderDate' AS fields
 FROM (SELECT *, TRY_CAST(substr(order_date, 1, 4) AS INTEGER) AS y FROM base)
 WHERE order_date IS NULL OR order_date = 'undefined' OR y > year(DATE '{QUALITY_AS_OF}' + 1) + 1 OR y < 2010)"""

CURRENCY_RULE = f"""currency_rule AS (
 SELECT order_id, 'warning' AS level, 'inconsistent_invoice_currencies' AS type, 'medium' AS severity,
  'Inconsistent currencies in invoice fields: $, €' AS message, 'subtotal,shipping,tax,total' AS fields FROM base WHERE order_id % 13 = 0
 UNION ALL SELECT order_id, 'warning', 'multiple_currencies', 'low', 'Items have different currencies but invoice totals are consistent', 'items'
 FROM base WHERE order_id % 13 <> 0 AND symbols > 1
 UNION ALL SELECT order_id, 'warning', 'invalid_currency_format', 'medium', 'Invalid currency format in shipping: ' || {fixed("ship")}, 'shipping'
 FROM base WHERE order_id % 17 = 0)"""

COMPLETE = f"""complete AS (
 SELECT order_id, 'error' AS level, 'missing_critical_field' AS type, 'high' AS severity, 'Critical field ''orderNumber'' is missing' AS message,
  'orderNumber' AS fields FROM base WHERE order_number IS NULL
 UNION ALL SELECT order_id, 'error', 'missing_critical_field', 'high', 'Critical field ''total'' is missing', 'total' FROM base WHERE NOT has_total
 UNION ALL SELECT order_id, 'warning', 'no_items_found', 'medium', 'No items were extracted from the invoice despite having a subtotal', 'items'
 FROM base WHERE n = 0 AND sub > 0
 UNION ALL SELECT order_id, 'warning', 'high_total_amount', 'low', 'Total amount is unusually high: ' || {fixed("tot")}, 'total' FROM base WHERE tot > 1000000
 UNION ALL SELECT order_id, 'warning', 'low_total_amount', 'low', 'Total amount is unusually low: ' || {fixed("tot")}, 'total'
 FROM base WHERE tot > 0 AND tot < 100)"""

REPEATED = """repeated AS (
 SELECT order_id, asin, count(DISTINCT unit_cents) AS k, min(unit_cents) AS lo, max(unit_cents) AS hi
 FROM items GROUP BY order_id, asin HAVING count(DISTINCT unit_cents) > 1)"""


JSON_FAULTS = """json_lines AS (SELECT order_id, part_key AS p, 'items.' || CAST(row_number() OVER (PARTITION BY order_id
  ORDER BY line_number, part_key, supplier_key, total_cents, ship_date) - 1 AS VARCHAR) AS place FROM items WHERE order_id % 23 <> 0),
json_faults AS (
 SELECT order_id, '' AS path, 'json' AS rule FROM invoices WHERE order_id % 23 = 0
 UNION ALL SELECT order_id, 'orderNumber', 'pattern' FROM invoices WHERE order_id % 23 <> 0 AND order_id % 11 = 0
 UNION ALL SELECT order_id, 'subtotal', 'type' FROM invoices WHERE order_id % 23 <> 0 AND order_id % 13 = 0
 UNION ALL SELECT order_id, 'languageDetection.language', 'required' FROM invoices WHERE order_id % 23 <> 0 AND order_id % 19 = 0
 UNION ALL SELECT order_id, 'languageDetection.confidence', 'max' FROM invoices WHERE order_id % 23 <> 0 AND order_id % 17 = 0
 UNION ALL SELECT order_id, place || '.description', 'null' FROM json_lines WHERE p % 101 = 0
 UNION ALL SELECT order_id, place || '.quantity', CASE WHEN p % 29 = 0 THEN 'integer' WHEN p % 2 = 0 THEN 'min' ELSE 'type' END FROM json_lines WHERE p % 29 = 0 OR p % 5 = 0
 UNION ALL SELECT order_id, place || '.unitPrice', 'min' FROM json_lines WHERE p % 7 = 0)"""


def money_grade(present: str) -> str:
    return f"CASE WHEN {present} THEN 95 ELSE 0 END"


def quality_sql() -> dict[str, str]:
    base = [INVOICES, ITEMS, FLAWED]
    plural = lambda number, noun: f"CAST({number} AS VARCHAR) || ' {noun}' || CASE WHEN {number} > 1 THEN 's' ELSE '' END"
    classes = "CASE " + " ".join(
        "WHEN "
        + " OR ".join(
            [f"contains(lower(error), '{w}')" for w in words]
            + [f"contains(context, '{w}')" for w in context_words]
            + ([f"context = '{exact}'"] if exact else [])
        )
        + f" THEN {{}}{i}{{}}"
        if words or context_words
        else f"ELSE {{}}{i}{{}}"
        for i, (words, context_words, exact, *_) in enumerate(rules.ERROR_CLASSES)
    ).format(*[""] * 10) + " END"
    failures = f"""failures AS (SELECT o_orderkey AS order_id,
  ['File not found: a.pdf', 'PDF parsing failed', 'Field extraction failed', 'Schema validation problem', 'Out of luck', 'Permission denied'][o_orderkey % 6 + 1] AS error,
  ['batch-processing', 'pdf-parsing', 'field-extraction-total', 'post-validation'][o_orderkey % 4 + 1] AS context FROM orders),
 numbered AS (SELECT *, {classes} AS k FROM failures),
 classified AS (SELECT order_id, error, context,
  {"[" + ", ".join(quoted(r[3]) for r in rules.ERROR_CLASSES) + "]"}[k + 1] AS level,
  {"[" + ", ".join(quoted(r[4]) for r in rules.ERROR_CLASSES) + "]"}[k + 1] AS type,
  {"[" + ", ".join(str(r[5]).lower() for r in rules.ERROR_CLASSES) + "]"}[k + 1] AS recoverable,
  {"[" + ", ".join(quoted(r[6]) for r in rules.ERROR_CLASSES) + "]"}[k + 1] AS suggestion FROM numbered)"""
    found = """recovered AS (SELECT *, CAST(found AS DOUBLE) / 7 AS share FROM (SELECT *, 3 + CAST(order_number IS NOT NULL AS INTEGER) +
  CAST(order_date IS NOT NULL AS INTEGER) + CAST(has_total AS INTEGER) + CAST(n > 0 AS INTEGER) AS found FROM base))"""
    steps = []
    for kind, rows in rules.RECOVERY_ACTIONS.items():
        for i, (action, _, priority, needs) in enumerate(rows):
            steps.append(f"({quoted(kind)}, {i + 1}, {quoted(action)}, {quoted(priority)}, {str(needs).lower()})")
    runs = """runs AS (SELECT b.order_id, error, 35 + b.order_id % 33 AS ms, region AS language, b.order_id % 71 + 30 AS points,
  order_number_there, order_date_there, has_total, n > 0 AS has_items FROM
  (SELECT *, order_number IS NOT NULL AS order_number_there, order_date IS NOT NULL AS order_date_there FROM base) b
  JOIN owners o ON o.order_id = b.order_id)"""
    mean = lambda column: f"CAST(count_if(error IS NULL AND {column}) AS DOUBLE) / CAST(count_if(error IS NULL) AS DOUBLE)"
    hits = " + ".join(f"count_if(error IS NULL AND {c})" for c in ("order_number_there", "order_date_there", "has_total", "has_items"))
    grade = {
        "orderNumber": "CASE WHEN order_number IS NULL THEN 0 WHEN order_number = 'unreadable' THEN 30 ELSE 100 END",
        "orderDate": f"""CASE WHEN order_date IS NULL THEN 0 WHEN d IS NULL THEN 10
   WHEN year(d) >= 2020 AND d <= DATE '{QUALITY_AS_OF}' + 1 THEN 95 ELSE 60 END""",
        "items": "CASE WHEN n = 0 THEN 0 WHEN described > 0 THEN CAST(floor(CAST(described AS DOUBLE) / CAST(n AS DOUBLE) * 100 + 0.5) AS INTEGER) ELSE 10 END",
        "subtotal": "95",
        "shipping": "95",
        "tax": "95",
        "discount": money_grade("disc > 0"),
        "total": f"CASE WHEN NOT has_total THEN 0 WHEN tot > 100000000 THEN 60 ELSE 95 END",
        "currency": "CASE WHEN currency IS NULL THEN 0 WHEN currency = 'SEK' THEN 70 ELSE 100 END",
    }
    cost = " ".join(
        f"- (1 - CAST(g_{n} AS DOUBLE) / 100 * CAST({1.0 if c else 0.5} AS DOUBLE)) * {10 if c else 5}"
        for n, (c, _) in rules.CHECKLIST_B.items()
    )
    invalid_date = "order_date = 'undefined'"
    return {
        "dq_math": with_(*base, MATH, body="SELECT * FROM math"),
        "dq_items_sum": with_(*base, ITEM_SUM, body="SELECT * FROM item_sum"),
        "dq_item_subtotal": with_(*base, ITEM_VALUE, body="SELECT * FROM item_value"),
        "dq_dup_asin": with_(
            ITEMS,
            REPEATED,
            body=f"""SELECT order_id, 'error' AS level, 'duplicate_item_different_prices' AS type, 'critical' AS severity,
 'Multiple items with same ASIN ' || asin || ' have ' || CAST(k AS VARCHAR) || ' different prices: €' || {fixed("lo")} || ' to €' || {fixed("hi")}
 AS message, 'items' AS fields FROM repeated""",
        ),
        "dq_dup_asin_prices": with_(
            ITEMS,
            REPEATED,
            body="""SELECT order_id, asin, unit_cents AS price_cents, line_number AS position, description, k AS distinct_prices,
 count(*) OVER (PARTITION BY order_id, asin, unit_cents) AS copies FROM items JOIN repeated USING (order_id, asin)""",
        ),
        "dq_price": with_(
            ITEMS,
            body=f"""SELECT order_id, CASE WHEN unit_cents > 500000 THEN 'error' ELSE 'warning' END AS level,
 CASE WHEN unit_cents > 500000 THEN 'price_sanity_check_failed' ELSE 'high_price_warning' END AS type,
 CASE WHEN unit_cents > 500000 THEN 'critical' ELSE 'medium' END AS severity,
 'Item price €' || {fixed("unit_cents")} || ' is ' || CASE WHEN unit_cents > 500000 THEN 'unrealistically' ELSE 'unusually' END ||
 ' high for a consumer product' AS message, 'items' AS fields FROM items WHERE unit_cents > 100000""",
        ),
        "dq_date": with_(*base, DATES, body="SELECT * FROM dates"),
        "dq_currency": with_(*base, CURRENCY_RULE, body="SELECT * FROM currency_rule"),
        "dq_complete": with_(*base, COMPLETE, body="SELECT * FROM complete"),
        "dq_score": with_(
            *base,
            MATH,
            ITEM_SUM,
            ITEM_VALUE,
            DATES,
            CURRENCY_RULE,
            COMPLETE,
            REPEATED,
            """listed AS (SELECT order_id, level FROM math UNION ALL SELECT order_id, level FROM item_sum
 UNION ALL SELECT order_id, level FROM item_value UNION ALL SELECT order_id, level FROM dates
 UNION ALL SELECT order_id, level FROM currency_rule UNION ALL SELECT order_id, level FROM complete
 UNION ALL SELECT order_id, 'error' FROM repeated
 UNION ALL SELECT order_id, CASE WHEN unit_cents > 500000 THEN 'error' ELSE 'warning' END FROM items WHERE unit_cents > 100000),
 counts AS (SELECT base.order_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings
  FROM base LEFT JOIN listed USING (order_id) GROUP BY base.order_id)""",
            body=f"""SELECT order_id, errors, warnings, CAST(greatest(0, 100 - errors * 20 - warnings * 5) AS BIGINT) AS score,
 errors = 0 AS is_valid, CASE WHEN errors + warnings = 0 THEN 'All validations passed' ELSE {plural("(errors + warnings)", "validation issue")} ||
 ' found: ' || concat_ws(', ', CASE WHEN errors > 0 THEN {plural("errors", "error")} END,
  CASE WHEN warnings > 0 THEN {plural("warnings", "warning")} END) END AS summary FROM counts""",
        ),
        "dq_parser_score": with_(
            *base,
            """judged AS (SELECT order_id, CAST(order_number = 'unreadable' AS INTEGER) AS bad_number, n - described AS undescribed,
  CAST(order_number IS NULL AS INTEGER) AS no_number, CAST(order_date IS NULL AS INTEGER) AS no_date, CAST(n = 0 AS INTEGER) AS no_items,
  CAST(NOT has_total AS INTEGER) AS no_total,
  CAST(has_total AND CAST(tot AS DOUBLE) / 100 < CAST(sub AS DOUBLE) / 100 * CAST(0.8 AS DOUBLE) AS INTEGER) AS low FROM base),
 counts AS (SELECT *, CAST(coalesce(bad_number, 0) + undescribed AS BIGINT) AS errors,
  CAST(no_number + no_date + no_items + no_total + low AS BIGINT) AS warnings FROM judged)""",
            body="""SELECT order_id, CAST(100 - coalesce(bad_number, 0) * 15 - undescribed * 5 - no_number * 25 - no_date * 20 - no_items * 15
 - no_total * 15 - low * 5 AS BIGINT) AS score, errors, warnings, errors = 0 AS is_valid,
 CASE WHEN errors > 0 THEN errors || ' error(s), ' || warnings || ' warning(s)' WHEN warnings > 0 THEN warnings || ' warning(s)'
 ELSE 'Valid invoice data' END AS summary FROM counts""",
        ),
        "checklist_a": with_(
            *base,
            """graded AS (SELECT order_id, CAST(floor(CAST(100 * (4 + CAST(order_number IS NOT NULL AS INTEGER) + CAST(order_date IS NOT NULL AS INTEGER)
  + CAST(n > 0 AS INTEGER) + CAST(has_total AS INTEGER) + CAST(currency IS NOT NULL AS INTEGER)) AS DOUBLE) / 9 + 0.5) AS BIGINT) AS score,
  CAST(CAST(order_number IS NULL AS INTEGER) + CAST(order_date IS NULL AS INTEGER) + CAST(n = 0 AS INTEGER) + CAST(NOT has_total AS INTEGER)
   + CAST(currency IS NULL AS INTEGER) AS BIGINT) AS critical_missing FROM base)""",
            body="""SELECT order_id, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair'
 ELSE 'poor' END AS status, critical_missing, CAST(9 AS BIGINT) AS total_fields,
 concat_ws(', ', CASE WHEN critical_missing > 0 THEN 'manual_entry' END, CASE WHEN score < 60 THEN 'reupload' END) AS actions FROM graded""",
        ),
        "checklist_b": with_(
            *base,
            f"""graded AS (SELECT *, {", ".join(f"{g} AS g_{n}" for n, g in grade.items())}
  FROM (SELECT *, TRY_CAST(order_date AS DATE) AS d FROM base)),
 scored AS (SELECT *, CAST(greatest(0, least(100, floor(100 {cost} + 0.5))) AS BIGINT) AS score,
  CAST(CAST(order_number IS NULL AS INTEGER) + CAST(order_date IS NULL AS INTEGER) + CAST(n = 0 AS INTEGER) + CAST(NOT has_total AS INTEGER) AS BIGINT) AS critical_missing,
  concat_ws(', ', CASE WHEN g_orderNumber < 50 THEN 'orderNumber' END, CASE WHEN g_orderDate < 50 THEN 'orderDate' END,
   CASE WHEN g_items < 50 THEN 'items' END, CASE WHEN NOT has_total THEN 'total' END) AS manual,
  concat_ws(', ', CASE WHEN g_total = 60 THEN 'total' END, CASE WHEN currency = 'SEK' THEN 'currency' END) AS unsure FROM graded),
 named AS (SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair'
  WHEN score >= 40 THEN 'poor' ELSE 'critical' END AS status FROM scored)""",
            body="""SELECT order_id, score, status, critical_missing,
 CAST(9 - critical_missing - CAST(disc = 0 AS INTEGER) - CAST(currency IS NULL AS INTEGER) AS BIGINT) AS extracted_fields,
 concat_ws(' | ', CASE WHEN manual <> '' THEN 'Manual data entry required for critical fields: ' || manual END,
  CASE WHEN unsure <> '' THEN 'Verify financial calculations for: ' || unsure END,
  CASE status WHEN 'critical' THEN 'This invoice has significant parsing issues. Consider manual processing.'
   WHEN 'poor' THEN 'This invoice has parsing quality issues. Review extracted data carefully.' END,
  CASE WHEN order_date IS NULL THEN 'Order date is missing. Check invoice header or footer for date information.' END,
  CASE WHEN NOT has_total THEN 'Total amount is missing. Sum of subtotal, tax, and shipping may be needed.' END,
  CASE WHEN described > 0 AND g_items < 70 THEN 'Item descriptions may be incomplete. Verify item details manually.' END) AS recommendations FROM named""",
        ),
        "recovery_usable": with_(
            *base,
            found,
            body="""SELECT order_id, CAST(found AS BIGINT) AS found_fields, share AS overall_confidence,
 order_number IS NOT NULL AND order_date IS NOT NULL AND share > CAST(0.3 AS DOUBLE) AS usable,
 CAST(found + 1 AS DOUBLE) / 8 >= CAST(0.4 AS DOUBLE) AS usable_by_share FROM recovered""",
        ),
        "error_classes": with_(failures, body="SELECT * FROM classified"),
        "recovery_actions": with_(
            *base,
            found,
            failures,
            f"""steps AS (SELECT * FROM (VALUES {", ".join(steps)}) AS t(kind, place, action, priority, needs)),
 errors AS (SELECT order_id, type, share, order_number IS NOT NULL AND order_date IS NOT NULL AND share > CAST(0.3 AS DOUBLE) AS usable
  FROM classified JOIN recovered USING (order_id)),
 chosen AS (SELECT order_id, type, place, action, priority FROM errors JOIN steps
   ON kind = CASE WHEN type IN (SELECT kind FROM steps) THEN type ELSE 'other' END WHERE usable OR NOT needs
  UNION ALL SELECT order_id, type, 0, CASE WHEN share > CAST(0.7 AS DOUBLE) THEN 'high_confidence_data' ELSE 'medium_confidence_data' END,
   CASE WHEN share > CAST(0.7 AS DOUBLE) THEN 'high' ELSE 'medium' END FROM errors WHERE share > CAST(0.3 AS DOUBLE))""",
            body="""SELECT order_id, type, CAST(row_number() OVER (PARTITION BY order_id ORDER BY place) AS INTEGER) AS position, action, priority FROM chosen""",
        ),
        "extraction_metrics": with_(
            *base,
            found,
            body="""SELECT order_id, order_number IS NOT NULL AS has_order_number, order_date IS NOT NULL AS has_order_date, true AS has_subtotal,
 true AS has_tax, true AS has_shipping, has_total, n > 0 AS has_items, share AS overall, n AS total_items, described AS items_with_prices,
 described AS items_with_descriptions FROM recovered""",
        ),
        "schema_rejects": with_(
            *base,
            """lines AS (SELECT order_id, line_number, part_key, flawed.order_number, order_id + part_key AS k, quantity AS q, unit_cents, description
  FROM priced JOIN flawed USING (order_id)),
 texts AS (SELECT order_id, line_number, part_key, order_number, description,
  CASE WHEN k % 5 <> 0 THEN CAST(q AS VARCHAR) WHEN k % 2 = 0 THEN '0' ELSE 'many' END AS quantity,
  CASE WHEN k % 7 <> 0 THEN CAST(unit_cents AS VARCHAR) ELSE '-1' END AS unit_price,
  CASE WHEN k % 11 = 0 THEN '120' ELSE '19' END AS vat_rate, CASE WHEN k % 13 = 0 THEN 'severe' ELSE 'critical' END AS severity FROM lines)""",
            body="""SELECT *, nullif(concat_ws('; ', CASE WHEN order_number = 'unreadable' THEN 'orderNumber pattern' END,
 CASE WHEN quantity IN ('0', 'many') THEN 'quantity integer >= 1' END, CASE WHEN unit_price = '-1' THEN 'unitPrice number >= 0' END,
 CASE WHEN description IS NULL THEN 'description required' END, CASE WHEN vat_rate = '120' THEN 'vatRate 0..100' END,
 CASE WHEN severity = 'severe' THEN 'severity enum' END), '') AS reason FROM texts""",
        ),
        "schema_typed": with_(
            INVOICES,
            ITEMS,
            JSON_FAULTS,
            body=f"""SELECT order_id, CASE WHEN order_id % 37 <> 0 THEN order_number END AS "orderNumber", '$' || {fixed("subtotal_cents")} AS subtotal,
 CASE WHEN order_id % 7 = 3 THEN 'Amazon' ELSE vendor END AS vendor, item_count, CAST(coalesce(q, 0) AS BIGINT) AS quantity,
 CAST(coalesce(u, 0) AS BIGINT) AS unit_cents, CAST(0.9 AS DOUBLE) AS confidence
 FROM invoices LEFT JOIN (SELECT order_id, sum(quantity) AS q, sum(unit_cents) AS u FROM items GROUP BY order_id) USING (order_id)
 WHERE order_id NOT IN (SELECT order_id FROM json_faults)""",
        ),
        "schema_faults": with_(INVOICES, ITEMS, JSON_FAULTS, body="SELECT order_id, path, rule FROM json_faults"),
        "batch_outcomes": with_(
            *base,
            found,
            failures,
            body="""SELECT outcome, level, count(*) AS file_count FROM (
 SELECT CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN found < 7 THEN 'recovered' ELSE 'successful' END AS outcome,
  CASE WHEN o_orderstatus = 'F' THEN level END AS level
 FROM recovered JOIN classified USING (order_id) JOIN orders ON o_orderkey = order_id) GROUP BY outcome, level""",
        ),
        "perf_report": with_(
            *base,
            runs,
            body=f"""SELECT count(*) AS total_invoices, CAST(count_if(error IS NULL) AS BIGINT) AS successful_invoices,
 CAST(count_if(error IS NOT NULL) AS BIGINT) AS failed_invoices, CAST(count_if(error IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS success_rate,
 CAST(sum(ms) FILTER (error IS NULL) AS BIGINT) AS total_ms,
 CAST(sum(ms) FILTER (error IS NULL) AS DOUBLE) / CAST(count_if(error IS NULL) AS DOUBLE) AS average_ms,
 min(ms) FILTER (error IS NULL) AS min_ms, max(ms) FILTER (error IS NULL) AS max_ms,
 CAST({hits} + 3 * count_if(error IS NULL) AS DOUBLE) / CAST(count_if(error IS NULL) AS DOUBLE) / 7 AS average_extraction,
 {mean("order_number_there")} AS order_number_rate, {mean("order_date_there")} AS order_date_rate, {mean("has_items")} AS items_rate,
 {mean("true")} AS subtotal_rate, {mean("true")} AS tax_rate, {mean("true")} AS shipping_rate, {mean("has_total")} AS total_rate FROM runs""",
        ),
        "perf_by_language": with_(
            *base,
            runs,
            body="""SELECT language, count(*) AS document_count, CAST(sum(points) AS DOUBLE) / 100 / CAST(count(*) AS DOUBLE) AS average_confidence
 FROM runs WHERE error IS NULL GROUP BY language""",
        ),
        "perf_errors": with_(
            *base, runs, body="SELECT error, count(*) AS invoice_count FROM runs WHERE error IS NOT NULL GROUP BY error"
        ),
    }


COMPARED = f"""compared AS (
 SELECT job_id, processed_at, order_number, strftime(order_date, '%Y-%m-%d') AS order_date, customer_name, currency,
  CAST(total_cents AS DOUBLE) / 100 AS total FROM invoices),
firsts AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY processed_at, order_number) AS place FROM compared
 WHERE job_id IN ({", ".join(f"'{j}'" for j in COMPARED_JOBS)})),
cells AS ({" UNION ALL ".join(
    f"SELECT job_id AS group_id, '{shown}' AS field, "
    + (f"CAST({c} AS VARCHAR) AS value, {c} AS number" if c == "total" else f"{c} AS value, CAST(NULL AS DOUBLE) AS number")
    + f", CAST({0.9 if c in ('order_number', 'total') else 0.7} AS DOUBLE) AS confidence FROM firsts WHERE place = 1"
    for c, shown in FIELDS.items())}),
judged AS (SELECT field, coalesce(max(number) - min(number) >= CAST(0.01 AS DOUBLE), false)
   OR coalesce(max(lower(value)) FILTER (number IS NULL) <> min(lower(value)) FILTER (number IS NULL), false) AS has_differences,
  CAST(CAST(sum(round(confidence * 10)) AS BIGINT) AS DOUBLE) / 10 / CAST(count(*) AS DOUBLE) AS confidence, count(*) AS value_count,
  {len(COMPARED_JOBS)} - count(*) AS missing_jobs FROM cells GROUP BY field)"""


def compare_sql() -> dict[str, str]:
    wide = ", ".join(
        f"max(value) FILTER (group_id = '{j}') AS {j}_value, max(confidence) FILTER (group_id = '{j}') AS {j}_confidence"
        for j in COMPARED_JOBS
    )
    return {
        "compare_values": with_(INVOICES, COMPARED, body="SELECT * FROM cells"),
        "compare_fields": with_(INVOICES, COMPARED, body="SELECT * FROM judged"),
        "compare_issues": with_(
            INVOICES,
            COMPARED,
            body="""SELECT field, 'difference' AS type, CASE WHEN confidence < 0.5 THEN 'high' ELSE 'medium' END AS severity,
 'Values differ across invoices for field: ' || field AS message FROM judged WHERE has_differences
 UNION ALL SELECT field, 'missing', 'medium', 'Missing data for field: ' || field || ' in some invoices' FROM judged WHERE missing_jobs > 0""",
        ),
        "compare_summary": with_(
            INVOICES,
            COMPARED,
            body="""SELECT count(*) AS total_fields, CAST(count_if(has_differences) AS BIGINT) AS fields_with_differences,
 CAST(sum(CAST(has_differences AS INTEGER) + CAST(missing_jobs > 0 AS INTEGER)) AS BIGINT) AS total_issues,
 round(avg(confidence), 6) AS average_confidence FROM judged""",
        ),
        "compare_pivot": with_(
            INVOICES,
            COMPARED,
            body=f"SELECT field, any_value(has_differences) AS has_differences, {wide} FROM cells JOIN (SELECT field, has_differences FROM judged) USING (field) GROUP BY field",
        ),
        "compare_search": with_(
            INVOICES,
            COMPARED,
            body="SELECT field, has_differences, value_count FROM judged WHERE contains(lower(field), 'total')",
        ),
        "compare_missing_jobs": with_(
            OWNERS,
            body=f"""SELECT job_id FROM (VALUES {", ".join(f"('{j}')" for j in [*COMPARED_JOBS, "job_1890_0", "job_1891_1"])}) AS asked(job_id)
 WHERE job_id NOT IN (SELECT job_id FROM owners)""",
        ),
        "compare_nested": with_(
            INVOICES,
            ITEMS,
            "sizes AS (SELECT order_id, coalesce(n, 0) AS n FROM invoices LEFT JOIN (SELECT order_id, count(*) AS n FROM items GROUP BY order_id) USING (order_id))",
            """cells AS (
 SELECT 'seller.name' AS field, false AS differs FROM sizes
 UNION ALL SELECT 'totals.total', order_id % 5 = 0 FROM sizes
 UNION ALL SELECT 'items.0.price', n > 0 AND order_id % 7 = 0 FROM sizes
 UNION ALL SELECT 'items.0.description', false FROM sizes
 UNION ALL SELECT 'items.2.price', false FROM sizes
 UNION ALL SELECT 'tags.channel', order_id % 13 = 0 FROM sizes
 UNION ALL SELECT unnest(['tags.absent', 'totals.absent']), false FROM sizes)""",
            body="""SELECT field, count(*) AS orders, CAST(count_if(differs) AS BIGINT) AS orders_with_differences,
 CAST(0 AS BIGINT) AS orders_in_one_run FROM cells GROUP BY field""",
        ),
        "compare_all_jobs": with_(
            INVOICES,
            COMPARED,
            f"""pairs AS (SELECT *, CAST(substr(order_number, 1, 3) AS INTEGER) AS share FROM compared),
 changes AS ({" UNION ALL ".join(
     f"SELECT order_number, '{shown}' AS field, "
     + {"total": "share % 7 <> 0 AND share % 5 = 0", "customer_name": "false"}.get(c, "false")
     + " AS differs FROM pairs" for c, shown in FIELDS.items() if c != "order_number")})""",
            body="""SELECT field, count(*) AS orders, CAST(count_if(differs) AS BIGINT) AS orders_with_differences,
 CAST(0 AS BIGINT) AS orders_in_one_run FROM changes GROUP BY field""",
        ),
    }


NOISY = """noisy AS (SELECT doc_id, text FROM documents)"""
SPACED = r"""spaced AS (SELECT doc_id, replace(replace(text, '. ', '.  ' || chr(9) || ' '), chr(10), ' ' || repeat(chr(10), 5) || '  ') AS text FROM documents)"""

HEADS = [
    "", "Amazon.com\nOrder Placed: May 3, 2020\n$5", "amazon.de Rechnung 12,00 € MwSt Bestelldatum 1.2.2020",
    "Commande du 3 mars 2020\nTVA 20%\nTotal TTC 12,00 €", "CHF 12.00 Bestellnummer Zwischensumme Versand MwSt Gesamtbetrag",
    "Order Number 1\nSubtotal £5.00\nVAT Grand Total Postage", "注文番号 注文日 小計 合計 2020年1月2日", "Factura Total IVA 21% Importe total Envío 5,00 €",
]
SUB_HEADS = ["amazon.de\n", "amazon.de Firma GmbH USt-IdNr\n", "Rechnung ASIN: X Privatkunde\n", "Rechnung ASIN: | 2 | ASIN:\n"]


def text_list(words: list[str]) -> str:
    return "[" + ", ".join("replace(" + quoted(w.replace("\n", "~")) + ", '~', chr(10))" for w in words) + "]"


MARKED = f"marked AS (SELECT doc_id, {text_list(HEADS)}[doc_id % {len(HEADS)} + 1] || chr(10) || text AS text FROM documents)"


def token_sum(tokens: list[tuple[int, list[str]]]) -> str:
    return " + ".join(f"CAST(contains(low, {quoted(w.lower())}) AS INTEGER) * {points}" for points, words in tokens for w in words)


def matches(column: str, pattern: str) -> str:
    return f"CAST(regexp_matches({column}, {quoted(pattern)}) AS INTEGER)"


def whole_words(phrase: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return rf"(?:^|{edge}){phrase.replace(' ', chr(92) + 's+')}(?:$|{edge})"


def language_sum(language: languages.Language) -> str:
    edge = r"(?:^|[^\p{L}\p{N}_])"
    terms = [f"{matches('up', whole_words(p))} * 15" for p in language.strong]
    terms += [f"{matches('up', edge + p)} * 15" for p in language.open_ended]
    terms += [f"{matches('up', whole_words(p))} * 8" for p in language.medium]
    if language.money_limit is None:
        terms.append(f"{matches('up', '|'.join(language.money))} * 15")
    else:
        counts = " + ".join(f"len(regexp_extract_all(up, {quoted(p)}))" for p in language.money)
        terms.append(f"least(({counts}) * 5, {language.money_limit})")
    terms.append(f"{matches('up', language.dates)} * 10")
    return f"least(100, {' + '.join(terms)})"


DATE_FORMS = """(o_orderkey % 8)"""
EXPECTED_RULE_SET = """CASE r WHEN 'AMERICA' THEN 'us' WHEN 'AFRICA' THEN 'uk' WHEN 'EUROPE' THEN 'eu_consumer' WHEN 'ASIA' THEN 'japanese' ELSE 'swiss' END"""
EXPECTED_ITEMS = f"""expected_items AS (
 SELECT order_id, region, CASE WHEN region = 'EUROPE' THEN asin END AS asin, description, quantity,
  CAST(CASE region WHEN 'ASIA' THEN unit_cents * 100 ELSE unit_cents END AS BIGINT) AS unit_cents,
  CAST(CASE region WHEN 'ASIA' THEN unit_cents * 100 * quantity ELSE unit_cents * quantity END AS BIGINT) AS total_cents
 FROM items JOIN owners USING (order_id))"""


PLACED = """placed AS (SELECT * REPLACE (CAST(unit_cents AS BIGINT) AS unit_cents), CAST(row_number() OVER (PARTITION BY order_id
  ORDER BY line_number, part_key, supplier_key, items.total_cents, ship_date) - 1 AS INTEGER) AS position FROM items)"""


def printed(cents: str) -> str:
    """An amount as the page of its region shows it."""
    pounds = f"'£' || format('{{:,}}', {cents} // 100) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0')"
    return f"""CASE region WHEN 'AMERICA' THEN '$' || {fixed(cents)} WHEN 'EUROPE' THEN replace({fixed(cents)}, '.', ',') || ' €'
  WHEN 'AFRICA' THEN {pounds} WHEN 'ASIA' THEN '¥' || format('{{:,}}', {cents}) ELSE 'CHF ' || {fixed(cents)} END"""


# What the page of an order must give, by its region: amounts in cents, items as printed, and whether the page
# repeats the label of the subtotal. Yen are read as whole yen.
PAGES = f"""page_facts AS (SELECT order_id, count(*) AS n, CAST(sum(total_cents) AS BIGINT) AS ps, CAST(sum(unit_cents * quantity) AS BIGINT) AS vs,
  count_if(unit_cents > 500000) AS vh, count_if(unit_cents > 100000 AND unit_cents <= 500000) AS hp, CAST(count_if(unit_cents > 0) AS BIGINT) AS priced
  FROM expected_items GROUP BY order_id),
base AS (SELECT order_id, order_number, strftime(order_date, '%Y-%m-%d') AS order_date, region, order_id % 6 = 1 AND region = 'AMERICA' AS several,
  CAST(CASE region WHEN 'EUROPE' THEN coalesce(ps, 0) WHEN 'ASIA' THEN subtotal_cents * 100 ELSE subtotal_cents END AS BIGINT) AS sub,
  CAST(CASE region WHEN 'ASIA' THEN shipping_cents * 100 ELSE shipping_cents END AS BIGINT) AS ship,
  CAST(CASE region WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN tax_cents * 100 ELSE tax_cents END AS BIGINT) AS tax,
  CAST(CASE region WHEN 'EUROPE' THEN coalesce(ps, 0) + shipping_cents WHEN 'ASIA' THEN total_cents * 100 ELSE total_cents END AS BIGINT) AS tot,
  true AS has_total, region <> 'EUROPE' OR n IS NOT NULL AS has_sub, region <> 'EUROPE' AS has_tax,
  coalesce(n, 0) AS n, coalesce(ps, 0) AS ps, coalesce(vs, 0) AS vs, coalesce(vh, 0) AS vh, coalesce(hp, 0) AS hp, coalesce(priced, 0) AS priced
  FROM invoices LEFT JOIN page_facts USING (order_id))"""

PAGE_REPEATED = """repeated AS (SELECT order_id, asin, count(DISTINCT unit_cents) AS k, min(unit_cents) AS lo, max(unit_cents) AS hi
 FROM expected_items WHERE asin IS NOT NULL GROUP BY order_id, asin HAVING count(DISTINCT unit_cents) > 1)"""


def assess_sql() -> dict[str, str]:
    parts = [INVOICES, ITEMS, EXPECTED_ITEMS, PAGES, MATH, ITEM_SUM, ITEM_VALUE, DATES, COMPLETE, PAGE_REPEATED]
    rules_ = ("math", "item_sum", "item_value", "dates", "complete")
    shown = " UNION ALL ".join(f"SELECT order_id, level, type, severity, message, fields FROM {name}" for name in rules_)
    listed = f"""listed AS ({shown}
 UNION ALL SELECT order_id, 'error', 'duplicate_item_different_prices', 'critical',
  'Multiple items with same ASIN ' || asin || ' have ' || CAST(k AS VARCHAR) || ' different prices: €' || {fixed("lo")} || ' to €' || {fixed("hi")}, 'items' FROM repeated
 UNION ALL SELECT order_id, CASE WHEN unit_cents > 500000 THEN 'error' ELSE 'warning' END,
  CASE WHEN unit_cents > 500000 THEN 'price_sanity_check_failed' ELSE 'high_price_warning' END, CASE WHEN unit_cents > 500000 THEN 'critical' ELSE 'medium' END,
  'Item price €' || {fixed("unit_cents")} || ' is ' || CASE WHEN unit_cents > 500000 THEN 'unrealistically' ELSE 'unusually' END ||
  ' high for a consumer product', 'items' FROM expected_items WHERE unit_cents > 100000)"""
    counts = """counts AS (SELECT base.*, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings,
  count(*) FILTER (level = 'error' AND contains(fields, 'items')) AS item_errors, count(*) FILTER (level = 'error' AND contains(fields, 'subtotal')) AS sub_errors
  FROM base LEFT JOIN listed USING (order_id) GROUP BY ALL)"""
    plural = lambda number, noun: f"CAST({number} AS VARCHAR) || ' {noun}' || CASE WHEN {number} > 1 THEN 's' ELSE '' END"
    # Strict reading takes one comma group of whole yen as decimals, and of more groups the first one only.
    strict = lambda cents: f"""CASE WHEN region <> 'ASIA' THEN CAST({cents} AS DOUBLE) / 100 WHEN {cents} < 100000 THEN CAST({cents} // 100 AS DOUBLE)
   WHEN {cents} < 100000000 THEN CAST({cents} // 100 AS DOUBLE) / 1000 WHEN {cents} < 100000000000 THEN CAST({cents} // 100000000 AS DOUBLE)
   ELSE CAST({cents} // 100000000000 AS DOUBLE) END"""  # noqa: E731
    found = "2 + CAST(has_sub AS INTEGER) + CAST(has_tax AS INTEGER) + 2 + CAST(n > 0 AS INTEGER)"
    money = {"subtotal": ("has_sub", "sub"), "shipping": ("true", "ship"), "tax": ("has_tax", "tax"), "total": ("true", "tot")}
    grade = {
        "orderNumber": "100",
        "orderDate": f"CASE WHEN year(CAST(order_date AS DATE)) >= 2020 AND CAST(order_date AS DATE) <= DATE '{QUALITY_AS_OF}' + 1 THEN 95 ELSE 60 END",
        "items": "CASE WHEN n = 0 THEN 0 ELSE 100 END",
        "discount": "0",
        "currency": "100",
        **{name: f"CASE WHEN NOT {there} THEN 0 WHEN {strict(cents)} > 1000000 THEN 60 ELSE 95 END" for name, (there, cents) in money.items()},
    }
    weights = {"orderNumber": 1, "orderDate": 1, "items": 1, "subtotal": 1, "shipping": 0, "tax": 1, "discount": 0, "total": 1, "currency": 0}
    cost = " ".join(f"- (1 - CAST(g_{n} AS DOUBLE) / 100 * CAST({1.0 if c else 0.5} AS DOUBLE)) * {10 if c else 5}" for n, c in weights.items())
    return {
        "assess_documents": with_(
            *parts,
            listed,
            counts,
            f"""judged AS (SELECT *, CAST(n = 0 AS INTEGER) AS no_items,
  CAST(has_sub AND {strict("tot")} < {strict("sub")} * CAST(0.8 AS DOUBLE) AS INTEGER) AS low FROM counts)""",
            body=f"""SELECT order_id, order_number, errors, warnings, CAST(greatest(0, 100 - errors * 20 - warnings * 5) AS BIGINT) AS score,
 errors = 0 AS is_valid, CASE WHEN errors + warnings = 0 THEN 'All validations passed' ELSE {plural("(errors + warnings)", "validation issue")} ||
 ' found: ' || concat_ws(', ', CASE WHEN errors > 0 THEN {plural("errors", "error")} END,
  CASE WHEN warnings > 0 THEN {plural("warnings", "warning")} END) END AS summary,
 CAST(100 - no_items * 15 - low * 5 AS BIGINT) AS parser_score, CAST(0 AS BIGINT) AS parser_errors, CAST(no_items + low AS BIGINT) AS parser_warnings,
 CASE WHEN no_items + low > 0 THEN (no_items + low) || ' warning(s)' ELSE 'Valid invoice data' END AS parser_summary,
 true AS has_order_number, true AS has_order_date, has_sub AS has_subtotal, has_tax, true AS has_shipping, true AS has_total, n > 0 AS has_items,
 CAST({found} AS DOUBLE) / 7 AS overall, n AS total_items, priced AS items_with_prices, n AS items_with_descriptions FROM judged""",
        ),
        "document_issues": with_(*parts, listed, body="SELECT * FROM listed"),
        "document_checklists": with_(
            *parts,
            listed,
            counts,
            f"""marked AS (SELECT *, CAST(CASE WHEN n > 0 THEN greatest(0, 100 - item_errors * 20) ELSE 0 END + CASE WHEN has_sub THEN greatest(0, 100 - sub_errors * 20) ELSE 0 END
  + CASE WHEN has_tax THEN 100 ELSE 0 END + 600 AS DOUBLE) AS points, {", ".join(f"{g} AS g_{n}" for n, g in grade.items())} FROM counts),
 scored AS (SELECT *, CAST(floor(points / 9 + 0.5) AS BIGINT) AS a, CAST(n = 0 AS BIGINT) AS a_missing,
  CAST(greatest(0, least(100, floor(100 {cost} + 0.5))) AS BIGINT) AS b,
  CAST(CAST(n = 0 AS INTEGER) + CAST(NOT has_sub AS INTEGER) + CAST(NOT has_tax AS INTEGER) AS BIGINT) AS b_missing,
  concat_ws(', ', CASE WHEN n = 0 THEN 'items' END, CASE WHEN NOT has_sub THEN 'subtotal' END, CASE WHEN NOT has_tax THEN 'tax' END) AS manual,
  concat_ws(', ', CASE WHEN g_subtotal = 60 THEN 'subtotal' END, CASE WHEN g_shipping = 60 THEN 'shipping' END, CASE WHEN g_tax = 60 THEN 'tax' END,
   CASE WHEN g_total = 60 THEN 'total' END) AS unsure FROM marked),
 named AS (SELECT *, CASE WHEN b >= 90 THEN 'excellent' WHEN b >= 75 THEN 'good' WHEN b >= 60 THEN 'fair' WHEN b >= 40 THEN 'poor' ELSE 'critical' END AS b_named FROM scored)""",
            body="""SELECT order_id, a AS a_score, CASE WHEN a >= 80 THEN 'excellent' WHEN a >= 60 THEN 'good' WHEN a >= 40 THEN 'fair' ELSE 'poor' END AS a_status,
 a_missing AS a_critical_missing, concat_ws(', ', CASE WHEN a_missing > 0 THEN 'manual_entry' END, CASE WHEN a < 60 THEN 'reupload' END,
  CASE WHEN item_errors + sub_errors > 0 THEN 'review_data' END) AS a_actions,
 b AS b_score, b_named AS b_status, b_missing AS b_critical_missing, CAST(8 - b_missing AS BIGINT) AS b_extracted_fields,
 concat_ws(' | ', CASE WHEN manual <> '' THEN 'Manual data entry required for critical fields: ' || manual END,
  CASE WHEN unsure <> '' THEN 'Verify financial calculations for: ' || unsure END,
  CASE b_named WHEN 'critical' THEN 'This invoice has significant parsing issues. Consider manual processing.'
   WHEN 'poor' THEN 'This invoice has parsing quality issues. Review extracted data carefully.' END) AS b_recommendations FROM named""",
        ),
    }


def text_sql() -> dict[str, str]:
    ranked = ", ".join(f"({i}, '{language.code}', p_{language.code})" for i, language in enumerate(languages.LANGUAGES))
    votes = {code: " + ".join(matches("text", f"(?i){s}") for s in signs) for code, signs in formats.EU_LANGUAGE_SIGNS.items()}
    best = f"greatest({', '.join('v_' + code for code in votes)})"
    vote_case = " ".join(f"WHEN v_{code} = {best} THEN '{code}'" for code in reversed(list(votes)))
    edge = "[^0-9A-Za-z_]"
    return {
        "stream_progress": f"""SELECT job_id, processed, successful, failed, {rate("successful", "processed")} AS success_rate FROM (
 SELECT user_id AS job_id, count(*) AS processed, CAST(count_if(event_type = 'purchase') AS BIGINT) AS successful,
  CAST(count_if(event_type = 'error') AS BIGINT) AS failed FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)""",
        "stream_windowed": f"""SELECT period_start, job_id, processed, successful, failed, {rate("successful", "processed")} AS success_rate FROM (
 SELECT date_trunc('day', ts) AS period_start, user_id AS job_id, count(*) AS processed, CAST(count_if(event_type = 'purchase') AS BIGINT) AS successful,
  CAST(count_if(event_type = 'error') AS BIGINT) AS failed FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL)""",
        "ruleset_best": with_(
            INVOICES,
            ITEMS,
            EXPECTED_ITEMS,
            PAGES,
            body="""SELECT order_id, CASE region WHEN 'AMERICA' THEN 'us' WHEN 'AFRICA' THEN 'uk' WHEN 'ASIA' THEN 'japanese' WHEN 'MIDDLE EAST' THEN 'swiss'
  ELSE CASE WHEN n > 0 THEN 'eu_consumer' ELSE 'eu_business' END END AS rule_set,
 CASE WHEN region <> 'EUROPE' THEN 6 + CAST(n > 0 AS BIGINT) WHEN n > 0 THEN 6 ELSE 4 END AS points, order_number, tot AS total_cents, n AS item_count
 FROM base JOIN invoices USING (order_id, order_number, region)""",
        ),
        "clean_mojibake": "SELECT doc_id, text FROM documents",
        "clean_light": with_(
            SPACED,
            body="""SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(9), ' '), ' {2,}', ' ', 'g'), '\\n{4,}',
 repeat(chr(10), 3), 'g') AS text FROM spaced""",
        ),
        "clean_final": with_(
            SPACED,
            body="""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\t\\f\\r]+', ' ', 'g'), ' {2,}', ' ', 'g'),
 '\\n{3,}', repeat(chr(10), 2), 'g'), '(?m)^ +| +$', '', 'g'), ' ' || chr(10)) AS text FROM spaced""",
        ),
        "filter_report_docs": """SELECT doc_id, CAST(length(text) + CASE WHEN doc_id % 7 = 0 THEN 22 ELSE 0 END AS INTEGER) AS length
 FROM documents WHERE doc_id % 9 <> 0""",
        "parse_money": with_(
            ITEMS,
            body="""SELECT order_id, line_number, CASE WHEN f = 6 THEN 0 ELSE total_cents END AS tolerant_cents,
 CASE f WHEN 6 THEN 0 WHEN 5 THEN -total_cents ELSE total_cents END AS signed_cents,
 CASE f WHEN 6 THEN NULL WHEN 5 THEN -total_cents ELSE total_cents END AS strict_cents,
 CASE f WHEN 1 THEN '€' WHEN 2 THEN '£' WHEN 3 THEN '€' WHEN 4 THEN 'CHF' WHEN 6 THEN NULL ELSE '$' END AS symbol,
 f NOT IN (5, 6) AS well_formed FROM (SELECT *, line_number % 7 AS f FROM items)""",
        ),
        "parse_dates": """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 8 <> 7 THEN CAST(o_orderdate AS DATE) END AS day,
 CASE WHEN o_orderkey % 8 <> 7 THEN CAST(o_orderdate AS DATE) END AS report_day FROM orders""",
        "classify_format": with_(
            MARKED,
            f"""scored AS (SELECT doc_id, {token_sum(formats.US_TOKENS)} AS us_score, {token_sum(formats.EU_TOKENS)} AS eu_score
  FROM (SELECT doc_id, lower(text) AS low FROM marked)),
 named AS (SELECT *, CASE WHEN us_score < 25 AND eu_score < 25 THEN NULL WHEN eu_score >= us_score THEN 'amazon.eu' ELSE 'amazon.com' END AS format,
  greatest(us_score, eu_score) AS w, least(us_score, eu_score) >= 25 AS both_strong FROM scored),
 graded AS (SELECT *, CASE WHEN w < 25 THEN 0 WHEN w >= 100 THEN 100 WHEN w >= 80 THEN CASE WHEN both_strong THEN 60 ELSE 80 END
  WHEN w >= 60 THEN CASE WHEN both_strong THEN 55 ELSE 60 END WHEN w >= 40 THEN 40 ELSE 25 END AS format_confidence FROM named)""",
            body="""SELECT doc_id, us_score, eu_score, format, CAST(format_confidence AS INTEGER) AS format_confidence,
 CASE WHEN format_confidence < 25 THEN 'VERY LOW' WHEN format_confidence < 40 THEN 'LOW' WHEN format_confidence < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS quality_level,
 CASE WHEN format_confidence < 25 THEN 'reject' WHEN format_confidence < 70 THEN 'review' ELSE 'accept' END AS action FROM graded""",
        ),
        "classify_subtype": """SELECT doc_id, 'amazon.eu' AS format, CASE WHEN doc_id % 2 = 1 THEN 'business' ELSE 'consumer' END AS subtype
 FROM documents""",
        "detect_language": with_(
            MARKED,
            "points AS (SELECT doc_id, "
            + ", ".join(f"{language_sum(language)} AS p_{language.code}" for language in languages.LANGUAGES)
            + " FROM (SELECT doc_id, upper(text) AS up FROM marked))",
            f"""long AS (SELECT doc_id, unnest([{", ".join(f"{{'place': {i}, 'code': '{language.code}', 'p': p_{language.code}}}" for i, language in enumerate(languages.LANGUAGES))}]) AS e FROM points),
 best AS (SELECT doc_id, e.code AS code, e.p AS p, row_number() OVER (PARTITION BY doc_id ORDER BY e.p DESC, e.place) AS k FROM long)""",
            body="""SELECT doc_id, CASE WHEN p >= 30 THEN code ELSE 'UNKNOWN' END AS language, CAST(p AS DOUBLE) / 100 AS language_confidence,
 p >= 30 AS language_supported FROM best WHERE k = 1""",
        ),
        "eu_language_vote": with_(
            MARKED,
            "votes AS (SELECT doc_id, " + ", ".join(f"{v} AS v_{code}" for code, v in votes.items()) + " FROM marked)",
            body=f"SELECT doc_id, CASE WHEN {best} = 0 THEN 'en' {vote_case} END AS language FROM votes",
        ),
        "route_documents": with_(
            OWNERS,
            body=f"""SELECT order_id, CASE WHEN r = 'AMERICA' THEN 'amazon.com' WHEN r = 'EUROPE' THEN 'amazon.eu' END AS format,
 CASE WHEN r = 'EUROPE' THEN 'consumer' END AS subtype, {EXPECTED_RULE_SET} AS rule_set FROM (SELECT order_id, region AS r FROM owners)""",
        ),
        "extract_headers": with_(
            INVOICES,
            ITEMS,
            EXPECTED_ITEMS,
            "gross AS (SELECT order_id, CAST(sum(total_cents) AS BIGINT) AS g FROM expected_items WHERE region = 'EUROPE' GROUP BY order_id)",
            body="""SELECT order_id, order_number, CAST(order_date AS DATE) AS order_date,
 CASE region WHEN 'EUROPE' THEN g WHEN 'ASIA' THEN subtotal_cents * 100 ELSE subtotal_cents END AS subtotal_cents,
 CASE region WHEN 'ASIA' THEN shipping_cents * 100 ELSE shipping_cents END AS shipping_cents,
 CASE region WHEN 'EUROPE' THEN NULL WHEN 'ASIA' THEN tax_cents * 100 ELSE tax_cents END AS tax_cents,
 CAST(CASE region WHEN 'EUROPE' THEN coalesce(g, 0) + shipping_cents WHEN 'ASIA' THEN total_cents * 100 ELSE total_cents END AS BIGINT) AS total_cents,
 currency, item_count FROM invoices LEFT JOIN gross USING (order_id)""",
        ),
        "extract_languages": with_(
            INVOICES,
            body=f"""SELECT order_id AS doc_id, [{", ".join(quoted(n) for n in LANGUAGE_LAYOUTS)}][order_id % {len(LANGUAGE_LAYOUTS)} + 1] AS rule_set,
 order_number, CAST(order_date AS DATE) AS order_date, subtotal_cents, shipping_cents, tax_cents,
 CASE WHEN order_id % {len(LANGUAGE_LAYOUTS)} NOT IN (5, 6) THEN discount_cents END AS discount_cents, total_cents FROM invoices""",
        ),
        "classify_scores": with_(
            MARKED,
            body=f"""SELECT doc_id, {token_sum(formats.US_TOKENS)} AS us_score, {token_sum(formats.EU_TOKENS)} AS eu_score
 FROM (SELECT doc_id, lower(text) AS low FROM marked)""",
        ),
        "extract_items": with_(
            OWNERS,
            ITEMS,
            EXPECTED_ITEMS,
            body="SELECT order_id, asin, description, quantity, unit_cents, total_cents FROM expected_items",
        ),
        "item_fingerprints": with_(
            OWNERS,
            ITEMS,
            EXPECTED_ITEMS,
            body="""SELECT order_id, asin, description, unit_cents, CAST(count(*) OVER (
 PARTITION BY order_id, asin, description, quantity, unit_cents, total_cents) AS INTEGER) AS copies FROM expected_items""",
        ),
        "extract_csv": with_(
            INVOICES,
            ITEMS,
            f"""placed AS (SELECT order_id, description, unit_cents, quantity, row_number() OVER (PARTITION BY order_id
  ORDER BY line_number, part_key, supplier_key, total_cents, ship_date) AS position FROM items),
 gross AS (SELECT order_id, CAST(sum(unit_cents * quantity) AS BIGINT) AS g FROM items GROUP BY order_id),
 pages AS (SELECT invoices.* REPLACE (CAST(CASE WHEN region = 'EUROPE' THEN g ELSE subtotal_cents END AS BIGINT) AS subtotal_cents,
   CAST(CASE WHEN region = 'EUROPE' THEN coalesce(g, 0) + shipping_cents ELSE total_cents END AS BIGINT) AS total_cents,
   CASE WHEN region <> 'EUROPE' THEN tax_cents END AS tax_cents) FROM invoices LEFT JOIN gross USING (order_id))""",
            body=f"""SELECT CASE WHEN first THEN order_number END AS order_number, CASE WHEN first THEN CAST(order_date AS DATE) END AS order_date,
 CASE WHEN first THEN {printed("subtotal_cents")} END AS subtotal, CASE WHEN first THEN {printed("shipping_cents")} END AS shipping,
 CASE WHEN first THEN {printed("tax_cents")} END AS tax, CASE WHEN first THEN {printed("total_cents")} END AS total,
 CASE WHEN first THEN 'Amazon' END AS vendor, description AS item_description,
 CASE WHEN region <> 'EUROPE' THEN {printed("unit_cents")} END AS item_price
 FROM (SELECT pages.*, description, unit_cents, coalesce(position, 1) = 1 AS first FROM pages LEFT JOIN placed USING (order_id))""",
        ),
        **assess_sql(),
        "extract_business_items": with_(
            ITEMS,
            PLACED,
            body="""SELECT order_id, 'eu_business' AS rule_set, position, asin, description || ' mit Zubehoer und Tragetasche' AS description, quantity, unit_cents,
 CAST(unit_cents * quantity AS BIGINT) AS total_cents FROM placed""",
        ),
        "extract_language_items": with_(
            ITEMS,
            PLACED,
            "turned AS (SELECT *, order_id % 6 AS turn, CAST(unit_cents * quantity AS BIGINT) AS whole FROM placed)",
            body=f"""SELECT order_id, CASE WHEN turn < 3 THEN 'german' ELSE 'english' END AS rule_set, position, CASE WHEN turn IN (0, 3) THEN asin END AS asin,
 CASE WHEN turn IN (1, 4, 5) THEN CAST(quantity AS VARCHAR) || ' x ' || description ELSE description END AS description,
 CASE WHEN turn IN (0, 3) THEN 1 WHEN turn = 2 THEN NULL ELSE quantity END AS quantity, CASE WHEN turn = 3 THEN whole ELSE unit_cents END AS unit_cents,
 CASE WHEN turn IN (3, 4) THEN whole ELSE unit_cents END AS total_cents,
 CASE WHEN turn < 3 THEN replace({fixed("unit_cents")}, '.', ',') || ' €' WHEN turn = 5 THEN '$' || {fixed("unit_cents")} ELSE '$' || {fixed("whole")} END AS price
 FROM turned""",
        ),
        "extract_generic": with_(
            INVOICES,
            body="""SELECT order_id, 'generic' AS reader, subtotal_cents, shipping_cents, tax_cents, total_cents,
 ['GBP', 'GBP', 'EUR', 'USD'][order_id % 4 + 1] AS currency, item_count FROM invoices""",
        ),
        "extract_generic_items": with_(
            ITEMS,
            f"""placed AS (SELECT *, order_id % 4 AS turn, CAST(row_number() OVER (PARTITION BY order_id
  ORDER BY line_number, part_key, supplier_key, total_cents, ship_date) - 1 AS INTEGER) AS position FROM items)""",
            body=f"""SELECT order_id, position, CASE WHEN turn = 2 THEN description ELSE CAST(quantity AS VARCHAR) || ' x ' || description END AS description,
 CASE WHEN turn <> 2 THEN quantity END AS quantity, unit_cents,
 CAST(CASE WHEN turn IN (0, 3) THEN unit_cents * quantity ELSE unit_cents END AS BIGINT) AS total_cents,
 CASE turn WHEN 1 THEN '£' || {fixed("unit_cents")} WHEN 2 THEN replace({fixed("unit_cents")}, '.', ',') || ' €' ELSE '$' || {fixed("unit_cents")} END AS price FROM placed""",
        ),
        "repair_prices": with_(
            INVOICES,
            ITEMS,
            """placed AS (SELECT order_id, asin, description, quantity, unit_cents, CAST(unit_cents * quantity AS BIGINT) AS total_cents,
  CAST(row_number() OVER (PARTITION BY order_id ORDER BY line_number, part_key, supplier_key, items.total_cents, ship_date) - 1 AS INTEGER) AS position,
  CAST(floor(CAST(unit_cents AS DOUBLE) * 100 / 119 + 0.5) AS BIGINT) AS net, order_id % 3 = 0 AS merged FROM items),
 shown AS (SELECT *, CASE WHEN merged THEN CAST(CAST(quantity AS VARCHAR) || lpad(CAST(net AS VARCHAR), CAST(greatest(length(CAST(net AS VARCHAR)), 3) AS INTEGER), '0') AS BIGINT) ELSE net END AS front
  FROM placed),
 judged AS (SELECT *, bool_or(merged AND quantity > 1) OVER (PARTITION BY order_id) AS broken,
  greatest(front, unit_cents, total_cents) > 200000 OR front > unit_cents * 3 AS suspicious FROM shown)""",
            body="""SELECT order_id, position, asin, description, quantity, unit_cents, total_cents, CASE WHEN broken THEN 'repaired' ELSE 'read' END AS balance,
 CASE WHEN merged AND broken AND (quantity > 1 OR suspicious) THEN 'quantity split' WHEN merged AND NOT broken AND suspicious THEN 'merged' END AS repair,
 CAST(front AS VARCHAR) || ',' || CAST(unit_cents AS VARCHAR) || ',' || CAST(total_cents AS VARCHAR) AS printed FROM judged""",
        ),
    }


def all_sql() -> dict[str, str]:
    return {**report_sql(), **job_sql(), **quality_sql(), **compare_sql(), **text_sql()}
