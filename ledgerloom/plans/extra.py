"""Queries of company closings, validation, progress, messages, the grid and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.checkpoints import shared_folder
from ledgerloom.functions.codes import code_distance
from ledgerloom.operators import job, reconcile, report, shown, validate
from ledgerloom.plans.bindings import END, START, amount, for_duckdb, view, written
from ledgerloom.plans.crosscheck_sql import distances
from ledgerloom.plans.reconciliation import PERIOD, PRESENCE
from ledgerloom.sources import slips
from ledgerloom.streaming import ingest, reading


def closings_of_company(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.of_company(view(spark, d, "b_closing_file"), "A").select("date", "file_name", "pix_cents", "cash_cents", "store_total_cents")


def gross_by_date(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.gross_by_date(view(spark, d, "b_ledger"))


def source_sets(spark: SparkSession, d: str) -> DataFrame:
    found = reconcile.source_sets(view(spark, d, "b_acquirer"), "status", "modality")
    return found.select("records", F.array_join("status", ",").alias("statuses"), F.array_join("modality", ",").alias("modalities"))


def validation_findings(spark: SparkSession, d: str) -> DataFrame:
    found = validate.findings(view(spark, d, "b_ledger_day"), view(spark, d, "b_acquirer"), view(spark, d, "b_closing_two"), START, END, "A")
    return found.select("severity", "code", "detail", F.size("dates").cast("bigint").alias("n_dates"), F.array_min("dates").alias("first_date"))


def message_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return validate.distinct_in_order(view(spark, d, "b_retry"), "message", "k")


def hint_cap(spark: SparkSession, d: str) -> DataFrame:
    return job.within_cap(view(spark, d, "b_hint"), "source", "row_no", "n", 100)


def job_progress(spark: SparkSession, d: str) -> DataFrame:
    found = job.progress(view(spark, d, "b_job"))
    return found.select("job", "estimated_total", F.floor(F.col("progress") * 1000).cast("bigint").alias("per_mille"), shown.duration_text(F.col("seconds")).alias("left"))


def markdown_text(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "b_money").select("k", shown.markdown_safe(F.concat(F.lit("*"), "written", F.lit("_$"))).alias("safe"))


def slip_grid(spark: SparkSession, d: str) -> DataFrame:
    return shown.grid(view(spark, d, "b_slip"))


def code_distance_any(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "b_code_any").select("k", "a", "b", code_distance(F.col("a"), F.col("b")).cast("bigint").alias("distance"))


def slip_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Response files, taken in by the stream: what the cache has of them when all are read."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    view(spark, d, "b_stream").repartition(8, "page").write.json(f"{at}/in")
    query = ingest.start(spark, f"{at}/in", f"{at}/cache", f"{at}/failures", f"{at}/state", "v1", files_at_once=3, name=f"read-{uuid.uuid4().hex[:8]}")
    query.awaitTermination()
    return slips.cached(spark, f"{at}/cache", "v1").select("hash", "page", "position", F.get_json_object("payload", "$.numero").alias("number"))


def slip_read_states(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every slot of b_stream when a client cannot read some, and is busy once, twice or always for others."""
    at = f"{shared_folder(spark)}/reading-{uuid.uuid4().hex}"
    view(spark, d, "b_stream").select(F.lit("slot").alias("kind"), "hash", "page", "position").write.json(f"{at}/events/slots")
    digit = F.col("page") % 10
    bad, busy = F.col("page") % 7 == 3, (digit == 0) | (digit <= 2) & (F.col("attempt") <= digit)

    def ask(asked: DataFrame) -> DataFrame:
        error = F.when(bad, "unreadable").when(busy, "busy")
        return asked.select("*", error.alias("error"), (~bad).alias("retryable"), F.when(error.isNull(), F.concat(F.lit("read "), "page")).alias("body"))

    job = reading.start(spark, f"{at}/events", ask, f"{at}/results", f"{at}/state", lanes=8, in_flight=1000, tries=3, pause_ms=100)
    if not job.settle(3600):
        raise TimeoutError(f"{job.open()} slots are not settled")
    return reading.settled(spark, f"{at}/results")


def report_pages(spark: SparkSession, d: str) -> DataFrame:
    """All ledger lines as pages of a report."""
    rows = view(spark, d, "b_ledger").orderBy("seq")
    table = rows.select(F.col("sale_number").alias("sale"), "code", "product", F.col("gross_cents").alias("cents"))
    return report.paged(report.wrapped(report.laid_out(table), wide=24), per_page=50)


QUERIES = {
    f.__name__: f
    for f in (report_pages, closings_of_company, gross_by_date, source_sets, validation_findings, message_dedupe, hint_cap, job_progress, markdown_text, slip_grid, code_distance_any, slip_stream_ingest, slip_read_states)
}

NAMES = ("ledger", "acquirer", "closing")

ORACLE = {
    # Columns as wide as their widest cell, lines of 24 characters, the rest of a line on the next; 50 lines a page.
    "report_pages": for_duckdb(
        "SELECT (n // 50) + 1 AS page, n % 50 + 1 AS line, text FROM (SELECT row_number() OVER (ORDER BY seq, k) - 1 AS n, substr(text, CAST(24 * k + 1 AS BIGINT), 24) AS text FROM ("
        "SELECT seq, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 24) AS BIGINT)))) AS k FROM ("
        "SELECT seq, rtrim(rpad(sale, CAST(w1 AS INTEGER), ' ') || '  ' || rpad(code, CAST(w2 AS INTEGER), ' ') || '  ' || rpad(product, CAST(w3 AS INTEGER), ' ') || '  ' || rpad(cents, CAST(w4 AS INTEGER), ' ')) AS text FROM ("
        "SELECT *, max(length(sale)) OVER () AS w1, max(length(code)) OVER () AS w2, max(length(product)) OVER () AS w3, max(length(cents)) OVER () AS w4 FROM ("
        "SELECT seq, sale_number AS sale, code, product, CAST(gross_cents AS VARCHAR) AS cents FROM b_ledger UNION ALL SELECT -1, 'sale', 'code', 'product', 'cents')))))"
    ),
    "closings_of_company": for_duckdb("SELECT date, file_name, pix_cents, cash_cents, store_total_cents FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY seq) AS r FROM b_closing_file WHERE company = 'A') WHERE r = 1"),
    "gross_by_date": for_duckdb("SELECT date, CAST(sum(gross_cents * quantity) AS BIGINT) AS gross_cents FROM b_ledger GROUP BY date"),
    "source_sets": for_duckdb("SELECT count(*) AS records, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, string_agg(DISTINCT modality, ',' ORDER BY modality) AS modalities FROM b_acquirer"),
    "validation_findings": for_duckdb(
        f"SELECT severity, code, detail, n_dates, first_date FROM (WITH c2 AS (SELECT * FROM b_closing_two), {PRESENCE}, "
        "g AS (" + " UNION ALL ".join(f"SELECT '{a}/{b}' AS detail, date FROM p WHERE in_{a} AND NOT in_{b}" for a in NAMES for b in NAMES if a != b) + "), "
        "o AS (SELECT DISTINCT s AS detail, date FROM (SELECT date, 'ledger' AS s FROM b_ledger_day UNION ALL SELECT date, 'acquirer' FROM b_acquirer UNION ALL SELECT date, 'closing' FROM c2 WHERE company = 'A') "
        f"WHERE NOT (date {PERIOD})) "
        "SELECT 'WARNING' AS severity, 'DATE_GAP' AS code, detail, count(*) AS n_dates, min(date) AS first_date FROM g GROUP BY detail "
        "UNION ALL SELECT 'WARNING', 'MISSING_CLOSING', 'closing', count(*), min(date) FROM p WHERE (in_ledger OR in_acquirer) AND NOT in_closing HAVING count(*) > 0 "
        "UNION ALL SELECT 'WARNING', 'OUT_OF_PERIOD', detail, count(*), min(date) FROM o GROUP BY detail "
        "UNION ALL SELECT 'ERROR', 'OTHER_COMPANY', string_agg(DISTINCT company, ', ' ORDER BY company), 0, NULL FROM c2 WHERE company <> 'A' HAVING count(*) > 0 "
        "UNION ALL SELECT 'ERROR', 'MIXED_COMPANIES', string_agg(DISTINCT company, ', ' ORDER BY company), 0, NULL FROM c2 HAVING count(DISTINCT company) > 1)"
    ),
    "message_dedupe": for_duckdb("SELECT message, min(k) AS k FROM b_retry GROUP BY message"),
    "hint_cap": for_duckdb("SELECT source, row_no, n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b_hint) WHERE before < 100"),
    "job_progress": for_duckdb(
        "SELECT job, estimated_total, CAST(floor(1000 * CASE WHEN finished THEN 1.0::DOUBLE ELSE least(0.99::DOUBLE, (done + failed)::DOUBLE / greatest(estimated_total, done + failed, 1)) END) AS BIGINT) AS per_mille, "
        "CASE WHEN seconds >= 3600 THEN (seconds // 3600) || 'h' || lpad(CAST(seconds // 60 % 60 AS VARCHAR), 2, '0') WHEN seconds >= 60 THEN (seconds // 60) || ' min ' || lpad(CAST(seconds % 60 AS VARCHAR), 2, '0') || ' s' ELSE seconds || ' s' END AS left "
        "FROM (SELECT *, CAST(found + round_even(greatest(0, pages - pages_done) * CASE WHEN pages_done > 0 THEN found::DOUBLE / pages_done ELSE 2.4::DOUBLE END, 0) AS BIGINT) AS estimated_total FROM b_job)"
    ),
    "markdown_text": for_duckdb("SELECT k, replace(replace(replace('*' || written || '_$', '$', chr(92) || '$'), '*', chr(92) || '*'), '_', chr(92) || '_') AS safe FROM b_money"),
    "slip_grid": for_duckdb(
        f"SELECT 'scan ' || file || '.pdf#p1b' || k AS image_id, CAST(k AS VARCHAR) AS numero, {written()} AS data, CASE WHEN k % 13 = 0 THEN '' ELSE 'José  ' || seller END AS vendedora, '' AS cliente, CAST(pieces AS INTEGER) AS num_pecas, "
        f"{amount('sub_total_cents')} AS sub_total, CASE WHEN k % 20 = 9 THEN '12,5%' ELSE {amount('discount_cents')} END AS desconto, CASE WHEN total_cents IS NULL THEN '' ELSE {amount('total_cents')} END AS total, "
        "CASE k % 4 WHEN 0 THEN 'PIX' WHEN 1 THEN 'Cartão de Crédito' WHEN 2 THEN 'espécie' ELSE 'xyz' END AS pagamento, '' AS bandeira FROM b_slip_fact"
    ),
    "code_distance_any": for_duckdb(f"SELECT k, a, b, CAST(distance AS BIGINT) AS distance FROM b_code_any JOIN ({distances("(SELECT DISTINCT a, b FROM b_code_any)")}) USING (a, b)"),
    "slip_stream_ingest": for_duckdb("SELECT hash, page, position, CAST(page AS VARCHAR) AS number FROM b_stream JOIN b_orders ON page = k WHERE k % 5 < 3"),
    "slip_read_states": for_duckdb(
        "SELECT hash, page, position, CASE WHEN page % 7 = 3 OR page % 10 = 0 THEN 'failed' ELSE 'done' END AS status, "
        "CAST(CASE WHEN page % 7 = 3 THEN 1 WHEN page % 10 = 0 THEN 3 WHEN page % 10 <= 2 THEN page % 10 + 1 ELSE 1 END AS INTEGER) AS attempts, "
        "CASE WHEN page % 7 = 3 THEN 'unreadable' WHEN page % 10 = 0 THEN 'busy' END AS error, "
        "CASE WHEN page % 7 <> 3 AND page % 10 <> 0 THEN 'read ' || CAST(page AS VARCHAR) END AS body FROM b_stream"
    ),
}
