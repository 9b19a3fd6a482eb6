"""Queries of the daily reconciliation, its checks and its explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.codes import normalize_branch_code
from ledgerloom.operators import diagnose, reconcile, validate
from ledgerloom.plans.bindings import END, SELLERS, START, for_duckdb, view

PERIOD = f"BETWEEN DATE '{START}' AND DATE '{END}'"


def sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return view(spark, d, "b_ledger_day"), view(spark, d, "b_acquirer"), view(spark, d, "b_closing")


def daily_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.daily(*sources(spark, d), START, END, "A")


DAILY = f"""
    l AS (SELECT date, CAST(sum(cents) AS BIGINT) AS ledger_cents FROM b_ledger_day WHERE date {PERIOD} GROUP BY date),
    a AS (SELECT date, CAST(coalesce(sum(cents) FILTER (status IN ('aprovada', 'aprovado') AND modality IN ('credito', 'debito')), 0) AS BIGINT) AS acquirer_cents,
                 CAST(coalesce(sum(cents) FILTER (status IN ('pago', 'paga') AND modality = 'pix'), 0) AS BIGINT) AS acquirer_pix_cents
          FROM b_acquirer WHERE date {PERIOD} GROUP BY date),
    c AS (SELECT * FROM b_closing WHERE date {PERIOD}),
    days AS (
      SELECT coalesce(l.date, a.date, c.date) AS date, coalesce(ledger_cents, 0) AS ledger_cents, pix_cents, cash_cents,
             coalesce(ledger_cents, 0) - pix_cents - cash_cents AS expected_card_cents, coalesce(acquirer_cents, 0) AS acquirer_cents,
             coalesce(ledger_cents, 0) - pix_cents - cash_cents - coalesce(acquirer_cents, 0) AS difference_cents,
             CASE WHEN c.date IS NULL THEN 'PENDING' WHEN coalesce(ledger_cents, 0) - pix_cents - cash_cents = coalesce(acquirer_cents, 0) THEN 'OK' ELSE 'DIVERGENT' END AS status
      FROM l FULL JOIN a ON l.date = a.date FULL JOIN c ON c.date = coalesce(l.date, a.date)
      WHERE coalesce(ledger_cents, 0) <> 0 OR a.date IS NOT NULL OR pix_cents <> 0 OR cash_cents <> 0 OR store_total_cents <> 0)"""


def on_days(select: str) -> str:
    """DuckDB SQL over the views and the days of the reconciliation."""
    sql = for_duckdb(f"SELECT 1 FROM b_ledger_day, b_acquirer, b_closing, ({select})")
    views = sql[: sql.rindex("SELECT 1 FROM b_ledger_day")].rstrip()
    return f"{views}, {DAILY} {select}"


def reconciliation_totals(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.totals(daily_reconciliation(spark, d))


def seller_day_dense(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.sellers_dense(view(spark, d, "b_ledger_day"), daily_reconciliation(spark, d))


def seller_pivot(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.sellers_wide(view(spark, d, "b_ledger_day").filter(reconcile.in_period(START, END)), SELLERS)


def seller_totals_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.seller_totals(view(spark, d, "b_ledger_day"))


def acquirer_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.exceptions(view(spark, d, "b_acquirer"))


EXCEPTIONS = """
    x AS (SELECT seq, date, modality, status, cents FROM b_acquirer WHERE status IN ('negada', 'negado', 'expirada', 'expirado', 'devolvida', 'devolvido', 'cancelada', 'cancelado')
          UNION ALL SELECT seq, date, modality, 'cancelada', coalesce(cancelled_cents, cents) FROM b_acquirer WHERE cancelled AND status NOT IN ('cancelada', 'cancelado'))"""


def closing_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.kept_closings(view(spark, d, "b_closing_file")).select("company", "date", "file_name", "pix_cents", "cash_cents", "store_total_cents", "duplicates", "conflict")


def closing_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.closing_conflicts(view(spark, d, "b_closing_file"))


def date_presence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return validate.date_gaps(validate.presence(*sources(spark, d), START, END))


def missing_closings(spark: SparkSession, d: str) -> DataFrame:
    return validate.missing_closings(validate.presence(*sources(spark, d), START, END))


def out_of_period(spark: SparkSession, d: str) -> DataFrame:
    return validate.out_of_period(*sources(spark, d), START, END)


def company_by_identifier(spark: SparkSession, d: str) -> DataFrame:
    codes = view(spark, d, "b_source_code").select("source", normalize_branch_code(F.col("raw")).alias("code"))
    found = validate.companies_by_code(codes, view(spark, d, "b_company"))
    return found.select("source", F.array_join("companies", ",").alias("companies"), F.array_join(F.array_except("companies", F.array(F.lit("North"))), ",").alias("others"))


def company_by_text(spark: SparkSession, d: str) -> DataFrame:
    found = validate.companies_by_text(view(spark, d, "b_source_text"), view(spark, d, "b_company"))
    return found.select("source", F.array_join("companies", ",").alias("companies"))


def exception_amount_match(spark: SparkSession, d: str) -> DataFrame:
    return diagnose.exception_matches(daily_reconciliation(spark, d), acquirer_exceptions(spark, d))


def adjacent_day_match(spark: SparkSession, d: str) -> DataFrame:
    return diagnose.adjacent_matches(daily_reconciliation(spark, d), view(spark, d, "b_acquirer"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    ledger, acquirer, closings = sources(spark, d)
    days = reconcile.daily(ledger, acquirer, closings, START, END, "A")
    return diagnose.observations(days, ledger, acquirer, reconcile.acquirer_by_day(acquirer), reconcile.exceptions(acquirer))


def currency(cents: str) -> str:
    """DuckDB SQL that formats cents of zero or more."""
    return f"('R$ ' || replace(format('{{:,}}', ({cents}) // 100), ',', '.') || ',' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0'))"


FIRST = """
    e AS (SELECT date, seq, status, cents FROM (
            SELECT x.date, x.seq, x.status, x.cents, row_number() OVER (PARTITION BY x.date ORDER BY x.seq) AS r
            FROM x JOIN days ON x.date = days.date AND days.status = 'DIVERGENT' AND x.cents = abs(days.difference_cents)) WHERE r = 1)"""
ADJACENT = """
    n AS (SELECT days.date, abs(days.difference_cents) AS cents, CAST(min(date_diff('day', days.date, b.date)) AS INTEGER) AS day_offset
          FROM days JOIN b_acquirer b ON days.status = 'DIVERGENT' AND b.cents = abs(days.difference_cents)
               AND (b.date = days.date - 1 OR b.date = days.date + 1) GROUP BY 1, 2)"""


def with_parts(parts: str, select: str) -> str:
    sql = on_days(select)
    return sql[: len(sql) - len(select)].rstrip() + f", {parts} {select}"


QUERIES = {
    f.__name__: f
    for f in (
        daily_reconciliation, reconciliation_totals, seller_pivot, seller_day_dense, seller_totals_rollup, acquirer_exceptions, closing_dedupe, closing_conflicts,
        date_presence_gaps, missing_closings, out_of_period, company_by_identifier, company_by_text, exception_amount_match, adjacent_day_match, observations,
    )
}

PRESENCE = f"""
    p AS (SELECT date, bool_or(s = 'ledger') AS in_ledger, bool_or(s = 'acquirer') AS in_acquirer, bool_or(s = 'closing') AS in_closing FROM (
        SELECT date, 'ledger' AS s FROM b_ledger_day UNION ALL SELECT date, 'acquirer' FROM b_acquirer UNION ALL SELECT date, 'closing' FROM b_closing)
        WHERE date {PERIOD} GROUP BY date)"""
MEASURES = ", ".join(f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}" for m in reconcile.MEASURES)
STATUS_WORD = "CASE e.status " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in diagnose.STATUS_WORDS.items()) + " ELSE e.status END"

ORACLE = {
    "daily_reconciliation": on_days("SELECT * FROM days"),
    "reconciliation_totals": on_days(
        f"SELECT {MEASURES}, count(*) FILTER (status = 'OK') AS ok_days, count(*) FILTER (status = 'DIVERGENT') AS divergent_days, count(*) FILTER (status = 'PENDING') AS pending_days, "
        "CASE WHEN count(*) FILTER (status = 'PENDING') > 0 THEN 'PENDING' WHEN count(*) FILTER (status = 'DIVERGENT') > 0 THEN 'DIVERGENT' ELSE 'OK' END AS overall_status FROM days"
    ),
    "seller_pivot": for_duckdb("SELECT date, " + ", ".join(f"CAST(coalesce(sum(cents) FILTER (seller = '{s}'), 0) AS BIGINT) AS \"{s}\"" for s in SELLERS) + f" FROM b_ledger_day WHERE date {PERIOD} GROUP BY date"),
    "seller_day_dense": on_days(
        "SELECT days.date, s.seller, coalesce(g.cents, 0) AS cents FROM days CROSS JOIN (SELECT DISTINCT seller FROM b_ledger_day) s "
        "LEFT JOIN (SELECT date, seller, CAST(sum(cents) AS BIGINT) AS cents FROM b_ledger_day GROUP BY ALL) g ON g.date = days.date AND g.seller = s.seller"
    ),
    "seller_totals_rollup": for_duckdb("SELECT coalesce(seller, 'TOTAL') AS seller, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS lines FROM b_ledger_day GROUP BY ROLLUP (seller)"),
    "acquirer_exceptions": for_duckdb(f"SELECT * FROM (WITH {EXCEPTIONS} SELECT * FROM x)"),
    "closing_dedupe": for_duckdb(
        "SELECT company, date, arg_min(file_name, seq) AS file_name, arg_min(pix_cents, seq) AS pix_cents, arg_min(cash_cents, seq) AS cash_cents, arg_min(store_total_cents, seq) AS store_total_cents, "
        "count(*) - 1 AS duplicates, count(DISTINCT (pix_cents, cash_cents, store_total_cents)) > 1 AS conflict FROM b_closing_file GROUP BY company, date"
    ),
    "closing_conflicts": for_duckdb(
        "SELECT l.company, l.date, f.file_name AS first_file, l.file_name, l.pix_cents, l.cash_cents, l.store_total_cents FROM b_closing_file l JOIN b_closing_file f "
        "ON l.company = f.company AND l.date = f.date AND f.seq = 0 AND l.seq > 0 AND (l.pix_cents, l.cash_cents, l.store_total_cents) <> (f.pix_cents, f.cash_cents, f.store_total_cents)"
    ),
    "date_presence_gaps": for_duckdb(
        f"SELECT present_in, absent_in, date FROM (WITH {PRESENCE} "
        + " UNION ALL ".join(f"SELECT '{a}' AS present_in, '{b}' AS absent_in, date FROM p WHERE in_{a} AND NOT in_{b}" for a in ("ledger", "acquirer", "closing") for b in ("ledger", "acquirer", "closing") if a != b)
        + ")"
    ),
    "missing_closings": for_duckdb(f"SELECT date FROM (WITH {PRESENCE} SELECT date FROM p WHERE (in_ledger OR in_acquirer) AND NOT in_closing)"),
    "out_of_period": for_duckdb(
        "SELECT source, count(*) AS n_dates, string_agg(strftime(date, '%d/%m/%Y'), ', ' ORDER BY date) AS dates FROM (SELECT DISTINCT source, date FROM ("
        "SELECT 'ledger' AS source, date FROM b_ledger_day UNION ALL SELECT 'acquirer', date FROM b_acquirer UNION ALL SELECT 'closing', date FROM b_closing) "
        f"WHERE NOT (date {PERIOD})) GROUP BY source"
    ),
    "company_by_identifier": for_duckdb(
        "SELECT source, string_agg(company, ',' ORDER BY company) AS companies, coalesce(string_agg(company, ',' ORDER BY company) FILTER (company <> 'North'), '') AS others FROM ("
        "SELECT DISTINCT source, company FROM b_source_code JOIN b_company ON lpad(regexp_replace(raw, '[^0-9]', '', 'g'), 5, '0') = code) GROUP BY source"
    ),
    "company_by_text": for_duckdb(
        "SELECT source, string_agg(company, ',' ORDER BY company) AS companies FROM (SELECT DISTINCT source, company FROM b_source_text JOIN b_company "
        "ON contains(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'), regexp_replace(lower(strip_accents(alias)), '\\s+', ' ', 'g'))) GROUP BY source"
    ),
    "exception_amount_match": with_parts(f"{EXCEPTIONS}, {FIRST}", "SELECT date, seq, status, cents FROM e"),
    "adjacent_day_match": with_parts(ADJACENT, "SELECT date, cents, day_offset FROM n"),
    "observations": with_parts(
        f"{EXCEPTIONS}, {FIRST}, {ADJACENT}",
        f"""SELECT days.date, CASE days.status WHEN 'PENDING' THEN 'No cash closing was sent for this date. Ask for it.' WHEN 'OK' THEN '' ELSE
              coalesce(nullif(concat_ws(' ',
                CASE WHEN days.date NOT IN (SELECT date FROM b_ledger_day) THEN 'No ledger movement on this date.' END,
                CASE WHEN days.date NOT IN (SELECT date FROM b_acquirer) THEN 'No acquirer transactions on this date.' END,
                CASE WHEN days.pix_cents <> coalesce(a.acquirer_pix_cents, 0) THEN 'PIX of the cash closing is ' || {currency('abs(days.pix_cents - coalesce(a.acquirer_pix_cents, 0))')}
                     || CASE WHEN days.pix_cents > coalesce(a.acquirer_pix_cents, 0) THEN ' above' ELSE ' below' END || ' the paid PIX of the acquirer.' END,
                CASE WHEN e.date IS NOT NULL THEN 'A ' || {STATUS_WORD} || ' transaction of ' || {currency('e.cents')} || ' equals the difference of the day.' END,
                CASE WHEN n.date IS NOT NULL THEN 'A transaction of ' || {currency('abs(days.difference_cents)')} || ' on the day ' || CASE WHEN n.day_offset < 0 THEN 'before' ELSE 'after' END || ' equals the difference.' END), ''),
              'The cause could not be found automatically. Check the slips and transactions of the day.') END AS observation
            FROM days LEFT JOIN a ON a.date = days.date LEFT JOIN e ON e.date = days.date LEFT JOIN n ON n.date = days.date""",
    ),
}
