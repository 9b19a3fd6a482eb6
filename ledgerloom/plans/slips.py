"""Queries of slips and of the cross-check. Slips are derived from orders and their lines, with every kind of noise."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.checkpoints import stored
from ledgerloom.functions.codes import code_distance, control_matches
from ledgerloom.operators import match, slips
from ledgerloom.plans import crosscheck_sql
from ledgerloom.plans.bindings import for_duckdb, view

START, END = date(1995, 1, 1), date(2001, 12, 31)


def raw(spark: SparkSession, d: str) -> DataFrame:
    # Reading a slip costs more than moving it, and what is small in bytes would be joined into one partition.
    return view(spark, d, "b_slip").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq")


def typed(spark: SparkSession, d: str, *only: str) -> DataFrame:
    return slips.typed(raw(spark, d), START, END, *only)


def text_of(pieces: str) -> F.Column:
    return F.array_join(F.transform(pieces, lambda x: F.concat_ws(":", x["code"], x["value_cents"].cast("string"))), ",")


def slip_typed(spark: SparkSession, d: str) -> DataFrame:
    rows = typed(spark, d)
    return rows.select("seq", "image_id", "number", "control_no", "seller", "sub_total_cents", "discount_cents", "total_cents", "piece_count", "payment_method", "items_uncertain", text_of("items").alias("items"), text_of("returns").alias("returns"), F.array_join("flags", ",").alias("flags"))


def slip_checks(spark: SparkSession, d: str) -> DataFrame:
    undated = typed(spark, d).select("seq", F.filter("checks", lambda c: ~F.startswith(c, F.lit("the slip says")) & ~F.startswith(c, F.lit("the date "))).alias("checks"))
    return undated.select("seq", F.size("checks").cast("bigint").alias("n_checks"), F.array_join("checks", " | ").alias("checks"))


def slip_discount_percent(spark: SparkSession, d: str) -> DataFrame:
    rows = slips.parsed(raw(spark, d)).filter(slips.is_percent(F.col("p.desconto"))).select("seq", F.col("p.desconto").alias("written"))
    return rows.join(typed(spark, d).select("seq", "sub_total_cents", "discount_cents"), "seq")


def slip_self_consistent(spark: SparkSession, d: str) -> DataFrame:
    return typed(spark, d).select("seq", slips.self_consistent(F.col("items"), F.col("returns"), F.col("sub_total_cents"), F.col("discount_cents"), F.col("total_cents")).alias("consistent"))


def slip_dates(spark: SparkSession, d: str) -> DataFrame:
    return typed(spark, d).select("seq", "date", "date_source")


def slip_date_outliers(spark: SparkSession, d: str) -> DataFrame:
    return slips.suspect_dates(typed(spark, d, "seq", "source_file", "date", "date_source")).select("seq", "source_file", "date")


def slip_daily_by_seller(spark: SparkSession, d: str) -> DataFrame:
    return slips.daily_by_seller(typed(spark, d))


def slip_review_queue(spark: SparkSession, d: str) -> DataFrame:
    return slips.review_queue(typed(spark, d)).select("seq", "image_id")


def slip_overlay(spark: SparkSession, d: str) -> DataFrame:
    edits = view(spark, d, "b_edit")
    return slips.typed(slips.overlay(raw(spark, d), edits), START, END).select("seq", "number", "date", "date_source", "total_cents", "piece_count")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "b_ledger")


def sales_grouped(spark: SparkSession, d: str) -> DataFrame:
    return match.sales(ledger(spark, d)).select("date", "sale_number", "seller", F.size("pieces").cast("bigint").alias("pieces"), F.array_join(F.transform("pieces", lambda p: p["code"]), ",").alias("codes"))


def sale_net_gross(spark: SparkSession, d: str) -> DataFrame:
    return match.sales(ledger(spark, d)).select("date", "sale_number", "gross_cents", "net_cents")


def pieces_expanded(spark: SparkSession, d: str) -> DataFrame:
    return match.line_pieces(ledger(spark, d)).select("date", "sale_number", "seq", "copy", "code", "value_cents", "is_return", "paid_cents")


def code_distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "b_code_pair")
    return rows.select("k", "a", "b", code_distance(F.col("a"), F.col("b")).cast("bigint").alias("distance"))


def control_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "b_control")
    return rows.select("k", control_matches(F.col("control_no"), F.col("sale_number")).alias("matches"))


def piece_match(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every slip against those of the sale that it was written for."""
    left, right = match.prepared(typed(spark, d, "seq", "date", "date_suspect", "items", "returns").withColumn("sale_number", (F.col("seq")).cast("string")), ledger(spark, d), START, END)
    both = left.select("slip", "sale_number", "slip_pieces").join(right.select("sale_number", "sale_pieces"), "sale_number")
    both = match.dealt(both, "slip")
    return match.with_piece_match(both).select("slip", F.posexplode("matched").alias("place", "x")).select("slip", F.col("place").cast("bigint").alias("place"), F.col("x.distance").cast("bigint").alias("distance"), F.col("x.side").cast("bigint").alias("side"), F.col("x.bi").cast("bigint").alias("bi"), F.col("x.ci").cast("bigint").alias("ci"))


#: What pairing looks at, and what discrepancies and days tell besides.
PAIRED = ("seq", "source_file", "date", "date_source", "date_suspect", "control_no", "total_cents", "items", "returns")
TOLD = (*PAIRED, "image_id", "number", "seller", "sub_total_cents", "discount_cents", "items_uncertain", "checks", "unreadable_fields")


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    return crosscheck(spark, d).day_scores


def crosscheck(spark: SparkSession, d: str, columns: tuple[str, ...] = PAIRED) -> match.Crosscheck:
    rows = slips.date_outliers(stored(typed(spark, d, *columns)), stored)
    return match.Crosscheck(view(spark, d, "b_booked"), rows, START, END, stored, is_stored=True)


def day_assignment(spark: SparkSession, d: str) -> DataFrame:
    return crosscheck(spark, d).day_pairs


def total_only_match(spark: SparkSession, d: str) -> DataFrame:
    return crosscheck(spark, d).total_pairs


def other_day_match(spark: SparkSession, d: str) -> DataFrame:
    return crosscheck(spark, d).other_pairs


def discrepancies(spark: SparkSession, d: str) -> DataFrame:
    return crosscheck(spark, d, TOLD).discrepancies()


def crosscheck_days(spark: SparkSession, d: str) -> DataFrame:
    return crosscheck(spark, d, TOLD).kept_days()


def crosscheck_totals(spark: SparkSession, d: str) -> DataFrame:
    return crosscheck(spark, d, TOLD).totals()


def discrepancy_kinds(spark: SparkSession, d: str) -> DataFrame:
    return crosscheck(spark, d, TOLD).discrepancies().groupBy("kind").agg(F.count("*").alias("n"), F.sum("impact_cents").alias("impact_cents"))


def unmatched_sales(spark: SparkSession, d: str) -> DataFrame:
    return crosscheck(spark, d).loose_sales.select("date", "sale_number", "net_cents")


def unmatched_slips(spark: SparkSession, d: str) -> DataFrame:
    return crosscheck(spark, d).loose_slips.select("date", "slip", "total_cents")


QUERIES = {
    f.__name__: f
    for f in (
        slip_typed, slip_checks, slip_discount_percent, slip_self_consistent, slip_dates, slip_date_outliers, slip_daily_by_seller, slip_review_queue, slip_overlay,
        sales_grouped, sale_net_gross, pieces_expanded, code_distance_pairs, control_suffix_match, piece_match, pair_scores, day_assignment, total_only_match, other_day_match,
        discrepancies, discrepancy_kinds, crosscheck_days, crosscheck_totals, unmatched_sales, unmatched_slips,
    )
}

# What the slips of b_slip say, computed from the views they are made of and not from their JSON.
CHECKS = """concat_ws(' | ',
    CASE WHEN n_items = 0 THEN 'no item was read' END, CASE WHEN total_cents IS NULL THEN 'TOTAL was not read' END,
    CASE WHEN n_items > 0 AND pieces <> n_items THEN 'PIECES says ' || pieces || ', but ' || n_items || ' items were read' END,
    CASE WHEN n_items > 0 AND items_cents <> sub_total_cents THEN 'sum of items (' || {items} || ') differs from SUB TOTAL (' || {sub} || ')' END,
    CASE WHEN abs(sub_total_cents - coalesce(discount_cents, 0) - total_cents) > CASE WHEN k % 20 = 9 THEN 1 ELSE 0 END
         THEN 'SUB TOTAL - DISCOUNT (' || {off} || ') differs from TOTAL (' || {total} || ')' END,
    CASE WHEN n_returns > 0 AND returns_cents <> discount_cents THEN 'sum of returns (' || {back} || ') differs from DISCOUNT (' || {disc} || ')' END)"""


def money(cents: str) -> str:
    """DuckDB SQL of a formatted amount of either sign."""
    return f"('R$ ' || CASE WHEN ({cents}) < 0 THEN '-' ELSE '' END || replace(format('{{:,}}', abs({cents}) // 100), ',', '.') || ',' || lpad(CAST(abs({cents}) % 100 AS VARCHAR), 2, '0'))"


CHECKS_SQL = CHECKS
for _name, _cents in (("items", "items_cents"), ("sub", "sub_total_cents"), ("off", "(sub_total_cents - coalesce(discount_cents, 0))"), ("total", "total_cents"), ("back", "returns_cents"), ("disc", "discount_cents")):
    CHECKS_SQL = CHECKS_SQL.replace("{" + _name + "}", money(_cents))

CONSISTENT = (
    "coalesce(abs(items_cents - returns_cents - coalesce(discount_cents, 0) - total_cents) <= 1 OR abs(items_cents - coalesce(discount_cents, 0) - total_cents) <= 1 "
    "OR abs(items_cents - returns_cents - total_cents) <= 1 OR abs(sub_total_cents - coalesce(discount_cents, 0) - total_cents) <= 1 "
    "OR abs(sub_total_cents - returns_cents - coalesce(discount_cents, 0) - total_cents) <= 1, false)"
)
SOURCE_DATE = "CASE WHEN k % 31 = 0 THEN date ELSE shown END"

ORACLE = {
    "slip_typed": for_duckdb(
        "SELECT k AS seq, 'scan ' || file || '.pdf#p1b' || k AS image_id, CAST(k AS VARCHAR) AS number, CASE WHEN k % 20 = 10 THEN NULL ELSE control END AS control_no, "
        "CASE WHEN k % 13 = 0 THEN NULL ELSE 'JOSE ' || seller END AS seller, sub_total_cents, discount_cents, total_cents, CAST(pieces AS INTEGER) AS piece_count, "
        "CASE k % 4 WHEN 0 THEN 'pix' WHEN 1 THEN 'credito' WHEN 2 THEN 'dinheiro' END AS payment_method, n_items = 0 OR pieces <> n_items AS items_uncertain, "
        "coalesce(items_text, '') AS items, coalesce(returns_text, '') AS returns, CASE WHEN k % 6 = 0 THEN 'brinde,whats' ELSE '' END AS flags FROM b_slip_fact"
    ),
    "slip_checks": for_duckdb(f"SELECT seq, CASE WHEN checks = '' THEN 0 ELSE 1 + len(string_split(checks, ' | ')) - 1 END AS n_checks, checks FROM (SELECT k AS seq, {CHECKS_SQL} AS checks FROM b_slip_fact)"),
    "slip_discount_percent": for_duckdb("SELECT k AS seq, '12,5%' AS written, sub_total_cents, discount_cents FROM b_slip_fact WHERE k % 20 = 9"),
    "slip_self_consistent": for_duckdb(f"SELECT k AS seq, {CONSISTENT} AS consistent FROM b_slip_fact"),
    "slip_dates": for_duckdb(f"SELECT k AS seq, {SOURCE_DATE} AS date, CASE WHEN k % 31 = 0 THEN 'file' ELSE 'slip' END AS date_source FROM b_slip_fact"),
    "slip_date_outliers": for_duckdb(
        f"SELECT seq, 'scan ' || file || '.pdf' AS source_file, date FROM (SELECT *, max(n) OVER (PARTITION BY file) AS top FROM (SELECT k AS seq, file, {SOURCE_DATE} AS date, count(*) OVER (PARTITION BY file, {SOURCE_DATE}) AS n FROM b_slip_fact WHERE k % 31 <> 0)) WHERE n = 1 AND top >= 3"
    ),
    "slip_daily_by_seller": for_duckdb(
        f"SELECT {SOURCE_DATE} AS date, CASE WHEN k % 13 = 0 THEN '(NO SELLER)' ELSE 'JOSE ' || seller END AS seller, CAST(sum(total_cents) AS BIGINT) AS cents FROM b_slip_fact WHERE total_cents IS NOT NULL GROUP BY ALL"
    ),
    "slip_review_queue": for_duckdb(f"SELECT k AS seq, 'scan ' || file || '.pdf#p1b' || k AS image_id FROM b_slip_fact WHERE {CHECKS_SQL} <> '' OR k % 19 = 0 OR (k % 31 = 0 AND k % 20 = 6)"),
    "slip_overlay": for_duckdb(
        f"SELECT k AS seq, CASE WHEN k % 10 = 3 THEN 'E' || k ELSE CAST(k AS VARCHAR) END AS number, {SOURCE_DATE} AS date, CASE WHEN k % 31 = 0 THEN 'file' ELSE 'slip' END AS date_source, "
        "CASE WHEN k % 10 = 3 THEN 12345 ELSE total_cents END AS total_cents, CAST(CASE WHEN k % 10 = 3 THEN 2 ELSE pieces END AS INTEGER) AS piece_count FROM b_slip_fact"
    ),
    "sales_grouped": for_duckdb(
        "SELECT date, sale_number, arg_min(seller, seq) AS seller, count(*) AS pieces, string_agg(code, ',' ORDER BY seq) AS codes FROM (SELECT *, unnest(range(greatest(1, quantity))) AS n FROM b_ledger) GROUP BY date, sale_number"
    ),
    "sale_net_gross": for_duckdb(
        "SELECT date, sale_number, CAST(sum(gross_cents * quantity) AS BIGINT) AS gross_cents, CAST(sum(sign(gross_cents) * abs(coalesce(net_cents, gross_cents)) * quantity) AS BIGINT) AS net_cents FROM b_ledger GROUP BY date, sale_number"
    ),
    "pieces_expanded": for_duckdb(
        "SELECT date, sale_number, seq, CAST(unnest(range(1, quantity + 1)) AS INTEGER) AS copy, code, abs(gross_cents) AS value_cents, gross_cents < 0 AS is_return, abs(net_cents) AS paid_cents FROM b_ledger"
    ),
    # The pairs differ by one digit, by a swap of neighbours, by both far apart, or not at all, so that the distance is known.
    "code_distance_pairs": for_duckdb("SELECT k, a, b, CAST(CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN substr(a, 4, 1) = substr(a, 5, 1) THEN 0 ELSE 1 END ELSE 2 END AS BIGINT) AS distance FROM b_code_pair"),
    "control_suffix_match": for_duckdb(
        "SELECT k, (length(c) >= 2 AND suffix(sale_number, c)) OR (length(ltrim(c, '0')) >= 2 AND suffix(sale_number, ltrim(c, '0'))) OR (length(substr(c, 1, 3)) >= 2 AND suffix(sale_number, substr(c, 1, 3))) "
        "OR (length(ltrim(substr(c, 1, 3), '0')) >= 2 AND suffix(sale_number, ltrim(substr(c, 1, 3), '0'))) AS matches FROM (SELECT *, regexp_replace(control_no, '[^0-9]', '', 'g') AS c FROM b_control)"
    ),
}


NEEDED = "(SELECT 1 FROM b_slip_fact, b_slip_piece, b_booked)"
PAIRS = crosscheck_sql.pair_ctes(SOURCE_DATE, START, END)
FOUND = f"{PAIRS}, {crosscheck_sql.found_ctes()}"
DAYS = f"{FOUND}, {crosscheck_sql.day_ctes(CONSISTENT, f"{CHECKS_SQL} <> '' OR k % 19 = 0 OR (k % 31 = 0 AND k % 20 = 6)")}"


def on_pairs(ctes: str, select: str) -> str:
    """DuckDB SQL over the views and the phases of the cross-check."""
    sql = for_duckdb(f"SELECT 1 FROM {NEEDED}")
    return f"{sql[: sql.rindex('SELECT 1 FROM (SELECT 1')].rstrip()}, {ctes} {select}"


COUNTED = ("slips", "sales", "matched_sales", "sales_without_slip", "slips_without_sale", "piece_divergences", "reading_notes", "slip_value_cents", "ledger_value_cents", "difference_cents")
KEPT = "(slips > excluded_slips OR sales > 0)"
ORACLE |= {
    "piece_match": on_pairs(
        f"{crosscheck_sql.sources(SOURCE_DATE, START, END).replace('b_booked', 'b_ledger').replace('WHERE NOT suspect', '')}, own AS (SELECT slip, slip AS sale FROM sl WHERE slip IN (SELECT sale FROM sales)), {crosscheck_sql.piece_match('0', 'own')}",
        "SELECT slip, place, CAST(d AS BIGINT) AS distance, CAST(side AS BIGINT) AS side, CAST(bi AS BIGINT) AS bi, CAST(ci AS BIGINT) AS ci FROM matched0",
    ),
    "pair_scores": on_pairs(PAIRS, f"SELECT slip, date AS slip_date, sale_date AS date, number AS sale_number, score FROM score1 JOIN sl USING (slip) JOIN sales USING (sale) WHERE score >= {crosscheck_sql.MIN_SCORE}"),
    "day_assignment": on_pairs(PAIRS, "SELECT slip, sale_date AS date, number AS sale_number FROM day_pairs JOIN sales USING (sale)"),
    "total_only_match": on_pairs(PAIRS, "SELECT sale_date AS date, slip, number AS sale_number FROM total_pairs JOIN sales USING (sale)"),
    "other_day_match": on_pairs(PAIRS, "SELECT slip, date AS slip_date, sale_date AS date, number AS sale_number, score FROM other_pairs JOIN sl USING (slip) JOIN sales USING (sale)"),
    "unmatched_sales": on_pairs(PAIRS, "SELECT sale_date AS date, number AS sale_number, net AS net_cents FROM loose_sales"),
    "unmatched_slips": on_pairs(PAIRS, "SELECT date, slip, total AS total_cents FROM loose_slips"),
    "discrepancies": on_pairs(FOUND, "SELECT * FROM found"),
    "discrepancy_kinds": on_pairs(FOUND, "SELECT kind, count(*) AS n, CAST(sum(impact_cents) AS BIGINT) AS impact_cents FROM found GROUP BY kind"),
    "crosscheck_days": on_pairs(DAYS, f"SELECT * FROM days WHERE {KEPT}"),
    "crosscheck_totals": on_pairs(
        DAYS,
        "SELECT " + ", ".join(f"CAST(coalesce(sum({c}) FILTER ({KEPT}), 0) AS BIGINT) AS {c}" for c in COUNTED) + ", CAST(coalesce(sum(excluded_slips), 0) AS BIGINT) AS excluded_slips, "
        + ", ".join(f"count(*) FILTER ({KEPT} AND status = '{x}') AS {x.lower()}_days" for x in ("OK", "DIVERGENT", "REVIEW", "NO_SLIP")) + " FROM days",
    ),
}
