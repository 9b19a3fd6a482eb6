"""What people see: labels, display tables, the editable grid, and the parts of the report on slips."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.codes import image_id
from ledgerloom.functions.dates import format_date
from ledgerloom.functions.money import format_cents, format_currency
from ledgerloom.operators.match import DIVERGENCES, NOTES

LABELS = {
    "SALE_WITHOUT_SLIP": "Sale in the ledger without a slip",
    "SLIP_WITHOUT_SALE": "Slip without a sale in the ledger",
    "PIECE_ONLY_SLIP": "Piece on the slip that the sale lacks",
    "PIECE_ONLY_LEDGER": "Piece of the sale that the slip lacks",
    "PIECE_VALUE": "Amount of a piece differs from the ledger",
    "CODE_MISREAD": "Code read otherwise than in the ledger",
    "READING_ONLY": "Difference of reading; the total of the slip closes",
    "OTHER_DAY": "Slip paired with a sale of another day",
    "TOTAL_MATCH": "Slip paired with the sale of the same total",
}


def kind_label(kind: Column) -> Column:
    """The label of a kind; an unknown kind is its own label."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, kind), kind)


def dash(value: Column) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("-"))


def money_or(cents: str, otherwise: str) -> Column:
    return F.when(F.col(cents).isNull(), otherwise).otherwise(format_cents(F.col(cents))).alias(cents)


def slip_table(slips_: DataFrame, review: Column) -> DataFrame:
    """Slips by file, page and place, as text."""
    paid = F.when((F.col("payment_method") == "credito") & (F.coalesce("installments", F.lit(0)) > 0), F.concat(F.lit("credito "), F.col("installments").cast("string"), F.lit("x"))).otherwise(dash(F.col("payment_method")))
    return ordered(slips_).select(
        F.concat("source_file", F.lit(" (p"), F.col("page").cast("string"), F.lit("/"), F.col("position").cast("string"), F.lit(")")).alias("file"), dash(F.col("number")).alias("number"),
        F.coalesce(format_date(F.col("date")), F.lit("not read")).alias("date"), dash(F.col("seller")).alias("seller"), dash(F.col("piece_count")).alias("pieces"), F.size("items").alias("items_read"),
        money_or("total_cents", "not read").alias("total"), paid.alias("payment"), F.when(review, "review").otherwise("OK").alias("check"),
    )


def ordered(slips_: DataFrame) -> DataFrame:
    """Slips as they lie in the files: by file, page and place."""
    return slips_.orderBy("source_file", "page", "position")


def crosscheck_table(days: DataFrame) -> DataFrame:
    """The days of the cross-check as text, ascending, a TOTAL row, and no column of excluded slips if there are none."""
    counts = ["slips", "excluded_slips", "sales", "matched_sales", "sales_without_slip", "slips_without_sale", "piece_divergences"]
    sums = ["ledger_value_cents", "difference_cents"]
    total = days.agg(F.lit(None).cast("date").alias("date"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*counts, *sums]], worst().alias("status"))
    if total.first().excluded_slips == 0:
        counts.remove("excluded_slips")
    every = days.select("date", *counts, *sums, "status").unionByName(total.select("date", *counts, *sums, "status"))
    return every.orderBy(F.col("date").asc_nulls_last()).select(F.coalesce(format_date(F.col("date")), F.lit("TOTAL")).alias("date"), *[F.col(c).cast("string").alias(c) for c in counts], *[format_cents(F.col(c)).alias(c) for c in sums], "status")


def worst(status: str = "status") -> Column:
    """The overall status of days: the first of these that any day has."""
    c = F.col(status)
    return F.when(F.count_if(c == "DIVERGENT") > 0, "DIVERGENT").when(F.count_if(c == "REVIEW") > 0, "REVIEW").when(F.count_if(c == "NO_SLIP") > 0, "NO_SLIP").otherwise("OK")


def discrepancy_table(found: DataFrame) -> DataFrame:
    """Discrepancies in order, as text."""
    impact = F.when(F.col("impact_cents") == 0, "-").otherwise(format_cents(F.col("impact_cents")))
    return found.orderBy("date", "section", "slip", "sale_number", "ordinal").select(
        format_date(F.col("date")).alias("date"), kind_label(F.col("kind")).alias("kind"), dash(F.col("sale_number")).alias("sale"), dash(F.coalesce("slip_number", "image_id")).alias("slip"),
        dash(F.col("seller")).alias("seller"), dash(F.col("code")).alias("code"), impact.alias("difference"), "detail",
    )


def daily_wide(days: DataFrame, wide: DataFrame, sellers: list[str]) -> DataFrame:
    """A row a day as text: the sellers' sums, then the reconciliation; what is missing is named."""
    rows = days.join(wide, "date", "left")
    return rows.orderBy("date").select(
        format_date(F.col("date")).alias("date"), *[format_cents(F.coalesce(F.col(f"`{s}`"), F.lit(0))).alias(s) for s in sellers], format_cents(F.col("ledger_cents")).alias("ledger_cents"), money_or("pix_cents", "not given"),
        money_or("cash_cents", "not given"), money_or("expected_card_cents", "not computed"), format_cents(F.col("acquirer_cents")).alias("acquirer_cents"), money_or("difference_cents", "not computed"), "status",
    )


def observation_table(days: DataFrame, observations: DataFrame) -> DataFrame:
    return days.select("date", "status").join(observations, "date", "left").orderBy("date").select(format_date(F.col("date")).alias("date"), "status", F.coalesce("observation", F.lit("")).alias("observation"))


def crosscheck_section(days: DataFrame, found: DataFrame) -> list[tuple[str, DataFrame]]:
    """Tables of the report on slips: days with totals, divergences, how many notes of each kind, and the notes that need words."""
    notes = found.filter(F.col("kind").isin(*NOTES)).groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").select(kind_label(F.col("kind")).alias("kind"), F.col("n").cast("string").alias("n"))
    detailed = [k for k in NOTES if k != "CODE_MISREAD"]
    return [
        ("Slips against the ledger", crosscheck_table(days)),
        ("Divergences", discrepancy_table(found.filter(F.col("kind").isin(*DIVERGENCES)))),
        ("Notes of reading (no divergence, not in the difference)", notes),
        ("Notes in detail", discrepancy_table(found.filter(F.col("kind").isin(*detailed))).drop("difference")),
    ]


def summary_table(totals: DataFrame, sellers: int) -> DataFrame:
    """Period totals as lines of a label and an amount, with how many days have which status."""
    money = [("ledger", "ledger_cents"), ("PIX of the closings", "pix_cents"), ("cash of the closings", "cash_cents"), ("expected by card", "expected_card_cents"), ("acquirer", "acquirer_cents"), ("difference", "difference_cents")]
    lines = [F.struct(F.lit(k).alias("what"), format_currency(F.col(c)).alias("value")) for k, c in money]
    lines += [F.struct(F.lit(f"days {s}").alias("what"), F.col(f"{s.lower()}_days").cast("string").alias("value")) for s in ("OK", "DIVERGENT", "PENDING")]
    lines += [F.struct(F.lit("sellers").alias("what"), F.lit(str(sellers)).alias("value")), F.struct(F.lit("overall status").alias("what"), F.col("overall_status").alias("value"))]
    return totals.select(F.explode(F.array(*lines)).alias("x")).select("x.*")


#: Fields of a slip's payload that the grid shows.
GRID = ("numero", "data", "vendedora", "cliente", "num_pecas", "sub_total", "desconto", "total", "pagamento", "bandeira")


def grid(raw: DataFrame) -> DataFrame:
    """Raw slips as rows to edit: image_id and the fields of GRID as trimmed text, blank where absent; num_pecas is an integer or null."""
    kinds = ", ".join(f"{f} string" for f in GRID)
    rows = raw.select(image_id(F.col("source_file"), F.col("page"), F.col("position")).alias("image_id"), F.from_json("payload", kinds).alias("p"))
    text = lambda f: F.coalesce(F.trim(F.col(f"p.{f}")), F.lit("")).alias(f)
    return rows.select("image_id", *[F.trim(F.col("p.num_pecas")).try_cast("double").cast("int").alias(f) if f == "num_pecas" else text(f) for f in GRID])


def duration_text(seconds: Column) -> Column:
    """1h05, 2 min 03 s, 9 s; null is still being computed."""
    s = F.floor(seconds).cast("bigint")
    minutes, hours = F.floor(s / 60).cast("bigint"), F.floor(s / 3600).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    short = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" min "), two(s % 60), F.lit(" s"))).otherwise(F.concat(s.cast("string"), F.lit(" s")))
    return F.when(s.isNull(), "computing").when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), two(minutes % 60))).otherwise(short)


def markdown_safe(text: Column) -> Column:
    """Text in which no character is taken for Markdown."""
    return F.regexp_replace(text, r"([\\$*_`])", r"\\$1")


def report_name(company: str, start: date, end: date, suffix: str = "pdf") -> str:
    """The name of a report's file, by company and period."""
    safe = "".join(c if c.isalnum() else "_" for c in company.lower())
    return f"reconciliation_{safe}_{start:%Y%m%d}_{end:%Y%m%d}.{suffix}"
