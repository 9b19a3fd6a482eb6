"""Daily three-way reconciliation: ledger, cash closings and card acquirer, in integer cents.

ledger: date, seller, cents · acquirer: seq, date, status, modality, cents · closings: company, date,
pix_cents, cash_cents, store_total_cents.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses and modalities of acquirer exports.
APPROVED, CARD = ("aprovada", "aprovado"), ("credito", "debito")
PAID, PIX = ("pago", "paga"), "pix"
EXCEPTIONS = ("negada", "negado", "expirada", "expirado", "devolvida", "devolvido", "cancelada", "cancelado")


def in_period(start: date, end: date, column: str = "date") -> Column:
    return F.col(column).between(F.lit(start), F.lit(end))


def ledger_by_day(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("date").agg(F.sum("cents").alias("ledger_cents"))


def approved_card() -> Column:
    return F.col("status").isin(*APPROVED) & F.col("modality").isin(*CARD)


def paid_pix() -> Column:
    return F.col("status").isin(*PAID) & (F.col("modality") == PIX)


def acquirer_by_day(acquirer: DataFrame) -> DataFrame:
    """Approved card and paid PIX of every day with any transaction; one pass, partial sums before the shuffle."""
    zero = F.lit(0).cast("bigint")
    card, pix = (F.coalesce(F.sum(F.when(such, F.col("cents"))), zero) for such in (approved_card(), paid_pix()))
    return acquirer.groupBy("date").agg(card.alias("acquirer_cents"), pix.alias("acquirer_pix_cents"))


def of_company(closings: DataFrame, company: str) -> DataFrame:
    """One closing a date of the company: the first by seq (where there is none, the least by its amounts)."""
    fields = [c for c in closings.columns if c not in ("company", "date")]
    order = F.struct(*(["seq"] if "seq" in fields else []), *[c for c in fields if c != "seq"])
    first = closings.filter(F.col("company") == company).groupBy("date").agg(F.min_by(F.struct(*fields), order).alias("x"))
    return first.select(F.lit(company).alias("company"), "date", "x.*")


def daily(ledger: DataFrame, acquirer: DataFrame, closings: DataFrame, start: date, end: date, company: str) -> DataFrame:
    """One row a day with movement: status OK, DIVERGENT, or PENDING where the closing is missing (then nulls, never zero).

    Of the closings only the company's first of a date counts. The period is filtered below each aggregate: no filter
    passes a full outer join's merged key.
    """
    such = in_period(start, end)
    closings = of_company(closings.filter(such), company)
    books = ledger_by_day(ledger.filter(such))
    cards = acquirer_by_day(acquirer.filter(such)).withColumn("has_acquirer", F.lit(True))
    cash = closings.select("date", "pix_cents", "cash_cents", "store_total_cents", F.lit(True).alias("has_closing"))
    days = books.join(cards, "date", "full_outer").join(cash, "date", "full_outer")
    moved = (F.coalesce("ledger_cents", F.lit(0)) != 0) | F.col("has_acquirer") | (F.col("pix_cents") != 0) | (F.col("cash_cents") != 0) | (F.col("store_total_cents") != 0)
    zero = F.lit(0).cast("bigint")
    days = days.filter(moved).withColumns({"ledger_cents": F.coalesce("ledger_cents", zero), "acquirer_cents": F.coalesce("acquirer_cents", zero)})
    expected = F.when(F.col("has_closing"), F.col("ledger_cents") - F.col("pix_cents") - F.col("cash_cents"))
    days = days.withColumn("expected_card_cents", expected).withColumn("difference_cents", F.col("expected_card_cents") - F.col("acquirer_cents"))
    status = F.when(F.col("has_closing").isNull(), "PENDING").when(F.col("difference_cents") == 0, "OK").otherwise("DIVERGENT")
    return days.select("date", "ledger_cents", "pix_cents", "cash_cents", "expected_card_cents", "acquirer_cents", "difference_cents", status.alias("status"))


def gross_by_date(lines: DataFrame) -> DataFrame:
    """Gross amount times quantity by date, over ledger lines (date, gross_cents, quantity)."""
    return lines.groupBy("date").agg(F.sum(F.col("gross_cents") * F.coalesce("quantity", F.lit(1))).alias("gross_cents"))


def source_sets(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: how many records there are, and the distinct values of each column (not null, sorted).

    Sellers, branches, establishments and tax ids are dimensions of the business, few by nature; dates are days.
    """
    return rows.agg(F.count("*").alias("records"), *[F.array_sort(F.collect_set(c)).alias(c) for c in columns])


MEASURES = ("ledger_cents", "pix_cents", "cash_cents", "expected_card_cents", "acquirer_cents", "difference_cents")


def overall(status: str = "status") -> Column:
    c = F.col(status)
    return F.when(F.count_if(c == "PENDING") > 0, "PENDING").when(F.count_if(c == "DIVERGENT") > 0, "DIVERGENT").otherwise("OK")


def totals(days: DataFrame) -> DataFrame:
    """One row: sums that skip nulls (0 where there is nothing), days by status and the overall status."""
    sums = [F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in MEASURES]
    counts = [F.count_if(F.col("status") == s).alias(f"{s.lower()}_days") for s in ("OK", "DIVERGENT", "PENDING")]
    return days.agg(*sums, *counts, overall().alias("overall_status"))


def sellers_dense(ledger: DataFrame, days: DataFrame) -> DataFrame:
    """Every day with every seller of the ledger, 0 where there is none (date, seller, cents).

    The sellers are a dimension of the business, few by nature; the cross product is the answer's own size.
    """
    axis = days.select("date").distinct().crossJoin(ledger.select("seller").distinct())
    sums = ledger.groupBy("date", "seller").agg(F.sum("cents").alias("cents"))
    return axis.join(sums, ["date", "seller"], "left").select("date", "seller", F.coalesce("cents", F.lit(0).cast("bigint")).alias("cents"))


def sellers_wide(ledger: DataFrame, sellers: Sequence[str]) -> DataFrame:
    """A row a day and a column a seller; the sellers are given, so the pivot needs no pass of its own."""
    wide = ledger.groupBy("date").pivot("seller", list(sellers)).agg(F.sum("cents"))
    return wide.fillna(0, list(sellers))


def seller_totals(ledger: DataFrame) -> DataFrame:
    """Sums by seller and of all (seller TOTAL)."""
    sums = ledger.rollup("seller").agg(F.sum("cents").alias("cents"), F.count("*").alias("lines"), F.grouping("seller").alias("all"))
    return sums.select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("seller")).alias("seller"), "cents", "lines")


def exceptions(acquirer: DataFrame) -> DataFrame:
    """Denied, expired, returned and cancelled transactions, and a cancelled one for each that the merchant cancelled.

    acquirer also has cancelled (boolean) and cancelled_cents (null: the sale's amount).
    """
    own = F.when(F.col("status").isin(*EXCEPTIONS), F.struct("status", "cents"))
    flagged = F.col("cancelled") & ~F.col("status").isin("cancelada", "cancelado")
    made = F.when(flagged, F.struct(F.lit("cancelada").alias("status"), F.coalesce("cancelled_cents", "cents").alias("cents")))
    both = acquirer.select("seq", "date", "modality", F.explode(F.array_compact(F.array(own, made))).alias("x"))
    return both.select("seq", "date", "modality", "x.status", "x.cents")


def kept_closings(closings: DataFrame) -> DataFrame:
    """The first of the closings (by seq) of a company and date, with how many repeat it and how many contradict it."""
    key = F.struct("pix_cents", "cash_cents", "store_total_cents")
    grouped = closings.groupBy("company", "date").agg(F.min_by(F.struct("seq", "file_name", "pix_cents", "cash_cents", "store_total_cents"), "seq").alias("first"), F.count("*").alias("n"), F.count_distinct(key).alias("n_values"))
    return grouped.select("company", "date", "first.*", (F.col("n") - 1).alias("duplicates"), (F.col("n_values") > 1).alias("conflict"))


def closing_conflicts(closings: DataFrame) -> DataFrame:
    """Later closings that contradict the first of their company and date, beside it."""
    first = kept_closings(closings).filter("conflict").select("company", "date", F.col("seq").alias("first_seq"), F.col("file_name").alias("first_file"), *[F.col(c).alias(f"first_{c}") for c in ("pix_cents", "cash_cents", "store_total_cents")])
    both = closings.join(first, ["company", "date"]).filter("seq > first_seq")
    differs = F.struct("pix_cents", "cash_cents", "store_total_cents") != F.struct("first_pix_cents", "first_cash_cents", "first_store_total_cents")
    return both.filter(differs).select("company", "date", "first_file", "file_name", "pix_cents", "cash_cents", "store_total_cents")
