"""Evidence for the days that do not reconcile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import format_currency

#: How each exception status is told.
STATUS_WORDS = {"negada": "denied", "negado": "denied", "expirada": "expired", "expirado": "expired", "devolvida": "returned", "devolvido": "returned", "cancelada": "cancelled", "cancelado": "cancelled"}


def exception_matches(days: DataFrame, exceptions: DataFrame) -> DataFrame:
    """For each divergent day the first exception (by seq) of the amount of its difference: date, seq, status, cents."""
    open_ = days.filter("status = 'DIVERGENT'").select("date", F.abs("difference_cents").alias("cents"))
    found = exceptions.join(open_, ["date", "cents"])
    return found.groupBy("date").agg(F.min_by(F.struct("seq", "status", "cents"), "seq").alias("x")).select("date", "x.*")


def adjacent_matches(days: DataFrame, acquirer: DataFrame) -> DataFrame:
    """For each divergent day whether a transaction of its difference lies on the day before (-1), else after (1): date, day_offset, cents.

    The two offsets are exploded on the days' side, so the band join is an equality join.
    """
    open_ = days.filter("status = 'DIVERGENT'").select("date", F.abs("difference_cents").alias("cents"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("day_offset"))
    near = open_.withColumn("other", F.date_add("date", F.col("day_offset")))
    txn = acquirer.select(F.col("date").alias("other"), "cents")
    return near.join(txn, ["other", "cents"], "left_semi").groupBy("date", "cents").agg(F.min("day_offset").alias("day_offset"))


def pix_evidence(closing: Column, acquirer: Column) -> Column:
    delta = closing - acquirer
    side = F.when(delta > 0, "above").otherwise("below")
    return F.when(delta != 0, F.concat(F.lit("PIX of the cash closing is "), format_currency(F.abs(delta)), F.lit(" "), side, F.lit(" the paid PIX of the acquirer.")))


def status_word(status: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in STATUS_WORDS.items() for x in pair])
    return F.coalesce(F.element_at(words, status), status)


def observations(days: DataFrame, ledger: DataFrame, acquirer: DataFrame, by_day: DataFrame, exceptions: DataFrame) -> DataFrame:
    """date, observation: why a day is pending, empty where it is OK, else all evidence in a fixed order.

    by_day: acquirer_pix_cents by date (reconcile.acquirer_by_day).
    """
    rows = days.join(ledger.select("date").distinct().withColumn("in_ledger", F.lit(True)), "date", "left")
    rows = rows.join(by_day.select("date", "acquirer_pix_cents").withColumn("in_acquirer", F.lit(True)), "date", "left")
    rows = rows.join(exception_matches(days, exceptions).select("date", F.col("status").alias("x_status"), F.col("cents").alias("x_cents")), "date", "left")
    rows = rows.join(adjacent_matches(days, acquirer).select("date", "day_offset"), "date", "left")
    target = format_currency(F.abs("difference_cents"))
    evidence = F.array_compact(
        F.array(
            F.when(F.col("in_ledger").isNull(), "No ledger movement on this date."),
            F.when(F.col("in_acquirer").isNull(), "No acquirer transactions on this date."),
            pix_evidence(F.col("pix_cents"), F.coalesce("acquirer_pix_cents", F.lit(0))),
            F.when(F.col("x_status").isNotNull(), F.concat(F.lit("A "), status_word(F.col("x_status")), F.lit(" transaction of "), format_currency(F.col("x_cents")), F.lit(" equals the difference of the day."))),
            F.when(F.col("day_offset").isNotNull(), F.concat(F.lit("A transaction of "), target, F.lit(" on the day "), F.when(F.col("day_offset") < 0, "before").otherwise("after"), F.lit(" equals the difference."))),
        )
    )
    told = F.when(F.size(evidence) > 0, F.array_join(evidence, " ")).otherwise("The cause could not be found automatically. Check the slips and transactions of the day.")
    text = F.when(F.col("status") == "PENDING", "No cash closing was sent for this date. Ask for it.").when(F.col("status") == "OK", "").otherwise(told)
    return rows.select("date", text.alias("observation"))
