"""Money: bigint cents everywhere, decimals only while a text is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import let
from ledgerloom.functions.text import is_blank


def cents_of(amount: Column) -> Column:
    """Cents of a number."""
    return F.round(amount.cast("decimal(18,4)") * 100).cast("bigint")


def parse_money_cents(text: Column) -> Column:
    """Cents of an amount as people write it; null or blank is 0, what is no amount is null.

    The last of both separators is the decimal one; a lone separator is decimal; of several dots the last
    is; parentheses negate, also what is negative already.
    """
    t = F.replace(F.replace(F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit("R$"), F.lit("")), F.lit("r$"), F.lit("")), F.lit(" "), F.lit(""))
    return let(t, lambda t: F.when(t.isin("", "-", "--"), F.lit(0).cast("bigint")).otherwise(_signed(t)))


def _signed(t: Column) -> Column:
    negated = F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")"))
    inner = F.when(negated, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    cents = let(F.regexp_replace(inner, r"[^0-9,.+\-]", ""), lambda body: (F.round(_plain(body).try_cast("decimal(20,6)"), 2) * 100).cast("bigint"))
    return let(cents, lambda c: F.when(negated, -c).otherwise(c))


def _plain(body: Column) -> Column:
    """With a dot before the decimals and no other separator."""
    last_of_many = lambda sep: F.regexp_replace(body, rf"[{sep}](?=.*[{sep}])", "")
    comma, dot = F.instr(body, ",") > 0, F.instr(body, ".") > 0
    comma_last = F.locate(",", F.reverse(body)) < F.locate(".", F.reverse(body))
    return (
        F.when(comma & dot & comma_last, F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & dot, F.replace(body, F.lit(","), F.lit("")))
        .when(comma, F.replace(last_of_many(","), F.lit(","), F.lit(".")))
        .otherwise(last_of_many("."))
    )


def slip_money(text: Column) -> Column:
    """As parse_money_cents, but blank is null."""
    return F.when(~is_blank(text), parse_money_cents(text))


def unreadable_money(text: Column) -> Column:
    return ~is_blank(text) & parse_money_cents(text).isNull()


def cents_to_decimal(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / 100).cast("decimal(20,2)")


def format_cents(cents: Column) -> Column:
    """1.234,56; no minus before zero."""
    whole = F.coalesce(cents, F.lit(0))
    return F.translate(F.format_number(cents_to_decimal(whole), 2), ",.", ".,")


def format_currency(cents: Column) -> Column:
    return F.concat(F.lit("R$ "), format_cents(cents))
