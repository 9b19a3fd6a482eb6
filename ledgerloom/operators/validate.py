"""Checks between sources before a reconciliation: findings are rows (severity, code, detail), and a gate raises."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import format_dates
from ledgerloom.functions.text import normalize_text


def presence(ledger: DataFrame, acquirer: DataFrame, closings: DataFrame, start: date, end: date) -> DataFrame:
    """date and whether each source has it, within the period."""
    sides = []
    for name, df in (("ledger", ledger), ("acquirer", acquirer), ("closing", closings)):
        sides.append(df.filter(F.col("date").between(F.lit(start), F.lit(end))).select("date", F.lit(name).alias("source")))
    every = sides[0].unionByName(sides[1]).unionByName(sides[2])
    return every.groupBy("date").agg(*[F.bool_or(F.col("source") == n).alias(f"in_{n}") for n in ("ledger", "acquirer", "closing")])


def date_gaps(presence_: DataFrame) -> DataFrame:
    """present_in, absent_in, date for each ordered pair of sources."""
    names = ("ledger", "acquirer", "closing")
    pairs = [F.struct(F.lit(a).alias("present_in"), F.lit(b).alias("absent_in"), (F.col(f"in_{a}") & ~F.col(f"in_{b}")).alias("gap")) for a in names for b in names if a != b]
    return presence_.select("date", F.explode(F.array(*pairs)).alias("p")).filter("p.gap").select("p.present_in", "p.absent_in", "date")


def missing_closings(presence_: DataFrame) -> DataFrame:
    return presence_.filter("(in_ledger or in_acquirer) and not in_closing").select("date")


def out_of_period(ledger: DataFrame, acquirer: DataFrame, closings: DataFrame, start: date, end: date) -> DataFrame:
    """source, n_dates, dates (ascending, as text) of each source's dates outside the period."""
    sides = [df.filter(~F.col("date").between(F.lit(start), F.lit(end))).select(F.lit(n).alias("source"), "date") for n, df in (("ledger", ledger), ("acquirer", acquirer), ("closing", closings))]
    every = sides[0].unionByName(sides[1]).unionByName(sides[2]).distinct()
    return every.groupBy("source").agg(F.count("*").alias("n_dates"), format_dates(F.collect_list("date")).alias("dates"))


def companies_by_code(codes: DataFrame, companies: DataFrame) -> DataFrame:
    """codes: source, code · companies: company, code (normalised). source, companies (sorted) by equal code.

    companies is configuration, a few rows a company, so it is broadcast.
    """
    return codes.join(F.broadcast(companies.select("company", "code").distinct()), "code").groupBy("source").agg(F.array_sort(F.collect_set("company")).alias("companies"))


#: Letters of the start of an alias by which texts meet it.
GRAM = 4


def companies_by_text(texts: DataFrame, companies: DataFrame) -> DataFrame:
    """texts: source, text · companies: company, alias (configuration). source, companies whose alias the text contains; blank aliases
    mean no company.

    An alias stands in a text only where its first letters do, so texts are cut into stretches of so many letters, which meet
    the aliases by equality; what meets is then looked for as a whole. Shorter aliases are met by stretches of their own length.
    """
    alias = companies.select("company", normalize_text(F.col("alias")).alias("alias")).filter("alias <> ''").distinct().withColumn("gram", F.substring("alias", 1, GRAM))
    lengths = [r.n for r in alias.select(F.length("gram").alias("n")).distinct().collect()]
    normal = texts.select("source", normalize_text(F.col("text")).alias("text"))
    stretches = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - n + 1)), lambda i: F.substring(F.col("text"), i, F.lit(n)))
    grams = F.array_distinct(F.concat(F.array().cast("array<string>"), *[stretches(n) for n in sorted(lengths)]))
    met = normal.withColumn("gram", F.explode(grams)).join(F.broadcast(alias), "gram").filter(F.contains("text", "alias"))
    return met.groupBy("source").agg(F.array_sort(F.collect_set("company")).alias("companies"))


def identity(found: DataFrame, selected: str, has_identifiers: bool) -> DataFrame:
    """found: source, companies. severity, code, source, others: whether each source belongs to the selected company."""
    others = F.array_except("companies", F.array(F.lit(selected)))
    none = F.size("companies") == 0
    code = F.when(F.size(others) > 0, "OTHER_COMPANY").when(none & F.lit(has_identifiers), "NOT_CONFIRMED").when(none, "NOT_CONFIGURED")
    severity = F.when(code == "NOT_CONFIGURED", "WARNING").otherwise("ERROR")
    return found.withColumn("others", others).withColumn("code", code).withColumn("severity", severity).filter("code is not null").select("severity", "code", "source", "others")


def companies_of_closings(closings: DataFrame, selected: str) -> DataFrame:
    """severity, code, detail: closings of other companies than the selected one, and of more than one company."""
    seen = closings.agg(F.array_sort(F.collect_set("company")).alias("c"))
    others = F.array_except("c", F.array(F.lit(selected)))
    found = F.array_compact(F.array(F.when(F.size(others) > 0, F.struct(F.lit("OTHER_COMPANY").alias("code"), F.array_join(others, ", ").alias("detail"))), F.when(F.size("c") > 1, F.struct(F.lit("MIXED_COMPANIES").alias("code"), F.array_join("c", ", ").alias("detail")))))
    return seen.select(F.explode(found).alias("x")).select(F.lit("ERROR").alias("severity"), "x.code", "x.detail")


def findings(ledger: DataFrame, acquirer: DataFrame, closings: DataFrame, start: date, end: date, company: str, identities: DataFrame | None = None, has_identifiers: bool = True) -> DataFrame:
    """severity, code, detail, dates: all that the sources say about each other in the period.

    closings may hold several companies: that is found, and the other checks look at the selected one. identities: source,
    companies, what each source says of itself (`companies_by_code`, `companies_by_text`). has_identifiers: whether the selected company has
    any by which a source could tell (`config.identified`); without, a source that says nothing is a warning and passes the gate.
    """
    no_dates = F.array().cast("array<date>").alias("dates")
    if start > end:
        return ledger.sparkSession.createDataFrame([("ERROR", "PERIOD", f"{start} > {end}", None)], "severity string, code string, detail string, dates array<date>")
    mixed = companies_of_closings(closings, company).select("severity", "code", "detail", no_dates)
    own = closings.filter(F.col("company") == company)
    seen = presence(ledger, acquirer, own, start, end)
    dates: Column = F.array_sort(F.collect_set("date")).alias("dates")
    gaps = date_gaps(seen).groupBy(F.concat_ws("/", "present_in", "absent_in").alias("detail")).agg(dates).select(F.lit("WARNING").alias("severity"), F.lit("DATE_GAP").alias("code"), "detail", "dates")
    missing = missing_closings(seen).agg(dates).filter(F.size("dates") > 0).select(F.lit("WARNING").alias("severity"), F.lit("MISSING_CLOSING").alias("code"), F.lit("closing").alias("detail"), "dates")
    counts = seen.agg(*[F.count_if(f"in_{n}").alias(n) for n in ("ledger", "acquirer", "closing")])
    empty = counts.select(F.explode(F.array(*[F.struct(F.lit("WARNING" if n == "closing" else "ERROR").alias("severity"), F.lit(n).alias("detail"), F.col(n).alias("n")) for n in ("ledger", "acquirer", "closing")])).alias("x"))
    empty = empty.filter("x.n = 0").select("x.severity", F.lit("EMPTY_SOURCE").alias("code"), "x.detail", no_dates)
    every = [df.select(F.lit(n).alias("detail"), "date") for n, df in (("ledger", ledger), ("acquirer", acquirer), ("closing", own))]
    outside = every[0].unionByName(every[1]).unionByName(every[2]).filter(~F.col("date").between(F.lit(start), F.lit(end))).groupBy("detail").agg(dates).select(F.lit("WARNING").alias("severity"), F.lit("OUT_OF_PERIOD").alias("code"), "detail", "dates")
    found = mixed.unionByName(gaps).unionByName(missing).unionByName(empty).unionByName(outside)
    if identities is not None:
        named = identity(identities, company, has_identifiers).select("severity", "code", F.concat_ws(": ", F.col("source").cast("string"), F.array_join("others", ", ")).alias("detail"), no_dates)
        found = found.unionByName(named)
    return found


def distinct_in_order(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Messages or file names, each once, with the place (`order`) of its first occurrence; sort by it to read them."""
    return rows.groupBy(value).agg(F.min(order).alias(order))


def gate(found: DataFrame) -> None:
    """Raise if there is an error among the findings."""
    errors = found.filter("severity = 'ERROR'").limit(5).collect()
    if errors:
        raise ValueError("; ".join(f"{r.code}: {r.detail if 'detail' in r else r.source}" for r in errors))
