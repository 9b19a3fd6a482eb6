"""Reports: table blocks with totals, as Markdown (finished, small frames) or as pages of lines of any number, a PDF among them.

Lines are laid out, wrapped, numbered, dealt to pages and drawn where they lie; what reaches the driver are the widths of the
columns, a count for each partition, and for a PDF its drawn pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.checkpoints import checkpointed
from ledgerloom.functions.dates import format_date
from ledgerloom.functions.money import format_cents
from ledgerloom.operators.reconcile import MEASURES

#: A period's days, sellers and notes are a few thousand lines at most; more than this is a mistake and is refused.
MAX_LINES = 20_000


def daily_table(days: DataFrame) -> DataFrame:
    """The days as text, ascending, and a TOTAL row."""
    every = days.select("date", *MEASURES, "status").unionByName(days.agg(F.lit(None).cast("date").alias("date"), *[F.sum(m).alias(m) for m in MEASURES], F.lit("").alias("status")))
    label = F.coalesce(format_date(F.col("date")), F.lit("TOTAL"))
    return every.orderBy(F.col("date").asc_nulls_last()).select(label.alias("date"), *[F.when(F.col(m).isNull(), "-").otherwise(format_cents(F.col(m))).alias(m) for m in MEASURES], "status")


def seller_blocks(wide: DataFrame, sellers: Sequence[str], width: int = 5) -> list[DataFrame]:
    """The seller columns in blocks of five, each with a TOTAL row."""
    blocks = []
    for at in range(0, len(sellers), width):
        part = list(sellers[at : at + width])
        total = wide.agg(F.lit(None).cast("date").alias("date"), *[F.sum(s).alias(s) for s in part])
        rows = wide.select("date", *part).unionByName(total).orderBy(F.col("date").asc_nulls_last())
        blocks.append(rows.select(F.coalesce(format_date(F.col("date")), F.lit("TOTAL")).alias("date"), *[format_cents(F.col(s)).alias(s) for s in part]))
    return blocks


def notes(observations: DataFrame) -> DataFrame:
    return observations.filter(F.trim("observation") != "").orderBy("date").select(format_date(F.col("date")).alias("date"), "observation")


def lines_of(table: DataFrame) -> list[list[str]]:
    rows = table.limit(MAX_LINES + 1).collect()
    if len(rows) > MAX_LINES:
        raise ValueError(f"a report table has more than {MAX_LINES} lines")
    return [table.columns, *[["" if v is None else str(v) for v in r] for r in rows]]


def markdown(title: str, tables: Sequence[tuple[str, DataFrame]]) -> str:
    out = [f"# {title}"]
    for name, table in tables:
        head, *body = lines_of(table)
        cell = lambda v: v.replace("|", "\\|")
        out += [f"\n## {name}\n", "| " + " | ".join(map(cell, head)) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in body)]
    return "\n".join(out) + "\n"


#: Characters of a line, of which longer ones are continued on the next, and lines of a page.
WIDE, PER_PAGE = 140, 60


def laid_out(table: DataFrame) -> DataFrame:
    """text: a line for the names of the columns and one a row, in the table's order, every column as wide as its widest cell."""
    cells = table.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{k}") for k, c in enumerate(table.columns)])
    found = cells.agg(*[F.max(F.length(c)) for c in cells.columns]).first()
    widths = [max(len(name), w or 0) for name, w in zip(table.columns, found, strict=True)]
    head = "  ".join(name.ljust(w) for name, w in zip(table.columns, widths, strict=True)).rstrip()
    line = F.rtrim(F.concat_ws("  ", *[F.rpad(c, w, " ") for c, w in zip(cells.columns, widths, strict=True)]))
    return table.sparkSession.createDataFrame([(head,)], "text string").unionByName(cells.select(line.alias("text")))


def wrapped(lines: DataFrame, wide: int = WIDE) -> DataFrame:
    """The lines, none longer than `wide`: what does not fit goes on in the next."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / wide).cast("int")))
    return lines.select(F.explode(F.transform(starts, lambda k: F.substring(F.col("text"), k * wide + 1, F.lit(wide)))).alias("text"))


def paged(lines: DataFrame, per_page: int = PER_PAGE, checkpoint: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """page and line (from 1) and text of lines, in the order in which they lie: that of a sorted table, or of several one after another.

    The lines are checkpointed, so their partitions stay; a line's number is its place in its partition and the count of the
    lines in those before.
    """
    rows = checkpoint(lines).select("text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mark"))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("mark").alias("first")).collect()
    before, starts = 0, []
    for p in sorted(parts, key=lambda p: p.part):
        starts.append((p.part, p.first, before))
        before += p.n
    known = rows.sparkSession.createDataFrame(starts, "part int, first bigint, before bigint")
    placed = rows.join(F.broadcast(known), "part").withColumn("at", F.col("mark") - F.col("first") + F.col("before"))
    return placed.select((F.floor(F.col("at") / per_page) + 1).alias("page"), (F.col("at") % per_page + 1).alias("line"), "text")


def drawn(pages: DataFrame) -> DataFrame:
    """page and body, the PDF operators that draw its lines with its number at the foot. A page is a group of few lines."""
    total = pages.agg(F.max("page")).first()[0] or 0

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = []
            for page, lines in zip(batch["page"], batch["lines"], strict=True):
                shown = [*(x["text"] for x in lines), "", f"page {page} of {total}"]
                plain = [s.translate({92: "\\\\", 40: "\\(", 41: "\\)"}) for s in shown]
                bodies.append(("BT /F1 7 Tf 11 TL 30 810 Td " + " ".join(f"({s}) Tj T*" for s in plain) + " ET").encode("cp1252", "replace"))
            yield pd.DataFrame({"page": batch["page"], "body": bodies})

    groups = pages.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    return groups.mapInPandas(draw, "page bigint, body binary")


def pdf(title: str, tables: Sequence[tuple[str, DataFrame]], per_page: int = PER_PAGE) -> bytes:
    """A4 portrait, monospaced, with "page n of m" at the foot; long lines go on in the next."""
    spark = tables[0][1].sparkSession
    words = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    lines = words(title, "")
    for name, table in tables:
        lines = lines.unionByName(words(name)).unionByName(laid_out(table)).unionByName(words(""))
    bodies = [bytes(r.body) for r in drawn(paged(wrapped(lines), per_page)).orderBy("page").collect()]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(bodies), b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(bodies)))), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for n, body in enumerate(bodies):
        objects += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * n), b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)]
    out, places = b"%PDF-1.4\n", []
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
