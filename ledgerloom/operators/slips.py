"""Order slips: from the transcription's JSON to typed rows that have checked themselves.

raw: seq, source_file, page, position, payload (JSON text). Each operator adds columns; nothing is dropped
but slips whose structure is broken, which go to `rejected`.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import let
from ledgerloom.functions.codes import image_id, normalize_barcode, only_digits
from ledgerloom.functions.dates import date_from_filename, resolve_slip_date
from ledgerloom.functions.money import format_currency, slip_money, unreadable_money
from ledgerloom.functions.text import filled, is_blank, normalize_person

#: Field names of the transcription's JSON.
FLAGS = ("brinde", "presente", "whats", "cashback", "aniver", "outros")
ITEM = "array<struct<codigo string, valor string, manuscrito boolean>>"
PAYLOAD_DDL = (
    "numero string, numero_controle string, data string, vendedora string, cliente string, telefone string, "
    f"itens {ITEM}, trocas {ITEM}, sub_total string, desconto string, total string, num_pecas string, pagamento string, "
    "parcelas string, bandeira string, " + ", ".join(f"{f} boolean" for f in FLAGS) + ", campos_ilegiveis array<string>, data_confirmada boolean"
)
#: Payment methods by how they are written.
PAYMENTS = {"pix": "pix", "dinheiro": "dinheiro", "especie": "dinheiro", "credito": "credito", "cartao de credito": "credito", "debito": "debito", "cartao de debito": "debito"}
PERCENT = r"^\s*(\d+(?:[.,]\d+)?)\s*%\s*$"
MIN_CONSENSUS = 3


def items(raw: Column) -> Column:
    """code, value_cents, handwritten of the entries that have a readable value, in order."""
    typed = F.transform(F.coalesce(raw, F.array().cast(ITEM)), lambda x: F.struct(normalize_barcode(x["codigo"]).alias("code"), slip_money(x["valor"]).alias("value_cents"), F.coalesce(x["manuscrito"], F.lit(False)).alias("handwritten")))
    return F.filter(typed, lambda x: x["value_cents"].isNotNull())


def item_problems(raw: Column) -> Column:
    lost = F.filter(F.coalesce(raw, F.array().cast(ITEM)), lambda x: is_blank(x["valor"]))
    return F.transform(lost, lambda x: F.concat(F.lit("item "), F.coalesce(F.nullif(normalize_barcode(x["codigo"]), F.lit("")), F.lit("(no code)")), F.lit(" has no readable value")))


def total_of(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("bigint"), lambda a, x: a + x["value_cents"])


def discount_cents(text: Column, base: Column) -> Column:
    """In currency, or in percent of the base, half up to a cent; null for blank, or for percent of nothing."""
    rate = F.replace(F.nullif(F.regexp_extract(text, PERCENT, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(12,4)")
    share = F.round(base.cast("decimal(20,0)") * rate / 100, 0).cast("bigint")
    return F.when(is_percent(text), share).otherwise(slip_money(text))


def is_percent(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(PERCENT)), F.lit(False))


def integer(text: Column) -> Column:
    return F.when(~is_blank(text), F.nullif(only_digits(text), F.lit("")).try_cast("int"))


def payment_method(text: Column) -> Column:
    key = F.lower(normalize_person(text))
    return F.element_at(F.create_map(*[F.lit(x) for pair in PAYMENTS.items() for x in pair]), key)


def parsed(raw: DataFrame) -> DataFrame:
    """raw with p (the payload as a struct) and error: null, or why the slip's structure is broken."""
    p = F.from_json("payload", PAYLOAD_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = raw.withColumn("p", p).withColumn("shape", F.try_parse_json("payload"))
    amounts = F.array(*[F.col(f"p.{f}") for f in ("sub_total", "total")], F.when(~is_percent(F.col("p.desconto")), F.col("p.desconto")))
    entries = F.concat(F.coalesce("p.itens", F.array().cast(ITEM)), F.coalesce("p.trocas", F.array().cast(ITEM)))
    bad_amount = F.exists(amounts, lambda a: F.coalesce(unreadable_money(a), F.lit(False))) | F.exists(entries, lambda x: F.coalesce(unreadable_money(x["valor"]), F.lit(False)))
    kind = lambda f: F.schema_of_variant(F.try_variant_get("shape", f"$.{f}", "variant"))
    not_list = F.lit(False)
    for f in ("itens", "trocas", "campos_ilegiveis"):
        not_list = not_list | ~F.coalesce(kind(f), F.lit("VOID")).rlike("^(VOID|ARRAY)")
    error = F.when(F.col("shape").isNull() | ~F.schema_of_variant("shape").startswith("OBJECT"), "the payload is not a JSON object").when(not_list, "a list field is not a list").when(bad_amount, "an amount is not money")
    return settled(rows.withColumn("error", error).drop("shape"))


def checks(items_: Column, returns: Column, sub_total: Column, discount: Column, total: Column, pieces: Column, percent: Column) -> Column:
    """What does not add up on a slip, in a fixed order; a percent discount may be a cent off."""
    some, tolerance = F.size(items_) > 0, F.when(percent, 1).otherwise(0)
    own, off = total_of(items_), F.coalesce(discount, F.lit(0))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    from_sub, from_items = sub_total - off, own - off
    label = F.when(off != 0, "sum of items - DISCOUNT").otherwise("sum of items")
    return F.array_compact(
        F.array(
            F.when(~some, "no item was read"),
            F.when(total.isNull(), "TOTAL was not read"),
            F.when(some & (pieces != F.size(items_)), text("PIECES says ", pieces.cast("string"), ", but ", F.size(items_).cast("string"), " items were read")),
            F.when(some & (own != sub_total), text("sum of items (", format_currency(own), ") differs from SUB TOTAL (", format_currency(sub_total), ")")),
            F.when(sub_total.isNotNull() & (F.abs(from_sub - total) > tolerance), text("SUB TOTAL - DISCOUNT (", format_currency(from_sub), ") differs from TOTAL (", format_currency(total), ")")).when(
                sub_total.isNull() & some & (F.abs(from_items - total) > tolerance), text(label, " (", format_currency(from_items), ") differs from TOTAL (", format_currency(total), ")")
            ),
            F.when((F.size(returns) > 0) & (total_of(returns) != discount), text("sum of returns (", format_currency(total_of(returns)), ") differs from DISCOUNT (", format_currency(discount), ")")),
        )
    )


def self_consistent(items_: Column, returns: Column, sub_total: Column, discount: Column, total: Column) -> Column:
    """Whether the total is, to a cent, what some reading of items, returns, discount and subtotal gives."""
    size = lambda pieces: F.aggregate(pieces, F.lit(0).cast("bigint"), lambda a, x: a + F.abs(x["value_cents"]))
    own, back, off = size(items_), size(returns), F.coalesce(discount, F.lit(0).cast("bigint"))
    tried = F.array_compact(F.array(own - back - off, own - off, own - back, sub_total - off, sub_total - back - off))
    return F.coalesce(F.exists(tried, lambda v: F.abs(v - total) <= 1), F.lit(False))


def effective_date(text: Column, confirmed: Column, file: Column, start: date, end: date) -> Column:
    """date, source (confirmed, file or slip) and check: the confirmed date, else the file name's, else the slip's."""
    day = lambda d: F.date_format(d, "dd/MM")

    def chosen(of_file: Column, read: Column) -> Column:
        other = F.concat(F.lit("the slip says "), day(read), F.lit(", the file is of "), day(of_file), F.lit("; "), day(of_file), F.lit(" was taken"))
        sure = F.coalesce(confirmed, F.lit(False)) & read.isNotNull()
        unread = F.when(filled(text).isNotNull() & read.isNull(), F.concat(F.lit("the date "), text, F.lit(" could not be read")))
        return F.struct(
            F.when(sure, read).otherwise(F.coalesce(of_file, read)).alias("date"),
            F.when(sure, "confirmed").when(of_file.isNotNull(), "file").otherwise("slip").alias("source"),
            F.when(sure, None).when(of_file.isNotNull(), F.when(read != of_file, other)).otherwise(unread).alias("check"),
        )

    return let(date_from_filename(file, start, end), lambda f: let(resolve_slip_date(text, start, end, F.month(f)), lambda r: chosen(f, r)))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, their columns computed once: no later filter or projection is merged into what made them."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("x")).select("x.*")


#: What `typed` finds in two steps before its columns, and which of its columns need that.
FROM_PAYLOAD = {
    "items": ("items", "items_uncertain", "discount_cents", "checks"), "returns": ("returns", "checks"), "sub_total_cents": ("sub_total_cents", "discount_cents", "checks"),
    "total_cents": ("total_cents", "checks"), "piece_count": ("piece_count", "items_uncertain", "checks"),
}
FROM_THESE = {"discount_cents": ("discount_cents", "checks"), "at": ("date", "date_source", "unreadable_fields", "checks"), "lost": ("checks",)}


def typed(raw: DataFrame, start: date, end: date, *only: str) -> DataFrame:
    """Typed slips of the sound rows of raw; dates of lone slips are flagged by date_outliers. Of the columns those in `only`, if given:
    no later projection reaches through `settled`, so what is not named here is found in any case."""
    such = lambda known, uses: {c: v for c, v in known.items() if not only or set(uses[c]) & set(only)}
    rows = parsed(raw).filter("error is null")
    first = {"items": items(F.col("p.itens")), "returns": items(F.col("p.trocas")), "sub_total_cents": slip_money(F.col("p.sub_total")), "total_cents": slip_money(F.col("p.total")), "piece_count": integer(F.col("p.num_pecas"))}
    if first := such(first, FROM_PAYLOAD):
        rows = settled(rows.withColumns(first))
    percent = is_percent(F.col("p.desconto"))
    second = {"at": effective_date(F.col("p.data"), F.col("p.data_confirmada"), F.col("source_file"), start, end), "lost": F.concat(item_problems(F.col("p.itens")), item_problems(F.col("p.trocas")))}
    if {"items", "sub_total_cents"} <= first.keys():
        base = F.coalesce("sub_total_cents", F.when(F.size("items") > 0, total_of(F.col("items"))))
        second["discount_cents"] = discount_cents(F.col("p.desconto"), base)
    if second := such(second, FROM_THESE):
        rows = settled(rows.withColumns(second))
    no_base = F.when(percent & F.col("discount_cents").isNull(), F.concat(F.lit("DISCOUNT of "), F.col("p.desconto"), F.lit(" without SUB TOTAL or items")))
    own = checks(F.col("items"), F.col("returns"), F.col("sub_total_cents"), F.col("discount_cents"), F.col("total_cents"), F.col("piece_count"), percent)
    unreadable = F.coalesce("p.campos_ilegiveis", F.array().cast("array<string>"))
    flags = F.array_compact(F.array(*[F.when(F.col(f"p.{f}"), f) for f in sorted(FLAGS)]))
    columns = {
        "seq": F.col("seq"), "image_id": image_id(F.col("source_file"), F.col("page"), F.col("position")), **{c: F.col(c) for c in ("source_file", "page", "position")},
        "number": filled(F.col("p.numero")), "control_no": filled(F.col("p.numero_controle")),
        "date": F.col("at.date"), "date_source": F.col("at.source"), "date_suspect": F.lit(False),
        "items_uncertain": (F.size("items") == 0) | (F.size(item_problems(F.col("p.itens"))) > 0) | F.coalesce(F.col("piece_count") != F.size("items"), F.lit(False)),
        "seller": normalize_person(F.col("p.vendedora")), "client": filled(F.col("p.cliente")), "phone": F.nullif(only_digits(F.col("p.telefone")), F.lit("")),
        **{c: F.col(c) for c in ("items", "returns", "sub_total_cents", "discount_cents", "total_cents", "piece_count")},
        "payment_method": payment_method(F.col("p.pagamento")), "installments": integer(F.col("p.parcelas")), "card_brand": filled(F.col("p.bandeira")), "flags": flags,
        "unreadable_fields": F.when(F.col("at.source") == "file", F.array_remove(unreadable, "data")).otherwise(unreadable),
        "checks": F.concat(own, "lost", F.array_compact(F.array(no_base, F.col("at.check")))),
    }
    return settled(rows.select(*[v.alias(c) for c, v in columns.items() if not only or c in only]))


def rejected(raw: DataFrame) -> DataFrame:
    return parsed(raw).filter("error is not null").select("seq", "source_file", "page", "position", "error")


def suspect_dates(slips: DataFrame) -> DataFrame:
    """seq, source_file, date, top and top_n of the slips that alone in their file have their date while another, `top`, the commonest
    there, has top_n, three or more.

    Only dates read from the slips count. Counts are aggregated by file and date first, so a file of any size is
    a few rows; the commonest date is the one that came first among equals. The slips are read once.
    """
    own = slips.filter("date_source = 'slip' and date is not null and source_file is not null")
    counts = own.groupBy("source_file", "date").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = Window.partitionBy("source_file").orderBy(F.desc("n"), "first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("top", F.first("date").over(best)).withColumn("top_n", F.first("n").over(best))
    # The only slip of a date is the first one.
    return ranked.filter(f"n = 1 and top_n >= {MIN_CONSENSUS}").select(F.col("first").alias("seq"), "source_file", "date", "top", "top_n")


def date_outliers(slips: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Flags slips with `suspect_dates`, which are checkpointed."""
    lone = checkpoint(suspect_dates(slips).drop("seq").withColumn("date_source", F.lit("slip")))
    day = lambda d: F.date_format(d, "dd/MM")
    told = F.concat(F.lit("date "), day(F.col("date")), F.lit(" appears on this slip only; the other "), F.col("top_n").cast("string"), F.lit(" of the file are of "), day(F.col("top")))
    both = slips.join(lone, ["source_file", "date", "date_source"], "left").withColumn("date_suspect", F.col("top").isNotNull())
    if "checks" not in slips.columns:
        return both.select(slips.columns)
    return both.withColumn("checks", F.when(F.col("top").isNotNull(), F.concat("checks", F.array(told))).otherwise(F.col("checks"))).select(slips.columns)


def needs_review() -> Column:
    return (F.size("checks") > 0) | (F.size("unreadable_fields") > 0)


def review_queue(slips: DataFrame) -> DataFrame:
    return slips.filter(needs_review())


def daily_by_seller(slips: DataFrame, nobody: str = "(NO SELLER)") -> DataFrame:
    """date, seller, cents of the slips with a date and a total."""
    return slips.filter("date is not null and total_cents is not null").groupBy("date", F.coalesce("seller", F.lit(nobody)).alias("seller")).agg(F.sum("total_cents").alias("cents"))


#: The fields that a person may correct.
EDITABLE = ("numero", "numero_controle", "data", "vendedora", "sub_total", "desconto", "total", "num_pecas", "pagamento", "parcelas")


def overlay(raw: DataFrame, edits: DataFrame) -> DataFrame:
    """raw with the corrections (image_id and EDITABLE fields, all of a row given) put into the payloads of their slips.

    A changed date that is not blank counts as confirmed. Corrections of unknown slips are ignored.
    """
    given = edits.select(F.col("image_id").alias("edit_id"), *[filled(F.col(f)).alias(f"edit_{f}") for f in EDITABLE])
    rows = raw.withColumn("own_id", image_id(F.col("source_file"), F.col("page"), F.col("position"))).join(given, F.col("own_id") == F.col("edit_id"), "left")
    rows = rows.withColumn("p", F.from_json("payload", PAYLOAD_DDL))
    changed = F.col("edit_data").isNotNull() & ~F.col("edit_data").eqNullSafe(filled(F.col("p.data")))
    fields = [F.col(f"edit_{f}").alias(f) for f in EDITABLE]
    kept = [f"p.{n}" for n in ("cliente", "telefone", "itens", "trocas", "bandeira", *FLAGS, "campos_ilegiveis")]
    made = F.to_json(F.struct(*fields, *kept, F.when(changed, True).otherwise(F.col("p.data_confirmada")).alias("data_confirmada")))
    return rows.withColumn("payload", F.when(F.col("edit_id").isNotNull(), made).otherwise(F.col("payload"))).select(raw.columns)


def signature(raw: DataFrame) -> DataFrame:
    """One row: a digest of all payloads by slip, which an approval is bound to; key order in the JSON does not count."""
    rows = raw.select(image_id(F.col("source_file"), F.col("page"), F.col("position")).alias("id"), F.to_json(F.from_json("payload", PAYLOAD_DDL)).alias("body"))
    one = rows.select(F.sha2(F.concat_ws("\x1f", "id", "body"), 256).alias("h"))
    # Sums of digest parts do not depend on order, and merge without gathering rows.
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)]
    return one.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts), 256).alias("signature"))


def require_approved(raw: DataFrame, approved: str | None) -> DataFrame:
    """raw, if the approval (the signature that was approved) is of exactly these slips; else an error."""
    now = signature(raw).first().signature
    if approved is None:
        raise ValueError("the slips have not been approved")
    if now != approved:
        raise ValueError("the slips have changed since they were approved")
    return raw


def result_key(company: str, start: date, end: date, files: str, slips_: str) -> str:
    """What a processed result belongs to: company, period, and the signatures of its files and slips."""
    return sha256("\x1f".join([company, start.isoformat(), end.isoformat(), files, slips_]).encode()).hexdigest()
