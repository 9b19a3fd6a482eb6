import json
from datetime import date

from pyspark.sql import functions as F

from ledgerloom.operators import slips
from ledgerloom.plans import slips as plans_slips

START, END = date(2026, 9, 1), date(2026, 9, 27)
RAW = "seq bigint, source_file string, page int, position int, payload string"


def item(code, value, hand=False):
    return {"codigo": code, "valor": value, "manuscrito": hand}


def payload(**over):
    base = {"numero": "28900", "numero_controle": "055", "data": "22/09", "vendedora": "Aná", "itens": [item("0002239377971", "59,90")], "trocas": [], "sub_total": "59,90", "desconto": None, "total": "59,90", "num_pecas": 1, "pagamento": "Cartão de crédito", "campos_ilegiveis": []}
    return {**base, **over}


def rows(spark, payloads, files=None):
    data = [(k, (files or {}).get(k, "scan.pdf"), 1, k, p if isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads)]
    return spark.createDataFrame(data, RAW)


def typed(spark, *payloads, files=None):
    return slips.typed(rows(spark, payloads, files), START, END).orderBy("seq").collect()


def test_clean_slip(spark):
    (r,) = typed(spark, payload())
    assert (r.date, r.date_source, r.seller, r.total_cents, r.payment_method, r.checks, r.items_uncertain) == (date(2026, 9, 22), "slip", "ANA", 5990, "credito", [], False)
    assert r["items"][0].code == "2239377971" and r.image_id == "scan.pdf#p1b0"


def test_what_does_not_add_up(spark):
    got = typed(
        spark,
        payload(itens=[], num_pecas=None, total=None, sub_total=None),
        payload(num_pecas=3),
        payload(sub_total="60,00", total="60,00"),
        payload(total="50,00"),
        payload(sub_total=None, total="50,00", desconto="5,00"),
        payload(desconto="10%", total="53,92"),
        payload(desconto="10%", total="53,80"),
        payload(trocas=[item("1", "10,00")], desconto="5,00", total="54,90"),
        payload(itens=[item("77", "null"), item("1", "59,90")]),
        payload(desconto="10%", sub_total=None, itens=[], num_pecas=None),
        payload(total="null", data="xx"),
    )
    heads = [[c[:24] for c in r.checks] for r in got]
    assert heads[0] == ["no item was read", "TOTAL was not read"]
    assert heads[1] == ["PIECES says 3, but 1 ite"] and got[1].items_uncertain
    assert heads[2] == ["sum of items (R$ 59,90) "]
    assert heads[3] == ["SUB TOTAL - DISCOUNT (R$"]
    assert got[4].checks == ["sum of items - DISCOUNT (R$ 54,90) differs from TOTAL (R$ 50,00)"]
    assert heads[5] == [] and got[5].discount_cents == 599
    assert heads[6] == ["SUB TOTAL - DISCOUNT (R$"]
    assert heads[7] == ["sum of returns (R$ 10,00"]
    assert heads[8] == ["item 77 has no readable "] and got[8].items_uncertain
    assert heads[9][-1] == "DISCOUNT of 10% without "
    assert heads[10] == ["TOTAL was not read", "the date xx could not be"]


def test_dates_by_file_and_hand(spark):
    files = {0: "Ana 05.09.pdf", 1: "Ana 05.09.pdf", 2: "Ana 22.09.pdf", 3: "x.pdf"}
    got = typed(spark, payload(), payload(data_confirmada=True), payload(data="", campos_ilegiveis=["data", "total"]), payload(data="2020-01-01"), files=files)
    assert [(r.date.day, r.date_source) for r in got] == [(5, "file"), (22, "confirmed"), (22, "file"), (1, "slip")]
    assert got[0].checks == ["the slip says 22/09, the file is of 05/09; 05/09 was taken"] and got[2].unreadable_fields == ["total"]


def test_broken_structure_is_rejected(spark):
    raw = rows(spark, ["[1]", "nonsense", payload(itens="x"), payload(total="abc"), payload()])
    assert [r.seq for r in slips.rejected(raw).orderBy("seq").collect()] == [0, 1, 2, 3]
    assert slips.typed(raw, START, END).count() == 1


def test_lone_dates(spark):
    days = ["22/09"] * 3 + ["21/09"] + ["20/09"] * 2 + [None]
    df = slips.date_outliers(slips.typed(rows(spark, [payload(data=d) for d in days]), START, END))
    got = {r.seq: r for r in df.collect()}
    assert [got[k].date_suspect for k in range(7)] == [False] * 3 + [True] + [False] * 3
    assert got[3].checks == ["date 21/09 appears on this slip only; the other 3 of the file are of 22/09"]
    assert sorted(r.seq for r in slips.review_queue(df).collect()) == [3]


def test_overlay_and_signature(spark):
    raw = rows(spark, [payload(data="xx"), payload()])
    edit = {f: None for f in slips.EDITABLE} | {"image_id": "scan.pdf#p1b0", "data": "21/09", "total": "10,00", "numero": "1"}
    edits = spark.createDataFrame([edit, {**edit, "image_id": "unknown#p1b0"}], "image_id string, " + ", ".join(f"{f} string" for f in slips.EDITABLE))
    fixed = slips.overlay(raw, edits)
    got = slips.typed(fixed, START, END).orderBy("seq").collect()
    assert (got[0].date, got[0].date_source, got[0].total_cents, got[0].seller) == (date(2026, 9, 21), "confirmed", 1000, None)
    assert got[1].total_cents == 5990 and len(got) == 2
    one, two = slips.signature(raw).first()[0], slips.signature(fixed).first()[0]
    turned = raw.withColumn("payload", F.to_json(F.from_json("payload", "total string, sub_total string, " + slips.PAYLOAD_DDL.replace("sub_total string, ", "").replace(" total string,", ""))))
    assert one != two and slips.signature(turned.orderBy(F.desc("seq"))).first()[0] == one


def test_sums_by_seller(spark):
    df = slips.typed(rows(spark, [payload(), payload(vendedora=None), payload(total=None)]), START, END)
    assert {(r.seller, r.cents) for r in slips.daily_by_seller(df).collect()} == {("ANA", 5990), ("(NO SELLER)", 5990)}


def test_self_consistent(spark):
    df = slips.typed(rows(spark, [payload(), payload(total="59,91"), payload(total="10,00"), payload(trocas=[item("1", "9,90")], total="50,00", sub_total=None), payload(total=None)]), START, END)
    args = [F.col(c) for c in ("items", "returns", "sub_total_cents", "discount_cents", "total_cents")]
    assert [r[0] for r in df.orderBy("seq").select(slips.self_consistent(*args)).collect()] == [True, True, False, True, False]


def test_outliers_read_each_slip_once_and_only_what_they_need(spark):
    """A query of lone dates parses no amounts and no item twice, and does not come back to the slips for them."""
    plan = plans_slips.slip_date_outliers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "sum of items" not in plan


def test_columns_of_typed_slips_can_be_asked_for(spark):
    raw = plans_slips.raw(spark, "/root/testdata/sf0.001").limit(60).localCheckpoint()
    whole = slips.typed(raw, plans_slips.START, plans_slips.END)
    want = {c: sorted(map(str, whole.select("seq", c).collect())) for c in whole.columns[1:]}
    for only in [("discount_cents",), ("items_uncertain",), ("date", "date_source"), ("items", "returns", "date"), ("checks", "unreadable_fields"), ("number",)]:
        found = slips.typed(raw, plans_slips.START, plans_slips.END, "seq", *only)
        assert set(found.columns) == {"seq", *only}
        rows = found.localCheckpoint()
        assert all(sorted(map(str, rows.select("seq", c).collect())) == want[c] for c in only)
