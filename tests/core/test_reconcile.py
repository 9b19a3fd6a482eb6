from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom import config
from ledgerloom.operators import diagnose, job, reconcile, report, shown, slips, validate

DAYS = [date(2026, 9, d) for d in range(1, 8)]
START, END = DAYS[0], DAYS[-1]


def frames(spark, ledger=(), acquirer=(), closings=()):
    return (
        spark.createDataFrame(list(ledger), "date date, seller string, cents bigint"),
        spark.createDataFrame(list(acquirer), "seq bigint, date date, status string, modality string, cents bigint, cancelled boolean, cancelled_cents bigint"),
        spark.createDataFrame(list(closings), "seq bigint, company string, date date, pix_cents bigint, cash_cents bigint, store_total_cents bigint"),
    )


def test_days_of_one_company(spark):
    one, two, three = DAYS[:3]
    ledger, acquirer, closings = frames(
        spark,
        [(one, "ANA", 100), (one, "BIA", 50), (two, "ANA", 70), (three, "ANA", 0)],
        [(1, one, "aprovada", "credito", 130, False, None), (2, one, "negada", "credito", 9, False, None), (3, two, "pago", "pix", 70, False, None)],
        [(1, "A", one, 10, 10, 150), (2, "A", one, 99, 0, 150), (3, "B", one, 1, 1, 1), (4, "B", two, 1, 1, 1), (5, "A", three, 0, 0, 0)],
    )
    got = {r.date: tuple(r)[1:] for r in reconcile.daily(ledger, acquirer, closings, START, END, "A").collect()}
    assert got == {one: (150, 10, 10, 130, 130, 0, "OK"), two: (70, None, None, None, 0, None, "PENDING")}
    other = {r.date: r.status for r in reconcile.daily(ledger, acquirer, closings, START, END, "B").collect()}
    assert other == {one: "DIVERGENT", two: "DIVERGENT"}
    total = reconcile.totals(reconcile.daily(ledger, acquirer, closings, START, END, "A")).first()
    assert (total.ok_days, total.pending_days, total.overall_status, total.ledger_cents) == (1, 1, "PENDING", 220)


def test_observations_of_a_day_without_the_ledger(spark):
    ledger, acquirer, closings = frames(spark, [(DAYS[1], "ANA", 500)], [(1, DAYS[0], "aprovada", "credito", 130, False, None), (2, DAYS[1], "negada", "debito", 500, False, None)], [(1, "A", DAYS[0], 0, 0, 5), (2, "A", DAYS[1], 0, 0, 5)])
    days = reconcile.daily(ledger, acquirer, closings, START, END, "A")
    got = {r.date: r.observation for r in diagnose.observations(days, ledger, acquirer, reconcile.acquirer_by_day(acquirer), reconcile.exceptions(acquirer)).collect()}
    assert got[DAYS[0]].startswith("No ledger movement on this date.")
    assert "equals the difference of the day" in got[DAYS[1]]


def test_findings(spark):
    ledger, acquirer, closings = frames(spark, [(DAYS[0], "ANA", 1), (date(2026, 8, 1), "ANA", 1)], [(1, DAYS[1], "pago", "pix", 1, False, None)], [(1, "A", DAYS[0], 1, 1, 1), (2, "B", DAYS[2], 1, 1, 1)])
    known = spark.createDataFrame([("ledger", ["A"]), ("acquirer", ["B"])], "source string, companies array<string>")
    got = {(r.severity, r.code, r.detail) for r in validate.findings(ledger, acquirer, closings, START, END, "A", known).collect()}
    assert got == {
        ("ERROR", "OTHER_COMPANY", "B"), ("ERROR", "MIXED_COMPANIES", "A, B"), ("ERROR", "OTHER_COMPANY", "acquirer: B"), ("WARNING", "OUT_OF_PERIOD", "ledger"), ("WARNING", "MISSING_CLOSING", "closing"),
        ("WARNING", "DATE_GAP", "ledger/acquirer"), ("WARNING", "DATE_GAP", "acquirer/ledger"), ("WARNING", "DATE_GAP", "acquirer/closing"), ("WARNING", "DATE_GAP", "closing/acquirer"),
    }
    with pytest.raises(ValueError, match="MIXED|OTHER"):
        validate.gate(validate.findings(ledger, acquirer, closings, START, END, "A"))
    assert [r.code for r in validate.findings(ledger, acquirer, closings, END, START, "A").collect()] == ["PERIOD"]
    silent = spark.createDataFrame([("ledger", []), ("acquirer", ["A"])], "source string, companies array<string>")
    own = closings.filter("company = 'A'")
    for known, code in ((True, ("ERROR", "NOT_CONFIRMED")), (False, ("WARNING", "NOT_CONFIGURED"))):
        found = validate.findings(ledger, acquirer, own, START, END, "A", silent, known)
        assert code in {(r.severity, r.code) for r in found.collect()}
        if known:
            with pytest.raises(ValueError, match="NOT_CONFIRMED"):
                validate.gate(found)
        else:
            validate.gate(found)


def test_identity(spark):
    found = spark.createDataFrame([("a", ["A"]), ("b", ["A", "B"]), ("c", [])], "source string, companies array<string>")
    assert {(r.source, r.code, r.severity) for r in validate.identity(found, "A", True).collect()} == {("b", "OTHER_COMPANY", "ERROR"), ("c", "NOT_CONFIRMED", "ERROR")}
    assert {(r.source, r.code, r.severity) for r in validate.identity(found, "A", False).collect()} == {("b", "OTHER_COMPANY", "ERROR"), ("c", "NOT_CONFIGURED", "WARNING")}


def test_messages_and_caps_in_order(spark):
    rows = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "seq int, message string")
    assert [r.message for r in validate.distinct_in_order(rows, "message", "seq").orderBy("seq").collect()] == ["b", "a", "c"]
    counted = spark.createDataFrame([("s", k, 40) for k in range(5)], "source string, row_no int, n int")
    assert [r.row_no for r in job.within_cap(counted, "source", "row_no", "n", 100).orderBy("row_no").collect()] == [0, 1, 2]


def test_progress(spark):
    rows = [(10, 0, 0, 0, 0, False), (10, 4, 10, 9, 1, False), (10, 10, 20, 20, 0, False), (10, 10, 20, 20, 0, True), (0, 0, 0, 0, 0, False)]
    got = job.progress(spark.createDataFrame(rows, "pages int, pages_done int, found int, done int, failed int, finished boolean"))
    assert [(r.estimated_total, round(r.progress, 2)) for r in got.collect()] == [(24, 0.0), (25, 0.4), (20, 0.99), (20, 1.0), (0, 0.0)]


def test_approval_is_bound_to_the_slips(spark):
    raw = spark.createDataFrame([("f", 1, 1, '{"numero":"1"}')], "source_file string, page int, position int, payload string")
    approved = slips.signature(raw).first().signature
    assert slips.require_approved(raw, approved) is raw
    with pytest.raises(ValueError, match="changed"):
        slips.require_approved(raw.withColumn("payload", F.lit('{"numero":"2"}')), approved)
    with pytest.raises(ValueError, match="not been approved"):
        slips.require_approved(raw, None)
    one, two = (slips.result_key("A", START, END, "f", s) for s in ("x", "y"))
    assert one != two and len(one) == 64
    files = [(1, "a", b"1"), (2, "b", b"2")]
    sign = lambda rows: job.files_signature(spark.createDataFrame(rows, "seq int, name string, content binary")).first().signature
    assert sign(files) == sign(files[::-1]) != sign([(1, "a", b"1"), (2, "b", b"3")])


def test_shown_values(spark):
    got = spark.createDataFrame([(None,), (9,), (123,), (3900,)], "s int").select(shown.duration_text(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["computing", "9 s", "2 min 03 s", "1h05"]
    assert spark.sql("select r'R$ 1_*`x' as t").select(shown.markdown_safe(F.col("t")).alias("t")).first().t == r"R\$ 1\_\*\`x"
    assert shown.report_name("North 2", START, END) == "reconciliation_north_2_20260901_20260907.pdf"
    labels = spark.createDataFrame([("OTHER_DAY",), ("X",)], "k string").select(shown.kind_label(F.col("k")).alias("l")).collect()
    assert [r.l for r in labels] == ["Slip paired with a sale of another day", "X"]
    raw = spark.createDataFrame([("f", 1, 2, '{"numero":" 7 ","num_pecas":3,"total":null}')], "source_file string, page int, position int, payload string")
    (r,) = shown.grid(raw).collect()
    assert (r.image_id, r.numero, r.num_pecas, r.total) == ("f#p1b2", "7", 3, "")


def test_tables_of_slips_and_the_report(spark):
    days = spark.createDataFrame([(DAYS[0], 2, 0, 2, 1, 1, 0, 0, 500, -100, "DIVERGENT"), (DAYS[1], 1, 0, 1, 1, 0, 0, 0, 50, 0, "OK")], "date date, slips bigint, excluded_slips bigint, sales bigint, matched_sales bigint, sales_without_slip bigint, slips_without_sale bigint, piece_divergences bigint, ledger_value_cents bigint, difference_cents bigint, status string")
    found = spark.createDataFrame([(DAYS[0], 3, None, "9", 0, "SALE_WITHOUT_SLIP", None, None, "ANA", None, -100, "x"), (DAYS[0], 2, 5, "8", -1, "OTHER_DAY", "5", "f#p1b1", "ANA", None, 0, "y")], "date date, section int, slip bigint, sale_number string, ordinal int, kind string, slip_number string, image_id string, seller string, code string, impact_cents bigint, detail string")
    sections = dict(shown.crosscheck_section(days, found))
    table = sections["Slips against the ledger"]
    assert "excluded_slips" not in table.columns and [(r.date, r.status) for r in table.collect()] == [("01/09/2026", "DIVERGENT"), ("02/09/2026", "OK"), ("TOTAL", "DIVERGENT")]
    assert [r.sale for r in sections["Divergences"].collect()] == ["9"] and [r.n for r in sections["Notes of reading (no divergence, not in the difference)"].collect()] == ["1"]
    made = report.pdf("Report", list(sections.items()))
    assert made.startswith(b"%PDF")
    ledger, acquirer, closings = frames(spark, [(DAYS[0], "ANA", 100)], [], [(1, "A", DAYS[0], 1, 1, 1)])
    rec = reconcile.daily(ledger, acquirer, closings, START, END, "A")
    wide = shown.daily_wide(rec, reconcile.sellers_wide(ledger, ["ANA"]), ["ANA"]).first()
    assert wide.ANA == "1,00" and wide.status == "DIVERGENT"
    lines = {r.what: r.value for r in shown.summary_table(reconcile.totals(rec), 1).collect()}
    assert lines["overall status"] == "DIVERGENT" and lines["ledger"] == "R$ 1,00"
    assert shown.observation_table(rec, spark.createDataFrame([(DAYS[0], "why")], "date date, observation string")).first().observation == "why"
    typed = spark.createDataFrame([("b", 1, 1, "7", DAYS[0], None, 2, [1, 2], 100, "credito", 3), ("a", 2, 1, None, None, "ANA", None, [], None, None, None)], "source_file string, page int, position int, number string, date date, seller string, piece_count int, items array<int>, total_cents bigint, payment_method string, installments int")
    rows = shown.slip_table(typed, F.col("total_cents").isNull()).collect()
    assert [(r.file, r.payment, r.total, r.check) for r in rows] == [("a (p2/1)", "-", "not read", "review"), ("b (p1/1)", "credito 3x", "1,00", "OK")]


def test_settings_and_companies(spark):
    text = "# note\nA=1\nB='two'\nLEDGERLOOM_READER_URL=file\nbroken"
    got = config.layered(text, {"B": "3", "C": "4"}, {"C": 5, "A": None})
    assert (got["A"], got["B"], got["C"]) == ("1", "3", "5")
    reader = config.Reader.of(config.layered(text, {"LEDGERLOOM_READER_ATTEMPTS": "9"}, {}))
    assert (reader.url, reader.attempts, reader.concurrency, reader.token) == ("file", 9, 8, None)
    with pytest.raises(ValueError):
        config.Reader.of({})
    companies = [config.Company("N", ["north"], ["North Ltd"], ["12"], ["7"]), config.Company("S", ["south"])]
    assert config.selected(companies, "S").name == "S" and config.company_texts(spark, companies).count() == 3
    assert {(r.company, r.kind, r.code) for r in config.company_codes(spark, companies).collect()} == {("N", "branch", "00007"), ("N", "tax_id", "00000000000012")}
    with pytest.raises(ValueError):
        config.selected(companies, "X")
    assert config.identified(companies, "N") and not config.identified(companies, "S")
    odd = config.layered("  x y = \"q = 1\"  \n=3\n#c=1\nempty=\n\nlast= 5 ", {})
    assert dict(odd) == {"x y": "q = 1", "empty": "", "last": "5"}


def test_sets_and_sums(spark):
    lines = spark.createDataFrame([(DAYS[0], 10, 2, "b"), (DAYS[0], -5, None, "a"), (DAYS[1], 1, 1, None)], "date date, gross_cents bigint, quantity int, seller string")
    assert {r.date: r.gross_cents for r in reconcile.gross_by_date(lines).collect()} == {DAYS[0]: 15, DAYS[1]: 1}
    (r,) = reconcile.source_sets(lines, "seller", "date").collect()
    assert (r.records, r.seller, r.date) == (3, ["a", "b"], DAYS[:2])
