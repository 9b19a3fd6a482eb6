import io
import json
import pathlib
import zipfile
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import job, report, validate
from ledgerloom.sources import closing_text, slips, xlsx
from ledgerloom.streaming import ingest


def workbook(rows):
    def cell(c, r, v):
        ref = f"{chr(65 + c)}{r}"
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, int | float) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_ledger_workbooks(spark, tmp_path):
    head = ["Data ", "Vendédor", "Base Comissão", "Código", "Valor Bruto", "Qtde"]
    rows = [["report"], [], head, ["02/07/2026", "ana", "10,50", "0001", "-5,00", 2], [None, None, None], [46205, "bia", "abc", "9", "1,00"]]
    (tmp_path / "a.xlsx").write_bytes(workbook(rows))
    (tmp_path / "b.xlsx").write_bytes(b"not a zip")
    lines = xlsx.ledger_lines(xlsx.read_xlsx(spark, f"{tmp_path}/*.xlsx", *xlsx.LEDGER))
    good = lines.filter("error is null").collect()
    assert [(r.date, r.seller, r.commission_cents, r.code, r.gross_cents, r.quantity) for r in good] == [(date(2026, 7, 2), "ANA", 1050, "1", -500, 2)]
    assert xlsx.items_of(lines).count() == 1
    errors = {r.source[-6:]: r.errors for r in xlsx.first_errors(lines).collect()}
    assert errors["a.xlsx"] == "the commission base is not money" and "b.xlsx" in errors


def test_acquirer_workbook(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["Data da venda", "Status da venda", "Valor da venda", "Modalidade", "CNPJ", "Cancelada pelo estabelecimento"], ["02/07/2026", "Aprovada", "10,00", "Crédito", "1.2", "Sim"]]))
    (r,) = xlsx.transactions(xlsx.read_xlsx(spark, str(tmp_path), *xlsx.ACQUIRER)).collect()
    assert (r.status, r.modality, r.cents, r.cancelled, r.tax_id, r.error) == ("aprovada", "credito", 1000, True, "00000000000012", None)


def test_closings(spark):
    text = "North Retail 10:20:30\nPERÍODO DE 02/07/2026 ATÉ 02/07/2026\nFilial: 12 Centro\nPIX 1,00 2,00 144,80\nTotal geral 9,99\nTOTAL desta loja 4.080,40"
    files = [(0, "a", text), (1, "b", text.replace("PIX 1,00 2,00 144,80", "DINHEIRO")), (2, "c", text.replace("ATÉ 02", "ATÉ 03")), (3, "d", ""), (4, "e", text.replace("North", "Other"))]
    companies = spark.createDataFrame([("N", "north retail")], "company string, alias string")
    got = {r.seq: r for r in closing_text.closings(spark.createDataFrame(files, "seq int, file_name string, text string"), companies).collect()}
    a = got[0]
    assert (a.company, a.legal_name, a.branch, a.date, a.pix_cents, a.cash_cents, a.store_total_cents, a.absent_methods, a.error) == ("N", "North Retail", "12 Centro", date(2026, 7, 2), 14480, 0, 408040, ["CASH"], None)
    assert [got[k].error for k in (1, 2, 3, 4)] == ["the line of cash has no amount", "the period is not one day", "no text", "not exactly one known company"]


def page(*spans, width=600, height=200):
    grey = np.full((height, width), 230, np.uint8)
    for a, b in spans:
        grey[20:180, a:b] = 60
    return grey


def columns_of(spark, grey):
    runs = "array<struct<lo int, hi int>>"
    rows = spark.createDataFrame([(slips.empty_runs(grey), grey.shape[1])], f"empty {runs}, width int")
    return [(x.lo, x.hi) for x in rows.select(job.segments(F.col("empty"), F.col("width")).alias("s")).first().s]


def test_segmentation(spark):
    # The gutters of 8 and 22 columns are as wide as a gutter must be, the one of 5 is not; what is narrower than a tenth of the page is dropped.
    assert columns_of(spark, page((20, 180), (220, 400), (405, 560))) == [(20, 180), (220, 560)]
    assert columns_of(spark, page((20, 180), (188, 400))) == [(20, 180), (188, 400)]
    assert columns_of(spark, page((20, 180), (300, 330))) == [(20, 180)]
    assert columns_of(spark, page()) == []
    # A speck in a gutter, up to a twentieth of the page, does not part it; a slip may reach the page's edge.
    assert columns_of(spark, page((0, 180), (210, 230), (260, 600))) == [(0, 180), (260, 600)]
    # Ink in the margin above and below does not count.
    margin = page((20, 180))
    margin[:10, 200:500] = 0
    assert columns_of(spark, margin) == [(20, 180)]


def test_pale_slips_are_found_by_their_rules(spark):
    grey = page((20, 180))
    for y in (50, 90, 130):
        grey[y : y + 2, 300:500] = 205
    assert columns_of(spark, grey) == [(20, 180), (300, 500)]
    cover = slips.rules_across(grey[12:188])
    assert set(cover[300:500]) == {6} and not cover[200:300].any() and not cover[500:].any()
    assert not slips.rules_across(grey[:8]).any()


def test_reduced_images_and_png():
    import struct
    import zlib

    assert slips.fitted(np.full((1536, 2000), 7, np.uint8)).shape == (768, 1000) and slips.fitted(page()).shape == (200, 600)
    board = np.kron(np.array([[0, 200], [100, 50]], np.uint8), np.ones((800, 800), np.uint8))
    small = slips.fitted(board, 2)
    assert small.tolist() == [[0, 200], [100, 50]]
    made = slips.png(small)
    assert made[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", made[16:24]) == (2, 2)
    at = made.index(b"IDAT") + 4
    assert zlib.decompress(made[at : at + struct.unpack(">I", made[at - 8 : at - 4])[0]]) == bytes([0, 0, 200, 0, 100, 50])


def test_pages_and_texts_by_injected_readers(spark):
    files = xlsx.uploads(spark, [("a.pdf", b"%PDF-2"), ("b.txt", b"x"), ("c.png", b"img"), ("d.pdf", b"%PDF-0"), ("e.png", b"")])

    def reader(content, name, dpi):
        assert dpi == 200
        for _ in range(int(content[-1:]) if content[:5] == b"%PDF-" else 1):
            yield np.full((20, 30), 9, np.uint8)

    got = sorted((r.source_file, r.page, r.width, r.error) for r in slips.pages(files, reader).collect())
    assert got == [("a.pdf", 1, 30, None), ("a.pdf", 2, 30, None), ("b.txt", 1, 0, "b.txt: neither a PDF nor an image"), ("c.png", 1, 30, None), ("d.pdf", 1, 0, "d.pdf: the file has no pages"), ("e.png", 1, 0, "e.png: the file is empty")]
    assert {r.source_file: r.n_pages for r in slips.page_counts(files, lambda c, n: int(c[-1:])).collect()} == {"a.pdf": 2, "b.txt": None, "c.png": 1, "d.pdf": 0, "e.png": None}
    found = {r.file_name: (r.text, r.error) for r in slips.texts(files, lambda c: c.decode().strip("x")).collect()}
    assert found["a.pdf"] == ("%PDF-2", None) and found["b.txt"] == ("", "no text")


def test_uploads_of_any_kind(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes(b"path")
    with open(tmp_path / "p.bin", "rb") as handle:
        handle.seek(2)
        rows = xlsx.uploads(spark, [b"raw", bytearray(b"array"), ("n", io.BytesIO(b"value")), handle, str(tmp_path / "p.bin")]).collect()
        assert handle.tell() == 2
    assert [bytes(r.content) for r in rows] == [b"raw", b"array", b"value", b"th", b"path"] and rows[2].path == "n"


def test_files_are_used_whole_or_not_at_all(spark):
    head = ["Data", "Vendedor", "Base Comissão"]
    good, bad, none = workbook([head, ["02/07/2026", "ana", "1,00"], [None, None, "9"]]), workbook([head, ["02/07/2026", "ana", "1,00"], *[["x", "b", "1"]] * 6, ["02/07/2026", None, "1"]]), workbook([head, [None, None, "1"]])
    files = xlsx.uploads(spark, [("good", good), ("bad", bad), ("none", none)])
    raw = xlsx.read_xlsx(spark, files, *xlsx.LEDGER)
    lines = xlsx.ledger_lines(raw)
    kept, errors = xlsx.whole_files(lines)
    assert {r.source for r in kept.collect()} == {"good"}
    told = {r.source: r.errors for r in errors.collect()}
    assert told["bad"].count("the date cannot be read") == 5 and told["bad"].endswith("(+2)")
    assert [tuple(r) for r in xlsx.without_records(files, lines).collect()] == [("none", "the file has no records")]
    hints = {r.source: r.text for r in xlsx.hints(raw, ["date", "seller"], cap=3).collect()}
    assert hints["good"] == "02/07/2026 ana" and hints["bad"] == "02/07/2026 ana x b"


def test_sheets_come_in_the_order_of_the_workbook():
    body = lambda text: f'<worksheet xmlns="{xlsx.NS[1:-1]}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{text}</t></is></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in (1, 2, 3, 4):
            z.writestr(f"xl/worksheets/sheet{k}.xml", body(f"s{k}"))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{xlsx.NS[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="9" r:id="x"/><sheet name="b" sheetId="2" r:id="y"/><sheet name="c" sheetId="3" r:id="z"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x" Target="worksheets/sheet3.xml"/><Relationship Id="y" Target="/xl/worksheets/sheet1.xml"/><Relationship Id="z" Target="worksheets/sheet4.xml"/></Relationships>')
    assert [rows[0][0] for rows in xlsx.sheets(out.getvalue())] == ["s3", "s1", "s4", "s2"]
    found = xlsx.records(out.getvalue(), {"f": ["s4", "s1"]}, {})
    assert found == []  # the header of the second sheet shown, not of the first by number


def test_transcription_and_cache(spark, tmp_path):
    grey = page((20, 180), (220, 400))
    pages = spark.createDataFrame([("h", "f.pdf", 1, 600, 200, bytearray(grey.tobytes()), slips.empty_runs(grey))], "hash string, source_file string, page int, width int, height int, pixels binary, empty array<struct<lo int, hi int>>")

    def client(pixels, name):
        if name.endswith("b2"):
            raise slips.Transient("busy", after_ms=1)
        return json.dumps({"numero": name})

    cut = slips.cut_pages(pages)
    done = slips.transcribed(cut, client, 2, sleep=lambda s: None).cache()
    got = {r.position: r for r in done.collect()}
    assert json.loads(got[1].payload)["numero"] == "f.pdf#p1b1" and got[1].attempts == 1
    assert got[2].error == "busy" and got[2].attempts == 3
    path = f"{tmp_path}/cache"
    slips.append_cache(done, path, "v1")
    slips.append_cache(done, path, "v1")
    assert slips.cached(spark, path, "v1").count() == 1 and slips.cached(spark, path, "v2").count() == 0 and slips.cache_size(spark, path) == 1
    marks = f"{tmp_path}/marks"
    slips.mark_complete(spark.createDataFrame([("h", 2), ("g", 1)], "hash string, slips int"), marks, "v1")
    assert slips.complete_entries(spark, path, marks, "v1").count() == 0
    slips.mark_complete(spark.createDataFrame([("h", 1)], "hash string, slips int"), marks, "v1")
    assert [r.position for r in slips.complete_entries(spark, path, marks, "v1").collect()] == [1]
    # Forgetting one file touches the files of its bucket only.
    many = spark.createDataFrame([(f"h{k}", 1, 1, f"{k}", None) for k in range(200)], "hash string, page int, position int, payload string, error string")
    slips.append_cache(many, path, "v1")
    slips.append_cache(many, path, "v2")
    stamps = lambda: {f: f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("*.parquet")}
    before = stamps()
    slips.forget(spark, path, ["h", "h7", "nobody"], f"{tmp_path}/scratch")
    after = stamps()
    assert slips.cache_size(spark, path) == 199 and slips.cached(spark, path, "v2").count() == 199
    changed = {f.parent.parent.name for f in set(before) ^ set(after)}
    assert len(changed) <= 2 and all(after[f] == t for f, t in before.items() if f in after)
    slips.forget(spark, path, [f"h{k}" for k in range(200)], f"{tmp_path}/scratch")
    assert slips.cache_size(spark, path) == 0
    slips.append_cache(done, path, "v1")
    slips.clear(spark, path)
    assert slips.cache_size(spark, path) == 0


def test_stream_is_taken_in_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"hash": "h", "page": 1, "position": k, "body": json.dumps({"boleta": {"numero": str(k)}} if k else {"error": "timeout"})} for k in range(3)]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    places = [str(tmp_path / p) for p in ("in", "cache", "failures", "checkpoint")]
    ingest.start(spark, *places, version="v1").awaitTermination(120)
    assert slips.cached(spark, places[1], "v1").count() == 2
    (source / "b.json").write_text("\n".join(map(json.dumps, [*rows[1:], {**rows[0], "body": json.dumps([{"numero": "0"}])}])))
    ingest.start(spark, *places, version="v1").awaitTermination(120)
    assert spark.read.parquet(places[1]).count() == 3 and spark.read.parquet(places[2]).count() == 1


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    """The last batch fails after each of its writes and is repeated by the next start."""
    source = tmp_path / "in"
    source.mkdir()
    places = [str(tmp_path / p) for p in ("in", "cache", "failures", "checkpoint")]
    for k in range(2):
        rows = [{"hash": f"h{k}", "page": 1, "position": p, "body": json.dumps({"numero": "1"} if p else {"error": "timeout"})} for p in range(3)]
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))

        def fail(batch, number):
            raise RuntimeError("after the writes")

        query = ingest.start(spark, *places, version="v1", each=fail)
        with pytest.raises(Exception):  # noqa: B017
            query.awaitTermination(120)
        ingest.start(spark, *places, version="v1").awaitTermination(120)
        assert spark.read.parquet(places[1]).count() == 2 * (k + 1) and spark.read.parquet(places[2]).count() == k + 1


def test_report(spark):
    days = spark.createDataFrame([(date(2026, 9, 1), 100, 10, 5, 85, 85, 0, "OK"), (date(2026, 9, 2), 50, None, None, None, 20, None, "PENDING")], "date date, ledger_cents bigint, pix_cents bigint, cash_cents bigint, expected_card_cents bigint, acquirer_cents bigint, difference_cents bigint, status string")
    table = report.daily_table(days)
    assert [r.date for r in table.collect()] == ["01/09/2026", "02/09/2026", "TOTAL"]
    text = report.markdown("Report", [("Days", table)])
    assert "| TOTAL | 1,50 |" in text
    made = report.pdf("Report", [("Days", table)] * 30)
    assert made.startswith(b"%PDF") and b"page 2 of" in made
    long = spark.createDataFrame([("x", "word " * 60 + "(end)")], "a string, b string")
    assert b"\\(end\\)" in report.pdf("Report", [("Long", long)])
    many = spark.range(1000, numPartitions=7).select(F.col("id").cast("string").alias("text"))
    assert [(r.page, r.line, r.text) for r in report.paged(many.orderBy(F.desc(F.col("text").cast("int"))), 60).orderBy("page", "line").collect()] == [(k // 60 + 1, k % 60 + 1, str(999 - k)) for k in range(1000)]
    assert [r.text for r in report.wrapped(spark.createDataFrame([("abcdefg",), ("",), ("abc",)], "text string"), 3).collect()] == ["abc", "def", "g", "", "abc"]
    wide = spark.createDataFrame([(date(2026, 9, 1), *range(7))], "date date, " + ", ".join(f"s{i} bigint" for i in range(7)))
    assert [len(b.columns) for b in report.seller_blocks(wide, [f"s{i}" for i in range(7)])] == [6, 3]


def test_gate(spark):
    empty = spark.createDataFrame([], "date date")
    found = validate.findings(empty, empty, spark.createDataFrame([], "company string, date date"), date(2026, 1, 1), date(2026, 1, 2), "A")
    with pytest.raises(ValueError, match="EMPTY_SOURCE"):
        validate.gate(found)


def test_stream_states_and_cancel(spark, tmp_path):
    places = [str(tmp_path / p) for p in ("in", "cache", "failures", "checkpoint")]
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"hash": "h", "page": k, "position": 1, "body": json.dumps({"numero": str(k)})}))
    seen = []

    def stop(batch, number):
        (query,) = [q for n, q in ingest.running(spark).items() if n == "job"]
        seen.append(ingest.state(query))
        if number == 1:
            ingest.cancel(query)

    query = ingest.start(spark, *places, version="v1", files_at_once=1, name="job", each=stop)
    query.awaitTermination(120)
    assert ingest.state(query) == "cancelled" and "job" not in ingest.running(spark) and set(seen) <= {"preparing", "reading"}
    kept = spark.read.parquet(places[1]).count()
    assert 1 <= kept <= 3
    query = ingest.start(spark, *places, version="v1", files_at_once=1, name="job")
    query.awaitTermination(120)
    assert ingest.state(query) == "done" and spark.read.parquet(places[1]).count() == 4

    def fail(batch, number):
        raise RuntimeError("no")

    (tmp_path / "in" / "9.json").write_text("{}")
    query = ingest.start(spark, *places, version="v1", each=fail)
    with pytest.raises(Exception):  # noqa: B017
        query.awaitTermination(120)
    assert ingest.state(query) == "failed"
