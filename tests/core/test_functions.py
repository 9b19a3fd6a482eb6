import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import codes, dates, money, text


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.coalesce(1).orderBy("i").select(make(F.col("v"))).collect()]


def test_money(spark):
    cases = {None: 0, "": 0, "-": 0, "--": 0, "R$": 0, "R$ 1.234,56": 123456, "1,234.56": 123456, "1,234": 123, "1.234": 123, "1.234.567": 123457, "(5,00)": -500, "(-5,00)": 500, "abc": None, "-3,5": -350, "0,005": 1, "7": 700, "1,2,3": 1230, "r$ 9": 900}
    assert column(spark, list(cases), money.parse_money_cents) == list(cases.values())
    assert column(spark, [None, "null", " - ", "x", "1,50"], money.slip_money) == [None, None, None, None, 150]


def test_money_format(spark):
    cases = {0: "0,00", -1: "-0,01", 123456789: "1.234.567,89", -250: "-2,50", None: "0,00"}
    assert column(spark, list(cases), money.format_cents, "bigint") == list(cases.values())


def test_text(spark):
    assert column(spark, [None, "  Ação\t de  CRÉDITO ", "é"], text.normalize_text) == ["", "acao de credito", "e"]
    assert column(spark, ["Nº da Venda!", "__x__"], text.normalize_identifier)[1] == "x"
    assert column(spark, [None, "", "  ", "josé  da silva"], text.normalize_person) == [None, None, None, "JOSE DA SILVA"]
    assert column(spark, ["ﬁle Ⅳ", "Ação"], text.normalize_text_full) == ["file iv", "acao"]


def test_codes(spark):
    assert column(spark, ["12.345-6", None, "1" * 15], codes.normalize_tax_id) == ["00000000123456", "", "1" * 15]
    assert column(spark, ["7", "123456", ""], codes.normalize_branch_code) == ["00007", "123456", ""]
    assert column(spark, ["0001230", "000", "", "a1b2"], codes.normalize_barcode) == ["1230", "000", "", "12"]
    assert column(spark, ["2239377971", ""], codes.ledger_code) == ["0002239377971", "0" * 13]
    assert column(spark, [12.0, 12.5], codes.digits_of_number, "double") == ["12", "125"]


def osa(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_code_distance_matches_a_plain_table(spark):
    rng = random.Random(1)
    pairs = [("ca", "abc"), ("", "12"), ("2293977971", "2239377971")]
    for _ in range(1500):
        a = "".join(rng.choices("0123", k=rng.randrange(11)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            if b:
                k = rng.randrange(len(b))
                b[k : k + rng.randrange(3)] = rng.choices("0123", k=rng.randrange(3))
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", codes.code_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == osa(r.a, r.b) for r in got) and len(got) == len(pairs)
    assert df.limit(1).select(codes.code_distance(F.lit(None).cast("string"), F.lit("ab"))).first()[0] == 2


@pytest.mark.parametrize(("control", "sale", "want"), [("055", "17055", True), ("0552", "17055", True), ("5", "17055", False), ("", "1", False), (None, "1", False), ("0041", "9941", True), ("123", "9941", False)])
def test_control(spark, control, sale, want):
    df = spark.createDataFrame([(control, sale)], "c string, s string")
    assert df.select(codes.control_matches(F.col("c"), F.col("s"))).first()[0] is want


def test_dates(spark):
    cases = {"2026-07-02": date(2026, 7, 2), "02/07/26": date(2026, 7, 2), "2-7-2026 10:00": date(2026, 7, 2), "46205": date(2026, 7, 2), "46205.5": date(2026, 7, 2), "31/02/2026": None, "x": None, "": None, None: None, "20260702": None}
    assert column(spark, list(cases), dates.parse_date) == list(cases.values())


def test_slip_dates(spark):
    start, end = date(2026, 9, 1), date(2026, 9, 27)
    day = date(2026, 9, 22)
    cases = {"22/09": day, "22-9": day, "22.09.2026": day, "22/SET": day, "22 SET. 2026": day, "22 SET": day, "22/set.2026": day, "22 de setembro": day, "22": day, "2026-9-22": day, "22/13": None, "22/xyz": None, "": None, None: None, "30/09": date(2026, 9, 30), "5/9/25": date(2025, 9, 5)}
    assert column(spark, list(cases), lambda c: dates.resolve_slip_date(c, start, end)) == list(cases.values())
    # One mark, or "de" between spaces, on either side of the name, and nothing else.
    strict = {"22--set": None, ".22 set": None, "22,set": None, "22de set": None, "22 de set de 26": None, "22 set..26": day, "22 set...26": None, "22SET2026": day, "22/set, 26": day, "22 set x": None, "22 - set - 2026": day, "22 set 026": None, "22 março!": None, "22//set": None}
    assert column(spark, list(strict), lambda c: dates.resolve_slip_date(c, start, end)) == list(strict.values())
    across = lambda c: dates.resolve_slip_date(c, date(2025, 12, 20), date(2026, 1, 10))
    assert column(spark, ["28/12", "03/01", "15"], across) == [date(2025, 12, 28), date(2026, 1, 3), None]


def test_dates_in_file_names(spark):
    start, end = date(2026, 9, 1), date(2026, 9, 27)
    cases = {"Slips Ana 05.09.pdf": date(2026, 9, 5), "31-02 06-09-26.pdf": date(2026, 9, 6), "05.10.pdf": None, "scan 105.09": None, None: None, "1.2 07_09.pdf": date(2026, 9, 7)}
    assert column(spark, list(cases), lambda c: dates.date_from_filename(c, start, end)) == list(cases.values())
