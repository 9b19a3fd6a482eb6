"""Spreadsheets of ledgers and acquirers, read by the tasks from files that Spark lists.
fields is JSON: {"required": {field: [aliases]}, "optional": {field: [aliases]}}. The first row of any sheet whose
headers (normalised) cover the required fields is the header; each field takes the first column that has one of its
aliases. Every cell is text; numbers keep their plain form and dates their serial, so nothing is guessed here.
Files are read by the tasks through Spark (binaryFile), one row of content each.
"""

from __future__ import annotations

import io
import json
import os
import posixpath
import re
import unicodedata
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.job import within_cap

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def identifier(text: str | None) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "_", plain.lower()).strip("_")


def column_of(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_files(z: zipfile.ZipFile) -> list[str]:
    """The files of the sheets in the order in which the workbook shows them; by number where it does not say, and those that it does
    not name last."""
    names = z.namelist()
    files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
        return files
    targets = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target") or "")).lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    shown = [targets.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), None)) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{NS}sheet")]
    first = [f for f in dict.fromkeys(shown) if f in names]
    return first + [f for f in files if f not in first]


def sheets(content: bytes) -> Iterator[list[list[str | None]]]:
    """The rows of each sheet, in the order of the workbook; a sheet is parsed when it is asked for."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{NS}si")]
        for name in sheet_files(z):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{NS}row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.iter(f"{NS}c")):
                    value, inline = c.find(f"{NS}v"), c.find(f"{NS}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{NS}t")) if inline is not None else value.text if value is not None else None
                    if text is not None and c.get("t") == "s":
                        text = shared[int(text)]
                    if text is not None:
                        cells[column_of(c.get("r")) if c.get("r") else k] = text
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            yield rows


def records(content: bytes, required: dict[str, list[str]], optional: dict[str, list[str]]) -> list[dict[str, str | None]]:
    """The non-blank rows below the header. Raises ValueError where no sheet has the header."""
    aliases = {field: {identifier(a) for a in names} for field, names in {**required, **optional}.items()}
    for rows in sheets(content):
        for at, row in enumerate(rows):
            heads = [identifier(c) for c in row]
            places = {f: next((i for i, h in enumerate(heads) if h in names), None) for f, names in aliases.items()}
            if all(places[f] is not None for f in required):
                get = lambda cells, i: cells[i] if i is not None and i < len(cells) else None
                return [{f: get(cells, i) for f, i in places.items()} for cells in rows[at + 1 :] if any((c or "").strip() for c in cells)]
    raise ValueError("no sheet has the columns " + ", ".join(required))


def read_xlsx(spark: SparkSession, path: str | DataFrame, required: dict[str, list[str]], optional: dict[str, list[str]] | None = None) -> DataFrame:
    """source, row_no, error and the fields as text; a file that cannot be read is one row with its error."""
    fields = [*required, *(optional or {})]
    spec = json.dumps([required, optional or {}])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        needed, extra = json.loads(spec)
        for files in batches:
            for file in files.itertuples():
                try:
                    found = [{"source": file.path, "row_no": k, "error": None, **r} for k, r in enumerate(records(bytes(file.content), needed, extra))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    found = [{"source": file.path, "row_no": None, "error": str(e)[:300], **dict.fromkeys(fields)}]
                yield pd.DataFrame(found, columns=["source", "row_no", "error", *fields]).astype({"row_no": "Int64"})

    schema = "source string, row_no bigint, error string, " + ", ".join(f"`{f}` string" for f in fields)
    files = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(parse, schema)


def uploads(spark: SparkSession, sources: Sequence[object]) -> DataFrame:
    """path, content of what a caller holds: (name, bytes-like or file-like) pairs, file-like objects, or paths. An object with
    `getvalue` gives all it has; another is read from where it stands and put back there. For uploads, few and small by nature."""
    rows = []
    for k, source in enumerate(sources):
        name, body = source if isinstance(source, tuple) else (getattr(source, "name", None), source)
        if isinstance(body, (str, os.PathLike)):
            files = spark.read.format("binaryFile").load(os.fspath(body)).select("path", "content").collect()
            rows += [(name or f.path, bytes(f.content)) for f in files]
            continue
        if isinstance(body, (bytes, bytearray, memoryview)):
            content = bytes(body)
        elif hasattr(body, "getvalue"):
            content = body.getvalue()
        else:
            at = body.tell() if hasattr(body, "tell") else None
            content = body.read()
            if at is not None:
                body.seek(at)
        rows.append((str(name or f"upload-{k}"), bytes(content)))
    return spark.createDataFrame(rows, "path string, content binary")


#: Header aliases of ledger and acquirer exports.
LEDGER = ({"date": ["data", "data_venda", "date"], "seller": ["vendedor", "vendedora", "nome_vendedor", "seller"], "commission_base": ["base_comissao", "valor_comissao", "commission_base"]},
          {"branch": ["filial", "branch"], "code": ["codigo", "cod_barras", "code"], "gross": ["valor_bruto", "preco", "gross"], "net": ["valor", "valor_liquido", "net"], "sale_number": ["nrovenda", "venda", "sale_number"], "quantity": ["qtde", "quantidade", "quantity"], "product": ["produto", "descricao", "product"]})
ACQUIRER = ({"date": ["data_da_venda", "data", "date"], "status": ["status_da_venda", "status"], "value": ["valor_da_venda", "valor", "value"], "modality": ["modalidade", "modality"]},
            {"tax_id": ["cpf_cnpj", "cnpj", "tax_id"], "establishment": ["nome_do_estabelecimento", "estabelecimento", "establishment"], "cancelled": ["cancelada_pelo_estabelecimento", "cancelled"], "cancelled_value": ["valor_cancelado", "cancelled_value"]})


def ledger_lines(rows: DataFrame) -> DataFrame:
    """Typed ledger lines: date, seller, commission_cents, sale_number, code, gross_cents, net_cents, quantity, product, branch, and error."""
    from ledgerloom.functions.codes import normalize_barcode
    from ledgerloom.functions.dates import parse_date
    from ledgerloom.functions.money import parse_money_cents, slip_money
    from ledgerloom.functions.text import filled

    rows = rows.filter(F.col("error").isNotNull() | filled(F.col("date")).isNotNull() | filled(F.col("seller")).isNotNull())
    day, cents = parse_date(F.col("date")), parse_money_cents(F.col("commission_base"))
    error = F.coalesce("error", F.when(day.isNull(), "the date cannot be read"), F.when(filled(F.col("seller")).isNull(), "no seller"), F.when(cents.isNull(), "the commission base is not money"))
    quantity = F.greatest(F.lit(1), F.coalesce(F.floor(F.col("quantity").try_cast("double")), F.lit(1))).cast("int")
    return rows.select(
        "source", "row_no", day.alias("date"), F.upper(F.trim("seller")).alias("seller"), cents.alias("commission_cents"), filled(F.col("sale_number")).alias("sale_number"), normalize_barcode(F.col("code")).alias("code"),
        parse_money_cents(F.col("gross")).alias("gross_cents"), slip_money(F.col("net")).alias("net_cents"), quantity.alias("quantity"), filled(F.col("product")).alias("product"), "branch", error.alias("error"),
    )


def items_of(lines: DataFrame) -> DataFrame:
    """The lines that describe pieces: with a code and a gross amount that is not zero."""
    return lines.filter("error is null and code <> '' and gross_cents <> 0")


def transactions(rows: DataFrame) -> DataFrame:
    """Typed acquirer transactions: seq, date, status, modality, cents, cancelled, cancelled_cents, tax_id, establishment, and error."""
    from ledgerloom.functions.codes import normalize_tax_id
    from ledgerloom.functions.dates import parse_date
    from ledgerloom.functions.money import parse_money_cents, slip_money
    from ledgerloom.functions.text import normalize_text

    day, cents = parse_date(F.col("date")), parse_money_cents(F.col("value"))
    status, modality = normalize_text(F.col("status")), normalize_text(F.col("modality"))
    error = F.coalesce("error", F.when(day.isNull(), "the date cannot be read"), F.when(cents.isNull(), "the value is not money"), F.when(status == "", "no status"), F.when(modality == "", "no modality"))
    return rows.select(
        "source", F.col("row_no").alias("seq"), day.alias("date"), status.alias("status"), modality.alias("modality"), cents.alias("cents"), normalize_text(F.col("cancelled")).isin("sim", "s", "yes").alias("cancelled"),
        slip_money(F.col("cancelled_value")).alias("cancelled_cents"), normalize_tax_id(F.col("tax_id")).alias("tax_id"), "establishment", error.alias("error"),
    )


def whole_files(lines: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Lines of the files that can be used as a whole, and (source, errors) of the others: one bad line rejects its file,
    as does having no line at all. The files are those that have a row in `lines`, be it their error."""
    bad = first_errors(lines, top)
    good = lines.join(bad.select("source"), "source", "left_anti")
    return good, bad


def without_records(files: DataFrame, lines: DataFrame) -> DataFrame:
    """source, errors of files (path) that gave no line."""
    none = files.select(F.col("path").alias("source")).join(lines.select("source"), "source", "left_anti")
    return none.select("source", F.lit("the file has no records").alias("errors"))


def hints(rows: DataFrame, fields: Sequence[str], cap: int = 100) -> DataFrame:
    """source, text: the texts of a file's first rows, by which its company may be known; no row is added once `cap` texts are there."""
    texts = F.array_compact(F.array(*[F.when(F.trim(F.col(f"`{f}`")) != "", F.col(f"`{f}`")) for f in fields]))
    some = within_cap(rows.select("source", "row_no", texts.alias("texts")).withColumn("n", F.size("texts")), "source", "row_no", "n", cap)
    return some.groupBy("source").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "texts"))), lambda x: x["texts"])), " ").alias("text"))


def first_errors(rows: DataFrame, top: int = 5) -> DataFrame:
    """source, errors: the first five of a file, and how many more there are."""
    such = rows.filter("error is not null")
    from pyspark.sql import Window

    at = "row_no" if "row_no" in rows.columns else "seq"
    ranked = such.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(at))).groupBy("source").agg(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "error")))).alias("e"), F.count("*").alias("n"))
    text = F.array_join(F.transform("e", lambda x: x["error"]), "; ")
    return ranked.select("source", F.when(F.col("n") > top, F.concat(text, F.lit(" (+"), (F.col("n") - top).cast("string"), F.lit(")"))).otherwise(text).alias("errors"))
