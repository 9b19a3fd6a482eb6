"""The reconciliation's inputs, derived from the generic test tables by rules that make every branch occur.

Each view is one SELECT that Spark and DuckDB both read; {name} stands for a test table.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession

START, END = date(1995, 2, 1), date(2001, 7, 15)
SELLERS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

def amount(cents: str) -> str:
    """SQL of an amount as a person writes it."""
    return f"concat(CASE WHEN {cents} < 0 THEN '-' ELSE '' END, CAST(CAST(floor(abs({cents}) / 100) AS BIGINT) AS STRING), ',', lpad(CAST(abs({cents}) % 100 AS STRING), 2, '0'))"


def entry(code: str, cents: str) -> str:
    """SQL of a slip's JSON entry; braces are spelled as characters, since they mark tables here."""
    return f"""concat(chr(123), '"codigo":"', {code}, '","valor":"', {amount(cents)}, '","manuscrito":false', chr(125))"""


def local(day: str, sep: str) -> str:
    return f"concat(lpad(CAST(day({day}) AS STRING), 2, '0'), '{sep}', lpad(CAST(month({day}) AS STRING), 2, '0'), '{sep}', CAST(year({day}) AS STRING))"


def written() -> str:
    """SQL of the date on a slip, in three spellings."""
    return f"CASE k % 3 WHEN 0 THEN CAST(shown AS STRING) WHEN 1 THEN {local('shown', '/')} ELSE {local('shown', '-')} END"


VIEWS = {
    "b_orders": """
        SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS st, o_custkey,
               CAST(round(CAST(o_totalprice AS DECIMAL(18,4)) * 100) AS BIGINT) AS cents FROM {orders}""",
    "b_ledger_day": "SELECT d AS date, c_mktsegment AS seller, cents FROM b_orders JOIN {customer} ON o_custkey = c_custkey",
    "b_acquirer": """
        SELECT k AS seq,
               CASE WHEN st = 'P' AND k % 50 = 1 THEN CAST(d + INTERVAL '1' DAY AS DATE)
                    WHEN st = 'P' AND k % 50 = 2 THEN CAST(d - INTERVAL '1' DAY AS DATE) ELSE d END AS date,
               CASE WHEN st = 'F' THEN 'pago' WHEN k % 50 = 0 THEN 'negada' ELSE 'aprovada' END AS status,
               CASE WHEN st = 'F' THEN 'pix' WHEN k % 2 = 0 THEN 'credito' ELSE 'debito' END AS modality,
               cents, k % 77 = 0 AS cancelled, CASE WHEN k % 154 = 0 THEN cents - 100 END AS cancelled_cents
        FROM b_orders WHERE st = 'P' OR (st = 'F' AND k % 40 <> 0)""",
    "b_closing": """
        SELECT 'A' AS company, d AS date,
               CAST(sum(CASE WHEN st = 'F' THEN cents ELSE 0 END) AS BIGINT) AS pix_cents,
               CAST(sum(CASE WHEN st = 'O' THEN cents ELSE 0 END) AS BIGINT) AS cash_cents,
               CAST(sum(cents) AS BIGINT) AS store_total_cents
        FROM b_orders WHERE day(d) % 7 <> 0 GROUP BY d""",
    "b_closing_file": """
        SELECT 0 AS seq, concat('a-', CAST(date AS STRING)) AS file_name, company, date, pix_cents, cash_cents, store_total_cents FROM b_closing
        UNION ALL SELECT 1 AS seq, concat('b-', CAST(date AS STRING)) AS file_name, company, date, pix_cents, cash_cents, store_total_cents FROM b_closing WHERE day(date) % 5 = 0
        UNION ALL SELECT 2 AS seq, concat('c-', CAST(date AS STRING)) AS file_name, company, date, pix_cents + 1 AS pix_cents, cash_cents, store_total_cents FROM b_closing WHERE day(date) % 11 = 0""",
    "b_closing_two": """
        SELECT company, date, pix_cents, cash_cents, store_total_cents FROM b_closing
        UNION ALL SELECT 'B' AS company, date, cash_cents AS pix_cents, pix_cents AS cash_cents, store_total_cents FROM b_closing WHERE day(date) % 9 = 0""",
    "b_company": """
        SELECT * FROM (VALUES ('North', 'AUTOMOBILE', 'Autómobile  Norte', '00001'), ('South', 'BUILDING', 'building', '00002'), ('East', 'FURNITURE', 'FÚRNITURE', '00003'))
        AS t(company, segment, alias, code)""",
    "b_source_code": "SELECT concat('file-', CAST(c_nationkey AS STRING)) AS source, concat('fil.', CAST(c_custkey % 5 AS STRING)) AS raw FROM {customer}",
    "b_source_text": "SELECT c_custkey AS source, concat('  Relatório  da ', c_mktsegment, ' Çidade') AS text FROM {customer}",
    "b_line": """
        SELECT o.k, o.d AS date, l_partkey, l_linenumber, l_returnflag, l_suppkey, l_quantity,
               CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)) * 100) AS BIGINT) AS gross,
               CAST(round(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) * 100) AS BIGINT) AS net
        FROM {lineitem} JOIN b_orders o ON l_orderkey = o.k""",
    # Orders as sales; the place of a line within its order makes seq, so no order over all lines is needed.
    "b_ledger": """
        SELECT k, k * 1000 + row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey, gross, net, l_quantity) AS seq,
               date, concat('S', CAST(k % 5 AS STRING)) AS seller, CAST(k AS STRING) AS sale_number,
               CAST(1000000000 + (l_partkey * 2654435761) % 9000000000 AS STRING) AS code,
               CASE WHEN l_returnflag = 'R' THEN -gross ELSE gross END AS gross_cents, CASE WHEN k % 3 = 0 THEN NULL ELSE net END AS net_cents,
               CAST(1 + l_linenumber % 3 AS INT) AS quantity, concat('P', CAST(l_partkey AS STRING)) AS product
        FROM b_line""",
    # What the cross-check looks at: every 97th sale was never booked, so its slip has none.
    "b_booked": "SELECT * FROM b_ledger WHERE k % 97 <> 0",
    "b_piece": """
        SELECT k, date, seller, seq * 4 + n AS ord, code, abs(gross_cents) AS cents, gross_cents < 0 AS back, abs(coalesce(net_cents, gross_cents)) AS paid,
               row_number() OVER (PARTITION BY k, gross_cents < 0 ORDER BY seq, n) AS pos
        FROM b_ledger JOIN (VALUES (1), (2), (3)) AS q(n) ON n <= quantity WHERE k % 20 <> 0""",
    # Noise by k % 20: 1 a digit, 2 a swap, 3 an amount, 4 an amount and the total, 5 no total, 6 the next day, 7 returns as items, 8 the piece count,
    # 9 a percent discount, 10 other codes and amounts and no control number, so that the total alone is right.
    "b_slip_piece": """
        SELECT k, date, seller, ord, cents AS own_cents, back AS own_back, paid,
               CASE WHEN pos = 1 AND NOT back AND k % 20 = 1 THEN concat(substr(code, 1, 4), CAST((CAST(substr(code, 5, 1) AS INT) + 1) % 10 AS STRING), substr(code, 6))
                    WHEN pos = 1 AND NOT back AND k % 20 = 2 THEN concat(substr(code, 1, 3), substr(code, 5, 1), substr(code, 4, 1), substr(code, 6))
                    WHEN k % 20 = 10 THEN CAST(9999999999 - CAST(code AS BIGINT) AS STRING) ELSE code END AS code,
               cents + CASE WHEN pos = 1 AND NOT back AND k % 20 IN (3, 4) THEN 100 WHEN NOT back AND k % 20 = 10 THEN 13 ELSE 0 END AS cents, back AND k % 20 <> 7 AS back
        FROM b_piece""",
    "b_slip_sum": f"""
        SELECT k, date, seller, CAST(sum(CASE WHEN back THEN 0 ELSE 1 END) AS BIGINT) AS n_items, CAST(sum(CASE WHEN back THEN 1 ELSE 0 END) AS BIGINT) AS n_returns,
               CAST(sum(CASE WHEN back THEN 0 ELSE cents END) AS BIGINT) AS items_cents, CAST(sum(CASE WHEN back THEN cents ELSE 0 END) AS BIGINT) AS returns_cents,
               CAST(sum(CASE WHEN own_back THEN 0 ELSE own_cents END) AS BIGINT) AS own_cents, CAST(sum(CASE WHEN own_back THEN -paid ELSE paid END) AS BIGINT) AS net,
               listagg(CASE WHEN NOT back THEN concat(code, ':', CAST(cents AS STRING)) END, ',') WITHIN GROUP (ORDER BY ord) AS items_text,
               listagg(CASE WHEN back THEN concat(code, ':', CAST(cents AS STRING)) END, ',') WITHIN GROUP (ORDER BY ord) AS returns_text,
               listagg(CASE WHEN NOT back THEN {entry("code", "cents")} END, ',') WITHIN GROUP (ORDER BY ord) AS items_json,
               listagg(CASE WHEN back THEN {entry("code", "cents")} END, ',') WITHIN GROUP (ORDER BY ord) AS returns_json
        FROM b_slip_piece GROUP BY k, date, seller""",
    "b_slip_fact": f"""
        SELECT *, CASE WHEN k % 20 = 7 THEN items_cents ELSE own_cents END AS sub_total_cents,
               CASE WHEN k % 20 = 9 THEN CAST(round(CAST(own_cents AS DECIMAL(18,4)) * 125 / 1000) AS BIGINT) ELSE own_cents - net END AS discount_cents,
               CASE WHEN k % 20 = 5 THEN NULL WHEN k % 20 = 4 THEN net + 500 WHEN k % 20 = 9 THEN own_cents - CAST(round(CAST(own_cents AS DECIMAL(18,4)) * 125 / 1000) AS BIGINT) ELSE net END AS total_cents,
               n_items + CASE WHEN k % 20 = 8 THEN 1 ELSE 0 END AS pieces, right(CAST(k AS STRING), 3) AS control,
               CASE WHEN k % 20 = 6 THEN CAST(date + INTERVAL '1' DAY AS DATE) ELSE date END AS shown,
               CASE WHEN k % 31 = 0 THEN {local("date", ".")} ELSE replace(CAST(date AS STRING), '-', '') END AS file
        FROM b_slip_sum""",
    "b_slip": f"""
        SELECT k AS seq, concat('scan ', file, '.pdf') AS source_file, 1 AS page, CAST(k AS INT) AS position, concat(chr(123),
               '"numero":"', CAST(k AS STRING), '","numero_controle":', CASE WHEN k % 20 = 10 THEN 'null' ELSE concat('"', control, '"') END,
               ',"data":"', {written()}, '","vendedora":', CASE WHEN k % 13 = 0 THEN 'null' ELSE concat('"José  ', seller, '"') END,
               ',"itens":[', coalesce(items_json, ''), '],"trocas":[', coalesce(returns_json, ''), '],"sub_total":"', {amount("sub_total_cents")},
               '","desconto":"', CASE WHEN k % 20 = 9 THEN '12,5%' ELSE {amount("discount_cents")} END, '","total":', CASE WHEN total_cents IS NULL THEN 'null' ELSE concat('"', {amount("total_cents")}, '"') END,
               ',"num_pecas":', CAST(pieces AS STRING), ',"pagamento":"', CASE k % 4 WHEN 0 THEN 'PIX' WHEN 1 THEN 'Cartão de Crédito' WHEN 2 THEN 'espécie' ELSE 'xyz' END,
               '","brinde":', CASE WHEN k % 6 = 0 THEN 'true' ELSE 'false' END, ',"whats":', CASE WHEN k % 6 = 0 THEN 'true' ELSE 'false' END,
               ',"campos_ilegiveis":[', CASE WHEN k % 19 = 0 THEN '"total"' ELSE '' END, ']', chr(125)) AS payload
        FROM b_slip_fact""",
    "b_edit": f"""
        SELECT concat('scan ', file, '.pdf#p1b', CAST(k AS STRING)) AS image_id, concat('E', CAST(k AS STRING)) AS numero, CAST(NULL AS STRING) AS numero_controle, {written()} AS data,
               'ana' AS vendedora, CAST(NULL AS STRING) AS sub_total, '-' AS desconto, '123,45' AS total, '2' AS num_pecas, 'pix' AS pagamento, CAST(NULL AS STRING) AS parcelas
        FROM b_slip_fact WHERE k % 10 = 3""",
    "b_code_pair": """
        SELECT seq AS k, code AS a, CASE seq % 4 WHEN 0 THEN code WHEN 2 THEN concat(substr(code, 1, 3), substr(code, 5, 1), substr(code, 4, 1), substr(code, 6))
               WHEN 1 THEN concat(substr(code, 1, 6), CAST((CAST(substr(code, 7, 1) AS INT) + 1) % 10 AS STRING), substr(code, 8))
               ELSE concat(substr(code, 1, 1), CAST((CAST(substr(code, 2, 1) AS INT) + 1) % 10 AS STRING), substr(code, 3, 5), CAST((CAST(substr(code, 8, 1) AS INT) + 1) % 10 AS STRING), substr(code, 9)) END AS b
        FROM b_ledger""",
    "b_control": """
        SELECT k, CAST(k AS STRING) AS sale_number, CASE k % 6 WHEN 0 THEN right(CAST(k AS STRING), 3) WHEN 1 THEN concat(right(CAST(k AS STRING), 3), '2') WHEN 2 THEN '5' WHEN 3 THEN ''
               WHEN 4 THEN concat('0', right(CAST(k AS STRING), 2)) ELSE concat('n. ', right(CAST(k + 1 AS STRING), 2)) END AS control_no
        FROM b_orders""",
    "b_money": f"""
        SELECT k, cents, CASE WHEN k % 2 = 0 THEN cents ELSE -cents END AS signed, CASE k % 9
               WHEN 0 THEN concat('R$ ', {amount("cents")}) WHEN 1 THEN concat(CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING), '.', lpad(CAST(cents % 100 AS STRING), 2, '0'))
               WHEN 2 THEN concat('(', {amount("cents")}, ')') WHEN 3 THEN '--' WHEN 4 THEN 'abc' WHEN 6 THEN '' WHEN 7 THEN concat('-', {amount("cents")})
               WHEN 5 THEN concat(CAST(CAST(floor(cents / 100000) AS BIGINT) AS STRING), '.', lpad(CAST(CAST(floor(cents / 100) AS BIGINT) % 1000 AS STRING), 3, '0'), ',', lpad(CAST(cents % 100 AS STRING), 2, '0'))
               ELSE CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING) END AS written FROM b_orders""",
    "b_date": f"""
        SELECT k, d, CASE k % 6 WHEN 0 THEN CAST(d AS STRING) WHEN 1 THEN {local("d", "/")} WHEN 2 THEN concat({local("d", "-")}, ' 10:30') WHEN 3 THEN concat(CAST(d AS STRING), 'T00:00:00')
               WHEN 4 THEN CAST(datediff(d, DATE '1899-12-30') AS STRING) ELSE 'no date' END AS written FROM b_orders""",
    "b_text": """
        SELECT c_custkey AS k, concat('  ', c_name, ' Ção  é ', c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN ' Ñandú' ELSE '' END) AS t,
               concat('00', CAST(c_custkey AS STRING), '-', CAST(c_nationkey AS STRING)) AS bar FROM {customer}""",
    "b_response": """
        SELECT k, CASE k % 5 WHEN 0 THEN concat(chr(123), '"numero":"', CAST(k AS STRING), '"', chr(125)) WHEN 1 THEN concat(chr(123), '"boleta":', chr(123), '"numero":"', CAST(k AS STRING), '"', chr(125), chr(125))
               WHEN 2 THEN concat('[', chr(123), '"boleta":', chr(123), '"numero":"', CAST(k AS STRING), '"', chr(125), chr(125), ']') WHEN 3 THEN concat(chr(123), '"error":"rate limit reached"', chr(125))
               ELSE concat('[', chr(123), '"error":"bad image"', chr(125), ']') END AS body FROM b_orders""",
    "b_retry": "SELECT k, CASE k % 3 WHEN 0 THEN concat('try again in ', CAST(k % 900 AS STRING), 'ms') WHEN 1 THEN concat('Retry after ', CAST(k % 60 AS STRING), ' s please') ELSE 'no hint' END AS message FROM b_orders",
    "b_stream": "SELECT concat('h', CAST(k % 97 AS STRING)) AS hash, CAST(k AS INT) AS page, CAST(k % 3 AS INT) AS position, body FROM b_response",
    "b_job": """
        SELECT k AS job, CAST(k % 9 AS INT) AS pages, CAST(k % 7 AS INT) AS pages_done, CAST(k % 7 * (1 + k % 4) AS INT) AS found,
               CAST(k % 11 AS INT) AS done, CAST(k % 2 AS INT) AS failed, k % 13 = 0 AS finished, cents % 20000 AS seconds FROM b_orders""",
    "b_hint": "SELECT c_nationkey AS source, c_custkey AS row_no, CAST(1 + c_custkey % 4 AS INT) AS n FROM {customer}",
    # Neighbouring lines of an order: codes that have nothing in common, cut to several lengths, and moved by a place.
    "b_code_any": """
        SELECT l.seq AS k, substr(l.code, 1 + CAST(l.seq % 3 AS INT), 10 - CAST(l.k % 4 AS INT)) AS a,
               CASE WHEN l.seq % 5 = 0 THEN concat(substr(l.code, 3, 1), substr(l.code, 2, 1), substr(l.code, 1, 1), substr(l.code, 5)) ELSE r.code END AS b
        FROM b_ledger l JOIN b_ledger r ON r.seq = l.seq + 1""",
    "b_slot": "SELECT concat('h', CAST(doc_id % 97 AS STRING)) AS hash, CAST(doc_id AS INT) AS page, CAST(doc_id % 3 AS INT) AS position FROM {documents}",
    "b_cache": """
        SELECT concat('h', CAST(doc_id % 97 AS STRING)) AS hash, CAST(doc_id AS INT) AS page, CAST(doc_id % 3 AS INT) AS position, CASE WHEN doc_id % 11 = 0 THEN 'v1' ELSE 'v2' END AS render_version
        FROM {documents} WHERE doc_id % 97 % 2 = 0 OR doc_id % 5 <> 0""",
    # Stretches of columns with ink, from lo up to hi, on pages of 450 columns.
    "b_band": "SELECT user_id AS page, CAST(event_id * 37 % 400 AS INT) AS lo, CAST(event_id * 37 % 400 + 5 + event_id % 45 AS INT) AS hi FROM {events} WHERE event_id % 7 = 0",
}


def names_in(sql: str) -> list[str]:
    """The views that the statement needs, each after those that it needs itself."""
    found: list[str] = []
    for name in re.findall(r"\bb_\w+", sql):
        if name in VIEWS and name not in found:
            found += [n for n in [*names_in(VIEWS[name]), name] if n not in found]
    return found


def with_views(sql: str) -> str:
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names_in(sql))
    return f"WITH {views} {sql}" if views else sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = with_views(f"SELECT * FROM {name}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def for_duckdb(sql: str) -> str:
    """The statement over the test tables in DuckDB, which spells two functions otherwise."""
    plain = re.sub(r"\{(orders|customer|lineitem|events|documents)\}", r"\1", with_views(sql))
    plain = plain.replace("datediff(d, DATE '1899-12-30')", "date_diff('day', DATE '1899-12-30', d)")
    return re.sub(r"listagg\(((?:(?!listagg).)*?), ','\) WITHIN GROUP \(ORDER BY (\w+)\)", r"string_agg(\1, ',' ORDER BY \2)", plain)
