"""DuckDB SQL of the cross-check, written from its rules: pieces as rows, and what is taken one after another as a fold over a sorted list."""

from __future__ import annotations

#: Fixed values, spelled out here so that a wrong one in the operator shows.
ALIKE, MAX_DAYS, MIN_SCORE, MIN_OTHER_DAY = 2, 3, 7, 15
PIECE_KINDS = ("PIECE_ONLY_SLIP", "PIECE_ONLY_LEDGER", "PIECE_VALUE")
DIVERGENCES = ("SALE_WITHOUT_SLIP", "SLIP_WITHOUT_SALE", "PIECE_ONLY_SLIP", "PIECE_ONLY_LEDGER", "PIECE_VALUE")
NOTES = ("CODE_MISREAD", "READING_ONLY", "OTHER_DAY", "TOTAL_MATCH")


def distances(pairs: str) -> str:
    """a, b and their optimal string alignment distance, for a relation of distinct pairs. The distance table row by row: each step
    makes the next row out of the last two. A cell may also come from its left neighbour, so it is the least, over all
    cells up to it, of what they hold and the steps between."""
    return f"""
    WITH RECURSIVE t(a, b, i, one, two) AS (
        SELECT a, b, 0, range(0, length(b) + 1), range(0, length(b) + 1) FROM {pairs} WHERE a <> b
        UNION ALL
        SELECT a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda m: cells[m + 1] - m)) + j), one
        FROM (SELECT *, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(one[j + 1] + 1, one[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END,
                  CASE WHEN i > 0 AND j > 1 AND a[i + 1] = b[j - 1] AND a[i] = b[j] THEN two[j - 1] + 1 ELSE 99 END) END) AS cells
              FROM t WHERE i < length(a)))
    SELECT a, b, one[length(b) + 1] AS distance FROM t WHERE i = length(a) UNION ALL SELECT a, b, 0 FROM {pairs} WHERE a = b"""


#: Of a sorted list of candidates those taken: each bi and each ci once.
GREEDY = "list_reduce(list({{'b': [bi], 'c': [ci], 't': [{{'d': d, 'side': side, 'bi': bi, 'ci': ci}}]}} ORDER BY d, side, bi, ci), lambda acc, x: CASE WHEN list_contains(acc.b, x.b[1]) OR list_contains(acc.c, x.c[1]) THEN acc ELSE {{'b': acc.b || x.b, 'c': acc.c || x.c, 't': acc.t || x.t}} END).t".format()


def piece_match(n: str, pairs: str) -> str:
    """CTEs over the pairs (slip, sale): matched{n} and alike{n} (slip, sale, distance, side, bi, ci; alike also has `last`), rest_left{n} and rest_right{n}."""
    return f"""
    eq{n} AS MATERIALIZED (SELECT slip, sale, l.bi, r.ci, l.code AS a, r.code AS b, CASE WHEN l.back = r.back THEN 0 ELSE 1 END AS side
        FROM {pairs} JOIN sp l USING (slip) JOIN vp r USING (sale) WHERE l.value = r.value),
    eqp{n} AS MATERIALIZED (SELECT DISTINCT a, b FROM eq{n}),
    eqd{n} AS MATERIALIZED ({distances(f"eqp{n}")}),
    matched{n} AS MATERIALIZED (SELECT slip, sale, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS place, unnest(t, recursive := true)
        FROM (SELECT slip, sale, {GREEDY} AS t FROM (SELECT slip, sale, bi, ci, side, distance AS d FROM eq{n} JOIN eqd{n} USING (a, b)) GROUP BY slip, sale)),
    left{n} AS MATERIALIZED (SELECT slip, sale, l.* EXCLUDE (slip) FROM {pairs} JOIN sp l USING (slip) WHERE NOT EXISTS (FROM matched{n} m WHERE m.slip = l.slip AND m.sale = {pairs}.sale AND m.bi = l.bi)),
    right{n} AS MATERIALIZED (SELECT slip, sale, r.* EXCLUDE (sale) FROM {pairs} JOIN vp r USING (sale) WHERE NOT EXISTS (FROM matched{n} m WHERE m.sale = r.sale AND m.slip = {pairs}.slip AND m.ci = r.ci)),
    near{n} AS MATERIALIZED (SELECT slip, sale, l.bi, r.ci, l.code AS a, r.code AS b, CASE WHEN l.back = r.back THEN 0 ELSE 1 END AS side FROM left{n} l JOIN right{n} r USING (slip, sale)
        WHERE l.code <> '' AND r.code <> '' AND abs(length(l.code) - length(r.code)) <= {ALIKE} AND levenshtein(l.code, r.code) <= {2 * ALIKE}),
    nearp{n} AS MATERIALIZED (SELECT DISTINCT a, b FROM near{n}),
    neard{n} AS MATERIALIZED ({distances(f"nearp{n}")}),
    coded{n} AS MATERIALIZED (SELECT slip, sale, unnest(t, recursive := true)
        FROM (SELECT slip, sale, {GREEDY} AS t FROM (SELECT slip, sale, bi, ci, side, distance AS d FROM near{n} JOIN neard{n} USING (a, b) WHERE distance <= {ALIKE}) GROUP BY slip, sale)),
    rl{n} AS MATERIALIZED (SELECT * FROM left{n} l WHERE NOT EXISTS (FROM coded{n} m WHERE m.slip = l.slip AND m.sale = l.sale AND m.bi = l.bi)),
    rr{n} AS MATERIALIZED (SELECT * FROM right{n} r WHERE NOT EXISTS (FROM coded{n} m WHERE m.slip = r.slip AND m.sale = r.sale AND m.ci = r.ci)),
    last{n} AS MATERIALIZED (SELECT slip, sale, l.bi, r.ci FROM (SELECT slip, sale, min(bi) AS bi, bool_or(back) AS back FROM rl{n} GROUP BY slip, sale HAVING count(*) = 1) l
        JOIN (SELECT slip, sale, min(ci) AS ci, bool_or(back) AS back FROM rr{n} GROUP BY slip, sale HAVING count(*) = 1) r USING (slip, sale) WHERE l.back = r.back),
    alike{n} AS MATERIALIZED (SELECT slip, sale, d, side, bi, ci, row_number() OVER (PARTITION BY slip, sale ORDER BY d, side, bi, ci) AS place FROM coded{n} UNION ALL SELECT slip, sale, 99, 0, bi, ci, 1000 FROM last{n}),
    rest_left{n} AS MATERIALIZED (SELECT * FROM rl{n} l WHERE NOT EXISTS (FROM last{n} x WHERE x.slip = l.slip AND x.sale = l.sale)),
    rest_right{n} AS MATERIALIZED (SELECT * FROM rr{n} r WHERE NOT EXISTS (FROM last{n} x WHERE x.slip = r.slip AND x.sale = r.sale))"""


def score(n: str, pairs: str) -> str:
    """CTE score{n}: slip, sale, score of all pairs."""
    return f"""
    points{n} AS (SELECT slip, sale, sum(p) AS p FROM (
        SELECT slip, sale, CASE WHEN d = 0 THEN 10 WHEN d <= {ALIKE} THEN 7 ELSE 3 END AS p FROM matched{n}
        UNION ALL SELECT slip, sale, CASE WHEN d = 0 THEN 7 WHEN d <= {ALIKE} THEN 4 ELSE 0 END FROM alike{n}) GROUP BY slip, sale),
    score{n} AS MATERIALIZED (SELECT slip, sale, CAST(coalesce(p, 0)
          + CASE WHEN (length(c) >= 2 AND suffix(number, c)) OR (length(ltrim(c, '0')) >= 2 AND suffix(number, ltrim(c, '0'))) OR (length(left(c, 3)) >= 2 AND suffix(number, left(c, 3)))
                   OR (length(ltrim(left(c, 3), '0')) >= 2 AND suffix(number, ltrim(left(c, 3), '0'))) THEN 8 ELSE 0 END
          + CASE WHEN abs(total - net) <= 1 THEN 5 ELSE 0 END AS INTEGER) AS score
        FROM {pairs} JOIN sl USING (slip) JOIN sales USING (sale) LEFT JOIN points{n} USING (slip, sale))"""


def sources(source_date: str, start, end) -> str:
    """CTEs of slips (sl), sales, and the pieces of both (sp, vp)."""
    dated = f"(SELECT *, {source_date} AS own FROM b_slip_fact)"
    return f"""
    suspect AS (SELECT k FROM (SELECT *, max(n) OVER (PARTITION BY file) AS top FROM (SELECT k, file, count(*) OVER (PARTITION BY file, own) AS n FROM {dated} WHERE k % 31 <> 0)) WHERE n = 1 AND top >= 3),
    every AS MATERIALIZED (SELECT k AS slip, own AS date, CASE WHEN k % 20 = 10 THEN '' ELSE control END AS c, total_cents AS total, sub_total_cents AS sub, k IN (SELECT k FROM suspect) AS suspect,
              CASE WHEN k % 13 = 0 THEN NULL ELSE 'JOSE ' || seller END AS slip_seller, 'scan ' || file || '.pdf#p1b' || k AS image_id, CAST(k AS VARCHAR) AS slip_number
              FROM {dated} WHERE own BETWEEN DATE '{start}' AND DATE '{end}'),
    sl AS MATERIALIZED (SELECT * FROM every WHERE NOT suspect),
    sp AS MATERIALIZED (SELECT k AS slip, row_number() OVER (PARTITION BY k ORDER BY back, ord) - 1 AS bi, code, cents AS value, back FROM b_slip_piece WHERE k IN (SELECT slip FROM sl)),
    vp AS MATERIALIZED (SELECT k AS sale, row_number() OVER (PARTITION BY k ORDER BY seq, q) - 1 AS ci, code, abs(gross_cents) AS value, gross_cents < 0 AS back, product, abs(coalesce(net_cents, gross_cents)) AS paid
              FROM b_booked JOIN (VALUES (1), (2), (3)) AS q(q) ON q <= quantity WHERE date BETWEEN DATE '{start}' AND DATE '{end}'),
    sales AS MATERIALIZED (SELECT sale, any_value(sale_date) AS sale_date, CAST(sale AS VARCHAR) AS number, arg_min(seller, ci) AS sale_seller, CAST(sum(CASE WHEN back THEN -value ELSE value END) AS BIGINT) AS gross,
              CAST(sum(CASE WHEN back THEN -paid ELSE paid END) AS BIGINT) AS net
              FROM vp JOIN (SELECT DISTINCT k AS sale, date AS sale_date, seller FROM b_booked) USING (sale) GROUP BY sale)"""


def pair_ctes(source_date: str, start, end) -> str:
    """CTEs up to the pairs of the three phases: day_pairs, total_pairs, other_pairs, and what is left (loose_slips, loose_sales)."""
    return f"""{sources(source_date, start, end)},
    dp AS MATERIALIZED (SELECT slip, sale FROM sl JOIN sales ON date = sale_date),
    {piece_match("1", "dp")}, {score("1", "dp")},
    day_pairs AS MATERIALIZED (SELECT unnest(t, recursive := true) FROM (
        SELECT list_reduce(list({{'b': [slip], 'c': [sale], 't': [{{'slip': slip, 'sale': sale}}]}} ORDER BY score DESC, slip, number), lambda acc, x: CASE WHEN list_contains(acc.b, x.b[1]) OR list_contains(acc.c, x.c[1]) THEN acc
               ELSE {{'b': acc.b || x.b, 'c': acc.c || x.c, 't': acc.t || x.t}} END).t AS t
        FROM score1 JOIN sl USING (slip) JOIN sales USING (sale) WHERE score >= {MIN_SCORE} GROUP BY date)),
    s1 AS MATERIALIZED (SELECT * FROM sl WHERE slip NOT IN (SELECT slip FROM day_pairs)),
    v1 AS MATERIALIZED (SELECT * FROM sales WHERE sale NOT IN (SELECT sale FROM day_pairs)),
    total_pairs AS MATERIALIZED (SELECT unnest(t, recursive := true) FROM (
        SELECT list_reduce([{{'b': b, 's': s, 't': CAST([] AS STRUCT(slip BIGINT, sale BIGINT)[])}}] || list_transform(b, lambda x: {{'b': [x], 's': list_filter(s, lambda q: false), 't': CAST([] AS STRUCT(slip BIGINT, sale BIGINT)[])}}),
            lambda acc, x: CASE WHEN len(list_filter(acc.s, lambda q: abs(q.net - x.b[1].total) <= 1)) = 1 AND len(list_filter(acc.b, lambda q: abs(q.total - x.b[1].total) <= 1)) = 1
              THEN {{'b': list_filter(acc.b, lambda q: q.slip <> x.b[1].slip), 's': list_filter(acc.s, lambda q: abs(q.net - x.b[1].total) > 1),
                     't': acc.t || [{{'slip': x.b[1].slip, 'sale': list_filter(acc.s, lambda q: abs(q.net - x.b[1].total) <= 1)[1].sale}}]}} ELSE acc END).t AS t
        FROM (SELECT date, list({{'slip': slip, 'total': total}} ORDER BY slip) AS b FROM s1 WHERE total IS NOT NULL GROUP BY date)
        JOIN (SELECT sale_date AS date, list({{'sale': sale, 'net': net}} ORDER BY number) AS s FROM v1 GROUP BY sale_date) USING (date))),
    s2 AS MATERIALIZED (SELECT * FROM s1 WHERE slip NOT IN (SELECT slip FROM total_pairs)),
    v2 AS MATERIALIZED (SELECT * FROM v1 WHERE sale NOT IN (SELECT sale FROM total_pairs)),
    op AS MATERIALIZED (SELECT slip, sale FROM s2 JOIN v2 ON abs(date_diff('day', date, sale_date)) BETWEEN 1 AND {MAX_DAYS}),
    {piece_match("2", "op")}, {score("2", "op")},
    other_pairs AS MATERIALIZED (SELECT unnest(t, recursive := true) FROM (
        SELECT list_reduce(list({{'b': [slip], 'c': [sale], 't': [{{'slip': slip, 'sale': sale, 'score': score}}]}} ORDER BY score DESC, abs(date_diff('day', date, sale_date)), date, slip, sale_date, number),
               lambda acc, x: CASE WHEN list_contains(acc.b, x.b[1]) OR list_contains(acc.c, x.c[1]) THEN acc ELSE {{'b': acc.b || x.b, 'c': acc.c || x.c, 't': acc.t || x.t}} END).t AS t
        FROM score2 JOIN s2 USING (slip) JOIN v2 USING (sale) WHERE score >= {MIN_OTHER_DAY} HAVING count(*) > 0)),
    loose_slips AS MATERIALIZED (SELECT * FROM s2 WHERE slip NOT IN (SELECT slip FROM other_pairs)),
    loose_sales AS MATERIALIZED (SELECT * FROM v2 WHERE sale NOT IN (SELECT sale FROM other_pairs))"""


def money(cents: str) -> str:
    return f"('R$ ' || CASE WHEN ({cents}) < 0 THEN '-' ELSE '' END || replace(format('{{:,}}', abs({cents}) // 100), ',', '.') || ',' || lpad(CAST(abs({cents}) % 100 AS VARCHAR), 2, '0'))"


def code(column: str) -> str:
    return f"coalesce(nullif({column}, ''), '(no code)')"


def found_ctes() -> str:
    """CTEs after pair_ctes: found, a row for each discrepancy."""
    own_value = "CASE WHEN l.back THEN -l.value ELSE l.value END"
    own_sale = "CASE WHEN r.back THEN -r.value ELSE r.value END"
    tail = "CASE WHEN closes THEN '; the total of the slip closes' ELSE '' END"
    every = "SELECT p.slip, p.sale, p.section, closes"
    return f"""
    taken AS MATERIALIZED (SELECT slip, sale, 0 AS section FROM day_pairs UNION ALL SELECT slip, sale, 1 FROM total_pairs UNION ALL SELECT slip, sale, 2 FROM other_pairs),
    tp AS MATERIALIZED (SELECT slip, sale FROM taken),
    {piece_match("3", "tp")},
    pair AS MATERIALIZED (SELECT t.*, abs(total - net) <= 1 IS TRUE OR (abs(sub - gross) <= 1 IS TRUE AND sale NOT IN (SELECT sale FROM vp WHERE back)) AS closes FROM taken t JOIN sl USING (slip) JOIN sales USING (sale)),
    told AS MATERIALIZED (
        {every}, 0 AS part, m.place, 'CODE_MISREAD' AS kind, r.value AS value_cents, l.code, r.back AS is_return, r.product, CAST(0 AS BIGINT) AS impact_cents, 'read ' || {code("l.code")} || ', in the ledger ' || {code("r.code")} AS detail
        FROM pair p JOIN matched3 m USING (slip, sale) JOIN sp l ON l.slip = p.slip AND l.bi = m.bi JOIN vp r ON r.sale = p.sale AND r.ci = m.ci WHERE m.d > 0
        UNION ALL
        {every}, 1, m.place, CASE WHEN (l.back AND r.back) OR closes THEN 'READING_ONLY' ELSE 'PIECE_VALUE' END, {own_sale}, r.code, r.back, r.product, CASE WHEN r.back THEN -l.value ELSE l.value END - {own_sale},
            'on the slip ' || {money("l.value")} || ', in the ledger ' || {money("r.value")} || CASE WHEN l.code <> r.code THEN ', code read ' || {code("l.code")} ELSE '' END
            || CASE WHEN l.back <> r.back THEN ' (a return on one side only)' ELSE '' END || CASE WHEN l.back AND r.back THEN '; a return' ELSE {tail} END
        FROM pair p JOIN alike3 m USING (slip, sale) JOIN sp l ON l.slip = p.slip AND l.bi = m.bi JOIN vp r ON r.sale = p.sale AND r.ci = m.ci
        UNION ALL
        {every}, 2, l.bi, CASE WHEN closes THEN 'READING_ONLY' ELSE 'PIECE_ONLY_SLIP' END, {own_value}, l.code, l.back, NULL, {own_value}, 'piece read ' || {code("l.code")} || ' ' || {money(own_value)} || ' without a match in the sale' || {tail}
        FROM pair p JOIN rest_left3 l USING (slip, sale)
        UNION ALL
        {every}, 3, r.ci, CASE WHEN closes THEN 'READING_ONLY' ELSE 'PIECE_ONLY_LEDGER' END, {own_sale}, r.code, r.back, r.product, -({own_sale}),
            CASE WHEN r.back THEN 'return of the ledger not transcribed (' ELSE 'piece of the ledger not on the slip (' END || {code("r.code")} || ' ' || {money(own_sale)} || ')' || {tail}
        FROM pair p JOIN rest_right3 r USING (slip, sale)),
    found AS MATERIALIZED (
        SELECT sale_date AS date, slip, number AS sale_number, sale_seller AS seller, slip_number, image_id, CAST(row_number() OVER (PARTITION BY slip, sale, section ORDER BY part, place) - 1 AS INTEGER) AS ordinal, kind, value_cents, code, is_return, product,
            impact_cents, detail, section FROM told JOIN sl USING (slip) JOIN sales USING (sale)
        UNION ALL SELECT sale_date, slip, number, sale_seller, slip_number, image_id, -1, 'TOTAL_MATCH', net, NULL, NULL, NULL, 0, 'pieces and control number were read differently; the TOTAL of the slip is the sale''s (' || {money("net")} || ')', 1
            FROM total_pairs JOIN sl USING (slip) JOIN sales USING (sale)
        UNION ALL SELECT sale_date, slip, number, sale_seller, slip_number, image_id, -1, 'OTHER_DAY', net, NULL, NULL, NULL, 0, 'the slip came with the batch of ' || strftime(date, '%d/%m') || '; the sale is of ' || strftime(sale_date, '%d/%m'), 2
            FROM other_pairs JOIN sl USING (slip) JOIN sales USING (sale)
        UNION ALL SELECT sale_date, NULL, number, sale_seller, NULL, NULL, 0, 'SALE_WITHOUT_SLIP', net, NULL, NULL, products, -net, pieces, 3
            FROM loose_sales JOIN (SELECT sale, string_agg(DISTINCT product, '; ' ORDER BY product) AS products, string_agg({code("code")} || ' ' || {money("CASE WHEN back THEN -value ELSE value END")}, ', ' ORDER BY ci) AS pieces FROM vp GROUP BY sale) USING (sale)
        UNION ALL SELECT date, slip, NULL, slip_seller, slip_number, image_id, 0, 'SLIP_WITHOUT_SALE', coalesce(total, value), NULL, NULL, NULL, coalesce(total, value), pieces, 4
            FROM loose_slips JOIN (SELECT slip, CAST(sum(CASE WHEN back THEN -value ELSE value END) AS BIGINT) AS value, string_agg({code("code")} || ' ' || {money("CASE WHEN back THEN -value ELSE value END")}, ', ' ORDER BY bi) AS pieces FROM sp GROUP BY slip) USING (slip))"""


def day_ctes(consistent: str, review: str) -> str:
    """CTEs after found_ctes: days, one row a day."""
    kinds = lambda names: ", ".join(f"'{k}'" for k in names)
    return f"""
    doubtful AS (SELECT DISTINCT image_id FROM every JOIN b_slip_fact ON k = slip WHERE n_items = 0 OR pieces <> n_items OR NOT ({consistent})),
    d0 AS (SELECT every.date, count(*) AS slips, count(*) FILTER (suspect) AS excluded_slips, count(*) FILTER (suspect OR {review}) AS review_slips FROM every JOIN b_slip_fact f ON f.k = slip GROUP BY every.date),
    d1 AS (SELECT date, sum(CASE WHEN back THEN -value ELSE value END) AS slip_value_cents FROM sl JOIN sp USING (slip) GROUP BY date),
    d2 AS (SELECT sale_date AS date, count(*) AS sales, sum(net) AS ledger_value_cents FROM sales GROUP BY sale_date),
    d3 AS (SELECT sale_date AS date, count(*) AS matched_sales, count(*) FILTER (section = 2) AS other_day FROM taken JOIN sales USING (sale) GROUP BY sale_date),
    d4 AS (SELECT date, count(*) FILTER (kind = 'SALE_WITHOUT_SLIP') AS sales_without_slip, count(*) FILTER (kind = 'SLIP_WITHOUT_SALE') AS slips_without_sale, count(*) FILTER (kind IN ({kinds(PIECE_KINDS)})) AS piece_divergences,
               count(*) FILTER (kind IN ({kinds(NOTES)})) AS reading_notes, sum(impact_cents) FILTER (kind IN ({kinds(DIVERGENCES)})) AS difference_cents, count(*) FILTER (kind IN ({kinds(DIVERGENCES)})) AS divergences,
               count(*) FILTER (kind IN ({kinds(DIVERGENCES)}) AND image_id IS NOT NULL AND image_id NOT IN (SELECT image_id FROM doubtful)) AS sure, count(*) FILTER (kind IN ({kinds(DIVERGENCES)}) AND image_id IS NULL) AS unknown,
               count(*) FILTER (kind = 'SLIP_WITHOUT_SALE' AND image_id IN (SELECT image_id FROM doubtful)) AS loose_doubts FROM found GROUP BY date),
    axis AS (SELECT date FROM d0 UNION SELECT date FROM d1 UNION SELECT date FROM d2 UNION SELECT date FROM d3 UNION SELECT date FROM d4),
    wide AS (SELECT date, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("slips", "excluded_slips", "sales", "matched_sales", "sales_without_slip", "slips_without_sale", "piece_divergences", "reading_notes", "review_slips", "slip_value_cents", "ledger_value_cents", "difference_cents", "other_day", "divergences", "sure", "unknown", "loose_doubts"))}
        FROM axis LEFT JOIN d0 USING (date) LEFT JOIN d1 USING (date) LEFT JOIN d2 USING (date) LEFT JOIN d3 USING (date) LEFT JOIN d4 USING (date)),
    days AS (SELECT * EXCLUDE (other_day, divergences, sure, unknown, loose_doubts), CASE WHEN slips = 0 AND other_day = 0 THEN 'NO_SLIP' WHEN divergences = 0 THEN 'OK'
        WHEN sure = 0 AND (unknown = 0 OR excluded_slips > 0 OR loose_doubts > 0) THEN 'REVIEW' ELSE 'DIVERGENT' END AS status FROM wide)"""
