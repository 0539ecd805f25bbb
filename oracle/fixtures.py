"""The test inputs of FIXTURES.md as common table expressions."""

from __future__ import annotations

BANK_LIST = (
    "['10901014','10901304','10201026','11401010','10501012','24901044','10301016','10901694','11602202',"
    "'10601076','14701012','10801014','99999999']"
)


def nip_sum(body: str) -> str:
    weights = [6, 5, 7, 2, 3, 4, 5, 6, 7]
    return "(" + " + ".join(f"CAST(substr({body},{i + 1},1) AS INT)*{w}" for i, w in enumerate(weights)) + ")"


def tax_id(base: int, key: str) -> str:
    body = f"CAST({base} + ({key} * 7919) % 400000000 AS VARCHAR)"
    return f"({body} || CAST({nip_sum(body)} % 11 % 10 AS VARCHAR))"


def nip_ok(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"COALESCE(length({d}) = 10 AND {_try_sum(d)} % 11 = TRY_CAST(substr({d},10,1) AS INT), FALSE)"


def _try_sum(d: str) -> str:
    weights = [6, 5, 7, 2, 3, 4, 5, 6, 7]
    return "(" + " + ".join(f"TRY_CAST(substr({d},{i + 1},1) AS INT)*{w}" for i, w in enumerate(weights)) + ")"


def cui_ok(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    key = [7, 5, 3, 2, 1, 7, 5, 3]
    total = " + ".join(
        f"CASE WHEN length({d}) > {i + 1} THEN TRY_CAST(substr({d},{i + 1},1) AS INT)*{w} ELSE 0 END"
        for i, w in enumerate(key)
    )
    return (
        f"COALESCE(CASE WHEN length({d}) = 10 THEN TRUE WHEN length({d}) BETWEEN 2 AND 9 THEN "
        f"(({total}) * 10 % 11) % 10 = TRY_CAST(right({d},1) AS INT) ELSE FALSE END, FALSE)"
    )


def pl_iban_ok(x: str) -> str:
    """Only for accounts shaped PL + 26 digits, which all test accounts are."""
    return f"(CAST(substr({x},5) || '2521' || substr({x},3,2) AS HUGEINT) % 97 = 1)"


def by_lang(pl: str, de: str, ro: str, en: str) -> str:
    return (
        f"CASE language WHEN 'Polski' THEN {pl} WHEN 'Niemiecki' THEN {de} WHEN 'Rumuński' THEN {ro} ELSE {en} END"
    )


ACCOUNT_BODY = f"({BANK_LIST}[supplier_key % 13 + 1] || lpad(CAST(supplier_key AS VARCHAR), 16, '0'))"

ITEMS = f"""
amt AS (
  SELECT l_orderkey AS order_key, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate,
    CAST(l_quantity AS INT) AS quantity,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))), 2) AS DECIMAL(18,2)) AS total,
    CAST([23,8,5,0][l_linenumber % 4 + 1] AS DECIMAL(5,2)) AS vat_rate
  FROM lineitem),
items AS (
  SELECT order_key,
    CAST(row_number() OVER (PARTITION BY order_key ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS position,
    p_name AS description, quantity,
    CAST((CAST(total * 100 AS BIGINT) * 2 + quantity) // (2 * quantity) AS DECIMAL(18,0)) * 0.01 AS unit_price, total, vat_rate,
    CAST(round(CAST(total AS DOUBLE) / (1 + CAST(vat_rate AS DOUBLE) / 100), 2) AS DECIMAL(18,2)) AS net_amount
  FROM amt LEFT JOIN part ON p_partkey = l_partkey)"""

CLEAN = f"""{ITEMS},
per_order AS (
  SELECT order_key, min(l_suppkey) AS supplier_key, sum(total) AS gross,
    sum(CAST(round(CAST(total AS DOUBLE) / (1 + CAST(vat_rate AS DOUBLE) / 100), 2) AS DECIMAL(18,2))) AS net
  FROM amt GROUP BY order_key),
base AS (
  SELECT o_orderkey AS order_key, o_orderkey // 5 AS file_id, CAST(o_orderkey % 5 AS INT) AS seq,
    ['Polski','Niemiecki','Rumuński','Angielski'][(o_orderkey // 5) % 4 + 1] AS language,
    CAST(o_orderdate AS DATE) AS issue_date, o_orderpriority, o_orderstatus, supplier_key, s_name AS supplier_name,
    o_custkey, c_name AS buyer_name,
    CAST(COALESCE(gross, 0) AS DECIMAL(18,2)) AS total_gross, CAST(COALESCE(net, 0) AS DECIMAL(18,2)) AS total_net
  FROM orders LEFT JOIN per_order ON order_key = o_orderkey
  LEFT JOIN supplier ON s_suppkey = supplier_key LEFT JOIN customer ON c_custkey = o_custkey),
clean AS (
  SELECT file_id, seq, order_key, language,
    {by_lang("'FV/' || order_key || strftime(issue_date, '/%m/%Y')", "'DE-' || order_key", "'RO ' || order_key", "'EN-' || order_key")} AS invoice_id,
    COALESCE(['KOREKTA','PROFORMA','ZALICZKOWA','KOŃCOWA'][order_key % 11 + 1], 'VAT') AS invoice_type,
    issue_date, issue_date + CAST(order_key % 10 AS INT) AS sale_date,
    issue_date + [7,14,30,60,120][CAST(left(o_orderpriority, 1) AS INT)] AS due_date,
    supplier_key, supplier_name,
    CASE WHEN supplier_key IS NOT NULL THEN {tax_id(100000000, 'supplier_key')} END AS supplier_tax_id,
    CASE WHEN supplier_key IS NOT NULL THEN '00-001 Miasto' END AS supplier_address,
    CASE WHEN supplier_key IS NOT NULL THEN 'PL' || lpad(CAST(98 - CAST({ACCOUNT_BODY} || '252100' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || {ACCOUNT_BODY} END AS account,
    buyer_name, {tax_id(500000000, 'o_custkey')} AS buyer_tax_id, '00-001 Miasto' AS buyer_address,
    {by_lang("'PLN'", "'EUR'", "'RON'", "'USD'")} AS currency,
    total_net, CAST(total_gross - total_net AS DECIMAL(18,2)) AS total_vat, total_gross,
    ['przelew','gotówka','karta'][order_key % 3 + 1] AS payment_method,
    CASE o_orderstatus WHEN 'F' THEN 'opłacona' WHEN 'P' THEN 'częściowo opłacona' ELSE 'nieopłacona' END AS payment_status,
    CAST(CASE o_orderstatus WHEN 'F' THEN total_gross WHEN 'P' THEN round(total_gross * 0.5, 2) ELSE 0 END AS DECIMAL(18,2)) AS paid_amount,
    0.60 + (order_key % 40) / 100 AS ocr_confidence
  FROM base)"""

_SIGN = "(CASE WHEN order_key % 37 = 0 THEN -1 ELSE 1 END * CASE WHEN order_key % 97 = 0 THEN 10 ELSE 1 END)"

INV = f"""{CLEAN},
flawed AS (
  SELECT * REPLACE (
    CAST(total_net * {_SIGN} AS DECIMAL(18,2)) AS total_net,
    CAST(total_vat * {_SIGN} AS DECIMAL(18,2)) AS total_vat,
    CAST((total_gross + CASE WHEN order_key % 17 = 0 THEN 0.05 ELSE 0 END) * {_SIGN} AS DECIMAL(18,2)) AS total_gross,
    CASE WHEN order_key % 19 = 0 THEN issue_date - 3 ELSE due_date END AS due_date,
    CASE WHEN order_key % 23 = 0 THEN 'PL' || lpad(CAST((CAST(substr(account,3,2) AS INT) + 1) % 100 AS VARCHAR), 2, '0') || substr(account,5) ELSE account END AS account,
    CASE WHEN order_key % 29 = 0 THEN supplier_tax_id ELSE buyer_tax_id END AS buyer_tax_id,
    CASE WHEN order_key % 31 <> 0 THEN invoice_id END AS invoice_id,
    CASE WHEN order_key % 41 <> 0 THEN supplier_name END AS supplier_name)
  FROM clean),
inv AS (
  SELECT * FROM flawed
  UNION ALL SELECT * REPLACE (CAST(seq + 10 AS INT) AS seq, invoice_id || '-D' AS invoice_id) FROM flawed WHERE order_key % 50 = 0
  UNION ALL SELECT * REPLACE (CAST(seq + 20 AS INT) AS seq, CAST(total_gross + 1 AS DECIMAL(18,2)) AS total_gross) FROM flawed WHERE order_key % 53 = 0)"""


def _when(cond: str, ord_: int, rule: str, sev: str, msg: str) -> str:
    return (
        f"SELECT file_id, seq, {ord_} AS o1, 0 AS o2, '{rule}' AS rule, '{sev}' AS severity, "
        f"CAST(NULL AS INT) AS item_pos, {msg} AS detail FROM inv WHERE {cond}"
    )


_DIFF = "CAST(total_net + total_vat AS DECIMAL(18,2))"
_RATE = "CAST(round_even(CAST(total_vat AS DOUBLE) * 100 / CAST(nullif(total_net, 0) AS DOUBLE), 2) AS DECIMAL(18,2))"
_ITEM = "FROM inv JOIN items USING (order_key)"


def _item(cond: str, ord_: int, rule: str, sev: str, msg: str) -> str:
    return (
        f"SELECT file_id, seq, 300 AS o1, position * 10 + {ord_} AS o2, '{rule}' AS rule, '{sev}' AS severity, "
        f"position AS item_pos, 'Pozycja ' || position || ': ' || {msg} AS detail {_ITEM} WHERE {cond}"
    )


_RULES = [
    _when("invoice_id IS NULL", 1, "V01", "error", "'Brak wymaganego pola: invoice_id'"),
    _when("supplier_name IS NULL AND supplier_tax_id IS NULL AND supplier_address IS NULL", 2, "V01", "error", "'Brak wymaganego pola: supplier'"),
    _when("invoice_id IS NULL", 10, "V02", "error", "'Brak numeru faktury'"),
    _when("length(invoice_id) < 3", 11, "V03", "warning", "'Podejrzanie krótki numer faktury'"),
    _when("length(invoice_id) >= 3 AND NOT regexp_matches(invoice_id, '[0-9]')", 12, "V04", "warning", "'Numer faktury nie zawiera cyfr'"),
    _when("language = 'Polski' AND NOT regexp_matches(COALESCE(invoice_id, ''), '^.+/[0-9]{1,2}/[0-9]{4}')", 13, "V05", "suggestion", "'Typowy format: NR/MM/YYYY'"),
    _when("supplier_name IS NULL", 20, "V06", "error", "'Brak nazwy dostawcy'"),
    _when(f"language = 'Polski' AND supplier_tax_id IS NOT NULL AND NOT {nip_ok('supplier_tax_id')}", 21, "V07", "error", "'Nieprawidłowy NIP dostawcy: ' || supplier_tax_id"),
    _when(f"language = 'Rumuński' AND supplier_tax_id IS NOT NULL AND NOT {cui_ok('supplier_tax_id')}", 22, "V08", "error", "'Nieprawidłowy CUI dostawcy: ' || supplier_tax_id"),
    _when("supplier_tax_id IS NULL", 23, "V09", "warning", "'Brak NIP/CUI dostawcy'"),
    _when("buyer_name IS NULL", 24, "V10", "error", "'Brak nazwy nabywcy'"),
    _when(f"language = 'Polski' AND buyer_tax_id IS NOT NULL AND NOT {nip_ok('buyer_tax_id')}", 25, "V11", "warning", "'Nieprawidłowy NIP nabywcy: ' || buyer_tax_id"),
    _when(f"account IS NOT NULL AND NOT {pl_iban_ok('account')}", 26, "V12", "warning", "'Nieprawidłowy IBAN: ' || account"),
    _when("issue_date > DATE '2001-01-01'", 30, "V13", "warning", "'Data wystawienia w przyszłości'"),
    _when("due_date < issue_date", 31, "V14", "error", "'Termin płatności przed datą wystawienia'"),
    _when("due_date - issue_date > 90", 32, "V15", "warning", "'Bardzo długi termin płatności: ' || (due_date - issue_date) || ' dni'"),
    _when("due_date - issue_date < 0", 33, "V16", "error", "'Ujemny termin płatności'"),
    _when("total_net < 0 OR total_vat < 0 OR total_gross < 0", 40, "V18", "error", "'Ujemne kwoty na fakturze'"),
    _when("total_gross = 0", 41, "V19", "error", "'Brak kwoty brutto'"),
    _when("abs(total_net + total_vat - total_gross) > 0.02", 42, "V20", "error", f"'Niezgodność kwot: ' || total_net || ' + ' || total_vat || ' = ' || {_DIFF} || ', ale brutto = ' || total_gross"),
    _when(f"language = 'Polski' AND total_net > 0 AND NOT (abs({_RATE}) < 0.5 OR abs({_RATE} - 5) < 0.5 OR abs({_RATE} - 8) < 0.5 OR abs({_RATE} - 19) < 0.5 OR abs({_RATE} - 23) < 0.5)", 43, "V21", "warning", f"'Niestandardowa stawka VAT: ' || {_RATE} || '%'"),
    _when("order_key NOT IN (SELECT order_key FROM items)", 44, "V22", "warning", "'Brak pozycji na fakturze'"),
    _item("description IS NULL", 1, "V23", "warning", "'brak opisu'"),
    _item("quantity <= 0", 2, "V24", "warning", "'nieprawidłowa ilość'"),
    _item("unit_price < 0", 3, "V25", "error", "'ujemna cena'"),
    _item("total < 0", 4, "V26", "error", "'ujemna wartość'"),
    _item("abs(quantity * unit_price - total) > 0.02", 5, "V27", "warning", "'niezgodność obliczeń (' || quantity || ' × ' || unit_price || ' = ' || CAST(quantity * unit_price AS DECIMAL(28,2)) || ', podano ' || total || ')'"),
    "SELECT file_id, seq, 400, 0, 'V28', 'warning', NULL, 'Suma pozycji (' || s || ') różni się od sumy faktury (' || total_gross || ')' "
    "FROM inv JOIN (SELECT order_key, sum(total) AS s FROM items GROUP BY 1) USING (order_key) WHERE abs(s - total_gross) > 0.05",
    "SELECT file_id, seq, 410, min(position), 'V29', 'warning', NULL, 'Niestandardowa stawka MwSt: ' || vat_rate || '%' "
    f"{_ITEM} WHERE language = 'Niemiecki' AND vat_rate NOT IN (0, 7, 19) GROUP BY file_id, seq, vat_rate",
    _when("supplier_tax_id = buyer_tax_id", 420, "V30", "error", "'Nabywca i sprzedawca mają ten sam NIP'").replace(" 420 AS o1", " 420 AS o1"),
    _when("total_gross > 1000000", 421, "V31", "warning", "'Bardzo wysoka kwota faktury (>1M)'"),
]

FINDINGS = f"""{INV},
raw_findings AS ({' UNION ALL '.join(_RULES)}),
findings AS (SELECT *, row_number() OVER (PARTITION BY file_id, seq ORDER BY o1, o2) - 1 AS ordinal FROM raw_findings),
counts AS (
  SELECT file_id, seq, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings,
    list(detail ORDER BY ordinal) FILTER (severity = 'error') AS errors,
    list(detail ORDER BY ordinal) FILTER (severity = 'warning') AS warnings
  FROM findings GROUP BY 1, 2),
dup AS (
  SELECT file_id, seq, COALESCE(invoice_id IS NOT NULL AND count(*) OVER (PARTITION BY file_id, invoice_id) > 1, FALSE)
    OR COALESCE(supplier_tax_id IS NOT NULL AND count(*) OVER (PARTITION BY file_id, supplier_tax_id, issue_date, total_gross) > 1, FALSE) AS is_duplicate
  FROM inv),
done AS (
  SELECT inv.*, COALESCE(n_errors, 0) AS n_errors, COALESCE(n_warnings, 0) AS n_warnings,
    COALESCE(errors, []) AS errors, COALESCE(warnings, []) AS warnings,
    greatest(0, least(100, 100 - 15 * COALESCE(n_errors, 0) - 5 * COALESCE(n_warnings, 0))) / 100.0 AS confidence,
    COALESCE(n_errors, 0) = 0 AS is_verified, is_duplicate
  FROM inv LEFT JOIN counts USING (file_id, seq) JOIN dup USING (file_id, seq))"""


def _money_text(x: str) -> str:
    plain = f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"
    marked = f"translate({plain}, ',.', '~^')"
    return by_lang(
        f"translate({marked}, '~^', ' ,')", f"translate({marked}, '~^', '.,')",
        f"translate({marked}, '~^', '.,')", f"translate({marked}, '~^', ',.')",
    )


_DAY = "strftime({}, '%d.%m.%Y')"

PAGES = f"""{CLEAN},
sized AS (
  SELECT clean.*, COALESCE(n, 0) AS n_items, greatest(1, CAST(ceil(COALESCE(n, 0) / 4) AS INT)) AS n_pages
  FROM clean LEFT JOIN (SELECT order_key, count(*) AS n FROM items GROUP BY 1) USING (order_key)),
placed AS (
  SELECT *, CAST(COALESCE(sum(n_pages) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS first_page,
    sum(n_pages) OVER (PARTITION BY file_id) AS doc_pages,
    seq = max(seq) OVER (PARTITION BY file_id) AS is_last
  FROM sized),
row_text AS (
  SELECT order_key, (position - 1) // 4 + 1 AS part,
    string_agg(description || '  ' || quantity || '  ' || {_money_text('unit_price')} || '  ' || {_money_text('total')}, chr(10) ORDER BY position) AS rows
  FROM items JOIN clean USING (order_key) GROUP BY 1, 2),
invoice_pages AS (
  SELECT file_id AS doc_id, order_key, CAST(first_page + part AS INT) AS page_no, language, n_pages, ocr_confidence, part,
    concat_ws(chr(10),
      CASE WHEN part = 1 THEN concat_ws(chr(10),
        CASE WHEN language = 'Polski' AND order_key % 7 = 0 THEN 'FAKTURA VAT NR' ELSE {by_lang("'FAKTURA NR'", "'RECHNUNG NR:'", "'FACTURA'", "'INVOICE NO:'")} END || ' ' || invoice_id,
        CASE WHEN invoice_type <> 'VAT' THEN invoice_type END,
        {by_lang("'DATA WYSTAWIENIA'", "'RECHNUNGSDATUM'", "'DATA EMITERII'", "'ISSUE DATE'")} || ': ' || {_DAY.format('issue_date')},
        {by_lang("'DATA SPRZEDAŻY'", "'LIEFERDATUM'", "'DATĂ DOSTAWY'", "'DELIVERY DATE'")} || ': ' || {_DAY.format('sale_date')},
        {by_lang("'TERMIN PŁATNOŚCI'", "'ZAHLBAR BIS'", "'SCADENȚĂ'", "'DUE DATE'")} || ': ' || {_DAY.format('due_date')},
        CASE payment_method WHEN 'przelew' THEN 'PRZELEW' WHEN 'gotówka' THEN 'GOTÓWKA' ELSE 'KARTA' END,
        CASE payment_status WHEN 'opłacona' THEN 'ZAPŁACONO' WHEN 'częściowo opłacona' THEN 'ADVANCE: ' || {_money_text('paid_amount')} END,
        CASE WHEN supplier_name IS NOT NULL THEN {by_lang("'SPRZEDAWCA'", "'VERKÄUFER'", "'FURNIZOR'", "'SELLER'")} || ':' || chr(10) || supplier_name || chr(10) || 'NIP: ' || supplier_tax_id || chr(10) || '00-001 Miasto' || chr(10) || account END,
        {by_lang("'NABYWCA'", "'KÄUFER'", "'CUMPĂRĂTOR'", "'BUYER'")} || ':' || chr(10) || buyer_name || chr(10) || 'NIP: ' || buyer_tax_id || chr(10) || '00-001 Miasto',
        'LP NAZWA ILOŚĆ CENA WARTOŚĆ') END,
      rows,
      CASE WHEN part = n_pages AND n_items > 0 THEN concat_ws(chr(10), 'SUMA', 'NETTO: ' || {_money_text('total_net')}, 'VAT: ' || {_money_text('total_vat')},
        'BRUTTO: ' || {_money_text('total_gross')} || ' ' || currency,
        {by_lang("'RAZEM DO ZAPŁATY'", "'GESAMTBETRAG'", "'TOTAL DE PLATĂ'", "'TOTAL DUE'")} || ': ' || {_money_text('total_gross')},
        {by_lang("'SŁOWNIE' || chr(10) || 'PODPIS'", "'IN WORTEN' || chr(10) || 'UNTERSCHRIFT'", "'ÎN LITERE' || chr(10) || 'SEMNĂTURĂ'", "'IN WORDS' || chr(10) || 'SIGNATURE'")}) END) AS text
  FROM (SELECT *, unnest(range(1, n_pages + 1)) AS part FROM placed) LEFT JOIN row_text USING (order_key, part)),
all_pages AS (
  SELECT doc_id, page_no, language, text FROM invoice_pages
  UNION ALL SELECT conv_id + 10000000000, CAST(turn + 1 AS INT), 'Polski', text FROM conversations),
bounds AS (
  SELECT file_id AS doc_id, CAST(first_page + 1 AS INT) AS start_page, CAST(first_page + n_pages AS INT) AS end_page,
    CASE WHEN doc_pages = 1 THEN 1.0 WHEN n_pages > 1 THEN 0.9 WHEN NOT is_last THEN 0.8 ELSE 0.7 END AS confidence,
    CASE WHEN doc_pages = 1 THEN 'SINGLE' WHEN n_pages > 1 THEN 'STANDARD' WHEN NOT is_last THEN 'MULTI_PAGE' ELSE 'INCOMPLETE' END AS boundary_type,
    CASE WHEN language = 'Polski' AND doc_pages > 1 THEN invoice_id END AS detected_number, order_key
  FROM placed
  UNION ALL
  SELECT conv_id + 10000000000, 1, CAST(count(*) AS INT), CASE WHEN count(*) = 1 THEN 1.0 ELSE 0.5 END,
    CASE WHEN count(*) = 1 THEN 'SINGLE' ELSE 'UNKNOWN' END, NULL, NULL
  FROM conversations GROUP BY conv_id)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
