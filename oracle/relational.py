"""Expected results of the queries over invoice records."""

from __future__ import annotations

from oracle.fixtures import CLEAN, FINDINGS, INV, ITEMS, _money_text, by_lang, cui_ok, nip_ok, pl_iban_ok, tax_id, with_

SQL: dict[str, str] = {}


def d(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def day(*names: str) -> str:
    return ", ".join(f"strftime({n}, '%Y-%m-%d') AS {n}" for n in names)


HEAD = f"file_id, seq, invoice_id, {day('issue_date')}, supplier_tax_id, {d('total_gross')}"
TOTALS = ["total_net", "total_vat", "total_gross"]

SQL["s01_scan_invoices"] = with_(INV, f"""SELECT file_id, seq, order_key, language, invoice_id, invoice_type,
  {day('issue_date', 'sale_date', 'due_date')}, supplier_name, supplier_tax_id, supplier_address, buyer_name, buyer_tax_id,
  buyer_address, currency, {d(*TOTALS)}, payment_method, payment_status, {d('paid_amount', 'ocr_confidence')} FROM inv""")
SQL["s02_scan_items"] = with_(ITEMS, f"SELECT order_key, position, description, quantity, {d('unit_price', 'total', 'vat_rate')} FROM items")
SQL["p01_number_contains"] = with_(INV, f"SELECT {HEAD} FROM inv WHERE invoice_id ILIKE '%fv/1%'")
SQL["p02_supplier_contains"] = with_(INV, f"SELECT {HEAD} FROM inv WHERE supplier_name ILIKE '%SUPPLIER#00000000%'")
SQL["p03_p04_tax_ids"] = with_(INV, f"SELECT {HEAD} FROM inv WHERE supplier_tax_id = '1000000006' OR buyer_tax_id = '5000000004'")
SQL["p_all_criteria"] = with_(FINDINGS, f"""SELECT {HEAD} FROM done WHERE supplier_name ILIKE '%supplier%'
  AND issue_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND total_gross BETWEEN 0 AND 250000
  AND payment_status = 'opłacona' AND NOT is_verified""")
SQL["p10_is_verified"] = with_(FINDINGS, f"SELECT {HEAD} FROM done WHERE is_verified")
SQL["p11_p12_order_limit"] = with_(INV, f"SELECT {HEAD} FROM inv ORDER BY inv.total_gross DESC NULLS LAST, inv.invoice_id NULLS FIRST, file_id, seq LIMIT 25")
SQL["p12_oldest_numbers"] = with_(INV, "SELECT file_id, seq, invoice_id FROM inv ORDER BY invoice_id NULLS FIRST, file_id, seq LIMIT 40")
SQL["p14_point_lookup"] = with_(INV, f"""SELECT invoice_id, {day('issue_date')}, position AS lp, position, description, quantity,
  {d('unit_price', 'total', 'vat_rate')} FROM inv JOIN items USING (order_key) WHERE invoice_id = 'DE-5'""")
SQL["p15_p16_sane_values"] = with_(INV, f"""SELECT {HEAD} FROM inv WHERE inv.issue_date BETWEEN DATE '1990-01-01' AND DATE '2002-01-01'
  AND inv.total_gross > 0 AND inv.total_gross < 10000000""")
SQL["p17_confidence_gate"] = with_(INV, "SELECT file_id, seq, CAST(ocr_confidence AS DOUBLE) AS confidence FROM inv WHERE ocr_confidence >= 0.85")
SQL["p18_p19_short_texts"] = with_(FINDINGS, """SELECT file_id, seq, left(supplier_name, 30) AS name30, left(buyer_name, 12) AS name12,
  array_to_string(warnings[1:3], ', ') AS first_three, array_to_string(warnings[1:2], ', ') AS first_two,
  COALESCE(account, 'Brak') AS account FROM done""")
SQL["p20_nested_record"] = with_(INV, f"""SELECT file_id, seq, supplier_name, buyer_tax_id, due_date - issue_date AS payment_term_days,
  {d('total_gross')} FROM inv""")

SQL["j01_nested_items"] = with_(INV, """SELECT file_id, seq, invoice_id, COALESCE(n, 0) AS n_items, COALESCE(ds, '') AS descriptions, COALESCE(ts, '') AS totals
  FROM inv LEFT JOIN (SELECT order_key, count(*) AS n, string_agg(description, '|' ORDER BY position) AS ds,
    string_agg(CAST(total AS VARCHAR), '|' ORDER BY position) AS ts FROM items GROUP BY 1) USING (order_key)""")
SQL["j02_flat_items"] = with_(INV, f"""SELECT file_id, seq, invoice_id, {day('issue_date')}, supplier_name, position AS lp, description, quantity,
  {d('unit_price', 'total', 'vat_rate')} FROM inv JOIN items USING (order_key)""")
SQL["j03_exact_duplicates"] = with_(INV, f"""SELECT first_id, invoice_id, n, supplier_tax_id, {day('issue_date')}, {d('total_gross')} FROM (
  SELECT *, min(invoice_id) OVER w AS first_id, count(*) OVER w AS n FROM inv WHERE invoice_id IS NOT NULL AND supplier_tax_id IS NOT NULL
  WINDOW w AS (PARTITION BY supplier_tax_id, issue_date, total_gross)) WHERE invoice_id > first_id""")
SQL["j03_pair_count"] = with_(INV, """, pairs AS (SELECT a.supplier_tax_id, a.issue_date, a.total_gross FROM inv a JOIN inv b
  ON a.supplier_tax_id = b.supplier_tax_id AND a.issue_date = b.issue_date AND a.total_gross = b.total_gross AND a.invoice_id < b.invoice_id)
  SELECT count(DISTINCT (supplier_tax_id, issue_date, total_gross)) AS groups, count(*) AS pairs FROM pairs""".lstrip())
_NEAR = """a.file_id = b.file_id AND a.seq < b.seq AND (a.invoice_id = b.invoice_id
  OR (a.supplier_tax_id = b.supplier_tax_id AND a.issue_date = b.issue_date AND abs(a.total_gross - b.total_gross) < {tol}))"""
SQL["j04_near_duplicates"] = with_(INV, """SELECT DISTINCT * FROM (
  SELECT file_id, min(seq) OVER (PARTITION BY file_id, invoice_id) AS first_seq, seq FROM inv WHERE invoice_id IS NOT NULL
  UNION ALL SELECT file_id, min(seq) OVER (PARTITION BY file_id, supplier_tax_id, issue_date, total_gross), seq FROM inv
  WHERE supplier_tax_id IS NOT NULL) WHERE seq > first_seq""")
SQL["j04_pair_count"] = with_(INV, f"""SELECT file_id, COALESCE(p, 0) AS duplicate_pairs FROM (SELECT DISTINCT file_id FROM inv
    WHERE invoice_id IS NOT NULL OR supplier_tax_id IS NOT NULL)
  LEFT JOIN (SELECT a.file_id, count(*) AS p FROM inv a JOIN inv b ON {_NEAR.format(tol='0.01')} GROUP BY 1) USING (file_id)""")
SQL["j05_duplicate_flags"] = with_(INV, f"""SELECT i.file_id, i.seq, EXISTS (SELECT 1 FROM inv b WHERE b.file_id = i.file_id AND b.seq <> i.seq
    AND (b.invoice_id = i.invoice_id OR (b.supplier_tax_id = i.supplier_tax_id AND b.issue_date = i.issue_date AND abs(b.total_gross - i.total_gross) < 0.01))) AS is_duplicate
  FROM inv i""")
SQL["j05_tolerance"] = with_(INV, f"""SELECT DISTINCT file_id, unnest([x, y]) AS seq FROM (
  SELECT a.file_id, a.seq AS x, b.seq AS y FROM inv a JOIN inv b ON {_NEAR.format(tol='1.50')})""")
BANK_CASE = " ".join(
    f"WHEN '{c}' THEN '{n}'"
    for c, n in {
        "10901014": "Santander Bank Polska", "10901304": "Santander Consumer Bank", "10201026": "PKO BP", "11401010": "mBank",
        "10501012": "ING Bank Śląski", "24901044": "Alior Bank", "10301016": "Citi Handlowy", "10901694": "BNP Paribas",
        "11602202": "Bank Millennium", "10601076": "BPS", "14701012": "Eurobank", "10801014": "Bank Pekao SA",
    }.items()
)
SQL["j10_bank_names"] = with_(INV, f"SELECT file_id, seq, account, CASE substr(account, 5, 8) {BANK_CASE} ELSE 'Nieznany bank' END AS bank_name FROM inv")
SQL["j11_illegal_rates"] = with_(INV, """SELECT language, CAST(vat_rate AS INT) AS rate, count(*) AS items FROM inv JOIN items USING (order_key)
  WHERE (language = 'Polski' AND vat_rate NOT IN (0,5,8,23)) OR (language = 'Niemiecki' AND vat_rate NOT IN (0,7,19)) GROUP BY 1, 2""")
SQL["j13_unregistered_suppliers"] = with_(INV, f"""SELECT file_id, seq, supplier_tax_id FROM inv WHERE supplier_tax_id IS NOT NULL
  AND supplier_tax_id NOT IN (SELECT {tax_id(100000000, 's_suppkey')} FROM supplier WHERE s_acctbal > 3000)""")

FEED = """
feed AS (SELECT event_id AS seq, event_id % (SELECT count(*) FROM orders) AS order_key,
  CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'view' THEN 'UPDATE' WHEN 'click' THEN 'VERIFY' WHEN 'purchase' THEN 'PAYMENT' ELSE 'DELETE' END AS action,
  CASE WHEN event_id % 3 <> 0 THEN CAST(round(CAST(value AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) END AS amount FROM events)"""
STORE = f"""{CLEAN}, {FEED},
fed AS (SELECT f.seq, f.order_key, action, amount, invoice_id FROM feed f JOIN clean USING (order_key)),
store AS (SELECT * FROM clean),
named AS (SELECT * REPLACE (CASE WHEN action = 'CREATE' THEN invoice_id || '-N' ELSE invoice_id END AS invoice_id) FROM fed WHERE action IN ('CREATE','UPDATE')),
upd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY seq DESC) AS rn FROM named) WHERE rn = 1)"""
SQL["j14_existing_and_new"] = with_(STORE, "SELECT invoice_id, CASE WHEN invoice_id IN (SELECT invoice_id FROM store) THEN 'update' ELSE 'insert' END AS kind FROM upd")
SQL["j15_cascade"] = with_(STORE, "SELECT order_key, position, description FROM items WHERE order_key NOT IN (SELECT order_key FROM feed WHERE action = 'DELETE')")
SQL["j16_language_profile"] = """SELECT doc_id, language, profile, CASE profile WHEN 'Polski' THEN 'pl' WHEN 'Niemiecki' THEN 'de' ELSE 'en' END AS code,
  CASE profile WHEN 'Angielski' THEN '.' ELSE ',' END AS decimal_sep, CASE profile WHEN 'Polski' THEN ' ' WHEN 'Niemiecki' THEN '.' ELSE ',' END AS thousand_sep,
  CASE profile WHEN 'Polski' THEN 'zł' WHEN 'Niemiecki' THEN '€' ELSE '$' END AS symbol
  FROM (SELECT doc_id, CASE lang WHEN 'de' THEN 'Niemiecki' WHEN 'en' THEN 'Angielski' WHEN 'fr' THEN 'Francuski' END AS language,
    CASE lang WHEN 'de' THEN 'Niemiecki' WHEN 'en' THEN 'Angielski' ELSE 'Polski' END AS profile FROM documents)"""

_GENERAL = f"""SELECT count(*) AS total_count, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in TOTALS)},
  round(CAST(sum(total_gross) AS DOUBLE) / count(*), 2) AS avg_gross, CAST(min(total_gross) AS DOUBLE) AS min_gross, CAST(max(total_gross) AS DOUBLE) AS max_gross,
  count(DISTINCT supplier_tax_id) AS unique_suppliers, count(DISTINCT buyer_tax_id) AS unique_buyers,
  count(*) FILTER (is_verified) AS verified_count, count(*) FILTER (is_duplicate) AS duplicate_count FROM done"""
SQL["a01_general"] = with_(FINDINGS, _GENERAL)
SQL["a01_p13_period"] = with_(FINDINGS, _GENERAL + " WHERE issue_date BETWEEN DATE '1997-03-01' AND DATE '1999-09-30'")
SQL["a02_top_suppliers"] = with_(INV, """SELECT supplier_tax_id, max(supplier_name) AS supplier_name, count(*) AS invoice_count, CAST(sum(total_gross) AS DOUBLE) AS total_amount
  FROM inv GROUP BY 1 ORDER BY sum(total_gross) DESC, supplier_tax_id NULLS FIRST LIMIT 10""")
_MONTH = "strftime(issue_date, '%Y-%m')"
_MONTHLY = f"SELECT {_MONTH} AS month, count(*) AS invoice_count, CAST(sum(total_gross) AS DOUBLE) AS total_amount FROM inv GROUP BY 1"
SQL["a03_last_months"] = with_(INV, _MONTHLY + " ORDER BY month DESC LIMIT 12")
SQL["a06_monthly"] = with_(INV, _MONTHLY)
_REPORT = f"""SELECT count(*) AS total_count, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in TOTALS)},
  round(CAST(sum(total_gross) AS DOUBLE) / count(*), 2) AS avg_invoice_value, round(CAST(median(CAST(total_gross AS DOUBLE)) AS DOUBLE), 3) AS median_invoice_value,
  CAST(max(total_gross) AS DOUBLE) AS max_invoice_value, CAST(min(total_gross) AS DOUBLE) AS min_invoice_value,
  count(DISTINCT supplier_name) AS unique_suppliers, count(DISTINCT buyer_name) AS unique_buyers, count(*) FILTER (is_verified) AS valid_invoices,
  count(*) FILTER (n_errors > 0) AS error_invoices, count(*) FILTER (n_warnings > 0 AND n_errors = 0) AS warning_invoices FROM done"""
SQL["a04_report_statistics"] = with_(FINDINGS, _REPORT)
_TOP = "SELECT supplier_name, count(*) AS invoice_count, sum(total_gross) AS total_amount FROM inv GROUP BY 1 ORDER BY total_amount DESC, supplier_name NULLS FIRST LIMIT 20"
SQL["a05_top_names"] = with_(INV, f"SELECT supplier_name, invoice_count, {d('total_amount')} FROM ({_TOP})")
SQL["e10_supplier_rank"] = with_(INV, f"SELECT supplier_name, invoice_count, {d('total_amount')}, row_number() OVER (ORDER BY t.total_amount DESC, supplier_name NULLS FIRST) AS rank FROM ({_TOP}) t")
_PIE = f"""SELECT least(rank, 6) AS slice, CASE WHEN least(rank, 6) = 6 THEN 'Pozostali' ELSE max(supplier_name) END AS name, CAST(sum(total_amount) AS DOUBLE) AS value
  FROM (SELECT *, row_number() OVER (ORDER BY total_amount DESC, supplier_name NULLS FIRST) AS rank FROM ({_TOP})) GROUP BY 1 HAVING least(rank, 6) < 6 OR sum(total_amount) > 0"""
SQL["a07_pie"] = with_(INV, _PIE)
_TYPES = ["BŁĄD", "KOREKTA", "KOŃCOWA", "PROFORMA", "VAT", "ZALICZKOWA"]
_PIVOT = f"""SELECT {_MONTH} AS month, {', '.join(
    f"COALESCE(CAST(sum(total_{m}) FILTER (invoice_type = '{t}') AS DOUBLE), 0) AS \"{t}_{m}\"" for t in _TYPES for m in ('net', 'vat', 'gross'))}
  FROM inv GROUP BY 1"""
SQL["a08_pivot"] = SQL["r06_pivot"] = with_(INV, _PIVOT)
SQL["a09_total_row"] = with_(INV, f"""SELECT file_id, seq, invoice_id, {d(*TOTALS)}, FALSE AS is_total FROM inv
  UNION ALL SELECT NULL, NULL, 'SUMA:', {', '.join(f'CAST(sum({c}) AS DOUBLE)' for c in TOTALS)}, TRUE FROM inv""")
SQL["a10_vat_summary"] = with_(ITEMS, """SELECT CAST(vat_rate AS DOUBLE) AS vat_rate, CAST(sum(net_amount) AS DOUBLE) AS net, CAST(sum(v) AS DOUBLE) AS vat,
  CAST(sum(net_amount + v) AS DOUBLE) AS gross FROM (SELECT *, CAST(round(net_amount * vat_rate * 0.01, 2) AS DECIMAL(18,2)) AS v FROM items) GROUP BY 1""")
SQL["a11_item_sums"] = with_(INV, f"""SELECT file_id, seq, CAST(COALESCE(s, 0) AS DOUBLE) AS items_total, {d('total_gross')}, abs(COALESCE(s, 0) - inv.total_gross) > 0.05 AS differs
  FROM inv LEFT JOIN (SELECT order_key, sum(total) AS s FROM items GROUP BY 1) USING (order_key)""")
SQL["a13_panel"] = with_(FINDINGS, """SELECT count(*) AS total, count(*) FILTER (is_verified) AS valid, count(*) FILTER (n_errors > 0) AS errors,
  count(*) FILTER (n_warnings > 0 AND n_errors = 0) AS warnings, count(*) FILTER (is_duplicate) AS duplicates, CAST(sum(total_gross) AS DOUBLE) AS total_amount FROM done""")
SQL["e03_row_numbers"] = with_(INV, "SELECT file_id, seq, row_number() OVER (ORDER BY file_id, seq) AS lp FROM inv")
SQL["e09_latest_change"] = f"""WITH {FEED} SELECT order_key, seq, action, {d('amount')} FROM feed QUALIFY row_number() OVER (PARTITION BY order_key ORDER BY seq DESC) = 1"""
SQL["u02_replaced_items"] = with_(STORE, f"""SELECT order_key, position, description, {d('total')} FROM items WHERE order_key NOT IN (SELECT order_key FROM feed WHERE action = 'UPDATE')
  UNION ALL SELECT order_key, row_number() OVER (PARTITION BY order_key ORDER BY position), description, CAST(total AS DOUBLE) FROM items
  WHERE order_key IN (SELECT order_key FROM feed WHERE action = 'UPDATE') AND items.total > 20000""")
SQL["u04_all_files"] = with_(CLEAN, f"""SELECT file_id, invoice_id, {d('total_gross')} FROM clean
  UNION ALL SELECT DISTINCT conv_id + 10000000000, NULL, NULL FROM conversations""")

_VAT = "CAST(round(net_amount * vat_rate * 0.01, 2) AS DECIMAL(18,2))"
SQL["n02_vat"] = with_(ITEMS, f"SELECT order_key, position, CAST({_VAT} AS DOUBLE) AS vat, CAST(net_amount + {_VAT} AS DOUBLE) AS gross, {d('net_amount')} FROM items")
_SYMBOL = by_lang("' zł'", "' €'", "' lei'", "' $'")
SQL["n03_format_amount"] = with_(CLEAN, f"SELECT invoice_id, {_money_text('total_gross')} || {_SYMBOL} AS text FROM clean")
SQL["n01_parse_amount"] = with_(CLEAN, "SELECT invoice_id, CAST(total_gross AS DOUBLE) AS amount FROM clean")
SQL["n04_reverse_charge"] = with_(CLEAN, """SELECT invoice_id, country, applicable, CAST(total_net AS DOUBLE) AS net, CAST(v AS DOUBLE) AS vat,
  CAST(total_net + v AS DOUBLE) AS gross, CASE WHEN applicable THEN 'Odwrotne obciążenie - art. 17 ust. 1 pkt 4' END AS note
  FROM (SELECT *, CASE WHEN applicable THEN 0 ELSE CAST(round(total_net * 0.23, 2) AS DECIMAL(18,2)) END AS v
    FROM (SELECT *, country IN ('DE','FR','IT','ES') AS applicable FROM (SELECT *, ['PL','DE','RO','FR','IT','ES'][order_key % 6 + 1] AS country FROM clean)))""")
SQL["n05_item_amounts"] = with_(ITEMS, "SELECT order_key, position, CAST(total - net_amount AS DOUBLE) AS vat_amount, CAST(total AS DOUBLE) AS gross_amount, CAST(net_amount AS DOUBLE) AS net_amount FROM items")
SQL["n06_report_amounts"] = with_(ITEMS, "SELECT order_key, position, round(CAST(total AS DOUBLE) / 1.23, 2) AS net_amount FROM items")
_DMY = "strftime({}, '%d.%m.%Y')"
SQL["d02_d03_format_dates"] = with_(INV, f"""SELECT file_id, seq, {_DMY.format('issue_date')} AS day,
  CASE WHEN supplier_key IS NULL THEN 'Brak daty' ELSE {_DMY.format('due_date')} END AS due,
  CASE language WHEN 'Angielski' THEN strftime(issue_date, '%m/%d/%Y') ELSE {_DMY.format('issue_date')} END AS local_day FROM inv""")
SQL["d04_d05_d06_terms"] = with_(INV, f"SELECT file_id, seq, strftime(issue_date + 14, '%Y-%m-%d') AS due14, due_date - issue_date AS term, {_MONTH} AS month FROM inv")
SQL["c01_nip"] = with_(INV, f"SELECT file_id, seq, {nip_ok('supplier_tax_id')} AS supplier_ok, {nip_ok('buyer_tax_id')} AS buyer_ok FROM inv")
SQL["c01_sql_function"] = with_(INV, f"SELECT file_id, seq, {nip_ok('supplier_tax_id')} AS supplier_ok FROM inv")
SQL["c02_cui"] = f"SELECT c_custkey, {cui_ok('CAST(c_custkey AS VARCHAR)')} AS key_ok, {cui_ok('CAST(c_custkey * 7919 + 1234567 AS VARCHAR)')} AS long_ok FROM customer"
_GROUPS = "rtrim(regexp_replace({}, '(.{{4}})', '\\1 ', 'g'))"
SQL["c03_c06_iban"] = with_(INV, f"""SELECT file_id, seq, COALESCE({pl_iban_ok('account')}, FALSE) AS valid, {_GROUPS.format('account')} AS grouped,
  {_GROUPS.format("'PL' || substr(account, 3)")} AS from_nrb, left(account, 10) AS too_short FROM inv""")
SQL["c04_email"] = r"""SELECT doc_id, count(*) AS emails FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents)
  WHERE regexp_full_match(word, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') GROUP BY 1"""
SQL["c05_phone"] = """SELECT c_custkey, country, CASE country WHEN 'PL' THEN n IN (9, 11) WHEN 'DE' THEN n IN (10, 11, 12) WHEN 'RO' THEN n = 10
  WHEN 'GB' THEN n IN (10, 11) WHEN 'US' THEN n = 10 ELSE n BETWEEN 9 AND 12 END AS ok
  FROM (SELECT c_custkey, ['PL','DE','RO','GB','US','CZ'][c_custkey % 6 + 1] AS country, length(CAST(c_custkey * 104729 * 104729 AS VARCHAR)) AS n FROM customer)"""
_STATUS = """CASE WHEN is_duplicate THEN '🔄 Duplikat' WHEN n_errors > 0 THEN '❌ ' || n_errors || ' błędów' WHEN n_warnings > 0 THEN '⚠️ ' || n_warnings || ' ostrzeżeń'
  WHEN confidence < 0.8 THEN '❓ Niska pewność' ELSE '✅ OK' END"""
SQL["l01_l04_labels"] = with_(FINDINGS, f"""SELECT file_id, seq, {_STATUS} AS status, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN confidence < 0.8 THEN 'Do weryfikacji' ELSE '' END AS review,
  CASE WHEN n_errors > 0 THEN '⚠️ Błędy' WHEN NOT is_verified THEN '❓ Obcy NIP' ELSE '✅ OK' END AS row_status FROM done""")

SQL["v_findings"] = with_(FINDINGS, "SELECT file_id, seq, ordinal, rule, severity, item_pos, detail FROM findings")
SQL["v_by_rule"] = with_(FINDINGS, "SELECT rule, severity, count(*) AS findings FROM findings GROUP BY 1, 2")
SQL["a16_a17_v33_confidence"] = with_(FINDINGS, """SELECT file_id, seq, CAST(confidence AS DOUBLE) AS confidence, is_verified,
  array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings FROM done""")

SQL["k01_upsert"] = with_(STORE, f"""SELECT c.invoice_id, invoice_type, {day('issue_date')}, supplier_tax_id, CAST(total_net AS DOUBLE) AS total_net,
  CAST(CASE WHEN u.invoice_id IS NOT NULL THEN COALESCE(amount, total_gross) ELSE total_gross END AS DOUBLE) AS total_gross,
  CASE WHEN u.invoice_id IS NOT NULL THEN 'nieopłacona' ELSE payment_status END AS payment_status,
  CAST(CASE WHEN u.invoice_id IS NOT NULL THEN 0 ELSE paid_amount END AS DOUBLE) AS paid_amount, u.invoice_id IS NOT NULL AS is_verified,
  'file-' || file_id AS file_path FROM clean c LEFT JOIN upd u USING (invoice_id)
  UNION ALL SELECT u.invoice_id, invoice_type, {day('issue_date')}, supplier_tax_id, CAST(total_net AS DOUBLE), CAST(COALESCE(amount, total_gross) AS DOUBLE),
  'nieopłacona', 0.0, TRUE, 'new' FROM upd u JOIN clean c USING (order_key) WHERE u.action = 'CREATE'""")
SQL["k02_items_of_upserts"] = with_(STORE, """SELECT order_key, position, description FROM items WHERE order_key NOT IN (SELECT order_key FROM feed WHERE action IN ('CREATE','UPDATE'))
  UNION ALL SELECT order_key, position - 1, description FROM items WHERE order_key IN (SELECT order_key FROM feed WHERE action IN ('CREATE','UPDATE')) AND position > 1""")
SQL["k03_delete"] = with_(STORE, f"SELECT invoice_id, {d('total_gross')} FROM store WHERE order_key NOT IN (SELECT order_key FROM feed WHERE action = 'DELETE')")
SQL["k04_mark_paid"] = with_(STORE, """, pay AS (SELECT order_key, amount FROM feed WHERE action = 'PAYMENT' QUALIFY row_number() OVER (PARTITION BY order_key ORDER BY seq DESC) = 1)
  SELECT invoice_id, CASE WHEN p.order_key IS NOT NULL THEN 'opłacona' ELSE payment_status END AS payment_status,
  CAST(CASE WHEN p.order_key IS NOT NULL THEN COALESCE(amount, total_gross) ELSE paid_amount END AS DOUBLE) AS paid_amount
  FROM store LEFT JOIN pay p USING (order_key)""")
SQL["k05_verify"] = with_(STORE, "SELECT invoice_id, order_key IN (SELECT order_key FROM feed WHERE action = 'VERIFY') AS is_verified FROM store")
SQL["k_updated_at"] = with_(STORE, """, stamps AS (SELECT event_id AS seq, ts FROM events),
  pay AS (SELECT order_key, ts FROM feed JOIN stamps USING (seq) WHERE action = 'PAYMENT' QUALIFY row_number() OVER (PARTITION BY order_key ORDER BY seq DESC) = 1),
  ver AS (SELECT order_key, ts FROM feed JOIN stamps USING (seq) WHERE action = 'VERIFY' QUALIFY row_number() OVER (PARTITION BY order_key ORDER BY seq DESC) = 1)
  SELECT c.invoice_id, strftime(COALESCE(v.ts, p.ts, t.ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM clean c LEFT JOIN upd u ON u.invoice_id = c.invoice_id
    LEFT JOIN stamps t ON t.seq = u.seq LEFT JOIN pay p ON p.order_key = c.order_key LEFT JOIN ver v ON v.order_key = c.order_key
  UNION ALL SELECT u.invoice_id, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM upd u JOIN stamps USING (seq) WHERE u.action = 'CREATE'""")
SQL["k06_audit"] = with_(STORE, """SELECT seq, invoice_id, action, 'SYSTEM' AS user, CASE action WHEN 'PAYMENT' THEN CASE WHEN amount IS NULL THEN '{}' ELSE '{"amount":' || amount || '}' END
  WHEN 'VERIFY' THEN '{"verified":true}' END AS changes FROM fed""")

SQL["r01_summary"] = with_(FINDINGS, f"""SELECT row_number() OVER (ORDER BY file_id, seq) AS lp, COALESCE(invoice_id, 'UNKNOWN') AS invoice_id, invoice_type,
  {_DMY.format('issue_date')} AS issue_date, {_DMY.format('sale_date')} AS sale_date, {_DMY.format('due_date')} AS due_date,
  COALESCE(left(supplier_name, 50), 'Nie znaleziono') AS supplier_name, COALESCE(supplier_tax_id, 'Brak') AS supplier_tax_id, left(buyer_name, 50) AS buyer_name,
  COALESCE(buyer_tax_id, 'Brak') AS buyer_tax_id, COALESCE(account, 'Brak') AS account, {d(*TOTALS)}, currency, {_STATUS} AS status, array_to_string(warnings[1:3], ', ') AS notes FROM done
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'SUMA:', NULL, {', '.join(f'CAST(sum({c}) AS DOUBLE)' for c in TOTALS)}, NULL, NULL, NULL FROM done""")
_ISO = "strftime({}, '%Y-%m-%d')"
_PAIRS = [
    ("'FAKTURA: ' || COALESCE(invoice_id, 'UNKNOWN')", "''"), ("'Typ dokumentu:'", "invoice_type"),
    ("'Data wystawienia:'", _ISO.format("issue_date")), ("'Data sprzedaży:'", _ISO.format("sale_date")),
    ("'Termin płatności:'", _ISO.format("due_date")), ("''", "''"), ("'SPRZEDAWCA'", "''"),
    ("'Nazwa:'", "COALESCE(supplier_name, 'Nie znaleziono')"), ("'NIP:'", "COALESCE(supplier_tax_id, 'Brak')"),
    ("'Adres:'", "COALESCE(supplier_address, 'Nie znaleziono')"), ("'Konto:'", "COALESCE(account, 'Brak')"), ("''", "''"),
    ("'NABYWCA'", "''"), ("'Nazwa:'", "buyer_name"), ("'NIP:'", "COALESCE(buyer_tax_id, 'Brak')"),
    ("'Adres:'", "buyer_address"), ("''", "''"), ("'PODSUMOWANIE'", "''"),
    ("'Wartość netto:'", "total_net || ' ' || currency"), ("'VAT:'", "total_vat || ' ' || currency"),
    ("'Wartość brutto:'", "total_gross || ' ' || currency"), ("''", "''"),
    ("'Metoda płatności:'", "payment_method"), ("'Status płatności:'", "payment_status"),
]
SQL["r02_details"] = with_(INV, " UNION ALL ".join(
    f"SELECT file_id, seq, {i} AS ordinal, {a} AS label, {b} AS value FROM inv" for i, (a, b) in enumerate(_PAIRS)
) + """ UNION ALL SELECT file_id, seq, 23 + position, 'Pozycja ' || position, description || ' | ' || quantity || ' | ' || unit_price || ' | ' || total
  FROM inv JOIN items USING (order_key)""")
SQL["r03_items"] = with_(INV, f"""SELECT file_id, seq, COALESCE(invoice_id, 'UNKNOWN') AS invoice_id, {day('issue_date')}, left(COALESCE(supplier_name, 'Nie znaleziono'), 30) AS supplier_name,
  position AS lp, left(description, 100) AS description, quantity, {d('unit_price', 'net_amount')}, CAST(total - net_amount AS DOUBLE) AS vat_amount, CAST(total AS DOUBLE) AS gross_amount
  FROM inv JOIN items USING (order_key)""")
_FIGURES = [
    ("Liczba faktur:", "total_count"), ("Łączna wartość netto:", "total_net"), ("Łączny VAT:", "total_vat"),
    ("Łączna wartość brutto:", "total_gross"), ("Średnia wartość faktury:", "avg_invoice_value"), ("Mediana wartości:", "median_invoice_value"),
    ("Najwyższa faktura:", "max_invoice_value"), ("Najniższa faktura:", "min_invoice_value"), ("Liczba dostawców:", "unique_suppliers"),
    ("Liczba nabywców:", "unique_buyers"), ("Faktury OK:", "valid_invoices"), ("Faktury z błędami:", "error_invoices"),
    ("Faktury z ostrzeżeniami:", "warning_invoices"),
]
SQL["r04_statistics"] = with_(FINDINGS, f", rep AS ({_REPORT}) " + " UNION ALL ".join(
    f"SELECT 'STATYSTYKI OGÓLNE' AS section, '{t}' AS label, CAST(NULL AS BIGINT) AS invoice_count, round(CAST({c} AS DOUBLE), 2) AS amount FROM rep" for t, c in _FIGURES
) + f""" UNION ALL SELECT * FROM (SELECT 'TOP 10 DOSTAWCÓW', COALESCE(supplier_name, 'Nie znaleziono'), invoice_count, CAST(total_amount AS DOUBLE) FROM ({_TOP}) t ORDER BY t.total_amount DESC, supplier_name NULLS FIRST LIMIT 10)
  UNION ALL SELECT 'PODSUMOWANIE MIESIĘCZNE', month, invoice_count, total_amount FROM ({_MONTHLY})""")
SQL["r05_charts"] = with_(INV, f"""SELECT 'pie' AS chart, COALESCE(name, 'Nie znaleziono') AS label, value FROM ({_PIE}) UNION ALL SELECT 'bar', month, total_amount FROM ({_MONTHLY})""")
SQL["r07_validation"] = with_(FINDINGS, """SELECT file_id, seq, COALESCE(invoice_id, 'UNKNOWN') AS invoice_id, CASE WHEN is_verified THEN '✅ OK' ELSE '❌ Błąd' END AS status,
  format('{:.1f}', CAST(confidence * 100 AS DOUBLE)) || '%' AS confidence, CASE WHEN n_errors > 0 THEN array_to_string(errors, '; ') ELSE 'Brak' END AS errors,
  CASE WHEN n_warnings > 0 THEN array_to_string(warnings, '; ') ELSE 'Brak' END AS warnings, CASE WHEN done.confidence < 0.8 THEN 'Do weryfikacji' ELSE '' END AS notes FROM done""")
SQL["s08_json_export"] = with_(FINDINGS, """SELECT invoice_id, supplier_tax_id, CAST(total_gross AS DOUBLE) AS gross, currency, description AS first_item
  FROM done LEFT JOIN (SELECT * FROM items WHERE position = 1) USING (order_key)""")
SQL["s10_json_columns"] = with_(FINDINGS, "SELECT file_id, seq, n_warnings, account FROM done")
