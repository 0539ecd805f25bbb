"""Expected results of the queries over texts, pages and words."""

from __future__ import annotations

from ledgerloom.dims import END_KEYWORDS, KEYWORDS, LANGUAGES, PAGE_HEADERS, PATTERNS, START_KEYWORDS, SUMMARY_PATTERNS, TABLE_INDICATORS
from oracle.fixtures import FINDINGS, INV, PAGES, by_lang, nip_ok, with_
from oracle.relational import d, day

SQL: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Between digits: two passes stand in for look-around.
_clean = "regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[←→↑↓■□▪▫◆◇○●]', '', 'g')"
for _old, _new in {"l": "1", "O": "0", "S": "5", "Z": "2", "\\|": "I", "!": "1", "@": "a", "#": "H"}.items():
    for _ in range(2):
        _clean = f"regexp_replace({_clean}, '([0-9]){_old}([0-9])', '\\1{_new}\\2', 'g')"
SQL["t01_clean_text"] = f"SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, trim({_clean}, ' ') AS c FROM documents)"

_NUMBER = r"[0-9]{1,3}(?: [0-9]{3})+(?:,[0-9]{2})?|[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]{2})?|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{2})?|[0-9]+(?:[.,][0-9]+)?"
_DATES = r"[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}"


def tokens(text: str) -> str:
    return f"regexp_extract_all(regexp_replace({text}, '{_DATES}', '', 'g'), '{_NUMBER}')"


_VALUE = """TRY_CAST(CASE
  WHEN contains(x, ',') AND contains(x, '.') AND length(split_part(reverse(x), ',', 1)) < length(split_part(reverse(x), '.', 1)) THEN replace(replace(x, '.', ''), ',', '.')
  WHEN contains(x, ',') AND contains(x, '.') THEN replace(x, ',', '')
  WHEN regexp_full_match(x, '[^,]*,[^,][^,]') THEN replace(x, ',', '.')
  WHEN contains(x, ',') THEN replace(x, ',', '')
  WHEN length(x) - length(replace(x, '.', '')) > 1 THEN replace(x, '.', '') ELSE x END AS DECIMAL(38,6))"""
_NUMBERS = """numbers AS (SELECT *, {value} AS v FROM (SELECT {keys}, unnest({tokens}) AS raw, generate_subscripts({tokens}, 1) AS i, replace(raw, ' ', '') AS x FROM {source})),
  kept AS (SELECT * FROM numbers WHERE v > 0 AND v < 10000000)"""
SQL["t02_numbers"] = f"""WITH {_NUMBERS.format(value=_VALUE, keys='doc_id', tokens=tokens('text'), source='documents')}
  SELECT doc_id, count(*) AS n, CAST(arg_min(v, i) AS DOUBLE) AS first, CAST(arg_max(v, i) AS DOUBLE) AS last, CAST(max(v) AS DOUBLE) AS largest FROM kept GROUP BY 1"""
SQL["t02_page_numbers"] = with_(PAGES, f""", lined AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS line FROM invoice_pages),
  {_NUMBERS.format(value=_VALUE, keys='doc_id, page_no', tokens=tokens('line'), source='lined')}
  SELECT doc_id, page_no, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM kept GROUP BY 1, 2""")


def rx(pattern: str) -> str:
    return q("(?i)" + pattern)


def hits(words: dict[str, list[str]]) -> str:
    def count(ws: list[str]) -> str:
        return "(" + " + ".join(f"CAST(contains(up, {q(w)}) AS INT)" for w in ws) + ")"

    return by_lang(*[count(words[n]) for n in LANGUAGES])


_header = " ".join(f"WHEN regexp_matches(text, {rx(p)}) THEN {i}" for i, p in enumerate(PAGE_HEADERS))
_number = " ".join(
    f"WHEN {i} THEN regexp_extract(text, {rx(p + chr(92) + 's*([A-Z0-9/' + chr(92) + '-' + chr(92) + '.]+)')}, 1)" for i, p in enumerate(PAGE_HEADERS)
)
_items = " + ".join(f"CAST(regexp_matches(text, {rx(p)}) AS INT)" for p in TABLE_INDICATORS)
_summary = " OR ".join(f"regexp_matches(text, {rx(p)})" for p in SUMMARY_PATTERNS)
SQL["t19_t22_page_flags"] = with_(PAGES, f""", f1 AS (SELECT doc_id, page_no, language, text, upper(text) AS up, CASE {_header} END AS header FROM all_pages),
  f2 AS (SELECT doc_id, page_no, header IS NOT NULL AS has_header, CASE header {_number} END AS num, {hits(START_KEYWORDS)} >= 2 AS start_keywords, {hits(END_KEYWORDS)} >= 2 AS end_keywords,
    ({_items}) >= 3 OR len(regexp_extract_all(text, '[0-9]+[,.][0-9]{{2}}')) >= 5 AS has_items, ({_summary}) AS has_summary,
    regexp_matches(text, '(?i)PODPIS|SIGNATURE|UNTERSCHRIFT') AS has_signature, nullif(regexp_extract(text, '(?i)(?:RAZEM|TOTAL|SUMA)[:\\s]+([0-9\\s,\\.]+)', 1), '') AS tt FROM f1),
  f3 AS (SELECT * EXCLUDE (num, tt), CASE WHEN regexp_matches(num, '[0-9]') THEN num END AS header_number, CASE WHEN has_summary THEN tt END AS total_text FROM f2)
  SELECT *, CAST(least(100, CASE WHEN has_header THEN 30 ELSE 0 END + CASE WHEN start_keywords THEN 20 ELSE 0 END + CASE WHEN end_keywords THEN 15 ELSE 0 END
    + CASE WHEN has_items THEN 15 ELSE 0 END + CASE WHEN has_summary THEN 15 ELSE 0 END + CASE WHEN has_signature THEN 5 ELSE 0 END
    + CASE WHEN header_number IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN total_text IS NOT NULL THEN 5 ELSE 0 END) / 100.0 AS DOUBLE) AS page_confidence FROM f3""")
_NUMERIC = """length({t}) AS n_chars_seen, length({t}) - length(replace({t}, chr(10), '')) AS n_lines,
  len(regexp_extract_all({t}, '[0-9]+')) AS n_numbers, len(regexp_extract_all({t}, '[A-Z]{{2,}}')) AS n_caps"""
SQL["t24_text_features"] = f"""SELECT 'documents' AS kind, doc_id AS id, {_NUMERIC.format(t='text')} FROM documents
  UNION ALL SELECT 'pages', page_id, {_NUMERIC.format(t='html')} FROM pages UNION ALL SELECT 'talk', conv_id * 1000 + turn, {_NUMERIC.format(t='text')} FROM conversations"""
SQL["s03_discovery"] = "SELECT item_id, strlen(text) + 1 AS file_size, true AS named FROM benchmark"
SQL["s04_file_digests"] = "SELECT item_id, sha256(text || chr(10)) AS file_hash FROM benchmark"
SQL["s04_text_digest"] = "SELECT doc_id, sha256(text) AS digest FROM documents"


def score(lang: str) -> str:
    words = [f"CAST(contains(up, {q(w)}) AS INT)" for ws in KEYWORDS[lang].values() for w in ws]
    found = []
    for kind, patterns in PATTERNS[lang].items():
        for p in patterns:
            plain = p.replace(r"(?<!\d)\d{26}(?!\d)", r"(?:^|[^0-9])[0-9]{26}(?:[^0-9]|$)").replace(r"(\d{10})(?!\d)", r"(\d{10})(?:[^0-9]|$)")
            found.append(f"2 * CAST(regexp_matches(text, {q(plain) if kind == 'bank_account' else rx(plain)}) AS INT)")
    return " + ".join(words + found)


_scores = ", ".join(f"{score(lang)} AS s{i}" for i, lang in enumerate(LANGUAGES))
_best = " ".join(f"WHEN s{i} = score THEN '{lang}'" for i, lang in enumerate(LANGUAGES))
SQL["a18_language"] = f"""WITH s AS (SELECT doc_id, {_scores} FROM (SELECT doc_id, text, upper(text) AS up FROM documents)),
  m AS (SELECT *, greatest(s0, s1, s2, s3) AS score FROM s) SELECT doc_id, score, CASE {_best} END AS detected FROM m"""
SQL["t25_document_language"] = with_(PAGES, f""", s AS (SELECT doc_id, {_scores} FROM (SELECT doc_id, text, upper(text) AS up FROM invoice_pages WHERE page_no = 1)),
  m AS (SELECT doc_id, CASE {_best} END AS detected FROM (SELECT *, greatest(s0, s1, s2, s3) AS score FROM s))
  SELECT detected AS language, count(*) AS pages FROM invoice_pages JOIN m USING (doc_id) GROUP BY 1""")

# A Polish number ends in k/MM/yyyy, so its last two digits may read as a day.
_ID_DAY = "TRY_STRPTIME(right('0' || (order_key % 100), 2) || strftime(issue_date, '/%m/%Y'), '%d/%m/%Y')"
SQL["d01_parse_date"] = with_(PAGES, f"""SELECT doc_id, page_no, strftime(CASE WHEN part = 1 THEN CASE WHEN p.language = 'Polski' THEN COALESCE({_ID_DAY}, issue_date) ELSE issue_date END END, '%Y-%m-%d') AS day
  FROM invoice_pages p JOIN clean USING (order_key) UNION ALL SELECT conv_id + 10000000000, turn + 1, NULL FROM conversations""")
SQL["t10_e06_date_hits"] = with_(PAGES, f""", h AS (SELECT doc_id, page_no, part, issue_date, due_date, CASE WHEN part = 1 AND p.language = 'Polski' AND order_key >= 10 THEN CAST({_ID_DAY} AS DATE) END AS id_day
    FROM invoice_pages p JOIN clean USING (order_key))
  SELECT doc_id, page_no, CASE WHEN part = 1 THEN 3 + CAST(id_day IS NOT NULL AS INT) ELSE 0 END AS n, CASE WHEN part = 1 THEN strftime(COALESCE(id_day, issue_date), '%Y-%m-%d') END AS first,
    CASE WHEN part = 1 THEN strftime(due_date, '%Y-%m-%d') END AS last FROM h UNION ALL SELECT conv_id + 10000000000, turn + 1, 0, NULL, NULL FROM conversations""")
_ACCOUNT = "rtrim(regexp_replace(account, '(.{4})', '\\1 ', 'g'))"
SQL["c07_accounts"] = with_(PAGES, f"""SELECT doc_id, page_no, CASE WHEN part = 1 AND account IS NOT NULL THEN {_ACCOUNT} ELSE '' END AS accounts FROM invoice_pages JOIN clean USING (order_key)
  UNION ALL SELECT conv_id + 10000000000, turn + 1, '' FROM conversations""")

_BOUND = f"doc_id, start_page, end_page, {d('confidence')}"
SQL["e01_boundaries"] = with_(PAGES, f"SELECT {_BOUND}, boundary_type, detected_number FROM bounds")
SQL["e01_whole_documents"] = with_(PAGES, "SELECT doc_id, 1 AS start_page, count(*) AS end_page, CAST(1 AS DOUBLE) AS confidence, 'SINGLE' AS boundary_type FROM all_pages GROUP BY 1")
SQL["e02_boundaries_unchanged"] = with_(PAGES, f"SELECT {_BOUND} FROM bounds")
SQL["e02_clean_intervals"] = """WITH iv AS (SELECT l_orderkey AS doc_id, l_linenumber * 2 AS s, CAST(l_linenumber * 2 + l_quantity % 5 - 1 AS INT) AS e FROM lineitem),
  ok AS (SELECT doc_id, s, max(e) AS e, count(*) AS n FROM iv WHERE e >= s GROUP BY 1, 2),
  o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok),
  g AS (SELECT *, count(*) FILTER (reach IS NULL OR s > reach) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM o)
  SELECT doc_id, min(s) AS start_page, max(e) AS end_page, round(0.8 * pow(0.9, sum(n) - 1), 6) AS confidence, CAST(sum(n) AS BIGINT) AS merged FROM g GROUP BY doc_id, island"""
SQL["t23_merged_texts"] = with_(PAGES, """, m AS (SELECT b.doc_id, start_page, end_page, boundary_type, string_agg(text, chr(10) || chr(10) || '--- NOWA STRONA ---' || chr(10) || chr(10) ORDER BY page_no) AS t
  FROM bounds b JOIN all_pages p ON p.doc_id = b.doc_id AND page_no BETWEEN start_page AND end_page WHERE text <> '' GROUP BY 1, 2, 3, 4)
  SELECT doc_id, start_page, end_page, boundary_type, length(t) AS n, md5(t) AS digest FROM m""")
SQL["a15_segmentation_summary"] = with_(PAGES, """, s AS (SELECT doc_id, count(*) AS total_invoices, count(*) FILTER (confidence < 0.6) AS low,
    count(*) FILTER (boundary_type = 'INCOMPLETE') AS incomplete, count(detected_number) > count(DISTINCT detected_number) AS repeated FROM bounds GROUP BY 1)
  SELECT *, concat_ws('; ', CASE WHEN low > 0 THEN 'Wykryto ' || low || ' faktur z niską pewnością (<60%)' END,
    CASE WHEN incomplete > 0 THEN 'Wykryto ' || incomplete || ' potencjalnie niekompletnych faktur' END, CASE WHEN repeated THEN 'Wykryto duplikaty numerów faktur' END) AS issues FROM s""")
_SIZED = PAGES[PAGES.index("sized AS") : PAGES.index("row_text AS")].rstrip().rstrip(",")
SQL["a12_batch_statistics"] = with_(f"{FINDINGS}, {_SIZED}", f""", dups AS (SELECT a.file_id, count(*) AS p FROM inv a JOIN inv b ON a.file_id = b.file_id AND a.seq < b.seq AND (a.invoice_id = b.invoice_id
    OR (a.supplier_tax_id = b.supplier_tax_id AND a.issue_date = b.issue_date AND a.total_gross = b.total_gross)) GROUP BY 1),
  pg AS (SELECT file_id, CAST(sum(n_pages) AS BIGINT) AS total_pages, count(*) AS invoices_detected FROM placed GROUP BY 1),
  parsed AS (SELECT file_id, count(*) AS invoices_parsed, count(*) FILTER (is_verified) AS invoices_valid, count(*) FILTER (n_errors > 0) AS invoices_with_errors, CAST(sum(total_gross) AS DOUBLE) AS total_amount FROM done GROUP BY 1)
  SELECT file_id, total_pages, invoices_detected, invoices_parsed, invoices_valid, invoices_with_errors, total_amount, COALESCE(p, 0) AS duplicate_pairs
  FROM pg JOIN parsed USING (file_id) LEFT JOIN dups USING (file_id)""")
_SIZED_INV = f"{INV}, {_SIZED}"
SQL["s12_run_record"] = with_(_SIZED_INV, """SELECT (SELECT count(DISTINCT file_id) FROM placed) + (SELECT count(DISTINCT conv_id) FROM conversations) AS files,
  CAST((SELECT sum(n_pages) FROM placed) + (SELECT count(*) FROM conversations) AS BIGINT) AS total_pages, (SELECT count(*) FROM inv) AS invoices_count, 'tesseract' AS ocr_engine, 'Polski' AS language""")

WORDS = f"""{PAGES},
lines AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM invoice_pages),
toks AS (SELECT doc_id, page_no, line, unnest(regexp_split_to_array(row, '\\s+')) AS token, generate_subscripts(regexp_split_to_array(row, '\\s+'), 1) - 1 AS pos FROM lines),
words AS (
  SELECT doc_id, page_no, line, pos, 'a' AS engine, token AS text, CASE WHEN (line * 7 + pos) % 13 = 5 THEN -1 ELSE 60 + (line * 7 + pos) * 7 % 40 END AS conf FROM toks WHERE token <> ''
  UNION ALL SELECT doc_id, page_no, line, pos, 'b', CASE WHEN (line * 7 + pos) % 10 = 3 THEN left(token, length(token) - 1) ELSE token END,
    CASE WHEN (line * 7 + pos) % 13 = 5 THEN -1 ELSE 60 + (line * 7 + pos) * 11 % 40 END FROM toks WHERE token <> ''),
reads AS (SELECT doc_id, page_no, engine, string_agg(text, chr(10) ORDER BY line, pos) FILTER (conf > 0) AS text, count(*) FILTER (conf > 0) AS n,
  COALESCE(avg(conf) FILTER (conf > 0) / 100, 0) AS confidence FROM words GROUP BY 1, 2, 3)"""
SQL["a14_page_confidence"] = with_(WORDS, "SELECT doc_id, page_no, engine, round(confidence, 6) AS confidence FROM reads")
SQL["e05_reading_order"] = with_(WORDS, "SELECT doc_id, page_no, engine, n AS words, md5(text) AS digest FROM reads")
SQL["e04_best_engine"] = with_(WORDS, """SELECT doc_id, page_no, CASE WHEN b.confidence > a.confidence THEN 'b' ELSE 'a' END AS engine, round(greatest(a.confidence, b.confidence), 6) AS confidence
  FROM (SELECT * FROM reads WHERE engine = 'a') a JOIN (SELECT * FROM reads WHERE engine = 'b') b USING (doc_id, page_no)""")
SQL["j12_u03_merged_engines"] = with_(WORDS, """SELECT doc_id, page_no, 'hybrid' AS engine, a.n + b.n AS boxes, round((a.confidence + b.confidence) / 2, 6) AS confidence, md5(a.text) AS digest
  FROM (SELECT * FROM reads WHERE engine = 'a') a JOIN (SELECT * FROM reads WHERE engine = 'b') b USING (doc_id, page_no)""")

# What the records say about each boundary; ids fail their check as in the engine's rules.
TRUTH = f"""{PAGES},
truth AS (SELECT clean.*, doc_id, start_page, end_page, n_items,
    CASE WHEN clean.language <> 'Polski' OR {nip_ok('supplier_tax_id')} THEN supplier_tax_id END AS s_ok,
    CASE WHEN clean.language <> 'Polski' OR {nip_ok('buyer_tax_id')} THEN buyer_tax_id END AS b_ok,
    greatest(1, CAST(substr(buyer_name, 10) AS INT)) AS stray, n_items = 0 AS no_items
  FROM bounds JOIN clean USING (order_key) JOIN (SELECT order_key, n_items FROM sized) USING (order_key))"""
_KEY = "file_id, start_page, end_page"
SQL["t05_t06_number_type"] = with_(TRUTH, f"SELECT {_KEY}, invoice_id, invoice_type FROM truth")
SQL["j06_t11_dates"] = with_(TRUTH, f"SELECT {_KEY}, {day('issue_date', 'sale_date', 'due_date')} FROM truth")
SQL["t07_j07_parties"] = with_(TRUTH, f"SELECT {_KEY}, COALESCE(s_ok, b_ok) AS supplier_tax_id, COALESCE(b_ok, s_ok) AS buyer_tax_id FROM truth")
SQL["j08_own_tax_id"] = with_(TRUTH, f"""SELECT {_KEY}, COALESCE(s_ok, b_ok) AS supplier_tax_id, COALESCE(b_ok, s_ok) AS buyer_tax_id, COALESCE(b_ok = '1000000006', FALSE) AS belongs_to_user FROM truth""")
SQL["t08_t09_names_addresses"] = with_(TRUTH, f"""SELECT {_KEY}, supplier_name, buyer_name, CASE WHEN COALESCE(s_ok, b_ok) IS NOT NULL THEN '00-001 Miasto' END AS supplier_address,
  CASE WHEN COALESCE(b_ok, s_ok) IS NOT NULL THEN '00-001 Miasto' END AS buyer_address, {_ACCOUNT} AS account FROM truth""")
# An order without lines has no sums; its only number lines follow the buyer label, so the rule for texts without
# a table reads one item there, and the totals come from it.
_GROSS = "CASE WHEN no_items THEN CAST(stray AS DOUBLE) ELSE CAST(total_gross AS DOUBLE) END"
_NET = "CASE WHEN no_items THEN round(stray / 1.23, 2) ELSE CAST(total_net AS DOUBLE) END"
_TAX = "CASE WHEN no_items THEN CAST(stray - CAST(round(stray / 1.23, 2) AS DECIMAL(18,2)) AS DOUBLE) ELSE CAST(total_vat AS DOUBLE) END"
SQL["t12_t13_totals"] = with_(TRUTH, f"SELECT {_KEY}, {_NET} AS total_net, {_TAX} AS total_vat, {_GROSS} AS total_gross, no_items AS totals_from_items FROM truth")
_STATUS = "CASE WHEN payment_status = 'nieopłacona' AND invoice_type = 'ZALICZKOWA' THEN 'częściowo opłacona' ELSE payment_status END"
SQL["t14_t15_t16_payment"] = with_(TRUTH, f"""SELECT {_KEY}, CASE WHEN n_items > 0 THEN currency ELSE 'PLN' END AS currency, payment_method, {_STATUS} AS payment_status,
  CASE WHEN no_items AND payment_status = 'opłacona' THEN CAST(stray AS DOUBLE) ELSE CAST(paid_amount AS DOUBLE) END AS paid_amount FROM truth""")
SQL["e07_t17_t18_items"] = with_(TRUTH, f"""SELECT {_KEY}, position, description, quantity, {d('unit_price', 'total')} FROM truth JOIN items USING (order_key)
  UNION ALL SELECT {_KEY}, 1, CASE WHEN buyer_name = 'Customer#000000000' THEN buyer_name ELSE {by_lang("'NABYWCA:'", "'KÄUFER:'", "'CUMPĂRĂTOR:'", "'BUYER:'")} END, 1,
    CAST(stray AS DOUBLE), CAST(stray AS DOUBLE) FROM truth WHERE no_items""")
SQL["e11_label_positions"] = with_(PAGES, """SELECT doc_id, page_no, CASE WHEN part = 1 AND supplier_name IS NOT NULL THEN strpos(text, s || ':' || chr(10)) - 1 ELSE -1 END AS seller,
  CASE WHEN part = 1 THEN strpos(text, chr(10) || b || ':' || chr(10)) ELSE -1 END AS buyer
  FROM (SELECT p.doc_id, p.page_no, p.part, p.text, supplier_name, CASE p.language WHEN 'Polski' THEN 'SPRZEDAWCA' WHEN 'Niemiecki' THEN 'VERKÄUFER' WHEN 'Rumuński' THEN 'FURNIZOR' ELSE 'SELLER' END AS s,
    CASE p.language WHEN 'Polski' THEN 'NABYWCA' WHEN 'Niemiecki' THEN 'KÄUFER' WHEN 'Rumuński' THEN 'CUMPĂRĂTOR' ELSE 'BUYER' END AS b FROM invoice_pages p JOIN clean USING (order_key))""")
SQL["k07_error_records"] = """SELECT conv_id + 10000000000 AS file_id, 'ERROR_1' AS invoice_id, 'BŁĄD' AS invoice_type, TRUE AS failed,
  least(500, sum(length(text)) + 23 * (count(*) - 1)) AS kept FROM conversations GROUP BY conv_id"""
SQL["j05_extracted_duplicates"] = with_(TRUTH, """, t AS (SELECT * REPLACE (CASE WHEN no_items THEN stray ELSE total_gross END AS total_gross), COALESCE(s_ok, b_ok) AS sup FROM truth)
  SELECT file_id, start_page AS seq, (sup IS NOT NULL AND count(*) OVER (PARTITION BY file_id, sup, issue_date, total_gross) > 1)
    OR count(*) OVER (PARTITION BY file_id, invoice_id) > 1 AS is_duplicate FROM t""")
# Errors that the clean records can show once read back: no seller name, one id read for both parties, no seller at all.
SQL["flagship_supplier_totals"] = with_(TRUTH, f""", t AS (SELECT COALESCE(s_ok, b_ok) AS supplier_tax_id, {_GROSS} AS g,
    CAST(no_items AS INT) + CAST((s_ok IS NULL) <> (b_ok IS NULL) AS INT) + CAST(no_items AND b_ok IS NULL AS INT) AS e FROM truth)
  SELECT supplier_tax_id, count(*) AS invoices, count(*) FILTER (e = 0) AS valid, CAST(sum(e) AS BIGINT) AS errors,
    CAST(sum(CAST(g AS DECIMAL(18,2))) AS DOUBLE) AS total_gross FROM t GROUP BY 1""")
