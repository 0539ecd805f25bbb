"""Fixed dimension values: language profiles, keyword lists, patterns, rates, banks, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Languages in tie-break order, their codes, separators, symbol, first date format.
LANGUAGES = ["Polski", "Niemiecki", "Rumuński", "Angielski"]
DEFAULT_LANGUAGE = "Polski"
LANG_CODE = {"Polski": "pl", "Niemiecki": "de", "Rumuński": "ro", "Angielski": "en"}
DECIMAL_SEP = {"Polski": ",", "Niemiecki": ",", "Rumuński": ",", "Angielski": "."}
THOUSAND_SEP = {"Polski": " ", "Niemiecki": ".", "Rumuński": ".", "Angielski": ","}
CURRENCY_SYMBOL = {"Polski": "zł", "Niemiecki": "€", "Rumuński": "lei", "Angielski": "$"}
DATE_FORMAT = {
    "Polski": "dd.MM.yyyy",
    "Niemiecki": "dd.MM.yyyy",
    "Rumuński": "dd.MM.yyyy",
    "Angielski": "MM/dd/yyyy",
}

# Keywords by language and role.
KEYWORDS = {
    "Polski": {
        "invoice_header": ["FAKTURA", "FAKTURA VAT", "FAKTURA PROFORMA", "NOTA"],
        "seller": ["SPRZEDAWCA", "SPRZEDAJĄCY", "DOSTAWCA", "WYSTAWCA", "USŁUGODAWCA"],
        "buyer": ["NABYWCA", "KUPUJĄCY", "ODBIORCA", "PŁATNIK", "ZAMAWIAJĄCY"],
        "nip": ["NIP", "REGON", "KRS"],
        "payment": ["ZAPŁATA", "TERMIN PŁATNOŚCI", "DO ZAPŁATY", "FORMA PŁATNOŚCI"],
        "bank": ["BANK", "KONTO", "RACHUNEK", "IBAN", "SWIFT"],
        "summary": ["SUMA", "RAZEM", "DO ZAPŁATY", "WARTOŚĆ", "OGÓŁEM"],
        "items": ["LP", "NAZWA", "ILOŚĆ", "CENA", "WARTOŚĆ", "NETTO", "VAT", "BRUTTO"],
        "dates": ["DATA WYSTAWIENIA", "DATA SPRZEDAŻY", "TERMIN PŁATNOŚCI"],
        "signature": ["PODPIS", "PIECZĄTKA", "WYSTAWIŁ", "ODEBRAŁ"],
    },
    "Niemiecki": {
        "invoice_header": ["RECHNUNG", "QUITTUNG", "BELEG", "FAKTURA"],
        "seller": ["VERKÄUFER", "LIEFERANT", "ANBIETER", "LEISTUNGSERBRINGER"],
        "buyer": ["KÄUFER", "KUNDE", "EMPFÄNGER", "AUFTRAGGEBER"],
        "nip": ["UST-IDNR", "STEUERNUMMER", "HANDELSREGISTER"],
        "payment": ["ZAHLUNG", "ZAHLUNGSBEDINGUNGEN", "FÄLLIGKEIT", "ZAHLBAR"],
        "bank": ["BANK", "IBAN", "BIC", "SWIFT", "KONTONUMMER"],
        "summary": ["GESAMT", "SUMME", "TOTAL", "BETRAG", "ENDBETRAG"],
        "items": ["POS", "BEZEICHNUNG", "MENGE", "PREIS", "BETRAG", "NETTO", "MWST", "BRUTTO"],
        "dates": ["RECHNUNGSDATUM", "LIEFERDATUM", "ZAHLUNGSZIEL"],
        "signature": ["UNTERSCHRIFT", "STEMPEL", "AUSGESTELLT"],
    },
    "Rumuński": {
        "invoice_header": ["FACTURĂ", "FACTURA", "CHITANȚĂ", "BON"],
        "seller": ["FURNIZOR", "VÂNZĂTOR", "PRESTATOR", "EMITENT"],
        "buyer": ["CUMPĂRĂTOR", "CLIENT", "BENEFICIAR", "DESTINATAR"],
        "nip": ["CUI", "CIF", "COD FISCAL", "REG.COM"],
        "payment": ["PLATĂ", "TERMEN PLATĂ", "SCADENȚĂ", "MODALITATE PLATĂ"],
        "bank": ["BANCA", "CONT", "IBAN", "BIC", "SWIFT"],
        "summary": ["TOTAL", "SUMA", "VALOARE", "TOTAL GENERAL", "DE PLATĂ"],
        "items": ["NR", "DENUMIRE", "CANTITATE", "PREȚ", "VALOARE", "TVA"],
        "dates": ["DATA EMITERII", "DATA LIVRĂRII", "DATA SCADENȚEI"],
        "signature": ["SEMNĂTURĂ", "ȘTAMPILĂ", "EMIS DE", "PRIMIT DE"],
    },
    "Angielski": {
        "invoice_header": ["INVOICE", "BILL", "RECEIPT", "STATEMENT"],
        "seller": ["SELLER", "VENDOR", "SUPPLIER", "FROM", "BILLER"],
        "buyer": ["BUYER", "CUSTOMER", "BILL TO", "TO", "PURCHASER"],
        "nip": ["VAT", "TAX ID", "EIN", "GST", "COMPANY REG"],
        "payment": ["PAYMENT", "DUE DATE", "PAYMENT TERMS", "PAY BY"],
        "bank": ["BANK", "ACCOUNT", "IBAN", "SWIFT", "ROUTING"],
        "summary": ["TOTAL", "GRAND TOTAL", "AMOUNT DUE", "BALANCE", "SUBTOTAL"],
        "items": ["NO", "DESCRIPTION", "QTY", "PRICE", "AMOUNT", "TAX", "GROSS"],
        "dates": ["INVOICE DATE", "DELIVERY DATE", "DUE DATE"],
        "signature": ["SIGNATURE", "AUTHORIZED BY", "ISSUED BY", "RECEIVED BY"],
    },
}

# Patterns by language and kind, matched without regard to case unless kind is "bank_account".
PATTERNS = {
    "Polski": {
        "invoice_number": [
            r"(?:Faktura|FV|FA)[:\s]*(?:nr\.?|Nr\.?)?\s*([A-Z0-9][A-Z0-9/\-\._]+)",
            r"Nr\s+faktury[:\s]*([A-Z0-9][A-Z0-9/\-\._]+)",
            r"([0-9]{1,10}/[0-9]{1,2}/[0-9]{4})",
        ],
        "nip": [
            r"NIP[:\s]*(\d{3}[-\s]?\d{3}[-\s]?\d{2}[-\s]?\d{2})",
            r"NIP[:\s]*(\d{10})",
            r"(?:PL\s?)?(\d{10})(?!\d)",
        ],
        "amount": [
            r"(\d{1,3}(?:\s\d{3})*(?:,\d{2})?)\s*(?:zł|PLN|ZŁ)",
            r"(\d{1,3}(?:\.\d{3})*(?:,\d{2})?)\s*(?:zł|PLN|ZŁ)",
        ],
        "bank_account": [
            r"(?:PL\s?)?\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}",
            r"(?<!\d)\d{26}(?!\d)",
        ],
    },
    "Niemiecki": {
        "invoice_number": [
            r"Rechnungs?[-\s]?(?:nr|nummer)[:\s]*([A-Z0-9][A-Z0-9/\-\.]+)",
            r"(?:RNr|R\-Nr)[:\s]*([A-Z0-9][A-Z0-9/\-\.]+)",
        ],
        "nip": [
            r"(?:UST[-\s]?ID[-\s]?Nr|USt[-\s]?IdNr)[:\s]*(DE\s?\d{9})",
            r"Steuernummer[:\s]*(\d{2,3}/\d{3}/\d{5})",
        ],
        "amount": [r"(\d{1,3}(?:\.\d{3})*(?:,\d{2})?)\s*(?:€|EUR)"],
        "bank_account": [r"(?:DE\s?)?\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{2}"],
    },
    "Rumuński": {
        "invoice_number": [r"(?:Factur[aă]|Seria)[:\s]*([A-Z]+\s*[0-9]+)", r"Nr\.\s*([0-9]+)"],
        "nip": [r"(?:CUI|CIF|C\.U\.I)[:\s]*(RO\s?\d{2,10})", r"(?:CUI|CIF)[:\s]*(\d{2,10})"],
        "amount": [r"(\d{1,3}(?:\.\d{3})*(?:,\d{2})?)\s*(?:lei|RON|LEI)"],
        "bank_account": [r"(?:RO\s?)?\d{2}\s?[A-Z]{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}"],
    },
    "Angielski": {
        "invoice_number": [r"Invoice\s*(?:No|#)[:\s]*([A-Z0-9][A-Z0-9/\-\.]+)", r"INV[-\s]?([0-9]+)"],
        "nip": [r"(?:VAT|Tax\s*ID)[:\s]*([A-Z]{2}\s?\d+)", r"EIN[:\s]*(\d{2}-\d{7})"],
        "amount": [r"(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s*(?:\$|USD|GBP|EUR)"],
        "bank_account": [r"[A-Z]{2}\d{2}\s?[A-Z0-9]{4}\s?\d{4}\s?\d{4}\s?\d{4}(?:\s?\d{0,4})?"],
    },
}

# Page headers, start and end keywords, item-table and summary indicators.
PAGE_HEADERS = [
    r"FAKTURA\s+(?:VAT\s+)?(?:NR\.?|Nr\.?)?",
    r"INVOICE\s+(?:NO\.?|#)?",
    r"RECHNUNG\s+(?:NR\.?)?",
    r"FACTURĂ\s+(?:NR\.?)?",
    r"FACTURA\s+(?:NÚM\.?)?",
    r"NOTA\s+(?:KSIĘGOWA|KORYGUJĄCA)?",
    r"CREDIT\s+NOTE",
    r"PROFORMA",
    r"ZALICZK",
]
START_KEYWORDS = {
    "Polski": ["SPRZEDAWCA", "DOSTAWCA", "WYSTAWCA", "NABYWCA"],
    "Niemiecki": ["VERKÄUFER", "LIEFERANT", "KÄUFER"],
    "Rumuński": ["FURNIZOR", "VÂNZĂTOR", "CUMPĂRĂTOR"],
    "Angielski": ["SELLER", "SUPPLIER", "BUYER", "BILL TO"],
}
END_KEYWORDS = {
    "Polski": ["RAZEM DO ZAPŁATY", "SŁOWNIE", "PODPIS", "PIECZĄTKA"],
    "Niemiecki": ["GESAMTBETRAG", "IN WORTEN", "UNTERSCHRIFT"],
    "Rumuński": ["TOTAL DE PLATĂ", "ÎN LITERE", "SEMNĂTURĂ"],
    "Angielski": ["TOTAL DUE", "IN WORDS", "SIGNATURE", "STAMP"],
}
SIGNATURE = r"PODPIS|SIGNATURE|UNTERSCHRIFT"
TABLE_INDICATORS = [
    r"\bL\.?\s*P\.?",
    r"NAZWA|OPIS|DESCRIPTION",
    r"ILOŚĆ|QTY|QUANTITY",
    r"CENA|PRICE",
    r"WARTOŚĆ|VALUE|AMOUNT",
    r"\bNETTO\b|\bNET\b",
    r"\bVAT\b|\bTAX\b",
    r"BRUTTO|GROSS",
]
PRICE_LIKE = r"\d+[,\.]\d{2}"
SUMMARY_PATTERNS = [
    r"(?:SUMA|RAZEM|TOTAL|GESAMT)\s*:?\s*\d",
    r"(?:DO\s+ZAPŁATY|AMOUNT\s+DUE|ZU\s+ZAHLEN)",
    r"(?:NETTO|NET)\s*:?\s*\d+",
    r"(?:BRUTTO|GROSS)\s*:?\s*\d+",
    r"VAT\s*:?\s*\d+[,\.]\d{2}",
]
# Words of which a match of the pattern at the same place holds one; none: it is always searched.
PAGE_HEADER_WORDS = [
    ["FAKTURA"], ["INVOICE"], ["RECHNUNG"], ["FACTURĂ"], ["FACTURA"], ["NOTA"], ["CREDIT"], ["PROFORMA"], ["ZALICZK"],
]
TABLE_INDICATOR_WORDS = [
    [], ["NAZWA", "OPIS", "DESCRIPTION"], ["ILOŚĆ", "QTY", "QUANTITY"], ["CENA", "PRICE"], ["WARTOŚĆ", "VALUE", "AMOUNT"],
    ["NET"], ["VAT", "TAX"], ["BRUTTO", "GROSS"],
]
SUMMARY_WORDS = [
    ["SUMA", "RAZEM", "TOTAL", "GESAMT"], ["ZAPŁATY", "AMOUNT", "ZAHLEN"], ["NET"], ["BRUTTO", "GROSS"], ["VAT"],
]
TOTAL_TEXT = r"(?:RAZEM|TOTAL|SUMA)[:\s]+([0-9\s,\.]+)"
PAGE_BREAK = "\n\n--- NOWA STRONA ---\n\n"

# Labels of the three dates.
DATE_LABELS = {
    "issue": [
        "DATA WYSTAWIENIA", "DATA WYSTAWIENIA:", "WYSTAWIENIA", "INVOICE DATE", "ISSUE DATE",
        "DATE OF ISSUE", "RECHNUNGSDATUM", "AUSSTELLUNGSDATUM", "DATA EMITERII",
    ],
    "sale": [
        "DATA SPRZEDAŻY", "DATA SPRZEDAZY", "DATA SPRZEDAŻY:", "DATA DOSTAWY", "DATA WYKONANIA",
        "DOSTAWY/WYKONANIA USŁUGI", "DATĂ DOSTAWY", "DAȚA DOSTAWY", "SALE DATE", "DELIVERY DATE",
        "SERVICE DATE", "LIEFERDATUM", "LEISTUNGSDATUM",
    ],
    "due": [
        "TERMIN PŁATNOŚCI", "TERMIN PLATNOŚCI", "TERMIN PŁATNOŚCI:", "DO DNIA", "PŁATNE DO",
        "ZAPŁATA DO", "DUE DATE", "PAYMENT DUE", "PAY BY", "ZAHLBAR BIS", "FÄLLIGKEITSDATUM",
        "TERMEN DE PLATĂ", "SCADENȚĂ",
    ],
}
DATE_HITS = [
    (r"\d{2}\.\d{2}\.\d{4}", "d-M-yyyy"),
    (r"\d{2}-\d{2}-\d{4}", "d-M-yyyy"),
    (r"\d{2}/\d{2}/\d{4}", "d-M-yyyy"),
    (r"\d{4}-\d{2}-\d{2}", "yyyy-M-d"),
    (r"\d{4}\.\d{2}\.\d{2}", "yyyy-M-d"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "d-M-yyyy"),
]

# Tax-id patterns; the group holds the id.
TAX_ID_PATTERNS = [
    r"NIP[:\.\s-]*(\d{3}[-\s]\d{3}[-\s]\d{2}[-\s]\d{2})",
    r"NIP[:\.\s-]*(\d{3}[-\s]\d{2}[-\s]\d{2}[-\s]\d{3})",
    r"NIP[:\.\s-]*(\d{3}\.\d{3}\.\d{2}\.\d{2})",
    r"NIP[:\.\s-]*(\d{3}\s\d{3}\s\d{2}\s\d{2})",
    r"NIP[:\.\s-]*(\d{10})",
    r"(?:PL[-\s]?)(\d{10})(?!\d)",
    r"(?<!\d)(\d{3}[-\s]\d{3}[-\s]\d{2}[-\s]\d{2})(?!\d)",
    r"(?<!\d)(\d{10})(?!\d)",
]

# Amount labels, item-table words, stop words, currencies.
GROSS_LABELS = ["DO ZAPŁATY", "RAZEM", "TOTAL", "SUMA", "BRUTTO"]
NET_LABELS = ["NETTO", "NET", "PODSTAWA"]
VAT_LABELS = ["VAT", "TAX", "PODATEK"]
ADVANCE_LABELS = ["ZALICZKA", "ADVANCE"]
TABLE_WORDS = ["LP", "NAZWA", "ILOŚĆ", "CENA", "WARTOŚĆ", "DESCRIPTION", "QTY", "PRICE"]
TABLE_END = ["SUMA", "RAZEM", "TOTAL"]
GROUP_END = ["SUMA", "RAZEM", "TOTAL", "DO ZAPŁATY"]
NOT_ITEM = ["NIP", "REGON", "BANK"]
CURRENCIES = ["PLN", "EUR", "USD", "GBP", "RON", "CZK"]
NUMBER_LABELS = ["Faktura nr", "Invoice no", "Rechnung Nr", "Factura nr"]

# Invoice types, rates, bank codes, account and phone lengths.
INVOICE_TYPES = ["BŁĄD", "KOREKTA", "KOŃCOWA", "PROFORMA", "VAT", "ZALICZKOWA"]
STANDARD_RATES = [0, 5, 8, 19, 23]
LEGAL_RATES = {"Polski": [0, 5, 8, 23], "Niemiecki": [0, 7, 19]}
DEFAULT_RATE = 23
REVERSE_CHARGE = ["DE", "FR", "IT", "ES"]
REVERSE_NOTE = "Odwrotne obciążenie - art. 17 ust. 1 pkt 4"
BANKS = {
    "10901014": "Santander Bank Polska",
    "10901304": "Santander Consumer Bank",
    "10201026": "PKO BP",
    "11401010": "mBank",
    "10501012": "ING Bank Śląski",
    "24901044": "Alior Bank",
    "10301016": "Citi Handlowy",
    "10901694": "BNP Paribas",
    "11602202": "Bank Millennium",
    "10601076": "BPS",
    "14701012": "Eurobank",
    "10801014": "Bank Pekao SA",
}
UNKNOWN_BANK = "Nieznany bank"
IBAN_LENGTH = {"PL": 28, "DE": 22, "RO": 24, "GB": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18}
PHONE_LENGTHS = {"PL": [9, 11], "DE": [10, 11, 12], "RO": [10], "GB": [10, 11], "US": [10]}
PHONE_DEFAULT = [9, 10, 11, 12]
TRANSFER, CASH, CARD = "przelew", "gotówka", "karta"
PAID, PART_PAID, UNPAID = "opłacona", "częściowo opłacona", "nieopłacona"


def lang_profile(spark: SparkSession) -> DataFrame:
    """Four rows: one per language."""
    rows = [
        (i, name, LANG_CODE[name], DECIMAL_SEP[name], THOUSAND_SEP[name], CURRENCY_SYMBOL[name], DATE_FORMAT[name])
        for i, name in enumerate(LANGUAGES)
    ]
    return spark.createDataFrame(
        rows,
        "ordinal int, language string, code string, decimal_sep string, thousand_sep string, symbol string, date_format string",
    )


def bank_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BANKS.items()), "bank_code string, bank_name string")


def legal_rates(spark: SparkSession) -> DataFrame:
    rows = [(lang, rate) for lang, rates in LEGAL_RATES.items() for rate in rates]
    return spark.createDataFrame(rows, "language string, rate int")
