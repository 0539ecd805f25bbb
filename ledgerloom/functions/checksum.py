"""Tax-id, account, email and phone checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerloom.dims import IBAN_LENGTH, PHONE_DEFAULT, PHONE_LENGTHS

NIP_WEIGHTS = [6, 5, 7, 2, 3, 4, 5, 6, 7]  # fixed values
CUI_KEY = [7, 5, 3, 2, 1, 7, 5, 3, 2]  # fixed values


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _digit(text: Column, position: int) -> Column:
    return F.substring(text, position, 1).try_cast("int")


def nip_valid(text: Column, plain: bool = False) -> Column:
    """Polish tax id: ten digits, weighted sum of the first nine mod 11 equals the tenth; ``plain`` texts are digits."""
    d = text if plain else digits(text)
    total = sum((_digit(d, i + 1) * w for i, w in enumerate(NIP_WEIGHTS)), F.lit(0))
    return F.coalesce((F.length(d) == 10) & (total % 11 == _digit(d, 10)), F.lit(False))


def cui_valid(text: Column, plain: bool = False) -> Column:
    """Romanian tax id: the key is applied from the left; ten digits pass unchecked; ``plain`` texts are digits."""
    d = text if plain else digits(text)
    n = F.length(d)
    total = sum(
        (F.when(n > i + 1, _digit(d, i + 1) * w).otherwise(0) for i, w in enumerate(CUI_KEY[:8])), F.lit(0)
    )
    control = total * 10 % 11
    control = F.when(control == 10, 0).otherwise(control)
    last = F.substring(d, -1, 1).try_cast("int")
    checked = F.when(n == 10, True).when(n.between(2, 9), control == last).otherwise(False)
    return F.coalesce(checked, F.lit(False))


def tax_id_valid(text: Column, language: Column, plain: bool = False) -> Column:
    """Checksum for Polish and Romanian ids, a length of 8 to 12 digits for the others. ``plain`` texts are digits, which
    are not taken out again for each figure of the sum."""
    return (
        F.when(language == "Polski", nip_valid(text, plain))
        .when(language == "Rumuński", cui_valid(text, plain))
        .otherwise(F.coalesce(F.length(text if plain else digits(text)).between(8, 12), F.lit(False)))
    )


def iban_mod97(compact: Column) -> Column:
    """Remainder of the rearranged account number (no big integers): sixteen digits at a time where only the country is
    letters and at most 32 digits follow the check digits, else folded sign by sign."""
    body = F.lpad(F.substr(compact, F.lit(5)), 32, "0")

    def letter(place: int) -> Column:
        return F.ascii(F.substring(compact, place, 1)) - 55

    first = F.substring(body, 1, 16).try_cast("long") % 97
    second = (first * 10**16 + F.substring(body, 17, 16).try_cast("long")) % 97
    ends = second * 1_000_000 + letter(1) * 10_000 + letter(2) * 100 + F.substring(compact, 3, 2).try_cast("int")
    rearranged = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    folded = F.aggregate(
        F.split(rearranged, ""),
        F.lit(0),
        lambda acc, ch: F.when(ch == "", acc)
        .when(ch.between("0", "9"), (acc * 10 + ch.try_cast("int")) % 97)
        .otherwise((acc * 100 + F.ascii(ch) - 55) % 97),
    )
    return F.when(compact.rlike(r"^[A-Z]{2}\d{2,34}$"), (ends % 97).cast("int")).otherwise(folded)


def iban_valid(account: Column) -> Column:
    def checked(compact: Column) -> Column:
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTH.items() for x in pair])
        expected = F.try_element_at(lengths, F.substring(compact, 1, 2))
        shaped = compact.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]+$") & (F.coalesce(expected, F.length(compact)) == F.length(compact))
        return F.when(shaped, iban_mod97(compact) == 1)

    # one-element array: the blanks are taken out once, and only where something is to change
    plain = F.upper(F.regexp_replace(account, r"(?U)\s", ""))
    compact = F.array(F.when(account.rlike("^[A-Z0-9]*$"), account).otherwise(plain))
    return F.coalesce(F.transform(compact, checked)[0], F.lit(False))


def email_valid(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), F.lit(False))


def phone_valid(text: Column, country: Column) -> Column:
    lengths = F.create_map(
        *[x for code, ns in PHONE_LENGTHS.items() for x in (F.lit(code), F.array(*map(F.lit, ns)))]
    )
    allowed = F.coalesce(F.try_element_at(lengths, country), F.array(*map(F.lit, PHONE_DEFAULT)))
    return F.coalesce(F.array_contains(allowed, F.length(digits(text))), F.lit(False))


def format_iban(account: Column) -> Column:
    """Groups of four; a bare 26-digit Polish number gets its country code; short input stays as it is."""
    def grouped(signs: Column) -> Column:
        compact = F.when(signs.rlike(r"^\d{26}$"), F.concat(F.lit("PL"), signs)).otherwise(signs)
        return F.when(F.length(compact) >= 15, F.regexp_replace(compact, "(.{4})(?=.)", "$1 "))

    signs = F.array(F.regexp_replace(F.upper(account), "[^A-Z0-9]", ""))  # found once
    return F.coalesce(F.transform(signs, grouped)[0], account)


def bank_accounts(text: Column) -> Column:
    """All valid accounts of a text, formatted, in pattern and text order, each once."""
    patterns = [
        r"(?i)[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,8}",
        r"(?i)[A-Z]{2}\d{26}",
        r"\d{26}",
        r"\d{2}(?:\s?\d{4}){6}",
    ]  # fixed values
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]))
    return F.filter(F.array_distinct(F.transform(found, format_iban)), iban_valid)


def bank_code(account: Column) -> Column:
    """Clearing number: digits 3 to 10 of the 26-digit number, NULL for other shapes."""
    d = digits(account)
    return F.when(F.length(d) == 26, F.substring(d, 3, 8))


def register_sql(spark: SparkSession) -> None:
    """The id and account checks as temporary SQL functions: nip_valid, cui_valid, iban_valid, tax_digits."""
    weighted = " + ".join(f"try_cast(substr(d, {i + 1}, 1) as int) * {w}" for i, w in enumerate(NIP_WEIGHTS))
    spark.sql(
        "create or replace temporary function nip_valid(text string) returns boolean return "
        f"(select coalesce(length(d) = 10 and ({weighted}) % 11 = try_cast(substr(d, 10, 1) as int), false) "
        r"from (select regexp_replace(text, '\\D', '') as d))"
    )
    spark.sql(
        "create or replace temporary function tax_digits(text string) returns string "
        r"return regexp_replace(text, '\\D', '')"
    )
    key = " + ".join(
        f"if(length(d) > {i + 1}, try_cast(substr(d, {i + 1}, 1) as int) * {w}, 0)" for i, w in enumerate(CUI_KEY[:8])
    )
    spark.sql(
        "create or replace temporary function cui_valid(text string) returns boolean return "
        f"(select coalesce(length(d) = 10 or (length(d) between 2 and 9 and ({key}) * 10 % 11 % 10 = try_cast(right(d, 1) as int)), false) "
        r"from (select regexp_replace(text, '\\D', '') as d))"
    )
    lengths = ", ".join(f"'{code}', {n}" for code, n in IBAN_LENGTH.items())
    spark.sql(
        "create or replace temporary function iban_valid(account string) returns boolean return "
        r"(select coalesce(c rlike '^[A-Z]{2}[0-9]{2}[A-Z0-9]+$' "
        f"and coalesce(try_element_at(map({lengths}), substr(c, 1, 2)), length(c)) = length(c) "
        "and aggregate(split(concat(substr(c, 5), substr(c, 1, 4)), ''), 0, (s, x) -> case when x = '' then s "
        "when x between '0' and '9' then (s * 10 + try_cast(x as int)) % 97 else (s * 100 + ascii(x) - 55) % 97 end) = 1, false) "
        r"from (select upper(regexp_replace(account, '(?U)\\s', '')) as c))"
    )
