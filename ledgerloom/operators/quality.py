"""Invoice quality rules as one projection: findings, messages, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.dims import LEGAL_RATES, STANDARD_RATES
from ledgerloom.functions.checksum import cui_valid, iban_valid, nip_valid
from ledgerloom.functions.money import MONEY
from ledgerloom.memo import memo

ERROR, WARNING, SUGGESTION = "error", "warning", "suggestion"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _finding(rule: str, severity: str, detail: Column, item: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        (F.lit(None) if item is None else item).cast("int").alias("item_pos"),
        detail.alias("detail"),
    )


NONE = "cast(array() as array<struct<rule:string,severity:string,item_pos:int,detail:string>>)"


def _if(condition: Column, rule: str, severity: str, *message: Column | str) -> Column:
    """A list of one finding, or an empty one. Lists are joined in generated code; a filter over one list of all rules
    would have every rule interpreted for every row."""
    return F.when(condition, F.array(_finding(rule, severity, _text(*message)))).otherwise(F.expr(NONE))


def _money(name: str) -> Column:
    return F.coalesce(name, F.lit(0).cast(MONEY))


@memo
def findings(as_of: str) -> Column:
    """``array<struct<rule, severity, item_pos, detail>>`` in rule order; messages are fixed values."""
    today = F.lit(as_of).cast("date")
    col = F.col
    polish, romanian = col("language") == "Polski", col("language") == "Rumuński"
    number = F.coalesce("invoice_id", F.lit(""))
    no_number = number.isin("", "UNKNOWN", "BRAK")
    short = F.length(number) < 3
    s_id, b_id = col("supplier_tax_id"), col("buyer_tax_id")
    issue, due = col("issue_date"), col("due_date")
    term = F.datediff(due, issue)
    dated = issue.isNotNull() & due.isNotNull()
    net, vat, gross = _money("total_net"), _money("total_vat"), _money("total_gross")
    limit = F.lit("0.02").cast(MONEY)
    no_items = F.coalesce(F.size("line_items"), F.lit(0)) <= 0
    rate = F.bround(vat * 100 / net, 2).cast("decimal(18,2)")
    standard = F.lit(False)
    for r in STANDARD_RATES:
        standard = standard | (F.abs(rate - r) < 0.5)
    items_total = F.aggregate(
        "line_items", F.lit(0).cast(MONEY), lambda acc, i: (acc + F.coalesce(i["total"], F.lit(0))).cast(MONEY)
    )

    def all_null(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & col(n).isNull()
        return out

    head = F.concat(
        _if(number == "", "V01", ERROR, "Brak wymaganego pola: invoice_id"),
        _if(all_null("supplier_name", "supplier_tax_id", "supplier_address"), "V01", ERROR, "Brak wymaganego pola: supplier"),
        _if(all_null("buyer_name", "buyer_tax_id", "buyer_address"), "V01", ERROR, "Brak wymaganego pola: buyer"),
        _if(all_null("issue_date", "sale_date", "due_date"), "V01", ERROR, "Brak wymaganego pola: dates"),
        _if(all_null("total_net", "total_vat", "total_gross"), "V01", ERROR, "Brak wymaganego pola: summary"),
        _if(no_number, "V02", ERROR, "Brak numeru faktury"),
        _if(~no_number & short, "V03", WARNING, "Podejrzanie krótki numer faktury"),
        _if(~no_number & ~short & ~number.rlike(r"\d"), "V04", WARNING, "Numer faktury nie zawiera cyfr"),
        _if(polish & ~number.rlike(r"^.+/\d{1,2}/\d{4}"), "V05", SUGGESTION, "Typowy format: NR/MM/YYYY"),
        _if(F.coalesce("supplier_name", F.lit("")) == "", "V06", ERROR, "Brak nazwy dostawcy"),
        _if(polish & s_id.isNotNull() & ~nip_valid(s_id), "V07", ERROR, "Nieprawidłowy NIP dostawcy: ", s_id),
        _if(romanian & s_id.isNotNull() & ~cui_valid(s_id), "V08", ERROR, "Nieprawidłowy CUI dostawcy: ", s_id),
        _if(s_id.isNull(), "V09", WARNING, "Brak NIP/CUI dostawcy"),
        _if(F.coalesce("buyer_name", F.lit("")) == "", "V10", ERROR, "Brak nazwy nabywcy"),
        _if(polish & b_id.isNotNull() & ~nip_valid(b_id), "V11", WARNING, "Nieprawidłowy NIP nabywcy: ", b_id),
    )
    accounts = F.transform(
        F.filter("supplier_accounts", lambda a: ~iban_valid(a)),
        lambda a: _finding("V12", WARNING, _text("Nieprawidłowy IBAN: ", a)),
    )
    middle = F.concat(
        _if(dated & (issue > today), "V13", WARNING, "Data wystawienia w przyszłości"),
        _if(dated & (due < issue), "V14", ERROR, "Termin płatności przed datą wystawienia"),
        _if(dated & (term > 90), "V15", WARNING, "Bardzo długi termin płatności: ", term, " dni"),
        _if(dated & (term < 0), "V16", ERROR, "Ujemny termin płatności"),
        _if(~dated, "V17", ERROR, "Nieprawidłowy format dat"),
        _if((net < 0) | (vat < 0) | (gross < 0), "V18", ERROR, "Ujemne kwoty na fakturze"),
        _if(gross == 0, "V19", ERROR, "Brak kwoty brutto"),
        _if(
            F.abs(net + vat - gross) > limit, "V20", ERROR,
            "Niezgodność kwot: ", net, " + ", vat, " = ", (net + vat).cast(MONEY), ", ale brutto = ", gross,
        ),
        F.when(net > 0, _if(polish & ~standard, "V21", WARNING, "Niestandardowa stawka VAT: ", rate, "%")).otherwise(F.expr(NONE)),
        _if(no_items, "V22", WARNING, "Brak pozycji na fakturze"),
    )

    def figures(item: Column) -> Column:
        qty = F.coalesce(item["quantity"], F.lit(0))
        price, total = F.coalesce(item["unit_price"], F.lit(0).cast(MONEY)), F.coalesce(item["total"], F.lit(0).cast(MONEY))
        return F.struct(
            item["description"].alias("description"), qty.alias("quantity"), price.alias("price"), total.alias("total"),
            (qty * price).cast("decimal(28,2)").alias("product"),
        )

    def item_rules(item: Column, index: Column) -> Column:
        place = index + 1
        qty, price, total, product = item["quantity"], item["price"], item["total"], item["product"]

        def rule(condition: Column, name: str, severity: str, *message: Column | str) -> Column:
            return F.when(condition, _finding(name, severity, _text("Pozycja ", place, ": ", *message), place))

        return F.array(
            rule(F.coalesce(item["description"], F.lit("")) == "", "V23", WARNING, "brak opisu"),
            rule(qty <= 0, "V24", WARNING, "nieprawidłowa ilość"),
            rule(price < 0, "V25", ERROR, "ujemna cena"),
            rule(total < 0, "V26", ERROR, "ujemna wartość"),
            rule(
                F.abs(product - total) > limit, "V27", WARNING,
                "niezgodność obliczeń (", qty, " × ", price, " = ", product, ", podano ", total, ")",
            ),
        )

    every_item = F.flatten(F.transform(F.transform("line_items", figures), item_rules))
    item_findings = F.filter(every_item, lambda f: f.isNotNull())
    cross = _if(
        ~no_items & (F.abs(items_total - gross) > F.lit("0.05").cast(MONEY)), "V28", WARNING,
        "Suma pozycji (", items_total, ") różni się od sumy faktury (", gross, ")",
    )
    rates = F.filter(F.array_distinct(F.transform("line_items", lambda i: i["vat_rate"])), lambda r: r.isNotNull())

    def illegal(name: str, kind: str) -> Column:
        return F.transform(
            F.filter(rates, lambda r: ~r.isin(LEGAL_RATES[name])),
            lambda r: _finding("V29", WARNING, _text(f"Niestandardowa stawka {kind}: ", r, "%")),
        )

    breakdown = (
        F.when(polish, illegal("Polski", "VAT"))
        .when(col("language") == "Niemiecki", illegal("Niemiecki", "MwSt"))
        .otherwise(F.expr(NONE))
    )
    tail = F.concat(
        _if(s_id == b_id, "V30", ERROR, "Nabywca i sprzedawca mają ten sam NIP"),
        _if(gross > 1_000_000, "V31", WARNING, "Bardzo wysoka kwota faktury (>1M)"),
        _if((gross > 0) & (gross < F.lit("0.01").cast("decimal(18,4)")), "V32", WARNING, "Podejrzanie niska kwota faktury"),
    )
    return F.concat(head, accounts, middle, item_findings, cross, breakdown, tail)


def confidence(errors: Column, warnings: Column) -> Column:
    """1 less 0.15 per error and 0.05 per warning, between 0 and 1."""
    points = F.lit(100) - errors * 15 - warnings * 5
    return F.greatest(F.lit(0), F.least(F.lit(100), points)) / F.lit(100.0)


def validate(invoices: DataFrame, as_of: str) -> DataFrame:
    """Adds findings, errors, warnings, suggestions, confidence and is_verified; no shuffle."""

    def details(severity: str) -> Column:
        return F.transform(F.filter("findings", lambda f: f["severity"] == severity), lambda f: f["detail"])

    return (
        invoices.withColumn("findings", findings(as_of))
        .withColumns({"errors": details(ERROR), "warnings": details(WARNING), "suggestions": details(SUGGESTION)})
        .withColumn("confidence", confidence(F.size("errors"), F.size("warnings")))
        .withColumn("is_verified", F.size("errors") == 0)
    )


def long_findings(validated: DataFrame, *keys: str) -> DataFrame:
    """One row per finding, numbered in rule order."""
    exploded = validated.select(*keys, F.posexplode_outer("findings").alias("ordinal", "f"))
    return exploded.where(F.col("f").isNotNull()).select(*keys, "ordinal", "f.*")


def rule_counts(validated: DataFrame) -> DataFrame:
    """Findings per rule and severity."""
    return (
        validated.select(F.explode_outer("findings").alias("f"))
        .where(F.col("f").isNotNull())
        .groupBy("f.rule", "f.severity")
        .agg(F.count("*").alias("findings"))
    )
