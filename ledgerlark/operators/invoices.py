"""Fields of a tax invoice out of its text: parties, dates, numbers and totals, as column expressions over its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

#: Labels of the fields, in the order in which they are tried. Fixed values.
SUPPLIER_LABELS = ["공급자", "공급 자", "판매자", "발행자"]
BUYER_LABELS = ["공급받는자", "공급 받는 자", "구매자", "매입자"]
DATE_LABELS = ["작성일자", "발행일자", "발행일", "작성일", "공급일자", "거래일자"]
AMOUNT_LABELS = {"supply": ["공급가액합계", "공급가액 합계", "공급가액"], "tax": ["세액합계", "세액 합계", "세액"], "total": ["합계금액", "합 계", "합계", "청구금액", "총액"]}
#: What stands after labels, and patterns of a party's name and a representative after their labels, a business number and a plain date. Fixed values.
AFTER = r"\s*[：:\s]\s*"
DATE = r"(\d{4}[.\-/년]\s*\d{1,2}[.\-/월]\s*\d{1,2}일?)"
PARTY = r".{0,30}상호\s*[：:\s]\s*([^\s,;|]+(?:\s[^\s,;|]+){0,3})"
REPRESENTATIVE = r"자?\s*[：:\s]\s*([가-힣]{2,5}(?:\s[가-힣]{1,5})?)"
NUMBER = r"(?<![0-9A-Za-z_가-힣])(\d{3}[-\s]?\d{2}[-\s]?\d{5})(?![0-9A-Za-z_가-힣])"
PLAIN_DATE = r"(\d{4}[.\-/]\d{2}[.\-/]\d{2})"
LONGEST_NAME = 30
#: What is cut off the ends of a line.
BLANKS = " \t\x0b\f"


def _found(joined: Column, label: str, pattern: str) -> Column:
    """What a pattern that begins with the label gives at its first place, empty if nothing; null without the label, which is looked for before the pattern."""
    return F.when(F.contains(joined, F.lit(label)), F.regexp_extract(joined, pattern, 1))


def _first(joined: Column, labels: list[str], rest: str) -> Column:
    """What the first pattern, a label and the rest, that is met gives at its first place."""
    return F.coalesce(*[F.nullif(_found(joined, label, label + rest), F.lit("")) for label in labels])


def _next_line(joined: Column, lines: Column, labels: list[str]) -> Column:
    """The line after the first one with a label, if it doesn't begin with a digit; else after the next such line, then by the next label."""

    def after(label: str) -> Column:
        pairs = F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        of = F.filter(pairs, lambda p: F.contains(p["a"], F.lit(label)) & p["b"].isNotNull() & ~F.rlike(p["b"], F.lit(r"^\d")))
        return F.when(F.contains(joined, F.lit(label)), F.get(of, F.lit(0))["b"])

    return F.substring(F.coalesce(*[after(label) for label in labels]), 1, LONGEST_NAME)


def _number(found: Column) -> Column:
    """The number of digits and commas; null if it is 0 or none."""
    return F.nullif(F.try_to_number(F.nullif(F.replace(found, F.lit(","), F.lit("")), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(0))


def invoice_fields(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts with supplier, supplier_number, representative, buyer, buyer_number, issue_date, supply_amount, tax_amount and total_amount of the text, which is dropped.

    The supplier's name stands after its label and 상호, else on the line after its label; the first two business numbers are the supplier's and the buyer's. A date that isn't one is passed over; without a labelled
    one the first plain date counts. Without a total, supply and tax are summed. Null or empty texts have no fields.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), r"\r\n|[\n\r\x0b\x0c\u0085  ]"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    rows = texts.withColumn("_lines", lines).withColumn("_text", F.array_join("_lines", " ")).drop(column)
    joined, by_line = F.col("_text"), F.col("_lines")
    # What patterns find is a column before it is read, so a text is searched once for each label that it has; numbers and dates are made in lambdas, as one
    # expression they are a method that the JVM doesn't compile. Of several labels the first with a number, or a date, counts; dates are mostly there twice.
    labels = [label for own in AMOUNT_LABELS.values() for label in own]
    amounts = F.array(*[_found(joined, label, rf"{label}\s*[：:\s]?\s*([\d,]+)") for label in labels])
    shown = F.array(*[_found(joined, label, f"{label}{AFTER}{DATE}") for label in DATE_LABELS], F.regexp_extract(joined, PLAIN_DATE, 1))
    rows = rows.withColumns({"_amounts": amounts, "_dates": shown, "_numbers": F.regexp_extract_all(joined, F.lit(NUMBER), F.lit(1))})
    rows = rows.withColumns({"_amounts": F.transform("_amounts", _number), "_dates": F.transform(F.array_distinct("_dates"), dates.loose_date)})
    numbers = F.transform("_numbers", text.business_number)
    amounts = {k: F.coalesce(*[F.get("_amounts", F.lit(labels.index(label))) for label in own]) for k, own in AMOUNT_LABELS.items()}
    found = {
        "supplier": F.coalesce(_first(joined, SUPPLIER_LABELS, PARTY), _next_line(joined, by_line, SUPPLIER_LABELS)),
        "supplier_number": F.get(numbers, F.lit(0)),
        "representative": _first(joined, ["대표"], REPRESENTATIVE),
        "buyer": _first(joined, BUYER_LABELS, PARTY),
        "buyer_number": F.get(numbers, F.lit(1)),
        "issue_date": F.get(F.array_compact("_dates"), F.lit(0)),
        "supply_amount": amounts["supply"],
        "tax_amount": amounts["tax"],
        "total_amount": F.coalesce(amounts["total"], amounts["supply"] + amounts["tax"]),
    }
    return rows.withColumns(found).drop("_lines", "_text", "_amounts", "_dates", "_numbers")
