"""Items and documents that come as JSON of several layouts, read as VARIANT by tables of aliases: a new spelling is a row, not another schema.

A field's aliases are paths in the order of their priority; the first that has a value is taken. Text that is no JSON gives nulls and the layout null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Layouts of an item: the keys of which one marks it (also with a null), and the aliases of each field. Fixed values.
ITEM_LAYOUTS = {
    "v3": {"marks": ["used_on"], "used_on": ["used_on"], "amount": ["total_amount"], "name": ["item_name"], "category": ["category_code"], "vendor": []},
    "plain": {"marks": ["date", "amount", "description"], "used_on": ["date"], "amount": ["amount"], "name": ["name", "description"], "category": ["category"], "vendor": ["vendor"]},
    "korean": {"marks": [], "used_on": ["사용일자"], "amount": ["금액"], "name": ["사용내역"], "category": ["항목명"], "vendor": ["추가정보.업체명", "추가정보.진단기관", "추가정보.지도기관", "추가정보.교육주관", "추가정보.진단병원"]},
}
#: Aliases of the fields of documents and their lines, by kind. Fixed values.
DOCUMENT_ALIASES = {
    "wage_statement": {"vendor": ["vendor"], "date": ["date"]},
    "delivery_statement": {"vendor": ["supplier.company_name", "store.name"], "date": ["issue_date", "payment.date"]},
    "receipt": {"vendor": ["store.name"], "date": ["payment.date"]},
}
LINE_ALIASES = {
    "wage_statement": {"name": ["item_name", "name"], "count": [], "unit_price": []},
    "delivery_statement": {"name": ["item_name", "name"], "count": ["count", "quantity"], "unit_price": ["unit_price"]},
    "receipt": {"name": ["name"], "count": ["count"], "unit_price": ["unit_price"]},
}

#: What documents are read as, all fields at once; a value of another type is null.
LINE = "struct<item_name: string, name: string, count: double, quantity: double, unit_price: double, supply_amount: bigint, tax_amount: bigint, amount: bigint>"
DOCUMENT = (
    "struct<vendor: string, date: string, issue_date: string, supplier: struct<company_name: string>, store: struct<name: string>, payment: struct<date: string>, total_amount: bigint, infer_result: string, "
    f"items: array<{LINE}>, validation: struct<is_valid: boolean, has_required_fields: boolean, items_sum_match: boolean, warnings: array<string>, errors: array<string>>>"
)


def _path(alias: str) -> str:
    return "$" + "".join(f"['{key}']" for key in alias.split("."))


def value(v: Column, alias: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, _path(alias), kind)


def _filled(found: list[Column], nothing) -> Column:
    """The first that has a value; empty texts and zeros (nothing) are none, unless nothing follows."""
    return F.coalesce(*[F.nullif(c, F.lit(nothing)) for c in found], found[-1])


def first_of(v: Column, aliases: list[str], kind: str = "string") -> Column:
    """The first alias with a value; empty texts and zeros are none, unless nothing follows."""
    nothing = {"string": "", "double": 0.0, "bigint": 0}[kind]
    return _filled([value(v, a, kind) for a in aliases], nothing) if aliases else F.lit(None).cast(kind)


def has_key(v: Column, alias: str) -> Column:
    return value(v, alias, "variant").isNotNull()


def items(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """rows with layout, used_on, amount, name, category and vendor of the JSON item in ``raw``, which is replaced.

    The vendor of layout v3 is that of its remark; that of the Korean one the first of five keys with a text. Missing texts are empty, as is an unknown vendor.
    """
    parsed = rows.withColumn("_v", F.try_parse_json(raw)).drop(raw)
    v = F.col("_v")
    layout = F.lit("korean")
    for name in ("plain", "v3"):
        marks = [has_key(v, m) for m in ITEM_LAYOUTS[name]["marks"]]
        layout = F.when(F.exists(F.array(*marks), lambda m: m), name).otherwise(layout)
    parsed = parsed.withColumn("layout", F.when(v.isNotNull() & F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), layout))

    def field(name: str, kind: str = "string") -> Column:
        out = F.lit(None).cast(kind)
        for key, aliases in ITEM_LAYOUTS.items():
            out = F.when(F.col("layout") == key, first_of(v, aliases[name], kind)).otherwise(out)
        return out

    vendor = F.when(F.col("layout") == "v3", text.remark_vendor(value(v, "remark"))).otherwise(field("vendor"))
    texts = {n: F.when(F.col("layout").isNotNull(), F.coalesce(c, F.lit(""))) for n, c in (("used_on", field("used_on")), ("name", field("name")), ("category", field("category")), ("vendor", vendor))}
    return parsed.withColumns({**texts, "amount": field("amount", "double")}).drop("_v")


def documents(rows: DataFrame, raw: str = "raw", kind: str = "kind") -> DataFrame:
    """rows with doc_type, infer_result, vendor, date, total_amount, lines (name, count, unit_price, amount), is_valid, sums_match and warnings of the JSON document in ``raw``.

    kind is wage_statement, receipt or anything else for delivery statements. A delivery line's amount is supply and tax, or the supply, or null. Without an infer_result a receipt is an
    ERROR, other documents are a SUCCESS if they are valid or have the required fields, else PARTIAL. A receipt's errors are warnings too. What is no JSON object has nulls.
    """
    # One conversion to a struct gives all fields and lines; what is no object has none.
    parsed = rows.withColumn("_v", F.try_parse_json(raw)).drop(raw).withColumn("_d", F.try_variant_get("_v", "$", DOCUMENT))
    d = F.col("_d")
    doc_type = F.when(F.col(kind).isin("wage_statement", "receipt"), F.col(kind)).otherwise("delivery_statement")
    is_receipt, is_wage = F.coalesce(F.col(kind) == "receipt", F.lit(False)), F.coalesce(F.col(kind) == "wage_statement", F.lit(False))

    def field(of: Column, alias: str) -> Column:
        for key in alias.split("."):
            of = of[key]
        return of

    def by_kind(of) -> Column:
        return F.when(is_wage, of("wage_statement")).when(is_receipt, of("receipt")).otherwise(of("delivery_statement"))

    def first(of: Column, aliases: list[str], nothing) -> Column:
        return _filled([field(of, a) for a in aliases], nothing) if aliases else F.lit(None).cast("string" if nothing == "" else "double")

    def lines(key: str) -> Column:
        def line(x: Column) -> Column:
            amount = x["amount"] if key in ("wage_statement", "receipt") else F.coalesce(x["supply_amount"] + x["tax_amount"], x["supply_amount"])
            names = {n: first(x, LINE_ALIASES[key][n], "" if n == "name" else 0.0) for n in ("name", "count", "unit_price")}
            return F.struct(F.coalesce(names["name"], F.lit("")).alias("name"), names["count"].alias("count"), names["unit_price"].alias("unit_price"), amount.alias("amount"))

        return F.transform(d["items"], line)

    checks = d["validation"]
    flag = lambda alias: F.coalesce(checks[alias], F.lit(False))
    texts = lambda alias: F.coalesce(checks[alias], F.array().cast("array<string>"))
    stated = F.nullif(d["infer_result"], F.lit(""))
    result = F.when(is_receipt, F.coalesce(d["infer_result"], F.when(~has_key(F.col("_v"), "infer_result"), F.lit("ERROR")))).otherwise(F.coalesce(stated, F.when(flag("is_valid") | flag("has_required_fields"), "SUCCESS").otherwise("PARTIAL")))
    found = {
        "doc_type": doc_type,
        "infer_result": result,
        "vendor": by_kind(lambda k: first(d, DOCUMENT_ALIASES[k]["vendor"], "")),
        "date": by_kind(lambda k: first(d, DOCUMENT_ALIASES[k]["date"], "")),
        "total_amount": d["total_amount"],
        "lines": F.coalesce(by_kind(lines), F.array().cast("array<struct<name: string, count: double, unit_price: double, amount: bigint>>")),
        "is_valid": F.when(is_receipt, flag("has_required_fields")).otherwise(flag("is_valid")),
        "sums_match": F.when(is_receipt, checks["items_sum_match"]),
        "warnings": F.when(is_receipt, F.concat(texts("warnings"), texts("errors"))).otherwise(texts("warnings")),
    }
    return parsed.withColumns({n: F.when(d.isNotNull(), c) for n, c in found.items()}).drop("_v", "_d")
