"""Readers and writers of the audit's files and tables. Schemas are fixed; production reads infer nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "struct<seq: int, category_code: string, used_on: string, item_name: string, unit: string, quantity: double, unit_price: double, total_amount: bigint, remark: string, page_no: int, line_no: int>"
STATEMENT = f"source_file string, parse_status string, meta struct<project_name: string, report_month: string>, line_items array<{LINE}>, items array<{LINE}>"
EVIDENCE = (
    "receipt_id string, source_file string, doc_type string, infer_result string, vendor string, date string, supply_amount bigint, tax_amount bigint, total_amount bigint, "
    "store struct<name: string, biz_num: string>, payment struct<date: string>, items array<struct<name: string, item_name: string, count: double, unit_price: double, amount: bigint, supply_amount: bigint, tax_amount: bigint>>"
)
#: Document types by the names that parsers give them. Fixed values.
DOC_TYPES = {"trade_statement": "delivery_statement", "transaction_statement": "delivery_statement", "receipt": "receipt", "tax_invoice": "tax_invoice", "wage_statement": "wage_statement", "site_photo": "site_photo", "unknown": "unknown"}
#: Endings of evidence files that are read.
EXTENSIONS = ("pdf", "jpg", "jpeg", "png", "webp")


def doc_type(name):
    """The common name of a document type; other names as they are."""
    out = name
    for k, v in DOC_TYPES.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def statements(spark: SparkSession, path: str) -> DataFrame:
    """Parsed usage statements, one JSON object a file; lines are under line_items or items."""
    raw = spark.read.schema(STATEMENT).json(path, multiLine=True)
    return raw.select("source_file", "parse_status", "meta", F.coalesce("line_items", "items").alias("lines"))


def statement_lines(statements: DataFrame) -> DataFrame:
    """Lines that have a date and a category, cut and filled as they are stored; the report month is that of the first line."""
    lines = statements.select("source_file", "meta", F.inline("lines"))
    kept = lines.filter(F.col("used_on").isNotNull() & F.col("category_code").isNotNull())
    return kept.select(
        "source_file", "seq", "category_code", F.substring("used_on", 1, 10).try_cast("date").alias("used_on"), F.substring("item_name", 1, 300).alias("item_name"), F.substring("unit", 1, 50).alias("unit"),
        F.coalesce("quantity", F.lit(0.0)).alias("quantity"), F.coalesce("unit_price", F.lit(0.0)).alias("unit_price"), F.coalesce("total_amount", F.lit(0)).alias("total_amount"), F.substring("remark", 1, 500).alias("remark"),
    )


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence documents; a file holds one object or a list. Dates and vendors come from the new or the old place."""
    raw = spark.read.schema(EVIDENCE).json(path, multiLine=True)
    date = F.coalesce(F.nullif(F.trim("date"), F.lit("")), F.col("payment.date"))
    vendor = F.coalesce(F.nullif(F.trim("vendor"), F.lit("")), F.col("store.name"), F.lit(""))
    return raw.withColumns({"date": date, "vendor": vendor, "doc_type": doc_type(F.col("doc_type"))})


def evidence_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, length and time of the files that have a supported ending; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS))


def relational(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational table, read in ranges of its key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Reference documents: id (file name) and whole text."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("id"), F.col("value").alias("text"))


def cases(spark: SparkSession, inputs: str, expected: str, input_schema: str, expected_schema: str) -> DataFrame:
    """Evaluation cases: inputs with what is expected of them, by id."""
    return spark.read.schema(input_schema).json(inputs, multiLine=True).join(spark.read.schema(expected_schema).json(expected, multiLine=True), "id")


def write_matches(matches: DataFrame, summary: DataFrame, path: str) -> None:
    """A batch's matches, by month, and its summary."""
    matches.write.mode("overwrite").partitionBy("month").parquet(f"{path}/matches")
    summary.write.mode("overwrite").json(f"{path}/summary")


def append_logs(rows: DataFrame, keys: list[str], path: str) -> None:
    """Log rows: the keys, and all other columns as JSON without nulls."""
    rest = [c for c in rows.columns if c not in keys]
    rows.select(*keys, F.to_json(F.struct(*rest)).alias("details")).write.mode("append").parquet(path)
