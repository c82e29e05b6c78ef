"""Queries of row-level decisions, TODO rows and text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascades, report
from ..sources.adapters import adapted, oracle_with, read


def f13_category_of_text(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("p_partkey") % 5
    value = F.when(i == 0, F.concat((F.col("p_partkey") % 9 + 1).cast("string"), F.lit(". x"))).when(i == 1, F.lit("안전 시설비 등")).when(i == 2, F.lit("보호구")).otherwise(F.col("p_name"))
    return read(spark, sf, "part").select("p_partkey", cascades.category_of_text(value).alias("code"))


def p26_resolved_category(spark: SparkSession, sf: str) -> DataFrame:
    nations = read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    rows = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.concat(F.lit("NATION_"), (F.col("c_custkey") % 40).cast("string"))).alias("given"))
    return cascades.resolved_category(rows, nations, "given").select("c_custkey", "category_code")


def p15_photos_to_review(spark: SparkSession, sf: str) -> DataFrame:
    return cascades.photos_to_review(adapted(spark, sf, "files"), adapted(spark, sf, "items")).select("file_id")


def p21_generic_policy(spark: SparkSession, sf: str) -> DataFrame:
    policies = read(spark, sf, "part").select(F.array("p_name").alias("aliases"), F.when(F.col("p_partkey") % 2 == 0, F.lit("CAT_02")).alias("category"))
    items = adapted(spark, sf, "items").select("statement_id", "seq", "item_name", "category_code")
    return cascades.generic_policy(items, policies).select("statement_id", "seq", "category_code", "needs_review")


def d12_evidence_todos(spark: SparkSession, sf: str) -> DataFrame:
    links = adapted(spark, sf, "files").filter("NOT deleted").select("statement_id", F.col("item_seq").alias("seq"), "evidence_type")
    names = adapted(spark, sf, "files").select("evidence_type").distinct().filter("evidence_type <> 'site_photo'").withColumn("type_name", F.upper("evidence_type"))
    return cascades.evidence_todos(report.missing_evidence(adapted(spark, sf, "requirements"), links), names).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


def u8_omitted_answers(spark: SparkSession, sf: str) -> DataFrame:
    asked = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    answers = read(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("id"), F.col("o_orderpriority").alias("answer"), F.col("o_orderkey").alias("at"))
    none, first = cascades.omitted(asked, answers, "id")
    return first.unionByName(none.withColumn("answer", F.lit(None).cast("string")))


def w12_first_and_last(spark: SparkSession, sf: str) -> DataFrame:
    logs = adapted(spark, sf, "logs").select(F.col("statement_id").alias("item_id"), F.col("result_code").alias("result"), F.col("updated_at").alias("made_at"), "log_id")
    return cascades.first_and_last(logs)


def d5_item_decision(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("seq") + F.col("quantity").cast("int")
    rows = adapted(spark, sf, "items").select("category_code", (F.col("amount") > 90000).alias("limit_exceeded"), F.when(n % 3 == 0, F.lit(3.0)).alias("disallow_score"), F.when(n % 2 == 0, F.lit(2.6)).alias("allow_score"), F.when(n % 5 == 0, F.lit("특정 용도")).alias("evidence"), F.when(n % 7 == 0, F.lit(1.0)).alias("shortfall"))
    return cascades.item_decision(rows.na.fill(False, ["limit_exceeded"])).groupBy("status", "result_code").agg(F.count(F.lit(1)).alias("n"))


def f16_invoice_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices as text: a line for each item of an order and supplier."""
    line = F.concat_ws(" ", "item_name", F.col("quantity").cast("int").cast("string"), F.format_number(F.col("amount"), 0), F.format_number(F.floor(F.col("amount") / 10), 0))
    texts = adapted(spark, sf, "items").filter("amount IS NOT NULL").groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))).alias("ls"))
    found = cascades.invoice_lines(texts.select(F.col("statement_id").alias("id"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("text")))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("lines"), F.sum("supply").alias("supply"), F.sum("tax").alias("tax"), F.sum("quantity").alias("quantity"))


QUERIES = {
    "f13_category_of_text": f13_category_of_text, "p26_resolved_category": p26_resolved_category, "p15_photos_to_review": p15_photos_to_review, "p21_generic_policy": p21_generic_policy, "d12_evidence_todos": d12_evidence_todos,
    "u8_omitted_answers": u8_omitted_answers, "w12_first_and_last": w12_first_and_last, "d5_item_decision": d5_item_decision, "f16_invoice_lines": f16_invoice_lines,
}

ORACLES = {
    "f13_category_of_text": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'CAT_0' || (p_partkey % 9 + 1) WHEN 1 THEN 'CAT_02' WHEN 2 THEN 'CAT_03' END AS code FROM part",
    "p26_resolved_category": """WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'NATION_' || (c_custkey % 40) END AS given FROM customer)
SELECT c_custkey, CAST(coalesce(a.n_nationkey, b.n_nationkey) AS VARCHAR) AS category_code FROM g LEFT JOIN nation a ON given = CAST(a.n_nationkey AS VARCHAR) LEFT JOIN nation b ON given = b.n_name""",
    "p15_photos_to_review": f"WITH {oracle_with('files', 'items')} SELECT file_id FROM files f WHERE evidence_type = 'site_photo' AND EXISTS (SELECT 1 FROM items i WHERE i.statement_id = f.statement_id AND i.seq = f.item_seq AND category_code IN ('CAT_02', 'CAT_03'))",
    "p21_generic_policy": f"""WITH {oracle_with('items')}, p AS (SELECT DISTINCT p_name, CASE WHEN p_partkey % 2 = 0 THEN 'CAT_02' END AS c FROM part)
SELECT statement_id, seq, category_code, EXISTS (SELECT 1 FROM p WHERE p_name = item_name AND (c IS NULL OR c = category_code)) AS needs_review FROM items""",
    "d12_evidence_todos": f"""WITH {oracle_with('files', 'requirements')}, l AS (SELECT DISTINCT statement_id, item_seq AS seq, evidence_type FROM files WHERE NOT deleted)
SELECT CASE WHEN evidence_type = 'site_photo' THEN evidence_type ELSE upper(evidence_type) END || ' missing' AS title, count(*) AS n FROM requirements r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.statement_id = r.statement_id AND l.seq = r.seq AND l.evidence_type = r.evidence_type) GROUP BY 1""",
    "u8_omitted_answers": "WITH a AS (SELECT o_custkey * 2 AS id, arg_min(o_orderpriority, o_orderkey) AS answer FROM orders GROUP BY 1) SELECT c_custkey AS id, answer FROM customer LEFT JOIN a ON a.id = c_custkey",
    "w12_first_and_last": f"WITH {oracle_with('logs')} SELECT statement_id AS item_id, first(result_code ORDER BY updated_at, log_id) AS first_result, first(result_code ORDER BY updated_at DESC, log_id DESC) AS last_result FROM logs GROUP BY 1",
    "d5_item_decision": f"""WITH {oracle_with('items')}, n AS (SELECT coalesce(amount > 90000, false) AS lim, seq + CAST(quantity AS INT) AS n FROM items), f AS (SELECT *, n % 3 = 0 AND (n % 2 <> 0) AS forbids, n % 5 = 0 AS cond FROM n),
s AS (SELECT CASE WHEN lim THEN 'cap_exceeded' WHEN forbids AND NOT cond THEN 'disallowed' WHEN n % 7 = 0 THEN 'progress_short' WHEN forbids THEN 'conditional' ELSE 'ok' END AS status FROM f)
SELECT status, CASE WHEN status = 'ok' THEN 'success' ELSE 'hil' END AS result_code, count(*) AS n FROM s GROUP BY 1""",
    "f16_invoice_lines": f"""WITH {oracle_with('items')}, x AS (SELECT statement_id AS id, amount, CAST(floor(amount / 10) AS BIGINT) AS tax, CAST(quantity AS BIGINT) AS q FROM items WHERE amount IS NOT NULL)
SELECT id, count(*) AS lines, CAST(sum(amount) AS BIGINT) AS supply, CAST(sum(tax) AS BIGINT) AS tax, CAST(sum(list_min(list_filter([q, amount, tax], lambda v: v > 0 AND v < 10000))) AS BIGINT) AS quantity FROM x WHERE amount >= 100 AND tax >= 100 GROUP BY id""",
}
