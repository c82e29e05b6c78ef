"""Queries of context joins and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context
from ..sources.adapters import adapted, oracle_with, read


def j4_item_context(spark: SparkSession, sf: str) -> DataFrame:
    items = adapted(spark, sf, "items")
    customers = read(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"), "c_mktsegment", "c_nationkey")
    nations = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = items.join(customers, "project_id").join(nations, "c_nationkey")
    return rows.groupBy("n_name", "c_mktsegment", "category_code").agg(F.count(F.lit(1)).alias("items"), F.sum("amount").alias("amount"))


def j5_files_per_item(spark: SparkSession, sf: str) -> DataFrame:
    out = context.files_per_item(adapted(spark, sf, "items").select("statement_id", "seq"), adapted(spark, sf, "files"))
    return out.select("statement_id", "seq", "n_files", F.coalesce(F.array_join("file_ids", ","), F.lit("")).alias("file_ids"))


def j14_verdict_fallback(spark: SparkSession, sf: str) -> DataFrame:
    items = adapted(spark, sf, "items").select("statement_id", "seq", "category_code", "amount")
    own = items.filter("amount % 3 = 0").select("statement_id", "seq", F.lit("own").alias("verdict"))
    category = items.groupBy("statement_id", "category_code").agg(F.sum("amount").alias("s")).filter("s % 2 = 0").select("statement_id", "category_code", F.lit("category").alias("verdict"))
    return context.with_fallback(items, own, category).groupBy("category_code", "verdict").agg(F.count(F.lit(1)).alias("n"))


def j16_natural_keys(spark: SparkSession, sf: str) -> DataFrame:
    items = adapted(spark, sf, "items").select((F.col("statement_id") * 100 + F.col("seq")).alias("id"), "statement_id", "category_code", "item_name")
    return context.natural_keys(items, ["statement_id", "category_code", "item_name"])


def j17_first_context(spark: SparkSession, sf: str) -> DataFrame:
    return context.first_context(adapted(spark, sf, "files"), adapted(spark, sf, "items"))


def j18_owners(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    records = orders.select("o_orderkey", F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("requester"))
    uploads = orders.filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") + 1).alias("uploader"))
    assignees = orders.filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("assignee"), F.col("o_orderdate").alias("assigned_at"))
    return context.owners(records, uploads, assignees).select("o_orderkey", "owner")


def j13_citations(spark: SparkSession, sf: str) -> DataFrame:
    sources = read(spark, sf, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("legal_basis"))
    cite = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey").cast("string")).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("Brand#"), (F.col("l_partkey") % 30).cast("string"))).otherwise(F.lit("none"))
    citations = read(spark, sf, "lineitem").select(cite.alias("citation"))
    return context.by_citation(citations, sources).groupBy("citation", "source_id").agg(F.count(F.lit(1)).alias("n"))


def a26_changes(spark: SparkSession, sf: str) -> DataFrame:
    items = adapted(spark, sf, "items").select("statement_id", F.col("seq").cast("int").alias("seq"), F.col("category_code").alias("given_code"), F.when(F.col("quantity") > 25, F.lit("CAT_03")).otherwise(F.col("category_code")).alias("final_code"))
    return context.change_counts(items, ["statement_id"]).select("statement_id", "changed", "kept")


def p13_project_check(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderkey") % 10 != 0, F.trunc("o_orderdate", "MM")).alias("month"), F.concat(F.lit("Customer "), (F.col("o_custkey") + F.col("o_orderkey") % 2).cast("string"), F.lit(" 신축공사")).alias("statement_name"))
    projects = read(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"), F.lit("1996-01-15").cast("date").alias("start"), F.lit("1999-06-30").cast("date").alias("end"), F.concat(F.lit("Customer"), F.col("c_custkey").cast("string")).alias("project_name"))
    return context.project_check(orders, projects).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def p16_equipment(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, F.lit(" 안전모")).when(F.col("p_partkey") % 5 == 1, F.lit(" 안전대")).otherwise(F.lit("")))
    return read(spark, sf, "part").select("p_partkey", context.target_equipment(name).alias("equipment"))


def w5_carried_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapted(spark, sf, "items").select("statement_id", "seq", F.when(F.col("quantity") > 30, F.col("category_code")).alias("category_code"))
    return context.carried_forward(rows, "statement_id", "seq", "category_code")


def a25_grouped_laws(spark: SparkSession, sf: str) -> DataFrame:
    return context.grouped_laws(read(spark, sf, "part").select(F.col("p_type").alias("summary"), F.col("p_brand").alias("law")))


def p23_preferred_corpus(spark: SparkSession, sf: str) -> DataFrame:
    chunks = read(spark, sf, "documents").select("doc_id", "source", (F.col("doc_id") % 3 == 0).alias("is_pdf"))
    return context.preferred_corpus(chunks).select("doc_id", "source")


def p25_validator_rows(spark: SparkSession, sf: str) -> DataFrame:
    blocks = adapted(spark, sf, "items").select("statement_id", "seq", F.when(F.col("seq") != 4, F.col("item_name")).otherwise(F.lit(" ")).alias("item_name"), "amount", (F.col("statement_id") % 20).alias("budget"))
    good, bad = context.validator_rows(blocks)
    return good.withColumn("reject_reason", F.lit("ok")).unionByName(bad).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def o2_newest_logs(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the newest failed logs."""
    return context.newest(adapted(spark, sf, "logs").filter("result_code = 'fail'").select("log_id", "agent", "updated_at"), [F.desc("updated_at"), F.desc("log_id")], 50)


QUERIES = {
    "j4_item_context": j4_item_context, "j5_files_per_item": j5_files_per_item, "j14_verdict_fallback": j14_verdict_fallback, "j16_natural_keys": j16_natural_keys, "j17_first_context": j17_first_context, "j18_owners": j18_owners,
    "j13_citations": j13_citations, "a26_changes": a26_changes, "p13_project_check": p13_project_check, "p16_equipment": p16_equipment, "w5_carried_forward": w5_carried_forward, "a25_grouped_laws": a25_grouped_laws,
    "p23_preferred_corpus": p23_preferred_corpus, "p25_validator_rows": p25_validator_rows, "o2_newest_logs": o2_newest_logs,
}

ORACLES = {
    "j4_item_context": f"WITH {oracle_with('items')} SELECT n_name, c_mktsegment, category_code, count(*) AS items, CAST(sum(amount) AS BIGINT) AS amount FROM items JOIN customer ON project_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3",
    "j5_files_per_item": f"""WITH {oracle_with('items', 'files')}, f AS (SELECT statement_id, item_seq, count(*) AS n, string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY file_id) AS ids FROM files WHERE NOT deleted GROUP BY 1, 2)
SELECT i.statement_id, seq, CAST(coalesce(n, 0) AS INT) AS n_files, coalesce(ids, '') AS file_ids FROM items i LEFT JOIN f ON f.statement_id = i.statement_id AND f.item_seq = i.seq""",
    "j14_verdict_fallback": f"""WITH {oracle_with('items')}, c AS (SELECT statement_id, category_code FROM items GROUP BY 1, 2 HAVING sum(amount) % 2 = 0)
SELECT i.category_code, CASE WHEN amount % 3 = 0 THEN 'own' WHEN c.statement_id IS NOT NULL THEN 'category' ELSE 'unchecked' END AS verdict, count(*) AS n FROM items i LEFT JOIN c ON c.statement_id = i.statement_id AND c.category_code = i.category_code GROUP BY 1, 2""",
    "j16_natural_keys": f"WITH {oracle_with('items')} SELECT statement_id, category_code, item_name, min(statement_id * 100 + seq) AS id, count(*) AS shared FROM items GROUP BY 1, 2, 3",
    "j17_first_context": f"""WITH {oracle_with('files', 'items')}, m AS (SELECT file_id, item_name, category_code, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS n FROM files f LEFT JOIN items i ON i.statement_id = f.statement_id AND f.item_seq <= i.seq)
SELECT file_id, item_name, category_code FROM m WHERE n = 1""",
    "j18_owners": """WITH a AS (SELECT o_custkey AS p, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS assignee FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 1 END, assignee) AS owner FROM orders LEFT JOIN a ON p = o_custkey""",
    "j13_citations": """WITH c AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN 'Brand#' || (l_partkey % 30) ELSE 'none' END AS citation FROM lineitem),
k AS (SELECT CAST(p_partkey AS VARCHAR) AS citation, p_partkey AS s FROM part UNION ALL SELECT p_brand, min(p_partkey) FROM part GROUP BY p_brand) SELECT citation, s AS source_id, count(*) AS n FROM c LEFT JOIN k USING (citation) GROUP BY 1, 2""",
    "a26_changes": f"WITH {oracle_with('items')} SELECT statement_id, count_if(quantity > 25 AND category_code <> 'CAT_03') AS changed, count_if(NOT (quantity > 25 AND category_code <> 'CAT_03')) AS kept FROM items GROUP BY 1",
    "p13_project_check": """SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'month_unknown' WHEN date_trunc('month', o_orderdate) < DATE '1996-01-01' OR date_trunc('month', o_orderdate) > DATE '1999-06-30' THEN 'outside_construction'
  WHEN NOT (contains('Customer' || (o_custkey + o_orderkey % 2), 'Customer' || o_custkey) OR contains('Customer' || o_custkey, 'Customer' || (o_custkey + o_orderkey % 2))) THEN 'other_project' END AS violation, count(*) AS n FROM orders GROUP BY 1""",
    "p16_equipment": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'safety_helmet' WHEN 1 THEN 'safety_belt' END AS equipment FROM part",
    "w5_carried_forward": f"WITH {oracle_with('items')} SELECT statement_id, seq, last_value(CASE WHEN quantity > 30 THEN category_code END IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category_code FROM items",
    "a25_grouped_laws": "SELECT p_type AS summary, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS laws, count(*) AS uses FROM part GROUP BY 1",
    "p23_preferred_corpus": "SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0",
    "p25_validator_rows": f"""WITH {oracle_with('items')} SELECT CASE WHEN seq = 4 OR item_name = '' THEN 'no_name' WHEN amount IS NULL THEN 'no_amount' WHEN statement_id % 20 <= 0 THEN 'no_budget' ELSE 'ok' END AS reject_reason, count(*) AS n FROM items GROUP BY 1""",
    "o2_newest_logs": f"WITH {oracle_with('logs')} SELECT log_id, agent, updated_at FROM logs WHERE result_code = 'fail' ORDER BY updated_at DESC, log_id DESC LIMIT 50",
}
