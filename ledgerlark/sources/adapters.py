"""The domain's tables made of the driver's tables, in SQL that Spark and DuckDB both read.

Statements are orders, items their lines, rules the types and sizes of all parts, evidence documents and invoices the lines of one supplier in an order, agent logs
the events. (l_orderkey, l_linenumber) isn't unique, so an item's number counts the lines in the order of all columns. A file's id is unique for orders under 10^11
and suppliers under 9 * 10^7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import buckets, sized, stored

_LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

#: Of an item its amount, date and vendor; of documents and invoices what is selected, and by what they are grouped.
_AMOUNT = "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END"
_DAY = "CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_shipdate AS DATE) END"
_VENDOR = "CASE WHEN l_linenumber = 6 THEN '' ELSE s_name END"
_DOCS = """SELECT l_orderkey AS statement_id, l_suppkey AS doc_id, s_name AS vendor, max(CAST(l_shipdate AS DATE)) AS doc_date,
  CASE l_suppkey % 4 WHEN 0 THEN 'receipt' WHEN 1 THEN 'delivery_statement' WHEN 2 THEN 'wage_statement' ELSE 'tax_invoice' END AS doc_type,
  CASE WHEN l_suppkey % 11 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS infer_result,
  sum(CAST(floor(l_extendedprice) AS BIGINT)) AS supply, count(*) AS n_lines, min(p_name) AS first_item,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(floor(sum(CAST(floor(l_extendedprice) AS BIGINT)) * (l_suppkey % 3) / 200) AS BIGINT) END AS tax,
  sum(CAST(floor(l_extendedprice) AS BIGINT)) AS total"""
_DOCS_BY = "GROUP BY l_orderkey, l_suppkey, s_name"
_INVOICES = """SELECT l_orderkey AS statement_id, l_suppkey AS invoice_id, CASE WHEN l_suppkey % 13 = 0 THEN '' ELSE s_name END AS vendor,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS invoice_date, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS amount"""
_INVOICES_BY = "GROUP BY l_orderkey, l_suppkey, s_name, CAST(date_trunc('month', l_shipdate) AS DATE)"

ADAPTERS = {
    "items": f"""
SELECT l_orderkey AS statement_id, o_custkey AS project_id, CAST(o_orderdate AS DATE) AS written_on,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS INT) AS seq,
  'CAT_0' || CAST(1 + p_partkey % 9 AS STRING) AS category_code, p_name AS item_name, p_brand AS brand, p_type AS kind,
  l_quantity AS quantity, p_retailprice AS unit_price, l_suppkey AS supplier_id,
  {_AMOUNT} AS amount,
  {_DAY} AS used_on,
  {_VENDOR} AS vendor,
  'note ' || l_returnflag || '| vendor: ' || s_name || ' | flag: ' || l_linestatus AS remark
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    "docs": f"""
{_DOCS}
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey {_DOCS_BY}""",
    "invoices": f"""
{_INVOICES}
FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey {_INVOICES_BY}""",
    "logs": """
SELECT event_id AS log_id, user_id % 500 AS statement_id, 'agent_' || CAST(user_id % 7 AS STRING) AS agent, ts AS updated_at,
  CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'hil' ELSE 'success' END AS result_code,
  CASE WHEN event_id % 5 = 0 THEN 'in_progress' ELSE 'done' END AS status_code, event_type, value AS seconds,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS tokens,
  CASE event_id % 4 WHEN 0 THEN 'gpt-4o-mini-2024' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'gpt-5-mini' ELSE 'other' END AS model, props
FROM {events}""",
    "files": """
SELECT l_orderkey * 1000 + l_suppkey % 1000 + (l_suppkey - l_suppkey % 1000) * 100000000000 AS file_id, l_orderkey AS statement_id, min(l_linenumber) AS item_seq,
  CASE l_suppkey % 5 WHEN 0 THEN 'receipt' WHEN 1 THEN 'tax_invoice' WHEN 2 THEN 'site_photo' WHEN 3 THEN 'delivery_statement' ELSE 'wage_statement' END AS evidence_type,
  CASE WHEN l_suppkey % 6 = 0 THEN 'done' WHEN l_suppkey % 6 = 1 THEN 'fail' ELSE 'draft' END AS status_code,
  l_suppkey % 17 = 0 AS deleted, 'folder/' || s_name || '_' || CAST(l_orderkey AS STRING) || '.pdf' AS file_name
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_orderkey, l_suppkey, s_name""",
    "requirements": f"""
SELECT statement_id, seq, evidence_type FROM (
  SELECT l_orderkey AS statement_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS INT) AS seq, l_partkey FROM {{lineitem}}) r
  CROSS JOIN (SELECT 'receipt' AS evidence_type, 2 AS every UNION ALL SELECT 'tax_invoice', 3 UNION ALL SELECT 'site_photo', 5) t
WHERE l_partkey % every = 0""",
    "rules": """
SELECT min(p_partkey) AS rule_id, CASE WHEN min(p_partkey) % 6 = 0 THEN NULL ELSE 'CAT_0' || CAST(1 + min(p_partkey) % 9 AS STRING) END AS category_code,
  CASE p_size % 8 WHEN 0 THEN 'disallowed' WHEN 1 THEN 'allowed' WHEN 2 THEN 'limit' WHEN 3 THEN 'qa_disallowed' WHEN 4 THEN 'qa_allowed'
    WHEN 5 THEN 'category' WHEN 6 THEN 'rule_like_allowed' ELSE 'rule_like_disallowed' END AS rule_type,
  min(p_name) AS keyword, min(p_brand) || ' ' || p_type AS body, CASE WHEN p_size % 8 = 2 THEN 0.1 * (1 + min(p_partkey) % 5) END AS limit_pct
FROM {part} GROUP BY p_type, p_size""",
    "profiles": """
SELECT DISTINCT 'CAT_0' || CAST(1 + (ascii(a) * 3 + length(b) * 5 + ascii(b) + n * 4) % 9 AS STRING) AS category_code, kind,
  CASE n WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN substr(b, 2, 3) WHEN 3 THEN upper(a) WHEN 4 THEN a || ' ' || b ELSE substr(a, 1, 2) END AS term, CASE n WHEN 0 THEN b END AS other
FROM (SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM {part}) w
  CROSS JOIN (SELECT 'pair' AS kind, 0 AS n UNION ALL SELECT 'strong', 1 UNION ALL SELECT 'medium', 2 UNION ALL SELECT 'negative', 3 UNION ALL SELECT 'allow', 4 UNION ALL SELECT 'disallow', 5) k""",
    "raw_items": f"""
SELECT statement_id, seq, CASE seq % 5
  WHEN 0 THEN '{{{{"used_on": ' || coalesce('"' || CAST(used_on AS STRING) || '"', 'null') || ', "total_amount": ' || coalesce(CAST(amount AS STRING), 'null') || ', "item_name": "' || item_name || '", "category_code": "' || category_code || '", "remark": "' || remark || '"}}}}'
  WHEN 1 THEN '{{{{"date": ' || coalesce('"' || CAST(used_on AS STRING) || '"', 'null') || ', "amount": ' || coalesce(CAST(amount AS STRING), 'null') || ', "description": "' || item_name || '", "category": "' || category_code || '", "vendor": "' || vendor || '"}}}}'
  WHEN 2 THEN '{{{{"사용일자": ' || coalesce('"' || CAST(used_on AS STRING) || '"', 'null') || ', "금액": ' || coalesce(CAST(amount AS STRING), 'null') || ', "사용내역": "' || item_name || '", "항목명": "' || category_code || '", "추가정보": {{{{"업체명": "", "교육주관": "' || vendor || '"}}}}}}}}'
  WHEN 3 THEN '{{{{"사용내역": "' || item_name || '", "추가정보": {{{{"업체명": "' || vendor || '"}}}}}}}}'
  ELSE 'note ' || item_name END AS raw
FROM (SELECT l_orderkey AS statement_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS INT) AS seq, 'CAT_0' || CAST(1 + p_partkey % 9 AS STRING) AS category_code, p_name AS item_name,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS amount, CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS used_on,
  CASE WHEN l_linenumber = 6 THEN '' ELSE s_name END AS vendor, 'note ' || l_returnflag || '| vendor: ' || s_name || ' | flag: ' || l_linestatus AS remark
  FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey) i""",
    "raw_docs": """
SELECT statement_id, doc_id, CASE doc_id % 4 WHEN 0 THEN 'wage_statement' WHEN 1 THEN 'delivery_statement' WHEN 2 THEN 'transaction' ELSE 'receipt' END AS kind, CASE doc_id % 4
  WHEN 0 THEN '{{"vendor": "' || vendor || '", "date": "' || on_day || '", "total_amount": ' || total || ', "items": [{{"item_name": "", "name": "' || one || '", "amount": ' || total || '}}, {{"item_name": "' || two || '", "amount": null}}], "validation": {{"is_valid": ' || valid || ', "warnings": ["w' || total || '"]}}}}'
  WHEN 1 THEN '{{"supplier": {{"company_name": "' || vendor || '"}}, "store": {{"name": "other"}}, "issue_date": "' || on_day || '", "total_amount": ' || total || ', "items": [{{"item_name": "' || one || '", "supply_amount": ' || total || ', "tax_amount": 10, "count": 0, "quantity": 3}}, {{"name": "' || two || '", "tax_amount": 5}}], "infer_result": ""}}'
  WHEN 2 THEN '{{"supplier": {{"company_name": ""}}, "store": {{"name": "' || vendor || '"}}, "payment": {{"date": "' || on_day || '"}}, "total_amount": null, "items": [], "validation": {{"has_required_fields": ' || valid || '}}}}'
  ELSE '{{"store": {{"name": "' || vendor || '"}}, "payment": {{"date": "' || on_day || '"}}, "total_amount": ' || total || ', "items": [{{"name": "' || one || '", "count": 2, "amount": ' || total || '}}], "validation": {{"has_required_fields": ' || valid || ', "warnings": ["a"], "errors": ["b"]}}' || CASE WHEN doc_id % 3 = 0 THEN ', "infer_result": "SUCCESS"' ELSE '' END || '}}' END AS raw
FROM (SELECT l_orderkey AS statement_id, l_suppkey AS doc_id, s_name AS vendor, CAST(max(CAST(l_shipdate AS DATE)) AS STRING) AS on_day, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS STRING) AS total, min(p_name) AS one, max(p_name) AS two,
  CASE WHEN l_orderkey % 3 = 0 THEN 'true' ELSE 'false' END AS valid FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_orderkey, l_suppkey, s_name) d""",
    "law_texts": """
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'CAT_0' || CAST(doc_id % 10 AS STRING) END AS category_code,
  CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '제' || CAST(n_chars % 130 AS STRING) || '조제2항' WHEN 2 THEN '제4조제2호 | 제' || CAST(n_chars % 130 AS STRING) || '조|별표 2' WHEN 3 THEN ' 제' || CAST(n_chars % 130 AS STRING) || '조 ' WHEN 4 THEN 'other basis' ELSE '' END AS legal_basis,
  CASE doc_id % 7 WHEN 0 THEN '산업안전보건법 시행규칙 제' || CAST(n_chars % 130 AS STRING) || '조제2항 및 제98조, 제' || CAST(doc_id % 130 AS STRING) || '조' WHEN 1 THEN '제17조와 제17조, 제' || CAST(doc_id % 130 AS STRING) || '조제1항제2호 (별표 ' || CAST(doc_id % 5 AS STRING) || ')'
    WHEN 2 THEN '건설업 산업안전보건관리비 계상 및 사용기준 제7조제1항제' || CAST(doc_id % 10 AS STRING) || '호' WHEN 3 THEN '(제' || CAST(n_chars % 90 AS STRING) || '조) 건설기술 진흥법제62조' WHEN 4 THEN 'no law ' || source
    WHEN 5 THEN '응급의료에 관한 법률 제47조 / 중대재해 처벌 등에 관한 법률 시행령 제4조제2호' ELSE '' END AS body,
  '제' || CAST(doc_id % 70 AS STRING) || '조제1항;별표 ' || CAST(n_chars % 5 AS STRING) || ';제62조;제2조제3항;제98조;제4조제' || CAST(doc_id % 3 AS STRING) || '호;별표 3;제' || CAST(n_chars % 70 AS STRING) || '조제1항;제17조' AS cited
FROM {documents}""",
    "item_checks": f"""
SELECT statement_id, seq, CASE (statement_id + seq) % 5 WHEN 0 THEN '검토필요' WHEN 1 THEN '카테고리변경' ELSE '유지' END AS class_status, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN '' ELSE 'class ' || CAST(seq AS STRING) END AS class_reason,
  CASE (statement_id * 3 + seq) % 7 WHEN 0 THEN 'fail' WHEN 1 THEN 'conditional' WHEN 2 THEN NULL WHEN 3 THEN 'odd word' ELSE 'ok' END AS law_status, CASE WHEN seq % 4 = 0 THEN NULL ELSE 'law ' || CAST(statement_id AS STRING) END AS law_reason,
  CASE WHEN seq % 2 = 0 THEN '제' || CAST(statement_id % 9 AS STRING) || '조' END AS cited
FROM (SELECT l_orderkey AS statement_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS INT) AS seq FROM {{lineitem}}) i""",
    "item_logs": """
SELECT event_id AS log_id, user_id % 500 AS statement_id, CAST(1 + event_id % 5 AS INT) AS seq, ts AS created_at, CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'HIL ' WHEN 'view' THEN 'success' WHEN 'signup' THEN 'warning' ELSE 'odd' END AS result_code,
  CASE event_id % 4 WHEN 0 THEN '{{"summary": "s' || CAST(event_id AS STRING) || '", "basis": "b"}}' WHEN 1 THEN '{{"summary": "", "reason": "r' || CAST(event_id AS STRING) || '", "action": "a' || CAST(event_id AS STRING) || '"}}'
    WHEN 2 THEN '{{"problem": "p", "sources": [{{"조항": "제' || CAST(event_id % 7 AS STRING) || '조"}}, {{"legal_basis": ""}}]}}' ELSE '{{}}' END AS details
FROM {events}""",
    "invoice_texts": """
SELECT statement_id, invoice_id, CASE k WHEN 0 THEN '전자세금계산서' || nl || '공급자 등록번호 ' || num || ' 상호: ' || vendor || ', 대표자: 김철수, ' || nl || '공급받는자 987 65 43210 상호 : ' || buyer || ' | 작성일자: ' || on_day || nl || '공급가액 ' || net || ' 세액: ' || tax || nl || '합계금액 ' || total
  WHEN 1 THEN '판매자' || nl || '  ' || vendor || ' ' || nl || '작성일 2024.13.40 거래일자 ' || on_day || nl || '공급가액합계 0 공급가액 ' || net || nl || '세액 ' || tax
  WHEN 2 THEN '공급자' || nl || '123 street' || nl || '발행자' || nl || vendor || nl || on_day || ' and ' || num || ' 총액 ' || total
  WHEN 3 THEN nl || 'no field ' || vendor ELSE '매입자 상호 ' || buyer || ', 발행일 ' || on_day || ' 청구금액 , 합계 ' || total END AS text
FROM (SELECT l_orderkey AS statement_id, l_suppkey AS invoice_id, (l_orderkey + l_suppkey) % 5 AS k, s_name AS vendor, 'Buyer ' || CAST(l_orderkey AS STRING) AS buyer, chr(10) AS nl, CAST(max(CAST(l_shipdate AS DATE)) AS STRING) AS on_day,
  CAST(1000000000 + l_orderkey * 1000 + l_suppkey AS STRING) AS num, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS STRING) AS net, CAST(l_suppkey AS STRING) AS tax, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) + l_suppkey AS STRING) AS total
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_orderkey, l_suppkey, s_name) t""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the domain's tables, lazily, over the driver's tables in sf_dir."""
    sql = ADAPTERS[name]
    tables = [t for t in TABLES if "{" + t + "}" in sql]
    sized(spark, [f"{sf_dir}/{t}.parquet" for t in tables])
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in tables})


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of lineitem with their supplier, part and order, joined once and stored by order: what items, docs and invoices are made of, which then need no shuffle.

    A row for each part of a line's key (part_no from 0; null without a part, as invoices don't need one), with its place among the order's rows of its kind and the number of orders of its key.
    """
    line, part, supplier, orders = (read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "orders"))
    sized(spark, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part", "supplier", "orders")])
    named = part.groupBy("p_partkey").agg(F.collect_list(F.struct("p_name")).alias("parts"))
    full = line.join(supplier.select("s_suppkey", "s_name"), F.expr("l_suppkey = s_suppkey")).join(named, F.expr("l_partkey = p_partkey"), "left")
    full = full.select("l_orderkey", *_LINE.split(", "), "s_name", F.posexplode_outer("parts").alias("part_no", "own")).repartition(buckets(spark), "l_orderkey")
    place = F.expr(f"CAST(row_number() OVER (PARTITION BY l_orderkey, part_no IS NULL ORDER BY {_LINE}) AS INT)")
    counts = orders.select("o_orderkey").repartition(buckets(spark), "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n_orders"))
    out = full.withColumn("place", place).join(counts, F.expr("l_orderkey = o_orderkey"), "left")
    price, day = F.expr("CAST(floor(l_extendedprice) AS BIGINT)").alias("l_extendedprice"), F.expr("CAST(l_shipdate AS DATE)").alias("l_shipdate")
    return stored(out.select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", price, day, "s_name", F.col("own.p_name").alias("p_name"), "part_no", "place", "n_orders"), "lines")


def items_of(lines: DataFrame) -> DataFrame:
    """The columns of items that matching reads."""
    sql = f"""SELECT l_orderkey AS statement_id, (place - 1) * n_orders + copy AS seq, p_name AS item_name, {_AMOUNT} AS amount, l_quantity AS quantity, {_DAY} AS used_on, {_VENDOR} AS vendor, l_suppkey AS supplier_id
FROM {{lines}} LATERAL VIEW explode(sequence(1, n_orders)) AS copy WHERE part_no IS NOT NULL AND n_orders > 0"""
    return lines.sparkSession.sql(sql, lines=lines)


def docs_of(lines: DataFrame) -> DataFrame:
    return lines.sparkSession.sql(f"{_DOCS} FROM {{lines}} WHERE part_no IS NOT NULL {_DOCS_BY}", lines=lines)


def invoices_of(lines: DataFrame) -> DataFrame:
    return lines.sparkSession.sql(f"{_INVOICES} FROM {{lines}} WHERE coalesce(part_no, 0) = 0 {_INVOICES_BY}", lines=lines)


def oracle_with(*names: str) -> str:
    """The WITH clause, without the word, that has the adapted tables for DuckDB."""
    return ",\n".join(f"{n} AS ({ADAPTERS[n].format(**{t: t for t in TABLES})})" for n in names)
