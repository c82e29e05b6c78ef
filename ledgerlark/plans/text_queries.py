"""Queries of the text, date, amount and nested-value functions, over strings made of the tables' values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, dates, nested, text
from ..sources.adapters import adapted, oracle_with, read
from ..sources.shared import stored


def f1_vendor_names(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("s_suppkey") % 6
    name = F.when(i == 0, F.concat(F.lit("㈜"), "s_name")).when(i == 1, F.concat(F.lit(" (주) "), "s_name")).when(i == 2, F.concat("s_name", F.lit("(유)"))).when(i == 3, F.concat(F.lit("(株)"), "s_name")).when(i == 4, F.concat("s_name", F.lit(" ㈔"))).otherwise(F.col("s_name"))
    rows = read(spark, sf, "supplier").select("s_suppkey", name.alias("name"))
    return rows.select("s_suppkey", text.vendor_normalised(F.col("name")).alias("plain"), text.vendor_key(F.col("name")).alias("key"))


def p2_remark_vendor(spark: SparkSession, sf: str) -> DataFrame:
    return adapted(spark, sf, "items").select("statement_id", "seq", text.remark_vendor(F.col("remark")).alias("remark_vendor"))


def f40_dates(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("o_orderkey") % 5
    y, m, d = (F.date_format("o_orderdate", p) for p in ("yyyy", "MM", "dd"))
    shown = F.when(i == 0, F.concat_ws("-", y, m, d)).when(i == 1, F.concat_ws(".", y, m, d)).when(i == 2, F.concat(F.substring(y, 3, 2), F.lit("/"), m, F.lit("/"), d)).when(i == 3, F.concat(y, F.lit("년 "), m, F.lit("월 "), d, F.lit("일"))).otherwise(F.lit("none"))
    rows = read(spark, sf, "orders").select("o_orderkey", shown.alias("shown"), F.to_date("o_orderdate").alias("day"))
    return rows.select("o_orderkey", F.coalesce(dates.iso_date(F.col("shown")).cast("string"), F.lit("-")).alias("iso"), F.coalesce(dates.loose_date(F.col("shown")).cast("string"), F.lit("-")).alias("loose"), dates.date_anomaly(F.col("shown"), F.lit("1999-01-01").cast("date")).alias("anomaly"))


def f43_date_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.when(F.col("l_linenumber") != 5, F.to_date("l_shipdate")), F.when(F.col("l_linenumber") < 5, F.to_date("o_orderdate"))
    return rows.select(dates.date_score(a, b).alias("score"), dates.month_gate(a, b).alias("gate")).groupBy("score", "gate").agg(F.count(F.lit(1)).alias("n"))


def f50_amount_scores(spark: SparkSession, sf: str) -> DataFrame:
    pairs = adapted(spark, sf, "items").join(adapted(spark, sf, "docs").select("statement_id", "total", "doc_type", "supply", "tax"), "statement_id")
    amount = amounts.document_amount(F.col("doc_type"), F.col("supply"), F.col("tax"), F.col("total"))
    return pairs.select("doc_type", amounts.amount_score(F.col("amount"), amount).alias("score")).groupBy("doc_type", "score").agg(F.count(F.lit(1)).alias("n"))


def f53_integrity(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapted(spark, sf, "items")
    off = amounts.price_integrity(F.col("unit_price"), F.col("quantity"), F.col("amount"))
    vat = amounts.vat_plausible(F.col("amount"), F.col("amount") % 1000)
    head = amounts.reconciliation(F.col("amount"), F.col("amount") + F.col("seq"), F.col("amount") + 20)
    return rows.select(off.alias("off"), vat.alias("vat"), head.alias("state")).groupBy("off", "vat", "state").agg(F.count(F.lit(1)).alias("n"))


def f63_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part")
    shown = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.format_number(F.floor("p_retailprice"), 0), F.lit("원"))).when(F.col("p_partkey") % 4 == 1, F.lit("-")).when(F.col("p_partkey") % 4 == 2, F.concat(F.col("p_size").cast("string"), F.lit("개"))).otherwise(F.lit("0"))
    return rows.select("p_partkey", amounts.lenient_amount(shown).alias("amount"), amounts.leading_number(shown).alias("number"))


def f62_recognised(spark: SparkSession, sf: str) -> DataFrame:
    caps = adapted(spark, sf, "items").withColumn("cap", F.when(F.col("seq") % 2 == 0, F.lit(30000)))
    ok, bad = amounts.recognised(F.col("amount"), F.col("cap"))
    return caps.groupBy("category_code").agg(F.sum(ok).alias("recognised"), F.sum(bad).alias("disputed"))


def p6_statement_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents")
    words = ["the", "of", "and", "de", "la", "der", "in", "to", "que", "und"]
    found = text.is_usage_statement(F.lower("text"), words)
    return rows.select("doc_id", found.alias("is_statement"), text.has_at_least(F.lower("text"), words[:4], 2).alias("two_of_four"))


def p7_skip_rows(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.array(F.when(F.col("p_partkey") % 5 == 0, F.lit("소 계")).otherwise(F.col("p_name")), F.col("p_brand"), F.col("p_type"), F.lit("x"), F.lit("합계"))
    return read(spark, sf, "part").select("p_partkey", text.is_skip_row(cells).alias("skip"))


def p9_category_codes(spark: SparkSession, sf: str) -> DataFrame:
    code = (F.col("p_partkey") % 12).cast("string")
    return read(spark, sf, "part").select("p_partkey", text.category_code(code).alias("code"), text.category_digit(text.category_code(code)).alias("digit"))


def p5_document_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The files' eligible rows, with a stem of their names."""
    files = adapted(spark, sf, "files").filter("NOT deleted AND status_code IN ('draft', 'fail')")
    return files.select("file_id", "evidence_type", text.file_stem(F.col("file_name")).alias("stem"), text.source_name(F.col("file_name")).alias("source"))


def f11_business_numbers(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 10, "1"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).when(F.col("c_custkey") % 3 == 1, F.lit("9")).otherwise(F.lit("")))
    n = text.business_number(raw)
    return read(spark, sf, "customer").select("c_custkey", n.alias("number"), text.is_business_number(n).alias("valid"))


def f10_project_core(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("c_custkey") % 4
    name = F.concat_ws(" ", "c_name", F.when(i == 0, F.lit("신축공사")).when(i == 1, F.lit("공사")).when(i == 2, F.lit("리모델링 공사")))
    return read(spark, sf, "customer").select("c_custkey", text.project_core(name).alias("core"))


def f17_laws(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("p_partkey") % 30).cast("string")
    ref = F.concat(F.lit("산업안전보건법 제"), n, F.lit("조"), F.when(F.col("p_partkey") % 2 == 0, F.lit("제1항")).otherwise(F.lit("")))
    parts = text.law_parts(ref)
    tags = F.concat(F.lit("x [LEGAL_CITE: "), ref, F.lit("| 제"), n, F.lit("조] y [LEGAL_CITE: "), ref, F.lit("]"))
    laws = text.collapsed_laws(F.array(ref, F.concat(F.lit("산업안전보건법 제"), n, F.lit("조")), F.lit(" ")))
    return read(spark, sf, "part").select("p_partkey", parts["law"].alias("law"), parts["article"].alias("article"), parts["clause"].alias("clause"), F.array_join(text.cited(tags), ";").alias("cited"), F.array_join(laws, ";").alias("laws"))


def f21_limits(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("p_partkey") % 4
    n = (F.col("p_size") % 40 + 1).cast("string")
    body = F.concat(F.when(i == 0, F.concat(F.lit("총액의 100분의 "), n)).when(i == 1, F.concat(F.lit("계상액의 50분의 "), n)).when(i == 2, F.concat(F.lit("총액 대비 "), n, F.lit("%"))).otherwise(F.concat(F.lit("비용의 "), n, F.lit("%"))), F.lit("를 초과할 수 없다"))
    return read(spark, sf, "part").select("p_partkey", F.round(text.total_limit(body), 6).alias("limit_share"))


def f22_cost_ratio(spark: SparkSession, sf: str) -> DataFrame:
    n, m = (F.col("p_size") % 40 + 1).cast("string"), (F.col("p_partkey") % 90 + 5).cast("string")
    body = F.concat(F.lit("구입·임대 비용의 "), n, F.lit("% 까지 사용 가능 "), F.repeat(F.lit("x"), 300), F.lit(" "), m, F.lit("% 다른 값"))
    return read(spark, sf, "part").select("p_partkey", F.round(text.cost_ratio_limit(body, F.lit(80)), 6).alias("ratio"))


def f25_sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    doubled = F.concat_ws(" ", "text", "text")
    return docs.select("doc_id", F.length(text.without_sentences(F.col("text"), [["the", "der"], ["of", "und"]])).alias("kept"), (F.length(text.distinct_sentences(doubled)) < F.length(doubled)).alias("shorter"))


def f4_text_sets(spark: SparkSession, sf: str) -> DataFrame:
    parts = read(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    # Sets are made and compared once for each distinct name and type. A missing one counts as empty.
    names = parts.select("p_partkey", *[F.coalesce(c, F.lit("")).alias(c) for c in ("p_name", "p_type")])
    sets = names.select("p_name", "p_type").distinct().withColumns({"_x": text.normalised(F.col("p_name")), "_y": text.normalised(F.concat_ws(" ", "p_name", "p_type"))})
    sets = sets.withColumns({"_xb": text.bigrams(F.col("_x")), "_yb": text.bigrams(F.col("_y")), "_xt": text.tokens(F.col("_x")), "_yt": text.tokens(F.col("_y"))})
    each = sets.select("p_name", "p_type", F.round(text.jaccard(F.col("_xb"), F.col("_yb")), 6).alias("bigram"), F.round(text.jaccard(F.col("_xt"), F.col("_yt")), 6).alias("token"), F.size(text.rule_tokens(F.col("p_type"), ["economy"])).alias("rule_tokens"))
    return names.join(stored(each, "text-sets"), ["p_name", "p_type"]).select("p_partkey", "bigram", "token", "rule_tokens")


def f77_usage_tokens(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id") % 3
    n = F.floor(F.col("value") * 10).cast("string")
    usage = F.when(i == 0, F.concat(F.lit('{"prompt_tokens":'), n, F.lit(',"completion_tokens":5,"prompt_tokens_details":{"cached_tokens":'), (F.col("event_id") % 90).cast("string"), F.lit("}}"))).when(i == 1, F.concat(F.lit('{"input_tokens":'), n, F.lit(',"output_tokens":7,"total_tokens":1}'))).otherwise(F.lit("{}"))
    t = nested.tokens_used(usage)
    return read(spark, sf, "events").select("event_id", *[t[c].alias(f"tokens_{c}") for c in ("input", "cached", "output", "total")])


def s12_merged_details(spark: SparkSession, sf: str) -> DataFrame:
    detail = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"))
    patch = F.create_map(F.lit("type"), F.lit("patched"), F.lit("new"), (F.col("event_id") % 3).cast("string"))
    m = nested.merged_detail(detail, F.when(F.col("event_id") % 2 == 0, patch))
    return read(spark, sf, "events").select("event_id", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("k", "type", "new")])


def u3_photo_codes(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit("안전모")).otherwise(F.col("p_name"))
    need = F.array(F.lit("receipt"), F.lit("site_photo"), F.when(F.col("p_partkey") % 2 == 0, F.lit("wage_statement")).otherwise(F.lit("tax_invoice")))
    allowed = F.array(F.lit("receipt"), F.lit("tax_invoice"), F.lit("site_photo"), F.lit("wearing_photo"))
    return read(spark, sf, "part").select("p_partkey", F.array_join(nested.photo_codes(need, allowed, name), ",").alias("codes"))


def f32_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part")
    return rows.select("p_partkey", text.money_label(F.floor("p_retailprice")).alias("money"), text.body_hash(F.col("p_name")).alias("hash"), F.coalesce(text.question(F.concat(F.lit("  a\t"), "p_name")), F.lit("-")).alias("question"), text.evidence_text(F.concat("p_name", F.lit("  "), "p_type"), 12).alias("evidence"), text.match_text(F.concat("p_brand", F.lit("! "), "p_type")).alias("match"))


QUERIES = {
    "f1_vendor_names": f1_vendor_names, "p2_remark_vendor": p2_remark_vendor, "f40_loose_dates": f40_dates, "f43_date_scores": f43_date_scores, "f50_amount_scores": f50_amount_scores, "f53_integrity": f53_integrity,
    "f63_lenient_numbers": f63_numbers, "f62_recognised": f62_recognised, "p6_statement_words": p6_statement_words, "p7_skip_rows": p7_skip_rows, "p9_category_codes": p9_category_codes, "p10_eligible_files": p5_document_kinds,
    "f11_business_numbers": f11_business_numbers, "f10_project_core": f10_project_core, "f17_law_references": f17_laws, "f21_total_limits": f21_limits, "f22_cost_ratio": f22_cost_ratio, "f25_sentences": f25_sentences,
    "f4_text_sets": f4_text_sets, "f77_usage_tokens": f77_usage_tokens, "s12_merged_details": s12_merged_details, "u3_photo_codes": u3_photo_codes, "f32_labels": f32_labels,
}

_SCORE = """CASE WHEN amount IS NULL AND a IS NULL THEN NULL WHEN amount IS NULL OR a IS NULL THEN 0.3 WHEN greatest(amount, a) = 0 THEN 1.0 WHEN abs(amount - a) / greatest(amount, a) <= 0.01 THEN 1.0 WHEN abs(amount - a) / greatest(amount, a) <= 0.05 THEN 0.85
  WHEN abs(amount - a) / greatest(amount, a) <= 0.1 THEN 0.65 WHEN abs(amount - a) / greatest(amount, a) <= 0.2 THEN 0.3 ELSE 0.0 END::DOUBLE"""
ORACLES = {
    "f1_vendor_names": """WITH p AS (SELECT s_suppkey, s_name, s_suppkey % 6 AS i, lower(replace(s_name, '#', '')) AS k FROM supplier)
SELECT s_suppkey, CASE i WHEN 0 THEN '주' || s_name WHEN 1 THEN '주 ' || s_name WHEN 2 THEN s_name || '유' WHEN 3 THEN '주' || s_name WHEN 4 THEN s_name || ' 사' ELSE s_name END AS plain, k AS key FROM p""",
    "p2_remark_vendor": f"WITH {oracle_with('items')} SELECT statement_id, seq, split_part(split_part(remark, 'vendor: ', 2), ' |', 1) AS remark_vendor FROM items",
    "f40_loose_dates": """WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS i, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN i = 0 THEN CAST(d AS VARCHAR) ELSE '-' END AS iso, CASE WHEN i = 4 THEN '-' WHEN i = 2 THEN '20' || strftime(d, '%y-%m-%d') ELSE CAST(d AS VARCHAR) END AS loose,
  CASE WHEN i = 4 THEN 'unreadable' WHEN (CASE WHEN i = 2 THEN '20' || strftime(d, '%y-%m-%d') ELSE CAST(d AS VARCHAR) END) > '1999-01-01' THEN 'future' ELSE 'old' END AS anomaly FROM o""",
    "f43_date_scores": """WITH x AS (SELECT CASE WHEN l_linenumber <> 5 THEN CAST(l_shipdate AS DATE) END AS a, CASE WHEN l_linenumber < 5 THEN CAST(o_orderdate AS DATE) END AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
y AS (SELECT *, date_trunc('month', a) = date_trunc('month', b) AS m, abs(date_diff('day', a, b)) <= 2 AS n FROM x)
SELECT CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL OR b IS NULL THEN 0.4 WHEN m THEN 1.0 WHEN n THEN 0.85 ELSE 0.0 END::DOUBLE AS score, CASE WHEN a IS NULL OR b IS NULL THEN true ELSE m OR n END AS gate, count(*) AS n FROM y GROUP BY 1, 2""",
    "f50_amount_scores": f"""WITH {oracle_with('items', 'docs')}, x AS (SELECT doc_type, amount, CASE WHEN doc_type IN ('delivery_statement', 'tax_invoice') AND tax IS NOT NULL THEN supply + tax ELSE total END AS a FROM items JOIN docs USING (statement_id))
SELECT doc_type, {_SCORE} AS score, count(*) AS n FROM x GROUP BY 1, 2""",
    "f53_integrity": f"""WITH {oracle_with('items')} SELECT abs(round_even(unit_price * quantity, 0) - amount) > greatest(1, amount * 0.01::DOUBLE) AS off, abs(amount % 1000 - round_even(amount / 11, 0)) <= 10 AS vat,
  CASE WHEN amount IS NULL THEN 'error' WHEN least(seq, 20) <= 1 THEN 'ok' WHEN least(seq, 20) <= 10 THEN 'warning' ELSE 'error' END AS state, count(*) AS n FROM items GROUP BY 1, 2, 3""",
    "f63_lenient_numbers": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(floor(p_retailprice) AS BIGINT) WHEN 2 THEN CASE WHEN p_size > 0 THEN CAST(p_size AS BIGINT) END END AS amount,
  CASE p_partkey % 4 WHEN 0 THEN floor(p_retailprice) WHEN 2 THEN CAST(p_size AS DOUBLE) WHEN 3 THEN 0 END AS number FROM part""",
    "f62_recognised": f"WITH {oracle_with('items')} SELECT category_code, CAST(sum(CASE WHEN seq % 2 = 0 THEN least(amount, 30000) ELSE amount END) AS BIGINT) AS recognised, CAST(sum(CASE WHEN seq % 2 = 0 THEN coalesce(greatest(amount - 30000, 0), 0) ELSE 0 END) AS BIGINT) AS disputed FROM items GROUP BY category_code",
    "p6_statement_words": """WITH h AS (SELECT doc_id, list_transform(['the', 'of', 'and', 'de', 'la', 'der', 'in', 'to', 'que', 'und'], lambda w: CAST(contains(lower(coalesce(text, '')), w) AS INT)) AS h FROM documents)
SELECT doc_id, list_sum(h) >= 6 AS is_statement, list_sum(h[1:4]) >= 2 AS two_of_four FROM h""",
    "p7_skip_rows": "SELECT p_partkey, p_partkey % 5 = 0 AS skip FROM part",
    "p9_category_codes": "SELECT p_partkey, CASE WHEN p_partkey % 12 BETWEEN 1 AND 9 THEN 'CAT_0' || (p_partkey % 12) ELSE CAST(p_partkey % 12 AS VARCHAR) END AS code, CAST(p_partkey % 12 AS VARCHAR) AS digit FROM part",
    "p10_eligible_files": f"WITH {oracle_with('files')} SELECT file_id, evidence_type, replace(replace(file_name, 'folder/', ''), '.pdf', '') AS stem, regexp_replace(regexp_replace(replace(replace(file_name, 'folder/', ''), '.pdf', ''), '_[0-9a-f]{{8,}}$', ''), '[_ (]*[0-9]{{4}}[-.]?[0-9]{{2}}[-.]?[0-9]{{2}}\\)?$', '') AS source FROM files WHERE NOT deleted AND status_code IN ('draft', 'fail')",
    "f11_business_numbers": """WITH r AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 10, '1') AS d FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 1 THEN substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6, 5) END AS number, c_custkey % 3 <> 1 AS valid FROM r""",
    "f10_project_core": "SELECT c_custkey, c_name || CASE WHEN c_custkey % 4 = 2 THEN '' ELSE '' END AS core FROM customer",
    "f17_law_references": """WITH p AS (SELECT p_partkey, CAST(p_partkey % 30 AS VARCHAR) AS n, p_partkey % 2 = 0 AS e FROM part)
SELECT p_partkey, '산업안전보건법' AS law, '제' || n || '조' AS article, CASE WHEN e THEN '제1항' ELSE '' END AS clause, '산업안전보건법 제' || n || '조' || CASE WHEN e THEN '제1항' ELSE '' END || ';제' || n || '조' AS cited,
  '산업안전보건법 제' || n || '조' || CASE WHEN e THEN '제1항' ELSE '' END AS laws FROM p""",
    "f21_total_limits": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS i, p_size % 40 + 1 AS n FROM part) SELECT p_partkey, CASE i WHEN 0 THEN round(n / 100, 6) WHEN 1 THEN round(n / 50, 6) WHEN 2 THEN round(n / 100, 6) END AS limit_share FROM p""",
    "f22_cost_ratio": "SELECT p_partkey, round((p_size % 40 + 1) / 100, 6) AS ratio FROM part",
    "f4_text_sets": """WITH a AS (SELECT p_partkey, lower(p_name) AS x, lower(p_name || ' ' || p_type) AS y, p_type FROM part),
b AS (SELECT *, list_distinct(list_transform(range(1, length(replace(x, ' ', ''))), lambda i: substr(replace(x, ' ', ''), i, 2))) AS xb, list_distinct(list_transform(range(1, length(replace(y, ' ', ''))), lambda i: substr(replace(y, ' ', ''), i, 2))) AS yb,
  list_distinct(list_filter(string_split(x, ' '), lambda t: length(t) > 1)) AS xt, list_distinct(list_filter(string_split(y, ' '), lambda t: length(t) > 1)) AS yt FROM a)
SELECT p_partkey, round(len(list_intersect(xb, yb)) / len(list_distinct(list_concat(xb, yb))), 6) AS bigram, round(len(list_intersect(xt, yt)) / len(list_distinct(list_concat(xt, yt))), 6) AS token,
  CAST(len(list_filter(list_distinct(regexp_extract_all(lower(p_type), '[0-9a-z]{2,}')), lambda t: t <> 'economy')) AS INT) AS rule_tokens FROM b""",
    "f77_usage_tokens": """WITH e AS (SELECT event_id, event_id % 3 AS i, CAST(floor(value * 10) AS BIGINT) AS n FROM events)
SELECT event_id, CASE WHEN i < 2 THEN n ELSE 0 END AS tokens_input, CASE WHEN i = 0 THEN least(event_id % 90, n) ELSE 0 END AS tokens_cached, CAST(CASE i WHEN 0 THEN 5 WHEN 1 THEN 7 ELSE 0 END AS BIGINT) AS tokens_output, CASE i WHEN 0 THEN n + 5 WHEN 1 THEN greatest(1, n + 7) ELSE 0 END AS tokens_total FROM e""",
    "s12_merged_details": """SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN 'patched' ELSE event_type END AS type, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 AS VARCHAR) END AS new FROM events""",
    "u3_photo_codes": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'receipt,wearing_photo' ELSE 'receipt' END ELSE CASE WHEN p_partkey % 3 = 0 THEN 'receipt,tax_invoice,wearing_photo' ELSE 'receipt,tax_invoice' END END AS codes FROM part""",
    "f32_labels": """SELECT p_partkey, format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) || '원' AS money, sha256(p_name) AS hash, 'a ' || p_name AS question, substr(p_name || ' ' || p_type, 1, 12) AS evidence, lower(replace(p_brand, '#', '')) || ' ' || lower(p_type) AS match FROM part""",
}
