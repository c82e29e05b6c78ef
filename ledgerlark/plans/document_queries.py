"""Queries of layouts of raw items and documents, and of names of laws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import invoices, laws, layouts, merges, reviews
from ..sources.adapters import adapted, oracle_with, read
from ..sources.shared import stored


def p1_item_layouts(spark: SparkSession, sf: str) -> DataFrame:
    return layouts.items(adapted(spark, sf, "raw_items"))


def p11_document_layouts(spark: SparkSession, sf: str) -> DataFrame:
    out = layouts.documents(adapted(spark, sf, "raw_docs"))
    shown = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["name"], F.coalesce(x["count"].cast("int").cast("string"), F.lit("-")), F.coalesce(x["amount"].cast("string"), F.lit("-")))), ",")
    return out.select("statement_id", "doc_id", "doc_type", "infer_result", "vendor", "date", "total_amount", shown.alias("lines"), "is_valid", F.array_join("warnings", ",").alias("warnings"))


def f15_invoice_fields(spark: SparkSession, sf: str) -> DataFrame:
    return invoices.invoice_fields(adapted(spark, sf, "invoice_texts"))


def f18_rule_laws(spark: SparkSession, sf: str) -> DataFrame:
    return adapted(spark, sf, "law_texts").select("doc_id", F.array_join(laws.rule_laws(F.col("legal_basis"), F.col("body"), F.col("category_code")), " ; ").alias("laws"))


def o8_law_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapted(spark, sf, "law_texts")
    own = F.split("cited", ";")
    found = laws.prioritised(own, F.when(F.col("doc_id") % 2 == 0, 0.5), F.col("doc_id") % 3 == 0, F.col("body"), F.slice(own, 1, 2))
    return rows.select("doc_id", F.array_join(found, ";").alias("laws"))


def f33_reasons(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapted(spark, sf, "law_texts")
    return rows.select("doc_id", laws.item_reason(F.col("body"), laws.rule_laws(F.col("legal_basis"), F.lit(""), F.col("category_code"))).alias("reason"))


def _checked(spark: SparkSession, sf: str):
    """Items of statements with logs, and their classifications, judgements, logs and requirements."""
    checks, logs = adapted(spark, sf, "item_checks"), adapted(spark, sf, "item_logs")
    items = checks.join(logs.select("statement_id").distinct(), "statement_id", "left_semi")
    classified = checks.select(*_KEYS, F.col("class_status").alias("status"), F.col("class_reason").alias("reason"))
    judged = checks.filter("law_status IS NOT NULL").select(*_KEYS, F.col("law_status").alias("status"), F.col("law_reason").alias("reason"), F.array_compact(F.array("cited")).alias("citations"))
    needed = adapted(spark, sf, "requirements").withColumn("satisfied", F.col("seq") % 2 == 0)
    return items.select(*_KEYS), classified, judged, logs, needed


_KEYS = ["statement_id", "seq"]


def a10_item_reviews(spark: SparkSession, sf: str) -> DataFrame:
    items, classified, judged, logs, needed = _checked(spark, sf)
    return reviews.item_reviews(items, _KEYS, classified, judged, logs, needed)


def d9_issues(spark: SparkSession, sf: str) -> DataFrame:
    items, classified, judged, logs, needed = _checked(spark, sf)
    return reviews.issues(reviews.item_reviews(items, _KEYS, classified, judged, logs, needed), _KEYS, classified, judged, logs)


def _two_runs(rows: DataFrame, keys: list[str], rules: dict[str, str], order: list[str], run: str) -> DataFrame:
    """The changes of two runs that merge rows of run 1 and 2 into an empty table."""
    columns = [*keys, *rules]
    first = stored(merges.changes(rows.select(columns).limit(0), rows.filter(F.col(run) == 1), keys, rules, order, 1), "merge-1")
    second = merges.changes(merges.replayed(first, keys), rows.filter(F.col(run) == 2), keys, rules, order, 2)
    return first.unionByName(stored(second, "merge-2"))


def s9_agent_logs(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each agent of a statement, after two runs: the last result, the last known tokens, their sum, and the first log."""
    rows = adapted(spark, sf, "logs").select("statement_id", "agent", "updated_at", "log_id", "result_code", "status_code", F.col("tokens").alias("token_current"), F.col("tokens").alias("token_cumulative"), F.col("log_id").alias("first_log"), (2 - F.col("log_id") % 2).alias("run"))
    rules = {"result_code": "set", "status_code": "set", "token_current": "fill", "token_cumulative": "add", "first_log": "keep"}
    return merges.replayed(_two_runs(rows, ["statement_id", "agent"], rules, ["updated_at", "log_id"], "run"), ["statement_id", "agent"])


def s7_touched_statements(spark: SparkSession, sf: str) -> DataFrame:
    """A statement of a known project only touches the one that is there."""
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("statement_id"), F.col("o_orderdate").cast("date").cast("string").alias("touched"), (1 + F.col("o_orderkey") % 2).alias("run"))
    log = _two_runs(rows.withColumn("at", F.col("statement_id")), ["project_id"], {"statement_id": "keep", "touched": "set"}, ["at"], "run")
    return log.select("run", "project_id", "change", F.col("before.touched").alias("was"), F.col("after.touched").alias("touched"), F.col("after.statement_id").alias("statement_id"))


def r9_refresh_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log of a refresh of the corpus by a whole snapshot."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("body"))
    changed = docs.filter("id % 11 <> 0").withColumn("body", F.when(F.col("id") % 5 == 0, F.sha2(F.col("body").cast("binary"), 256)).otherwise(F.col("body")))
    log = merges.changes(docs.filter("id % 7 <> 0"), changed, ["id"], {"body": "set"}, ["body"], 7, snapshot=True)
    return log.select("run", "id", "change", F.col("before.body").alias("previous"), F.col("after.body").alias("new"))


QUERIES = {"f15_invoice_fields": f15_invoice_fields, "s9_agent_logs": s9_agent_logs, "s7_touched_statements": s7_touched_statements, "r9_refresh_log": r9_refresh_log, "a10_item_reviews": a10_item_reviews, "d9_issues": d9_issues, "p1_item_layouts": p1_item_layouts, "p11_document_layouts": p11_document_layouts, "f18_rule_laws": f18_rule_laws, "o8_law_order": o8_law_order, "f33_reasons": f33_reasons}

_TABLE = "(VALUES " + ", ".join(f"('{a}', '{full}')" for a, full in laws.FULL_NAMES.items()) + ") t(article, full_name)"
_FULL = """coalesce(map_extract(nm, trim({0}))[1], map_extract(nm, regexp_extract(trim({0}), '^(제[0-9]+조)', 1))[1] || substr(trim({0}), length(regexp_extract(trim({0}), '^(제[0-9]+조)', 1)) + 1), trim({0}))"""
_NAMED = laws.NAMED.replace("\\s", "[\\s]")
#: names holds the table of articles as a map; a fold over the bare articles adds what no law has yet.
_LAWS = f"""{oracle_with('law_texts')}, names AS (SELECT map(list(article), list(full_name)) AS nm FROM {_TABLE}),
a AS (SELECT doc_id, category_code, body, nm, CASE WHEN trim(coalesce(legal_basis, '')) <> '' THEN [array_to_string(list_transform(string_split(trim(legal_basis), '|'), lambda p: {_FULL.format('p')}), ' | ')] ELSE [] END AS basis,
  list_transform(list_zip(regexp_extract_all(body, '{_NAMED}', 1), regexp_extract_all(body, '{_NAMED}', 2)), lambda z: trim(z[1]) || ' ' || z[2]) AS named, regexp_extract_all(body, '{laws.ARTICLE}') AS bare FROM law_texts, names),
b AS (SELECT *, list_filter(list_concat(basis, named), lambda x, i: list_position(list_concat(basis, named), x) = i) AS start FROM a),
c AS (SELECT *, list_reduce(list_concat([start], list_transform(bare, lambda x: [x])), lambda acc, x: CASE WHEN list_contains(acc, {_FULL.format('x[1]')}) OR len(list_filter(acc, lambda l: contains(l, x[1]))) > 0 THEN acc ELSE list_append(acc, {_FULL.format('x[1]')}) END) AS found FROM b)"""

_REVIEWS = f"""{oracle_with('item_checks', 'item_logs', 'requirements')}, x AS (SELECT * FROM item_checks WHERE statement_id IN (SELECT statement_id FROM item_logs)),
lg AS (SELECT *, CASE lower(trim(result_code)) WHEN 'fail' THEN 2 WHEN 'hil' THEN 1 WHEN 'warning' THEN 1 END AS lv, coalesce(nullif(details->>'$.summary', ''), nullif(details->>'$.reason', '')) AS said FROM item_logs),
lf AS (SELECT statement_id, seq, max(lv) AS lv, first(said ORDER BY created_at, log_id) FILTER (WHERE lv > 0 AND said IS NOT NULL) AS said FROM lg GROUP BY ALL),
mi AS (SELECT statement_id, seq, string_agg(DISTINCT evidence_type, ', ' ORDER BY evidence_type) AS gone FROM requirements WHERE seq % 2 <> 0 GROUP BY ALL),
rv AS (SELECT x.*, lf.said, gone, greatest(CASE WHEN class_status = '검토필요' THEN 1 ELSE 0 END, CASE law_status WHEN 'fail' THEN 2 WHEN 'conditional' THEN 1 WHEN 'odd word' THEN 1 ELSE 0 END, coalesce(lf.lv, 0)) AS w0,
  CASE WHEN class_status = '카테고리변경' THEN coalesce(nullif(class_reason, ''), '{reviews.CHANGED_REASON}') END AS moved, CASE WHEN law_status IS NOT NULL THEN law_reason END AS law FROM x LEFT JOIN lf USING (statement_id, seq) LEFT JOIN mi USING (statement_id, seq)),
rw AS (SELECT *, CASE WHEN gone IS NOT NULL AND w0 < 2 THEN 1 ELSE w0 END AS w, CASE WHEN gone IS NOT NULL AND w0 < 2 THEN '{reviews.MISSING_REASON}' || gone END AS lack FROM rv),
fr AS (SELECT statement_id, seq, ['appropriate', 'needs_review', 'inappropriate'][w + 1] AS decision, ['low', 'medium', 'high'][w + 1] AS risk_level,
  coalesce(CASE WHEN w > 0 THEN coalesce(CASE WHEN law_status <> 'ok' THEN law END, said, lack) END, moved, law, said, '{reviews.NOTHING_REASON}') AS summary_reason FROM rw)"""

_PLAIN = r"'(?s)^.*?([0-9]{4})[.\-/년] *([0-9]{1,2})[.\-/월] *([0-9]{1,2}).*$'"


def _labelled(label: str) -> str:
    found = f"nullif(regexp_extract(t, '{label}[\\s]*[：:\\s][\\s]*([0-9]{{4}}[.\\-/년][\\s]*[0-9]{{1,2}}[.\\-/월][\\s]*[0-9]{{1,2}}일?)', 1), '')"
    return f"try_cast(regexp_replace({found}, {_PLAIN}, '\\1-\\2-\\3') AS DATE)"


def _number(labels: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(try_cast(replace(regexp_extract(t, '{x}[\\s]*[：:\\s]?[\\s]*([0-9,]+)', 1), ',', '') AS BIGINT), 0)" for x in labels) + ")"


def _party(labels: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{x}.{{0,30}}상호[\\s]*[：:\\s][\\s]*([^\\s,;|]+(?:[\\s][^\\s,;|]+){{0,3}})', 1), '')" for x in labels) + ")"


def _below(labels: list[str]) -> str:
    return "coalesce(" + ", ".join(f"ls[list_filter(range(1, len(ls)), lambda i: contains(ls[i], '{x}') AND NOT regexp_matches(ls[i + 1], '^[0-9]'))[1] + 1]" for x in labels) + ")"


ORACLES = {
    "f15_invoice_fields": f"""WITH {oracle_with('invoice_texts')}, l AS (SELECT statement_id, invoice_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM invoice_texts), j AS (SELECT *, array_to_string(ls, ' ') AS t FROM l),
n AS (SELECT *, list_transform(regexp_extract_all(t, '\\b[0-9]{{3}}[-\\s]?[0-9]{{2}}[-\\s]?[0-9]{{5}}\\b'), lambda x: regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^(...)(..)(.....)$', '\\1-\\2-\\3')) AS nums FROM j),
m AS (SELECT *, {_number(invoices.AMOUNT_LABELS['supply'])} AS supply_amount, {_number(invoices.AMOUNT_LABELS['tax'])} AS tax_amount, {_number(invoices.AMOUNT_LABELS['total'])} AS total FROM n)
SELECT statement_id, invoice_id, substr(coalesce({_party(invoices.SUPPLIER_LABELS)}, {_below(invoices.SUPPLIER_LABELS)}), 1, 30) AS supplier, nums[1] AS supplier_number, nullif(regexp_extract(t, '대표자?[\\s]*[：:\\s][\\s]*([가-힣]{{2,5}}(?:[\\s][가-힣]{{1,5}})?)', 1), '') AS representative,
  {_party(invoices.BUYER_LABELS)} AS buyer, nums[2] AS buyer_number, coalesce({", ".join(_labelled(x) for x in invoices.DATE_LABELS)}, try_cast(regexp_replace(nullif(regexp_extract(t, '([0-9]{{4}}[.\\-/][0-9]{{2}}[.\\-/][0-9]{{2}})', 1), ''), '[./]', '-', 'g') AS DATE)) AS issue_date,
  supply_amount, tax_amount, coalesce(total, supply_amount + tax_amount) AS total_amount FROM m""",
    "s9_agent_logs": f"""WITH {oracle_with('logs')}, o AS (SELECT *, row_number() OVER (PARTITION BY statement_id, agent ORDER BY 2 - log_id % 2, updated_at, log_id) AS k FROM logs)
SELECT statement_id, agent, arg_max(result_code, k) AS result_code, arg_max(status_code, k) AS status_code, arg_max(tokens, k) FILTER (WHERE tokens IS NOT NULL) AS token_current, CAST(sum(tokens) AS BIGINT) AS token_cumulative, arg_min(log_id, k) AS first_log FROM o GROUP BY statement_id, agent""",
    "s7_touched_statements": """WITH r AS (SELECT o_custkey AS project_id, o_orderkey AS statement_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS touched, 1 + o_orderkey % 2 AS run FROM orders),
g AS (SELECT project_id, run, arg_min(statement_id, statement_id) AS first, arg_max(touched, statement_id) AS touched FROM r GROUP BY ALL),
h AS (SELECT b.run, b.project_id, CASE WHEN a.run IS NULL THEN 'inserted' ELSE 'updated' END AS change, a.touched AS was, b.touched, coalesce(a.first, b.first) AS statement_id FROM g b LEFT JOIN g a ON a.project_id = b.project_id AND a.run = 1 AND b.run = 2)
SELECT CAST(run AS BIGINT) AS run, project_id, change, was, touched, statement_id FROM h WHERE was IS NULL OR was <> touched""",
    "r9_refresh_log": """WITH d AS (SELECT doc_id AS id, sha256(text) AS h FROM documents), a AS (SELECT * FROM d WHERE id % 7 <> 0), b AS (SELECT id, CASE WHEN id % 5 = 0 THEN sha256(h) ELSE h END AS h FROM d WHERE id % 11 <> 0)
SELECT 7::BIGINT AS run, id, CASE WHEN a.h IS NULL THEN 'inserted' WHEN b.h IS NULL THEN 'deleted' ELSE 'updated' END AS change, a.h AS previous, b.h AS new FROM a FULL JOIN b USING (id) WHERE a.h IS DISTINCT FROM b.h""",
    "a10_item_reviews": f"WITH {_REVIEWS} SELECT statement_id, seq, decision, risk_level, summary_reason FROM fr",
    "d9_issues": f"""WITH {_REVIEWS}, dl AS (SELECT *, coalesce(nullif(details->>'$.legal_basis', ''), nullif(details->>'$.basis', '')) AS basis, details->>'$.action' AS action, coalesce(nullif(details->>'$.problem', ''), nullif(details->>'$.reason', '')) AS problem, details->>'$.sources[0]."조항"' AS src FROM item_logs),
dg AS (SELECT statement_id, seq, first(basis ORDER BY created_at, log_id) FILTER (WHERE basis IS NOT NULL) AS basis, first(action ORDER BY created_at, log_id) FILTER (WHERE action IS NOT NULL) AS action, first(problem ORDER BY created_at, log_id) FILTER (WHERE problem IS NOT NULL) AS problem,
  list(src ORDER BY created_at, log_id) FILTER (WHERE src IS NOT NULL) AS srcs FROM dl GROUP BY ALL)
SELECT fr.statement_id, fr.seq, decision AS issue_type, coalesce(nullif(law, ''), nullif(class_reason, ''), problem, summary_reason) AS problem,
  coalesce(CASE WHEN law_status IS NOT NULL THEN cited END, nullif(array_to_string(list_filter(srcs, lambda s, i: list_position(srcs, s) = i), ', '), ''), basis, '{reviews.NO_BASIS}') AS legal_basis, action AS required_action
FROM fr JOIN rw USING (statement_id, seq) LEFT JOIN dg USING (statement_id, seq) WHERE decision <> 'appropriate'""",
    "p1_item_layouts": f"""WITH {oracle_with('raw_items')}, j AS (SELECT statement_id, seq, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM raw_items),
k AS (SELECT *, CASE WHEN j IS NULL THEN NULL WHEN json_exists(j, '$.used_on') THEN 'v3' WHEN json_exists(j, '$.date') OR json_exists(j, '$.amount') OR json_exists(j, '$.description') THEN 'plain' ELSE 'korean' END AS layout FROM j)
SELECT statement_id, seq, layout, CASE WHEN layout IS NOT NULL THEN coalesce(CASE layout WHEN 'v3' THEN j->>'$.used_on' WHEN 'plain' THEN j->>'$.date' ELSE j->>'$."사용일자"' END, '') END AS used_on,
  CAST(CASE layout WHEN 'v3' THEN j->>'$.total_amount' WHEN 'plain' THEN j->>'$.amount' ELSE j->>'$."금액"' END AS DOUBLE) AS amount,
  CASE WHEN layout IS NOT NULL THEN coalesce(CASE layout WHEN 'v3' THEN j->>'$.item_name' WHEN 'plain' THEN coalesce(j->>'$.name', j->>'$.description') ELSE j->>'$."사용내역"' END, '') END AS name,
  CASE WHEN layout IS NOT NULL THEN coalesce(CASE layout WHEN 'v3' THEN j->>'$.category_code' WHEN 'plain' THEN j->>'$.category' ELSE j->>'$."항목명"' END, '') END AS category,
  CASE WHEN layout IS NOT NULL THEN coalesce(CASE layout WHEN 'v3' THEN trim(regexp_extract(j->>'$.remark', '^[^:]*: ([^|]*)', 1)) WHEN 'plain' THEN j->>'$.vendor' ELSE coalesce(nullif(j->>'$."추가정보"."업체명"', ''), j->>'$."추가정보"."교육주관"') END, '') END AS vendor FROM k""",
    "p11_document_layouts": f"""WITH {oracle_with('raw_docs')}, j AS (SELECT statement_id, doc_id, CASE WHEN kind IN ('wage_statement', 'receipt') THEN kind ELSE 'delivery_statement' END AS doc_type, CAST(raw AS JSON) AS j FROM raw_docs),
l AS (SELECT statement_id, doc_id, doc_type, unnest(range(CAST(json_array_length(j, '$.items') AS BIGINT))) AS pos, j FROM j),
m AS (SELECT statement_id, doc_id, pos, json_extract(j, '$.items[' || pos || ']') AS x, doc_type FROM l),
n AS (SELECT statement_id, doc_id, string_agg(CASE doc_type WHEN 'receipt' THEN coalesce(x->>'$.name', '') ELSE coalesce(nullif(x->>'$.item_name', ''), x->>'$.name', '') END || ':' ||
  coalesce(CASE doc_type WHEN 'wage_statement' THEN NULL WHEN 'receipt' THEN x->>'$.count' ELSE coalesce(nullif(x->>'$.count', '0'), x->>'$.quantity') END, '-') || ':' ||
  coalesce(CASE doc_type WHEN 'delivery_statement' THEN CAST(coalesce(CAST(x->>'$.supply_amount' AS BIGINT) + CAST(x->>'$.tax_amount' AS BIGINT), CAST(x->>'$.supply_amount' AS BIGINT)) AS VARCHAR) ELSE x->>'$.amount' END, '-'), ',' ORDER BY pos) AS lines FROM m GROUP BY statement_id, doc_id)
SELECT statement_id, doc_id, doc_type, CASE WHEN doc_type = 'receipt' THEN CASE WHEN json_exists(j, '$.infer_result') THEN j->>'$.infer_result' ELSE 'ERROR' END
    ELSE coalesce(nullif(j->>'$.infer_result', ''), CASE WHEN j->>'$.validation.is_valid' = 'true' OR j->>'$.validation.has_required_fields' = 'true' THEN 'SUCCESS' ELSE 'PARTIAL' END) END AS infer_result,
  CASE doc_type WHEN 'wage_statement' THEN j->>'$.vendor' WHEN 'receipt' THEN j->>'$.store.name' ELSE coalesce(nullif(j->>'$.supplier.company_name', ''), j->>'$.store.name') END AS vendor,
  CASE doc_type WHEN 'wage_statement' THEN j->>'$.date' WHEN 'receipt' THEN j->>'$.payment.date' ELSE coalesce(nullif(j->>'$.issue_date', ''), j->>'$.payment.date') END AS date,
  CAST(j->>'$.total_amount' AS BIGINT) AS total_amount, coalesce(lines, '') AS lines, coalesce(CASE doc_type WHEN 'receipt' THEN j->>'$.validation.has_required_fields' ELSE j->>'$.validation.is_valid' END = 'true', false) AS is_valid,
  array_to_string(list_concat(coalesce(CAST(j->'$.validation.warnings' AS VARCHAR[]), []), CASE WHEN doc_type = 'receipt' THEN coalesce(CAST(j->'$.validation.errors' AS VARCHAR[]), []) ELSE [] END), ',') AS warnings FROM j LEFT JOIN n USING (statement_id, doc_id)""",
    "f18_rule_laws": f"""WITH {_LAWS} SELECT doc_id, array_to_string(CASE WHEN regexp_matches(category_code, '^CAT_0[1-9]$') AND NOT list_contains(found, '{laws.NOTICE} 제7조제1항제' || substr(category_code, 6) || '호')
  THEN list_append(found, '{laws.NOTICE} 제7조제1항제' || substr(category_code, 6) || '호') ELSE found END, ' ; ') AS laws FROM c""",
    "o8_law_order": f"""WITH {oracle_with('law_texts')}, x AS (SELECT *, string_split(cited, ';') AS own FROM law_texts), y AS (SELECT doc_id, body, own, unnest(own) AS law, generate_subscripts(own, 1) AS pos FROM x),
z AS (SELECT doc_id, law, min(pos) AS pos, any_value(CASE WHEN doc_id % 2 = 0 AND (contains(law, '별표 3') OR contains(law, '공사진척')) THEN 0 WHEN doc_id % 3 = 0 AND starts_with(law, '제4조') THEN 1 WHEN doc_id % 3 = 0 AND contains(body, law) THEN 2
  WHEN list_contains(own[1:2], law) AND contains(law, '제') AND (contains(law, '항') OR contains(law, '호')) THEN 3 WHEN contains(body, law) THEN 4 WHEN starts_with(law, '제2조') THEN 5 WHEN starts_with(law, '제62조') THEN 6 WHEN starts_with(law, '별표') THEN 7 ELSE 8 END) AS place
  FROM y WHERE law <> '' GROUP BY doc_id, law)
SELECT doc_id, string_agg(law, ';' ORDER BY place, pos) AS laws FROM z GROUP BY doc_id""",
}
