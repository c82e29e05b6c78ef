"""Queries of logs, upserts, costs, reports and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records, report
from ..sources.adapters import adapted, oracle_with, read

_LAST = "row_number() OVER (PARTITION BY statement_id, agent ORDER BY updated_at DESC, log_id DESC) = 1"


def w1_latest_log(spark: SparkSession, sf: str) -> DataFrame:
    logs = adapted(spark, sf, "logs").select("statement_id", "agent", "updated_at", "log_id", "result_code", "tokens")
    return records.latest(logs, ["statement_id", "agent"], ["updated_at", "log_id"]).drop("updated_at")


def w9_running_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return records.running_tokens(adapted(spark, sf, "logs")).select("log_id", "token_current", "token_cumulative")


def a12_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return records.dashboard(adapted(spark, sf, "logs"))


def a14_readiness(spark: SparkSession, sf: str) -> DataFrame:
    return records.readiness(adapted(spark, sf, "logs"), adapted(spark, sf, "files"))


def a16_cost(spark: SparkSession, sf: str) -> DataFrame:
    logs = adapted(spark, sf, "logs").filter("tokens IS NOT NULL")
    prices = records.prices(logs.select("model").distinct())
    # A row for each distinct model name.
    priced = logs.join(prices, "model").select("agent", "model", records.cost(F.col("tokens"), F.col("tokens") % 7, F.col("log_id") % 50).alias("cost"))
    return priced.groupBy("agent", "model").agg(F.count(F.lit(1)).alias("runs"), F.sum("cost").cast("double").alias("cost_usd"))


def a17_counters(spark: SparkSession, sf: str) -> DataFrame:
    return adapted(spark, sf, "logs").groupBy("agent", "result_code").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("result_code") == "hil").alias("review_items"))


def a18_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return records.histogram(adapted(spark, sf, "logs"), ["agent"], "seconds", records.DURATION_BUCKETS)


def a18_p95(spark: SparkSession, sf: str) -> DataFrame:
    return adapted(spark, sf, "logs").groupBy("agent").agg(F.round(F.percentile("seconds", 0.95), 6).alias("p95"))


def s7_upsert(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("version"))
    current, incoming = orders.filter("id % 3 <> 0"), orders.filter("id % 2 = 0").withColumn("state", F.lit("new"))
    updated = records.upserted(current, incoming, ["id"]).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).withColumn("policy", F.lit("update"))
    kept = records.upserted(current, incoming, ["id"], "nothing").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).withColumn("policy", F.lit("nothing"))
    return updated.unionByName(kept)


def s13_replace_set(spark: SparkSession, sf: str) -> DataFrame:
    need = adapted(spark, sf, "requirements").withColumn("is_active", F.lit(True))
    new = need.filter("statement_id % 4 = 0").drop("is_active").withColumn("evidence_type", F.lit("wage_statement"))
    return records.replaced_set(need, new.distinct(), "statement_id").groupBy("evidence_type", "is_active").agg(F.count(F.lit(1)).alias("n"))


def s14_statuses(spark: SparkSession, sf: str) -> DataFrame:
    files = adapted(spark, sf, "files")
    changes = files.filter("item_seq = 1").select("file_id", F.lit("fail").alias("new_status"))
    return records.set_statuses(files, changes).select("file_id", "status_code", "deleted")


def j15_snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    changed = F.when(F.col("id") % 5 == 0, F.sha2(F.col("hash").cast("binary"), 256)).otherwise(F.col("hash"))
    return records.snapshot_diff(docs.filter("id % 7 <> 0"), docs.filter("id % 11 <> 0").withColumn("hash", changed))


def w2_revisions(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("statement_id"), F.col("o_custkey").alias("project_id"), F.trunc("o_orderdate", "MM").alias("month"))
    old = orders.filter("statement_id % 2 = 0").groupBy("project_id", "month").agg(F.count(F.lit(1)).cast("int").alias("revision_no"))
    return records.next_revisions(orders.filter("statement_id % 2 = 1"), old).select("statement_id", F.col("revision_no").cast("int").alias("revision_no"))


def j8_missing_evidence(spark: SparkSession, sf: str) -> DataFrame:
    links = adapted(spark, sf, "files").filter("NOT deleted").select("statement_id", F.col("item_seq").alias("seq"), "evidence_type")
    return report.evidence_check(report.missing_evidence(adapted(spark, sf, "requirements"), links))


def a9_evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    files = adapted(spark, sf, "files").filter("NOT deleted")
    links = files.select("statement_id", F.col("item_seq").alias("seq"), "evidence_type")
    missing = report.missing_evidence(adapted(spark, sf, "requirements"), links).filter("NOT is_satisfied")
    return report.evidence_summary(files, missing, files.filter("status_code = 'fail'"))


def a5_category_metrics(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("statement_id"), F.floor("o_totalprice").cast("double").alias("budget"), (F.col("o_orderkey") % 101).cast("double").alias("progress"))
    caps = adapted(spark, sf, "rules").filter("limit_pct IS NOT NULL AND category_code IS NOT NULL").groupBy("category_code").agg(F.max("limit_pct").cast("double").alias("limit_pct"))
    # Progress bands of the law: none below 50 %, half to 70, seven tenths to 90, then nine tenths.
    bands = spark.createDataFrame([(50.0, 70.0, 0.5), (70.0, 90.0, 0.7), (90.0, None, 0.9)], "min_rate double, max_rate double, required double")
    out = report.category_metrics(adapted(spark, sf, "items"), orders, caps, bands)
    return out.select("statement_id", "category_code", "total", "exceeded", "cumulative", "status")


def a7_budget(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("statement_id"), F.floor("o_totalprice").cast("long").alias("budget"))
    return report.budget_summary(adapted(spark, sf, "items"), orders)


def a10_worst_decision(spark: SparkSession, sf: str) -> DataFrame:
    return records.worst_of(adapted(spark, sf, "logs").withColumnRenamed("result_code", "decision").select("statement_id", records.nested.decision(F.col("decision")).alias("decision")), ["statement_id"], "decision")


def a8_category_notes(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("amount").isNull(), "inappropriate").when(F.col("used_on").isNull(), "needs_review").otherwise("appropriate")
    return report.category_notes(adapted(spark, sf, "items").withColumn("decision", state))


def a19_photo_reviews(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events")
    kinds = ["click", "view", "error"]
    seen = events.select((F.col("user_id") % 400).alias("file_id"), F.col("event_type").alias("equipment"), (F.col("value") > 10).alias("is_wearing"), (F.col("event_id") % 6 == 0).alias("needs_review"), F.round("value", 2).alias("confidence"))
    return report.photo_reviews(seen.filter(F.col("equipment").isin(*kinds)), kinds)


def a27_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("expected"), F.col("toxic").alias("given"))
    return report.evaluation(labels, docs.filter("doc_id % 13 <> 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") > 600).cast("int").alias("actual")))


def a28_confusion(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") > 600).cast("int").alias("actual"))
    return report.confusion(read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("expected")), docs, [0, 1])


def w8_chat_history(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    last = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("size"))))), 1, 6)
    out = turns.groupBy("conv_id").agg(F.reverse(last).alias("m"))
    return out.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["size"].cast("string"))), " ").alias("history"))


def o7_evidence_order(spark: SparkSession, sf: str) -> DataFrame:
    types = adapted(spark, sf, "files").groupBy("evidence_type").agg(F.count(F.lit(1)).alias("n"))
    return types.select("evidence_type", "n", report.evidence_order(F.col("evidence_type")).alias("place")).orderBy("place", "evidence_type")


def f72_action_rows(spark: SparkSession, sf: str) -> DataFrame:
    row = F.array(F.create_map(F.lit("item_id"), F.col("user_id").cast("string"), F.lit("status"), F.lit("hil")), F.create_map(F.lit("id"), F.lit("x"), F.lit("status"), F.lit("OK")))
    details = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.struct(row.alias("results")).alias("payload")))).otherwise(F.to_json(F.struct(row.alias("items"))))
    return records.action_rows(read(spark, sf, "events").select(F.col("event_id").alias("log_id"), details.alias("details")))


QUERIES = {
    "w1_latest_log": w1_latest_log, "w9_running_tokens": w9_running_tokens, "a12_dashboard": a12_dashboard, "a14_readiness": a14_readiness, "a16_model_cost": a16_cost,
    "a17_run_counters": a17_counters, "a18_duration_histogram": a18_histogram, "a18_p95_duration": a18_p95, "s7_keyed_upsert": s7_upsert, "s13_replace_set": s13_replace_set,
    "s14_file_statuses": s14_statuses, "j15_snapshot_diff": j15_snapshot_diff, "w2_next_revision": w2_revisions, "j8_missing_evidence": j8_missing_evidence, "a9_evidence_summary": a9_evidence_summary,
    "a5_category_metrics": a5_category_metrics, "a7_budget_summary": a7_budget, "a10_worst_decision": a10_worst_decision, "a8_category_notes": a8_category_notes, "a19_photo_reviews": a19_photo_reviews,
    "a27_evaluation": a27_evaluation, "a28_confusion": a28_confusion, "w8_chat_history": w8_chat_history, "o7_evidence_order": o7_evidence_order, "f72_action_rows": f72_action_rows,
}

_LINKS = "l AS (SELECT DISTINCT statement_id, item_seq AS seq, evidence_type FROM files WHERE NOT deleted), m AS (SELECT r.*, l.seq IS NOT NULL AS is_satisfied FROM requirements r LEFT JOIN l ON l.statement_id = r.statement_id AND l.seq = r.seq AND l.evidence_type = r.evidence_type)"

ORACLES = {
    "w1_latest_log": f"WITH {oracle_with('logs')} SELECT statement_id, agent, log_id, result_code, tokens FROM logs QUALIFY {_LAST}",
    "w9_running_tokens": f"""WITH {oracle_with('logs')} SELECT log_id, last_value(tokens IGNORE NULLS) OVER w AS token_current, CAST(coalesce(sum(tokens) OVER w, 0) AS BIGINT) AS token_cumulative FROM logs
WINDOW w AS (PARTITION BY statement_id, agent ORDER BY updated_at, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "a12_dashboard": f"""WITH {oracle_with('logs')}, x AS (SELECT * FROM logs QUALIFY {_LAST})
SELECT statement_id, count(*) AS agents, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count_if(status_code = 'in_progress') AS in_progress, count_if(result_code = 'success') AS success, count_if(result_code = 'hil') AS hil, count_if(result_code = 'fail') AS fail,
  coalesce(string_agg(DISTINCT CASE WHEN result_code = 'hil' THEN agent END, ',' ORDER BY CASE WHEN result_code = 'hil' THEN agent END), '') AS hil_agents, max(CASE result_code WHEN 'fail' THEN 2 WHEN 'hil' THEN 1 ELSE 0 END) AS worst FROM x GROUP BY statement_id""",
    "a14_readiness": f"""WITH {oracle_with('logs', 'files')}, x AS (SELECT * FROM logs QUALIFY {_LAST}),
h AS (SELECT statement_id, count(*) AS files, bool_or(evidence_type IN ('receipt', 'tax_invoice')) AS has_receipt, bool_or(evidence_type = 'site_photo') AS has_photo FROM files WHERE NOT deleted GROUP BY statement_id),
d AS (SELECT statement_id, bool_or(agent = 'agent_0' AND result_code = 'success') AS classified, bool_and(result_code = 'success') AS all_done FROM x GROUP BY statement_id)
SELECT *, concat_ws(',', CASE WHEN has_receipt THEN 'link' END, CASE WHEN has_photo THEN 'vision' END, CASE WHEN NOT classified THEN 'classify' END) AS to_run FROM h JOIN d USING (statement_id)""",
    "a16_model_cost": f"""WITH {oracle_with('logs')}, c AS (SELECT agent, model, tokens, tokens % 7 AS cached, log_id % 50 AS out,
  CASE model WHEN 'gpt-4o-mini-2024' THEN 0.15 WHEN 'gpt-4o' THEN 2.5 WHEN 'gpt-5-mini' THEN 0.25 ELSE 0.4 END::DECIMAL(10, 4) AS a, CASE model WHEN 'gpt-4o-mini-2024' THEN 0.075 WHEN 'gpt-4o' THEN 1.25 WHEN 'gpt-5-mini' THEN 0.025 ELSE 0.1 END::DECIMAL(10, 4) AS b,
  CASE model WHEN 'gpt-4o-mini-2024' THEN 0.6 WHEN 'gpt-4o' THEN 10 WHEN 'gpt-5-mini' THEN 2 ELSE 1.6 END::DECIMAL(10, 4) AS c FROM logs WHERE tokens IS NOT NULL)
SELECT agent, model, count(*) AS runs, CAST(sum((floor((((tokens - cached) * a + cached * b + out * c) * 10000)::BIGINT / 100 + 0.5))::BIGINT)::DECIMAL(28, 8) / 100000000 AS DOUBLE) AS cost_usd FROM c GROUP BY agent, model""",
    "a17_run_counters": f"WITH {oracle_with('logs')} SELECT agent, result_code, count(*) AS runs, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count_if(result_code = 'hil') AS review_items FROM logs GROUP BY agent, result_code",
    "a18_duration_histogram": f"""WITH {oracle_with('logs')}, b AS (SELECT unnest([0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]::DOUBLE[]) AS le)
SELECT agent, le, count_if(seconds <= le) AS n FROM logs, b GROUP BY agent, le""",
    "a18_p95_duration": f"WITH {oracle_with('logs')} SELECT agent, round(quantile_cont(seconds, 0.95), 6) AS p95 FROM logs GROUP BY agent",
    "s7_keyed_upsert": """WITH c AS (SELECT o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_orderkey % 3 <> 0), i AS (SELECT o_orderkey AS id, 'new' AS state FROM orders WHERE o_orderkey % 2 = 0),
u AS (SELECT 'update' AS policy, * FROM i UNION ALL SELECT 'update', * FROM c WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT 'nothing', * FROM c UNION ALL SELECT 'nothing', * FROM i WHERE id NOT IN (SELECT id FROM c))
SELECT policy, state, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM u GROUP BY policy, state""",
    "s13_replace_set": f"""WITH {oracle_with('requirements')}, u AS (SELECT evidence_type, statement_id % 4 <> 0 AS is_active FROM requirements UNION ALL
SELECT 'wage_statement', true FROM (SELECT DISTINCT statement_id, seq FROM requirements WHERE statement_id % 4 = 0)) SELECT evidence_type, is_active, count(*) AS n FROM u GROUP BY evidence_type, is_active""",
    "s14_file_statuses": f"WITH {oracle_with('files')} SELECT file_id, CASE WHEN NOT deleted AND item_seq = 1 THEN 'fail' ELSE status_code END AS status_code, deleted FROM files",
    "j15_snapshot_diff": """WITH d AS (SELECT doc_id AS id, sha256(text) AS hash FROM documents), a AS (SELECT * FROM d WHERE id % 7 <> 0), b AS (SELECT id, CASE WHEN id % 5 = 0 THEN sha256(hash) ELSE hash END AS hash FROM d WHERE id % 11 <> 0)
SELECT coalesce(a.id, b.id) AS id, a.hash AS previous_hash, b.hash AS new_hash, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'deleted' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'updated' END AS change FROM a FULL JOIN b ON a.id = b.id""",
    "w2_next_revision": """WITH o AS (SELECT o_orderkey AS id, o_custkey AS p, date_trunc('month', o_orderdate) AS m FROM orders), t AS (SELECT p, m, count(*) AS top FROM o WHERE id % 2 = 0 GROUP BY p, m)
SELECT id AS statement_id, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY o.p, o.m ORDER BY id) AS INT) AS revision_no FROM o LEFT JOIN t ON t.p = o.p AND t.m = o.m WHERE id % 2 = 1""",
    "j8_missing_evidence": f"WITH {oracle_with('files', 'requirements')}, {_LINKS} SELECT statement_id, seq, coalesce(string_agg(evidence_type, ',' ORDER BY evidence_type) FILTER (WHERE NOT is_satisfied), '') AS missing, CASE WHEN bool_and(is_satisfied) THEN 'OK' ELSE 'MISSING' END AS status FROM m GROUP BY statement_id, seq",
    "a9_evidence_summary": f"""WITH {oracle_with('files', 'requirements')}, {_LINKS}, u AS (SELECT evidence_type, 1 AS s, CAST(status_code = 'fail' AS INT) AS e, 0 AS g FROM files WHERE NOT deleted UNION ALL SELECT evidence_type, 0, 0, 1 FROM m WHERE NOT is_satisfied UNION ALL SELECT 'usage_statement', 0, 0, 0)
SELECT evidence_type, CAST(sum(s) AS BIGINT) AS submitted_count, CAST(sum(e) AS BIGINT) AS error_count, CAST(sum(g) AS BIGINT) AS missing_count, CAST(greatest(sum(s) - sum(e), 0) AS BIGINT) AS passed_count,
  CASE evidence_type WHEN 'usage_statement' THEN 0 WHEN 'receipt' THEN 1 WHEN 'site_photo' THEN 2 WHEN 'tax_invoice' THEN 3 WHEN 'other' THEN 4 ELSE 99 END AS show_order FROM u GROUP BY evidence_type""",
    "a5_category_metrics": f"""WITH {oracle_with('items', 'rules')}, caps AS (SELECT category_code, CAST(max(limit_pct) AS DOUBLE) AS limit_pct FROM rules WHERE limit_pct IS NOT NULL AND category_code IS NOT NULL GROUP BY category_code),
t AS (SELECT statement_id, category_code, coalesce(sum(amount), 0) AS total FROM items GROUP BY statement_id, category_code),
c AS (SELECT t.*, sum(total) OVER (PARTITION BY statement_id) AS cumulative, CAST(floor(o_totalprice) AS DOUBLE) AS budget, o_orderkey % 101 AS progress FROM t JOIN orders ON statement_id = o_orderkey),
x AS (SELECT c.*, coalesce(total > budget * limit_pct, false) AS exceeded, CASE WHEN progress >= 90 THEN 0.9::DOUBLE WHEN progress >= 70 THEN 0.7::DOUBLE WHEN progress >= 50 THEN 0.5::DOUBLE END AS required FROM c LEFT JOIN caps USING (category_code))
SELECT statement_id, category_code, CAST(total AS BIGINT) AS total, exceeded, CAST(cumulative AS BIGINT) AS cumulative, CASE WHEN exceeded THEN 'cap_exceeded' WHEN coalesce(budget * required - cumulative > 0, false) THEN 'progress_short' ELSE 'ok' END AS status FROM x""",
    "a7_budget_summary": f"""WITH {oracle_with('items')}, u AS (SELECT statement_id, coalesce(sum(amount), 0) AS used FROM items GROUP BY statement_id), b AS (SELECT o_orderkey AS statement_id, CAST(floor(o_totalprice) AS BIGINT) AS budget FROM orders)
SELECT statement_id, CAST(used AS BIGINT) AS used, CAST(budget - used AS BIGINT) AS remaining, CASE WHEN budget > 0 THEN CAST((used * 2000 + budget) // (budget * 2) AS DOUBLE) / 10 END AS ratio FROM b JOIN u USING (statement_id)""",
    "a10_worst_decision": f"""WITH {oracle_with('logs')}, x AS (SELECT statement_id, max(CASE result_code WHEN 'fail' THEN 2 WHEN 'hil' THEN 1 ELSE 0 END) AS w FROM logs GROUP BY statement_id)
SELECT statement_id, CASE w WHEN 2 THEN 'inappropriate' WHEN 1 THEN 'needs_review' ELSE 'appropriate' END AS decision, CASE w WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level FROM x""",
    "a8_category_notes": f"""WITH {oracle_with('items')}, x AS (SELECT category_code, count(*) AS items, count_if(amount IS NULL) AS inappropriate, count_if(amount IS NOT NULL AND used_on IS NULL) AS review FROM items GROUP BY category_code)
SELECT *, CASE WHEN inappropriate > 0 THEN 'inappropriate ' || inappropriate WHEN review > 0 THEN 'review ' || review ELSE 'ok' END AS note FROM x""",
    "a19_photo_reviews": """WITH s AS (SELECT user_id % 400 AS file_id, event_type AS equipment, value > 10 AS is_wearing, event_id % 6 = 0 AS needs_review, round(value, 2) AS confidence FROM events WHERE event_type IN ('click', 'view', 'error')),
f AS (SELECT DISTINCT file_id, e AS equipment FROM s, (SELECT unnest(['click', 'view', 'error']) AS e)), w AS (SELECT file_id, equipment, max(CASE WHEN NOT is_wearing THEN 3 WHEN needs_review THEN 2 ELSE 1 END) AS w, max(confidence) AS confidence FROM s GROUP BY file_id, equipment)
SELECT f.file_id, f.equipment, confidence, CASE w WHEN 3 THEN 'not_wearing' WHEN 2 THEN 'needs_review' WHEN 1 THEN 'wearing' ELSE 'unknown' END AS status FROM f LEFT JOIN w USING (file_id, equipment)""",
    "a27_evaluation": """WITH x AS (SELECT quality AS e, toxic AS g, CAST(n_chars > 600 AS INT) AS a FROM labels LEFT JOIN (SELECT * FROM documents WHERE doc_id % 13 <> 0) USING (doc_id)), y AS (SELECT *, coalesce(e = a, false) AS r FROM x)
SELECT count(*) AS rows, round_even(count_if(r) / count(*), 6) AS accuracy, round_even(count_if(r AND e = g) / count_if(e = g), 6) AS keep_accuracy, round_even(count_if(r AND e <> g) / count_if(e <> g), 6) AS reclass_accuracy,
  round_even(count_if(NOT r AND e = g) / count_if(e = g), 6) AS over_change, round_even(count_if(a IS NULL) / count(*), 6) AS no_answer FROM y""",
    "a28_confusion": """SELECT CAST(n_chars > 600 AS INT) AS actual, count_if(quality = 0) AS "0", count_if(quality = 1) AS "1" FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
    "w8_chat_history": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS history FROM l WHERE n <= 6 GROUP BY conv_id""",
    "o7_evidence_order": f"WITH {oracle_with('files')} SELECT evidence_type, count(*) AS n, CASE evidence_type WHEN 'receipt' THEN 1 WHEN 'site_photo' THEN 2 WHEN 'tax_invoice' THEN 3 ELSE 99 END AS place FROM files GROUP BY evidence_type",
    "f72_action_rows": """SELECT event_id AS log_id, event_id * 1000 AS action_id, user_id AS item_id, 'needs_review' AS decision FROM events UNION ALL SELECT event_id, event_id * 1000 + 1, NULL, 'appropriate' FROM events""",
}
