"""An item's review: the worst decision over classification, law, logs and missing evidence, with its reasons, and the issues of items that aren't in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nested import DECISIONS

LEVELS = ["appropriate", "needs_review", "inappropriate"]
RISKS = ["low", "medium", "high"]
#: States of a classification that change a review, and what is said where nothing else is. Fixed values.
CHECK, CHANGED = "검토필요", "카테고리변경"
CHANGED_REASON = "분류 agent가 카테고리 변경 필요성을 확인함"
MISSING_REASON = "필수 증빙 미충족: "
NOTHING_REASON = "제출 증빙과 사용내역서 기준 검토 결과 특이사항 없음"
NO_BASIS = "검증 로그의 판정 근거 확인 필요"
#: Keys of a log's details, in the order of their priority. Fixed values.
SUMMARY_KEYS = ["summary", "reason"]
BASIS_KEYS = ["legal_basis", "law_basis", "basis", "조항"]
ACTION_KEYS = ["required_action", "action", "recommendation", "필요조치", "필요 조치"]
PROBLEM_KEYS = ["problem", "error", "reason", "사유"]


def level(word: Column) -> Column:
    """0, 1 or 2 of a result's word; null for one that says nothing."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(LEVELS):
        out = F.when(word.isin(*DECISIONS[name]), i).otherwise(out)
    return out


def at_key(details: Column, key: str) -> Column:
    """What JSON details have at a key. Only texts in which the key, or an escape that may write it, occurs are parsed."""
    there = F.contains(details, F.lit(key)) | F.contains(details, F.lit("\\"))
    return F.when(there, F.get_json_object(details, f"$['{key}']"))


def detail(details: Column, keys: list[str]) -> Column:
    """The first key of JSON details with a value that isn't empty."""
    found = [F.nullif(at_key(details, k), F.lit("")) for k in keys]
    return F.coalesce(*found)


def _rows(df: DataFrame, keys: list[str], rank: int, at: Column, found: Column, reason: Column, issue: Column) -> DataFrame:
    return df.select(*keys, F.lit(rank).alias("rank"), at.cast("long").alias("at"), found.cast("int").alias("level"), F.nullif(reason, F.lit("")).alias("reason"), F.coalesce(issue, F.lit(False)).alias("issue"))


def item_reviews(items: DataFrame, keys: list[str], classified: DataFrame, judged: DataFrame, logs: DataFrame, requirements: DataFrame) -> DataFrame:
    """keys, decision, risk_level and summary_reason of every item.

    classified: keys, status, reason; judged: keys, status, reason (a status of no known word needs a review); logs: keys, log_id, created_at, result_code, details (JSON); requirements:
    keys, evidence_type, satisfied. An item has one classification and one judgement at most. Sources come in this order, logs by created_at, then log_id. The reason is the first that
    belongs to a problem; without problems the first of all. Missing evidence asks for a review where nothing is inappropriate.
    """
    change = F.when(F.col("status") == CHANGED, F.coalesce(F.nullif("reason", F.lit("")), F.lit(CHANGED_REASON)))
    one = _rows(classified, keys, 0, F.lit(0), F.when(F.col("status") == CHECK, 1), change, F.lit(False))
    by_law = F.coalesce(level(F.col("status")), F.lit(1))
    two = _rows(judged, keys, 1, F.lit(0), by_law, F.col("reason"), by_law > 0)
    by_log = level(F.lower(F.trim("result_code")))
    three = logs.filter(by_log > 0).select(*keys, F.lit(2).alias("rank"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), by_log.alias("level"), detail(F.col("details"), SUMMARY_KEYS).alias("reason"), F.lit(True).alias("issue"), F.col("log_id").cast("long").alias("id"))
    rows = one.unionByName(two).withColumn("id", F.lit(0).cast("long")).unionByName(three)
    said = F.when(F.col("reason").isNotNull(), F.struct("rank", "at", "id", "reason"))
    found = rows.groupBy(*keys).agg(F.max("level").alias("_worst"), F.min(F.when(F.col("issue"), said)).alias("_issue"), F.min(said).alias("_any"))
    gone = requirements.filter(~F.coalesce("satisfied", F.lit(False))).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("evidence_type")), ", ").alias("_missing"))
    out = items.select(*keys).join(found, keys, "left").join(gone, keys, "left")
    before = F.coalesce("_worst", F.lit(0))
    lacks = F.col("_missing").isNotNull() & (before < 2)
    worst = F.when(lacks, 1).otherwise(before)
    missing = F.when(lacks, F.concat(F.lit(MISSING_REASON), "_missing"))
    reason = F.when(worst > 0, F.coalesce(F.col("_issue.reason"), missing)).otherwise(F.lit(None).cast("string"))
    named = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), worst + 1)
    return out.select(*keys, named(LEVELS).alias("decision"), named(RISKS).alias("risk_level"), F.coalesce(reason, F.col("_any.reason"), F.lit(NOTHING_REASON)).alias("summary_reason"))


def issues(reviews: DataFrame, keys: list[str], classified: DataFrame, judged: DataFrame, logs: DataFrame) -> DataFrame:
    """keys, issue_type, problem, legal_basis and required_action of items that aren't appropriate.

    judged may have citations (array of legal_basis); without any, the citations of logs' details count (sources, citations or 출처), by created_at and log_id. The problem is the judgement's
    reason, else the classification's, else the logs', else the review's; the action is the first that a log asks for.
    """
    bad = reviews.filter("decision <> 'appropriate'")
    own = judged.select(*keys, F.nullif("reason", F.lit("")).alias("_law"), *([F.array_distinct(F.filter("citations", lambda c: c.isNotNull())).alias("_cited")] if "citations" in judged.columns else [F.array().cast("array<string>").alias("_cited")]))
    said = classified.select(*keys, F.nullif("reason", F.lit("")).alias("_class"))
    order = [F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.col("log_id").cast("long").alias("id")]
    source = "array<struct<legal_basis: string, `조항`: string, article_no: string>>"
    lists = F.coalesce(*[F.from_json(at_key(F.col("details"), k), source) for k in ("sources", "citations", "출처")])
    bases = F.filter(F.transform(lists, lambda c: F.coalesce(F.nullif(c["legal_basis"], F.lit("")), F.nullif(c["조항"], F.lit("")), F.nullif(c["article_no"], F.lit("")))), lambda b: b.isNotNull())
    rows = logs.join(bad.select(*keys), keys, "left_semi").select(*keys, *order, detail(F.col("details"), BASIS_KEYS).alias("basis"), detail(F.col("details"), ACTION_KEYS).alias("action"), detail(F.col("details"), PROBLEM_KEYS).alias("problem"), bases.alias("cited"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("at", "id", c)))[c]
    told = rows.groupBy(*keys).agg(first("basis").alias("_basis"), first("action").alias("_action"), first("problem").alias("_problem"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("cited") > 0, F.struct("at", "id", "cited")))), lambda x: x["cited"]))).alias("_logged"))
    out = bad.join(own, keys, "left").join(said, keys, "left").join(told, keys, "left")
    cited = F.when(F.size("_cited") > 0, F.col("_cited")).otherwise(F.col("_logged"))
    basis = F.coalesce(F.nullif(F.array_join(cited, ", "), F.lit("")), "_basis", F.lit(NO_BASIS))
    return out.select(*keys, F.col("decision").alias("issue_type"), F.coalesce("_law", "_class", "_problem", "summary_reason").alias("problem"), basis.alias("legal_basis"), F.col("_action").alias("required_action"))
