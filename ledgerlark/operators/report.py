"""Completeness and reports: missing evidence, summaries by type and category, budgets, caps, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Order in which evidence types are shown. Fixed values.
EVIDENCE_ORDER = {"usage_statement": 0, "receipt": 1, "site_photo": 2, "tax_invoice": 3, "other": 4}


def missing_evidence(requirements: DataFrame, links: DataFrame) -> DataFrame:
    """requirements (statement_id, seq, evidence_type) with is_satisfied: a link of that type is there."""
    there = links.select("statement_id", "seq", "evidence_type").distinct().withColumn("_is", F.lit(True))
    return requirements.join(there, ["statement_id", "seq", "evidence_type"], "left").withColumn("is_satisfied", F.col("_is").isNotNull()).drop("_is")


def evidence_check(checked: DataFrame) -> DataFrame:
    """By item: MISSING with its missing types in order, or OK."""
    gone = F.array_sort(F.collect_set(F.when(~F.col("is_satisfied"), F.col("evidence_type"))))
    out = checked.groupBy("statement_id", "seq").agg(gone.alias("_gone"))
    return out.select("statement_id", "seq", F.array_join("_gone", ",").alias("missing"), F.when(F.size("_gone") > 0, "MISSING").otherwise("OK").alias("status"))


def evidence_order(code):
    out = F.lit(99)
    for k, v in EVIDENCE_ORDER.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def evidence_summary(files: DataFrame, missing: DataFrame, errors: DataFrame) -> DataFrame:
    """By evidence type: submitted, passed, errors and missing, as sums over one union of counts; usage_statement is always there."""
    spark = files.sparkSession
    zero = F.lit(0).cast("long")
    parts = [
        files.groupBy("evidence_type").agg(F.count(F.lit(1)).alias("submitted_count"), zero.alias("error_count"), zero.alias("missing_count")),
        errors.groupBy("evidence_type").agg(zero.alias("submitted_count"), F.count(F.lit(1)).alias("error_count"), zero.alias("missing_count")),
        missing.groupBy("evidence_type").agg(zero.alias("submitted_count"), zero.alias("error_count"), F.count(F.lit(1)).alias("missing_count")),
        spark.range(1).select(F.lit("usage_statement").alias("evidence_type"), zero.alias("submitted_count"), zero.alias("error_count"), zero.alias("missing_count")),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    out = union.groupBy("evidence_type").agg(*[F.sum(c).alias(c) for c in ("submitted_count", "error_count", "missing_count")])
    return out.withColumns({"passed_count": F.greatest(F.col("submitted_count") - F.col("error_count"), F.lit(0)), "show_order": evidence_order(F.col("evidence_type"))})


def category_metrics(items: DataFrame, budgets: DataFrame, caps: DataFrame, bands: DataFrame) -> DataFrame:
    """By statement and category: total, cap and whether it is exceeded, required use by progress, shortfall of all categories together.

    caps (category_code, limit_pct) and bands (min_rate, max_rate, required) are small tables of rules: checked to be so, and broadcast.
    """
    for table in (caps, bands):
        if table.limit(10_001).count() > 10_000:
            raise ValueError("a table of caps or progress bands has over 10,000 rows")
    totals = items.groupBy("statement_id", "category_code").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("total"))
    cumulative = F.sum("total").over(Window.partitionBy("statement_id"))
    rows = totals.withColumn("cumulative", cumulative).join(budgets, "statement_id").join(F.broadcast(caps), "category_code", "left")
    # The bands as one value, by their ends: where several hold, the first one does.
    ordered = bands.agg(F.array_sort(F.collect_list(F.struct("min_rate", "max_rate", "required"))).alias("_bands"))
    holds = F.filter("_bands", lambda b: (F.col("progress") >= b["min_rate"]) & (b["max_rate"].isNull() | (F.col("progress") < b["max_rate"])))
    rows = rows.join(F.broadcast(ordered)).withColumn("required", F.get(holds, F.lit(0))["required"])
    cap, required = F.col("budget") * F.col("limit_pct"), F.col("budget") * F.col("required")
    exceeded = F.coalesce(F.col("total") > cap, F.lit(False))
    shortfall = F.when(required.isNotNull(), F.greatest(required - F.col("cumulative"), F.lit(0.0)))
    status = F.when(exceeded, "cap_exceeded").when(F.coalesce(shortfall > 0, F.lit(False)), "progress_short").otherwise("ok")
    return rows.select("statement_id", "category_code", "total", cap.alias("limit_amount"), exceeded.alias("exceeded"), "cumulative", shortfall.alias("shortfall"), status.alias("status"))


def budget_summary(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """By statement: used, remaining and used share of the budget in percent to a tenth (half up)."""
    used = items.groupBy("statement_id").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("used"))
    ratio = F.round(F.col("used").cast("decimal(18,2)") * 100 / F.col("budget").cast("decimal(18,2)"), 1)
    return budgets.join(used, "statement_id").select("statement_id", "used", (F.col("budget") - F.col("used")).alias("remaining"), F.when(F.col("budget") > 0, ratio.cast("double")).alias("ratio"))


def category_notes(reviews: DataFrame) -> DataFrame:
    """By category: items, inappropriate and review counts, and the note they make."""
    out = reviews.groupBy("category_code").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("decision") == "inappropriate").alias("inappropriate"), F.count_if(F.col("decision") == "needs_review").alias("review"))
    note = F.when(F.col("inappropriate") > 0, F.concat(F.lit("inappropriate "), F.col("inappropriate").cast("string"))).when(F.col("review") > 0, F.concat(F.lit("review "), F.col("review").cast("string"))).otherwise("ok")
    return out.withColumn("note", note)


def photo_reviews(detections: DataFrame, equipment: list[str]) -> DataFrame:
    """By file and equipment: not_wearing, needs_review, wearing or unknown in this order, with the best confidence; every equipment has a row."""
    files = detections.select("file_id").distinct().select("file_id", F.explode(F.array(*[F.lit(e) for e in equipment])).alias("equipment"))
    worst = F.max(F.when(~F.col("is_wearing"), 3).when(F.col("needs_review"), 2).otherwise(1))
    seen = detections.groupBy("file_id", "equipment").agg(worst.alias("_w"), F.max("confidence").alias("confidence"))
    status = F.when(F.col("_w") == 3, "not_wearing").when(F.col("_w") == 2, "needs_review").when(F.col("_w") == 1, "wearing").otherwise("unknown")
    return files.join(seen, ["file_id", "equipment"], "left").withColumn("status", status).drop("_w")


def evaluation(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: rows, accuracy, share of changes among rows that should stay, and of rows without an answer."""
    both = expected.join(actual, "id", "left")
    right = F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    stay = F.col("expected") == F.col("given")

    def share(hit, of):
        n = F.count_if(of)
        return F.when(n > 0, F.bround(F.count_if(of & hit) / n, 6))

    always = F.lit(True)
    return both.agg(
        F.count(F.lit(1)).alias("rows"), share(right, always).alias("accuracy"), share(right, stay).alias("keep_accuracy"), share(right, ~stay).alias("reclass_accuracy"),
        share(~right, stay).alias("over_change"), share(F.col("actual").isNull(), always).alias("no_answer"),
    )


def confusion(expected: DataFrame, actual: DataFrame, classes: list) -> DataFrame:
    return expected.join(actual, "id").groupBy("actual").pivot("expected", classes).count().na.fill(0)
