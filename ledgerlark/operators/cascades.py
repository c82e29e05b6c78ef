"""Row-level decisions, TODO rows, invoice text, and corpus helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .context import PHOTO_CATEGORIES

#: Patterns of a rule that forbids under conditions only. Fixed values.
CONDITIONAL_PATTERNS = [r"[0-9]+\)\s", r"사용할\s*수\s*있", r"경우에는\s*사용", r"아니한\s*경우", r"병행하는\s*경우", r"않는\s*경우", r"경우에\s*한하", r"목적으로\s*하", "목적의", "용도", "등에서", "외의"]

#: Categories by the words of their names, and names by code. Fixed values.
CATEGORY_NAMES = {
    "CAT_01": "안전·보건관리자 임금 등",
    "CAT_02": "안전시설비 등",
    "CAT_03": "보호구 등",
    "CAT_04": "안전보건진단비 등",
    "CAT_05": "안전보건교육비 등",
    "CAT_06": "근로자 건강장해예방비 등",
    "CAT_07": "건설재해예방전문지도기관 기술지도비",
    "CAT_08": "본사 전담조직 근로자 임금 등",
    "CAT_09": "위험성평가 등에 따른 소요비용",
}


def category_of_text(value: Column) -> Column:
    """The category of a leading number, else of the first category whose name's words are in the text, blanks aside; null if none."""
    plain = F.replace(value, F.lit(" "))
    out = F.lit(None).cast("string")
    for code, name in reversed(list(CATEGORY_NAMES.items())):
        words = [w for w in name.replace("등", "").replace("·", "").replace(" ", "").split() if len(w) > 1]
        out = F.when(F.rlike(plain, F.lit("|".join(words))), code).otherwise(out)
    number = F.regexp_extract(F.trim(value), r"^([1-9])[.\s]", 1)
    return F.when(number != "", F.concat(F.lit("CAT_0"), number)).otherwise(out)


def resolved_category(rows: DataFrame, categories: DataFrame, column: str) -> DataFrame:
    """rows with category_code, found by code or else by name (categories: code, name)."""
    by_code = categories.select(F.col("code").alias("_a"), F.col("code").alias("_by_code"))
    by_name = categories.select(F.col("name").alias("_b"), F.col("code").alias("_by_name"))
    out = rows.join(by_code, F.col(column) == F.col("_a"), "left").join(by_name, F.col(column) == F.col("_b"), "left")
    return out.withColumn("category_code", F.coalesce("_by_code", "_by_name")).drop("_a", "_b", "_by_code", "_by_name")


def photos_to_review(files: DataFrame, items: DataFrame) -> DataFrame:
    """Photos that are linked to an item of a category whose photos are reviewed."""
    wanted = items.filter(F.col("category_code").isin(*PHOTO_CATEGORIES)).select("statement_id", F.col("seq").alias("item_seq"))
    return files.filter("evidence_type = 'site_photo'").join(wanted, ["statement_id", "item_seq"], "left_semi")


def generic_policy(items: DataFrame, policies: DataFrame) -> DataFrame:
    """items with needs_review: their name is a policy's alias, in its category where it names one (policies: aliases, category)."""
    each = policies.select(F.explode("aliases").alias("item_name"), F.col("category").alias("_only")).distinct()
    marked = each.withColumn("_hit", F.lit(True))
    both = items.join(marked, (items.item_name == marked.item_name) & (marked["_only"].isNull() | (marked["_only"] == items.category_code)), "left").drop(marked.item_name)
    return both.groupBy(*items.columns).agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("needs_review"))


def photo_overall(reviews: DataFrame) -> DataFrame:
    """By file: the worst equipment status, and the equipment that isn't worn."""
    level = F.when(F.col("status") == "not_wearing", 3).when(F.col("status") == "needs_review", 2).when(F.col("status") == "unknown", 1).otherwise(0)
    out = reviews.groupBy("file_id").agg(F.max(level).alias("_l"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "not_wearing", F.col("equipment")))), ",").alias("not_worn"))
    return out.withColumn("overall", F.when(F.col("_l") == 3, "fail").when(F.col("_l") >= 1, "hil").otherwise("success")).drop("_l")


def evidence_todos(checked: DataFrame, names: DataFrame) -> DataFrame:
    """A TODO for each missing type, with its name, or its code where it has none."""
    return checked.filter("NOT is_satisfied").join(names, "evidence_type", "left").withColumn("title", F.concat(F.coalesce("type_name", "evidence_type"), F.lit(" missing")))


def omitted(asked: DataFrame, answers: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What was asked without an answer, and the first answer of each that was asked; unknown and repeated answers are left out."""
    known = answers.join(asked.select(key), key, "left_semi")
    first = known.groupBy(key).agg(F.min_by("answer", "at").alias("answer"))
    return asked.join(first, key, "left_anti"), first


def first_and_last(results: DataFrame) -> DataFrame:
    """By item: the first and the last result in the order they were made."""
    return results.groupBy("item_id").agg(F.min_by("result", F.struct("made_at", "log_id")).alias("first_result"), F.max_by("result", F.struct("made_at", "log_id")).alias("last_result"))


def reranked(hits: DataFrame, scores: DataFrame, keep: int = 5) -> DataFrame:
    """The best hits of a query by an outside score; hits without one come last, in their own order."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("new_score"), "rank")
    return hits.join(scores, ["query_id", "id"], "left").withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= keep)


def item_decision(rows: DataFrame) -> DataFrame:
    """rows (limit_exceeded, disallow_score, allow_score, evidence, shortfall) with a category status and its item code.

    An exceeded cap comes first, then a rule that clearly forbids (half a point over the best that allows, or none that does), then too little progress.
    """
    forbids = F.col("disallow_score").isNotNull() & (F.col("allow_score").isNull() | (F.col("disallow_score") >= F.col("allow_score") + 0.5))
    conditional = F.rlike(F.coalesce("evidence", F.lit("")), F.lit("|".join(CONDITIONAL_PATTERNS)))
    status = F.when(F.col("limit_exceeded"), "cap_exceeded").when(forbids & ~conditional, "disallowed").when(F.coalesce(F.col("shortfall") > 0, F.lit(False)), "progress_short").when(forbids, "conditional").otherwise("ok")
    out = rows.withColumn("status", status)
    return out.withColumn("result_code", F.when(F.col("status") == "ok", "success").otherwise("hil"))


def invoice_lines(texts: DataFrame) -> DataFrame:
    """Item lines of invoices' text: lines with two or more amounts of at least 100, the last two are supply and tax; the least number under 10000 before them is the quantity."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    raw = F.regexp_extract_all("line", F.lit(r"(\d[\d,]*)"), F.lit(1))
    numbers = F.filter(F.transform(raw, lambda n: F.replace(n, F.lit(",")).try_cast("long")), lambda n: n.isNotNull())
    found = lines.withColumn("numbers", numbers).withColumn("amounts", F.filter("numbers", lambda n: n >= 100)).filter(F.size("amounts") >= 2)
    rest = F.filter("numbers", lambda n: (n > 0) & (n < 10000))
    return found.select("id", "at", F.element_at("amounts", -2).alias("supply"), F.element_at("amounts", -1).alias("tax"), F.array_min(rest).alias("quantity"))


def checklist_rows(texts: DataFrame) -> DataFrame:
    """Cells of the first table (lines between bars) of each text: id, row, cells."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("bar", F.startswith(F.trim("line"), F.lit("|")))
    run = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Lines of the first run of table lines share the count of other lines before them.
    numbered = lines.withColumn("others", F.sum((~F.col("bar")).cast("int")).over(run)).filter("bar")
    first = numbered.groupBy("id").agg(F.min("others").alias("others"))
    rows = numbered.join(first, ["id", "others"]).filter(~F.rlike("line", F.lit(r"^[|\s:-]+$")))
    return rows.select("id", "at", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)).alias("cells"))
