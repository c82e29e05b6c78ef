"""Context joins and row-level cascades around the audit's main operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Words that name a piece of equipment. Fixed values.
EQUIPMENT = {"safety_helmet": ["안전모", "헬멧"], "safety_shoes": ["안전화"], "safety_belt": ["안전벨트", "안전대", "안전띠"], "safety_net": ["안전망"]}
#: Categories whose photos are reviewed. Fixed values.
PHOTO_CATEGORIES = ("CAT_02", "CAT_03")


def target_equipment(name: Column, words: dict[str, list[str]] = EQUIPMENT) -> Column:
    out = F.lit(None).cast("string")
    for kind, terms in reversed(list(words.items())):
        out = F.when(F.rlike(name, F.lit("|".join(terms))), kind).otherwise(out)
    return out


def project_check(statements: DataFrame, projects: DataFrame) -> DataFrame:
    """The first thing wrong with a statement (month, statement_name) of a project (start, end, project_name), or null."""
    both = statements.join(projects, "project_id")
    own, theirs = text.project_core(F.col("statement_name")), text.project_core(F.col("project_name"))
    wrong = (
        F.when(F.col("month").isNull(), "month_unknown")
        .when((F.col("month") < F.trunc("start", "MM")) | (F.col("month") > F.col("end")), "outside_construction")
        .when(~(F.contains(own, theirs) | F.contains(theirs, own)), "other_project")
    )
    return both.withColumn("violation", wrong)


def files_per_item(items: DataFrame, files: DataFrame) -> DataFrame:
    """items with their live files, in order, and their number."""
    own = files.filter("NOT deleted").groupBy("statement_id", F.col("item_seq").alias("seq")).agg(F.array_sort(F.collect_list("file_id")).alias("file_ids"))
    return items.join(own, ["statement_id", "seq"], "left").withColumn("n_files", F.coalesce(F.size("file_ids"), F.lit(0)))


def first_context(files: DataFrame, items: DataFrame) -> DataFrame:
    """Each file with the name and category of the first item of its statement that it is linked to."""
    linked = files.join(items.select("statement_id", "seq", "item_name", "category_code"), (files.statement_id == items.statement_id) & (files.item_seq <= items.seq), "left").drop(items.statement_id)
    first = linked.groupBy("file_id").agg(F.min_by(F.struct("item_name", "category_code"), "seq").alias("c"))
    return first.select("file_id", F.col("c.item_name").alias("item_name"), F.col("c.category_code").alias("category_code"))


def natural_keys(items: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest id of each natural key, and how many share it."""
    return items.groupBy(*keys).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("shared"))


def with_fallback(items: DataFrame, own: DataFrame, category: DataFrame) -> DataFrame:
    """items with their own verdict, or else their category's."""
    joined = items.join(own.withColumnRenamed("verdict", "_own"), ["statement_id", "seq"], "left").join(category.withColumnRenamed("verdict", "_cat"), ["statement_id", "category_code"], "left")
    return joined.withColumn("verdict", F.coalesce("_own", "_cat", F.lit("unchecked"))).drop("_own", "_cat")


def owners(records: DataFrame, uploads: DataFrame, assignees: DataFrame) -> DataFrame:
    """The owner of a record: who asked for it, else who uploaded its file, else the latest assignee of its project."""
    latest = assignees.groupBy("project_id").agg(F.max_by("assignee", F.struct("assigned_at", "assignee")).alias("_assignee"))
    both = records.join(uploads, "file_id", "left").join(latest, "project_id", "left")
    return both.withColumn("owner", F.coalesce("requester", "uploader", "_assignee")).drop("_assignee")


def carried_forward(rows: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """rows whose empty values of a column are the last one before them."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def by_citation(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Each citation's source: by id, else by its legal basis, else by the alias of both; the least id of several."""
    keys = [F.col("source_id").cast("string"), F.col("legal_basis"), F.concat_ws(":", "legal_basis", "source_id")]
    aliases = sources.select("source_id", F.posexplode(F.array(*keys)).alias("priority", "citation"))
    best = aliases.groupBy("citation").agg(F.min(F.struct("priority", "source_id")).alias("b"))
    return citations.join(best, "citation", "left").select(*citations.columns, F.col("b.source_id").alias("source_id"))


def change_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    """By key: items whose category changes, those that keep theirs, and the changed ones in order."""
    changed = F.col("given_code") != F.col("final_code")
    return items.groupBy(*keys).agg(F.count_if(changed).alias("changed"), F.count_if(~changed).alias("kept"), F.array_join(F.array_sort(F.collect_list(F.when(changed, F.col("seq").cast("string")))), ",").alias("changed_items"))


def grouped_laws(laws: DataFrame) -> DataFrame:
    """Laws of equal summaries together, in order."""
    return laws.groupBy("summary").agg(F.array_join(F.array_sort(F.collect_set("law")), ",").alias("laws"), F.count(F.lit(1)).alias("uses"))


def preferred_corpus(chunks: DataFrame) -> DataFrame:
    """The chunks from PDFs, or all if there are none (a flag of one row)."""
    any_pdf = chunks.agg(F.coalesce(F.bool_or("is_pdf"), F.lit(False)).alias("_any"))
    return chunks.join(F.broadcast(any_pdf)).filter(F.col("is_pdf") | ~F.col("_any")).drop("_any")


def validator_rows(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that can be validated, and the rejected ones with the reason: they need a name, an amount and a budget."""
    reason = F.when(F.coalesce(F.trim("item_name"), F.lit("")) == "", "no_name").when(F.col("amount").isNull(), "no_amount").when(F.coalesce("budget", F.lit(0)) <= 0, "no_budget")
    marked = blocks.withColumn("reject_reason", reason)
    return marked.filter("reject_reason IS NULL").drop("reject_reason"), marked.filter("reject_reason IS NOT NULL")


def newest(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows, from 1 to 200: a page of a report."""
    return rows.orderBy(*order).limit(max(1, min(n, 200)))
