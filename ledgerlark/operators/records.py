"""Keyed records: latest per key, running sums, upserts, snapshot differences, logs, costs, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nested

#: USD for a million tokens: input, cached input, output. Fixed values.
MODEL_PRICES = {
    "gpt-4.1": ("2.00", "0.50", "8.00"),
    "gpt-4.1-mini": ("0.40", "0.10", "1.60"),
    "gpt-4o": ("2.50", "1.25", "10.00"),
    "gpt-4o-mini": ("0.15", "0.075", "0.60"),
    "gpt-5.2": ("1.75", "0.175", "14.00"),
    "gpt-5-mini": ("0.25", "0.025", "2.00"),
    "text-embedding-3-small": ("0.02", "0.02", "0"),
    "gemini-2.5-flash": ("0.30", "0.03", "2.50"),
    "gemini-2.5-flash-lite": ("0.10", "0.01", "0.40"),
    "gemini-3.1-flash-lite": ("0.25", "0.025", "1.50"),
    "claude-sonnet-4.6": ("3.00", "0.30", "15.00"),
    "claude-sonnet-4-6": ("3.00", "0.30", "15.00"),
}
#: Of models that aren't listed. Fixed values.
DEFAULT_PRICE = ("0.40", "0.10", "1.60")
#: Upper bounds of the duration histogram, in seconds. Fixed values.
DURATION_BUCKETS = [0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300]


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by one aggregate that is combined before the shuffle."""
    values = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in values]).select(*rows.columns)


def running_tokens(logs: DataFrame) -> DataFrame:
    """token_current, the last known, and token_cumulative, the sum so far, in a statement's log of an agent."""
    w = Window.partitionBy("statement_id", "agent").orderBy("updated_at", "log_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return logs.withColumns({"token_current": F.last("tokens", ignorenulls=True).over(w), "token_cumulative": F.coalesce(F.sum("tokens").over(w), F.lit(0))})


def upserted(current: DataFrame, incoming: DataFrame, keys: list[str], policy: str = "update") -> DataFrame:
    """current with incoming rows: those of known keys replace theirs (update) or are left out (nothing)."""
    kept = current.join(incoming.select(*keys).distinct(), keys, "left_anti") if policy == "update" else current
    new = incoming if policy == "update" else incoming.join(current.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new.dropDuplicates(keys))


def replaced_set(active: DataFrame, incoming: DataFrame, owner: str) -> DataFrame:
    """Rows of owners that come anew turn inactive, and the new rows are active."""
    old = active.join(incoming.select(F.col(owner).alias("_o")).distinct(), F.col(owner) == F.col("_o"), "left")
    return old.withColumn("is_active", F.col("is_active") & F.col("_o").isNull()).drop("_o").unionByName(incoming.withColumn("is_active", F.lit(True)))


def set_statuses(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files with the status of changes (file_id, new_status) where they are live."""
    joined = files.join(changes, "file_id", "left")
    return joined.withColumn("status_code", F.when(~F.col("deleted") & F.col("new_status").isNotNull(), F.col("new_status")).otherwise(F.col("status_code"))).drop("new_status")


def snapshot_diff(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """id, change (added, updated, deleted, unchanged), previous and new hash; hashes are compared, bodies never move."""
    both = current.select("id", F.col("hash").alias("previous_hash")).join(incoming.select("id", F.col("hash").alias("new_hash")), "id", "full")
    change = F.when(F.col("previous_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("previous_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    return both.withColumn("change", change)


def next_revisions(statements: DataFrame, existing: DataFrame) -> DataFrame:
    """revision_no of new statements of a project and month, after those that there are (existing: project, month, revision_no)."""
    top = existing.groupBy("project_id", "month").agg(F.max("revision_no").alias("_top"))
    n = F.row_number().over(Window.partitionBy("project_id", "month").orderBy("statement_id"))
    return statements.join(top, ["project_id", "month"], "left").withColumn("revision_no", F.coalesce("_top", F.lit(0)) + n).drop("_top")


def prices(models: DataFrame) -> DataFrame:
    """model with its prices: its own, else of the longest known name that it continues after a dash, else the default. models: distinct names."""
    spark = models.sparkSession
    rows = [(k, *map(str, v)) for k, v in MODEL_PRICES.items()]
    known = spark.createDataFrame(rows, "known string, price_in string, price_cached string, price_out string")
    name = F.lower(F.trim(F.col("model")))
    fits = (name == F.col("known")) | F.startswith(name, F.concat(F.col("known"), F.lit("-")))
    # A dozen prices: broadcast, and matched by prefix against distinct names only.
    found = models.join(F.broadcast(known), fits, "left")
    best = found.groupBy("model").agg(F.max_by(F.struct("price_in", "price_cached", "price_out"), F.length("known")).alias("p"))
    columns = [F.coalesce(F.col("p")[c], F.lit(d)).cast("decimal(10,4)").alias(c) for c, d in zip(("price_in", "price_cached", "price_out"), DEFAULT_PRICE, strict=True)]
    return best.select("model", *columns)


def cost(input_tokens: Column, cached: Column, output: Column) -> Column:
    """USD, eight digits, half up, of rows with their prices."""
    billable = F.greatest(input_tokens - cached, F.lit(0)).cast("decimal(18,0)")
    total = billable * F.col("price_in") + cached.cast("decimal(18,0)") * F.col("price_cached") + output.cast("decimal(18,0)") * F.col("price_out")
    return F.round(total / F.lit(1_000_000).cast("decimal(7,0)"), 8).cast("decimal(18,8)")


def dashboard(logs: DataFrame) -> DataFrame:
    """By statement, of the latest log of each agent: rows, tokens, counts by status and result, agents that need a human."""
    last = latest(logs.select("statement_id", "agent", "updated_at", "log_id", "status_code", "result_code", "tokens"), ["statement_id", "agent"], ["updated_at", "log_id"])
    return last.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("agents"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count_if(F.col("status_code") == "in_progress").alias("in_progress"),
        *[F.count_if(F.col("result_code") == r).alias(r) for r in ("success", "hil", "fail")],
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("result_code") == "hil", F.col("agent")))), ",").alias("hil_agents"),
        F.max(F.when(F.col("result_code") == "fail", 2).when(F.col("result_code") == "hil", 1).otherwise(0)).alias("worst"),
    )


def histogram(rows: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts: for each bound the rows up to it."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*keys).agg(*counts)
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)])
    return wide.select(*keys, F.inline(pairs))


def readiness(logs: DataFrame, files: DataFrame) -> DataFrame:
    """By statement: files with receipts or photos, agents that succeeded, and those to run next."""
    have = files.filter("NOT deleted").groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("files"), F.bool_or(F.col("evidence_type").isin("receipt", "tax_invoice")).alias("has_receipt"), F.bool_or(F.col("evidence_type") == "site_photo").alias("has_photo")
    )
    last = latest(logs.select("statement_id", "agent", "updated_at", "log_id", "result_code"), ["statement_id", "agent"], ["updated_at", "log_id"])
    done = last.groupBy("statement_id").agg(F.bool_or((F.col("agent") == "agent_0") & (F.col("result_code") == "success")).alias("classified"), F.bool_and(F.col("result_code") == "success").alias("all_done"))
    run = F.array_compact(F.array(F.when(F.col("has_receipt"), F.lit("link")), F.when(F.col("has_photo"), F.lit("vision")), F.when(~F.col("classified"), F.lit("classify"))))
    return have.join(done, "statement_id").withColumn("to_run", F.array_join(run, ","))


def action_rows(details: DataFrame) -> DataFrame:
    """A row for each result in a log's details (log_id, details), numbered log_id * 1000 + place."""
    rows = details.select("log_id", F.posexplode(nested.result_rows(F.col("details"))).alias("at", "row"))
    return rows.select("log_id", (F.col("log_id") * 1000 + F.col("at")).alias("action_id"), nested.item_id(F.col("row")).alias("item_id"), nested.decision(F.try_element_at(F.col("row"), F.lit("status"))).alias("decision"))


def worst_of(rows: DataFrame, keys: list[str], decision: str) -> DataFrame:
    """The worst decision of each key; rows with an unknown one don't count."""
    level = rows.groupBy(*keys).agg(F.max(nested.severity(F.col(decision))).alias("_level"))
    name = F.coalesce(nested.severity_name(F.col("_level")), F.lit("appropriate"))
    return level.select(*keys, name.alias(decision), F.when(F.col("_level") == 2, "high").when(F.col("_level") == 1, "medium").otherwise("low").alias("risk_level"))
