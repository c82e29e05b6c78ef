"""Keyed merges with a rule for each column, and a log of changes from which every state can be made again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: set: the batch's last value, also a null; fill: its last value that isn't null; add: the sum, a null adds nothing; keep: what was first there.
RULES = ("set", "fill", "add", "keep")


def _last(rows: DataFrame, keys: list[str], rules: dict[str, str], order: list[str]) -> DataFrame:
    """A batch's rows of a key as one, in the order of ``order``; an aggregate that combines before the shuffle."""
    at = F.struct(*order)
    parts = {
        "set": lambda c: F.max(F.struct(at.alias("at"), F.col(c).alias("v")))["v"],
        "fill": lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"],
        "add": lambda c: F.sum(c),
        "keep": lambda c: F.min(F.struct(at.alias("at"), F.col(c).alias("v")))["v"],
    }
    return rows.groupBy(*keys).agg(*[parts[rule](c).alias(f"_{c}") for c, rule in rules.items()], F.lit(True).alias("_in"))


def changes(table: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, str], order: list[str], run: int, snapshot: bool = False) -> DataFrame:
    """The changes that a batch makes to a table (keys and the columns of rules): run, keys, change (inserted, updated, deleted), before, after (structs), before_hash and after_hash.

    A key's rows of the batch count in their order. Rows that stay as they are make no change. If the batch is a whole snapshot, what isn't in it is deleted. Null keys equal each other.
    """
    kinds = {f.name: f.dataType for f in table.schema}
    new = _last(batch, keys, rules, order).select(*[F.col(k).alias(f"_{k}") for k in keys], *[f"_{c}" for c in rules], "_in")
    old = table.select(*keys, *rules).withColumn("_was", F.lit(True))
    both = old.join(new, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "full")
    was, there = F.coalesce("_was", F.lit(False)), F.coalesce("_in", F.lit(False))
    value = {
        "set": lambda c: F.col(f"_{c}"),
        "fill": lambda c: F.coalesce(f"_{c}", c),
        "add": lambda c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.coalesce(c, F.lit(0)) + F.col(f"_{c}")),
        "keep": lambda c: F.when(was, F.col(c)).otherwise(F.col(f"_{c}")),
    }
    before = F.when(was, F.struct(*[F.col(c) for c in rules]))
    after = F.when(there, F.struct(*[value[rule](c).cast(kinds[c]).alias(c) for c, rule in rules.items()]))
    rows = both.select(*[F.when(was, F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys], before.alias("before"), after.alias("after"))
    change = F.when(F.col("before").isNull(), "inserted").when(F.col("after").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "updated")
    rows = rows.withColumn("change", change).filter(F.col("change").isNotNull() & (F.lit(snapshot) | (F.col("change") != "deleted")))
    hashes = {f"{n}_hash": F.when(F.col(n).isNotNull(), F.sha2(F.to_json(n, {"ignoreNullFields": "false"}), 256)) for n in ("before", "after")}
    return rows.withColumns(hashes).select(F.lit(run).cast("long").alias("run"), *keys, "change", "before", "after", *hashes)


def applied(table: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """The table after one run's changes."""
    columns = [c for c in table.columns if c not in keys]
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    touched = log.select(*[F.col(k).alias(f"_{k}") for k in keys])
    rest = table.join(touched, on, "left_anti")
    return rest.unionByName(log.filter("change <> 'deleted'").select(*keys, *[F.col("after")[c].alias(c) for c in columns]))


def replayed(log: DataFrame, keys: list[str], upto: int | None = None) -> DataFrame:
    """The table that the logs of runs (up to one, if given) make of an empty one: each key's last change."""
    rows = log if upto is None else log.filter(F.col("run") <= upto)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("change", "after"), "run").alias("l"))
    return last.filter("l.change <> 'deleted'").select(*keys, "l.after.*")
