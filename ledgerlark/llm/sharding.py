"""Shards by balanced label propagation: linked documents move to their neighbours' shards, sizes stay even.

Documents are linked through a hub (a host, a text's hash, any key): documents of one hub are neighbours. Neighbours are
never paired: a hub's counts by shard stand for them. Where a document starts is left to a hash. In each round every hub that isn't
settled asks for the shard that most of its documents are in, of those with room for all of it, and its documents move there
together. Places of documents that have yet to move are free, as they leave them. A shard admits large hubs first; which of
equally large ones is decided by a hash, so that no task ranks them all: sums by shard, size class and bucket of
the hash are all that the driver gets. Rounds go on until all hubs are settled or none that is left fits anywhere; then fewer hubs than shards
are left, and they are split over as few shards as their rooms allow, as are at first the hubs larger than a shard. Documents without neighbours cut no
link wherever they are; they fill the shards up to the exact sizes at the end.

The law is `rows`: the shards' row counts differ by one at most. Slots are gapless from 0 in each shard.

Defined results: a null text has no neighbours, size 8 and the checksum of no bytes; equal rows are separate
members of one hub; an empty table gives an empty result. A hub with more documents than a shard holds fills whole shards and what
is left of it stays together in one more, if one has the room.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import hot_lookup, ranked, read_table, stored, text_key

N_SHARDS = 24
#: Bounds a run; rounds end when nothing is left that fits.
ROUNDS = 30
#: Buckets of a hash in each size class (a power of two) of hubs that ask for a shard.
LOTS = 64


def targets(n: int, n_shards: int) -> list[int]:
    return [n // n_shards + (s < n % n_shards) for s in range(n_shards)]


def _by_shard(values: list, shard):
    return F.element_at(F.array(*[F.lit(v) for v in values]), shard + 1)


def _tally(df: DataFrame, column: str, n_shards: int) -> list[int]:
    """Rows by shard: n_shards numbers."""
    got = {r[0]: r[1] for r in df.groupBy(column).count().collect()}
    return [got.get(s, 0) for s in range(n_shards)]


def split(hubs: list[tuple], room: list[int]) -> list[tuple]:
    """(hub, end, shard): a hub's members with numbers below ``end``, from the end before, go to the shard. ``room`` shrinks.

    As long as no shard has room for what is left of a hub, the roomiest one is filled; then the tightest that holds it gets the rest.
    """
    plan = []
    for hub, size in sorted(hubs, key=lambda h: -h[1]):
        at = 0
        while at < size:
            enough = [s for s, r in enumerate(room) if r >= size - at]
            s = min(enough, key=lambda s: (room[s], s)) if enough else max(range(len(room)), key=lambda s: (room[s], -s))
            n = min(room[s], size - at)
            room[s] -= n
            at += n
            plan.append((hub, at, s))
    return plan


def admitted(asked: list[tuple[int, int, int, int]], room: list[int]) -> set[tuple[int, int, int]]:
    """Of (shard, size class, lot, rows), those (shard, size class, lot) that fit, large classes first. ``room`` shrinks."""
    out = set()
    for shard, level, lot, n in sorted(asked, key=lambda a: (a[0], -a[1], a[2])):
        if n <= room[shard]:
            room[shard] -= n
            out.add((shard, level, lot))
    return out


def settled_hubs(counts: DataFrame, hub: str, quota: list[int], rounds: int) -> tuple[list[DataFrame], list[tuple], list[int]]:
    """Hubs (hub, _members, _is, shard) that go to one shard, the plan of those that are split, and the room left.

    counts: hub, _members and _counts, its rows by shard.
    """
    n_shards = len(quota)
    room, whole = list(quota), []
    big = counts.filter(F.col("_members") > max(quota)).select(hub, "_members").collect()  # fewer than shards
    plan = split([tuple(r) for r in big], room)
    left = counts.filter(F.col("_members") <= max(quota))
    for t in range(rounds):
        least = left.agg(F.min("_members")).first()[0]
        if least is None or least > max(room):
            break
        places = F.array(*[F.struct(F.element_at("_counts", s + 1).alias("n"), F.xxhash64(hub, F.lit(t), F.lit(s)).alias("h"), F.lit(s).alias("s"), F.lit(r).alias("room")) for s, r in enumerate(room)])
        best = F.array_max(F.filter(places, lambda p: p["room"] >= F.col("_members")))["s"]
        asking = left.withColumns({"_best": best, "_level": F.floor(F.log2("_members")).cast("int"), "_lot": F.pmod(F.xxhash64(hub, F.lit(-1 - t)), F.lit(LOTS)).cast("int")})
        asking = stored(asking, f"shard-asked-{t}")
        asked = asking.filter("_best IS NOT NULL").groupBy("_best", "_level", "_lot").agg(F.sum("_members").alias("n")).collect()
        took = admitted([tuple(r) for r in asked], room)
        names = asking.sparkSession.createDataFrame(sorted(took), "_best int, _level int, _lot int").withColumn("_in", F.lit(1))
        tried = stored(asking.join(F.broadcast(names), ["_best", "_level", "_lot"], "left"), f"shard-tried-{t}")
        whole.append(tried.filter("_in = 1").select(hub, "_members", F.lit(1).alias("_is"), F.col("_best").alias("shard")))
        left = tried.filter("_in IS NULL").select(counts.columns)
    rest = left.select(hub, "_members").limit(n_shards).collect()  # all that are left, unless rounds ran out
    if len(rest) < n_shards:
        plan += split([tuple(r) for r in rest], room)
    return whole, plan, room


def balanced_label_propagation(rows: DataFrame, id_columns: list[str], hub: str, n_shards: int = N_SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows with ``shard`` and ``slot``: rows of one hub together as far as the shards' quotas let them.

    id_columns order rows; rows equal in all of them are interchangeable. A null hub links nothing.
    """
    base = stored(rows.withColumn("_row", F.xxhash64(*id_columns)), "shard-rows")
    n = base.count()
    quota = targets(n, n_shards)
    start = F.pmod("_row", F.lit(n_shards)).cast("int")
    counts = base.filter(F.col(hub).isNotNull()).groupBy(hub).agg(F.count(F.lit(1)).alias("_members"), F.array(*[F.count_if(start == s) for s in range(n_shards)]).alias("_counts"))
    counts = stored(counts.filter("_members > 1"), "shard-hubs")
    whole, plan, _ = settled_hubs(counts, hub, quota, rounds)
    names = base.sparkSession.createDataFrame([(h,) for h in {h for h, _, _ in plan}], StructType([rows.schema[hub]]))
    divided = counts.join(F.broadcast(names), hub).select(hub, "_members", F.lit(2).alias("_is"), F.lit(None).cast("int").alias("shard"))
    homes = stored(reduce(DataFrame.unionByName, [*whole, divided]), "shard-homes")
    found = stored(hot_lookup(base, homes, hub, "_members", n), "shard-found")
    placed = found.filter("_is = 1").drop("_is")
    if plan:
        cut = ranked(found.filter("_is = 2").drop("_is", "shard"), [hub], ["_row", *id_columns], "_number")
        ends: dict = {}
        for h, end, s in plan:
            ends.setdefault(h, []).append((end, s))
        table = base.sparkSession.createDataFrame([(h, [e for e, _ in v], [s for _, s in v]) for h, v in ends.items()], StructType([rows.schema[hub], *StructType.fromDDL("_ends array<long>, _shards array<int>").fields]))
        cut = cut.join(F.broadcast(table), hub)
        passed = F.size(F.filter("_ends", lambda e: e <= F.col("_number")))
        placed = placed.unionByName(cut.withColumn("shard", F.element_at("_shards", passed + 1)).drop("_number", "_ends", "_shards"))
    placed = stored(ranked(placed, ["shard"], ["_row", hub, *id_columns], "slot"), "shard-placed")
    kept = _tally(placed, "shard", n_shards)
    spare = stored(found.filter(F.col("_is").isNull()).drop("_is", "shard").withColumn("_all", F.lit(0)), "shard-spare")
    dealt = ranked(spare, ["_all"], ["_row", *id_columns], "_turn", buckets=256).drop("_all")
    # The free places, as ranges of turns: shard s takes the turns from ends[s - 1] to ends[s].
    ends = [sum(quota[: s + 1]) - sum(kept[: s + 1]) for s in range(n_shards)]
    shard = reduce(lambda rest, s: F.when(F.col("_turn") < ends[s], s).otherwise(rest), range(n_shards - 2, -1, -1), F.lit(n_shards - 1))
    starts = [k - (ends[s - 1] if s else 0) for s, k in enumerate(kept)]
    filled = dealt.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_turn") + _by_shard(starts, F.col("shard")))
    return placed.select(*rows.columns, "shard", "slot").unionByName(filled.select(*rows.columns, "shard", "slot"))


def op7_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), text_key().alias("_hub")
    )
    out = balanced_label_propagation(rows, ["doc_id", "_hub"], "_hub")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_share(sharded: DataFrame, hub: str) -> DataFrame:
    """One row: the links inside hubs, and those between shards (pairs are counted, not made)."""
    counts = sharded.filter(F.col(hub).isNotNull()).groupBy(hub, "shard").agg(F.count(F.lit(1)).alias("_n"))
    per = counts.groupBy(hub).agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * (F.col("_n") - 1) / 2).alias("_in"))
    return per.agg(F.sum(F.col("_m") * (F.col("_m") - 1) / 2).alias("links"), F.sum(F.col("_m") * (F.col("_m") - 1) / 2 - F.col("_in")).alias("cut"))
