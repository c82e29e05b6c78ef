"""Near duplicates by b-bit MinHash.

1. A document's shingle set gives PERMUTATIONS minima. Bands of the full minima are keys of buckets; of each
   minimum the low BITS bits are kept, packed, as the signature. Documents with equal sets are one class, with a
   number of its own, so groups of exact copies vanish before anything is shuffled by bucket.
2. In each bucket one member, drawn by a hash that differs from band to band, is the centre: every member is a candidate
   with it, never with all others.
3. Equal low bits of two signatures, counted, give a similarity; what agrees by chance (2 ** -BITS of the minima) is taken off.
   Candidates far below the threshold go; the others are confirmed on their full shingle sets.
4. Connected components of confirmed links. A bucket whose members are still in several components is looked at again: its
   members outside its most common component are compared with the rest, so links that no centre showed aren't lost.

With 32 bands of 4 minima, a pair at the threshold of 0.75 shares no bucket in 5 cases of a million.

Defined results: null and empty texts, and those of white space, have no shingles, form components of their own and are kept;
fewer than SHINGLE words are one shingle; repeated rows are copies of each other; rows with one doc_id and different
texts have each the links of their text; an empty table gives an empty result; columns other than doc_id
and text aren't looked at. A row with a null doc_id is linked as any other, and names a component (by null) only if all its rows are such.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hot_lookup, read_table, stored, text_key
from ._words import shingle_set

SHINGLE = 5
PERMUTATIONS = 128
BANDS = 32
BITS = 4
THRESHOLD = 75  # hundredths
#: Estimates so far below the threshold (over five standard deviations of 128 minima) need no confirmation.
SLACK = 0.2
#: A bucket of no more rows than this may have its pairs made.
SMALL_BUCKET = 64
#: Rows of a bucket, and their shingles, that are compared in one task at most.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 2_000_000

_ODD = np.random.default_rng(20240101).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each permutation of the shingle hashes (a product with an odd number is one to one)."""
    least = [(shingles[i : i + 512] * _ODD[:, None]).min(axis=1) for i in range(0, len(shingles), 512)]
    return np.min(least, axis=0)


def _packed(minima: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum; its high bits are nearly all zero, so they are taken of a hash of it."""
    low = (minima * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (null for an empty set), bands and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                sizes, keys, bands, codes = [], [], [], []
                for text in some.column(2).to_pylist():
                    s = shingle_set(text, SHINGLE)
                    sizes.append(len(s))
                    if not len(s):
                        keys.append(None), bands.append(None), codes.append(None)
                        continue
                    m = _minima(s)
                    keys.append(blake2b(s.tobytes(), digest_size=16).digest())
                    bands.append([int.from_bytes(blake2b(b.tobytes(), digest_size=8).digest(), "little", signed=True) for b in m.reshape(BANDS, -1)])
                    codes.append(_packed(m))
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                columns = [*some.columns[:2], *[pa.array(v, k) for v, k in zip((sizes, keys, bands, codes), kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "set_key", "bands", "signature"])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key string, n_shingles long, set_key binary, bands array<long>, signature array<long>")


def similarity(a: Column, b: Column) -> Column:
    """The estimate from two signatures: equal groups of BITS bits, counted, less those that agree by chance."""
    ones = sum(1 << i for i in range(0, 64, BITS))
    ones -= (1 << 64) * (ones >= 1 << 63)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = d
        for i in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, i))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    words = PERMUTATIONS * BITS // 64
    apart = sum((differing(a[i], b[i]) for i in range(1, words)), differing(a[0], b[0]))
    chance = 2.0**-BITS
    return ((1 - apart / F.lit(float(PERMUTATIONS))) - chance) / (1 - chance)


def shingle_sets(rows: DataFrame) -> DataFrame:
    """rep and the sorted distinct shingle hashes, as bytes, of rows (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                sets = pa.array([shingle_set(t, SHINGLE).tobytes() for t in some.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), sets], ["rep", "shingles"])

    return rows.select("rep", "text").mapInArrow(run, "rep long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= threshold * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = 0
                if 100 * min(len(s), len(t)) >= threshold * max(len(s), len(t)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= threshold * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("_s")), "a")
    with_b = with_a.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("_t")), "b")
    return with_b.select("a", "b", "_s", "_t").mapInArrow(run, "a long, b long")


def linked_blocks(mixed: DataFrame, floor: float, threshold: int) -> DataFrame:
    """Links (a, b) between the components that one bucket still has: each row outside the main one against the others.

    Blocks of a bucket's stray rows meet blocks of its rows in tasks of their own. A pair is looked at in the first
    band that it shares; of a row's links to one component, one is enough.
    """
    names = ["band", "key", "block", "stray_block", "rep", "component", "main", "signature", "bands", "shingles"]
    stray = mixed.filter("component <> main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = mixed.withColumn("stray_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stray_blocks") - 1)))
    chance = 2.0**-BITS
    ones = np.uint64(sum(1 << i for i in range(0, 64, BITS)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            band = left.column("band")[0].as_py()
            rep, component, main = (right.column(c).to_numpy() for c in ("rep", "component", "main"))
            codes, bands = (np.array(right.column(c).to_pylist()) for c in ("signature", "bands"))
            sets = [np.frombuffer(b, np.uint64) for b in right.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            for own in left.to_pylist():
                apart = (codes ^ np.array(own["signature"])).view(np.uint64)
                folded = apart.copy()
                for i in range(1, BITS):
                    folded |= apart >> np.uint64(i)
                differ = np.bitwise_count(folded & ones).sum(axis=1)
                estimate = (1 - differ / PERMUTATIONS - chance) / (1 - chance)
                size = len(own["shingles"]) // 8
                near = (component != own["component"]) & ((component == main) | (rep < own["rep"])) & (estimate >= floor)
                near &= (bands[:, :band] != np.array(own["bands"])[:band]).all(axis=1)
                near &= 100 * np.minimum(sizes, size) >= threshold * np.maximum(sizes, size)
                at = np.flatnonzero(near)
                if not len(at):
                    continue
                mine = np.frombuffer(own["shingles"], np.uint64)
                flat = np.concatenate([sets[i] for i in at])
                place = np.minimum(np.searchsorted(mine, flat), size - 1)
                both = np.add.reduceat((mine[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[at])[:-1]]))
                ok = at[100 * both >= threshold * (size + sizes[at] - both)]
                _, one = np.unique(component[ok], return_index=True)
                out += [(min(own["rep"], r), max(own["rep"], r)) for r in rep[ok[one]].tolist()]
        return pa.table({"a": [a for a, _ in out], "b": [b for _, b in out]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    keys = ["band", "key", "block", "stray_block"]
    return stray.select(*names).groupBy(*keys).cogroup(every.select(*names).groupBy(*keys)).applyInArrow(run, "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """id and component, the smallest id reachable, for every id in links (a, b): alternating large and small stars.

    Each round is two joins with minima that are aggregated before the shuffle, and is written to the shared folder.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    mark = None
    t = 0
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u", F.lit(1))).alias("y")).first()
        if now["n"] == 0 or now == mark:
            break
        mark, t = now, t + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-{t}-least")
        # Large star: the larger neighbours of u go to the least of u and its neighbours.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = stored(large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct(), f"{name}-{t}-large")
        # Small star: the smaller neighbours of u, and u, go to the least of them.
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{t}-small")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{t}")
    roots = edges.select(F.col("v").alias("id")).distinct().join(edges.select(F.col("u").alias("id")), "id", "left_anti")
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept (doc_id = component_id) and first for every row of docs (doc_id, text).

    first marks the rows of one document of each component: that with component_id, and if several texts have that id the
    one with the least text_key.
    """
    floor = threshold / 100 - SLACK
    signed = stored(signatures(docs), "minhash")
    total = signed.count()
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min(row).alias("row"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies")
    )
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "minhash-classes")
    keyed = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    # The centre of a bucket: a member that a hash draws, another one in another band.
    buckets = keyed.groupBy("band", "key").agg(
        F.min_by("rep", F.xxhash64("rep", "band")).alias("centre"), F.count(F.lit(1)).alias("members")
    )
    buckets = stored(buckets.filter("members > 1").select("band", "key", "centre"), "minhash-buckets")
    members = stored(keyed.join(buckets, ["band", "key"]), "minhash-members")
    codes = stored(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "signature", "bands", "n_shingles", F.struct("row.doc_id", "row.text_key").alias("_id")), "minhash-codes")
    # One row of each class.
    rows = docs.select(F.struct("doc_id", text_key().alias("text_key")).alias("_id"), "text").join(codes.select("_id", "rep"), "_id")
    sets = stored(shingle_sets(rows).dropDuplicates(["rep"]), "minhash-sets")
    codes = codes.drop("_id")

    def estimated(pairs: DataFrame) -> DataFrame:
        left = pairs.join(codes.select(F.col("rep").alias("a"), F.col("signature").alias("_x")), "a")
        both = left.join(codes.select(F.col("rep").alias("b"), F.col("signature").alias("_y")), "b")
        return both.filter(similarity(F.col("_x"), F.col("_y")) >= floor).select("a", "b")

    stars = members.filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    links = stored(confirmed(estimated(stars), sets, threshold), "minhash-links")
    first = stored(components(links, "minhash-cc"), "minhash-first")

    # Buckets still in several components: what isn't in the most common one is compared with the others.
    labelled = members.join(first.select(F.col("id").alias("rep"), "component"), "rep", "left").join(codes.select("rep", "n_shingles"), "rep")
    labelled = stored(labelled.select("band", "key", "rep", "n_shingles", F.coalesce("component", "rep").alias("component")), "minhash-labelled")
    parts = labelled.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    largest = F.max_by(F.struct("component", "n", "size"), F.struct("n", "component"))
    split = parts.groupBy("band", "key").agg(largest.alias("_main"), F.sum("n").alias("members"), F.sum("size").alias("_size"), F.count(F.lit(1)).alias("parts"))

    def blocks(rows, size):
        return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_SHINGLES), F.lit(1).cast("long"))

    split = split.withColumns({"main": F.col("_main.component"), "blocks": blocks(F.col("members"), F.col("_size")), "stray_blocks": blocks(F.col("members") - F.col("_main.n"), F.col("_size") - F.col("_main.size"))})
    split = split.drop("_main", "_size")
    split = stored(split.filter("parts > 1").drop("parts"), "minhash-split")
    # In a small bucket pairs are few, and only those with a high estimate need sets; in a large one pairs aren't made.
    few = labelled.join(split.filter(F.col("members") <= SMALL_BUCKET).select("band", "key", "main"), ["band", "key"])
    few = stored(few.join(codes.drop("n_shingles"), "rep").select("band", "key", "rep", "component", "main", "signature", "bands"), "minhash-few")
    stray = few.filter("component <> main").select("band", "key", *[F.col(c).alias(f"_{c}") for c in ("rep", "component", "signature", "bands")])
    earlier = F.exists(F.slice(F.zip_with("bands", "_bands", lambda x, y: x == y), F.lit(1), F.col("band")), lambda same: same)
    pairs = stray.join(few, ["band", "key"]).filter(
        (F.col("component") != F.col("_component"))
        & ((F.col("component") == F.col("main")) | (F.col("rep") < F.col("_rep")))
        & (similarity(F.col("signature"), F.col("_signature")) >= floor)
        & ~earlier
    )
    pairs = confirmed(pairs.select(F.least("rep", "_rep").alias("a"), F.greatest("rep", "_rep").alias("b")).distinct(), sets, threshold)
    large = split.filter(F.col("members") > SMALL_BUCKET).drop("members")
    mixed = labelled.join(large, ["band", "key"]).join(codes.drop("n_shingles"), "rep").join(sets, "rep")
    mixed = stored(mixed.withColumns({"block": F.pmod(F.xxhash64("rep"), F.col("blocks")), "stray_block": F.pmod(F.xxhash64("rep"), F.col("stray_blocks"))}), "minhash-mixed")
    more = stored(linked_blocks(mixed, floor, threshold).unionByName(pairs).distinct(), "minhash-more")
    if not more.isEmpty():
        first = stored(components(links.unionByName(more), "minhash-all"), "minhash-second")

    named = classes.select("set_key", "copies", "rep", "row").join(first.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = stored(named.select("set_key", "copies", "row", F.coalesce("component", "rep").alias("component")), "minhash-parts")
    least = named.groupBy("component").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("parts"))
    named = stored(hot_lookup(named.select("set_key", "copies", "component"), least, "component", "parts", total).select("set_key", "copies", "least"), "minhash-named")
    empty = signed.filter("set_key IS NULL").select("doc_id", "text_key", "n_shingles", F.lit(None).cast(named.schema["least"].dataType).alias("least"))
    rest = signed.filter("set_key IS NOT NULL").select("doc_id", "text_key", "n_shingles", "set_key")
    found = hot_lookup(rest, named, "set_key", "copies", total).drop("set_key").unionByName(empty)
    found = found.withColumn("component_id", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")))
    found = found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return found.withColumn("first", F.col("kept") & F.coalesce(F.col("text_key") == F.col("least.text_key"), F.lit(True))).drop("least")


def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS d, doc_id AS m FROM s UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.m AS component_id, s.doc_id = c.m AS kept
FROM s JOIN (SELECT d, min(m) AS m FROM r GROUP BY d) c ON c.d = s.doc_id
"""
