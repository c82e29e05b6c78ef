"""Benchmark decontamination by winnowing.

A text's fingerprints are, for each window of WINDOW successive GRAM-word hashes, the least one. Two texts that share
GRAM + WINDOW - 1 = SPAN words choose the same fingerprint within the shared span, so a join of fingerprints misses no span of
that length. Each hit is then extended to both sides over the words around it; what reaches SPAN equal words is contamination.
Benchmark items of fewer words are matched as a whole, by hashes of as many words.

Documents are read once. Each keeps, of its fingerprints, those that a bitmap of the benchmark's may contain; the bitmap has
a fixed size however large the benchmark is. What passes is joined by a shuffle, once for all copies of a text.

Defined results: a null or empty text has no words and no hits; an item without words takes no part; rows with equal
item_ids count as one item, those with a null item_id mark words but are not listed; repeated document rows get equal results; an
empty benchmark leaves all documents clean; other columns than doc_id and text, or item_id and text, aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import HOT_SHARE, hot_lookup, read_table, stored, text_key
from ._words import grams, hashes, mixed

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: Bits of the bitmap of benchmark fingerprints, a power of two.
BITMAP_BITS = 1 << 24

#: A-Z are lowered; 0-9, a-z and all beyond ASCII are of words, the rest is between them.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 0x20 for b in range(256))

SEEDS = "array<struct<print: long, size: int, pos: int, before: array<long>, core: array<long>, after: array<long>>>"


def words(text: str | None) -> np.ndarray:
    """Hashes of the text's words."""
    return hashes((text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split())


def _winnowed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the chosen grams of a text of at least SPAN words."""
    g = grams(h, GRAM)
    least = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    at = np.unique(least.argmin(axis=1) + np.arange(len(least)))
    return at, g[at]


def _whole(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of size words, apart from those of winnowed grams."""
    return mixed(grams(h, size) + np.uint64(size))


def _seeds(h: np.ndarray, at: np.ndarray, prints: np.ndarray, size: int) -> list[dict]:
    reach = SPAN - size if size == GRAM else 0
    v = h.view(np.int64)
    return [
        {"print": p, "size": size, "pos": a, "before": v[max(0, a - reach) : a][::-1], "core": v[a : a + size], "after": v[a + size : a + size + reach]}
        for a, p in zip(at.tolist(), prints.view(np.int64).tolist(), strict=True)
    ]


_SEED_TYPE = pa.list_(pa.struct([("print", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("before", pa.list_(pa.int64())), ("core", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))]))


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words and the seeds of each item: all chosen fingerprints, or of a short item its whole text.

    A short item's size is negative, so that it isn't taken for a gram of as many words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for text in batch.column(1).to_pylist():
                h = words(text)
                counts.append(len(h))
                if len(h) >= SPAN:
                    out.append(_seeds(h, *_winnowed(h), GRAM))
                elif len(h):
                    out.append([s | {"size": -len(h)} for s in _seeds(h, np.array([0]), _whole(h, len(h)), len(h))])
                else:
                    out.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(out, _SEED_TYPE)], ["item_id", "n_words", "seeds"])

    return benchmark.select("item_id", "text").mapInArrow(run, f"item_id long, n_words long, seeds {SEEDS}")


def bitmap(prints: DataFrame) -> np.ndarray:
    """BITMAP_BITS bits, that of each value of ``print`` set: at most BITMAP_BITS / 64 rows come to the driver."""
    place = F.col("print").bitwiseAND(F.lit(BITMAP_BITS - 1))
    cells = prints.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits"))
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    for r in cells.toLocalIterator():
        out[r["cell"]] = r["bits"]
    return out


def document_seeds(docs: DataFrame, bits: np.ndarray, short_sizes: list[int]) -> DataFrame:
    """doc_id, text_key, n_words and the seeds of each document that the bitmap may contain."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value.view(np.uint64)

        def known(prints: np.ndarray) -> np.ndarray:
            place = prints & np.uint64(BITMAP_BITS - 1)
            return (cells[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                out, counts = [], []
                for text in some.column(2).to_pylist():
                    h = words(text)
                    counts.append(len(h))
                    found = []
                    if len(h) >= SPAN:
                        at, prints = _winnowed(h)
                        ok = known(prints)
                        found += _seeds(h, at[ok], prints[ok], GRAM)
                    for size in short_sizes:
                        if len(h) >= size:
                            prints = _whole(h, size)
                            at = np.flatnonzero(known(prints))
                            found += [s | {"size": -size} for s in _seeds(h, at, prints[at], size)]
                    out.append(found)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(counts, pa.int64()), pa.array(out, _SEED_TYPE)], ["doc_id", "text_key", "n_words", "seeds"])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, f"doc_id long, text_key string, n_words long, seeds {SEEDS}")


def _same(a: Column, b: Column) -> Column:
    """The equal words at the start of two runs."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.greatest(F.size(a), F.size(b))).cast("int")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs."""
    items = stored(benchmark_seeds(benchmark), "winnow-items")
    short = sorted(-r[0] for r in items.select(F.explode("seeds.size").alias("s")).filter("s < 0").distinct().collect())
    seeds = items.select("item_id", F.explode("seeds").alias("s")).select("item_id", "s.*")
    total = docs.count()
    read = stored(document_seeds(docs, bitmap(seeds.select("print")), short), "winnow-docs")
    # Once for each text: its copies come back at the end.
    texts = read.filter(F.size("seeds") > 0).groupBy("text_key").agg(F.first("seeds").alias("seeds"), F.count(F.lit(1)).alias("copies"))
    texts = stored(texts, "winnow-texts")
    own = texts.select("text_key", F.explode("seeds").alias("s")).select("text_key", "s.*")
    theirs = seeds.groupBy("print", "size", F.col("before").alias("_before"), F.col("core").alias("_core"), F.col("after").alias("_after"))
    theirs = stored(theirs.agg(F.collect_set("item_id").alias("items")), "winnow-prints")
    # A fingerprint that many texts have is met in as many tasks as its rows need: there are at most HOT_SHARE such.
    salts = own.groupBy("print", "size").agg(F.count(F.lit(1)).alias("_n"))
    salts = stored(salts.filter(F.col("_n") > max(1, total // HOT_SHARE)).withColumn("_salts", F.expr(f"_n div {max(1, total // HOT_SHARE)} + 1")).drop("_n"), "winnow-salts")

    def salted(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(salts), ["print", "size"], "left").withColumn("_salts", F.coalesce("_salts", F.lit(1).cast("long")))

    own = salted(own).withColumn("_salt", F.pmod(F.xxhash64("text_key", "pos"), F.col("_salts"))).drop("_salts")
    theirs = salted(theirs).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    met = own.join(theirs, ["print", "size", "_salt"]).filter(F.col("core") == F.col("_core"))
    left, right = _same(F.col("before"), F.col("_before")), _same(F.col("after"), F.col("_after"))
    spans = met.select("text_key", "items", (F.col("pos") - F.when(F.col("size") > 0, left).otherwise(0)).alias("lo"), (F.col("pos") + F.abs("size") + F.when(F.col("size") > 0, right).otherwise(0)).alias("hi"), "size")
    spans = spans.filter((F.col("size") < 0) | (F.col("hi") - F.col("lo") >= SPAN))
    hits = spans.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["hi"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(acc["end"], s["lo"]))).alias("n")),
    )
    hits = hits.select("text_key", covered["n"].alias("n_hit"), F.array_sort(F.transform("items", lambda i: i.cast("string"))).alias("items"))
    hits = stored(hits.join(texts.select("text_key", "copies"), "text_key"), "winnow-hits")
    found = hot_lookup(read.select("doc_id", "n_words", "text_key"), hits, "text_key", "copies", total)
    items_of = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return found.select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_key")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bs AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, k, g FROM (SELECT item_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g FROM bs)),
dk AS (SELECT doc_id, ws, k FROM d, (SELECT DISTINCT k FROM bs) WHERE len(ws) >= k),
dw AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS pos, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g FROM dk),
m AS (SELECT DISTINCT doc_id, pos, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
