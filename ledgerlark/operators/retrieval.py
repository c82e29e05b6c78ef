"""Retrieval for a table of queries: BM25, cosine, rank fusion, sections of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



K1, B = 1.5, 0.75
#: The constant of reciprocal rank fusion.
FUSION = 60
#: Queries of a block that is sent to every task; queries and rows that a task compares at once.
QUERY_BLOCK = 4096
QUERY_STEP, ROW_STEP = 256, 2048


def bm25(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: the k best of corpus (id, text) for queries (query_id, text); ties to the smaller id."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([0-9a-z가-힣]{2,})"), F.lit(1))
    # The words are made before they are exploded; beside the explode they would be made for each of its rows.
    split = corpus.select("id", words.alias("words"), F.size(words).alias("dl"))
    terms = split.select("id", "dl", F.explode("words").alias("term"))
    postings = terms.groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    asked = queries.select("query_id", F.explode(F.array_distinct(words)).alias("term"))
    stats = split.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    # Only postings of terms that are asked for go on.
    postings = postings.join(asked.select("term").distinct(), "term", "left_semi")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # One row of totals.
    weighted = postings.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = asked.join(weighted.select("term", "id", weight.alias("w")), "term").groupBy("query_id", "id").agg(F.sum("w").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _comparable(rows: DataFrame) -> DataFrame:
    v = F.col("vector")
    return rows.filter(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0))


def _keep_best(score: np.ndarray, own: np.ndarray, scores: np.ndarray, ids: np.ndarray, threshold: float) -> None:
    """Puts what is among a query's best into its row of scores and ids, best first, equal scores by id; score has a row for each query, own the ids of its columns."""
    k = scores.shape[1]
    least = np.maximum(scores[:, -1], threshold)
    if score.shape[1] > k and not np.isfinite(scores[:, -1]).all():
        least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
    at, column = np.nonzero(score >= least[:, None])
    if not len(at):
        return
    hit = np.unique(at)
    query = np.concatenate([at, np.repeat(hit, k)])
    value, name = np.concatenate([score[at, column], scores[hit].ravel()]), np.concatenate([own[column], ids[hit].ravel()])
    order = np.lexsort((name, -value, query))
    # A hit query has k rows at least, the empty places of before included.
    starts = np.searchsorted(query[order], hit)
    best = order[starts[:, None] + np.arange(k)]
    scores[hit], ids[hit] = value[best], name[best]


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = -1.0) -> DataFrame:
    """query_id, rank, id, score: the k nearest of vectors (id, vector) for queries (query_id, vector) with at least the threshold.

    Queries go to every task in blocks of QUERY_BLOCK, as many passes as there are blocks; each task keeps its k best of a query
    and compares QUERY_STEP queries with ROW_STEP rows at once, so its memory doesn't grow with the input.
    Equal scores go to the smaller id. Vectors that are null, zero or hold null or non-finite components take no part.
    """
    vectors, queries = _comparable(vectors), _comparable(queries)
    spark = vectors.sparkSession
    blocks = -(-queries.count() // QUERY_BLOCK)
    found = None
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if not own.num_rows:
            continue
        q = np.array(own.column("vector").to_pylist(), np.float64)
        shared = spark.sparkContext.broadcast((own.column("query_id").to_numpy(), q / np.linalg.norm(q, axis=1, keepdims=True)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, unit = shared.value
            scores, ids = np.full((len(names), k), -np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
            for batch in batches:
                for at in range(0, batch.num_rows, ROW_STEP):
                    some = batch.slice(at, ROW_STEP)
                    v = np.asarray(some.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(some.num_rows, -1)
                    v, own = v / np.linalg.norm(v, axis=1, keepdims=True), some.column(0).to_numpy()
                    for q in range(0, len(names), QUERY_STEP):
                        _keep_best(unit[q : q + QUERY_STEP] @ v.T, own, scores[q : q + QUERY_STEP], ids[q : q + QUERY_STEP], threshold)
            ok = scores > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ok.sum(axis=1))), pa.array(ids[ok]), pa.array(scores[ok])], ["query_id", "id", "score"])

        part = vectors.select("id", "vector").mapInArrow(run, "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fused(*ranked: DataFrame, weights: tuple[float, ...] = (0.5, 0.5), k: int = 10) -> DataFrame:
    """Weighted reciprocal ranks of several results (query_id, id, rank), summed."""
    parts = [r.select("query_id", "id", (F.lit(w) / (FUSION + F.col("rank"))).alias("w")) for r, w in zip(ranked, weights, strict=True)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    scores = union.groupBy("query_id", "id").agg(F.sum("w").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sections(corpus: DataFrame, heading: str) -> DataFrame:
    """id, section (0 before the first heading), title, lines: a document's lines from each heading to the next."""
    lines = corpus.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("is_head", F.rlike("line", F.lit(heading)))
    w = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines.withColumn("section", F.sum(F.col("is_head").cast("int")).over(w))
    return numbered.groupBy("id", "section").agg(F.min(F.when(F.col("is_head"), F.col("line"))).alias("title"), F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


def distinct_chunks(chunks: DataFrame, size: int = 120) -> DataFrame:
    """Chunks (source, id, text) once for each source and first characters, the smallest id."""
    return chunks.groupBy("source", F.substring("text", 1, size).alias("head")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def with_fallback(first: DataFrame, queries: DataFrame, broader) -> DataFrame:
    """Results of ``first``, and of ``broader`` (a function of queries) for the queries that had none."""
    none = queries.join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.withColumn("fallback", F.lit(False)).unionByName(broader(none).withColumn("fallback", F.lit(True)))
