"""Nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to unit length and rotated by one random rotation for all; its code is the signs of the coordinates, packed. The inner
product of the code's own unit vector with the rotated one is its correction scalar. A query, rotated but not coded,
has an unbiased estimate of its cosine with every coded vector, and the scalar bounds the estimate's error
(proportional to sqrt(1 - scalar ** 2) / scalar / sqrt(dimensions)). In each block of vectors a query reranks, on the original
vectors in double precision, those whose upper bound reaches the k-th best cosine of a few with the best estimates; the blocks' best are merged.

Vectors are dealt to blocks of about BLOCK rows by a hash of their id, queries to blocks of QUERY_BLOCK; every block of queries meets
every block of vectors in a task of its own, so memory doesn't grow with the input.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, as do those of
another length than most have (of equally common lengths the shorter) and those without an id. Equal scores go to the smaller id. Repeated rows are
candidates each; an id in several rows is one query and isn't a candidate for itself. A query with fewer than k candidates gets all of them. An
empty table gives no rows. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import read_table, stored

K = 5
#: Vectors, and queries, that meet in one task at most, about; of few vectors a task has no fewer than LEAST_BLOCK.
BLOCK = 32768
QUERY_BLOCK = 16384
LEAST_BLOCK = 4096
#: Widths of the error bound; the estimate is farther off in about one of 1,000,000 cases.
EPSILON = 5.0
#: Queries that are estimated and reranked together, and how many times k rows are compared for a floor.
STEP = 128
FIRST = 4
SEED = 7


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def taking_part(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and vector (array of double) of the rows that can be compared."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).filter(F.col("id").isNotNull() & v.isNotNull())
    rows = rows.filter((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return rows.filter(F.exists("vector", lambda x: x != 0))


def coded(rows: DataFrame, dimensions: int) -> DataFrame:
    """id, vector, code (packed signs) and scalar: the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dimensions)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), dimensions)
            o = _unit(v) @ turn.T
            codes = np.packbits(o > 0, axis=1)
            scalar = np.abs(o).sum(axis=1) / np.sqrt(dimensions)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scalar)], ["id", "vector", "code", "scalar"])

    return rows.filter(F.size("vector") == dimensions).select("id", "vector").mapInArrow(run, "id long, vector array<double>, code binary, scalar double")


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimensions)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; components are added in their order, so that equal vectors have equal scores in any block."""
    # A power of two is taken off each row first, which changes no digit and keeps very large and small components in range.
    a, b = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (a, b))
    ab, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        ab += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return ab / (np.sqrt(aa) * np.sqrt(bb))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


#: The signs that each byte of a code stands for, as -1 and 1.
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def inner_products(turned: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of each rotated query with each code's unit vector: the signs of the packed bits, multiplied as one matrix."""
    dimensions = turned.shape[1]
    signs = _SIGNS[codes].reshape(len(codes), -1)[:, :dimensions]
    return (turned / np.float32(np.sqrt(dimensions))).astype(np.float32) @ signs.T


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, scalars: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id, and ids and scores of its k best in the block.

    The k-th best cosine of a few with the best estimates is a floor; whose upper bound reaches it is reranked. What some query of STEP asks for is reranked in one product of
    matrices, and only what is among a query's k best by it, rounding apart, is compared exactly.
    """
    n, dimensions = vectors.shape
    unit, asked = _unit(vectors), _unit(queries)
    turned = (asked @ rotation(dimensions).T).astype(np.float32)
    error = (EPSILON * np.sqrt(np.maximum(0, 1 - scalars**2)) / scalars / np.sqrt(max(1, dimensions - 1))).astype(np.float32)
    first = min(n, FIRST * k)
    for i in range(0, len(queries), STEP):
        own = asked[i : i + STEP]
        estimates = inner_products(turned[i : i + STEP], codes) / scalars.astype(np.float32)
        estimates[query_ids[i : i + STEP, None] == ids] = -np.inf
        seeds = np.argpartition(estimates, n - first, axis=1)[:, n - first :]
        known = np.where(np.take_along_axis(estimates, seeds, 1) > -np.inf, np.einsum("qd,qsd->qs", own, unit[seeds]), -np.inf)
        floor = np.partition(known, first - k, axis=1)[:, first - k, None] if first >= k else -np.inf
        near = (estimates + error >= floor - 1e-5) & (estimates > -np.inf)
        some = np.flatnonzero(near.any(axis=0))
        if not len(some):
            continue
        score = np.where(near[:, some], own @ unit[some].T, -np.inf)
        least = np.partition(score, -k, axis=1)[:, -k, None] - 1e-9 if len(some) > k else -np.inf
        for q, hit in enumerate((score >= least) & (score > -np.inf), i):
            found = some[hit]
            if len(found):
                exact = cosines(np.broadcast_to(queries[q], (len(found), dimensions)), vectors[found])
                best = _best(exact, ids[found], k)
                yield int(query_ids[q]), ids[found][best], exact[best]


def nearest(index: DataFrame, queries: DataFrame, dimensions: int, rows: int, n_queries: int, k: int = K) -> DataFrame:
    """query_id, rank, id, score: the k nearest of the index (coded()) for each of queries (id, vector)."""
    tasks = index.sparkSession.sparkContext.defaultParallelism
    blocks, query_blocks = max(1, -(-rows // BLOCK), min(tasks, -(-rows // LEAST_BLOCK))), max(1, -(-n_queries // QUERY_BLOCK))

    def block(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    right = index.withColumns({"block": block(blocks), "query_block": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))})
    left = queries.select("id", "vector").withColumns({"query_block": block(query_blocks), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if asked.num_rows and there.num_rows:
            asked, there = asked.combine_chunks(), there.combine_chunks()
            vectors = _matrix(there.column("vector").combine_chunks(), dimensions)
            codes = np.frombuffer(b"".join(there.column("code").to_pylist()), np.uint8).reshape(len(vectors), -1)
            found = search_block(
                _matrix(asked.column("vector").combine_chunks(), dimensions), asked.column("id").to_numpy(), vectors, there.column("id").to_numpy(), codes, there.column("scalar").to_numpy(), k
            )
            for query, ids, scores in found:
                out["query_id"] += [query] * len(ids)
                out["id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pa.table(out, pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    keys = ["block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, id long, score double")
    # Spark keeps k rows of each query in every task before they are shuffled.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def search(vectors: DataFrame, id_column: str, column: str, query_filter, k: int = K) -> DataFrame:
    rows = stored(taking_part(vectors, id_column, column), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimensions = sizes["d"] if sizes else 1
    index = stored(coded(rows, dimensions), "vector-index")
    queries = index.filter(query_filter(F.col("id"))).dropDuplicates(["id"])
    return nearest(index, queries, dimensions, index.count(), queries.count(), k)


def op1_onebit_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: F.pmod(i, F.lit(50)) == 0)
    return found.withColumnRenamed("id", "vec_id")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
g AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS l FROM g),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.l * c.l) AS score
      FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
