import numpy as np
from pyspark.sql import functions as F

from ledgerlark.llm import onebit

SCHEMA = "vec_id long, embedding array<float>, label int, score string, id string"


def brute(rows, k=5):
    v = {i: np.array(e, float) for i, e in rows}
    out = []
    for q in sorted(i for i in v if i % 50 == 0):
        ids = [i for i in v if i != q]
        s = onebit.cosines(np.array([v[q]] * len(ids)), np.array([v[i] for i in ids]))
        best = sorted(zip(-s, ids))[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(best)]
    return out


def found(spark, df):
    return sorted(tuple(r) for r in onebit.search(df, "vec_id", "embedding", lambda i: F.pmod(i, F.lit(50)) == 0).select("query_id", "rank", "id", "score").collect())


def test_same_as_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(24).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 440)]  # a common vector
    df = spark.createDataFrame([(*r, 0, "s", "x") for r in rows], SCHEMA)
    assert found(spark, df) == brute(rows)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert [(q, r, i) for q, r, i, _ in found(spark, df)] == [(0, 1, 1), (0, 2, 9)]


def test_repeated_rows_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5])]
    got = found(spark, spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA))
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 1)]
    assert found(spark, spark.createDataFrame([], SCHEMA)) == []


def test_the_bound_holds():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((4000, 64))
    o = onebit._unit(v) @ onebit.rotation(64).T
    signs = np.where(o > 0, 1, -1) / 8
    scalar = (o * signs).sum(axis=1)
    q = o[0]
    error = onebit.EPSILON * np.sqrt(1 - scalar**2) / scalar / np.sqrt(63)
    assert (np.abs(signs @ q / scalar - o @ q) <= error).mean() > 0.999


def test_very_large_and_small_components(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16))
    scale = np.where(np.arange(60) % 3 == 0, 1e200, np.where(np.arange(60) % 3 == 1, 1e-200, 1.0))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(base, scale))]
    got = onebit.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", lambda i: i % 10 == 0).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        want = [i for i in np.argsort(-(unit @ unit[q])) if i != q][:5]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_inner_products_are_those_of_the_signs():
    rng = np.random.default_rng(9)
    for d in (5, 8, 64, 70):
        turned, o = rng.normal(size=(7, d)).astype(np.float32), rng.normal(size=(30, d))
        got = onebit.inner_products(turned, np.packbits(o > 0, axis=1))
        assert np.allclose(got, turned @ np.where(o > 0, 1, -1).T / np.sqrt(d), atol=1e-4)


def test_few_vectors_are_compared_exactly(monkeypatch):
    # Before, the bounds let nearly every vector of 64 dimensions through to the exact comparison.
    rng = np.random.default_rng(8)
    v = rng.standard_normal((3000, 64))
    o = onebit._unit(v) @ onebit.rotation(64).T
    codes, scalars = np.packbits(o > 0, axis=1), np.abs(o).sum(axis=1) / 8
    seen, exact = [], onebit.cosines
    monkeypatch.setattr(onebit, "cosines", lambda a, b: seen.append(len(a)) or exact(a, b))
    ids = np.arange(3000)
    got = {q: list(i) for q, i, _ in onebit.search_block(v[:300], ids[:300], v, ids, codes, scalars, 5)}
    assert sum(seen) < 300 * 10
    unit = onebit._unit(v)
    score = unit[:300] @ unit.T
    score[ids[:300], ids[:300]] = -2
    assert got == {q: list(np.argsort(-score[q], kind="stable")[:5]) for q in range(300)}
