import numpy as np

from ledgerlark.operators import retrieval


def test_nearest_vectors_in_bounded_steps(spark, monkeypatch):
    # Before, a whole batch was compared with a whole block of queries at once, and sorted in full.
    monkeypatch.setattr(retrieval, "QUERY_STEP", 3)
    monkeypatch.setattr(retrieval, "ROW_STEP", 7)
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (60, 3)).astype(float)
    v[~v.any(axis=1)] = 1
    v[0] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    for threshold in (-1.0, 0.7):
        out = retrieval.cosine_topk(rows.repartition(2), rows.filter("id < 9").withColumnRenamed("id", "query_id"), 4, threshold)
        got = {(r["query_id"], r["rank"]): round(r["score"], 9) for r in out.collect()}
        unit = v[1:] / np.linalg.norm(v[1:], axis=1, keepdims=True)
        want = {}
        for q in range(1, 9):
            best = np.sort(unit @ unit[q - 1])[::-1][:4]
            want.update({(q, i + 1): round(s, 9) for i, s in enumerate(best) if s >= threshold})
        assert got == want


def test_the_best_are_kept_by_score_and_id():
    rng = np.random.default_rng(2)
    score, names = rng.integers(0, 4, (5, 40)).astype(float), rng.permutation(40)
    scores, ids = np.full((5, 3), -np.inf), np.full((5, 3), np.iinfo(np.int64).max)
    for at in range(0, 40, 8):
        retrieval._keep_best(score[:, at : at + 8], names[at : at + 8], scores, ids, 1.0)
    for q in range(5):
        want = sorted((-s, n) for s, n in zip(score[q], names) if s >= 1)[:3]
        assert [(-s, n) for s, n in zip(scores[q], ids[q])] == want
