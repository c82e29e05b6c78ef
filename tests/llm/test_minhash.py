import numpy as np
from pyspark.sql import functions as F

from ledgerlark.llm import minhash
from ledgerlark.llm._words import shingle_set

SCHEMA = "doc_id long, text string, bands string, component string"


def brute(rows):
    sets = {i: set(shingle_set(t, 5).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


def run(spark, rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame([(*r, "b", "c") for r in rows], SCHEMA)).collect()}


def edited(words, n, rng):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"e{rng.integers(1e9)}"
    return " ".join(words)


def test_same_components_as_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for group in range(6):
        base = [f"w{rng.integers(5000)}" for _ in range(120)]
        rows += [(len(rows) + k, edited(base, int(rng.integers(0, 9)), rng)) for k in range(25)]
    rows += [(len(rows) + k, " ".join(f"w{rng.integers(5000)}" for _ in range(60))) for k in range(40)]
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), t) for i, t in rows]
    assert run(spark, rows) == brute(rows)


def test_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, edited(base, int(rng.integers(1, 8)), rng)) for i in range(70)]
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "a b c d e"), (8, "x " * 20000), (9, "X " * 100)]
    got = run(spark, rows)
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (1, 8)}
    many = minhash.near_duplicates(spark.createDataFrame([(1, "p q r", "", ""), (1, "p q r", "", ""), (None, "p q r", "", "")], SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept, r.first) for r in many) == [(False, 1, True, True), (False, 1, True, True), (True, 1, False, False)]


def test_empty(spark):
    assert run(spark, []) == {}


def test_estimate_follows_the_true_similarity(spark):
    rng = np.random.default_rng(4)
    errors = []
    for share in (0.5, 0.75, 0.9):
        n = 400
        common = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in range(2))
        x, y = (minhash._packed(minhash._minima(s)).tolist() for s in (a, b))
        got = spark.createDataFrame([(x, y)], "x array<long>, y array<long>").select(minhash.similarity(F.col("x"), F.col("y"))).first()[0]
        errors.append(abs(got - share))
    assert max(errors) < 0.16


def test_ids_of_several_texts_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " more"), (None, a), (None, c), (None, c + " more")]
    got = minhash.near_duplicates(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).join(spark.createDataFrame(rows, "i long, text string").select(F.md5(F.col("text").cast("binary")).alias("text_key"), "text").distinct(), "text_key").collect()
    assert sorted((r.text[0], r.text.endswith("more"), r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        ("a", False, 0, 1, False), ("a", False, 1, 1, True), ("b", False, 1, 1, True), ("b", True, 2, 1, False), ("c", False, 0, 0, True), ("c", True, 0, 0, True)]
    assert sorted(r.text[0] for r in got if r.first) == ["a", "b", "c"]


def test_recall_at_the_threshold(spark):
    """Pairs of exactly 0.75 to 0.8 similarity, 300 of them: all are found."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(300):
        n = 84 + int(rng.integers(0, 4))
        base = [f"p{k}w{i}" for i in range(n)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[: n - 10], *(f"q{k}x{i}" for i in range(10))]))]
    want, got = brute_pairs(rows), run(spark, rows)
    assert sum(want) > 200 and [got[2 * k + 1][1] == 2 * k for k in range(300)] == want


def brute_pairs(rows):
    sets = [set(shingle_set(t, 5).tolist()) for _, t in rows]
    return [100 * len(a & b) >= 75 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
