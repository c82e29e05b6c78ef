import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerlark.llm import periodic_runs


def brute(w):
    """All runs by definition: for each period the maximal stretches, of which those with a smaller period go."""
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if len(x) >= max(24, 3 * q) and all(any(x[k] != x[k + p] for k in range(len(x) - p)) for p in range(1, q)):
                out.add((i, len(x), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rnd, most=200):
    w = []
    while rnd.random() < 0.85 and len(w) < most:
        kind = rnd.random()
        if kind < 0.5:
            p = [rnd.randint(0, rnd.choice([1, 2, 5, 30])) for _ in range(rnd.randint(1, 20))]
            w += (p * 30)[: rnd.randint(5, 90)]
        else:
            w += [rnd.randint(0, 3 if kind < 0.7 else 300) for _ in range(rnd.randint(1, 40))]
    return w


@pytest.mark.parametrize("seed", range(5))
def test_against_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        docs = [some_words(rnd) for _ in range(rnd.randint(1, 4))]
        assert periodic_runs.runs_of([np.array(d, np.int64) for d in docs]) == [brute(d) for d in docs]


def test_splitting_keeps_what_runs_need():
    # 9 is twice in all; 1 2 3 surround it, and after the split 4 is too rare on its side.
    w = np.array([1, 2, 3] * 10 + [9] + [5] * 30 + [4] + [5] * 3 + [9] + [4, 4], np.int64)
    starts, ends = periodic_runs.split_segments(w, np.array([0]), np.array([len(w)]))
    assert sorted(zip(starts.tolist(), ends.tolist(), strict=True)) == [(0, 30), (31, 61)]


def test_long_texts():
    w = np.tile(np.random.default_rng(0).permutation(7000), 4)
    assert periodic_runs.runs_of([w, np.zeros(100_000, np.int64)]) == [[(0, 28000, 7000)], [(0, 100_000, 1)]]


def test_operator_and_edge_cases(spark):
    rows = [(1, "a b " * 20 + "c", "x"), (2, None, "y"), (3, "", "z"), (3, " \t\n", "z"), (None, "q " * 24, "z"), (4, "x y " * 24, "z"), (5, "x " * 23, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(df).collect()}
    assert got == {(1, "a b c"): [(0, 40, 2)], (2, ""): [], (3, ""): [], (None, "q"): [(0, 24, 1)], (4, "x y"): [(0, 24, 1)], (5, " ".join("x" * 23)): []}
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, " ".join(map(str, some_words(rnd)))) for i in range(150)] + [(7, None), (8, ""), (9, "a " * 30), (9, "a " * 30), (None, "b c " * 12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()]
    want = []
    for doc_id, text in rows:
        w = (text or "").split(" ")
        w = [x for x in w if x]
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
        want.append((doc_id, len(runs), *four, *sha))
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r[1] for r in want) > 30
