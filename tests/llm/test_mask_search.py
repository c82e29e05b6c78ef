import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from ledgerlark.llm import mask_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    held = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for d, c in held:
            m, score = 75 + 25 * sum(c.values()) * n_docs // total, 0
            for w in words(text):
                if c[w]:
                    df = sum(1 for _, o in held if o[w])
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item_id, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:20])]
    return sorted(out, key=repr)


def search(spark, docs, items, **more):
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r) for r in mask_search.ranked_documents(a, b, **more).collect()], key=repr)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Éa", "ß", "x1", "A", "ÀÉ"]
    some = lambda k: " ".join(rnd.choices(vocabulary, [1 / (1 + i) for i in range(len(vocabulary))], k=k))
    docs = [(rnd.randrange(200), some(rnd.randint(0, 60))) for _ in range(n)] + [(None, "w1 w2"), (5, None), (6, ""), (7, "---"), (8, "w3, W3;w3\x7fw4")]
    items = [(i, some(rnd.randint(1, 12))) for i in range(12)] + [(50, None), (51, ""), (None, "w5 w6"), (52, "none of these"), (0, "w9 w9 w9"), (0, "w9 w9 w9")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus(1)
    assert search(spark, docs, items) == brute(docs, items)


def test_blocks_and_small_slices(spark, monkeypatch):
    docs, items = corpus(2)
    want = brute(docs, items)
    assert search(spark, docs, items, block_terms=60) == want
    # Workers get their own copies of modules, so small slices are tried here.
    monkeypatch.setattr(mask_search, "MASK_CELLS", 8)
    number, counted = {}, [(i, Counter(words(t))) for i, t in dict.fromkeys(items)]
    held = [(np.array([number.setdefault(w, len(number)) for w in c], np.int64), np.array(list(c.values()), np.int64)) for _, c in counted]
    rows = [(d, Counter(words(t))) for d, t in docs if words(t) and d is not None]
    n_docs, total = len(rows), sum(sum(c.values()) for _, c in rows)
    weights = np.array([mask_search.weight(n_docs, sum(1 for _, c in rows if c[w])) for w in number], np.int64)
    best = mask_search.Best(len(held))
    for a in range(0, len(rows), 50):
        some = rows[a : a + 50]
        flat = sorted((number[w], i, c[w]) for i, (_, c) in enumerate(some) for w in c if w in number)
        t, at, tf = (np.array(x, np.int64) for x in zip(*flat, strict=True))
        n = np.array([sum(c.values()) for _, c in some], np.int64)
        mask_search.search_slice(best, held, weights, 75 + 25 * n * n_docs // total, np.array([d for d, _ in some]), np.searchsorted(t, np.arange(len(number) + 1)), at, tf)
    got = [(i, r + 1, d, s) for (i, _), ids, scores in zip(counted, best.ids, best.scores, strict=True) for r, (d, s) in enumerate(zip(ids.tolist(), scores.tolist(), strict=True))]
    assert sorted(got, key=repr) == brute([(d, t) for d, t in docs if d is not None], items)


def test_ties_and_repeated_rows(spark):
    docs = [(i, "tie word") for i in range(40, 0, -1)] + [(3, "tie word")] * 2 + [(99, "other")] * 60
    got = search(spark, docs, [(1, "tie")])
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [1, 2, 3, 3, 3, *range(4, 19)] and got == brute(docs, [(1, "tie")])


def test_empty_tables(spark):
    assert search(spark, [], [(1, "a")]) == [] and search(spark, [(1, "a")], []) == [] and search(spark, [(1, None)], [(1, "a")]) == []


def test_masks_stop_early():
    """A slice whose masks can't reach the 20th score so far is passed over; groups come by descending maximum."""
    best = mask_search.Best(1)
    best.add(0, np.full(20, 10**12), np.arange(20))
    args = (np.array([10]), np.array([75]), np.array([5]), np.array([0, 1]), np.array([0]), np.array([3]))
    mask_search.search_slice(best, [(np.array([0]), np.array([1]))], *args)
    assert best.scores[0].tolist() == [10**12] * 20
    held, masks, group = mask_search.mask_groups(np.array([0, 1, 0, 1, 1]), np.array([4, 4, 7, 9, 2]), 2)
    assert held.tolist() == [2, 4, 7, 9] and sorted(map(tuple, masks.tolist())) == [(False, True), (True, False), (True, True)] and group[0] == group[3] != group[1]


def test_query_same_as_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({mask_search.ORACLE_SQL})").fetchall()
    got = [tuple(r) for r in mask_search.op11_mask_search(spark, "/root/testdata/sf0.001").select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
