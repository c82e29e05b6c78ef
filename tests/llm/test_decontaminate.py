import hashlib
import re

import numpy as np

from ledgerlark.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string, seeds string, items string", "item_id long, text string, print string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, s in items:
            v = words(s)
            k = min(10, len(v))
            windows = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for j in range(len(w) - k + 1):
                if k and tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    if i is not None:
                        found.add(str(i))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def run(spark, docs, items):
    a = spark.createDataFrame([(*r, "s", "i") for r in docs], DOCS)
    b = spark.createDataFrame([(*r, "p") for r in items], ITEMS)
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contaminated(a, b).collect()}


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"v{i}" for i in range(40)]
    def text(n):
        return " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(rng.integers(10, 60)))) for i in range(30)] + [(40, "v1 v2 v3"), (41, "v4"), (42, "v1 v2 v3 v4 v5"), (43, ""), (44, None), (45, "..."), (None, "v7 v8")]
    items += [(46, items[0][1]), (46, items[0][1])]
    docs = []
    for i in range(80):
        cut = words(items[int(rng.integers(30))][1])
        n = int(rng.integers(5, 15))
        at = int(rng.integers(0, max(1, len(cut) - n)))
        docs.append((i, f"{text(30)}, {' '.join(cut[at : at + n]).upper()}! {text(30)}"))
    docs += [(100, None), (101, ""), (102, "é" * 3), (103, "same " * 30), (104, items[3][1]), (105, items[3][1]), (105, items[3][1]), (106, "w " * 30000 + items[2][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_repeated_words_and_every_offset(spark):
    item = " ".join(f"k{i}" for i in range(30))
    v = item.split()
    docs = [(i, " ".join(["x"] * (i % 7) + v[i : i + 10] + ["y"] * 5)) for i in range(21)] + [(50 + i, " ".join(["x"] * 3 + v[i : i + 9] + ["y"] * 5)) for i in range(21)]
    items = [(1, item), (2, "a " * 12)]
    docs += [(90, "a " * 9), (91, "a " * 10), (92, "b a " * 10)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == {}
    assert run(spark, [(1, "a b c")], []) == brute([(1, "a b c")], [])
