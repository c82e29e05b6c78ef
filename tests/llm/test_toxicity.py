import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerlark.llm import toxicity

ABUSE = ["idiot", "moron", "zorbel", "zorban", "kwaxo"]


def table(n=600, seed=1):
    rnd = random.Random(seed)
    words = [a + b for a in ("ba", "de", "fi", "go", "hu", "kel") for b in ("lo", "mi", "na", "ro", "sta", "tu")]
    docs, labels = [], []
    for i in range(n):
        w = rnd.choices(words, k=rnd.randint(20, 300))
        toxic = int(i % 8 == 0)
        if toxic:
            for _ in range(max(2, len(w) // 40)):
                w.insert(rnd.randrange(len(w)), rnd.choice(ABUSE[:2] if i % 16 else ABUSE[2:]))
        docs.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, toxic))
    return docs, labels


def scored(spark, docs, labels):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(labels, "doc_id long, toxic int")
    return toxicity.scored(a, b)


def test_held_out_accuracy(spark):
    docs, labels = table()
    got = {r.doc_id: r.score for r in scored(spark, docs, labels).collect()}
    learned = {d for d, _ in labels if zlib.crc32(str(d).encode()) % 5}
    held_out = [i for i in range(600) if i not in learned]
    assert len(held_out) > 200 and all((got[i] >= 0.5) == (i % 8 == 0) for i in held_out)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = table(200)
    flipped = [(d, t if zlib.crc32(str(d).encode()) % 5 else 1 - t) for d, t in labels]
    one, two = ({r.doc_id: round(r.score, 9) for r in scored(spark, docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_edge_cases(spark):
    docs, labels = table(200)
    extra = [(None, "you are an idiot and a moron"), (900, None), (901, ""), (902, "idiot moron"), (902, "idiot moron"), (903, "idiot " * 5000), (904, "balo " * 30000 + "idiot")]
    got = [(r.doc_id, r.score) for r in scored(spark, docs + extra, [*labels, (900, 1), (None, 1), (3, None), (5, 0), (5, 1)]).collect()]
    by = dict(got)
    assert len(got) == 207 and by[900] == by[901] < 0.5 < min(by[None], by[902], by[903])
    assert sum(d == 902 for d, _ in got) == 2 and all(0 <= s <= 1 for _, s in got)
    assert scored(spark, [], labels).count() == 0
    # Without labels lexicons and patterns alone vote.
    alone = {r.doc_id: r.score for r in scored(spark, extra[:4], []).collect()}
    assert alone[902] > alone[901]


def test_mining_finds_stems_and_refutes(spark):
    docs, labels = table()
    a = spark.createDataFrame([(i, f"kill {t}" if i % 2 else t) for i, t in docs], "doc_id long, text string")
    terms, refuted = toxicity.mined(a, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"idiot", "moron", "zorb*"} & set(terms) and any(t.startswith("zor") for t in terms) and refuted == ["kill"] and not any("ba" == t[:2] for t in terms)


def test_terms_are_taken_for_open_documents():
    held = [{0, 1}, {0, 1}, {0, 1}, {0, 1}, {2}, {2}, {2}, {2}, {3}, {3}]
    toxic = [1] * 8 + [0] * 2
    assert toxicity.chosen(held, toxic, 4, (8, 2), cover=1, least=2) == [0, 2]
    assert toxicity.chosen(held, toxic, 4, (8, 2), cover=2, least=2) == [0, 1, 2]
    # An impure term that covers most goes again where pure ones cover its documents.
    held = [{0, 1, 2}] * 20 + [{0, 3, 4}] * 20 + [{0}] * 8
    toxic = [1] * 40 + [0] * 8
    assert toxicity.chosen(held, toxic, 5, (40, 60)) == [1, 2, 3, 4]
    assert toxicity.chosen([{0, 1}] * 40 + [{0}] * 8, toxic, 2, (40, 60)) == [1, 0]


def test_label_model_against_plain_expectation_maximisation(spark):
    rnd = np.random.default_rng(0)
    n, rates = 4000, ((0.7, 0.02), (0.5, 0.05), (0.6, 0.01))
    y = rnd.random(n) < 0.2
    rows = {}
    for i in range(n):
        fired = tuple(v * 4 + 2 for v, (on, off) in enumerate(rates) if rnd.random() < (on if y[i] else off))
        rows[fired] = rows.get(fired, 0) + 1
    sets = spark.createDataFrame([(list(k), v) for k, v in rows.items()], "fired array<int>, n long")
    on, off = np.full((3, 3), 0.1), np.full((3, 3), 0.01)
    _, _, got = toxicity.label_model(sets, 3, on, off, 0.1)

    def fixed(hits, size, rate):
        return max((hits + 10 * rate / 3) / (size + 10), 1e-7)

    p1, p0, prior = [[0.1] * 3 for _ in range(3)], [[0.01] * 3 for _ in range(3)], 0.1
    for _ in range(toxicity.ROUNDS):
        post = {}
        for k in rows:
            z = math.log(prior / (1 - prior))
            for v in range(3):
                if v * 4 + 2 in k:
                    z += math.log(p1[v][1] / p0[v][1])
                else:
                    z += math.log((1 - sum(p1[v])) / (1 - sum(p0[v])))
            post[k] = 1 / (1 + math.exp(-z))
        toxic = sum(post[k] * m for k, m in rows.items())
        prior = min((toxic + 10 * toxicity.SHARE) / (n + 10), 0.5)
        a = [sum(post[k] * m for k, m in rows.items() if v * 4 + 2 in k) for v in range(3)]
        b = [sum(m for k, m in rows.items() if v * 4 + 2 in k) - a[v] for v in range(3)]
        p1 = [[fixed(0, toxic, toxicity.FIRES), fixed(a[v], toxic, toxicity.FIRES), fixed(0, toxic, toxicity.FIRES)] for v in range(3)]
        p0 = [[fixed(0, n - toxic, toxicity.FALSE), fixed(b[v], n - toxic, toxicity.FALSE), fixed(0, n - toxic, toxicity.FALSE)] for v in range(3)]
    assert abs(got["prior"] - prior) < 1e-9 and np.allclose(got["on"], p1) and np.allclose(got["off"], p0)
    assert abs(got["prior"] - 0.2) < 0.03 and abs(got["on"][0, 1] - 0.7) < 0.07


def test_voters_that_always_agree_count_less(spark):
    sets = spark.createDataFrame([([2, 6], 100), ([10], 60), ([2, 6, 10], 60), ([], 1000)], "fired array<int>, n long")
    _, _, got = toxicity.label_model(sets, 3, np.full((3, 3), 0.15), np.full((3, 3), 0.01), 0.1)
    assert got["correlation"][0, 1] > 0.4 > got["correlation"][0, 2]


def test_query(spark, tmp_path):
    docs, labels = table(200)
    spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, fired string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 0, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = toxicity.op13_weak_toxicity(spark, str(tmp_path))
    rows = df.collect()
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows) and len(rows) == 200
    assert df.filter(F.col("score").isNull()).count() == 0
