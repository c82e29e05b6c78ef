import numpy as np
import pytest

from ledgerlark.llm import language

SCHEMA = "doc_id long, text string, lang string, score string, row int"
WORDS = {"en": "the house is near an old river and they walk with friends", "de": "das haus steht nahe dem alten fluss und sie gehen mit freunden", "ru": "дом стоит рядом со старой рекой и они гуляют вместе"}


def rows(n=60):
    rng = np.random.default_rng(0)
    return [(i, " ".join(rng.choice(WORDS[lang].split(), 25)), lang, "s", 1) for i, lang in enumerate(["en", "de", "ru"] * n)]


@pytest.fixture(scope="module")
def trained(spark):
    return language.train(spark.createDataFrame(rows(), SCHEMA))


def predict(spark, trained, texts, spans=False):
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], SCHEMA)
    return sorted(language.identified(df, trained, spans).collect(), key=lambda r: r["doc_id"])


def test_held_out_accuracy(spark, trained):
    own = rows()
    got = predict(spark, trained, [r[1] for r in own])
    assert np.mean([g["lang_pred"] == r[2] for g, r in zip(got, own)]) > 0.97


def test_accuracy_on_rows_that_were_not_learned(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(100), SCHEMA)
    found = language.identified(df, language.train(df)).filter(language._held_out(F.col("doc_id")))
    got = found.select("lang", "lang_pred").collect()
    assert len(got) > 60 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_same_results_as_a_plain_search(spark, trained):
    """Words by one pattern over the whole text, scores word by word, and the best path by its recurrence."""
    model = language.Model(*trained)
    rng = np.random.default_rng(5)
    vocabulary = [w for t in WORDS.values() for w in t.split()] + ["x", "Haus!", "old-river", "3rd", "дом,дом", "漢字"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 60))) + "\n" * int(rng.integers(0, 2)) for _ in range(80)]
    for text, got in zip(texts, predict(spark, trained, texts), strict=True):
        ws = [w for w in language._WORD.findall(text.lower()) if any(map(str.isalpha, w))]
        model.known, model.chunks = {}, {}
        if ws:
            model._learn(list(dict.fromkeys(ws)))
        s = [model.scores[model.known[w]].astype(float) for w in ws]
        best, back = [s[0]] if s else [], []
        for v in s[1:]:
            back.append([int(np.argmax([best[-1][y] - language.SWITCH * (y != x) for y in range(3)])) for x in range(3)])
            best.append(v + np.array([max(best[-1][y] - language.SWITCH * (y != x) for y in range(3)) for x in range(3)]))
        path = [int(np.argmax(best[-1]))] if s else []
        for b in reversed(back):
            path.append(b[path[-1]])
        letters = np.bincount(path[::-1], weights=[len(w) for w in ws], minlength=3) if s else np.zeros(3)
        if not s:
            assert got["lang_pred"] == "und"
            continue

        def worth(p, s=s):
            return sum(v[x] for v, x in zip(s, p, strict=True)) - language.SWITCH * sum(x != y for x, y in zip(p, p[1:], strict=False))

        # Words that score alike for all languages let paths tie: any of the best is one.
        assert abs(worth(model.paths(model.indices([text]))[0].tolist()) - worth(path[::-1])) < 1e-3
        if "漢字" not in text and np.sort(letters)[-1] - np.sort(letters)[-2] > 0:
            assert got["lang_pred"] == model.languages[int(letters.argmax())] and abs(got["score"] - letters.max() / letters.sum()) < 1e-9


def test_spans_of_a_mixed_text(spark, trained):
    a, b = WORDS["en"], WORDS["de"]
    (got,) = predict(spark, trained, [f"{a}. {a}! {b}; {b}"], spans=True)
    assert [s["lang"] for s in got["spans"]] == ["en", "de"]
    assert abs(got["spans"][0]["end"] - len(f"{a}. {a}")) < 12
    assert 0.4 < got["score"] < 0.65 and got["row"] == 1


def test_edge_cases(spark, trained):
    got = predict(spark, trained, [None, "", "123 %% 4²", "дом", "漢字", "the " * 50000, "THE HOUSE"])
    assert [r["lang_pred"] for r in got[:4]] == ["und", "und", "und", "ru"]
    assert got[4]["lang_pred"] in trained[0] and got[5]["lang_pred"] == got[6]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [r["readable"] for r in got[3:]] == [1.0, 0.0, 1.0, 1.0]


def test_without_labels_and_empty(spark):
    none = language.train(spark.createDataFrame([(1, "text", None, "", 1)], SCHEMA))
    assert [r["lang_pred"] for r in predict(spark, none, ["some text", None])] == ["und", "und"]
    assert language.identified(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_labels_of_held_out_rows_are_not_learned(spark):
    held = [(i, "zzz", "xx", "", 1) for i in range(300)]
    df = spark.createDataFrame(held, SCHEMA).filter(language._held_out(__import__("pyspark").sql.functions.col("doc_id")))
    assert df.count() > 50 and language.train(df)[0] == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    texts = [rng.normal(size=(n, 3)).astype(np.float32) * 4 for n in (1, 2, 5, 7, 7, 3)]
    for s, got in zip(texts, language.viterbi(texts, 3.0)):
        def worth(p, s=s):
            return sum(float(s[i, x]) for i, x in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:]))
        every = [[]]
        for _ in range(len(s)):
            every = [[*p, x] for p in every for x in range(3)]
        assert abs(worth(got.tolist()) - max(map(worth, every))) < 1e-4


def test_ties_go_to_the_language_that_sorts_first(spark, trained):
    en, de = WORDS["en"].split(), WORDS["de"].split()
    a, b = sum(map(len, en)), sum(map(len, de))
    text = " ".join(en * b + de * a)
    assert sum(map(len, text.split()[: len(en) * b])) == a * b
    got = predict(spark, trained, ["漢字 漢字", text, " ".join(de * a + en * b)])
    assert [r["lang_pred"] for r in got] == ["de"] * 3 and abs(got[1]["score"] - 0.5) < 0.02 and sorted(trained[0])[0] == "de"


def test_copies_are_learned_once(spark):
    """Equal rows share a lot, and still come in, once; they crowd no other text out."""
    copies = [(i, "kopie eins zwei drei", "de", "", 1) for i in range(3000)]
    others = [(10_000 + i, f"the copy {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", "en", "", 1) for i in range(100)]
    df = spark.createDataFrame(copies + others, SCHEMA)
    languages, grams, _ = language.train(df, per_language=1000)
    assert languages == ["de", "en"]
    k = languages.index("de")
    assert grams["^ei"][k] == 1 if "^ei" in grams else True
    assert grams["e"][k] == "kopie eins zwei drei".count("e")
    few = language.train(df, per_language=20)
    assert few[0] == ["de", "en"] and few[1]["e"][k] == "kopie eins zwei drei".count("e")


def test_naive_bayes_of_a_small_table(spark):
    """The scores of words, worked out from the definition."""
    import math
    from collections import Counter

    texts = {"x": ["ab ab", "ac"], "y": ["ba", "ca ca ba"]}
    ids = iter(i for i in range(1000) if __import__("zlib").crc32(str(i).encode()) % 3 != 1)
    trained = language.train(spark.createDataFrame([(next(ids), t, k, "", 1) for k, ts in texts.items() for t in ts], SCHEMA))
    model = language.Model(*trained)

    def grams(w):
        w2 = f"^{w}$"
        return [*w, *[w2[i : i + 2] for i in range(len(w2) - 1)], *[w2[i : i + 3] for i in range(len(w2) - 2)]]

    counts = {k: Counter(g for t in ts for w in t.split() for g in grams(w)) for k, ts in texts.items()}
    known = {g for g in counts["x"] | counts["y"] if counts["x"][g] + counts["y"][g] > 1}
    for w in ("ab", "ca", "zz"):
        model.indices([w])
        for i, k in enumerate(model.languages):
            want = 0.0
            for g in grams(w):
                kinds = [h for h in known if len(h) == len(g)]
                total = sum(counts[k][h] for h in kinds) + 0.5 * (len(kinds) + 1)
                want += math.log(((counts[k][g] if g in known else 0) + 0.5) / total) / 3
            assert abs(model.scores[model.known[w]][i] - want) < 1e-4
