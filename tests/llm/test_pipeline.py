import re

import corpus_pipeline
from ledgerlark.llm._common import hot_lookup, ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _drop string"


def story(i):
    name = "".join(chr(97 + int(d)) for d in str(i * 7919 + 13))
    return "\n".join(f"The {w} {name}{w} goes {w}{name} to {name}x{w} and {w}y{name} z{name}{w}" for w in ("baker", "miller", "sailor"))


def docs(spark):
    rows = [(i, f"Posted by the editors of this site\n{story(i)}", "en", "s", 1, "d") for i in range(10)]
    rows += [(20, story(3) + " more", "en", "s", 1, "d"), (21, None, None, None, None, None), (22, "123 456", "en", "s", 1, "d"), (23, "", "en", "s", 1, "d")]
    rows += [(24, "Before it. One two three four five six seven eight nine ten eleven twelve. After it came more words", "en", "s", 1, "d"), (9, rows[9][1], "en", "s", 1, "d")]
    # One id with two texts, an id of null twice, a text in a script that nothing teaches, and a very long text.
    rows += [(30, story(30), "en", "s", 1, "d"), (30, story(31), None, "s", 1, "d"), (None, story(32), "en", "s", 1, "d"), (None, story(33), "en", "s", 1, "d"), (34, "漢字 かな " * 9, None, "s", 1, "d")]
    rows += [(35, " ".join(f"long{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(15000)), "en", "s", 1, "d")]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_take_effect(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = docs(spark), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, str(tmp_path)), "t")
        assert now.columns == docs(spark).columns
        kept.append({r.doc_id: r.text for r in now.collect()})
    clean = {*range(10), 30, None, 35}
    assert set(kept[0]) == {*clean, 20, 24}
    assert all(t == story(i) for i, t in kept[1].items() if i in range(10))
    assert set(kept[2]) == {*clean, 24} and now.count() == len(kept[3]) + 2
    assert set(kept[3]) == clean
    texts = {(r.doc_id, r.text, r.lang) for r in now.collect()}
    assert {(30, story(30), "en"), (30, story(31), "en"), (None, story(32), "en"), (None, story(33), "en")} <= texts
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == set(kept[3])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_hot_lookup_and_ranks(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 10}") for i in range(3000)], "i long, k string")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "upper(k) AS u")
    got = hot_lookup(left, right.filter("k <> 'k4'"), "k", "n", 3000).collect()
    assert len(got) == 3000 and all(r.u == (None if r.k == "k4" else r.k.upper()) for r in got)
    numbers = ranked(left, ["k"], ["i"], "r").collect()
    for k in {r.k for r in numbers}:
        own = sorted(r.r for r in numbers if r.k == k)
        assert own == list(range(len(own)))


def test_no_import_guard_in_the_pipeline():
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"\btry:|ImportError", source)
