import zlib
from collections import Counter

from pyspark.sql import functions as F

from ledgerlark.llm import sharding

SCHEMA = "doc_id long, hub string, shard string, slot string"


def run(spark, rows, n=6):
    df = spark.createDataFrame(rows, "doc_id long, hub string")
    return sharding.balanced_label_propagation(df, ["doc_id", "hub"], "hub", n)


def balanced(rows, n):
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(shards.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())


def test_groups_stay_together(spark):
    rows = [(i, f"g{i % 40}" if i < 240 else f"s{i}") for i in range(600)]
    df = run(spark, rows)
    got = df.collect()
    balanced(got, 6)
    links, cut = sharding.cut_share(df, "hub").first()
    assert links == 40 * 15 and cut <= 0.15 * links
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]


def test_all_rows_linked(spark):
    # Groups of 20, of mixed sizes, and with one larger than a shard.
    for hubs in ([i // 20 for i in range(1200)], [int(i**0.5) for i in range(1100)], ["hot" if i < 400 else i // 4 for i in range(1200)]):
        df = run(spark, [(i, f"g{h}") for i, h in enumerate(hubs)])
        got = df.collect()
        balanced(got, 6)
        shards = {}
        for r in got:
            shards.setdefault(r["hub"], set()).add(r["shard"])
        assert sum(len(v) > 1 for v in shards.values()) < 6
        assert sorted(r["doc_id"] for r in got) == list(range(len(hubs)))
    links, cut = sharding.cut_share(run(spark, [(i, f"g{i // 20}") for i in range(1200)]), "hub").first()
    assert links == 60 * 190 and cut == 0


def test_a_third_in_one_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i}") for i in range(900)]
    got = run(spark, rows).collect()
    balanced(got, 6)
    assert Counter(r["shard"] for r in got if r["hub"] == "hot").most_common(1)[0][1] >= 140


def test_edge_cases(spark):
    assert run(spark, []).count() == 0
    got = run(spark, [(1, None), (1, None), (None, "a"), (2, "a"), (2, "a")]).collect()
    balanced(got, 6)
    assert len(got) == 5


def test_query(spark, tmp_path):
    rows = [(i, ["same", None, "", f"é{i}"][i % 4], "x", 3) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, shard string, size int").write.parquet(f"{tmp_path}/documents.parquet")
    df = sharding.op7_label_propagation_shards(spark, str(tmp_path))
    got = df.collect()
    balanced(got, 24)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in got)
    assert df.filter(F.col("grown_shard").isNotNull()).count() == 0
