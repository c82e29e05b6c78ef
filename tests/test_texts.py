import random

from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.operators import invoices
from ledgerlark.plans import text_queries


def test_distinct_sentences_are_those_of_comparing_each_with_all_kept(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(" ".join(rnd.choice("aa bb cc dd ee ff gg h".split()) for _ in range(rnd.randint(1, 6))) + rnd.choice(". ! ?".split()) for _ in range(rnd.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "h. h. h.")]
    out = spark.createDataFrame(rows, "id int, t string").select("id", text.distinct_sentences(F.col("t")).alias("d"))
    # Before, sentences were compared pair by pair in an aggregate over an array.
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["d"] for r in out.collect()}
    for i, t in rows:
        kept = []
        for s in [s for s in __import__("re").split(r"(?<=[.!?])\s+", t or "") if s.strip()]:
            own = {w for w in s.lower().split() if len(w) > 1}
            if not any(len(own & k) >= 0.8 * max(min(len(own), len(k)), 1) for _, k in kept):
                kept.append((s, own))
        assert got[i] == " ".join(s for s, _ in kept)


def test_text_sets_are_made_once_for_each_distinct_name(spark, tmp_path):
    rows = [(i, ["red cup", "blue", None][i % 3], ["SMALL ECONOMY", None][i % 2]) for i in range(12)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    out = text_queries.f4_text_sets(spark, str(tmp_path))
    assert "array_intersect" not in out._jdf.queryExecution().optimizedPlan().toString()  # they are stored
    got = {r["p_partkey"]: (r["bigram"], r["token"], r["rule_tokens"]) for r in out.collect()}
    assert len(got) == 12 and got[1] == (1.0, 1.0, 0) and got[2] == (0.0, 0.0, 1) and got[0] == (round(5 / 17, 6), 0.5, 1) and got[6] == got[0]


def test_a_labelled_date_is_searched_for_once(spark):
    rows = spark.createDataFrame([(1, "작성일자: 2024-03-05 공급가액 100 세액 10"), (2, "작성일자 2024.13.40 거래일자 2024-03-06"), (3, None)], "id int, text string")
    out = invoices.invoice_fields(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(_text") - plan.count("regexp_extract(_text#") == 0 and plan.count("작성일자") == 1
    assert [(str(r["issue_date"]), r["total_amount"]) for r in out.orderBy("id").collect()] == [("2024-03-05", 110), ("2024-03-06", None), ("None", None)]
