import datetime as dt

from pyspark.sql import functions as F

from ledgerlark.functions import nested, text
from ledgerlark.operators import records, retrieval
from ledgerlark.sources.streams import drained, file_stream
from ledgerlark.streaming import alerts


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "id string, hash string")
    b = spark.createDataFrame([("1", "x"), ("2", "w"), ("4", "v")], "id string, hash string")
    assert {r.id: r.change for r in records.snapshot_diff(a, b).collect()} == {"1": "unchanged", "2": "updated", "3": "deleted", "4": "added"}


def test_prices(spark):
    models = spark.createDataFrame([("GPT-4o-mini-2024",), ("gpt-4o",), ("unknown",), ("gpt-4omni",)], "model string")
    got = {r.model: (float(r.price_in), float(r.price_out)) for r in records.prices(models).collect()}
    assert got == {"GPT-4o-mini-2024": (0.15, 0.6), "gpt-4o": (2.5, 10.0), "unknown": (0.4, 1.6), "gpt-4omni": (0.4, 1.6)}


def test_result_rows_and_ids(spark):
    details = ['{"results":[{"item_id":"7","status":"hil"}],"payload":{"items":[{"id":"x"}]}}', "no json", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(details)], "log_id long, details string")
    rows = sorted(records.action_rows(df).collect(), key=lambda r: r.action_id)
    assert [(r.action_id, r.item_id, r.decision) for r in rows] == [(0, 7, "needs_review"), (1, None, None)]


def test_upserts(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    b = spark.createDataFrame([(2, "new"), (3, "c"), (3, "c")], "id long, v string")
    assert sorted(map(tuple, records.upserted(a, b, ["id"]).collect())) == [(1, "a"), (2, "new"), (3, "c")]
    assert sorted(map(tuple, records.upserted(a, b, ["id"], "nothing").collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_photo_codes(spark):
    def codes(name):
        need, allowed = (F.array(*map(F.lit, x)) for x in (["receipt", "site_photo"], ["receipt", "site_photo", "wearing_photo"]))
        return spark.range(1).select(nested.photo_codes(need, allowed, F.lit(name))).first()[0]

    assert codes("안전모") == ["receipt", "wearing_photo"] and codes("net") == ["receipt"]


def test_limits_and_sentences(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(text.total_limit(F.lit("총액의 100분의 20을 초과할 수 없다"))) == 0.2
    assert one(text.total_limit(F.lit("총액의 100분의 20"))) is None
    assert one(text.distinct_sentences(F.lit("A red hat. A red hat. Blue shoes."))) == "A red hat. Blue shoes."
    assert one(text.cited(F.lit("[LEGAL_CITE: a|b] [LEGAL_CITE: a]"))) == ["a", "b"]


def test_bm25_prefers_rare_words(spark):
    corpus = spark.createDataFrame([(1, "common common"), (2, "common rare"), (3, "other words")], "id long, text string")
    got = retrieval.bm25(corpus, spark.createDataFrame([(9, "rare common")], "query_id long, text string"), 2).collect()
    assert sorted((r.rank, r.id) for r in got) == [(1, 2), (2, 1)]


def test_stuck_runs_are_reported_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 0, False), (1, 5, True), (2, 0, False), (3, 1, False), (3, 40, True), (4, 60, False)]
    df = spark.createDataFrame([(r, t + dt.timedelta(minutes=m), e) for r, m, e in rows], "run_id long, ts timestamp, ended boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/a")
    stream = file_stream(spark, f"{tmp_path}/a", "run_id long, ts timestamp, ended boolean")
    got = sorted((r.run_id, r.started_at.minute) for r in drained(alerts.stuck_runs(stream), "append").collect())
    assert got == [(2, 0), (3, 1)]


def test_alert_windows(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t + dt.timedelta(seconds=20 * i), i % 3 == 0) for i in range(30)], "agent string, ts timestamp, failed boolean")
    rows = alerts.failure_rates(df).filter(F.col("window_start") == F.lit(t)).collect()
    assert [(r.runs, r.failures, r.alert) for r in rows] == [(30, 10, True)]
