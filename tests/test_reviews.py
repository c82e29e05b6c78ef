import datetime as dt
import json

from pyspark.sql import functions as F

from ledgerlark.operators import reviews

KEYS = ["item_id"]


def frames(spark, classified=(), judged=(), logs=(), requirements=(), n=9):
    return (
        spark.createDataFrame([(i,) for i in range(n)], "item_id long"), spark.createDataFrame(list(classified), "item_id long, status string, reason string"), spark.createDataFrame(list(judged), "item_id long, status string, reason string, citations array<string>"),
        spark.createDataFrame([(i, k, dt.datetime(2024, 1, d), r, json.dumps(x, ensure_ascii=False)) for i, k, d, r, x in logs], "item_id long, log_id long, created_at timestamp, result_code string, details string"), spark.createDataFrame(list(requirements), "item_id long, evidence_type string, satisfied boolean"),
    )


def test_reviews_and_issues(spark):
    items, classified, judged, logs, needed = frames(
        spark,
        classified=[(1, "검토필요", "look"), (2, "카테고리변경", None), (3, "카테고리변경", "moved"), (4, "유지", "x")],
        judged=[(3, "fail", "against the rule", ["A", None, "A", "B"]), (4, "ok", "fine", []), (5, "unheard of", "", [])],
        logs=[
            (3, 1, 1, "hil", {"summary": "late"}), (6, 2, 5, " FAIL ", {"reason": "second", "required_action": "resend"}), (6, 3, 4, "warning", {"summary": "", "reason": "first", "sources": [{"조항": "제1조"}, {"legal_basis": ""}]}), (6, 4, 4, "nonsense", {"summary": "ignored"}),
            (7, 5, 1, "success", {"summary": "all well", "필요 조치": "none"}), (5, 6, 1, "pass", {"basis": "C", "error": "e"}),
        ],
        requirements=[(7, "receipt", False), (7, "photo", None), (6, "receipt", False), (8, "receipt", True)],
    )
    found = reviews.item_reviews(items, KEYS, classified, judged, logs, needed)
    got = {r.item_id: (r.decision, r.risk_level, r.summary_reason) for r in found.collect()}
    nothing = reviews.NOTHING_REASON
    assert got == {
        0: ("appropriate", "low", nothing), 1: ("needs_review", "medium", nothing), 2: ("appropriate", "low", reviews.CHANGED_REASON), 3: ("inappropriate", "high", "against the rule"), 4: ("appropriate", "low", "fine"),
        5: ("needs_review", "medium", nothing), 6: ("inappropriate", "high", "first"), 7: ("needs_review", "medium", "필수 증빙 미충족: photo, receipt"), 8: ("appropriate", "low", nothing),
    }
    own = {r.item_id: (r.issue_type, r.problem, r.legal_basis, r.required_action) for r in reviews.issues(found, KEYS, classified, judged, logs).collect()}
    assert own == {
        1: ("needs_review", "look", reviews.NO_BASIS, None), 3: ("inappropriate", "against the rule", "A, B", None), 5: ("needs_review", "e", "C", None), 6: ("inappropriate", "first", "제1조", "resend"),
        7: ("needs_review", "필수 증빙 미충족: photo, receipt", reviews.NO_BASIS, "none"),
    }


def test_empty_tables(spark):
    items, classified, judged, logs, needed = frames(spark, n=2)
    found = reviews.item_reviews(items, KEYS, classified, judged.drop("citations"), logs, needed)
    assert {r.decision for r in found.collect()} == {"appropriate"} and reviews.issues(found, KEYS, classified, judged.drop("citations"), logs).count() == 0


def test_details_are_parsed_only_where_a_key_occurs(spark):
    texts = ['{"action": "a"}', '{"summary": "s", "basis": ""}', '{"\\uc870\\ud56d": "escaped"}', '{"조항": "plain"}', "{}", None, "no action", '{"x": {"basis": 1}}', '[{"basis": "b"}]', '{"basis": {"k": [1, 2]}}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, details string").orderBy("n")
    kinds = (reviews.BASIS_KEYS, reviews.ACTION_KEYS)
    plain = [F.coalesce(*[F.nullif(F.get_json_object("details", f"$['{k}']"), F.lit("")) for k in ks]) for ks in kinds]
    got = [tuple(r) for r in rows.select(*[reviews.detail(F.col("details"), ks) for ks in kinds], *plain).collect()]
    assert [r[:2] for r in got] == [r[2:] for r in got] and (got[2][0], got[3][0], got[0][1]) == ("escaped", "plain", "a")
    assert all("contains" in str(reviews.detail(F.col("details"), [k])).lower() for ks in kinds for k in ks)
