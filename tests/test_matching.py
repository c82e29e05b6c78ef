import datetime as dt

from pyspark.sql import functions as F

from ledgerlark.functions import amounts, dates, text
from ledgerlark.operators import matching

D = dt.date


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_vendor_forms(spark):
    for shown in ("㈜한빛", "(주) 한빛", "한빛(주)", "(株)한빛", "주 한빛", "한빛!"):
        assert one(spark, text.vendor_key(F.col("v")), v=shown) == "한빛"
    assert one(spark, text.vendor_key(F.lit(None).cast("string"))) == ""


def test_similarity(spark):
    def s(a, b):
        return one(spark, text.similarity(text.normalised(F.col("a")), text.normalised(F.col("b"))), a=a, b=b)

    assert s("안전모 구입", "안전모 구입") == 1.0 and s("", "x") == 0.0
    # bigrams ab,bc | bc,cd: 1/3; tokens 0; ratio 2*2/6
    assert s("abc", "bcd") == round(0.4 / 3 + 0.3 * 4 / 6, 4)


def test_date_gate_and_score(spark):
    def both(a, b):
        x, y = F.lit(a).cast("date"), F.lit(b).cast("date")
        return spark.range(1).select(dates.month_gate(x, y), dates.date_score(x, y)).first()

    assert tuple(both("2024-12-31", "2025-01-01")) == (True, 0.85)
    assert tuple(both("2024-01-01", "2024-01-31")) == (True, 1.0)
    assert tuple(both("2024-01-15", "2024-02-15")) == (False, 0.0)
    assert tuple(both(None, "2024-02-15")) == (True, 0.4) and tuple(both(None, None)) == (True, None)


def test_loose_dates(spark):
    for shown, want in (("2024.3.5", D(2024, 3, 5)), ("24/03/05", D(2024, 3, 5)), ("2024년 3월 5일", D(2024, 3, 5)), ("2024-13-05", None), ("none", None)):
        assert one(spark, dates.loose_date(F.col("v")), v=shown) == want


def test_amounts(spark):
    assert [one(spark, amounts.lenient_amount(F.col("v")), v=v) for v in ("1,000원", "-", "0", "x")] == [1000, None, None, None]
    assert [one(spark, amounts.amount_score(F.lit(100), F.lit(v))) for v in (100, 104, 109, 118, 200)] == [1.0, 0.85, 0.65, 0.3, 0.0]
    scores = {"amount": F.lit(1.0), "vendor": F.lit(None).cast("double"), "item_desc": F.lit(0.5)}
    assert one(spark, amounts.weighted(scores, F.lit("receipt"))) == round((0.55 + 0.1) / 0.75, 4)
    assert one(spark, amounts.line_amount(F.lit("tax_invoice"), F.lit(0), F.lit(1000), F.lit(None).cast("long"))) == 1100


ITEMS = "statement_id long, seq int, item_name string, amount long, quantity double, used_on date, vendor string"
DOCS = "statement_id long, doc_id long, doc_type string, infer_result string, vendor string, doc_date date, supply long, tax long, total long, item_text string, n_lines long"


def frames(spark):
    items = [(1, 1, "Helmet", 1000, 1.0, D(2024, 3, 1), "Acme"), (1, 2, "helmet!", 2000, 1.0, D(2024, 3, 2), "Acme"), (1, 3, "Rope", 500, 1.0, D(2024, 3, 9), ""), (2, 1, "Net", None, 1.0, None, "B")]
    docs = [(1, 10, "receipt", "SUCCESS", "ACME", D(2024, 3, 30), None, None, 3010, "helmet", 1), (1, 11, "delivery_statement", "SUCCESS", "Other", D(2024, 4, 20), 450, 50, 1, "rope", 1)]
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(docs, DOCS)


def test_flow(spark):
    items, docs = frames(spark)
    sums = matching.same_name_sums(items)
    own = {(r.statement_id, r.norm_name): (r.amount, r.source_count, len(r.source_dates)) for r in sums.collect()}
    assert own == {(1, "helmet"): (3000, 2, 2), (1, "rope"): (500, 1, 1), (2, "net"): (None, 1, 1)}
    pairs = {(r.statement_id, r.seq, r.d_doc_id): (r.gate_date, r.gate_amount, r.gate_vendor, r.passed) for r in matching.gated(sums, docs).collect()}
    assert pairs[1, 1, 10] == (True, True, True, True) and pairs[1, 3, 11] == (False, True, True, False) and pairs[2, 1, None][3] is False
