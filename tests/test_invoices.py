import datetime as dt

from ledgerlark.operators import invoices

NAMES = ["supplier", "supplier_number", "representative", "buyer", "buyer_number", "issue_date", "supply_amount", "tax_amount", "total_amount"]


def read(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")
    return [tuple(r[c] for c in NAMES) for r in sorted(invoices.invoice_fields(df).collect(), key=lambda r: r.n)]


def test_fields(spark):
    got = read(
        spark,
        "전자세금계산서\n공급자 등록번호 123-45-67890 상호: 한빛 안전 주식회사, 대표자: 김철수,\n공급받는자 111 22 33333 상호 : 대한건설 | 작성일자: 2024년 3월 5일\n공급가액 1,000 세액: 100\n합계금액 1,100",
        "판매자\n  (주)든든  \r\n작성일 2024.13.40 거래일자 2024-04-02\n공급가액합계 0 공급가액 500\n세액 50",
        "공급자\n123 not a name\n발행자\nSecond Co\n2024/05/06 and 1234567890x 9876543210",
        "", None, "세액 , 총액 12,345",
    )
    assert got == [
        ("한빛 안전 주식회사", "123-45-67890", "김철수", "대한건설", "111-22-33333", dt.date(2024, 3, 5), 1000, 100, 1100),
        ("(주)든든", None, None, None, None, dt.date(2024, 4, 2), 500, 50, 550),
        ("Second Co", "987-65-43210", None, None, None, dt.date(2024, 5, 6), None, None, None),
        (None,) * 9, (None,) * 9, (None,) * 8 + (12345,),
    ]


def test_first_label_with_a_value_counts(spark):
    got = read(spark, "발행일 2024-13-01 작성일자 2024-02-30 거래일자 2024.1.2 공급일자 2023-01-01 합계금액 0 총액 7 청구금액 , 대표 이영희 \u00a0\n상호: x 공급자", " \t공급자 \x0b\n\t Firma \f\n발행일: 2024-03-04")
    assert got == [(None, None, "이영희", None, None, dt.date(2023, 1, 1), None, None, 7), ("Firma", None, None, None, None, dt.date(2024, 3, 4), None, None, None)]


def test_fields_are_found_in_methods_that_the_jvm_compiles(spark):
    # The JVM compiles no method over 8000 bytes.
    import contextlib
    import io
    import re

    out, before = io.StringIO(), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        texts = spark.range(10).selectExpr("id AS n", "'발행일 ' || id AS text").repartition(2)
        with contextlib.redirect_stdout(out):
            invoices.invoice_fields(texts).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())) < 8000
