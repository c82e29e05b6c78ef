import json

from ledgerlark.operators import layouts


def read(spark, objects):
    df = spark.createDataFrame([(i, o if isinstance(o, str) or o is None else json.dumps(o, ensure_ascii=False)) for i, o in enumerate(objects)], "n int, raw string")
    return {r.n: (r.layout, r.used_on, r.amount, r.name, r.category, r.vendor) for r in layouts.items(df).collect()}


def test_layouts_of_items(spark):
    got = read(spark, [
        {"used_on": "2024-03-01", "total_amount": 100, "item_name": "net", "category_code": "CAT_02", "remark": "note | vendor: Acme | x: y"},
        {"used_on": None, "total_amount": None, "item_name": "net"},
        {"date": "2024-03-01", "amount": 5.5, "description": "rope", "category": "c", "vendor": "B"},
        {"description": "only", "name": ""},
        {"사용일자": "2024-03-02", "금액": 7, "사용내역": "안전모", "항목명": "보호구", "추가정보": {"업체명": "", "진단기관": None, "교육주관": "C"}},
        {"사용내역": "망", "추가정보": None}, {}, "broken {", None, "[1]", {"used_on": "2024", "amount": 3, "total_amount": "12"},
    ])
    assert got == {
        0: ("v3", "2024-03-01", 100.0, "net", "CAT_02", "Acme"), 1: ("v3", "", None, "net", "", ""), 2: ("plain", "2024-03-01", 5.5, "rope", "c", "B"), 3: ("plain", "", None, "only", "", ""),
        4: ("korean", "2024-03-02", 7.0, "안전모", "보호구", "C"), 5: ("korean", "", None, "망", "", ""), 6: ("korean", "", None, "", "", ""), 7: (None,) * 6, 8: (None,) * 6, 9: (None,) * 6, 10: ("v3", "2024", 12.0, "", "", ""),
    }


def test_layouts_of_documents(spark):
    rows = [
        ("wage_statement", {"vendor": "A", "date": "2024-01-31", "total_amount": 900, "items": [{"item_name": "", "name": "guard", "amount": 400, "count": 3}], "validation": {"is_valid": True, "warnings": ["w"]}}),
        ("delivery_statement", {"supplier": {"company_name": "B"}, "store": {"name": "no"}, "issue_date": "2024-02-01", "total_amount": 330, "items": [{"name": "x", "supply_amount": 100, "tax_amount": 10, "quantity": 2, "count": 0, "unit_price": 50}, {"item_name": "y", "supply_amount": 7}, {"item_name": "z", "tax_amount": 7}], "infer_result": "SUCCESS"}),
        ("transaction", {"supplier": {"company_name": ""}, "store": {"name": "S"}, "payment": {"date": "2024-02-02"}, "items": []}),
        ("receipt", {"store": {"name": "R"}, "payment": {"date": "2024-02-03"}, "total_amount": 5, "items": [{"name": "q", "item_name": "no", "amount": 5, "count": 1}], "validation": {"has_required_fields": True, "items_sum_match": False, "warnings": ["a"], "errors": ["b"]}}),
        ("receipt", {"infer_result": None}), ("receipt", "no json"),
    ]
    df = spark.createDataFrame([(i, k, o if isinstance(o, str) else json.dumps(o)) for i, (k, o) in enumerate(rows)], "n int, kind string, raw string")
    got = {r.n: r for r in layouts.documents(df).collect()}
    short = {n: (r.doc_type, r.infer_result, r.vendor, r.date, r.total_amount, [tuple(x) for x in r.lines or []], r.is_valid, r.sums_match, r.warnings) for n, r in got.items()}
    assert short == {
        0: ("wage_statement", "SUCCESS", "A", "2024-01-31", 900, [("guard", None, None, 400)], True, None, ["w"]),
        1: ("delivery_statement", "SUCCESS", "B", "2024-02-01", 330, [("x", 2.0, 50.0, 110), ("y", None, None, 7), ("z", None, None, None)], False, None, []),
        2: ("delivery_statement", "PARTIAL", "S", "2024-02-02", None, [], False, None, []),
        3: ("receipt", "ERROR", "R", "2024-02-03", 5, [("q", 1.0, None, 5)], True, False, ["a", "b"]),
        4: ("receipt", None, None, None, None, [], False, None, []), 5: (None, None, None, None, None, [], None, None, None),
    }


def test_a_document_is_converted_once(spark):
    rows = spark.createDataFrame([(1, "receipt", '{"store": {"name": "s"}, "items": [{"name": "a", "count": "x", "amount": 5}, 7], "validation": {"errors": ["e"]}}'), (2, "receipt", "[1]")], "id long, kind string, raw string")
    out = layouts.documents(rows)
    # One conversion, and one look for a key.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get(") <= 2
    one, two = out.orderBy("id").collect()
    assert [tuple(x) for x in one.lines] == [("a", None, None, 5), ("", None, None, None)] and (one.infer_result, one.warnings) == ("ERROR", ["e"])
    assert two.doc_type is None and two.lines is None
