import datetime as dt
import json
import os

from ledgerlark.operators import context
from ledgerlark.sources import readers, shared
from ledgerlark.sources.adapters import adapted


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_statements(spark, tmp_path):
    line = {"seq": 1, "category_code": "CAT_02", "used_on": "2024-03-01T00", "item_name": "n" * 400, "total_amount": None}
    put(tmp_path / "a.json", {"source_file": "a", "line_items": [line, {"seq": 2, "used_on": None, "category_code": "CAT_01"}]})
    put(tmp_path / "b.json", {"source_file": "b", "items": [dict(line, total_amount=5, used_on="bad date")]})
    rows = {r.source_file: r for r in readers.statement_lines(readers.statements(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].used_on == dt.date(2024, 3, 1) and len(rows["a"].item_name) == 300
    assert (rows["a"].total_amount, rows["b"].total_amount, rows["b"].used_on) == (0, 5, None)


def test_evidence(spark, tmp_path):
    put(tmp_path / "one.json", {"receipt_id": "1", "doc_type": "transaction_statement", "date": " ", "payment": {"date": "2024-01-02"}, "store": {"name": "S"}})
    put(tmp_path / "many.json", [{"receipt_id": "2", "doc_type": "receipt", "vendor": "V", "date": "2024-01-03"}, {"receipt_id": "3"}])
    got = {r.receipt_id: (r.doc_type, r.date, r.vendor) for r in readers.evidence(spark, str(tmp_path)).collect()}
    assert got == {"1": ("delivery_statement", "2024-01-02", "S"), "2": ("receipt", "2024-01-03", "V"), "3": (None, None, "")}


def test_files_and_corpus(spark, tmp_path):
    for name in ("a.PDF", "b.txt", "c.jpg"):
        put(tmp_path / name, "x")
    assert readers.evidence_files(spark, str(tmp_path)).count() == 2
    put(tmp_path / "d.md", "# one\ntwo")
    assert [tuple(r) for r in readers.corpus(spark, str(tmp_path / "*.md")).collect()] == [("d.md", "# one\ntwo")]


def test_cases_and_writes(spark, tmp_path):
    put(tmp_path / "in.json", [{"id": "1", "x": 1}, {"id": "2", "x": 2}])
    put(tmp_path / "out.json", [{"id": "1", "y": 3}])
    got = readers.cases(spark, str(tmp_path / "in.json"), str(tmp_path / "out.json"), "id string, x int", "id string, y int")
    assert [tuple(r) for r in got.collect()] == [("1", 1, 3)]
    readers.write_matches(got.selectExpr("*", "'2024-01' AS month"), got.groupBy().count(), f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m/matches").count() == 1
    readers.append_logs(got.selectExpr("id", "x", "CAST(NULL AS INT) AS z"), ["id"], f"{tmp_path}/l")
    assert spark.read.parquet(f"{tmp_path}/l").first()["details"] == '{"x":1}'


def test_carried_forward_and_corpus_choice(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, "A"), (1, 3, None), (2, 1, None)], "g long, n int, c string")
    assert [r.c for r in context.carried_forward(rows, "g", "n", "c").orderBy("g", "n").collect()] == [None, "A", "A", None]
    chunks = spark.createDataFrame([(1, False), (2, False)], "id long, is_pdf boolean")
    assert context.preferred_corpus(chunks).count() == 2
    assert context.preferred_corpus(chunks.unionByName(spark.createDataFrame([(3, True)], chunks.schema))).count() == 1


def test_files_of_many_suppliers_have_ids_of_their_own(spark, tmp_path):
    lines = [(1, 1005, 1), (2, 5, 1), (1, 5, 2), (3, 60_000, 1), (63, 0, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"S{k}") for k in {s for _, s, _ in lines}], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    ids = {(r.statement_id, r.item_seq): r.file_id for r in adapted(spark, str(tmp_path), "files").collect()}
    assert len(set(ids.values())) == len(lines) and ids[2, 1] == 2005


def test_shuffles_have_partitions_by_the_size_of_the_input(spark, monkeypatch):
    key, tables = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "/root/testdata/sf0.001"
    size = sum(os.path.getsize(f"{tables}/{t}.parquet") for t in ("lineitem", "orders", "part", "supplier"))
    adapted(spark, tables, "items")
    assert int(spark.conf.get(key)) == 4  # the session's own number is the least
    monkeypatch.setattr(shared, "INPUT_BYTES", size // 10)
    adapted(spark, tables, "items")
    assert int(spark.conf.get(key)) in (10, 11)
    monkeypatch.undo()
    adapted(spark, tables, "items")
    assert int(spark.conf.get(key)) == 4
