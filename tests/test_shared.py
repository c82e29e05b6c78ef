import glob

import pytest
from ledgerlark.operators import assignment
from ledgerlark.sources import adapters, shared
from pyspark.sql import functions as F

ITEMS = ["statement_id", "seq", "item_name", "amount", "quantity", "used_on", "vendor", "supplier_id"]


@pytest.fixture
def odd(spark, tmp_path):
    """Lines without a part, supplier or order, keys of parts and orders that recur, null keys."""
    line = "(BIGINT({}), BIGINT({}), BIGINT({}), {}, {}D, {}D, 0.1D, 0.2D, 'N', 'O', {})"
    rows = [
        (1, 10, 100, 1, 1, 10.5, "TIMESTAMP'2024-01-05 00:00:00'"),
        (1, 11, 100, 5, 2, 20.5, "TIMESTAMP'2024-02-05 00:00:00'"),
        (1, 10, 101, 6, 3, 30.5, "TIMESTAMP'2024-01-06 00:00:00'"),
        (1, 10, 100, 7, 4, 40.5, "TIMESTAMP'2024-01-07 00:00:00'"),
        (2, 99, 100, 1, 5, 50.5, "TIMESTAMP'2024-03-05 00:00:00'"),
        (2, 10, 999, 2, 6, 60.5, "TIMESTAMP'2024-03-06 00:00:00'"),
        (2, 11, 101, 2, 7, 70.5, "NULL"),
        (3, 12, 102, 1, 8, "double(null)", "TIMESTAMP'2024-04-05 00:00:00'"),
        (4, 10, 102, 1, 9, 90.5, "TIMESTAMP'2024-05-05 00:00:00'"),
        ("NULL", 10, 102, 1, 9, 90.5, "TIMESTAMP'2024-05-05 00:00:00'"),
    ]
    values = ", ".join(line.format(*r).replace("double(null)D", "double(null)") for r in rows)
    names = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
    tables = {
        "lineitem": f"SELECT * FROM VALUES {values} AS t({names})",
        "part": "SELECT *, 'b' AS p_brand, 't' AS p_type, 1 AS p_size, 1.0D AS p_retailprice FROM VALUES (10L, 'a bolt'), (11L, 'a ring'), (11L, 'b ring'), (12L, NULL) AS t(p_partkey, p_name)",
        "supplier": "SELECT *, 1 AS s_nationkey, 1.0D AS s_acctbal FROM VALUES (100L, 'One'), (101L, 'Two'), (102L, NULL) AS t(s_suppkey, s_name)",
        "orders": "SELECT *, 1L AS o_custkey, TIMESTAMP'2024-01-01 00:00:00' AS o_orderdate FROM VALUES (1L), (2L), (3L), (3L) AS t(o_orderkey)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_items_docs_and_invoices_of_the_joined_lines_are_those_of_the_tables(spark, odd):
    lines = adapters.statement_lines(spark, odd)
    items = adapters.adapted(spark, odd, "items")
    # Two parts of one key leave open which is numbered first.
    assert sorted(r.seq for r in adapters.items_of(lines).filter("statement_id = 1").collect()) == [1, 2, 3, 4, 5]
    alone = "item_name IS NULL OR item_name NOT LIKE '%ring'"
    assert _rows(adapters.items_of(lines).filter(alone).drop("seq").select(*[c for c in ITEMS if c != "seq"])) == _rows(items.filter(alone).select(*[c for c in ITEMS if c != "seq"]))
    assert _rows(adapters.items_of(lines).filter("statement_id = 3").select(*ITEMS)) == _rows(items.filter("statement_id = 3").select(*ITEMS))
    for name, of in (("docs", adapters.docs_of), ("invoices", adapters.invoices_of)):
        whole = adapters.adapted(spark, odd, name)
        assert _rows(of(lines).select(*whole.columns)) == _rows(whole)


def test_tables_stored_by_key_meet_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.range(1000).select((F.col("id") % 50).alias("statement_id"), F.col("id").alias("x"))
    one, two = shared.stored(rows, "one"), shared.stored(rows, "two")
    assert _rows(one) == _rows(rows)
    met = one.join(two.withColumnRenamed("x", "y"), "statement_id").groupBy("statement_id", "x").agg(F.max("y").alias("y"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SelectedBucketsCount" in plan
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    shared.discarded(one)
    assert not glob.glob(f"{shared.shared_dir(spark)}/lib-one-*") and not [t for t in spark.catalog.listTables() if t.name.startswith("lib_one_")]


def test_shuffle_files_of_a_stored_table_are_removed(spark):
    folder = spark.conf.get("spark.local.dir")
    before = set(glob.glob(f"{folder}/**/shuffle_*", recursive=True))
    shared.stored(spark.range(1000).groupBy((F.col("id") % 9).alias("k")).count(), "counts")
    assert not set(glob.glob(f"{folder}/**/shuffle_*", recursive=True)) - before


def test_matches_leave_only_their_own_table(spark):
    items = spark.createDataFrame([(1, 1, "steel rope", 100, None, "One")], "statement_id long, seq int, item_name string, amount long, used_on date, vendor string")
    docs = spark.createDataFrame([(1, 7, "receipt", "SUCCESS", "One", None, 100, None, 100)], "statement_id long, doc_id long, doc_type string, infer_result string, vendor string, doc_date date, supply long, tax long, total long")
    lines = spark.createDataFrame([(1, 7, 1, "steel rope", None, 100, None)], "statement_id long, doc_id long, line_no int, name string, supply long, amount long, tax long")
    invoices = spark.createDataFrame([], "statement_id long, invoice_id long, vendor string, invoice_date date, amount long, names array<string>, line_amounts array<long>")
    pool = shared.stored(assignment.verified(assignment.entries(docs, lines), invoices), "pool")
    before = set(glob.glob(f"{shared.shared_dir(spark)}/lib-*"))
    out = assignment.matches(items, pool)
    assert [(r.doc_id, r.tier, r.tax_invoice_status) for r in out.collect()] == [(7, 1, "unverified")]
    left = {f for f in set(glob.glob(f"{shared.shared_dir(spark)}/lib-*")) - before if glob.glob(f"{f}/*.parquet")}
    assert not [f for f in left if any(n in f for n in ("-side-", "choices", "misses", "candidates", "names-"))]
