import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlark.plans import queries
from ledgerlark.sources.adapters import TABLES

SF = "/root/testdata/sf0.001"
#: Queries over few rows each; the driver compares all of them.
SOME = ["a1_same_name_sums", "j2_invoice_verification", "a12_dashboard", "a16_model_cost", "j8_missing_evidence", "a22_category_scores", "o4_validator_matches", "r2_bm25", "f40_loose_dates", "t5_hourly_rollups", "f71_nearest_lines", "p20_link_todos", "d10_human_reviews", "u8_omitted_answers", "j3_exclusive_assignment", "d3_item_route", "f60_profile_scores", "t1_failure_rates", "t3_stuck_runs", "p1_item_layouts", "p11_document_layouts", "f15_invoice_fields", "f18_rule_laws", "o8_law_order", "a10_item_reviews", "d9_issues", "s9_agent_logs", "r9_refresh_log"]


def test_names():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = con.sql(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert sorted(map(repr, [[str(x) for x in r] for r in got])) == sorted(map(repr, [[str(x) for x in r] for r in want]))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
