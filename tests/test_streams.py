import datetime as dt

import duckdb
from pyspark.sql import functions as F

from ledgerlark.plans import queries
from ledgerlark.sources.streams import Latest, drained_in_parts
from ledgerlark.streaming import alerts

T = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, agent string, ts timestamp, failed boolean, seconds double, arrival int"


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


def events(spark, rows):
    return spark.createDataFrame([(i, u, "a", at(m), f, s, k) for i, (u, m, f, s, k) in enumerate(rows)], EVENTS)


def test_late_rows_are_dropped_and_counted(spark):
    # The second part moves the watermark to 90; in the third, minute 5 is behind every window's end and 95 isn't.
    rows = [(1, 1, True, 1.0, 0), (1, 2, False, 2.0, 0), (1, 100, True, 3.0, 1), (1, 5, True, 9.0, 2), (1, 95, False, 9.0, 2), (1, 300, False, 1.0, 2)]
    df = events(spark, rows)
    got, late = drained_in_parts(df, "arrival", 3, alerts.failure_rates)
    kept = {(r.window_start, r.runs, r.failures) for r in got.collect()}
    batch = {(r.window_start, r.runs, r.failures) for r in alerts.failure_rates(df.filter("event_id <> 3").drop("arrival")).collect() if r.window_start < at(280)}
    assert kept == batch and late == 10  # ten windows of the late row
    everything = alerts.failure_rates(df.drop("arrival")).agg(F.sum("runs")).first()[0]
    open_ = 10  # windows of the last row don't close
    assert got.agg(F.sum("runs")).first()[0] == everything - late - open_


def test_sketch_of_percentiles(spark):
    rows = [(1, 1, False, float(i), 0) for i in range(100)] + [(1, 500, False, 1.0, 1)]
    got, _ = drained_in_parts(events(spark, rows), "arrival", 2, lambda s: alerts.slow_runs(s, "10 minutes", "10 minutes"))
    assert [(r.p95, r.alert) for r in got.collect()] == [(94.0, False)]
    many = spark.range(200_000).select(F.lit(T).alias("ts"), F.lit("a").alias("agent"), (F.col("id") % 1000).cast("double").alias("seconds"))
    (row,) = alerts.slow_runs(many, "10 minutes", "10 minutes").collect()
    assert abs(row.p95 - 950) < 25


def test_percentile_of_many_runs_is_exact(spark):
    rows = [(1, 1, False, float(i * i % 10007), 0) for i in range(3000)] + [(1, 500, False, 1.0, 1)]
    got, _ = drained_in_parts(events(spark, rows), "arrival", 2, lambda s: alerts.slow_runs(s, "10 minutes", "10 minutes"))
    assert [r.p95 for r in got.collect()] == [sorted(s for _, m, _, s, _ in rows if m == 1)[2849]]


def test_search_failures_of_all_agents(spark):
    df = spark.createDataFrame([("a", at(1), True), ("b", at(2), True), ("c", at(3), True), ("c", at(30), True)], "agent string, ts timestamp, failed boolean")
    got = alerts.search_failures(df).collect()
    assert {r.failures for r in got} == {3} and len(got) == 8


def test_sessions_over_parts(spark):
    rows = [(1, 0, False, 1.0, 0), (1, 30, False, 1.0, 1), (2, 31, False, 1.0, 1), (1, 500, False, 1.0, 2), *[(3, 600 + i, False, 1.0, 2) for i in range(25)], (9, 3000, False, 1.0, 3)]
    got, late = drained_in_parts(events(spark, rows), "arrival", 4, lambda s: alerts.sessions(s.select("user_id", "ts", "event_id"), 60, keep=20))
    seen = sorted((r.user_id, r.session_start, r.session_end, r.messages, list(r.last_ids)) for r in got.collect())
    assert late == 0 and seen == [(1, at(0), at(90), 2, [0, 1]), (1, at(500), at(560), 1, [3]), (2, at(31), at(91), 1, [2]), (3, at(600), at(684), 25, list(range(9, 29)))]


def test_late_messages_of_a_session_stand_by_their_time(spark):
    rows = [(1, 0, False, 1.0, 0), (1, 9, False, 1.0, 0), (1, 5, False, 1.0, 1), (1, 11, False, 1.0, 1), (9, 3000, False, 1.0, 2)]
    got, late = drained_in_parts(events(spark, rows), "arrival", 3, lambda s: alerts.sessions(s.select("user_id", "ts", "event_id"), 60, keep=3))
    assert late == 0 and [(r.user_id, r.messages, list(r.last_ids)) for r in got.collect()] == [(1, 4, [2, 1, 3])]


def test_requests_of_busy_sessions(spark):
    rows = [(1, 0, False, 1.0, 0), (1, 5, False, 1.0, 0), (1, 9, False, 1.0, 1), (1, 10, False, 1.0, 1), (1, 19, False, 1.0, 2), (1, 21, False, 1.0, 2), (2, 21, False, 1.0, 2), (2, 2, False, 1.0, 2)]
    got, late = drained_in_parts(events(spark, rows), "arrival", 3, lambda s: alerts.first_requests(s.select("user_id", "ts", "event_id"), 10, delay="5 minutes"))
    assert sorted((r.user_id, r.event_id) for r in got.collect()) == [(1, 0), (1, 3), (1, 5), (2, 6)] and late == 1


def test_late_requests_find_sessions_busy_in_sql_too(spark, tmp_path):
    # The first part ends at minute 998; the request of minute 995 comes with the second, in time.
    rows = [(2, 0, 2), (1, 998, 1), (50, 995, 1), (4, 1300, 1), (3, 4000, 2)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, 'view', 1.0, '{}')", [(i, at(m), u) for i, m, u in rows])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = sorted((r.user_id, r.event_id) for r in queries.QUERIES["t8_first_requests"](spark, str(tmp_path)).collect())
    assert got == [(1, 1), (1, 4), (2, 2), (2, 3)]
    assert sorted(con.sql(f"SELECT user_id, event_id FROM ({queries.ORACLES['t8_first_requests']})").fetchall()) == got


def test_stuck_runs_over_parts(spark):
    rows = [(1, 0, False, 1.0, 0), (2, 0, False, 1.0, 0), (2, 14, True, 1.0, 1), (3, 14, False, 1.0, 1), (1, 40, True, 1.0, 2), (9, 100, True, 1.0, 2)]
    df = events(spark, rows).select(F.col("user_id").alias("run_id"), "ts", F.col("failed").alias("ended"), "arrival")
    got, _ = drained_in_parts(df, "arrival", 3, alerts.stuck_runs)
    assert sorted((r.run_id, r.started_at) for r in got.collect()) == [(1, at(0)), (3, at(14))]


def test_merged_states(spark):
    rows = [(1, "a", at(0), 1, "x", 0), (1, "a", at(5), 2, "y", 1), (1, "a", at(3), 3, "late", 2), (2, "b", at(1), 4, "z", 2)]
    df = spark.createDataFrame(rows, "statement_id long, agent string, ts timestamp, log_id long, state string, arrival int")
    table = Latest(spark, alerts.newest)
    drained_in_parts(df, "arrival", 3, lambda s: s, table)
    assert sorted((r.statement_id, r.state) for r in table.table(spark).collect()) == [(1, "y"), (2, "z")]
    # A batch that is tried again gives the same table.
    table(df.filter("arrival = 2").drop("arrival"), max(table.versions))
    assert sorted((r.statement_id, r.state) for r in table.table(spark).collect()) == [(1, "y"), (2, "z")]


def test_a_runs_rows_in_whole_milliseconds():
    import pandas as pd

    times = pd.to_datetime(["2024-01-01 00:00:02.0019", "2024-01-01 00:00:01.999999", "2024-01-01 00:00:03.0"])
    rows = pd.DataFrame({"ts": times, "ended": [True, False, True]})
    start = 1_704_067_200_000
    assert alerts._in_order([rows]) == alerts._in_order([rows[1:], rows[:1]]) == ([start + 1999, start + 2001, start + 3000], [False, True, True])
