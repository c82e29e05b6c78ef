"""Queries that drain the events table as a stream that arrives in parts, some of its rows late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import read
from ..sources.streams import Latest, drained_in_parts
from ..streaming import alerts

#: Parts in which the table arrives: quarters of its time; of rows whose id LATE divides, a quarter later.
PARTS, LATE = 4, 50


def _events(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    at = F.floor((F.unix_micros("ts") - F.unix_micros("lo")) * PARTS / (F.unix_micros("hi") - F.unix_micros("lo") + 1))
    agent = F.concat(F.lit("agent_"), (F.col("user_id") % 7).cast("string"))
    return rows.crossJoin(F.broadcast(span)).select(
        "event_id", "ts", "user_id", agent.alias("agent"), (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "click").alias("hil"), (F.col("value") * 10).alias("seconds"), F.floor("value").alias("tokens"),
        (F.col("user_id") % 500).alias("statement_id"), F.col("event_type").alias("state"), F.col("event_id").alias("log_id"), F.least(at + (F.col("event_id") % LATE == 0).cast("int"), F.lit(PARTS - 1)).cast("int").alias("arrival"),
    )


def _drained(spark: SparkSession, sf: str, build) -> DataFrame:
    return drained_in_parts(_events(spark, sf), "arrival", PARTS, build)[0]


def t1_failure_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(spark, sf, alerts.failure_rates)


def t2_slow_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(spark, sf, alerts.slow_runs).withColumn("p95", F.round("p95", 6))


def t4_search_failures(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(spark, sf, alerts.search_failures)


def t5_rollups(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(spark, sf, alerts.rollups)


def t6_latest_states(spark: SparkSession, sf: str) -> DataFrame:
    """Each batch is merged into the table of latest states; late rows count as any other, as they can't replace newer ones."""
    table = Latest(spark, alerts.newest)
    drained_in_parts(_events(spark, sf), "arrival", PARTS, lambda s: s.select("statement_id", "agent", "ts", "log_id", "state"), table)
    return table.table(spark).select("statement_id", "agent", "state", "log_id")


def t7_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The table has no week without a message of a user, so sessions expire after six hours here."""
    out = _drained(spark, sf, lambda s: alerts.sessions(s.select("user_id", "ts", "event_id"), 360))
    return out.select("user_id", "session_start", "session_end", "messages", F.array_join(F.transform("last_ids", lambda i: i.cast("string")), ",").alias("last_ids"))


def t8_first_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(spark, sf, lambda s: alerts.first_requests(s.select("user_id", "ts", "event_id"), 120))


def t3_stuck_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = lambda s: s.select(F.col("user_id").alias("run_id"), "ts", F.col("state").isin("purchase", "view").alias("ended"))
    return _drained(spark, sf, lambda s: alerts.stuck_runs(runs(s)))


QUERIES = {
    "t1_failure_rates": t1_failure_rates, "t2_slow_runs": t2_slow_runs, "t3_stuck_runs": t3_stuck_runs, "t4_search_failures": t4_search_failures, "t5_hourly_rollups": t5_rollups,
    "t6_latest_states": t6_latest_states, "t7_sessions": t7_sessions, "t8_first_requests": t8_first_requests,
}

#: Rows with their arrival, and the watermark's base when they arrive: the latest time of the parts before, to the millisecond.
_E = f"""b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
e0 AS (SELECT events.*, 'agent_' || (user_id % 7) AS agent, CAST(least(floor((epoch_us(ts) - epoch_us(lo)) * {PARTS}::DOUBLE / (epoch_us(hi) - epoch_us(lo) + 1)) + CASE WHEN event_id % {LATE} = 0 THEN 1 ELSE 0 END, {PARTS - 1}) AS INT) AS arrival FROM events, b),
m AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM e0 GROUP BY arrival),
e AS (SELECT e0.*, date_trunc('milliseconds', upto) AS upto, (SELECT date_trunc('milliseconds', hi) FROM b) AS fin FROM e0 JOIN m USING (arrival))"""
_IN_TIME = "e1 AS (SELECT * FROM e WHERE upto IS NULL OR ts > upto - INTERVAL 10 MINUTE)"


def _windows(size: int, slide: int) -> str:
    """Rows by window, without those that come when it has closed, and windows that have closed in the end."""
    return f"""{_E}, w0 AS (SELECT e.*, time_bucket(INTERVAL {slide} MINUTE, ts) - i * INTERVAL {slide} MINUTE AS window_start FROM e, (SELECT unnest(range({size // slide})) AS i)),
w AS (SELECT * FROM w0 WHERE (upto IS NULL OR window_start + INTERVAL {size} MINUTE > upto - INTERVAL {size} MINUTE) AND window_start + INTERVAL {size} MINUTE <= fin - INTERVAL {size} MINUTE)"""


ORACLES = {
    "t1_failure_rates": f"WITH {_windows(10, 1)} SELECT window_start, agent, count(*) AS runs, count_if(event_type = 'error') AS failures, count_if(event_type = 'error') / count(*) > 0.2 AS alert FROM w GROUP BY 1, 2",
    "t2_slow_runs": f"WITH {_windows(10, 1)} SELECT window_start, agent, round(quantile_disc(value * 10, 0.95), 6) AS p95, quantile_disc(value * 10, 0.95) > 120 AS alert FROM w GROUP BY 1, 2",
    "t3_stuck_runs": f"""WITH RECURSIVE {_E}, x AS (SELECT user_id, date_trunc('milliseconds', ts) AS ms, event_type IN ('purchase', 'view') AS ended, fin FROM e WHERE upto IS NULL OR ts > upto - INTERVAL 1 MINUTE),
r AS (SELECT user_id, min(ms) AS s FROM x WHERE NOT ended GROUP BY user_id
  UNION ALL SELECT user_id, CASE WHEN e IS NOT NULL THEN (SELECT min(x.ms) FROM x WHERE x.user_id = q.user_id AND NOT x.ended AND x.ms > q.e) ELSE (SELECT min(x.ms) FROM x WHERE x.user_id = q.user_id AND NOT x.ended AND x.ms >= q.s + INTERVAL 15 MINUTE) END
  FROM (SELECT r.user_id, r.s, (SELECT min(x.ms) FROM x WHERE x.user_id = r.user_id AND x.ended AND x.ms > r.s AND x.ms < r.s + INTERVAL 15 MINUTE) AS e FROM r WHERE r.s IS NOT NULL) q)
SELECT user_id AS run_id, s AS started_at FROM r WHERE s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x WHERE x.user_id = r.user_id AND x.ended AND x.ms > r.s AND x.ms < r.s + INTERVAL 15 MINUTE)
  AND (EXISTS (SELECT 1 FROM x WHERE x.user_id = r.user_id AND x.ms >= r.s + INTERVAL 15 MINUTE) OR r.s + INTERVAL 15 MINUTE < (SELECT max(fin) FROM x) - INTERVAL 1 MINUTE)""",
    "t4_search_failures": f"WITH {_windows(10, 1)} SELECT window_start, count_if(event_type = 'error') AS failures FROM w GROUP BY 1 HAVING count_if(event_type = 'error') >= 3",
    "t5_hourly_rollups": f"WITH {_windows(60, 60)} SELECT window_start AS hour, agent, count(*) AS runs, count_if(event_type = 'click') AS hil, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM w GROUP BY 1, 2",
    "t6_latest_states": f"WITH {_E} SELECT user_id % 500 AS statement_id, agent, event_type AS state, event_id AS log_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id % 500, agent ORDER BY ts DESC, event_id DESC) = 1",
    "t7_sessions": f"""WITH {_E}, {_IN_TIME}, a AS (SELECT user_id, ts, event_id, fin, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e1),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a),
g AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, max(ts) AS last, count(*) AS messages, list(event_id ORDER BY ts, event_id) AS ids, any_value(fin) AS fin, lead(min(ts)) OVER (PARTITION BY user_id ORDER BY s) AS next FROM s GROUP BY user_id, s)
SELECT user_id, session_start, session_end, messages, array_to_string(ids[greatest(len(ids) - 19, 1):], ',') AS last_ids FROM g WHERE next IS NOT NULL OR date_trunc('milliseconds', session_end) < fin - INTERVAL 10 MINUTE""",
    "t8_first_requests": f"""WITH RECURSIVE {_E}, {_IN_TIME},
r AS (SELECT user_id, min({{'a': arrival, 't': ts}}) AS p FROM e1 GROUP BY user_id
  UNION ALL SELECT r.user_id, (SELECT min({{'a': e1.arrival, 't': e1.ts}}) FROM e1 WHERE e1.user_id = r.user_id AND e1.arrival >= r.p.a AND e1.ts >= r.p.t + INTERVAL 120 MINUTE) AS p FROM r WHERE r.p IS NOT NULL)
SELECT e1.user_id, e1.ts, min(event_id) AS event_id FROM r JOIN e1 ON e1.user_id = r.user_id AND e1.arrival = r.p.a AND e1.ts = r.p.t GROUP BY e1.user_id, e1.ts, e1.arrival""",
}
