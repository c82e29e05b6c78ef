import random

from pyspark.sql import functions as F

from ledgerlark.operators import merges

RULES = {"status": "set", "token": "fill", "total": "add", "born": "keep"}
SCHEMA = "k1 long, k2 string, at int, status string, token long, total long, born string"


def by_hand(state, rows, snapshot=False):
    state = dict(state)
    for k1, k2, _, status, token, total, born in sorted(rows, key=lambda r: r[2]):
        old = state.get((k1, k2))
        if old is None:
            state[k1, k2] = (status, token, total, born)
        else:
            state[k1, k2] = (status, old[1] if token is None else token, old[2] if total is None else (old[2] or 0) + total, old[3])
    if snapshot:
        seen = {r[:2] for r in rows}
        state = {k: v for k, v in state.items() if k in seen}
    return state


def test_runs_and_their_replay(spark):
    rnd = random.Random(1)
    keys = [(None, "a"), (1, None), (1, "a"), (2, "b"), (3, "c"), (4, "d")]
    table = spark.createDataFrame([], SCHEMA).select("k1", "k2", *RULES)
    state, logs, states = {}, None, []
    for run in range(4):
        rows = [(*rnd.choice(keys), at, rnd.choice(["x", "y", None]), rnd.choice([None, 1, 2]), rnd.choice([None, 5, 7]), rnd.choice(["p", "q", None])) for at in range(6)]
        log = merges.changes(table, spark.createDataFrame(rows, SCHEMA), ["k1", "k2"], RULES, ["at"], run, snapshot=run == 2)
        table = spark.createDataFrame(merges.applied(table, log, ["k1", "k2"]).collect(), table.schema)
        log = spark.createDataFrame(log.collect(), log.schema)
        logs = log if logs is None else logs.unionByName(log)
        state = by_hand(state, rows, run == 2)
        states.append(state)
        assert {(r.k1, r.k2): (r.status, r.token, r.total, r.born) for r in table.collect()} == state
    for run, want in enumerate(states):
        assert {(r.k1, r.k2): (r.status, r.token, r.total, r.born) for r in merges.replayed(logs, ["k1", "k2"], run).collect()} == want
    assert logs.filter("change = 'updated' AND before_hash = after_hash").count() == 0 and logs.filter("change = 'deleted' AND after_hash IS NOT NULL").count() == 0


def test_nothing_new_is_no_change(spark):
    rows = spark.createDataFrame([(1, "a", 0, "x", 1, None, "p")], SCHEMA)
    table = rows.select("k1", "k2", *RULES)
    assert merges.changes(table, rows.withColumn("born", F.lit("other")), ["k1", "k2"], RULES, ["at"], 1).count() == 0
    assert merges.changes(table, rows.limit(0), ["k1", "k2"], RULES, ["at"], 1).count() == 0
