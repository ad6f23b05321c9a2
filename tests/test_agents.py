import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsframe.operators import agents as a

START = datetime(2024, 1, 1)


@pytest.fixture(params=[1, 4])
def slices(request):
    return request.param


def minutes(spark, points):
    df = spark.createDataFrame([(k, START + timedelta(seconds=round(m * 60))) for k, m in points], "k string, ts timestamp")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def turns(spark, n, agent="x"):
    rows = [(agent, i, START + timedelta(minutes=i), f"q{i}", None if i == 2 else f"r{i}") for i in range(n)]
    return spark.createDataFrame(rows, "agent_id string, position int, ts timestamp, query string, response string")


def test_pairs_skip_system_rows_and_keep_unanswered(spark, slices):
    talk = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "system", "s"), (1, 3, "assistant", "b"),
            (1, 4, "user", "c"), (1, 5, "user", "d"), (2, 0, "user", "e")]
    df = spark.createDataFrame(talk, "conv_id int, turn int, role string, text string")
    got = sorted((r.conv_id, r.query, r.response) for r in a.pair_turns(df, slices=slices).collect())
    assert got == [(1, "a", "b"), (1, "c", None), (1, "d", None), (2, "e", None)]


def test_payload_holds_five_earlier_turns(spark, slices):
    got = {r.position: r for r in a.prompt_payload(turns(spark, 8), slices=slices).collect()}
    assert got[0].transcript == "q0" and [tuple(m) for m in got[0].messages] == [("user", "q0")]
    assert len(got[7].messages) == 11
    assert [m.content for m in got[7].messages][:3] == ["q2", None, "q3"]
    assert got[3].transcript == "User: q0\nAssistant: r0\nUser: q1\nAssistant: r1\nUser: q2\nAssistant: \nUser: q3"


def test_fold_splits_long_histories_into_numbered_documents(spark, slices):
    got = a.fold_state(turns(spark, 7), chunk=3, slices=slices).orderBy("chunk_no").collect()
    assert [len(r.history) for r in got] == [3, 3, 1]
    assert [h["query"] for r in got for h in r.history] == [f"q{i}" for i in range(7)]
    assert {(r.reflection_count, r.created_at, r.last_updated) for r in got} == {(7, START, START + timedelta(minutes=6))}
    text = a.history_messages(a.fold_state(turns(spark, 2), slices=slices)).orderBy("pos").collect()
    assert [(r.role, r.text) for r in text] == [("user", "q0"), ("bot", "r0"), ("user", "q1"), ("bot", "r1")]


def test_a_pause_of_exactly_the_gap_does_not_end_a_session(spark, slices):
    df = minutes(spark, [("u", 0), ("u", 30), ("u", 60.1), ("u", 95), ("v", 10)])
    got = sorted((r.k, r.events) for r in a.idle_sessions(df, "k", gap="30m", slices=slices).collect())
    assert got == [("u", 1), ("u", 1), ("u", 2), ("v", 1)]


def test_sessions_go_on_over_many_slices(spark):
    df = minutes(spark, [("u", i) for i in range(100)] + [("u", 500 + i) for i in range(100)] + [("v", 31 * i) for i in range(30)]
                 + [(None, i) for i in range(40)])
    got = sorted(((r.k, r.start, r.events) for r in a.idle_sessions(df, "k", gap="30m", slices=11).collect()), key=repr)
    assert got == sorted([("u", START, 100), ("u", START + timedelta(minutes=500), 100), (None, START, 40)]
                         + [("v", START + timedelta(minutes=31 * i), 1) for i in range(30)], key=repr)


def test_pool_usage_counts_live_sessions(spark, slices):
    df = minutes(spark, [("u", 0), ("v", 5), ("w", 30)])
    got = [(r.ts, r.live, r.over_limit, r.beyond_ready) for r in
           a.pool_usage(df, "k", cooldown="600s", most=1, ready=0, slices=slices).orderBy("ts").collect()]
    at = lambda m: START + timedelta(minutes=m)
    assert got == [(at(0), 1, False, 1), (at(5), 2, True, 2), (at(10), 1, False, 1), (at(15), 0, False, 0),
                   (at(30), 1, False, 1), (at(40), 0, False, 0)]


def test_as_of_takes_the_version_at_the_same_moment(spark, slices):
    req = minutes(spark, [("u", 0), ("u", 10), ("u", 15), ("z", 1)]).withColumn("id", F.monotonically_increasing_id())
    versions = minutes(spark, [("u", 10), ("u", 20)]).withColumn("v", F.minute("ts"))
    got = {(r.k, r.ts.minute): r.v for r in a.state_as_of(req, versions, "k", "ts", ["v"], "id", slices).collect()}
    assert got == {("u", 0): None, ("u", 10): 10, ("u", 15): 10, ("z", 1): None}


def test_versions_reuse_an_unchanged_definition(spark, slices):
    df = spark.createDataFrame([("n", i, d) for i, d in enumerate(["a", "a", "b", None, None, "a"])], "name string, t int, d string")
    got = [(r.is_new, r.version) for r in a.catalog_versions(df, "name", ["t"], "d", slices).orderBy("t").collect()]
    assert got == [(True, 1), (False, 1), (True, 2), (True, 3), (False, 3), (True, 4)]


def test_default_state_for_unknown_agents(spark):
    state = spark.createDataFrame([("a", START, 3)], "agent_id string, created_at timestamp, reflection_count long")
    ids = spark.createDataFrame([("a",), ("b",)], "agent_id string")
    got = {r.agent_id: (r.created_at, r.reflection_count, r.restored) for r in
           a.state_or_default(ids, state, "2024-02-01 00:00:00").collect()}
    assert got == {"a": (START, 3, True), "b": (datetime(2024, 2, 1), 0, False)}


def test_replicas_are_clamped(spark):
    df = minutes(spark, [(str(i), 0) for i in range(25)] + [(str(i), 60) for i in range(200)])
    got = {r.start.hour: r.replicas for r in a.replica_demand(df, "1h").collect()}
    assert got == {0: 3, 1: 10}


def test_tiers(spark):
    df = spark.sql("select explode(array(date'2024-01-31', date'2024-01-29', date'2024-01-01')) last_updated")
    got = [r.tier for r in a.tier_state(df, "2024-02-01", 3, 20).orderBy(F.desc("last_updated")).collect()]
    assert got == ["hot", "cool", "expire"]


def test_replies_come_in_segments(spark):
    df = spark.createDataFrame([("r", i, "t" if i < 2 else None, str(i) if i >= 2 else None) for i in (4, 2, 0, 1, 3)],
                               "response_id string, seq long, reasoning string, content string")
    got = a.assemble_deltas(df, segment=3).orderBy("segment_no").collect()
    assert [(r.segment_no, r.reasoning, r.answer) for r in got] == [(0, "tt", "2"), (1, "", "34")]


def test_outcomes(spark):
    df = spark.createDataFrame([("[Error] x",), ("[Simulated] y",), ("see [Error] z",)], "r string")
    assert [r[0] for r in df.select(a.turn_outcome("r")).collect()] == ["error", "simulated", "ok"]


def test_requests_in_flight(spark, slices):
    rng = random.Random(1)
    rows = [(rng.randrange(600), rng.choice([0, 1, 5, 40])) for _ in range(80)] + [(900, 0), (1300, 1)]
    at = lambda x: START + timedelta(minutes=x)
    df = spark.createDataFrame([(at(s), at(s + n)) for s, n in rows] + [(None, at(3)), (at(1200), None)], "start timestamp, end timestamp")
    live = lambda m: sum(s <= m < s + n for s, n in rows) + (m >= 1200)
    begin = min(s for s, n in rows if n) // 10
    want = [(at(10 * w), max(live(m) for m in range(10 * w, 10 * w + 10))) for w in range(begin, 1301 // 10 + 1)]
    got = a.in_flight(df, "10m", per_replica=2, least=1, most=3, slices=slices).orderBy("start").collect()
    assert [(r.start, r.concurrent) for r in got] == want
    assert all(r.replicas == max(1, min(3, -(-r.concurrent // 2))) for r in got)
