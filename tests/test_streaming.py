"""Streams fed by several files, against the batch operators on the same rows."""

import random
import time
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from obsframe.operators import agents, metrics
from obsframe.sources.files import stream_table
from obsframe.sources.sinks import read_latest
from obsframe.streaming import streams as s
from obsframe.streaming.processors import DONE, PassedReplies, ReplyBuckets, ReplyChunks

START = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, value double, status int"
CLOSER = [("closer", START + timedelta(days=9), 0.0, 200)]


def points():
    """Three series over six hours, out of order inside a file, with counter resets."""
    out = []
    for i in range(240):
        for k, every in (("a", 1.5), ("b", 1.3), ("c", 1.9)):
            out.append((k, START + timedelta(minutes=i * every, seconds=ord(k)), float(i % 37), 500 if i % 5 == 0 else 200))
    return sorted(out, key=lambda r: r[1])


@pytest.fixture
def folder(spark, tmp_path):
    """Rows in time order over five files, then one row that closes all windows."""
    path, rows = str(tmp_path / "in"), points()
    size = len(rows) // 5
    for part in range(5):
        chunk = rows[part * size:(part + 1) * size if part < 4 else None]
        spark.createDataFrame(chunk[::-1], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(CLOSER, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, tmp_path, stream, name="out"):
    s.stream_to_files(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name))


def batch(spark, folder):
    return spark.read.schema(SCHEMA).parquet(folder)


def same(left, right):
    return sorted(map(repr, left.collect())) == sorted(map(repr, right.select(left.columns).collect()))


def stream(spark, folder):
    return stream_table(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)


def test_rollup_equals_batch(spark, tmp_path, folder):
    got = run(spark, tmp_path, s.stream_rollup(stream(spark, folder), ["k"], "PT15M", "10m"))
    want = metrics.rollup(batch(spark, folder), ["k"], "PT15M").where("k <> 'closer'")
    assert want.count() > 60 and same(want, got)


def test_alerts_equal_batch(spark, tmp_path, folder):
    got = run(spark, tmp_path, s.stream_alert(stream(spark, folder), "10m", 0.2, "10m"))
    want = metrics.error_rate(batch(spark, folder), "10m").where("error_rate > 0.2")
    assert want.count() > 5 and same(want, got)


def test_idle_sessions_equal_batch(spark, tmp_path, folder):
    got = run(spark, tmp_path, s.stream_idle(stream(spark, folder).where("value < 2"), "k", "30m", "10m"))
    want = agents.idle_sessions(batch(spark, folder).where("value < 2 and k <> 'closer'"), "k", gap="30m")
    # The closing row's own session stays open.
    assert want.count() > 9 and same(want, got)


def test_increase_equals_batch(spark, tmp_path, folder):
    got = run(spark, tmp_path, s.stream_increase(stream(spark, folder), ["k"], ["k"], "1h", "15m", "10m"))
    want = metrics.increase_grid(batch(spark, folder), ["k"], "15m", "1h").where("k <> 'closer'")
    assert want.count() > 60 and same(want, got)


def test_late_samples_within_the_watermark_are_put_in_order(spark, tmp_path):
    path = str(tmp_path / "late")
    at = lambda m: START + timedelta(minutes=m)
    for rows in ([("a", at(0), 1.0, 0), ("a", at(10), 8.0, 0)], [("a", at(5), 3.0, 0), ("a", at(20), 9.0, 0)], CLOSER):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = run(spark, tmp_path, s.stream_deltas(stream(spark, path), ["k"], "30m"))
    assert [(r.value, r.delta) for r in got.where("k = 'a'").orderBy("ts").collect()] == [(1.0, None), (3.0, 2.0), (8.0, 5.0), (9.0, 1.0)]


def turns(n, agent):
    return [(agent, i, START + timedelta(minutes=i), f"q{i}", f"r{i}") for i in n]


TURN = "agent_id string, position long, ts timestamp, query string, response string"


def test_agent_state_survives_a_restart(spark, tmp_path):
    path = str(tmp_path / "turns")
    schema = spark.createDataFrame([], TURN).schema
    for part in (range(0, 4), range(4, 9)):
        rows = turns(part, "x") + turns(part, "y")[:2]
        spark.createDataFrame(rows, TURN).coalesce(1).write.mode("append").parquet(path)
        # Each run is a new query on the old checkpoint.
        got = run(spark, tmp_path, s.stream_agent_state(stream_table(spark, path, schema)))
    whole = spark.read.schema(TURN).parquet(path)
    want = agents.reply_record(whole).select("agent_id", "position", "reflection_count")
    assert same(want, got)
    x = {r.position: r for r in got.where("agent_id = 'x'").collect()}
    assert [x[i].recent_turns for i in range(9)] == [0, 1, 2, 3, 4, 5, 5, 5, 5]
    assert {r.created_at for r in x.values()} == {START}


DELTA = "response_id string, seq long, ts timestamp, reasoning string, content string, is_last boolean"


def test_reply_chunks_over_batches(spark, tmp_path):
    path = str(tmp_path / "deltas")
    at = lambda x: START + timedelta(seconds=x)
    files = [
        [("r", 1, at(1), None, "b", False), ("r", 0, at(0), "a", None, False), ("cut", 0, at(0), None, "x", False)],
        [("r", 1, at(1), None, "b", False), ("r", 3, at(60), None, "d", True), ("r", 2, at(40), None, "c", False)],
        [("end", 0, START + timedelta(days=1), None, "", True)]]
    for rows in files:
        spark.createDataFrame(rows, DELTA).coalesce(1).write.mode("append").parquet(path)
    source = stream_table(spark, path, spark.createDataFrame([], DELTA).schema, files_per_trigger=1)
    got = run(spark, tmp_path, s.stream_delta_assembly(source, "2m", segment=3))
    assert sorted((r.response_id, r.segment_no, r.reasoning, r.answer, r.complete) for r in got.collect()) == [
        ("cut", 0, "", "x", False), ("r", 0, "a", "bc", True), ("r", 1, "", "d", True)]


def test_upsert_keeps_the_latest_per_key(spark, tmp_path, folder):
    base = str(tmp_path)
    s.stream_upsert(stream(spark, folder), "k", ["ts"], f"{base}/state", f"{base}/cp").awaitTermination()
    got = read_latest(spark, f"{base}/state", "k", ["ts"])
    want = batch(spark, folder).groupBy("k").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    assert got.count() == 4 and same(want, got)


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    path = str(tmp_path / "behind")
    for rows in ([("a", START + timedelta(hours=5), 1.0, 0)], [("a", START + timedelta(hours=9), 1.0, 0)],
                 [("a", START, 1.0, 0), ("a", START + timedelta(hours=9), 2.0, 0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    rollup = s.stream_rollup(stream(spark, path), ["k"], "PT15M", "10m")
    query = s.stream_to_files(rollup, str(tmp_path / "o"), str(tmp_path / "c"))
    query.awaitTermination()
    assert s.late_rows(query) == 1


def write_files(spark, path, schema, parts):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return stream_table(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)


def test_agent_lives_do_not_depend_on_the_files(spark, tmp_path):
    rows = turns(range(12), "x") + turns(range(5), "y") + turns([3, 4], "z")
    random.Random(3).shuffle(rows)
    parts = [rows[i::6] for i in range(6)]
    closer = ("closer", 0, START + timedelta(days=9), "q", "r")
    source = write_files(spark, str(tmp_path / "in"), TURN, [*parts, [closer]])
    got = run(spark, tmp_path, s.stream_agent_lives(source, "1d")).where("agent_id <> 'closer'")
    whole = spark.createDataFrame(rows, TURN)
    assert same(agents.reply_record(whole).select("agent_id", "position", "reflection_count"), got)
    state = {r.agent_id: (r.reflection_count, r.created_at, [h.query for h in r.history]) for r in agents.fold_state(whole).collect()}
    found = got.groupBy("agent_id").agg(F.max("reflection_count").alias("n"), F.max("created_at").alias("c"), F.min("created_at").alias("d"),
                                        F.sort_array(F.collect_list(F.struct("reflection_count", "query")))["query"].alias("q"))
    assert {r.agent_id: (r.n, r.c, r.q) for r in found.collect()} == state and all(r.c == r.d for r in found.collect())


def test_agent_lives_go_on_from_saved_state(spark, tmp_path):
    saved = agents.fold_state(spark.createDataFrame(turns(range(7), "x") + turns(range(2), "y"), TURN), chunk=3)
    later = turns(range(7, 10), "x") + turns([0], "z") + [("closer", 0, START + timedelta(days=9), "q", "r")]
    source = write_files(spark, str(tmp_path / "in"), TURN, [later])
    got = run(spark, tmp_path, s.stream_agent_lives(source, "1d", saved=saved)).where("agent_id <> 'closer'")
    assert sorted((r.agent_id, r.position, r.reflection_count, r.recent_turns, r.created_at) for r in got.collect()) == [
        ("x", 7, 8, 5, START), ("x", 8, 9, 5, START), ("x", 9, 10, 5, START), ("z", 0, 1, 0, START)]


def test_idle_agents_leave(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    rows = [("x", i, at(m), "q", None) for i, m in enumerate([0, 30, 61, 62])] + [("y", 0, at(5), "q", "r")]
    source = write_files(spark, str(tmp_path / "in"), TURN, [rows[:3], rows[3:], [("closer", 0, at(9000), "q", "r")]])
    stream_ = s.stream_agent_lives(source, "1h", idle="30m")
    query = s.stream_to_files(stream_, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = spark.read.schema(stream_.schema).parquet(str(tmp_path / "out"))
    assert sorted(((r.agent_id, r.ts, r.reflection_count, r.created_at, r.evicted) for r in got.where("agent_id <> 'closer'").collect())) == sorted([
        ("x", at(0), 1, at(0), False), ("x", at(30), 2, at(0), False), ("x", at(60), 2, at(0), True),
        ("x", at(61), 1, at(61), False), ("x", at(62), 2, at(61), False), ("x", at(92), 2, at(61), True),
        ("y", at(5), 1, at(5), False), ("y", at(35), 1, at(5), True)])
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "seen").load()
    assert state.where("key.agent_id <> 'closer'").count() == 0


def test_replies_wait_for_their_last_chunk(spark, tmp_path):
    at = lambda x: START + timedelta(seconds=x)
    files = [
        [("r", 0, at(0), "a", None, False), ("r", 1, at(1), None, "b", False), ("cut", 0, at(0), None, "x", False)],
        [("r", 1, at(100), None, "other", False), ("r", 3, at(420), None, "d", True)],
        [("r", 2, at(301), None, "c", False), ("two", 0, at(400), None, "z", True), ("two", 0, at(400), None, "y", True)],
        [("end", 0, START + timedelta(days=1), None, "", False)]]
    stream_ = s.stream_replies(write_files(spark, str(tmp_path / "in"), DELTA, files), "5m")
    s.stream_to_files(stream_, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.schema(stream_.schema).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.response_id, r.reasoning, r.answer, r.chunks, r.ended_at, r.complete) for r in got) == [
        ("cut", "", "x", 1, at(0), False), ("r", "a", "bcd", 4, at(420), True), ("two", "", "y", 1, at(400), True)]
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "seen").load()
    assert [r[0] for r in state.select("key.response_id").collect()] == ["end"]


def test_a_reply_costs_a_fixed_number_of_state_calls():
    calls = []

    class Values:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    values, chunks = Values(), SimpleNamespace()  # the map has no methods: a short reply must not touch it
    handle = SimpleNamespace(getMapState=lambda *a: chunks, getValueState=lambda *a: values, registerTimer=lambda ms: calls.append("timer"))
    reply = ReplyChunks(600_000_000)
    reply.init(handle)
    rows = [Row(seq=i % 30, us=i, reasoning=None, content=str(i), is_last=i == 29) for i in range(60)]
    list(reply.handleInputRows(("r",), iter(rows), None))
    assert calls == ["get", "update", "timer"]
    assert values.value[:3] == (59, 30, 30) and [c[3] for c in values.value[3]] == [str(i) for i in range(30)]


def test_long_replies_go_on_in_the_map(spark, tmp_path):
    at = lambda x: START + timedelta(seconds=x)
    long = [("long", i, at(i), None, f"{i},", i == 149) for i in range(150)]
    again = [("long", i, at(i + 1), None, "late", False) for i in (3, 70, 120)] + [("long", 90, at(0), None, "90;", False)]
    edge = [("edge", i, at(i), None, f"{i},", i == ReplyChunks.HELD - 1) for i in range(ReplyChunks.HELD)]
    files = [long[40:100] + edge[:10], long[:40] + again[:1], again[3:] + edge[10:], long[100:] + again[1:3],
             [("end", 0, START + timedelta(days=1), None, "", False)]]
    stream_ = s.stream_replies(write_files(spark, str(tmp_path / "in"), DELTA, files), "5m")
    got = {r.response_id: (r.answer, r.chunks, r.ended_at, r.complete) for r in run(spark, tmp_path, stream_).collect()}
    whole = lambda n: "".join(f"{i}," for i in range(n))
    assert got == {"long": (whole(150).replace(",90,", ",90;"), 150, at(149), True),
                   "edge": (whole(ReplyChunks.HELD), ReplyChunks.HELD, at(ReplyChunks.HELD - 1), True)}


def test_whole_replies_share_their_state(spark, tmp_path):
    at = lambda x: START + timedelta(seconds=x)
    wide = DELTA.replace("response_id string", "response_id bigint")
    ids = [None, *range(2**60, 2**60 + 200)]
    first = [(i, seq, at(60 * seq), f"r{seq}", f"{i}/{seq},", seq == 2) for i in ids for seq in (2, 0, 1)]
    # one chunk turns out to have come earlier, one comes after the last, one is the first of a reply that stays open
    second = [(2**60, 1, at(59), None, "early,", False), (2**60 + 1, 3, at(130), None, "more", False), (7, 0, at(100), None, "open", False)]
    source = write_files(spark, str(tmp_path / "in"), wide, [first, second, [(8, 0, START + timedelta(days=1), None, "", False)]])
    stream_ = s.stream_replies(source, "5m", buckets=4)
    query = s.stream_to_files(stream_, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    rows = spark.read.schema(stream_.schema).parquet(str(tmp_path / "out")).collect()
    got = {r.response_id: (r.reasoning, r.answer, r.chunks, r.ended_at, r.complete) for r in rows}
    want = {i: ("r0r1r2", f"{i}/0,{i}/1,{i}/2,", 3, at(120), True) for i in ids}
    want[2**60] = ("r0r2", f"{2**60}/0,early,{2**60}/2,", 3, at(120), True)
    want[2**60 + 1] = ("r0r1r2", want[2**60 + 1][1] + "more", 4, at(130), False)
    assert got == {**want, 7: ("", "open", 1, at(100), False)} and len(rows) == len(got)
    timers = sum(state["customMetrics"]["numRegisteredTimers"] for step in query.recentProgress for state in step["stateOperators"])
    assert 0 < timers < 30


class Keyed:
    """A keyed processor with its state in memory, run batch by batch."""

    def __init__(self, processor):
        self.processor, self.values, self.timers, self.key = processor, {}, set(), None
        processor.init(self)

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.values.get((self.key, name)), clear=lambda: self.values.pop((self.key, name), None),
                               update=lambda value: self.values.update({(self.key, name): value}))

    def getMapState(self, name, *schemas):
        held = lambda: self.values.setdefault((self.key, name), {})
        return SimpleNamespace(containsKey=lambda k: k in held(), getValue=lambda k: held()[k], updateValue=lambda k, v: held().update({k: v}),
                               iterator=lambda: iter(list(held().items())), clear=lambda: self.values.pop((self.key, name), None))

    def registerTimer(self, ms):
        self.timers.add((ms, self.key))

    def batch(self, groups, mark):
        times, out = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark // 1000), []
        for self.key, rows in groups.items():
            out += self.processor.handleInputRows(self.key, iter(rows), times)
        for timer in sorted((t for t in self.timers if t[0] * 1000 < mark), key=lambda t: t[0]):
            self.key = timer[1]
            out += self.processor.handleExpiredTimer(self.key, times, None)
            self.timers.discard(timer)
        return out


def test_where_a_reply_is_held_does_not_show(monkeypatch):
    monkeypatch.setattr(ReplyChunks, "HELD", 3)
    monkeypatch.setattr(ReplyBuckets, "PACK", 2)
    second, seen = 1_000_000, set()
    fields = ["reply", "seq", "us", "reasoning", "content", "is_last"]

    def groups(chunks, key, form):
        out = {}
        for c in chunks:
            out.setdefault(key(c), []).append(c)
        return {k: form(v) for k, v in out.items()}

    for seed in range(100):
        rng = random.Random(seed)
        alone, first, then = Keyed(ReplyChunks(6 * second)), Keyed(ReplyBuckets(6 * second)), Keyed(PassedReplies(6 * second))
        chunks = []
        for reply in range(8):
            size, start = rng.randint(1, 5), rng.randint(0, 30)
            for seq in range(size + rng.choice([0, 0, 0, 1])):
                for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 2])):
                    chunks.append((reply, seq, (start + rng.randint(0, 4)) * second, rng.choice([None, "r", "s"]), rng.choice("xyz"), seq == size - 1))
        spread = rng.choice([0, 2, 12])
        chunks.sort(key=lambda c: c[2] // second + rng.randint(0, spread))
        top, late = 0, second // 2  # never at the very moment at which a reply may go out
        while chunks or late < 100 * second:
            mark = max(late, top - 5 * second - second // 2) if chunks or rng.random() < 0.5 else late + 7 * second
            size = rng.choice([1, 4, 20])
            now, chunks = chunks[:size], chunks[size:]
            top = max([top, *(c[2] for c in now)])
            now = [c for c in now if c[2] > late]
            want = alone.batch(groups(now, lambda c: (c[0],), lambda v: [Row(**dict(zip(fields, c))) for c in v]), mark)
            frames = first.batch(groups(now, lambda c: (c[0] % 2,), lambda v: [pd.DataFrame(v[i:i + 3], columns=fields) for i in range(0, len(v), 3)]), mark)
            rows = [Row(**r) for f in frames for r in f.to_dict("records")]
            assert all(r.ts.value // 1000 > mark for r in rows)
            seen |= {r.done is None for r in rows}
            packed = then.batch(groups(rows, lambda r: (r.reply, r.bucket), list), mark)
            got = [(*values, p.complete) for p in packed for values in zip(*(p[name] for name in DONE))]
            moment = lambda r: round(r.ended_at.timestamp() * second)
            assert sorted(got) == sorted((r.response_id, r.reasoning, r.answer, r.chunks, moment(r), r.complete) for r in want)
            late = mark
        assert not alone.values and not then.values and not first.values
    assert seen == {True, False}


def test_late_rows_are_counted_over_many_batches_and_runs(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "late")
    counter = s.LateRows(spark, folder)
    spark.streams.addListener(counter)
    try:
        at = lambda h: START + timedelta(hours=h)
        spark.createDataFrame([("a", at(5), 1.0, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        spark.createDataFrame([("a", at(9), 1.0, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        for part in range(3):
            for i in range(2):
                rows = [("a", at(n / 2), 1.0, 0) for n in range(part + 1)] + [("a", at(10 + 2 * part + i), 2.0, 0)]
                spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
            query = s.stream_to_files(s.stream_rollup(stream(spark, path), ["k"], "PT15M", "10m"), str(tmp_path / "o"), str(tmp_path / "c"))
            query.awaitTermination()
            wanted = sum(2 * (p + 1) for p in range(part + 1))
            deadline = time.time() + 20
            while counter.total(query) < wanted and time.time() < deadline:
                time.sleep(0.2)
            assert counter.total(query) == wanted
    finally:
        spark.streams.removeListener(counter)
    # another session knows nothing but the files
    assert s.LateRows(spark, folder).total(query) == 12
    # far more batches than a query's progress remembers
    again = s.LateRows(spark, str(tmp_path / "other"))
    for number in range(300):
        state = SimpleNamespace(numRowsDroppedByWatermark=1)
        for _ in range(2):  # a batch that is reported twice counts once
            again.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(id="q", batchId=number, stateOperators=[state, state])))
    assert again.total(SimpleNamespace(id="q")) == 600


def test_upsert_folds_batches_into_snapshots(spark, tmp_path, folder):
    base = str(tmp_path)
    s.stream_upsert(stream(spark, folder), "k", ["ts"], f"{base}/state", f"{base}/cp", compact_every=2).awaitTermination()
    got = read_latest(spark, f"{base}/state", "k", ["ts"])
    want = batch(spark, folder).groupBy("k").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    assert got.count() == 4 and same(want, got)
    assert sorted(p.name for p in (tmp_path / "state" / "_manifests").glob("[0-9]*.json")) == ["1.json", "2.json", "3.json"]
