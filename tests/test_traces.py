import pytest

from obsframe.operators import traces


def spans(spark, links, trace="t"):
    rows = [(trace, s, p, f"svc{s % 2}", "op", 100 + s, 10) for s, p in links]
    return spark.createDataFrame(rows, "trace_id string, span_id long, parent_id long, service string, operation string, start_us long, duration_us long")


@pytest.fixture(params=[1, 4])
def slices(request):
    return request.param


def test_depth_of_chains_stars_orphans_and_cycles(spark, slices):
    chain = [(1, None)] + [(i, i - 1) for i in range(2, 41)]
    star = [(100, None)] + [(i, 100) for i in range(101, 160)] + [(200, 159)]
    orphans = [(300, 999), (301, 300)]
    cycle = [(400, 401), (401, 400), (402, 401)]
    df = spans(spark, chain + star + orphans + cycle).unionByName(spans(spark, [(1, None), (2, 1)], "u"))
    got = {(r.trace_id, r.span_id): r for r in traces.trace_timeline(df, slices=slices).collect()}
    assert len(got) == len(chain + star + orphans + cycle) + 2
    assert [got["t", i].depth for i in range(1, 41)] == list(range(40))
    assert {got["t", i].depth for i in range(101, 160)} == {1} and got["t", 200].depth == 2
    assert (got["t", 300].depth, got["t", 301].depth) == (0, 1)
    assert {got["t", i].depth for i in (400, 401, 402)} == {None}
    assert got["u", 2].depth == 1 and got["u", 2].offset_us == 1 and got["t", 40].offset_us == 39


def test_small_traces_are_not_joined(spark, slices, monkeypatch):
    links = [(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (6, 7), (7, 6), (8, 7), (9, 9), (10, 9)]
    df = spans(spark, links).unionByName(spans(spark, [(1, None), (2, 1), (3, 1)], "u")).unionByName(spans(spark, [(1, None), (2, 1)], None))
    out = traces.trace_timeline(df, slices=slices)
    assert slices > 1 or "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.trace_id, r.span_id): r.depth for r in out.collect()}
    assert got == {**{("t", i + 1): d for i, d in enumerate([0, 1, 2, 0, 1, None, None, None, None, None])},
                   ("u", 1): 0, ("u", 2): 1, ("u", 3): 1, (None, 1): 0, (None, 2): 0}
    monkeypatch.setattr(traces, "FAMILY", 1)
    joined = traces.trace_timeline(df, slices=slices)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, out.collect()))


def test_edges_and_self_time(spark):
    df = spans(spark, [(1, None), (2, 1), (4, 1), (3, 2), (5, 77)])
    got = {(r.caller, r.callee): (r.calls, r.mean_us) for r in traces.service_edges(df).collect()}
    assert got == {("svc1", "svc0"): (2, 10.0), ("svc0", "svc1"): (1, 10.0)}
    own = {r.span_id: r.self_us for r in traces.span_self_time(df).collect()}
    assert own == {1: 0, 2: 0, 3: 10, 4: 10, 5: 10}


def test_sampling_keeps_whole_traces(spark):
    df = spark.range(4000).selectExpr("cast(id % 1000 as string) trace_id", "id span_id")
    kept = traces.sample_traces(df, 10.0)
    sizes = {r["count"] for r in kept.groupBy("trace_id").count().collect()}
    assert sizes == {4} and 60 < kept.count() / 4 < 140
    assert traces.sample_traces(df, 100).count() == 4000 and traces.sample_traces(df, 0).count() == 0


def test_performance(spark, slices):
    got = traces.span_performance(spans(spark, [(i, None) for i in range(2, 22, 2)]), slices=slices).collect()
    assert [(r.service, r.calls, r.mean_us, r.p95_us) for r in got] == [("svc0", 10, 10.0, 10.0)]
