import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from obsframe.operators import benchmarks as b
from obsframe.operators import gateway as g
from obsframe.operators import relabel


@pytest.fixture(params=[1, 4])
def slices(request):
    return request.param


def token(**claims):
    part = base64.urlsafe_b64encode(json.dumps(claims).encode()).decode().rstrip("=")
    return f"h.{part}.s"


def test_claims(spark):
    cases = {
        None: "missing token", "": "missing token", "nodots": "unreadable token", "a.!!.c": "unreadable token",
        token(iss="x", aud="a", appid="1"): "wrong issuer", token(aud="a"): "wrong issuer",
        token(iss="i", aud="z", appid="1"): "wrong audience", token(iss="i", aud="a"): "claim not allowed",
        token(iss="i", aud="a", appid="9"): "claim not allowed", token(iss="i", aud="a", appid="1", name="ü?>~"): "ok"}
    df = spark.createDataFrame([(t,) for t in cases], "token string")
    full = g.audit_claims(df, ["i", "j"], ["a"], "appid", ["1", "2"])
    assert {r.token: r.verdict for r in full.collect()} == cases
    assert {r.status for r in full.where("verdict = 'ok'").collect()} == {200}
    issuers_only = {r.token: r.status for r in g.audit_claims(df, ["i"]).collect()}
    assert issuers_only[token(iss="i", aud="z", appid="1")] == 200
    assert issuers_only[token(iss="x", aud="a", appid="1")] == 401


def test_limits(spark, slices):
    df = spark.sql("select * from values ('k', 1, timestamp'2024-01-01 00:00:01', 60L), ('k', 2, timestamp'2024-01-01 00:00:30', 50L), "
                   "('k', 3, timestamp'2024-01-01 00:00:59', 1L), ('k', 4, timestamp'2024-01-01 00:01:00', 99L) as t(k, id, ts, tokens)")
    got = {r.id: (r.call_no, r.limited) for r in g.rate_limit(df, "k", 2, "1m", ["ts"], slices=slices).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (3, True), 4: (1, False)}
    got = {r.id: (r.used, r.limited) for r in g.token_limit(df, "k", 100, ["ts"], slices=slices).collect()}
    assert got == {1: (60, False), 2: (110, True), 3: (111, True), 4: (99, False)}


def test_retries(spark):
    df = spark.createDataFrame([("a", 1, 429), ("a", 2, 503), ("a", 3, 200), ("b", 1, 500), ("c", 1, 404)], "r string, n int, status int")
    got = {x.r: (x.attempts, x.final_status, x.retries) for x in g.retry_collapse(df, ["r"], ["n"]).collect()}
    assert got == {"a": (3, 200, 2), "b": (1, 500, 0), "c": (1, 404, 0)}


def test_cache_hits_follow_the_first_call(spark, slices):
    df = spark.createDataFrame([(i, p) for i, p in enumerate("xyxxzy")], "id int, p string")
    got = [r.cache for r in g.prompt_cache(df, "p", ["id"], slices).orderBy("id").collect()]
    assert got == ["miss", "miss", "hit", "hit", "miss", "hit"]


def test_probe_health(spark, slices):
    marks = "++--+---+-++--"
    df = spark.createDataFrame([("t", i, m == "+") for i, m in enumerate(marks)], "k string, i int, ok boolean")
    health = lambda **n: "".join("HU"[not r.healthy] for r in g.probe_state(df, "k", ["i"], "ok", slices=slices, **n).orderBy("i").collect())
    assert health(fail_n=2) == "HHHUHHUUHHHHHU"
    assert health(fail_n=2, ok_n=2) == "HHHUUUUUUUUHHU"
    assert health(fail_n=30) == "H" * len(marks)


def test_routes_take_the_first_rule(spark):
    rules = [g.Route("exact", "/a", "x"), g.Route("prefix", "/a", "y"), g.Route("prefix", "/s%_", "z")]
    df = spark.createDataFrame([("/a",), ("/ab",), ("/A",), ("/s1x",), ("/s%_q",)], "path string")
    got = {r.path: (r.rule_no, r.destination) for r in g.match_routes(df, rules).collect()}
    assert got == {"/a": (1, "x"), "/ab": (2, "y"), "/A": (None, None), "/s1x": (None, None), "/s%_q": (3, "z")}
    assert "Exchange" not in g.match_routes(df, rules)._jdf.queryExecution().executedPlan().toString()


def test_cost_is_null_where_nothing_was_measured(spark):
    usage = spark.createDataFrame([("per_token", 1.0, 2.0, 10), ("per_token", 1.0, 2.0, None), ("node_uptime", 1.0, 2.0, 10), (None, 1.0, 2.0, 10)],
                                  "billing_model string, core_hours double, uptime_hours double, tokens long")
    rates = spark.createDataFrame([("per_token", 0.5), ("node_uptime", 3.0)], "billing_model string, rate double")
    got = sorted(((r.billing_model, r.cost) for r in g.cost(usage, rates).collect()), key=repr)
    assert got == sorted([("per_token", 5.0), ("per_token", None), ("node_uptime", 6.0), (None, None)], key=repr)


def test_quota(spark):
    usage = spark.createDataFrame([("a", 2), ("a", 3)], "k string, used long")
    limits = spark.createDataFrame([("a", 10), ("b", 4)], "k string, limit long")
    got = {r.k: (r.used, r.remaining) for r in g.quota_headroom(usage, limits, "k").collect()}
    assert got == {"a": (5, 5), "b": (0, 4)}


def test_rollup_has_null_for_what_was_not_measured(spark, slices):
    df = spark.sql("select * from values ('p', 'w', timestamp'2024-01-01 00:00:00', 10D, true, cast(null as long)), "
                   "('p', 'w', timestamp'2024-01-01 00:00:10', cast(null as double), false, null), "
                   "('q', 'w', timestamp'2024-01-01 00:00:00', 5D, true, 8L), ('r', 'w', timestamp'2024-01-01 00:00:00', 1D, true, 4L), "
                   "('r', 'w', timestamp'2024-01-01 00:00:02', 3D, true, null) as t(platform, workload, ts, latency_ms, success, tokens)")
    got = {r.platform: r for r in b.benchmark_rollup(df, slices=slices).collect()}
    assert (got["p"].requests, got["p"].failed_requests, got["p"].average_latency_ms, got["p"].tokens_per_second) == (2, 1, 10.0, None)
    assert got["q"].tokens_per_second is None  # one moment is no measured time
    assert got["r"].tokens_per_second == 2.0 and got["r"].p95_latency_ms == pytest.approx(2.9)


def test_contract(spark):
    good = {"platform": "p", "workload": "w", "requests": 2, "successful_requests": 1, "failed_requests": 1}
    docs = {
        "fine": good, "nulls": {**good, "billing_model": None, "gpu_count": None, "model": None, "duration_seconds": None},
        "numbers": {**good, "duration_seconds": 3, "average_latency_ms": 1.5, "billing_model": "node_uptime"},
        "no platform": {k: v for k, v in good.items() if k != "platform"}, "null workload": {**good, "workload": None},
        "text count": {**good, "requests": "2"}, "fraction": {**good, "gpu_count": 1.5}, "enum": {**good, "billing_model": "free"},
        "sum": {**good, "requests": 5}}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()] + [("broken", "{"), ("list", json.dumps([good])), ("none", None)], "id string, document string")
    got = {(r.id, r.field, r.rule) for r in b.violations(df).collect()}
    assert got == {("no platform", "platform", "required"), ("null workload", "workload", "type"), ("text count", "requests", "type"),
                   ("fraction", "gpu_count", "type"), ("enum", "billing_model", "enum"), ("sum", "requests", "warning"), ("broken", "", "unreadable"),
                   ("list", "", "unreadable"), ("none", "", "unreadable")}


def test_comparison_and_ranks(spark):
    res = spark.createDataFrame([("a", 1, None), ("b", 2, 3.5)], "platform string, requests long, rate double")
    got = {r.dimension: (r.a, r.b) for r in b.compare_platforms(res, ["a", "b"], ["requests", "rate"]).collect()}
    assert got == {"requests": ("1", "2"), "rate": (None, "3.5")}
    both = b.union_results(res.select("platform", "requests"), res.select("platform", "rate"))
    assert both.count() == 4 and both.where(F.col("requests").isNull()).count() == 2
    rank = spark.createDataFrame([("t", "base", 2.0), ("t", "m", 4.0), ("u", "m", 1.0)], "task string, model string, duration double")
    got = {(r.task, r.model): (r["rank"], r.ratio) for r in b.model_rank(rank, "base").collect()}
    assert got == {("t", "base"): (1, 1.0), ("t", "m"): (2, 2.0), ("u", "m"): (1, None)}


@pytest.mark.parametrize("slices", [1, 9])
def test_route_table_equals_rules_in_the_plan(spark, slices):
    rng = random.Random(2)
    uri = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(5)))
    rules = [g.Route(rng.choice(["exact", "prefix"]), uri(), f"d{i}") for i in range(25)] + [g.Route("prefix", "/b", "again"), g.Route("prefix", "", "rest")][:rng.randrange(3)]
    paths = [(i, "/hot" if i % 3 else uri()) for i in range(400)] + [(400, None), (401, "")]
    requests = spark.createDataFrame(paths, "id int, path string")
    table = spark.createDataFrame([(i, r.kind, r.uri, r.destination) for i, r in enumerate(rules, 1)], "rule_no int, kind string, uri string, destination string")
    got = g.match_route_table(requests, table, slices=slices)
    want = g.match_routes(requests, rules)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("slices", [1, 9])
def test_monitor_table_equals_selectors_in_the_plan(spark, slices):
    rng = random.Random(4)
    names, values = ["app", "tier", "namespace"], ["a", "b", ""]
    monitors = [relabel.Monitor(f"m{i}", {n: rng.choice(values) for n in rng.sample(names, rng.randrange(3))},
                                None if rng.random() < 0.5 else tuple(rng.choices(["a", "b", "c"], k=2))) for i in range(40)]
    monitors += [relabel.Monitor("all"), relabel.Monitor("none", {}, ()), relabel.Monitor("never", {"app": "zzz"}), relabel.Monitor("extra", {"x": "1"})]
    targets = [(i, {n: rng.choice(["a", "b"]) for n in rng.sample([*names, "x"], rng.randrange(5))} if i else None) for i in range(200)]
    df = spark.createDataFrame(targets, "id int, labels map<string,string>")
    table = spark.createDataFrame([(x.name, x.match_labels, None if x.namespaces is None else list(x.namespaces)) for x in monitors],
                                  "monitor string, match_labels map<string,string>, namespaces array<string>")
    got = relabel.match_monitors(df, table, slices=slices)
    want = relabel.match_selector(df, monitors)
    assert sorted((r.id, r.monitor) for r in got.collect()) == sorted((r.id, r.monitor) for r in want.collect())
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_any_schema_is_compiled(spark, tmp_path):
    schema = {"properties": {"n": {"type": ["integer", "null"], "minimum": 1, "maximum": 9}, "s": {"type": "string", "pattern": "^a", "maxLength": 3},
                             "b": {"type": "boolean"}, "e": {"enum": ["x", 2, True]}, "o": {"type": "object"}, "l": {"type": "array"}, "odd name.": {"type": "number"}},
              "required": ["s", "free"]}
    (tmp_path / "schema.json").write_text(json.dumps(schema))
    good = {"n": 3, "s": "abc", "b": True, "e": "x", "o": {"k": 1}, "l": [1], "odd name.": 1.5, "free": None}
    cases = {"good": {}, "null n": {"n": None}, "low": {"n": 0}, "high": {"n": 10}, "text n": {"n": "3"}, "pattern": {"s": "ba"}, "long": {"s": "aaaa"},
             "b": {"b": 1}, "two": {"e": 2}, "true": {"e": True}, "other": {"e": "y"}, "null e": {"e": None}, "o": {"o": [1]}, "l": {"l": {}}, "odd": {"odd name.": "x"}}
    rows = [(name, json.dumps({**good, **change})) for name, change in cases.items()] + [("few", "{}"), ("none", None)]
    df = spark.createDataFrame(rows, "id string, document string")
    got = {(r.id, r.field, r.rule) for r in b.violations(df, schema=b.read_schema(spark, str(tmp_path / "schema.json"))).collect()}
    assert got == {("low", "n", "minimum"), ("high", "n", "maximum"), ("text n", "n", "type"), ("pattern", "s", "pattern"), ("long", "s", "maxLength"),
                   ("b", "b", "type"), ("other", "e", "enum"), ("null e", "e", "enum"), ("o", "o", "type"), ("l", "l", "type"), ("odd", "odd name.", "type"),
                   ("few", "s", "required"), ("few", "free", "required"), ("none", "", "unreadable")}
