"""Gateway and benchmark-record queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.catalog.registry import query
from obsframe.operators import benchmarks as b
from obsframe.operators import gateway as g
from obsframe.operators import matrix
from obsframe.views import Lake

PLATFORMS = ["platform-0", "platform-1", "platform-2", "platform-3"]
BILLING = """CASE user_id % 4 WHEN 0 THEN 'compute_core_hours' WHEN 1 THEN 'node_uptime' WHEN 2 THEN 'per_token' END"""


@query("claims_audit", """
    WITH parts AS (SELECT c_custkey, token, translate(split_part(token, '.', 2), '-_', '+/') AS part FROM claims),
    bodies AS (SELECT c_custkey, token, TRY(decode(from_base64(
                   rpad(part, CAST(ceil(length(part) / 4.0) * 4 AS INTEGER), '=')))) AS body FROM parts),
    fields AS (SELECT c_custkey, token, body, json_extract_string(body, '$.iss') AS iss,
                      json_extract_string(body, '$.aud') AS aud, json_extract_string(body, '$.appid') AS appid FROM bodies),
    judged AS (SELECT c_custkey, CASE WHEN token IS NULL THEN 'missing token' WHEN body IS NULL THEN 'unreadable token'
                   WHEN iss NOT IN ('https://issuer-a/', 'https://issuer-b/') THEN 'wrong issuer'
                   WHEN aud <> 'https://gateway' THEN 'wrong audience'
                   WHEN appid NOT IN ('app-0', 'app-1') THEN 'claim not allowed' ELSE 'ok' END AS verdict FROM fields)
    SELECT c_custkey, verdict, CASE WHEN verdict = 'ok' THEN 200 ELSE 401 END AS status FROM judged
""", "claims")
def _(lake: Lake) -> DataFrame:
    return g.audit_claims(lake.claims, ["https://issuer-a/", "https://issuer-b/"], ["https://gateway"],
                          "appid", ["app-0", "app-1"]).drop("token")


@query("rate_limit_by_key", """
    SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) AS call_no,
           row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) > 3 AS limited FROM events
""")
def _(lake: Lake) -> DataFrame:
    calls = lake.events.select("event_id", "user_id", "ts")
    return g.rate_limit(calls, "user_id", 3, "1d", ["ts"]).select("event_id", "user_id", "call_no", "limited")


@query("token_limit", """
    WITH sized AS (SELECT agent_id, position, ts, length(query) AS tokens FROM agent_turns),
    summed AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY agent_id, date_trunc('minute', ts) ORDER BY position) AS BIGINT) AS used FROM sized)
    SELECT agent_id, position, date_trunc('minute', ts) AS minute, used, used > 200 AS limited FROM summed
""", "agent_turns")
def _(lake: Lake) -> DataFrame:
    sized = lake.agent_turns.select("agent_id", "position", "ts", F.char_length("query").cast("long").alias("tokens"))
    out = g.token_limit(sized, "agent_id", 200, ["position"])
    return out.select("agent_id", "position", "minute", "used", "limited")


@query("retry_collapse", """
    SELECT user_id, workload, CAST(ts AS DATE) AS day, count(*) AS attempts, arg_max(status, ts) AS final_status,
           count(*) FILTER (status = 429 OR status BETWEEN 500 AND 599)
             - CASE WHEN arg_max(status, ts) = 429 OR arg_max(status, ts) BETWEEN 500 AND 599 THEN 1 ELSE 0 END AS retries
    FROM requests GROUP BY ALL
""", "requests")
def _(lake: Lake) -> DataFrame:
    rows = lake.requests.withColumn("day", F.col("ts").cast("date"))
    return g.retry_collapse(rows, ["user_id", "workload", "day"], ["ts"])


@query("prompt_cache", """
    SELECT doc_id, md5(text) AS prompt_hash, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1
           THEN 'miss' ELSE 'hit' END AS cache FROM documents
""")
def _(lake: Lake) -> DataFrame:
    return g.prompt_cache(lake.documents.select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", "prompt_hash", "cache")


@query("probe_state", """
    WITH base AS (SELECT event_id, user_id % 10 AS target, event_type NOT IN ('error', 'click') AS ok,
                         row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS rn FROM events),
    islands AS (SELECT *, rn - row_number() OVER (PARTITION BY target, ok ORDER BY rn) AS island FROM base),
    runs AS (SELECT *, row_number() OVER (PARTITION BY target, ok, island ORDER BY rn) AS run FROM islands),
    flips AS (SELECT *, CASE WHEN NOT ok AND run >= 3 THEN false WHEN ok AND run >= 2 THEN true END AS flip FROM runs)
    SELECT event_id, target, CASE WHEN ok THEN 0 ELSE run END AS failures_in_row,
           CASE WHEN ok THEN run ELSE 0 END AS successes_in_row,
           coalesce(last_value(flip IGNORE NULLS) OVER (PARTITION BY target ORDER BY rn), true) AS healthy FROM flips
""")
def _(lake: Lake) -> DataFrame:
    probes = lake.events.select("event_id", (F.col("user_id") % 10).alias("target"),
                                (~F.col("event_type").isin("error", "click")).alias("ok"))
    return g.probe_state(probes, "target", ["event_id"], "ok", fail_n=3, ok_n=2).drop("ok")


@query("quota_headroom", """
    WITH used AS (SELECT c_nationkey AS resource, count(*) AS used FROM customer GROUP BY 1)
    SELECT n_nationkey AS resource, coalesce(used, 0) AS used, CAST(100 AS BIGINT) AS "limit", 100 - coalesce(used, 0) AS remaining
    FROM nation LEFT JOIN used ON n_nationkey = resource
""")
def _(lake: Lake) -> DataFrame:
    usage = lake.table("customer").select(
        F.col("c_nationkey").alias("resource"), F.lit(1).cast("long").alias("used"))
    limits = lake.table("nation").select(F.col("n_nationkey").alias("resource"), F.lit(100).cast("long").alias("limit"))
    return g.quota_headroom(usage, limits, "resource")


@query("cost_by_billing", f"""
    WITH usage AS (SELECT event_id, {BILLING} AS billing_model, value AS core_hours, value * 2 AS uptime_hours,
             CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS tokens
         FROM events),
    rates AS (SELECT CASE r_regionkey WHEN 0 THEN 'compute_core_hours' WHEN 1 THEN 'node_uptime' WHEN 2 THEN 'per_token' END AS billing_model,
                     0.5 + r_regionkey AS rate FROM region WHERE r_regionkey < 3)
    SELECT event_id, usage.billing_model, round(CAST(rate * CASE usage.billing_model WHEN 'compute_core_hours' THEN core_hours
        WHEN 'node_uptime' THEN uptime_hours WHEN 'per_token' THEN tokens END AS DOUBLE), 6) AS cost
    FROM usage LEFT JOIN rates ON usage.billing_model = rates.billing_model
""")
def _(lake: Lake) -> DataFrame:
    user, k = F.col("user_id") % 4, F.get_json_object("props", "$.k").cast("long")
    usage = lake.events.select(
        "event_id", F.when(user == 0, "compute_core_hours").when(user == 1, "node_uptime").when(user == 2, "per_token").alias("billing_model"),
        F.col("value").alias("core_hours"), (F.col("value") * 2).alias("uptime_hours"), F.when(k % 2 == 1, k).alias("tokens"))
    region = F.col("r_regionkey")
    rates = lake.table("region").where(region < 3).select(
        F.when(region == 0, "compute_core_hours").when(region == 1, "node_uptime").otherwise("per_token").alias("billing_model"),
        (region + 0.5).alias("rate"))
    return g.cost(usage, rates).select("event_id", "billing_model", F.round("cost", 6).alias("cost"))


ROLLUP = """
    SELECT platform, workload, count(*) AS requests, count(*) FILTER (success) AS successful_requests,
           count(*) FILTER (NOT success) AS failed_requests,
           round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_seconds,
           round(avg(latency_ms), 6) AS average_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms,
           round(CASE WHEN count(tokens) > 0 AND max(ts) > min(ts)
               THEN sum(tokens) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) END, 9) AS tokens_per_second
    FROM requests GROUP BY ALL"""


def _rounded(lake: Lake) -> DataFrame:
    digits = {"duration_seconds": 6, "average_latency_ms": 6, "p95_latency_ms": 6, "tokens_per_second": 9}
    return b.benchmark_rollup(lake.requests).withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("benchmark_rollup", ROLLUP, "requests")
def _(lake: Lake) -> DataFrame:
    return _rounded(lake)


COMPARE = "\n UNION ALL ".join(f"""
    SELECT '{d}' AS dimension, {', '.join(f'''max(CAST({d} AS VARCHAR)) FILTER (platform = '{p}') AS "{p}"''' for p in PLATFORMS)}
    FROM figures""" for d in ("requests", "failed_requests", "tokens"))


@query("platform_compare", f"""
    WITH figures AS (SELECT platform, count(*) AS requests, count(*) FILTER (NOT success) AS failed_requests,
                            CAST(sum(tokens) AS BIGINT) AS tokens FROM requests GROUP BY platform)
    {COMPARE}
""", "requests")
def _(lake: Lake) -> DataFrame:
    results = lake.requests.groupBy("platform").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("success")).alias("failed_requests"), F.sum("tokens").alias("tokens"))
    return b.compare_platforms(results, PLATFORMS, ["requests", "failed_requests", "tokens"])


@query("union_results", """
    SELECT platform, workload, latency_ms, tokens FROM requests WHERE platform = 'platform-2'
    UNION ALL SELECT platform, workload, latency_ms, NULL FROM requests WHERE platform <> 'platform-2'
""", "requests")
def _(lake: Lake) -> DataFrame:
    columns = ["platform", "workload", "latency_ms"]
    with_tokens = lake.requests.where(F.col("platform") == "platform-2").select(*columns, "tokens")
    return b.union_results(with_tokens, lake.requests.where(F.col("platform") != "platform-2").select(*columns))


@query("duration_leaderboard", """
    SELECT platform AS model, count(*) AS n, round(sum(latency_ms), 6) AS total, round(avg(latency_ms), 6) AS mean,
           round(median(latency_ms), 6) AS median, min(latency_ms) AS min, max(latency_ms) AS max
    FROM requests GROUP BY platform
""", "requests")
def _(lake: Lake) -> DataFrame:
    rows = lake.requests.select(F.col("platform").alias("model"), F.col("latency_ms").alias("duration"))
    return b.leaderboard(rows).withColumns({c: F.round(c, 6) for c in ("total", "mean", "median")})


@query("model_rank", """
    WITH best AS (SELECT workload AS task, platform AS model, max(latency_ms) AS duration FROM requests GROUP BY ALL)
    SELECT task, model, duration, CAST(rank() OVER (PARTITION BY task ORDER BY duration) AS INTEGER) AS rank,
           round(duration / max(CASE WHEN model = 'platform-0' THEN duration END) OVER (PARTITION BY task), 9) AS ratio
    FROM best
""", "requests")
def _(lake: Lake) -> DataFrame:
    best = lake.requests.groupBy(F.col("workload").alias("task"), F.col("platform").alias("model")).agg(
        F.max("latency_ms").alias("duration"))
    return b.model_rank(best, "platform-0").withColumn("ratio", F.round("ratio", 9))


def _documents(lake: Lake) -> DataFrame:
    event = F.col("event_id")
    fields = [
        F.when(event % 7 == 0, "").otherwise(F.concat(F.lit('"platform":"p'), (event % 4).cast("string"), F.lit('",'))),
        F.when(event % 5 == 0, '"billing_model":"free",').when(event % 5 == 1, '"billing_model":null,').otherwise('"billing_model":"per_token",'),
        F.lit('"workload":"chat",'),
        F.when(event % 11 == 0, '"requests":"many",').otherwise(F.concat(F.lit('"requests":'), (event % 50).cast("string"), F.lit(","))),
        F.concat(F.lit('"successful_requests":'), (event % 50).cast("string"), F.lit(',"failed_requests":')),
        F.when(event % 13 == 0, "null").when(event % 13 == 1, "1").otherwise("0"),
        F.when(event % 17 == 0, ',"gpu_count":1.5').otherwise(',"gpu_count":2'),
        F.when(event % 19 == 0, ',"duration_seconds":"long"').otherwise(',"duration_seconds":3'),
    ]
    text = F.concat(F.lit("{"), *fields, F.lit("}"))
    return lake.events.select(F.col("event_id").alias("id"), F.when(event % 23 == 0, "{broken").otherwise(text).alias("document"))


@query("validate_benchmark", """
    WITH ok AS (SELECT event_id AS id FROM events WHERE event_id % 23 <> 0)
    SELECT event_id AS id, '' AS field, 'unreadable' AS rule FROM events WHERE event_id % 23 = 0
    UNION ALL SELECT id, 'platform', 'required' FROM ok WHERE id % 7 = 0
    UNION ALL SELECT id, 'billing_model', 'enum' FROM ok WHERE id % 5 = 0
    UNION ALL SELECT id, 'requests', 'type' FROM ok WHERE id % 11 = 0
    UNION ALL SELECT id, 'failed_requests', 'type' FROM ok WHERE id % 13 = 0
    UNION ALL SELECT id, 'gpu_count', 'type' FROM ok WHERE id % 17 = 0
    UNION ALL SELECT id, 'duration_seconds', 'type' FROM ok WHERE id % 19 = 0
    UNION ALL SELECT id, 'requests', 'warning' FROM ok WHERE id % 13 = 1 AND id % 11 <> 0
""")
def _(lake: Lake) -> DataFrame:
    return b.violations(_documents(lake))


PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]  # all there are


@query("matrix_pivot", f"""
    SELECT p_brand, {", ".join(f"max(p_size) FILTER (p_type = '{kind}') AS \"{kind}\"" for kind in PART_TYPES)} FROM part GROUP BY p_brand
""")
def _(lake: Lake) -> DataFrame:
    cells = lake.table("part").groupBy("p_brand", "p_type").agg(F.max("p_size").alias("value"))
    return matrix.pivot_cells(cells, ["p_brand"], "p_type", PART_TYPES)
