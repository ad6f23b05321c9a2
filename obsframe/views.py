"""Telemetry views derived from the test tables, in Spark and, for the checks, in SQL.

The tables hold no telemetry of their own, so events stand in for metric samples,
requests and log lines, line items for spans and training steps, customers for token
bearers, conversations for agent turns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.operators.agents import pair_turns
from obsframe.plans.slices import scan

SERIES = ["name", "pod", "response_code"]
SHOP, BILLING = "shop.default.svc.cluster.local", "billing.default.svc.cluster.local"


def _s(column: str) -> Column:
    return F.col(column).cast("string")


class Lake:
    """The tables of one folder and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.table("conversations")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def counter_samples(self) -> DataFrame:
        user = F.col("user_id")
        rows = self.events.select(
            F.lit("requests_total").alias("name"), F.concat(F.lit("pod-"), (user % 4).cast("string")).alias("pod"),
            F.col("event_type").alias("response_code"),
            F.when(user % 4 < 3, SHOP).otherwise(BILLING).alias("destination_service"),
            F.when(user % 2 == 0, "v1").otherwise("v2").alias("destination_version"),
            "ts", "event_id", F.col("ts").cast("date").alias("day"))
        out = scan(rows, ["response_code", "pod", "day"], ["ts", "event_id"], sums={"value": F.lit(1.0)})
        return out.drop("event_id", "day")

    @cached_property
    def counter_maps(self) -> DataFrame:
        names = ["pod", "response_code", "destination_service", "destination_version"]
        labels = F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))])
        return self.counter_samples.select("name", labels.alias("labels"), "ts", "value")

    @cached_property
    def gauge_samples(self) -> DataFrame:
        user = F.col("user_id")
        return self.events.select(
            F.concat(F.when(user % 2 == 0, "containerapps_").otherwise("vm_"), "event_type").alias("name"),
            F.concat(F.lit("pod-"), (user % 4).cast("string")).alias("pod"), "event_type", "ts", "value")

    @cached_property
    def requests(self) -> DataFrame:
        event, user = F.col("event_id"), F.col("user_id")
        k = F.get_json_object("props", "$.k").cast("long")
        status = (F.when(F.col("event_type") == "error", F.when(event % 2 == 0, 500).otherwise(429))
                  .when(event % 17 == 0, 404).otherwise(200))
        return self.events.select(
            F.col("event_id").alias("request_id"), "ts", "user_id",
            F.concat(F.lit("platform-"), (user % 4).cast("string")).alias("platform"),
            F.col("event_type").alias("workload"), F.col("value").alias("latency_ms"),
            (F.col("event_type") != "error").alias("success"), status.alias("status"),
            F.when(k % 2 == 1, k).alias("tokens"))

    @cached_property
    def log_lines(self) -> DataFrame:
        event, user = F.col("event_id"), F.col("user_id")
        container = F.when(user % 3 == 0, "istio-proxy").when(user % 3 == 1, "istio-ingressgateway").otherwise("app")
        message = F.concat(
            F.lit("["), _s("event_id"), F.lit('] "GET /'), "event_type",
            F.when(event % 5 == 0, ' HTTP/1.10" ').otherwise(' HTTP/1.1" '),
            F.when(event % 3 == 0, "- ").otherwise("via_upstream "),
            F.when(event % 2 == 0, "outbound|").otherwise("inbound|"), F.lit("9080||"), "event_type",
            F.lit(".default.svc.cluster.local"))
        return self.events.select(
            F.col("ts").alias("TimeGenerated"), F.concat(F.lit("ns-"), (user % 5).cast("string")).alias("PodNamespace"),
            F.concat(F.lit("pod-"), _s("user_id")).alias("PodName"), container.alias("ContainerName"),
            message.alias("LogMessage"))

    @cached_property
    def targets(self) -> DataFrame:
        u = F.col("u")
        users = self.events.select(F.col("user_id").alias("u")).distinct()
        return users.select(
            u.alias("target_id"),
            F.concat(F.lit("10.0."), _s("u"), F.lit(".1:8080")).alias("address"),
            F.when(u % 3 == 0, "true").when(u % 3 == 1, "false").alias("scrape"),
            F.when(u % 4 == 0, F.concat(F.lit("/metrics/"), _s("u"))).alias("path"),
            F.when(u % 5 < 3, (9000 + u).cast("string")).alias("port"),
            F.concat(F.lit("ns-"), (u % 5).cast("string")).alias("namespace"),
            F.when(u % 2 == 0, "control").otherwise("worker").alias("app"))

    @cached_property
    def agent_turns(self) -> DataFrame:
        pairs = pair_turns(self.conversations)
        # Turns within one conversation are 20 seconds apart, conversations start each hour.
        offset = (F.col("conv_id") * 3600 + F.col("turn") * 20).cast("int")
        ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=offset.cast("decimal(18,6)"))
        return pairs.select(F.col("conv_id").alias("agent_id"), F.col("turn").alias("position"), ts.alias("ts"),
                            "query", "response")

    @cached_property
    def spans(self) -> DataFrame:
        order = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"]
        rows = scan(self.table("lineitem"), ["l_orderkey"], order, sums={"span_id": F.lit(1).cast("long")})
        span = F.col("span_id")
        return rows.select(
            F.col("l_orderkey").alias("trace_id"), "span_id",
            F.when(span > 1, F.floor(span / 2)).alias("parent_id"),
            F.concat(F.lit("svc-"), (F.col("l_suppkey") % 4).cast("string")).alias("service"),
            F.col("l_returnflag").alias("operation"),
            (F.col("l_orderkey") * 1000000 + span * 7).alias("start_us"),
            F.col("l_quantity").cast("long").alias("duration_us"))

    @cached_property
    def training_steps(self) -> DataFrame:
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        rows = self.table("lineitem").withColumn("epoch", F.col("l_orderkey") % 3)
        return scan(rows, ["epoch"], order, sums={"step": F.lit(1).cast("long")}).select(
            "epoch", "step", F.col("l_discount").alias("loss"))

    @cached_property
    def claims(self) -> DataFrame:
        key = F.col("c_custkey")
        body = F.concat(
            F.lit('{"iss":"https://issuer-'), F.when(key % 8 == 1, "x").otherwise("a"), F.lit('/","aud":"https://'),
            F.when(key % 8 == 2, "other").otherwise("gateway"), F.lit('","appid":"app-'),
            F.when(key % 8 == 3, "z").otherwise((key % 3).cast("string")), F.lit('"}'))
        part = F.rtrim(F.translate(F.base64(F.encode(body, "UTF-8")), "+/\r\n", "-_"), F.lit("="))
        token = F.when(key % 8 == 0, None).when(key % 8 == 4, "head.###.sign").otherwise(
            F.concat(F.lit("head."), part, F.lit(".sign")))
        return self.table("customer").select("c_custkey", token.alias("token"))


# The same views for DuckDB.
VIEW_SQL = {
    "counter_samples": f"""
        SELECT 'requests_total' AS name, 'pod-' || (user_id % 4) AS pod, event_type AS response_code,
               CASE WHEN user_id % 4 < 3 THEN '{SHOP}' ELSE '{BILLING}' END AS destination_service,
               CASE WHEN user_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS destination_version, ts,
               CAST(row_number() OVER (PARTITION BY event_type, user_id % 4, CAST(ts AS DATE) ORDER BY ts, event_id)
                    AS DOUBLE) AS value
        FROM events""",
    "gauge_samples": """
        SELECT CASE WHEN user_id % 2 = 0 THEN 'containerapps_' ELSE 'vm_' END || event_type AS name,
               'pod-' || (user_id % 4) AS pod, event_type, ts, value
        FROM events""",
    "requests": """
        SELECT event_id AS request_id, ts, user_id, 'platform-' || (user_id % 4) AS platform, event_type AS workload,
               value AS latency_ms, event_type <> 'error' AS success,
               CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 500 ELSE 429 END
                    WHEN event_id % 17 = 0 THEN 404 ELSE 200 END AS status,
               CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1
                    THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS tokens
        FROM events""",
    "log_lines": """
        SELECT ts AS "TimeGenerated", 'ns-' || (user_id % 5) AS "PodNamespace", 'pod-' || user_id AS "PodName",
               CASE user_id % 3 WHEN 0 THEN 'istio-proxy' WHEN 1 THEN 'istio-ingressgateway' ELSE 'app' END
                   AS "ContainerName",
               '[' || event_id || '] "GET /' || event_type
                   || CASE WHEN event_id % 5 = 0 THEN ' HTTP/1.10" ' ELSE ' HTTP/1.1" ' END
                   || CASE WHEN event_id % 3 = 0 THEN '- ' ELSE 'via_upstream ' END
                   || CASE WHEN event_id % 2 = 0 THEN 'outbound|' ELSE 'inbound|' END || '9080||' || event_type
                   || '.default.svc.cluster.local' AS "LogMessage"
        FROM events""",
    "targets": """
        SELECT u AS target_id, '10.0.' || u || '.1:8080' AS address,
               CASE u % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS scrape,
               CASE WHEN u % 4 = 0 THEN '/metrics/' || u END AS path,
               CASE WHEN u % 5 < 3 THEN CAST(9000 + u AS VARCHAR) END AS port, 'ns-' || (u % 5) AS namespace,
               CASE WHEN u % 2 = 0 THEN 'control' ELSE 'worker' END AS app
        FROM (SELECT DISTINCT user_id AS u FROM events)""",
    "agent_turns": """
        SELECT conv_id AS agent_id, turn AS position,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 20) AS ts, text AS query,
               CASE WHEN next_role = 'assistant' THEN next_text END AS response
        FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
              FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user'""",
    "spans": """
        SELECT l_orderkey AS trace_id, span_id, CASE WHEN span_id > 1 THEN span_id // 2 END AS parent_id,
               'svc-' || (l_suppkey % 4) AS service, l_returnflag AS operation,
               l_orderkey * 1000000 + span_id * 7 AS start_us, CAST(l_quantity AS BIGINT) AS duration_us
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber,
                  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS span_id
              FROM lineitem)""",
    "training_steps": """
        SELECT l_orderkey % 3 AS epoch, l_discount AS loss,
               row_number() OVER (PARTITION BY l_orderkey % 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS step
        FROM lineitem""",
    "claims": """
        SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 4 THEN 'head.###.sign' ELSE
            'head.' || rtrim(translate(to_base64(encode(body)), '+/', '-_'), '=') || '.sign' END AS token
        FROM (SELECT c_custkey, '{"iss":"https://issuer-' || CASE WHEN c_custkey % 8 = 1 THEN 'x' ELSE 'a' END
                  || '/","aud":"https://' || CASE WHEN c_custkey % 8 = 2 THEN 'other' ELSE 'gateway' END
                  || '","appid":"app-' || CASE WHEN c_custkey % 8 = 3 THEN 'z' ELSE CAST(c_custkey % 3 AS VARCHAR) END
                  || '"}' AS body FROM customer)""",
}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Put the named views in front of a query as common table expressions."""
    if not views:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in views)
    lead = "WITH RECURSIVE" if sql.lstrip().upper().startswith("WITH RECURSIVE") else "WITH"
    rest = sql.lstrip()
    for head in ("WITH RECURSIVE", "WITH"):
        if rest.upper().startswith(head):
            return f"{lead} {ctes},\n{rest[len(head):]}"
    return f"{lead} {ctes}\n{rest}"
