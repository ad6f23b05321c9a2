"""Log, route, text and nested-field queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.catalog.registry import query
from obsframe.functions import text as t
from obsframe.operators import logs
from obsframe.operators.corpus import normalize_prompts, response_text
from obsframe.operators.gateway import Route, match_route_table, match_routes
from obsframe.views import Lake

TERM = r"(^|[^0-9A-Za-z]){}($|[^0-9A-Za-z])"
HTTP = "regexp_matches(\"LogMessage\", '(?i)" + TERM.format(r"HTTP/1\.1") + "')"
VIA = "regexp_matches(\"LogMessage\", '(?i)" + TERM.format("via_upstream") + "')"


@query("log_filter_source", """SELECT * FROM log_lines WHERE "ContainerName" = 'istio-proxy'""", "log_lines")
def _(lake: Lake) -> DataFrame:
    return logs.from_container(lake.log_lines)


@query("log_filter_in", """
    SELECT * FROM log_lines WHERE "ContainerName" IN ('istio-proxy', 'istio-ingressgateway')
""", "log_lines")
def _(lake: Lake) -> DataFrame:
    return logs.from_containers(lake.log_lines, [logs.SIDECAR, logs.INGRESS])


@query("log_has_term", rf"""
    SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?i){TERM.format("the")}')
""")
def _(lake: Lake) -> DataFrame:
    return lake.conversations.where(t.has("text", "the")).select("conv_id", "turn")


@query("log_access_query", f"""
    SELECT "TimeGenerated", "PodNamespace", "PodName", "LogMessage" FROM log_lines
    WHERE "ContainerName" = 'istio-proxy' AND {HTTP} AND {VIA} ORDER BY "TimeGenerated" DESC
""", "log_lines")
def _(lake: Lake) -> DataFrame:
    return logs.access_lines(lake.log_lines)


@query("log_direction", r"""
    SELECT "TimeGenerated", "PodName", "LogMessage",
           CASE WHEN regexp_matches("LogMessage", '(?i)(^|[^0-9A-Za-z])outbound\|') THEN 'outbound'
                WHEN regexp_matches("LogMessage", '(?i)(^|[^0-9A-Za-z])inbound\|') THEN 'inbound' END AS direction
    FROM log_lines WHERE "ContainerName" = 'istio-proxy'
        AND regexp_matches("LogMessage", '(?i)(^|[^0-9A-Za-z])outbound\|')
""", "log_lines")
def _(lake: Lake) -> DataFrame:
    return logs.direction_lines(lake.log_lines).withColumn("direction", logs.direction("LogMessage"))


@query("log_service_filter", rf"""
    SELECT "TimeGenerated", "PodName", "LogMessage" FROM log_lines WHERE "ContainerName" = 'istio-proxy'
        AND regexp_matches("LogMessage", '(?i){TERM.format("view.default.svc.cluster.local")}')
""", "log_lines")
def _(lake: Lake) -> DataFrame:
    return logs.service_lines(lake.log_lines, "view.default.svc.cluster.local")


@query("log_troubleshoot", f"""
    SELECT * FROM log_lines WHERE "ContainerName" IN ('istio-proxy', 'istio-ingressgateway') AND {HTTP}
""", "log_lines")
def _(lake: Lake) -> DataFrame:
    return logs.troubleshoot(lake.log_lines)


@query("order_desc", 'SELECT "TimeGenerated", "PodName" FROM log_lines ORDER BY "TimeGenerated" DESC', "log_lines")
def _(lake: Lake) -> DataFrame:
    return logs.newest_first(lake.log_lines.select("TimeGenerated", "PodName"))


@query("events_by_last_ts", "SELECT event_id, event_type, ts FROM events ORDER BY ts")
def _(lake: Lake) -> DataFrame:
    return logs.oldest_first(lake.events.select("event_id", "event_type", "ts"), "ts")


@query("tail_per_key", """
    SELECT "PodName", "TimeGenerated", "LogMessage",
           CAST(row_number() OVER (PARTITION BY "PodName" ORDER BY "TimeGenerated" DESC, "LogMessage" DESC) AS INTEGER)
               AS from_end
    FROM log_lines QUALIFY from_end <= 50
""", "log_lines")
def _(lake: Lake) -> DataFrame:
    lines = lake.log_lines.select("PodName", "TimeGenerated", "LogMessage")
    return logs.tail_per_key(lines, ["PodName"], ["TimeGenerated", "LogMessage"], 50)


@query("route_match", """
    WITH paths AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, path,
           CASE WHEN path = '/en/25' THEN 1 WHEN path LIKE '/en/%' THEN 2 WHEN path = '/fr' THEN 3
                WHEN path LIKE '/fr/8%' THEN 4 WHEN path LIKE '/de%' THEN 5 END AS rule_no,
           CASE WHEN path = '/en/25' THEN 'front' WHEN path LIKE '/en/%' THEN 'english' WHEN path = '/fr' THEN 'front'
                WHEN path LIKE '/fr/8%' THEN 'french' WHEN path LIKE '/de%' THEN 'german' END AS destination
    FROM paths
""")
def _(lake: Lake) -> DataFrame:
    rules = [Route("exact", "/en/25", "front"), Route("prefix", "/en/", "english"), Route("exact", "/fr", "front"),
             Route("prefix", "/fr/8", "french"), Route("prefix", "/de", "german")]
    paths = lake.table("pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1).alias("path"))
    return match_routes(paths, rules)


@query("route_match_table", """
    WITH paths AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages),
    rules AS (SELECT c_custkey AS rule_no, CASE WHEN c_custkey % 3 = 0 THEN 'exact' ELSE 'prefix' END AS kind, c_mktsegment AS destination,
                     '/' || CASE c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END || '/' || (c_custkey % 200) AS uri
              FROM customer WHERE c_custkey % 10 < 7),
    hits AS (SELECT page_id, min(rule_no) AS rule_no FROM paths JOIN rules ON path = uri OR (kind = 'prefix' AND starts_with(path, uri)) GROUP BY page_id)
    SELECT p.page_id, p.path, h.rule_no, r.destination FROM paths p LEFT JOIN hits h USING (page_id) LEFT JOIN rules r USING (rule_no)
""")
def _(lake: Lake) -> DataFrame:
    key = F.col("c_custkey")
    tongue = F.when(key % 4 == 0, "en").when(key % 4 == 1, "fr").when(key % 4 == 2, "de").otherwise("es")
    rules = lake.table("customer").where(key % 10 < 7).select(
        key.alias("rule_no"), F.when(key % 3 == 0, "exact").otherwise("prefix").alias("kind"), F.col("c_mktsegment").alias("destination"),
        F.concat(F.lit("/"), tongue, F.lit("/"), (key % 200).cast("string")).alias("uri"))
    paths = lake.table("pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1).alias("path"))
    return match_route_table(paths, rules)


@query("contains_ci", "SELECT doc_id FROM documents WHERE contains(lower(text), 'there')")
def _(lake: Lake) -> DataFrame:
    return lake.documents.where(t.contains_ci("text", "THERE")).select("doc_id")


@query("nested_project", """
    SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS gpu,
           json_extract_string(props, '$.missing') AS missing, event_type AS pool
    FROM events WHERE event_type = 'purchase'
""")
def _(lake: Lake) -> DataFrame:
    nodes = lake.events.select("event_id", "props", F.struct(F.create_map(F.lit("pool"), "event_type").alias("labels")).alias("meta"))
    out = logs.nested_project(nodes, F.col("meta.labels")["pool"] == "purchase", id="event_id", gpu="props:k",
                              missing="props:missing", pool="meta.labels.pool")
    return out.withColumn("gpu", F.col("gpu").cast("long"))


@query("array_count_where", """
    SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positives FROM embeddings
""")
def _(lake: Lake) -> DataFrame:
    signs = F.transform("embedding", lambda x: F.struct(F.when(x > 0, "up").otherwise("down").alias("sign")))
    return lake.table("embeddings").select("vec_id", logs.array_count_where(signs, "sign", "up").cast("long").alias("positives"))


@query("normalize_prompts", r"""
    SELECT conv_id * 1000 + turn AS id, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS prompt,
           length(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS length
    FROM (SELECT conv_id, turn, role, '  ' || chr(160) || text || chr(9) || ' ' AS text FROM conversations)
    WHERE role = 'user'
""")
def _(lake: Lake) -> DataFrame:
    padded = F.concat(F.lit("   "), "text", F.lit("\t "))
    rows = lake.conversations.where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), padded.alias("prompt"))
    return normalize_prompts(rows)


@query("response_text", """
    SELECT conv_id, turn, role || ': ' || text AS answer FROM conversations
""")
def _(lake: Lake) -> DataFrame:
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    content = F.array(part("output_text", F.concat("role", F.lit(": "))), part("refusal", F.lit("not this")),
                      part("output_text", F.col("text")))
    kind = "array<struct<type: string, text: string>>"
    reply = F.to_json(F.array(F.struct(F.lit("reasoning").alias("type"), F.lit(None).cast(kind).alias("content")),
                              F.struct(F.lit("message").alias("type"), content.alias("content"))))
    rows = lake.conversations.select("conv_id", "turn", reply.alias("output"))
    return rows.select("conv_id", "turn", response_text("output").alias("answer"))


@query("fn_text_helpers", """
    SELECT page_id, regexp_replace(url, '/+$', '') || '/v1/chat' AS joined, substr(html, 1, 100) AS preview,
           replace(replace('__HOST__/__PAGE__', '__HOST__', url), '__PAGE__', CAST(page_id AS VARCHAR)) AS filled
    FROM pages
""")
def _(lake: Lake) -> DataFrame:
    filled = t.fill_template(F.lit("__HOST__/__PAGE__"), {"__HOST__": F.col("url"), "__PAGE__": F.col("page_id").cast("string")})
    return lake.table("pages").select("page_id", t.url_join("url", "/v1/chat").alias("joined"),
                                      t.preview("html").alias("preview"), filled.alias("filled"))


@query("fn_iso_utc_and_defaults", """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, round(value / 7, 3) AS rounded,
           coalesce(json_extract_string(props, '$.none'), 'unknown') AS label FROM events
""")
def _(lake: Lake) -> DataFrame:
    return lake.events.select("event_id", t.iso_utc("ts").alias("iso"), t.round3(F.col("value") / 7).alias("rounded"),
                              t.get_or(t.json_field("props", "none"), "unknown").alias("label"))
