"""Source and sink queries. Files are first written by Spark from the tables, then read
back; formats of one file per record are parsed from rows that hold whole texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe import schemas
from obsframe.catalog.registry import query
from obsframe.operators import agents, matrix
from obsframe.plans.slices import scan
from obsframe.session import work_dir
from obsframe.sources import files, sinks, texts
from obsframe.views import Lake


def _text(name: str):
    return F.col(name).cast("string")


@query("src_jsonl", "SELECT doc_id AS id, text AS prompt FROM documents")
def _(lake: Lake) -> DataFrame:
    path = work_dir(lake.spark, "jsonl")
    lake.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("prompt")).write.json(path)
    return files.read_jsonl(lake.spark, path, schemas.PROMPT).drop(schemas.CORRUPT)


@query("src_chat_jsonl", """
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
           role, text AS content FROM conversations
""")
def _(lake: Lake) -> DataFrame:
    path, size = work_dir(lake.spark, "chat"), 1000
    numbered = scan(lake.conversations, ["conv_id"], ["turn"], sums={"rn": F.lit(1)})
    message = F.struct("rn", F.struct("role", F.col("text").alias("content")).alias("m"))
    chats = numbered.groupBy("conv_id", F.floor((F.col("rn") - 1) / size).alias("part")).agg(
        F.sort_array(F.collect_list(message))["m"].alias("messages"))
    chats.select(F.concat_ws(":", "conv_id", "part").alias("key"), "messages").write.json(path)
    out = files.read_chat_jsonl(lake.spark, path, key="key")
    key = F.split("key", ":")
    position = key[1].cast("long") * size + F.col("position")
    return out.select(key[0].alias("conv_id"), position.alias("position"), "role", "content")


@query("src_state_docs", """
    SELECT 'agent-' || agent_id AS agent_id, CAST(count(*) AS INTEGER) AS reflection_count,
           CAST(min(ts) AS VARCHAR) AS created_at, count(*) AS turns, arg_max(query, position) AS last_query
    FROM agent_turns GROUP BY agent_id
""", "agent_turns")
def _(lake: Lake) -> DataFrame:
    state = agents.fold_state(lake.agent_turns)
    entries = F.transform("history", lambda h: F.struct(h["query"].alias("query"), h["response"].alias("response"),
                                                        h["timestamp"].cast("string").alias("timestamp")))
    doc = F.to_json(F.struct(F.col("created_at").cast("string").alias("created_at"), "reflection_count", entries.alias("history")))
    rows = state.select(F.concat(F.lit("/state/agent-"), _text("agent_id"), F.lit(".json")).alias("path"), doc.alias("value"))
    out = files.parse_state(rows)
    return out.select("agent_id", "reflection_count", "created_at", F.size("history").cast("long").alias("turns"),
                      F.element_at("history", -1)["query"].alias("last_query"))


@query("src_response_corpus", """
    SELECT 'model-a-' || (turn % 3) AS model, 'task' || conv_id AS task, CAST(length(text) || '.25' AS DOUBLE) AS duration,
           'Duration: 1.0 seconds.' || chr(10) || text AS body, false AS parse_error FROM conversations
""")
def _(lake: Lake) -> DataFrame:
    path = F.concat(F.lit("/out/response-model-a-"), (F.col("turn") % 3).cast("string"), F.lit("-task"), _text("conv_id"), F.lit(".txt"))
    value = F.concat(F.lit("Duration: "), F.char_length("text").cast("string"),
                     F.lit(".25 seconds.\n\nCode generated:\nDuration: 1.0 seconds.\n"), "text")
    return texts.parse_responses(lake.conversations.select(path.alias("path"), value.alias("value")))


@query("src_prompt_files", """
    SELECT 'doc' || doc_id AS task, CASE WHEN doc_id % 10 = 0 THEN 'other' ELSE 'doc' || doc_id END AS id, text AS prompt,
           false AS parse_error FROM documents
""")
def _(lake: Lake) -> DataFrame:
    name = F.concat(F.lit("doc"), _text("doc_id"))
    own = F.when(F.col("doc_id") % 10 == 0, "other").otherwise(name)
    value = F.concat(F.lit("id: "), own, F.lit("\nprompt: |\n"), "text")
    path = F.concat(F.lit("/in/prompts-"), name, F.lit(".yaml"))
    return texts.parse_prompts(lake.documents.select(path.alias("path"), value.alias("value")))


@query("src_exposition", """
    SELECT event_id, 'requests_total' AS name, event_type AS code, 'a "quoted" \\ path' AS path, value,
           date_trunc('millisecond', ts) AS ts FROM events
""")
def _(lake: Lake) -> DataFrame:
    sample = F.concat(F.lit('requests_total{code="'), "event_type", F.lit('",path="a \\"quoted\\" \\\\ path"} '),
                      _text("value"), F.lit(" "), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
    lines = lake.events.select("event_id", F.explode(F.array(F.lit("# TYPE requests_total counter"), sample, F.lit(""))).alias("value"))
    out = texts.parse_exposition(lines).where(F.col("parse_error").isNull())
    return out.select("event_id", "name", F.col("labels.code").alias("code"), F.col("labels.path").alias("path"), "value",
                      F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("src_container_logs", "SELECT * FROM log_lines", "log_lines")
def _(lake: Lake) -> DataFrame:
    path = work_dir(lake.spark, "logs")
    lake.log_lines.withColumn("TimeGenerated", F.col("TimeGenerated").cast("timestamp")).write.parquet(path)
    return files.read_logs(lake.spark, path).withColumn("TimeGenerated", F.col("TimeGenerated").cast("timestamp_ntz"))


@query("src_traffic_log", """
    SELECT request_id, strftime(ts, '%H:%M:%S') AS clock, request_id AS n, status, NULL AS parse_error FROM requests
    WHERE request_id % 50 <> 0
    UNION ALL SELECT request_id, NULL, NULL, NULL, 'curl: (7) failed' FROM requests WHERE request_id % 50 = 0
""", "requests")
def _(lake: Lake) -> DataFrame:
    line = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(": "), _text("request_id"), F.lit(" "), _text("status"))
    value = F.when(F.col("request_id") % 50 == 0, "curl: (7) failed").otherwise(line)
    return texts.parse_traffic(lake.requests.select("request_id", value.alias("value")))


@query("src_spans", """
    SELECT CAST(trace_id AS VARCHAR) AS trace_id, CAST(span_id AS VARCHAR) AS span_id, CAST(parent_id AS VARCHAR) AS parent_id,
           service, operation, start_us, make_timestamp(start_us) AS start, duration_us FROM spans
""", "spans")
def _(lake: Lake) -> DataFrame:
    path = work_dir(lake.spark, "spans")
    lake.spans.select(
        _text("trace_id").alias("traceId"), _text("span_id").alias("id"), _text("parent_id").alias("parentId"),
        F.col("operation").alias("name"), F.col("start_us").alias("timestamp"), F.col("duration_us").alias("duration"),
        F.struct(F.col("service").alias("serviceName")).alias("localEndpoint")).write.json(path)
    out = files.read_spans(lake.spark, path).drop("tags", schemas.CORRUPT)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _matrix(lake: Lake) -> DataFrame:
    """One small Markdown document with two tables per part."""
    flag = F.when(F.col("p_size") % 2 == 0, "✅ yes").otherwise("❌ no")
    value = F.concat(
        F.lit("# Title\n\n| Model | Format | Score |\n|:---|---|:-:|\n| **A** | "), flag, F.lit(" | AUC "),
        _text("p_retailprice"), F.lit(" |\n| B | "), "p_type", F.lit(" | accuracy: "), _text("p_size"),
        F.lit("% |\n\ntext | not a table\n\n| X | Y |\n|---|---|\n| "), "p_name", F.lit(" | a \\| b |\n"))
    path = F.concat(F.lit("/docs/part"), _text("p_partkey"), F.lit(".md"))
    return lake.table("part").select(path.alias("path"), value.alias("value"))


CELLS = r"""
    cells AS (
        SELECT 'part' || p_partkey || '.md' AS doc, c.* FROM part, LATERAL (VALUES
            (0, 0, '**A**', 'Format', CASE WHEN p_size % 2 = 0 THEN '✅ yes' ELSE '❌ no' END),
            (0, 0, '**A**', 'Score', 'AUC ' || p_retailprice), (0, 1, 'B', 'Format', p_type),
            (0, 1, 'B', 'Score', 'accuracy: ' || p_size || '%'), (1, 0, p_name, 'Y', 'a \| b')
        ) AS c(table_no, row_no, entity, attribute, value))"""


@query("src_md_matrix", f"WITH {CELLS} SELECT * FROM cells")
def _(lake: Lake) -> DataFrame:
    return texts.parse_matrices(_matrix(lake))


@query("matrix_flags", f"""
    WITH {CELLS} SELECT doc, table_no, attribute, count(*) FILTER (starts_with(value, '✅')) AS supported,
        count(*) FILTER (starts_with(value, '❌')) AS unsupported, count(*) AS cells FROM cells GROUP BY ALL
""")
def _(lake: Lake) -> DataFrame:
    return matrix.flag_counts(texts.parse_matrices(_matrix(lake)))


@query("matrix_numbers", """
    SELECT 'part' || p_partkey || '.md' AS doc, '**A**' AS entity, 'AUC' AS label, p_retailprice AS number, false AS is_percent FROM part
    UNION ALL SELECT 'part' || p_partkey || '.md', 'B', 'accuracy', CAST(p_size AS DOUBLE), true FROM part
""")
def _(lake: Lake) -> DataFrame:
    out = matrix.labelled_numbers(texts.parse_matrices(_matrix(lake)))
    return out.select("doc", "entity", "label", "number", "is_percent")


@query("src_os_inventory", """
    SELECT 'node-' || user_id AS "Computer", strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "Timestamp", event_type AS "OsVersion" FROM events
""")
def _(lake: Lake) -> DataFrame:
    record = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("Timestamp"),
                                F.concat(F.lit("node-"), _text("user_id")).alias("Computer"), F.col("event_type").alias("OsVersion")))
    rows = lake.events.select(F.lit("/share/os.json").alias("path"), F.concat(F.lit("\ufeff"), record).alias("value"))
    return files.parse_os_inventory(rows).select("Computer", "Timestamp", "OsVersion")


@query("sink_upsert_latest", """
    SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id
""")
def _(lake: Lake) -> DataFrame:
    path = work_dir(lake.spark, "latest")
    states = lake.events.select("user_id", "ts", "event_id", "event_type")
    # Two batches, the later one with older rows among its own; the first is then repeated.
    for number, odd in ((0, 1), (1, 0), (0, 1)):
        sinks.upsert_latest(states.where(F.col("event_id") % 2 == odd), "user_id", ["ts"], path, number, "first")
    return sinks.read_latest(lake.spark, path, "user_id", ["ts"])


@query("sink_versions", """
    SELECT agent_id, position, row_number() OVER (PARTITION BY agent_id ORDER BY position) AS version,
           row_number() OVER (PARTITION BY agent_id ORDER BY position DESC) = 1 AS is_latest FROM agent_turns
""", "agent_turns")
def _(lake: Lake) -> DataFrame:
    path = work_dir(lake.spark, "versions")
    turns = lake.agent_turns.select("agent_id", "position")
    for number in (0, 1):
        sinks.append_versions(turns.where(F.col("agent_id") % 2 == number), path, number, "first")
    return sinks.read_versions(lake.spark, path, "agent_id", ["position"])



@query("sink_snapshot", """
    SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id
""")
def _(lake: Lake) -> DataFrame:
    path, states = work_dir(lake.spark, "snapshot"), lake.events.select("user_id", "ts", "event_id", "event_type")
    # Two compactions, a batch after them, and a batch that comes again after it was folded in.
    for number in range(4):
        sinks.upsert_latest(states.where(F.col("event_id") % 4 == number), "user_id", ["ts"], path, number, "first")
        if number in (1, 2):
            sinks.compact(lake.spark, path, "user_id", ["ts"], buckets=4)
    sinks.upsert_latest(states.where(F.col("event_id") % 4 == 0), "user_id", ["ts"], path, 0, "first")
    return sinks.read_latest(lake.spark, path, "user_id", ["ts"])
