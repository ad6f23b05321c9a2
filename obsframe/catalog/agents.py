"""Conversation, state and session queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.catalog.registry import query
from obsframe.operators import agents as a
from obsframe.plans.slices import scan
from obsframe.views import Lake

NOW = "2024-02-01 00:00:00"
SESSIONS = """
    marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL {gap} THEN 1 ELSE 0 END AS opens
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM marked),
    sessions AS (SELECT user_id, min(ts) AS start, max(ts) AS end_, count(*) AS events FROM numbered GROUP BY user_id, no)"""


@query("turn_pairs", "SELECT agent_id AS conv_id, position AS turn, query, response FROM agent_turns", "agent_turns")
def _(lake: Lake) -> DataFrame:
    return a.pair_turns(lake.conversations)


@query("context_last5", """
    SELECT agent_id, position, len(recent) AS turns, coalesce(list_aggregate(recent, 'string_agg', '|'), '') AS recent
    FROM (SELECT agent_id, position, list(query || '>' || coalesce(response, '')) OVER (
              PARTITION BY agent_id ORDER BY position ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent FROM agent_turns)
""", "agent_turns")
def _(lake: Lake) -> DataFrame:
    brief = F.transform("context", lambda t: F.concat(t["query"], F.lit(">"), F.coalesce(t["response"], F.lit(""))))
    out = a.context(lake.agent_turns)
    size = F.when(F.size("context") > 0, F.size("context").cast("long"))
    return out.select("agent_id", "position", size.alias("turns"), F.array_join(brief, "|").alias("recent"))


@query("prompt_payload", """
    WITH texts AS (SELECT agent_id, position, query, string_agg('User: ' || query || chr(10) || 'Assistant: '
              || coalesce(response, ''), chr(10)) OVER (PARTITION BY agent_id ORDER BY position
              ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS earlier,
              count(*) OVER (PARTITION BY agent_id ORDER BY position ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n
          FROM agent_turns)
    SELECT agent_id, position, 2 * n + 1 AS messages, 'user' AS last_role,
           CASE WHEN n = 0 THEN query ELSE earlier || chr(10) || 'User: ' || query END AS transcript FROM texts
""", "agent_turns")
def _(lake: Lake) -> DataFrame:
    out = a.prompt_payload(lake.agent_turns)
    return out.select("agent_id", "position", F.size("messages").cast("long").alias("messages"),
                      F.element_at("messages", -1)["role"].alias("last_role"), "transcript")


@query("reply_record", """
    SELECT agent_id, position, query, response, row_number() OVER w AS reflection_count,
           count(*) OVER w AS history_length FROM agent_turns WINDOW w AS (PARTITION BY agent_id ORDER BY position)
""", "agent_turns")
def _(lake: Lake) -> DataFrame:
    return a.reply_record(lake.agent_turns)


@query("turn_outcome", """
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'simulated' ELSE 'ok' END AS outcome FROM conversations
""")
def _(lake: Lake) -> DataFrame:
    mark = F.when(F.col("turn") % 3 == 0, "[Error] ").when(F.col("turn") % 3 == 1, "[Simulated] ").otherwise(" [Error] ")
    return lake.conversations.select("conv_id", "turn", a.turn_outcome(F.concat(mark, "text")).alias("outcome"))


@query("agent_state_fold", """
    WITH numbered AS (SELECT *, (row_number() OVER (PARTITION BY agent_id ORDER BY position) - 1) // 1000 AS chunk_no,
            min(ts) OVER w AS created_at, max(ts) OVER w AS last_updated, count(*) OVER w AS reflection_count
        FROM agent_turns WINDOW w AS (PARTITION BY agent_id))
    SELECT agent_id, chunk_no, created_at, last_updated, reflection_count,
           string_agg(query || '>' || coalesce(response, ''), chr(10) ORDER BY position) AS history
    FROM numbered GROUP BY agent_id, chunk_no, created_at, last_updated, reflection_count
""", "agent_turns")
def _(lake: Lake) -> DataFrame:
    lines = F.transform("history", lambda h: F.concat(h["query"], F.lit(">"), F.coalesce(h["response"], F.lit(""))))
    return a.fold_state(lake.agent_turns).select(
        "agent_id", "chunk_no", "created_at", "last_updated", "reflection_count", F.array_join(lines, "\n").alias("history"))


@query("history_messages", """
    WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY position) - 1 AS n FROM agent_turns)
    SELECT agent_id, 2 * n AS pos, 'user' AS role, query AS text FROM numbered
    UNION ALL SELECT agent_id, 2 * n + 1, 'bot', response FROM numbered
""", "agent_turns")
def _(lake: Lake) -> DataFrame:
    return a.history_messages(a.fold_state(lake.agent_turns)).select("agent_id", "pos", "role", "text")


@query("state_or_default", f"""
    WITH state AS (SELECT agent_id, min(ts) AS created_at, count(*) AS reflection_count FROM agent_turns GROUP BY agent_id)
    SELECT c.c_custkey AS agent_id, coalesce(s.created_at, TIMESTAMP '{NOW}') AS created_at,
           TIMESTAMP '{NOW}' AS resumed_at, coalesce(s.reflection_count, 0) AS reflection_count,
           s.agent_id IS NOT NULL AS restored
    FROM customer c LEFT JOIN state s ON s.agent_id = c.c_custkey
""", "agent_turns")
def _(lake: Lake) -> DataFrame:
    ids = lake.table("customer").select(F.col("c_custkey").alias("agent_id"))
    state = lake.agent_turns.groupBy("agent_id").agg(
        F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("reflection_count"))
    return a.state_or_default(ids, state, NOW)


@query("state_versions", """
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS version,
           row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1 AS is_latest FROM events
""")
def _(lake: Lake) -> DataFrame:
    return a.state_versions(lake.events.select("user_id", "event_id", "ts"), "user_id", ["ts"]).drop("ts")


@query("catalog_versions", """
    WITH seen AS (SELECT *, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts), true) AS is_new FROM events)
    SELECT user_id, event_id, is_new, CAST(sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (
               PARTITION BY user_id ORDER BY ts) AS BIGINT) AS version FROM seen
""")
def _(lake: Lake) -> DataFrame:
    deploys = lake.events.select("user_id", "event_id", "ts", "event_type")
    return a.catalog_versions(deploys, "user_id", ["ts"], "event_type").select("user_id", "event_id", "is_new", "version")


@query("state_as_of", """
    SELECT r.event_id, r.user_id, r.ts, v.ts AS state_ts, v.event_id AS version_id, v.value AS balance
    FROM (SELECT * FROM events WHERE event_type <> 'purchase') r
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') v ON r.user_id = v.user_id AND r.ts >= v.ts
""")
def _(lake: Lake) -> DataFrame:
    is_state = F.col("event_type") == "purchase"
    versions = lake.events.where(is_state).select("user_id", "ts", F.col("event_id").alias("version_id"), F.col("value").alias("balance"))
    return a.state_as_of(lake.events.where(~is_state), versions, "user_id", "ts", ["version_id", "balance"], "event_id")


@query("idle_sessions", f"""
    WITH {SESSIONS.format(gap="30 MINUTE")} SELECT user_id, start, end_ AS "end", events FROM sessions
""")
def _(lake: Lake) -> DataFrame:
    return a.idle_sessions(lake.events, "user_id", "ts", "30m")


@query("pool_sessions", f"""
    WITH {SESSIONS.format(gap="600 SECOND")},
    steps AS (SELECT start AS ts, 1 AS step FROM sessions UNION ALL SELECT end_ + INTERVAL 600 SECOND, -1 FROM sessions),
    moments AS (SELECT ts, sum(step) AS step FROM steps GROUP BY ts),
    running AS (SELECT ts, CAST(sum(step) OVER (ORDER BY ts) AS BIGINT) AS live FROM moments)
    SELECT ts, live, live > 4 AS over_limit, greatest(live - 3, 0) AS beyond_ready FROM running
""")
def _(lake: Lake) -> DataFrame:
    return a.pool_usage(lake.events, "user_id", "ts", "600s", most=4, ready=3)


@query("replica_demand", """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS concurrent,
           CAST(greatest(least(ceil(count(*) / 10), 10), 0) AS BIGINT) AS replicas FROM events GROUP BY ALL
""")
def _(lake: Lake) -> DataFrame:
    return a.replica_demand(lake.events, "1h")


@query("replica_demand_in_flight", """
    WITH req AS (SELECT ts AS s, ts + to_minutes(event_id % 97) AS e FROM events WHERE event_id % 97 > 0),
    hours AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(s)) FROM req), (SELECT max(e) FROM req), INTERVAL 1 HOUR)) AS start),
    moments AS (SELECT start AS m FROM hours UNION SELECT s FROM req),
    live AS (SELECT m, (SELECT count(*) FROM req WHERE s <= m) - (SELECT count(*) FROM req WHERE e <= m) AS n FROM moments)
    SELECT date_trunc('hour', m) AS start, max(n) AS concurrent,
           CAST(greatest(least(ceil(max(n) / 10), 10), 0) AS BIGINT) AS replicas FROM live GROUP BY ALL
""")
def _(lake: Lake) -> DataFrame:
    lasts = F.expr("make_dt_interval(0, 0, cast(event_id % 97 as int), 0)")
    requests = lake.events.select(F.col("ts").alias("start"), (F.col("ts") + lasts).alias("end"))
    return a.in_flight(requests, "1h")


@query("state_tiering", f"""
    SELECT user_id, max(ts) AS last_updated, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS age_days,
           CASE WHEN date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') >= 5 THEN 'expire'
                WHEN date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') >= 3 THEN 'cool' ELSE 'hot' END AS tier
    FROM events GROUP BY user_id
""")
def _(lake: Lake) -> DataFrame:
    states = lake.events.groupBy("user_id").agg(F.max("ts").alias("last_updated"))
    return a.tier_state(states, NOW, cool_after=3, expire_after=5)


@query("latest_inventory", """
    WITH latest AS (SELECT user_id, arg_max(event_type, ts) AS version FROM events GROUP BY user_id)
    SELECT version, count(*) AS computers FROM latest GROUP BY version
""")
def _(lake: Lake) -> DataFrame:
    records = lake.events.select("user_id", "ts", F.col("event_type").alias("version"))
    latest = a.latest_inventory(records, "user_id", ["ts"], ["version"])
    return latest.groupBy("version").agg(F.count(F.lit(1)).alias("computers"))


@query("delta_assembly", """
    SELECT user_id AS response_id, CAST(0 AS BIGINT) AS segment_no,
           coalesce(string_agg(CASE WHEN event_type = 'error' THEN props END, '' ORDER BY ts), '') AS reasoning,
           coalesce(string_agg(CASE WHEN event_type <> 'error' THEN event_type END, '' ORDER BY ts), '') AS answer
    FROM events GROUP BY user_id
""")
def _(lake: Lake) -> DataFrame:
    rows = scan(lake.events, ["user_id"], ["ts"], sums={"rn": F.lit(1)})
    thinking = F.col("event_type") == "error"
    deltas = rows.select(F.col("user_id").alias("response_id"), (F.col("rn") - 1).alias("seq"),
                         F.when(thinking, F.col("props")).alias("reasoning"),
                         F.when(~thinking, F.col("event_type")).alias("content"))
    return a.assemble_deltas(deltas)
