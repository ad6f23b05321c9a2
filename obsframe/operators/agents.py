"""Agent conversations, saved state and sessions.

A turn row has ``agent_id, position, ts, query, response``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsframe.functions.units import interval, parse_duration
from obsframe.plans.slices import SLICE, WHOLE_BYTES, last_rows, lookup_join, scan, settle, slice_by, slice_once, unslice

CONTEXT_TURNS = 5  # fixed value: earlier turns given to the model


def pair_turns(messages: DataFrame, key: str = "conv_id", order: str = "turn",
               slices: int | None = None) -> DataFrame:
    """Each user message with the assistant message right after it, or null.

    System messages do not count as neighbours.
    """
    talk = messages.where(F.col("role") != "system")
    out = scan(talk, [key], [order], slices=slices,
               following={"next_role": F.col("role"), "next_text": F.col("text")})
    answer = F.when(F.col("next_role") == "assistant", F.col("next_text"))
    return out.where(F.col("role") == "user").withColumnRenamed("text", "query").withColumn(
        "response", answer).drop("role", "next_role", "next_text")


def context(turns: DataFrame, n: int = CONTEXT_TURNS, slices: int | None = None) -> DataFrame:
    """Add ``context``: up to ``n`` answered turns before each turn, oldest first."""
    pair = F.struct("query", "response")
    return last_rows(turns, ["agent_id"], ["position"], n, pair, "context", slices)


def prompt_payload(turns: DataFrame, n: int = CONTEXT_TURNS, slices: int | None = None) -> DataFrame:
    """Add what the model is sent: role messages, and the same as a plain transcript."""
    rows = context(turns, n, slices)
    earlier = F.flatten(F.transform("context", lambda t: F.array(
        _message("user", t["query"]), _message("assistant", t["response"]))))
    messages = F.concat(earlier, F.array(_message("user", F.col("query"))))
    lines = F.transform("context", lambda t: F.concat(
        F.lit("User: "), F.coalesce(t["query"], F.lit("")),
        F.lit("\nAssistant: "), F.coalesce(t["response"], F.lit(""))))
    transcript = F.when(F.size("context") == 0, F.col("query")).otherwise(
        F.concat(F.array_join(lines, "\n"), F.lit("\nUser: "), F.col("query")))
    return rows.withColumns({"messages": messages, "transcript": transcript})


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def reply_record(turns: DataFrame, slices: int | None = None) -> DataFrame:
    """Per turn what the agent returns: texts, running count and history length."""
    out = scan(turns, ["agent_id"], ["position"], sums={"reflection_count": F.lit(1)}, slices=slices)
    return out.select("agent_id", "position", "query", "response", "reflection_count",
                      F.col("reflection_count").alias("history_length"))


def turn_outcome(reply: Column | str) -> Column:
    """``error``, ``simulated`` or ``ok`` by the marks that open a stored reply."""
    text = F.col(reply) if isinstance(reply, str) else reply
    return F.when(text.startswith("[Error] "), "error").when(text.startswith("[Simulated] "), "simulated").otherwise("ok")


def fold_state(turns: DataFrame, chunk: int = 1000, slices: int | None = None) -> DataFrame:
    """Turns to state documents: created, last updated, count and ordered history.

    A document holds at most ``chunk`` history entries; an agent with more turns has
    further documents, numbered by ``chunk_no``, so no history has to fit one row.
    ``first_turn`` counts the turns in the documents before.
    """
    numbered = scan(turns, ["agent_id"], ["position"], sums={"rn": F.lit(1)}, slices=slices,
                    totals={
                        "created_at": ("min", F.col("ts")), "last_updated": ("max", F.col("ts")),
                        "reflection_count": ("count", F.lit(1))})
    entry = F.struct("rn", F.struct("query", "response", F.col("ts").alias("timestamp")).alias("e"))
    return (numbered.withColumn("chunk_no", F.floor((F.col("rn") - 1) / chunk))
            .groupBy("agent_id", "created_at", "last_updated", "reflection_count", "chunk_no")
            .agg((F.min("rn") - 1).alias("first_turn"), F.sort_array(F.collect_list(entry))["e"].alias("history")))


def history_messages(state: DataFrame) -> DataFrame:
    """Saved history as alternating role messages; ``pos`` counts on over all documents of an agent."""
    both = F.flatten(F.transform("history", lambda h: F.array(_message("user", h["query"]), _message("bot", h["response"]))))
    return state.select(*[c for c in state.columns if c != "history"], F.posexplode(both).alias("__at", "m")).select(
        "*", (F.col("__at") + 2 * F.col("first_turn")).alias("pos"),
        F.col("m.role").alias("role"), F.col("m.content").alias("text")).drop("m", "__at")


def state_or_default(ids: DataFrame, state: DataFrame, now: str, key: str = "agent_id") -> DataFrame:
    """State of every id; an id without saved state gets the default record.

    ``state`` has one row per id with ``created_at`` and ``reflection_count``.
    """
    found = lookup_join(ids.select(key).distinct(), state.withColumn("__found", F.lit(True)), [key])
    moment = F.lit(now).cast(state.schema["created_at"].dataType)
    return found.select(
        key, F.coalesce("created_at", moment).alias("created_at"), moment.alias("resumed_at"),
        F.coalesce("reflection_count", F.lit(0)).alias("reflection_count"),
        F.coalesce("__found", F.lit(False)).alias("restored"))


def state_versions(states: DataFrame, key: str, order: list[str], slices: int | None = None) -> DataFrame:
    """Number the versions of each key from 1 and flag the latest."""
    out = scan(states, [key], order, sums={"version": F.lit(1)}, totals={"versions": ("count", F.lit(1))}, slices=slices)
    return out.withColumn("is_latest", F.col("version") == F.col("versions")).drop("versions")


def catalog_versions(deploys: DataFrame, name: str, order: list[str], definition: str,
                     slices: int | None = None) -> DataFrame:
    """Per deploy: is the definition reused or new, and which version is it then."""
    cut, slices = slice_once(deploys, [name], order, slices)
    seen = scan(cut, [name], order, previous={"__prev": F.col(definition), "__any": F.lit(True)}, slices=slices)
    changed = F.col("__any").isNull() | ~F.col(definition).eqNullSafe(F.col("__prev"))
    marked = seen.withColumn("is_new", changed).drop("__prev", "__any")
    return unslice(scan(marked, [name], order, sums={"version": F.col("is_new").cast("int")}, slices=slices))


def state_as_of(requests: DataFrame, versions: DataFrame, key: str, ts: str, payload: list[str],
                request_id: str, slices: int | None = None) -> DataFrame:
    """The state version in force at each request: the latest with ``version.ts <= request.ts``.

    Both sides go through one ordered pass, so no pair of rows is ever formed.
    """
    kind = F.struct(*payload)
    asked = requests.select(F.lit(1).alias("__side"), F.col(request_id).alias("__id"), key, ts,
                            F.lit(None).cast(versions.select(kind.alias("s")).schema["s"].dataType).alias("__state"))
    saved = versions.select(F.lit(0).alias("__side"), F.lit(None).cast(requests.schema[request_id].dataType).alias("__id"),
                            key, ts, kind.alias("__state"))
    rows = asked.unionByName(saved)
    newest = F.when(F.col("__side") == 0, F.struct(F.col(ts).alias("at"), F.col("__state").alias("s")))
    out = scan(rows, [key], [ts, "__side", "__id"], highs={"__now": newest}, slices=slices)
    return out.where(F.col("__side") == 1).select(
        F.col("__id").alias(request_id), key, ts, F.col("__now.at").alias("state_ts"),
        *[F.col(f"__now.s.{p}").alias(p) for p in payload])


def idle_sessions(df: DataFrame, key: str, ts: str = "ts", gap: str = "30m", slices: int | None = None) -> DataFrame:
    """Sessions of each key, ended by a pause longer than ``gap``: start, end, events.

    ``session_window`` merges rows exactly one gap apart, which is the rule wanted here.
    Of a hot key it finds the sessions of each slice; of those only the first of a slice
    can go on from an earlier slice, and the summary below tells which do.
    """
    cut = slice_by(df.select(key, ts), [key], [ts], slices)
    parts = cut.groupBy(*[c for c in cut.columns if c != ts], F.session_window(ts, interval(gap)).alias("w")).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("events")).drop("w")
    if SLICE not in parts.columns:
        return parts
    others, parts = parts.where(F.col(SLICE) == 0), parts.where(F.col(SLICE) > 0)
    across = Window.partitionBy(key).orderBy(SLICE)
    ends = parts.groupBy(key, SLICE).agg(
        F.min("start").alias("first"), F.max("start").alias("last"), F.max("end").alias("end"),
        F.count(F.lit(1)).alias("parts")).withColumn("before", F.lag("end").over(across))
    goes_on = F.coalesce(F.col("first") - F.col("before") <= F.expr(f"interval {interval(gap)}"), F.lit(False))
    opened = F.when(~goes_on | (F.col("parts") > 1), F.col("last"))
    began = F.max(opened).over(across.rowsBetween(Window.unboundedPreceding, -1))
    links = ends.withColumn("began", began).where(goes_on).select(key, SLICE, F.col("first").alias("start"), "began")
    linked = lookup_join(parts, links, [key, SLICE, "start"])
    whole = linked.groupBy(key, F.coalesce("began", "start").alias("start")).agg(
        F.max("end").alias("end"), F.sum("events").alias("events"))
    return whole.unionByName(others.drop(SLICE))


def pool_usage(df: DataFrame, key: str, ts: str = "ts", cooldown: str = "600s", most: int = 50, ready: int = 3,
               slices: int | None = None) -> DataFrame:
    """Sessions kept alive for a cooldown, as steps of concurrency against the pool's limits.

    One row per moment at which the number of live sessions changes.
    """
    sessions = idle_sessions(df, key, ts, cooldown, slices)
    hold = F.expr(f"interval {interval(cooldown)}")
    steps = sessions.select(F.explode(F.array(
        F.struct(F.col("start").alias("ts"), F.lit(1).alias("step")),
        F.struct((F.col("end") + hold).alias("ts"), F.lit(-1).alias("step")))).alias("s")).select("s.*")
    moments = settle(steps.groupBy("ts").agg(F.sum("step").alias("step")), slices, WHOLE_BYTES)
    out = scan(moments, [], ["ts"], sums={"live": F.col("step")}, slices=slices)
    return out.select("ts", "live", (F.col("live") > most).alias("over_limit"),
                      F.greatest(F.col("live") - ready, F.lit(0)).alias("beyond_ready"))


def replica_demand(df: DataFrame, every: str, per_replica: int = 10, least: int = 0, most: int = 10) -> DataFrame:
    """Replicas wanted per window: ``clamp(ceil(requests / per_replica), least, most)``."""
    load = df.groupBy(F.window("ts", interval(every)).start.alias("start")).agg(F.count(F.lit(1)).alias("concurrent"))
    wanted = F.ceil(F.col("concurrent") / per_replica)
    return load.withColumn("replicas", F.greatest(F.least(wanted, F.lit(most)), F.lit(least)).cast("long"))


def in_flight(requests: DataFrame, every: str, start: str = "start", end: str = "end", per_replica: int = 10, least: int = 0,
              most: int = 10, slices: int | None = None) -> DataFrame:
    """The most requests in flight at once in each window, and the replicas they want; windows without any have a row too.

    A request is in flight from its start up to, not including, its end; one that has not ended (null) stays in flight.
    Windows run from that of the first start to that of the last moment at which something starts or ends.
    """
    width = round(parse_duration(every).total_seconds() * 1_000_000)
    epoch = F.lit("1970-01-01 00:00:00").cast(requests.schema[start].dataType)
    micros = lambda c: F.timestamp_diff("MICROSECOND", epoch, F.col(c))
    known = requests.where(F.col(start).isNotNull()).select(micros(start).alias("from"), micros(end).alias("to")).where("to is null or to > from")
    moves = known.select(F.explode(F.array(
        F.struct(F.col("from").alias("at"), F.lit(1).alias("step")), F.struct(F.col("to").alias("at"), F.lit(-1).alias("step")))).alias("m")).select("m.*")
    steps = settle(moves.where("at is not null").groupBy("at").agg(F.sum("step").alias("step")), slices, WHOLE_BYTES)
    held = scan(steps, [], ["at"], sums={"live": F.col("step")}, following={"until": F.col("at")}, slices=slices)
    window = lambda c: F.floor(c / F.lit(width))
    spans = held.select("live", F.explode(F.sequence(window(F.col("at")), window(F.coalesce(F.col("until") - 1, F.col("at"))))).alias("w"))
    load = spans.groupBy("w").agg(F.max("live").alias("concurrent"))
    wanted = F.greatest(F.least(F.ceil(F.col("concurrent") / per_replica), F.lit(most)), F.lit(least)).cast("long")
    return load.select(F.timestamp_add("MICROSECOND", F.col("w") * width, epoch).alias("start"), "concurrent", wanted.alias("replicas"))


def tier_state(states: DataFrame, now: str, cool_after: int, expire_after: int, updated: str = "last_updated") -> DataFrame:
    """``hot``, ``cool`` or ``expire`` by whole days since the last update."""
    age = F.datediff(F.lit(now).cast("date"), F.col(updated).cast("date"))
    return states.withColumn("age_days", age.cast("long")).withColumn(
        "tier", F.when(age >= expire_after, "expire").when(age >= cool_after, "cool").otherwise("hot"))


def latest_inventory(records: DataFrame, computer: str, ts: list[str], columns: list[str]) -> DataFrame:
    """Latest record per computer."""
    newest = F.max_by(F.struct(*columns), F.struct(*ts))
    return records.groupBy(computer).agg(newest.alias("r")).select(computer, "r.*")


def assemble_deltas(deltas: DataFrame, segment: int = 10_000) -> DataFrame:
    """Ordered chunks of a reply to its reasoning text and its answer text.

    ``seq`` counts chunks from 0; a chunk that came twice counts once. A reply longer than ``segment`` chunks comes as
    several numbered segments, to be read one after the other.
    """
    piece = F.struct("seq", F.coalesce("reasoning", F.lit("")).alias("r"), F.coalesce("content", F.lit("")).alias("c"))
    return (deltas.groupBy("response_id", F.floor(F.col("seq") / segment).alias("segment_no"))
            .agg(F.sort_array(F.collect_set(piece)).alias("p"))
            .select("response_id", "segment_no", F.array_join(F.col("p")["r"], "").alias("reasoning"),
                    F.array_join(F.col("p")["c"], "").alias("answer")))
