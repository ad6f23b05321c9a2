"""Gateway requests: token claims, limits, retries, cache, probes, routes, quota and cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.functions.tokens import claim, token_payload
from obsframe.functions.units import interval
from obsframe.plans.slices import attach, lookup_join, scan, slice_once, unslice


def audit_claims(df: DataFrame, issuers: list[str], audiences: list[str] | None = None,
                 claim_name: str | None = None, allowed: list[str] | None = None, token: str = "token") -> DataFrame:
    """Why a request passes or fails the gateway's claim rules, and its status.

    Only issuers are always checked; audience and claim rules apply where given. The
    signature is not checked.
    """
    # Each read of the token is a column of its own, so it happens once per row.
    rows = df.withColumn("__body", token_payload(F.col(token))).withColumns({
        "__iss": claim(F.col("__body"), "iss"), "__aud": claim(F.col("__body"), "aud"),
        "__claim": claim(F.col("__body"), claim_name or "sub")})
    verdict = F.when(F.coalesce(F.col(token), F.lit("")) == "", "missing token")
    verdict = verdict.when(F.col("__body").isNull(), "unreadable token")
    verdict = verdict.when(~_one_of(F.col("__iss"), issuers), "wrong issuer")
    if audiences is not None:
        verdict = verdict.when(~_one_of(F.col("__aud"), audiences), "wrong audience")
    if claim_name is not None:
        verdict = verdict.when(~_one_of(F.col("__claim"), allowed or []), "claim not allowed")
    rows = rows.withColumn("verdict", verdict.otherwise("ok")).drop("__body", "__iss", "__aud", "__claim")
    return rows.withColumn("status", F.when(F.col("verdict") == "ok", 200).otherwise(401))


def _one_of(value: Column, allowed: list[str]) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False)) if allowed else F.lit(False)


def rate_limit(df: DataFrame, key: str, calls: int, period: str, order: list[str], ts: str = "ts",
               slices: int | None = None) -> DataFrame:
    """Number the calls of each key within its period and mark those over ``calls``."""
    timed = df.withColumn("period_start", F.window(ts, interval(period)).start)
    out = scan(timed, [key, "period_start"], order, sums={"call_no": F.lit(1)}, slices=slices)
    return out.withColumn("limited", F.col("call_no") > calls)


def token_limit(df: DataFrame, key: str, per_minute: int, order: list[str], ts: str = "ts", tokens: str = "tokens",
                slices: int | None = None) -> DataFrame:
    """Sum tokens per key and minute and mark calls from which on the sum passes the limit."""
    timed = df.withColumn("minute", F.date_trunc("minute", ts).cast(df.schema[ts].dataType))
    out = scan(timed, [key, "minute"], order, sums={"used": F.col(tokens)}, slices=slices)
    return out.withColumn("limited", F.col("used") > per_minute)


def retry_collapse(attempts: DataFrame, request: list[str], order: list[str], status: str = "status") -> DataFrame:
    """Attempts of a request as one row: how many, the last status, and retries after 429 or 5xx."""
    again = (F.col(status) == 429) | F.col(status).between(500, 599)
    last = F.max_by(status, F.struct(*order))
    last_again = F.max_by(again, F.struct(*order))
    return attempts.groupBy(*request).agg(
        F.count(F.lit(1)).alias("attempts"), last.alias("final_status"),
        (F.count_if(again) - F.when(last_again, 1).otherwise(0)).alias("retries"))


def prompt_cache(calls: DataFrame, prompt: str, order: list[str], slices: int | None = None) -> DataFrame:
    """``hit`` where the same prompt was sent before, else ``miss``."""
    hashed = calls.withColumn("prompt_hash", F.md5(F.col(prompt)))
    out = scan(hashed, ["prompt_hash"], order, previous={"__seen": F.lit(True)}, slices=slices)
    return out.withColumn("cache", F.when(F.col("__seen"), "hit").otherwise("miss")).drop("__seen")


def probe_state(probes: DataFrame, key: str, order: list[str], ok: str, fail_n: int, ok_n: int = 1,
                slices: int | None = None) -> DataFrame:
    """Health after each probe: ``fail_n`` failures in a row make it unhealthy, ``ok_n`` successes healthy."""
    cut, slices = slice_once(probes, [key], order, slices)
    rows = scan(cut, [key], order, sums={"__rn": F.lit(1)}, slices=slices)
    good, spot = F.col(ok), F.col("__rn")
    rows = scan(rows, [key], order, slices=slices, highs={
        "__last_ok": F.when(good, spot), "__last_bad": F.when(~good, spot)})
    rows = rows.withColumns({
        "failures_in_row": spot - F.coalesce("__last_ok", F.lit(0)),
        "successes_in_row": spot - F.coalesce("__last_bad", F.lit(0))})
    if ok_n == 1:
        sick = F.col("failures_in_row") >= fail_n
    else:
        rows = scan(rows, [key], order, slices=slices, highs={
            "__sick": F.when(F.col("failures_in_row") >= fail_n, spot),
            "__well": F.when(F.col("successes_in_row") >= ok_n, spot)})
        sick = F.coalesce("__sick", F.lit(0)) > F.coalesce("__well", F.lit(0))
    return unslice(rows.withColumn("healthy", ~sick).drop(
        "__rn", "__last_ok", "__last_bad", "__sick", "__well"))


@dataclass(frozen=True)
class Route:
    """A URI rule: ``exact`` or ``prefix``, and where it leads."""

    kind: str
    uri: str
    destination: str


def match_routes(requests: DataFrame, rules: list[Route], path: str = "path") -> DataFrame:
    """First rule each request matches, in rule order. Rules are literals, so nothing is shuffled."""
    number, destination = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, rule in reversed(list(enumerate(rules, 1))):
        hit = F.col(path) == rule.uri if rule.kind == "exact" else F.startswith(F.col(path), F.lit(rule.uri))
        number = F.when(hit, F.lit(i)).otherwise(number)
        destination = F.when(hit, F.lit(rule.destination)).otherwise(destination)
    return requests.withColumns({"rule_no": number, "destination": destination})


def match_route_table(requests: DataFrame, rules: DataFrame, path: str = "path", slices: int | None = None) -> DataFrame:
    """``match_routes`` for a table of rules: ``rule_no`` (the least wins), ``kind``, ``uri``, ``destination``.

    Every different path is looked up once, as a whole and by its beginnings of those lengths that rules have: equality alone
    joins, and a path asked for by very many requests is one row. The lengths are numbers up to that of the longest rule.
    """
    filed = rules.where(F.col("kind").isin("exact", "prefix") & F.col("uri").isNotNull()).groupBy("kind", "uri").agg(
        F.min(F.struct("rule_no", "destination")).alias("__rule"))
    lengths = sorted(r[0] for r in rules.where("kind = 'prefix'").select(F.length("uri")).where("uri is not null").distinct().collect())
    known = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    beginnings = F.transform(F.filter(known, lambda n: n <= F.length("__path")),
                             lambda n: F.struct(F.lit("prefix").alias("kind"), F.substring(F.col("__path"), F.lit(1), n).alias("uri")))
    whole = F.array(F.struct(F.lit("exact").alias("kind"), F.col("__path").alias("uri")))
    paths = requests.select(F.col(path).alias("__path")).where("__path is not null").distinct()
    asked = paths.select("__path", F.explode(F.concat(whole, beginnings)).alias("k")).select("__path", "k.*")
    found = attach(asked, filed, ["kind", "uri"], "inner", slices).groupBy("__path").agg(F.min("__rule").alias("__rule"))
    lookup = found.select(F.col("__path").alias(path), F.col("__rule.rule_no").alias("rule_no"), F.col("__rule.destination").alias("destination"))
    return attach(requests, lookup, [path], "left", slices)


def quota_headroom(usage: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Used, limit and what remains, per resource. Usage is summed before the join."""
    used = usage.groupBy(key).agg(F.sum("used").alias("used"))
    out = lookup_join(limits, used, [key])
    return out.select(key, F.coalesce("used", F.lit(0)).alias("used"), "limit",
                      (F.col("limit") - F.coalesce("used", F.lit(0))).alias("remaining"))


def cost(usage: DataFrame, rates: DataFrame, slices: int | None = None) -> DataFrame:
    """Quantity times the rate of its billing model; null where the quantity was not measured.

    ``usage`` has one row per result with ``billing_model, core_hours, uptime_hours, tokens``.
    """
    measured = (F.when(F.col("billing_model") == "compute_core_hours", F.col("core_hours"))
                .when(F.col("billing_model") == "node_uptime", F.col("uptime_hours"))
                .when(F.col("billing_model") == "per_token", F.col("tokens").cast("double")))
    return attach(usage.withColumn("quantity", measured), rates, ["billing_model"], slices=slices).withColumn(
        "cost", F.col("quantity") * F.col("rate"))
