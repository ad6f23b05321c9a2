"""Metric, relabelling and target queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.catalog.registry import query
from obsframe.functions.labels import metric_name
from obsframe.functions.units import duration_seconds, quantity_value
from obsframe.operators import metrics as m
from obsframe.operators import relabel as r
from obsframe.views import SERIES, SHOP, Lake

END, MONTH = "2024-02-01 00:00:00", "31d"
DELTAS = """
    deltas AS (SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN value >= prev THEN value - prev ELSE value END AS delta
               FROM (SELECT *, lag(value) OVER (PARTITION BY name, pod, response_code ORDER BY ts) AS prev
                     FROM counter_samples))"""


@query("sel_label_match", f"""
    SELECT pod, response_code, ts, value FROM counter_samples
    WHERE name = 'requests_total' AND destination_service = '{SHOP}' AND destination_version = 'v1'
""", "counter_samples")
def _(lake: Lake) -> DataFrame:
    found = m.select_series(lake.counter_maps, "requests_total", destination_service=SHOP, destination_version="v1")
    return found.select(F.col("labels.pod").alias("pod"), F.col("labels.response_code").alias("response_code"), "ts", "value")


@query("sel_name_regex", """
    SELECT name, pod, ts, value FROM gauge_samples WHERE regexp_full_match(name, '.*containerapps.*')
""", "gauge_samples")
def _(lake: Lake) -> DataFrame:
    return m.select_regex(lake.gauge_samples, "__name__", ".*containerapps.*").select("name", "pod", "ts", "value")


@query("latest_sample", f"""
    SELECT name, pod, response_code, max(ts) AS ts, arg_max(value, ts) AS value FROM counter_samples
    WHERE ts > TIMESTAMP '{END}' - INTERVAL 31 DAY AND ts <= TIMESTAMP '{END}' GROUP BY ALL
""", "counter_samples")
def _(lake: Lake) -> DataFrame:
    return m.instant(lake.counter_samples, SERIES, END, MONTH)


@query("count_by_label", f"""
    SELECT response_code, count(DISTINCT pod) AS series FROM counter_samples
    WHERE ts > TIMESTAMP '{END}' - INTERVAL 31 DAY AND ts <= TIMESTAMP '{END}' GROUP BY response_code
""", "counter_samples")
def _(lake: Lake) -> DataFrame:
    return m.count_by(lake.counter_samples, SERIES, END, MONTH, "response_code")


@query("increase_by_series", f"""
    WITH {DELTAS}
    SELECT name, pod, response_code, coalesce(sum(delta), 0) AS increase FROM deltas
    WHERE ts > TIMESTAMP '{END}' - INTERVAL 24 DAY AND ts <= TIMESTAMP '{END}' GROUP BY ALL
""", "counter_samples")
def _(lake: Lake) -> DataFrame:
    return m.increase(lake.counter_samples, SERIES, END, "24d")


@query("sum_increase_by_code", f"""
    WITH {DELTAS}
    SELECT date_trunc('hour', ts) AS start, response_code, coalesce(sum(delta), 0) AS increase
    FROM deltas GROUP BY ALL
""", "counter_samples")
def sum_increase_by_code(lake: Lake) -> DataFrame:
    """The flagship: growth of the request counters by response code, hour by hour."""
    return m.sum_by(m.increase_grid(lake.counter_samples, SERIES, "1h"), "increase", "start", "response_code")


@query("increase_extrapolated", f"""
    WITH inside AS (
        SELECT *, lag(value) OVER (PARTITION BY name, pod, response_code ORDER BY ts) AS prev FROM counter_samples
        WHERE ts > TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '{END}'),
    spans AS (
        SELECT name, pod, response_code, count(*) AS n, arg_min(value, ts) AS v0,
               coalesce(sum(CASE WHEN value >= prev THEN value - prev WHEN prev IS NOT NULL THEN value END), 0) AS grown,
               epoch_us(min(ts)) / 1e6 AS t0, epoch_us(max(ts)) / 1e6 AS t1
        FROM inside GROUP BY ALL HAVING count(*) >= 2),
    gaps AS (SELECT *, t1 - t0 AS sampled, (t1 - t0) / (n - 1) AS gap,
                    t0 - epoch_us(TIMESTAMP '2024-01-01') / 1e6 AS lead,
                    epoch_us(TIMESTAMP '{END}') / 1e6 - t1 AS tail FROM spans),
    reach AS (SELECT *, CASE WHEN lead >= gap * 1.1 THEN gap / 2 ELSE lead END AS l1,
                     CASE WHEN tail >= gap * 1.1 THEN gap / 2 ELSE tail END AS l2 FROM gaps)
    SELECT name, pod, response_code, round(grown * (sampled + l2 + CASE WHEN grown > 0 AND v0 >= 0
               AND sampled * v0 / grown < l1 THEN sampled * v0 / grown ELSE l1 END) / sampled, 6) AS increase
    FROM reach
""", "counter_samples")
def _(lake: Lake) -> DataFrame:
    out = m.increase(lake.counter_samples, SERIES, END, MONTH, mode="extrapolated")
    return out.withColumn("increase", F.round("increase", 6))


@query("increase_sliding", f"""
    WITH {DELTAS.strip()},
    placed AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS start FROM deltas, range(24) AS r(k))
    SELECT start, name, pod, response_code, round(coalesce(sum(delta), 0), 6) AS increase FROM placed GROUP BY ALL
""", "counter_samples")
def _(lake: Lake) -> DataFrame:
    return m.increase_grid(lake.counter_samples, SERIES, "15m", "6h").withColumn("increase", F.round("increase", 6))


@query("interval_rollup", """
    SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, round(avg(value), 6) AS average,
           min(value) AS minimum, max(value) AS maximum, round(sum(value), 6) AS total, count(*) AS count
    FROM gauge_samples GROUP BY ALL
""", "gauge_samples")
def _(lake: Lake) -> DataFrame:
    out = m.rollup(lake.gauge_samples, ["event_type"], "PT15M")
    return out.withColumns({"average": F.round("average", 6), "total": F.round("total", 6)})


@query("interval_rollup_day", """
    SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, round(avg(value), 6) AS average,
           min(value) AS minimum, max(value) AS maximum, round(sum(value), 6) AS total, count(*) AS count
    FROM gauge_samples WHERE ts > TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL
""", "gauge_samples")
def _(lake: Lake) -> DataFrame:
    out = m.rollup(lake.gauge_samples, ["event_type"], "PT15M", span="PT24H", at="2024-01-20 12:00:00")
    return out.withColumns({"average": F.round("average", 6), "total": F.round("total", 6)})


@query("error_rate", """
    SELECT date_trunc('hour', ts) AS start, count(*) AS requests, count(*) FILTER (status >= 400) AS errors,
           round(count(*) FILTER (status >= 400) / count(*), 9) AS error_rate
    FROM requests GROUP BY ALL
""", "requests")
def _(lake: Lake) -> DataFrame:
    return m.error_rate(lake.requests, "1h").withColumn("error_rate", F.round("error_rate", 9))


@query("status_counts", "SELECT status, count(*) AS probes FROM requests GROUP BY status", "requests")
def _(lake: Lake) -> DataFrame:
    return m.status_counts(lake.requests)


@query("target_up", """
    WITH grid AS (SELECT user_id, slot FROM (SELECT DISTINCT user_id FROM events),
                  generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 6 HOUR) AS g(slot)),
    seen AS (SELECT DISTINCT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS slot FROM events)
    SELECT grid.user_id, grid.slot, CASE WHEN seen.slot IS NULL THEN 0 ELSE 1 END AS up
    FROM grid LEFT JOIN seen ON grid.user_id = seen.user_id AND grid.slot = seen.slot
""")
def _(lake: Lake) -> DataFrame:
    events = lake.events
    return m.target_up(events, events, "user_id", "6h", "2024-01-01 00:00:00", "2024-01-30 00:00:00")


@query("target_up_off_grid", """
    WITH grid AS (SELECT user_id, slot FROM (SELECT DISTINCT user_id FROM events),
                  generate_series(TIMESTAMP '2024-01-02 00:07:00', TIMESTAMP '2024-01-05', INTERVAL 45 MINUTE) AS g(slot)),
    seen AS (SELECT DISTINCT user_id, time_bucket(INTERVAL 45 MINUTE, ts, TIMESTAMP '2024-01-02 00:07:00') AS slot FROM events)
    SELECT grid.user_id, grid.slot, CASE WHEN seen.slot IS NULL THEN 0 ELSE 1 END AS up
    FROM grid LEFT JOIN seen ON grid.user_id = seen.user_id AND grid.slot = seen.slot
""")
def _(lake: Lake) -> DataFrame:
    events = lake.events
    return m.target_up(events, events, "user_id", "45m", "2024-01-02 00:07:00", "2024-01-05 00:00:00")


@query("attach_labels", """
    SELECT 'gateway' AS job, 'shop' AS app, pod, response_code, ts, value FROM counter_samples
""", "counter_samples")
def _(lake: Lake) -> DataFrame:
    out = m.attach_labels(lake.counter_maps, "gateway", app="shop")
    return out.select(*[F.col("labels")[k].alias(k) for k in ("job", "app", "pod", "response_code")], "ts", "value")


@query("metric_name_template", """
    SELECT event_id, event_type || '_' || 'Requests' || '_' || CASE WHEN user_id % 2 = 0 THEN 'average' ELSE 'total' END
           || '_count' AS metric_name FROM events
""")
def _(lake: Lake) -> DataFrame:
    rows = lake.events.select("event_id", F.col("event_type").alias("name"), F.lit("Requests").alias("metric"),
                              F.when(F.col("user_id") % 2 == 0, "average").otherwise("total").alias("aggregation"),
                              F.lit("count").alias("unit"))
    return rows.select("event_id", metric_name("{name}_{metric}_{aggregation}_{unit}").alias("metric_name"))


@query("relabel_keep", "SELECT target_id, address FROM targets WHERE scrape = 'true'", "targets")
def _(lake: Lake) -> DataFrame:
    return r.relabel_keep(lake.targets, ["scrape"], "true").select("target_id", "address")


@query("relabel_replace", r"""
    SELECT target_id, CASE WHEN path IS NULL THEN '/metrics' ELSE path END AS metrics_path,
           CASE WHEN port IS NOT NULL THEN split_part(address, ':', 1) || ':' || port ELSE address END AS address
    FROM targets
""", "targets")
def _(lake: Lake) -> DataFrame:
    targets = lake.targets.withColumn("metrics_path", F.lit("/metrics"))
    out = r.relabel_replace(targets, ["path"], "(.+)", "$1", "metrics_path")
    out = r.relabel_replace(out, ["address", "port"], r"([^:]+)(?::\d+)?;(\d+)", "$1:$2", "address")
    return out.select("target_id", "metrics_path", "address")


@query("ns_scrape_filter", "SELECT target_id, namespace FROM targets WHERE namespace IN ('ns-1', 'ns-3')", "targets")
def _(lake: Lake) -> DataFrame:
    return r.namespace_filter(lake.targets, "ns-1|ns-3").select("target_id", "namespace")


@query("selector_match", """
    SELECT target_id, 'control-in-1' AS monitor FROM targets WHERE app = 'control' AND namespace IN ('ns-1')
    UNION ALL SELECT target_id, 'workers' FROM targets WHERE app = 'worker'
    UNION ALL SELECT target_id, 'scraped-workers' FROM targets WHERE app = 'worker' AND scrape = 'true'
""", "targets")
def _(lake: Lake) -> DataFrame:
    monitors = [r.Monitor("control-in-1", {"app": "control"}, ("ns-1",)), r.Monitor("workers", {"app": "worker"}),
                r.Monitor("scraped-workers", {"app": "worker", "scrape": "true"})]
    return r.match_selector(lake.targets, monitors).select("target_id", "monitor")


@query("selector_match_table", """
    WITH monitors AS (
        SELECT 'nation-' || n_nationkey AS monitor, n_nationkey AS k, CASE WHEN n_nationkey % 3 < 2 THEN CASE n_nationkey % 2 WHEN 0 THEN 'control' ELSE 'worker' END END AS app,
               CASE n_nationkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN '' END AS scrape,
               CASE WHEN n_nationkey % 5 > 0 THEN ['ns-' || (n_nationkey % 5), 'ns-' || (n_nationkey % 7)] END AS namespaces FROM nation)
    SELECT target_id, monitor FROM targets t JOIN monitors m ON (m.app IS NULL OR m.app = t.app)
        AND (m.scrape IS NULL OR m.scrape = coalesce(t.scrape, '')) AND (m.namespaces IS NULL OR list_contains(m.namespaces, t.namespace))
""", "targets")
def _(lake: Lake) -> DataFrame:
    key = F.col("n_nationkey")
    name = lambda n: F.concat(F.lit("ns-"), (key % n).cast("string"))
    pairs = F.map_from_entries(F.array(
        F.struct(F.lit("app"), F.when(key % 3 < 2, F.when(key % 2 == 0, "control").otherwise("worker"))),
        F.struct(F.lit("scrape"), F.when(key % 4 == 0, "true").when(key % 4 == 1, ""))))
    monitors = lake.table("nation").select(
        F.concat(F.lit("nation-"), key.cast("string")).alias("monitor"), F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("match_labels"),
        F.when(key % 5 > 0, F.array(name(5), name(7))).alias("namespaces"))
    return r.match_monitors(lake.targets, monitors, ["app", "scrape", "namespace"]).select("target_id", "monitor")


@query("target_settings_join", """
    SELECT s.name, s.pod, s.ts, s.value, c.scrape_interval
    FROM gauge_samples s JOIN (SELECT 'pod-' || n_nationkey AS target, n_nationkey % 2 = 0 AS enabled,
        CASE WHEN n_nationkey = 2 THEN 'vm_.*|containerapps_click' ELSE '' END AS keep_list,
        (30 + n_nationkey) || 's' AS scrape_interval FROM nation) c ON c.target = s.pod
    WHERE c.enabled AND (c.keep_list = '' OR regexp_full_match(s.name, c.keep_list))
""", "gauge_samples")
def _(lake: Lake) -> DataFrame:
    key = F.col("n_nationkey")
    settings = lake.table("nation").select(
        F.concat(F.lit("pod-"), key.cast("string")).alias("target"), (key % 2 == 0).alias("enabled"),
        F.when(key == 2, "vm_.*|containerapps_click").otherwise("").alias("keep_list"),
        F.concat((30 + key).cast("string"), F.lit("s")).alias("scrape_interval"))
    samples = lake.gauge_samples.withColumn("target", F.col("pod"))
    return r.apply_target_settings(samples, settings).select("name", "pod", "ts", "value", "scrape_interval")


@query("fn_duration_seconds", """
    SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN (user_id % 90) * 60 WHEN 1 THEN (user_id % 90)
        WHEN 2 THEN (user_id % 9) * 86400 + 7200 END AS DOUBLE) AS seconds FROM events
""")
def _(lake: Lake) -> DataFrame:
    n, kind = F.col("user_id") % 90, F.col("event_id") % 4
    text = (F.when(kind == 0, F.concat(F.lit("PT"), n.cast("string"), F.lit("M")))
            .when(kind == 1, F.concat(n.cast("string"), F.lit("s")))
            .when(kind == 2, F.concat(F.lit("P"), (F.col("user_id") % 9).cast("string"), F.lit("DT2H")))
            .otherwise("soon"))
    return lake.events.select("event_id", duration_seconds(text).alias("seconds"))


@query("fn_quantity_value", """
    SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN user_id * 1073741824 WHEN 1 THEN user_id * 0.001
        WHEN 2 THEN user_id END AS DOUBLE) AS quantity FROM events
""")
def _(lake: Lake) -> DataFrame:
    n, kind = F.col("user_id").cast("string"), F.col("event_id") % 4
    text = (F.when(kind == 0, F.concat(n, F.lit("Gi"))).when(kind == 1, F.concat(n, F.lit("m")))
            .when(kind == 2, n).otherwise(F.concat(n, F.lit("Zi"))))
    return lake.events.select("event_id", F.round(quantity_value(text), 6).alias("quantity"))
