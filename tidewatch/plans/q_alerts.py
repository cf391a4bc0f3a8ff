"""Registered queries of M21 and A.

The catalogue runs on a clock slowed by 60 (five minutes become five hours), since the given events are sparse.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidewatch.functions.pointers import written
from tidewatch.operators import alerts as al
from tidewatch.operators import cost, recording
from tidewatch.operators import samples as m
from tidewatch.plans import fixtures, q_ops, q_requests, rule_sql, rules
from tidewatch.plans.fixtures import with_fixtures
from tidewatch.plans.q_requests import COSTS_SQL, LEVELS_SQL, REQ_SQL
from tidewatch.plans.registry import query
from tidewatch.session import work_dir

STEP, SLOW = 3600, 60

# One row per sampled series: metric, extra labels, and how its value follows from the event id.
_SERIES = """
  ('elasticsearch_cluster_health_status', 0, NULL, 'green', NULL, NULL, NULL, NULL, 'c1'),
  ('elasticsearch_cluster_health_status', 1, NULL, 'yellow', NULL, NULL, NULL, NULL, 'c1'),
  ('elasticsearch_cluster_health_status', 2, NULL, 'red', NULL, NULL, NULL, NULL, 'c1'),
  ('elasticsearch_cluster_health_number_of_nodes', 3, NULL, NULL, NULL, NULL, NULL, NULL, 'c1'),
  ('elasticsearch_jvm_memory_used_bytes', 4, NULL, NULL, 'heap', NULL, NULL, NULL, NULL),
  ('elasticsearch_jvm_memory_used_bytes', 4, NULL, NULL, 'non-heap', NULL, NULL, NULL, NULL),
  ('elasticsearch_jvm_memory_max_bytes', 5, NULL, NULL, 'heap', NULL, NULL, NULL, NULL),
  ('elasticsearch_indices_indexing_index_total', 6, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('elasticsearch_indices_indexing_index_time_seconds_total', 7, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('elasticsearch_filesystem_data_free_bytes', 8, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('elasticsearch_filesystem_data_size_bytes', 9, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('elasticsearch_thread_pool_rejected_count', 6, NULL, NULL, NULL, 'search', NULL, NULL, NULL),
  ('probe_success', 10, 'blackbox-logstash', NULL, NULL, NULL, NULL, NULL, NULL),
  ('probe_ssl_earliest_cert_expiry', 11, 'web', NULL, NULL, NULL, NULL, NULL, NULL),
  ('up', 10, 'kafka-jmx', NULL, NULL, NULL, NULL, NULL, NULL),
  ('kafka_controller_active_controller_count', 12, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('kafka_controller_offline_partitions_count', 13, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('kafka_consumergroup_lag', 14, NULL, NULL, NULL, NULL, 'g1', 't1', NULL),
  ('kafka_consumergroup_lag', 14, NULL, NULL, NULL, NULL, 'g1', 't2', NULL),
  ('kafka_consumergroup_lag', 14, NULL, NULL, NULL, NULL, 'g2', 't1', NULL),
  ('kafka_consumergroup_members', 15, NULL, NULL, NULL, NULL, 'g1', NULL, NULL),
  ('kafka_consumergroup_members', 15, NULL, NULL, NULL, NULL, 'g2', NULL, NULL),
  ('logstash_node_pipeline_events_out_total', 16, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('logstash_node_pipeline_events_in_total', 17, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('logstash_node_dead_letter_queue_size_in_bytes', 18, NULL, NULL, NULL, NULL, NULL, NULL, NULL)"""

fixtures.add_fixture("stack_samples", f"""
SELECT ts, x.metric, concat('n', CAST(user_id % 3 AS STRING)) AS instance, x.job, x.color, x.area, x.name, x.consumergroup, x.topic, x.cluster,
  CAST(CASE x.kind WHEN 0 THEN CASE WHEN event_id % 5 > 1 THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN event_id % 5 = 1 THEN 1 ELSE 0 END
    WHEN 2 THEN CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END WHEN 3 THEN 2 + event_id % 2 WHEN 4 THEN 70 + event_id % 30 WHEN 5 THEN 100
    WHEN 6 THEN (event_id * 3) % 1000 WHEN 7 THEN (event_id * 7) % 900 WHEN 8 THEN 1000 - event_id % 950 WHEN 9 THEN 1000
    WHEN 10 THEN CASE WHEN event_id % 13 < 2 THEN 0 ELSE 1 END WHEN 11 THEN 1704067200 + 86400 * (event_id % 60) WHEN 12 THEN CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END
    WHEN 13 THEN CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END WHEN 14 THEN (event_id * 11) % 1500 WHEN 15 THEN event_id % 4 WHEN 16 THEN (event_id * 5) % 2000
    WHEN 17 THEN (event_id * 6) % 2200 ELSE (event_id * 1000) % 20000000 END AS DOUBLE) AS value
FROM events CROSS JOIN (VALUES{_SERIES}) AS x(metric, kind, job, color, area, name, consumergroup, topic, cluster)
WHERE NOT (x.kind <= 2 AND extract(day FROM ts) = 9)
""", "events")



# What the other metrics of the catalogue look like, an hour apart: the kind of value, its scale, and labels. Gauges wander from
# 0 to 100, counters start anew every 60 hours, flat ones stop growing after 250, constants and buckets only grow.
GAUGE, COUNTER, FLAT, CONSTANT, BUCKET = range(5)
LABELS = ("area", "cluster", "color", "consumergroup", "exporter", "job", "le", "name", "operation", "processor", "quantile", "receiver", "request", "topic")
_SCALES = (  # the first pattern that a name holds decides
    (r"_max_|max_file|limit_size|_max_bytes", CONSTANT, 100), (r"messages_in_total$", FLAT, 1_000_000), (r"number_of_data_nodes", GAUGE, 0.04), (r"idle_percent", GAUGE, 0.01),
    (r"queue_count|total_time_ms", GAUGE, 5), (r"queue_push_duration", GAUGE, 50), (r"load[0-9]+", GAUGE, 0.1), (r"queue_events_count", GAUGE, 1),
    (r"plugins_(filters|outputs)_events_duration", COUNTER, 4_000_000), (r"documents_successes", COUNTER, 500), (r"events_out_total", COUNTER, 1000), (r"evictions|collection_time|old_collection", COUNTER, 2_000_000), (r"search_query_time", COUNTER, 30_000), (r"gc_collection_seconds_sum", COUNTER, 4000),
    (r"config_last_reload", GAUGE, 0.5), (r"duration_seconds$", GAUGE, 0.1), (r"http_status_code", GAUGE, 5))
_MORE = (  # series of their own beside what the events give
    ("kafka_consumergroup_lag", GAUGE, 400, {"consumergroup": "g9", "topic": "t9"}), ("logstash_node_dead_letter_queue_size_in_bytes", GAUGE, 10_000_000, {"cluster": "big"}),
    ("logstash_node_pipeline_events_in_total", FLAT, 1_000_000, {"cluster": "stopped"}), ("elasticsearch_thread_pool_rejected_count", COUNTER, 7, {"name": "write"}),
    ("probe_success", GAUGE, 0.01, {"job": "blackbox-zookeeper"}), ("elasticsearch_indices_indexing_index_total", FLAT, 1_000_000, {"cluster": "stopped"}),
    ("logstash_node_pipeline_events_out_total", CONSTANT, 5, {"cluster": "busy"}), ("logstash_node_pipeline_events_filtered_total", COUNTER, 1000, {"cluster": "busy"}), ("logstash_node_pipeline_events_in_total", COUNTER, 1200, {"cluster": "busy"}),
)


def _catalogue_series():
    known = set(re.findall(r"\('([a-z_]+)', [0-9]+,", _SERIES))
    names = {r.name for r in rules.RECORDING_RULES}
    read = {}
    for rule in (*rules.RECORDING_RULES, *(a.rule for a in rules.ALERT_RULES)):
        for o in rule.operands:
            if o.metric not in names and o.metric not in known:
                fns, labels = read.setdefault(o.metric, (set(), []))
                fns.add(o.fn)
                own = dict(o.match) | {k: v.replace(".*", "x") for k, v in o.like}
                labels.append(own | {k: f"{k}1" for k in o.by if k in LABELS and k not in own and k not in ("job", "le")})
    rows = list(_MORE)
    for metric, (fns, labels) in sorted(read.items()):
        kind, scale = next(((k, n) for pattern, k, n in _SCALES if re.search(pattern, metric)), (COUNTER, 900) if fns & {"rate", "irate", "increase"} else (GAUGE, 1))
        most = max(labels, key=len)
        sets = {tuple(sorted((most if not x else x | {k: v for k, v in most.items() if k not in x and k in ("topic", "consumergroup")}).items())) for x in labels}
        if metric.endswith("_bucket"):
            rows += [(metric, BUCKET, n, dict(x) | {"le": le}) for x in sets for n, le in ((5, "0.1"), (8, "1.0"), (9, "+Inf"))]
        else:
            rows += [(metric, kind, scale, dict(x)) for x in sets]
    return ",\n  ".join("(" + ", ".join([f"'{m_}'", str(k), f"CAST({n} AS DOUBLE)", *[f"'{x[c]}'" if c in x else "NULL" for c in LABELS]]) + ")" for m_, k, n, x in rows)


fixtures.add_fixture("catalogue_samples", f"""
SELECT h.ts, x.metric, concat('n', CAST(i.i AS STRING)) AS instance, {", ".join(f"x.{c}" for c in LABELS)},
  CAST(CASE x.kind WHEN {GAUGE} THEN ((h.h * 7 + i.i * 3) % 101) * x.scale WHEN {COUNTER} THEN (h.h % 60) * (1 + i.i) * x.scale WHEN {FLAT} THEN least(h.h, 250) * x.scale WHEN {CONSTANT} THEN x.scale ELSE h.h * x.scale END AS DOUBLE) AS value
FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts, (extract(day FROM ts) - 1) * 24 + extract(hour FROM ts) AS h FROM events) AS h CROSS JOIN (VALUES (0), (1), (2)) AS i(i)
CROSS JOIN (VALUES
  {_catalogue_series()}) AS x(metric, kind, scale, {", ".join(LABELS)})
""", "events")


def stack(t):
    return m.as_samples(t.stack_samples)


def whole_stack(t):
    """Samples of every metric that the catalogue reads; their labels stay columns, as no map is made for each row then."""
    return t.stack_samples.unionByName(t.catalogue_samples, allowMissingColumns=True)


ALL_LABELS = tuple(sorted((*LABELS, "instance")))
_pairs = lambda cols: "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}=' || {c} END" for c in cols) + ")"
SMP_SQL = with_fixtures("stack_samples", "catalogue_samples") + f""", smp AS (
SELECT ts, metric, {_pairs([c for c in ALL_LABELS if c in ("area", "cluster", "color", "consumergroup", "instance", "job", "name", "topic")])} AS lab, value FROM stack_samples
UNION ALL SELECT ts, metric, {_pairs(ALL_LABELS)}, value FROM catalogue_samples),
hours AS (SELECT t FROM (SELECT unnest(generate_series(date_trunc('hour', (SELECT min(ts) FROM events)), (SELECT max(ts) FROM events), INTERVAL 1 HOUR)) AS t) g WHERE t >= (SELECT min(ts) FROM events)),
"""


def label_text(col="labels"):
    return F.array_join(F.array_sort(F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


def span(t):
    return m.grid_over(t.events, STEP)


H5 = 5 * 3600
L_COLS = ("area", "cluster", "color", "consumergroup", "instance", "job", "name", "topic")
TEXT = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}=' || {c} END" for c in L_COLS) + ")"

# Instant vectors and rates of every series by brute force: all pairs of a grid point and a sample in its range.
BASE_SQL = with_fixtures("stack_samples") + f""", s0 AS (SELECT *, {TEXT} AS lab FROM stack_samples),
s AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pts FROM s0 WINDOW w AS (PARTITION BY metric, lab ORDER BY ts)),
g AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM s), (SELECT max(ts) FROM s) + INTERVAL 70 HOUR, INTERVAL 1 HOUR)) AS t),
hours AS (SELECT t FROM g WHERE t >= (SELECT min(ts) FROM s) AND t <= (SELECT max(ts) FROM s)),
x AS (SELECT g.t, s.*, CASE WHEN pts > g.t - INTERVAL {H5} SECOND THEN CASE WHEN value >= pv THEN value - pv ELSE value END ELSE 0 END AS inc FROM g JOIN s ON s.ts > g.t - INTERVAL {H5} SECOND AND s.ts <= g.t),
v AS (SELECT t, metric, lab, any_value(instance) AS instance, any_value(job) AS job, any_value(color) AS color, any_value(area) AS area, any_value(name) AS name, any_value(consumergroup) AS consumergroup, any_value(topic) AS topic,
  max_by(value, ts) AS value, avg(value) AS mean, CASE WHEN count(*) >= 2 THEN sum(inc) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) END AS rate FROM x GROUP BY t, metric, lab),
"""


AVAIL_SQL = BASE_SQL + """level0 AS (SELECT t, 'logstash:availability:up' AS rec, lab, value FROM v WHERE metric = 'probe_success' AND job = 'blackbox-logstash'),
avail AS (SELECT g.t, l.lab, avg(l.value) AS c FROM g JOIN level0 l ON l.t > g.t - INTERVAL 60 HOUR AND l.t <= g.t GROUP BY g.t, l.lab)"""

CATALOGUE = recording.stretch(rules.RECORDING_RULES, SLOW)


def rounded(d, name="name"):
    return d.select("t", F.col(name).alias("rec"), label_text().alias("lab"), F.round("value", 6).alias("value"))


RECORDED_SQL, TAGS = rule_sql.recorded_sql(CATALOGUE)


@query("m21_record_rules", SMP_SQL + RECORDED_SQL + f" SELECT t, name AS rec, lab, round(value, 6) AS value FROM ({rule_sql.all_of(TAGS)}) z WHERE NOT starts_with(name, '_')")
def _(t):
    """The whole catalogue, level by level, through the table of recorded series."""
    d = recording.store_rules(whole_stack(t), CATALOGUE, work_dir(t.spark, "recorded"), STEP, span(t))
    return rounded(d.where(~F.col("name").startswith("_")))


SLO_ONLY = [r for r in CATALOGUE if r.name in ("logstash:availability:up", "slo:logstash:availability:current", "slo:logstash:availability:budget_consumed")]


@query("m21_lazy_levels", AVAIL_SQL + """ SELECT t, 'logstash:availability:up' AS rec, lab, round(value, 6) AS value FROM level0
UNION ALL SELECT t, 'slo:logstash:availability:current', lab, round(c, 6) FROM avail
UNION ALL SELECT t, 'slo:logstash:availability:budget_consumed', lab, round((1 - c) / (1 - 0.999::DOUBLE), 6) FROM avail""")
def _(t):
    """Rules that read rules, as one lazy plan."""
    return rounded(recording.record_rules(stack(t), SLO_ONLY, STEP, span(t)))


ALERTS = recording.stretch_alerts(rules.ALERT_RULES, SLOW)
NEEDED = recording.needed_rules(ALERTS, CATALOGUE)


@query("a1_evaluate_rules", SMP_SQL + rule_sql.breaches_sql(recording.closure(CATALOGUE, [o.metric for a in ALERTS for o in a.rule.operands]), ALERTS) + " SELECT t, alertname, lab, round(value, 6) AS value FROM breaches")
def _(t):
    """All conditions, each of which breaks somewhere; those over recorded series read the table of the few rules they need."""
    grid = span(t)
    recorded = recording.store_rules(whole_stack(t), NEEDED, work_dir(t.spark, "recorded"), STEP, grid)
    d = recording.evaluate_rules(whole_stack(t), ALERTS, CATALOGUE, STEP, grid, recorded)
    return rounded(d, "alertname").withColumnRenamed("rec", "alertname")


# --- from here on the alerts come from a smaller view: breaches by hour, made of the events themselves

_PICK = (
    # alertname, severity, service, category, hold in hours
    ("ElasticsearchClusterRed", "critical", "elasticsearch", "cluster", 1), ("ElasticsearchClusterYellow", "warning", "elasticsearch", "cluster", 5),
    ("ElasticsearchNodeDown", "critical", "elasticsearch", "nodes", 1), ("ElasticsearchHeapUsageWarning", "warning", "elasticsearch", "jvm", 5),
    ("ElasticsearchDiskUsageWarning", "warning", "elasticsearch", "disk", 5), ("EndpointDown", "critical", "", "availability", 1),
    ("EndpointSlowResponse", "warning", "", "performance", 5), ("SLOBudgetBurning", "warning", "", "slo", 5),
    ("SSLCertificateExpiringSoon", "warning", "", "ssl", 60), ("KafkaBrokerDown", "critical", "kafka", "cluster", 1),
)
fixtures.add_fixture("alert_points", f"""
SELECT date_trunc('hour', ts) AS t, CASE CAST(user_id % {len(_PICK)} AS INT) {' '.join(f"WHEN {i} THEN '{p[0]}'" for i, p in enumerate(_PICK))} END AS alertname,
  concat('c', CAST(user_id % 2 AS STRING)) AS cluster, concat('n', CAST(user_id % 2 AS STRING)) AS instance, max(value) AS value
FROM events GROUP BY 1, 2, 3, 4""", "events")
_VALUES = ", ".join(f"('{n}', '{s}', '{sv}', '{c}', {h})" for n, s, sv, c, h in _PICK)
POINTS = with_fixtures("alert_points") + f""", rl(alertname, severity, service, category, hold) AS (VALUES {_VALUES}),
al AS (SELECT p.*, severity, service, category, hold FROM alert_points p JOIN rl USING (alertname))"""


def points(t):
    return t.alert_points.select(
        F.col("t").cast("timestamp").alias("t"), "alertname", F.create_map(F.lit("cluster"), F.col("cluster"), F.lit("instance"), F.col("instance")).alias("labels"), "value")


def alert_rows(t):
    return points(t).join(al.rules_frame(t.spark, rules.ALERT_RULES).select("alertname", "severity", "service", "category"), "alertname")


def flat(*cols):
    return [F.col("labels")["cluster"].alias("cluster"), F.col("labels")["instance"].alias("instance"), *cols]


@query("a2_hold_for", POINTS + """, r AS (SELECT *, t - to_hours(CAST(row_number() OVER (PARTITION BY alertname, cluster, instance ORDER BY t) AS INT)) AS run FROM al),
h AS (SELECT *, min(t) OVER (PARTITION BY alertname, cluster, instance, run) AS since FROM r)
SELECT t, alertname, cluster, instance, since, CASE WHEN t - since >= to_hours(hold) THEN 'firing' ELSE 'pending' END AS state FROM h""")
def _(t):
    holds = al.rules_frame(t.spark, ALERTS).select("alertname", "hold")
    return al.hold_for(points(t), holds, STEP).select("t", "alertname", *flat("since", "state"))


@query("a3_label_alerts", POINTS + """
SELECT t, alertname, cluster, instance, severity, service, category, regexp_replace(alertname, '([a-z])([A-Z])', '\\1 \\2', 'g') AS summary FROM al""")
def _(t):
    d = al.label_alerts(points(t), al.rules_frame(t.spark, rules.ALERT_RULES))
    return d.select("t", "alertname", *flat("severity", "service", "category", "summary"))


@query("a3_alert_values", POINTS + """, w AS (SELECT *, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS txt FROM al)
SELECT t, alertname, cluster, instance, concat('Endpoint Down on ', instance, ': value ', txt, ', condition == 0') AS description FROM w WHERE alertname = 'EndpointDown'""")
def _(t):
    d = al.label_alerts(points(t).where("alertname = 'EndpointDown'"), al.rules_frame(t.spark, rules.ALERT_RULES))
    return d.select("t", "alertname", *flat("description"))


ROUTED = POINTS + """, routed AS (
  SELECT *, 'critical-receiver' AS receiver, 10 AS group_wait, 60 AS group_interval, 3600 AS repeat_interval, concat('alertname=', alertname, ',cluster=', cluster, ',service=', service) AS group_key FROM al WHERE severity = 'critical'
  UNION ALL SELECT *, CASE category WHEN 'cluster' THEN 'elasticsearch-critical' WHEN 'disk' THEN 'elasticsearch-disk' ELSE 'elasticsearch-receiver' END, CASE category WHEN 'cluster' THEN 10 ELSE 30 END, 300, 14400,
    concat('alertname=', alertname, ',node=,category=', category) FROM al WHERE service = 'elasticsearch'
  UNION ALL SELECT *, 'slo-receiver', 30, 300, 7200, concat('alertname=', alertname) FROM al WHERE service <> 'elasticsearch' AND category = 'slo'
  UNION ALL SELECT *, 'ssl-receiver', 30, 300, 86400, concat('alertname=', alertname, ',instance=', instance) FROM al WHERE service <> 'elasticsearch' AND category = 'ssl'
  UNION ALL SELECT *, 'default-receiver', 30, 300, 14400, concat('alertname=', alertname, ',cluster=', cluster, ',service=', service) FROM al WHERE service <> 'elasticsearch' AND category NOT IN ('slo', 'ssl') AND severity <> 'critical')"""


@query("a4_route_alerts", ROUTED + "SELECT t, alertname, cluster, instance, receiver, group_wait, group_interval, repeat_interval FROM routed")
def _(t):
    return al.route_alerts(alert_rows(t)).select("t", "alertname", *flat("receiver", "group_wait", "group_interval", "repeat_interval"))


@query("a5_inhibit", POINTS + """
SELECT t, alertname, cluster, instance FROM al a WHERE NOT (alertname = 'ElasticsearchClusterYellow' AND EXISTS (SELECT 1 FROM al s WHERE s.t = a.t AND s.alertname = 'ElasticsearchClusterRed' AND s.cluster = a.cluster))
  AND NOT (alertname LIKE 'Elasticsearch%' AND category IN ('jvm', 'performance', 'disk') AND EXISTS (SELECT 1 FROM al s WHERE s.t = a.t AND s.alertname = 'ElasticsearchNodeDown' AND s.cluster = a.cluster))
  AND NOT (alertname = 'EndpointSlowResponse' AND EXISTS (SELECT 1 FROM al s WHERE s.t = a.t AND s.alertname = 'EndpointDown' AND s.instance = a.instance))
  AND NOT (severity = 'warning' AND EXISTS (SELECT 1 FROM al s WHERE s.t = a.t AND s.severity = 'critical' AND s.alertname = a.alertname AND s.service = a.service))""")
def _(t):
    return al.inhibit(alert_rows(t)).select("t", "alertname", *flat())


@query("a6_group_alerts", ROUTED + """
SELECT receiver, group_key, t, count(*) AS alerts, CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'critical' ELSE 'warning' END AS severity FROM routed GROUP BY 1, 2, 3""")
def _(t):
    return al.group_alerts(al.route_alerts(alert_rows(t))).select("receiver", "group_key", "t", "alerts", "severity")


NOTICES_SQL = ROUTED.replace("WITH ", "WITH RECURSIVE ", 1) + """, gr AS (
  SELECT receiver, group_key, t, any_value(group_wait) AS w, any_value(group_interval) AS i, any_value(repeat_interval) AS r, count(*) AS alerts,
    string_agg(concat(alertname, '/', cluster, '/', instance), ',' ORDER BY alertname, cluster, instance) AS members FROM routed GROUP BY 1, 2, 3),
isl AS (SELECT *, t - to_hours(CAST(row_number() OVER (PARTITION BY receiver, group_key ORDER BY t) AS INT)) AS run FROM gr),
runs AS (SELECT receiver, group_key, run, any_value(w) AS w, any_value(i) AS i, any_value(r) AS r, min(t) AS a, max(t) + INTERVAL 1 HOUR AS z FROM isl GROUP BY 1, 2, 3),
fl AS (SELECT receiver, group_key, run, r, unnest(generate_series(a + to_seconds(w), z + to_seconds(i - 1), to_seconds(i))) AS at_s, z FROM runs),
seen AS (SELECT f.receiver, f.group_key, f.run, f.r, f.at_s, f.at_s >= f.z AS ended, g.members, coalesce(g.alerts, 0) AS alerts
  FROM fl f LEFT JOIN gr g ON g.receiver = f.receiver AND g.group_key = f.group_key AND g.t = date_trunc('hour', f.at_s) AND f.at_s < f.z),
heads AS (SELECT receiver, group_key, run, min(at_s) AS at_s FROM seen GROUP BY 1, 2, 3),
notices AS (
  SELECT s.receiver, s.group_key, s.run, s.at_s, 'first' AS reason, s.alerts, s.members FROM seen s JOIN heads h USING (receiver, group_key, run, at_s)
  UNION ALL SELECT receiver, group_key, run, at_s, reason, alerts, members FROM (
    SELECT s.receiver, s.group_key, s.run, s.at_s, CASE WHEN s.ended THEN 'resolved' WHEN s.members <> n.members THEN 'change' ELSE 'repeat' END AS reason, s.alerts, s.members,
      row_number() OVER (PARTITION BY n.receiver, n.group_key, n.run ORDER BY s.at_s) AS k
    FROM notices n JOIN seen s ON s.receiver = n.receiver AND s.group_key = n.group_key AND s.run = n.run AND s.at_s > n.at_s
      AND (s.ended OR s.members <> n.members OR s.at_s - n.at_s >= to_seconds(s.r)) WHERE n.reason <> 'resolved') x WHERE k = 1)
SELECT receiver, group_key, at_s AS t, reason, alerts FROM notices"""


@query("a7_notification_times", NOTICES_SQL)
def _(t):
    """The SQL goes from notice to notice; every silence of two hours ends a group, as no interval is that long."""
    return al.notification_times(al.group_alerts(al.route_alerts(alert_rows(t))), STEP)


@query("a8_auto_resolve", POINTS + """, n AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY alertname, cluster, instance ORDER BY t), TIMESTAMP '2024-02-01 00:00:00') AS nx FROM al)
SELECT alertname, cluster, instance, t AS last_seen, t + INTERVAL 2 HOUR AS resolved_at FROM n WHERE nx - t > INTERVAL 2 HOUR""")
def _(t):
    return al.auto_resolve(points(t), "2024-02-01 00:00:00", 7200).select("alertname", *flat("last_seen", "resolved_at"))


FIN_SQL = "days AS (SELECT CAST(ts AS DATE) AS day, sum(total_cost) AS spent FROM costs GROUP BY 1), fin AS (SELECT *, CASE WHEN spent >= 10 THEN 100 WHEN spent >= 9 THEN 90 WHEN spent >= 7.5 THEN 75 WHEN spent >= 5 THEN 50 END AS threshold FROM days)"
VIOL_SQL = COSTS_SQL + ", " + LEVELS_SQL[len(REQ_SQL) + 2:] + ", " + FIN_SQL + ", " + q_ops.FACTS_SQL.split("SELECT * FROM violations")[0].replace("WITH ", "", 1).replace("violations AS", "comp AS")
VIOL_SQL = VIOL_SQL.replace(fixtures.AI_REQUESTS.strip(), "@@", 1)
_first, _rest = VIOL_SQL.split("@@", 1)
VIOL_SQL = _first + fixtures.AI_REQUESTS.strip() + _rest.replace(f"ai_requests AS ({fixtures.AI_REQUESTS.strip()}),\n", "")
TITLE = "array_to_string(list_transform(string_split(type, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"
ALERT_SQL = VIOL_SQL + f""", alerts AS (
  SELECT window_start AS ts, concat('Technical: ', {TITLE}) AS name, 'technical' AS category, CASE severity WHEN 'critical' THEN 'critical' ELSE 'warning' END AS severity,
    format('Threshold exceeded: {{:.2f}} > {{:.2f}}', value, threshold) AS message, concat(provider, '/', model) AS entity, type FROM violations
  UNION ALL SELECT CAST(day AS TIMESTAMP), 'FinOps: Budget Threshold', 'finops', CASE WHEN threshold >= 100 THEN 'critical' ELSE 'warning' END, concat('Daily budget ', threshold, '% threshold reached'), 'daily', 'budget_threshold' FROM fin WHERE threshold IS NOT NULL
  UNION ALL SELECT ts, concat('Compliance: ', {TITLE}), 'compliance', CASE severity WHEN 'high' THEN 'critical' ELSE 'warning' END, concat('Compliance violation detected: ', type), detail, type FROM comp),
keyed AS (SELECT *, substr(md5(concat_ws(':', name, category, entity)), 1, 16) AS k FROM alerts)"""


def violation_frames(t):
    from tidewatch.operators import governance

    return q_requests.hourly_violations(t), cost.budget_alerts(q_requests.costs(t), 10.0), governance.compliance_violations(q_ops.compliance_facts(t))


def alert_frame(t):
    return al.violations_to_alerts(*violation_frames(t))


@query("a9_violations_to_alerts", ALERT_SQL + " SELECT ts, name, category, severity, message, entity FROM alerts")
def _(t):
    return alert_frame(t).select("ts", "name", "category", "severity", "message", "entity")


@query("a10_dedup_key", ALERT_SQL + """ SELECT substr(md5(concat('Compliance: ', ' X:', request_id, ':{"detail": "', detail, '", "request_id": "', request_id, '", "severity": "', severity, '", "type": "', type, '"}')), 1, 16) AS dedup_key, request_id FROM comp""")
def _(t):
    comp = violation_frames(t)[2]
    details = al._details(type=F.col("type"), severity=F.col("severity"), request_id=F.col("request_id").cast("string"), detail=F.col("detail"))
    d = comp.select(F.lit("Compliance:  X").alias("name"), F.col("request_id").cast("string").alias("category"), details.alias("details"), "request_id")
    return d.select(al.dedup_key().alias("dedup_key"), "request_id")


def kept_alerts(t):
    """What the cooldowns read of the alerts, written once, as they read it several times."""
    return written(alert_frame(t).select("ts", "name", "category", "entity"), "alerts")


# The greedy choice by recursion: the next accepted time is the first one at least the cooldown later.
COOL_SQL = ALERT_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, tm AS (SELECT DISTINCT k, ts FROM keyed),
nx AS (SELECT a.k, a.ts, (SELECT min(b.ts) FROM tm b WHERE b.k = a.k AND b.ts >= a.ts + INTERVAL 180 MINUTE) AS nts FROM tm a),
acc AS (SELECT k, min(ts) AS ts FROM tm GROUP BY k UNION ALL SELECT nx.k, nx.nts FROM acc JOIN nx ON nx.k = acc.k AND nx.ts = acc.ts WHERE nx.nts IS NOT NULL)"""


@query("a11_suppress_cooldown", COOL_SQL + """
SELECT keyed.k AS dedup_key, keyed.ts, acc.k IS NOT NULL AS accepted, count(*) AS alerts FROM keyed LEFT JOIN acc ON acc.k = keyed.k AND acc.ts = keyed.ts GROUP BY 1, 2, 3""")
def _(t):
    d = al.suppress_cooldown(kept_alerts(t), minutes=180)
    return d.groupBy("dedup_key", "ts", "accepted").agg(F.count(F.lit(1)).alias("alerts"))


# Every alert of the day's last hour is closed at the hour before midnight of every third day.
CLOSED_SQL = """cl AS (SELECT DISTINCT k, date_trunc('day', ts) + INTERVAL 23 HOUR AS at FROM keyed WHERE day(ts) % 3 = 0)"""


@query("a11_touch_active", ALERT_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {CLOSED_SQL}, tm AS (SELECT DISTINCT k, ts FROM keyed),
nc AS (SELECT a.k, a.ts, (SELECT min(c.at) FROM cl c WHERE c.k = a.k AND c.at > a.ts) AS at FROM tm a),
nx AS (SELECT a.k, a.ts, (SELECT min(b.ts) FROM tm b WHERE b.k = a.k AND b.ts >= a.ts + INTERVAL 180 MINUTE AND b.ts >= a.at) AS nts FROM nc a),
acc AS (SELECT k, min(ts) AS ts FROM tm GROUP BY k UNION ALL SELECT nx.k, nx.nts FROM acc JOIN nx ON nx.k = acc.k AND nx.ts = acc.ts WHERE nx.nts IS NOT NULL),
j AS (SELECT keyed.k, keyed.ts, acc.ts AS made FROM keyed ASOF JOIN acc ON acc.k = keyed.k AND keyed.ts >= acc.ts)
SELECT k AS dedup_key, ts, CASE WHEN ts = made THEN 'created' WHEN ts >= made + INTERVAL 180 MINUTE THEN 'updated' ELSE 'skipped' END AS outcome, count(*) AS alerts FROM j GROUP BY 1, 2, 3""")
def _(t):
    d = kept_alerts(t)
    closed = d.where(F.dayofmonth("ts") % 3 == 0).select(al.stable_key().alias("dedup_key"), (F.date_trunc("day", "ts") + F.expr("INTERVAL 23 HOURS")).alias("at")).distinct()
    return al.touch_active(d, closed, minutes=180).groupBy("dedup_key", "ts", "outcome").agg(F.count(F.lit(1)).alias("alerts"))


# Numbers as in a JSON text: the values here need no exponent.
@query("a10_dedup_key_numbers", VIOL_SQL + """ SELECT window_start AS ts, provider, model, type,
  substr(md5(concat('T:technical:{"sure": true, "threshold": ', CAST(CAST(threshold AS DOUBLE) AS VARCHAR), ', "type": "', type, '"}')), 1, 16) AS dedup_key FROM violations""")
def _(t):
    tech = violation_frames(t)[0]
    details = al._details(type=F.col("type"), threshold=F.col("threshold").cast("double"), sure=F.lit(True))
    d = tech.select(F.col("window_start").alias("ts"), "provider", "model", "type", F.lit("T").alias("name"), F.lit("technical").alias("category"), details.alias("details"))
    return d.select("ts", "provider", "model", "type", al.dedup_key().alias("dedup_key"))


def stored_alerts(t):
    d = alert_frame(t).withColumn("dedup_key", al.stable_key())
    first = d.groupBy("dedup_key", "ts").agg(*[F.min(c).alias(c) for c in ("name", "category", "severity", "message", "entity")])
    return al.assign_alert_ids(first).withColumn("status", F.lit("active"))


STORED_SQL = ALERT_SQL + """, one AS (SELECT k, ts, min(name) AS name, min(category) AS category, min(severity) AS severity, min(message) AS message, min(entity) AS entity FROM keyed GROUP BY k, ts),
num AS (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, k) AS no, concat('ALT-', strftime(ts, '%Y%m%d'), '-', lpad(CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, k) AS VARCHAR), 5, '0')) AS id FROM one),
st AS (SELECT *, CASE WHEN no % 5 = 0 THEN 'resolved' WHEN no % 3 = 0 THEN 'acknowledged' ELSE 'active' END AS status FROM num)"""


@query("a12_assign_alert_ids", STORED_SQL + " SELECT id, ts, name, k AS dedup_key FROM num")
def _(t):
    return stored_alerts(t).select("id", "ts", "name", "dedup_key")


def acted(t):
    d = stored_alerts(t)
    no = F.substring_index("id", "-", -1).cast("bigint")
    ten, thirty = F.expr("INTERVAL 10 MINUTES"), F.expr("INTERVAL 30 MINUTES")
    rows = F.explode(F.filter(F.array(
        F.when(no % 3 == 0, F.struct(F.lit("acknowledge").alias("action"), F.lit("ana").alias("by"), (F.col("ts") + ten).alias("at"))),
        F.when(no % 5 == 0, F.struct(F.lit("resolve").alias("action"), F.lit("bo").alias("by"), (F.col("ts") + thirty).alias("at"))),
    ), lambda x: x.isNotNull()))
    return al.apply_alert_actions(d, d.select("id", rows.alias("r")).select("id", "r.*"))


@query("a13_apply_alert_actions", STORED_SQL + """ SELECT id, status, CASE WHEN no % 3 = 0 THEN 'ana' END AS acknowledged_by, CASE WHEN no % 3 = 0 THEN ts + INTERVAL 10 MINUTE END AS acknowledged_at,
  CASE WHEN no % 5 = 0 THEN ts + INTERVAL 30 MINUTE END AS resolved_at FROM st""")
def _(t):
    return acted(t).select("id", "status", "acknowledged_by", "acknowledged_at", "resolved_at")


@query("a14_active_alerts", STORED_SQL + " SELECT id, name, severity FROM st WHERE status = 'active' AND category = 'technical' AND severity = 'critical'")
def _(t):
    return al.active_alerts(acted(t), "technical", "critical").select("id", "name", "severity")


@query("a15_alert_history", STORED_SQL + " SELECT id, ts, name FROM st WHERE category = 'compliance' ORDER BY ts DESC, id DESC LIMIT 100")
def _(t):
    return al.alert_history(stored_alerts(t), 100, "compliance").select("id", "ts", "name")


@query("a16_alert_summary", STORED_SQL + """ SELECT 'total_active' AS block, '' AS key, count(*) FILTER (WHERE status = 'active') AS alerts FROM st UNION ALL SELECT 'total_historical', '', count(*) FROM st
UNION ALL SELECT 'by_severity', s.s, count(st.id) FROM (VALUES ('info'), ('warning'), ('critical')) AS s(s) LEFT JOIN st ON st.severity = s.s AND st.status = 'active' GROUP BY s.s
UNION ALL SELECT 'by_category', c.c, count(st.id) FROM (VALUES ('technical'), ('cognitive'), ('finops'), ('devops'), ('compliance')) AS c(c) LEFT JOIN st ON st.category = c.c AND st.status = 'active' GROUP BY c.c""")
def _(t):
    return al.alert_summary(acted(t))


@query("a17_pick_recipients", STORED_SQL + """ SELECT id, 'slack' AS channel, CASE severity WHEN 'critical' THEN '#ai-alerts-critical' ELSE '#ai-alerts-warning' END AS recipient FROM num
UNION ALL SELECT id, 'email', 'ai-team@example.com' FROM num UNION ALL SELECT id, 'email', 'ops-team@example.com' FROM num WHERE severity = 'critical'""")
def _(t):
    return al.pick_recipients(stored_alerts(t)).select("id", "channel", "recipient")


METRIC_ROWS = """SELECT event_id, ts, value * 40 AS p95_latency, value / 20 AS error_rate, value AS daily_cost, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 200.0 END AS daily_budget,
  (event_id % 100) / 100.0 AS hallucination_confidence, event_id % 9 = 0 AS compliance_violation FROM events"""


@query("a18_metric_rules", f"""WITH r AS ({METRIC_ROWS}) SELECT event_id, 'High Latency' AS name, 'warning' AS severity, 15 AS cooldown_minutes FROM r WHERE p95_latency > 5000
UNION ALL SELECT event_id, 'Critical Error Rate', 'critical', 5 FROM r WHERE error_rate > 5 UNION ALL SELECT event_id, 'Budget Exceeded', 'critical', 60 FROM r WHERE daily_cost > daily_budget
UNION ALL SELECT event_id, 'Hallucination Detected', 'warning', 0 FROM r WHERE hallucination_confidence > 0.9 UNION ALL SELECT event_id, 'Compliance Violation', 'critical', 0 FROM r WHERE compliance_violation""")
def _(t):
    d = t.spark.sql(METRIC_ROWS.replace("FROM events", "FROM {e}"), e=t.events)
    return al.metric_rules(d).select("event_id", "name", "severity", "cooldown_minutes")


@query("a19_all_alerts", VIOL_SQL + """ SELECT 'technical' AS category, type, severity, count(*) AS rows, count(value) AS with_value FROM violations GROUP BY 2, 3
UNION ALL SELECT 'finops', 'budget_threshold', CASE WHEN threshold >= 100 THEN 'critical' ELSE 'warning' END, count(*), 0 FROM fin WHERE threshold IS NOT NULL GROUP BY 3
UNION ALL SELECT 'compliance', type, severity, count(*), 0 FROM comp GROUP BY 2, 3""")
def _(t):
    return al.all_alerts(*violation_frames(t)).groupBy("category", "type", "severity").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("with_value"))
