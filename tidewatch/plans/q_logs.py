"""Registered queries of N, E and S."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import bean_rules, enrich, normalise
from tidewatch.plans.fixtures import with_fixtures
from tidewatch.plans.registry import query
from tidewatch.session import work_dir
from tidewatch.sources import contracts, lifecycle, tables
from tidewatch.streaming import streams

NOW = "2024-02-01 00:00:00"
LOG_SQL = with_fixtures("app_logs")

# How each level reads once normalised, per spelling in the fixture.
LEVEL_SQL = """CASE raw_level WHEN 'ERR' THEN 'error' WHEN 'info' THEN 'info' WHEN 'Warning' THEN 'warn'
  WHEN 'notice' THEN 'info' WHEN 'crit' THEN 'fatal' END"""


def nested_logs(t):
    """The log view in its nested form."""
    return t.app_logs.select(
        "event_id", "ts", F.upper("raw_level").alias("level"), "log_type", "message",
        F.struct(F.col("service_name").alias("name"), F.lit("1.0").alias("version"), "environment").alias("service"),
        F.struct(F.concat(F.lit("host-"), F.col("event_id") % 5).alias("name"), "datacenter").alias("host"),
        F.struct(F.col("trace_id").alias("id"), "span_id").alias("trace"),
        F.struct(F.struct("status_code", "latency_ms").alias("response")).alias("http"),
        F.struct(F.col("client_ip").alias("ip")).alias("client"),
    )


def raw_events(t):
    """Events as they arrive: an event struct beside the arrival time; service is text or an object in turn."""
    return t.app_logs.select(
        "event_id", F.col("ts").alias("arrival"),
        F.struct(
            F.when(F.col("event_id") % 13 != 0, F.col("message")).alias("message"), F.col("raw_level").alias("level"),
            F.struct(F.col("service_name").alias("name"), F.lit("1.0").alias("version")).alias("service"),
            F.concat(F.lit("host-"), F.col("event_id") % 5).alias("host"),
            F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
            .when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"))
            .when(F.col("event_id") % 4 == 2, F.lit("yesterday")).alias("timestamp"),
            F.col("client_ip").alias("ip"),
        ).alias("event"),
    )


@query("n1_lift_event_fields", LOG_SQL + """
SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN message END AS message, raw_level AS log_level, service_name,
  concat('host-', event_id % 5) AS host_name, client_ip AS kept_ip FROM app_logs""")
def _(t):
    return normalise.lift_event_fields(raw_events(t)).select(
        "event_id", "message", "log_level", F.col("service.name").alias("service_name"), F.col("host.name").alias("host_name"),
        F.col("event.ip").alias("kept_ip"))


@query("n2_parse_event_time", LOG_SQL + """
SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN date_trunc('millisecond', ts) ELSE ts END AS ts FROM app_logs""")
def _(t):
    d = raw_events(t).select("event_id", "arrival", F.col("event.timestamp").alias("timestamp"))
    return normalise.parse_event_time(d).select("event_id", "ts")


@query("n3_add_ingest_time", LOG_SQL + f"""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '{NOW}' ELSE ts END AS ts, TIMESTAMP '{NOW}' AS ingested_at FROM app_logs""")
def _(t):
    d = t.app_logs.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("ts"))
    return normalise.add_ingest_time(d, NOW)


@query("n4_normalise_level", LOG_SQL + f"""SELECT event_id, {LEVEL_SQL} AS level FROM app_logs""")
def _(t):
    return t.app_logs.select("event_id", normalise.normalise_level(F.col("raw_level")).alias("level"))


@query("n5_drop_health_checks", LOG_SQL + """
SELECT event_id, message FROM app_logs WHERE NOT regexp_matches(message, 'health.?check|healthcheck|ping')""")
def _(t):
    return normalise.drop_health_checks(t.app_logs).select("event_id", "message")


@query("n6_geoip_enrich", with_fixtures("app_logs", "networks") + """, a AS (
SELECT event_id, client_ip, CAST(split_part(client_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(client_ip, '.', 2) AS BIGINT) * 65536
  + CAST(split_part(client_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(client_ip, '.', 4) AS BIGINT) AS n FROM app_logs)
SELECT event_id, client_ip, city_name, country_code2, continent_code, CAST(lat AS DOUBLE) AS lat FROM a LEFT JOIN networks ON n BETWEEN start_ip AND end_ip
QUALIFY row_number() OVER (PARTITION BY event_id, client_ip ORDER BY end_ip - start_ip, start_ip) = 1""")
def _(t):
    return normalise.geoip_enrich(t.app_logs, t.networks).select(
        "event_id", "client_ip", "geo.city_name", "geo.country_code2", "geo.continent_code", F.col("geo.location.lat").alias("lat"))


@query("n7_user_agent_enrich", LOG_SQL + """
SELECT event_id, CASE user_agent WHEN 'curl/7.68.0' THEN 'curl' WHEN 'something else' THEN 'Other' ELSE CASE WHEN contains(user_agent, 'Windows') THEN 'Browser' ELSE 'Mobile Browser' END END AS browser,
  CASE WHEN contains(user_agent, 'Windows') THEN 'Windows' WHEN contains(user_agent, 'iPhone') THEN 'iOS' WHEN contains(user_agent, 'Android') THEN 'Android' ELSE 'Other' END AS os,
  CASE WHEN contains(user_agent, 'Windows') THEN 'desktop' WHEN contains(user_agent, 'curl') THEN 'tool' WHEN user_agent = 'something else' THEN 'other' ELSE 'phone' END AS device
FROM app_logs""")
def _(t):
    return normalise.user_agent_enrich(t.app_logs).select("event_id", "agent.browser", "agent.os", "agent.device")


@query("n8_lift_kafka_metadata", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('topic-', event_type) END AS topic, CASE WHEN event_id % 2 = 0 THEN event_id % 3 END AS partition_no,
  CASE WHEN event_id % 2 = 0 THEN event_id * 10 END AS offset_no, CASE WHEN event_id % 2 = 0 THEN ts END AS broker_time FROM events""")
def _(t):
    d = t.events.select(
        "event_id", F.concat(F.lit("topic-"), "event_type").alias("topic"), (F.col("event_id") % 3).alias("partition"),
        (F.col("event_id") * 10).alias("offset"), F.col("ts").alias("broker_time"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("kafka"))).otherwise(F.array(F.lit("beats"))).alias("tags"))
    return normalise.lift_kafka_metadata(d).select(
        "event_id", "kafka.topic", F.col("kafka.partition").alias("partition_no"), F.col("kafka.offset").alias("offset_no"),
        F.col("kafka.timestamp").alias("broker_time"))


@query("n9_stamp_static_fields", LOG_SQL + "SELECT event_id, 'main' AS pipeline, 'node-01' AS node FROM app_logs")
def _(t):
    return normalise.stamp_static_fields(raw_events(t).drop("arrival"), {"pipeline": "main", "node": "node-01"})


@query("n10_annotate_dead_letters", LOG_SQL + f"""
SELECT event_id, message, concat('bad-', raw_level) AS reason, 'output' AS plugin_type, ts AS entry_time, TIMESTAMP '{NOW}' AS processed_at FROM app_logs WHERE status_code = 503""")
def _(t):
    d = t.app_logs.where("status_code = 503").select(
        "event_id", "message", F.concat(F.lit("bad-"), "raw_level").alias("reason"), F.lit("output").alias("plugin_type"),
        F.lit("p1").alias("plugin_id"), F.col("ts").alias("entry_time"))
    return normalise.annotate_dead_letters(d, NOW).select(
        "event_id", "message", "dlq.reason", "dlq.plugin_type", "dlq.entry_time", "dlq.processed_at")


def attributed(t):
    return t.app_logs.select("event_id", F.create_map(
        F.lit("environment"), F.col("environment"), F.lit("service"), F.col("service_name")).alias("attributes"))


@query("n11_upsert_attributes", LOG_SQL + """
SELECT event_id, 'production' AS environment, service_name AS service, 'observability-cluster' AS cluster, CAST(6 AS INT) AS entries FROM app_logs""")
def _(t):
    a = F.col("attributes")
    return normalise.upsert_attributes(attributed(t)).select(
        "event_id", a["environment"].alias("environment"), a["service"].alias("service"), a["cluster"].alias("cluster"),
        F.size("attributes").alias("entries"))


METRIC_NAMES = """SELECT event_id, value, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'system.memory.usage' WHEN 1 THEN 'http_seconds_bucket'
  WHEN 2 THEN 'system.cpu.utilization' WHEN 3 THEN 'bucket_count' ELSE 'system.memory.utilization' END AS metric FROM events"""


def metric_rows(t):
    return t.spark.sql(METRIC_NAMES.replace("FROM events", "FROM {e}"), e=t.events).withColumn(
        "labels", F.create_map(F.lit("id"), (F.col("event_id") % 7).cast("string")))


@query("n12_drop_metrics_by_name", f"""WITH m AS ({METRIC_NAMES}) SELECT event_id, metric FROM m WHERE metric NOT LIKE '%\\_bucket' ESCAPE '\\'""")
def _(t):
    return normalise.drop_metrics_by_name(metric_rows(t)).select("event_id", "metric")


@query("n13_tag_metric_units", f"""WITH m AS ({METRIC_NAMES}) SELECT event_id, metric, CASE WHEN metric = 'system.memory.usage' THEN 'bytes' END AS unit,
  TIMESTAMP '{NOW}' AS processed_at FROM m""")
def _(t):
    return normalise.tag_metric_units(metric_rows(t), NOW).select(
        "event_id", "metric", F.col("labels")["unit"].alias("unit"), "processed_at")


@query("n14_rename_metrics", f"""WITH m AS ({METRIC_NAMES}) SELECT event_id, CASE metric WHEN 'system.cpu.utilization' THEN 'cpu_utilization'
  WHEN 'system.memory.utilization' THEN 'memory_utilization' ELSE metric END AS metric FROM m""")
def _(t):
    return normalise.rename_metrics(metric_rows(t)).select("event_id", "metric")


@query("n15_sample_traces", LOG_SQL + """
SELECT event_id, trace_id FROM app_logs WHERE CAST(concat('0x', substr(md5(trace_id), 1, 8)) AS BIGINT) % 10000 < 2500""")
def _(t):
    return normalise.sample_traces(t.app_logs, 25, hashing="md5").select("event_id", "trace_id")


BEAN_CASES = (
    # bean text, metric, kind, labels as sorted k=v text
    ("kafka.server<type=KafkaServer, name=BrokerState><>Value", "kafka_server_broker_state", "GAUGE", ""),
    ("kafka.network<type=RequestMetrics, name=RequestsPerSec, request=Produce, version=9><>Count", "kafka_network_request_metrics_requests_total", "COUNTER", "request=Produce,version=9"),
    ("kafka.network<type=RequestMetrics, name=TotalTimeMs, request=Fetch><>99thPercentile", "kafka_network_request_total_time_ms", "GAUGE", "quantile=0.99,request=Fetch"),
    ("kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec, topic=logs><>Count", "kafka_server_broker_topic_metrics_bytes_in_total", "COUNTER", "topic=logs"),
    ("kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec><>Count", "kafka_server_broker_topic_metrics_bytes_in_total_all", "COUNTER", ""),
    ("kafka.log<type=Log, name=Size, topic=logs, partition=2><>Value", "kafka_log_size_bytes", "GAUGE", "partition=2,topic=logs"),
    ("java.lang<type=Memory><HeapMemoryUsage>used", "jvm_memory_heap_used_bytes", "GAUGE", ""),
    ("java.lang<type=GarbageCollector, name=G1 Old><CollectionTime>", "jvm_gc_collection_time_ms", "COUNTER", "gc=G1 Old"),
    ("java.nio<type=BufferPool, name=direct><MemoryUsed>", "jvm_buffer_pool_memory_used_bytes", "GAUGE", "pool=direct"),
    ("kafka.server<type=Unknown, name=Thing><>Value", None, None, None),
    ("com.example<type=KafkaServer, name=BrokerState><>Value", None, None, None),
)


def _q(x):
    return "CAST(NULL AS STRING)" if x is None else "'" + x + "'"


def _case(i):
    arms = " ".join(f"WHEN {k} THEN {_q(c[i])}" for k, c in enumerate(BEAN_CASES))
    return f"CASE CAST(event_id % {len(BEAN_CASES)} AS INT) {arms} END"


BEAN_SQL = f"SELECT event_id, value, {_case(0)} AS bean FROM events"


@query("n16_map_bean_names", f"""WITH b AS (SELECT event_id, value, {_case(1)} AS metric, {_case(2)} AS kind, {_case(3)} AS labels FROM events)
SELECT * FROM b WHERE metric IS NOT NULL""")
def _(t):
    beans = t.spark.sql(BEAN_SQL.replace("FROM events", "FROM {e}"), e=t.events)
    out = normalise.map_bean_names(beans, bean_rules.BEAN_RULES, bean_rules.ALLOWED_DOMAINS)
    text = F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return out.withColumn("labels", text)


@query("n17_relabel", """
SELECT event_id, concat('n', user_id % 3, ':', 9000 + user_id % 5) AS instance, concat('n', user_id % 3) AS node, 'blackbox-exporter:9115' AS address,
  'svc' AS job FROM events""")
def _(t):
    d = t.events.select("event_id", F.create_map(
        F.lit("__address__"), F.concat(F.lit("n"), F.col("user_id") % 3, F.lit(":"), F.lit(9000) + F.col("user_id") % 5),
        F.lit("job"), F.lit("svc")).alias("labels"))
    lab = F.col("labels")
    return normalise.relabel(d, bean_rules.NODE_RELABEL).select(
        "event_id", lab["instance"].alias("instance"), lab["node"].alias("node"), lab["__address__"].alias("address"), lab["job"].alias("job"))


PROCESS_SQL = """SELECT concat('host-', CAST(user_id % 5 AS STRING)) AS host, date_trunc('day', ts) AS ts, event_id AS pid,
  CAST((event_id * 37) % 1009 AS DOUBLE) AS cpu, CAST((event_id * 101) % 997 AS DOUBLE) AS memory FROM events"""


@query("n18_top_n_processes", f"""WITH p AS ({PROCESS_SQL}), r AS (
SELECT *, row_number() OVER (PARTITION BY host, ts ORDER BY cpu DESC, pid) AS c, row_number() OVER (PARTITION BY host, ts ORDER BY memory DESC, pid) AS m FROM p)
SELECT host, ts, pid, cpu, memory FROM r WHERE c <= 5 OR m <= 5""")
def _(t):
    d = t.spark.sql(PROCESS_SQL.replace("FROM events", "FROM {e}"), e=t.events)
    return normalise.top_n_processes(d).select("host", "ts", "pid", "cpu", "memory")


@query("n19_to_document", LOG_SQL + """
SELECT event_id, span_id, CAST(CASE WHEN latency_ms IS NULL THEN 0 ELSE 1 END + CASE WHEN span_id IS NULL THEN 0 ELSE 1 END + 2 AS INT) AS fields, CAST(1000 AS INT) AS message_length FROM app_logs""")
def _(t):
    d = t.app_logs.select("event_id", "span_id", "latency_ms", F.struct(F.repeat(F.lit("x"), 1200).alias("message")).alias("error"))
    doc = normalise.to_document(d)
    return doc.select(
        F.get_json_object("document", "$.event_id").cast("bigint").alias("event_id"),
        F.get_json_object("document", "$.span_id").alias("span_id"), F.size(F.json_object_keys("document")).alias("fields"),
        F.length(F.get_json_object("document", "$.error.message")).alias("message_length"))


@query("n20_nested_value", LOG_SQL + """
SELECT event_id, service_name AS a, status_code AS b, CAST(NULL AS STRING) AS c, CAST(user_k AS STRING) AS d FROM (
  SELECT l.event_id, service_name, status_code, json_extract_string(e.props, '$.k') AS user_k FROM app_logs l JOIN events e USING (event_id)) x""")
def _(t):
    d = nested_logs(t).join(t.events.select("event_id", "props"), "event_id")
    return d.select(
        "event_id", normalise.nested_value(d, "service.name").alias("a"), normalise.nested_value(d, "http.response.status_code").alias("b"),
        normalise.nested_value(d, "http.request.method").alias("c"), normalise.nested_value(d, "props.k").alias("d"))


TIER_SQL = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'platinum' WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' ELSE 'bronze' END"
SLA_SQL = LOG_SQL + f""", s AS (SELECT *, {TIER_SQL} AS tier, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 100 WHEN 1 THEN 250 WHEN 2 THEN 500 ELSE 1000 END AS budget FROM app_logs),
v AS (SELECT *, CASE WHEN coalesce(latency_ms, 0) <> 0 THEN latency_ms > budget ELSE false END AS breach,
  CASE WHEN coalesce(latency_ms, 0) = 0 THEN 'unknown' WHEN latency_ms < 50 THEN 'fast' WHEN latency_ms < 200 THEN 'normal' WHEN latency_ms < 500 THEN 'slow'
       WHEN latency_ms < 2000 THEN 'very_slow' ELSE 'critical' END AS category FROM s)"""


def enriched(t):
    d = nested_logs(t).withColumn("tier", F.expr(TIER_SQL))
    latency, status = F.col("http.response.latency_ms"), F.col("http.response.status_code")
    return enrich.sli_flags(enrich.sla_check(d, F.col("tier"), latency), latency, status)


@query("e1_sla_check", SLA_SQL + """
SELECT event_id, tier, CAST(budget AS INT) AS latency_budget_ms, CASE tier WHEN 'platinum' THEN 99.99::DOUBLE WHEN 'gold' THEN 99.9 WHEN 'silver' THEN 99.5 ELSE 99.0 END AS availability_target,
  breach, CASE WHEN coalesce(latency_ms, 0) <> 0 THEN greatest(0, budget - latency_ms) END AS remaining_budget_ms FROM v""")
def _(t):
    return enriched(t).select("event_id", "sla.*")


@query("e2_sli_flags", SLA_SQL + """SELECT event_id, category AS latency_category, status_code < 500 AS success, CASE WHEN breach THEN 1 ELSE 0 END AS error_budget_impact FROM v""")
def _(t):
    return enriched(t).select("event_id", "sli.*")


@query("e3_latency_category", SLA_SQL + """SELECT category AS latency_category, count(*) AS rows FROM v GROUP BY 1""")
def _(t):
    return t.app_logs.groupBy(enrich.latency_category(F.col("latency_ms")).alias("latency_category")).agg(F.count(F.lit(1)).alias("rows"))


@query("e4_correlation_chain", LOG_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS rn FROM app_logs),
s AS (SELECT trace_id, rn, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY rn) AS k FROM o WHERE span_id IS NOT NULL),
p AS (SELECT o.event_id, o.span_id, count(s.k) AS depth, max_by(s.span_id, s.k) AS parent, min_by(s.span_id, s.k) AS root
  FROM o LEFT JOIN s ON s.trace_id = o.trace_id AND s.rn < o.rn AND s.k <= 10 GROUP BY 1, 2)
SELECT event_id, CAST(depth AS INT) AS chain_depth, parent AS parent_span_id, CASE WHEN depth > 0 THEN root ELSE span_id END AS root_span_id, depth = 0 AS is_root FROM p""")
def _(t):
    return enrich.correlation_chain(t.app_logs).select("event_id", "correlation.*")


@query("e5_cost_center", LOG_SQL + """SELECT event_id, CASE service_name WHEN 'api-gateway' THEN 'platform' WHEN 'order-service' THEN 'product' WHEN 'payment-service' THEN 'product'
  WHEN 'search-service' THEN 'analytics' ELSE 'engineering' END AS center FROM app_logs""")
def _(t):
    return t.app_logs.select("event_id", enrich.cost_center(F.col("service_name")).alias("center"))


@query("e6_level_from_status", LOG_SQL + """SELECT event_id, CASE WHEN status_code < 400 THEN 'INFO' WHEN status_code < 500 THEN 'WARN' ELSE 'ERROR' END AS level FROM app_logs""")
def _(t):
    return t.app_logs.select("event_id", enrich.level_from_status(F.col("status_code")).alias("level"))


@query("e7_level_from_resources", LOG_SQL + """SELECT event_id, CASE WHEN cpu > 90 OR mem > 90 THEN 'ERROR' WHEN cpu > 75 OR mem > 80 THEN 'WARN' ELSE 'INFO' END AS level,
  CASE WHEN cpu > 90 OR mem > 90 THEN 'Resource usage critical' WHEN cpu > 75 OR mem > 80 THEN 'Resource usage high' ELSE 'System metrics collected' END AS message FROM app_logs""")
def _(t):
    d = t.app_logs.select("event_id", enrich.level_from_resources(F.col("cpu"), F.col("mem")).alias("r"))
    return d.select("event_id", "r.*")


ROUTE_SQL = SLA_SQL + """, w AS (SELECT event_id, service_name, environment, log_type, datacenter, breach, category, upper(raw_level) AS level FROM v),
routed AS (SELECT event_id, service_name,
  concat('logs-', service_name) AS by_service,
  CASE WHEN datacenter IS NULL THEN 'logs' ELSE concat('logs-', replace(datacenter, 'dc-', '')) END AS by_datacenter,
  CASE environment WHEN 'production' THEN 'logs-prod' WHEN 'staging' THEN 'logs-staging' ELSE 'logs-dev' END AS by_environment,
  concat('logs-', CASE log_type WHEN 'metric' THEN 'metrics' ELSE log_type END) AS by_log_type,
  CASE WHEN level IN ('FATAL') THEN 'logs-critical' WHEN level = 'ERROR' THEN 'logs-errors' WHEN breach THEN 'logs-sla-breaches'
    WHEN service_name IN ('payment-service', 'order-service') THEN 'logs-payments' WHEN category IN ('critical', 'very_slow') THEN 'logs-performance-issues'
    WHEN datacenter = 'dc-us-east-1' THEN 'logs-us-east' WHEN datacenter = 'dc-us-west-2' THEN 'logs-us-west' WHEN datacenter = 'dc-eu-west-1' THEN 'logs-europe'
    WHEN level = 'INFO' THEN 'logs-info' WHEN level = 'WARN' THEN 'logs-warnings' ELSE 'logs' END AS by_level FROM w)"""


@query("e8_route_topic", ROUTE_SQL + "SELECT event_id, by_service, by_datacenter, by_environment, by_log_type, by_level, 'logs' AS static FROM routed")
def _(t):
    d = enriched(t)
    plain = ("static", "by_service", "by_datacenter", "by_environment", "by_log_type")
    return d.select("event_id", *[enrich.route_topic(d, s).alias(s) for s in plain],
                    enrich.route_topic(d, "by_level", enrich.EXAMPLE_ROUTES).alias("by_level"))


@query("e9_partition_key", LOG_SQL + "SELECT event_id, service_name AS key FROM app_logs")
def _(t):
    d = nested_logs(t)
    return d.select("event_id", enrich.partition_key(d).alias("key"))


@query("e10_topic_stats", ROUTE_SQL + "SELECT by_level AS topic, count(*) AS messages FROM routed GROUP BY 1")
def _(t):
    d = enriched(t)
    return enrich.topic_stats(d.withColumn("topic", enrich.route_topic(d, "by_level", enrich.EXAMPLE_ROUTES)))


@query("e11_ingest_rate", LOG_SQL + """SELECT service_name AS sink, date_trunc('hour', ts) AS window_start, count(*) AS rows, round(count(*) / 3600.0, 8) AS rows_per_second FROM app_logs GROUP BY 1, 2""")
def _(t):
    return enrich.ingest_rate(t.app_logs.withColumnRenamed("service_name", "sink")).withColumn("rows_per_second", F.round("rows_per_second", 8))


@query("e12_enrichment_stamp", LOG_SQL + f"""SELECT event_id, 'payments' AS custom_team, '1.0' AS version, TIMESTAMP '{NOW}' AS stamped FROM app_logs""")
def _(t):
    d = enrich.enrichment_stamp(t.app_logs, {"team": "payments"}, NOW)
    return d.select("event_id", F.col("custom")["team"].alias("custom_team"), "_enrichment.version", F.col("_enrichment.timestamp").alias("stamped"))


EVENT = T.StructType().add("event_id", "long").add("message", "string").add("level", "string").add("service", T.StructType().add("name", "string"))
_EVENT_SQL = "SELECT event_id, message, raw_level AS level, service_name AS service"


def event_rows(t):
    """Log rows as the nested events that shippers send."""
    return t.app_logs.select("ts", F.struct("event_id", "message", F.col("raw_level").alias("level"), F.struct(F.col("service_name").alias("name")).alias("service")).alias("event"))


@query("s1_parse_records", LOG_SQL + _EVENT_SQL + ", concat('logs-', event_id % 3) AS topic, event_id AS \"offset\", ts AS broker_time, 'kafka' AS tag FROM app_logs")
def _(t):
    """The body of the broker source over rows in the form of a broker's."""
    i = F.col("event.event_id")
    records = event_rows(t).select(
        F.to_json("event").cast("binary").alias("value"), F.concat(F.lit("logs-"), (i % 3).cast("string")).alias("topic"),
        (i % 8).cast("int").alias("partition"), i.alias("offset"), F.col("ts").alias("timestamp"))
    d = streams.parse_records(records, EVENT)
    return d.select("event.event_id", "event.message", "event.level", F.col("event.service.name").alias("service"), "topic", "offset", "broker_time", F.col("tags")[0].alias("tag"))


@query("s2_read_json_landing", LOG_SQL + _EVENT_SQL + ", 'beats' AS origin FROM app_logs")
def _(t):
    path = work_dir(t.spark, "landing")
    event_rows(t).select("event").write.json(path)
    d = streams.read_json_landing(t.spark, path, T.StructType([T.StructField("event", EVENT)]), "beats", stream=False)
    return d.select("event.event_id", "event.message", "event.level", F.col("event.service.name").alias("service"), "origin")


@query("s3_read_dead_letters", LOG_SQL + "SELECT event_id, concat('bad-', raw_level) AS reason, 'output' AS plugin_type, ts AS entry_time FROM app_logs WHERE status_code = 503")
def _(t):
    path = work_dir(t.spark, "dead-letters")
    t.app_logs.where("status_code = 503").select(
        "event_id", F.concat(F.lit("bad-"), "raw_level").alias("reason"), F.lit("output").alias("plugin_type"),
        F.col("ts").alias("entry_time")).write.mode("append").parquet(path)
    return tables.read_dead_letters(t.spark, path)


@query("s4_write_daily_partitions", LOG_SQL + """SELECT concat('logs-', strftime(ts, '%Y.%m.%d')) AS index_name, CAST(ts AS DATE) AS log_date, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM app_logs GROUP BY 1, 2""")
def _(t):
    path = work_dir(t.spark, "daily")
    tables.write_daily_partitions(t.app_logs, path, "logs")
    return t.spark.read.parquet(path).groupBy("index_name", "log_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


@query("s5_write_failed_events", LOG_SQL + """SELECT concat('failed-events-', strftime(ts, '%Y.%m.%d')) AS index_name, CAST(ts AS DATE) AS failed_date, count(*) AS rows FROM app_logs WHERE status_code = 503 GROUP BY 1, 2""")
def _(t):
    path = work_dir(t.spark, "failed")
    tables.write_failed_events(t.app_logs.where("status_code = 503").withColumnRenamed("ts", "entry_time"), path)
    return t.spark.read.parquet(path).groupBy("index_name", "failed_date").agg(F.count(F.lit(1)).alias("rows"))


@query("s6_write_routed", ROUTE_SQL + "SELECT by_level AS topic, service_name AS key, count(*) AS messages, CAST(sum(event_id) AS BIGINT) AS ids FROM routed GROUP BY 1, 2")
def _(t):
    path = work_dir(t.spark, "routed")
    d = enriched(t)
    tables.write_routed(d, enrich.route_topic(d, "by_level", enrich.EXAMPLE_ROUTES), enrich.partition_key(d), path)
    return t.spark.read.parquet(path).groupBy("topic", "key").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.get_json_object("value", "$.event_id").cast("bigint")).alias("ids"))


VERSIONS = """SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(floor(event_id / 3) AS BIGINT) END AS request_id, ts, event_id, value FROM events"""


@query("s7_upsert_by_request_id", f"""WITH v AS ({VERSIONS})
SELECT request_id, max_by(event_id, ts) AS event_id, max_by(value, ts) AS value FROM v WHERE request_id IS NOT NULL GROUP BY request_id
UNION ALL SELECT request_id, event_id, value FROM v WHERE request_id IS NULL""")
def _(t):
    d = t.spark.sql(VERSIONS.replace("FROM events", "FROM {e}"), e=t.events)
    return tables.latest_by_id(d).select("request_id", "event_id", "value")


IDED = "SELECT CAST(floor(event_id / 3) AS BIGINT) AS request_id, ts AS sent, event_id, value FROM events"


@query("s7_upsert_sink", f"""WITH v AS ({IDED}), n AS (SELECT request_id, max_by(event_id, sent) AS event_id, max_by(value, sent) AS value FROM v GROUP BY request_id)
SELECT request_id, event_id, CASE WHEN request_id % 2 = 0 THEN -value ELSE value END AS value FROM n""")
def _(t):
    """Written, replayed, and partly replaced by later versions, one day of them compacted: each id comes once, in its newest version."""
    path = work_dir(t.spark, "upsert")
    d = t.spark.sql(IDED.replace("FROM events", "FROM {e}"), e=t.events)
    d = d.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("request_id") % 20 * 86400))
    newer = tables.latest_by_id(d, order=["sent"]).where("request_id % 2 = 0").withColumns({"value": -F.col("value"), "sent": F.col("sent") + F.expr("INTERVAL 1 HOUR")})
    for number, batch in enumerate((d, newer)):
        for _ in range(2):
            tables.upsert_by_request_id(batch, path, number, order=["sent"])
    tables.compact_versions(t.spark, path, ["2024-01-03"], 2, order=["sent"])
    return tables.read_versions(t.spark, path, order=["sent"]).select("request_id", "event_id", "value")


@query("s8_write_with_rejects", LOG_SQL + f""", c AS (SELECT *, coalesce(latency_ms < 4000, false) AS ok FROM app_logs)
SELECT 'kept' AS outcome, event_id, CAST(NULL AS STRING) AS error FROM c WHERE ok UNION ALL SELECT 'rejected', event_id, 'contract violated' FROM c WHERE NOT ok""")
def _(t):
    d = t.app_logs.select("event_id", "latency_ms", "ts")
    good, bad = contracts.split_by_contract(d, F.col("latency_ms") < 4000, "logs", NOW)
    return good.select(F.lit("kept").alias("outcome"), "event_id", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select(F.lit("rejected").alias("outcome"), F.get_json_object("document", "$.event_id").cast("bigint").alias("event_id"), "error"))


@query("s8_replay_rejects", LOG_SQL + """, c AS (SELECT event_id, latency_ms, '{"event_id":' || event_id || coalesce(',"latency_ms":' || latency_ms, '') || '}' AS document
  FROM app_logs WHERE NOT coalesce(latency_ms < 1000, false) ORDER BY document LIMIT 100)
SELECT count(*) AS retried, count(*) FILTER (WHERE latency_ms < 3000 AND event_id % 7 <> 0) AS success, count(*) FILTER (WHERE NOT coalesce(latency_ms < 3000, false)) AS failed FROM c""")
def _(t):
    d = t.app_logs.select("event_id", "latency_ms")
    _, bad = contracts.split_by_contract(d, F.col("latency_ms") < 1000, "logs", NOW)
    schema = T.StructType().add("event_id", "long").add("latency_ms", "integer")
    written = d.where("event_id % 7 = 0")
    return contracts.replay_counts(contracts.replay_rejects(bad, schema, F.col("latency_ms") < 3000, written, "event_id"))


@query("s9_enforce_strict_schema", """
SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 1 THEN 'unknown_field:colour' WHEN 2 THEN 'wrong_type' WHEN 3 THEN 'not_json' WHEN 4 THEN 'unknown_field:http.verb' END AS reason,
  CASE WHEN event_id % 6 IN (0, 5) THEN event_id END AS parsed_id FROM events""")
def _(t):
    i = F.col("event_id").cast("string")
    doc = (
        F.when(F.col("event_id") % 6 == 1, F.concat(F.lit('{"id":'), i, F.lit(',"colour":"red"}')))
        .when(F.col("event_id") % 6 == 2, F.concat(F.lit('{"id":"x'), i, F.lit('"}')))
        .when(F.col("event_id") % 6 == 3, F.concat(F.lit('{"id":'), i))
        .when(F.col("event_id") % 6 == 4, F.concat(F.lit('{"id":'), i, F.lit(',"http":{"status":200,"verb":"GET"}}')))
        .otherwise(F.concat(F.lit('{"id":'), i, F.lit(',"http":{"status":200}}')))
    )
    schema = T.StructType().add("id", "long").add("http", T.StructType().add("status", "integer"))
    d = contracts.enforce_strict_schema(t.events.select("event_id", doc.alias("document")), schema)
    return d.select("event_id", "reason", F.col("row.id").alias("parsed_id"))


@query("s10_reindex", """
SELECT event_id AS line_id, event_type, CASE WHEN event_id % 4 <> 0 THEN CAST(CAST(value AS FLOAT) AS DOUBLE) END AS duration_ms, CAST(user_id AS STRING) AS line FROM events""")
def _(t):
    old = t.events.select(
        "ts", "event_id", "event_type", F.col("user_id").alias("line"),
        F.when(F.col("event_id") % 4 != 0, F.col("value").cast("string")).otherwise(F.lit("n/a")).alias("duration_ms"))
    new = tables.reindex(old, {**tables.INDUSTRIAL_COLUMNS, "event_id": "bigint"})
    return new.select(F.col("event_id").alias("line_id"), "event_type", F.col("duration_ms").cast("double").alias("duration_ms"), "line")


PARTITION_SQL = """SELECT p.policy, CAST(o_orderdate AS DATE) AS log_date, count(*) AS docs, CAST(sum(o_orderkey) AS BIGINT) * 40000 AS primary_bytes
FROM orders CROSS JOIN (VALUES ('logs'), ('metrics'), ('events'), ('ai-metrics'), ('ai-compliance'), ('ai-audit')) AS p(policy) GROUP BY 1, 2"""
LIFE_AS_OF = "1998-08-01"


def day_stats(t):
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("log_date")).agg(
        F.count(F.lit(1)).alias("docs"), (F.sum("o_orderkey") * 40000).alias("primary_bytes"))
    return days.select(F.explode(F.array(*[F.lit(p) for p in lifecycle.POLICIES])).alias("policy"), "log_date", "docs", "primary_bytes")


@query("s11_lifecycle_phase", f"""WITH p AS ({PARTITION_SQL}), a AS (SELECT policy, log_date, date_diff('day', log_date, DATE '{LIFE_AS_OF}') AS age FROM p)
SELECT policy, log_date, CAST(age AS INT) AS age_days, CASE policy
  WHEN 'logs' THEN CASE WHEN age >= 90 THEN 'delete' WHEN age >= 30 THEN 'cold' WHEN age >= 7 THEN 'warm' WHEN age >= 0 THEN 'hot' END
  WHEN 'ai-metrics' THEN CASE WHEN age >= 90 THEN 'delete' WHEN age >= 30 THEN 'cold' WHEN age >= 7 THEN 'warm' WHEN age >= 0 THEN 'hot' END
  WHEN 'metrics' THEN CASE WHEN age >= 30 THEN 'delete' WHEN age >= 3 THEN 'warm' WHEN age >= 0 THEN 'hot' END
  WHEN 'events' THEN CASE WHEN age >= 60 THEN 'delete' WHEN age >= 7 THEN 'warm' WHEN age >= 0 THEN 'hot' END
  WHEN 'ai-compliance' THEN CASE WHEN age >= 2555 THEN 'delete' WHEN age >= 365 THEN 'frozen' WHEN age >= 90 THEN 'cold' WHEN age >= 30 THEN 'warm' WHEN age >= 0 THEN 'hot' END
  ELSE CASE WHEN age >= 3650 THEN 'delete' WHEN age >= 180 THEN 'frozen' WHEN age >= 60 THEN 'cold' WHEN age >= 14 THEN 'warm' WHEN age >= 0 THEN 'hot' END END AS phase FROM a""")
def _(t):
    return lifecycle.lifecycle_phase(day_stats(t), LIFE_AS_OF).select("policy", "log_date", "age_days", "phase")


@query("s12_apply_retention", f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS log_date FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '{LIFE_AS_OF}') < 90 OR o_orderkey % 10 = 0""")
def _(t):
    d = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("log_date"), (F.col("o_orderkey") % 10 == 0).alias("legal_hold"))
    return lifecycle.apply_retention(d, "logs", LIFE_AS_OF).select("o_orderkey", "log_date")


@query("s13_rollover_plan", f"""WITH p AS ({PARTITION_SQL}), l AS (SELECT *, CASE policy WHEN 'metrics' THEN 30 WHEN 'ai-audit' THEN 30 ELSE 50 END * CAST(1073741824 AS BIGINT) AS size_limit,
  CASE policy WHEN 'metrics' THEN 5000000 WHEN 'ai-compliance' THEN 5000000 WHEN 'ai-audit' THEN 2000000 ELSE 10000000 END AS doc_limit FROM p)
SELECT policy, log_date, concat_ws(',', CASE WHEN date_diff('day', log_date, DATE '{LIFE_AS_OF}') >= 1 THEN 'age' END, CASE WHEN primary_bytes >= size_limit THEN 'size' END,
  CASE WHEN docs >= doc_limit THEN 'docs' END) AS reasons,
  date_diff('day', log_date, DATE '{LIFE_AS_OF}') >= 1 OR primary_bytes >= size_limit OR docs >= doc_limit AS rollover FROM l""")
def _(t):
    return lifecycle.rollover_plan(day_stats(t), LIFE_AS_OF).select("policy", "log_date", "reasons", "rollover")


@query("s14_compact_partitions", LOG_SQL + """SELECT CAST(ts AS DATE) AS log_date, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids,
  CAST(CASE WHEN CAST(ts AS DATE) IN (DATE '2024-01-02', DATE '2024-01-03') THEN 1 END AS BIGINT) AS files FROM app_logs GROUP BY 1""")
def _(t):
    path = work_dir(t.spark, "compact")
    tables.write_daily_partitions(t.app_logs, path, "logs")
    tables.write_daily_partitions(t.app_logs.limit(0), path, "logs")
    days = ["2024-01-02", "2024-01-03"]
    tables.compact_partitions(t.spark, path, days)
    return t.spark.read.parquet(path).withColumn("file", F.input_file_name()).groupBy("log_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"), F.countDistinct("file").alias("_f")
    ).select("log_date", "rows", "ids", F.when(F.col("log_date").isin(*[F.lit(d).cast("date") for d in days]), F.col("_f")).alias("files"))


@query("s15_read_index_pattern", LOG_SQL + """SELECT event_id, ts FROM app_logs WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-09 18:00:00'""")
def _(t):
    path = work_dir(t.spark, "pattern")
    tables.write_daily_partitions(t.app_logs, path, "logs-app")
    tables.write_daily_partitions(t.app_logs, path, "metrics")
    return tables.read_index_pattern(t.spark, path, "logs", "2024-01-05 06:00:00", "2024-01-09 18:00:00").select("event_id", "ts")


@query("s16_read_samples", with_fixtures("samples") + """SELECT metric, job, instance, 'prod' AS cluster, count(*) AS samples, sum(value) AS total FROM samples GROUP BY ALL""")
def _(t):
    path = work_dir(t.spark, "samples")
    t.samples.write.parquet(path)
    d = tables.read_samples(t.spark, path, {"cluster": "prod"})
    lab = F.col("labels")
    return d.groupBy("metric", lab["job"].alias("job"), lab["instance"].alias("instance"), lab["cluster"].alias("cluster")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total"))


@query("s17_write_summary_json", """WITH c AS (SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'passed' WHEN 1 THEN 'warning' WHEN 2 THEN 'failed' ELSE 'skipped' END AS status FROM nation)
SELECT 'fleet' AS title, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(count(*) AS INT) AS checks FROM c""")
def _(t):
    path = work_dir(t.spark, "report")
    status = F.element_at(F.array(*[F.lit(s) for s in ("passed", "warning", "failed", "skipped", "skipped")]), F.col("n_regionkey") + 1)
    checks = t.nation.select(F.concat(F.lit("check-"), "n_nationkey").alias("check"), status.alias("status"), F.col("n_name").alias("message"))
    tables.write_summary_json(checks, path, {"title": "fleet"})
    schema = "title string, summary struct<passed bigint, failed bigint>, checks array<struct<check string, status string>>"
    return t.spark.read.schema(schema).json(path).select("title", "summary.passed", "summary.failed", F.size("checks").alias("checks"))
