"""Registered queries of D, Q, U and of P5-P12."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.columns import hash16
from tidewatch.operators import cognitive, cost, governance, health, reconcile, requests, search
from tidewatch.plans import q_requests, q_text
from tidewatch.plans.fixtures import with_fixtures
from tidewatch.plans.q_requests import COSTS_SQL, REQ_SQL
from tidewatch.plans.registry import ORACLES, query
from tidewatch.session import work_dir
from tidewatch.sources import erasure

CHECKS = with_fixtures("health_checks")


def r(c, n=6):
    return F.round(F.col(c).cast("double"), n).alias(c)


@query("d1_health_streaks", CHECKS + """, h AS (SELECT *, max(CASE WHEN status = 'healthy' THEN ts END) OVER (PARTITION BY service ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_success,
  count(CASE WHEN status = 'healthy' THEN 1 END) OVER (PARTITION BY service ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM health_checks)
SELECT event_id, last_success, CAST(sum(CASE WHEN status <> 'healthy' THEN 1 ELSE 0 END) OVER (PARTITION BY service, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consecutive_failures FROM h""")
def _(t):
    return health.health_streaks(t.health_checks).select("event_id", "last_success", "consecutive_failures")


AVAIL_SQL = CHECKS + """, n AS (SELECT *, {key} AS k FROM health_checks),
s AS (SELECT *, lead(ts) OVER w AS nts, lag(status = 'healthy') OVER w AS was, max(CASE WHEN status = 'healthy' THEN ts END) OVER (PARTITION BY k) AS last_ok,
  max(ts) OVER (PARTITION BY k) AS last_ts FROM n WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)),
a AS (SELECT k, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS total, coalesce(sum(CASE WHEN status <> 'healthy' THEN (epoch_us(nts) - epoch_us(ts)) / 1e6 END), 0) AS down,
  count(*) FILTER (WHERE status <> 'healthy' AND coalesce(was, true)) AS outages, max(CASE WHEN last_ok < last_ts THEN 1 ELSE 0 END) AS still,
  coalesce(sum(CASE WHEN status <> 'healthy' AND ts > last_ok THEN (epoch_us(nts) - epoch_us(ts)) / 1e6 END), 0) AS open_s FROM s GROUP BY k)"""


@query("d2_availability", AVAIL_SQL.replace("{key}", "service") + """
SELECT k AS service, round(total, 3) AS total_seconds, round(down, 3) AS downtime_seconds, round((total - down) / total * 100, 6) AS uptime_percentage, (total - down) / total * 100 >= 99.9 AS sla_met,
  outages AS incident_count, round((down - open_s) / (outages - still), 3) AS mttr_seconds, round((total - down) / outages, 3) AS mtbf_seconds FROM a""")
def _(t):
    return health.availability(t.health_checks).select(
        "service", r("total_seconds", 3), r("downtime_seconds", 3), r("uptime_percentage"), "sla_met", "incident_count", r("mttr_seconds", 3), r("mtbf_seconds", 3))


@query("d3_deployment_history", with_fixtures("deployments") + """, d AS (SELECT deployment_id, min_by(version, event_id) AS version, min_by(strategy, event_id) AS strategy, min(ts) AS started_at,
  max_by(status, event_id) AS status, max(CASE WHEN status = 'completed' THEN ts END) AS done, max_by(canary_percentage, event_id) AS c FROM deployments GROUP BY 1)
SELECT deployment_id, version, strategy, started_at, status, round((epoch_us(done) - epoch_us(started_at)) / 1e6, 3) AS duration_seconds, CASE WHEN strategy = 'canary' THEN c END AS canary_percentage FROM d""")
def _(t):
    return health.deployment_history(t.deployments).select(
        "deployment_id", "version", "strategy", "started_at", "status", r("duration_seconds", 3), "canary_percentage")


@query("d4_scaling_events", with_fixtures("scaling") + """
SELECT event_type, scale_trigger, count(*) AS events, CAST(sum(replicas_after - replicas_before) AS BIGINT) AS replica_delta FROM scaling GROUP BY 1, 2""")
def _(t):
    return health.scaling_counts(t.scaling)


@query("d4_scaling_limits", with_fixtures("scaling") + "SELECT event_id, coalesce(min_replicas, 2) AS min_replicas, 20 AS max_replicas, replicas_after - replicas_before AS replica_delta FROM scaling")
def _(t):
    return health.scaling_events(t.scaling).select("event_id", "min_replicas", "max_replicas", "replica_delta")


@query("d5_circuit_breaker_state", with_fixtures("breakers") + """
SELECT name, max_by(state, event_id) AS state, max_by(failure_count, event_id) AS failure_count, max(CASE WHEN state = 'open' THEN ts END) AS last_failure,
  CASE WHEN max(event_id) % 4 = 0 THEN 60 ELSE CAST(30 + max(event_id) % 4 AS INT) END AS reset_timeout FROM breakers GROUP BY name""")
def _(t):
    return health.circuit_breaker_state(t.breakers)


# Ids repeat after a resolved event, so that some incidents have several episodes.
INC = "WITH x AS (SELECT 1), " + with_fixtures("incidents")[5:] + ", inc AS (SELECT event_id, ts, incident_id % 50 AS incident_id, status, severity FROM incidents)"


@query("d6_incident_lifecycle", INC + """, e AS (SELECT *, coalesce(sum(CASE WHEN status = 'resolved' THEN 1 ELSE 0 END) OVER (PARTITION BY incident_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM inc)
SELECT incident_id, CAST(episode AS BIGINT) AS episode, min_by(severity, event_id) AS severity, max_by(status, event_id) AS status, min(ts) AS started_at, count(*) AS events,
  max(CASE WHEN status = 'resolved' THEN ts END) AS resolved_at, CAST(floor((epoch_us(max(CASE WHEN status = 'resolved' THEN ts END)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS duration_seconds FROM e GROUP BY 1, 2""")
def _(t):
    return health.incident_lifecycle(t.incidents.withColumn("incident_id", F.col("incident_id") % 50))


@query("d7_system_status", AVAIL_SQL.replace("{key}", "1") + ", " + with_fixtures("deployments", "incidents", "breakers", "app_logs")[5:] + """,
dd AS (SELECT max_by(status, event_id) AS status FROM deployments GROUP BY deployment_id), ii AS (SELECT max_by(status, event_id) AS status FROM incidents GROUP BY incident_id)
SELECT (SELECT max_by(status, event_id) FROM health_checks) AS health, round((total - down) / total * 100, 6) AS uptime_percentage, outages AS incident_count,
  (SELECT count(*) FROM dd WHERE status NOT IN ('completed', 'failed')) AS active_deployments, (SELECT count(*) FROM ii WHERE status <> 'resolved') AS active_incidents,
  (SELECT string_agg(concat(name, '=', state), ',' ORDER BY name) FROM (SELECT name, max_by(state, event_id) AS state FROM breakers GROUP BY name) b) AS breakers,
  (SELECT round(avg(cpu), 6) FROM app_logs) AS cpu_percent, (SELECT round(avg(mem), 6) FROM app_logs) AS memory_percent FROM a""")
def _(t):
    d = health.system_status(t.health_checks, t.deployments, t.incidents, t.breakers, t.app_logs)
    text = F.array_join(F.transform(F.map_entries("circuit_breakers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return d.select("health", r("uptime_percentage"), "incident_count", "active_deployments", "active_incidents", text.alias("breakers"), r("cpu_percent"), r("memory_percent"))


@query("d8_health_status_counts", CHECKS + "SELECT status, count(*) AS checks FROM health_checks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return health.health_status_counts(t.health_checks)


@query("d9_resource_usage_over_time", with_fixtures("app_logs") + "SELECT date_trunc('day', ts) AS bucket, round(avg(cpu), 6) AS cpu, round(avg(mem), 6) AS mem FROM app_logs GROUP BY 1")
def _(t):
    return health.resource_usage_over_time(t.app_logs).select("bucket", r("cpu"), r("mem"))


# --- governance


@query("p5_model_approvals", with_fixtures("ai_requests", "approvals") + """
SELECT request_id, CASE WHEN a.approved_by IS NULL THEN 'pending' ELSE 'approved' END AS approval_status, a.approved_by, a.risk_level, a.use_case
FROM ai_requests r ASOF LEFT JOIN approvals a ON r.provider = a.provider AND r.model = a.model AND r.ts >= a.ts""")
def _(t):
    return governance.model_approvals(t.ai_requests, t.approvals).select("request_id", "approval_status", "approved_by", "risk_level", "use_case")


CONSENT_SQL = with_fixtures("ai_requests", "consents", "erasures") + """, ev AS (SELECT subject_id, ts, given FROM consents UNION ALL SELECT subject_id, ts, NULL FROM erasures),
q AS (SELECT r.*, CAST(user_id AS STRING) AS subject_id FROM ai_requests r)"""


@query("p6_consent_as_of", CONSENT_SQL + """
SELECT request_id, coalesce(e.given, false) AS consent_given FROM q ASOF LEFT JOIN ev e ON q.subject_id = e.subject_id AND q.ts >= e.ts""")
def _(t):
    q = t.ai_requests.withColumn("subject_id", F.col("user_id").cast("string"))
    return governance.consent_as_of(q, t.consents, t.erasures).select("request_id", "consent_given")


POLICY = "CASE CAST(request_id % 5 AS INT) WHEN 0 THEN 'default' WHEN 1 THEN 'audit' WHEN 2 THEN 'compliance' WHEN 3 THEN 'legal_hold' ELSE 'other' END"


@query("p7_retention_dates", REQ_SQL + f""", p AS (SELECT request_id, ts, {POLICY} AS p FROM ai_requests)
SELECT request_id, ts + INTERVAL 90 DAY AS deletion_scheduled, ts + to_days(CASE p WHEN 'default' THEN 90 WHEN 'audit' THEN 365 WHEN 'compliance' THEN 2555 WHEN 'legal_hold' THEN 3650 ELSE 90 END) AS deletion_date FROM p""")
def _(t):
    return governance.retention_dates(t.ai_requests.withColumn("retention_policy", F.expr(POLICY))).select("request_id", "deletion_scheduled", "deletion_date")


FACTS_SQL = with_fixtures("ai_requests", "approvals", "consents", "erasures") + """, ev AS (SELECT subject_id, ts, given FROM consents UNION ALL SELECT subject_id, ts, NULL FROM erasures),
q AS (SELECT r.*, CAST(user_id AS STRING) AS subject_id FROM ai_requests r),
f AS (SELECT q.request_id, q.ts, q.provider, q.model, q.subject_id, q.request_id % 4 = 0 AS pii_detected, coalesce(e.given, false) AS consent_given,
  CASE WHEN a.approved_by IS NULL THEN 'pending' ELSE 'approved' END AS approval_status, q.request_id % 21 = 0 AS policy_violation,
  q.request_id % 6 = 0 AS oversight_required, q.request_id % 12 = 0 AS oversight_present
  FROM q ASOF LEFT JOIN ev e ON q.subject_id = e.subject_id AND q.ts >= e.ts ASOF LEFT JOIN approvals a ON q.provider = a.provider AND q.model = a.model AND q.ts >= a.ts),
violations AS (
  SELECT request_id, ts, 'pii_without_consent' AS type, 'high' AS severity, 'email' AS detail FROM f WHERE pii_detected AND NOT consent_given
  UNION ALL SELECT request_id, ts, 'unapproved_model', 'medium', concat(provider, '/', model) FROM f WHERE approval_status = 'pending'
  UNION ALL SELECT request_id, ts, 'content_policy_violation', 'high', 'hate' FROM f WHERE policy_violation
  UNION ALL SELECT request_id, ts, 'missing_human_oversight', 'high', 'limited' FROM f WHERE oversight_required AND NOT oversight_present)"""


def compliance_facts(t):
    # the as-of joins shuffle whole rows, so only what the rules read goes in
    q = t.ai_requests.select("request_id", "ts", "provider", "model", F.col("user_id").cast("string").alias("subject_id"))
    d = governance.model_approvals(governance.consent_as_of(q, t.consents, t.erasures), t.approvals)
    i = F.col("request_id")
    return d.withColumns({
        "pii_detected": i % 4 == 0, "pii_types": F.array(F.lit("email")), "policy_violation": i % 21 == 0, "violation_type": F.lit("hate"),
        "oversight_required": i % 6 == 0, "oversight_present": i % 12 == 0, "risk_category": F.lit("limited")})


@query("p8_compliance_violations", FACTS_SQL + "SELECT * FROM violations")
def _(t):
    return governance.compliance_violations(compliance_facts(t))


@query("p9_apply_erasure", CONSENT_SQL + """
SELECT 'kept' AS part, CAST(request_id AS STRING) AS id, subject_id FROM q WHERE subject_id NOT IN (SELECT subject_id FROM erasures) OR request_id % 10 = 0
UNION ALL SELECT 'audit', requester_id, substr(sha256(subject_id), 1, 16) FROM erasures""")
def _(t):
    q = t.ai_requests.withColumns({"subject_id": F.col("user_id").cast("string"), "legal_hold": F.col("request_id") % 10 == 0})
    kept, audit = governance.apply_erasure(q, t.erasures)
    return kept.select(F.lit("kept").alias("part"), F.col("request_id").cast("string").alias("id"), "subject_id").unionByName(
        audit.select(F.lit("audit").alias("part"), F.col("actor").alias("id"), F.col("resource_id").alias("subject_id")))


@query("p9_erase_stored", CONSENT_SQL + """
SELECT request_id, subject_id FROM q WHERE subject_id NOT IN (SELECT subject_id FROM erasures) OR request_id % 10 = 0""")
def _(t):
    """The same on stored facts: only the files that hold an erased subject are written again."""
    path = work_dir(t.spark, "subject_facts")
    q = t.ai_requests.withColumns({"subject_id": F.col("user_id").cast("string"), "legal_hold": F.col("request_id") % 10 == 0})
    erasure.write_subject_facts(q, path)
    erasure.erase_subjects(t.spark, path, t.erasures)
    return t.spark.read.parquet(path).select("request_id", "subject_id")


@query("p10_compliance_summary", FACTS_SQL + """
SELECT provider, count(*) AS total_events, count(*) FILTER (WHERE pii_detected) AS pii_detections, round(avg(CAST(pii_detected AS INT)), 6) AS pii_detection_rate,
  count(*) FILTER (WHERE policy_violation) AS policy_violations, round(avg(CAST(policy_violation AS INT)), 6) AS violation_rate,
  count(DISTINCT CASE WHEN approval_status = 'approved' THEN model END) AS approved_models, count(DISTINCT CASE WHEN consent_given THEN subject_id END) AS consents,
  (SELECT count(*) FROM violations v JOIN f g USING (request_id) WHERE g.provider = f.provider) AS open_violations FROM f GROUP BY provider""")
def _(t):
    d = governance.compliance_summary(compliance_facts(t), ["provider"])
    return d.withColumns({"pii_detection_rate": F.round("pii_detection_rate", 6), "violation_rate": F.round("violation_rate", 6)})


AUDIT = """SELECT event_id, ts, CASE WHEN event_type = 'view' THEN 'read' WHEN event_type = 'purchase' THEN 'update' ELSE 'execute' END AS action,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE NULL END AS outcome, CASE WHEN user_id % 4 = 0 THEN 'service' ELSE NULL END AS actor_type,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('u', CAST(user_id AS STRING), '@example.org') END AS email,
  CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('10.0.0.', CAST(user_id AS STRING)) END AS address FROM events"""


def audit_rows(t):
    return governance.audit_trail(t.spark.sql(AUDIT.replace("FROM events", "FROM {e}"), e=t.events))


@query("p11_audit_trail", f"""WITH a AS ({AUDIT}) SELECT event_id, action, coalesce(outcome, 'success') AS outcome, coalesce(actor_type, 'user') AS actor_type,
  substr(sha256(coalesce(email, '')), 1, 16) AS email_hash, CASE WHEN address <> '' THEN substr(sha256(address), 1, 16) ELSE '' END AS address_hash FROM a""")
def _(t):
    return audit_rows(t).select("event_id", "action", "outcome", "actor_type", "email_hash", "address_hash")


@query("p11_audit_counts", f"WITH a AS ({AUDIT}) SELECT action, coalesce(outcome, 'success') AS outcome, count(*) AS events FROM a GROUP BY 1, 2")
def _(t):
    return governance.audit_counts(audit_rows(t))


@query("p12_consent_register", with_fixtures("consents") + """
SELECT subject_id, max_by(given, ts) AS given, max(ts) AS since, substr(sha256(subject_id), 1, 16) AS subject_hash,
  count(*) FILTER (WHERE given) AS updates, count(*) FILTER (WHERE NOT given) AS deletes FROM consents GROUP BY subject_id""")
def _(t):
    ev = governance.consent_events(t.consents).groupBy("subject_id", "subject_hash").agg(
        F.count_if(F.col("action") == "update").alias("updates"), F.count_if(F.col("action") == "delete").alias("deletes"))
    return governance.consent_register(t.consents).join(ev, "subject_id").select("subject_id", "given", "since", "subject_hash", "updates", "deletes")


# --- search

AS_OF = "2024-01-20 12:00:00"


@query("q1_time_filter", f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR")
def _(t):
    return search.time_filter(t.events, "24h", AS_OF).select("event_id", "ts")


@query("q2_search", "SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 100")
def _(t):
    return search.search(t.events, F.col("event_type") == "error", 100, [F.desc("value"), "event_id"]).select("event_id", "value")


@query("q3_date_histogram", """WITH w(span, width) AS (VALUES ('6h', 300), ('24h', 3600), ('30h', 21600), ('7d', 21600), ('30d', 86400), ('60d', 604800), ('2w', 3600))
SELECT span, make_timestamp(CAST(floor(epoch(ts) / width) * width * 1000000 AS BIGINT)) AS bucket, count(*) AS rows FROM events CROSS JOIN w GROUP BY 1, 2""")
def _(t):
    out = None
    for span in ("6h", "24h", "30h", "7d", "30d", "60d", "2w"):
        d = search.date_histogram(t.events, span).withColumn("span", F.lit(span))
        out = d if out is None else out.unionByName(d)
    return out


@query("q3_date_histogram_filled", """WITH s AS (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS bucket FROM events WHERE event_type = 'signup')
SELECT s.bucket, count(e.event_id) AS rows FROM s LEFT JOIN events e ON date_trunc('hour', e.ts) = s.bucket AND e.event_type = 'signup' GROUP BY 1""")
def _(t):
    return search.date_histogram(t.events.where("event_type = 'signup'"), "24h", fill=True)


@query("q4_terms", "SELECT CAST(user_id AS STRING) AS value, count(*) AS rows FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(t):
    return search.terms(t.events, "user_id")


@query("q5_metrics_summary", REQ_SQL + f""", d AS (SELECT * FROM ai_requests WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)
SELECT 'total' AS block, '' AS key, count(*) AS rows FROM d UNION ALL
SELECT 'histogram', strftime(make_timestamp(CAST(floor(epoch(ts) / 21600) * 21600 * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S'), count(*) FROM d GROUP BY 2 UNION ALL
SELECT 'by_model', model, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'by_team', team, count(*) FROM d WHERE team IS NOT NULL GROUP BY 2""")
def _(t):
    return search.metrics_summary(t.ai_requests, "7d", AS_OF, ["model", "team"])


@query("q6_count_documents", "SELECT count(*) FILTER (WHERE event_type = 'error') AS errors FROM events")
def _(t):
    return search.count_documents(t.events, F.col("event_type") == "error", "errors")


@query("q7_aggregate_query", """SELECT event_type, date_trunc('day', ts) AS day, round(avg(value), 6) AS mean, max(value) AS top, count(DISTINCT user_id) AS users FROM events WHERE value > 5 GROUP BY 1, 2""")
def _(t):
    return search.aggregate_query(
        t.events, {"mean": F.round(F.avg("value"), 6), "top": F.max("value"), "users": F.countDistinct("user_id")},
        ["event_type", F.date_trunc("day", "ts").alias("day")], F.col("value") > 5)


PANEL = """SELECT concat('n', CAST(user_id % 5 AS STRING)) AS series, ts AS t, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events"""


@query("q8_reduce_series", f"""WITH p AS ({PANEL}) SELECT series, arg_max(value, t) FILTER (WHERE value IS NOT NULL) AS last_not_null, arg_max_null(value, t) AS last, round(avg(value), 6) AS mean, max(value) AS max, min(value) AS min,
  round(quantile_cont(value, 0.95), 6) AS p95 FROM p GROUP BY series""")
def _(t):
    d = search.reduce_series(t.spark.sql(PANEL.replace("FROM events", "FROM {e}"), e=t.events), ["series"])
    return d.withColumns({"mean": F.round("mean", 6), "p95": F.round("p95", 6)})


@query("q9_monitoring_summary", COSTS_SQL + f""", l AS (SELECT {q_requests.P95} AS p95, 100.0 * count(*) FILTER (WHERE status <> 'success') / count(*) AS e, count(*) AS n FROM costs),
c AS (SELECT sum(total_cost) AS total, sum(business_value) / sum(total_cost) AS roi FROM costs), ch AS (SELECT status FROM ({CHECKS} SELECT status, event_id FROM health_checks) z ORDER BY event_id DESC LIMIT 1)
SELECT p95, round(e, 6) AS error_rate, n AS requests, round(total, 9) AS total_cost, round(roi, 6) AS roi_ratio, ch.status AS health, (SELECT count(*) FROM costs WHERE status_code = 500) AS rejects,
  (SELECT count(*) FROM conversations WHERE role = 'assistant') AS responses FROM l, c, ch""")
def _(t):
    costs = q_requests.costs(t)
    checks = t.health_checks
    d = search.monitoring_summary({
        "technical": requests.service_levels(t.ai_requests, ()),
        "finops": cost.roi_summary(costs),
        "devops": checks.agg(F.max_by("status", F.struct("ts", "event_id")).alias("health")),
        "cognitive": search.count_documents(t.conversations, F.col("role") == "assistant", "responses"),
        "rejects": search.count_documents(costs, F.col("status_code") == 500, "rejects"),
    })
    return d.select(
        "technical.p95", F.round("technical.error_rate", 6).alias("error_rate"), "technical.requests", F.round("finops.total_cost", 9).alias("total_cost"),
        F.round("finops.roi_ratio", 6).alias("roi_ratio"), "devops.health", "rejects.rejects", "cognitive.responses")


@query("q9_full_report", f"""WITH c AS (SELECT sum(total_analyzed) AS n, sum(total_analyzed * avg_quality_score) / sum(total_analyzed) AS q, sum(total_analyzed * toxicity_rate) / sum(total_analyzed) AS x FROM ({ORACLES["c14_cognitive_summary"]}) c14),
s AS (SELECT max(total) AS total, count(*) AS periods FROM ({ORACLES["f13_cost_summary"]}) f13), o AS (SELECT count(*) AS recommendations FROM ({ORACLES["f14_optimization_recommendations"]}) f14),
b AS (SELECT count(*) AS budget_alerts FROM ({ORACLES["f15_budget_alerts"]}) f15), d AS ({ORACLES["d7_system_status"]}),
p AS (SELECT CAST(sum(total_events) AS BIGINT) AS events, CAST(sum(pii_detections) AS BIGINT) AS pii, CAST(sum(open_violations) AS BIGINT) AS open FROM ({ORACLES["p10_compliance_summary"]}) p10), t AS ({ORACLES["t2_latency_percentiles_overall"]})
SELECT t.p95, CAST(c.n AS BIGINT) AS analyzed, round(c.q, 3) AS quality, round(c.x, 3) AS toxicity_rate, round(s.total, 6) AS largest_spend, s.periods, o.recommendations, b.budget_alerts, d.health, d.uptime_percentage, d.active_incidents,
  p.events, p.pii AS pii_detections, p.open AS open_violations FROM t, c, s, o, b, d, p""")
def _(t):
    """All parts of the report: technical, cognitive, finops with its alerts and advice, devops, compliance."""
    costs = q_requests.costs(t)
    d = search.monitoring_summary({
        "technical": requests.service_levels(t.ai_requests, ()),
        "cognitive": cognitive.cognitive_summary(cognitive.cognitive_facts(q_text.pairs(t))),
        "finops": cost.cost_summary(costs, q_requests.AS_OF).agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("periods")),
        "advice": cost.optimization_recommendations(costs).agg(F.count(F.lit(1)).alias("recommendations")),
        "budget": cost.budget_alerts(costs, 10.0).agg(F.count(F.lit(1)).alias("budget_alerts")),
        "devops": health.system_status(t.health_checks, t.deployments, t.incidents, t.breakers, t.app_logs),
        "compliance": governance.compliance_summary(compliance_facts(t)),
    })
    return d.select(
        "technical.p95", F.col("cognitive.total_analyzed").alias("analyzed"), F.round("cognitive.avg_quality_score", 3).alias("quality"), F.round("cognitive.toxicity_rate", 3).alias("toxicity_rate"),
        F.round(F.col("finops.total").cast("double"), 6).alias("largest_spend"), "finops.periods", "advice.recommendations", "budget.budget_alerts", "devops.health",
        F.round("devops.uptime_percentage", 6).alias("uptime_percentage"), "devops.active_incidents",
        F.col("compliance.total_events").alias("events"), "compliance.pii_detections", "compliance.open_violations")


# --- fleet

NODES, INDICES, SNAPS = with_fixtures("nodes"), with_fixtures("indices"), with_fixtures("snapshots")


@query("u1_reconcile_counts", """WITH b AS (SELECT l_suppkey AS name, count(*) AS rows_before FROM lineitem GROUP BY 1), a AS (SELECT l_suppkey AS name, count(*) AS rows_after FROM lineitem WHERE l_orderkey % 97 <> 0 GROUP BY 1)
SELECT name, rows_before, rows_after, rows_before - rows_after AS difference FROM b JOIN a USING (name) WHERE rows_after < rows_before""")
def _(t):
    return reconcile.reconcile_counts(
        reconcile.capture_counts(t.lineitem, "l_suppkey"), reconcile.capture_counts(t.lineitem.where("l_orderkey % 97 <> 0"), "l_suppkey"))


@query("u2_version_consistency", NODES + """
SELECT cluster, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions, count(*) AS nodes, count(*) FILTER (WHERE version <> '8.17.0') AS off_target,
  CASE WHEN count(DISTINCT version) > 1 THEN 'failed' ELSE 'passed' END AS status FROM nodes GROUP BY cluster""")
def _(t):
    return reconcile.version_consistency(t.nodes, "8.17.0").withColumn("versions", F.array_join("versions", ","))


@query("u2_nodes_off_target", NODES + "SELECT cluster, name, version FROM nodes WHERE version <> '8.17.0'")
def _(t):
    return reconcile.nodes_off_target(t.nodes, "8.17.0")


@query("u3_role_counts", NODES + """, c AS (SELECT cluster, count(*) FILTER (WHERE roles = 'master,data') AS m FROM nodes GROUP BY cluster)
SELECT cluster, m AS masters, m AS data_nodes, CASE WHEN m < 3 THEN 'warning' ELSE 'passed' END AS master_status, CASE WHEN m < 2 THEN 'warning' ELSE 'passed' END AS data_status FROM c""")
def _(t):
    return reconcile.role_counts(t.nodes)


@query("u4_resource_pressure", NODES + """, f AS (SELECT *, disk_available / disk_total * 100 AS free FROM nodes)
SELECT cluster, name, free < 20 AS low_disk, heap_used_percent > 85 AS high_heap, round(free, 2) AS free_percent, round(disk_available / 1073741824.0, 2) AS available_gb, heap_used_percent FROM f WHERE free < 20 OR heap_used_percent > 85""")
def _(t):
    return reconcile.resource_pressure(t.nodes).drop("total_gb")


@query("u4_resource_checks", NODES + """, c AS (SELECT cluster, count(*) FILTER (WHERE disk_available / disk_total * 100 < 20) AS low_disk, count(*) FILTER (WHERE heap_used_percent > 85) AS high_heap FROM nodes GROUP BY 1)
SELECT *, CASE WHEN low_disk > 0 THEN 'warning' ELSE 'passed' END AS disk_status, CASE WHEN high_heap > 0 THEN 'warning' ELSE 'passed' END AS heap_status FROM c""")
def _(t):
    return reconcile.resource_checks(t.nodes)


SHARDS = "SELECT c_custkey AS cluster, CAST(c_custkey % 3 AS INT) AS relocating_shards, CAST(c_custkey % 5 AS INT) AS initializing_shards, CAST(c_custkey % 13 AS INT) AS unassigned_shards FROM customer"


@query("u5_shard_state", f"""WITH h AS ({SHARDS}) SELECT *, CASE WHEN relocating_shards > 0 OR initializing_shards > 0 THEN 'warning' ELSE 'passed' END AS moving_status,
  CASE WHEN unassigned_shards >= 10 THEN 'failed' WHEN unassigned_shards > 0 THEN 'warning' ELSE 'passed' END AS unassigned_status FROM h""")
def _(t):
    return reconcile.shard_state(t.spark.sql(SHARDS.replace("FROM customer", "FROM {c}"), c=t.customer))


@query("u6_index_health_rollup", INDICES + """, c AS (SELECT cluster, count(*) AS total, count(*) FILTER (WHERE health = 'red') AS red, count(*) FILTER (WHERE health = 'yellow') AS yellow, count(*) FILTER (WHERE status = 'close') AS closed FROM indices GROUP BY 1)
SELECT *, total - red - yellow AS green, CASE WHEN red > 0 THEN 'failed' WHEN yellow > 0 OR closed > 0 THEN 'warning' ELSE 'passed' END AS status FROM c""")
def _(t):
    return reconcile.index_health_rollup(t.indices)


@query("u7_index_compatibility", INDICES + """
SELECT cluster, index_name, NOT (contains(mapping, '_type') OR created_version = '6.8.0') AS compatible,
  concat_ws('|', CASE WHEN contains(mapping, '_type') THEN 'Index uses deprecated _type field' END, CASE WHEN created_version = '6.8.0' THEN 'Index was created in version 6.8.0 - may need reindexing' END) AS issues,
  CASE WHEN contains(mapping, '_all') THEN 'Index uses _all field which is deprecated' ELSE '' END AS warnings FROM indices WHERE index_name NOT LIKE '.%'""")
def _(t):
    d = reconcile.index_compatibility(t.indices, "8.17.0")
    return d.select("cluster", "index_name", "compatible", F.array_join("issues", "|").alias("issues"), F.array_join("warnings", "|").alias("warnings"))


DEPRECATIONS = """SELECT CAST(c_nationkey AS BIGINT) AS cluster, CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'cluster' WHEN 1 THEN 'node' ELSE 'index' END AS scope,
  CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 7 = 0 THEN 'critical' ELSE 'warning' END AS level, concat('setting ', CAST(c_custkey AS STRING)) AS message FROM customer"""


@query("u8_deprecation_rollup", f"""WITH d AS ({DEPRECATIONS}), c AS (SELECT cluster, count(*) AS total, count(*) FILTER (WHERE scope <> 'index' AND level = 'critical') AS critical, count(*) FILTER (WHERE scope <> 'index' AND level <> 'critical') AS warnings FROM d GROUP BY 1)
SELECT *, CASE WHEN critical > 0 THEN 'failed' ELSE 'warning' END AS status FROM c""")
def _(t):
    return reconcile.deprecation_rollup(t.spark.sql(DEPRECATIONS.replace("FROM customer", "FROM {c}"), c=t.customer))


@query("u8_first_deprecations", f"""WITH d AS ({DEPRECATIONS}), x AS (SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY message) AS INT) AS rank, message FROM d WHERE scope <> 'index' AND level <> 'critical')
SELECT * FROM x WHERE rank <= 10""")
def _(t):
    return reconcile.first_deprecations(t.spark.sql(DEPRECATIONS.replace("FROM customer", "FROM {c}"), c=t.customer))


@query("u9_plugin_inventory", NODES + """, p AS (SELECT cluster, unnest(string_split(plugins, ',')) AS plugin FROM nodes) SELECT cluster, plugin, count(*) AS nodes FROM p WHERE plugin <> '' GROUP BY 1, 2""")
def _(t):
    return reconcile.plugin_inventory(t.nodes)


@query("u10_snapshot_freshness", SNAPS + """, g AS (SELECT repository, arg_max(snapshot, (end_time, snapshot)) FILTER (WHERE state = 'SUCCESS') AS snapshot, max(end_time) FILTER (WHERE state = 'SUCCESS') AS end_time FROM snapshots GROUP BY 1)
SELECT repository, snapshot, end_time, CASE WHEN snapshot IS NOT NULL THEN 90.0::DOUBLE END AS duration_seconds,
  CASE WHEN snapshot IS NULL OR end_time < TIMESTAMP '1998-08-03 00:00:00' - INTERVAL 24 HOUR THEN 'warning' ELSE 'passed' END AS status FROM g""")
def _(t):
    return reconcile.snapshot_freshness(t.snapshots, "1998-08-03 00:00:00")


@query("u11_size_estimate", INDICES + """SELECT cluster, count(*) AS indices, CAST(sum(store_size) AS BIGINT) AS total_bytes, CAST(sum(pri_store_size) AS BIGINT) AS primary_bytes,
  round(sum(store_size) / 1073741824.0, 2) AS total_gb, round(sum(pri_store_size) / 1073741824.0, 2) AS primary_gb, CAST(sum(pri_store_size) AS BIGINT) AS backup_bytes FROM indices GROUP BY cluster""")
def _(t):
    return reconcile.size_estimate(t.indices)


@query("u12_nodes_joined", NODES + """, b AS (SELECT cluster, count(*) AS expected FROM nodes GROUP BY 1), a AS (SELECT cluster, count(*) AS current FROM nodes WHERE node_id % 5 <> 0 GROUP BY 1)
SELECT cluster, expected, coalesce(current, 0) AS current, CASE WHEN coalesce(current, 0) < expected THEN 'failed' ELSE 'passed' END AS status FROM b LEFT JOIN a USING (cluster)""")
def _(t):
    return reconcile.nodes_joined(t.nodes, t.nodes.where("node_id % 5 <> 0"))


def fleet_checks(t):
    def rows(df, check, status):
        return df.select(F.col("cluster").cast("bigint").alias("cluster"), F.lit(check).alias("check"), F.col(status).alias("status"),
                         F.when(F.col(status) != "passed", F.array(F.lit("review before the upgrade"), F.concat(F.lit("look at "), F.lit(check)))).alias("recommendations"))
    roles, res = reconcile.role_counts(t.nodes), reconcile.resource_checks(t.nodes)
    return (
        rows(reconcile.version_consistency(t.nodes), "versions", "status").unionByName(rows(roles, "masters", "master_status"))
        .unionByName(rows(res, "disk", "disk_status")).unionByName(rows(reconcile.index_health_rollup(t.indices), "indices", "status")))


CHECKS_SQL = with_fixtures("nodes", "indices") + """, ch AS (
  SELECT CAST(cluster AS BIGINT) AS cluster, 'versions' AS c, CASE WHEN count(DISTINCT version) > 1 THEN 'failed' ELSE 'passed' END AS status FROM nodes GROUP BY 1
  UNION ALL SELECT cluster, 'masters', CASE WHEN count(*) FILTER (WHERE roles = 'master,data') < 3 THEN 'warning' ELSE 'passed' END FROM nodes GROUP BY 1
  UNION ALL SELECT cluster, 'disk', CASE WHEN count(*) FILTER (WHERE disk_available / disk_total * 100 < 20) > 0 THEN 'warning' ELSE 'passed' END FROM nodes GROUP BY 1
  UNION ALL SELECT cluster, 'indices', CASE WHEN count(*) FILTER (WHERE health = 'red') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE health = 'yellow' OR status = 'close') > 0 THEN 'warning' ELSE 'passed' END FROM indices GROUP BY 1)"""


@query("u13_readiness", CHECKS_SQL + """
SELECT cluster, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'warning') AS warning, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(0 AS BIGINT) AS error, CAST(0 AS BIGINT) AS skipped,
  count(*) FILTER (WHERE status = 'failed') = 0 AS ready FROM ch GROUP BY cluster""")
def _(t):
    return reconcile.readiness(fleet_checks(t))


@query("u13_blockers", CHECKS_SQL + """SELECT cluster, c AS "check", status FROM ch WHERE status IN ('failed', 'error')""")
def _(t):
    return reconcile.blockers(fleet_checks(t)).select("cluster", "check", "status")


@query("u13_recommendations", CHECKS_SQL + """SELECT cluster, concat('look at ', c) AS recommendation FROM ch WHERE status <> 'passed' UNION SELECT cluster, 'review before the upgrade' FROM ch WHERE status <> 'passed'""")
def _(t):
    return reconcile.recommendations(fleet_checks(t))
