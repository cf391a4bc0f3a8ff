"""Input views over the given tables, in SQL that both Spark and the checking database run."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession


AI_REQUESTS = """
SELECT event_id AS request_id, ts, user_id,
  CASE WHEN user_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider,
  CASE WHEN user_id % 2 = 0
       THEN CASE event_id % 4 WHEN 0 THEN 'gpt-4' WHEN 1 THEN 'gpt-4-turbo' WHEN 2 THEN 'gpt-3.5-turbo' ELSE 'unlisted' END
       ELSE CASE event_id % 3 WHEN 0 THEN 'claude-3-opus' WHEN 1 THEN 'claude-3-sonnet' ELSE 'claude-3-haiku' END
  END AS model,
  CAST(10 + (event_id * 37) % 491 AS INT) AS input_tokens,
  CAST(50 + (event_id * 101) % 1951 AS INT) AS output_tokens,
  CAST(CASE WHEN event_id % 10 = 0 THEN 10 + (event_id * 37) % 200 ELSE 0 END AS INT) AS cached_tokens,
  CAST(round(value * 20, 2) AS DOUBLE) AS latency_ms,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('team-', CAST(user_id % 4 AS STRING)) END AS team,
  concat('proj-', CAST(user_id % 6 AS STRING)) AS project,
  event_id % 10 = 0 AS cache_hit,
  event_id % 3 = 0 AS prompt_compressed,
  event_id % 20 = 0 AS batch_used,
  CASE WHEN event_id % 15 = 0 THEN 0.001 ELSE 0.0 END AS fallback_savings,
  CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS business_value,
  event_type = 'purchase' AS conversion
FROM events
"""

# The priced models.
PRICE_RATES = """
SELECT * FROM (VALUES
  ('openai', 'gpt-4', 0.03, 0.06, true),
  ('openai', 'gpt-4-turbo', 0.01, 0.03, true),
  ('openai', 'gpt-3.5-turbo', 0.0005, 0.0015, true),
  ('anthropic', 'claude-3-opus', 0.015, 0.075, true),
  ('anthropic', 'claude-3-sonnet', 0.003, 0.015, true),
  ('anthropic', 'claude-3-haiku', 0.00025, 0.00125, true)
) AS r(provider, model, input_per_1k, output_per_1k, enabled)
"""

TURN_PAIRS = """
SELECT conv_id, turn, conv_id * 1000 + turn AS request_id, text AS prompt, next_text AS response
FROM (SELECT conv_id, turn, role, text,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
      FROM conversations) x
WHERE role = 'user' AND next_role = 'assistant'
"""

APP_LOGS = """
SELECT event_id, ts, concat('trace-', CAST(event_id % 977 AS STRING)) AS trace_id,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('span-', CAST(event_id AS STRING)) END AS span_id,
  CASE event_type WHEN 'error' THEN 'ERR' WHEN 'view' THEN 'info' WHEN 'click' THEN 'Warning'
       WHEN 'signup' THEN 'notice' ELSE 'crit' END AS raw_level,
  CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'api-gateway' WHEN 1 THEN 'order-service' WHEN 2 THEN 'payment-service'
       WHEN 3 THEN 'search-service' ELSE 'unknown-service' END AS service_name,
  CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'dc-us-east-1' WHEN 1 THEN 'dc-us-west-2' WHEN 2 THEN 'dc-eu-west-1' ELSE NULL END AS datacenter,
  CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'production' WHEN 1 THEN 'staging' ELSE 'development' END AS environment,
  CASE WHEN event_type = 'error' THEN 503 WHEN event_id % 6 = 0 THEN 404 ELSE 200 END AS status_code,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value * 10) AS INT) END AS latency_ms,
  CASE WHEN event_id % 20 = 0 THEN 'health check' WHEN event_id % 20 = 1 THEN 'Health check passed'
       WHEN event_id % 20 = 2 THEN 'shipping done' ELSE concat('GET /', event_type) END AS message,
  concat('10.', CAST(user_id % 8 AS STRING), '.', CAST(event_id % 256 AS STRING), '.7') AS client_ip,
  CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'application' WHEN 1 THEN 'access' ELSE 'metric' END AS log_type,
  CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36'
       WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 14_0 like Mac OS X)' WHEN 2 THEN 'Mozilla/5.0 (Linux; Android 11; SM-G991B)'
       WHEN 3 THEN 'curl/7.68.0' ELSE 'something else' END AS user_agent,
  CAST(event_id % 101 AS DOUBLE) AS cpu, CAST(30 + event_id % 66 AS DOUBLE) AS mem
FROM events
"""

NETWORKS = """
SELECT * FROM (VALUES
  (CAST(167772160 AS BIGINT), CAST(167837695 AS BIGINT), 'Ashburn', 'United States', 'US', 'NA', 'Virginia', 39.04, -77.49),
  (CAST(167837696 AS BIGINT), CAST(167903231 AS BIGINT), 'Boardman', 'United States', 'US', 'NA', 'Oregon', 45.84, -119.7),
  (CAST(167903232 AS BIGINT), CAST(167968767 AS BIGINT), 'Dublin', 'Ireland', 'IE', 'EU', 'Leinster', 53.35, -6.26),
  (CAST(167968768 AS BIGINT), CAST(168034303 AS BIGINT), 'Mumbai', 'India', 'IN', 'AS', 'Maharashtra', 19.08, 72.88),
  (CAST(168034304 AS BIGINT), CAST(168099839 AS BIGINT), 'Sydney', 'Australia', 'AU', 'OC', 'New South Wales', -33.87, 151.21),
  (CAST(168099840 AS BIGINT), CAST(168165375 AS BIGINT), 'Osasco', 'Brazil', 'BR', 'SA', 'Sao Paulo', -23.53, -46.79),
  (CAST(167772160 AS BIGINT), CAST(184549375 AS BIGINT), 'Anywhere', 'Nowhere', 'XX', 'XX', 'All of it', 0.0, 0.0),
  (CAST(167772160 AS BIGINT), CAST(167804927 AS BIGINT), 'Reston', 'United States', 'US', 'NA', 'Virginia', 38.95, -77.34),
  (CAST(167804928 AS BIGINT), CAST(167813119 AS BIGINT), 'Herndon', 'United States', 'US', 'NA', 'Virginia', 38.97, -77.38),
  (CAST(167903300 AS BIGINT), CAST(167920000 AS BIGINT), 'Cork', 'Ireland', 'IE', 'EU', 'Munster', 51.89, -8.47)
) AS n(start_ip, end_ip, city_name, country_name, country_code2, continent_code, region_name, lat, lon)
"""

SAMPLES = """
SELECT ts, 'requests_total' AS metric, event_type AS job, concat('n', CAST(user_id % 3 AS STRING)) AS instance,
  CAST(event_id % 100 AS DOUBLE) AS value
FROM events
UNION ALL
SELECT ts, 'disk_free_bytes', event_type, concat('n', CAST(user_id % 3 AS STRING)),
  CAST(1000000 - event_id * 50 AS DOUBLE) FROM events
UNION ALL
SELECT ts, 'probe_success', event_type, concat('n', CAST(user_id % 3 AS STRING)),
  CAST(CASE WHEN event_id % 13 < 2 THEN 0 ELSE 1 END AS DOUBLE) FROM events
"""

HEALTH_CHECKS = """
SELECT event_id, ts, concat('svc-', CAST(user_id % 10 AS STRING)) AS service,
  CASE event_type WHEN 'error' THEN 'unhealthy' WHEN 'signup' THEN 'degraded' ELSE 'healthy' END AS status,
  value AS response_time_ms
FROM events
"""

INCIDENTS = """
SELECT event_id, ts, CAST(floor(event_id / 7) AS BIGINT) AS incident_id,
  CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'detected' WHEN 1 THEN 'investigating' WHEN 2 THEN 'identified'
       WHEN 6 THEN 'resolved' ELSE 'mitigating' END AS status,
  CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity
FROM events
"""

DEPLOYMENTS = """
SELECT event_id, ts, CAST(floor(event_id / 5) AS BIGINT) AS deployment_id,
  concat('v', CAST(event_id % 13 AS STRING)) AS version,
  CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'rolling' WHEN 1 THEN 'canary' ELSE 'blue_green' END AS strategy,
  CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'pending' WHEN 4 THEN
       CASE WHEN CAST(floor(event_id / 5) AS BIGINT) % 4 = 0 THEN 'failed' ELSE 'completed' END
       ELSE 'in_progress' END AS status,
  CAST(event_id % 101 AS DOUBLE) AS canary_percentage
FROM events
"""

BREAKERS = """
SELECT event_id, ts, concat('breaker-', CAST(user_id % 6 AS STRING)) AS name,
  CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'closed' WHEN 1 THEN 'open' ELSE 'half_open' END AS state,
  CAST(event_id % 9 AS INT) AS failure_count,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(30 + event_id % 4 AS INT) END AS reset_timeout
FROM events
"""

SCALING = """
SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'scale_down' ELSE 'scale_up' END AS event_type,
  CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'cpu' WHEN 1 THEN 'latency' ELSE 'manual' END AS scale_trigger,
  CAST(2 + event_id % 9 AS INT) AS replicas_before, CAST(2 + (event_id * 7) % 11 AS INT) AS replicas_after,
  CASE WHEN event_id % 5 = 0 THEN CAST(1 AS INT) ELSE NULL END AS min_replicas,
  CAST(NULL AS INT) AS max_replicas
FROM events
"""

CONSENTS = """
SELECT event_id, ts, CAST(user_id AS STRING) AS subject_id, event_id % 3 <> 0 AS given
FROM events WHERE event_type = 'signup'
"""

ERASURES = """
SELECT event_id, ts, CAST(user_id AS STRING) AS subject_id, concat('req-', CAST(event_id % 5 AS STRING)) AS requester_id
FROM events WHERE event_type = 'view' AND event_id % 50 = 0
"""

APPROVALS = """
SELECT provider, model, CAST(approved_at AS TIMESTAMP) AS ts, approved_by, risk_level, use_case FROM (VALUES
  ('openai', 'gpt-4', '2024-01-05 00:00:00', 'ana', 'limited', 'chat'),
  ('openai', 'gpt-4', '2024-01-15 00:00:00', 'bo', 'high', 'chat'),
  ('openai', 'gpt-4-turbo', '2024-01-05 00:00:00', 'ana', 'minimal', 'search'),
  ('openai', 'gpt-4-turbo', '2024-01-15 00:00:00', 'cy', 'limited', 'search'),
  ('openai', 'gpt-3.5-turbo', '2024-01-05 00:00:00', 'bo', 'minimal', 'batch'),
  ('openai', 'gpt-3.5-turbo', '2024-01-15 00:00:00', 'bo', 'limited', 'batch'),
  ('anthropic', 'claude-3-opus', '2024-01-05 00:00:00', 'cy', 'limited', 'chat'),
  ('anthropic', 'claude-3-opus', '2024-01-15 00:00:00', 'ana', 'high', 'chat'),
  ('anthropic', 'claude-3-sonnet', '2024-01-05 00:00:00', 'ana', 'limited', 'code'),
  ('anthropic', 'claude-3-sonnet', '2024-01-15 00:00:00', 'bo', 'limited', 'code')
) AS a(provider, model, approved_at, approved_by, risk_level, use_case)
"""

FEEDBACK = """
SELECT p.request_id, v.version, CAST(p.request_id % 5 + 1 AS INT) - CASE WHEN v.version = 1 AND p.request_id % 5 > 0 THEN 1 ELSE 0 END AS rating,
  p.request_id % 2 = 0 AS thumbs_up, concat('note-', CAST(v.version AS STRING)) AS feedback_text
FROM turn_pairs p CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) AS v(version)
WHERE p.request_id % 3 = 0
"""

NODES = """
SELECT s_nationkey AS cluster, s_name AS name, s_suppkey AS node_id,
  CASE WHEN s_suppkey % 9 = 0 THEN '8.17.0' ELSE '8.11.0' END AS version,
  CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'master,data' WHEN 1 THEN 'data_hot,ingest' ELSE 'ingest' END AS roles,
  CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'analysis-icu,repository-s3' WHEN 1 THEN 'analysis-icu' ELSE '' END AS plugins,
  CAST(1000000000000 AS BIGINT) AS disk_total,
  CAST(10000000000 * (s_suppkey % 50) AS BIGINT) AS disk_available,
  CAST(s_suppkey % 100 AS INT) AS heap_used_percent
FROM supplier
"""

INDICES = """
SELECT CAST(p_partkey % 25 AS BIGINT) AS cluster,
  CASE WHEN p_partkey % 10 = 0 THEN concat('.sys-', CAST(p_partkey AS STRING)) ELSE concat('logs-', CAST(p_partkey AS STRING)) END AS index_name,
  CASE CAST(p_size % 10 AS INT) WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' WHEN 2 THEN 'yellow' ELSE 'green' END AS health,
  CASE WHEN p_size % 17 = 0 THEN 'close' ELSE 'open' END AS status,
  CAST(p_partkey * 10 AS BIGINT) AS docs_count,
  CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '7.17.0' WHEN 1 THEN '8.1.0' ELSE '6.8.0' END AS created_version,
  CASE CAST(p_partkey % 14 AS INT) WHEN 0 THEN '{"_type":"doc"}' WHEN 1 THEN '{"_all":true}' ELSE '{}' END AS mapping,
  CAST(p_partkey * 1000000 AS BIGINT) AS pri_store_size,
  CAST(p_partkey * 2000000 AS BIGINT) AS store_size
FROM part
"""

SNAPSHOTS = """
SELECT concat('repo-', CAST(o_custkey % 5 AS STRING)) AS repository, concat('snap-', CAST(o_orderkey AS STRING)) AS snapshot,
  CASE WHEN o_orderstatus <> 'P' THEN 'SUCCESS' ELSE 'PARTIAL' END AS state, o_orderkey,
  o_orderdate AS start_time, o_orderdate + INTERVAL 90 SECOND AS end_time
FROM orders
"""

BY_NAME = {
    "ai_requests": (AI_REQUESTS, ("events",)),
    "price_rates": (PRICE_RATES, ()),
    "turn_pairs": (TURN_PAIRS, ("conversations",)),
    "app_logs": (APP_LOGS, ("events",)),
    "networks": (NETWORKS, ()),
    "samples": (SAMPLES, ("events",)),
    "health_checks": (HEALTH_CHECKS, ("events",)),
    "incidents": (INCIDENTS, ("events",)),
    "deployments": (DEPLOYMENTS, ("events",)),
    "breakers": (BREAKERS, ("events",)),
    "scaling": (SCALING, ("events",)),
    "consents": (CONSENTS, ("events",)),
    "erasures": (ERASURES, ("events",)),
    "approvals": (APPROVALS, ()),
    "feedback": (FEEDBACK, ("turn_pairs",)),
    "nodes": (NODES, ("supplier",)),
    "indices": (INDICES, ("part",)),
    "snapshots": (SNAPSHOTS, ("orders",)),
}
RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
       "embeddings", "pages", "benchmark", "labels", "conversations")


def add_fixture(name: str, sql: str, *inputs: str) -> None:
    BY_NAME[name] = (sql, inputs)


def with_fixtures(*names: str) -> str:
    """The fixtures as a WITH clause, inputs first, for the checking database."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in RAW or name in order:
            return
        for needed in BY_NAME[name][1]:
            visit(needed)
        order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({BY_NAME[n][0].strip()})" for n in order)


class Tables:
    """The given tables and the fixture views as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in RAW:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                self._made[name] = df
            elif name in BY_NAME:
                sql, inputs = BY_NAME[name]
                frames = {f"in_{i}": getattr(self, i) for i in inputs}
                text = sql.replace("{", "{{").replace("}", "}}")
                for i in inputs:
                    text = text.replace(f"FROM {i}", f"FROM {{in_{i}}}")
                self._made[name] = self.spark.sql(text, **frames)
            else:
                raise AttributeError(name)
        return self._made[name]
