"""Registered queries of M."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import samples as m
from tidewatch.plans.fixtures import with_fixtures
from tidewatch.plans.registry import query

STEP = 3600
H6, H24 = 6 * 3600, 24 * 3600
SQL = with_fixtures("samples")


def series(t, *metrics):
    return m.as_samples(t.samples.where(F.col("metric").isin(*metrics)))


def flat(v, places=6, extra=()):
    lab = F.col("labels")
    return v.select("t", lab["job"].alias("job"), lab["instance"].alias("instance"), F.round("value", places).alias("value"), *extra)


def grid_sql(metric, seconds):
    """Every pair of a grid point and a sample that its range holds, with the sample before it."""
    return SQL + f""", s AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pts FROM samples WHERE metric = '{metric}' WINDOW w AS (PARTITION BY job, instance ORDER BY ts)),
g AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM s), (SELECT max(ts) FROM s) + INTERVAL {seconds} SECOND, INTERVAL 1 HOUR)) AS t),
x AS (SELECT g.t, s.*, CASE WHEN pts > g.t - INTERVAL {seconds} SECOND THEN CASE WHEN value >= pv THEN value - pv ELSE value END ELSE 0 END AS inc,
  CASE WHEN pts > g.t - INTERVAL {seconds} SECOND AND pv <> value THEN 1 ELSE 0 END AS chg,
  (epoch_us(ts) - epoch_us(g.t)) / 1e6 AS sec FROM g JOIN s ON s.ts > g.t - INTERVAL {seconds} SECOND AND s.ts <= g.t)
"""


@query("m1_select_series", grid_sql("disk_free_bytes", H6) + """
SELECT t, job, instance, max_by(value, ts) AS value FROM x WHERE job = 'click' AND regexp_full_match(instance, 'n[01]') GROUP BY t, job, instance""")
def _(t):
    return flat(m.select_series(series(t, "disk_free_bytes"), "disk_free_bytes", {"job": "click"}, {"instance": "n[01]"}, STEP, H6))


@query("m2_rate", grid_sql("requests_total", H6) + """
SELECT t, job, instance, round(sum(inc) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 8) AS value FROM x GROUP BY t, job, instance HAVING count(*) >= 2""")
def _(t):
    return flat(m.rate(series(t, "requests_total"), H6, STEP), 8)


@query("m3_irate", grid_sql("requests_total", H6) + """
SELECT t, job, instance, round(max_by(inc, ts) / max_by((epoch_us(ts) - epoch_us(pts)) / 1e6, ts), 6) AS value FROM x GROUP BY t, job, instance HAVING count(*) >= 2""")
def _(t):
    return flat(m.irate(series(t, "requests_total"), H6, STEP), 6)


@query("m4_increase", grid_sql("requests_total", H24) + """
SELECT t, job, instance, round(sum(inc), 6) AS value FROM x GROUP BY t, job, instance HAVING count(*) >= 2""")
def _(t):
    return flat(m.increase(series(t, "requests_total"), H24, STEP))


@query("m5_delta", grid_sql("disk_free_bytes", H6) + """
SELECT t, job, instance, max_by(value, ts) - min_by(value, ts) AS value FROM x GROUP BY t, job, instance HAVING count(*) >= 2""")
def _(t):
    return flat(m.delta(series(t, "disk_free_bytes"), H6, STEP))


@query("m6_changes", grid_sql("probe_success", H24) + """
SELECT t, job, instance, CAST(sum(chg) AS DOUBLE) AS value FROM x GROUP BY t, job, instance""")
def _(t):
    return flat(m.changes(series(t, "probe_success"), H24, STEP))


@query("m7_avg_over_time", grid_sql("probe_success", H6) + """
SELECT t, job, instance, round(avg(value), 6) AS value FROM x GROUP BY t, job, instance""")
def _(t):
    return flat(m.avg_over_time(series(t, "probe_success"), H6, STEP))


@query("m8_predict_linear", grid_sql("disk_free_bytes", H24) + """
SELECT t, job, instance, round(regr_intercept(value, sec) + regr_slope(value, sec) * 86400, 3) AS value FROM x GROUP BY t, job, instance HAVING count(*) >= 2""")
def _(t):
    return flat(m.predict_linear(series(t, "disk_free_bytes"), H24, 86400, STEP), 3)


@query("m23_deriv", grid_sql("disk_free_bytes", H24) + """
SELECT t, job, instance, round(regr_slope(value, sec), 7) AS value FROM x GROUP BY t, job, instance HAVING count(*) >= 2""")
def _(t):
    return flat(m.deriv(series(t, "disk_free_bytes"), H24, STEP), 7)


def buckets(t):
    bounds = [("1", 1.0), ("5", 5.0), ("10", 10.0), ("50", 50.0), ("100", 100.0), ("+Inf", float("inf"))]
    b = F.explode(F.array(*[F.struct(F.lit(n).alias("le"), F.lit(v).alias("b")) for n, v in bounds]))
    d = t.events.select(F.date_trunc("day", "ts").alias("t"), "event_type", "value").groupBy("t", "event_type")
    counts = d.agg(*[F.count_if(F.col("value") <= v).cast("double").alias(n) for n, v in bounds])
    long = counts.unpivot(["t", "event_type"], [n for n, _ in bounds], "le", "value")
    return long.select("t", F.create_map(F.lit("job"), F.col("event_type"), F.lit("le"), F.col("le")).alias("labels"), "value")


HIST_SQL = """WITH c AS (SELECT date_trunc('day', ts) AS t, event_type AS job, count(*) FILTER (WHERE value <= 1) AS c1, count(*) FILTER (WHERE value <= 5) AS c2,
  count(*) FILTER (WHERE value <= 10) AS c3, count(*) FILTER (WHERE value <= 50) AS c4, count(*) FILTER (WHERE value <= 100) AS c5, count(*) AS c6 FROM events GROUP BY 1, 2),
r AS (SELECT *, c6 * 0.95::DOUBLE AS k FROM c),
q AS (SELECT t, job, CASE WHEN c1 >= k THEN 0 + 1 * k / c1 WHEN c2 >= k THEN 1 + 4 * (k - c1) / (c2 - c1) WHEN c3 >= k THEN 5 + 5 * (k - c2) / (c3 - c2)
  WHEN c4 >= k THEN 10 + 40 * (k - c3) / (c4 - c3) WHEN c5 >= k THEN 50 + 50 * (k - c4) / (c5 - c4) ELSE 100 END AS value FROM r)
"""


@query("m9_histogram_quantile", HIST_SQL + "SELECT t, job, round(value, 6) AS value FROM q")
def _(t):
    v = m.histogram_quantile(0.95, buckets(t))
    return v.select("t", F.col("labels")["job"].alias("job"), F.round("value", 6).alias("value"))


def rates(t):
    return m.rate(series(t, "requests_total"), H24, STEP)


RATE_CTE = grid_sql("requests_total", H24) + """, v AS (
SELECT t, job, instance, sum(inc) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS value FROM x GROUP BY t, job, instance HAVING count(*) >= 2)"""


@query("m10_aggregate", RATE_CTE + """
SELECT t, 'sum' AS fn, job, round(sum(value), 8) AS value FROM v GROUP BY t, job UNION ALL SELECT t, 'avg', job, round(avg(value), 8) FROM v GROUP BY t, job
UNION ALL SELECT t, 'max', job, round(max(value), 8) FROM v GROUP BY t, job UNION ALL SELECT t, 'groups', NULL, CAST(count(DISTINCT job) AS DOUBLE) FROM v GROUP BY t""")
def _(t):
    v = rates(t)
    parts = [m.aggregate(v, fn, ["job"]).withColumn("fn", F.lit(fn)) for fn in ("sum", "avg", "max")]
    parts.append(m.aggregate(m.aggregate(v, "count", ["job"]), "count").withColumn("fn", F.lit("groups")))
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return d.select("t", "fn", F.col("labels")["job"].alias("job"), F.round("value", 8).alias("value"))


DISK_PROBE = SQL + """, g AS (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS t, metric, job, instance, max_by(value, ts) AS value FROM samples GROUP BY 1, 2, 3, 4),
a AS (SELECT * FROM g WHERE metric = 'disk_free_bytes'), b AS (SELECT * FROM g WHERE metric = 'probe_success')"""


def hourly(t, metric):
    return m.select_series(series(t, metric), metric, step=STEP, lookback=STEP)


@query("m11_vector_op", DISK_PROBE + """
SELECT t, job, instance, round(CAST(CASE WHEN b.value = 0 THEN 'Infinity' ELSE a.value / b.value END AS DOUBLE), 6) AS value FROM a JOIN b USING (t, job, instance)""")
def _(t):
    return flat(m.vector_op(hourly(t, "disk_free_bytes"), hourly(t, "probe_success"), "/"))


@query("m12_scalar_op", DISK_PROBE + "SELECT t, job, instance, round(1 - value / 1000000, 6) AS value FROM a")
def _(t):
    return flat(m.scalar_op(m.scalar_op(hourly(t, "disk_free_bytes"), "/", 1e6), "-", 1, reverse=True))


@query("m13_compare", DISK_PROBE + """
SELECT t, job, instance, value FROM a WHERE value < 900000 UNION ALL SELECT t, job, instance, CASE WHEN value = 1 THEN 1.0::DOUBLE ELSE 0.0 END FROM b""")
def _(t):
    return flat(m.compare(hourly(t, "disk_free_bytes"), "<", 900000).unionByName(m.compare(hourly(t, "probe_success"), "==", 1, as_bool=True)))


@query("m14_vector_and", DISK_PROBE + "SELECT t, job, instance, value FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.t = a.t AND b.job = a.job AND b.instance = a.instance AND b.value = 0)")
def _(t):
    return flat(m.vector_and(hourly(t, "disk_free_bytes"), m.compare(hourly(t, "probe_success"), "==", 0)))


def span(t):
    return m.grid_over(t.events, STEP)


GRID = """, hours AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) + INTERVAL 1 HOUR FROM events), (SELECT max(ts) FROM events), INTERVAL 1 HOUR)) AS t)"""


@query("m15_vector_or", DISK_PROBE + GRID + """, l AS (SELECT t, job, instance, value FROM a WHERE value < 600000), r AS (SELECT t, job, instance, value FROM b)
SELECT t, job, instance, value FROM l UNION ALL SELECT t, job, instance, value FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.t = r.t AND l.job = r.job AND l.instance = r.instance)
UNION ALL SELECT t, NULL, NULL, 0.0 FROM hours""")
def _(t):
    v = m.vector_or(m.compare(hourly(t, "disk_free_bytes"), "<", 600000), hourly(t, "probe_success"))
    return flat(m.or_default(v, span(t)))


@query("m16_offset", DISK_PROBE + "SELECT n.t, job, instance, n.value - o.value AS value FROM a n JOIN (SELECT t + INTERVAL 3 HOUR AS t, job, instance, value FROM a) o USING (t, job, instance)")
def _(t):
    v = hourly(t, "disk_free_bytes")
    return flat(m.vector_op(v, m.offset(v, "3 HOURS"), "-"))


@query("m17_absent", DISK_PROBE + GRID + "SELECT t, 1.0::DOUBLE AS value FROM hours WHERE t NOT IN (SELECT t FROM b WHERE job = 'signup' AND value = 0)")
def _(t):
    v = m.compare(m.select_series(series(t, "probe_success"), "probe_success", {"job": "signup"}, step=STEP, lookback=STEP), "==", 0)
    return m.absent(v, span(t)).select("t", "value")


@query("m18_days_until", DISK_PROBE + "SELECT t, job, instance, round((1704067200 + value - epoch(t)) / 86400.0, 6) AS value FROM a")
def _(t):
    return flat(m.days_until(m.scalar_op(hourly(t, "disk_free_bytes"), "+", 1704067200)))


@query("m19_constant_series", "WITH z AS (SELECT 1)" + GRID + "SELECT t, 'target' AS name, 0.999::DOUBLE AS value FROM hours")
def _(t):
    return m.constant_series(span(t), 0.999, {"name": "target"}).select("t", F.col("labels")["name"].alias("name"), "value")


@query("m20_slo_report", grid_sql("probe_success", H6) + """, c AS (SELECT t, job, instance, avg(value) AS c FROM x GROUP BY t, job, instance)
SELECT t, job, instance, round(c, 6) AS current, round((1 - c) / 0.001::DOUBLE, 4) AS budget_consumed, round(1 - (1 - c) / 0.001::DOUBLE, 4) AS budget_remaining FROM c""")
def _(t):
    lab = F.col("labels")
    return m.slo_report(series(t, "probe_success"), 0.999, H6, STEP).select(
        "t", lab["job"].alias("job"), lab["instance"].alias("instance"), F.round("current", 6).alias("current"),
        F.round("budget_consumed", 4).alias("budget_consumed"), F.round("budget_remaining", 4).alias("budget_remaining"))


@query("m20_within_target", HIST_SQL + "SELECT t, job, CASE WHEN value < 60 THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM q")
def _(t):
    return m.within_target(m.histogram_quantile(0.95, buckets(t)), 60).select("t", F.col("labels")["job"].alias("job"), "value")


COLOR_SQL = """SELECT ts, 'health_status' AS metric, concat('c', CAST(user_id % 4 AS STRING)) AS cluster, c.color,
  CAST(CASE WHEN c.k = CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'signup' THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS DOUBLE) AS value
FROM events CROSS JOIN (VALUES ('green', 0), ('yellow', 1), ('red', 2)) AS c(color, k)"""


@query("m22_encode_status", """SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS t, concat('c', user_id % 4) AS cluster,
  max_by(CASE WHEN event_type = 'error' THEN 2.0::DOUBLE WHEN event_type = 'signup' THEN 1.0 ELSE 0.0 END, ts) AS value FROM events GROUP BY 1, 2""")
def _(t):
    s = m.as_samples(t.spark.sql(COLOR_SQL.replace("FROM events", "FROM {e}"), e=t.events))
    v = m.encode_status(m.select_series(s, "health_status", step=STEP, lookback=STEP))
    return v.select("t", F.col("labels")["cluster"].alias("cluster"), "value")
