"""Edge values by hand."""

import datetime as dt
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.functions.quantiles import exact_quantiles
from tidewatch.functions.slices import asof_join, running_totals, trailing_totals
from tidewatch.operators import alerts as al
from tidewatch.operators import cost, enrich, health, normalise, requests, search
from tidewatch.operators import samples as m

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_quantiles_match_sorted_list(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([-5.0, 0.0, 0.3, 7.25, 100.0, rng.uniform(-50, 9999)])) for _ in range(3000)] + [("one", 4.0)]
    got = {r["k"]: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    ordered = sorted(v for k, v in rows if k == "hot")
    assert got["hot"]["p50"] == ordered[int(len(ordered) * 0.5)]
    assert got["hot"]["p99"] == ordered[int(len(ordered) * 0.99)]
    assert got["one"]["p50"] == got["one"]["p99"] == 4.0


def test_running_and_trailing_totals_cross_slices(spark):
    rng = random.Random(2)
    rows = [(i, "a" if i % 3 else None, at(rng.randrange(0, 4000)), i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, v long")
    got = {r["id"]: (r["run"], r["near"]) for r in trailing_totals(
        running_totals(df, ["k"], "ts", ["ts", "id"], {"run": F.col("v")}, 60), ["k"], "ts", "id", {"near": F.col("v")}, 600, 60).collect()}
    for i, k, ts, v in rows:
        same = [r for r in rows if r[1] == k]
        run = sum(r[3] for r in same if (r[2], r[0]) <= (ts, i))
        near = sum(r[3] for r in same if (r[2], r[0]) < (ts, i) and r[2] > ts - dt.timedelta(seconds=600))
        assert got[i] == (run, near)


def test_asof_join_takes_latest_not_later(spark):
    left = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(7200)), (3, "b", at(5))], "id long, k string, ts timestamp")
    right = spark.createDataFrame([("a", at(10), "x"), ("a", at(20), "y"), ("b", at(6), "z")], "k string, ts timestamp, v string")
    assert values(asof_join(left, right, ["k"], "ts", ["v"]), "id", "v") == [(1, "x"), (2, "y"), (3, None)]


def test_latency_thresholds_are_strict(spark):
    rows = [("a", 500.0, 2000.0, 5000.0, 1.0), ("b", 500.1, 5000.0, 10000.1, 5.1)]
    df = spark.createDataFrame(rows, "k string, p50 double, p95 double, p99 double, error_rate double")
    got = values(requests.latency_violations(df, ["k"]), "k", "type")
    assert got == [("b", "error_rate_critical"), ("b", "latency_p50_warning"), ("b", "latency_p95_warning"), ("b", "latency_p99_critical")]


def test_empty_requests_give_zeros(spark):
    df = spark.createDataFrame([], "provider string, model string, ts timestamp, latency_ms double, status string")
    row = requests.latency_percentiles(df, ()).first()
    assert (row["p50"], row["max"], row["count"]) == (0.0, 0.0, 0)
    assert requests.error_rate(df, ()).first()["error_rate"] == 0.0


def test_cached_tokens_do_not_turn_cost_negative(spark):
    df = spark.createDataFrame([("x", "y", 10, 100, 50)], "provider string, model string, input_tokens int, output_tokens int, cached_tokens int")
    rates = spark.createDataFrame([], "provider string, model string, input_per_1k double, output_per_1k double, enabled boolean")
    row = cost.request_cost(df, rates).first()
    assert row["input_cost"] == 0.0 and row["total_cost"] == pytest.approx(0.0002) and row["pricing_input"] == 0.0


def test_zero_variance_is_no_division(spark):
    rows = [(i, at(i), 0.01 if i < 20 else 5.0) for i in range(21)]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, total_cost double")
    got = dict(values(cost.cost_anomaly(df), "request_id", "anomaly_detected"))
    assert got[20] is True and not any(got[i] for i in range(20))


def test_text_edges(spark):
    assert one(spark, "", text.prompt_scores)["complexity_score"] == 0.0
    assert one(spark, "", text.response_shape)["reading_level"] == "elementary"
    assert one(spark, "According to the manual", text.hallucination_markers)["confidence"] == 0.0
    assert one(spark, "according to experts", text.hallucination_markers)["confidence"] == pytest.approx(0.3)
    assert one(spark, "GOOD bad", text.sentiment)["label"] == "mixed"
    assert one(spark, "men can't; female employees", text.bias_scores)["categories"][0]["direction"] == "negative"


def test_redaction_leaves_no_match(spark):
    sample = "a.b@c.org 4111111111111111 123-45-6789 10.0.0.1 1/2/1990 +1-555-123-4567"
    masked = one(spark, sample, text.redact_pii)
    assert masked == " ".join(["[REDACTED]"] * 6)
    assert one(spark, masked, text.redact_pii) == masked
    assert one(spark, masked, text.detect_pii)["count"] == 0
    assert one(spark, "no data", lambda c: text.redact_pii(c, "hash")) == "no data"
    compat = one(spark, "4111111111111111", lambda c: text.redact_pii(c, compat_order=True))
    assert compat == "[REDACTED]111111"


def test_first_failing_check_counts_one_and_streak_crosses_slices(spark):
    rows = [(i, "s", at(1800 * i), st) for i, st in enumerate(["unhealthy", "unhealthy", "healthy"] + ["degraded"] * 6)]
    got = [r[1] for r in values(health.health_streaks(spark.createDataFrame(rows, "event_id long, service string, ts timestamp, status string")), "event_id", "consecutive_failures")]
    assert got == [1, 2, 0, 1, 2, 3, 4, 5, 6]


def counter(spark, points):
    return spark.createDataFrame([(at(s), "c", {"i": "1"}, float(v)) for s, v in points], "ts timestamp, metric string, labels map<string,string>, value double")


def test_rate_corrects_resets_and_needs_two_samples(spark):
    s = counter(spark, [(15, 10), (30, 25), (45, 5), (60, 20), (600, 7)])
    got = {r["t"]: r["value"] for r in m.rate(s, 300, 30).collect()}
    assert got[at(60)] == pytest.approx((15 + 5 + 15) / 45)
    assert got[at(30)] == pytest.approx(1.0)
    assert at(600) not in got and min(got.values()) >= 0
    assert {r["t"]: r["value"] for r in m.increase(s, 300, 30).collect()}[at(60)] == 35.0


def test_instant_vector_goes_stale(spark):
    got = {r["t"] for r in m.select_series(counter(spark, [(30, 1)]), "c", step=30, lookback=300).collect()}
    assert min(got) == at(30) and max(got) == at(300)


def test_histogram_quantile_in_last_bucket(spark):
    rows = [(T0, {"le": le}, v) for le, v in (("0.1", 1.0), ("0.5", 2.0), ("+Inf", 10.0))]
    df = spark.createDataFrame(rows, "t timestamp, labels map<string,string>, value double")
    assert m.histogram_quantile(0.9, df).first()["value"] == 0.5
    assert m.histogram_quantile(0.05, df).first()["value"] == pytest.approx(0.05)


def test_hold_resets_on_gap(spark):
    rows = [(at(s), "A", {}, 1.0) for s in (0, 30, 60, 120, 150)]
    df = spark.createDataFrame(rows, "t timestamp, alertname string, labels map<string,string>, value double")
    holds = spark.createDataFrame([("A", 60)], "alertname string, hold int")
    assert [r[1] for r in values(al.hold_for(df, holds, 30), "t", "state")] == ["pending", "pending", "firing", "pending", "pending"]


def test_cooldown_is_greedy(spark):
    rng = random.Random(3)
    seconds = sorted(rng.sample(range(0, 40000), 500))
    df = spark.createDataFrame([(at(s), "n", "c", "e") for s in seconds], "ts timestamp, name string, category string, entity string")
    got = [r[0] for r in values(al.suppress_cooldown(df, minutes=15).where("accepted"), "ts")]
    want, last = [], None
    for s in seconds:
        if last is None or s - last >= 900:
            want.append(at(s))
            last = s
    assert got == want


def test_hold_spans_slices(spark):
    rows = [(at(600 * i), "A", {}, 1.0) for i in range(60) if i != 20]
    df = spark.createDataFrame(rows, "t timestamp, alertname string, labels map<string,string>, value double")
    holds = spark.createDataFrame([("A", 9000)], "alertname string, hold int")
    got = values(al.hold_for(df, holds, 600, seconds=3600), "t", "since", "state")
    assert got == [(at(600 * i), at(0 if i < 20 else 12600), "firing" if 600 * i - (0 if i < 20 else 12600) >= 9000 else "pending") for i in range(60) if i != 20]


@pytest.mark.parametrize("seed", range(3))
def test_active_alerts_are_touched(spark, seed):
    rng = random.Random(seed)
    seconds = sorted(rng.sample(range(0, 60000), 300))
    closes = sorted(rng.sample(range(0, 60000), 12)) + [seconds[40]]
    rows = [(at(s), k, "c", "e") for s in seconds for k in ("n", "m")]
    df = spark.createDataFrame(rows, "ts timestamp, name string, category string, entity string")
    keys = {r[0]: r[1] for r in values(df.select("name", al.stable_key().alias("k")).distinct(), "name", "k")}
    closed = spark.createDataFrame([(keys["n"], at(s)) for s in closes], "dedup_key string, at timestamp")
    got = values(al.touch_active(df, closed, minutes=15), "name", "ts", "outcome")
    want = []
    for name, ends in (("n", closes), ("m", [])):
        made = None
        for s in seconds:
            if made is not None and s - made < 900:
                outcome = "skipped"
            elif made is not None and not any(made < c <= s for c in ends):
                outcome = "updated"
            else:
                outcome, made = "created", s
            want.append((name, at(s), outcome))
    assert got == sorted(want)


def test_dedup_key_is_that_of_json(spark):
    numbers = [0.0, 500.0, -2.5, 1.0e7, 123456789.125, 1e15, 1e16, 2.5e20, 0.001, 0.00012, 1e-5, 3.75e-7]
    texts = ["plain", 'say "hi"', "back\\slash", "tab\tnewline\n", "Grüße", "\U0001f600 ok", ""]
    rows = [(x, i, texts[i % len(texts)], i % 2 == 0) for i, x in enumerate(numbers)]
    df = spark.createDataFrame(rows, "x double, i long, s string, b boolean")
    details = al._details(x=F.col("x"), i=F.col("i"), s=F.col("s"), b=F.col("b"), none=F.lit(None).cast("string"))
    got = [r[0] for r in df.select("i", details.alias("details"), F.lit("N").alias("name"), F.lit("c").alias("category")).orderBy("i").select(al.dedup_key()).collect()]
    want = [hashlib.md5(f"N:c:{json.dumps({'x': x, 'i': i, 's': s, 'b': b}, sort_keys=True)}".encode()).hexdigest()[:16] for x, i, s, b in rows]
    assert got == want


def test_panel_percentile_lies_between_ranks(spark):
    rng = random.Random(4)
    rows = [("a", at(i), rng.uniform(-50, 50)) for i in range(333)] + [("b", at(0), 2.0), (None, at(0), None), (None, at(1), 1.0), (None, at(2), 2.0)]
    got = {r["k"]: r for r in search.reduce_series(spark.createDataFrame(rows, "k string, t timestamp, value double"), ["k"]).collect()}
    assert got["a"]["p95"] == pytest.approx(np.percentile([r[2] for r in rows if r[0] == "a"], 95))
    assert (got["b"]["p95"], got[None]["p95"], got[None]["last"]) == (2.0, pytest.approx(1.95), 2.0)


def test_summary_of_an_empty_range_has_its_total(spark):
    df = spark.createDataFrame([(at(0), "x"), (at(5), None)], "ts timestamp, f string")
    assert values(search.metrics_summary(df, "1h", "2030-01-01", ["f"]), "block", "key", "rows") == [("total", "", 0)]
    got = values(search.metrics_summary(df, "1h", "2024-01-01 00:30:00", ["f"]), "block", "key", "rows")
    assert got == [("by_f", "x", 1), ("histogram", "2024-01-01 00:00:00", 2), ("total", "", 2)]


def replay(rows, step):
    """Second-by-second replay of one group: what a router would send."""
    out, state = [], None
    points = {r[0]: r for r in rows}
    for now in range(rows[0][0], rows[-1][0] + 40 * step):
        last = max((s for s in points if s <= now), default=None)
        alive = last is not None and now - last < step
        if state is None:
            if now in points:
                state = {"next": now + points[now][3], "sent": None, "at": None}
            else:
                continue
        if now == state["next"]:
            _, count, mark, _, interval, repeat = points[last]
            if not alive:
                if state["sent"] is not None:
                    out.append((now, "resolved", 0))
                state = None
                continue
            if state["sent"] is None or mark != state["sent"]:
                out.append((now, "first" if state["sent"] is None else "change", count))
                state["sent"], state["at"] = mark, now
            elif now - state["at"] >= repeat:
                out.append((now, "repeat", count))
                state["at"] = now
            state["next"] = now + interval
    return out


@pytest.mark.parametrize("seed", range(6))
def test_notices_match_replay(seed):
    rng = random.Random(seed)
    rows, s = [], 0
    for _ in range(25):
        s += 30 * rng.choice([1, 1, 1, 1, 2, 12])
        rows.append((s, rng.randint(1, 3), rng.randint(1, 2), 30, 60, 300))
    assert al.notices_of_group(rows, 30) == replay(rows, 30)


def test_every_alert_has_a_receiver(spark, tables):
    from tidewatch.plans import q_alerts

    d = q_alerts.alert_rows(tables)
    assert al.route_alerts(d).select("t", "alertname", "labels").withColumn("labels", F.to_json("labels")).distinct().count() == \
        d.select("t", "alertname", F.to_json("labels")).distinct().count()


def test_percentage_and_duration_forms(spark):
    df = spark.createDataFrame([(0.8312,), (93784.0,), (0.25,), (75.0,)], "v double")
    rows = df.select(F.concat(al._four_digits(F.col("v") * 100), F.lit("%")).alias("p"), al._duration(F.col("v")).alias("d")).collect()
    assert rows[0]["p"] == "83.12%" and [r["d"] for r in rows] == ["831.2ms", "1d 2h 3m 4s", "250ms", "1m 15s"]


def test_level_null_and_unknown(spark):
    df = spark.createDataFrame([(None,), ("weird",), ("Crit",)], "x string")
    assert [r[0] for r in df.select(normalise.normalise_level(F.col("x"))).collect()] == [None, "info", "fatal"]


def test_bad_addresses_have_no_number(spark):
    df = spark.createDataFrame([("256.1.1.1",), ("1.2.3",), ("x",), ("0.0.1.0",)], "x string")
    assert [r[0] for r in df.select(normalise.ipv4_number(F.col("x"))).collect()] == [None, None, None, 256]


def test_chain_is_capped_at_ten(spark):
    rows = [(i, "t", f"s{i}", at(i)) for i in range(15)]
    d = enrich.correlation_chain(spark.createDataFrame(rows, "event_id long, trace_id string, span_id string, ts timestamp"))
    got = [r[1:] for r in values(d.select("event_id", "correlation.chain_depth", "correlation.parent_span_id"), "event_id", "chain_depth", "parent_span_id")]
    assert got[0] == (0, None) and got[10] == (10, "s9") and got[14] == (10, "s9")


def test_

def test_messages_round_by_the_exact_value_and_ties_to_even(spark):
    rng = random.Random(4)
    xs = [28.125, 15.625, 0.375, 2.675, 2.665, 1.005, 0.005, 0.015, 99.995, 9.999, -0.001, -28.135, 0.0, 5e-324, 1e12 + 0.125]
    xs += [rng.randrange(0, 10**6) / 1000 for _ in range(300)] + [rng.random() * 10 ** rng.randrange(-3, 9) for _ in range(300)]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r.x: r.t for r in d.select("x", al._two_places(F.col("x")).alias("t")).collect()}
    assert {x: f"{x:.2f}" for x in xs} == got


def test_a_grid_does_not_start_before_the_first_sample(spark):
    d = spark.createDataFrame([(T0 + dt.timedelta(microseconds=591358),), (at(7200),)], "ts timestamp")
    assert values(m.grid_over(d, 3600), "t") == [(at(3600),), (at(7200),)]
    d = spark.createDataFrame([(T0,), (at(3599.9),)], "ts timestamp")
    assert values(m.grid_over(d, 3600), "t") == [(T0,)]


def test_the_latest_of_versions_of_one_time_does_not_depend_on_their_order(spark, tmp_path):
    from tidewatch.sources import tables

    rows = [(1, at(0), 7, 2.0, {"a": "b"}), (1, at(0), 9, 1.0, {"a": "c"}), (1, at(0), 8, 3.0, {"a": "d"})]
    for k in range(3):
        d = spark.createDataFrame(rows[k:] + rows[:k], "request_id long, ts timestamp, event_id long, value double, tags map<string,string>").coalesce(1)
        assert values(tables.latest_by_id(d.drop("tags")), "event_id", "value") == [(9, 1.0)]
        assert [r.tags for r in tables.latest_by_id(d).collect()] == [{"a": "c"}]
        path = str(tmp_path / f"v{k}")
        for number in (0, 1):
            tables.upsert_by_request_id(d.withColumn("value", F.col("value") + number), path, number)
        tables.compact_versions(spark, path, ["2024-01-01"], 2)
        assert values(tables.read_versions(spark, path), "event_id", "value") == [(9, 2.0)]


def test_history_goes_on_past_five_digits(spark):
    rows = [(at(0), f"ALT-20240101-{n:05d}", "technical") for n in (99_998, 99_999, 100_000, 100_001)]
    d = spark.createDataFrame(rows, "ts timestamp, id string, category string")
    assert [r.id for r in al.alert_history(d, 3).collect()] == [f"ALT-20240101-{n:05d}" for n in (99_999, 100_000, 100_001)]
