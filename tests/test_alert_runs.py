"""Notices and cooldowns by pointers against plain walks, hot keys, and what plans hold."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.pointers import reached
from tidewatch.operators import alerts as al

BASE = 1704067200
GROUPS = "receiver string, group_key string, t timestamp, alerts bigint, fingerprint bigint, group_wait int, group_interval int, repeat_interval int"


def at(second):
    return datetime.datetime.fromtimestamp(BASE + second, datetime.timezone.utc).replace(tzinfo=None)


def history(rng, step, n, gaps):
    out, s = [], rng.randrange(5) * step
    for _ in range(n):
        s += step * rng.choice(gaps)
        out.append((s, rng.randint(1, 3), rng.randint(1, 2)))
    return out


@pytest.mark.parametrize(("step", "wait", "interval", "repeat"), [(30, 10, 60, 3600), (30, 30, 300, 700), (30, 100, 300, 14400), (60, 10, 60, 0), (3600, 30, 300, 14400), (7 * 10, 45, 330, 1000)])
def test_notices_equal_the_walk(spark, step, wait, interval, repeat):
    rng = random.Random(step + interval)
    rows, want = [], []
    for g in range(6):
        # many silences that end a group in one phase and not in another
        gaps = [1, 1, 1, 1, 2, 3, 5, 9, 12, 25] if g else [1, 2, 3, 4, 5, 6, 7, 8, 9]
        timed = [(BASE + s, c, m, wait, interval, repeat) for s, c, m in history(rng, step, 120 if g else 400, gaps)]
        timed = [(s - s % step, *rest) for s, *rest in timed]
        key = None if g == 5 else f"g{g}"
        rows += [("r", key, at(s - BASE), c, m, wait, interval, repeat) for s, c, m, *_ in timed]
        want += [("r", key, at(s - BASE), reason, n) for s, reason, n in al.notices_of_group(timed, step)]
    got = al.notification_times(spark.createDataFrame(rows, GROUPS).repartition(3), step, seconds=40 * step)
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(want, key=str)
    assert {"first", "resolved"} <= {w[3] for w in want}


def test_notices_of_no_groups(spark):
    assert al.notification_times(spark.createDataFrame([], GROUPS), 30).count() == 0


def test_notices_hold_no_history_in_a_row(spark):
    groups = spark.range(20).select(
        F.lit("r").alias("receiver"), F.lit("g").alias("group_key"), F.timestamp_seconds(F.col("id") * 30).alias("t"), F.lit(1).cast("bigint").alias("alerts"),
        F.col("id").alias("fingerprint"), F.lit(10).alias("group_wait"), F.lit(60).alias("group_interval"), F.lit(300).alias("repeat_interval"))
    text = al.notification_times(groups, 30)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in text and "collect_list" not in text


def test_a_hot_key_is_ordered_in_slices(spark):
    """One key holds nearly all rows: what is ordered at a time is a slice of it, and the rows stay right."""
    seconds = [40 * k for k in range(6000)]
    rows = [(at(s), "hot", "c", "e") for s in seconds] + [(at(s), f"k{s}", "c", "e") for s in seconds[:50]]
    df = spark.createDataFrame(rows, "ts timestamp, name string, category string, entity string")
    got = al.suppress_cooldown(df, minutes=15)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text
    taken = sorted(r.ts for r in got.where("accepted AND name = 'hot'").collect())
    want, last = [], None
    for s in seconds:
        if last is None or s - last >= 900:
            want.append(at(s))
            last = s
    assert taken == want
    touched = al.touch_active(df, spark.createDataFrame([], "dedup_key string, at timestamp"), minutes=15)
    assert touched.where("outcome = 'created' AND name = 'hot'").count() == 1


def test_alerts_without_a_time_or_a_key(spark):
    rows = [(None, "a"), (at(0), "a"), (at(10), None), (at(5000), None), (at(20), "a")]
    df = spark.createDataFrame(rows, "ts timestamp, k string")
    got = {(r.ts, r.k): r.accepted for r in al.suppress_cooldown(df, key=F.col("k"), minutes=15).collect()}
    assert got == {(None, "a"): False, (at(0), "a"): True, (at(10), None): True, (at(5000), None): True, (at(20), "a"): False}


def test_pointers_are_followed_to_their_ends(spark):
    n = 300
    jumps = [("a", k, k + 7) for k in range(n)] + [(None, k, k + 2 if k < 20 else None) for k in range(n)]
    starts = [("a", 0), ("a", 3), (None, 1)]
    got = reached(spark.createDataFrame(jumps, "k string, at bigint, to bigint"), spark.createDataFrame(starts, "k string, at bigint"), ["k"])
    want = {("a", x) for s in (0, 3) for x in range(s, n + 7, 7)} | {(None, x) for x in range(1, 22, 2)}
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(want, key=str)
