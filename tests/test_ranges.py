"""Range functions beside values that must not show outside their range, against the plain definition."""

import datetime
import math

import pytest

from tidewatch.functions.slices import trailing_totals
from tidewatch.operators import samples as m

STEP, RANGE = 60, 300
BASE = 1704067200
VALUES = [1.0, 1e17, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, float("nan"), 8.0, 9.0, 10.0, 11.0, 12.0, 13.0, float("inf"), 14.0, 15.0, 16.0, 17.0, 18.0, 19.0, 20.0, 21.0, 22.0]


def at(second):
    return datetime.datetime.fromtimestamp(BASE + second, datetime.timezone.utc).replace(tzinfo=None)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(at(60 * k + 17 * (k % 3)), "x", {"i": "a"}, v) for k, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "ts timestamp, metric string, labels map<string,string>, value double")


def seen(t):
    """(second, value) of the samples in (t - RANGE, t]."""
    return [(60 * k + 17 * (k % 3), v) for k, v in enumerate(VALUES) if t - RANGE < 60 * k + 17 * (k % 3) <= t]


def growth(inside):
    # no number is above every number, as in the engine
    up = [b - a if math.isnan(b) or (not math.isnan(a) and b >= a) else b for (_, a), (_, b) in zip(inside, inside[1:])]
    return sum(up)


def mean(inside):
    return sum(v for _, v in inside) / len(inside)


def line(inside, t, horizon):
    n = len(inside)
    mx, my = sum(s for s, _ in inside) / n, sum(v for _, v in inside) / n
    slope = sum((s - mx) * (v - my) for s, v in inside) / sum((s - mx) ** 2 for s, _ in inside)
    return my + slope * (t + horizon - mx)


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1e-9 * max(abs(a), abs(b))


@pytest.mark.parametrize("name", ["avg", "increase", "rate", "predict"])
def test_a_value_shows_only_inside_its_range(odd, name):
    frames = {
        "avg": lambda: m.avg_over_time(odd, RANGE, STEP), "increase": lambda: m.increase(odd, RANGE, STEP), "rate": lambda: m.rate(odd, RANGE, STEP),
        "predict": lambda: m.predict_linear(odd, RANGE, 600, STEP),
    }
    got = {int(r.t.replace(tzinfo=datetime.timezone.utc).timestamp()) - BASE: r.value for r in frames[name]().select("t", "value").collect()}
    assert got
    for t, value in got.items():
        inside = seen(t)
        if name == "avg":
            want = mean(inside)
        elif name == "predict":
            want = line(inside, t, 600)
        else:
            want = growth(inside) / (inside[-1][0] - inside[0][0] if name == "rate" else 1)
        if name == "predict" and any(v == 1e17 for _, v in inside):
            continue  # sixteen digits are all that a double has
        assert same(value, want) or (math.isinf(want) and math.isnan(value)) or (math.isnan(want) and math.isnan(value)), (t, value, want)
    if name != "avg":
        assert sorted(got) == sorted(t for t in got if len(seen(t)) >= 2)


def test_trailing_totals_keep_rows_without_id_and_of_equal_id(spark):
    from pyspark.sql import functions as F

    rows = [(None, "k", at(0), 1), (7, "k", at(10), 2), (7, "k", at(20), 4), (None, "k", at(30), 8), (9, None, at(40), 16), (9, "k", at(200), 32)]
    d = spark.createDataFrame(rows, "id bigint, key string, ts timestamp, v bigint")
    got = trailing_totals(d, ["key"], "ts", "id", {"near": F.col("v")}, 60, 60)
    assert got.columns == ["id", "key", "ts", "v", "near"]
    assert sorted((r.v, r.near) for r in got.collect()) == [(1, 0), (2, 1), (4, 3), (8, 7), (16, 0), (32, 0)]
