"""Nested, touching, overlapping and wide networks against a look at all of them."""

import random

import pytest

from tidewatch.operators import normalise

NETS = "start_ip bigint, end_ip bigint, city_name string, country_name string, country_code2 string, continent_code string, region_name string, lat double, lon double"


def frame(spark, nets):
    return spark.createDataFrame([(a, b, f"c{k}", "n", "XX", "YY", "r", float(k), 0.0) for k, (a, b) in enumerate(nets)], NETS)


def spelled(n):
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def holder(nets, n):
    held = [(b - a, a, f"c{k}") for k, (a, b) in enumerate(nets) if a <= n <= b]
    return min(held)[2] if held else None


@pytest.mark.parametrize("wide", [False, True])
def test_the_smallest_network_holds_an_address(spark, wide):
    rng = random.Random(2)
    base = 10 << 24
    nets = [(base, base + (1 << 24) - 1), (base + 5, base + 70_000), (base + 60_000, base + 140_000), (base + 65_536, base + 131_071), (base + 7, base + 7)]
    for _ in range(40):
        bits, at = rng.randint(0, 18), base + rng.randrange(1 << 19)
        at -= at % (1 << bits)
        nets.append((at, at + (1 << bits) - 1))
    nets = list(dict.fromkeys(nets))
    if wide:
        nets.append((0, 2**32 - 1))
    edges = [x + d for a, b in nets for x in (a, b) for d in (-1, 0, 1) if 0 <= x + d < 2**32]
    asked = sorted({*edges, *[base + rng.randrange(1 << 20) for _ in range(300)], 0, 2**32 - 1})
    rows = [(spelled(n),) for n in asked] + [(None,), ("300.1.1.1",)]
    got = normalise.geoip_enrich(spark.createDataFrame(rows, "client_ip string"), frame(spark, nets)).collect()
    assert len(got) == len(rows)
    found = {r.client_ip: r.geo and r.geo["city_name"] for r in got}
    assert found == {spelled(n): holder(nets, n) for n in asked} | {None: None, "300.1.1.1": None}


def test_a_wide_network_is_a_range_a_block_at_most(spark):
    from pyspark.sql import functions as F

    nets = frame(spark, [(0, 2**32 - 1), (1 << 20, (1 << 20) + 255)]).select("start_ip", "end_ip", F.struct("city_name").alias("geo"))
    flat = normalise.flat_networks(nets)
    assert flat.count() <= 65_536 + 4
    assert flat.agg(F.sum(F.expr("end_ip - start_ip + 1"))).first()[0] == 2**32


def test_no_networks(spark):
    got = normalise.geoip_enrich(spark.createDataFrame([("1.2.3.4",)], "client_ip string"), frame(spark, [])).collect()
    assert len(got) == 1 and got[0].geo is None
