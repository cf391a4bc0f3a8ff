"""Recorded rules as a table that runs go on with, and what their plans cost."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import recording
from tidewatch.operators import samples as m
from tidewatch.operators.recording import Operand, Rule

BASE = 1704067200
STEP = 60
RULES = (
    Rule("up:now", "a", (Operand("up"),)),
    Rule("up:mean", "a", (Operand("up", "avg", 600),)),
    Rule("hits:rate", "a", (Operand("hits", "rate", 300, agg="sum", by=("job",)),)),
    Rule("hits:last", "a", (Operand("hits", "irate", 120),)),
    Rule("hits:hour_ago", "a", (Operand("hits", "increase", 300, back=1800),)),
    Rule("hits:line", "a", (Operand("hits", "predict", 900, horizon=60),)),
    Rule("share", "a/b", (Operand("hits:rate"), Operand("up:mean", agg="sum", by=("job",)))),
    Rule("share:mean", "a", (Operand("share", "avg", 1200),)),
    Rule("share:trend", "a", (Operand("share", "deriv", 1200),)),
    Rule("goal", "const", (), 0.5),
    Rule("share:met", "a<k", (Operand("share", agg="max"),), 2.0),
)


def at(second):
    return datetime.datetime.fromtimestamp(BASE + second, datetime.timezone.utc).replace(tzinfo=None)


@pytest.fixture(scope="module")
def samples(spark):
    rows = []
    for i in range(3):
        for k in range(400):
            if 150 < k < 190 and i == 1:
                continue  # longer silence than most ranges
            labels = {"job": "a" if i < 2 else "b", "instance": f"n{i}"}
            rows.append((at(37 * k + i), "up", labels, float((k + i) % 5 > 0)))
            rows.append((at(37 * k + 3 * i), "hits", labels, float((k * k + 7 * i) % 900)))
    return spark.createDataFrame(rows, "ts timestamp, metric string, labels map<string,string>, value double")


def rows_of(df):
    return sorted((r.t, r.name, tuple(sorted(r.labels.items())), round(r.value, 9)) for r in df.collect())


def test_two_runs_equal_one_and_read_what_ranges_reach(spark, samples, tmp_path):
    end, half = BASE + 15_000, BASE + 7_200
    grid = m.time_grid(spark, BASE, end, STEP)
    whole = recording.RuleStore(spark, str(tmp_path / "whole"), RULES, STEP).run(samples, grid, end)
    parts = recording.RuleStore(spark, str(tmp_path / "parts"), RULES, STEP).run(samples, grid, half)
    assert parts.position() == half
    parts.run(samples, grid, half)  # nothing is new
    parts.run(samples, grid, end)
    want = rows_of(whole.values())
    assert rows_of(parts.values()) == want and {r[1] for r in want} == {r.name for r in RULES}
    assert len(want) == len({r[:3] for r in want})
    new = spark.read.parquet(str(tmp_path / "parts" / "steps")).where(F.col("run") == end)
    assert new.agg(F.min("g")).first()[0] > half


def test_what_a_failed_run_left_does_not_count(spark, samples, tmp_path, monkeypatch):
    grid, ends = m.time_grid(spark, BASE, BASE + 9_000, STEP), (BASE + 4_200, BASE + 6_000, BASE + 9_000)
    whole = recording.RuleStore(spark, str(tmp_path / "whole"), RULES, STEP).run(samples, grid, ends[2])
    store = recording.RuleStore(spark, str(tmp_path / "parts"), RULES, STEP).run(samples, grid, ends[0])
    write, count = store._write, iter(range(100))

    def fails(df, *rest):
        if next(count) == 4:
            raise OSError("lost")
        write(df, *rest)

    monkeypatch.setattr(store, "_write", fails)
    with pytest.raises(OSError):
        store.run(samples, grid, ends[1])
    monkeypatch.setattr(store, "_write", write)
    assert store.position() == ends[0]
    assert rows_of(store.run(samples, grid, ends[2]).values()) == rows_of(whole.values())


def test_stored_levels_equal_the_lazy_plan(spark, samples, tmp_path):
    grid = m.time_grid(spark, BASE, BASE + 15_000, STEP)
    assert rows_of(recording.store_rules(samples, RULES, str(tmp_path / "t"), STEP, grid)) == rows_of(recording.record_rules(samples, RULES, STEP, grid))


def test_one_shuffle_by_series_serves_all_lengths(spark, samples):
    lengths = [Rule(f"r{n}", "a", (Operand("hits", fn, n * 60),)) for n, fn in ((2, "rate"), (5, "rate"), (10, "avg"), (30, "increase"), (60, "delta"))]
    values, _ = recording.evaluate_level(recording.source_of(samples, STEP), lengths, STEP)
    text = values._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert sum("seconds" in x and "b#" in x for x in shuffles) == 1, shuffles
    # the rest: samples by step, the dictionary once for what the results are called, targets to values, results by rule
    assert len(shuffles) <= 6, shuffles
    assert "from_json" not in text and "to_json" not in text


def test_labels_in_columns_are_the_labels_of_a_map(spark, samples, tmp_path):
    grid = m.time_grid(spark, BASE, BASE + 15_000, STEP)
    wide = samples.select("ts", "metric", "value", F.col("labels")["job"].alias("job"), F.lit(None).cast("string").alias("area"), F.col("labels")["instance"].alias("instance"))
    assert set(recording.numbered(wide).select("metric", "sid").distinct().collect()) == set(recording.numbered(samples).select("metric", "sid").distinct().collect())
    assert rows_of(recording.store_rules(wide, RULES, str(tmp_path / "t"), STEP, grid)) == rows_of(recording.record_rules(samples, RULES, STEP, grid))
    # no sample makes or sorts a map for its number
    text = recording.numbered(wide)._jdf.queryExecution().optimizedPlan().toString()
    assert "map" not in text.split("\n")[0] and "sort_array" not in text


def test_a_sample_is_shuffled_without_its_metric(spark, samples, tmp_path, monkeypatch):
    plans, write = {}, recording.RuleStore._write

    def noted(self, df, table, *rest):
        plans.setdefault(table, df._jdf.queryExecution().optimizedPlan().toString())
        write(self, df, table, *rest)

    monkeypatch.setattr(recording.RuleStore, "_write", noted)
    recording.store_rules(samples, RULES, str(tmp_path / "t"), STEP)
    window = next(x for x in plans["steps"].split("\n") if "Window [" in x)
    assert "sid#" in window and "metric#" not in window
    assert {r.metric for r in spark.read.parquet(str(tmp_path / "t" / "steps")).select("metric").distinct().collect()} == {"up", "hits"}
