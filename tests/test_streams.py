"""Streaming runs against the batch form of the same operator."""

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import alerts as al
from tidewatch.operators import requests
from tidewatch.sources import tables as tables_of
from tidewatch.streaming import stateful, streams

T0 = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_windowed_requests_stream_equals_batch(spark, tables, tmp_path):
    src = str(tmp_path / "in")
    cols = ["provider", "model", "ts", "status", "latency_ms"]
    tables.ai_requests.select(*cols).repartition(4).write.parquet(src)
    late = spark.createDataFrame([("openai", "gpt-4", dt.datetime(2030, 1, 1), "success", 1.0)], tables.ai_requests.select(*cols).schema)
    late.write.mode("append").parquet(src)
    stream = spark.readStream.schema(late.schema).parquet(src)
    out = str(tmp_path / "out")
    d = requests.windowed_requests(stream, watermark="40 days")
    finish(streams.start_append(d, out, str(tmp_path / "cp"), once=True))
    got = spark.read.parquet(out)
    want = requests.windowed_requests(tables.ai_requests)
    assert rows_of(got.withColumn("latency_sum", F.round("latency_sum", 3))) == rows_of(want.withColumn("latency_sum", F.round("latency_sum", 3)))


def test_landing_pipeline_to_daily_partitions(spark, tables, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    logs = tables.app_logs.select(
        F.struct("message", F.col("raw_level").alias("level"), F.struct(F.col("service_name").alias("name")).alias("service"),
                 F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")).alias("event"), F.col("ts").alias("broker_time"))
    logs.write.json(src)
    schema = T.StructType.fromDDL("event struct<message string, level string, service struct<name string>, timestamp string>, broker_time timestamp")
    landing = streams.read_json_landing(spark, src, schema, "beats")
    finish(streams.start_daily(streams.log_pipeline(landing, {"pipeline": "main"}), out, "logs", str(tmp_path / "cp"), once=True))
    got = spark.read.parquet(out)
    assert got.count() == tables.app_logs.where("not message rlike 'health.?check|healthcheck|ping'").count()
    assert {r[0] for r in got.select("level").distinct().collect()} == {"error", "info", "warn", "fatal"}
    assert got.select("log_date").distinct().count() == tables.app_logs.select(F.to_date("ts")).distinct().count()


def test_broker_records_are_parsed(spark):
    schema = T.StructType.fromDDL("message string, level string")
    raw = spark.createDataFrame([(b'{"message":"m","level":"ERR"}', "logs", 1, 7, T0)], "value binary, topic string, partition int, offset long, timestamp timestamp")
    row = streams.parse_records(raw, schema).first()
    assert row["event"]["message"] == "m" and row["tags"] == ["kafka"] and row["offset"] == 7


VERSIONS = "request_id long, ts timestamp, v int"


def test_upsert_twice_is_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i % 20, T0 + dt.timedelta(minutes=i), i) for i in range(60)]
    spark.createDataFrame(rows, VERSIONS).coalesce(1).write.parquet(src)
    for run in ("a", "b"):
        stream = spark.readStream.schema(T.StructType.fromDDL(VERSIONS)).parquet(src)
        finish(streams.start_upsert(stream, out, str(tmp_path / f"cp-{run}"), once=True))
        got = rows_of(tables_of.read_versions(spark, out).select("request_id", "v"))
        assert got == [(i, 40 + i) for i in range(20)]


def test_a_replayed_batch_adds_nothing_with_or_without_ids(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(None if i % 4 == 0 else i % 10, T0 + dt.timedelta(hours=i % 10), i) for i in range(40)]
    first, second = spark.createDataFrame(rows[:25], VERSIONS), spark.createDataFrame(rows[25:], VERSIONS)
    want = None
    for number, part in ((0, first), (1, second), (0, first), (1, second)):
        tables_of.upsert_by_request_id(part, out, number)
        want = rows_of(tables_of.read_versions(spark, out).select(F.coalesce("request_id", F.lit(-1)), "v")) if number else want
    got = rows_of(tables_of.read_versions(spark, out).select(F.coalesce("request_id", F.lit(-1)), "v"))
    assert got == want and sum(r[0] == -1 for r in got) == 10
    assert sorted(r[1] for r in got if r[0] >= 0) == sorted({r[0]: r[2] for r in rows if r[0] is not None}.values())
    tables_of.compact_versions(spark, out, ["2024-01-01"], 2)
    assert rows_of(tables_of.read_versions(spark, out).select(F.coalesce("request_id", F.lit(-1)), "v")) == got
    assert [r.batch for r in spark.read.parquet(out).select("batch").distinct().collect()] == [1]


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    out = str(tmp_path / "out")
    many = spark.range(20_000).select(F.col("id").alias("request_id"), F.lit(T0).alias("ts"), F.col("id").cast("int").alias("v"))
    tables_of.upsert_by_request_id(many, out, 0)
    tables_of.upsert_by_request_id(many.limit(10), out, 1)
    sizes = {n: sum(f.stat().st_size for f in (tmp_path / "out").rglob(f"batch={n}/*.parquet")) for n in (0, 1)}
    assert sizes[1] < sizes[0] / 20
    assert tables_of.read_versions(spark, out).count() == 20_000


def test_a_lost_compaction_is_completed(spark, tmp_path):
    out = str(tmp_path / "out")
    for number in range(3):
        tables_of.upsert_by_request_id(spark.createDataFrame([(1, T0, number), (None, T0, number)], VERSIONS), out, number)
    aside = spark.createDataFrame([(1, T0, 1), (None, T0, 0), (None, T0, 1)], VERSIONS)
    aside.write.parquet(f"{out}/_compacting/2024-01-01/1")
    for child in (tmp_path / "out" / "log_date=2024-01-01" / "batch=0").iterdir():
        child.unlink()
    tables_of.compact_versions(spark, out, ["2024-01-01"], 2)
    got = rows_of(tables_of.read_versions(spark, out).select(F.coalesce("request_id", F.lit(-1)), "v"))
    assert got == [(-1, 0), (-1, 1), (-1, 2), (1, 2)]


def test_rejects_split_and_retry(spark, tmp_path):
    src, good, bad = (str(tmp_path / x) for x in ("in", "good", "bad"))
    spark.range(50).withColumn("ok", F.col("id") % 5 != 0).write.parquet(src)
    for run in ("a", "b"):
        stream = spark.readStream.schema(T.StructType.fromDDL("id long, ok boolean")).parquet(src)
        finish(streams.start_with_rejects(stream, F.col("ok"), good, bad, "facts", "2024-01-01", str(tmp_path / f"cp-{run}"), once=True))
    assert spark.read.parquet(good).count() == 40 and spark.read.parquet(bad).count() == 10


def run_parts(spark, make, parts, tmp_path):
    """What a stream gives that is stopped after each part and goes on from its checkpoint; a part is a list of rows."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(part.schema).parquet(src)
        finish(streams.start_append(make(stream), out, str(tmp_path / "cp"), once=True))
    return spark.read.parquet(out)


def test_hold_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    ddl = "t timestamp, alertname string, labels map<string,string>, value double"
    row = lambda i, n, name="A": (T0 + dt.timedelta(seconds=30 * i), name, {"n": str(n)}, 1.0)
    rows = [row(i, n) for n in range(3) for i in range(60) if rng.random() < 0.8]
    first, second = [r for r in rows if r[0] < T0 + dt.timedelta(minutes=15)], [r for r in rows if r[0] >= T0 + dt.timedelta(minutes=15)]
    rng.shuffle(first)
    rng.shuffle(second)
    late = [row(1, 9)]  # far behind the watermark of the first part
    holds = spark.createDataFrame([("A", 90)], "alertname string, hold int")
    parts = [spark.createDataFrame(p, ddl) for p in (first, second + late, [row(90_000, 0, "Z")])]
    got = run_parts(spark, lambda s: stateful.hold_for_stream(s, holds, 30, "30 seconds"), parts, tmp_path)
    want = al.hold_for(spark.createDataFrame(rows, ddl), holds, 30).select("alertname", F.unix_seconds("t"), F.unix_seconds("since"), "state")
    assert rows_of(got.select("alertname", "second", "since", "state")) == rows_of(want)


def test_cooldown_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    ddl = "ts timestamp, name string, category string, entity string"
    row = lambda s, name: (T0 + dt.timedelta(seconds=s), name, "c", "e")
    rows = [row(rng.randrange(0, 20000) + rng.choice([0, 0.25]), f"n{i % 3}") for i in range(300)]
    first, second = [r for r in rows if r[0] < T0 + dt.timedelta(seconds=9000)], [r for r in rows if r[0] >= T0 + dt.timedelta(seconds=9000)]
    rng.shuffle(second)
    parts = [spark.createDataFrame(p, ddl) for p in (first, second + [row(5, "n0")], [row(10**6, "z")])]
    got = run_parts(spark, lambda s: stateful.suppress_cooldown_stream(s, watermark="1 minute"), parts, tmp_path)
    want = al.suppress_cooldown(spark.createDataFrame(rows, ddl)).select(F.col("dedup_key").alias("key"), F.unix_micros("ts"), "accepted").distinct()
    assert rows_of(got.select("key", "us", "accepted")) == rows_of(want)


def test_notice_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    ddl = "receiver string, group_key string, t timestamp, alerts bigint, fingerprint bigint, group_wait int, group_interval int, repeat_interval int"
    rows = []
    for g in range(4):
        s = 30 * rng.randrange(4)
        for _ in range(80):
            s += 30 * rng.choice([1, 1, 1, 2, 4, 7, 15])
            rows.append(("r", f"g{g}", T0 + dt.timedelta(seconds=s), rng.randint(1, 3), rng.randint(1, 2), 40, 90, 400))
    half = T0 + dt.timedelta(seconds=3000)
    first, second = [r for r in rows if r[2] < half], [r for r in rows if r[2] >= half]
    rng.shuffle(first)
    rng.shuffle(second)
    push = [("r", "z", T0 + dt.timedelta(days=9), 1, 1, 40, 90, 400)]
    parts = [spark.createDataFrame(p, ddl) for p in (first, second, push)]
    got = run_parts(spark, lambda s: stateful.notification_times_stream(s, 30, "30 seconds"), parts, tmp_path)
    want = al.notification_times(spark.createDataFrame(rows, ddl), 30).select("receiver", "group_key", F.unix_seconds("t"), "reason", "alerts")
    assert rows_of(got.select("receiver", "group_key", "second", "reason", "alerts")) == rows_of(want)
