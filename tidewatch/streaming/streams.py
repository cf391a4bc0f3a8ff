"""Streams: sources (S1, S2), sinks (S4, S7, S8) and the log pipeline as one query."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tidewatch.operators import normalise
from tidewatch.sources import contracts, tables

TOPICS = ("logs", "metrics", "events")


def parse_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """S1 body: broker records (value, topic, partition, offset, timestamp) to events tagged kafka."""
    return records.select(
        F.from_json(F.col("value").cast("string"), schema).alias("event"), "topic", "partition", "offset",
        F.col("timestamp").alias("broker_time"), F.array(F.lit("kafka")).alias("tags"))


def read_log_stream(spark: SparkSession, servers: str, schema: T.StructType, topics: Sequence[str] = TOPICS, per_trigger: int = 5_000_000) -> DataFrame:
    """Topics from the latest offsets on; the rate limit bounds a micro-batch after a stop."""
    records = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
        .option("startingOffsets", "latest").option("maxOffsetsPerTrigger", per_trigger).load())
    return parse_records(records, schema)


def read_json_landing(spark: SparkSession, path: str, schema: T.StructType, origin: str, files_per_trigger: int = 1000, stream: bool = True) -> DataFrame:
    """JSON lines that land in a folder, with their origin; as a stream, or what lies there now as a batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    return reader.schema(schema).json(path).withColumn("origin", F.lit(origin))


def log_pipeline(events: DataFrame, fields: dict[str, str], arrival: str = "broker_time") -> DataFrame:
    """S1 to N9 and N5 in one pass without a shuffle: lift, parse time, level, metadata, constants, health checks."""
    d = events.withColumn("arrival", F.col(arrival))
    kind = d.schema["event"].dataType
    times = [n for n in ("timestamp", "@timestamp") if n in kind.fieldNames()]
    d = d.withColumns({f"_time{i}": F.col("event").getField(n).cast("string") for i, n in enumerate(times)})
    d = normalise.parse_event_time(d, [f"_time{i}" for i in range(len(times))]).drop(*[f"_time{i}" for i in range(len(times))])
    d = normalise.lift_event_fields(d).withColumn("level", normalise.normalise_level(F.col("log_level")))
    if "topic" in d.columns:
        d = normalise.lift_kafka_metadata(d)
    return normalise.drop_health_checks(normalise.stamp_static_fields(d, fields).drop("arrival"))


def start_daily(df: DataFrame, path: str, prefix: str, checkpoint: str, ts: str = "ts", once: bool = False) -> StreamingQuery:
    """S4 as a stream: append to the day partitions, exactly once through the checkpoint."""
    w = tables.with_day(df, prefix, ts).writeStream.format("parquet").partitionBy("prefix", "log_date")
    return _start(w.option("path", path).option("checkpointLocation", checkpoint), once)


def _start(writer, once: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    return _start(df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint), once)


def _first_number(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The number of a stream's batch 0 in the table: after all that is there when the stream first starts, then the same for ever."""
    writers = f"{path.rstrip('/')}/_writers"
    if tables._exists(spark, writers):
        known = spark.read.schema("checkpoint string, first bigint").parquet(writers).where(F.col("checkpoint") == checkpoint).agg(F.min("first")).first()[0]
        if known is not None:
            return known
    first = tables.next_batch(spark, path)
    spark.createDataFrame([(checkpoint, first)], "checkpoint string, first bigint").coalesce(1).write.mode("append").parquet(writers)
    return first


def start_upsert(df: DataFrame, path: str, checkpoint: str, once: bool = False, order: Sequence[str] = ("ts",)) -> StreamingQuery:
    """S7 as a stream: a replayed batch replaces what it wrote before, so the table stays as it was, rows without an id included."""
    first = _first_number(df.sparkSession, path, checkpoint)
    return start_batches(df, lambda batch, number: tables.upsert_by_request_id(batch, path, first + number, order=order), checkpoint, once)


def start_with_rejects(df: DataFrame, contract: Column, target: str, rejects: str, index: str, now, checkpoint: str, once: bool = False) -> StreamingQuery:
    """S8 as a stream. Both outputs carry the batch number as their partition and overwrite it, so a retry adds nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        good, bad = contracts.split_by_contract(batch, contract, index, now)
        for part, path in ((good, target), (bad, rejects)):
            part.withColumn("batch", F.lit(number)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return start_batches(df, sink, checkpoint, once)


def start_append(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    return _start(df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint), once)
