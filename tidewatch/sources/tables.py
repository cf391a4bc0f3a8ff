"""Day-partitioned tables, routed output and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """S3: rejected events with the reason, plugin and entry time."""
    return spark.read.parquet(path)


def with_day(df: DataFrame, prefix: str, ts: str = "ts") -> DataFrame:
    """The partition columns: prefix and UTC day, and the index name prefix-YYYY.MM.dd."""
    return df.withColumns({
        "index_name": F.concat(F.lit(f"{prefix}-"), F.date_format(ts, "yyyy.MM.dd")),
        "prefix": F.lit(prefix),
        "log_date": F.to_date(ts),
    })


def write_daily_partitions(df: DataFrame, path: str, prefix: str, ts: str = "ts", mode: str = "append") -> None:
    """One partition per UTC day. The rebalance hint splits a hot day over tasks and joins small ones."""
    with_day(df, prefix, ts).hint("rebalance", "prefix", "log_date").write.mode(mode).partitionBy("prefix", "log_date").parquet(path)


def write_failed_events(df: DataFrame, path: str, ts: str = "entry_time", mode: str = "append") -> None:
    """Rejected events by the day of their entry; no retention applies to them."""
    d = df.withColumns({
        "index_name": F.concat(F.lit("failed-events-"), F.date_format(ts, "yyyy.MM.dd")), "failed_date": F.to_date(ts),
    })
    d.hint("rebalance", "failed_date").write.mode(mode).partitionBy("failed_date").parquet(path)


def routed_rows(df: DataFrame, topic: Column, key: Column) -> DataFrame:
    """Topic, key and JSON value of each row."""
    return df.select(topic.alias("topic"), key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_routed(df: DataFrame, topic: Column, key: Column, path: str | None = None, servers: str | None = None) -> None:
    """Every row to the topic of its route with its key; as files by topic where no broker is given."""
    rows = routed_rows(df, topic, key)
    if servers:
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    else:
        rows.hint("rebalance", "topic").write.mode("append").partitionBy("topic").parquet(path)


def _newest(df: DataFrame, rest: Sequence[str], order: Sequence[str]) -> Column:
    """The row (``rest``) that comes last by ``order``; of equal ones the one of largest other columns, so that runs agree."""
    plain = [c for c in rest if c not in order and not any(k in df.schema[c].dataType.simpleString() for k in ("map<", "variant", "interval"))]
    rank = F.struct(*order, *plain)
    return F.max(rank) if {*order, *plain} == set(rest) else F.max_by(F.struct(*rest), rank)


def latest_by_id(df: DataFrame, row_id: str = "request_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """The last version of each id; rows without an id are all kept. Versions merge before the shuffle."""
    rest = [c for c in df.columns if c != row_id]
    newest = df.where(F.col(row_id).isNotNull()).groupBy(row_id).agg(_newest(df, rest, order).alias("_row")).select(row_id, "_row.*").select(*df.columns)
    return newest.unionByName(df.where(F.col(row_id).isNull()))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path holds anything, asked of the file system that it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(at) and len(files.listStatus(at)) > 0


def next_batch(spark: SparkSession, path: str) -> int:
    """The number after the largest that a table of versions holds; only names of partitions are read."""
    if not _exists(spark, path):
        return 0
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1


def upsert_by_request_id(df: DataFrame, path: str, batch: int | None = None, row_id: str = "request_id", ts: str = "ts", order: Sequence[str] = ("ts",)) -> None:
    """S7 as a sink: the rows become versions of their ids, in a folder of their day and batch; nothing stored is read.

    A batch that is written again replaces what it wrote before, rows without an id included, so a replay changes nothing.
    ``read_versions`` gives each id once. Without a number the batch is a new one. An id must keep its day.
    """
    spark = df.sparkSession
    number = next_batch(spark, path) if batch is None else batch
    d = latest_by_id(df, row_id, order).withColumns({"log_date": F.to_date(ts), "batch": F.lit(number).cast("bigint")})
    d.hint("rebalance", "log_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "batch").parquet(path)


def read_versions(spark: SparkSession, path: str, row_id: str = "request_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """S7 as a source: the newest version of each id, of the last batch and then the last by ``order``; all rows without an id.

    Ids keep their day, so a filter on log_date reads the folders of those days only.
    """
    d = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("bigint"))
    ided, loose = d.where(F.col(row_id).isNotNull()), d.where(F.col(row_id).isNull())
    rest = [c for c in d.columns if c not in (row_id, "log_date")]
    newest = ided.groupBy("log_date", row_id).agg(_newest(d, rest, ["batch", *order]).alias("_row"))
    return newest.select(row_id, "log_date", "_row.*").select(*d.columns).unionByName(loose).drop("batch")


def _children(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def _put_in_place(spark: SparkSession, path: str, day: str) -> None:
    """A finished compaction of the day replaces the batches that went into it, up to the one it is named by."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for last in _children(spark, f"{path}/_compacting/{day}"):
        aside = f"{path}/_compacting/{day}/{last}"
        if "_SUCCESS" not in _children(spark, aside):
            continue
        for name in _children(spark, f"{path}/log_date={day}"):
            if name.startswith("batch=") and int(name.removeprefix("batch=")) <= int(last):
                files.delete(hadoop.Path(f"{path}/log_date={day}/{name}"), True)
        files.rename(hadoop.Path(aside), hadoop.Path(f"{path}/log_date={day}/batch={last}"))


def compact_versions(spark: SparkSession, path: str, days: Sequence[str], before: int, row_id: str = "request_id", order: Sequence[str] = ("ts",)) -> None:
    """What the given days hold of batches below ``before`` becomes one batch, numbered like the last of them.

    ``before`` is a batch that can't be replayed any more. The new folder is finished aside before the old ones go; a run
    that is lost in between is completed by the next one of the day. Nothing should read a day while it is put in place.
    """
    path = path.rstrip("/")
    for day in days:
        _put_in_place(spark, path, day)
        there = spark.read.parquet(path).where((F.col("log_date") == F.lit(day).cast("date")) & (F.col("batch") < before))
        numbers = sorted(r.batch for r in there.select("batch").distinct().collect())
        if len(numbers) < 2:
            continue
        rest = [c for c in there.columns if c not in (row_id, "log_date", "batch")]
        ided, loose = there.where(F.col(row_id).isNotNull()), there.where(F.col(row_id).isNull())
        newest = ided.groupBy(row_id).agg(_newest(ided.drop(row_id, "log_date"), [*rest, "batch"], ["batch", *order]).alias("_row")).select(row_id, *[f"_row.{c}" for c in rest])
        newest.unionByName(loose.drop("log_date", "batch")).write.mode("overwrite").parquet(f"{path}/_compacting/{day}/{numbers[-1]}")
        _put_in_place(spark, path, day)


# The columns of the new table of industrial events.
INDUSTRIAL_COLUMNS = {
    "ts": "timestamp", "message": "string", "service": "string", "line": "string", "scenario": "string", "shift": "string",
    "level": "string", "host": "string", "event_type": "string", "status": "string", "duration_ms": "float",
    "error_code": "string",
}


def reindex(src: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Every row in the new schema; a value that does not fit its new type becomes null."""
    return src.select(*[
        (F.col(c).try_cast(t) if c in src.columns else F.lit(None).cast(t)).alias(c)
        for c, t in (mapping or INDUSTRIAL_COLUMNS).items()
    ])


def compact_partitions(spark: SparkSession, path: str, days: Sequence[str], sort: Sequence[str] = ("ts",), files: int = 1) -> None:
    """Rewrite the given days into ``files`` sorted files each; the rows stay the same.

    Rows spread over the files of their day by a hash of the row, so one hot day still uses several tasks.
    """
    d = spark.read.parquet(path).where(F.col("log_date").isin(*[F.lit(x).cast("date") for x in days]))
    part = ["prefix", "log_date"]
    slot = F.pmod(F.xxhash64(*[c for c in d.columns if c not in part]), F.lit(files)) if files > 1 else F.lit(0)
    out = d.withColumn("_slot", slot).repartition(max(1, files * len(days)), *part, "_slot").sortWithinPartitions(*part, *sort)
    out.drop("_slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)


def read_index_pattern(spark: SparkSession, path: str, prefix: str, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows of prefix-* in [start, end): day partitions outside are not read."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return spark.read.parquet(path).where(
        F.col("prefix").startswith(prefix) & F.col("log_date").between(F.to_date(a), F.to_date(b)) & (F.col(ts) >= a) & (F.col(ts) < b)
    )


def read_samples(spark: SparkSession, path: str, static_labels: dict[str, str] | None = None) -> DataFrame:
    """Samples as (ts, metric, labels, value); columns other than these become labels."""
    from tidewatch.operators.samples import as_samples

    return as_samples(spark.read.parquet(path), static_labels)


def write_summary_json(checks: DataFrame, path: str, header: dict[str, str]) -> None:
    """One JSON document: header, counts by status, and one element per check (a report has a few dozen)."""
    summary_document(checks, header).coalesce(1).write.mode("overwrite").json(path)


def summary_document(checks: DataFrame, header: dict[str, str]) -> DataFrame:
    counts = F.struct(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("passed", "warning", "failed", "error", "skipped")
    ])
    return checks.agg(
        *[F.lit(v).alias(k) for k, v in header.items()], counts.alias("summary"),
        F.array_sort(F.collect_list(F.struct("check", "status", "message"))).alias("checks"),
    )
