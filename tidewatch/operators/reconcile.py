"""Reconciliation of tables and of a fleet before and after an upgrade.

Check results are rows (cluster, check, category, status, message, recommendations); lists of names stay rows of their
own, so no list grows with the fleet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the checks.
MIN_MASTERS, MIN_DATA_NODES = 3, 2
MIN_FREE_DISK, MAX_HEAP = 20.0, 85
FAILED_UNASSIGNED = 10
STALE_HOURS = 24
GIB = float(1 << 30)


def capture_counts(df: DataFrame, table: str) -> DataFrame:
    """Rows per table name, as the baseline of U1."""
    return df.groupBy(F.col(table).alias("name")).agg(F.count(F.lit(1)).alias("rows"))


def reconcile_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names whose count fell. Names new or gone are not compared; without a baseline nothing is."""
    b = before.select("name", F.col("rows").alias("rows_before"))
    a = after.select("name", F.col("rows").alias("rows_after"))
    return b.join(a, "name").where("rows_after < rows_before").withColumn("difference", F.col("rows_before") - F.col("rows_after"))


def _status(failed: Column, warning: Column) -> Column:
    return F.when(failed, "failed").when(warning, "warning").otherwise("passed")


def version_consistency(nodes: DataFrame, target: str | None = None) -> DataFrame:
    """Versions per cluster (a handful); mixed fails. With a target also the nodes that are not on it."""
    off = F.count_if(F.col("version") != target) if target else F.lit(0).cast("bigint")
    d = nodes.groupBy("cluster").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.count(F.lit(1)).alias("nodes"), off.alias("off_target"))
    never = F.lit(False)
    return d.withColumn("status", _status(F.size("versions") > 1, never))


def nodes_off_target(nodes: DataFrame, target: str) -> DataFrame:
    return nodes.where(F.col("version") != target).select("cluster", "name", "version")


def role_counts(nodes: DataFrame) -> DataFrame:
    """Master-eligible and data nodes per cluster; too few is a warning."""
    roles = F.split("roles", ",")
    d = nodes.groupBy("cluster").agg(
        F.count_if(F.array_contains(roles, "master")).alias("masters"), F.count_if(F.array_contains(roles, "data")).alias("data_nodes"))
    few = F.lit(False)
    return d.withColumns({
        "master_status": _status(few, F.col("masters") < MIN_MASTERS), "data_status": _status(few, F.col("data_nodes") < MIN_DATA_NODES)})


def resource_pressure(nodes: DataFrame) -> DataFrame:
    """U4: nodes short of disk or heap, with the figures."""
    free = F.col("disk_available") / F.col("disk_total") * 100
    d = nodes.withColumns({
        "low_disk": (F.col("disk_total") > 0) & (free < MIN_FREE_DISK), "high_heap": F.col("heap_used_percent") > MAX_HEAP,
        "free_percent": F.round(free, 2), "available_gb": F.round(F.col("disk_available") / GIB, 2), "total_gb": F.round(F.col("disk_total") / GIB, 2)})
    return d.where("low_disk OR high_heap").select("cluster", "name", "low_disk", "high_heap", "free_percent", "available_gb", "total_gb", "heap_used_percent")


def resource_checks(nodes: DataFrame) -> DataFrame:
    """U4 per cluster: number of short nodes and the status of both checks."""
    free = F.col("disk_available") / F.col("disk_total") * 100
    d = nodes.groupBy("cluster").agg(
        F.count_if((F.col("disk_total") > 0) & (free < MIN_FREE_DISK)).alias("low_disk"), F.count_if(F.col("heap_used_percent") > MAX_HEAP).alias("high_heap"))
    no = F.lit(False)
    return d.withColumns({"disk_status": _status(no, F.col("low_disk") > 0), "heap_status": _status(no, F.col("high_heap") > 0)})


def shard_state(health: DataFrame) -> DataFrame:
    """Moving shards warn; unassigned ones warn below ten and fail from ten on."""
    lost = F.col("unassigned_shards")
    return health.withColumns({
        "moving_status": _status(F.lit(False), (F.col("relocating_shards") > 0) | (F.col("initializing_shards") > 0)),
        "unassigned_status": _status(lost >= FAILED_UNASSIGNED, lost > 0)})


def index_health_rollup(indices: DataFrame) -> DataFrame:
    """Indices by health; red fails, yellow and closed warn. Green is what is neither red nor yellow."""
    red, yellow = F.count_if(F.col("health") == "red"), F.count_if(F.col("health") == "yellow")
    d = indices.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("total"), red.alias("red"), yellow.alias("yellow"), F.count_if(F.col("status") == "close").alias("closed"))
    return d.withColumns({
        "green": F.col("total") - F.col("red") - F.col("yellow"),
        "status": _status(F.col("red") > 0, (F.col("yellow") > 0) | (F.col("closed") > 0))})


def index_compatibility(indices: DataFrame, target: str) -> DataFrame:
    """Issues and warnings of each index that is not a system one."""
    created = F.split(F.split("created_version", "-")[0], r"\.")[0].try_cast("int")
    old = F.lit(int(target.split(".")[0])) - created > 1
    issues = F.filter(F.array(
        F.when(F.contains("mapping", F.lit("_type")), F.lit("Index uses deprecated _type field")),
        F.when(old, F.format_string("Index was created in version %s - may need reindexing", "created_version"))), lambda x: x.isNotNull())
    warnings = F.filter(F.array(F.when(F.contains("mapping", F.lit("_all")), F.lit("Index uses _all field which is deprecated"))), lambda x: x.isNotNull())
    return indices.where(~F.col("index_name").startswith(".")).select(
        "cluster", "index_name", (F.size(issues) == 0).alias("compatible"), issues.alias("issues"), warnings.alias("warnings"), "created_version")


def deprecation_rollup(deprecations: DataFrame, first: int = 10) -> DataFrame:
    """U8: (cluster, scope, level, message) rows counted; critical cluster or node settings fail, any other warns.

    The first warnings come from a bounded sort per cluster.
    """
    own = F.col("scope").isin("cluster", "node")
    d = deprecations.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(own & (F.col("level") == "critical")).alias("critical"),
        F.count_if(own & (F.col("level") != "critical")).alias("warnings"))
    return d.withColumn("status", _status(F.col("critical") > 0, F.col("total") > 0))


def first_deprecations(deprecations: DataFrame, first: int = 10) -> DataFrame:
    """U8: the first warnings of cluster and node settings per cluster."""
    from pyspark.sql import Window

    w = Window.partitionBy("cluster").orderBy("message")
    d = deprecations.where(F.col("scope").isin("cluster", "node") & (F.col("level") != "critical"))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first).select("cluster", "rank", "message")


def plugin_inventory(nodes: DataFrame) -> DataFrame:
    """Distinct plugins per cluster as rows, with the number of nodes that have them."""
    d = nodes.select("cluster", F.explode(F.split("plugins", ",")).alias("plugin")).where("plugin <> ''")
    return d.groupBy("cluster", "plugin").agg(F.count(F.lit(1)).alias("nodes"))


def snapshot_freshness(snapshots: DataFrame, as_of) -> DataFrame:
    """Latest successful snapshot of each repository, its duration, and whether it is too old or missing."""
    good = F.col("state") == "SUCCESS"
    pos = F.when(good, F.struct("end_time", "snapshot"))
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    d = snapshots.groupBy("repository").agg(
        F.max_by("snapshot", pos).alias("snapshot"), F.max_by("start_time", pos).alias("_start"), F.max(F.when(good, F.col("end_time"))).alias("end_time"))
    age = (now - F.unix_micros("end_time")) / F.lit(3600e6)
    return d.select(
        "repository", "snapshot", "end_time", ((F.unix_micros("end_time") - F.unix_micros("_start")) / F.lit(1e6)).alias("duration_seconds"),
        F.when(F.col("snapshot").isNull() | (age > STALE_HOURS), "warning").otherwise("passed").alias("status"))


def size_estimate(indices: DataFrame, keys: Sequence[str] = ("cluster",)) -> DataFrame:
    """Total and primary size; a backup needs the primary size."""
    d = indices.groupBy(*keys).agg(F.count(F.lit(1)).alias("indices"), F.sum("store_size").alias("total_bytes"), F.sum("pri_store_size").alias("primary_bytes"))
    return d.withColumns({"total_gb": F.round(F.col("total_bytes") / GIB, 2), "primary_gb": F.round(F.col("primary_bytes") / GIB, 2), "backup_bytes": F.col("primary_bytes")})


def nodes_joined(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fewer nodes than before fails."""
    b = before.groupBy("cluster").agg(F.count(F.lit(1)).alias("expected"))
    a = after.groupBy("cluster").agg(F.count(F.lit(1)).alias("current"))
    d = b.join(a, "cluster", "left").withColumn("current", F.coalesce("current", F.lit(0)))
    return d.withColumn("status", _status(F.col("current") < F.col("expected"), F.lit(False)))


def readiness(checks: DataFrame, keys: Sequence[str] = ("cluster",)) -> DataFrame:
    """Checks by status, and ready when none failed and none was in error."""
    d = checks.groupBy(*keys).agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("passed", "warning", "failed", "error", "skipped")])
    return d.withColumn("ready", (F.col("failed") == 0) & (F.col("error") == 0))


def blockers(checks: DataFrame) -> DataFrame:
    """Checks that stand in the way."""
    return checks.where(F.col("status").isin("failed", "error"))


def recommendations(checks: DataFrame) -> DataFrame:
    """The distinct recommendations of all checks."""
    return checks.select("cluster", F.explode("recommendations").alias("recommendation")).distinct()
