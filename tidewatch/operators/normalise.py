"""Normalisation of logs and metric samples."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import as_map, literal_table, nested

# Spellings of log levels; any other text counts as info.
LEVELS = {
    "TRACE": "trace", "DEBUG": "debug", "INFO": "info", "WARN": "warn", "WARNING": "warn",
    "ERROR": "error", "ERR": "error", "FATAL": "fatal", "CRITICAL": "fatal", "CRIT": "fatal",
}
# Health-check messages, case-sensitive and unanchored.
HEALTH_PATTERN = "health.?check|healthcheck|ping"
# Second accepted form of an event time.
EVENT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"
# Attributes set on every resource, and metrics renamed or tagged.
RESOURCE_ATTRIBUTES = {
    "service.namespace": "observability", "deployment.environment": "production", "collector.name": "otel-collector",
    "environment": "production", "cluster": "observability-cluster",
}
RENAMED_METRICS = {
    "system.cpu.utilization": "cpu_utilization", "system.memory.utilization": "memory_utilization",
}
BYTE_METRICS = ("system.memory.usage",)
DROPPED_METRICS = (".*_bucket$",)
GEO_FIELDS = ("city_name", "country_name", "country_code2", "continent_code", "region_name")
ERROR_MESSAGE_LENGTH = 1000

# Agent rules: (pattern, browser, system, device), first match wins.
AGENT_RULES = (
    ("Windows NT", "Browser", "Windows", "desktop"),
    ("iPhone", "Mobile Browser", "iOS", "phone"),
    ("Android", "Mobile Browser", "Android", "phone"),
    ("Macintosh", "Browser", "macOS", "desktop"),
    ("^curl/", "curl", "Other", "tool"),
    ("^python-requests/", "python-requests", "Other", "tool"),
    ("^PostmanRuntime/", "Postman", "Other", "tool"),
    ("^Apache-HttpClient/", "Apache HttpClient", "Other", "tool"),
)


def lift_event_fields(df: DataFrame, event: str = "event") -> DataFrame:
    """Message, level, service and host move out of the event where present; its other fields stay.

    A service or host given as a struct contributes its name.
    """
    fields = {f.name: f.dataType for f in df.schema[event].dataType.fields}

    def text(name: str) -> Column:
        if name not in fields:
            return F.lit(None).cast("string")
        if isinstance(fields[name], T.StructType):
            return F.col(f"{event}.{name}.name").cast("string")
        return F.col(f"{event}.{name}").cast("string")

    def keep(column: str, lifted: Column) -> Column:
        return F.coalesce(lifted, F.col(column)) if column in df.columns else lifted

    out = df.withColumns({
        "message": keep("message", text("message")),
        "log_level": keep("log_level", text("level")),
        "service": F.struct(text("service").alias("name")),
        "host": F.struct(text("host").alias("name")),
    })
    moved = [c for c in ("message", "level", "service", "host") if c in fields]
    if len(moved) < len(fields):
        return out.withColumn(event, F.col(event).dropFields(*moved)) if moved else out
    return out.drop(event)


def parse_event_time(df: DataFrame, text: Sequence[str] | str = "timestamp", arrival: str = "arrival", out: str = "ts") -> DataFrame:
    """The first of the text columns that reads as ISO 8601 or in the second form; else the arrival time."""
    names = [text] if isinstance(text, str) else list(text)
    tries = []
    for n in names:
        tries += [F.try_to_timestamp(F.col(n)), F.try_to_timestamp(F.col(n), F.lit(EVENT_TIME_FORMAT))]
    return df.withColumn(out, F.coalesce(*tries, F.col(arrival)))


def add_ingest_time(df: DataFrame, now=None) -> DataFrame:
    """The ingest time in milliseconds; rows without an event time get the same. ``now`` defaults to the clock."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    at = F.timestamp_millis(F.unix_millis(at))
    out = df.withColumn("ingested_at", at)
    return out.withColumn("ts", F.coalesce("ts", at)) if "ts" in df.columns else out.withColumn("ts", at)


def normalise_level(level: Column) -> Column:
    """One of trace, debug, info, warn, error, fatal; null stays null."""
    known = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return F.when(level.isNotNull(), F.coalesce(known[F.upper(level)], F.lit("info")))


def drop_health_checks(df: DataFrame, message: str = "message", whole_word: bool = False) -> DataFrame:
    """Drop rows whose message matches the health pattern; a null message is kept."""
    pattern = rf"\b(?:{HEALTH_PATTERN})\b" if whole_word else HEALTH_PATTERN
    return df.where(~F.coalesce(F.col(message).rlike(pattern), F.lit(False)))


def ipv4_number(ip: Column) -> Column:
    """The address as BIGINT, null for anything that is not four numbers below 256."""
    parts = F.split(ip, r"\.")
    good = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    total = F.lit(0).cast("bigint")
    for i in range(4):
        total = total * 256 + F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(good, total)


BLOCK_BITS = 16


def _shift(way: str, value: Column, bits: Column) -> Column:
    return F.call_function(way, value, bits)


def _pieces(networks: DataFrame) -> DataFrame:
    """Aligned blocks of addresses (level, node), each with the smallest network that it is a part of; most networks are one block."""
    def halves(k: Column) -> Column:
        size = _shift("shiftleft", F.lit(1).cast("bigint"), k)
        low, high = F.ceil(F.col("start_ip") / size).cast("bigint"), F.floor((F.col("end_ip") + 1) / size).cast("bigint")
        both = F.array(F.when((low < high) & (low % 2 == 1), low), F.when((low < high) & (high % 2 == 1), high - 1))
        whole = F.when((k == 32) & (low < high), F.array(low))
        nodes = F.array_compact(F.coalesce(whole, both))
        return F.transform(nodes, lambda n: F.struct(k.alias("level"), n.alias("node")))

    levels = F.sequence(F.lit(0), F.lit(32))
    d = networks.withColumn("_p", F.explode(F.flatten(F.transform(levels, halves))))
    rank = F.struct((F.col("end_ip") - F.col("start_ip")).alias("size"), "start_ip", "geo")
    return d.groupBy(F.col("_p.level").alias("level"), F.col("_p.node").alias("node")).agg(F.min(rank).alias("best"))


def flat_networks(networks: DataFrame) -> DataFrame:
    """Networks (start_ip, end_ip, geo) as ranges that do not overlap, cut at /16 blocks: (block, start_ip, end_ip, geo).

    Where networks are nested or overlap the smallest holds an address, then the one that begins first. Networks become
    aligned blocks; who holds an address can change only where a block begins or ends, and at each such point the blocks
    around it, one of each of 33 sizes, are looked up by equality. A table of networks gives at most two ranges for each
    of its aligned blocks and one for each /16 block, however wide a network is.
    """
    pieces = _pieces(networks)
    size = _shift("shiftleft", F.lit(1).cast("bigint"), F.col("level"))
    ends = F.explode(F.array(F.col("node") * size, (F.col("node") + 1) * size))
    points = pieces.select(ends.alias("at")).distinct()
    # a range ends with its /16 block; blocks without points are added below, where one range spans them
    around = points.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(32)))).select(
        "at", F.col("_k").alias("level"), _shift("shiftright", F.col("at"), F.col("_k")).alias("node"))
    held = points.join(around.join(pieces, ["level", "node"]).groupBy("at").agg(F.min("best").alias("best")), "at", "left")
    held = held.select("at", F.col("best.geo").alias("geo"), F.shiftright("at", BLOCK_BITS).alias("block"))
    inside = Window.partitionBy("block").orderBy("at")
    held = held.withColumn("_next", F.lead("at").over(inside))
    # one row a block, of which there are 65,536 and one at most
    firsts = held.groupBy("block").agg(F.min("at").alias("first")).withColumn("_after", F.lead("first").over(Window.orderBy("block")))
    held = held.join(firsts.drop("first"), "block").withColumn("_end", F.coalesce("_next", "_after")).where("_end IS NOT NULL AND geo IS NOT NULL")
    span = F.sequence(F.col("block"), F.shiftright(F.col("_end") - 1, BLOCK_BITS))
    held = held.select("at", "_end", "geo", F.explode(span).alias("block"))
    low = F.shiftleft(F.col("block"), BLOCK_BITS)
    return held.select("block", F.greatest("at", low).alias("start_ip"), (F.least(F.col("_end"), low + (1 << BLOCK_BITS)) - 1).alias("end_ip"), "geo")


def geoip_enrich(df: DataFrame, networks: DataFrame, ip: str = "client_ip") -> DataFrame:
    """City, country, continent, region and location of the smallest network that holds the address.

    Networks are made flat first (``flat_networks``), so every row comes out once. The range join is an equi-join on the
    /16 block with a range filter; it needs no small side, and a hot block is split by the adaptive skew join.
    """
    geo = F.struct(*GEO_FIELDS, F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).alias("location"))
    nets = flat_networks(networks.select("start_ip", "end_ip", geo.alias("geo")).where("start_ip <= end_ip"))
    nets = nets.select(F.col("block").alias("_block"), "start_ip", "end_ip", "geo")
    d = df.withColumn("_ip", ipv4_number(F.col(ip))).withColumn("_b", F.shiftright("_ip", BLOCK_BITS))
    hit = (F.col("_b") == F.col("_block")) & F.col("_ip").between(F.col("start_ip"), F.col("end_ip"))
    return d.join(nets, hit, "left").drop("_ip", "_b", "_block", "start_ip", "end_ip")


def user_agent_enrich(df: DataFrame, rules: Sequence[tuple] = AGENT_RULES, agent: str = "user_agent") -> DataFrame:
    """Browser, system and device class by the first matching rule. Rules become one expression: no shuffle."""
    def row(browser, system, device):
        return F.struct(F.lit(browser).alias("browser"), F.lit(system).alias("os"), F.lit(device).alias("device"))

    found = F.lit(None)
    for pattern, *rest in reversed(list(rules)):
        found = F.when(F.col(agent).rlike(pattern), row(*rest)).otherwise(found)
    return df.withColumn("agent", F.when(F.col(agent).isNotNull(), F.coalesce(found, row("Other", "Other", "other"))))


def lift_kafka_metadata(df: DataFrame) -> DataFrame:
    """Topic, partition, offset and broker time as one struct, for rows tagged kafka."""
    meta = F.struct("topic", "partition", "offset", F.col("broker_time").alias("timestamp"))
    return df.withColumn("kafka", F.when(F.array_contains("tags", "kafka"), meta)).drop(
        "topic", "partition", "offset", "broker_time")


def stamp_static_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Constant columns; the event remainder and the document version are dropped."""
    return df.withColumns({k: F.lit(v) for k, v in fields.items()}).drop("event", "@version")


def annotate_dead_letters(df: DataFrame, now=None) -> DataFrame:
    """Reason, plugin, entry and processing time in one struct beside the untouched original."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return df.withColumn(
        "dlq", F.struct("reason", "plugin_type", "plugin_id", "entry_time", at.alias("processed_at"))
    ).drop("reason", "plugin_type", "plugin_id", "entry_time")


def upsert_attributes(df: DataFrame, attrs: dict[str, str] = RESOURCE_ATTRIBUTES, column: str = "attributes") -> DataFrame:
    """Insert or overwrite map entries."""
    names = list(attrs)
    kept = F.map_filter(F.col(column), lambda k, _: ~k.isin(names))
    return df.withColumn(column, F.map_concat(kept, as_map(attrs)))


def drop_metrics_by_name(df: DataFrame, patterns: Sequence[str] = DROPPED_METRICS) -> DataFrame:
    """Drop samples whose metric name fully matches one of the patterns."""
    return df.where(~F.col("metric").rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"))


def tag_metric_units(df: DataFrame, now=None) -> DataFrame:
    """unit=bytes for byte metrics; adds the processing time."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    rest = F.map_filter("labels", lambda k, _: k != "unit")
    tagged = F.when(F.col("metric").isin(*BYTE_METRICS), F.map_concat(rest, as_map({"unit": "bytes"}))).otherwise(F.col("labels"))
    return df.withColumns({"labels": tagged, "processed_at": at})


def rename_metrics(df: DataFrame, mapping: dict[str, str] = RENAMED_METRICS) -> DataFrame:
    """New names for some metrics."""
    return df.withColumn("metric", F.coalesce(as_map(mapping)[F.col("metric")], F.col("metric")))


def sample_traces(df: DataFrame, pct: float, trace: str = "trace_id", hashing: str = "xxhash64") -> DataFrame:
    """Keep ``pct`` per cent of traces, each whole or not at all; ``md5`` is the form other engines can repeat."""
    if hashing == "md5":
        bucket = F.conv(F.substring(F.md5(F.col(trace)), 1, 8), 16, 10).cast("bigint") % 10000
    else:
        bucket = F.pmod(F.xxhash64(trace), F.lit(10000))
    return df.where(bucket < F.lit(pct * 100))


def map_bean_names(df: DataFrame, rules: Sequence[tuple], allowed: Sequence[str], bean: str = "bean") -> DataFrame:
    """Bean text to metric name, kind and labels; first rule wins, unknown or not allowed beans drop.

    Rules are (pattern, name, kind, labels); $1 and $2 stand for groups. They run on distinct beans only, and the
    result is joined back: beans are few next to samples, and the join picks its strategy from measured sizes.
    """
    number = F.coalesce(*[F.when(F.col(bean).rlike(rule[0]), F.lit(i)) for i, rule in enumerate(rules)])
    table = literal_table(df.sparkSession, [(i, p, name, kind, [k.lower() for k in labels], list(labels.values()), re.compile(p).groups)
         for i, (p, name, kind, labels) in enumerate(rules)],
        "_i int, pattern string, name string, kind string, keys array<string>, vals array<string>, groups int",
    )

    def group(n: int) -> Column:
        value = F.call_function("regexp_extract", F.col(bean), F.col("pattern"), F.lit(n))
        return F.when(F.col("groups") >= n, value).otherwise(F.lit(""))

    def fill(template: Column) -> Column:
        return F.replace(F.replace(template, F.lit("$1"), F.col("_1")), F.lit("$2"), F.col("_2"))

    domain = F.substring_index(F.col(bean), "<", 1)
    names = (
        df.select(bean).distinct().where(domain.isin(*allowed)).withColumn("_i", number).where("_i IS NOT NULL")
        .join(F.broadcast(table), "_i").withColumns({"_1": group(1), "_2": group(2)})
        .select(bean, F.lower(fill(F.col("name"))).alias("metric"), "kind",
                F.map_from_arrays("keys", F.transform("vals", fill)).alias("labels"))
    )
    return df.join(names, bean).drop(bean)


def _without(labels: Column, name: str) -> Column:
    return F.map_filter(labels, lambda k, _: k != name)


def relabel(samples: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Ordered (source label, pattern, replacement, target label) rules over the label map.

    The pattern is anchored on both ends; without a match the labels stay as they are; an empty result removes the
    target. A rule without a source sets a constant.
    """
    labels = F.col("labels")
    for source, pattern, replacement, target in rules:
        anchored = f"^(?:{pattern})$"
        value = F.coalesce(labels[source], F.lit("")) if source else F.lit("")
        new = F.regexp_replace(value, anchored, replacement) if source else F.lit(replacement)
        rest = _without(labels, target)
        put = F.when(new == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(target), new)))
        labels = F.when(value.rlike(anchored), put).otherwise(labels) if source else put
    return samples.withColumn("labels", labels)


def top_n_processes(df: DataFrame, n: int = 5) -> DataFrame:
    """Per host and tick the processes that are among the top n by CPU or by memory, each once."""
    w = Window.partitionBy("host", "ts")
    return df.withColumns({
        "cpu_rank": F.row_number().over(w.orderBy(F.desc("cpu"), "pid")),
        "memory_rank": F.row_number().over(w.orderBy(F.desc("memory"), "pid")),
    }).where(F.least("cpu_rank", "memory_rank") <= n)


def to_document(df: DataFrame, columns: Sequence[str] | None = None, error_message: str = "error.message") -> DataFrame:
    """One JSON text per row without null fields; the error message is cut to 1000 characters."""
    outer, _, inner = error_message.partition(".")
    d = df
    if outer in df.columns:
        cut = F.substring(F.col(error_message), 1, ERROR_MESSAGE_LENGTH)
        d = d.withColumn(outer, F.col(outer).withField(inner, cut) if inner else cut)
    return d.select(F.to_json(F.struct(*(columns or d.columns)), {"ignoreNullFields": "true"}).alias("document"))


def nested_value(df: DataFrame, path: str) -> Column:
    """Value at a dotted path of structs, maps or JSON text; null when a part is missing."""
    return nested(df, path)
