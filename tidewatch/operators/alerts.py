"""Alerts from breach to receiver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import as_map, literal_table
from tidewatch.functions.pointers import next_at, reached, written
from tidewatch.functions.slices import SLICE, asof_join, carry, neighbour, null_safe_join, running_totals, slice_of, within
from tidewatch.operators.recording import Alert
from tidewatch.operators.samples import series_key

RESOLVE_SECONDS = 300
COOLDOWN_MINUTES = 15
CATEGORIES = ("technical", "cognitive", "finops", "devops", "compliance")
SEVERITIES = ("info", "warning", "critical")
# Where alerts of each severity go; another severity goes where warnings go.
CHANNELS = {
    "slack": {"critical": ["#ai-alerts-critical"], "warning": ["#ai-alerts-warning"], "info": ["#ai-alerts-info"]},
    "email": {"critical": ["ops-team@example.com", "ai-team@example.com"], "warning": ["ai-team@example.com"]},
}
# Conditions on a metrics row: name, condition, severity, cooldown in minutes.
METRIC_RULES = (
    ("High Latency", "p95_latency > 5000", "warning", 15),
    ("Critical Error Rate", "error_rate > 5", "critical", 5),
    ("Budget Exceeded", "daily_cost > daily_budget", "critical", 60),
    ("Hallucination Detected", "hallucination_confidence > 0.9", "warning", 0),
    ("Compliance Violation", "compliance_violation == true", "critical", 0),
)


def hold_for(breaches: DataFrame, holds: DataFrame, step: int, seconds: int = 86400) -> DataFrame:
    """A2: pending until a series has been broken at every grid point for its hold time, then firing.

    ``holds`` has (alertname, hold) in seconds, a row per rule. A missing grid point starts anew. A series is ordered
    inside slices of ``seconds``; the last start of a run travels from slice to slice.
    """
    keys = ["alertname", "key"]
    d = breaches.withColumns({"key": series_key(F.col("labels")), "_s": F.unix_seconds("t")})
    d = neighbour(d, keys, "t", ["t"], F.col("_s"), "_before", seconds)
    begins = F.col("_before").isNull() | (F.col("_s") - F.col("_before") > step)
    d = d.withColumns({"_start": F.when(begins, F.col("_s")), SLICE: slice_of(F.col("t"), seconds)})
    d = carry(d, keys, {"_last": F.max("_start")}, lambda w: {"_earlier": F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    here = F.max("_start").over(within(keys, ["t"]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_since", F.coalesce(here, "_earlier")).join(holds, "alertname")
    return d.select(
        *breaches.columns, F.timestamp_seconds("_since").alias("since"),
        F.when(F.col("_s") - F.col("_since") >= F.col("hold"), "firing").otherwise("pending").alias("state"))


def rules_frame(spark: SparkSession, alerts: Sequence[Alert]) -> DataFrame:
    """The alert rules as a table: one row per rule, so as small as the rule list."""
    def tokens(text: str) -> list[tuple[str, str]]:
        out = []
        for i, part in enumerate(text.replace("}}", "{{").split("{{")):
            inner = part.strip()
            if i % 2 == 0:
                out.append(("text", part))
            elif inner.startswith("$labels."):
                out.append(("label", inner[len("$labels."):]))
            else:
                form = inner.partition("|")[2].strip()
                out.append(({"humanizePercentage": "percent", "humanizeDuration": "time"}.get(form, "value"), ""))
        return out

    rows = [(a.name, a.hold, a.severity, a.service, a.category, tokens(a.summary), tokens(a.description)) for a in alerts]
    token = "array<struct<kind string, text string>>"
    return literal_table(spark, rows, f"alertname string, hold int, severity string, service string, category string, summary_tokens {token}, description_tokens {token}")


def _four_digits(x: Column) -> Column:
    """The number with four significant digits, without trailing zeros."""
    scale = F.pow(F.lit(10.0), F.lit(3) - F.floor(F.log10(F.abs(x))))
    text = F.when(x == 0, "0").otherwise((F.round(x * scale) / scale).cast("string"))
    return F.regexp_replace(text, r"\.0$", "")


def _duration(x: Column) -> Column:
    s = F.floor(F.abs(x)).cast("bigint")
    sign = F.when(x < 0, "-").otherwise("")
    day, hour, minute, sec = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60
    return (
        F.when(F.abs(x) < 1, F.concat(_four_digits(x * 1000), F.lit("ms"))).when(s < 60, F.concat(_four_digits(x), F.lit("s")))
        .when(s < 3600, F.concat(sign, F.format_string("%dm %ds", minute, sec)))
        .when(s < 86400, F.concat(sign, F.format_string("%dh %dm %ds", hour, minute, sec)))
        .otherwise(F.concat(sign, F.format_string("%dd %dh %dm %ds", day, hour, minute, sec)))
    )


def label_alerts(firing: DataFrame, rules: DataFrame) -> DataFrame:
    """A3: severity, service and category of the rule; summary and description with labels and value filled in."""
    v = F.col("value")
    d = firing.join(rules, "alertname").withColumns({
        "_value": F.regexp_replace(v.cast("string"), r"\.0$", ""), "_percent": F.concat(_four_digits(v * 100), F.lit("%")), "_time": _duration(v)})

    def fill(tokens: str) -> Column:
        parts = F.transform(tokens, lambda k: (
            F.when(k["kind"] == "text", k["text"]).when(k["kind"] == "label", F.coalesce(F.col("labels")[k["text"]], F.lit("")))
            .when(k["kind"] == "percent", F.col("_percent")).when(k["kind"] == "time", F.col("_time")).otherwise(F.col("_value"))))
        return F.array_join(parts, "")

    return d.withColumns({"summary": fill("summary_tokens"), "description": fill("description_tokens")}).drop(
        "summary_tokens", "description_tokens", "_value", "_percent", "_time", "hold")


@dataclass(frozen=True)
class Route:
    """A node of the routing tree; unset fields come from the parent."""

    receiver: str | None = None
    match: tuple[tuple[str, str], ...] = ()
    group_by: tuple[str, ...] | None = None
    group_wait: int | None = None
    group_interval: int | None = None
    repeat_interval: int | None = None
    go_on: bool = False
    routes: tuple["Route", ...] = ()


# The routing tree; times in seconds.
ROUTES = Route("default-receiver", group_by=("alertname", "cluster", "service"), group_wait=30, group_interval=300, repeat_interval=14400, routes=(
    Route("critical-receiver", (("severity", "critical"),), group_wait=10, group_interval=60, repeat_interval=3600, go_on=True),
    Route("elasticsearch-receiver", (("service", "elasticsearch"),), group_by=("alertname", "node", "category"), routes=(
        Route("elasticsearch-critical", (("category", "cluster"),), group_wait=10),
        Route("elasticsearch-receiver", (("category", "jvm"),)),
        Route("elasticsearch-disk", (("category", "disk"),)),
    )),
    Route("slo-receiver", (("category", "slo"),), group_by=("alertname",), repeat_interval=7200),
    Route("ssl-receiver", (("category", "ssl"),), group_by=("alertname", "instance"), repeat_interval=86400),
))

# Inhibition: source, target (exact), target (patterns), labels that must agree.
INHIBITIONS = (
    ({"alertname": "ElasticsearchClusterRed"}, {"alertname": "ElasticsearchClusterYellow"}, {}, ("cluster",)),
    ({"alertname": "ElasticsearchNodeDown"}, {}, {"alertname": "Elasticsearch.*", "category": "(jvm|performance|disk)"}, ("cluster",)),
    ({"alertname": "EndpointDown"}, {"alertname": "EndpointSlowResponse"}, {}, ("instance",)),
    ({"severity": "critical"}, {"severity": "warning"}, {}, ("alertname", "service")),
)


def all_labels() -> Column:
    """Labels of an alert together with the ones that its rule gave it."""
    own = F.create_map(*[x for c in ("alertname", "severity", "service", "category") for x in (F.lit(c), F.coalesce(F.col(c), F.lit("")))])
    return F.map_concat(F.map_filter("labels", lambda k, _: ~k.isin("alertname", "severity", "service", "category")), own)


def _matches(labels: Column, wanted) -> Column:
    ok = F.lit(True)
    for k, v in dict(wanted).items():
        ok = ok & (F.coalesce(labels[k], F.lit("")) == v)
    return ok


def _receivers(node: Route, parent: Route, labels: Column) -> Column:
    """The receivers that a matching alert reaches below ``node``: the children in order, else the node itself."""
    def inherit(field):
        own = getattr(node, field)
        return getattr(parent, field) if own is None else own

    here = Route(inherit("receiver"), node.match, inherit("group_by"), inherit("group_wait"), inherit("group_interval"), inherit("repeat_interval"))
    own = F.array(F.struct(
        F.lit(here.receiver).alias("receiver"), F.array(*[F.lit(g) for g in here.group_by]).alias("group_by"), F.lit(here.group_wait).alias("group_wait"),
        F.lit(here.group_interval).alias("group_interval"), F.lit(here.repeat_interval).alias("repeat_interval")))
    if not node.routes:
        return own
    found, stopped, parts = F.lit(False), F.lit(False), []
    for child in node.routes:
        hit = ~stopped & _matches(labels, child.match)
        below = _receivers(child, here, labels)
        parts.append(F.when(hit, below).otherwise(F.filter(below, lambda _: F.lit(False))))
        found = found | hit
        if not child.go_on:
            stopped = stopped | hit
    return F.when(found, F.flatten(F.array(*parts))).otherwise(own)


def route_alerts(alerts: DataFrame, tree: Route = ROUTES) -> DataFrame:
    """A4: one row per alert and receiver, with the grouping and timing of the route."""
    r = F.explode(_receivers(tree, tree, all_labels()))
    return alerts.withColumn("_r", r).select("*", "_r.*").drop("_r")


def inhibit(alerts: DataFrame, rules: Sequence[tuple] = INHIBITIONS) -> DataFrame:
    """A5: drop each target for which a source fires at the same time with equal labels; all rules see all alerts."""
    d = alerts.withColumn("_all", all_labels())
    out = d
    for source, exact, patterns, equal in rules:
        labels = F.col("_all")
        target = _matches(labels, exact)
        for k, p in patterns.items():
            target = target & F.coalesce(labels[k], F.lit("")).rlike(f"^(?:{p})$")
        keys = [F.coalesce(labels[e], F.lit("")).alias(f"_e{i}") for i, e in enumerate(equal)]
        sources = d.where(_matches(labels, source)).select(F.col("t").alias("_t"), *keys).distinct()
        cond = target & (F.col("t") == F.col("_t"))
        for i, e in enumerate(equal):
            cond = cond & (F.coalesce(labels[e], F.lit("")) == F.col(f"_e{i}"))
        out = out.join(sources, cond, "left_anti")
    return out.drop("_all")


def with_group(routed: DataFrame) -> DataFrame:
    """Routed alerts with the text that names their group."""
    labels = all_labels()
    pairs = F.transform("group_by", lambda g: F.concat(g, F.lit("="), F.coalesce(labels[g], F.lit(""))))
    return routed.withColumn("group_key", F.array_join(pairs, ","))


def group_alerts(routed: DataFrame) -> DataFrame:
    """One notice per receiver, group and time: number of alerts, worst severity, and a fingerprint of the members.

    Members stay rows (``with_group``); a notice does not carry a list that could be as long as the fleet is large.
    """
    d = with_group(routed)
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return d.groupBy("receiver", "group_key", "t", "group_wait", "group_interval", "repeat_interval").agg(
        F.count(F.lit(1)).alias("alerts"), F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.max(rank).cast("int")).alias("severity"),
        F.bit_xor(F.xxhash64("alertname", series_key(F.col("labels")))).alias("fingerprint"))


def notices_of_group(rows, step: int):
    """Flush times of one group, one after the other: (time, reason, alerts), for tests and single groups.

    ``rows`` are (second, alerts, fingerprint, wait, interval, repeat) in order. The first flush comes a wait after the
    group appears, later ones every interval. A flush sends when the members changed, or when the last notice is older
    than the repeat time. A group without alerts sends its end and vanishes.
    """
    out, i, n = [], 0, len(rows)
    while i < n:
        start, _, _, wait, interval, repeat = rows[i]
        at, sent, last = start + wait, None, None
        while True:
            while i + 1 < n and rows[i + 1][0] <= at:
                i += 1
            second, count, mark = rows[i][:3]
            if at - second >= step:
                if last is not None:
                    out.append((at, "resolved", 0))
                break
            if last is None:
                out.append((at, "first", count))
                sent, last = mark, at
            elif mark != sent:
                out.append((at, "change", count))
                sent, last = mark, at
            elif at - last >= repeat:
                out.append((at, "repeat", count))
                last = at
            at += interval
        i += 1
    return out


def _appearances(d: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """(keys, at): when groups appear, first or after they have vanished; d has s, _prev, wait and interval.

    A group vanishes at a flush that finds no alert. Where it is silent long enough for a flush whatever its phase, it
    surely has; in a shorter silence that depends on when it appeared before. So each row after a silence points to the
    first one after it before which a flush of its phase falls, and the appearances are what pointers lead to.
    """
    s, prev, wait, interval = (F.col(c) for c in ("s", "_prev", "wait", "interval"))
    heads = d.where(prev.isNull() | (s - prev > step)).select(
        *keys, "s", "_prev", "wait", "interval", F.pmod(s + wait, interval).alias("phase"),
        (prev.isNull() | (s - prev - F.greatest(wait, F.lit(step)) >= interval)).alias("sure"), s.alias("at"))
    heads = written(heads, "heads")
    sure = heads.where("sure").select(*keys, "at")
    if heads.where("NOT sure").isEmpty():
        return sure
    # the last flush of each phase of the group before a silence ends; a group has no more phases than seconds in its interval
    phases = heads.select(*keys, "phase").distinct()
    gaps = null_safe_join(heads.where("_prev IS NOT NULL").drop("phase"), phases, keys)
    flush = s - 1 - F.pmod(s - 1 - F.col("phase"), interval)
    hits = gaps.withColumn("flush", flush).where(F.col("flush") >= prev + step)
    micros = F.lit(1_000_000)
    ahead = next_at(heads.select(*keys, "phase", "at", "wait"), (F.col("at") + F.col("wait")) * micros, hits, [*keys, "phase"], F.col("flush") * micros, "to", s)
    return reached(ahead, sure, keys)


def notification_times(groups: DataFrame, step: int, seconds: int = 86400) -> DataFrame:
    """When each group notifies: (receiver, group_key, t, reason, alerts).

    A group has at most one row per grid point, and its timing is that of its receiver. A flush comes a wait after the
    group appears, then every interval. It sends ``first``, ``change`` when the members differ from those sent last,
    ``repeat`` when the last notice is as old as the repeat time; one that finds no alert sends ``resolved``, and the
    group vanishes. Flushes are numbered from an appearance on, so what each sends follows from the row before it that a
    flush has seen and from the last change; no history is walked through, and one is ordered only in slices.
    """
    keys = ["receiver", "group_key"]
    d = groups.select(
        *keys, "t", F.unix_seconds("t").alias("s"), "alerts", "fingerprint", *[F.col(f"group_{c}").cast("bigint").alias(c) for c in ("wait", "interval")],
        F.col("repeat_interval").cast("bigint").alias("repeat"))
    d = written(neighbour(written(d, "groups"), keys, "t", ["t"], F.col("s"), "_prev", seconds), "groups")
    found = _appearances(d, keys, step).select(*keys, F.timestamp_seconds("at").alias("t"), F.col("at").alias("start"))
    d = written(asof_join(d, found, keys, "t", ["start"], seconds=seconds), "groups")
    d = neighbour(d, keys, "t", ["t"], F.struct("s", "start"), "_next", seconds, following=True)
    s, start, wait, interval = (F.col(c) for c in ("s", "start", "wait", "interval"))
    ends = F.col("_next").isNull() | (F.col("_next.start") != start)
    until = F.when(ends, s + step).otherwise(F.col("_next.s"))
    number = lambda at: F.greatest(F.ceil((at - start - wait) / interval), F.lit(0)).cast("bigint")
    time = lambda k: start + wait + k * interval
    d = d.withColumns({"k": number(s), "ends": ends, "until": until})
    d = d.withColumns({"seen": time(F.col("k")) < F.col("until"), "k_to": F.floor((F.col("until") - 1 - start - wait) / interval)})
    d = written(d, "flushes")
    seen = d.where("seen").select(*keys, "t", "start", "k", "fingerprint")
    seen = neighbour(seen, keys, "t", ["t"], F.struct("start", "fingerprint"), "_was", seconds)
    fresh = F.col("_was").isNull() | (F.col("_was.start") != F.col("start"))
    sends = seen.where(fresh | (F.col("_was.fingerprint") != F.col("fingerprint")))
    sent = sends.select(*keys, "t", F.struct("start", "k", F.when(fresh, "first").otherwise("change").alias("reason")).alias("_sent"))
    d = asof_join(d, sent, keys, "t", ["_sent"], seconds=seconds)
    k, last, k_to = F.col("k"), F.col("_sent.k"), F.col("k_to")
    live = F.coalesce(F.col("_sent.start") == start, F.lit(False))
    every = F.greatest(F.ceil(F.col("repeat") / interval), F.lit(1)).cast("bigint")
    low, high = F.greatest(F.ceil((k - last) / every), F.lit(1)).cast("bigint"), F.floor((k_to - last) / every).cast("bigint")
    one = lambda at, reason, alerts: F.struct(at.alias("at"), reason.alias("reason"), alerts.cast("bigint").alias("alerts"))
    notices = F.array(
        F.when(F.col("seen") & live & (k == last), one(time(k), F.col("_sent.reason"), F.col("alerts"))),
        F.when(F.col("ends") & live, one(time(number(s + step)), F.lit("resolved"), F.lit(0))))
    repeats = F.when(F.col("seen") & live & (low <= high), F.transform(
        F.sequence(low, F.greatest(low, high)), lambda j: one(time(last + j * every), F.lit("repeat"), F.col("alerts"))))
    none = F.filter(notices, lambda _: F.lit(False))
    d = d.withColumn("_n", F.explode(F.concat(F.filter(notices, lambda x: x.isNotNull()), F.coalesce(repeats, none))))
    return d.select(*keys, F.timestamp_seconds("_n.at").alias("t"), F.col("_n.reason").alias("reason"), F.col("_n.alerts").alias("alerts"))


def auto_resolve(alerts: DataFrame, as_of, seconds: int = RESOLVE_SECONDS) -> DataFrame:
    """The time at which each alert counts as resolved: not seen again within the time limit."""
    d = alerts.select("t", "alertname", "labels").withColumn("key", series_key(F.col("labels")))
    d = neighbour(d, ["alertname", "key"], "t", ["t"], F.col("t"), "_next", 86400, following=True)
    end = F.coalesce(F.col("_next"), F.lit(as_of).cast("timestamp"))
    gap = F.unix_micros(end) - F.unix_micros("t")
    d = d.where(gap > seconds * 1_000_000)
    return d.select("alertname", "labels", F.col("t").alias("last_seen"), (F.col("t") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("resolved_at"))


def _two_places(x: Column) -> Column:
    """The number with two decimals, rounded by its exact binary value, ties to even, as JSON and C formats do.

    Below one a double has whole 2^-53ths and perhaps a rest, so hundredths are counted in whole numbers. Beyond 1e13 the
    JVM's own format, which rounds the shortest digits, has to do.
    """
    x = x.cast("double")
    whole = F.floor(F.abs(x))
    part = (F.abs(x) - whole) * F.lit(float(2**53))
    below = (part - F.floor(part)) * 100
    units = F.floor(part) * 100 + F.floor(below)
    cents, rest = F.shiftright(units, 53), units.bitwiseAND(2**53 - 1)
    half = F.lit(2**52)
    up = (rest > half) | ((rest == half) & ((below > F.floor(below)) | (cents % 2 == 1)))
    cents = whole * 100 + cents + F.when(up, 1).otherwise(0)
    text = F.concat(F.when(x < 0, "-").otherwise(""), ((cents - cents % 100) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(F.abs(x) < 1e13, text).otherwise(F.format_string("%.2f", x))


def _title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def _number(text: Column) -> Column:
    """A number written with an exponent, in the form that JSON texts of details have: plain from 1e-4 to 1e16."""
    power = F.substring_index(text, "E", -1).try_cast("int")
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    short = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    sign = F.when(power < 0, "-").otherwise("+")
    return F.when(power.between(-4, 15), plain).otherwise(F.concat(short, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0"))))


def _unicode(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _ascii(text: Column) -> Column:
    """The text with every character beyond ASCII as its JSON escape; two escapes beyond the first plane."""
    def one(ch):
        code = F.ascii(ch)
        beyond = code - 65536
        pair = F.concat(_unicode(F.lit(55296) + F.shiftright(beyond, 10)), _unicode(F.lit(56320) + beyond.bitwiseAND(1023)))
        return F.when(code < 128, ch).when(code < 65536, _unicode(code)).otherwise(pair)
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def json_value(c: Column) -> Column:
    """A plain value as JSON: numbers and booleans bare, texts quoted and escaped; null for null."""
    whole = F.to_json(F.struct(c.alias("v")))
    text = F.when(c.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))
    return F.when(text.rlike(r"^-?[0-9.]+E-?[0-9]+$"), _number(text)).otherwise(_ascii(text))


def _details(**cols: Column) -> Column:
    """Name to value as JSON text; what is null is left out."""
    pairs = [x for k in sorted(cols) for x in (F.lit(k), json_value(cols[k]))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def violations_to_alerts(technical: DataFrame, finops: DataFrame, compliance: DataFrame, entity: Sequence[str] = ("provider", "model")) -> DataFrame:
    """Violations of all three kinds as alerts: (ts, name, category, severity, message, details, entity)."""
    def out(df, ts, prefix, category, critical, message, details, who):
        return df.select(
            ts.alias("ts"), F.concat(F.lit(prefix), _title(F.col("type"))).alias("name"), F.lit(category).alias("category"),
            F.when(critical, "critical").otherwise("warning").alias("severity"), message.alias("message"), details.alias("details"), who.alias("entity"))

    sev = F.col("severity")
    t = out(
        technical, F.col("window_start"), "Technical: ", "technical", sev == "critical",
        F.concat(F.lit("Threshold exceeded: "), _two_places(F.col("value")), F.lit(" > "), _two_places(F.col("threshold"))),
        _details(type=F.col("type"), value=F.col("value"), threshold=F.col("threshold"), severity=sev), F.concat_ws("/", *entity))
    f = out(
        finops, F.col("day").cast("timestamp"), "FinOps: ", "finops", sev == "critical", F.coalesce("message", F.lit("Budget threshold reached")),
        _details(type=F.col("type"), threshold=F.col("threshold"), spent=F.col("spent"), budget=F.col("budget"), severity=sev), F.lit("daily"))
    c = out(
        compliance, F.col("ts"), "Compliance: ", "compliance", sev == "high", F.concat(F.lit("Compliance violation detected: "), "type"),
        _details(type=F.col("type"), severity=sev, request_id=F.col("request_id").cast("string"), detail=F.col("detail")), F.coalesce(F.col("detail"), F.lit("")))
    return t.unionByName(f).unionByName(c)


def dedup_key() -> Column:
    """A10: first 16 hex characters of MD5 over name:category:details, the details (JSON values) as JSON sorted by key."""
    pairs = F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(json_value(e["key"]), F.lit(": "), e["value"]))
    text = F.concat(F.col("name"), F.lit(":"), F.col("category"), F.lit(":{"), F.array_join(pairs, ", "), F.lit("}"))
    return F.substring(F.md5(text), 1, 16)


def stable_key() -> Column:
    """The key without measured values: name, category and entity, so that repeats of an alert share it."""
    return F.substring(F.md5(F.concat_ws(":", "name", "category", "entity")), 1, 16)


def suppress_cooldown(alerts: DataFrame, key: Column | None = None, minutes: int = COOLDOWN_MINUTES, ts: str = "ts") -> DataFrame:
    """Accepted is true for alerts at least ``minutes`` after the last accepted one of their key.

    Times of a key are reduced to distinct ones before the shuffle. A time points to the first one a cooldown later; one
    that follows a gap of the cooldown is accepted whatever came before, and so is all that pointers lead to from there.
    An alert without a time is not accepted.
    """
    cool = minutes * 60 * 1_000_000
    d = alerts.withColumns({"_key": stable_key() if key is None else key, "_us": F.unix_micros(ts)})
    times = written(d.where("_us IS NOT NULL").select("_key", ts, F.col("_us").alias("at")).distinct(), "times")
    times = written(neighbour(times, ["_key"], ts, ["at"], F.col("at"), "_prev", max(3600, minutes * 60)), "times")
    sure = times.where(F.col("_prev").isNull() | (F.col("at") - F.col("_prev") >= cool)).select("_key", "at")
    times = times.select("_key", "at")
    taken = reached(next_at(times, F.col("at") + cool, times, ["_key"], F.col("at"), "to"), sure, ["_key"])
    hits = taken.select(F.col("_key").alias("_k"), F.col("at").alias("_u"))
    out = d.join(hits, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_us") == F.col("_u")), "left")
    return out.withColumns({"dedup_key": F.col("_key"), "accepted": F.col("_u").isNotNull()}).drop("_key", "_us", "_k", "_u")


def touch_active(alerts: DataFrame, closed: DataFrame, key: Column | None = None, minutes: int = COOLDOWN_MINUTES, ts: str = "ts") -> DataFrame:
    """A11 with alerts that stay active: adds dedup_key and outcome, one of created, updated and skipped.

    An alert within the cooldown of the last one created of its key is skipped. Later ones only update that one while
    it is active; ``closed`` (dedup_key, at) says when an alert of a key stopped being active, be it acknowledged or
    resolved. So after one is created the next is the first that comes a cooldown later and not before the next closing:
    each time points there, and from the first time of a key on, all that pointers lead to are created.
    """
    cool = minutes * 60 * 1_000_000
    d = alerts.withColumn("dedup_key", stable_key() if key is None else key)
    keys = ["dedup_key"]
    times = written(d.where(F.col(ts).isNotNull()).select("dedup_key", F.unix_micros(ts).alias("at")).distinct(), "times")
    ends = closed.where("at IS NOT NULL").select("dedup_key", F.unix_micros("at").alias("end")).distinct()
    closing = next_at(times, F.col("at") + 1, ends, keys, F.col("end"), "_end").where("_end IS NOT NULL")
    ahead = next_at(closing, F.greatest(F.col("at") + cool, F.col("_end")), times, keys, F.col("at"), "to")
    made = reached(ahead, times.groupBy("dedup_key").agg(F.min("at").alias("at")), keys)
    made = made.select("dedup_key", F.timestamp_micros("at").alias(ts), F.col("at").alias("_made"))
    found = asof_join(d, made, keys, ts, ["_made"])
    age = F.unix_micros(ts) - F.col("_made")
    return found.withColumn("outcome", F.when(age == 0, "created").when(age >= cool, "updated").otherwise("skipped")).drop("_made")


def assign_alert_ids(alerts: DataFrame, order: Sequence[str] = ("ts", "dedup_key"), ts: str = "ts") -> DataFrame:
    """ALT-YYYYMMDD-00001, counted per day in order."""
    d = alerts.withColumn("_day", F.to_date(ts))
    d = running_totals(d, ["_day"], ts, order, {"_no": F.lit(1).cast("bigint")}, 3600)
    return d.withColumn("id", F.concat(F.lit("ALT-"), F.date_format("_day", "yyyyMMdd"), F.lit("-"), F.format_string("%05d", "_no"))).drop("_day", "_no")


def apply_alert_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Acknowledge (by, at) and resolve (at) by id; unknown ids are ignored, and nothing reopens a resolved alert."""
    def last(kind, value):
        return F.max_by(value, F.when(F.col("action") == kind, F.col("at")))
    a = actions.groupBy("id").agg(
        last("acknowledge", F.col("by")).alias("acknowledged_by"), last("acknowledge", F.col("at")).alias("acknowledged_at"),
        F.min(F.when(F.col("action") == "resolve", F.col("at"))).alias("resolved_at"))
    status = F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("acknowledged_at").isNotNull(), "acknowledged").otherwise("active")
    return alerts.drop("status").join(a, "id", "left").withColumn("status", status)


def active_alerts(alerts: DataFrame, category: str | None = None, severity: str | None = None) -> DataFrame:
    """Active alerts, optionally of one category or severity."""
    d = alerts.where("status = 'active'")
    d = d if category is None else d.where(F.col("category") == category)
    return d if severity is None else d.where(F.col("severity") == severity)


def alert_history(alerts: DataFrame, limit: int = 100, category: str | None = None, order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """The last ``limit`` alerts in order of creation; numbers of a day go past five digits, so a longer id is a later one."""
    d = alerts if category is None else alerts.where(F.col("category") == category)
    by = [k for c in order for k in ((F.length(c), F.col(c)) if c == "id" else (F.col(c),))]
    return d.orderBy(*[k.desc() for k in by]).limit(limit).orderBy(*by)


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Active alerts in total, by severity and by category (zeros included), and all alerts ever, as rows."""
    on = F.col("status") == "active"
    counts = {("total_active", ""): F.count_if(on), ("total_historical", ""): F.count(F.lit(1))}
    counts |= {("by_severity", s): F.count_if(on & (F.col("severity") == s)) for s in SEVERITIES}
    counts |= {("by_category", c): F.count_if(on & (F.col("category") == c)) for c in CATEGORIES}
    row = alerts.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts.values())])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(k[0]).alias("block"), F.lit(k[1]).alias("key"), F.col(f"c{i}").alias("alerts")) for i, k in enumerate(counts)
    ])).alias("r")).select("r.*")


def pick_recipients(alerts: DataFrame, channels: dict = CHANNELS) -> DataFrame:
    """One row per alert, channel and recipient; a severity without an entry uses that of warnings. Nothing is sent."""
    options = []
    for channel, by_severity in channels.items():
        lists = F.create_map(*[x for s, to in by_severity.items() for x in (F.lit(s), F.array(*[F.lit(r) for r in to]))])
        to = F.coalesce(lists[F.col("severity")], lists[F.lit("warning")])
        options.append(_targets(channel, to))
    return alerts.withColumn("_t", F.explode(F.flatten(F.array(*options)))).select("*", "_t.*").drop("_t")


def _targets(channel: str, to: Column) -> Column:
    return F.transform(to, lambda r: F.struct(F.lit(channel).alias("channel"), r.alias("recipient")))


def metric_rules(metrics: DataFrame, rules: Sequence[tuple] = METRIC_RULES) -> DataFrame:
    """One row per metrics row and condition that holds; a null never holds."""
    found = F.filter(F.array(*[
        F.when(F.coalesce(F.expr(cond), F.lit(False)), F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.lit(c).alias("cooldown_minutes")))
        for n, cond, s, c in rules
    ]), lambda x: x.isNotNull())
    return metrics.withColumn("_f", F.explode(found)).select("*", "_f.*").drop("_f")


def all_alerts(technical: DataFrame, finops: DataFrame, compliance: DataFrame) -> DataFrame:
    """All violations with their category; columns that a kind lacks are null."""
    t = technical.withColumn("category", F.lit("technical"))
    f = finops.withColumn("category", F.lit("finops"))
    c = compliance.withColumn("category", F.lit("compliance"))
    return t.unionByName(f, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
