"""Recording rules and alert conditions evaluated together.

A rule is data: up to three operands (a range function over a metric, matchers, an aggregation) and the arithmetic that
joins them. Samples become step rows of numbered series, written once. A whole level of rules is one plan: the dictionary
of series meets the rule table (its size is that of the rule list), which says for each series what ranges are read and
into what series each result goes; one shuffle of step rows by series and block answers all lengths of range; one grouping
brings the operands of a rule together by time and number. Labels are read once for each series, never once for each row.
Rules that read other rules come in the next level, whose step rows are the recorded values themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import literal_table
from tidewatch.operators import samples as m


@dataclass(frozen=True)
class Operand:
    """fn(metric{match, like}[seconds] offset back) where-compared, then aggregated by labels."""

    metric: str
    fn: str = "instant"
    seconds: int = m.LOOKBACK
    match: tuple[tuple[str, str], ...] = ()
    like: tuple[tuple[str, str], ...] = ()
    where: tuple[str, float] | None = None
    agg: str | None = None
    by: tuple[str, ...] = ()
    back: int = 0
    horizon: int = 0


@dataclass(frozen=True)
class Rule:
    """A recorded series: operands a, b, c joined by ``op``; ``k`` is the constant of the operation."""

    name: str
    op: str
    operands: tuple[Operand, ...] = ()
    k: float = 0.0


@dataclass(frozen=True)
class Alert:
    """A condition over a rule's value, held for a time, with its labels."""

    name: str
    rule: Rule
    compare: tuple[str, float] | None
    hold: int
    severity: str
    service: str
    category: str
    summary: str = ""
    description: str = ""
    extra: dict = field(default_factory=dict, hash=False)


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _nil(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


# Arithmetic of a rule on its operands a, b, c, its constant k and the time t.
OPERATIONS = {
    "a": lambda a, b, c, k, t: a,
    "a/b": lambda a, b, c, k, t: m.divide(a, b),
    "a-b": lambda a, b, c, k, t: a - b,
    "1-a/b": lambda a, b, c, k, t: F.lit(1.0) - m.divide(a, b),
    "a/(a+b)": lambda a, b, c, k, t: m.divide(a, a + b),
    "a/k": lambda a, b, c, k, t: a / k,
    "1-a": lambda a, b, c, k, t: F.lit(1.0) - a,
    "(1-a)/(1-k)": lambda a, b, c, k, t: (F.lit(1.0) - a) / (F.lit(1.0) - k),
    "(a-t)/86400": lambda a, b, c, k, t: (a - F.unix_seconds(t)) / F.lit(86400.0),
    "a is k": lambda a, b, c, k, t: F.when(a.isNotNull(), _flag(a == k)),
    "a<k": lambda a, b, c, k, t: F.when(a.isNotNull(), _flag(a < k)),
    "worst": lambda a, b, c, k, t: F.greatest(_nil(a) * 0, _nil(b) * 1, _nil(c) * 2),
    "a is k and b is 1 and c is 0": lambda a, b, c, k, t: _flag((_nil(a) == k) & (_nil(b) == 1) & (_nil(c) == 0)),
    "a/b<k": lambda a, b, c, k, t: F.when(a.isNotNull() & b.isNotNull(), _flag(m.divide(a, b) < k)),
    "1-(1-a)/(1-k)": lambda a, b, c, k, t: F.lit(1.0) - (F.lit(1.0) - a) / (F.lit(1.0) - k),
    "a and b": lambda a, b, c, k, t: F.when(b.isNotNull(), a),
    "a<b*k": lambda a, b, c, k, t: F.when(a < b * k, a),
    "quantile": lambda a, b, c, k, t: a,
}
# Codes of the aggregations in the rule table; a number keeps the grouping in hash form.
AGGREGATES = {"sum": 1, "avg": 2, "max": 3, "count": 4}
WITH_DEFAULT = ("a<k", "a/b<k")


def _choose(selector: Column, choices: dict[str, Column]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in choices.items():
        out = F.when(selector == name, value).otherwise(out)
    return out


def _span(o: Operand, step: int) -> int:
    return math.ceil(o.seconds / step) * step


def _rule_table(spark: SparkSession, rules: Sequence[Rule], step: int) -> DataFrame:
    rows = []
    for r in rules:
        for slot, o in enumerate(r.operands):
            rows.append((
                ":".join(map(str, _fn(o))), _span(o, step), o.metric, r.name, r.op, float(r.k), slot,
                [(k, v, False) for k, v in o.match] + [(k, v, True) for k, v in o.like],
                o.where[0] if o.where else None, float(o.where[1]) if o.where else None, AGGREGATES.get(o.agg), list(o.by), o.back,
            ))
    return literal_table(spark, rows,
        "fn string, seconds bigint, metric string, name string, op string, k double, slot int, match array<struct<k string, v string, like boolean>>, "
        "cmp string, cmp_k double, agg int, by array<string>, back int",
    )


def _fn(o: Operand) -> tuple[str, int]:
    return o.fn, o.seconds if o.fn == "instant" else o.horizon


def series_number(metric: Column, labels: Column) -> Column:
    """The number of a series: a hash of its metric and its labels in order. Series of other metrics never meet."""
    return F.xxhash64(metric, F.sort_array(F.map_entries(labels)))


@dataclass(frozen=True)
class Source:
    """What rules read: steps (metric, sid, g, ...), points (metric, sid, ts, value) and series (metric, sid, labels).

    Points are the samples themselves, which only lines through a range need.
    """

    steps: DataFrame
    points: DataFrame
    series: DataFrame

    def union(self, other: "Source") -> "Source":
        return Source(self.steps.unionByName(other.steps), self.points.unionByName(other.points), self.series.unionByName(other.series))


def _label_columns(samples: DataFrame) -> list[str]:
    """The columns that hold the labels, by name, where samples have no map of them."""
    return [] if "labels" in samples.columns else sorted(c for c in samples.columns if c not in m.COLUMNS)


def numbered(samples: DataFrame) -> DataFrame:
    """(metric, sid, ts, value). Labels are a map or columns (as_samples); from columns no row has to make a map."""
    if "labels" in samples.columns:
        number = series_number(F.col("metric"), F.col("labels"))
    else:  # a null leaves a hash as it is, so this is the number of the map without nulls
        pairs = [x for c in _label_columns(samples) for x in (F.when(F.col(c).isNotNull(), F.lit(c)), F.col(c).cast("string"))]
        number = F.xxhash64("metric", *pairs)
    return samples.select("metric", number.alias("sid"), "ts", "value")


def dictionary_of(samples: DataFrame) -> DataFrame:
    """(metric, sid, labels) of samples, one row for each series; maps are made and numbered after the distinct."""
    if "labels" in samples.columns:
        once = samples.select("metric", F.sort_array(F.map_entries("labels")).alias("entries")).distinct()
        once = once.select("metric", F.map_from_entries("entries").alias("labels"))
    else:
        once = samples.select("metric", *_label_columns(samples)).distinct()
        once = m.as_samples(once.withColumns({"ts": F.lit(None).cast("timestamp"), "value": F.lit(None).cast("double")}))
    return once.select("metric", series_number(F.col("metric"), F.col("labels")).alias("sid"), "labels")


def series_of(points: DataFrame) -> DataFrame:
    """One row for each series of numbered samples; a map can't be a key, so its entries stand for it until the end."""
    entries = F.sort_array(F.map_entries("labels")).alias("entries")
    return points.select("metric", "sid", entries).distinct().select("metric", "sid", F.map_from_entries("entries").alias("labels"))


def source_of(samples: DataFrame, step: int) -> Source:
    d = numbered(samples)
    return Source(m.step_rows(d, step, ("metric", "sid")), d, dictionary_of(samples))


def recorded_source(values: DataFrame, series: DataFrame, step: int) -> Source:
    """Recorded values (t, name, sid, value) as step rows: a step holds the one value of its grid point, so nothing is grouped."""
    d = values.select(F.col("name").alias("metric"), "sid", F.col("t").alias("ts"), "value")
    us, v, nothing = F.unix_micros("ts"), F.col("value"), F.lit(0)
    steps = d.select(
        "metric", "sid", m.step_of(us, step).alias("g"), F.lit(1).cast("bigint").alias("n"), v.alias("sy"), us.alias("first_us"), us.alias("last_us"),
        v.alias("first_v"), v.alias("last_v"), F.lit(None).cast("bigint").alias("second_us"), F.lit(None).cast("double").alias("second_v"),
        nothing.cast("double").alias("inc"), nothing.cast("bigint").alias("chg"))
    return Source(steps, d, series)


def _needed_lengths(rules: Sequence[Rule], step: int, lines: bool) -> dict[tuple[str, int], int]:
    """(metric, length) to how far back an operand looks beyond its range, for operands that need lines or for the others."""
    out: dict[tuple[str, int], int] = {}
    for r in rules:
        for o in r.operands:
            if (o.fn in m.LINES) == lines:
                at = (o.metric, _span(o, step))
                out[at] = max(out.get(at, 0), o.back)
    return out


def _read_values(source: Source, rules: Sequence[Rule], step: int, after: int | None) -> DataFrame | None:
    """(sid, seconds, at, fn values) of all that the rules read: one pass for plain functions, one for lines."""
    out = None
    functions = sorted({_fn(o) for r in rules for o in r.operands})
    for lines in (False, True):
        lengths = _needed_lengths(rules, step, lines)
        if not lengths:
            continue
        wanted = [f for f in functions if (f[0] in m.LINES) == lines]
        metrics = sorted({metric for metric, _ in lengths})
        table = literal_table(source.steps.sparkSession, [(k, n, n + back) for (k, n), back in lengths.items()], "metric string, seconds bigint, reach bigint")
        table = F.broadcast(table)

        def lengthened(d: DataFrame, g: Column, table=table, metrics=metrics) -> DataFrame:
            d = d.where(F.col("metric").isin(*metrics)).join(table, "metric")
            return d if after is None else d.where(g > F.lit(after) - F.col("reach"))

        rows = lengthened(source.steps, F.col("g"))
        points = lengthened(source.points, m.step_of(F.unix_micros("ts"), step)) if lines else None
        v = m.frame_values(rows, step, wanted, ("sid",), points)
        named = [F.col(f"v{i}").alias(":".join(map(str, f))) for i, f in enumerate(wanted)]
        v = v.select("sid", "seconds", "at", *named)
        out = v if out is None else out.unionByName(v, allowMissingColumns=True)
    return out


def _targets(source: Source, rules: Sequence[Rule], step: int) -> DataFrame:
    """What each series is read for, and the labels and number of the series that the result belongs to."""
    labels = F.col("labels")

    def fit(x: Column) -> Column:
        have = F.coalesce(labels[x["k"]], F.lit(""))
        return F.when(x["like"], F.rlike(have, F.concat(F.lit("^(?:"), x["v"], F.lit(")$")))).otherwise(have == x["v"])

    d = source.series.join(F.broadcast(_rule_table(source.series.sparkSession, rules, step)), "metric").where(F.forall("match", fit))
    kept = F.when(F.col("agg").isNull(), labels).otherwise(F.map_filter(labels, lambda k, _: F.array_contains(F.col("by"), k)))
    d = d.withColumn("labels", kept).drop("match", "by", "metric")
    return d.withColumn("out", series_number(F.col("name"), F.col("labels")))


def evaluate_level(source: Source, rules: Sequence[Rule], step: int, after: int | None = None, until: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rules that read only ``source``: their values (t, name, sid, value) and the series of these (metric, sid, labels).

    With ``after`` and ``until`` (epoch seconds) only the grid points in (after, until] are evaluated.
    """
    targets = _targets(source, rules, step)
    functions = sorted({":".join(map(str, _fn(o))) for r in rules for o in r.operands})
    d = _read_values(source, rules, step, after).join(targets.drop("labels"), ["sid", "seconds"])
    at = F.col("at") + F.col("back")
    if after is not None:
        d = d.where(at > after)
    if until is not None:
        d = d.where(at <= until)
    d = d.withColumns({"value": _choose(F.col("fn"), {f: F.col(f"`{f}`") for f in functions}), "t": F.timestamp_seconds(at)}).where("value IS NOT NULL")
    passes = F.lit(False)
    for op, test in m._COMPARE.items():
        passes = passes | ((F.col("cmp") == op) & test(F.col("value"), F.col("cmp_k")))
    d = d.where(F.col("cmp").isNull() | passes)
    aggs = []
    for i in range(3):
        mine = F.when(F.col("slot") == i, F.col("value"))
        aggs += [F.sum(mine).alias(f"s{i}"), F.max(mine).alias(f"m{i}"), F.count(mine).alias(f"n{i}"),
                 F.max(F.when(F.col("slot") == i, F.col("agg"))).alias(f"g{i}")]
    d = d.groupBy("name", "op", "k", "t", "out").agg(*aggs)
    operands = []
    for i in range(3):
        n, g = F.col(f"n{i}"), F.col(f"g{i}")
        value = F.when(g == AGGREGATES["sum"], F.col(f"s{i}")).when(g == AGGREGATES["avg"], F.col(f"s{i}") / n)
        operands.append(F.when(n > 0, value.when(g == AGGREGATES["count"], n.cast("double")).otherwise(F.col(f"m{i}"))))
    used = sorted({r.op for r in rules})
    value = _choose(F.col("op"), {op: OPERATIONS[op](*operands, F.col("k"), F.col("t")) for op in used})
    d = d.select("t", "name", "op", "k", F.col("out").alias("sid"), value.alias("value")).where(F.col("value").isNotNull())
    series = targets.select(F.col("name").alias("metric"), F.col("out").alias("sid"), "labels")
    values = d.where(F.col("op") != "quantile").select("t", "name", "sid", "value")
    shares = sorted({r.k for r in rules if r.op == "quantile"})
    if not shares:
        return values, series_of(series)
    names = [r.name for r in rules if r.op == "quantile"]
    bounds = series_of(series.where(F.col("metric").isin(*names)))
    for q in shares:
        tagged = d.where((F.col("op") == "quantile") & (F.col("k") == q)).join(bounds.select("sid", "labels"), "sid").withColumn(
            "labels", F.map_concat("labels", F.create_map(F.lit("__rule__"), F.col("name"))))
        v = m.histogram_quantile(q, tagged).withColumns({
            "name": F.col("labels")["__rule__"], "labels": F.map_filter("labels", lambda k, _: k != "__rule__")})
        values = values.unionByName(v.select("t", "name", series_number(F.col("name"), F.col("labels")).alias("sid"), "value"))
    without = bounds.withColumn("labels", F.map_filter("labels", lambda k, _: k != "le"))
    without = without.withColumn("sid", series_number(F.col("metric"), F.col("labels")))
    return values, series_of(series.where(~F.col("metric").isin(*names)).unionByName(without))


def inline(rules: Sequence[Rule], known: Sequence[Rule]) -> list[Rule]:
    """Rules that only copy a known rule take over its operands, so that they need no level of their own."""
    by_name = {r.name: r for r in known}

    def direct(r: Rule) -> Rule:
        while r.op == "a" and len(r.operands) == 1:
            o = r.operands[0]
            plain = o.fn == "instant" and not (o.match or o.like or o.where or o.agg or o.back)
            source = by_name.get(o.metric)
            if not plain or source is None or source.op == "const":
                break
            r = Rule(r.name, source.op, source.operands, source.k)
        return r

    return [direct(r) for r in rules]


def _levels(rules: Sequence[Rule]) -> dict[str, int]:
    by_name = {r.name: r for r in rules}
    level: dict[str, int] = {}

    def visit(name: str) -> int:
        if name not in level:
            needs = [o.metric for o in by_name[name].operands if o.metric in by_name]
            level[name] = 1 + max([visit(n) for n in needs], default=-1)
        return level[name]

    for name in by_name:
        visit(name)
    return level


def closure(rules: Sequence[Rule], names: Iterable[str]) -> list[Rule]:
    """The rules of these names and all that they read."""
    by_name = {r.name: r for r in rules}
    todo, seen = list(names), {}
    while todo:
        n = todo.pop()
        if n in by_name and n not in seen:
            seen[n] = by_name[n]
            todo += [o.metric for o in by_name[n].operands]
    return [r for r in rules if r.name in seen]


def stretch(rules: Sequence[Rule], factor: int) -> list[Rule]:
    """The same rules on a slower clock: every range, offset and horizon times ``factor``."""
    def slow(o: Operand) -> Operand:
        return Operand(**{**o.__dict__, "seconds": o.seconds * factor, "back": o.back * factor, "horizon": o.horizon * factor})
    return [Rule(r.name, r.op, tuple(slow(o) for o in r.operands), r.k) for r in rules]


def stretch_alerts(alerts: Sequence[Alert], factor: int) -> list[Alert]:
    return [Alert(**{**a.__dict__, "rule": stretch([a.rule], factor)[0], "hold": a.hold * factor}) for a in alerts]


def _at_step(rules: Sequence[Rule], names: set[str], step: int) -> list[Rule]:
    """Instant reads of recorded series look at the value of the same grid point."""
    def fit(o: Operand) -> Operand:
        if o.metric in names and o.fn == "instant":
            return Operand(**{**o.__dict__, "seconds": step})
        return o
    return [Rule(r.name, r.op, tuple(fit(o) for o in r.operands), r.k) for r in rules]


def _no_labels() -> Column:
    return F.create_map().cast("map<string,string>")


def _one_level(source: Source | None, rules: Sequence[Rule], step: int, grid: DataFrame | None, after: int | None = None, until: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Values and series of a level, with the constants and zeros that the grid asks for."""
    reads = [r for r in rules if r.op != "const"]
    values, series = evaluate_level(source, reads, step, after, until) if reads else (None, None)
    if grid is None:
        return None if values is None else (values, series)
    fixed = {r.name: r.k for r in rules if r.op == "const"}
    filled = [r.name for r in reads if r.op in WITH_DEFAULT]

    def bare(names) -> DataFrame:
        """The series without labels of each name: as many rows as names."""
        named = literal_table(grid.sparkSession, [(n,) for n in names], "metric string").withColumn("labels", _no_labels())
        return named.select("metric", series_number(F.col("metric"), F.col("labels")).alias("sid"), "labels")

    if fixed:
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(k)).alias("value")) for n, k in fixed.items()]))
        v = grid.select("t", pairs.alias("p")).select("t", "p.name", series_number(F.col("p.name"), _no_labels()).alias("sid"), "p.value")
        values, series = (v, bare(fixed)) if values is None else (values.unionByName(v), series.unionByName(bare(fixed)))
    if filled:
        spine = grid.select("t", F.explode(F.array(*[F.lit(n) for n in filled])).alias("name"))
        spine = spine.withColumn("sid", series_number(F.col("name"), _no_labels()))
        there = values.where(F.col("name").isin(*filled)).select("t", "sid")
        zero = spine.join(there, ["t", "sid"], "left_anti").withColumn("value", F.lit(0.0))
        values = values.unionByName(zero.select("t", "name", "sid", "value"))
        series = series.unionByName(bare(filled))
    return values, series


def _with_labels(values: DataFrame, series: DataFrame) -> DataFrame:
    """(t, name, labels, value); a series may be in the dictionary several times."""
    once = series_of(series.select("metric", "sid", "labels")).select(F.col("metric").alias("name"), "sid", "labels")
    return values.join(once, ["name", "sid"]).select("t", "name", "labels", "value")


def _planned(rules: Sequence[Rule], step: int) -> tuple[list[Rule], dict[str, int]]:
    rules = inline(rules, rules)
    level = _levels(rules)
    return _at_step(rules, set(level), step), level


def record_rules(samples: DataFrame, rules: Sequence[Rule], step: int = 30, grid: DataFrame | None = None) -> DataFrame:
    """The series of all rules on the step grid: (t, name, labels, value). Names that start with _ are helpers.

    Constants and the zero of ``or vector(0)`` need the grid. This is one lazy plan, in which a later level computes the
    earlier rules it reads again; for a whole catalogue use ``store_rules``, which writes each level.
    """
    rules, level = _planned(rules, step)
    base, done, out = source_of(samples, step), {}, None
    for n in range(max(level.values()) + 1):
        here = [r for r in rules if level[r.name] == n]
        source = base
        for k in sorted({level[o.metric] for r in here for o in r.operands if o.metric in level}):
            source = source.union(recorded_source(*done[k], step))
        made = _one_level(source, here, step, grid)
        if made is not None:
            done[n] = made
            v = _with_labels(*made)
            out = v if out is None else out.unionByName(v)
    return out


#: The run of a table that is evaluated as far as the samples reach, without a last grid point.
OPEN_END = 253_402_300_799


class RuleStore:
    """M21 as a table that later runs go on with: step rows, dictionary and values of each level, and how far it has come.

    A run reads the samples after the position, adds their step rows, and evaluates the grid points up to its end; of
    earlier step rows and values it reads what the longest range of a metric still sees. What a run writes carries its end
    as a partition and counts only once the position says so, so a run that failed is simply run again.
    """

    def __init__(self, spark: SparkSession, path: str, rules: Sequence[Rule], step: int = 30):
        self.spark, self.path, self.step = spark, path.rstrip("/"), step
        self.rules, self.level = _planned(rules, step)

    def _runs(self) -> DataFrame | None:
        files = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        there = files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files)
        return self.spark.read.schema("until bigint").parquet(f"{self.path}/runs") if there else None

    def position(self) -> int | None:
        """The last grid point evaluated."""
        runs = self._runs()
        return None if runs is None else runs.agg(F.max("until")).first()[0]

    def _write(self, df: DataFrame, table: str, run: int, *by: str) -> None:
        d = df.withColumn("run", F.lit(run).cast("bigint"))
        d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", *by).parquet(f"{self.path}/{table}")

    def _read(self, table: str, run: int, since: int | None = None) -> DataFrame:
        """The rows of finished runs and of this one, without the days before ``since``; what a failed run left is passed over."""
        own = self.spark.range(run, run + 1).select(F.col("id").alias("run"))
        runs = self._runs()
        done = own if runs is None else runs.select(F.col("until").alias("run")).union(own).distinct()
        d = self.spark.read.parquet(f"{self.path}/{table}").join(done, "run", "left_semi")
        return d if since is None else d.where(F.col("date") >= F.to_date(F.timestamp_seconds(F.lit(since))))

    def _source(self, run: int, metrics: set[str], names: set[str], since: int | None = None) -> Source:
        series = self._read("series", run).select("metric", "sid", "labels")
        series = series_of(series.where(F.col("metric").isin(*metrics, *names)))
        steps = self._read("steps", run, since).where(F.col("metric").isin(*metrics)).drop("run", "date")
        if self._lines():
            points = self._read("points", run, since).where(F.col("metric").isin(*metrics)).drop("run", "date")
        else:  # nothing reads them
            points = steps.select("metric", "sid", F.timestamp_micros("first_us").alias("ts"), F.col("first_v").alias("value")).limit(0)
        source = Source(steps, points, series)
        if not names:
            return source
        values = self._read("values", run, since).where(F.col("name").isin(*names)).select("t", "name", "sid", "value")
        return source.union(recorded_source(values, series.limit(0), self.step))

    def _lines(self) -> set[str]:
        """Metrics of samples through which lines are drawn."""
        return {o.metric for r in self.rules for o in r.operands if o.fn in m.LINES} - set(self.level)

    def run(self, samples: DataFrame, grid: DataFrame | None = None, until: int | None = None) -> "RuleStore":
        """Evaluate the grid points after the position up to ``until`` (epoch seconds, a multiple of the step)."""
        after, end = self.position(), OPEN_END if until is None else until
        if after is not None:
            if end <= after:
                return self
            samples = samples.where(F.col("ts") > F.timestamp_seconds(F.lit(after)))
            grid = None if grid is None else grid.where(F.col("t") > F.timestamp_seconds(F.lit(after)))
        if until is not None:
            samples = samples.where(F.col("ts") <= F.timestamp_seconds(F.lit(until)))
            grid = None if grid is None else grid.where(F.col("t") <= F.timestamp_seconds(F.lit(until)))
        read = {o.metric for r in self.rules for o in r.operands} - set(self.level)
        samples = samples.where(F.col("metric").isin(*sorted(read)))
        d = numbered(samples)
        self._write(dictionary_of(samples).withColumn("level", F.lit(-1)), "series", end, "level")
        named = self._read("series", end).where((F.col("run") == end) & (F.col("level") == -1)).select("metric", "sid")
        # a sample is shuffled with its number only; the step rows, which are few, get the metric back
        steps = m.step_rows(d.drop("metric"), self.step, ("sid",)).join(named, "sid").select("*", F.to_date(F.timestamp_seconds("g")).alias("date"))
        self._write(steps.hint("rebalance", "date"), "steps", end, "date")
        if lines := self._lines():
            lined = d.where(F.col("metric").isin(*lines)).select("metric", "sid", "ts", "value", F.to_date("ts").alias("date"))
            self._write(lined.hint("rebalance", "date"), "points", end, "date")
        for n in range(max(self.level.values()) + 1):
            here = [r for r in self.rules if self.level[r.name] == n]
            reads = {o.metric for r in here for o in r.operands}
            reach = max([_span(o, self.step) + o.back for r in here for o in r.operands], default=0)
            source = self._source(end, reads - set(self.level), reads & set(self.level), None if after is None else after - reach)
            made = _one_level(source, here, self.step, grid, after, until)
            if made is not None:
                self._write(made[0].withColumns({"level": F.lit(n), "date": F.to_date("t")}).hint("rebalance", "date"), "values", end, "level", "date")
                self._write(made[1].withColumn("level", F.lit(n)), "series", end, "level")
        self.spark.range(1).select(F.lit(end).cast("bigint").alias("until")).write.mode("append").parquet(f"{self.path}/runs")
        return self

    def values(self) -> DataFrame:
        """All that finished runs have recorded: (t, name, labels, value)."""
        return _with_labels(self._read("values", -1), self._read("series", -1))

    def source(self, metrics: Iterable[str]) -> Source:
        """Step rows of samples and of recorded series, for conditions that read both."""
        metrics = set(metrics)
        return self._source(-1, metrics - set(self.level), metrics & set(self.level))


def store_rules(samples: DataFrame, rules: Sequence[Rule], path: str, step: int = 30, grid: DataFrame | None = None) -> DataFrame:
    """M21 with every level written to a table and read back by the next, so that no level is computed twice."""
    return RuleStore(samples.sparkSession, path, rules, step).run(samples, grid).values()


def needed_rules(alerts: Sequence[Alert], rules: Sequence[Rule]) -> list[Rule]:
    """The recording rules whose stored series the conditions read."""
    conditions = inline([Rule(a.name, a.rule.op, a.rule.operands, a.rule.k) for a in alerts], rules)
    return closure(rules, {o.metric for r in conditions for o in r.operands})


def evaluate_rules(
    samples: DataFrame, alerts: Sequence[Alert], rules: Sequence[Rule] = (), step: int = 30, grid: DataFrame | None = None,
    recorded: DataFrame | None = None,
) -> DataFrame:
    """A1: the series that break a condition at each grid point: (t, alertname, labels, value).

    Conditions may read recorded series: from the table ``recorded`` where it is given, else the rules they need (and
    only those) are evaluated in the same plan.
    """
    spark = samples.sparkSession
    names = {r.name for r in rules}
    conditions = inline([Rule(a.name, a.rule.op, a.rule.operands, a.rule.k) for a in alerts if a.rule.op != "absent"], rules)
    conditions = _at_step(conditions, names, step)
    needed = {o.metric for r in conditions for o in r.operands if o.metric in names}
    read = {o.metric for r in conditions for o in r.operands} - names
    source = source_of(samples.where(F.col("metric").isin(*sorted(read))), step)
    if needed:
        if recorded is None:
            recorded = record_rules(samples, closure(rules, needed), step, grid)
        d = recorded.where(F.col("name").isin(*sorted(needed))).withColumn("sid", series_number(F.col("name"), F.col("labels")))
        named = series_of(d.select(F.col("name").alias("metric"), "sid", "labels"))
        source = source.union(recorded_source(d, named, step))
    v = _with_labels(*evaluate_level(source, conditions, step)).withColumnRenamed("name", "alertname")
    limits = [(a.name, a.compare[0], float(a.compare[1])) for a in alerts if a.compare and a.rule.op != "absent"]
    table = F.broadcast(literal_table(spark, limits, "alertname string, cmp string, limit double"))
    passes = F.lit(False)
    for op, test in m._COMPARE.items():
        passes = passes | ((F.col("cmp") == op) & test(F.col("value"), F.col("limit")))
    out = v.join(table, "alertname", "left").where(F.col("cmp").isNull() | passes).select("t", "alertname", "labels", "value")
    for a in alerts:
        if a.rule.op == "absent" and grid is not None:
            o = a.rule.operands[0]
            seen = m.select_series(m.as_samples(samples.where(F.col("metric") == o.metric)), step=step, lookback=o.seconds)
            out = out.unionByName(m.absent(seen, grid).select("t", F.lit(a.name).alias("alertname"), "labels", "value"))
    return out
