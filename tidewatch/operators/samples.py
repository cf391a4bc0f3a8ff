"""Time-series operators over metric samples.

Samples are rows (ts, metric, labels, value); vectors are rows (t, metric, labels, value) on a time grid, where t is a
multiple of the step. Ranges are left-open: (t - range, t]. Rates are not extrapolated to the edges of the range.

Samples are first reduced to one row per series and step. Whatever range a function looks at, it reads these rows, never
the samples again (but for least squares), and windows over them are cut into blocks as long as the range, so that no
task holds a whole history and no value outside a range can show in it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import as_map

COLUMNS = ("ts", "metric", "labels", "value")
LOOKBACK = 300
MICROS = 1_000_000


def as_samples(df: DataFrame, static_labels: dict[str, str] | None = None) -> DataFrame:
    """(ts, metric, labels, value) rows; every other column becomes a label where it is not null."""
    extra = [c for c in df.columns if c not in COLUMNS]
    parts = [F.col("labels")] if "labels" in df.columns else []
    if extra:
        pairs = F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c).cast("string"))])
        parts.append(F.map_filter(pairs, lambda _, v: v.isNotNull()))
    if static_labels or not parts:
        parts.append(as_map(static_labels or {}))
    labels = parts[0] if len(parts) == 1 else F.map_concat(*parts)
    return df.select("ts", "metric", labels.alias("labels"), F.col("value").cast("double").alias("value"))


def series_key(labels: Column) -> Column:
    """Text that is equal for equal label sets; a map itself cannot be a key."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(labels))))


def labels_of(key: Column) -> Column:
    """The labels of a key. Aggregations carry the key only: a map would force them to sort."""
    return F.from_json(key, "map<string,string>")


def time_grid(spark: SparkSession, start: int, end: int, step: int) -> DataFrame:
    """The grid points from ``start`` to ``end`` (epoch seconds), rounded up to the step."""
    first = math.ceil(start / step) * step
    return spark.range(first, end + 1, step).select(F.timestamp_seconds("id").alias("t"))


def grid_over(samples: DataFrame, step: int, ts: str = "ts") -> DataFrame:
    """The grid points from the first to the last sample; one that lies less than a second before the first is not among them."""
    ends = samples.agg(F.unix_micros(F.min(ts)).alias("a"), F.unix_seconds(F.max(ts)).alias("b")).first()
    return time_grid(samples.sparkSession, -(-ends["a"] // MICROS), ends["b"], step)


def match_labels(labels: Column, equal: dict[str, str] | None = None, pattern: dict[str, str] | None = None) -> Column:
    """Label matchers: equality, and patterns anchored on both ends. A missing label reads as empty text."""
    ok = F.lit(True)
    for k, v in (equal or {}).items():
        ok = ok & (F.coalesce(labels[k], F.lit("")) == v)
    for k, v in (pattern or {}).items():
        ok = ok & F.coalesce(labels[k], F.lit("")).rlike(f"^(?:{v})$")
    return ok


def step_of(us: Column, step: int) -> Column:
    """The grid point at or after a time in microseconds."""
    return (F.ceil(us / F.lit(step * MICROS)) * step).cast("bigint")


def step_rows(samples: DataFrame, step: int, keys: Sequence[str] = ("metric", "series")) -> DataFrame:
    """One row per series (``keys``) and step: what the range functions need to know about the samples in it."""
    us = F.unix_micros("ts")
    s = samples.select(*keys, us.alias("us"), step_of(us, step).alias("g"), "value")
    inside = Window.partitionBy(*keys, "g").orderBy("us")
    v, before = F.col("value"), F.col("_pv")
    s = s.withColumns({"_pv": F.lag("value").over(inside), "_pu": F.lag("us").over(inside)})
    grown = F.when(before.isNull(), 0.0).when(v >= before, v - before).otherwise(v)
    return s.groupBy(*keys, "g").agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("sy"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.min_by("value", "us").alias("first_v"), F.max_by("value", "us").alias("last_v"),
        F.max_by("_pu", "us").alias("second_us"), F.max_by("_pv", "us").alias("second_v"),
        F.sum(grown).alias("inc"), F.count_if(before.isNotNull() & (before != v)).alias("chg"),
    )


# Kinds of rows in a frame: grid points, steps that leave the range, samples and samples that leave it.
POINT, LEAVES, SAMPLE, SAMPLE_LEAVES = range(4)


def _place(block: Column, at: Column, kind: int) -> Column:
    return F.struct(block.alias("b"), at.alias("at"), F.lit(kind).alias("kind"))


class RangeFrame:
    """Step rows spread over the grid points at which a range can see them; a row says in ``seconds`` how long its range is.

    Blocks are as long as the range, so a range is the end of one block and the start of the next. What has entered
    since the block began is a window that grows with time; what the block before still holds is a window that grows
    against time, over marks put where a step is last seen. Nothing is subtracted: a value outside the range cannot
    show in it, be it huge, infinite or no number. A grid point costs the same whether the range holds ten steps or a
    thousand. A block holds all that its grid points can see, so one shuffle by series, length and block serves all
    lengths: which steps follow each other is found inside the block.
    """

    def __init__(self, rows: DataFrame, step: int, keys: Sequence[str] = ("metric", "series")):
        self.step, self.keys, self.seconds = step, [*keys, "seconds"], F.col("seconds")
        self.tail = self.seconds - step
        g, b, at, kind = (F.col(c) for c in ("g", "b", "at", "kind"))
        own, seen = self._block(g), self._block(g + self.tail)
        places = F.array(_place(own, g, POINT), F.when(seen > own, _place(seen, g + self.tail, LEAVES)))
        rows = rows.withColumn("_place", F.explode(F.filter(places, lambda x: x.isNotNull()))).select("*", "_place.*").drop("_place")
        block = Window.partitionBy(*self.keys, "b")
        along = block.orderBy("g")
        # marks of the block before come first, as their steps are older
        rows = rows.withColumns({
            "_pv": F.lag("last_v").over(along), "_pu": F.lag("last_us").over(along), "prev_g": F.lag("g").over(along), "_pk": F.lag("kind").over(along),
            "_nv": F.lead("first_v").over(along), "_ng": F.lead("g").over(along), "_nk": F.lead("kind").over(along),
            "_own": F.min(F.when(kind == POINT, g)).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        })
        first, before, last, after = F.col("first_v"), F.col("_pv"), F.col("last_v"), F.col("_nv")
        held = F.col("_nk") == LEAVES
        low = F.when(kind == POINT, g).when(F.col("_pk") == LEAVES, F.col("prev_g") + self.tail + step).otherwise(b * self.seconds)
        high = F.when(kind == LEAVES, F.least(at, F.col("_own") - step)).otherwise(F.coalesce(F.col("_ng") - step, (b + 1) * self.seconds - step))
        spots = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high), F.lit(step).cast("bigint")), lambda x: F.struct(x.alias("at"), F.lit(POINT).alias("kind"))))
        mark = F.when(kind == LEAVES, F.array(F.struct(at.alias("at"), F.lit(LEAVES).alias("kind"))))
        none = F.array().cast("array<struct<at:bigint,kind:int>>")
        rows = rows.withColumns({
            "cross": F.when(before.isNull(), 0.0).when(first >= before, first - before).otherwise(first),
            "cross_chg": F.when(before != first, 1).otherwise(0),
            "ahead_cross": F.when(held, F.when(after >= last, after - last).otherwise(after)).otherwise(0.0),
            "ahead_cross_chg": F.when(held & (after != last), 1).otherwise(0),
            "second_us": F.coalesce("second_us", "_pu"), "second_v": F.coalesce("second_v", "_pv"),
            "start": F.struct("first_us", "first_v"),
            "_spot": F.explode(F.concat(F.coalesce(mark, none), F.coalesce(spots, none))),
        })
        self.rows = rows.withColumns({"at": F.col("_spot.at"), "kind": F.col("_spot.kind")}).drop("_spot", "_pv", "_pu", "_nv", "_ng", "_nk", "_own")
        self.upto = block.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        self.still = block.orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        self.enters = (kind == POINT) & (at == g)
        self.leaves = kind == LEAVES
        self.age = (at - b * self.seconds).cast("double")

    def _block(self, at: Column) -> Column:
        return F.floor(at / self.seconds)

    def total(self, c: str) -> Column:
        return F.coalesce(F.sum(F.when(self.enters, F.col(c))).over(self.upto), F.lit(0)) + F.coalesce(
            F.sum(F.when(self.leaves, F.col(c))).over(self.still), F.lit(0))

    def pairs(self, c: str) -> Column:
        """Sum over the steps of the range whose step before is in the range too."""
        inside = self.enters & (F.col("_pk") == POINT)
        first = F.first(F.when(self.enters, F.struct("prev_g", F.col(c).alias("c"))), ignorenulls=True).over(self.upto)
        return (
            F.coalesce(F.sum(F.when(inside, F.col(c))).over(self.upto), F.lit(0))
            + F.coalesce(F.sum(F.when(self.leaves, F.col(f"ahead_{c}"))).over(self.still), F.lit(0))
            + F.when(first["prev_g"] >= F.col("at") - self.tail, first["c"]).otherwise(0)
        )

    def start(self) -> Column:
        """The first step of the range: (first_us, first_v)."""
        held = F.last(F.when(self.leaves, F.col("start")), ignorenulls=True).over(self.still)
        return F.coalesce(held, F.first(F.when(self.enters, F.col("start")), ignorenulls=True).over(self.upto))

    def last(self, c: str) -> Column:
        held = F.first(F.when(self.leaves, F.col(c)), ignorenulls=True).over(self.still)
        return F.coalesce(F.last(F.when(self.enters, F.col(c)), ignorenulls=True).over(self.upto), held)

    def with_line(self, samples: DataFrame) -> None:
        """Add the samples themselves (keys, seconds, ts, value) for least squares; x counts seconds from the start of the block."""
        d = samples.select(*self.keys, F.unix_micros("ts").alias("_us"), F.col("value").alias("y"))
        g = step_of(F.col("_us"), self.step)
        own, seen = self._block(g), self._block(g + self.tail)
        places = F.array(_place(own, g, SAMPLE), F.when(seen > own, _place(seen, g + self.tail, SAMPLE_LEAVES)))
        d = d.withColumn("_place", F.explode(F.filter(places, lambda x: x.isNotNull()))).select(*self.keys, "_us", "y", "_place.*")
        x = (F.col("_us") - F.col("b") * (self.seconds * MICROS)) / F.lit(float(MICROS))
        self.rows = self.rows.unionByName(d.withColumn("x", x).drop("_us"), allowMissingColumns=True)

    def moments(self, kind: int, n: str) -> dict[str, Column]:
        """Count, means and centred sums of the samples on one side, kept centred while they grow."""
        w = self.upto if kind == SAMPLE else self.still
        x, y = (F.when(F.col("kind") == kind, F.col(c)) for c in ("x", "y"))
        parts = {"n": F.regr_count, "x": F.regr_avgx, "y": F.regr_avgy, "xx": F.regr_sxx, "xy": F.regr_sxy}
        return {f"_{k}{n}": F.coalesce(fn(y, x).over(w), F.lit(0)) for k, fn in parts.items()}


# What each range function needs from the frame, and its value; null where the range holds too few samples.


def _growth(r: RangeFrame) -> dict[str, Column]:
    return {
        "_n": r.total("n"), "_start": r.start(), "_grown": r.total("inc") + r.pairs("cross"), "_u": r.last("last_us"),
    }


def _fn_instant(r: RangeFrame, lookback: int):
    young = F.col("at") * MICROS - F.col("_u") < lookback * MICROS
    return {"_v": r.last("last_v"), "_u": r.last("last_us")}, F.when(young, F.col("_v"))


def _fn_rate(r: RangeFrame, _):
    seconds = (F.col("_u") - F.col("_start.first_us")) / F.lit(float(MICROS))
    return _growth(r), F.when((F.col("_n") >= 2) & (seconds > 0), F.col("_grown") / seconds)


def _fn_increase(r: RangeFrame, _):
    return _growth(r), F.when(F.col("_n") >= 2, F.col("_grown"))


def _fn_irate(r: RangeFrame, _):
    cols = {n: r.last(c) for n, c in (("_u", "last_us"), ("_v", "last_v"), ("_u0", "second_us"), ("_v0", "second_v"))}
    inside = (F.col("_u0") > (F.col("at") - r.seconds) * MICROS) & (F.col("_u") > F.col("_u0"))
    grown = F.when(F.col("_v") >= F.col("_v0"), F.col("_v") - F.col("_v0")).otherwise(F.col("_v"))
    return cols, F.when(inside, grown / ((F.col("_u") - F.col("_u0")) / F.lit(float(MICROS))))


def _fn_delta(r: RangeFrame, _):
    cols = {"_n": r.total("n"), "_start": r.start(), "_v": r.last("last_v")}
    return cols, F.when(F.col("_n") >= 2, F.col("_v") - F.col("_start.first_v"))


def _fn_changes(r: RangeFrame, _):
    cols = {"_n": r.total("n"), "_chg": r.total("chg") + r.pairs("cross_chg")}
    return cols, F.when(F.col("_n") > 0, F.col("_chg").cast("double"))


def _fn_avg(r: RangeFrame, _):
    return {"_n": r.total("n"), "_sy": r.total("sy")}, F.when(F.col("_n") > 0, F.col("_sy") / F.col("_n"))


def _line(r: RangeFrame) -> tuple[dict[str, Column], Column, Column, Column]:
    """Slope, mean x and mean y of the range: both sides merged without leaving their centres."""
    cols = r.moments(SAMPLE, "1") | r.moments(SAMPLE_LEAVES, "2")
    n1, x1, y1, xx1, xy1, n2, x2, y2, xx2, xy2 = (F.col(f"_{k}{i}") for i in "12" for k in ("n", "x", "y", "xx", "xy"))
    n = n1 + n2
    both = F.when((n1 > 0) & (n2 > 0), n1 * n2 / n).otherwise(0.0)
    dx, dy = x2 - x1, y2 - y1
    xx = xx1 + xx2 + F.when(both > 0, dx * dx * both).otherwise(0.0)
    xy = xy1 + xy2 + F.when(both > 0, dx * dy * both).otherwise(0.0)
    mean = lambda p, q: F.when(n1 == 0, q).when(n2 == 0, p).otherwise(p + (q - p) * (n2 / n))
    return cols, F.when((n >= 2) & (xx > 0), xy / xx), mean(x1, x2), mean(y1, y2)


def _fn_deriv(r: RangeFrame, _):
    cols, slope, _x, _y = _line(r)
    return cols, slope


def _fn_predict(r: RangeFrame, horizon: int):
    cols, slope, x, y = _line(r)
    return cols, y + slope * (r.age + horizon - x)


RANGE_FUNCTIONS = {
    "instant": _fn_instant, "rate": _fn_rate, "irate": _fn_irate, "increase": _fn_increase, "delta": _fn_delta,
    "changes": _fn_changes, "avg": _fn_avg, "predict": _fn_predict, "deriv": _fn_deriv,
}


LINES = ("predict", "deriv")


def frame_values(rows: DataFrame, step: int, wanted: Sequence[tuple[str, int]], keys: Sequence[str], samples: DataFrame | None = None) -> DataFrame:
    """Functions of ranges over step rows that carry their ``seconds``: (keys, seconds, at, v0, v1, ...) in the order of ``wanted``.

    ``samples`` (keys, seconds, ts, value) are needed for the functions of LINES.
    """
    r = RangeFrame(rows, step, keys)
    if any(fn in LINES for fn, _ in wanted):
        r.with_line(samples)
    cols: dict[str, Column] = {}
    values = []
    for i, (fn, arg) in enumerate(wanted):
        needs, value = RANGE_FUNCTIONS[fn](r, arg)
        cols |= needs
        values.append(value.alias(f"v{i}"))
    return r.rows.withColumns(cols).where(F.col("kind") == POINT).select(*keys, "seconds", "at", *values)


def range_values(samples: DataFrame, seconds: int, step: int, wanted: Sequence[tuple[str, int]]) -> DataFrame:
    """Several functions of the same range in one pass: (t, metric, labels, v0, v1, ...) in the order of ``wanted``.

    ``wanted`` has (function, argument) pairs; the argument is the lookback of instant and the horizon of predict.
    """
    if seconds % step:
        raise ValueError("the range must be a multiple of the step")
    s = samples.select("metric", series_key(F.col("labels")).alias("series"), "ts", "value")
    length = F.lit(seconds).cast("bigint").alias("seconds")
    d = frame_values(step_rows(s, step).select("*", length), step, wanted, ("metric", "series"), s.select("*", length))
    return d.select(F.timestamp_seconds("at").alias("t"), "metric", labels_of(F.col("series")).alias("labels"), *[f"v{i}" for i in range(len(wanted))])


def _one(samples: DataFrame, seconds: int, step: int, fn: str, arg: int = 0) -> DataFrame:
    return range_values(samples, seconds, step, [(fn, arg)]).withColumnRenamed("v0", "value").where("value IS NOT NULL")


def select_series(
    samples: DataFrame, metric: str | None = None, equal: dict | None = None, pattern: dict | None = None,
    step: int = 30, lookback: int = LOOKBACK,
) -> DataFrame:
    """M1: instant vector: per series the newest sample that is younger than the lookback."""
    s = samples if metric is None else samples.where(F.col("metric") == metric)
    s = s.where(match_labels(F.col("labels"), equal, pattern))
    return _one(s, math.ceil(lookback / step) * step, step, "instant", lookback)


def rate(samples: DataFrame, seconds: int = 300, step: int = 30) -> DataFrame:
    """M2: growth per second of a counter over the range, resets corrected; needs two samples."""
    return _one(samples, seconds, step, "rate")


def irate(samples: DataFrame, seconds: int = 60, step: int = 30) -> DataFrame:
    """M3: growth per second between the last two samples of the range."""
    return _one(samples, seconds, step, "irate")


def increase(samples: DataFrame, seconds: int = 300, step: int = 30) -> DataFrame:
    """M4: reset-corrected growth of a counter over the range."""
    return _one(samples, seconds, step, "increase")


def delta(samples: DataFrame, seconds: int = 300, step: int = 30) -> DataFrame:
    """M5: last minus first sample of a gauge in the range."""
    return _one(samples, seconds, step, "delta")


def changes(samples: DataFrame, seconds: int = 300, step: int = 30) -> DataFrame:
    """M6: how often the value changed in the range."""
    return _one(samples, seconds, step, "changes")


def avg_over_time(samples: DataFrame, seconds: int = 300, step: int = 30) -> DataFrame:
    """M7: mean of the samples in the range."""
    return _one(samples, seconds, step, "avg")


def predict_linear(samples: DataFrame, seconds: int, horizon: int, step: int = 30) -> DataFrame:
    """M8: value of the least squares line of the range at t + horizon."""
    return _one(samples, seconds, step, "predict", horizon)


def deriv(samples: DataFrame, seconds: int = 300, step: int = 30) -> DataFrame:
    """Slope per second of the least squares line of the range."""
    return _one(samples, seconds, step, "deriv")


def histogram_quantile(q: float, buckets: DataFrame) -> DataFrame:
    """M9: quantile of each histogram, linear inside the first bucket whose count reaches q times the total.

    Buckets carry their upper bound in the label ``le``; the last bucket gives the highest finite bound.
    """
    le = F.col("labels")["le"]
    bound = F.when(le.isin("+Inf", "Inf"), F.lit(float("inf"))).otherwise(le.try_cast("double"))
    d = buckets.withColumns({"_le": bound, "labels": F.map_filter("labels", lambda k, _: k != "le")}).where("_le IS NOT NULL")
    d = d.withColumn("_key", series_key(F.col("labels")))
    group = Window.partitionBy("t", "_key")
    order = group.orderBy("_le")
    d = d.withColumns({
        "_total": F.max(F.when(F.col("_le") == float("inf"), F.col("value"))).over(group),
        "_lo": F.lag("_le").over(order), "_below": F.coalesce(F.lag("value").over(order), F.lit(0.0)),
    })
    rank = F.col("_total") * F.lit(q)
    low = F.coalesce(F.col("_lo"), F.when(F.col("_le") > 0, 0.0).otherwise(F.col("_le")))
    part = (rank - F.col("_below")) / (F.col("value") - F.col("_below"))
    value = F.when(F.col("_le") == float("inf"), F.col("_lo")).when(
        F.col("value") > F.col("_below"), low + (F.col("_le") - low) * part).otherwise(low)
    first = (F.col("value") >= rank) & (F.col("_lo").isNull() | (F.col("_below") < rank))
    return d.where((F.col("_total") > 0) & first).select("t", "labels", value.alias("value"))


def keep_labels(labels: Column, by: Sequence[str]) -> Column:
    names = list(by)
    return F.map_filter(labels, lambda k, _: k.isin(names)) if names else F.create_map().cast("map<string,string>")


def aggregate(vector: DataFrame, fn: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum, avg, max, min or count over the series that agree on the ``by`` labels."""
    agg = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}[fn]
    d = vector.withColumn("_key", series_key(keep_labels(F.col("labels"), by)))
    d = d.groupBy("t", "_key").agg(agg("value").cast("double").alias("value"))
    return d.select("t", labels_of(F.col("_key")).alias("labels"), "value")


def divide(a: Column, b: Column) -> Column:
    """Division of doubles: 0/0 is not a number, x/0 is infinite, and a missing side gives nothing."""
    by_zero = F.when(a == 0, F.lit(float("nan"))).when(a.isNotNull(), F.signum(a) * F.lit(float("inf")))
    return F.when(b != 0, a / b).when(b == 0, by_zero)


_OPS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide}
_COMPARE = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
}


def _keyed(v: DataFrame, on: Sequence[str] | None) -> DataFrame:
    labels = F.col("labels") if on is None else keep_labels(F.col("labels"), on)
    return v.withColumn("_key", series_key(labels))


def vector_op(a: DataFrame, b: DataFrame, op: str, on: Sequence[str] | None = None) -> DataFrame:
    """Arithmetic or comparison of series with equal labels (the metric name does not count); others drop."""
    right = _keyed(b, on).select(F.col("t").alias("_t"), F.col("_key").alias("_k"), F.col("value").alias("_b"))
    d = _keyed(a, on).join(right, (F.col("t") == F.col("_t")) & (F.col("_key") == F.col("_k")))
    if op in _COMPARE:
        return d.where(_COMPARE[op](F.col("value"), F.col("_b"))).select("t", "labels", "value")
    return d.select("t", "labels", _OPS[op](F.col("value"), F.col("_b")).alias("value"))


def scalar_op(v: DataFrame, op: str, k: float, reverse: bool = False) -> DataFrame:
    """Arithmetic with a constant, on the right or (``reverse``) on the left."""
    a, b = (F.lit(float(k)), F.col("value")) if reverse else (F.col("value"), F.lit(float(k)))
    return v.withColumn("value", _OPS[op](a, b))


def compare(v: DataFrame, op: str, k: float, as_bool: bool = False) -> DataFrame:
    """The series for which the comparison holds, or 1 and 0 for all."""
    ok = _COMPARE[op](F.col("value"), F.lit(float(k)))
    return v.withColumn("value", F.when(ok, 1.0).otherwise(0.0)) if as_bool else v.where(ok)


def vector_and(a: DataFrame, b: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``a`` that have a match in ``b``."""
    right = _keyed(b, on).select(F.col("t").alias("_t"), F.col("_key").alias("_k"))
    cond = (F.col("t") == F.col("_t")) & (F.col("_key") == F.col("_k"))
    return _keyed(a, on).join(right, cond, "left_semi").drop("_key")


def vector_or(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a``, and rows of ``b`` without a match in ``a``."""
    left = _keyed(a, None).select(F.col("t").alias("_t"), F.col("_key").alias("_k"))
    cond = (F.col("t") == F.col("_t")) & (F.col("_key") == F.col("_k"))
    rest = _keyed(b, None).join(left, cond, "left_anti").drop("_key")
    return a.unionByName(rest, allowMissingColumns=True)


def or_default(v: DataFrame, grid: DataFrame, value: float = 0.0) -> DataFrame:
    """M15 with a constant: the value at grid points where ``v`` has no series without labels."""
    return vector_or(v, constant_series(grid, value))


def offset(v: DataFrame, by: str) -> DataFrame:
    """The vector as it was ``by`` earlier ("1 hour")."""
    return v.withColumn("t", F.col("t") + F.expr(f"INTERVAL {by}"))


def absent(v: DataFrame, grid: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """1 at the grid points where the vector has no series."""
    seen = v.select(F.col("t").alias("_t")).distinct()
    return grid.join(seen, F.col("t") == F.col("_t"), "left_anti").select("t", as_map(labels or {}).alias("labels"), F.lit(1.0).alias("value"))


def days_until(v: DataFrame) -> DataFrame:
    """Days from t to the epoch second that the series holds."""
    return v.withColumn("value", (F.col("value") - F.unix_seconds("t")) / F.lit(86400.0))


def constant_series(grid: DataFrame, value: float, labels: dict[str, str] | None = None) -> DataFrame:
    """The same value at every grid point."""
    return grid.select("t", as_map(labels or {}).alias("labels"), F.lit(float(value)).alias("value"))


def encode_status(vector: DataFrame, by: Sequence[str] = ("cluster",)) -> DataFrame:
    """0, 1 or 2 for the colour (green, yellow, red) whose series is 1; the worst counts."""
    code = as_map({"green": 0.0, "yellow": 1.0, "red": 2.0})[F.col("labels")["color"]]
    return aggregate(vector.withColumn("value", F.when(F.col("value") == 1, code).otherwise(0.0)), "max", by)


def slo_report(health: DataFrame, target: float, seconds: int = 3600, step: int = 60) -> DataFrame:
    """Mean of a 1/0 health series over the range, and the error budget used and left against the target."""
    current = avg_over_time(health, seconds, step)
    used = (F.lit(1.0) - F.col("value")) / F.lit(1.0 - target)
    return current.select("t", "labels", F.col("value").alias("current"), F.lit(target).alias("target"),
                          used.alias("budget_consumed"), (F.lit(1.0) - used).alias("budget_remaining"))


def within_target(v: DataFrame, limit: float) -> DataFrame:
    """1 below the limit, else 0."""
    return compare(v, "<", limit, as_bool=True)
