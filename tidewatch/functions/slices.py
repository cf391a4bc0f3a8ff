"""Ordered computations that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends all rows of one key to one task, and one key may
hold a third of all rows. The helpers here cut each key's history into time slices: rows are ordered only
inside a (key, slice), and what one slice must know about the earlier ones travels through a table with one
row per (key, slice), whose size depends on the length of the history and not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MICROS = 1_000_000
SLICE = "_slice"


def slice_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * MICROS))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; the right key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"_r_{c}" for c in on])


def within(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    totals: dict[str, Column],
    over: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """Aggregate each (key, slice), run ``over`` on a window across the slices of a key, join the result back."""
    w = Window.partitionBy(*keys).orderBy(SLICE)
    t = df.groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in totals.items()])
    cols = over(w)
    t = t.select(*keys, SLICE, *[c.alias(n) for n, c in cols.items()])
    return null_safe_join(df, t, [*keys, SLICE])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    measures: dict[str, Column],
    seconds: int = 60,
    include_current: bool = True,
    slice_by: Column | None = None,
) -> DataFrame:
    """Running sum of each measure per key in ``order`` (``ts`` must lead that order).

    ``slice_by`` cuts histories that are ordered by something else than time; it must grow with the order.
    """
    d = df.withColumn(SLICE, slice_of(F.col(ts), seconds) if slice_by is None else slice_by)
    d = d.withColumns({f"_m_{n}": c for n, c in measures.items()})
    d = carry(
        d, keys,
        {f"_s_{n}": F.sum(f"_m_{n}") for n in measures},
        lambda w: {
            f"_c_{n}": F.sum(f"_s_{n}").over(w.rowsBetween(Window.unboundedPreceding, -1)) for n in measures
        },
    )
    w = within(keys, order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    d = d.withColumns({
        n: F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(F.sum(f"_m_{n}").over(w), F.lit(0)) for n in measures
    })
    return d.drop(SLICE, *[f"_c_{n}" for n in measures], *[f"_m_{n}" for n in measures])


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    value: Column,
    name: str,
    seconds: int = 3600,
    following: bool = False,
) -> DataFrame:
    """The value of the row just before (or after) each row of its key, whatever slice it lies in."""
    d = df.withColumn(SLICE, slice_of(F.col(ts), seconds)).withColumn("_v", F.struct(value.alias("v")))
    pos = F.struct(*order)
    edge = F.min_by("_v", pos) if following else F.max_by("_v", pos)
    step = F.lead if following else F.lag
    d = carry(d, keys, {"_edge": edge}, lambda w: {"_n": step("_edge").over(w)})
    inner = step("_v").over(within(keys, order))
    return d.withColumn(name, F.coalesce(inner, F.col("_n"))["v"]).drop(SLICE, "_v", "_n")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    payload: Sequence[str],
    tie: Sequence[str] = (),
    seconds: int = 3600,
) -> DataFrame:
    """Give every left row the payload of the newest right row of its key at or before its time.

    Union and last value, never a range join. Where several right rows share a time, the last by ``tie`` counts.
    """
    rest = [c for c in left.columns if c not in keys and c != ts]
    tie_cols = [F.col(c) for c in tie] or [F.lit(0)]
    l = left.select(
        *keys, ts, F.lit(1).alias("_side"), F.struct(F.lit(0).alias("_one"), *rest).alias("_l"),
        F.lit(None).alias("_p"), F.lit(None).alias("_tie"),
    )
    r = right.select(
        *keys, ts, F.lit(0).alias("_side"), F.lit(None).alias("_l"),
        F.struct(*payload).alias("_p"), F.struct(*[c.alias(f"t{i}") for i, c in enumerate(tie_cols)]).alias("_tie"),
    )
    u = r.unionByName(l).withColumn(SLICE, slice_of(F.col(ts), seconds))
    u = carry(
        u, keys,
        {"_end": F.max_by("_p", F.when(F.col("_side") == 0, F.struct(ts, "_tie")))},
        lambda w: {"_before": F.last("_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))},
    )
    w = within(keys, [ts, "_side", "_tie"]).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_hit", F.coalesce(F.last("_p", ignorenulls=True).over(w), F.col("_before")))
    u = u.where("_side = 1")
    return u.select(
        *keys, ts, *[F.col("_l")[c].alias(c) for c in rest], *[F.col("_hit")[c].alias(c) for c in payload]
    )


def trailing_totals(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    row_id: str,
    measures: dict[str, Column],
    seconds: int,
    slice_seconds: int,
) -> DataFrame:
    """Totals of each measure over the earlier rows of the key that are younger than ``seconds``.

    Each row sends itself and a narrow probe that stands at the far end of its range. The total is the whole slices
    between them, plus the part of its own slice before the row, minus the part of the probe's slice up to the probe.
    No row is copied once per row that sees it. Row and probe find each other by a key made for the purpose, so rows
    without an id and rows of equal id all stay; ``row_id`` only breaks ties.
    """
    if seconds % slice_seconds:
        raise ValueError("the range must be a multiple of the slice")
    names = list(measures)
    us = F.unix_micros(F.col(ts))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    marks = df.select(
        *keys, F.monotonically_increasing_id().alias("_uid"), F.col(row_id).alias("_id"), whole.alias("_row"),
        us.alias("_us"), *[c.alias(f"_m_{n}") for n, c in measures.items()])
    marks = marks.withColumn("_mark", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("_us").alias("at")),
        F.struct(F.lit(1).alias("kind"), (F.col("_us") - F.lit(seconds * MICROS)).alias("at")),
    ))).select("*", "_mark.kind", "_mark.at").drop("_mark", "_us")
    marks = marks.withColumns({
        SLICE: F.floor(F.col("at") / F.lit(slice_seconds * MICROS)), "_row": F.when(F.col("kind") == 0, F.col("_row"))})
    own = {n: F.when(F.col("kind") == 0, F.col(f"_m_{n}")) for n in names}
    span = seconds // slice_seconds
    marks = carry(
        marks, keys,
        {f"_s_{n}": F.sum(c) for n, c in own.items()},
        lambda w: {f"_c_{n}": F.sum(f"_s_{n}").over(w.rangeBetween(-span, -1)) for n in names},
    )
    w = within(keys, ["at", "kind", "_id", "_uid"]).rowsBetween(Window.unboundedPreceding, -1)
    parts = []
    for n in names:
        before = F.coalesce(F.sum(own[n]).over(w), F.lit(0))
        parts.append(
            F.when(F.col("kind") == 0, before + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).otherwise(-before).alias(f"_t_{n}")
        )
    totals = marks.select("_uid", "_row", *parts).groupBy("_uid").agg(
        F.first("_row", ignorenulls=True).alias("_row"), *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in names])
    return totals.select("_row.*", *[F.col(f"_t_{n}").alias(n) for n in names])
