"""Exact quantiles without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.slices import null_safe_join


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with the value at 0-based rank ``floor(n * p)`` for each named probability."""
    return exact_ranks(df, keys, value, {name: lambda n, p=p: F.floor(n * F.lit(p)) for name, p in probs.items()})


def exact_ranks(df: DataFrame, keys: Sequence[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per group with the value at each named 0-based rank, a function of the number of values that are not null.

    Rows are first counted per distinct value (partial aggregation). Logarithmic bands of under one per cent then
    tell in which band each rank falls, and only the values of those bands are put in order. ``ln`` is monotone,
    so the bands keep the order of the values; their number per group is bounded by the range of the type.
    """
    v = F.col(value)
    counts = (
        df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
        .withColumn("_band", F.signum("_v") * F.floor(F.log1p(F.abs("_v")) * F.lit(128.0)))
    )
    bands = counts.groupBy(*keys, "_band").agg(F.sum("_k").alias("_k"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_band")
    bands = bands.withColumns({
        "_n": F.sum("_k").over(group),
        "_lo": F.sum("_k").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_k"),
    })
    ranks = {name: place(F.col("_n")) for name, place in places.items()}
    hit = F.lit(False)
    for r in ranks.values():
        hit = hit | ((F.col("_lo") <= r) & (r < F.col("_lo") + F.col("_k")))
    wanted = bands.where(hit).select(*keys, "_band", "_n", "_lo")
    inside = Window.partitionBy(*keys, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = null_safe_join(counts, wanted, [*keys, "_band"]).withColumn(
        "_hi", F.col("_lo") + F.sum("_k").over(inside)
    )
    at = [
        F.max(F.when((F.col("_hi") - F.col("_k") <= r) & (r < F.col("_hi")), F.col("_v"))).alias(n)
        for n, r in ranks.items()
    ]
    return ranked.groupBy(*keys).agg(*at)
