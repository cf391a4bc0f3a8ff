"""Chains of pointers followed by doubling: what a walk from given starts comes to, without walking step by step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.slices import asof_join, null_safe_join
from tidewatch.session import work_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written in the shared folder and read back, where a plan would else compute it several times."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def next_at(left: DataFrame, wanted: Column, right: DataFrame, keys: Sequence[str], at: Column, name: str, value: Column | None = None, seconds: int = 3600) -> DataFrame:
    """left with the smallest ``at`` of right with equal keys that is ``wanted`` or more (or its ``value``), null where there is none.

    Times are in microseconds. An as-of join against time: histories are cut into slices, so a hot key is not one task's work.
    """
    back = lambda us: F.timestamp_micros(-us)
    stops = right.select(*keys, back(at).alias("_back"), (at if value is None else value).alias(name))
    return asof_join(left.withColumn("_back", back(wanted)), stops, keys, "_back", [name], seconds=seconds).drop("_back")


def reached(pointers: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, at): the starts (keys, at) and all that the pointers (keys, at, to) lead to from them, one row each.

    Pointers lead ahead, from a smaller ``at`` to a larger ``to``. Every round doubles how far a pointer spans and joins
    it to what is reached so far, so a chain of a million takes twenty rounds; each round is a written table of one row
    a pointer at most. A null ``to`` ends a chain; null keys are keys like others.
    """
    jumps = written(pointers.where("to IS NOT NULL").select(*keys, "at", "to"), "jumps")
    found = written(starts.select(*keys, "at").distinct(), "reached")
    while True:
        ahead = null_safe_join(found, jumps, [*keys, "at"]).select(*keys, F.col("to").alias("at")).distinct()
        there = found.select(*[F.col(c).alias(f"_there_{c}") for c in (*keys, "at")])
        same = F.lit(True)
        for c in (*keys, "at"):
            same = same & F.col(c).eqNullSafe(F.col(f"_there_{c}"))
        new = written(ahead.join(there, same, "left_anti"), "ahead")
        if new.isEmpty():
            return found
        found = written(found.unionByName(new), "reached")
        on = jumps.select(*keys, F.col("at").alias("to"), F.col("to").alias("_far"))
        jumps = written(null_safe_join(jumps, on, [*keys, "to"]).select(*keys, "at", F.col("_far").alias("to")), "jumps")
