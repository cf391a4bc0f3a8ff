"""Age phases, retention and rollover of day partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First age in days of each phase.
POLICIES = {
    "logs": {"hot": 0, "warm": 7, "cold": 30, "delete": 90},
    "metrics": {"hot": 0, "warm": 3, "delete": 30},
    "events": {"hot": 0, "warm": 7, "delete": 60},
    "ai-metrics": {"hot": 0, "warm": 7, "cold": 30, "delete": 90},
    "ai-compliance": {"hot": 0, "warm": 30, "cold": 90, "frozen": 365, "delete": 2555},
    "ai-audit": {"hot": 0, "warm": 14, "cold": 60, "frozen": 180, "delete": 3650},
}
GB = 1 << 30
# Rollover at age in days, primary bytes, documents.
ROLLOVER = {
    "logs": (1, 50 * GB, 10_000_000),
    "metrics": (1, 30 * GB, 5_000_000),
    "events": (1, 50 * GB, 10_000_000),
    "ai-metrics": (1, 50 * GB, 10_000_000),
    "ai-compliance": (1, 50 * GB, 5_000_000),
    "ai-audit": (1, 30 * GB, 2_000_000),
}


def age_in_days(day: Column, as_of) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), day)


def _per_policy(policy: Column, make) -> Column:
    out = F.lit(None)
    for name in POLICIES:
        out = F.when(policy == name, make(name)).otherwise(out)
    return out


def lifecycle_phase(partitions: DataFrame, as_of, policies: dict = POLICIES) -> DataFrame:
    """The phase of each (policy, log_date) partition by its age; policies are one expression, no join."""
    age = age_in_days(F.col("log_date"), as_of)

    def phase(name):
        steps = sorted(policies[name].items(), key=lambda x: -x[1])
        out = F.lit(None).cast("string")
        for label, first in reversed(steps):
            out = F.when(age >= first, label).otherwise(out)
        return out

    return partitions.withColumns({"age_days": age, "phase": _per_policy(F.col("policy"), phase)})


def apply_retention(df: DataFrame, policy: str, as_of, hold: str = "legal_hold", day: str = "log_date") -> DataFrame:
    """Rows younger than the delete age; rows under legal hold stay for ever. The day filter prunes partitions."""
    first_kept = F.date_sub(F.lit(as_of).cast("date"), POLICIES[policy]["delete"])
    return df.where((F.col(day) > first_kept) | F.coalesce(F.col(hold), F.lit(False)))


def rollover_plan(daily_stats: DataFrame, as_of, rollover: dict = ROLLOVER) -> DataFrame:
    """Partitions due for rollover by age, primary bytes or documents."""
    age = age_in_days(F.col("log_date"), as_of)

    def due(name):
        days, size, docs = rollover[name]
        return F.concat_ws(
            ",", F.when(age >= days, "age"), F.when(F.col("primary_bytes") >= size, "size"), F.when(F.col("docs") >= docs, "docs"))

    d = daily_stats.withColumn("reasons", _per_policy(F.col("policy"), due))
    return d.withColumn("rollover", F.col("reasons") != "")
