"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import store


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
    return (
        both.join(least, "hi")
        .filter("lo > hi")
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .filter("hi <> lo")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node with a link: root is the smallest node reachable.

    links: two columns of one integer type, (a, b), in any order, repeats and a = b allowed. Rows with a null are no
    links. Only the links travel; every round is a written table, so no plan grows with the rounds. Reaching
    most_rounds raises (60 double the length of a path far beyond any table).
    """
    a, b = links.columns
    now = store(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "links",
    )
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        seen = state
        now = store(_small_star(_large_star(now)), "links")
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
