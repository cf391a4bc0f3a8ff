"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, from the largest ids down. A run is a table of line keys, bucketed and sorted by key; each
batch merges with the runs that stand (same buckets, so the runs are not shuffled), keys that no run holds enter with
their holder in this batch, known keys only with their count, and the batch is added as a run of its own. As many runs
of a level as `fanout` are compacted into one of the next level by merging them; two runs merge without a shuffle.
"""

from __future__ import annotations

import functools
import operator
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.shared import BLANKS, LOWER, UPPER, store


def line_key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is right and quick where each character is one byte
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_length: int) -> DataFrame:
    """(doc_id, text_hash, pos, first, key) of each line with a key of min_length or more; first marks one per text."""
    bare = F.transform(split_lines(F.col("text")), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("pos")))
    long = F.filter(bare, lambda x: F.char_length(x["key"]) >= min_length)
    hashed = F.transform(
        long, lambda x: F.struct(F.unhex(F.substring(F.sha2(x["key"], 256), 1, 32)).alias("key"), x["pos"].alias("pos"))
    )
    by_doc = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.sort_array(hashed).alias("keys"))
    marked = F.transform(
        "keys",
        lambda x, i: F.struct(
            x["key"].alias("key"),
            x["pos"].alias("pos"),
            ((i == 0) | (F.get("keys", i - 1)["key"] != x["key"])).alias("first"),
        ),
    )
    return by_doc.select("doc_id", "text_hash", F.explode(marked).alias("x")).select("doc_id", "text_hash", "x.*")


class LineRuns:
    """Runs of (key, n_docs, holder) at levels; `add` takes (key, doc_id, first) rows of one batch."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = defaultdict(list)

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").saveAsTable(name)
        self.levels[level].append(name)

    def _runs(self) -> list[str]:
        return [name for level in sorted(self.levels) for name in self.levels[level]]

    def _merge(self, names: list[str]) -> DataFrame:
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("key", F.col("n_docs").alias("more"), F.col("holder").alias("other"))
            return a.join(b, "key", "full").select(
                "key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("holder", "other").alias("holder")
            )

        return functools.reduce(two, [self.spark.table(n) for n in names])

    def add(self, batch: DataFrame) -> None:
        keys = batch.groupBy("key").agg(F.sum(F.col("first").cast("long")).alias("n_docs"), F.max("doc_id").alias("holder"))
        known = []
        for k, name in enumerate(self._runs()):
            run = self.spark.table(name).select("key", F.lit(True).alias(f"in_{k}"))
            keys = keys.join(run, "key", "left")
            known.append(F.col(f"in_{k}").isNotNull())
        fresh = ~functools.reduce(operator.or_, known) if known else F.lit(True)
        self._write(keys.select("key", "n_docs", F.when(fresh, F.col("holder")).alias("holder")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._write(self._merge(names), level + 1)
            for name in names:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def merged(self) -> DataFrame:
        return self._merge(self._runs())

    def drop(self) -> None:
        for name in self._runs():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels.clear()


def frequent_lines(lines: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(key, holder) of the keys in min_docs documents or more; holder is the largest doc_id that has it."""
    shares = [k / batches for k in range(1, batches)]
    cuts = lines.agg(F.percentile_approx("doc_id", shares).alias("cuts")).first()["cuts"] if shares else []
    cuts = sorted(set(cuts or []), reverse=True)
    doc = F.col("doc_id")
    ranges = []
    for k in range(len(cuts) + 1):
        above = doc > cuts[k] if k < len(cuts) else doc.isNull() | (doc <= cuts[-1]) if cuts else F.lit(True)
        ranges.append(above & (doc <= cuts[k - 1]) if 0 < k < len(cuts) else above)
    runs = LineRuns(lines.sparkSession, fanout)
    try:
        for k in ranges:
            runs.add(lines.filter(k))
        return store(runs.merged().filter(F.col("n_docs") >= min_docs).select("key", "holder"), "frequent_lines")
    finally:
        runs.drop()


def dedup_lines(docs: DataFrame, min_length: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Add n_lines, n_dropped and kept_text to docs (doc_id, text and any other columns; columns of these three names are replaced).

    A line whose key has min_length code points or more and stands in min_docs documents or more goes from all of them
    but the one with the largest doc_id. Null and empty texts are one empty line. A key twice in a text counts once,
    and both its lines stay or go. Each row is a document: a repeated row counts again, and rows that share the largest
    doc_id all keep their lines. A null doc_id is smaller than any other; where no holder has an id, all keep the line.
    Very long texts are split whole; an empty table stays empty.
    """
    lines = store(line_keys(docs.select("doc_id", "text"), min_length), "lines")
    frequent = frequent_lines(lines, min_docs, batches, fanout)
    gone = (
        lines.join(frequent, "key")
        .filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy(F.col("doc_id").alias("_gone_doc"), F.col("text_hash").alias("_gone_hash"))
        .agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    )
    row = F.struct(*[c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]).alias("_row")
    whole = docs.select(row, "doc_id", "text", split_lines(F.col("text")).alias("_lines"), F.xxhash64("text").alias("_hash")).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_gone_doc")) & (F.col("_hash") == F.col("_gone_hash")), "left"
    )
    # the stretches between dropped positions, each cut out once
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("_gone", i - 1) + 1)
    gaps = F.transform(F.concat(F.col("_gone"), F.array(F.size("_lines"))), lambda end, i: F.slice("_lines", start(i) + 1, end - start(i)))
    made = whole.select(
        "_row",
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(F.flatten(gaps), "\n"))
        .alias("kept_text"),
    )
    return made.select("_row.*", "n_lines", "n_dropped", "kept_text")
