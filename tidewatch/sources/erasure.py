"""Facts of subjects by day, from which subjects are erased by rewriting only the files that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import hash16
from tidewatch.functions.pointers import written
from tidewatch.sources.tables import _children

#: Up to so many subjects are conditions of their own, which the filters of a file can answer; more are joined.
AT_ONCE = 200


def write_subject_facts(facts: DataFrame, path: str, subject: str = "subject_id", ts: str = "ts", subjects_a_file: int = 100_000, mode: str = "append") -> None:
    """Facts by day, the files of a day ordered by the subject's hash, with a Bloom filter over it in each."""
    d = facts.withColumns({"subject_hash": hash16(F.col(subject)), "log_date": F.to_date(ts)})
    d = d.repartitionByRange("log_date", "subject_hash").sortWithinPartitions("log_date", "subject_hash")
    _write(d, path, subjects_a_file, mode)


def _write(d: DataFrame, path: str, subjects_a_file: int, mode: str) -> None:
    w = d.write.mode(mode).option("parquet.bloom.filter.enabled#subject_hash", "true")
    w.option("parquet.bloom.filter.expected.ndv#subject_hash", str(subjects_a_file)).partitionBy("log_date").parquet(path)


def _any_of(hashes: Sequence[str]) -> Column:
    found = F.lit(False)
    for h in hashes:
        found = found | (F.col("subject_hash") == h)
    return found


def _swap(spark: SparkSession, path: str) -> None:
    """Puts finished rewrites in place: the files that they replace go, theirs come in. May be repeated at any point."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for run in _children(spark, f"{path}/_erasing"):
        aside = f"{path}/_erasing/{run}"
        if "_SUCCESS" not in _children(spark, f"{aside}/replaced"):
            files.delete(hadoop.Path(aside), True)
            continue
        for row in spark.read.schema("file string").parquet(f"{aside}/replaced").toLocalIterator():
            files.delete(hadoop.Path(row.file), False)
        for day in _children(spark, f"{aside}/facts"):
            if day.startswith("log_date="):
                files.mkdirs(hadoop.Path(f"{path}/{day}"))
                for name in _children(spark, f"{aside}/facts/{day}"):
                    files.rename(hadoop.Path(f"{aside}/facts/{day}/{name}"), hadoop.Path(f"{path}/{day}/{name}"))
        files.delete(hadoop.Path(aside), True)


def erase_subjects(spark: SparkSession, path: str, erasures: DataFrame, subject: str = "subject_id", hold: str = "legal_hold", subjects_a_file: int = 100_000) -> int:
    """P9 on stored facts: rows of the erased subjects go, but for those on legal hold; returns how many files were rewritten.

    For few subjects, the ranges and Bloom filters of the files leave few to look into; many are joined, in one pass over the
    hashes. Only files with a row to erase are read and written again, each once, however many subjects there are; all others
    keep their names and times. Rewrites are finished aside, with the list of what they replace, and then
    put in place; a run that is lost is completed or thrown away by the next one. Nothing should read meanwhile.
    """
    path = path.rstrip("/")
    _swap(spark, path)
    gone = written(erasures.select(hash16(F.col(subject)).alias("_gone")).where("_gone IS NOT NULL").distinct(), "erased")
    facts = spark.read.parquet(path)
    free = ~F.coalesce(F.col(hold), F.lit(False))
    found = F.col("subject_hash") == F.col("_gone")
    asked = [r[0] for r in gone.limit(AT_ONCE + 1).collect()]
    few = len(asked) <= AT_ONCE
    looked = facts.where(F.coalesce(_any_of(asked), F.lit(False)) & free) if few else facts.where(free)
    held = looked.select("subject_hash", F.col("_metadata.file_path").alias("file"))
    held = held if few else held.join(gone, found, "left_semi")
    names = [r.file for r in held.select("file").distinct().toLocalIterator()]
    if not names:
        return 0
    aside = f"{path}/_erasing/0"
    kept = spark.read.option("basePath", path).schema(facts.schema).parquet(*names)
    if few:
        kept = kept.where(~(F.coalesce(_any_of(asked), F.lit(False)) & free))
    else:
        kept = kept.join(gone, found & free, "left_anti").repartitionByRange("log_date", "subject_hash")
    _write(kept.sortWithinPartitions("log_date", "subject_hash"), f"{aside}/facts", subjects_a_file, "overwrite")
    spark.createDataFrame([(n,) for n in names], "file string").coalesce(1).write.mode("overwrite").parquet(f"{aside}/replaced")
    _swap(spark, path)
    return len(names)
