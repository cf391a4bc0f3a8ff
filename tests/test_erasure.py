"""Erasure by rewriting the files that hold a subject: what is left, what is untouched, and lost runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import erasure

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = [(k, f"s{k % 50}", T0 + dt.timedelta(days=k % 4), k % 100 == 7) for k in range(2000)]
    facts = spark.createDataFrame(rows, "request_id long, subject_id string, ts timestamp, legal_hold boolean")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    erasure.write_subject_facts(facts, path)
    return path, rows


def files(path):
    from pathlib import Path

    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def erased(spark, *subjects):
    return spark.createDataFrame([(s,) for s in subjects], "subject_id string")


def left(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("request_id", "subject_id", "ts", "legal_hold").collect())


def test_only_files_that_hold_the_subject_are_written_again(spark, stored):
    path, rows = stored
    before = files(path)
    n = erasure.erase_subjects(spark, path, erased(spark, "s7", "nobody"))
    after = files(path)
    assert left(spark, path) == sorted(r for r in rows if r[1] != "s7" or r[3]) and any(r[1] == "s7" for r in left(spark, path))
    same = {f for f in before if after.get(f) == before[f]}
    assert 0 < n == len(before) - len(same) < len(before)
    assert erasure.erase_subjects(spark, path, erased(spark, "s7")) == 0 and files(path) == after


def test_a_lost_run_is_completed_or_thrown_away(spark, stored, monkeypatch):
    path, rows = stored
    swap, calls = erasure._swap, iter(range(9))

    def fails(spark, path):
        if next(calls) == 1:
            raise OSError("lost")
        swap(spark, path)

    monkeypatch.setattr(erasure, "_swap", fails)
    with pytest.raises(OSError):
        erasure.erase_subjects(spark, path, erased(spark, "s3"))
    assert left(spark, path) == sorted(rows)
    monkeypatch.setattr(erasure, "_swap", swap)
    erasure.erase_subjects(spark, path, erased(spark))
    assert left(spark, path) == sorted(r for r in rows if r[1] != "s3" or r[3])


def test_files_carry_bloom_filters(spark, stored):
    import pyarrow.parquet as pq

    path, _ = stored
    column = pq.ParquetFile(next(iter(files(path)))).metadata.row_group(0)
    names = [column.column(k).path_in_schema for k in range(column.num_columns)]
    assert "subject_hash" in names
    with open(next(iter(files(path))), "rb") as f:
        assert f.read(4) == b"PAR1"
    text = spark.read.parquet(path).where(F.col("subject_hash") == "x")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(subject_hash,x)" in text


def test_many_subjects_rewrite_each_file_once_and_rows_without_a_subject_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "facts")
    rows = [(k, None if k % 9 == 0 else f"s{k % 50}", T0 + dt.timedelta(days=k % 4), k % 100 == 7) for k in range(2000)]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    erasure.write_subject_facts(spark.createDataFrame(rows, "request_id long, subject_id string, ts timestamp, legal_hold boolean"), path)
    before = files(path)
    gone = [f"s{k}" for k in range(0, 50, 2)]
    monkeypatch.setattr(erasure, "AT_ONCE", 4)
    assert erasure.erase_subjects(spark, path, erased(spark, *gone, None)) <= len(before)
    want = [r for r in rows if r[1] not in gone or r[3]]
    key = lambda r: r[0]
    got = spark.read.parquet(path).select("request_id", "subject_id", "ts", "legal_hold").collect()
    assert sorted((tuple(r) for r in got), key=key) == want
    erasure.erase_subjects(spark, path, erased(spark, "s1"))
    got = spark.read.parquet(path).select("request_id", "subject_id", "ts", "legal_hold").collect()
    assert sorted((tuple(r) for r in got), key=key) == [r for r in want if r[1] != "s1" or r[3]]
