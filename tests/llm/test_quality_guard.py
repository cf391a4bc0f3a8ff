"""The pipeline's first stage where the classifier has nothing to learn from."""

from __future__ import annotations

import zlib

import corpus_pipeline as cp
import pytest

HELD_OUT = [k for k in range(60) if zlib.crc32(str(k).encode()) % 4 == 2]


@pytest.mark.parametrize("labels", [[(k, 1) for k in HELD_OUT], [(k, k % 2) for k in range(1000, 1050)], [(1, None)], []])
def test_all_documents_stay_where_no_row_can_be_learned_from(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(k, f"a clean text number {k}", "en", "s", 20) for k in range(60)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert cp.reject_poor(spark, docs, str(tmp_path)).count() == 60
