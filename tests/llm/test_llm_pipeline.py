"""The pipeline stage by stage against plain versions of what each stage decides."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from test_near_copies import groups
from tidewatch.llm import mixing, pieces, queries, shared

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    """What each stage returns, written and read again."""
    docs, out = shared.table(spark, SF, "documents"), []
    for name, stage in cp.STAGES:
        docs = shared.store(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_return_the_columns_of_documents(made):
    assert [name for name, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "source_mix", "piece_encoding"]
    assert all(tuple(d.columns) == cp.COLUMNS for d in made[:-1])


def test_good_documents_stay_and_poor_ones_go(spark, made):
    kept = {r.doc_id for r in made[0].collect()}
    labels = {r.doc_id: r.quality for r in shared.table(spark, SF, "labels").collect() if r.quality is not None}
    right = [(d in kept) == (q == 1) for d, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)


def test_one_of_each_group_stays(made):
    rows = sorted((r.doc_id, r.text) for r in made[1].select("doc_id", "text").collect())
    first = groups([t for _, t in rows])
    assert len(set(first)) < len(rows)
    assert sorted(r.doc_id for r in made[2].collect()) == sorted(rows[k][0] for k in set(first))


def test_one_row_stays_of_rows_that_share_an_id_or_have_none(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    one, two, three = "a text of some words that stands alone", "quite another one with nothing in common", "the third has its own words as well"
    rows = [(5, one), (5, one), (3, one), (5, two), (3, three), (None, one), (None, "x y z w"), (None, "x y z w"), (None, "no id either but other words")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], schema)
    got = sorted([(r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, SF).collect()], key=str)
    assert got == sorted([(3, one), (5, two), (3, three), (None, "x y z w"), (None, "no id either but other words")], key=str)


def test_the_mix_repeats_whole_rows(made):
    given = {r.doc_id: tuple(r) for r in made[2].collect()}
    wanted = {r.doc_id: r.copies for r in mixing.mix(made[2]).collect()}
    got = Counter(tuple(r) for r in made[3].collect())
    assert got == Counter({given[d]: n for d, n in wanted.items() if n})


def test_ids_read_back(made):
    back = made[4].select("doc_id", pieces.decode_pieces(F.col("ids"), queries.PIECE_MODEL).alias("text")).collect()
    texts = {r.doc_id: r.text for r in made[3].collect()}
    assert len(back) == made[3].count() and all(r.text == texts[r.doc_id] for r in back)


def test_odd_and_empty_documents_pass_through(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, size int"
    rows = [(1, None, None, None, None, "x", 1), (1, "", "en", "a", 0, "x", 1), (None, "one two", "en", "b", 7, "x", 1), (2, "z" * 100_000, "en", "a", 1, "x", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in cp.STAGES[1:]:
            docs = shared.store(stage(spark, docs, SF), "odd")
        assert docs.count() <= 2 * len(data)
