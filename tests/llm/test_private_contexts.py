"""Discovery of unseen identifiers: rare contexts beside a strong one, and contexts that hold digits."""

from __future__ import annotations

import pytest

from tidewatch.llm import private


def added(spark, texts):
    """The discovered (kind, value) of each text."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if s.kind >= 4] for r in private.find_private(docs).collect()}
    return [found[k] for k in range(len(texts))]


def test_a_rare_context_does_not_hide_an_identifier(spark):
    seeds = [f"write to mail address user{k}@host{k}.org now" for k in range(30)]
    unseen = ["write to mail address user77.host77.12345 now", "once more mail address user77.host77.12345 again", "somebody mumbled user77.host77.12345 there"]
    assert added(spark, seeds + unseen)[30:] == [[(4, "user77.host77.12345")], [(4, "user77.host77.12345")], []]


def test_a_common_context_without_seeds_does_not_hide_an_identifier(spark):
    seeds = [f"write to mail address user{k}@host{k}.org now" for k in range(30)]
    others = [f"order number X{k}-12345{k} of today" for k in range(12)]
    unseen = ["write to mail address X3-123453 now"]
    got = added(spark, seeds + others + unseen)
    assert got[-1] == [(4, "X3-123453")] and not any(got[30:42])


@pytest.mark.parametrize("number", [7, 42, "3 5 8 13"])
def test_digits_before_an_identifier_belong_to_its_context(spark, number):
    seeds = [f"unit {k % 10 if number == 7 else number} account user{k}@host{k}.org now" for k in range(30)]
    assert added(spark, [*seeds, f"unit {number} account AB-12345 now", "the account AB-12345 now"])[30:] == [[(4, "AB-12345")], []]
