"""Repositories in secret scans, identifiers with late digits, run tables after a failure, and one grown tree by exhaustive search."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, private, quality, secrets


def test_a_value_in_many_repositories_of_one_owner_is_an_example(spark):
    spread, live = "Zx9qL2mV7tR4bN8kW3pJ5cHd", "Ab1cD2eF3gH4iJ5kL6mN7"
    rows = [(k, "one", f"see {spread} now") for k in range(30)] + [(90 + k, "one", f"here {live} is") for k in range(4)]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), copied_within=25).collect()}
    assert all(got[k].spans == [] and got[k].n_example == 1 and got[k].n_live == 0 for k in range(30))
    assert all(len(got[90 + k].spans) == 1 and got[90 + k].n_live == 1 for k in range(4))


@pytest.mark.parametrize("letters", [3, 40, 41, 60, 300])
def test_an_identifier_is_found_wherever_its_digits_begin(spark, letters):
    unseen = "a" * letters + "-12345"
    seeds = [f"write to mail address user{k}@host{k}.org now" for k in range(30)]
    docs = spark.createDataFrame(list(enumerate([*seeds, f"write to mail address {unseen} now"])), "doc_id bigint, text string")
    last = max(private.find_private(docs).collect(), key=lambda r: r.doc_id)
    assert [(s.start, s.end) for s in last.spans if s.kind >= 4] == [(22, 22 + len(unseen))]


def test_long_runs_without_digits_take_one_look(spark):
    docs = spark.createDataFrame([(1, "a." * 100_000), (2, "b" * 200_000)], "doc_id bigint, text string")
    assert [r.spans for r in private.find_private(docs).collect()] == [[], []]


def test_no_run_table_is_left_after_a_failure(spark, monkeypatch):
    def tables():
        return {r.tableName for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith("line_run")}

    before, calls = tables(), iter(range(9))
    add = line_dedup.LineRuns.add

    def fails(self, lines):
        if next(calls) == 2:
            raise RuntimeError("lost")
        add(self, lines)

    monkeypatch.setattr(line_dedup.LineRuns, "add", fails)
    docs = spark.createDataFrame([(k, "a line that many documents have in common, it is so\nother") for k in range(40)], "doc_id bigint, text string")
    with pytest.raises(RuntimeError):
        line_dedup.dedup_lines(docs).count()
    assert tables() == before


def test_columns_of_the_operators_own_names_go_through(spark):
    names = ("_lines", "_hash", "_row", "_gone", "n_lines", "n_dropped", "kept_text")
    docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id bigint, text string").withColumns({c: F.lit("own") for c in names})
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert (got[1].n_lines, got[1].kept_text, got[2].kept_text) == (2, "a\nb", "")
    assert all(got[1][c] == "own" for c in names[:4])
    assert len(line_dedup.dedup_lines(docs).columns) == len(docs.columns)


def test_a_tree_is_what_an_exhaustive_search_grows():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 9, size=(60, 3)).astype(float)
    target = ((rows[:, 0] > 4) ^ (rng.random(60) < 0.1)).astype(float)
    grown = quality.boost(rows, target, trees=1, depth=2, rate=1.0, bins=64, ridge=1.0, least=3.0)
    up = (target.sum() + 1) / 62
    slope, curve = target - up, np.full(60, up * (1 - up))

    def best(inside):
        g, h, found = slope[inside].sum(), curve[inside].sum(), (1e-6, None)
        for f in range(3):
            for cut in np.unique(np.quantile(rows[:, f], np.linspace(0, 1, 65)[1:-1])):
                left, right = inside & (rows[:, f] <= cut), inside & (rows[:, f] > cut)
                if 4 * curve[left].sum() < 3 or 4 * curve[right].sum() < 3:
                    continue
                gain = sum(slope[s].sum() ** 2 / (curve[s].sum() + 1) for s in (left, right)) - g**2 / (h + 1)
                if gain > found[0] + 1e-12:
                    found = (gain, (f, cut))
        return found[1]

    nodes = {0: np.ones(60, dtype=bool)}
    for node in itertools.chain([0], [1, 2]):
        if node not in nodes:
            continue
        split = best(nodes[node])
        if split is None:
            assert grown.feature[0][node] == -1
            continue
        f, cut = split
        inside = nodes[node]
        mine = inside & (rows[:, grown.feature[0][node]] <= grown.threshold[0][node])
        assert (mine == (inside & (rows[:, f] <= cut))).all()
        nodes[2 * node + 1], nodes[2 * node + 2] = mine, inside & ~mine
    for node, inside in nodes.items():
        assert grown.value[0][node] == pytest.approx(slope[inside].sum() / (curve[inside].sum() + 1))


def test_scoring_an_empty_table(spark):
    model = quality.boost(np.empty((0, len(quality.FEATURES))), np.empty(0))
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert docs.select(quality.quality_score(F.col("text"), model)).count() == 0
