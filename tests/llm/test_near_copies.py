"""The pipeline's near-copy stage against all pairs compared on their sets of five-word shingles."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline as cp
import pytest

from tidewatch.llm import near_copies, shared, simhash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def groups(texts):
    """Position of the first text of each one's group."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
    return root


def family(rng, size, copies, changed):
    words = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = [" ".join(words)]
    for _ in range(copies):
        copy = list(words)
        for k in rng.sample(range(size), changed):
            copy[k] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("settings", [{}, {"turns": 3, "pairs_a_row": 0}])
def test_copies_with_a_few_changed_words_leave_one(spark, settings):
    rng = random.Random(11)
    texts = [t for size, changed in ((100, 1), (100, 2), (100, 4), (300, 5), (60, 2)) for t in family(rng, size, 4, changed)]
    texts += family(rng, 200, 40, 3) + ["", None, "  ", "one two", "One  TWO", "one two three four five", "one two three four six"]
    rows = list(enumerate(texts))
    docs = shared.store(spark.createDataFrame([(k, k, t) for k, t in rows], "row bigint, doc_id bigint, text string"), "copies")
    assert sorted(r.row for r in near_copies.first_rows(docs, **settings).collect()) == sorted(set(groups(texts)))


def test_the_stage_drops_a_near_copy_beyond_two_bits(spark):
    first, second = family(random.Random(2), 100, 1, 2)
    assert (simhash.fingerprint(first.encode()) ^ simhash.fingerprint(second.encode())).bit_count() > 2
    docs = spark.createDataFrame([(7, second, "en", "s", 1), (5, first, "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()] == [5]


def test_copies_within_two_bits_are_linked_by_their_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    texts = [t for _ in range(3) for t in family(rng, 1500, 5, 1)] + family(rng, 60, 4, 2) + ["", "one two"]
    docs = shared.store(spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row bigint, doc_id bigint, text string"), "copies")
    found, links = [], near_copies.near_links

    def noted(nodes, of, turns, pairs_a_row, known):
        found.extend(tuple(r) for r in known.collect())
        return links(nodes, of, turns, pairs_a_row, known)

    monkeypatch.setattr(near_copies, "near_links", noted)
    first = groups(texts)
    assert sorted(r.row for r in near_copies.first_rows(docs).collect()) == sorted(set(first))
    prints = [simhash.fingerprint(t.encode(), near_copies.WIDTH) % 2**64 for t in texts]
    close = [[k for k, q in enumerate(prints) if (p ^ q).bit_count() <= 2] for p in prints]
    # some are linked so, all of one group, and a text that is within two bits of the first of its group is linked
    assert found and all(first[a] == first[b] for a, b in found)
    linked = {x for pair in found for x in pair}
    assert linked >= {k for k in range(len(texts)) if k != first[k] and first[k] in close[k]}
