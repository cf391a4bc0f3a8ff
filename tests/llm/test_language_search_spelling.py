"""The operators of language, ranked search and spelling on small cases, against plain versions of their definitions."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import language, queries, ranked_search, shared, spelling

SF = "/root/testdata/sf0.001"


def table_of(spark, rows, extra="", schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in extra.split()})


# --- ranked search


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    big_n, big_l = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * big_n) // big_l
            score = 0
            for t in terms(text):
                if t in b:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def random_docs(n, seed, longest=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(150)] + ["Déjà", "x9", "THE", "naïve"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(k, " ,;".join(rng.choices(words, weights, k=rng.randint(0, longest)))) for k in range(n)]


@pytest.mark.parametrize("k", [1, 20])
def test_search_equals_brute_force(spark, k):
    docs = random_docs(400, 1) + [(900, None), (901, ""), (902, " .!"), (903, "the the the w1"), (903, "the the the w1"), (None, "the w1 w1"), (904, "w3 " * 40_000)]
    items = random_docs(25, 2, 12) + [(500, "nowhere"), (501, None), (502, "w1 w1 w1 the"), (502, "w2"), (503, "")]
    index = ranked_search.build_index(table_of(spark, docs, "n m sketch terms score query").repartition(3))
    got = ranked_search.search(index, table_of(spark, items, "query term rank", "item_id bigint, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == ranked(docs, items, k)


def test_search_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "TERMS_A_PASS", 40)
    docs, items = random_docs(150, 5), random_docs(30, 6, 12)
    got = ranked_search.search(ranked_search.build_index(table_of(spark, docs)), table_of(spark, items, schema="item_id bigint, text string"), 5)
    assert sorted([tuple(r) for r in got.collect()], key=str) == ranked(docs, items, 5)


def test_search_of_empty_tables(spark):
    for docs, items in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, None)])):
        index = ranked_search.build_index(table_of(spark, docs))
        assert ranked_search.search(index, table_of(spark, items, schema="item_id bigint, text string")).count() == 0


def test_sketches_bound_scores_and_skip_most_documents():
    rng = random.Random(4)
    for size in (1, 20, 500, 5000):
        names = [f"t{rng.randrange(10**6)}".encode() for _ in range(size)]
        counts = np.array([rng.randint(1, 9) for _ in names])
        impact = ranked_search.impacts(counts, 100)
        cells = ranked_search.sketch(ranked_search._hashes(names), impact)
        at = ranked_search._cells(ranked_search._hashes(names), len(cells))
        assert (cells[at].astype(int) * ranked_search.GRAIN >= impact).all()
        assert size < 20 or (cells > 0).mean() < 0.3


# --- spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def words_of(docs, slip):
    seen = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if slip and d is not None and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 3}


def grouped(words):
    rows = {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        rows[w] = (form, n, len(others), words[form] if form else None)
    out = []
    for w, (form, n, n_near, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, n, n_near, form_n))
    return sorted(out)


def spelled_docs(seed=7):
    rng = random.Random(seed)
    letters = "abcdeéÀ"
    stems = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "ababab", "bababa", "ÀÀÀÀÀ", "ÿ×÷öø"]
    docs = []
    for k in range(300):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(stems)
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]))
            words.append(w.title() if rng.random() < 0.2 else w)
        docs.append((k if k % 50 else None, " ".join(words)))
    return docs + [(400, None), (401, ""), (402, "12 -- 3"), (403, "Straße straße strasse " * 3000)]


@pytest.mark.parametrize(("slip", "hot"), [(None, 2048), (7, 2048), (7, 3)])
def test_spelling_groups_equal_brute_force(spark, slip, hot):
    docs = spelled_docs()
    got = spelling.spelling_groups(table_of(spark, docs, "word n form root last gram"), slip_one_in=slip, hot_posting=hot)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = grouped(words_of(docs, slip))
    assert len(want) > 150 and any(r[1] for r in want)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_roots_follow_a_chain(spark):
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb"]
    docs = [(k, " ".join([w] * 3 * 2**k)) for k, w in enumerate(chain)]
    got = {r.word: (r.form, r.root) for r in spelling.spelling_groups(table_of(spark, docs)).collect()}
    assert got == {w: (chain[min(k + 1, 5)] if k < 5 else None, chain[5]) for k, w in enumerate(chain)}


def test_spelling_of_empty_tables_and_short_words(spark):
    assert spelling.spelling_groups(table_of(spark, [])).count() == 0
    assert spelling.spelling_groups(table_of(spark, [(1, None), (2, "abc abc abc")])).count() == 0
    with pytest.raises(ValueError):
        spelling.near_words(spark.createDataFrame([("abc", 3)], "word string, n bigint"))


def test_pivots_are_disjoint_and_least():
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("abc", k=rng.randint(5, 12)))
        ranks = np.array(rng.sample(range(spelling.GRAMS), spelling.GRAMS), dtype=np.int32) if _ % 50 == 0 else ranks  # noqa: F821
        last, at, prefix = spelling.signature(word, ranks)
        rank = {p: r for r, p in prefix}
        best = min(rank[a] + rank[b] for a, b in itertools.combinations(sorted(rank), 2) if b - a >= 2)
        assert abs(at[0] - at[1]) >= 2 and sum(rank[p] for p in at) == best and max(r for r, _ in prefix) == last


# --- language


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(shared.table(spark, "/root/testdata/sf0.01", "documents"))


def test_held_out_documents_get_their_language(spark, model):
    docs = shared.table(spark, "/root/testdata/sf0.01", "documents").filter("lang IS NOT NULL AND text RLIKE '[A-Za-z]'")
    told = docs.filter(language.held_out(F.col("doc_id"))).select("lang", language.language(F.col("text"), model).alias("x")).collect()
    assert len(told) > 100 and sum(r.lang == r.x["lang"] for r in told) >= 0.98 * len(told)
    assert all(0 <= r.x["score"] <= 1 for r in told)


def test_families_come_first(model):
    assert model.families == (("de", "en"), ("es", "fr")) and model.pairs == (("de", "en"), ("es", "fr"))


def test_texts_without_letters_are_undetermined(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the and of the " * 30_000), (4, "le de la les"), (None, "x")]
    told = table_of(spark, rows, "lang score at").select("text", language.language(F.col("text"), model).alias("x")).collect()
    assert [r.x["lang"] == "und" for r in told] == [True, True, True, False, False, False]
    assert all((r.x["score"] == 0.0) == (r.x["lang"] == "und") for r in told)


def test_the_label_of_a_document_is_no_input(spark):
    docs = shared.table(spark, SF, "documents")
    first = {r.doc_id: tuple(r) for r in queries.op11_language_id(spark, SF).collect()}
    model = language.fit(docs)
    swapped = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")}).select("doc_id", language.language(F.col("text"), model).alias("x"))
    assert all(first[r.doc_id][2:] == (r.x["lang"], r.x["score"]) for r in swapped.collect())


def test_models_of_no_and_of_one_language(spark):
    schema = "doc_id bigint, text string, lang string"
    none = language.fit(spark.createDataFrame([(1, "abc", None), (None, "abc", "en"), (2, None, "en"), (3, "12", "en")], schema))
    assert none.families == () and none.predict(np.zeros(language.CELLS)) == ("und", 0.0)
    rows = [(k, f"hello there {k}", "en") for k in range(20)] + [(k, "hello there", "en") for k in range(20)]
    one = language.fit(spark.createDataFrame(rows, schema))
    assert one.predict(language.vector(language.cells("hello"))) == ("en", 1.0)


def test_a_hot_language_and_id_stay_within_the_sample(spark):
    rows = [(7, f"same id {k}", "en") for k in range(500)] + [(k, f"un texte {k}", "fr") for k in range(400)] + [(k, f"ein text {k}", "zz") for k in range(30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), most_rows=60)
    assert sorted(x for f in model.families for x in f) == ["en", "fr", "zz"]
    assert model.predict(language.vector(language.cells("un texte 3")))[0] == "fr"


def test_machines_part_what_can_be_parted():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 10)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sign = np.where(x[:, 0] > 0.1, 1, -1)
    keep = np.abs(x[:, 0] - 0.1) > 0.1
    w = language.machine(x[keep], sign[keep], rounds=400, cost=1000.0)
    assert (np.sign(x[keep] @ w[:-1] + w[-1]) == sign[keep]).mean() >= 0.98
