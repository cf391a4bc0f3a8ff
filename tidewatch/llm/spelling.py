"""Spelling variant grouping: words one edit apart, found by pivotal grams.

The bigrams of a word, with their positions, are ranked by how many there are in all words, rare ones first. The three
rarest (with all others of the third one's rank) are its prefix; among them two that do not overlap, with the least
sum, are its pivots, chosen by dynamic programming. One edit leaves one of two disjoint grams whole. So of two words one
edit apart, the one whose prefix ends at the lower rank has a pivot in the prefix of the other, at the same place or
moved by the difference in length. Words meet on (gram, length, place) and are verified there. Places with more words
than `hot_posting` are keyed by half a word as well: an edit leaves one of the two halves whole, so nothing is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import store

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Grams are known by a number below this, whatever the alphabet, so the table of their counts has a bound.
GRAMS = 1 << 16
#: Words that a task counts before it hands them on.
HELD = 200_000
#: (difference in length, difference in place) of a gram that an edit has left whole.
MOVES = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))


def slipped(word: str, seed: int, one_in: int) -> str:
    """The word without one letter, for one seed in one_in."""
    if seed % one_in:
        return word
    at = seed % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, slip_one_in: int | None = None) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z in lower case, of least_length letters and least_count occurrences.

    slip_one_in drops a letter of one in so many runs of a document, by the crc32 of "<doc_id>:<run>"; a document
    without an id keeps all its letters. A null text has no words. Tasks hand on sums, so a common word is a few rows.
    """

    def count(batches):
        seen: Counter[str] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column("id"), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                runs = Counter(RUN.findall(text.as_buffer().to_pybytes().lower().decode()))
                known = zlib.crc32(f"{name.as_py()}:".encode()) if name.is_valid and slip_one_in else None
                for word, n in runs.items():
                    if known is not None:
                        word = slipped(word, zlib.crc32(word.encode(), known), slip_one_in)
                    if len(word) >= least_length:
                        seen[word] += n
                if len(seen) >= HELD:
                    yield rows()
                    seen.clear()
        yield rows()

    parts = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def grams(word: str) -> list[int]:
    return [(ord(a) * 65_599 + ord(b)) % GRAMS for a, b in zip(word, word[1:], strict=False)]


def gram_ranks(words: DataFrame) -> np.ndarray:
    """The rank of each gram by its count in all words. Each task sends GRAMS numbers at most."""

    def count(batches):
        total = np.zeros(GRAMS, dtype=np.int64)
        for batch in batches:
            of = [g for word in batch.column(0).to_pylist() for g in grams(word)]
            total += np.bincount(np.array(of, dtype=np.int64), minlength=GRAMS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["gram", "n"])

    total = np.zeros(GRAMS, dtype=np.int64)
    for row in words.select("word").mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        total[row.gram] = row.n
    ranks = np.empty(GRAMS, dtype=np.int32)
    ranks[np.lexsort((np.arange(GRAMS), total))] = np.arange(GRAMS, dtype=np.int32)
    return ranks


def letters(word: str) -> int:
    """A bit for each letter, modulo 64, as a signed long. An edit changes two bits at most: one letter goes, one comes."""
    mask = 0
    for c in word:
        mask |= 1 << (ord(c) % 64)
    return mask - (1 << 64) if mask >> 63 else mask


def signature(word: str, ranks: np.ndarray) -> tuple[int, list[int], list[tuple[int, int]]]:
    """(last rank of the prefix, places of the two pivots, prefix as (rank, place)) of a word of four grams or more."""
    of = [int(ranks[g]) for g in grams(word)]
    last = sorted(of)[2]
    prefix = [(rank, place) for place, rank in enumerate(of) if rank <= last]
    # best[k]: least sum of k disjoint grams that end before the place; a gram covers two places
    one: list[tuple[int, list[int]]] = []
    two: tuple[int, list[int]] | None = None
    for rank, place in prefix:
        before = [x for x in one if x[1][0] <= place - 2]
        if before:
            sum_one, at = min(before)
            if two is None or sum_one + rank < two[0]:
                two = (sum_one + rank, [*at, place])
        if not one or rank < one[-1][0]:
            one.append((rank, [place]))
    return last, two[1], prefix


def _signatures(words: DataFrame, ranks: np.ndarray) -> DataFrame:
    entry = pa.list_(pa.struct([("gram", pa.int32()), ("place", pa.int32())]))

    def sign(batches):
        for batch in batches:
            lasts, masks, pivots, prefixes = [], [], [], []
            for word in batch.column("word").to_pylist():
                last, at, prefix = signature(word, ranks)
                masks.append(letters(word))
                lasts.append(last)
                rank_at = {place: rank for rank, place in prefix}
                pivots.append([{"gram": rank_at[p], "place": p} for p in at])
                prefixes.append([{"gram": r, "place": p} for r, p in prefix])
            made = [pa.array(lasts, pa.int32()), pa.array(masks, pa.int64()), pa.array(pivots, entry), pa.array(prefixes, entry)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *made], names=["word", "n", "last", "letters", "pivots", "prefix"])

    kind = "array<struct<gram:int,place:int>>"
    return words.select("word", "n").mapInArrow(sign, f"word string, n bigint, last int, letters bigint, pivots {kind}, prefix {kind}")


def _meet(pivots: DataFrame, prefixes: DataFrame, keys: list[str]) -> DataFrame:
    a, b = pivots.alias("a"), prefixes.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    fit = (F.col("a.last") <= F.col("b.last")) & (F.col("a.word") != F.col("b.word"))
    # few pairs pass the letters, so few are compared letter by letter
    alike = F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2
    near = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    return a.join(b, same & fit & alike & near).select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in ("a", "b") for c in ("word", "n")])


def near_words(words: DataFrame, hot_posting: int = 2048) -> DataFrame:
    """(word, n, other, other_n): every pair of words (word, n) exactly one inserted, deleted or replaced letter apart, both ways.

    Words are distinct and have five letters or more (shorter ones raise: they lack the grams that the search rests on).
    """
    if not words.filter(F.char_length("word") < 5).isEmpty():
        raise ValueError("words of five letters or more only")
    words = store(words.select("word", "n"), "words")
    signed = store(_signatures(words, gram_ranks(words)), "word_signatures").withColumn("length", F.char_length("word"))
    prefixes = signed.select("word", "n", "last", "letters", "length", F.inline("prefix"))
    moves = F.array(*[F.struct(F.lit(d).alias("longer"), F.lit(p).alias("moved")) for d, p in MOVES])
    pivots = signed.select("word", "n", "last", "letters", F.col("length").alias("own"), F.inline("pivots"))
    pivots = pivots.select("word", "n", "last", "letters", "own", "gram", "place", F.inline(moves))
    pivots = pivots.select("word", "n", "last", "letters", "own", "gram", (F.col("own") + F.col("longer")).alias("length"), (F.col("place") + F.col("moved")).alias("place"))
    pivots = pivots.filter("place >= 0")
    keys = ["gram", "length", "place"]
    hot = store(prefixes.groupBy(*keys).count().filter(F.col("count") > hot_posting).select(*keys), "hot_grams")
    if hot.isEmpty():
        pairs = _meet(pivots, prefixes, keys)
    else:
        pairs = _meet(pivots.join(hot, keys, "left_anti"), prefixes.join(hot, keys, "left_anti"), keys)

        def halved(rows: DataFrame, least: F.Column) -> DataFrame:
            half = F.floor(least / 2).cast("int")
            sides = F.array(
                F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("half")),
                F.struct(F.lit(1).alias("side"), F.substring("word", F.char_length("word") - (least - half) + 1, least - half).alias("half")),
            )
            return rows.withColumn("least", least).select("word", "n", "last", "letters", *keys, "least", F.inline(sides))

        mine = halved(pivots.join(hot, keys, "left_semi"), F.least("own", "length"))
        theirs = prefixes.join(hot, keys, "left_semi")
        theirs = halved(theirs, F.col("length")).unionByName(halved(theirs, F.col("length") - 1))
        pairs = pairs.unionByName(_meet(mine, theirs, [*keys, "least", "side", "half"]))
    back = pairs.select("word_b", "n_b", "word_a", "n_a")
    return pairs.union(back).distinct().toDF("word", "n", "other", "other_n")


def spelling_groups(docs: DataFrame, least_length: int = 5, least_count: int = 3, slip_one_in: int | None = None, hot_posting: int = 2048) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of docs (doc_id, text); other columns are ignored.

    form is the near word of largest n (the first in code-point order of several) where that n is twice the word's own or
    more, else null; root follows forms to the last, so it is the word itself without one. No words, no rows.
    """
    if least_length < 5:
        raise ValueError("words of five letters or more only")
    words = store(count_words(docs, least_length, least_count, slip_one_in), "counted_words")
    near = near_words(words, hot_posting)
    best = near.groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best")
    )
    fits = -F.col("best.less") >= 2 * F.col("n")
    best = store(
        best.select("word", "n_near", F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "word_forms"
    )
    # n doubles from word to form, so a chain is short and each round doubles what a pointer spans
    at = best.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = store(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word_roots")
        if at.filter("moved").isEmpty():
            break
        at = at.drop("moved")
    found = words.join(best, "word", "left").join(at.drop("moved"), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
