"""SimHash near-dedup over an inverted index of byte positions.

Fingerprints of 8 bytes at distance k differ in k bytes at most, so a pair within 2 bits shares 6 of its 8 positional
bytes or more. A posting is keyed by four positional bytes (two of the four byte pairs): such a pair meets in one of the
six postings at least. Postings with more rows than `hot_posting` are keyed by two more positional bytes, which loses no
pair for the same reason. Pairs that meet tally all their shared positional bytes; those with 6 or more are verified
by their distance. A pair counts only in the first posting in which it meets, so no pair is made twice.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.graph import components
from tidewatch.llm.shared import store

SEED = 42
#: Two of four byte pairs, and two of four single bytes, in the order in which a pair looks for its first meeting.
CHOICES = tuple(itertools.combinations(range(4), 2))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits, each set if over half the shingles' hashes have it; words are parted by blanks, A-Z in lower case."""
    words = text.lower().split()  # on bytes: ASCII letters and the six ASCII blanks only
    if not words:
        return 0
    if len(words) <= width:
        hashes = xxhash.xxh64_digest(b" ".join(words), SEED)
    else:
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - width].tolist() if width > 1 else (ends - lengths).tolist()
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    counts = np.stack([np.bincount(rows[:, k], minlength=256) for k in range(8)]) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(rows)).tobytes(), "big", signed=True)


def fingerprint_column(text: Column, width: int = 3) -> Column:
    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in texts.cast(pa.large_binary())], pa.int64())

    return prints(text)


def _pair_of_bytes(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, 16 * k).bitwiseAND(F.lit(65535))


def _byte(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, 8 * k).bitwiseAND(F.lit(255))


def _postings(prints: DataFrame) -> DataFrame:
    keys = [
        F.struct(F.lit(n).alias("choice"), (F.shiftleft(_pair_of_bytes(F.col("fp"), i), 16) + _pair_of_bytes(F.col("fp"), j)).alias("key"))
        for n, (i, j) in enumerate(CHOICES)
    ]
    return prints.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.*", F.lit(-1).alias("more"))


def _narrowed(postings: DataFrame) -> DataFrame:
    """Each row of a posting once for every two of the four bytes that its key lacks."""
    out = None
    for n, (i, j) in enumerate(CHOICES):
        rest = [b for k in range(4) if k not in (i, j) for b in (2 * k, 2 * k + 1)]
        subs = [
            F.struct(F.lit(m).alias("more"), (F.shiftleft(_byte(F.col("fp"), rest[a]), 8) + _byte(F.col("fp"), rest[b])).alias("low"))
            for m, (a, b) in enumerate(CHOICES)
        ]
        rows = postings.filter(F.col("choice") == n).select("fp", "choice", "key", F.explode(F.array(*subs)).alias("x"))
        rows = rows.select("fp", "choice", (F.shiftleft("key", 16) + F.col("x.low")).alias("key"), F.col("x.more").alias("more"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _first_meeting(x: Column) -> tuple[Column, Column]:
    """For x = a XOR b: the first choice of byte pairs that agree, and within it that of two single bytes."""
    same = [_pair_of_bytes(x, k) == 0 for k in range(4)]
    choice, more = F.lit(-1), F.lit(-1)
    for n, (i, j) in reversed(list(enumerate(CHOICES))):
        rest = [b for k in range(4) if k not in (i, j) for b in (2 * k, 2 * k + 1)]
        inner = F.lit(-1)
        for m, (a, b) in reversed(list(enumerate(CHOICES))):
            inner = F.when((_byte(x, rest[a]) == 0) & (_byte(x, rest[b]) == 0), F.lit(m)).otherwise(inner)
        choice = F.when(same[i] & same[j], F.lit(n)).otherwise(choice)
        more = F.when(same[i] & same[j], inner).otherwise(more)
    return choice, more


def near_pairs(prints: DataFrame, max_distance: int = 2, hot_posting: int = 512) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp) that differ in max_distance bits or fewer, 2 at most."""
    if not 0 <= max_distance <= 2:
        raise ValueError("two byte pairs agree for certain only up to 2 bits")
    postings = _postings(prints.select("fp").filter("fp IS NOT NULL").distinct())
    hot = postings.groupBy("choice", "key").count().filter(F.col("count") > hot_posting).select("choice", "key")
    hot = store(hot, "hot_postings")
    if not hot.isEmpty():
        rest = postings.join(hot, ["choice", "key"], "left_anti")
        postings = rest.unionByName(_narrowed(postings.join(hot, ["choice", "key"], "left_semi")).select(*rest.columns))
    postings = store(postings, "postings")
    a, b = postings.alias("a"), postings.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    tally = sum((_byte(x, k) == 0).cast("int") for k in range(8))
    choice, more = _first_meeting(x)
    return a.join(
        b,
        (F.col("a.choice") == F.col("b.choice"))
        & (F.col("a.more") == F.col("b.more"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (tally >= 8 - max_distance)
        & (F.bit_count(x) <= max_distance)
        & (choice == F.col("a.choice"))
        & ((F.col("a.more") < 0) | (more == F.col("a.more"))),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_groups(docs: DataFrame, width: int = 3, max_distance: int = 2, hot_posting: int = 512, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, root, *carry), one row for each row of docs (doc_id, text, *carry).

    fp is the fingerprint as a signed long; rows link when theirs differ in max_distance bits or fewer, and
    component_id is the smallest doc_id reachable. Equal fingerprints are one node of the graph, so copies make no
    pairs. Texts without words (null, empty, blank) have fingerprint 0 and link like any other. A null doc_id is never
    a component_id unless its component has no other; rows that share a doc_id are rows of their own, and root, the
    smallest fingerprint of the component, tells components apart that have the same component_id.
    """
    prints = store(docs.select("doc_id", fingerprint_column(F.col("text"), width).alias("fp"), *carry), "fingerprints")
    return groups_of(prints, max_distance, hot_posting, carry)


def groups_of(prints: DataFrame, max_distance: int = 2, hot_posting: int = 512, carry: tuple[str, ...] = ()) -> DataFrame:
    """near_groups of fingerprints (doc_id, fp, *carry) that are written already."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_pairs(nodes, max_distance, hot_posting))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id", "root")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id", "root", *carry)
