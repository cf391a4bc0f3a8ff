"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, linked transitively.

The closest come from fingerprints: SimHash of the five-word shingles by the index of positional bytes (simhash.py), whose
groups within 2 bits are compared on their sets, each node with the first of its group. Fingerprints can't find all by
their bytes: at 0.8 two of them are about 10 bits apart, and one such pair in twelve shares no positional byte at all. So
the other candidates come from bands of MinHash values: four values make a key, and a
pair of similarity s misses all 20 keys with a chance of (1 - s^4)^20, 3e-5 at 0.8. A signature of four bits for each of
256 values goes with a node; of 256 cells a pair at 0.8 agrees in 208 on average, and one that agrees in fewer than 180 (4.5
standard deviations, a chance of 3e-6) is no candidate. Every candidate is verified on the sets, which travel once to each
pair of blocks of nodes, however many candidates there are between the two.

Large groups are not compared pair by pair. Six keys of eight values come first: each row of a key meets one of them, and
what is linked has one root. Then the rows of a short key that are not of its commonest root meet one row of that root,
in turns, until few are left; these are compared with all rows of their keys that have another root. Roots are kept by
node, and a pair of rows of one root is never made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import simhash
from tidewatch.llm.graph import components
from tidewatch.llm.shared import store

SEED = 42
WIDTH = 5
BANDS, ROWS = 20, 4
LONG_BANDS, LONG_ROWS = 6, 8
VALUES, PLANES = 256, 4
#: Cells of two signatures that agree at least. A signature holds one bit of each value, 64 to a long, then the next bit.
WORDS, AGREE = VALUES // 64, 180
#: Nodes in a block, about.
BLOCK = 256
#: A pair is near from 4/5 on; in whole numbers, so that 0.8 itself counts.
NEAR, OF = 4, 5
_RNG = np.random.default_rng(SEED)
_TURN = _RNG.integers(0, 2**64, size=(VALUES, 1), dtype=np.uint64)
_TIMES = _RNG.integers(0, 2**64, size=(VALUES, 1), dtype=np.uint64) | np.uint64(1)
_BIT = np.arange(64, dtype=np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; words as in simhash.fingerprint, a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: -width] + 1).tolist()]
    hashes = [digest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, dtype=np.uint64))


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The least of the set's hashes under each of VALUES mixings."""
    least = np.full(VALUES, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(hashes), 512):  # small enough for the cache
        np.minimum(least, ((hashes[None, k : k + 512] ^ _TURN) * _TIMES).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A signed long for each band of so many values."""
    key = np.zeros(bands, dtype=np.uint64)
    for k in range(rows):
        key = (key ^ least[k::rows]) * _TIMES[0]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """PLANES bits of each value, a plane of WORDS signed longs for each bit."""
    planes = [(least >> np.uint64(37 + p)) & np.uint64(1) for p in range(PLANES)]
    return np.concatenate([np.bitwise_or.reduce(p.reshape(WORDS, 64) << _BIT, axis=1) for p in planes]).view(np.int64)


def _bytes_of(texts: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.cast(pa.large_binary())]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)))


def _prints(text: Column) -> Column:
    none, blank = np.empty(0, dtype=np.int64), np.zeros(WORDS * PLANES, dtype=np.int64)

    @F.arrow_udf("struct<digest:binary,size:bigint,fp:bigint,short:array<bigint>,long:array<bigint>,cells:array<bigint>>")
    def prints(texts: pa.Array) -> pa.Array:
        digests, sizes, fps, short, long, cells = [], [], [], [], [], []
        for t in _bytes_of(texts):
            found = shingles(t)
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            fps.append(simhash.fingerprint(t, WIDTH))
            least = least_values(found) if len(found) else None
            short.append(none if least is None else band_keys(least[: BANDS * ROWS], BANDS, ROWS))
            long.append(none if least is None else band_keys(least[BANDS * ROWS : BANDS * ROWS + LONG_BANDS * LONG_ROWS], LONG_BANDS, LONG_ROWS))
            cells.append(blank if least is None else signature(least))
        columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), _lists(short), _lists(long), _lists(cells)]
        return pa.StructArray.from_arrays(columns, ["digest", "size", "fp", "short", "long", "cells"])

    return prints(text)


def _sets(text: Column) -> Column:
    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t).tobytes() for t in _bytes_of(texts)], pa.binary())

    return sets(text)


def _agreement(a: Column, b: Column) -> Column:
    """How many cells of two signatures agree."""
    apart = F.lit(0)
    for w in range(WORDS):
        x = F.lit(0).cast("bigint")
        for p in range(PLANES):
            x = x.bitwiseOR(a[p * WORDS + w].bitwiseXOR(b[p * WORDS + w]))
        apart = apart + F.bit_count(x)
    return F.lit(VALUES) - apart


def _may_be_near(a: str, b: str) -> Column:
    size, other = F.col(f"{a}.size"), F.col(f"{b}.size")
    return (size * OF >= other * NEAR) & (other * OF >= size * NEAR) & (_agreement(F.col(f"{a}.cells"), F.col(f"{b}.cells")) >= AGREE)


def _near_of(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs of two blocks that are near; sets has each of their nodes once."""
    hashes = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in sets.column("hashes"))
    of = dict(zip(sets.column("node").to_pylist(), hashes, strict=True))
    kept = []
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        x, y = of[a], of[b]
        both = len(np.intersect1d(x, y, assume_unique=True))
        kept.append(OF * both >= NEAR * (len(x) + len(y) - both))
    return pairs.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near, by their sets. Pairs and sets are written first, which also cuts the plan."""
    pairs = store(pairs, "near_candidates")
    nodes = store(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "near_compared")
    sets = store(texts.join(nodes, "node", "left_semi").select("node", _sets(F.col("text")).alias("hashes")), "near_sets")
    blocks = F.lit(nodes.count() // BLOCK + 1)
    block = lambda c: F.pmod(F.xxhash64(c), blocks)
    pairs = pairs.withColumns({"of_a": block("a"), "of_b": block("b")})
    keys = ["of_a", "of_b"]
    there = pairs.select(*keys, F.col("a").alias("node")).union(pairs.select(*keys, "b")).distinct().join(sets, "node")
    there = there.select(F.col("of_a").alias("left"), F.col("of_b").alias("right"), "node", "hashes")
    near = pairs.groupBy(*keys).cogroup(there.groupBy("left", "right")).applyInArrow(_near_of, "a bigint, b bigint")
    return store(near, "near_links")


def _rooted(nodes: DataFrame, links: DataFrame | None) -> DataFrame:
    """nodes with the root that the links give them, and how many nodes have it."""
    if links is None:
        return nodes.withColumns({"root": F.col("node"), "mass": F.lit(1).cast("bigint")})
    roots = components(links).withColumnRenamed("root", "to")
    roots = store(roots.join(roots.groupBy("to").agg(F.count("*").alias("many")), "to"), "near_roots")
    found = nodes.join(roots, "node", "left")
    return found.withColumns({"root": F.coalesce("to", "node"), "mass": F.coalesce("many", F.lit(1))}).drop("to", "many")


def _outside(rooted: DataFrame, keys: str, turn: int) -> DataFrame:
    """(band, key, node, root, one, main, rows): rows of a key that are not of its commonest root, with a node of that root, that root and the key's rows."""
    # the commonest root first, another of several from turn to turn
    weight = F.shiftleft(F.least("mass", F.lit(1 << 30)), 32) + F.xxhash64("root", F.lit(turn)).bitwiseAND(F.lit(0xFFFFFFFF))
    posted = rooted.select("node", "root", weight.alias("weight"), F.posexplode(keys).alias("band", "key"))
    of = [F.max_by("node", "weight").alias("one"), F.max_by("root", "weight").alias("main"), F.count("*").alias("rows")]
    shared = posted.groupBy("band", "key").agg(*of).filter("rows > 1")
    met = posted.join(shared, ["band", "key"]).filter(F.col("root") != F.col("main"))
    return store(met.select("band", "key", "node", "root", "one", "main", "rows"), "near_outside")


def fingerprint_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): near nodes (node, fp) whose fingerprints are in one group, a the group's smallest; texts: (node, text)."""
    groups = simhash.groups_of(nodes.select(F.col("node").alias("doc_id"), "fp"))
    return _verified(groups.filter("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")), texts)


def near_links(nodes: DataFrame, texts: DataFrame, turns: int = 6, pairs_a_row: int = 64, known: DataFrame | None = None) -> DataFrame:
    """(a, b): links that join all near nodes of a component.

    nodes: (node, size, short, long, cells), distinct sets; texts: (node, text); known: links found before. Turns go on while the pairs to compare
    are more than pairs_a_row for each row of the short keys and a turn still links one node in a thousand; then
    all that are left are compared by their signatures, however many, and those that pass on their sets.
    """
    links, facts, moved = known, nodes.select("node", "size", "cells", "short"), True
    size = nodes.count()
    few = pairs_a_row * BANDS * size
    for turn in range(turns + 1):
        rooted = _rooted(nodes, links)
        outside = _outside(rooted, "long" if turn == 0 < turns else "short", turn)
        last = turn == turns or (turn > 0 and not moved) or (turn > 1 and (outside.agg(F.sum("rows")).first()[0] or 0) <= few)
        if last:
            one = outside.join(facts, "node").alias("one")
            posted = rooted.select("node", "root", F.posexplode("short").alias("band", "key"))
            posted = posted.join(outside.select("band", "key").distinct(), ["band", "key"], "left_semi")
            other = posted.join(facts, "node").alias("other")
            same = (F.col("one.band") == F.col("other.band")) & (F.col("one.key") == F.col("other.key"))
            # a pair once: of two rows outside the smaller first, and only by the first key that both have
            apart = (F.col("one.root") != F.col("other.root")) & ((F.col("other.root") == F.col("one.main")) | (F.col("one.node") < F.col("other.node")))
            before = F.lit(False)
            for k in range(BANDS - 1):
                before = before | ((F.col("one.band") > k) & (F.col("one.short")[k] == F.col("other.short")[k]))
            met = one.join(other, same & apart & _may_be_near("one", "other") & ~before)
            a, b = F.col("one.node"), F.col("other.node")
            pairs = met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
        else:
            met = outside.select("node", "one").distinct().join(facts.alias("x"), "node").join(facts.withColumnRenamed("node", "one").alias("y"), "one")
            met = met.filter(_may_be_near("x", "y")).select("node", "one", _agreement(F.col("x.cells"), F.col("y.cells")).alias("agree"))
            best = met.groupBy("node").agg(F.max(F.struct("agree", "one")).alias("best"))
            pairs = best.select(F.least("node", "best.one").alias("a"), F.greatest("node", "best.one").alias("b")).distinct()
        new = _verified(pairs, texts)
        links = new if links is None else links.unionByName(new)
        if last:
            return links
        moved = turn == 0 or new.count() * 1000 >= size


def first_rows(docs: DataFrame, turns: int = 6, pairs_a_row: int = 64) -> DataFrame:
    """(row), one for each group of near copies: that with the smallest doc_id, then the smallest row; docs (row, doc_id, text).

    A null doc_id counts only where a group has no other. Texts with equal sets, also those without words, are one node.
    """
    prints = docs.select("row", "doc_id", _prints(F.col("text")).alias("p")).select("row", "doc_id", "p.*")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    # texts of one set may repeat shingles in their own ways: the least of their fingerprints stands for the node
    sums = [F.min("row").alias("node"), F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in ("size", "short", "long", "cells")], best]
    nodes = store(prints.groupBy("digest").agg(*sums), "near_nodes")
    texts = docs.select(F.col("row").alias("node"), "text")
    roots = components(near_links(nodes, texts, turns, pairs_a_row, fingerprint_links(nodes, texts)))
    rooted = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    return rooted.agg(F.min("best").alias("best")).select("best.row")
