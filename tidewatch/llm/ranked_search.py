"""Ranked lexical search over hashed max-sketches.

Each document is indexed as its terms with their counts and a sketch: a term's impact, the part of its score that depends
on the document alone, is rounded up to a byte and folded into one of the sketch's cells, which keeps the largest. A
sketch has four cells or more for each distinct term, so bounds stay sharp for texts of any length. For a batch of
queries, a cell times the term's weight is never less than what the term adds to the score; the sums are upper bounds for
all documents of a batch at once. Documents are then scored exactly by descending bound until no bound reaches the worst
of the best k known. Each task keeps the best k of each query, and those meet in two steps.
"""

from __future__ import annotations

import bisect
import dataclasses
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import store

#: A byte of a sketch stands for this much impact; impacts are below 1,000,000.
GRAIN = 4000
LEAST_CELLS = 64
CELLS_A_TERM = 4
#: Distinct terms that a task counts before it hands them on.
HELD = 200_000
#: Documents whose bounds a task holds at a time.
ROWS_AT_ONCE = 512
#: Terms of queries that one pass over the index looks up, about.
TERMS_A_PASS = 100_000
_KEPT = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
_TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _KEPT else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all that is beyond ASCII, with A-Z in lower case."""
    return text.translate(_TABLE).split()


def _bytes(values: pa.Array) -> list[bytes]:
    return [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in values.cast(pa.large_binary())]


def impacts(counts: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def length_part(n: int, documents: int, all_terms: int) -> int:
    return 75 + (25 * n * documents) // all_terms


def _cells(hashes: np.ndarray, width: int) -> np.ndarray:
    return hashes & np.uint32(width - 1)


def sketch(hashes: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """Maxima of the impacts, rounded up, in a power of two of cells."""
    width = max(LEAST_CELLS, 1 << (CELLS_A_TERM * len(hashes) - 1).bit_length())
    out = np.zeros(width, dtype=np.uint8)
    np.maximum.at(out, _cells(hashes, width), (-(-impact // GRAIN)).astype(np.uint8))
    return out


def _hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, terms), dtype=np.uint32, count=len(terms))


@dataclasses.dataclass(frozen=True)
class Index:
    """terms: (term, df); rows: (doc_id, n, m, sketch, terms, counts), a row for each document with a term."""

    terms: DataFrame
    rows: DataFrame
    documents: int
    all_terms: int


def build_index(docs: DataFrame) -> Index:
    """The index of docs (doc_id, text), written in the shared folder; other columns are ignored.

    A null or empty text has no term and is not indexed, nor counted. Rows that share an id are documents of their own.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def count(batches):
        seen: Counter[bytes] = Counter()
        documents = tokens = 0

        def rows(names, df, n):
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(df, pa.int64()), pa.array(n, pa.int64())], names=["term", "df", "n"])

        for batch in batches:
            for text in _bytes(batch.column("text")):
                found = terms_of(text)
                documents, tokens = documents + bool(found), tokens + len(found)
                seen.update(set(found))
                if len(seen) >= HELD:
                    yield rows(list(seen), list(seen.values()), [0] * len(seen))
                    seen.clear()
        yield rows([*seen, None], [*seen.values(), documents], [0] * len(seen) + [tokens])

    parts = docs.select("text").mapInArrow(count, "term binary, df bigint, n bigint")
    terms = store(parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")), "search_terms")
    total = terms.filter("term IS NULL").first()
    documents, all_terms = (total.df, total.n) if total else (0, 0)

    def fold(batches):
        for batch in batches:
            kept, out = [], ([], [], [], [], [])
            for k, text in enumerate(_bytes(batch.column("text"))):
                seen = Counter(terms_of(text))
                if not seen:
                    continue
                names, counts = list(seen), np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
                n = int(counts.sum())
                m = length_part(n, documents, all_terms)
                kept.append(k)
                for column, value in zip(out, (n, m, sketch(_hashes(names), impacts(counts, m)).tobytes(), b" ".join(names), counts.astype("<i4").tobytes()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = [batch.column("doc_id").take(pa.array(kept, pa.int64())), *[pa.array(v, t) for v, t in zip(out, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "m", "sketch", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(fold, f"doc_id {kind}, n bigint, m bigint, sketch binary, terms binary, counts binary")
    return Index(terms.filter("term IS NOT NULL").select("term", "df"), store(rows, "search_rows"), documents, all_terms)


@dataclasses.dataclass(frozen=True)
class Batch:
    """Queries as arrays: hashes and weights of all their terms, where each query starts, and each as (term, weight) pairs."""

    names: list[int]
    hashes: np.ndarray
    weights: np.ndarray
    starts: np.ndarray
    pairs: list[list[tuple[bytes, int]]]

    def bounds(self, cells: bytes) -> np.ndarray:
        """For each query, what no exact score of the document exceeds."""
        there = np.frombuffer(cells, dtype=np.uint8)
        return np.add.reduceat(there[_cells(self.hashes, len(there))] * self.weights, self.starts) * GRAIN


def _batch(rows) -> Batch:
    names, starts, pairs, terms, weights = [], [], [], [], []
    for row in sorted(rows, key=lambda r: (r.query, r.term)):
        if not names or names[-1] != row.query:
            names.append(row.query)
            starts.append(len(terms))
            pairs.append([])
        terms.append(bytes(row.term))
        weights.append(row.weight)
        pairs[-1].append((bytes(row.term), row.weight))
    return Batch(names, _hashes(terms), np.array(weights, dtype=np.int64), np.array(starts, dtype=np.int64), pairs)


class _Best:
    """The k best documents of a query so far, best first: (-score, id is null, id)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self) -> int:
        """No document with a lower bound can come in."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, score: int, doc_id) -> None:
        bisect.insort(self.rows, (-score, doc_id is None, 0 if doc_id is None else doc_id))
        del self.rows[self.k :]


def _search(batch: Batch, k: int, kind: pa.DataType):
    def run(batches):
        best = [_Best(k) for _ in batch.names]
        floors = np.ones(len(best), dtype=np.int64)
        for rows in batches:
            for start in range(0, rows.num_rows, ROWS_AT_ONCE):
                part = rows.slice(start, ROWS_AT_ONCE)
                ids, ms = part.column("doc_id").to_pylist(), part.column("m").to_pylist()
                bounds = np.stack([batch.bounds(cells) for cells in _bytes(part.column("sketch"))])
                open_to = bounds >= floors
                known: dict[int, dict[bytes, int]] = {}
                for q in np.flatnonzero(open_to.any(axis=0)).tolist():
                    at = np.flatnonzero(open_to[:, q])
                    for d in at[np.argsort(-bounds[at, q], kind="stable")].tolist():
                        if bounds[d, q] < best[q].floor():
                            break
                        if d not in known:
                            counts = np.frombuffer(part.column("counts")[d].as_buffer(), dtype="<i4").astype(np.int64)
                            names = part.column("terms")[d].as_buffer().to_pybytes().split()
                            known[d] = dict(zip(names, impacts(counts, ms[d]).tolist(), strict=True))
                        of = known[d].get
                        score = sum(w * of(term, 0) for term, w in batch.pairs[q])
                        if score > 0:
                            best[q].add(score, ids[d])
                    floors[q] = best[q].floor()
        found = [(name, None if none else i, -less) for name, b in zip(batch.names, best, strict=True) for less, none, i in b.rows]
        columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    return run


def _best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of items (item_id, text), by score, then doc_id.

    A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))) each time it occurs in the item. Items are looked up in passes
    of about TERMS_A_PASS terms, however many there are. An item without a known term has no rows; rows that share an
    item_id are ranked on their own. A null doc_id comes after the others of its score.
    """
    items = store(items.select("item_id", "text", F.monotonically_increasing_id().alias("query")), "search_items")

    def split(batches):
        for batch in batches:
            found = [(q, t, c) for q, text in zip(batch.column("query").to_pylist(), _bytes(batch.column("text")), strict=True) for t, c in Counter(terms_of(text)).items()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "term", "repeats"])

    asked = items.select("query", F.col("text").cast("string").alias("text")).mapInArrow(split, "query bigint, term binary, repeats bigint")
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2) / (2 * F.col("df") + 1)))
    asked = store(asked.join(index.terms, "term").select("query", "term", (F.col("repeats") * weight).alias("weight")).filter("weight > 0"), "search_asked")
    passes = math.ceil(asked.count() / TERMS_A_PASS)
    kind = index.rows.schema["doc_id"].dataType
    found = None
    for p in range(passes):
        batch = _batch(asked.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == p).collect())
        if not batch.names:
            continue
        rows = index.rows.select("doc_id", "m", "sketch", "terms", "counts")
        arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
        part = rows.mapInArrow(_search(batch, k, arrow), f"query bigint, doc_id {kind.simpleString()}, score bigint")
        part = store(part.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(64))), "search_found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = items.sparkSession.createDataFrame([], f"query bigint, doc_id {kind.simpleString()}, score bigint, task int")
    ranked = _best_of(_best_of(found, ["query", "task"], k).drop("rank"), ["query"], k)
    return ranked.join(items.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
