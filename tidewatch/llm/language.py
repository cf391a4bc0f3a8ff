"""Language identification in two steps: the family of languages first, then the language within it.

A text is a vector of its letter pairs, letter triples and words, hashed. Linear support vector machines tell each family
from the rest; within the chosen one, a machine for each pair of its languages votes. Machines are fitted on a bounded
sample on the driver; all texts are scored whole, in tasks.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = "und"
#: Cells of a vector, a power of two; a cell's number fits in 16 bits.
CELLS = 8192
# Codes of languages by family; a value that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "finnic": ("fi", "et"),
    "turkic": ("tr", "az", "kk", "uz", "tk"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt", "am"),
    "iranian": ("fa", "ps", "ku", "tg"),
    "celtic": ("cy", "ga", "gd", "br"),
    "baltic": ("lv", "lt"),
}
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * _FACTORS[3]
    return (x ^ (x >> np.uint32(13))) & np.uint32(CELLS - 1)


def cells(text: str) -> np.ndarray | None:
    """Counts of the hashed features; None for a text without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return None
    # one blank (0) before each word and after the last
    after = np.concatenate(([False], is_letter[:-1]))
    keep = is_letter | after
    line = np.concatenate(([0], np.where(is_letter, codes, 0)[keep], [0])).astype(np.uint32)
    pair = line[:-1] * _FACTORS[0] + line[1:] * _FACTORS[1]
    triple = pair[:-1] + line[2:] * _FACTORS[2] + np.uint32(1)
    blank = line == 0
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    first = np.maximum.accumulate(np.where(blank, np.arange(len(line)), 0))
    spot = (np.arange(len(line)) - first).astype(np.uint32)
    words = np.add.reduceat(np.where(blank, 0, (line + spot * _FACTORS[1]) * (line ^ _FACTORS[0])).astype(np.uint32), starts)
    return np.bincount(np.concatenate((_mixed(pair), _mixed(triple), _mixed(words + np.uint32(2)))), minlength=CELLS)


def vector(counts: np.ndarray) -> np.ndarray:
    root = np.sqrt(counts)
    return (root / np.sqrt(counts.sum())).astype(np.float32)


def machine(rows: np.ndarray, sign: np.ndarray, rounds: int = 80, cost: float = 20.0) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared hinge loss, by accelerated gradient steps.

    Both classes weigh the same in the loss, however many rows each has.
    """
    x = np.hstack([rows, np.ones((len(rows), 1), dtype=np.float32)])
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * cost
    # a row has length sqrt(2), so this bounds the curvature
    step = 1 / (1 + 4 * share.sum())
    w = ahead = np.zeros(x.shape[1])
    for k in range(rounds):
        gap = np.maximum(0, 1 - sign * (x @ ahead.astype(np.float32)))
        slope = ahead - 2 * ((share * sign * gap).astype(np.float32) @ x)
        moved = ahead - step * slope
        ahead, w = moved + k / (k + 3) * (moved - w), moved
    return w.astype(np.float32)


@dataclasses.dataclass(frozen=True)
class Model:
    """Families with their languages, and the weights of the machines: one for each family, one for each pair within a family."""

    families: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return NONE, 0.0
        margin = self.weights[:, :-1] @ x + self.weights[:, -1]
        count = len(self.families)
        own = np.exp(3 * (margin[:count] - margin[:count].max()))
        family = int(own.argmax())
        sure = float(own[family] / own.sum())
        votes = {lang: [0, 0.0] for lang in self.families[family]}
        for (a, b), m in zip(self.pairs, margin[count:], strict=True):
            if a in votes:
                p = float(1 / (1 + np.exp(-3 * m)))
                votes[a][0] += m > 0
                votes[b][0] += m <= 0
                votes[a][1] += p
                votes[b][1] += 1 - p
        lang = max(sorted(votes), key=lambda x: votes[x])
        return lang, sure * (votes[lang][1] / (len(votes) - 1) if len(votes) > 1 else 1.0)


def families_of(langs: list[str], families: dict[str, tuple[str, ...]]) -> tuple[tuple[str, ...], ...]:
    named = {code: name for name, codes in families.items() for code in codes}
    groups: dict[tuple, list[str]] = {}
    for lang in sorted(langs):
        groups.setdefault((0, named[lang]) if lang in named else (1, lang), []).append(lang)
    return tuple(tuple(groups[k]) for k in sorted(groups))


def train(rows: np.ndarray, langs: np.ndarray, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    groups = families_of(sorted(set(langs)), families)
    found, pairs = [], []
    for group in groups:
        sign = np.where(np.isin(langs, group), 1, -1)
        found.append(machine(rows, sign) if len(groups) > 1 else np.zeros(CELLS + 1, dtype=np.float32))
    for group in groups:
        for a, b in itertools.combinations(group, 2):
            here = np.isin(langs, (a, b))
            pairs.append((a, b))
            found.append(machine(rows[here], np.where(langs[here] == a, 1, -1)))
    return Model(groups, tuple(pairs), np.stack(found) if found else np.zeros((0, CELLS + 1), dtype=np.float32))


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text, modulo 5, is 0. A null id is never one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _texts(values: pa.Array) -> list[str]:
    return [v.as_buffer().to_pybytes().decode("utf-8", "replace") if v.is_valid else "" for v in values.cast(pa.large_binary())]


def fit(docs: DataFrame, most_rows: int = 2000, most_langs: int = 64, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """Fit on docs (doc_id, text, lang), without the held-out rows and rows without an id, a language or a letter.

    The sample is bounded: most_rows documents, as many of each language as there are, of the most_langs commonest
    languages (ties by name), chosen by a hash of the id. Several rows of one id and language teach once. Without rows
    the model knows no language.
    """
    known = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("doc_id").alias("ids"))
    sizes = counts.orderBy(F.desc("rows"), "lang").limit(most_langs).collect()
    if not sizes:
        return train(np.zeros((0, CELLS), dtype=np.float32), np.array([], dtype=object), families)
    each = max(1, most_rows // len(sizes))
    # a draw of about three times as many ids first, so that no language is put in order whole
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r.lang, min(1.0, 3 * each / r.ids)) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = known.select("doc_id", "lang").join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = drawn.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each).drop("k")

    def measure(batches):
        for batch in batches:
            kept, at, values = [], [], []
            for k, text in enumerate(_texts(batch.column("text"))):
                counts = cells(text)
                if counts is not None:
                    there = np.flatnonzero(counts)
                    kept.append(k)
                    at.append(there.astype("<u2").tobytes())
                    values.append(counts[there].astype("<u4").tobytes())
            keep = pa.array(kept, pa.int64())
            columns = [batch.column("doc_id").take(keep), batch.column("lang").take(keep), pa.array(at, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "at", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    measured = picked.mapInArrow(measure, f"doc_id {kind}, lang string, at binary, counts binary")
    rows = measured.groupBy("doc_id", "lang").agg(F.min(F.struct("at", "counts")).alias("x")).collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.doc_id))
    x = np.zeros((len(rows), CELLS), dtype=np.float32)
    for k, row in enumerate(rows):
        counts = np.zeros(CELLS)
        counts[np.frombuffer(row.x["at"], dtype="<u2")] = np.frombuffer(row.x["counts"], dtype="<u4")
        x[k] = vector(counts)
    return train(x, np.array([r.lang for r in rows], dtype=object), families)


def language(text: Column, model: Model) -> Column:
    """struct(lang, score): the language and how sure it is, 0 to 1; `und` and 0 for a null text or one without a letter."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def told(texts: pa.Array) -> pa.Array:
        out = []
        for t in _texts(texts):
            counts = cells(t)
            lang, score = (NONE, 0.0) if counts is None else model.predict(vector(counts))
            out.append({"lang": lang, "score": score})
        return pa.array(out, kind)

    return told(text)
