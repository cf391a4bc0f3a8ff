"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A vocabulary is read from a model file whose path is a parameter; nothing is trained. The text is split where a piece
can't reach across (before a blank that follows something else), and each distinct stretch is encoded once per task.
"""

from __future__ import annotations

import dataclasses
import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "▁"
#: What a character that no piece covers scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Stretches that a task remembers before it starts anew.
REMEMBERED = 600_000


@dataclasses.dataclass(frozen=True)
class Vocabulary:
    """base and check of the trie over bytes, the piece that ends at a state (-1: none), scores and pieces by id."""

    base: np.ndarray
    check: np.ndarray
    ends: np.ndarray
    scores: np.ndarray
    pieces: tuple[bytes, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    dummy_prefix: bool


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States of all prefixes: the child of state s by byte c is base[s] + c + 1 if check of that is s; the root is 0."""
    children: dict[bytes, list[int]] = {b"": []}
    for word in words:
        for k in range(len(word)):
            if word[: k + 1] not in children:
                children[word[: k + 1]] = []
                children[word[:k]].append(word[k])
    size, window = 1 << 16, 4096
    base, check, ends = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    state = {b"": 0}
    low = 1
    by_depth: dict[int, list[bytes]] = {}
    for prefix in children:
        by_depth.setdefault(len(prefix), []).append(prefix)
    # a parent comes before its children; within a depth those with many children are the hardest to place
    for depth in sorted(by_depth):
        for prefix in sorted(by_depth[depth], key=lambda p: -len(children[p])):
            s = state[prefix]
            ends[s] = words.get(prefix, -1)
            marks = np.array(sorted(children[prefix]), dtype=np.int64) + 1
            if not len(marks):
                continue
            start = low
            while True:
                if start + window + 512 >= len(check):
                    base, ends = np.append(base, np.zeros(size, np.int32)), np.append(ends, np.full(size, -1, np.int32))
                    check = np.append(check, np.full(size, -1, np.int32))
                free = np.flatnonzero(check[start : start + window] < 0) + start
                if start == low and len(free) < window // 20:
                    low += window  # hardly a place left here
                at = free - marks[0]
                at = at[at > 0]
                for mark in marks[1:]:
                    at = at[check[at + mark] < 0]
                if len(at):
                    break
                start += window
            at = int(at[0])
            base[s] = at
            for mark in marks.tolist():
                check[at + mark] = s
                state[prefix + bytes([mark - 1])] = at + mark
    pad = 512  # base + byte never leaves the arrays
    return np.append(base, np.zeros(pad, np.int32)), np.append(check, np.full(pad, -1, np.int32)), np.append(ends, np.full(pad, -1, np.int32))


@functools.cache
def load(path: str) -> Vocabulary:
    """Read a model file. Pieces that hold a blank mark behind another character would cross the splits and are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = proto.ModelProto.SentencePiece
    usual = {p.piece.encode(): i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
    if any(MARK in p.decode().lstrip(MARK) for p in usual):
        raise ValueError("a piece holds a blank mark behind another character")
    of_byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
    byte_ids = tuple(of_byte[b] for b in range(256)) if len(of_byte) == 256 else ()
    pieces = tuple(
        bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else b"" if p.type in (kinds.CONTROL, kinds.UNKNOWN) else p.piece.encode()
        for p in model.pieces
    )
    unknown = next((i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), -1)
    return Vocabulary(
        *double_array(usual), np.array([p.score for p in model.pieces], dtype=np.float64), pieces, byte_ids, unknown, model.normalizer_spec.add_dummy_prefix
    )


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        used = vocabulary.scores[np.unique(vocabulary.ends[vocabulary.ends >= 0])]
        self.unknown_score = float(used.min(initial=0.0)) - UNKNOWN_PENALTY
        self.byte_ids = np.array(vocabulary.byte_ids or [vocabulary.unknown] * 256, dtype=np.int32)
        self.known: dict[str, bytes] = {}
        self.stretch = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def viterbi(self, stretches: list[str]) -> list[bytes]:
        """The ids of the best path of each; of paths that score alike the one whose last piece is longest."""
        v = self.v
        texts = [x.encode() for x in stretches]
        size = np.array([len(x) for x in texts], dtype=np.int64)
        longest = int(size.max())
        # a row for each position, so that all stretches are looked at together
        codes = np.frombuffer(b"".join(x.ljust(longest, b"\0") for x in texts), dtype=np.uint8).reshape(-1, longest).T.astype(np.int32, order="C")
        shape = (longest + 1, len(texts))
        best, back, piece = np.full(shape, -np.inf), np.zeros(shape, np.int32), np.full(shape, -1, np.int32)
        best[0] = 0.0
        for s in range(longest):
            row = np.flatnonzero((size > s) & (best[s] > -np.inf))
            here, first = best[s][row], codes[s][row]
            whole = first < 128
            width = np.where(whole, 1, np.where(first < 224, 2, np.where(first < 240, 3, 4)))
            whole[:] = False
            at, word, state, e = np.arange(len(row)), row, np.zeros(len(row), np.int32), s
            while e < longest and len(at):
                to = v.base[state] + codes[e][word] + 1
                there = np.flatnonzero((v.check[to] == state) & (size[word] > e))
                at, word, state, e = at[there], word[there], to[there], e + 1
                ids = v.ends[state]
                ending = np.flatnonzero(ids >= 0)
                if not len(ending):
                    continue
                a, r, i = at[ending], word[ending], ids[ending]
                whole[a] |= width[a] == e - s
                score = here[a] + v.scores[i]
                up = np.flatnonzero(score > best[e][r])
                r = r[up]
                best[e][r], back[e][r], piece[e][r] = score[up], s, i[up]
            lost = np.flatnonzero(~whole)
            if len(lost):
                r, e, score = row[lost], s + width[lost], here[lost] + self.unknown_score
                up = score > best[e, r]
                best[e[up], r[up]], back[e[up], r[up]], piece[e[up], r[up]] = score[up], s, -1
        # from the end; a character without a piece goes byte by byte
        out, used = np.zeros((len(texts), longest), np.int32), np.zeros(len(texts), np.int64)
        end, row = size.copy(), np.flatnonzero(size)
        while len(row):
            e = end[row]
            p = piece[e, row]
            used[row] += 1
            out[row, longest - used[row]] = np.where(p >= 0, p, self.byte_ids[codes[e - 1, row]])
            end[row] = np.where(p >= 0, back[e, row], e - 1)
            row = row[end[row] > 0]
        flat, width = out.tobytes(), 4 * longest
        return [flat[(k + 1) * width - 4 * n : (k + 1) * width] for k, n in enumerate(used.tolist())]

    def learn(self, stretches: set[str]) -> dict[str, bytes]:
        """Ids of stretches not yet known, in blocks of like length; short ones are remembered. A word stands for its stretch."""
        mark = MARK if self.v.dummy_prefix else ""
        new = sorted(stretches, key=len)
        found: dict[str, bytes] = {}
        while new:
            block = new[: max(1, min(20_000, 2_000_000 // (4 * len(new[min(len(new), 20_000) - 1]) + 1)))]
            found.update(zip(block, self.viterbi([x if MARK in x else mark + x for x in block]), strict=True))
            new = new[len(block) :]
        if len(self.known) + len(found) > REMEMBERED:
            self.known.clear()
        self.known.update((k, x) for k, x in found.items() if len(k) <= 64)
        return found

    def split(self, text: str) -> list[str]:
        if self.v.dummy_prefix and "  " not in text and MARK not in text and " " not in (text[0], text[-1]):
            return text.split(" ")  # each word with the mark before it is a stretch
        return self.stretch.findall((MARK if self.v.dummy_prefix else "") + text.replace(" ", MARK))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """For each text the ids as 32-bit integers, one after the other; an empty text has none."""
        split = [self.split(x) if x else [] for x in texts]
        get = self.known.get
        parts = [list(map(get, x)) for x in split]
        missing = {x for row, ids in zip(split, parts, strict=True) if None in ids for x, i in zip(row, ids, strict=True) if i is None}
        if missing:
            found = self.learn(missing)
            parts = [[found[x] if i is None else i for x, i in zip(row, ids, strict=True)] if None in ids else ids for row, ids in zip(split, parts, strict=True)]
        return [b"".join(x) for x in parts]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Pieces and bytes joined, marks as blanks, without the blank put before the text. Bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.v.pieces.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(load(path))


def encode_pieces(text: Column, path: str) -> Column:
    """array<int> of the ids; null and empty texts have none. path: a model file that each executor can open."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encoder, rows, group, chars = _encoder(path), [], [], 0
        for t in texts:
            group.append(t.as_py() or "")
            chars += len(group[-1])
            if chars >= 1_000_000:
                rows += encoder.encode_many(group)
                group, chars = [], 0
        rows += encoder.encode_many(group)
        offsets = np.cumsum([0, *[len(r) // 4 for r in rows]], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))

    return ids(text)


def decode_pieces(ids: Column, path: str) -> Column:
    """The text of array<int>; null for null. A blank mark (U+2581) in the text that was encoded comes back as a blank."""

    @F.arrow_udf("string")
    def texts(rows: pa.Array) -> pa.Array:
        encoder = _encoder(path)
        flat, ends = rows.flatten().to_numpy(), np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(rows), 0).to_numpy()).tolist()
        return pa.array([encoder.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip([0, *ends], ends, rows.is_valid().to_pylist(), strict=False)], pa.string())

    return texts(ids)
