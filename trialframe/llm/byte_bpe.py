"""Byte-level BPE on padded numpy matrices.

Texts are cut by the tokenizer's pattern. Distinct pieces that a task has not seen yet are encoded together,
bucketed by length: a matrix has one piece per row, and in each round every row merges its leftmost pair of
the smallest rank, so a round shortens each row by one and a boolean mask closes the gap. Ranks of pairs come
from a hash table over (left id, right id), made once per task from all splits of the vocabulary. Rows without
a mergeable pair leave the matrix. A piece beyond `LONG` bytes is a row of its own that merges all its pairs
of the smallest rank in a round, unless such a merge would make a pair that has to go first; then it merges one.

Ids depend on the text alone, so a repeated task gives the same rows. Memory: the vocabulary, a cache of
pieces that is emptied at a fixed size, and one block of text at a time (blocks end where every piece ends).

Defined cases: a null text is empty and has no ids; whole texts are encoded, special tokens are plain text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 256
BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 128, LONG)
CACHE = 400_000
#: Characters of text whose new pieces are encoded together.
BLOCK = 1 << 21
ROWS = 1 << 14
NONE = np.int32(2**31 - 1)
#: Ids of a piece, the same as decimal text, and the bytes they stand for.
Piece = tuple[list[int], str, bytes]


class PairTable:
    """Open-addressing hash table from (left id, right id) to the id of the merged token."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.mask = (1 << int(len(pairs) * 3).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, NONE, np.int32)
        slots, rest = self._slot(pairs), np.arange(len(pairs))
        self.probes = 0
        while len(rest):
            self.probes += 1
            free = rest[self.keys[slots[rest]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.values[slots[put]] = pairs[put], merged[put]
            rest = rest[self.keys[slots[rest]] != pairs[rest]]
            slots[rest] = (slots[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(8)).view(np.int64) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the vocabulary has no such token; negative ids are padding."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero(((found != keys) & (found >= 0) & (left >= 0) & (right >= 0)).ravel())
        flat, out_flat, at = keys.ravel(), out.ravel(), slots.ravel()[open_]
        while len(open_):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == flat[open_]
            out_flat[open_[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            open_, at = open_[on], at[on]
        return out_flat.reshape(keys.shape)


class Codec:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = {i: t for t, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.tokens}
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        left, right, merged = (np.array(x, np.int64) for x in (left, right, merged))
        self.pairs = PairTable((left << 32) | right, merged.astype(np.int32))
        self.cache: dict[str, Piece] = {}

    def _rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of at most `width` bytes."""
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_id[raw], np.int32(-1))
        out: list[list[int]] = [[]] * len(pieces)
        rows = np.arange(len(pieces))

        def leave(ids: np.ndarray, rows: np.ndarray) -> None:
            ends = (ids >= 0).sum(axis=1)
            for k, x, n in zip(rows.tolist(), ids.tolist(), ends.tolist(), strict=True):
                out[k] = x[:n]

        while len(rows) and ids.shape[1] > 1:
            ranks = self.pairs.get(ids[:, :-1], ids[:, 1:])
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(rows)), best]
            done = rank == NONE
            if done.any():
                leave(ids[done], rows[done])
                ids, rows, best, rank = ids[~done], rows[~done], best[~done], rank[~done]
            if not len(rows):
                break
            ids[np.arange(len(rows)), best] = rank
            stay = np.ones(ids.shape, bool)
            stay[np.arange(len(rows)), best + 1] = False
            ids = ids[stay].reshape(len(rows), -1)
        leave(ids, rows)
        return out

    def _long(self, piece: bytes) -> list[int]:
        """Ids of one long piece: all leftmost-first pairs of the smallest rank merge in a round, or one of them."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            ranks = self.pairs.get(ids[:-1], ids[1:])
            rank = ranks.min()
            if rank == NONE:
                break
            at = np.flatnonzero(ranks == rank)
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1]))  # of a chain of overlapping pairs every second merges
            start = np.flatnonzero(np.concatenate([[True], np.diff(run) > 0]))
            at = at[(np.arange(len(at)) - start[run - 1]) % 2 == 0]
            after = ids[np.minimum(at + 2, len(ids) - 1)]
            merged = np.delete(_put(ids, at, rank), at + 1)
            new = at - np.arange(len(at))
            soon = self.pairs.get(np.full(len(at), rank, np.int32), np.where(at + 2 < len(ids), after, -1))
            left = self.pairs.get(np.where(new > 0, merged[new - 1], -1), np.full(len(at), rank, np.int32))
            if min(soon.min(), left.min()) <= rank:  # a merge would make a pair that goes before the others
                merged = np.delete(_put(ids, at[:1], rank), at[:1] + 1)
            ids = merged
        return ids.tolist()

    def learn(self, found: Iterable[str]) -> None:
        """Encode the pieces that the cache lacks."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = [p for p in found if p not in self.cache]
        raw = [p.encode() for p in new]
        order = np.argsort([len(b) for b in raw], kind="stable").tolist()
        new, raw = [new[k] for k in order], [raw[k] for k in order]
        ids: list[list[int]] = []
        low = 0
        for width in BUCKETS:
            high = low
            while high < len(raw) and len(raw[high]) <= width:
                high += 1
            for k in range(low, high, ROWS):
                ids += self._rows(raw[k : min(high, k + ROWS)], width)
            low = high
        ids += [self._long(b) for b in raw[low:]]
        tokens, decimal = self.tokens, self.decimal
        for piece, x in zip(new, ids, strict=True):
            self.cache[piece] = (x, ",".join([decimal[i] for i in x]), b"".join([tokens[i] for i in x]))

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in parts that end where every piece ends."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > BLOCK:  # a single blank between two other characters always begins a piece
                cut = _CUT.search(text, at + BLOCK)
                end = cut.start() if cut else end
            yield self.pattern.findall(text[at:end])
            at = end

    def many(self, texts: Iterable[str | None]) -> Iterator[Iterable[list[Piece]]]:
        """For each text its encoded pieces, part by part; new pieces of many short texts are learnt together."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > BLOCK:
                yield from ([x] for x in self._known(group))
                yield (next(iter(self._known([part]))) for part in self._parts(text))
                group, size = [], 0
                continue
            group.append(self.pattern.findall(text))
            size += len(text)
            if size > BLOCK:
                yield from ([x] for x in self._known(group))
                group, size = [], 0
        yield from ([x] for x in self._known(group))

    def _known(self, group: list[list[str]]) -> Iterator[list[Piece]]:
        self.learn(set().union(*group))
        cache = self.cache
        for pieces in group:
            yield [cache[p] for p in pieces]

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        for parts in self.many(texts):
            yield [i for part in parts for ids, _, _ in part for i in ids]

    def decode(self, ids: Iterable[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def _put(ids: np.ndarray, at: np.ndarray, value: int) -> np.ndarray:
    ids = ids.copy()
    ids[at] = value
    return ids


_CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file; read once per Python worker."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _mapped(docs: DataFrame, column: str, outputs: list[tuple[str, pa.DataType, str]], fn) -> DataFrame:
    """`docs` with further columns that `fn` makes from the values of one column; columns of those names give way."""
    docs = docs.drop(*{n for n, _, _ in outputs} - {column})
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{n}` {s}" for n, _, s in outputs])
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(fn(x.as_py() for x in batch.column(at)))
            arrays = [pa.array([r[k] for r in rows], t) for k, (_, t, _) in enumerate(outputs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *[n for n, _, _ in outputs]])

    return docs.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the array column `ids`."""

    def encode(texts: Iterator[str | None]) -> Iterator[tuple]:
        return ((x,) for x in codec(path, pattern).encode(texts))

    return _mapped(docs, text, [(ids, pa.list_(pa.int32()), "array<int>")], encode)


def decoded(docs: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` with the bytes that its ids stand for; null ids give empty bytes."""

    def decode(rows: Iterator[list[int] | None]) -> Iterator[tuple]:
        return ((codec(path, pattern).decode(x or []),) for x in rows)

    return _mapped(docs, ids, [(text, pa.binary(), "binary")], decode)


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, `n_tokens`, and SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes."""

    def digest(texts: Iterator[str | None]) -> Iterator[tuple]:
        for parts in codec(path, pattern).many(texts):
            n, ids, back, comma = 0, hashlib.sha256(), hashlib.sha256(), ""
            for part in parts:
                n += sum([len(x[0]) for x in part])
                ids.update((comma + ",".join([x[1] for x in part])).encode())
                back.update(b"".join([x[2] for x in part]))
                comma = ","
            yield n, ids.hexdigest(), back.hexdigest()

    picked = docs.select(F.col(doc_id), F.col(text))
    columns = [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _mapped(picked, text, columns, digest).drop(text)
