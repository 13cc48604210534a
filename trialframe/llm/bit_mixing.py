"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words (A-Z lowered), each followed by a blank, and one end sign. Every byte is a path of binary
decisions in a code tree. Six predictors look at hashed contexts of a decision: one to four bytes before it and
the whole word so far, some of them together with a topic; a slot of a predictor holds how often the decision
went either way. Their log odds are mixed by weights that a gate selects (how well filled the slots of the long
contexts are); an adaptive map then corrects the mixed odds by what they came to in training. The product over
all decisions is the probability of the text; the bits over the bytes are its bits per byte.

The topic of a word is told by the short words before it: buckets of short words are clustered by how often
they follow each other in the training texts (languages, mostly), and a topic changes when two of the last three
short words agree. So a token's score depends on the token and its topic alone, and every distinct pair is
scored once:

1.  One pass counts which short words follow each other; the clusters come from that matrix of fixed size.
2.  One pass replaces the tokens of each block of documents by numbers of a local list and emits that list with
    its training counts. Lists are bounded, documents are not cut.
3.  The lists are added up to all pairs (token, topic) with exact counts in training texts.
4.  Passes over the pairs fill the slots (dense tables of fixed size, added up block by block), fit the weights
    online (each task goes through its pairs with their own occurrence left out; the tasks' weights are
    averaged by the decisions they saw) together with the adaptive map, and score all pairs.
5.  Scores return to the lists by a join and to the documents by the block number.

Everything that counts grows with the corpus and goes through shuffles; the model has a fixed size (`SLOTS`).

Defined cases: a null text is empty and consists of its end sign; without any training text all counts are
zero and every decision is even; rows that repeat are scored one by one and each counts in training.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import written
from .words import lower_words

BUCKETS = 512
SHORT = 3
TOPICS = 8
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
CONTEXTS = 6
#: Distinct pairs in a block's list.
LIST = 1_000_000
#: Pairs whose decisions are looked at together.
CHUNK = 2048
#: Tasks that fill slots or fit weights; each emits one copy of the model.
TASKS = 256
PART = 1 << 13
MINI = 1 << 14
STEPS = 33
PRIOR = 0.4
#: Weights that every gate starts from, by context.
START = (0.3, 0.4, 0.5, 0.3, 0.2, 0.25)
SCALE = 14
SEED = 3


# --- topics ---------------------------------------------------------------------------------------------------


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def _following(docs: DataFrame, text: str) -> np.ndarray:
    """How often a short word of one bucket is the next short word after one of another, in the documents given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS * BUCKETS, np.int64)
        known: dict[bytes, int] = {}
        for batch in batches:
            for x in batch.column(0):
                short = [w for w in lower_words(x.as_py()) if len(w) <= SHORT]
                for w in set(short).difference(known):
                    known[w] = bucket(w)
                if len(known) > 1_000_000:
                    known = {w: bucket(w) for w in set(short)}
                b = np.array([known[w] for w in short], np.int64)
                np.add.at(counts, b[:-1] * BUCKETS + b[1:], 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["pair", "n"])

    sums = docs.select(F.col(text)).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most BUCKETS squared rows
    matrix = np.zeros(BUCKETS * BUCKETS)
    matrix[found["pair"].to_numpy()] = found["n"].to_numpy()
    return matrix.reshape(BUCKETS, BUCKETS)


def _clusters(matrix: np.ndarray) -> np.ndarray:
    """A topic from 1 to TOPICS for each bucket."""
    both = matrix + matrix.T
    row = both.sum(axis=1)
    if not row.any():
        return np.ones(BUCKETS, int)
    scale = 1 / np.sqrt(np.maximum(row, 1))
    _, vector = np.linalg.eigh(both * scale[:, None] * scale[None, :])
    points = vector[:, -TOPICS:]
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    weight = np.sqrt(row)
    centers = points[[int(weight.argmax())]]
    while len(centers) < TOPICS:  # the heaviest points far from all centers
        far = 1 - (points @ centers.T).max(axis=1)
        centers = np.concatenate([centers, points[[int((far * weight).argmax())]]])
    for _ in range(30):
        label = (points @ centers.T).argmax(axis=1)
        for k in range(TOPICS):
            m = (points * (weight * (label == k))[:, None]).sum(axis=0)
            if np.linalg.norm(m) > 0:
                centers[k] = m / np.linalg.norm(m)
    return (points @ centers.T).argmax(axis=1) + 1


# --- documents to lists of tokens --------------------------------------------------------------------------------


def _listed(batches: Iterator[pa.RecordBatch], topics: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: a document with the numbers and counts of its tokens; of kind 1: an entry of a block's list."""
    heads = [bytes([k]) for k in range(TOPICS + 1)]
    topic = {}
    numbers: dict[bytes, int] = {}
    trained: list[int] = []
    docs: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not docs:
            return
        block = docs[0][0]
        names = ["kind", "block", "row", "id", "held", "bytes", "size", "packed", "topic", "token", "n"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(),
                 pa.binary(), pa.int32(), pa.binary(), pa.int64()]
        n = len(docs)
        columns = [[0] * n, [block] * n, *[[d[k] for d in docs] for k in range(6)], [None] * n, [None] * n, [None] * n]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        keys, n = list(numbers), len(numbers)
        for a in range(0, n, 50_000):
            part, m = keys[a : a + 50_000], min(n - a, 50_000)
            columns = [[1] * m, [block] * m, range(a, a + m), [None] * m, [None] * m, [None] * m, [None] * m, [None] * m,
                       [k[0] for k in part], [k[1:] for k in part], trained[a : a + m]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        docs.clear(), numbers.clear(), trained.clear()

    for batch in batches:
        for row, doc_id, held, text in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3), strict=True):
            found = lower_words(text.as_py())
            now = before = last = 0
            keys = []
            add = keys.append
            for w in found:
                add(heads[now] + w)
                if len(w) <= SHORT:
                    new = topic.get(w)
                    if new is None:
                        if len(topic) > 1_000_000:
                            topic.clear()
                        new = topic[w] = int(topics[bucket(w)])
                    if new == last or new == before or not now:
                        now = new
                    before, last = last, new
            add(heads[now])
            for k in set(keys).difference(numbers):
                numbers[k] = len(numbers)
                trained.append(0)
            own, count = np.unique(np.array([numbers[k] for k in keys], np.int32), return_counts=True)
            if not held:
                for k, c in zip(own.tolist(), count.tolist(), strict=True):
                    trained[k] += c
            both = np.concatenate([np.diff(own, prepend=0), count]).astype(np.int32)
            packed = pa.compress(both.tobytes(), codec="zstd", asbytes=True)
            docs.append((row, doc_id, held, sum(map(len, found)) + len(found) + 1, len(own), packed))
            if len(numbers) >= LIST:
                yield from flush()
    yield from flush()


_LISTED = ("kind int, block bigint, row bigint, id bigint, held boolean, bytes bigint, size bigint, packed binary, "
           "topic int, token binary, n bigint")


# --- the model --------------------------------------------------------------------------------------------------


@dataclass
class Code:
    """The code tree: for each byte where its path starts in `nodes` and `bits`, and how long it is."""

    start: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray


def code(histogram: np.ndarray) -> Code:
    """The shortest binary code for the given byte counts (each raised by one)."""
    heap = [(float(c) + 1, k, k) for k, c in enumerate(histogram)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    for node in range(256, 511):
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (node, 0), (node, 1)
        heapq.heappush(heap, (a + b, node, node))
    start, length, nodes, bits = [], [], [], []
    for byte in range(256):
        path, at = [], byte
        while at in parent:
            at, bit = parent[at]
            path.append((at - 256, bit))
        start.append(len(nodes)), length.append(len(path))
        nodes += [n for n, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
    return Code(*[np.array(x, np.int64) for x in (start, length, nodes)], np.array(bits, np.int8))


def _spelled(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the tokens with a blank after each (a line feed for the end sign), the token of each byte, the starts."""
    n = len(tokens)
    offsets = np.frombuffer(tokens.buffers()[1], np.int32, n + 1, tokens.offset * 4).astype(np.int64)
    body = tokens.buffers()[2]
    body = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
    length = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]]) if n else np.zeros(0, np.int64)
    out = np.full(len(body) + n, 32, np.uint8)
    last = starts + length
    inside = np.ones(len(out), bool)
    inside[last] = False
    out[inside] = body
    out[last[length == 0]] = 10
    return out, np.repeat(np.arange(n), length + 1), starts


_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_R = np.uint64(0x2545F4914F6CDD1D)
_RI = np.uint64(pow(int(_R), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _contexts(spelled: np.ndarray, token: np.ndarray, starts: np.ndarray, topic: np.ndarray) -> list[np.ndarray]:
    """A 64-bit hash per byte and context."""
    n = len(spelled)
    start = starts[token]
    place = np.arange(n) - start
    value = spelled.astype(np.uint64) + np.uint64(1)
    before = []
    for k in range(1, 5):
        x = np.zeros(n, np.uint64)
        x[k:] = value[:-k]
        before.append(np.where(place >= k, x, np.uint64(0)))
    t = (topic.astype(np.uint64) + np.uint64(1))[token] * _K[4]
    one = before[0] * _K[0]
    two = one + before[1] * _K[1]
    three = two + before[2] * _K[2]
    four = three + before[3] * _K[3]
    whole = np.zeros(n, np.uint64)
    power, back = _powers(_R, n), _powers(_RI, n)
    np.cumsum((value * power)[:-1], out=whole[1:])
    whole = (whole - whole[start]) * back[start]
    whole ^= whole >> np.uint64(31)
    return [one + t, two + t, three + t, four + t, whole * _K[1], whole * _K[2] + t]


class Decisions:
    """The binary decisions of a batch of pairs: token, node, bit, and their slots."""

    def __init__(self, tokens: pa.Array, topic: np.ndarray, tree: Code):
        spelled, token, starts = _spelled(tokens)
        size = tree.length[spelled]
        self.byte = np.repeat(np.arange(len(spelled)), size)
        step = np.arange(len(self.byte)) - np.repeat(np.cumsum(size) - size, size)
        at = tree.start[spelled][self.byte] + step
        self.bit = tree.bits[at]
        self.node = (tree.nodes[at].astype(np.uint64) + np.uint64(1)) * _K[3]
        self.token = token[self.byte]
        self.hashes = _contexts(spelled, token, starts, topic) if len(spelled) else [np.zeros(0, np.uint64)] * CONTEXTS

    def slots(self, k: int) -> np.ndarray:
        h = self.hashes[k][self.byte]
        h += self.node
        h *= _K[0]
        h >>= np.uint64(64 - SLOT_BITS)
        return h.view(np.int64)


#: Counts are told apart exactly up to 5, then by these bounds.
_BOUNDS = np.array([1, 2, 3, 4, 5, 6, 9, 16, 32, 128, 1024, 16384])
LEVELS = len(_BOUNDS) + 1
#: States with at most so many of the rarer outcome use the odds learned for the state, others the counts.
RARE = 5
_LEVEL = np.searchsorted(_BOUNDS, np.arange(16385), side="right").astype(np.int64)


def _state(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return _LEVEL[np.minimum(zero, 16384).astype(np.int64)] * LEVELS + _LEVEL[np.minimum(one, 16384).astype(np.int64)]


def _odds(zero: np.ndarray, one: np.ndarray, learned: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Log odds of counts: by what such states came to where one outcome is rare."""
    plain = np.log((one + np.float32(PRIOR)) / (zero + np.float32(PRIOR)))
    return np.clip(np.where(np.minimum(zero, one) <= RARE, learned[state], plain), -9, 9)


def _learned(hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log odds of every state from how it came out, drawn to those of its lower bounds where it was seen little."""
    low = np.concatenate([[0], _BOUNDS]).astype(float)
    zero, one = np.repeat(low, LEVELS), np.tile(low, LEVELS)
    prior = (one + PRIOR) / (zero + one + 2 * PRIOR)
    return np.log((hits + 20 * prior) / (total - hits + 20 * (1 - prior)))


def _filled(n: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(n.shape, np.int64)
    for s in steps:
        out += n >= s
    return out


def _sureness(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """0 unseen; 1 to 3 one outcome only: once, up to 7 times, more; 4 and 5 both: rarely, often."""
    n = zero + one
    single = _filled(n, (1, 2, 8))
    return np.where(np.minimum(zero, one) > 0, 4 + (n >= 32), single)


#: Contexts that the gate looks at, and how.
def _gate(two: np.ndarray, four: np.ndarray, five: np.ndarray) -> np.ndarray:
    return five * 18 + four * 3 + two


GATES = 108


@dataclass
class Model:
    """What scoring needs: quantized log odds and fill levels of all slots, weights, adaptive map."""

    tree: Code
    odds: np.ndarray
    filled: np.ndarray
    weights: np.ndarray
    adapted: np.ndarray

    def scores(self, tokens: pa.Array, topic: np.ndarray) -> np.ndarray:
        """log10 probability of each token under its topic."""
        d = Decisions(tokens, topic, self.tree)
        slots = [d.slots(k) for k in range(CONTEXTS)]
        gate = _gate(self.filled[0][slots[2]], self.filled[1][slots[4]], self.filled[2][slots[5]].astype(np.int64))
        mixed = np.zeros(len(gate), np.float32)
        for k in range(CONTEXTS):
            mixed += self.weights[:, k][gate] * self.odds[k][slots[k]]
        mixed /= SCALE
        np.clip(mixed, -12, 12, out=mixed)
        z = 0.5 * (mixed + _mapped(self.adapted, gate, mixed))
        lost = np.logaddexp(0, np.where(d.bit == 1, -z, z))
        return -np.bincount(d.token, weights=lost, minlength=len(tokens)) / np.log(10)


def _mapped(adapted: np.ndarray, gate: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    at = np.clip((mixed + 8) * 2, 0, STEPS - 1.001)
    low = at.astype(np.int64)
    part = (at - low).astype(np.float32)
    flat = adapted.ravel()
    return flat[gate * STEPS + low] * (1 - part) + flat[gate * STEPS + low + 1] * part


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches small enough that the arrays of their decisions stay in the processor's cache."""
    for batch in batches:
        for a in range(0, batch.num_rows, CHUNK):
            yield batch.slice(a, CHUNK)


def _histogram(pairs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for batch in batches:
            spelled, token, _ = _spelled(batch.column(0))
            total += np.bincount(spelled, weights=batch.column(1).to_numpy()[token], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    rows = pairs.select("token", "n").mapInArrow(run, "byte bigint, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(256)
    for r in rows:
        out[r["byte"]] = r["n"]
    return out


def _slot_counts(pairs: DataFrame, tree: Code) -> np.ndarray:
    """(context, slot, bit) counts over all training pairs."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((CONTEXTS, SLOTS * 2))
        for batch in _chunked(batches):
            d = Decisions(batch.column(0), batch.column(1).to_numpy(), tree)
            n = batch.column(2).to_numpy().astype(np.float64)[d.token]
            for k in range(CONTEXTS):
                np.add.at(counts[k], d.slots(k) * 2 + d.bit, n)
        blocks = counts.reshape(-1, PART * 2)
        used = np.flatnonzero(blocks.any(axis=1))
        packed = [pa.compress(blocks[k].tobytes(), codec="zstd", asbytes=True) for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(packed, pa.binary())], names=["part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(PART * 2)
        for x in rows["counts"]:
            total += np.frombuffer(pa.decompress(x.as_py(), PART * 16, codec="zstd"))
        return pa.table({"part": rows["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    partial = pairs.coalesce(TASKS).select("token", "topic", "n").mapInArrow(fill, "part bigint, counts binary")
    sums = partial.groupBy("part").applyInArrow(add, "part bigint, counts binary")
    out = np.zeros((CONTEXTS * SLOTS * 2) // (PART * 2) * (PART * 2), np.float32).reshape(-1, PART * 2)
    for r in sums.toLocalIterator():  # the table has a fixed size
        out[r["part"]] = np.frombuffer(r["counts"])
    return out.reshape(CONTEXTS, SLOTS, 2)


def _fitted(pairs: DataFrame, tree: Code, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, adaptive map and odds of states: every task learns online from its pairs, their own occurrence left out."""
    shared = pairs.sparkSession.sparkContext.broadcast((tree, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts = shared.value
        counts = counts.view(np.complex64)[:, :, 0]  # one look-up for both counts of a slot
        odds_of = np.zeros((CONTEXTS, LEVELS**2))
        fresh = 0
        weights = np.tile(np.array(START), (GATES, 1))
        mean, square = np.zeros_like(weights), np.zeros_like(weights)
        seen = np.zeros(GATES)
        hits, total = np.zeros(GATES * STEPS), np.zeros(GATES * STEPS)
        state_hits, state_total = np.zeros((CONTEXTS, LEVELS**2)), np.zeros((CONTEXTS, LEVELS**2))
        step = 0
        for batch in _chunked(batches):
            d = Decisions(batch.column(0), batch.column(1).to_numpy(), tree)
            y = d.bit.astype(np.float32)
            importance = np.sqrt(batch.column(2).to_numpy()).astype(np.float32)[d.token]
            x, parts = np.zeros((CONTEXTS, len(y)), np.float32), {}
            if fresh < 8 or fresh % 8 == 0:
                odds_of = np.stack([_learned(state_hits[k], state_total[k]) for k in range(CONTEXTS)]).astype(np.float32)
            fresh += 1
            for k in range(CONTEXTS):
                both = counts[k][d.slots(k)]
                zero, one = both.real - (1 - y), both.imag - y
                state = _state(zero, one)
                x[k] = _odds(zero, one, odds_of[k], state)
                state_hits[k] += np.bincount(state, weights=importance * y, minlength=LEVELS**2)
                state_total[k] += np.bincount(state, weights=importance, minlength=LEVELS**2)
                if k in (4, 5):
                    parts[k] = _sureness(zero, one)
                elif k == 2:
                    parts[k] = _filled(zero + one, (4, 64))
            gate = _gate(parts[2], parts[4], parts[5])
            for a in range(0, len(y), MINI):
                b = slice(a, a + MINI)
                g, w = gate[b], importance[b]
                mixed = np.zeros(len(g), np.float32)
                for k in range(CONTEXTS):
                    mixed += weights[:, k].astype(np.float32)[g] * x[k, b]
                mixed = np.clip(mixed, -12, 12)
                error = w * (y[b] - 1 / (1 + np.exp(-mixed)))
                amount = np.bincount(g, weights=w, minlength=GATES)
                grad = np.stack([np.bincount(g, weights=error * x[k, b], minlength=GATES) for k in range(CONTEXTS)], axis=1)
                grad /= np.maximum(amount, 1e-9)[:, None]
                step += 1
                mean += 0.1 * (grad - mean)
                square += 0.01 * (grad * grad - square)
                rate = 0.008 / (1 + step / 500)
                weights += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
                seen += amount
                at = g * STEPS + np.clip(np.rint((mixed + 8) * 2), 0, STEPS - 1).astype(np.int64)
                if step > 20:
                    hits += np.bincount(at, weights=w * y[b], minlength=GATES * STEPS)
                    total += np.bincount(at, weights=w, minlength=GATES * STEPS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (weights, seen, hits, total, state_hits, state_total)],
            names=["w", "seen", "hits", "total", "state_hits", "state_total"])

    rows = pairs.coalesce(TASKS).select("token", "topic", "n").mapInArrow(
        run, ", ".join(f"{x} array<double>" for x in ("w", "seen", "hits", "total", "state_hits", "state_total"))).collect()  # TASKS rows at most
    seen = np.array([r["seen"] for r in rows]) + 1e-9
    weights = (np.array([r["w"] for r in rows]).reshape(len(rows), GATES, CONTEXTS) * seen[:, :, None]).sum(axis=0) / seen.sum(axis=0)[:, None]
    hits, total = (np.array([r[k] for r in rows]).sum(axis=0).reshape(GATES, STEPS) for k in ("hits", "total"))
    even = np.arange(STEPS) / 2 - 8
    prior = 1 / (1 + np.exp(-even))
    adapted = np.log((hits + 50 * prior) / (total - hits + 50 * (1 - prior)))
    states = [np.array([r[k] for r in rows]).sum(axis=0).reshape(CONTEXTS, -1) for k in ("state_hits", "state_total")]
    return weights, adapted, np.stack([_learned(h, t) for h, t in zip(*states, strict=True)])


def fit(pairs: DataFrame) -> Model:
    """The model of all pairs with a training count."""
    trained = pairs.filter("n > 0")
    tree = code(_histogram(trained))
    counts = _slot_counts(trained, tree)
    if counts.any():
        weights, adapted, learned = _fitted(trained, tree, counts)
    else:
        weights, adapted, learned = np.zeros((GATES, CONTEXTS)), np.zeros((GATES, STEPS)), np.zeros((CONTEXTS, LEVELS**2))
    zero, one = counts[:, :, 0], counts[:, :, 1]
    odds = np.stack([_odds(zero[k], one[k], learned[k], _state(zero[k], one[k])) for k in range(CONTEXTS)])
    filled = np.stack([_filled(zero[2] + one[2], (4, 64)), _sureness(zero[4], one[4]), _sureness(zero[5], one[5])])
    return Model(tree, np.rint(odds * SCALE).astype(np.int8), filled.astype(np.int8), weights.astype(np.float32), adapted.astype(np.float32))


def _scored(pairs: DataFrame, model: Model) -> DataFrame:
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shared.value.scores(x.column(0), x.column(1).to_numpy()) for x in _chunked(iter([batch]))]
            s = pa.array(np.concatenate(s) if s else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), s], names=["token", "topic", "c", "s"])

    return pairs.select("token", "topic", "c").mapInArrow(run, "token binary, topic int, c bigint, s double")


def scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: `id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`, `bits_per_byte`."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("id"),
        F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    topics = _clusters(_following(rows.filter("NOT held"), "text"))
    listed = written(rows.mapInArrow(lambda it: _listed(it, topics), _LISTED))
    entries = listed.filter("kind = 1").select("block", F.col("row").cast("int").alias("number"), "topic", "token", "n")
    # An entry is a sum already; a token has at most one for each block and topic.
    dealt = entries.select("token", "topic", "n").repartition("token")
    each = dealt.groupBy("token", "topic").agg(F.sum("n").alias("n"))
    pairs = written(each.withColumn("c", F.sum("n").over(Window.partitionBy("token"))))
    known = by_token_totals(pairs)
    done = written(_scored(pairs, fit(pairs)))
    found = entries.select("block", "number", "topic", "token").join(done, ["token", "topic"]).select(F.col("block").alias("of"), "number", "c", "s")
    return _summed(listed.filter("kind = 0"), found, *known)


def by_token_totals(pairs: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens in training texts."""
    r = pairs.agg(F.sum("n").alias("n")).first()
    v = pairs.filter("c > 0").select("token").distinct().count()
    return int(r["n"] or 0), v


def _summed(docs: DataFrame, found: DataFrame, n: int, v: int) -> DataFrame:
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["number"].to_numpy())
        c, s = right["c"].to_numpy()[order], right["s"].to_numpy()[order]
        base = np.log10((c + 1) / (n + v + 1))
        out = []
        for row in left.select(["id", "held", "bytes", "size", "packed"]).to_batches():
            for doc_id, held, size, m, packed in zip(*[row.column(i) for i in range(5)], strict=True):
                both = np.frombuffer(pa.decompress(packed.as_py(), m.as_py() * 8, codec="zstd"), np.int32)
                at, k = np.cumsum(both[: m.as_py()]), both[m.as_py() :]
                score = float((s[at] * k).sum())
                out.append((doc_id.as_py(), held.as_py(), int(k.sum()), int(k[c[at] > 0].sum()), n,
                            float((base[at] * k).sum()), score, -score / np.log10(2) / size.as_py()))
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    schema = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    left = docs.select("block", "id", "held", "bytes", "size", "packed")
    return left.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(run, schema)
