"""SimHash near-dedup with BK-trees.

Fingerprints: the words of a text (A-Z lowered) in shingles of `shingle` words, XXH64 (seed 42) of each, and a
bit set where more than half of the hashes have it. Equal fingerprints are one node from then on.

Links (Hamming distance `radius` or less): the 64 bits are cut into radius + 1 bands. Fingerprints within the
radius agree in a band, so each band value is a shard, and a link is found in a shard of one of its bands.
Every shard becomes a BK-tree, children keyed by their integer distance to the parent, and a query at distance d
from a node follows only the edges from d - radius to d + radius. The trees of a batch of shards are flat arrays
and are grown and searched together, level by level. Shard trees travel with their shard in a shuffle instead of
a broadcast, because their total grows with the corpus.

A shard of more than `TREE` fingerprints is cut into parts; each pair of parts is searched by itself (the tree
of one, the other as queries), so no task holds more than two parts, whatever the shard. Inside a search the
links are folded to one link per node and local class, so a large group never emits its pairs.

Classes are the connected components of these links; of a class the row with the smallest id stays.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a text with fewer words
than a shingle is one shingle; rows with a null id keep a null class and are never dropped; rows that repeat an
id share its class if their texts do; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import written
from .components import components
from .words import computed, lower_words, packed, unpacked

RADIUS = 3
SHINGLE = 3
#: Fingerprints in one tree.
TREE = 1 << 15
#: Visits of (query, node) that a search keeps open at once.
FRONTIER = 1 << 20
PIECE = 1 << 15

_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1  # [byte, bit]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    found = lower_words(text)
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(len(found) - shingle + 1, 1)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    pieces = (zip(starts[k : k + PIECE], stops[k : k + PIECE], strict=True) for k in range(0, n, PIECE))
    return majority(np.array([digest(joined[a:b], 42) for a, b in piece], np.uint64) for piece in pieces)


def majority(pieces: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the hashes have, unsigned; the hashes come in pieces."""
    counts, n = np.zeros((8, 256), np.int64), 0
    offset = (np.arange(8) * 256)[None, :]
    for h in pieces:
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + offset).ravel(), minlength=2048).reshape(8, 256)
        n += len(h)
    ones = (counts @ _BITS).ravel()  # bit k of the little-endian hash
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`id`, `h` (hash of the text) and `fp` (signed 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["id", "h", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, h bigint, fp bigint")


class Forest:
    """BK-trees of many shards in flat arrays; node k is the k-th tree fingerprint, ordered by shard."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        self.fps = fps
        n = len(fps)
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, int)
        self.roots = dict(zip(shard[first].tolist(), first.tolist(), strict=True))
        root = np.repeat(first, np.diff(np.append(first, n)))
        parents, edges, children = [], [], []
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = root[rest]
        while len(rest):  # one level a round: the first to ask for an edge becomes its child, the others go down
            edge = np.bitwise_count(fps[rest] ^ fps[at]).astype(np.int64)
            key, index, inverse = np.unique(at * 65 + edge, return_index=True, return_inverse=True)
            child = rest[index]
            parents.append(key // 65), edges.append(key % 65), children.append(child)
            down = child[inverse]
            stay = down != rest
            rest, at = rest[stay], down[stay]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        key = join(parents) * 65 + join(edges)
        order = np.argsort(key, kind="stable")
        self.keys, self.children = key[order], join(children)[order]

    def links(self, queries: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, node) of all links, in chunks; a query searches the tree of its shard."""
        node = np.array([self.roots.get(s, -1) for s in shard.tolist()], np.int64)
        start = np.flatnonzero(node >= 0)
        stack = [(start[k : k + FRONTIER // 4], node[start[k : k + FRONTIER // 4]]) for k in range(0, len(start), FRONTIER // 4)]
        while stack:
            q, at = stack.pop()
            d = np.bitwise_count(queries[q] ^ self.fps[at]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], at[near]
            low = np.searchsorted(self.keys, at * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, at * 65 + np.minimum(d + radius, 64), side="right")
            count = high - low
            total = int(count.sum())
            if not total:
                continue
            for part in _chunks(count, FRONTIER):
                c = count[part]
                where = np.repeat(low[part] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(int(c.sum()))
                stack.append((np.repeat(q[part], c), self.children[where]))


def _chunks(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about `most` counted rows each."""
    ends = np.cumsum(count)
    cuts = np.unique(np.searchsorted(ends, np.arange(most, int(ends[-1]) + most, most), side="left") + 1)
    a = 0
    for b in np.minimum(cuts, len(count)).tolist():
        if b > a:
            yield slice(a, b)
            a = b


def _folded(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the smallest item of its class under the given links."""
    root = np.arange(n)

    def tops(x: np.ndarray) -> np.ndarray:
        x = root[x]
        while (root[x] != x).any():
            x = root[x]
        return x

    for a, b in found:
        while True:
            x, y = tops(a), tops(b)
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
    return tops(np.arange(n))


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the shards of a partition, which is sorted by shard; the last shard of a batch may go on in the next."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        shard, fp, node, tree = rows
        size = np.bincount(shard - shard[0])[shard - shard[0]]
        rows = rows[:, size > 1]
        shard, fp, node, tree = rows
        fp = fp.view(np.uint64)
        member = np.flatnonzero(tree != 1)  # 0: tree and query, 2: tree only, 1: query only
        asking = np.flatnonzero(tree != 2)
        forest = Forest(fp[member], shard[member])
        hits = ((asking[q], member[t]) for q, t in forest.links(fp[asking], shard[asking], radius))
        top = _folded(len(fp), hits)
        linked = np.flatnonzero(top != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[top[linked]])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        held.append(np.stack(new))
        if held[0][0][0] == new[0][-1]:
            continue
        rows = np.concatenate(held, axis=1)
        end = int(np.searchsorted(_ranked(rows[0]), _ranked(rows[0])[-1]))
        yield links(np.concatenate([_ranked(rows[0])[None, :end], rows[1:, :end]]))
        held = [rows[:, end:]]
    if held:
        rows = np.concatenate(held, axis=1)
        yield links(np.concatenate([_ranked(rows[0])[None], rows[1:]]))


def _ranked(shard: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for the shards in the order they come."""
    return np.concatenate([[0], np.cumsum(shard[1:] != shard[:-1])])


def links(nodes: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links (`a`, `b`) that connect all `nodes` (fp, node; fps distinct) within the radius, folded per shard."""
    bands = radius + 1
    width = [64 // bands + (k < 64 % bands) for k in range(bands)]
    shift = [sum(width[:k]) for k in range(bands)]
    value = lambda k: F.shiftrightunsigned("fp", shift[k]).bitwiseAND(F.lit((1 << width[k]) - 1))
    shard = F.array(*[value(k) * bands + k for k in range(bands)])
    rows = nodes.select("fp", "node", F.explode(shard).alias("shard"))
    large = written(rows.groupBy("shard").count().filter(F.col("count") > tree))
    if large.isEmpty():
        rows = rows.withColumn("role", F.lit(0))
        work = F.col("shard")
    else:
        rows = rows.join(large, "shard", "left")
        rows = rows.withColumn("parts", F.coalesce(F.ceil(F.col("count") / tree), F.lit(1)).cast("int"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        each = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(
            F.least(p, F.col("own")).alias("i"), F.greatest(p, F.col("own")).alias("j"),
            F.when(p == F.col("own"), 0).when(p > F.col("own"), 2).otherwise(1).alias("role"),
        ))
        rows = rows.select("fp", "node", "shard", F.inline(each))
        work = F.xxhash64("shard", "i", "j")  # two works of one hash would only be searched together
    rows = rows.select(work.alias("work"), "fp", "node", F.col("role").cast("long").alias("role"))
    sorted_ = rows.repartition("work").sortWithinPartitions("work")
    return sorted_.mapInArrow(lambda it: _search(it, radius), "a bigint, b bigint")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `h`, `fp` and `component` (smallest id of the class) for every row."""
    prints = written(fingerprints(docs, doc_id, text))
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("node")))
    roots = components(links(nodes.filter("node IS NOT NULL")))
    found = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    mine = F.when(F.col("id").isNotNull(), F.col("component"))
    return prints.join(written(found), "fp").select("id", "h", "fp", mine.alias("component"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each class the row with the smallest id (of its repeated rows one), and rows without an id; columns as given."""
    return kept(docs, classes(docs, doc_id, text), doc_id, text)


def kept(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same for classes already `found` (id, h, component)."""
    found = written(found)
    gone = found.filter("component != id").select("id", "h").distinct()
    first = written(found.filter("component = id").groupBy("id").agg(F.count("*").alias("n"), F.min("h").alias("h")).filter("n > 1"))
    keyed = packed(docs, id=F.col(doc_id).cast("long"), h=F.xxhash64(F.col(text)))
    stay = keyed.join(gone, ["id", "h"], "left_anti")
    if first.isEmpty():
        return unpacked(stay, docs)
    one = stay.join(first.select("id", "h"), ["id", "h"], "left_semi").dropDuplicates(["id"])
    return unpacked(stay.join(first.select("id"), "id", "left_anti").select("doc").unionAll(one.select("doc")), docs)
