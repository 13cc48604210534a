"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard.

Vectors of one dimension are dealt out by hash to shards of about `SHARD` distinct vectors. A shard's graph has
layers of flat neighbour arrays (one row per node, -1 where a link is missing); a node's layer is drawn from a
seeded geometric distribution, and nodes are numbered by layer, so layer l is the first rows of its array.
Nodes enter in batches: a beam search over the graph so far gives candidates, which are thinned to diverse
ones and linked both ways. Searches go down the layers with a beam, for a block of queries at a time.

Largest inner product becomes smallest distance by one more component that brings all vectors of a shard to
the same norm (zero for queries). Scores are inner products of the original vectors in double precision.

Every query visits every shard, in blocks of queries, and the shards' best are merged by a rank limit that
Spark applies before the shuffle. Equal vectors are one node with its `k` + 1 smallest ids, cut by rank before
the shuffle, too, so a vector that a third of the rows hold never meets in one task.

Defined cases: null vectors, vectors with null or non-finite components and zero vectors take no part; vectors
of different dimension are never compared; null ids take no part; rows that repeat an id and vector count once;
ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import written

SHARD = 8192
#: Links of a node in upper layers; the lowest layer has twice as many.
LINKS = 16
BUILD_BEAM = 96
SEARCH_BEAM = 160
#: Nodes expanded in one step of a beam, nodes inserted and queries searched together.
EXPAND = 4
BATCH = 256
#: Queries that one task searches in a shard.
BLOCK = 16384
SEED = 5


class Graph:
    """A layered graph over the rows of `vectors`, which all have the same norm."""

    def __init__(self, vectors: np.ndarray, counts: list[int], layers: list[np.ndarray]):
        self.vectors, self.counts, self.layers = vectors, counts, layers

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray) -> Graph:
        """`levels` falls from row to row."""
        top = int(levels[0])
        counts = [int((levels >= k).sum()) for k in range(top + 1)]
        layers = [np.full((counts[k], LINKS * (1 if k else 2)), -1, np.int32) for k in range(top + 1)]
        graph = cls(vectors, counts, layers)
        at, n = 1, len(vectors)
        while at < n:
            level = int(levels[at])
            end = min(at + max(1, min(BATCH, at // 2)), counts[level], n)
            graph._insert(np.arange(at, end), level)
            at = end
        return graph

    def beam(self, queries: np.ndarray, entry: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes found from the entry nodes, and their similarities, nearest first."""
        links, n = self.layers[layer], self.counts[layer]
        total = len(queries)
        ids = np.full((total, width), -1, np.int32)
        sims = np.full((total, width), -np.inf, np.float32)
        fresh = np.zeros((total, width), bool)
        seen = np.zeros((total, n), bool)
        e = min(entry.shape[1], width)
        ids[:, :e] = entry[:, :e]
        held = ids[:, :e] >= 0
        rows, cols = np.nonzero(held)
        sims[rows, cols] = np.einsum("nd,nd->n", queries[rows], self.vectors[ids[rows, cols]])
        fresh[:, :e] = held
        seen[rows, ids[rows, cols]] = True
        active = np.arange(total)
        while len(active):
            s = np.where(fresh[active], sims[active], -np.inf)
            k = min(EXPAND, width)
            pick = np.argpartition(-s, k - 1, axis=1)[:, :k]
            good = np.take_along_axis(s, pick, axis=1) > -np.inf
            on = good.any(axis=1)
            active, pick, good = active[on], pick[on], good[on]
            if not len(active):
                break
            side = active[:, None]
            fresh[side, pick] = False
            near = links[np.where(good, ids[side, pick], 0)]
            near[~good] = -1
            near = np.sort(near.reshape(len(active), -1), axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~seen[side, near]
            rows, cols = np.nonzero(new)
            if not len(rows):
                continue
            node = near[rows, cols]
            seen[active[rows], node] = True
            sim = np.einsum("nd,nd->n", queries[active[rows]], self.vectors[node])
            # New nodes to the left, then the best of old and new.
            slot = np.cumsum(new, axis=1)[rows, cols] - 1
            room = int(slot.max()) + 1
            more_ids, more_sims = np.full((len(active), room), -1, np.int32), np.full((len(active), room), -np.inf, np.float32)
            more_ids[rows, slot], more_sims[rows, slot] = node, sim
            all_sims = np.concatenate([sims[active], more_sims], axis=1)
            all_ids = np.concatenate([ids[active], more_ids], axis=1)
            all_fresh = np.concatenate([fresh[active], more_ids >= 0], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[active], ids[active] = np.take_along_axis(all_sims, best, axis=1), np.take_along_axis(all_ids, best, axis=1)
            fresh[active] = np.take_along_axis(all_fresh, best, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates sorted by nearness, those nearer to the node than to one already taken, then the nearest others."""
        if ids.shape[1] <= most:
            return ids
        v = self.vectors[np.maximum(ids, 0)]
        pair = v @ v.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -np.inf, np.float32)
        count = np.zeros(len(ids), int)
        for c in range(ids.shape[1]):
            take = (ids[:, c] >= 0) & (count < most) & (closest[:, c] < sims[:, c])
            taken[:, c] = take
            count += take
            closest = np.where(take[:, None], np.maximum(closest, pair[:, c]), closest)
        rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        pick = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(ids, pick, axis=1)

    def _insert(self, new: np.ndarray, level: int) -> None:
        vectors = self.vectors[new]
        near = np.zeros((len(new), 1), np.int32)
        for layer in range(len(self.layers) - 1, level, -1):
            near, _ = self.beam(vectors, near, layer, 1)
        mates = vectors @ vectors.T
        np.fill_diagonal(mates, -np.inf)
        k = min(LINKS, len(new))
        beside = np.argsort(-mates, axis=1)[:, :k]
        beside_sims = np.take_along_axis(mates, beside, axis=1)
        beside_ids = np.where(beside_sims > -np.inf, new[beside], -1).astype(np.int32)
        for layer in range(level, -1, -1):
            near, sims = self.beam(vectors, near, layer, BUILD_BEAM)
            ids, sims = np.concatenate([near, beside_ids], axis=1), np.concatenate([sims, beside_sims], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            chosen = self._diverse(ids, sims, LINKS)
            links = self.layers[layer]
            links[new, : chosen.shape[1]] = chosen
            rows, cols = np.nonzero(chosen >= 0)
            self._link_back(layer, chosen[rows, cols], new[rows])

    def _link_back(self, layer: int, nodes: np.ndarray, added: np.ndarray) -> None:
        links = self.layers[layer]
        order = np.lexsort((added, nodes))
        nodes, added = nodes[order], added[order]
        unique, first, count = np.unique(nodes, return_index=True, return_counts=True)
        slot = np.arange(len(nodes)) - np.repeat(first, count)
        more = np.full((len(unique), int(count.max())), -1, np.int32)
        more[np.repeat(np.arange(len(unique)), count), slot] = added
        ids = np.concatenate([links[unique], more], axis=1)
        ids = np.sort(ids, axis=1)[:, ::-1]
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        ids = np.sort(ids, axis=1)[:, ::-1]
        width = links.shape[1]
        full = (ids >= 0).sum(axis=1) > width
        links[unique[~full]] = ids[~full, :width]
        for k in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) // 1024)):
            if not len(k):
                continue
            some = ids[k]
            v = self.vectors[np.maximum(some, 0)]
            sims = np.where(some >= 0, np.einsum("nd,nkd->nk", self.vectors[unique[k]], v), -np.inf).astype(np.float32)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
            links[unique[k]] = self._diverse(np.take_along_axis(some, order, axis=1), np.take_along_axis(sims, order, axis=1), width)

    def search(self, queries: np.ndarray, width: int = SEARCH_BEAM) -> np.ndarray:
        """The nearest nodes of each query, nearest first, -1 where there are no more."""
        near = np.zeros((len(queries), 1), np.int32)
        for layer in range(len(self.layers) - 1, 0, -1):
            near, _ = self.beam(queries, near, layer, 1)
        return self.beam(queries, near, 0, width)[0]


def levelled(vectors: np.ndarray) -> np.ndarray:
    """Vectors in float32 with the component that makes their norms equal."""
    norm = np.einsum("nd,nd->n", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1).astype(np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _build(rows: pa.Table) -> pa.Table:
    """One row per shard: ids, vectors (double) and the layers, all flat."""
    order = np.argsort(rows["node"].to_numpy())
    ids, vectors = rows["node"].to_numpy()[order], _matrix(rows["vector"])[order]
    draw = np.random.default_rng(SEED).random(len(ids))
    levels = np.minimum(-np.log(1 - draw) / np.log(LINKS), 8).astype(int)
    order = np.argsort(-levels, kind="stable")
    ids, vectors, levels = ids[order], vectors[order], levels[order]
    graph = Graph.build(levelled(vectors), levels)
    return pa.table({
        "dim": pa.array([vectors.shape[1]], pa.int32()), "shard": pa.array([rows["shard"][0].as_py()], pa.int32()),
        "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary()),
        "counts": pa.array([graph.counts], pa.list_(pa.int32())),
        "links": pa.array([b"".join(x.tobytes() for x in graph.layers)], pa.binary()),
    })


def _loaded(row: dict) -> tuple[np.ndarray, np.ndarray, Graph]:
    ids = np.frombuffer(row["ids"], np.int64)
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
    layers, at = [], 0
    for k, n in enumerate(row["counts"]):
        size = n * LINKS * (1 if k else 2)
        layers.append(np.frombuffer(row["links"], np.int32, size, at * 4).reshape(n, -1))
        at += size
    return ids, vectors, Graph(levelled(vectors), row["counts"], layers)


def valid(vector) -> F.Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nodes(rows: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct vectors: `node` (smallest id), `ids` (the k + 1 smallest ids), `vector`, `dim`."""
    picked = rows.filter(F.col(vec_id).isNotNull() & valid(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    keyed = picked.dropDuplicates(["id", "vector"]).withColumn("key", F.xxhash64("vector"))
    rank = F.row_number().over(Window.partitionBy("key", "vector").orderBy("id"))
    few = keyed.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    return few.groupBy("key", "vector").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids")).select(
        "node", "ids", "vector", F.size("vector").alias("dim"))


def index(found: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per shard with its graph."""
    sizes = found.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    rows = found.select("node", "vector", "dim").join(sizes, "dim")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")).drop("shards")
    total = sizes.agg(F.sum("shards")).first()[0] or 1
    schema = "dim int, shard int, ids binary, vectors binary, counts array<int>, links binary"
    return rows.repartition(int(total), "dim", "shard").groupBy("dim", "shard").applyInArrow(_build, schema)


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (shard, block), the graph first, then its queries."""
    loaded = None
    for batch in batches:
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        start = np.flatnonzero(kinds == 0).tolist()
        cuts = sorted({0, *start, *[s + 1 for s in start], batch.num_rows})
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if kinds[a] == 0:
                loaded = _loaded(part.select(["ids", "vectors", "counts", "links"]).to_pylist()[0])
                continue
            ids, vectors, graph = loaded
            queries, names = _matrix(part.column("vector")), part.column("id").to_numpy()
            for at in range(0, len(queries), BATCH):
                q = queries[at : at + BATCH]
                wide = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
                near = graph.search(wide, max(SEARCH_BEAM, k))
                rows, cols = np.nonzero(near >= 0)
                node = near[rows, cols]
                score = np.einsum("nd,nd->n", q[rows], vectors[node])
                order = np.lexsort((ids[node], -score, rows))
                rows, node, score = rows[order], node[order], score[order]
                first = np.searchsorted(rows, np.arange(len(q)))
                keep = np.arange(len(rows)) - first[rows] < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[at : at + BATCH][rows[keep]]), pa.array(ids[node[keep]]), pa.array(score[keep])],
                    names=["query_id", "node", "score"])


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k nearest rows found for each query, but itself."""
    found = written(nodes(rows, k, vec_id, vector))
    graphs = written(index(found))
    asked = written(queries.filter(F.col(vec_id).isNotNull() & valid(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    ).dropDuplicates(["id"]).withColumn("dim", F.size("vector")))
    blocks = max(1, -(-asked.count() // BLOCK))
    shards = graphs.select("dim", "shard")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    none = {"id": "bigint", "vector": "array<double>", "ids": "binary", "vectors": "binary", "counts": "array<int>", "links": "binary"}
    empty = lambda *names: [F.lit(None).cast(none[x]).alias(x) for x in names]
    left = graphs.select("dim", "shard", each, F.lit(0).alias("kind"), *empty("id", "vector"), "ids", "vectors", "counts", "links")
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    # Every stated query meets every shard of its dimension: the list of shards is a row per SHARD vectors.
    listed = shards.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    right = asked.join(listed, "dim").select("dim", F.explode("shards").alias("shard"), own, F.lit(1).alias("kind"), "id", "vector",
                                             *empty("ids", "vectors", "counts", "links"))
    work = left.unionByName(right).repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "kind")
    hits = work.mapInArrow(lambda it: _searched(it, k + 1), "query_id bigint, node bigint, score double")
    by_node = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    merged = hits.withColumn("r", F.row_number().over(by_node)).filter(F.col("r") <= k + 1).drop("r")
    named = merged.join(found.select("node", "ids"), "node").select("query_id", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = named.filter("vec_id != query_id").withColumn("rank", F.row_number().over(by_id)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
