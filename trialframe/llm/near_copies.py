"""Near-duplicate classes: SimHash fingerprints in BK-trees propose, the Jaccard similarity of word shingles decides.

A text is the set of its shingles of `SHINGLE` words (A-Z lowered), by XXH64. Two texts are linked if the sets
have a Jaccard similarity of at least `SIMILAR` percent; classes are the connected components of the links.

1.  Every text gets a fingerprint over its shingles. The BK-trees of `simhash.links` find the texts within
    `simhash.RADIUS` bits, the sets verify these pairs, and the verified links are the first classes.
    A fingerprint of 64 bits cannot reach all of 0.8: such texts differ in about 10 bits (18 to miss one in 500), and at
    that radius a band has 3 bits and a search compares nearly all pairs. So the further links need keys:
    every text also gets BANDS keys, each over ROWS minima of its set. Texts of similarity 0.8 miss each other in all
    keys with a probability of 8e-6, more similar ones with less; of similarity 0.4 they meet in one case of 25. Texts of
    equal sets are one node from the start.
2.  In the bucket of a key every node is paired with one leader, unless the sizes of the sets rule the similarity out;
    the pairs are verified on the sets, and the verified links merged into classes. As long as a bucket holds several
    classes, this is repeated with other leaders, so a large group of near copies costs a few pairs per node.
3.  Nodes that are then still in different classes of one bucket are compared inside tasks, with their sets: a bucket is
    cut into parts, each pair of parts is compared by itself, and a node gives one link per class that it joins. So no
    link is left out, no task holds more than two parts, and pairs are never rows. Buckets with the same nodes are one.

Sets travel only for nodes that are in a pair or in such a bucket. Buckets, pairs and sets go through shuffles of tables
in storage, and a turn's tables are deleted after it.

Defined cases: null and empty texts have the empty set and are one class; a text with fewer words than a shingle
is one shingle; rows with a null id keep a null class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import forgotten, written
from . import simhash
from .components import components
from .words import lower_words

SHINGLE = 5
#: Percent of the union.
SIMILAR = 80
BANDS = 64
ROWS = 8
#: Rounds of leaders before nodes are compared inside tasks, and nodes of a part there.
ROUNDS = 3
PART = 256
PIECE = 1 << 11

_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(text: str | None) -> np.ndarray:
    """The shingle hashes of a text, repeats included."""
    found = lower_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(len(found) - SHINGLE + 1, 1)].tolist()
    stops = ends[min(SHINGLE, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(hashes(text))


def fingerprint(found: np.ndarray) -> int:
    """The SimHash fingerprint of shingle hashes, unsigned."""
    return simhash.majority(found[k : k + simhash.PIECE] for k in range(0, len(found), simhash.PIECE))


def keys(found: np.ndarray) -> np.ndarray:
    """The bucket keys of a shingle set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), PIECE):
        least = np.minimum(least, (found[None, k : k + PIECE] * _A[:, None] + _B[:, None]).min(axis=1))
    least = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for j in range(ROWS):
        key = (key ^ least[:, j]) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`id`, `h` (hash of the text), `s` and `size` (hash and size of the set), `fp` and `keys` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [hashes(x.as_py()) for x in batch.column(2)]
            fp = np.array([fingerprint(x) for x in every], np.uint64).view(np.int64)
            sets = [np.unique(x) for x in every]
            s = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            flat = np.concatenate([keys(x) for x in sets]) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(flat))
            size = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), size, pa.array(fp), lists], names=["id", "h", "s", "size", "fp", "keys"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, h bigint, s bigint, size bigint, fp bigint, keys array<bigint>")


def _sets(docs: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """`node` and its shingles, for the texts whose hash is in `nodes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py()).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    rows = docs.select(F.xxhash64(F.col(text)).alias("node"), F.col(text).alias("text")).join(nodes, "node", "left_semi")
    return rows.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(run, "node bigint, set array<bigint>")


def _similar(docs: DataFrame, text: str, pairs: DataFrame) -> DataFrame:
    """The `pairs` (a, b) that reach the similarity."""
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(_sets(docs, text, nodes))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    found = written(both.filter(same * 100 >= (F.size("x") + F.size("y") - same) * SIMILAR).select("a", "b"))
    forgotten(sets)
    return found


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the works of a partition, which is sorted by work: nodes of different classes, by their sets."""
    group: list[tuple] = []

    def links() -> pa.RecordBatch:
        top = {root: root for _, _, root, _, _ in group}

        def of(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        sets = [(node, root, role, np.array(found, np.int64)) for _, node, root, role, found in group]
        sets.sort(key=lambda x: len(x[3]))
        out = []
        for k, (node, root, role, x) in enumerate(sets):
            for other, root2, role2, y in sets[k + 1 :]:
                if len(x) * 100 < len(y) * SIMILAR:
                    break
                if (role and role == role2) or of(root) == of(root2):  # two of one part are compared in the part's own work
                    continue
                same = len(np.intersect1d(x, y, assume_unique=True))
                if same * 100 >= (len(x) + len(y) - same) * SIMILAR:
                    out.append((min(node, other), max(node, other)))
                    top[of(root)] = of(root2)
        group.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if group and row[0] != group[0][0]:
                yield links()
            group.append(row)
    if group:
        yield links()


def _rest(docs: DataFrame, text: str, rows: DataFrame, several: DataFrame) -> DataFrame:
    """Links between all nodes of different classes that share one of the buckets `several`."""
    left = rows.join(several.select("key"), "key", "left_semi")
    same = left.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    kept = written(same.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"))
    left = written(left.join(kept, "key"))
    sets = written(_sets(docs, text, left.select("node").distinct()))
    parts = F.ceil(F.col("n") / PART).cast("int")
    left = left.withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int"))
    each = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(
        F.least(p, F.col("own")).alias("i"), F.greatest(p, F.col("own")).alias("j"),
        F.when(p == F.col("own"), 0).when(p > F.col("own"), 1).otherwise(2).alias("role")))
    works = left.select("key", "node", "root", F.inline(each)).select(F.xxhash64("key", "i", "j").alias("work"), "node", "root", "role")
    full = works.join(sets, "node").select("work", "node", "root", "role", "set")
    found = written(full.repartition("work").sortWithinPartitions("work").mapInArrow(_compared, "a bigint, b bigint"))
    forgotten(kept, sets)
    return found


def _by_fingerprint(docs: DataFrame, text: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The pairs that the trees over the fingerprints of `nodes` (node, fp) propose, and those that the sets verify."""
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(least, "fp").filter("node != first").select(*_ordered(F.col("node"), F.col("first")))
    near = simhash.links(least.select("fp", F.col("first").alias("node"))).select(*_ordered(F.col("a"), F.col("b")))
    pairs = written(same.unionAll(near).distinct())
    forgotten(least)
    return pairs, None if pairs.isEmpty() else _similar(docs, text, pairs)


def _roots(docs: DataFrame, text: str, buckets: DataFrame, tested: DataFrame, found: DataFrame | None) -> DataFrame | None:
    """(`node`, `root`) of all linked nodes: by the links `found` among the pairs `tested`, then from `buckets` (key, node, size)."""
    roots = None if found is None or found.isEmpty() else written(components(found))
    for turn in range(ROUNDS + 1):
        rows = buckets.withColumn("root", F.col("node"))
        if roots is not None:
            rows = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = written(rows)
        several = rows.groupBy("key").agg(
            F.min("root").alias("low"), F.max("root").alias("high"),
            F.min_by(F.struct("node", "root", "size"), F.xxhash64("node", F.lit(turn))).alias("leader"))
        several = written(several.filter("low < high").select("key", "leader"))
        if several.isEmpty():
            forgotten(rows, several)
            break
        if turn == ROUNDS:
            found = _rest(docs, text, rows, several)
        else:
            near = rows.join(several, "key").filter(F.col("root") != F.col("leader.root"))
            near = near.filter(F.least("size", "leader.size") * 100 >= F.greatest("size", "leader.size") * SIMILAR)
            pairs = near.select(*_ordered(F.col("node"), F.col("leader.node"))).distinct()
            pairs = written(pairs.join(tested, ["a", "b"], "left_anti"))
            tested = tested.unionAll(pairs)
            found = None if pairs.isEmpty() else _similar(docs, text, pairs)
        forgotten(rows, several)
        if found is None or found.isEmpty():
            continue
        if roots is not None:  # only links between classes are new
            ends = {c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b")}
            new = found.join(ends["a"], "a", "left").join(ends["b"], "b", "left")
            new = written(components(new.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
            old = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            old = old.select("node", F.coalesce("top", "root").alias("root"))
            merged = written(old.unionAll(new.join(roots.select("node"), "node", "left_anti").select("node", "root")))
            forgotten(roots, new)
            roots = merged
        else:
            roots = written(components(found))
    return roots


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `h` and `component` (smallest id of the class) for every row."""
    signed = written(_signed(docs, doc_id, text))
    # The keys of equal sets are equal, so any row can give them.
    nodes = written(signed.groupBy("s").agg(F.min("h").alias("node"), F.min("id").alias("least"), F.first("size").alias("size"),
        F.min_by("fp", "h").alias("fp"), F.first("keys").alias("keys")))
    rows = written(signed.select("id", "h", "s"))
    forgotten(signed)
    placed = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = written(placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    buckets = written(placed.join(shared, "key"))
    roots = _roots(docs, text, buckets, *_by_fingerprint(docs, text, nodes.select("node", "fp")))
    known = nodes.select("s", "node", "least").withColumn("root", F.col("node"))
    if roots is not None:
        known = nodes.select("s", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = written(known)
    smallest = written(known.groupBy("root").agg(F.min("least").alias("component")))
    found = written(known.join(smallest, "root").select("s", "component"))
    forgotten(nodes, shared, buckets, known, smallest)
    mine = F.when(F.col("id").isNotNull(), F.col("component"))
    return rows.join(found, "s").select("id", "h", mine.alias("component"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each class the row with the smallest id (of its repeated rows one), and rows without an id; columns as given."""
    return simhash.kept(docs, classes(docs, doc_id, text), doc_id, text)
