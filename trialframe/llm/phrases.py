"""Phrase mining: collocations of each language, counted in HAT-tries that spill sorted runs.

1.  A task keeps, per language, a trie over word ids whose leaves are hash containers from the rest of a window to its
    count; a container above `BURST` entries bursts into one for each next word. At `HELD` entries the largest subtrees
    leave the trie as sorted runs, until half is left.
2.  Runs are merged per prefix: windows with the same first words meet, sorted, in one partition, and a single pass sums
    every prefix of them, since the windows that start with a phrase stand together. Windows that begin with a pair of
    over a `HOT`-th of all words are dealt by the whole window instead, and their sums are added up afterwards.
3.  A phrase is frequent only if all its pairs are, so windows end at a pair that is not. This is told by a bitmap of
    fixed size: pairs are counted beforehand as hashes of 64 bits, and the frequent ones set a bit each. A false bit costs
    extra counting, and a pair without its bit is never frequent; every count of a phrase comes from the tries.
4.  A phrase is cut after each of its words; the cut with the smallest score counts. Phrases that always stand inside
    a longer one go: it is enough to look one word further, as counts fall with length.

Scores are whole numbers of decimals with 38 digits; an input whose products pass these fails instead of rounding.

Defined cases: a null text has no words, a null language is `und`; rows that repeat count again; texts and words of any
length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import written
from ..operators.skew import attach

OFTEN = 100
LONGEST = 5
TOP = 2000
#: Bits of the table of frequent pairs: 16 MB.
BITS = 1 << 27
#: Entries of a container before it bursts, and of all containers of a task before subtrees are spilled.
BURST = 1 << 12
HELD = 1 << 19
#: Words whose ids a task remembers, and words that it looks at together.
KNOWN = 1 << 19
BLOCK = 1 << 16
#: Pairs that a task counts together.
PAIRS = 1 << 22
#: A pair with more than this share of all words is hot; there are fewer than this many.
HOT = 1000

#: Ends of pieces.
_END = re.compile(rb"[.,;:!?\n-\r]+")
_BREAK = b"."


class Node:
    """A hash container from the rest of a window to its count, or, once burst, a node with a child for each word."""

    __slots__ = ("table", "children")

    def __init__(self) -> None:
        self.table: dict[tuple[int, ...], int] = {}
        self.children: dict[int, Node] | None = None

    def add(self, key: tuple[int, ...], n: int) -> int:
        """Count `key` n more times; the entries that this adds."""
        node, d = self, 0
        while node.children is not None and d < len(key):
            child = node.children.get(key[d])
            if child is None:
                child = node.children[key[d]] = Node()
            node, d = child, d + 1
        rest = key[d:] if d else key
        before = node.table.get(rest)
        node.table[rest] = n if before is None else before + n
        if before is None and node.children is None and len(rest) > 1 and len(node.table) > BURST:
            node.burst()
        return before is None

    def burst(self) -> None:
        self.children, table, self.table = {}, self.table, {}
        for key, n in table.items():
            if key:
                self.children.setdefault(key[0], Node()).table[key[1:]] = n
            else:
                self.table[key] = n

    def entries(self, head: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], int]]:
        for key, n in self.table.items():
            yield head + key, n
        for word, child in (self.children or {}).items():
            yield from child.entries((*head, word))

    def size(self) -> int:
        return len(self.table) + sum(c.size() for c in (self.children or {}).values())


class Ids(dict):
    """Ids of words in the order they come; `new` is called with each new word."""

    def __init__(self, new) -> None:
        super().__init__()
        self.new = new

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        self.new(word)
        return found


class Trie:
    """Windows of one language: word ids with their hashes, and a shallow trie over them."""

    def __init__(self, lang: str) -> None:
        self.head = lang.encode() + b"\t"
        self.names: list[bytes] = []
        self.hashes = array("Q")
        self.ids = Ids(self._new)
        self.numbered([_BREAK])
        self.root = Node()

    def _new(self, word: bytes) -> None:
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(self.head + word, 42))

    def numbered(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.ids.__getitem__, words)), np.int64)

    def hashed(self, ids: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.hashes, np.uint64)[ids]

    def spilled(self, keep: int) -> Iterator[tuple[bytes, int, tuple[int, ...]]]:
        """Largest subtrees first, each as a sorted run of (window, count, ids), until at most `keep` entries are left."""
        names, root = self.names, self.root
        if root.children is None:
            if len(root.table) > keep:
                yield from sorted([(b" ".join([names[k] for k in key]) + b" ", n, key) for key, n in root.table.items()])
                root.table.clear()
            return
        sizes = sorted(((c.size(), w) for w, c in root.children.items()), reverse=True)
        left = sum(s for s, _ in sizes)
        for size, word in sizes:
            if left <= keep:
                return
            left -= size
            yield from sorted([(b" ".join([names[k] for k in key]) + b" ", n, key) for key, n in root.children.pop(word).entries((word,))])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs from hashes of their parts."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _pairs(trie: Trie, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the next, and whether no piece ends between them."""
    h = trie.hashed(ids)
    return _mixed(h[:-1], h[1:]), (ids[:-1] > 0) & (ids[1:] > 0)


def _windows(trie: Trie, ids: np.ndarray, bits: np.ndarray, high: int, starts: int) -> list[tuple[int, ...]]:
    """From each of the first `starts` words the longest window of up to `high` words whose pairs are all marked."""
    h, good = _pairs(trie, ids)
    at = (h & np.uint64(BITS - 1)).astype(np.int64)
    good &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    n = len(good)
    stop = np.minimum.accumulate(np.where(good, n, np.arange(n))[::-1])[::-1]  # the next pair that is not marked
    length = np.minimum(stop - np.arange(n) + 1, high)[:starts]
    at = np.flatnonzero(length > 1)
    words = ids.tolist()
    return [tuple(words[i : i + k]) for i, k in zip(at.tolist(), length[at].tolist(), strict=True)]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Language and words of each text, A-Z lowered, with a break between pieces."""
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        yield lang, _END.sub(b" . ", (text or b"").lower()).split()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text"))


def _word_counts(docs: DataFrame) -> DataFrame:
    """`lang`, `phrase` and `n` of all words; a task adds up its words in a table of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, words in found.items():
                words.pop(_BREAK, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64())],
                    names=["lang", "phrase", "n"])
            found.clear()

        for batch in batches:
            for lang, words in _texts(batch):
                for k in range(0, len(words), BLOCK):
                    found.setdefault(lang, Counter()).update(words[k : k + BLOCK])
                if sum(map(len, found.values())) > HELD:
                    yield from handed()
        yield from handed()

    return _rows(docs).mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _runs(docs: DataFrame, high: int, bits: Broadcast, hot: np.ndarray) -> DataFrame:
    """Sorted runs of windows: `lang`, `key` (a blank behind each word), `n`, `split` (hot) and `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}
        fresh: dict[str, Counter] = {}  # windows that are not in the trie yet
        held = 0

        def added(lang: str) -> int:
            add, new = tries[lang].root.add, fresh[lang]
            fresh[lang] = Counter()
            return sum([add(key, n) for key, n in new.items()])

        def handed(keep: int) -> Iterator[pa.RecordBatch]:
            for lang, trie in tries.items():
                spilled = trie.spilled(keep)
                while rows := list(islice(spilled, BLOCK)):
                    part = _mixed(*[trie.hashed(np.array([key[k] for _, _, key in rows])) for k in (0, 1)])
                    split = np.isin(part, hot)
                    for k in np.flatnonzero(split).tolist():
                        part[k] = xxhash.xxh64_intdigest(trie.head + rows[k][0], 7)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(rows), pa.string()), pa.array([x for x, _, _ in rows], pa.binary()).cast(pa.string()),
                         pa.array([n for _, n, _ in rows], pa.int64()), pa.array(split), pa.array(part.view(np.int64))],
                        names=["lang", "key", "n", "split", "part"])

        for batch in batches:
            for lang, words in _texts(batch):
                for k in range(0, len(words), BLOCK):
                    if lang not in tries:
                        tries[lang], fresh[lang] = Trie(lang), Counter()
                    ids = tries[lang].numbered(words[k : k + BLOCK + high - 1])
                    fresh[lang].update(_windows(tries[lang], ids, bits.value, high, BLOCK))
                    if len(fresh[lang]) > BLOCK:
                        held += added(lang)
                        if held > HELD:
                            yield from handed(HELD // 2 // len(tries))
                            held = sum(t.root.size() for t in tries.values())
                        if sum(len(t.ids) for t in tries.values()) > KNOWN:
                            for x in tries:
                                added(x)
                            yield from handed(0)
                            tries.clear()
                            held = 0
        for x in tries:
            added(x)
        yield from handed(0)

    return _rows(docs).mapInArrow(run, "lang string, key string, n bigint, split boolean, part bigint")


def _pair_counts(docs: DataFrame) -> DataFrame:
    """`pair` (hash) and `n` of all pairs of neighbouring words of a piece, per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}
        held: list[np.ndarray] = []

        def handed() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for lang, words in _texts(batch):
                for k in range(0, len(words), BLOCK):
                    if lang not in tries:
                        tries[lang] = Trie(lang)
                    h, inside = _pairs(tries[lang], tries[lang].numbered(words[k : k + BLOCK + 1]))
                    held.append(h[inside])
            if sum(map(len, held)) > PAIRS:
                yield handed()
            if sum(len(t.ids) for t in tries.values()) > KNOWN:
                tries.clear()
        yield handed()

    return _rows(docs).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _merge(batches: Iterator[pa.RecordBatch], floor: int) -> Iterator[pa.RecordBatch]:
    """Sums of all prefixes of two words or more, from rows sorted by language and window; sums of hot ones are partial."""
    out: list[tuple[str, str, int, int]] = []
    before: tuple = (None, None, None)
    words: list[str] = []
    sums: list[int] = []

    def close(down: int) -> None:
        """Sums of the prefixes with more than `down` words are complete."""
        split, lang, _ = before
        while len(words) > max(down, 1):
            n = sums.pop()
            if n >= floor or split:
                out.append((lang, " ".join(words), len(words), n))
            words.pop()

    def handed() -> pa.RecordBatch:
        kinds = {"lang": pa.string(), "phrase": pa.string(), "size": pa.int32(), "n": pa.int64()}
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))
        out.clear()
        return batch

    for batch in batches:
        for split, lang, key, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (split, lang, key) != before:
                new = key.split(" ")[:-1]
                same = 0
                if (split, lang) == before[:2]:
                    most = min(len(new), len(words))
                    while same < most and new[same] == words[same]:
                        same += 1
                close(same)
                del sums[max(same - 1, 0) :]
                words = new
                sums += [0] * (len(words) - 1 - len(sums))
                before = (split, lang, key)
            for k in range(len(sums)):
                sums[k] += n
        if len(out) > 1 << 16:
            yield handed()
    close(0)
    yield handed()


def counted(docs: DataFrame, high: int, floor: int, bits: Broadcast, hot: np.ndarray) -> DataFrame:
    """`lang`, `phrase`, `size` and `n` (`floor` at least) of all phrases of 2 to `high` words whose pairs are marked in
    `bits`; windows that begin with a pair among `hot` (hashes) are dealt whole."""
    runs = _runs(docs, high, bits, hot)
    runs = runs.repartition("part").sortWithinPartitions("split", "lang", "key").select("split", "lang", "key", "n")
    sums = runs.mapInArrow(lambda it: _merge(it, floor), "lang string, phrase string, size int, n bigint")
    if len(hot):
        sums = sums.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor)
    return written(sums)


def _bitmap(pairs: DataFrame) -> Broadcast:
    """The fixed-size table of the hashes `pair`, gathered in its 4,096 parts of 4 KB."""
    at = F.col("pair").bitwiseAND(F.lit(BITS - 1))
    parts = pairs.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("part"))
    bits = np.zeros(BITS >> 3, np.uint8)
    for row in parts.agg(F.expr("bitmap_construct_agg(at & 32767)").alias("bits")).collect():
        bits[row["part"] << 12 : (row["part"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    return pairs.sparkSession.sparkContext.broadcast(bits)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", often: int = OFTEN, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language by score: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    words = _word_counts(rows)
    words = written(words.select("lang", "phrase", F.lit(1).alias("size"), "n"))
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("total")))
    pairs = written(_pair_counts(rows).filter(F.col("n") >= often))
    limit = (totals.agg(F.sum("total")).first()[0] or 0) // HOT
    hot = np.array([r["pair"] for r in pairs.filter(F.col("n") > limit).collect()], np.int64).view(np.uint64)  # fewer than HOT
    phrases = counted(rows, longest, often, _bitmap(pairs), hot)
    return ranked(words.filter(F.col("n") >= often).unionAll(phrases), totals, top)


def ranked(known: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """Scores from `known` (lang, phrase, size, n; complete for the frequent phrases of any size) and `totals` (lang, total)."""
    parts = F.split("phrase", " ")
    candidates = known.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    inner = F.array(F.array_join(F.slice(parts, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(parts, F.lit(2), F.col("size") - 1), " "))
    longer = candidates.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    candidates = candidates.join(longer, ["lang", "phrase"], "left").filter("held IS NULL OR held < a").drop("held")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"),
    )
    count = lambda side, name: known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cuts = cuts.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    cuts = attach(cuts, totals, ["lang"], ["phrase"])
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumns({"over": wide("a") * wide("total") * F.lit(1000).cast("decimal(4,0)"), "under": wide("l") * wide("r")})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", F.col("total").alias("n"))).alias("x")).select("lang", "phrase", "x.*")
    order = "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)"
    best = best.withColumn("rank", F.expr(order).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
