"""Token ids in binary files with a minimal perfect hash index: any document by its key in constant time.

A folder holds, for documents in ascending order of their key:

* `ids-<shard>.bin`: the ids of all documents of a shard, one after the other, raw and little-endian, two or four
  bytes each; nothing else.
* `ends-<shard>.bin`: the number of ids up to the end of each document of the shard (64 bits each).
* `index-<bucket>.mph`: keys whose hash falls into the bucket. A minimal perfect hash gives each key a slot without
  storing the key: on each level every key that is still open names a bit of an array, bits named by one key are
  set, the other keys go on to the next level; the slot is the rank of the bit. A slot holds a fingerprint of
  32 bits and the runs (shard, first document, documents) of the key: one, or more where rows repeat a key.
* `shards.parquet`: documents and ids per shard, and the ids before it.
* `format.json`: version, width of an id, number of buckets and of index files.

Texts are dealt by range of (key, hash of the text), so shards follow the order; a key that repeats is dealt further by
row, so it never meets in one task. Files are written under a name of the attempt and renamed, so a repeated or
speculative task leaves one whole file with the same bytes. Folders are any that pyarrow can write to by a URI.

Encoding: a piece of the tokenizer always begins at a blank before a character that is not white space, at white space
or a mark behind a letter, and behind a single line end; texts are cut there, and a unit that a task has met is not
encoded again; new words, each one piece, go to the library's model without its cutting of texts. The cache has two
halves of fixed size, the units met lately and those before.

Defined cases: a null text is empty and has the end id alone; rows with a null key are stored before all others and
found by a null key; rows that repeat a key are all found by it, in the order of the texts' hashes; a key that is not there gives no
row, or, once in 2^32 such keys, a false one that the fingerprint does not catch; an empty table gives an empty folder.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = 2
#: Bytes of text (and a few for each document) in a shard, and keys in a bucket of the index.
SHARD = 1 << 25
BUCKET = 1 << 17
#: Documents of a shard that stand no further apart are read at once, in blocks of this size.
GAP = 1 << 16
READ = 1 << 23
#: Bits of a level for each open key.
ROOM = 2
#: Texts encoded at once; their units should fit a processor's cache.
BLOCK = 64
#: Units whose ids a worker remembers, and as many again that it met before those.
CACHE = 1 << 19
MAGIC = b"MPHINDEX1"
#: A word with the blank before it, if a mark, white space or the end follows; else all up to where a piece must begin.
_UNIT = re.compile(r""" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[ \n.,;:!?()'"-]|\Z)|.+?(?= \S|(?<=\S\n)(?=\S)|\Z)""", re.S)

_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Fixed values of byte-level vocabularies: printable bytes stand for themselves, the others for the code points from 256 on.
_PRINTED = frozenset((*range(33, 127), *range(161, 173), *range(174, 256)))
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _at(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder.replace("file:///", "file:/").replace("file:/", "file:///"))
    return pafs.LocalFileSystem(), folder


def _put(folder: str, name: str, parts: Iterable[bytes]) -> None:
    """A whole file under its name, or none."""
    fs, path = _at(folder)
    attempt = f"{path}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as f:
        for part in parts:
            f.write(part)
    try:
        fs.move(attempt, f"{path}/{name}")
    except OSError:  # where a store does not replace files, another attempt has put the same bytes
        if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
            raise
        fs.delete_file(attempt)


def _get(folder: str, name: str) -> bytes:
    fs, path = _at(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return f.read()


class Units:
    """Ids of texts by the tokenizers library, each unit of a text encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the cache before it was full; what is met again moves on
        parts = json.loads(self.tokenizer.to_str())
        cut = parts["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.whole_words = bool(plain and parts["normalizer"] is None)  # a word is one piece, and goes to the model as it is

    def _raw(self, ids: list[int]) -> bytes:
        return array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()

    def _coded(self, new: set[str]) -> dict[str, bytes]:
        words = [x for x in new if _WORD.fullmatch(x)] if self.whole_words else []
        tokens, blank = self.tokenizer.model.tokenize, chr(_SHOWN[32])
        shown = (x.replace(" ", blank) if x.isascii() else x.encode().decode("latin-1").translate(_SHOWN) for x in words)
        coded = {x: self._raw([y.id for y in tokens(y)]) for x, y in zip(words, shown, strict=True)}
        rest = list(new.difference(words))
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            for unit, x in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                coded[unit] = self._raw(x.ids)
        return coded

    def encode(self, texts: list[str]) -> list[bytes]:
        """The raw ids of each text."""
        split = list(map(_UNIT.findall, texts))
        flat = list(chain.from_iterable(split))
        found = list(map(self.cache.get, flat))
        at = [k for k, ids in enumerate(found) if ids is None]
        if at:
            new = set(map(flat.__getitem__, at))
            if len(self.cache) + len(new) > CACHE:
                self.older, self.cache = self.cache, {}
            coded = {x: self.older[x] for x in new if x in self.older}
            coded |= self._coded(new.difference(coded))
            self.cache |= coded
            for k in at:
                found[k] = coded[flat[k]]
        parts = iter(found)
        return [b"".join(islice(parts, len(units))) for units in split]


@lru_cache(maxsize=2)
def units(path: str) -> Units:
    return Units(path)


def _text_key(key: Column) -> Column:
    """A key as bytes of its decimal or text form; a null key is unlike all others."""
    return F.when(key.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), key.cast("string")))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int | None = END) -> None:
    """Encode all texts and write them in ascending order of their key, with the index."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()
    shards, buckets = max(math.ceil(size / SHARD), 1), max(math.ceil(total / BUCKET), 1)
    fs, path = _at(folder)
    fs.create_dir(path, recursive=True)
    kind = units(tokenizer).kind
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = rows.select(_text_key(F.col("key")).alias("name"), "text", *[c.alias(f"o{k}") for k, c in enumerate(order[1:], 1)], F.col("key").alias("o0"))
    order = [F.col("o0").asc_nulls_first(), "o1", "o2"]
    dealt = dealt.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().alias("shard"), "name", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = units(tokenizer)
        last = b"" if end is None else np.array([end], encoder.kind).tobytes()
        ends: list[int] = []
        runs: list[list] = []  # name, first document, documents
        shard = None

        def bodies() -> Iterator[bytes]:
            nonlocal shard
            total = 0
            for batch in batches:
                if batch.num_rows:
                    shard = batch.column(0)[0].as_py()
                for k in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(k, BLOCK)
                    coded = encoder.encode(part.column(2).to_pylist())
                    for name, x in zip(part.column(1).to_pylist(), coded, strict=True):
                        if not runs or runs[-1][0] != name:
                            runs.append([name, len(ends), 0])
                        runs[-1][2] += 1
                        total += (len(x) + len(last)) // encoder.kind.itemsize
                        ends.append(total)
                        yield x + last

        first = bodies()
        head = next(first, None)
        if head is None:
            return
        _put(folder, f"ids-{shard:08d}.bin", (x for part in ([head], first) for x in part))
        _put(folder, f"ends-{shard:08d}.bin", [np.array(ends, "<i8").tobytes()])
        for k in range(0, len(runs), 1 << 16):
            part = runs[k : k + (1 << 16)]
            ids = [0] * len(part)
            ids[0] = 0 if k else ends[-1]  # the shard's ids are told once
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.string()), pa.array([shard] * len(part), pa.int64()), pa.array([r[1] for r in part], pa.int64()),
                 pa.array([r[2] for r in part], pa.int64()), pa.array(ids, pa.int64())],
                names=["name", "shard", "first", "docs", "ids"])

    runs = dealt.mapInArrow(run, "name string, shard bigint, first bigint, docs bigint, ids bigint")
    runs.write.mode("overwrite").parquet(f"{folder}/runs.parquet")
    runs = spark.read.parquet(f"{folder}/runs.parquet")
    sums = runs.groupBy("shard").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"))
    before = F.expr("sum(ids) OVER (ORDER BY shard) - ids")  # one row per shard of 32 M characters
    sums.select("shard", "docs", "ids", before.alias("before")).write.mode("overwrite").parquet(f"{folder}/shards.parquet")
    keyed = runs.select(_bucket(F.col("name"), buckets).alias("bucket"), "name", "shard", "first", "docs")
    keyed = keyed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "name", "shard")
    made = keyed.mapInArrow(lambda it: _index(it, folder), "bucket int").count()
    about = {"version": 1, "width": kind.itemsize, "buckets": buckets, "index_files": made}
    _put(folder, "format.json", [json.dumps(about).encode()])


def _hashed(names: Iterable[str]) -> np.ndarray:
    """128 bits of each name as two rows of 64."""
    raw = b"".join([xxhash.xxh3_128_digest(x) for x in names])
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2).T


def _named(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bit that each key names on a level: its hash moved on by an odd step, then mixed."""
    x = h[0] + np.uint64(level) * (h[1] | np.uint64(1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(11)) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys: bit arrays of several levels and the number of set bits before each."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits
        self.ranks, total = [], 0
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(total + np.cumsum(counts) - counts)  # of set bits before each byte
            total += int(counts.sum())

    @classmethod
    def of(cls, h: np.ndarray) -> PerfectHash:
        levels, level = [], 0
        while h.shape[1]:
            size = -(-max(ROOM * h.shape[1], 64) // 8) * 8
            at = _named(h, level, size)
            single = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(single, bitorder="little"))
            h = h[:, ~single[at]]
            level += 1
        return cls(levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that is not there -1 or any slot."""
        out = np.full(h.shape[1], -1, np.int64)
        rest = np.arange(h.shape[1])
        for level, bits in enumerate(self.levels):
            at = _named(h[:, rest], level, len(bits) * 8)
            byte = bits[at >> 3]
            hit = (byte >> (at & 7).astype(np.uint8)) & 1 > 0
            below = np.bitwise_count(byte & ((1 << (at & 7)) - 1).astype(np.uint8))
            out[rest[hit]] = (self.ranks[level][at >> 3] + below)[hit]
            rest = rest[~hit]
        return out


def _index(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write the index file of each bucket of a partition, which is sorted by bucket and name."""
    held: list[pa.RecordBatch] = []

    def put() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        bucket = rows["bucket"][0].as_py()
        names = rows["name"].to_pylist()
        start = np.flatnonzero([True, *[a != b for a, b in zip(names, names[1:], strict=False)]])
        h = _hashed([names[k] for k in start.tolist()])
        found = PerfectHash.of(h)
        slot = found.slots(h)
        order = np.argsort(slot)
        count = np.diff(np.append(start, len(names)))[order]
        run = np.repeat(start[order] - np.cumsum(count) + count, count) + np.arange(len(names))
        prints = (h[1] >> np.uint64(32)).astype("<u4")[order]
        ends = np.cumsum(count).astype("<u4")
        columns = [rows[c].to_numpy()[run].astype("<i8") for c in ("shard", "first", "docs")]
        head = json.dumps({"keys": len(start), "runs": len(names), "levels": [len(x) for x in found.levels]}).encode()
        _put(folder, f"index-{bucket:08d}.mph", [MAGIC, len(head).to_bytes(4, "little"), head, *[x.tobytes() for x in (*found.levels, prints, ends, *columns)]])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32())], names=["bucket"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            ids = batch.column(0).to_numpy()
            end = int(np.searchsorted(ids, ids[at], side="right"))
            if held and held[0].column(0)[0].as_py() != ids[at]:
                yield put()
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield put()


class Index:
    """One bucket: the runs of a key by its slot."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not an index file")
        size = int.from_bytes(raw[len(MAGIC) : len(MAGIC) + 4], "little")
        at = len(MAGIC) + 4 + size
        head = json.loads(raw[len(MAGIC) + 4 : at])

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, kind, n, at)
            at += x.nbytes
            return x

        self.hash = PerfectHash([take("u1", n) for n in head["levels"]])
        self.prints, self.ends = take("<u4", head["keys"]), take("<u4", head["keys"])
        self.runs = [take("<i8", head["runs"]) for _ in range(3)]  # shard, first document, documents

    def find(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each run found: which of the names, and its shard, first document and documents."""
        h = _hashed(names)
        slot = self.hash.slots(h)
        which = np.flatnonzero(slot >= 0)
        which = which[self.prints[slot[which]] == (h[1, which] >> np.uint64(32)).astype(np.uint32)]
        slot = slot[which]
        end = self.ends[slot].astype(np.int64)
        start = np.where(slot > 0, self.ends[np.maximum(slot - 1, 0)], 0).astype(np.int64)
        count = end - start
        run = np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        return np.repeat(which, count), np.stack([x[run] for x in self.runs])


def about(folder: str) -> dict:
    return json.loads(_get(folder, "format.json"))


def addresses(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """`key`, `shard`, `first` and `docs` of each run of the distinct `keys` that are there; one index file per bucket."""
    known = about(folder)
    typed = keys.select(F.col(key).alias("key")).distinct().withColumn("name", _text_key(F.col("key")))
    rows = typed.withColumn("bucket", _bucket(F.col("name"), known["buckets"])).repartition("bucket").sortWithinPartitions("bucket")
    kind = typed.schema["key"].dataType.simpleString()
    there = {int(x.base_name[6:-4]) for x in _files(folder) if x.base_name.startswith("index-")} if known["index_files"] < known["buckets"] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, own = None, None
        for batch in batches:
            buckets = batch.column(2).to_numpy()
            for bucket in np.unique(buckets).tolist():
                if there is not None and bucket not in there:
                    continue
                if own != bucket:
                    index, own = Index(_get(folder, f"index-{bucket:08d}.mph")), bucket
                rows = np.flatnonzero(buckets == bucket)
                which, (shard, first, docs) = index.find(batch.column(1).take(pa.array(rows)).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[which])), pa.array(shard), pa.array(first), pa.array(docs)], names=["key", "shard", "first", "docs"])

    return rows.mapInArrow(run, f"key {kind}, shard bigint, first bigint, docs bigint")


def _files(folder: str) -> list[pafs.FileInfo]:
    fs, path = _at(folder)
    return fs.get_file_info(pafs.FileSelector(path))


def _documents(found: DataFrame, folder: str, columns: dict[str, str], make) -> DataFrame:
    """`make(ids)` for every document of the runs `found`; each task reads the files of its shards once, by ranges."""
    width = about(folder)["width"]
    kind = found.schema["key"].dataType.simpleString()
    rows = found.repartition("shard", F.shiftright("first", 16)).sortWithinPartitions("shard", "first")
    schema = f"key {kind}, shard bigint, offset bigint, n_tokens bigint" + "".join(f", {k} {v}" for k, v in columns.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ends = None, None
        for batch in batches:
            spans: list[tuple[int, int, int]] = []  # row of the batch, first and last id
            for k, (shard, first, docs) in enumerate(zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)], strict=True)):
                if own != shard:
                    yield from read(batch, own, spans)
                    own, ends, spans = shard, np.frombuffer(_get(folder, f"ends-{shard:08d}.bin"), "<i8"), []
                cuts = [int(ends[first - 1]) if first else 0, *ends[first : first + docs].tolist()]
                spans += [(k, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield from read(batch, own, spans)

    def read(batch: pa.RecordBatch, shard: int | None, spans: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        if not spans:
            return
        fs, path = _at(folder)
        with fs.open_input_file(f"{path}/ids-{shard:08d}.bin") as file:
            at = 0
            while at < len(spans):
                low, high, end = spans[at][1], spans[at][2], at + 1
                while end < len(spans) and 0 <= spans[end][1] - high <= GAP and spans[end][2] - low <= READ:
                    high, end = spans[end][2], end + 1
                raw = np.frombuffer(file.read_at((high - low) * width, low * width), f"<u{width}")
                out = [(shard, a, b - a, *make(raw[a - low : b - low])) for _, a, b in spans[at:end]]
                yield _batch(batch, [k for k, _, _ in spans[at:end]], out, schema)
                at = end

    return rows.mapInArrow(run, schema)


def _batch(batch: pa.RecordBatch, at: list[int], out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    fields = [x.split(" ") for x in schema.split(", ")[1:]]
    arrays = [pa.array([r[k] for r in out], kinds[f[1]]) for k, f in enumerate(fields)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=["key", *[f[0] for f in fields]])


def lookup(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """`key`, `shard`, `offset` (ids of the shard before it), `n_tokens` and `ids` of every document of the keys."""
    return _documents(addresses(keys, folder, key), folder, {"ids": "array<bigint>"}, lambda raw: (raw.tolist(),))


def digests(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """`key`, `start` (ids of all documents before it), `n_tokens` and `ids_crc32` of every document of the keys."""
    found = _documents(addresses(keys, folder, key), folder, {"ids_crc32": "bigint"}, lambda raw: (zlib.crc32(raw.astype("<u4").tobytes()),))
    before = keys.sparkSession.read.parquet(f"{folder}/shards.parquet").select("shard", "before")
    return found.join(before, "shard").select("key", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def target(spark: SparkSession) -> str:
    """A new folder beside the settled tables."""
    from ..operators.lineage import folder

    return f"{folder(spark)}/tokens-{uuid.uuid4().hex}"
