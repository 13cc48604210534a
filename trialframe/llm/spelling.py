"""Spelling variants: words one edit apart, each led to the more frequent spelling.

1.  Words are runs of letters (A-Z lowered) of at least `LEAST` code points with `OFTEN` occurrences. Every task counts
    its texts in a table of bounded size, so that sums of words travel, not occurrences. One spelling in `SLIP` per
    document loses a letter, by a checksum of document and word (typing slips with a known answer).
2.  Words that are one edit apart agree in the first or in the last half, as the edit stands in one of the halves:
    each word goes to the group of its first and of its last half, once for its own length and once as the longer of
    a pair. A group above `GROUP` words is cut again by the halves of what is still open, until one letter is; such
    a group is bounded by the alphabet. A pair belongs to the first group that holds it, so it is found once.
3.  A group is a sorted list. Every word scans the words behind it with an edit matrix of three diagonals. A row belongs
    to a prefix: the rows of the prefix that a word shares with the one before (the longest common prefix of
    neighbours) are kept, only the rest is computed. Once all three cells exceed one edit, the scan leaps to the next
    word that does not share this prefix.
4.  A word's form is its most frequent near word, if that is `FACTOR` times as frequent. Roots follow the forms by
    doubling steps; frequencies grow by the factor with each form, so the rounds are few.

Defined cases: a null text has no words; a null id is written as nothing in the checksum; rows that repeat count
again; words of any length are compared whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import written

#: Code points and occurrences that a word needs.
LEAST = 6
OFTEN = 5
#: A form is this many times as frequent as the word.
FACTOR = 5
#: One (document, run) in so many loses a letter.
SLIP = 199
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 19
#: Words of a group that one scan may hold, but for groups with a single open letter.
GROUP = 1 << 11

_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slip: int = SLIP) -> DataFrame:
    """`word` and `n` (occurrences) of all words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            rows = [(w, n) for w, n in total.items() if n and len(w) >= LEAST]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = _RUN.findall((t.as_py() or "").encode().lower().decode())
                total.update(runs)
                own, start = None, zlib.crc32(f"{'' if i is None else i}:".encode())
                for w in set(runs):
                    h = zlib.crc32(w.encode(), start)
                    if h % slip == 0:
                        own = own or Counter(runs)
                        at = h % len(w)
                        total[w] -= own[w]
                        total[w[:at] + w[at + 1 :]] += own[w]
                if len(total) > HELD:
                    yield handed()
        yield handed()

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= OFTEN)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in its two next groups: the open middle of `m - p - q` letters (one more in longer words) is halved."""
    p, q, t = F.col("p"), F.col("q"), F.floor((F.col("m") - F.col("p") - F.col("q")) / 2).cast("int")
    rest = F.col("m") - p - q - t
    rows = rows.select("word", "n", "m", F.inline(F.array(
        F.struct((p + t).alias("p"), q.alias("q"), F.concat("path", F.lit("F")).alias("path")),
        F.struct(p.alias("p"), (q + rest).alias("q"), F.concat("path", F.lit("B")).alias("path")),
    )))
    ends = [F.substring(F.col("word"), F.lit(1), F.col("p")), F.substring(F.col("word"), F.length("word") - F.col("q") + 1, F.col("q"))]
    return rows.withColumn("key", F.xxhash64("m", "path", *ends))


def _groups(words: DataFrame) -> Iterator[DataFrame]:
    """Rows (word, n, m, p, q, path, key) of all groups that one scan may hold."""
    length = F.length("word")
    own = F.array(*[F.struct(length.alias("m")), F.struct((length - 1).alias("m"))])
    rows = words.select("word", "n", F.inline(own)).filter(F.col("m") >= LEAST)
    rows = rows.withColumns({"p": F.lit(0), "q": F.lit(0), "path": F.lit("")})
    while True:
        rows = written(_halves(rows))
        large = rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("m") - F.col("p") - F.col("q")).alias("open"))
        large = written(large.filter((F.col("size") > GROUP) & (F.col("open") > 1)).select("key"))
        if large.isEmpty():
            yield rows
            return
        yield rows.join(large, "key", "left_anti")
        rows = rows.join(large, "key", "left_semi")


def neighbours(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j), i < j, of the sorted distinct texts that are exactly one edit apart."""
    n = len(texts)
    shared = [0] * n
    for k in range(1, n):
        a, b = texts[k - 1], texts[k]
        d, most = 0, min(len(a), len(b))
        while d < most and a[d] == b[d]:
            d += 1
        shared[k] = d
    leap = [n] * n  # the next text that shares less with the one before it
    for k in range(n - 2, -1, -1):
        j = k + 1
        while j < n and shared[j] >= shared[k]:
            j = leap[j]
        leap[k] = j
    longest = max(map(len, texts), default=0)
    own = [(9, 0, 1)] + [(1, 0, 1)] * longest  # rows of a text against itself: cells left of, on and right of the diagonal
    for i in range(n - 1):
        asked = texts[i] + "\0\0\0"
        size = len(texts[i])
        rows = own[: shared[i + 1] + 1]
        j = i + 1
        while j < n:
            text = texts[j]
            del rows[shared[j] + 1 :]
            x, y, z = rows[-1]
            d, end = len(rows) - 1, len(text)
            while d < end:
                c = text[d]
                d += 1
                a, b = x + (c != asked[d - 2]), y + 1
                x = a if a < b else b
                a, b = y + (c != asked[d - 1]), (z if z < x else x) + 1
                y = a if a < b else b
                a, b = z + (c != asked[d]), y + 1
                z = a if a < b else b
                if x > 1 and y > 1 and z > 1:
                    break
                rows.append((x, y, z))
            else:
                if -1 <= size - end <= 1 and rows[end][size - end + 1] == 1:
                    yield i, j
                j += 1
                continue
            j += 1
            while j < n and shared[j] >= d:
                j = leap[j]


def _first(a: str, b: str, m: int, path: str) -> bool:
    """Whether the group of this path is the first that holds the pair: halves agree where it says so, and there alone."""
    p = q = 0
    for step in path:
        t = (m - p - q) // 2
        if (a[p : p + t] == b[p : p + t]) != (step == "F"):
            return False
        if step == "F":
            p += t
        else:
            q = m - p - t
    return True


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of all near pairs of the groups of a partition, which is sorted by group and text."""
    out: list[tuple[str, str, int]] = []

    def handed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "other", "n"])
        out.clear()
        return batch

    def search(group: list[tuple]) -> None:
        _, _, _, m, path = group[0]
        for i, j in neighbours([r[1] for r in group]):
            a, b = group[i][1], group[j][1]
            if path[-1] == "B":
                a, b = a[::-1], b[::-1]
            if min(len(a), len(b)) == m and _first(a, b, m, path):
                out.append((a, b, group[j][2]))
                out.append((b, a, group[i][2]))

    group: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if group and (row[0], row[3], row[4]) != (group[0][0], group[0][3], group[0][4]):
                if len(group) > 1:
                    search(group)
                group = []
            group.append(row)
        if len(out) > 1 << 16:
            yield handed()
    if len(group) > 1:
        search(group)
    yield handed()


def near(words: DataFrame) -> DataFrame:
    """(`word`, `other`, `n` of the other) for all pairs of `words` (word, n; distinct) one edit apart, both ways."""
    found = None
    for rows in _groups(words):
        text = F.when(F.col("path").endswith("B"), F.reverse("word")).otherwise(F.col("word"))
        rows = rows.select("key", text.alias("text"), "n", "m", "path")
        part = rows.repartition("key").sortWithinPartitions("key", "m", "path", "text").mapInArrow(_scan, "word string, other string, n bigint")
        found = part if found is None else found.unionAll(part)
    return found


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near` and `form_n` of every one of the `words` (word, n; distinct)."""
    best = F.min(F.struct((-F.col("n")).alias("n"), "other"))  # the largest n, of these the smallest word
    about = near(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(about, "word", "left")
    formed = -F.col("best.n") >= F.col("n") * factor
    rows = written(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.other")).alias("form"),
        F.when(formed, -F.col("best.n")).alias("form_n"),
    ))
    step = written(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            break
        step = step.drop("moved")
    rows = rows.join(step.select("word", "root"), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The variants of all words of the texts."""
    return variants(written(counts(docs, doc_id, text)))
