"""Line deduplication by winnowing: later copies of long passages go, also where they stand inside a line.

A text is its sequence of pieces: a piece ends behind a run of marks or line ends and the blanks that follow, so
both places of a passage are cut alike, and the pieces joined are the text. Pieces are equal if they are without
the white space around them. A passage is a run of worded pieces with at least `min_words` words; it is a copy if
the same run stands earlier in the corpus (a smaller document key, or an earlier piece of the same document; null
ids come first). Pieces in a copy are deleted with the wordless ones between them; the first occurrence stays
whole. Of a passage that begins or ends inside a piece only the whole pieces count, which is why `min_words` is 40
where passages of 50 words are meant. What stands before and behind a deleted run inside a line is joined.

Winnowing: a window is the fewest pieces from one on that reach `min_words`, and its fingerprint a hash of them all, so
a fingerprint that stands elsewhere nearly always means a copy. Places are joined by fingerprint, and only the
places of shared ones go on. There a match is extended both ways around a piece: forward to the end of the window that
starts at it, backward to the start of the shortest window that ends at it, as long as the pieces agree. A piece of a
copied run lies in a copied window of one of the two kinds, so their union is exactly the set above; and a copied
window that ends at a piece holds one that starts at its first piece, so the fingerprints lose none.

Every occurrence is compared with the first one of its window only, never pair by pair. Aggregates are
combined before the shuffle; the lookups join tables read from storage, so AQE can split a window that a third
of the rows hold. Windows of a document are looked up in arrays, as a document is one row: the piece that holds the
n-th word ends the window that starts n - 1 words before. Windows are equal if two hashes of their pieces (96 bits) are.

Defined cases: rows that repeat both id and text are the same document and get the same result; a null or
empty text stays as it is; a text without marks and line ends is one piece; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import forgotten, written
from .words import WORD, computed, packed, unpacked

#: Words of a copy in whole pieces.
MIN_WORDS = 40
MARKS = r".!?,;:…।؟。！？，、；："
PIECE = rf"""[^\n{MARKS}]*[\n{MARKS}]+[\x20\x09-\x0D)"'”’»\]]*|[^\n{MARKS}]+"""
#: The same pieces for Java, which tests a class with wide characters one by one for every character of a text: those below
#: 256 have classes of their own, and nothing is tried twice.
_BODY = r"(?:[\x00-\x09\x0B-\x20\x22-\x2B\x2D\x2F-\x39\x3C-\x3E\x40-\xFF]++|[^\x00-\xFF…।؟。！？，、；：]++)"
_ENDS = r"""(?:[\n.!?,;:]++|[…।؟。！？，、；：]++)++(?:[\x20\x09-\x0D)"'»\]]++|[”’]++)*+"""
CUT = rf"{_BODY}++(?:{_ENDS})?+|{_ENDS}"
BLANKS = " \t\n\x0b\x0c\r"


def _key(doc_id: Column, text: Column) -> Column:
    return F.struct(doc_id.cast("long").alias("id"), F.xxhash64(text).alias("h"))


def pieces(text: Column) -> Column:
    """The pieces of a text; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def _n_words(piece: Column, plain: Column) -> Column:
    """Words of a piece without the white space around it; in a `plain` text these stand between single blanks mostly."""
    single = plain & ~F.contains(piece, F.lit("  ")) & ~F.contains(piece, F.lit("\n"))
    blanks = F.octet_length(piece) - F.octet_length(F.replace(piece, F.lit(" ")))
    return F.when(piece == "", 0).when(single, blanks + 1).otherwise(F.regexp_count(piece, F.lit(WORD)))


def _pieces(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """Every text that is not null: key, number of pieces, the worded ones with place, hash and words, and fingerprints."""
    plain = ~F.rlike(F.col(text), F.lit(r"[\x09\x0B-\x0D]"))
    stripped = F.transform(pieces(F.col(text)), lambda x: F.trim(x, F.lit(BLANKS)))
    rows = packed(docs.filter(F.col(text).isNotNull()), key=_key(F.col(doc_id), F.col(text)), plain=plain, stripped=stripped)
    piece = F.transform("stripped", lambda x, i: F.struct(
        _n_words(x, F.col("plain")).alias("words"), F.xxhash64(x).alias("h"), i.alias("at"),
    ))
    rows = computed(rows, "key", all=piece)
    rows = computed(rows, "key", n_pieces=F.size("all"), pieces=F.filter("all", lambda x: x["words"] > 0))
    ahead = lambda b, i: F.xxhash64(F.slice("h", i + 1, F.get("of", b + (min_words - 1)) - i + 1))
    prints = F.transform("begins", lambda b, i: F.when(b + min_words <= F.size("of"), ahead(b, i)))
    return _by_word(rows, "n_pieces", "pieces").select("key", "n_pieces", "pieces", F.array_compact(prints).alias("prints"))


def _by_word(rows: DataFrame, *keep: str) -> DataFrame:
    """Beside `pieces` their hashes `h`, the number of the piece `of` every word, and the first word of every piece, `begins`."""
    of = F.flatten(F.transform("pieces.words", lambda n, i: F.array_repeat(i, n)))
    first = F.flatten(F.transform("pieces.words", lambda n: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), n - 1))))
    begins = F.array_compact(F.transform(first, lambda x, i: F.when(x, i)))
    return computed(rows, "key", *keep, h=F.col("pieces.h"), of=of, begins=begins)


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """Forward and backward windows from the pieces numbered in `starts` (ascending): key, first and last piece, content."""
    rows = _by_word(rows, "pieces", "starts")
    gap = lambda x, i: x - F.coalesce(F.get("starts", i - 1), F.lit(-1)) - 1
    begun = F.flatten(F.transform("starts", lambda x, i: F.concat(F.array_repeat(F.lit(False), gap(x, i)), F.array(F.lit(True)))))
    rows = computed(rows, "key", "pieces", "h", "of", "begins", "starts", begun=begun)
    pair = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))  # noqa: E731  of numbers among worded pieces
    ahead = F.transform("starts", lambda i: pair(i, F.get("of", F.get("begins", i) + (min_words - 1))))
    first = lambda b, i: F.get("of", b + F.get("pieces", i)["words"] - min_words)
    behind = F.transform("begins", lambda b, i: F.when(F.get("begun", first(b, i)), pair(first(b, i), i)))
    rows = computed(rows, "key", "pieces", "h", pairs=F.array_distinct(F.array_compact(F.concat(ahead, behind))))
    begin, end = (lambda x: F.shiftright(x, 32).cast("int")), (lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))

    def window(x: Column) -> Column:
        own = F.slice("h", begin(x) + 1, end(x) - begin(x) + 1)
        return F.struct(
            F.get("pieces", begin(x))["at"].alias("from"), F.get("pieces", end(x))["at"].alias("to"),
            F.xxhash64(own, F.size(own)).alias("content"), F.hash(own).alias("more"),
        )

    return rows.select("key", F.inline(F.transform("pairs", window)))


def copied_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Disjoint runs of pieces to delete: key, `from`, `to` (numbers of pieces from 0, both included)."""
    rows = written(_pieces(docs, doc_id, text, min_words))
    runs = _runs(rows, min_words)
    forgotten(rows)
    return runs


def _runs(rows: DataFrame, min_words: int) -> DataFrame:
    """The same from the table of `_pieces`."""
    prints = rows.select("key", F.posexplode("prints").alias("i", "h"))
    places = prints.select("h", F.xxhash64("key", "i").alias("place")).groupBy("h")
    known = written(places.agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a < b").select("h"))
    matched = prints.join(known, "h").groupBy("key").agg(F.array_sort(F.collect_set("i")).alias("starts"))
    matched = written(matched)
    # Rows that repeat a document are one here.
    windows = written(_windows(rows.select("key", "pieces").join(matched, "key").dropDuplicates(["key"]), min_words))
    forgotten(known, matched)
    own = F.struct("key", "from")
    same = ["content", "more"]
    places = windows.groupBy(*same).agg(F.min(own).alias("first"), F.max(own).alias("last"))
    shared = written(places.filter("last > first").drop("last"))
    later = windows.join(shared, same).filter(own > F.col("first")).select("key", "from", "to")
    doc = Window.partitionBy("key").orderBy("from", "to")
    reach = F.max("to").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("new", F.when(F.col("from") <= reach, 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = written(marked.groupBy("key", "run").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("run"))
    forgotten(windows, shared)
    return runs


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every row as `doc`, with `clean_text` (without copied runs), `n_pieces` and `n_removed`."""
    rows = written(_pieces(docs, doc_id, text, min_words))
    runs = _runs(rows, min_words)
    run = F.struct(F.col("from").alias("a"), F.col("to").alias("b"))
    known = rows.select("key", "n_pieces", F.lit(None).alias("run")).unionAll(runs.select("key", F.lit(None), run))
    known = known.groupBy("key").agg(F.max("n_pieces").alias("n_pieces"), F.collect_list("run").alias("gone"))
    gone = written(known.select("key", "n_pieces", F.when(F.size("gone") > 0, F.array_sort("gone")).alias("gone")))
    forgotten(rows, runs)
    # The table grows with the corpus: the same join at every size, not a broadcast while it is small.
    df = packed(docs, key=_key(F.col(doc_id), F.col(text)), body=F.col(text)).join(gone.hint("merge"), "key", "left")
    # Texts that stay whole are not cut again.
    df = computed(df, "doc", "body", "n_pieces", "gone", parts=F.when(F.col("gone").isNotNull(), pieces(F.col("body"))))
    edges = F.concat(
        F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))), F.col("gone"),
        F.array(F.struct(F.size("parts").alias("a"), F.size("parts").alias("b"))),
    )
    df = df.withColumn("edges", edges)
    start = lambda i: F.get(F.col("edges"), i)["b"] + 2  # noqa: E731  position from 1 behind a deleted run
    stays = F.transform(F.slice("edges", F.lit(2), F.size("edges") - 1), lambda e, i: F.slice("parts", start(i), e["a"] + 1 - start(i)))
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda s, g: s + g["b"] - g["a"] + 1)
    stayed = F.array_join(F.flatten(stays), "")
    return computed(
        df, "doc", clean_text=F.when(F.col("gone").isNull(), F.col("body")).otherwise(stayed),
        n_pieces=F.coalesce("n_pieces", F.lit(0)).cast("long"), n_removed=F.coalesce(removed, F.lit(0).cast("long")),
    )


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents without later copies of passages; one left without any text goes. Columns as given."""
    df = deduplicated(docs, doc_id, text).filter((F.col("n_removed") == 0) | (F.trim("clean_text") != ""))
    changed = {text: F.col("clean_text")}
    if length in docs.columns:
        changed[length] = F.when(F.col("n_removed") == 0, F.col(f"doc.`{length}`")).otherwise(
            F.length("clean_text").cast(docs.schema[length].dataType))
    return unpacked(df, docs, **changed)
