"""Quality rules, line first: lines that fail a rule go, then documents that lost too much of their text.

Everything is one projection of built-in functions over the row: no shuffle, no Python. Words, lines and
five-word windows of a text are arrays of that row; repeated windows are found by hash, and sorted only in
texts that have some, so a text costs n log n at worst.

Defined cases: a null text has no words and is rejected; an empty line never fails; rows are judged one by
one, so repeated rows get the same verdict twice and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import WORD, computed, packed, unpacked, words

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
#: A document is rejected if its failing lines hold more than this share of its word characters.
MAX_LOST_PERCENT = 50
#: Lines this short may be taken for navigation or boilerplate by one phrase.
SHORT_LINE = 25
#: A line with at least so many words and no sentence end at its close is no prose.
OPEN_LINE = 12

SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›•·]"
ENDING = r"[.!?…:;。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
#: The same with the danda and the Arabic and Urdu marks.
ANY_ENDING = ENDING.replace("[.!?", "[.!?।॥؟۔", 1)
#: Texts whose longest line has at most so many characters may be hard-wrapped.
WRAP = 120
# Fixed phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "back to top", "click here", "cookie policy", "enable javascript",
    "javascript is disabled", "licensed under", "lorem ipsum", "privacy policy", "released under", "share this",
    "sign up for", "skip to content", "subscribe to", "terms of service", "terms of use",
)


def _line(line: Column) -> Column:
    """What the rules look at in one line."""
    return F.struct(
        line.alias("text"),
        F.regexp_count(line, F.lit(WORD)).alias("words"),
        F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", "")).alias("chars"),
    )


def _continued(x: Column, after: Column, longest: Column) -> Column:
    """Whether the line `after` a line struct goes on with its sentence: it starts small, or its first word had no room."""
    head = F.regexp_extract(after["text"], WORD, 0)
    full = (longest <= WRAP) & (F.length(x["text"]) + 1 + F.length(head) > longest)
    return F.coalesce((after["words"] > 0) & (head.rlike(r"^[\"'“‘(]*[\p{Ll}\p{Lo}]") | full), F.lit(False))


def _fails(x: Column, goes_on: Column | None = None) -> Column:
    """Punctuation, navigation and boilerplate rules for a line struct; a line without a word passes."""
    text, n = x["text"], x["words"]
    symbols = F.regexp_count(text, F.lit(SYMBOLS)) * 2 > n
    shouting = F.regexp_count(text, F.lit("!")) > n
    open_end = (n >= OPEN_LINE) & ~text.rlike(ENDING if goes_on is None else ANY_ENDING)
    if goes_on is not None:
        open_end = open_end & ~goes_on
    separators = F.regexp_count(text, F.lit(SEPARATORS))
    navigation = (separators >= 2) & (separators * 4 >= n)
    boilerplate = (n <= SHORT_LINE) & F.lower(text).rlike("|".join(BOILERPLATE))
    return (n > 0) & (open_end | symbols | shouting | navigation | boilerplate)


def _repeated_words(df: DataFrame) -> DataFrame:
    """Add `n_repeat_words` to a table with the array `found`: words in windows that occur twice or more."""
    hashes = F.transform("found", lambda w: F.xxhash64(w))
    df = df.withColumn("hashes", hashes)
    heads = F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0)))
    window = lambda x, i: F.xxhash64(x, *[F.get(F.col("hashes"), i + k) for k in range(1, WINDOW)])
    df = df.withColumn("windows", F.transform(heads, window))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")).otherwise(none))
    ordered = F.array_sort(F.transform("windows", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("ordered", ordered)
    same = lambda s, j: F.coalesce(F.get(F.col("ordered"), j)["g"] == s["g"], F.lit(False))
    starts = F.filter("ordered", lambda s, j: ((j > 0) & same(s, F.greatest(j - 1, F.lit(0)))) | same(s, j + 1))
    df = df.withColumn("starts", F.array_sort(F.transform(starts, lambda s: s["i"])))
    step = F.transform("starts", lambda p, j: F.least(F.coalesce(F.get(F.col("starts"), j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return df.withColumn("n_repeat_words", F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x))


def judged(docs: DataFrame, text: str = "text", wrapped: bool = False) -> DataFrame:
    """Each row packed as `doc`, beside its figures, `base_failed`, `kept` and the text without failing lines.

    `clean_text` is null for a null text; where no line fails it is the text itself.
    With `wrapped`, an open end counts only where the next line does not continue the sentence, and ANY_ENDING closes one.
    """
    df = packed(docs, body=F.coalesce(F.col(text), F.lit("")), absent=F.col(text).isNull())
    df = df.withColumn("found", words(F.col("body")))
    df = _repeated_words(df)
    lines = F.transform(F.split("body", "\n"), _line)
    if wrapped:
        df = computed(df, "doc", "body", "absent", "found", "n_repeat_words", lines=lines)
        longest = F.array_max(F.transform("lines", lambda x: F.length(x["text"])))
        df = computed(df, "doc", "body", "absent", "found", "n_repeat_words", "lines", longest=longest)
        fails = F.transform("lines", lambda x, i: _fails(x, _continued(x, F.get(F.col("lines"), i + 1), F.col("longest"))))
    else:
        df = df.withColumn("lines", lines)
        fails = F.transform("lines", lambda x: _fails(x))
    df = df.withColumn("fails", fails)
    worded = F.transform(F.filter("lines", lambda x: x["words"] > 0), lambda x: x["text"])
    df = df.withColumn("worded", worded)
    count = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    n_words = F.size("found").cast("long")
    word_chars = count(F.transform("lines", lambda x: x["chars"]))
    lost = count(F.transform("lines", lambda x, i: F.when(F.get(F.col("fails"), i), x["chars"]).otherwise(0)))
    passing = F.filter("lines", lambda x, i: ~F.get(F.col("fails"), i))
    clean = F.when(F.exists("fails", lambda f: f), F.array_join(F.transform(passing, lambda x: x["text"]), "\n")).otherwise(F.col("body"))
    df = computed(
        df, "doc", n_words=n_words, word_chars=word_chars,
        n_symbols=F.regexp_count("body", F.lit(SYMBOLS)).cast("long"),
        n_dup_lines=(F.size("worded") - F.size(F.array_distinct("worded"))).cast("long"),
        n_repeat_words=F.col("n_repeat_words"), lost_chars=lost, clean_text=F.when(~F.col("absent"), clean),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    much = F.col("lost_chars") * 100 > F.col("word_chars") * MAX_LOST_PERCENT
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~much)


def cleaned(docs: DataFrame, text: str = "text", length: str = "n_chars", wrapped: bool = True) -> DataFrame:
    """The kept documents with their failing lines removed and their length counted anew; columns as given."""
    df = judged(docs, text, wrapped).filter("kept")
    changed = {text: F.col("clean_text")}
    if length in docs.columns:
        changed[length] = F.length("clean_text").cast(docs.schema[length].dataType)
    return unpacked(df, docs, **changed)
