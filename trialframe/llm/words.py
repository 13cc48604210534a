"""What several operators agree on: words, ASCII lower case, and carrying whole rows past helper columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """All words of a text, in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lower_words(text: str | None) -> list[bytes]:
    """The same words inside a Python task, with A-Z lowered: bytes.lower() and bytes.split() follow ASCII alone."""
    return text.encode().lower().split() if text else []


def packed(df: DataFrame, **cols: Column) -> DataFrame:
    """The whole row as one struct `doc` beside named helper columns, so that no name of the input can clash."""
    return df.select(F.struct("*").alias("doc"), *[c.alias(k) for k, c in cols.items()])


def unpacked(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `like` again, some of them replaced by an expression over the helper columns."""
    return df.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in like.columns])


def computed(df: DataFrame, *keep: str, **cols: Column) -> DataFrame:
    """Columns `keep` and `cols`, with the latter computed once: a generator stands between them and later steps.

    A filter on a computed column would otherwise be moved below it with the whole expression copied into it,
    and arrays that an expression looks up by index would be built anew for every element.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))
