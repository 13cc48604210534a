"""Chat formatting: sorted turn structs of a conversation become one text with marked turns and a loss mask.

    <turn>ROLE
    TEXT<part>TEXT</turn>

Adjacent turns of one role share a block; `<part>` keeps their texts apart. Control strings inside a role or
text are escaped, so splitting the output at the markers gives the turns back exactly. The mask is carried by
`segments`: pieces of the formatted text in order, each with the flag whether it is trained on (the texts of
the assistant, without markers).

Defined cases: a null role or text is empty; a null turn number comes first; rows of equal turn number are
ordered by role, then text, and all of them stay; rows without conversation id form one conversation. A
conversation is one output row and must fit one, as a document must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import computed

OPEN, PART, CLOSE = "<turn>", "<part>", "</turn>\n"
CONTROL = ("<turn>", "<part>", "</turn>")
TRAINED = "assistant"


def escape(c: Column) -> Column:
    """Double every backslash, then break up control strings: '<' of such a string becomes backslash, l."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROL:
        c = F.replace(c, F.lit(x), F.lit("\\l" + x[1:]))
    return c


def unescape(c: Column) -> Column:
    """Undo `escape`; doubled backslashes are told apart first, from left to right."""
    return F.array_join(F.transform(F.split(c, r"\\\\"), lambda p: F.replace(p, F.lit("\\l"), F.lit("<"))), "\\")


def escape_role(c: Column) -> Column:
    """A role ends at the line end, so its own line ends are escaped, too."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    parts = F.transform(
        F.split(c, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    )
    return F.array_join(parts, "\\")


def format_conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: key, `formatted`, `segments` (text, trained)."""
    empty = F.lit("")
    picked = rows.select(
        F.col(key).alias("key"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"),
    )
    turns = picked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    indexed = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), i.alias("i")))
    heads = F.filter(indexed, lambda x: (x["i"] == 0) | (F.get(F.col("turns"), F.greatest(x["i"] - 1, F.lit(0)))["role"] != x["role"]))
    df = turns.withColumn("heads", heads)
    end = lambda j: F.coalesce(F.get(F.col("heads"), j + 1)["i"], F.size("turns"))
    blocks = F.transform("heads", lambda h, j: F.struct(
        h["role"].alias("role"),
        F.transform(F.slice("turns", h["i"] + 1, end(j) - h["i"]), lambda t: t["text"]).alias("texts"),
    ))
    piece = lambda c, trained: F.struct(c.alias("text"), trained.alias("trained"))
    no = F.lit(False)

    def pieces(b: Column) -> Column:
        head = piece(F.concat(F.lit(OPEN), escape_role(b["role"]), F.lit("\n")), no)
        body = F.transform(b["texts"], lambda t, i: F.array(
            piece(F.when(i > 0, F.lit(PART)).otherwise(""), no), piece(escape(t), b["role"] == TRAINED),
        ))
        return F.concat(F.array(head), F.flatten(body), F.array(piece(F.lit(CLOSE), no)))

    df = df.withColumn("blocks", blocks)
    df = df.withColumn("segments", F.flatten(F.transform("blocks", pieces)))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return computed(df, "key", formatted=formatted, segments=F.col("segments")).withColumnRenamed("key", key)


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, read from the text alone."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        header = F.substring_index(b, "\n", 1)
        body = F.substring(b, F.length(header) + 2, F.length(b))
        name = unescape_role(F.substring(header, F.lit(len(OPEN) + 1), F.length(header)))
        return F.transform(F.split(body, PART), lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["trained"]), lambda s: unescape(s["text"])), "")
