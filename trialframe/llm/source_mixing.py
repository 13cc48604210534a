"""Mixing sources to target weights by Poisson replication.

A source of n documents with target weight w (weights sum to one) is to fill the share w of `epochs` times the
corpus, so each of its documents is repeated at the mean rate w * epochs * N / n. The number of copies of a
document is the inverse of the Poisson distribution of that mean at a number in [0, 1) hashed from the seed, the
document's id and its text: rows decide for themselves, so a repeated task gives the same copies and nothing is
gathered but the row count of each source. Means above `STEP` are sums of equal smaller ones, each with its own
number, as the first term of the distribution would vanish. Copies are shuffled globally: dealt out by a hash of
seed, id, text and copy number, and sorted by it inside each partition.

Without given weights the sources are tempered: a weight in proportion to the source's documents to the power
`alpha` (1 keeps the mixture, 0 makes all sources equal).

Defined cases: a null source is a source of its own; a source that given weights don't name has weight zero; null
and empty texts are drawn like others; a null id or text is hashed as `null`, so rows without an id, or with the same
one, are told apart by their texts; rows that repeat both get equal counts and places; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import written
from .words import packed, unpacked

SEED = 17
ALPHA = 0.5
EPOCHS = 1.0
STEP = 64.0
#: Beyond so many sources the rates are joined by a shuffle, with every source split.
BROADCAST = 10_000
PARTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from an MD5 over the parts, 48 bits deep, as any engine can state it."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", alpha: float = ALPHA, epochs: float = EPOCHS) -> DataFrame:
    """One row per source: `source`, `n`, `rate` (mean copies of a document)."""
    counts = written(docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow("n", F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        weighed = counts.join(given, counts["source"].eqNullSafe(given["source"]), "left").select(
            counts["source"], "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = weighed.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    if not sums["weight"]:
        return weighed.select("source", "n", F.lit(0.0).alias("rate"))
    rate = F.col("weight") / F.lit(float(sums["weight"])) * F.lit(float(epochs)) * F.lit(int(sums["n"])) / F.col("n")
    return weighed.select("source", "n", rate.alias("rate"))


def distribution(mean: Column) -> Column:
    """Cumulative Poisson probabilities from 0 copies up, as far as doubles tell them from one."""
    last = (mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def more(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, more, lambda acc: acc["all"])


def counted(docs: DataFrame, rate: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = SEED, text: str = "text") -> DataFrame:
    """Every row packed as `doc`, with `id` and `mark` (a hash of the text) and `copies`."""
    steps = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    table = rate.select("source", "rate", steps.alias("steps"))
    table = table.withColumn("cdf", distribution(F.col("rate") / F.col("steps"))).drop("rate")
    table = written(table)
    df = packed(docs, id=F.col(doc_id), mark=F.md5(F.col(text)), name=F.col(source))
    if table.count() <= BROADCAST:
        joined = df.join(F.broadcast(table), F.col("name").eqNullSafe(F.col("source")))
    else:
        parts = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        salted = df.withColumn("own", F.pmod(F.xxhash64("id", "mark"), F.lit(PARTS)).cast("int"))
        joined = salted.join(parts, F.col("name").eqNullSafe(F.col("source")) & (F.col("own") == F.col("part")))
    draw = lambda j: uniform(F.lit(seed), F.col("id"), F.col("mark"), j)
    # The copies of one step are the probabilities at or below its number; the array is sorted.
    one = lambda u: F.size(F.filter("cdf", lambda c: c <= u))
    draws = F.transform(F.sequence(F.lit(1), F.col("steps")), draw)
    copies = F.aggregate(draws, F.lit(0).cast("long"), lambda a, u: a + one(u))
    return joined.select("doc", "id", "mark", copies.alias("copies"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, doc_id: str = "doc_id", source: str = "source",
          alpha: float = ALPHA, epochs: float = EPOCHS, seed: int = SEED, text: str = "text") -> DataFrame:
    """The copies, shuffled globally: `doc` (the row), `copy` (from 0) and `place` (the hash they are sorted by)."""
    df = counted(docs, rates(docs, weights, source, alpha, epochs), doc_id, source, seed, text).filter("copies > 0")
    df = df.select("doc", "id", "mark", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    known = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("id", "mark")]
    place = F.substring(F.md5(F.concat_ws(":", F.lit(f"place{seed}"), *known, "copy")), 1, 16)
    df = df.select("doc", "copy", place.alias("place"))
    return df.repartition("place").sortWithinPartitions("place")


def replicated(docs: DataFrame, **options) -> DataFrame:
    """The same with the columns of `docs` only."""
    return unpacked(mixed(docs, **options), docs)
