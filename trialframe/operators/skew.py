"""Grouped ordering and lookups that stay spread when one key holds a large share of the rows.

A plain window over a key sorts the whole key in one task. Here a key is cut into value buckets by a
fixed monotone rule; bucket totals (bounded in number) give offsets, and sorting happens inside a
bucket. The rule is deterministic, so a recomputed partition gives the same cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
STEPS_PER_OCTAVE = 32
ZERO_OFFSET = 1100 * STEPS_PER_OCTAVE


def value_bucket(value: Column) -> Column:
    """Monotone bucket of a double on a signed logarithmic grid (about 2 % wide steps)."""
    size = F.greatest(F.floor(F.log2(F.abs(value)) * STEPS_PER_OCTAVE) + ZERO_OFFSET, F.lit(1)).cast("int")
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size)


def id_bucket(value: Column, bits: int = 16) -> Column:
    """Monotone bucket of an integer that is distinct within its key: at most 2^bits neighbouring values each."""
    return F.shiftright(value.cast("long"), bits)


def hash_bucket(hashed: Column, bits: int = 10) -> Column:
    """Monotone bucket of a `draw`: its leading bits."""
    return F.shiftright(hashed, 60 - bits).cast("int")


def draw(seed: int, *cols) -> Column:
    """A seeded number of 60 bits for a row, from an MD5 over its columns, so that any engine can repeat the draw."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def attach(df: DataFrame, small: DataFrame, on: list[str], spread: list, salts: int = SALTS, how: str = "left") -> DataFrame:
    """Join one-row-per-key `small` to `df`, splitting every key of `df` into `salts` parts.

    `small` is copied `salts` times, so it is for keys far fewer than rows (sessions, regions, trials); `spread` must
    vary inside a key. Where `small` grows with `df`, a plain join lets AQE copy only what a hot key needs. AQE turns this into a broadcast when the measured size of `small` allows it.
    """
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def with_prefix(
    df: DataFrame, keys: list[str], order: list[str], weight: Column | None, bucket: Column,
    out: str = "before", total: str | None = None,
) -> DataFrame:
    """Add the summed weight of all earlier rows of the key (and the key total)."""
    weight = F.lit(1) if weight is None else weight
    rows = df.withColumn("_b", bucket).withColumn("_w", weight.cast("long"))
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    totals = (
        rows.groupBy(*keys, "_b")
        .agg(F.sum("_w").alias("_bw"))
        .withColumn("_off", F.sum("_bw").over(by_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_bw"))
    )
    if total:
        totals = totals.withColumn(total, F.sum("_bw").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(totals.drop("_bw"), [*keys, "_b"])
        .withColumn(out, F.sum("_w").over(inside) - F.col("_w") + F.col("_off"))
        .drop("_b", "_w", "_off")
    )


def with_position(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "pos", total: str | None = None) -> DataFrame:
    """1-based position within the key; `order` must be total and follow the bucket order."""
    return with_prefix(df, keys, order, None, bucket, out, total).withColumn(out, F.col(out) + 1)


def with_group_stats(df: DataFrame, keys: list[str], spread: list, *aggs: Column) -> DataFrame:
    """Add grouped aggregates to every row: partial aggregation, then a salted lookup."""
    return attach(df, df.groupBy(*keys).agg(*aggs), keys, spread)
