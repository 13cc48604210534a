"""Connected components of a table of links, by joins: no task and no driver holds the links of all nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(`node`, `root`) for every node that has a link; root is the smallest node it can reach.

    In turn, every node links all its larger neighbours, then its smaller ones and itself, to the smallest of
    its neighbourhood, until nothing changes; the number of rounds grows with the logarithm of the longest path.
    Minima are combined before the shuffle; a node with very many neighbours is split by AQE in the join, as both
    sides are read from storage. Every round is written, so a lost executor repeats one round at most.
    """
    pairs = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = written(pairs)
    while True:
        wide = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(wide.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = wide.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u != v").distinct())
        floor = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(floor, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionAll(floor.select("u", F.col("m").alias("v"))).distinct())
        changed = after.exceptAll(pairs).unionAll(pairs.exceptAll(after)).limit(1).count()
        pairs = after
        if not changed:
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
