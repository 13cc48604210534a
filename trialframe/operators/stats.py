"""Unit statistics as grouped aggregates.

Counts are compressed before any ordering: moments need one pass, rank tests work on per-unit value
histograms. Trials without spikes enter as one histogram row, so no unit x trial grid is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pvalues import chi2_sf, correlation_p
from ..functions.signal import significant
from ..schema import CLASSES, UNIT
from .lineage import cut
from .skew import value_bucket, with_group_stats, with_prefix

K = range(len(CLASSES))


def add(cols) -> Column:
    return reduce(lambda a, b: a + b, list(cols))


# ---------------------------------------------------------------- moments


def class_moments(unit_trials: DataFrame, sizes: DataFrame, value: str = "ctx") -> DataFrame:
    """Per unit and class: sum s_k, sum of squares q_k, active trials a_k, with class sizes n_k.

    `sizes` has one row per unit (`unit_sizes`); unlabelled trials are left out.
    """
    v = F.col(value)
    aggs = []
    for i, c in enumerate(CLASSES):
        mine = F.col("label") == c
        aggs += [
            F.sum(F.when(mine, v)).alias(f"s_{i}"),
            F.sum(F.when(mine, v * v)).alias(f"q_{i}"),
            F.count_if(mine & (v > 0)).alias(f"a_{i}"),
        ]
    sums = unit_trials.where(F.col("label").isNotNull()).groupBy(*UNIT).agg(*aggs)
    filled = sizes.join(sums, list(UNIT), "left")
    names = [f"{p}_{i}" for i in K for p in "sqa"]
    return filled.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


def _mean(*ks: int) -> Column:
    return F.try_divide(add(F.col(f"s_{k}") for k in ks), add(F.col(f"n_{k}") for k in ks))


def _var(ddof: int, *ks: int) -> Column:
    n, s, q = (add(F.col(f"{p}_{k}") for k in ks).cast("double") for p in "nsq")
    # clamped at zero: the difference of two equal sums may come out slightly negative
    return F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - ddof), F.lit(0.0))


def mean_rate(duration_s: float, *ks: int) -> Column:
    return _mean(*(ks or K)) / F.lit(duration_s)


def active_fraction() -> Column:
    return F.try_divide(add(F.col(f"a_{k}") for k in K), F.col("n_trials"))


def cohens_d() -> Column:
    """Left against Right with sample variances; NULL below two trials, 0 without spread."""
    spread = F.sqrt((_var(1, 1) + _var(1, 2)) / 2)
    d = F.coalesce(F.try_divide(_mean(1) - _mean(2), F.nullif(spread, F.lit(0.0))), F.lit(0.0))
    return F.when((F.col("n_1") >= 2) & (F.col("n_2") >= 2), d)


def eta_squared() -> Column:
    """Between-class share of the sum of squares; 0 without spread."""
    n, s, q = (add(F.col(f"{p}_{k}") for k in K).cast("double") for p in "nsq")
    base = F.try_divide(s * s, n)
    between = add(F.coalesce(F.try_divide(F.col(f"s_{k}").cast("double") * F.col(f"s_{k}"), F.col(f"n_{k}")), F.lit(0.0)) for k in K)
    total = q - base
    return F.when(total <= 0, F.lit(0.0)).otherwise((between - base) / total)


def dprime(pos: tuple[int, ...], neg: tuple[int, ...], duration_s: float = 1.0) -> Column:
    """Rate difference over the root mean population variance; 0 when undefined."""
    mean_var = (_var(0, *pos) + _var(0, *neg)) / (2 * duration_s**2)
    diff = (_mean(*pos) - _mean(*neg)) / duration_s
    enough = (add(F.col(f"n_{k}") for k in pos) >= 2) & (add(F.col(f"n_{k}") for k in neg) >= 2)
    return F.when(enough & (mean_var >= 1e-8), diff / F.sqrt(mean_var)).otherwise(0.0)


def choice_score(duration_s: float = 1.0) -> Column:
    """Larger of |d'(Left, Right)| and 0.65 |d'(lick, Ignore)|."""
    return F.greatest(F.abs(dprime((1,), (2,), duration_s)), F.abs(dprime((1, 2), (0,), duration_s)) * 0.65)


def preferred_class() -> Column:
    """Class with the highest mean; ties go to the lowest code, absent classes never win."""
    means = [F.coalesce(_mean(k), F.lit(float("-inf"))) for k in K]
    best = F.greatest(*means)
    return F.coalesce(*[F.when(means[k] == best, F.lit(CLASSES[k])) for k in K])


# ---------------------------------------------------------------- rank tests


def class_histogram(unit_trials: DataFrame, sizes: DataFrame, value: str = "ctx") -> DataFrame:
    """Per unit and distinct value v: trials c_0..c_2 of each class, zero-count trials included.

    A trial with spikes adds one to its value and takes one off the zeros; `sizes` gives all trials to
    the zeros first. So one pass over the sparse rows is enough.
    """
    rows = unit_trials.where(F.col("label").isNotNull() & (F.col(value) > 0))
    ones = [F.count_if(F.col("label") == c).alias(f"c_{i}") for i, c in enumerate(CLASSES)]
    seen = rows.groupBy(*UNIT, F.col(value).alias("v")).agg(*ones)
    return with_zeros(seen, sizes, list(UNIT), ["v"], {f"c_{i}": f"n_{i}" for i in K})


def with_zeros(seen: DataFrame, sizes: DataFrame, keys: list[str], values: list[str], counts: dict[str, str]) -> DataFrame:
    """Histogram rows plus the row of all-zero values, whose counts are the sizes less the rows seen."""
    zero = {v: F.lit(0).cast(seen.schema[v].dataType) for v in values}
    plus = F.struct(*[F.col(v) for v in values], *[F.col(c) for c in counts])
    minus = F.struct(*[zero[v].alias(v) for v in values], *[(-F.col(c)).alias(c) for c in counts])
    moved = seen.select(*keys, F.inline(F.array(plus, minus)))
    every = sizes.select(*keys, *[zero[v].alias(v) for v in values], *[F.col(n).cast("long").alias(c) for c, n in counts.items()])
    summed = moved.unionByName(every).groupBy(*keys, *values).agg(*[F.sum(c).alias(c) for c in counts])
    return summed.where(add(F.col(c) for c in counts) > 0)


def kruskal(hist: DataFrame, keys: list[str], spread: bool = False) -> DataFrame:
    """Tie-corrected rank test over classes with at least two trials.

    `hist` is one row per key and distinct value v with class counts c_k. Count histograms hold few
    values per key and are ordered by one window; `spread` orders continuous values by buckets.
    NULL when fewer than two classes remain or every class is constant.
    """
    sums = [F.sum(f"c_{k}").alias(f"n_{k}") for k in K]
    if spread:
        sized = with_group_stats(cut(hist), keys, ["v"], *sums)
    else:
        over = Window.partitionBy(*keys)
        sized = hist.withColumns({f"n_{k}": F.sum(f"c_{k}").over(over) for k in K})
    used = sized.withColumns({f"c_{k}": F.when(F.col(f"n_{k}") >= 2, F.col(f"c_{k}")).otherwise(0) for k in K})
    used = used.withColumn("ties", add(F.col(f"c_{k}") for k in K)).where(F.col("ties") > 0)
    if spread:
        ranked = with_prefix(used, keys, ["v"], F.col("ties"), value_bucket(F.col("v")))
    else:
        upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = used.withColumn("before", F.sum("ties").over(upto) - F.col("ties"))
    rank = F.col("before") + (F.col("ties") + 1) / 2
    t = F.col("ties").cast("double")
    agg = ranked.groupBy(*keys).agg(
        F.sum("ties").cast("double").alias("n"),
        F.sum(t * t * t - t).alias("tie_sum"),
        *[F.sum(rank * F.col(f"c_{k}")).alias(f"r_{k}") for k in K],
        *[F.sum(f"c_{k}").alias(f"m_{k}") for k in K],
        *[F.count_if(F.col(f"c_{k}") > 0).alias(f"d_{k}") for k in K],
    )
    n = F.col("n")
    groups = add((F.col(f"m_{k}") > 0).cast("int") for k in K)
    varied = reduce(lambda a, b: a | b, [F.col(f"d_{k}") > 1 for k in K])
    total = add(F.coalesce(F.try_divide(F.col(f"r_{k}") * F.col(f"r_{k}"), F.col(f"m_{k}")), F.lit(0.0)) for k in K)
    raw = F.lit(12.0) / (n * (n + 1)) * total - 3 * (n + 1)
    corrected = F.try_divide(raw, 1 - F.try_divide(F.col("tie_sum"), n * n * n - n))
    ok = (groups >= 2) & varied
    out = agg.select(*keys, F.when(ok, corrected).alias("h"), F.when(ok, groups - 1).alias("df"))
    return out.withColumn("p", chi2_sf(F.col("h"), F.col("df")))


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """Rank correlation per key from distinct (x, y) rows with a weight; NULL when x or y is constant."""
    w = F.col(weight) if weight else F.lit(1)
    base = pairs.withColumn("_w", w.cast("double"))

    def ranked(df: DataFrame, col: str, out: str) -> DataFrame:
        upto = Window.partitionBy(*keys).orderBy(col).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        same = Window.partitionBy(*keys).orderBy(col).rangeBetween(Window.currentRow, Window.currentRow)
        return df.withColumn(out, F.sum("_w").over(upto) - (F.sum("_w").over(same) - 1) / 2)

    rows = ranked(ranked(base, x, "_rx"), y, "_ry")
    return _weighted_correlation(rows, keys, "_rx", "_ry", "_w")


def _weighted_correlation(rows: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    wx, wy = F.col(w) * F.col(x), F.col(w) * F.col(y)
    agg = rows.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        F.sum(wx).alias("sx"),
        F.sum(wy).alias("sy"),
        F.sum(wx * F.col(x)).alias("sxx"),
        F.sum(wy * F.col(y)).alias("syy"),
        F.sum(wx * F.col(y)).alias("sxy"),
    )
    n = F.col("n")
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    scale = F.when((vx > 1e-9) & (vy > 1e-9), F.sqrt(vx * vy))
    rho = F.greatest(F.least(F.try_divide(cov, scale), F.lit(1.0)), F.lit(-1.0))
    return agg.select(*keys, F.when(scale.isNotNull(), rho).alias("rho"), n.cast("long").alias("n_pairs"))


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average rank of every row in its key, for continuous values and keys of any size.

    Equal values are merged before they are ordered; AQE splits the join back where a value holds very many rows.
    """
    distinct = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = with_prefix(distinct, keys, [value], F.col("_c"), value_bucket(F.col(value)))
    ranks = ranked.select(*keys, value, (F.col("before") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(ranks, [*keys, value], "left")


def spearman_global(df: DataFrame, x: str, y: str, keys: list[str] = []) -> DataFrame:
    """Rank correlation of continuous columns over large groups (or the whole table)."""
    keyed = df.select(*keys, x, y) if keys else df.select(F.lit(0).alias("_all"), x, y)
    k = keys or ["_all"]
    rows = average_ranks(average_ranks(keyed, k, x, "_rx"), k, y, "_ry").withColumn("_w", F.lit(1.0))
    out = _weighted_correlation(rows, k, "_rx", "_ry", "_w")
    out = out.withColumn("p", correlation_p(F.col("rho"), F.col("n_pairs")))
    return out if keys else out.drop("_all")


def coupling_pairs(unit_trials: DataFrame, sizes: DataFrame, x: str = "late", y: str = "tgt") -> DataFrame:
    """Per unit: distinct (x, y) counts with the number of trials, silent trials as (0, 0)."""
    rows = unit_trials.where(F.col("label").isNotNull() & ((F.col(x) > 0) | (F.col(y) > 0)))
    seen = rows.groupBy(*UNIT, x, y).agg(F.count("*").alias("c"))
    return with_zeros(seen, sizes, list(UNIT), [x, y], {"c": "n_trials"})


def spearman_coupling(unit_trials: DataFrame, sizes: DataFrame) -> DataFrame:
    """Late-context rate against target rate across trials."""
    out = spearman(coupling_pairs(unit_trials, sizes), list(UNIT), "late", "tgt", "c")
    return out.withColumn("p", correlation_p(F.col("rho"), F.col("n_pairs")))


def spearman_ramp(psths: DataFrame, smoothed: Column, digits: int = 9) -> DataFrame:
    """Bin number against the smoothed mean trace. Values are rounded so that bins that are equal
    but for the order of summation tie."""
    rows = psths.select(*UNIT, F.posexplode(smoothed).alias("bin", "v")).withColumn("v", significant(F.col("v"), digits))
    out = spearman(rows, list(UNIT), "bin", "v")
    return out.withColumn("p", correlation_p(F.col("rho"), F.col("n_pairs")))


def pearson_arrays(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Correlation of two equal-length arrays; 0 below four points or without spread, negatives 0."""
    pairs = df.select(*keys, F.inline(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("a", "b"))
    agg = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.covar_pop("a", "b").alias("cov"),
        F.stddev_pop("a").alias("sa"),
        F.stddev_pop("b").alias("sb"),
    )
    ok = (F.col("n") >= 4) & (F.col("sa") >= 1e-8) & (F.col("sb") >= 1e-8)
    r = F.try_divide(F.col("cov"), F.col("sa") * F.col("sb"))
    return agg.select(*keys, F.greatest(F.when(ok, r).otherwise(0.0), F.lit(0.0)).alias("coupling"))


# ---------------------------------------------------------------- false discovery rate


def bh_fdr(
    df: DataFrame, keys: list[str], p: str = "p", q: str = "q", spread: list[str] = ("unit",), settled: bool = False
) -> DataFrame:
    """Benjamini-Hochberg q per key. NULL p is not counted and stays NULL.

    The tests are read several times, so they are written once first unless the caller says they are
    `settled`.

    q depends on p only, so the ordering runs on distinct p values; the running minimum from the right
    is the minimum inside a p bucket and over all later buckets.
    """
    df = df if settled else cut(df)
    distinct = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_c"))
    bucket = value_bucket(F.col(p))
    ranked = with_prefix(distinct, keys, [p], F.col("_c"), bucket, total="_n")
    scaled = ranked.withColumn("_s", F.col(p) * F.col("_n") / (F.col("before") + F.col("_c"))).withColumn("_b", bucket)
    later = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    floors = (
        scaled.groupBy(*keys, "_b").agg(F.min("_s").alias("_m")).withColumn("_later", F.min("_m").over(later)).drop("_m")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    qs = scaled.join(floors, [*keys, "_b"]).select(
        *keys, p, F.least(F.min("_s").over(inside), F.col("_later"), F.lit(1.0)).alias(q)
    )
    return df.join(qs, [*keys, p], "left")


# ---------------------------------------------------------------- scaling within a group


def zscore(df: DataFrame, keys: list[str], cols: list[str], spread: list[str] = ("unit",)) -> DataFrame:
    """Adds z_<col>: population z-score in the group, 0 without spread."""
    aggs = [f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    out = with_group_stats(df, keys, list(spread), *aggs)
    z = {
        f"z_{c}": F.when(F.col(f"_s_{c}") >= 1e-8, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0)
        for c in cols
    }
    return out.withColumns(z).drop(*[f"_{n}_{c}" for c in cols for n in "ms"])


def softmax_prior(df: DataFrame, keys: list[str], value: str, out: str = "attention", spread: list[str] = ("unit",)) -> DataFrame:
    top = with_group_stats(df, keys, list(spread), F.max(value).alias("_top"))
    scored = top.withColumn("_e", F.exp(F.col(value) - F.col("_top")))
    return with_group_stats(scored, keys, list(spread), F.sum("_e").alias("_z")).withColumn(
        out, F.col("_e") / F.col("_z")
    ).drop("_top", "_e", "_z")


def gain_prior(df: DataFrame, keys: list[str], value: str, coupling: str, out: str = "prediction_gain", spread: list[str] = ("unit",)) -> DataFrame:
    top = with_group_stats(df, keys, list(spread), F.max(value).alias("_top"))
    return top.withColumn(out, F.col(coupling) * (F.col(value) / (F.col("_top") + 1e-8))).drop("_top")


def prior_dprime(duration_s: float) -> Column:
    """|Left - Right| over the root mean variance plus 1e-8; 0 without both classes."""
    v = (_var(0, 1) + _var(0, 2)) / (2 * duration_s**2)
    d = F.abs(_mean(1) - _mean(2)) / duration_s / F.sqrt(v + 1e-8)
    return F.coalesce(F.when((F.col("n_1") > 0) & (F.col("n_2") > 0), d), F.lit(0.0))


def minmax_spread(df: DataFrame, cols: list[str], keys: list[str] = []) -> DataFrame:
    """Column-wise (x - min) / (range + 1e-8), over the group or the whole table."""
    base = df if keys else df.withColumn("_all", F.lit(0))
    k = keys or ["_all"]
    aggs = [f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    out = with_group_stats(base, k, cols, *aggs)
    scaled = {c: (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-8) for c in cols}
    return out.withColumns(scaled).drop("_all", *[f"_{n}_{c}" for c in cols for n in ("lo", "hi")])
