"""Spike binning and unit-level rasters.

Rasters are kept sparse: a bin, trial or unit without spikes has no row. Operators that need the
zeros add them from counts (`class_sizes`) instead of building every unit x trial x bin cell.

Expected columns: spikes(session, region, unit, trial, t); trials(session, trial, label, ctx_start, go,
n_ctx, n_tgt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CLASSES, UNIT
from .skew import attach

CELL = [*UNIT, "trial", "label"]


def _index(t: Column, start: Column, width: Column) -> Column:
    """Floor of (t - start) / width, corrected so that it agrees with the edges start + i * width."""
    q = F.floor((t - start) / width)
    q = F.when(t < start + q * width, q - 1).otherwise(q)
    return F.when(t >= start + (q + 1) * width, q + 1).otherwise(q)


def bin_fixed_width(t: Column, start: Column, width: float, n: Column) -> Column:
    """Bin on edges start + i * width; the last bin includes its right edge; NULL outside."""
    w = F.lit(width)
    inside = (t >= start) & (t <= start + n * w) & (n > 0)
    return F.when(inside, F.least(_index(t, start, w), n - 1)).cast("int")


def bin_fixed_count(t: Column, start: Column, stop: Column, n: Column) -> Column:
    """Bin on n equal parts of [start, stop); NULL outside or for an empty window."""
    inside = (t >= start) & (t < stop) & (n > 0) & (stop > start)
    width = F.when(inside, (stop - start) / n)
    return F.when(inside, F.least(_index(t, start, width), n - 1)).cast("int")


def full_trial_bins(start: Column, stop: Column, width: float) -> Column:
    return F.ceil((stop - start) / F.lit(width)).cast("int")


def with_trials(spikes: DataFrame, trials: DataFrame) -> DataFrame:
    """Attach trial columns to spikes by (session, trial). Spikes of one busy trial are spread by
    unit and time, so no trial is joined in one task."""
    return attach(spikes, trials, ["session", "trial"], ["unit", "t"], how="inner")


def spikes_in_window(spikes: DataFrame, trials: DataFrame, start: str, stop: str) -> DataFrame:
    """Spikes with start <= t < stop of their own trial; the range is a residual of the equi-join."""
    joined = with_trials(spikes, trials)
    return joined.where((F.col("t") >= F.col(start)) & (F.col("t") < F.col(stop)))


def bin_windows(spikes: DataFrame, trials: DataFrame, ctx_bin: float, tgt_bin: float) -> DataFrame:
    """Sparse counts of the context (`ctx`) and target (`tgt`) windows."""
    dims = trials.select("session", "trial", "label", "ctx_start", "go", "n_ctx", "n_tgt")
    windows = F.array(
        F.struct(F.lit("ctx").alias("win"), bin_fixed_width(F.col("t"), F.col("ctx_start"), ctx_bin, F.col("n_ctx")).alias("bin")),
        F.struct(F.lit("tgt").alias("win"), bin_fixed_width(F.col("t"), F.col("go"), tgt_bin, F.col("n_tgt")).alias("bin")),
    )
    return (
        with_trials(spikes, dims)
        .select(*CELL, F.inline(windows))
        .where(F.col("bin").isNotNull())
        .groupBy(*CELL, "win", "bin")
        .agg(F.count("*").alias("n"))
    )


def unit_trial_counts(binned: DataFrame, n_ctx: int, late_bins: int) -> DataFrame:
    """Context, late-context and target counts of every unit and trial with a spike."""
    in_ctx = F.col("win") == "ctx"

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return binned.groupBy(*CELL).agg(
        total(in_ctx).alias("ctx"),
        total(in_ctx & (F.col("bin") >= n_ctx - late_bins)).alias("late"),
        total(F.col("win") == "tgt").alias("tgt"),
    )


def class_sizes(trials: DataFrame) -> DataFrame:
    """Labelled trials per session: n_trials and n_0..n_2 in class order."""
    return (
        trials.where(F.col("label").isNotNull())
        .groupBy("session")
        .agg(
            F.count("*").alias("n_trials"),
            *[F.count_if(F.col("label") == c).alias(f"n_{i}") for i, c in enumerate(CLASSES)],
        )
    )


def unit_sizes(units: DataFrame, trials: DataFrame) -> DataFrame:
    """Every unit with the class sizes of its session."""
    return attach(units.select(*UNIT), class_sizes(trials), ["session"], ["unit"], how="inner")


def dense_counts(counts: DataFrame, units: DataFrame, trials: DataFrame, value: str = "n") -> DataFrame:
    """Zero-filled unit x trial counts, for output only; statistics use the sparse rows."""
    grid = (
        units.select(*UNIT)
        .withColumn("_salt", F.pmod(F.xxhash64("unit"), F.lit(16)))
        .join(
            trials.select("session", "trial", "label").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15)))),
            ["session", "_salt"],
        )
        .drop("_salt")
    )
    return grid.join(counts.select(*UNIT, "trial", value), [*UNIT, "trial"], "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(0))
    )


def dense_array(pairs: Column, n: int) -> Column:
    """array<double> of length n from an array of (bin, value) structs; missing bins are zero."""
    cells = F.map_from_entries(pairs)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.coalesce(F.try_element_at(cells, b).cast("double"), F.lit(0.0))
    )


def raster_rows(binned: DataFrame, win: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """One row per unit and trial with its bins as an array of fixed length n."""
    keys = CELL if keys is None else keys
    return (
        binned.where(F.col("win") == win)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("bin", "n")).alias("pairs"))
        .select(*keys, dense_array(F.col("pairs"), n).alias("counts"))
    )


def psth(binned: DataFrame, sizes: DataFrame, by_class: bool = False) -> DataFrame:
    """Mean count per unit and bin over all labelled trials (or those of each class); sparse.

    `sizes` is one row per unit, so the join shares the unit key of the sums.
    """
    labelled = binned.where(F.col("label").isNotNull())
    extra = ["label"] if by_class else []
    sums = labelled.groupBy(*UNIT, "win", "bin", *extra).agg(F.sum("n").alias("total"))
    sized = sums.join(sizes, list(UNIT))
    n = F.col("n_trials")
    if by_class:
        n = F.coalesce(*[F.when(F.col("label") == c, F.col(f"n_{i}")) for i, c in enumerate(CLASSES)])
    return sized.select(*UNIT, "win", "bin", *extra, (F.col("total") / n).alias("mean_count"))


def psth_arrays(mean_counts: DataFrame, units: DataFrame, n_ctx: int, n_tgt: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Unit rows with dense `ctx` and `tgt` mean-count arrays; silent units get zeros."""
    keys = [*UNIT, *extra]

    def pairs(win: str) -> Column:
        return F.collect_list(F.when(F.col("win") == win, F.struct("bin", "mean_count")))

    packed = mean_counts.groupBy(*keys).agg(pairs("ctx").alias("c"), pairs("tgt").alias("g"))
    base = units.select(*UNIT) if not extra else mean_counts.select(*keys).distinct()
    none = F.array().cast("array<struct<bin:int,mean_count:double>>")
    return base.join(packed, keys, "left").select(
        *keys,
        dense_array(F.coalesce(F.col("c"), none), n_ctx).alias("ctx"),
        dense_array(F.coalesce(F.col("g"), none), n_tgt).alias("tgt"),
    )


def population_trace(binned: DataFrame, units: DataFrame, win: str = "ctx") -> DataFrame:
    """Mean count over the units of a region per trial and bin; sparse."""
    n_units = units.groupBy("session", "region").agg(F.count("*").alias("n_units"))
    sums = (
        binned.where(F.col("win") == win)
        .join(units.select(*UNIT), list(UNIT), "left_semi")
        .groupBy("session", "region", "trial", "bin")
        .agg(F.sum("n").alias("total"))
    )
    return attach(sums, n_units, ["session", "region"], ["trial", "bin"]).select(
        "session", "region", "trial", "bin", (F.col("total") / F.col("n_units")).alias("mean_count")
    )


def region_totals(binned: DataFrame, units: DataFrame, win: str = "ctx") -> DataFrame:
    """Per trial and region: units in the region, units that fired, total count."""
    n_units = units.groupBy("session", "region").agg(F.count("*").alias("n_units"))
    per_unit = binned.where(F.col("win") == win).groupBy("session", "region", "trial", "unit").agg(F.sum("n").alias("n"))
    per_region = per_unit.groupBy("session", "region", "trial").agg(
        F.count("*").alias("n_active"), F.sum("n").alias("total")
    )
    return attach(per_region, n_units, ["session", "region"], ["trial"])


def unit_positions(units: DataFrame) -> DataFrame:
    """0-based position of every unit in its region, by unit id."""
    from .skew import id_bucket, with_position

    ranked = with_position(units.select(*UNIT), ["session", "region"], ["unit"], id_bucket(F.col("unit")))
    return ranked.withColumn("pos", F.col("pos") - 1)


def crop_units(units: DataFrame, n: int) -> DataFrame:
    """First n units of every region; the rank limit is applied before the shuffle."""
    w = Window.partitionBy("session", "region").orderBy("unit")
    return (
        units.select(*UNIT)
        .withColumn("pos", F.row_number().over(w))
        .where(F.col("pos") <= n)
        .withColumn("pos", F.col("pos") - 1)
    )


def unit_count_changes(trial_units: DataFrame) -> DataFrame:
    """Sessions and regions whose number of units differs between trials."""
    per_trial = trial_units.groupBy("session", "region", "trial").agg(F.count("*").alias("n"))
    return (
        per_trial.groupBy("session", "region")
        .agg(F.min("n").alias("min_units"), F.max("n").alias("max_units"))
        .where(F.col("min_units") != F.col("max_units"))
    )


def nonempty_trials(binned: DataFrame, trials: DataFrame, win: str = "ctx") -> DataFrame:
    """Trials with at least one spike in the window."""
    totals = binned.where(F.col("win") == win).groupBy("session", "trial").agg(F.sum("n").alias("total"))
    return trials.select("session", "trial", "label").join(
        totals.where(F.col("total") > 0), ["session", "trial"], "left_semi"
    )
