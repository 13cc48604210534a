"""Band-power statistics over sparse rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal as S
from ..schema import CLASSES, UNIT
from .raster import raster_rows
from .stats import K, kruskal, with_zeros


def band_histogram(powers: DataFrame, sizes: DataFrame, keys: list[str], bands: list[str], digits: int = 9) -> DataFrame:
    """Class counts per key, band and distinct power.

    `powers` has array column `power` (one value per band) for trials with spikes; the others have power
    zero and come from `sizes`. Powers are rounded to significant digits, so that equal rasters tie whatever batch
    they ran in, and the ranks are the same in any unit of the signal.
    """
    rows = powers.where(F.col("label").isNotNull()).select(
        *keys, "label", F.posexplode("power").alias("band_idx", "v")
    )
    ones = [F.count_if(F.col("label") == c).alias(f"c_{i}") for i, c in enumerate(CLASSES)]
    seen = rows.withColumn("v", S.significant(F.col("v"), digits)).groupBy(*keys, "band_idx", "v").agg(*ones)
    per_band = sizes.select(
        *keys, *[f"n_{i}" for i in K], F.explode(F.sequence(F.lit(0), F.lit(len(bands) - 1))).alias("band_idx")
    )
    return with_zeros(seen, per_band, [*keys, "band_idx"], ["v"], {f"c_{i}": f"n_{i}" for i in K})


def band_tests(hist: DataFrame, keys: list[str]) -> DataFrame:
    return kruskal(hist, [*keys, "band_idx"], spread=True)


def best_band(tests: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Smallest p over the bands (not corrected) and its band; the earlier band wins a tie."""
    names = F.array(*[F.lit(b) for b in bands])
    low = tests.groupBy(*keys).agg(F.min(F.when(F.col("p").isNotNull(), F.struct("p", "band_idx"))).alias("low"))
    return low.select(
        *keys,
        F.col("low.p").alias("p_spectral"),
        F.coalesce(F.get(names, F.col("low.band_idx")), F.lit("")).alias("spectral_band"),
    )


def spectral_selectivity_a(binned: DataFrame, sizes: DataFrame, n_ctx: int, bin_s: float, bands: dict, sigma_bins: float) -> DataFrame:
    rasters = raster_rows(binned.where(F.col("label").isNotNull()), "ctx", n_ctx)
    powers = rasters.withColumn("power", S.band_power_cwt(F.col("counts"), bin_s, bands, sigma_bins))
    names = list(bands)
    return best_band(band_tests(band_histogram(powers, sizes, list(UNIT), names), list(UNIT)), list(UNIT), names)


def tf_selectivity_b(class_traces: DataFrame, keys: list[str], trace: str, bin_s: float, lo: float = 12.0, hi: float = 45.0) -> DataFrame:
    """|right - ignore| + 0.4 |left - (right + ignore) / 2| of the class-mean band energy; an absent class is 0."""
    energy = class_traces.withColumn("e", S.wavelet_band_energy(F.col(trace), bin_s, lo, hi))

    def of(label: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("label") == label, F.col("e"))), F.lit(0.0))

    agg = energy.groupBy(*keys).agg(of("Ignore").alias("ei"), of("Left").alias("el"), of("Right").alias("er"))
    i, l, r = F.col("ei"), F.col("el"), F.col("er")
    return agg.select(*keys, (F.abs(r - i) + F.lit(0.4) * F.abs(l - F.lit(0.5) * (r + i))).alias("tf_selectivity"))


def band_power_by_class(unit_powers: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Mean and standard error over units of log1p band power per class.

    `unit_powers`: one row per key, unit and label with array `power`, already averaged over trials.
    """
    names = F.array(*[F.lit(b) for b in bands])
    rows = unit_powers.select(*keys, "label", F.posexplode("power").alias("band_idx", "v"))
    return rows.groupBy(*keys, "label", F.get(names, F.col("band_idx")).alias("band")).agg(
        F.avg(F.log1p("v")).alias("mean"),
        (F.stddev_pop(F.log1p("v")) / F.sqrt(F.count("*"))).alias("sem"),
        F.count("*").alias("n_units"),
    )


def mean_power(powers: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise mean of array `power` per key."""
    rows = powers.select(*keys, F.posexplode("power").alias("i", "v"))
    per_band = rows.groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    # at most one entry per band
    packed = per_band.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
    return packed.select(*keys, F.transform("p", lambda s: s["v"]).alias("power"))


def scalogram_range(scalograms: DataFrame, keys: list[str], power: str) -> DataFrame:
    """5th and 98th percentile of log10 power over the middle 80 % of the bins."""
    rows = scalograms.select(*keys, F.explode(power).alias("row"))
    n = F.size("row")
    start, stop = F.floor(n * 0.1).cast("int"), F.floor(n * 0.9).cast("int")
    cells = rows.select(*keys, F.explode(F.slice("row", start + 1, stop - start)).alias("v"))
    q = F.percentile(F.log10(F.col("v") + 1e-6), F.array(F.lit(0.05), F.lit(0.98)))
    return cells.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("vmin"), F.col("q")[1].alias("vmax"))
