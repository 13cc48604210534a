"""Catalog, quality and weight summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CLASSES, REGIONS, QcRules
from .skew import attach, draw, hash_bucket, id_bucket, with_position


def class_count_columns(label: str = "label") -> list[Column]:
    return [F.count_if(F.col(label) == c).alias(c) for c in CLASSES]


def catalog_summary(trials: DataFrame, has_csv: str = "has_csv", has_video: str = "has_video") -> DataFrame:
    """Per dataset and session: trials per class, total, with log row, with video."""
    return trials.groupBy("dataset", "session").agg(
        *class_count_columns(),
        F.count_if(F.col("label").isin(*CLASSES)).alias("n_trials"),
        F.count_if(has_csv).alias("with_csv"),
        F.count_if(has_video).alias("with_video"),
    )


def dataset_class_counts(trials: DataFrame) -> DataFrame:
    return trials.groupBy("dataset").agg(*class_count_columns())


def class_counts(trials: DataFrame) -> DataFrame:
    return trials.groupBy("session").agg(*class_count_columns())


def min_trials_flag(trials: DataFrame, rules: QcRules = QcRules()) -> DataFrame:
    """Sessions where some class has fewer trials than the setting asks for."""
    counts = class_counts(trials)
    return counts.withColumn("few_trials", F.least(*CLASSES) < rules.min_trials_per_class)


def cache_summary(trials: DataFrame, units: DataFrame, n_ctx: int, n_tgt: int) -> DataFrame:
    """Per session: labelled trials, class counts, units per region, window lengths."""
    per_session = trials.where(F.col("label").isNotNull()).groupBy("session").agg(
        F.count("*").alias("n_trials"), *class_count_columns()
    )
    per_region = units.groupBy("session").agg(*[F.count_if(F.col("region") == r).alias(f"units_{r}") for r in REGIONS])
    return per_session.join(per_region, "session", "left").withColumns({"T_ctx": F.lit(n_ctx), "T_tgt": F.lit(n_tgt)})


def audit_summary(trials: DataFrame, reasons: list[str], reason: str = "reason", keys: list[str] = ["session"]) -> DataFrame:
    """Trials started, kept and excluded, with one column per reason code and one for all other codes.

    The code is what stands before a colon or a bracket: `csv_excluded:noise` counts as `csv_excluded`.
    """
    code = F.regexp_extract(F.col(reason), "^[^:(]*", 0)
    return trials.groupBy(*keys).agg(
        F.count("*").alias("n_start"),
        F.count_if(F.col(reason).isNull()).alias("n_kept"),
        F.count_if(F.col(reason).isNotNull()).alias("n_excluded"),
        *[F.count_if(code == r).alias(f"excl_{r}") for r in reasons],
        F.count_if(~code.isin(reasons)).alias("excl_other"),
    )


def importance_histogram(df: DataFrame, keys: list[str], value: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins over [0, 1]; the right edge belongs to the last bin; outside is dropped."""
    v = F.col(value)
    b = F.least(F.floor(v * bins), F.lit(bins - 1)).cast("int")
    return df.where((v >= 0) & (v <= 1)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def weight_by_class(weights: DataFrame, keys: list[str], label: str = "label", weight: str = "w") -> DataFrame:
    return weights.groupBy(*keys, label).agg(F.avg(weight).alias("mean_weight"))


def weight_entropy(weights: DataFrame, keys: list[str], group: list[str], weight: str = "w") -> DataFrame:
    """Mean weight and mean entropy; entropy is summed inside a group (trial and region) first."""
    w = F.col(weight)
    per = weights.groupBy(*keys, *group).agg(
        F.sum(w).alias("s"), F.count("*").alias("n"), F.sum(-w * F.ln(F.greatest(w, F.lit(1e-8)))).alias("h")
    )
    return per.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mean_weight"), F.avg("h").alias("entropy"))


def session_batches(trials: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """Batch number of every trial; a batch never mixes sessions. With a seed the order is hashed."""
    if seed is None:
        order, bucket = ["trial"], id_bucket(F.col("trial"))
        rows = trials
    else:
        rows = trials.withColumn("_h", draw(seed, "session", "trial"))
        order, bucket = ["_h", "trial"], hash_bucket(F.col("_h"))
    ranked = with_position(rows, ["session"], order, bucket)
    return ranked.withColumn("batch", F.floor((F.col("pos") - 1) / size).cast("long")).drop("pos", "_h")


def region_coverage(binned: DataFrame, units: DataFrame, trials: DataFrame, expected_bins: int) -> DataFrame:
    """Per session and region of the fixed region list: units, trials with spikes, mean spikes, coverage."""
    regions = F.explode(F.array(*[F.lit(r) for r in REGIONS])).alias("region")
    dims = trials.groupBy("session").agg(F.count("*").alias("n_trials")).select("session", "n_trials", regions)
    n_units = units.groupBy("session", "region").agg(F.count("*").alias("n_units"))
    per_trial = (
        binned.where(F.col("win") == "ctx")
        .groupBy("session", "region", "trial")
        .agg(F.sum("n").alias("spikes"), F.max("bin").alias("last_bin"))
    )
    seen = per_trial.groupBy("session", "region").agg(
        F.count("*").alias("trials_with_spikes"), F.sum("spikes").alias("spikes"), F.max("last_bin").alias("last_bin")
    )
    keys = ["session", "region"]
    out = dims.join(n_units, keys, "left").join(seen, keys, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_units", "trials_with_spikes", "spikes")}
    return out.withColumns(zero).select(
        *keys, "n_trials", "n_units", "trials_with_spikes", "spikes",
        (F.coalesce(F.col("last_bin"), F.lit(0)) < expected_bins).alias("bins_ok"),
        (F.col("n_units") > 0).alias("covered"),
    )


def unknown_regions(trial_units: DataFrame, region: str = "region") -> DataFrame:
    """Units per session whose region text is not recognised."""
    return trial_units.groupBy("session").agg(
        F.count_if(F.col(region).isNull()).alias("n_unknown"), F.count("*").alias("n_units")
    )


def top_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_rows_by(df: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def guarded_trials(trials: DataFrame, minimum: int, per_session: int = 1) -> DataFrame:
    """Trials of the sessions that have `per_session` or more of them; the job fails where fewer than `minimum` are left.

    The guard is a part of the plan: a branch over the counts alone, which gives no row and raises an error instead.
    """
    counts = trials.groupBy("session").agg(F.count("*").alias("_n")).where(F.col("_n") >= per_session)
    kept = attach(trials, counts, ["session"], ["trial"], how="inner").drop("_n").select(*trials.columns)
    left = F.coalesce(F.sum("_n"), F.lit(0))
    error = F.concat(F.lit("too few trials: "), left.cast("string"), F.lit(f" of at least {minimum}"))
    guard = counts.agg(F.when(left < minimum, F.raise_error(error).cast("boolean")).otherwise(F.lit(False)).alias("_row")).where("_row")
    empty = guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in trials.schema.fields])
    return kept.unionByName(empty)
