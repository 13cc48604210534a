"""Trial-level lookups and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_row(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row with the largest position per key, kept whole; partial aggregation, no sort."""
    row = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.col(position))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*")


def join_behavior(trials: DataFrame, log: DataFrame, keys: list[str], position: str = "file_pos") -> DataFrame:
    """Left join with the last log row of each key; rows without a whole trial number are ignored."""
    usable = log.where(F.col(keys[-1]).isNotNull())
    return trials.join(last_row(usable, keys, position).withColumn("has_row", F.lit(True)), keys, "left").withColumn(
        "has_row", F.coalesce(F.col("has_row"), F.lit(False))
    )


def with_fallback_log(own: DataFrame, combined: DataFrame, session: str) -> DataFrame:
    """Own logs, plus the combined log for sessions that have none."""
    have = own.select(session).distinct()
    return own.unionByName(combined.join(have, session, "left_anti"), allowMissingColumns=True)


def priority_lookup(
    trials: DataFrame, keys: str, log: DataFrame, log_keys: str, trial: str, position: str, payload: list[str], by: list[str],
) -> DataFrame:
    """First key (in list order) with a hit wins; among equal keys the last log row wins."""
    wanted = trials.select(*by, trial, F.posexplode(keys).alias("_prio", "_key"))
    offered = log.select(F.explode(log_keys).alias("_key"), trial, position, *payload)
    offered = last_row(offered.where(F.col(trial).isNotNull()), ["_key", trial], position)
    hits = wanted.join(offered, ["_key", trial])
    cols = [c for c in by if c != trial]
    best = hits.groupBy(*cols, trial).agg(
        F.min_by(F.struct(*payload), F.col("_prio")).alias("_hit"), F.min("_prio").alias("key_rank")
    )
    return trials.join(best, [*cols, trial], "left").select(*trials.columns, "key_rank", "_hit.*")


def join_videos(trials: DataFrame, videos: DataFrame) -> DataFrame:
    """Left join on (session, label, trial); the later of two videos wins."""
    one = last_row(videos, ["session", "label", "trial"], "file_pos").select("session", "label", "trial", "video_path")
    return trials.join(one, ["session", "label", "trial"], "left")


def keep_selected(raster: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    return raster.join(selected.select(*keys), keys, "left_semi")


def with_split(trials: DataFrame, splits: DataFrame) -> DataFrame:
    return trials.join(splits.select("session", "trial", "split"), ["session", "trial"])


def importance_with_score(weights: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Model weight beside statistical score, units that have both."""
    return weights.join(scores, keys, "inner")


def with_null_forecast(cells: DataFrame, null: DataFrame) -> DataFrame:
    """Null mean of the unit and bin beside every cell."""
    return cells.join(null, ["session", "region", "unit", "bin"], "left")


def union_datasets(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def by_path(trials: DataFrame, path: str) -> DataFrame:
    return trials.where(F.col("path") == path)


def first_trial(trials: DataFrame, label: str = "Left") -> DataFrame:
    """First trial with the label per session, else the first trial."""
    rank: Column = F.struct((F.col("label") != label).cast("int"), F.col("trial"))
    return trials.groupBy("session").agg(F.min_by(F.struct("trial", "label"), rank).alias("t")).select("session", "t.*")
