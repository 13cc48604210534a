"""Canonical tables read from a general event table.

Each event is a spike: the user is the unit, the calendar day the trial, seconds in the day the time.
Strong purchases and signups are left and right licks; noon is the go cue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import label_from_licks_a
from ..schema import REGIONS

GO = 43200.0
CTX_BIN, N_CTX = 1800.0, 24
TGT_BIN, N_TGT = 3600.0, 12
LATE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    # the clock time is taken from the fields, so the session time zone plays no part
    second = F.expr("extract(SECOND FROM ts)").cast("double")
    t = F.hour("ts") * 3600.0 + F.minute("ts") * 60.0 + second
    return e.select(
        F.floor(F.col("user_id") / 50).cast("long").alias("session"),
        F.get(F.array(*[F.lit(r) for r in REGIONS]), F.pmod("user_id", F.lit(4)).cast("int")).alias("region"),
        F.col("user_id").alias("unit"),
        F.unix_date(F.col("ts").cast("date")).cast("long").alias("trial"),
        t.alias("t"),
        "event_type",
        "value",
    )


def units(sp: DataFrame) -> DataFrame:
    return sp.select("session", "region", "unit").distinct()


def licks(sp: DataFrame) -> DataFrame:
    side = F.when(F.col("event_type") == "purchase", "Left").otherwise("Right")
    strong = F.col("event_type").isin("purchase", "signup") & (F.col("value") > 150)
    return sp.where(strong).select("session", "trial", side.alias("side"), "t")


def trials(sp: DataFrame) -> DataFrame:
    """One row per session and day with lick counts, first licks, label and windows; one aggregation."""
    strong = F.col("event_type").isin("purchase", "signup") & (F.col("value") > 150)
    left, right = strong & (F.col("event_type") == "purchase"), strong & (F.col("event_type") == "signup")
    after = F.col("t") >= GO
    t = F.col("t")
    agg = sp.groupBy("session", "trial").agg(
        F.count_if(left & after).alias("n_left"),
        F.count_if(right & after).alias("n_right"),
        F.count_if(strong & ~after).alias("n_early"),
        F.min(F.when(left, t)).alias("left_min"),
        F.min(F.when(right, t)).alias("right_min"),
        F.min(F.when(strong & after, t)).alias("first_after_go"),
    )
    label = label_from_licks_a(F.col("n_left") > 0, F.col("n_right") > 0)
    return agg.withColumn("label", label).withColumns(
        {"ctx_start": F.lit(0.0), "go": F.lit(GO), "n_ctx": F.lit(N_CTX), "n_tgt": F.lit(N_TGT)}
    )


def behavior(sp: DataFrame) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    errors = F.count_if(kind == "error") % 4
    return sp.groupBy("session", "trial").agg(
        F.when(F.max(F.when(kind == "error", value)) > 250, "True").otherwise("False").alias("excluded"),
        F.when(F.count_if((kind == "view") & (value > 200)) > 0, "0.5").alias("photostim_onset"),
        F.when(F.count_if((kind == "click") & (value > 250)) > 0, "1").otherwise("0").alias("auto_water"),
        F.when(errors == 1, "ignore").when(errors == 3, "miss").otherwise("hit").alias("outcome"),
    )


def binned(sp: DataFrame, tr: DataFrame) -> DataFrame:
    from ..operators.raster import bin_windows

    return bin_windows(sp, tr, CTX_BIN, TGT_BIN)


def trial_rules(sp: DataFrame) -> DataFrame:
    """Trials with their behaviour row."""
    return trials(sp).join(behavior(sp), ["session", "trial"], "left")
