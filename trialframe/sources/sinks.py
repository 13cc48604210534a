"""Write and read the stores of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Windows


def save_cache(binned: DataFrame, root: str, windows: Windows) -> str:
    """Binned counts by session under a folder named after the settings; only the sessions present are replaced.

    The settings themselves are kept beside the counts in `_settings`, which readers of the counts leave out.
    """
    path = f"{root}/{windows.key()}"
    binned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path)
    binned.sparkSession.createDataFrame([(windows.settings(),)], "value string").write.mode("overwrite").text(f"{path}/_settings")
    return path


def load_cache(spark: SparkSession, root: str, windows: Windows) -> DataFrame:
    return spark.read.parquet(f"{root}/{windows.key()}")


def missing_sessions(trials: DataFrame, cached: DataFrame) -> DataFrame:
    """Trials of sessions the cache does not hold yet."""
    return trials.join(cached.select("session").distinct(), "session", "left_anti")


def save_table(df: DataFrame, path: str, by: list[str] | None = None, form: str = "csv") -> None:
    """QC log, catalog, selection tables, predictions or splits."""
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*by) if by else writer
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(form).save(path)


def payload(summary: DataFrame, top: DataFrame, name: str = "selected", most: int = 100) -> DataFrame:
    """One JSON document: the fields of the one-row summary and a short list of rows; a longer list is an error."""
    found = F.collect_list(F.struct(*top.columns))
    message = F.lit(f"a report holds {most} rows at most")
    # no more than one row too many is ever gathered
    rows = top.limit(most + 1).agg(F.when(F.size(found) > most, F.raise_error(message)).otherwise(found))
    both = summary.withColumn(name, rows.scalar())
    return both.select(F.to_json(F.struct(*both.columns)).alias("value"))


def save_payload(doc: DataFrame, path: str) -> None:
    doc.write.mode("overwrite").text(path)


def load_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Result documents of several runs with the run folder as `mode`."""
    run: Column = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.json(pattern).withColumn("mode", run)
