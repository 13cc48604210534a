"""Incremental build of the trial cache: files that were ingested before are not read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.trial_files import decode_files, trial_units

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_new_trials(spark: SparkSession, root: str, out: str, checkpoint: str) -> None:
    """Decode archives that appeared since the last run and append their unit rows. The stream's file log
    in `checkpoint` remembers what was done, so a restart neither skips nor repeats a file."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.npz")
        .load(root)
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        # the batch number names the folder, so a repeated batch replaces itself
        trial_units(decode_files(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        files.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
