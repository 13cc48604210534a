"""Settle intermediate tables in storage that all executors share, so a lost executor repeats little work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Shuffle files go when the query that made them ends, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, one in the session's warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_settled")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a small or narrow table: its partitioning stays known to later steps."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write a table as Parquet and read it back: later steps prune columns and push filters.

    Nothing reads the shuffles of the write again, so their files go with it."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANED)
    conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANED, before)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled.settled_at = path
    return settled


def forgotten(*tables: DataFrame) -> None:
    """Delete tables that `written` has made and nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def file_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of files below a path and a hash of their names, times and lengths: a listing by the driver, without a job."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return len(found), hash(tuple(sorted(found)))
