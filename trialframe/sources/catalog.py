"""Trial, video and log catalogs from folder layouts. Of trials and videos only paths are read, never file contents;
Spark leaves out files of zero bytes."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import rules as R
from ..operators.joins import join_videos, last_row, priority_lookup
from ..schema import BEHAVIOR_COLUMNS, VIDEO_SUFFIXES, QcRules

# Names of log files, best first; those of a session stand in its folder, the others hold all sessions.
SESSION_LOGS = ("behavioral_master_log_audited.csv", "behavioral_master_log.csv")
COMBINED_LOGS = ("combined_audited_master_log.csv", "combined_behavioral_master_log.csv")
# Cells a log reader takes as missing.
NA_CELLS = ("", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def list_files(spark: SparkSession, root: str, pattern: str = "*.npz") -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.load(root).select("path")


def _part(pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract("path", pattern, group), F.lit(""))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


LAYOUT_A = r"/([^/]+)/Rasters/([^/]+)/([^/]+\.npz)$"
LAYOUT_B = r"/((?i:sub-)[^/]*)/([^/]*ses-[^/]*)/NPZ/([^/]+)/([^/]+\.npz)$"


def catalog_a(files: DataFrame) -> DataFrame:
    """<session>/Rasters/<class>/<trial>.npz."""
    session = _part(LAYOUT_A, 1)
    out = files.select(
        F.lit("A").alias("dataset"), F.concat(F.lit("A/"), session).alias("session"), session.alias("subject"),
        P.trial_number(_stem(_part(LAYOUT_A, 3))).alias("trial"), P.class_folder(_part(LAYOUT_A, 2)).alias("label"),
        F.lit("folder").alias("label_source"), "path",
    )
    return out.where("trial IS NOT NULL AND label IS NOT NULL AND session IS NOT NULL")


def catalog_b(files: DataFrame) -> DataFrame:
    """sub-*/<...ses-...>/NPZ/<class>/<trial>.npz; the session key drops what follows `_behavior`."""
    session_dir = _part(LAYOUT_B, 2)
    short = F.element_at(F.split(session_dir, "_behavior"), 1)
    out = files.select(
        F.lit("B").alias("dataset"), F.concat(F.lit("B/"), short).alias("session"), _part(LAYOUT_B, 1).alias("subject"),
        P.trial_number(_stem(_part(LAYOUT_B, 4))).alias("trial"), P.class_folder(_part(LAYOUT_B, 3)).alias("label"),
        F.lit("folder").alias("label_source"), "path", session_dir.alias("session_dir"),
    )
    return out.where("trial IS NOT NULL AND label IS NOT NULL AND session IS NOT NULL")


def catalog_sessions(files: DataFrame) -> DataFrame:
    """Folders starting with `session`; the class is any part of the path."""
    session = _part(r"(?i)/(session[^/]*)/", 1)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select(
        F.lit("Data").alias("dataset"), session.alias("session"), session.alias("subject"),
        P.trial_number_strict(name).alias("trial"), P.class_in_path(F.col("path")).alias("label"),
        F.lit("folder").alias("label_source"), "path",
    )
    return out.where("trial IS NOT NULL AND label IS NOT NULL AND session IS NOT NULL")


def catalog_data(files: DataFrame, root: str) -> DataFrame:
    """Trials of one root, with its fallbacks.

    Sessions are the folders right under the root that start with `session`; a root without any is a session itself.
    A session with a `Rasters` folder is searched there only. Files right inside a class folder count; a session
    without such files is searched at any depth, the class then being any part of the path below it.
    """
    base = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    top = base.rsplit("/", 1)[-1]
    below = F.expr(f"substring(path, instr(path, {_quoted(base + '/')}) + {len(base) + 1})")
    first = F.element_at(F.split(below, "/"), 1)
    named = F.lower(first).startswith("session") & below.contains("/")
    rows = files.select("path", F.when(named, first).alias("session"), below.alias("below"))
    # one row over all paths: whether the root has sessions
    any_named = rows.agg(F.coalesce(F.bool_or(F.col("session").isNotNull()), F.lit(False)).alias("x")).scalar()
    rows = rows.where(F.col("session").isNotNull() | ~any_named).select(
        "path", F.coalesce("session", F.lit(top)).alias("session"),
        F.when(F.col("session").isNotNull(), F.expr("substring(below, length(session) + 2)")).otherwise(F.col("below")).alias("inner"),
    )
    in_rasters = rows.where(F.col("inner").startswith("Rasters/"))
    found = in_rasters.select("path", "session", F.expr("substring(inner, 9)").alias("inner")).unionByName(
        rows.join(in_rasters.select("session").distinct(), "session", "left_anti").select("path", "session", "inner"))
    return _class_files(found, "Data", "session")


def _class_files(found: DataFrame, dataset: str, subject: str, *keep: str) -> DataFrame:
    """Trials of files (path, session, inner): those right inside a class folder, or else those with a class on their way."""
    folder = F.regexp_extract("inner", "^(Ignore|Left|Right)/[^/]+$", 1)
    direct = found.where(folder != "").withColumn("label", folder)
    deep = found.join(direct.select("session").distinct(), "session", "left_anti").withColumn("label", P.class_in_path(F.col("inner")))
    out = direct.unionByName(deep).select(
        F.lit(dataset).alias("dataset"), "session", F.col(subject).alias("subject"),
        P.trial_number_strict(F.element_at(F.split("path", "/"), -1)).alias("trial"), "label",
        F.lit("folder").alias("label_source"), "path", *keep,
    )
    return out.where("trial IS NOT NULL AND label IS NOT NULL")


def catalog_data2(files: DataFrame, logs: DataFrame | None, rules: QcRules = QcRules()) -> DataFrame:
    """Trials of the second layout with their log rows applied: checked, relabelled, dropped.

    Sessions are the folders with an `NPZ` folder whose name holds `ses-`, or all folders with one if no name does. A
    trial with a log row is kept only if the row passes the behaviour rules; its label is the action of the row, and a
    trial that licked both sides has none and goes. A trial without a row keeps its folder's class.
    """
    pattern = r"^(.*/([^/]+)/([^/]+))/NPZ/(.*)$"
    rows = files.select(
        "path", _part(pattern, 2).alias("parent"), _part(pattern, 3).alias("session"), F.regexp_extract("path", pattern, 4).alias("inner"),
    ).where("session IS NOT NULL")
    any_ses = rows.agg(F.coalesce(F.bool_or(F.col("session").contains("ses-")), F.lit(False)).alias("x")).scalar()
    rows = rows.where(F.col("session").contains("ses-") | ~any_ses)
    rows = rows.withColumn("who", F.when(F.col("parent").startswith("sub-"), F.col("parent")).otherwise(F.col("session")))
    trials = _class_files(rows, "Data2", "who", "parent")
    keys = P.session_keys(F.col("session"), F.col("parent"), F.col("trial")).alias("keys")
    trials = trials.select(*[c for c in trials.columns if c != "parent"], keys)
    columns = ["dataset", "session", "subject", "trial", "label", "label_source", "path"]
    if logs is None:
        return trials.select(*columns)
    found = with_log(trials, logs)
    kept = found.where(~F.col("has_row") | R.keep_behavior_b(set(logs.columns), rules))
    sides = [F.size(P.lick_list(F.col(c))) > 0 for c in ("left_lick_times", "right_lick_times")]
    label, source = R.label_precedence(F.col("label"), F.col("has_row"), *sides, F.col("outcome"), rules)
    return kept.withColumns({"label": label, "label_source": source}).where("label IS NOT NULL").select(*columns)


def discover_trials(
    spark: SparkSession, data: list[str], data2: list[str], logs: list[str] = [], rules: QcRules = QcRules(),
) -> DataFrame:
    """The trial catalog of both layouts. Roots are in order of preference (the demo's last): the first with a trial file
    serves. Combined logs beside the second root come first, then the log files given."""
    root, root2 = first_root(spark, data), first_root(spark, data2)
    parts = []
    if root:
        parts.append(catalog_data(list_files(spark, root), root))
    if root2:
        paths = [x for x in (f"{root2.rstrip('/')}/{name}" for name in COMBINED_LOGS) if _there(spark, x)] or [x for x in logs if _there(spark, x)]
        parts.append(catalog_data2(list_files(spark, root2), read_log(spark, paths) if paths else None, rules))
    if not parts:
        return spark.createDataFrame([], "dataset string, session string, subject string, trial int, label string, label_source string, path string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _there(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def first_root(spark: SparkSession, roots: list[str]) -> str | None:
    """The first root that holds a trial file; a missing root counts as empty."""
    for root in roots:
        try:
            if not list_files(spark, root).isEmpty():
                return root
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def catalog_subjects(files: DataFrame) -> DataFrame:
    """Any `ses-` folder with an NPZ child, with the lookup keys of its log rows."""
    pattern = r"/([^/]+)/([^/]*ses-[^/]*)/NPZ/"
    parent, session = _part(pattern, 1), _part(pattern, 2)
    name = F.element_at(F.split("path", "/"), -1)
    trial = P.trial_number_strict(name)
    out = files.select(
        F.lit("Data2").alias("dataset"), session.alias("session"),
        F.when(parent.startswith("sub-"), parent).otherwise(session).alias("subject"), trial.alias("trial"),
        P.class_in_path(F.col("path")).alias("label"), F.lit("folder").alias("label_source"), "path",
        P.session_keys(session, parent, trial).alias("keys"),
    )
    return out.where("trial IS NOT NULL AND label IS NOT NULL AND session IS NOT NULL")


def first_nonempty(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Files of the first root that holds any."""
    root = first_root(spark, roots)
    return spark.createDataFrame([], "path string") if root is None else list_files(spark, root)


def video_index(spark: SparkSession, root: str) -> DataFrame:
    """Videos by session, class and trial; `Videos` comes after `Video`, then by path."""
    files = list_files(spark, root, "*.{" + ",".join([*VIDEO_SUFFIXES, *[s.upper() for s in VIDEO_SUFFIXES]]) + "}")
    pattern = r"/([^/]+)/(Videos?)/([^/]+)/([^/]+)$"
    return files.select(
        _part(pattern, 1).alias("session_dir"), P.class_folder(_part(pattern, 3)).alias("label"),
        P.trial_number(_stem(_part(pattern, 4))).alias("trial"), F.struct(_part(pattern, 2), F.col("path")).alias("file_pos"),
        F.col("path").alias("video_path"),
    ).where("label IS NOT NULL AND trial IS NOT NULL")


def with_videos(trials: DataFrame, videos: DataFrame, session_dir: str) -> DataFrame:
    named = videos.withColumnRenamed("session_dir", session_dir)
    keyed = trials.withColumnRenamed("session", "_s").withColumnRenamed(session_dir, "session")
    out = join_videos(keyed, named.withColumnRenamed(session_dir, "session"))
    return out.withColumnRenamed("session", session_dir).withColumnRenamed("_s", "session")


def read_log(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Behaviour logs stacked by column name, every cell text, missing cells NULL, with source and position.

    All files are one scan, however many: each is read whole, cut by its own header, and its cells are named. Later paths
    come later in `file_pos`, then later files of a path by name, then later lines of a file. `priority` follows the
    file's name: 0 audited and 1 raw logs of a session, whose rows belong to their folder (`session_dir`), 2 and 3 combined
    logs; null for other names.
    """
    roots = [p.split(":", 1)[-1].rstrip("/").replace("//", "/") for p in paths]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place = next((k for k, x in enumerate(roots) if path.endswith(x) or f"{x}/" in path), len(roots))
                lines = csv.DictReader(io.StringIO(raw.as_py().decode("utf-8-sig"), newline=""))
                while rows := [r for _, r in zip(range(1 << 14), lines, strict=False)]:
                    cells = [[(k, None if v in NA_CELLS else v) for k, v in r.items() if isinstance(k, str) and not isinstance(v, list)] for r in rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(rows)), pa.array([place] * len(rows), pa.int32()), pa.array(range(lines.line_num, lines.line_num + len(rows)), pa.int64()),
                         pa.array(cells, pa.map_(pa.string(), pa.string()))], names=["source_csv", "place", "line", "cells"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    rows = files.mapInArrow(run, "source_csv string, place int, line bigint, cells map<string,string>")
    names = [r[0] for r in rows.select(F.explode(F.map_keys("cells"))).distinct().collect()]  # of columns, not of rows
    columns = [*sorted(names), *[c for c in BEHAVIOR_COLUMNS if c not in names]]
    name = F.element_at(F.split("source_csv", "/"), -1)
    ranks = [F.when(name == x, F.lit(k)) for k, x in enumerate([*SESSION_LOGS, *COMBINED_LOGS])]
    pos = F.struct("place", F.col("source_csv").alias("file"), "line").alias("file_pos")
    out = rows.select(*[F.col("cells")[c].alias(c) for c in columns], "source_csv", pos, F.coalesce(*ranks).alias("priority"))
    own = F.element_at(F.split("source_csv", "/"), -2)
    folder = F.when(F.col("priority") < len(SESSION_LOGS), own).otherwise(F.col("session_dir"))
    return out.withColumns({"session_dir": folder, "trial": F.col("trial").try_cast("double").try_cast("int")})


def best_logs(spark: SparkSession, root: str) -> DataFrame:
    """Of every session below the root the rows of its best log file."""
    names = "{" + ",".join([*SESSION_LOGS, *COMBINED_LOGS]) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    paths = [r[0] for r in found.select("path").orderBy("path").collect()]  # log files, a few for each session
    return session_logs(read_log(spark, paths))


def session_logs(logs: DataFrame, session: str = "session_dir") -> DataFrame:
    """Per session only the rows of its best file, by `priority` (see `read_log`)."""
    best = logs.groupBy(session).agg(F.min("priority").alias("priority"))
    return logs.join(best, [session, "priority"])


def last_log_rows(logs: DataFrame, keys: list[str]) -> DataFrame:
    return last_row(logs.where(F.col("trial").isNotNull()), keys, "file_pos")


def with_log(trials: DataFrame, logs: DataFrame) -> DataFrame:
    """Catalog trials that carry lookup `keys`, with the log row they answer to (`read_log`) and `has_row`.

    The first key with a row of the trial wins, and of its rows the last; a trial without any keeps NULL cells.
    """
    keys = P.behavior_keys(F.col("session_dir"), F.col("session_path"), F.col("subject_id"), F.col("trial"))
    cells = [c for c in logs.columns if c not in ("trial", "file_pos")]
    found = priority_lookup(trials, "keys", logs.withColumn("log_keys", keys), "log_keys", "trial", "file_pos", cells, ["path"])
    return found.withColumn("has_row", F.col("key_rank").isNotNull()).drop("key_rank")
