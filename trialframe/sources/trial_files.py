"""Trial archives to tables: one decode per file inside the tasks, Parquet from then on."""

from __future__ import annotations

import io
import pickle
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import region_canon_a
from ..schema import EPOCH_ALIASES, REGIONS, SPLIT_KEYS

EPOCH_FIELDS = [name for pair in EPOCH_ALIASES.items() for name in pair]
LICKS = ["left_lick_times", "right_lick_times"]
SCHEMA = (
    "path string, load_error string, "
    + ", ".join(f"{f} array<string>" for f in [*EPOCH_FIELDS, *LICKS])
    + ", units array<struct<region_raw: string, unit_index: int, unit_id: string, spike_times: array<double>>>"
    + ", members array<struct<key: string, shape: string, dtype: string>>"
)


class _ArraysOnly(pickle.Unpickler):
    """Object arrays are pickles from outside: only the names needed to rebuild arrays are allowed."""

    allowed = {
        (m, n)
        for m in ("numpy", "numpy.core.multiarray", "numpy._core.multiarray", "numpy._core.numeric", "numpy.core.numeric")
        for n in ("ndarray", "dtype", "_reconstruct", "scalar", "_frombuffer")
    }

    def find_class(self, module: str, name: str):
        if (module, name) in self.allowed:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a trial file")


def _member(data: bytes) -> np.ndarray:
    buf = io.BytesIO(data)
    version = np.lib.format.read_magic(buf)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, _, dtype = read(buf)
    if dtype.hasobject:
        return np.asarray(_ArraysOnly(buf).load(), dtype=object).reshape(shape)
    buf.seek(0)
    return np.lib.format.read_array(buf, allow_pickle=False)


def _texts(arrays: dict, key: str) -> list[str] | None:
    return [str(v) for v in np.ravel(arrays[key])] if key in arrays else None


def _times(values) -> list[float]:
    return [float(v) for v in np.ravel(np.asarray(values, dtype=float))]


def _units(arrays: dict) -> list[dict]:
    if "brain_region" in arrays and "spike_times" in arrays:
        regions = _texts(arrays, "brain_region")
        ids = _texts(arrays, "unit_ids") or [str(i) for i in range(len(regions))]
        return [
            {"region_raw": r, "unit_index": i, "unit_id": u, "spike_times": _times(t)}
            for i, (r, u, t) in enumerate(zip(regions, ids, arrays["spike_times"]))
        ]
    missing = [k for k in SPLIT_KEYS.values() if k not in arrays]
    if missing:
        raise KeyError(f"neither combined nor split spike arrays; missing {missing}")
    return [
        {"region_raw": region, "unit_index": i, "unit_id": str(i), "spike_times": _times(t)}
        for region, key in SPLIT_KEYS.items()
        for i, t in enumerate(np.ravel(arrays[key]))
    ]


def _decode(path: str, content: bytes) -> dict:
    row: dict = {"path": path, "load_error": None, "units": None, "members": None, **dict.fromkeys([*EPOCH_FIELDS, *LICKS])}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            arrays = {n.removesuffix(".npy"): _member(z.read(n)) for n in z.namelist() if n.endswith(".npy")}
        row.update({f: _texts(arrays, f) for f in [*EPOCH_FIELDS, *LICKS]})
        row["members"] = [{"key": k, "shape": str(v.shape), "dtype": str(v.dtype)} for k, v in arrays.items()]
        row["units"] = _units(arrays)
    except Exception as e:  # a broken file is a row with its error, not a failed job
        row["load_error"] = str(e)
    return row


def read_trials(spark: SparkSession, root: str) -> DataFrame:
    """One row per archive: epoch and lick arrays as text, units with spike times, or the load error."""
    return decode_files(
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(root)
    )


def decode_files(files: DataFrame) -> DataFrame:
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")[:2]] + EPOCH_FIELDS + LICKS + ["units", "members"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                # one archive at a time keeps the memory of a task at one trial
                yield pd.DataFrame([_decode(path, content)], columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def trial_units(decoded: DataFrame, canon=region_canon_a, regions: tuple[str, ...] = REGIONS) -> DataFrame:
    """Unit rows of the given regions; unit is the position inside the region, per trial file.

    Units are numbered inside the array of their file, so no spike times are shuffled.
    """
    unit = lambda u: F.struct(
        u["unit_index"].alias("at"), canon(u["region_raw"]).alias("region"), u["unit_id"].alias("unit_id"), u["spike_times"].alias("spike_times"))
    ordered = decoded.where("load_error IS NULL").select("path", F.array_sort(F.transform("units", unit)).alias("ordered"))

    def of(region: str):
        own = F.filter("ordered", lambda u: u["region"] == region)
        return F.transform(own, lambda u, i: F.struct(
            F.lit(region).alias("region"), i.cast("long").alias("unit"), u["unit_id"].alias("unit_id"), u["spike_times"].alias("spike_times")))

    return ordered.select("path", F.inline(F.flatten(F.array(*[of(r) for r in regions]))))


def unknown_region_counts(decoded: DataFrame, canon=region_canon_a) -> DataFrame:
    rows = decoded.where("load_error IS NULL").select("path", F.inline("units"))
    return rows.groupBy("path").agg(F.count_if(canon(F.col("region_raw")).isNull()).alias("n_unknown_region"))


def inspect(decoded: DataFrame) -> DataFrame:
    """Keys, shapes and types of every archive."""
    return decoded.select("path", F.inline("members"))
