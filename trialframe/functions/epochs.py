"""Column expressions for epochs, analysis windows and licks. Times are seconds, missing is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EPOCH_ALIASES, Windows
from .parsing import finite, scalar


def resolve_epochs(columns: set[str], log_columns: set[str] = frozenset()) -> dict[str, Column]:
    """One expression per epoch scalar.

    `columns` are array columns of the trial file, `log_columns` are text columns `log_<key>` of the
    joined behaviour row. The alias answers only where the canonical array is absent or empty, the log
    only where the file gives no finite number, and go falls back to the end of the delay.
    """
    out: dict[str, Column] = {}
    for key, alias in EPOCH_ALIASES.items():
        from_alias = scalar(F.col(alias)) if alias in columns else F.lit(None).cast("double")
        value = from_alias
        if key in columns:
            has_key = F.coalesce(F.size(F.col(key)) > 0, F.lit(False))
            value = F.when(has_key, scalar(F.col(key))).otherwise(from_alias)
        value = finite(value)
        if f"log_{key}" in log_columns:
            value = F.coalesce(value, finite(F.col(f"log_{key}").try_cast("double")))
        out[key] = value
    out["go_start_times"] = F.coalesce(out["go_start_times"], out["delay_stop_times"])
    return out


def n_bins(start: Column, stop: Column, width: float) -> Column:
    """Bin count with ties rounded to even."""
    return F.bround((stop - start) / F.lit(width)).cast("int")


def context_window(sample_start: Column, delay_start: Column, go: Column, p: Windows) -> tuple[Column, Column, Column]:
    """(start, stop, bins) of the context window; NULL where delay or go is missing."""
    start = delay_start - F.lit(p.pre_delay_s)
    if p.include_sample:
        start = F.coalesce(sample_start, start)
    start = F.when(delay_start.isNotNull() & go.isNotNull(), start)
    return start, go, n_bins(start, go, p.bin_s)


def target_window(go: Column, p: Windows) -> tuple[Column, Column, Column]:
    stop = go + F.lit(p.response_s)
    return go, stop, n_bins(go, stop, p.target_bin_s)


def delay_window_b(
    delay_start: Column, delay_stop: Column, sample_stop: Column, trial_start: Column, go: Column
) -> tuple[Column, Column]:
    """Delay epoch if ordered, else from the end of the sample to go (or 1.2 s later)."""
    ok = F.coalesce(delay_stop > delay_start, F.lit(False))
    start = F.coalesce(sample_stop, trial_start, F.lit(0.0))
    stop = F.coalesce(go, start + F.lit(1.2))
    return F.when(ok, delay_start).otherwise(start), F.when(ok, delay_stop).otherwise(stop)


def lick_window_b(
    first_lick: Column, go: Column, delay_end: Column, trial_stop: Column, window_s: float
) -> tuple[Column, Column]:
    """Opens at the first lick (else go, else delay end); closes at most at the trial end."""
    start = F.coalesce(first_lick, go, delay_end)
    full = start + F.lit(window_s)
    stop = F.least(full, trial_stop)
    return start, F.when(stop <= start, full).otherwise(stop)


def first_lick_a(left: Column, right: Column, go: Column) -> Column:
    """Earliest lick at or after go, relative to go."""
    return F.array_min(F.filter(F.concat(left, right), lambda x: x >= go)) - go


def first_lick_b(left_min: Column, right_min: Column) -> tuple[Column, Column]:
    """(time, side) of the earliest lick, pre-go licks included; a tie is Left."""
    side = (
        F.when(left_min.isNull() & right_min.isNull(), F.lit(None).cast("string"))
        .when(right_min.isNull() | (left_min <= right_min), "Left")
        .otherwise("Right")
    )
    return F.least(left_min, right_min), side


def epoch_spans(cols: dict[str, Column], delay: tuple[Column, Column], lick: tuple[Column, Column]) -> Column:
    """Array of six (epoch, start, stop) structs, for `inline`."""
    start = F.coalesce(cols["trial_start"], F.lit(0.0))
    stop = F.coalesce(cols["trial_stop"], start + F.lit(5.0))
    spans = {
        "trial": (start, stop),
        "presample": (
            F.coalesce(cols["presample_start_times"], start),
            F.coalesce(cols["presample_stop_times"], start),
        ),
        "sample": (F.coalesce(cols["sample_start_times"], start), F.coalesce(cols["sample_stop_times"], start)),
        "delay": delay,
        "go": (F.coalesce(cols["go_start_times"], delay[1]), F.coalesce(cols["go_stop_times"], stop)),
        "lick": lick,
    }
    return F.array(
        *[
            F.struct(F.lit(name).alias("epoch"), a.alias("epoch_start"), b.alias("epoch_stop"))
            for name, (a, b) in spans.items()
        ]
    )
